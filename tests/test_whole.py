"""Queries against brute force on small tables, none of whose rows or words may be left out."""

import collections
import math
import re

import numpy as np

from codexlake.plans.queries import QUERIES


def brute_class_tfidf(rows, least=3, most=0.35):
    n = collections.Counter()
    for cluster, text in rows:
        words = [w for w in re.findall(r"\w+", (text or "").lower()) if re.fullmatch("[a-zA-Z]{2,}", w) and w not in ("the", "of")]
        n.update((cluster, " ".join(words[i : i + k])) for k in (2, 3, 4) for i in range(len(words) - k + 1))
    df, clusters = collections.Counter(g for _, g in n), len({c for c, _ in rows})
    n = {k: v for k, v in n.items() if least <= df[k[1]] <= most * clusters}
    size = collections.Counter()
    for (c, _), v in n.items():
        size[c] += v
    got = set()
    for c in size:
        weighed = [(-round(v / size[c] * (math.log((clusters + 1) / (df[g] + 1)) + 1), 9), g, v) for (x, g), v in n.items() if x == c]
        got |= {(c, g, v, round(-w, 6)) for w, g, v in sorted(weighed)[:10]}
    return got


def test_class_tfidf_counts_long_texts_and_longer_grams(spark, tmp_path):
    phrase = [" ".join(chr(97 + k) + x for x in ("one", "two", "three", "four")) for k in range(10)]  # each in three clusters of ten
    rows = [(chr(97 + c), " ".join(f"{phrase[(c + (j + d) % 3) % 10]} été-ci nci{'z' * (j % 5)} the of{j % 4}" for j in range(2 + 12 * d))) for c in range(10) for d in range(3)]
    rows += [("a", f"only{'k' * i} {phrase[0]}") for i in range(2, 5)] + [("b", None), ("c", "")]
    assert any(len(t or "") > 600 for _, t in rows)
    spark.createDataFrame([(c, t, len(t or "")) for c, t in rows], "source string, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["cluster"], r["term"], r["n"], r["weight"]) for r in QUERIES["class_tfidf"](spark, str(tmp_path)).collect()}
    assert got == brute_class_tfidf(rows) and any(t.count(" ") == 3 for _, t, _, _ in got)


def test_merging_follows_the_means_of_members(spark):
    from codexlake.operators import clusters

    rng = np.random.default_rng(4)
    vectors = {c: rng.normal(size=(5 + c, 6)) + 2 * rng.normal(size=6) for c in range(8)}
    unit = {c: v / np.linalg.norm(v, axis=1, keepdims=True) for c, v in vectors.items()}
    held = {c: list(v) for c, v in unit.items()}
    of = {c: c for c in held}
    while len(held) > 3:
        names = sorted(held)
        m = np.stack([np.mean(held[c], axis=0) for c in names])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        s = m @ m.T
        np.fill_diagonal(s, -np.inf)
        i, j = np.unravel_index(np.argmax(s), s.shape)
        if s[i, j] < 0.2:
            break
        a, b = names[min(i, j)], names[max(i, j)]
        held[a] += held.pop(b)
        of = {c: a if x == b else x for c, x in of.items()}
    want = {c: sorted(held).index(x) for c, x in of.items()}
    df = spark.createDataFrame([(10 * c + k, c, [float(y) for y in x]) for c, v in unit.items() for k, x in enumerate(v)], "id long, cluster int, vector array<double>")
    assert {r["cluster"]: r["merged"] for r in clusters.merged_clusters(clusters.centroids(df), 0.2, 3).collect()} == want


def test_abstracts_have_all_words(spark, tmp_path):
    rows = [(1, " ".join(f"w{i % 70}" for i in range(500))), (2, "a  b\n a"), (3, " "), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["abstract"] for r in QUERIES["inverted_index_abstracts"](spark, str(tmp_path)).collect()}
    assert got == {1: rows[0][1], 2: "a b a"}


def test_abstracts_are_built_within_the_row(spark, tmp_path):
    rows = [(1, "b a b a"), (1, "b  c"), (None, "c c"), (2, "\n"), (3, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["inverted_index_abstracts"](spark, str(tmp_path))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert collections.Counter(map(tuple, df.collect())) == {(1, "b a b a"): 1, (1, "b c"): 1, (None, "c c"): 1, (2, ""): 1, (3, "x"): 1}


def test_inverted_index_has_each_words_places(spark):
    from pyspark.sql import functions as F

    from codexlake.functions.nested import inverted_index

    rows = [(0, "b a b a c"), (1, ""), (2, None), (3, "z")]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "k int, t string").select("k", inverted_index(F.col("t"))).collect()}
    assert got == {0: {"a": [1, 3], "b": [0, 2], "c": [4]}, 1: {"": [0]}, 2: None, 3: {"z": [0]}}


def test_diverse_ranking_is_a_permutation_of_each_cluster(spark, tmp_path):
    rng = np.random.default_rng(2)
    sizes = {0: 450, 1: 3, 2: 1}
    rows = [(i, c, rng.normal(c, 1, 8).round(3).tolist()) for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))] + [(999, 1, [0.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = collections.defaultdict(list)
    for r in QUERIES["diverse_ranking"](spark, str(tmp_path)).orderBy("cluster", "rank").collect():
        assert r["rank"] == len(got[r["cluster"]]) + 1
        got[r["cluster"]].append(r["id"])
    for c in sizes:
        members = {i: np.array(x, dtype=np.float32).astype(float) for i, k, x in rows if k == c}
        assert sorted(got[c]) == sorted(members)
        centre = np.mean(list(members.values()), axis=0)
        unit = {i: x / max(np.linalg.norm(x), 1e-300) for i, x in members.items()}
        relevance = {i: x @ centre / np.linalg.norm(centre) for i, x in unit.items()}
        for k, i in enumerate(got[c]):
            value = lambda j: 0.7 * relevance[j] - 0.3 * max((unit[j] @ unit[x] for x in got[c][:k]), default=0)  # noqa: B023, E731
            assert value(i) > max(map(value, got[c][k : k + 40])) - 1e-9
