"""class_tfidf's first count by hashes: what is shuffled, the cut of the most frequent terms, and the packed form."""

import collections
import random

import numpy as np

from codexlake.operators import clusters, terms
from codexlake.plans.queries import QUERIES
from test_whole import brute_class_tfidf


def shuffled(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_class_tfidf_shuffles_few_bytes_an_ngram(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    phrase = [[word() for _ in range(4)] for _ in range(40)]
    rows = []
    for c in range(10):
        for _ in range(4):
            w = [x for _ in range(1250) for x in ([word() for _ in range(4)] if rng.random() < 0.9 else phrase[(c + rng.randrange(3)) % 10 * 4 + rng.randrange(4)])]
            rows.append((f"c{c}", " ".join(w)))
    spark.createDataFrame(rows, "source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    before = shuffled(spark)
    got = {(r["cluster"], r["term"], r["n"], r["weight"]) for r in QUERIES["class_tfidf"](spark, str(tmp_path)).collect()}
    assert got == brute_class_tfidf(rows) and len(got) == 100
    assert shuffled(spark) - before < 4 * sum(len(t) for _, t in rows)


def test_the_most_frequent_terms_are_cut_as_in_sql(spark):
    rng = random.Random(5)
    rows = [(c, " ".join(rng.choices(["ab", "cd", "ef", "gh", "ij", "kl", "mn"], k=rng.randrange(0, 12)))) for c in range(12) for _ in range(3)] + [(None, "ab cd ef gh"), (3, None)]
    n = collections.Counter()
    for c, text in rows:
        w = (text or "").split()
        n.update((c, " ".join(w[i : i + k])) for k in (2, 3, 4) for i in range(len(w) - k + 1))
    within, total = collections.Counter(t for _, t in n), collections.Counter()
    for (_, t), x in n.items():
        total[t] += x
    valid = sorted((t for t in total if 3 <= within[t] <= 0.35 * 12), key=lambda t: (-total[t], t))
    df = spark.createDataFrame(rows, "cluster int, text string")
    for features in (1, len(valid) // 3, len(valid) // 2, 10 * len(valid)):
        got = {(r["cluster"], r["term"], r["n"]) for r in clusters.class_tfidf(df, [], top=1000, features=features).collect()}
        assert got == {(c, t, x) for (c, t), x in n.items() if t in valid[:features]}


def test_nothing_to_count(spark):
    assert clusters.class_tfidf(spark.createDataFrame([("a", None), ("b", "one")], "cluster string, text string"), []).collect() == []
    assert clusters.class_tfidf(spark.createDataFrame([], "cluster string, text string"), []).collect() == []


def test_packed_counts_come_back(spark):
    rng = np.random.default_rng(0)
    h, c, n = np.sort(rng.integers(0, 1 << 64, 5000, dtype=np.uint64)), rng.integers(-9, 9, 5000), rng.integers(1, 1 << 40, 5000)
    assert all((a == b).all() for a, b in zip(terms.unpacked(*terms.packed(h, c, n)), (h, c, n), strict=True))
    places = {k: at.tolist() for k, at, _ in terms.gram_hashes(np.arange(9, dtype=np.uint64), np.array([3, 0, 1, 5]), 2, 4)}
    assert places == {2: [0, 1, 4, 5, 6, 7], 3: [0, 4, 5, 6], 4: [4, 5]}
