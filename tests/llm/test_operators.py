import collections
import json
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest

from codexlake.llm import common, decontamination, html_text, jaccard, language, line_dedup, packing, quality, registry, suffix_dedup, token_files, tokens, toxicity
from conftest import DATA

TEXTS = [None, "", "a", "One two three. " * 40, "One two three. " * 40, "x y z\n" * 9, " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(395)) + " q", "L1\nL2\nL3\nend", "L1\nL2\nL3\nfin", "é" * 900, "tab\tx  y \n z, k. O'k 12"]


@pytest.fixture(scope="module")
def docs(spark):
    common.prepare(spark)
    rows = [(i, t, "en" if i % 2 else None, None, 1) for i, t in enumerate(TEXTS)] + [(None, "no id here", "de", "s", 1), (3, TEXTS[3], "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def none(spark):
    return common.prepare(spark).createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def where(spark):
    return common.shared_dir(spark)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, same, name):
    same(registry.QUERIES[name](spark, DATA), registry.ORACLE[name])


@pytest.mark.parametrize("name, kept", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_tokens_are_those_of_whole_texts(name, kept):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.vocabulary_path(name))
    whole.encode_special_tokens = True
    texts = [t or "" for t in TEXTS] + ["a  b", " lead", "x\n\ny", "x \n y", "A...\nB", "Σας ΣΑΣ, ok", "12,5 3.", "<|endoftext|> hi", ", ,", "q.\nr\ts.\nT", "x" * 9000 + " y"]
    got = tokens.PieceTokenizer(tokens.vocabulary_path(name), kept).ids(texts)
    assert [x.tolist() for x in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_packing_covers_every_id_once(spark, docs, none):
    path = tokens.vocabulary_path("word_bpe_49k.json")
    rows = packing.pack(docs.select("doc_id", "text").coalesce(1), path, length=64).collect()
    at = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 64
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert packing.pack(none, path).count() == 0


def test_cheapest_ends_are_the_brute_force_ones():
    rng = np.random.default_rng(1)
    for _ in range(20):
        pos = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 30))])
        penalty = rng.choice([0, 3, 7], len(pos))
        best = [0] + [10**9] * (len(pos) - 1)
        for j in range(1, len(pos)):
            for i in range(j):
                n = int(pos[j] - pos[i])
                if n <= 16:
                    best[j] = min(best[j], best[i] + int(penalty[j]) + (0 if n & (n - 1) == 0 else 16 - n))
        ends = packing.window_ends(pos, penalty, 16)
        begins = [0, *ends[:-1]]
        cost = sum((0 if (n := e - b) & (n - 1) == 0 else 16 - n) + int(penalty[list(pos).index(e)]) for b, e in zip(begins, ends))
        assert cost == best[-1]


def test_token_files_round_trip(spark, docs, none, tmp_path):
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    manifest = token_files.write_tokens(docs, f"file://{tmp_path}/t", path, True, 0)
    rows = token_files.read_tokens(manifest).orderBy("start").collect()
    t = tokens.PieceTokenizer(path, True)
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = np.append(t.ids([r["text"] or ""])[0], np.uint32(0)).astype("<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in rows] == want
    reader = token_files.TokenFileReader(manifest.orderBy("part").first()["uri"])
    assert reader.frames_read == 0
    assert token_files.read_tokens(token_files.write_tokens(none, f"file://{tmp_path}/n", path, True, 0)).count() == 0


def test_damaged_frames_are_noticed(tmp_path):
    uri = f"file://{tmp_path}/x.zst"
    w = token_files.TokenFileWriter(uri)
    for k in range(3):
        w.add(k, np.arange(100_000, dtype=np.uint32) % 50_000)
    w.close()
    raw = (tmp_path / "x.zst").read_bytes()
    n, descriptor, magic = int.from_bytes(raw[-9:-5], "little"), raw[-5], int.from_bytes(raw[-4:], "little")
    sizes = [int.from_bytes(raw[-9 - 12 * (n - k) :][:4], "little") for k in range(n)]
    assert magic == 0x8F92EAB1 and descriptor == 0x80 and sum(sizes) + 8 + 12 * n + 9 == len(raw)  # the public seekable layout
    with pytest.raises(ValueError):
        token_files.TokenFileWriter(f"file://{tmp_path}/y.zst").add(1, np.array([70_000], dtype=np.uint32))
    r = token_files.TokenFileReader(uri)
    assert r.get(1)[0].tolist() == (np.arange(100_000) % 50_000).tolist() and r.frames_read == 1
    raw = bytearray((tmp_path / "x.zst").read_bytes())
    raw[3000] ^= 255
    (tmp_path / "x.zst").write_bytes(raw)
    with pytest.raises(Exception):
        token_files.TokenFileReader(uri).get(0)


def brute_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    up = {d: d for d in sets}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


def test_jaccard_components(spark, docs, none):
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in range(300)]
    edited = [(1000 + k, " ".join(f"e{k}" if rng.random() < 0.01 * (k % 5) else w for w in base)) for k in range(60)]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + edited
    got = {r["doc_id"]: (r["n"], r["component"]) for r in jaccard.classes_of(spark.createDataFrame(rows, "doc_id long, text string"), where(spark)).collect()}
    assert got == brute_components(rows)
    assert jaccard.classes_of(docs, where(spark)).count() == docs.count()
    assert jaccard.classes_of(none, where(spark)).count() == 0


def test_long_entries_and_salts_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRED", 1)
    monkeypatch.setattr(jaccard, "SALTED", 3)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    rng = np.random.default_rng(13)
    base = [[f"{g}v{i}" for i in range(120)] for g in "abc"]
    rows = [(k, " ".join(f"e{k}" if rng.random() < 0.004 * (k % 9) else w for w in base[k % 3])) for k in range(150)] + [(900 + k, " ".join(base[0][: 60 + 5 * k])) for k in range(12)]
    got = {r["doc_id"]: (r["n"], r["component"]) for r in jaccard.classes_of(spark.createDataFrame(rows, "doc_id long, text string"), where(spark)).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) > 4


def test_shared_passages_that_the_sketch_takes_for_rare(spark, monkeypatch):
    """As in a corpus so large that the sketch tells nothing: no shingle is frequent, and passages in 40 unlike documents each are long entries."""
    monkeypatch.setattr(jaccard, "order_classes", lambda scan: (np.zeros(1 << jaccard.SKETCH_BITS, dtype=np.uint8), 7))
    monkeypatch.setattr(jaccard, "PART_TOKENS", 1000)
    monkeypatch.setattr(jaccard, "ROOM_TOKENS", 10_000, raising=False)
    monkeypatch.setattr(jaccard, "ROOM", 0, raising=False)
    sent, put = [], jaccard.written

    def written(df, place, name):
        out = put(df, place, name)
        if name == "block_nodes":
            sent.append(out.selectExpr("sum(size(blocks))").first()[0] or 0)
        return out

    monkeypatch.setattr(jaccard, "written", written)
    rng = np.random.default_rng(15)
    words = [[f"d{k}w{i}" for i in range(40)] + [f"p{k % 6}w{i}" for i in range(30)] + [f"d{k}x{i}" for i in range(40)] for k in range(240)]
    rows = [(k, " ".join(x)) for k, x in enumerate(words)] + [(1000 + k, " ".join(w if rng.random() > 0.01 else "z" for w in words[k])) for k in range(60)]
    got = {r["doc_id"]: (r["n"], r["component"]) for r in jaccard.classes_of(spark.createDataFrame(rows, "doc_id long, text string"), where(spark)).collect()}
    assert got == brute_components(rows) and 240 < len({c for _, c in got.values()}) < 290
    assert max(sent, default=0) <= 150 and sum(sent) <= len(rows)  # sets sent to blocks, of some 106 tokens


def test_blocks_are_sent_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    sent, put = [], jaccard.written

    def written(df, place, name):
        out = put(df, place, name)
        if name == "block_nodes":
            sent.append(out.selectExpr("sum(size(blocks))").first()[0] or 0)
        return out

    monkeypatch.setattr(jaccard, "written", written)
    base = [f"v{i}" for i in range(40)]
    rows = [(k, " ".join([*base, *(f"e{k % 30}w{i}" for i in range(25)), f"z{k}"])) for k in range(60)]  # k and k + 30 differ in a word
    held = {d: jaccard.shingle_set(t) for d, t in rows}
    key = {d: jaccard.set_key(x) for d, x in held.items()}
    members = spark.createDataFrame([(1, key[d], len(held[d]), key[d]) for d, _ in rows], "entry long, key long, n int, c long")
    reps = spark.createDataFrame([(key[d], d) for d, _ in rows], "key long, id long")
    links = jaccard.block_compared(members, reps, spark.createDataFrame(rows, "doc_id long, text string"), where(spark), 8000).collect()
    ids = {k: d for d, k in key.items()}
    assert sorted(tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in links) == [(k, k + 30) for k in range(30)]
    assert len(sent) > 2 and max(sent) <= sum(sent) / 2


def test_blocks_link_what_pairs_link():
    rng = np.random.default_rng(14)
    pool = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool[: 60 + 40 * (k % 9)], 40 + 5 * (k % 9), replace=False)) for k in range(60)] + [np.sort(pool[:50]), np.sort(pool[:49])]

    def joined(pairs, n):
        up = list(range(n))

        def top(a):
            while up[a] != a:
                a = up[a]
            return a

        for i, j in pairs:
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
        return [top(i) for i in range(n)]

    link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    n = len(sets)
    every = [(i, j) for i in range(n) for j in range(i) if link(sets[i], sets[j])]
    assert every and joined(jaccard.block_links(sets, None, list(range(n)), []), n) == joined(every, n)
    half = n // 2
    found = jaccard.block_links(sets[:half], sets[half:], list(range(half)), list(range(half, n)))
    assert joined([(i, half + j) for i, j in found], n) == joined([(i, j) for i, j in every if (i < half) != (j < half)], n)
    assert jaccard.histogram(np.zeros(0, dtype=np.uint64)) is None and jaccard.histogram(np.arange(1 << 15, dtype=np.uint64)) is None


def test_different_texts_under_one_id_stay_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b), (3, b), (4, "c d"), (5, None), (5, ""), (None, a), (None, "own"), (7, "c d"), (7, "c d")]
    df = spark.createDataFrame([(d, t, "u", "v") for d, t in rows], "doc_id long, text string, id string, key string")
    left = sorted(((r["doc_id"], r["text"]) for r in jaccard.stage(spark, df, DATA).collect()), key=repr)
    assert len(left) == 6 and {(4, "c d"), (5, None), (5, ""), (None, "own")} <= set(left)  # and one row each for a and b
    assert {t for _, t in left if t and len(t) > 20} == {a, b}


def test_short_hashes_bound_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) // np.uint64(1 << 40) * np.uint64(1 << 40)) for n in (1, 40, 900, 70_000)]
    sets += [np.unique(np.concatenate([s[::2], sets[2][:300]])) for s in sets]
    short = [(s >> np.uint64(48)).astype("<u2") for s in sets]
    for a, x in zip(sets, short):
        exact = [len(np.intersect1d(a, b)) for b in sets]
        assert [jaccard.exactly_shared(a, b) for b in sets] == exact
        assert all(n <= m <= min(len(a), len(b)) for n, m, b in zip(exact, jaccard.most_shared(x, short), sets))


def test_repeated_strings(spark, docs, none):
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(5000)]
    shared = " ".join(rng.choice(words, 120))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50 + k, " ".join(rng.choice(words, 60)) + " " + shared[k : 450 + 9 * k] + " " + " ".join(rng.choice(words, 60))) for k in range(9)] + [(99, "ab" * 1000)]
    count = collections.Counter(r[i : i + 400] for _, t in rows for r in [(t or "").encode()] for i in range(len(r) - 399))
    seen = set()
    for keep in ("none", "first"):
        got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), where(spark), keep).collect()}
        if keep == "none":
            for d, t in rows:
                r = (t or "").encode()
                gone = bytearray(len(r))
                for i in range(len(r) - 399):
                    if count[r[i : i + 400]] > 1:
                        gone[i : i + 400] = b"\1" * 400
                assert got[d] == (len(r), bytes(b for b, g in zip(r, gone) if not g)), d
        else:
            assert got[3][1] and not got[4][1]  # the first copy stays
            seen.update(got)
    assert suffix_dedup.dedup(docs, where(spark)).count() == docs.count() and suffix_dedup.dedup(none, where(spark)).count() == 0


@pytest.mark.parametrize("hot", [1, 5])
def test_hot_anchors_give_the_same(spark, monkeypatch, hot):
    rng = np.random.default_rng(8)
    shared = " ".join(f"s{i}" for i in rng.integers(0, 999, 150))
    rows = [(k, " ".join(f"u{k}_{i}" for i in range(30)) + shared[: 420 + 3 * k] + "!" * (k % 2)) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in ("none", "first"):
        got = lambda: sorted(map(repr, suffix_dedup.dedup(df, where(spark), keep).select("doc_id", "kept", "passages").collect()))  # noqa: B023, E731
        monkeypatch.setattr(suffix_dedup, "HOT", 1000)
        usual = got()
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        assert got() == usual


def test_factor_arrays_are_the_brute_force_ones():
    rng = np.random.default_rng(9)

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    for _ in range(150):
        m, least = int(rng.integers(1, 9)), int(rng.integers(1, 9))
        lefts = [bytes(rng.integers(97, 99, rng.integers(0, 9)).tolist()) for _ in range(m)]
        rights = [b"zzz" + bytes(rng.integers(97, 99, rng.integers(0, 9)).tolist()) for _ in range(m)]
        if m > 3:
            lefts[1], rights[2], lefts[3], rights[3] = lefts[0], rights[0], lefts[0], rights[0]
        got = {}
        for i, a, b, p, q in suffix_dedup.factor_runs(lefts, rights, least):
            for d in range(a, b + 1):
                assert (i, d) not in got
                got[i, d] = (d + p if p else 0, d + q if q else 0)
        for i in range(m):
            for d in range(len(lefts[i]) + 1):
                of = lambda js: max((d + common(rights[i], rights[j]) for j in js if lefts[j][:d] == lefts[i][:d] and len(lefts[j]) >= d), default=0)  # noqa: B023, E731
                want = (of(range(i)), of(range(i + 1, m)))
                assert tuple(x if x >= least else 0 for x in got.get((i, d), (0, 0))) == tuple(x if x >= least else 0 for x in want)


def test_passages_and_texts_beyond_a_chunk(spark):
    rng = np.random.default_rng(10)
    words = [f"w{i}" for i in range(9000)]
    passage = " ".join(f"pp{i}" for i in range(60))  # over 50 words, over 256 and under 400 bytes
    assert 256 < len(passage) < 390
    long = " ".join(rng.choice(words, 2 * suffix_dedup.CHUNK // 5))
    edge = long[suffix_dedup.CHUNK - 300 : suffix_dedup.CHUNK + 300]  # stands across a chunk's edge
    rows = [(1, long), (2, "a " + edge + " b"), (3, f"x {passage} y"), (4, f"z {passage}"), (5, "clean " * 3), (6, None)]
    got = {r["doc_id"]: (sum(x["e"] - x["s"] for x in r["removed"]), max((x["words"] for x in r["passages"]), default=0)) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), where(spark), "none").collect()}
    assert got[1][0] == got[2][0] >= 600 and got[3][0] == got[4][0] == 0
    assert got[3][1] >= 60 and got[4][1] >= 60 and got[5] == got[6] == (0, 0)


def test_line_dedup_edges(spark, docs, none):
    out = {r["doc_id"]: r["text"] for r in line_dedup.stage(spark, docs.filter("doc_id <> 3"), DATA).collect()}
    assert out[8] == "L1\nL2\nL3\nend" and out[9] == "fin" and out[0] is None and out[1] == ""
    copies = spark.createDataFrame([(1, "a\nb\nc", "x"), (2, "a\nb\nc", "y"), (3, "\n\n", "z")], "doc_id long, text string, n_removed string")
    assert sorted(map(tuple, line_dedup.stage(spark, copies, DATA).collect())) == [(1, "a\nb\nc", "x"), (3, "\n\n", "z")]  # what stands in an earlier one goes whole
    assert line_dedup.stage(spark, none, DATA).count() == 0


def test_line_dedup_of_a_text_of_many_lines(spark):
    lines = [f"line {i} of it" for i in range(30_000)]
    own = [f"line {i} of its own" for i in range(15_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:15_000] + own))], "doc_id long, text string")
    began = time.time()
    out = {r["doc_id"]: r["text"] for r in line_dedup.stage(spark, docs, DATA).collect()}
    assert out == {1: "\n".join(lines), 2: "\n".join(own)}
    assert time.time() - began < 20  # a text is split once, not for each line that stays


def test_base_counts():
    assert quality.base_counts("a b c a b c\n\nx #\nx #") == (10, 10, 2, 1, 6, 3, 5)
    assert quality.base_counts("") == (0, 0, 0, 0, 0, 0, 0)


def test_quality_edges(spark, docs, none):
    rows = quality.judged(docs, where(spark)).collect()
    assert len(rows) == docs.count() and not any(r["kept"] for r in rows if r["n_words"] < 50)
    assert quality.judged(none, where(spark)).count() == 0


def test_languages(spark, docs):
    rows = registry.QUERIES["op9_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    held = rows.filter("held_out")
    assert held.filter("lang = lang_pred").count() > 0.98 * held.count()
    assert language.fit(docs.filter("lang = 'none'")).predict("text") == ("und", 0.0)
    many = spark.createDataFrame([(i, f"{chr(0x4E00 + i) * 4} {chr(0x5E00 + i) * 3}", f"l{i:03}") for i in range(150)], "doc_id long, text string, lang string")
    known = language.fit(many)
    assert [known.predict(f"{chr(0x5E00 + i) * 3}")[0] for i in (0, 70, 149)] == ["l000", "l070", "l149"] and known.predict("zzz")[1] == 0
    filters = language.fit(docs.filter("lang is not null"))
    assert filters.predict(None) == ("und", 0.0) and filters.predict("12 !") == ("und", 0.0) and filters.predict("zz")[0] in ("en", "de")


def test_toxicity(spark, docs, none):
    rows = registry.QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out")
    right, bad, found = rows.filter("toxic = predicted").count(), rows.filter("toxic = 1").count(), rows.filter("toxic = 1 and predicted = 1").count()
    assert right > 0.98 * rows.count() and found > 0.9 * bad
    labels = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, *toxicity.fit(docs, labels)).filter("score >= 0.5").count() == 0
    weights = lambda c: [2.0 * (x == "I") for x in c]
    counts = [round(float(np.expm1(x))) for x in toxicity.clause_counts("IY|NI|RI|", weights("IY|NI|RI|"))[:-1]]
    assert counts == [0, 1, 1, 1, 0, 0, 0, 2, 2, 2, 0, 0, 3]  # clauses by kind, their weights, matched clauses


def test_html():
    page = '<html><body><nav><ul><li>a<li>b</ul></nav><div class="ad x">buy</div><article><h1>T &amp; t</h1><p>one\n two<br>three<p>four<aside>no</aside><div class="comments"><p>hi</div></article><footer>f</footer><script>"</p>"</script>'
    other = "<html><body><article><p>z</article></body></html>"
    wrapper = html_text.merge(html_text.skeleton(page), html_text.skeleton(other))
    assert html_text.extract(page, json.dumps(wrapper)) == "T & t\none two three\nfour"
    assert html_text.extract("", json.dumps(wrapper)) == ""
    assert "(<h1>=</>)?" in html_text.expression(wrapper)


def test_template_text_is_told_from_slots(spark):
    page = lambda k: f"<html><body><div class='top'>Same on all</div><div><p>own {k} <span class='advert'>buy</span> more</p><p>and {k}</p></div><div class='post-body comments-off'>kept {k}</div><div class='comments'>no {k}</div></body></html>"
    pages = [(k, f"http://h{k // 10}/x", page(k)) for k in range(14)] + [(20, "http://one/x", "<p>alone"), (21, "http://same/a", "<p>copy"), (22, "http://same/b", "<p>copy"), (23, "http://same/c", "<p>copy"), (24, "http://e/", "")]
    got = {r["page_id"]: r["text"] for r in html_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string"), where(spark)).collect()}
    assert all(got[k] == f"own {k} more\nand {k}\nkept {k}" for k in range(14))  # three pages or more say what the template is
    assert got[20] == "alone" and got[21] == got[22] == got[23] == "copy" and got[24] == ""
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string"), where(spark)).count() == 0
    long = "<article>" + "".join(f"<p>word {k}</p>" for k in range(60_000)) + "</article>"
    assert html_text.extract(long, json.dumps(html_text.skeleton(long))).count("\n") == 59_999


def test_pages_edges(spark):
    pages = spark.createDataFrame([(1, None, "<p>x"), (2, "http://A.b/c", None), (3, "http://a.b/d", "<main><p>y</main><p>z"), (3, "http://a.b/d", "<main><p>y</main><p>z")], "page_id long, url string, html string")
    rows = sorted(map(tuple, html_text.extracted(pages, where(spark)).select("page_id", "text").collect()))
    assert rows == [(1, "x"), (2, ""), (3, "y"), (3, "y")]


def test_pipeline_stages_on_edges(spark, docs, none):
    import corpus_pipeline

    for df in (docs, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = common.written(stage(spark, df, DATA), where(spark), "stage")
            assert set(df.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        corpus_pipeline.STAGES[-1][1](spark, df, DATA).count()


def test_pages_of_one_host_with_several_templates(spark):
    bodies = ["<body><article><p>in article</article><p>out", "<body><main><p>in main</main><p>out", "<body><div><p>in div</div>", "<body><article><nav>no</nav></article><div><p>in div too</div>", "<body><p>a<svg viewBox='0'/><p>b<math />c<svg><p>no</svg>"]
    want = ["in article", "in main", "in div", "in div too", "a\nbc"]
    urls = ["http://one.host/x", None, "relative/x", "http:/bad", "http://one.host/y"]
    pages = [(10 * k + j, url, body) for k, url in enumerate(urls) for j, body in enumerate(bodies)]
    got = {r["page_id"]: r["text"] for r in html_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string"), where(spark)).collect()}
    assert got == {10 * k + j: text for k in range(len(urls)) for j, text in enumerate(want)}


def test_quality_bounds_and_labelled_texts(spark):
    rng = np.random.default_rng(6)
    cov = np.cov(rng.normal(size=(quality.D, 50)) * np.array(quality.FLOOR)[:, None] * np.array([[0.1], [3], [1], [0], [2], [0.5], [4]]))
    got = quality.bounded(cov)
    floor = np.diag(np.square(quality.FLOOR))
    assert np.linalg.eigvalsh(got - floor).min() > -1e-9 and np.linalg.eigvalsh(got - cov).min() > -1e-9
    assert np.allclose(quality.bounded(floor * 2), floor * 2) and np.allclose(quality.bounded(floor / 9), floor)
    bins = quality.bin_of(np.full(9, 0.5))
    assert quality._middle(pd.DataFrame({"pool": "p", "bin": bins, "n": 1})).scale[0] < 0.1
    rows = registry.QUERIES["op4_quality"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 0.02 * (n.get((0, True), 0) + n[0, False]) and n.get((1, False), 0) <= 0.005 * n[1, True]


def test_concentration_steps_lower_the_determinant_and_find_the_clean_half(spark):
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(0, 1, (160, quality.D)) * np.array(quality.FLOOR) * 2 + 1, rng.normal(9, 1, (60, quality.D))])
    rows = spark.createDataFrame([(["s\x01en\x01a", "l\x01en", "a"], [float(v) for v in r], i) for i, r in enumerate(x)], "pools array<string>, x array<double>, id long")
    found = {r["pool"]: r for r in quality.estimated(rows, where(spark)).collect()}
    assert set(found) == {"s\x01en\x01a", "l\x01en", "a"}
    for r in found.values():
        mean, inverse = np.array(r["mean"]), np.reshape(r["inverse"], (quality.D, quality.D))
        assert np.abs(mean - x[:160].mean(axis=0)).max() < 0.3 and r["n"] == 220
        d2 = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
        assert d2[:160].max() < d2[160:].min()
        for _ in range(20):  # no random half that concentrates has a lesser determinant, up to the width of a bin
            half = rng.choice(220, 110, replace=False)
            for _ in range(30):
                m, c = x[half].mean(axis=0), np.cov(x[half].T, bias=True) + np.diag(np.square(quality.FLOOR)) * quality.RIDGE**2
                half = np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m))[:114]
            assert r["logdet"] < np.linalg.slogdet(c)[1] + 0.7


def test_outliers_of_small_groups_are_rejected(spark):
    rng = np.random.default_rng(16)
    words = [f"wo{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    clean = lambda: ". ".join(" ".join(rng.choice(words, 12)) for _ in range(20))
    rows = [(i, clean(), "en" if i % 2 else None, f"s{i % 7}") for i in range(140)] + [(500 + i, re.sub(" ", " # $ % ", clean()), "en", "s1") for i in range(3)]
    out = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), where(spark)).collect()}
    assert not any(out[500 + i] for i in range(3)) and sum(out[i] for i in range(140)) >= 138


def test_repeated_words_are_the_brute_force_ones():
    rng = np.random.default_rng(17)
    for _ in range(200):
        words = rng.choice(list("abcd"), rng.integers(0, 30)).tolist()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        assert quality.base_counts(" ".join(words))[4] == len(hit)


def test_negation_report_and_target_change_the_score(spark):
    rng = np.random.default_rng(18)
    rows, n = [], 0
    plain = lambda: " ".join(rng.choice([f"n{chr(97 + i)}x" for i in range(26)], 8))
    for _ in range(60):
        told = [(f"you are a zzidiot {plain()}.", 1), (f"zzidiot {plain()}.", 1), (f"{plain()} you zzidiot.", 1), (f"she said that he is one big zzidiot {plain()}.", 0), (f"this is not a zzidiot {plain()}.", 0), (f"kvetch zzidiot {plain()}.", 0)]
        for text, toxic in told + [(f"you are {plain()}. he said that {plain()}. this is not {plain()} a kvetch.", 0)] * 8:
            rows.append((n, text, toxic))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar, weights = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "=zzidiot" in grammar.marks and grammar.classes.get("kvetch") == toxicity.NEGATION_MARK  # learned to deny
    texts = ["you zzidiot.", "a zzidiot.", "not a zzidiot.", "he said it is a big old zzidiot.", "kvetch zzidiot.", "fine.", "", None]
    got = [r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), grammar, weights).orderBy("doc_id").collect()]
    assert min(got[:2]) > 0.5 > max(got[2:])


def test_proximity_is_the_brute_force_one(spark):
    rng = np.random.default_rng(19)
    vocabulary = [f"q{i}" for i in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate((1, 3, 8, 9, 4))]
    docs = [(d, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for d in range(40)] + [(99, None), (None, items[2][1])]
    slop = 2
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.near_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), where(spark), slop).collect()}
    want = {}
    for d, text in docs:
        w, near = (text or "").split(), set()
        for k, item in items:
            g = item.split()
            for gram in [g[i : i + 8] for i in range(max(1, len(g) - 7))]:
                if any(set(gram) <= set(w[i : i + len(gram) + slop]) for i in range(len(w))):
                    near.add(str(k))
        if near:
            want[d] = sorted(near)
    assert got == want


def test_any_exact_match_goes_in_the_stage(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("length(text) > 200").first()["text"]
    rows = [(1, f"some words. {item} more", "a"), (2, "clean words here and there", "b"), (3, None, "c"), (3, "", "d"), (4, " ".join(re.findall(r"\w+", item)[:8]).upper(), "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc_key string")
    assert sorted(map(repr, decontamination.stage(spark, df, DATA).collect())) == sorted(map(repr, df.filter("doc_id in (2, 3)").collect()))


def test_cuts_are_the_cheapest_over_every_sentence_end():
    rng = np.random.default_rng(20)
    for _ in range(30):
        ends = np.cumsum(rng.integers(1, 40, 6))
        sentence = np.unique(rng.integers(1, ends[-1] + 1, 9))
        pos, penalty = packing.places(ends, sentence, 16)
        assert set(ends) | set(sentence) | {0} <= set(pos.tolist()) and np.diff(pos).max() <= 16
        cost = lambda n: 0 if n & (n - 1) == 0 else 16 - n
        kind = {int(p): packing.SENTENCE_CUT for p in sentence} | {int(p): 0 for p in ends}
        firm = sorted({0, *kind})
        gap = {p for a, b in zip(firm, firm[1:]) if b - a > 16 for p in range(a, b)}
        best = {0: 0}
        for j in range(1, int(ends[-1]) + 1):
            if j in kind or j in gap:
                best[j] = min((best[i] + cost(j - i) for i in best if j - i <= 16), default=10**9) + kind.get(j, packing.HARD_CUT)
        cuts = packing.window_ends(pos, penalty, 16)
        assert sum(cost(b - a) + kind.get(b, packing.HARD_CUT) for a, b in zip([0, *cuts], cuts)) == best[int(ends[-1])]


def test_very_long_texts(spark):
    rng = np.random.default_rng(21)
    words = np.array([f"{a}{b}" for a in "bcdfgklm" for b in ("ara", "ilo", "enu", "os", "ut")])
    text = " ".join(rng.choice(words, 700_000)) + "."
    assert len(text) > tokens.TAKEN
    for name, kept in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        t = tokens.PieceTokenizer(tokens.vocabulary_path(name), kept)
        whole = t._tokenizer.encode(text, add_special_tokens=False).ids
        assert t.ids([text, "a", text])[0].tolist() == whole
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "short one", "en", "s", 9), (3, "x" * 3_000_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = packing.pack(df, tokens.vocabulary_path("word_bpe_49k.json")).filter("doc_id = 1").collect()
    assert sum(r["length"] for r in rows) == rows[0]["doc_tokens"] > 700_000
    assert quality.judged(df, where(spark)).filter("doc_id = 1").first()["n_words"] == 700_000
    assert {r["doc_id"]: r["n"] for r in jaccard.classes_of(df, where(spark)).collect()}[3] == 1
    assert language.predict(df, language.fit(df)).filter("lang_pred = 'en'").count() == 3


def test_planted_cases_through_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(22)
    common.prepare(spark)
    base = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("length(text) > 300").first()["text"]
    line = lambda: " ".join(f"{a}{b}" for a, b in zip(rng.choice(list("bcdfgklm"), 12), rng.choice(["ara", "ilo", "enu", "os"], 12)))
    clean = ["\n".join(line() for _ in range(12)) for _ in range(10)]
    rows = [(10_000 + k, t) for k, t in enumerate(clean)]
    rows += [(20_000 + k, t) for k, t in enumerate(clean[:3])]  # exact copies
    rows += [(30_000 + k, "\n".join(x + " x" if i % 2 else x for i, x in enumerate(t.split("\n")))) for k, t in enumerate(clean[3:5])]  # an edit in every window of lines
    rows += [(40_000, clean[5] + "\n" + item)]
    docs = spark.createDataFrame([tuple(r) for r in base] + [(d, t, "en", "p", len(t)) for d, t in rows], spark.read.parquet(f"{DATA}/documents.parquet").schema)
    left, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = common.written(stage(spark, left, DATA), where(spark), "stage")
        sizes.append(left.count())
    ids = {r["doc_id"] for r in left.collect()}
    assert {10_000 + k for k in range(10)} <= ids and not ids & {20_000, 20_001, 20_002, 40_000}
    linked = brute_components([(d, t) for d, t in rows if d < 40_000])
    assert all((30_000 + k in ids) == (linked[30_000 + k][1] == 30_000 + k) for k in range(2))
    assert sizes == sorted(sizes, reverse=True)
    packed = corpus_pipeline.STAGES[-1][1](spark, left, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids
