"""Repeated byte strings through longest-previous-factor arrays over suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere: at an earlier place (keep="first", the first copy stays) or anywhere
(keep="none"). Besides, passages are reported: runs of bytes that strings of LEAST bytes which also start elsewhere cover. Suffixes are compared up to LENGTH bytes, and
never all in one place:

1. Each start of a LEAST-byte string belongs to its anchor, the K-gram of least hash inside it. Equal strings have equal anchors, so suffixes that can share
   LEAST bytes meet under one anchor's hash. The starts of an anchor's occurrence are a block, its bytes (LENGTH from the last start on) the block's context.
2. Anchors that occur once are dropped by an aggregate. Of the rest, equal contexts are represented once, with their number.
3. Under an anchor, starts at one distance before it are put in suffix order: by the bytes up to the anchor, then by those from it on. In that order
   the previous and next places with smaller text positions give each start's longest previous factor; those with larger ones its longest later factor.
   Factors of LEAST and of LENGTH give passages and spans.
4. An anchor with more than HOT different contexts (of under 600 bytes each; that many are a task's bound) is extended: its blocks are split by the distance of a start from the anchor into ranges of RANGE, and keyed by
   all bytes that the strings of a range share. What is still as frequent then is extended to the whole string, which is one start; equal keys are equal
   strings there, and an aggregate finds them.

Texts that occur whole more than once are judged once. Positions are ordered by doc_id, text hash and place. Null text is empty; texts shorter than LEAST
bytes lose nothing; repeated rows are copies of each other, so with keep="none" they lose all, with keep="first" nothing if their ids are equal too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.llm.common import forget, shared_dir, small_side, table, text_or_empty, written
from codexlake.llm.jaccard import _BYTES, mix, powers

LENGTH, LEAST, K = 400, 256, 64
#: A passage counts if it has more words than this.
PASSAGE_WORDS = 50
CHUNK = 1 << 18
HOT, RANGE = 40_000, 24


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(h)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(h.dtype).max, dtype=h.dtype)
    padded[:n] = h
    grid = padded.reshape(rows, w)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def blocks_of(raw: bytes, least: int = LEAST, k: int = K, length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor's hash, context's hash, first start, last start, anchor's place); together the blocks hold every start of ``least`` bytes once."""
    import xxhash

    window = least - k + 1
    whole = np.frombuffer(raw, dtype=np.uint8)
    for begin in range(0, len(raw) - least + 1, CHUNK):
        part = whole[begin : begin + CHUNK + least - 1]
        n = len(part)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[part] * up[:n], out=sums[1:])
        h = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
        lowest = sliding_min(h, window)
        runs = np.concatenate([[0], np.flatnonzero(lowest[1:] != lowest[:-1]) + 1, [len(lowest)]]).tolist()
        for lo, stop in zip(runs, runs[1:], strict=False):
            while lo < stop:
                at = lo + int(h[lo : lo + window].argmin())
                hi = min(stop - 1, at)
                yield int(h[at].astype(np.int64)), xxhash.xxh3_64_intdigest(raw[begin + lo : begin + hi + length]) - (1 << 63), begin + lo, begin + hi, begin + at
                lo = hi + 1


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def reaches(order: list[int], near: list[int]) -> list[int]:
    """For places in suffix order, given their positions in the text and the common prefix of each with the one before: the longest common prefix with the
    previous or next place of smaller position; 0 if there is neither."""

    def one_way(order: list[int], near: list[int]) -> list[int]:
        out, stack = [], []  # positions that rise, each with its common prefix with the one below
        for at, r in zip(order, near, strict=True):
            while stack and stack[-1][0] > at:
                r = min(r, stack.pop()[1])
            out.append(r if stack else 0)
            stack.append((at, r))
        return out

    return list(map(max, one_way(order, near), reversed(one_way(order[::-1], [0, *near[:0:-1]]))))


def factor_runs(lefts: list[bytes], rights: list[bytes], least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The longest-previous-factor array, and the longest-later-factor one, of the starts at distances d = 0, 1, ... before each of an anchor's occurrences, in runs:
    (occurrence, first d, last d, previous, later), where the longest earlier string that equals one at a start has d + previous bytes, the longest later one d + later.

    rights: the bytes from the anchor on; lefts: those before it, the nearest first; occurrences stand in text order. Strings of ``least`` bytes at two starts are equal only
    if the starts have one d. Those of a d with equal bytes up to the anchor stand together in suffix order, in the order of their rights; they stay the same for a run of d, so the
    runs of all d are the nodes of the tree of common prefixes of lefts, and each needs its previous and next smaller positions once. Runs without a factor of ``least`` are left out."""
    rank = [0] * len(rights)
    for k, i in enumerate(sorted(range(len(rights)), key=rights.__getitem__)):
        rank[i] = k
    by_left = sorted(range(len(lefts)), key=lefts.__getitem__)
    shared = [0, *(common(lefts[i], lefts[j]) for i, j in zip(by_left, by_left[1:], strict=False))]
    todo = [(0, len(by_left), -1)]
    while todo:
        begin, end, above = todo.pop()
        if end - begin < 2:
            continue
        depth = min(shared[begin + 1 : end])
        cuts = [begin, *(k for k in range(begin + 1, end) if shared[k] == depth), end]
        todo += [(i, j, depth) for i, j in zip(cuts, cuts[1:], strict=False)]
        order = sorted(by_left[begin:end], key=rank.__getitem__)
        near = [0, *(common(rights[i], rights[j]) for i, j in zip(order, order[1:], strict=False))]
        if depth + max(near) < least:
            continue
        previous, later = reaches(order, near), reaches([-i for i in order], near)
        for i, p, q in zip(order, previous, later, strict=True):
            if depth + max(p, q) >= least:
                yield i, above + 1, depth, p, q


PLACE = "doc_id long, k1 long, lo int, hi int, anchor int"
#: whole: the span is one of strings of LENGTH, not LEAST.
SPAN = "doc_id long, k1 long, s int, e int, whole boolean"
BLOCKS = pa.schema([("core", pa.int64()), ("ctx", pa.int64()), ("doc_id", pa.int64()), ("k1", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("anchor", pa.int32()), ("size", pa.int32())])
CONTEXTS = pa.schema([("core", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("k1", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("anchor", pa.int32()), ("bytes", pa.binary())])
SPANS = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("whole", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _blocks(docs: DataFrame) -> DataFrame:
    """core, ctx, PLACE and size (the text's bytes) of every block of docs (doc_id, k1, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, k1, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(core, ctx, doc_id, k1, lo, hi, at, len(raw)) for core, ctx, lo, hi, at in blocks_of(raw)]
            if rows:
                yield _batch(rows, BLOCKS)

    return docs.select("doc_id", "k1", "text").mapInArrow(run, f"core long, ctx long, {PLACE}, size int")


def _contexts(docs: DataFrame, reps: DataFrame, where: str, name: str) -> DataFrame:
    """reps (core, c, PLACE) with bytes."""
    lists = written(reps.groupBy("doc_id", "k1").agg(F.collect_list(F.struct("core", "c", "lo", "hi", "anchor")).alias("cut")), where, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, k1, text, cut in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for k in range(0, len(cut), 2000):
                    yield _batch([(x["core"], x["c"], doc_id, k1, x["lo"], x["hi"], x["anchor"], raw[x["lo"] : x["hi"] + LENGTH]) for x in cut[k : k + 2000]], CONTEXTS)

    d, c = docs.alias("d"), lists.hint("shuffle_merge").alias("c")  # as large as the repeated parts of the corpus
    joined = d.join(c, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.k1") == F.col("c.k1"))).select("d.doc_id", "d.k1", "d.text", "c.cut")
    return joined.mapInArrow(run, f"core long, c long, {PLACE}, bytes binary")


def _ordered(contexts: DataFrame, keep: str) -> DataFrame:
    """SPAN of the repeated starts, by suffix order under each core."""

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        at = [r[6] - r[4] for r in rows]  # the anchor's place in the context
        for i, near, far, previous, later in factor_runs([r[-1][:a][::-1] for r, a in zip(rows, at, strict=True)], [r[-1][a:] for r, a in zip(rows, at, strict=True)], LEAST):
            _, c, doc_id, k1, lo, hi, anchor, _ = rows[i]
            if keep == "none" and c > 1:
                continue  # all of them are reported as equal contexts
            reach = previous if keep == "first" else max(previous, later)
            for whole, length in ((False, LEAST), (True, LENGTH)):
                first, last = max(lo, anchor - far), min(hi, anchor - max(near, length - reach))
                if first <= last:
                    yield doc_id, k1, first, last + length, whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        out: list[tuple] = []
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(len(CONTEXTS))), strict=True):
                if ready and r[0] != ready[0][0]:
                    out += solve(ready)
                    ready = []
                ready.append(r)
            if len(out) > 10_000:
                yield _batch(out, SPANS)
                out = []
        out += solve(ready)
        yield _batch(out, SPANS)

    return contexts.repartition("core").sortWithinPartitions("core", "doc_id", "k1", "anchor", "lo").mapInArrow(run, SPAN)


def _extended(contexts: DataFrame) -> DataFrame:
    """contexts, split by the distance of their starts from the anchor, with cores of all bytes that the strings of a range share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows = []
            for core, c, doc_id, k1, lo, hi, anchor, raw in zip(*(b.column(i).to_pylist() for i in range(len(CONTEXTS))), strict=True):
                for k in range((anchor - hi) // RANGE, (anchor - lo) // RANGE + 1):
                    near, far = k * RANGE, (k + 1) * RANGE - 1  # distances of the range
                    first, last = max(lo, anchor - far), min(hi, anchor - near)
                    shared = raw[anchor - near - lo : anchor - far + LEAST - lo]
                    rows.append((xxhash.xxh3_64_intdigest(shared, seed=(core ^ k) & ((1 << 64) - 1)) - (1 << 63), c, doc_id, k1, first, last, anchor, raw[first - lo : last - lo + LENGTH]))
            yield _batch(rows, CONTEXTS)

    return contexts.mapInArrow(run, f"core long, c long, {PLACE}, bytes binary")


def _single(contexts: DataFrame, keep: str) -> DataFrame:
    """SPAN of the repeated starts of cores that are as frequent when extended: each start's string on its own."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("v", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("k1", pa.int64()), ("s", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        half = 1 << 63
        for b in batches:
            for _, c, doc_id, k1, lo, hi, _, raw in zip(*(b.column(i).to_pylist() for i in range(len(CONTEXTS))), strict=True):
                rows = []
                for i in range(hi - lo + 1):
                    w, more = xxhash.xxh3_128_intdigest(raw[i : i + LEAST]), raw[i + LEAST : i + LENGTH]
                    rows.append(((w >> 64) - half, (w & ((1 << 64) - 1)) - half, xxhash.xxh3_64_intdigest(more) - half if len(more) == LENGTH - LEAST else None, c, doc_id, k1, lo + i))
                yield _batch(rows, schema)

    starts = contexts.mapInArrow(run, "w1 long, w2 long, v long, c long, doc_id long, k1 long, s int")
    here = F.struct("doc_id", "k1", "s")
    out = None
    for keys, length in ((["w1", "w2"], LEAST), (["w1", "w2", "v"], LENGTH)):
        some = starts.filter("v is not null") if length == LENGTH else starts
        repeated = some.groupBy(*keys).agg(F.min(here).alias("first"), F.max(here).alias("last")).filter("first <> last").drop("last")
        found = some.join(repeated, keys).filter(here != F.col("first") if keep == "first" else F.col("c") == 1)
        found = found.select("doc_id", "k1", "s", (F.col("s") + length).alias("e"), F.lit(length == LENGTH).alias("whole"))
        out = out.union(found) if out else found
    return out


def spans(docs: DataFrame, where: str, keep: str = "first") -> DataFrame:
    """doc_id, k1, spans (array of s, e in bytes and whole, not merged) for the rows of docs (doc_id, k1, text) with repeated strings."""
    blocks = written(_blocks(docs), where, "blocks")
    twice = written(blocks.groupBy("core").count().filter("count > 1").select("core"), where, "twice")
    shared = written(blocks.join(twice.hint("shuffle_merge"), "core"), where, "shared")
    forget(docs.sparkSession, where, "blocks")
    place = F.struct("doc_id", "k1", "lo", "hi", "anchor")
    contexts = written(shared.groupBy("core", "ctx").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("at")), where, "contexts")
    per_core = written(contexts.groupBy("core").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), where, "cores")
    full = shared.join(contexts.filter("c > 1").select("core", "ctx", "at"), ["core", "ctx"])
    full = full.filter(place != F.col("at")) if keep == "first" else full
    last = F.least("hi", F.col("size") - LENGTH)  # nearer to the text's end no string of LENGTH starts
    ends = F.array(F.struct((F.col("hi") + LEAST).alias("e"), F.lit(False).alias("whole")), F.struct(F.when(last >= F.col("lo"), last + LENGTH).alias("e"), F.lit(True).alias("whole")))
    parts = full.select("doc_id", "k1", F.col("lo").alias("s"), F.inline(ends)).filter("e is not null")
    reps = written(contexts.join(per_core.hint("shuffle_merge"), "core").select("core", "c", "m", "at.*"), where, "reps")
    parts = parts.union(_ordered(_contexts(docs, reps.filter(F.col("m") <= HOT).drop("m"), where, "lists"), keep))
    hot = reps.filter(F.col("m") > HOT).drop("m")
    if not hot.isEmpty():
        longer = written(_extended(_contexts(docs, hot, where, "hot_lists")), where, "extended")
        often = written(longer.groupBy("core").count().filter(F.col("count") > HOT).select("core"), where, "often")
        parts = parts.union(_ordered(longer.join(often, "core", "left_anti"), keep)).union(_single(longer.join(often, "core", "left_semi"), keep))
    out = written(parts.groupBy("doc_id", "k1").agg(F.collect_list(F.struct("s", "e", "whole")).alias("spans")), where, "spans")
    del blocks, twice, shared, contexts, per_core, full, reps, parts, hot
    forget(docs.sparkSession, where, "twice", "shared", "contexts", "cores", "reps", "lists", "hot_lists", "extended", "often")
    return out


def merged(each: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in each):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def dedup(docs: DataFrame, where: str, keep: str = "first") -> DataFrame:
    """doc_id, n_bytes, removed (array of s, e), kept (binary), passages (array of s, e, words) for each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    copied = written(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1"), where, "copied")
    r, c = rows.alias("r"), small_side(copied).alias("c")
    marked = r.join(c, (F.col("r.k1") == F.col("c.k1")) & (F.col("r.k2") == F.col("c.k2")), "left").select("r.doc_id", "r.k1", "r.text", "c.copies", (F.col("c.copies").isNull() | F.col("r.doc_id").eqNullSafe(F.col("c.first_id"))).alias("stands"))
    found = spans(marked.filter("stands").select("doc_id", "k1", "text"), where, keep).hint("shuffle_merge").alias("f")  # as large as the repeated parts of the corpus
    m = marked.alias("m")
    whole = F.col("m.copies").isNotNull() if keep == "none" else ~F.col("m.stands")
    each = m.join(found, F.col("m.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("m.k1") == F.col("f.k1")), "left").select("m.doc_id", "m.text", whole.alias("whole"), "f.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, kept, passages = [], [], [], []
            for text, all_, each in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                gone, long = (([(0, len(raw))] if len(raw) >= n else []) if all_ else merged([x for x in each or [] if x["whole"] == w]) for n, w in ((LENGTH, True), (LEAST, False)))
                edges = [0, *(x for span in gone for x in span), len(raw)]
                sizes.append(len(raw))
                removed.append([{"s": s, "e": e} for s, e in gone])
                kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)) if gone else raw)
                passages.append([{"s": s, "e": e, "words": len(raw[s:e].split())} for s, e in long])
            place = [("s", pa.int64()), ("e", pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct(place))), pa.array(kept, pa.binary()), pa.array(passages, pa.list_(pa.struct([*place, ("words", pa.int64())])))], names=["doc_id", "n_bytes", "removed", "kept", "passages"])

    return each.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<s: bigint, e: bigint>>, kept binary, passages array<struct<s: bigint, e: bigint, words: bigint>>")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents without strings of 400 bytes that occur twice or more; every copy goes. n_passages: passages of over PASSAGE_WORDS words that repeat,
    by strings of LEAST bytes, whether or not they reach the 400 bytes at which text goes."""
    out = dedup(table(spark, sf_dir, "documents", "doc_id", "text"), shared_dir(spark), keep="none")
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    n_passages = F.size(F.filter("passages", lambda x: x["words"] > PASSAGE_WORDS)).cast("long")
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), n_passages.alias("n_passages"))
