"""Near duplicates: a Jaccard join of word-shingle sets through prefixes of single shingles and of shingle combinations.

Documents with one set are one class, stood for by its smallest doc_id. All sets are put in one order of shingles, rare ones first, by the classes of a
counting sketch of fixed size over the whole corpus (the order decides the work and never the result). A set's prefix is extended until the shingles that it may lack from a
partner cannot hold all of it: rare shingles count one each and are indexed alone; frequent ones are dealt to parts by their hashes, a part of c shingles
counts c - 1 and is indexed by its pairs. Two sets that reach the similarity therefore share an index entry; parts depend on the size's step, and every set is indexed
under its own step and the next.

Sets that share an entry are compared in three steps, so that no link between different texts is lost and no group's pairs become rows:

1. In each entry all sets are compared with the one of least part of rare shingles, which edited copies have most in common with (a star). An entry that the sketch
   takes for very frequent is dealt to salts of about SALTED sets, each with a star of its own, whose centres form one more star.
2. Of entries with over PAIRED sets, those still in several components are cut into parts of one size step and bounded size; a block is two parts that share an
   entry, and its task holds every set of one part against every set of the other: first by bitmaps in which each shingle flips a bit, whose distance is never more
   than the sets' (one matrix product for a block), then exactly, and hands back links between components alone, fewer than it has sets.
3. Of the other entries, which have at most PAIRED sets and so pairs in proportion to the index, the pairs between components are held against a
   bound from the sets' histograms, one from 16 bits of each shingle's hash, and then compared.

The sketch's noise grows with the corpus, and shingles of some dozen unlike documents then pass for rare. Where the sets of long entries are too many for step 2, the index's own
counts mend the order: the shingles of these entries become frequent, and the sets in them, which any pair not yet seen is among, are indexed once more, until they are few. What
step 2 sends at once is bounded: blocks are done in as many rounds as that takes.

Comparisons are exact, on the whole sets of 64-bit shingle hashes. A group of copies that stay unlinked costs rows for members times blocks, and the square of its size in products of bits alone.

Null and empty texts and texts without words have an empty set and are linked with nothing. A row without doc_id gets the component of its class, null if
no row of it has an id. Repeated rows get equal results, each its own row; different texts under one doc_id are different classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codexlake.llm.common import forget, prepare, shared_dir, small_side, table, text_or_empty, unused, written
from codexlake.llm.components import components

SHINGLE, PERCENT = 5, 80
#: The sketch: its counters and those in a piece of it, as powers of two; shingles of FREQUENT documents or more, by its estimate, are frequent.
SKETCH_BITS, PIECE_BITS, FREQUENT = 24, 16, 64
STEP, PART = 1.2501, 4
#: Buckets by hash of a set's histogram, whose sums of minima bound intersections from above.
BUCKETS = 128
BLOCK_TOKENS, FINE_TOKENS, BLOCK_SETS, PART_TOKENS = 2_000_000, 8_000_000, 4096, 1_000_000
#: Tokens sent to blocks at once: this part of all sets' tokens, ROOM_TOKENS at least.
ROOM, ROOM_TOKENS = 0.25, 16_000_000
#: Texts after which a task hands on its counters and starts anew, so that 16 bits hold each.
COUNTED = 60_000
#: Sets of an entry whose pairs become rows, at most; sets of a salt of a very frequent entry, about.
PAIRED, SALTED = 16, 4096
SEEN = 50_000

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C13
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0 to n - 1, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, dtype=np.uint64)])) for x in (_BASE, _UNBASE)]
    return _powers[0], _powers[1]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    solid = np.empty(len(raw) + 2, dtype=np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    change = np.diff(solid)
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    w = word_hashes(text)
    if len(w) == 0:
        return w
    if len(w) < SHINGLE:
        return mix((w * _PLACE[: len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w)))
    s = np.full(len(w) - SHINGLE + 1, SHINGLE, dtype=np.uint64)
    for k in range(SHINGLE):
        s += w[k : len(w) - SHINGLE + 1 + k] * _PLACE[k]
    return np.unique(mix(s))


def set_key(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else 0


def histogram(s: np.ndarray) -> np.ndarray | None:
    """A set's sizes by bucket, None for the empty set and for very large ones, which no bound then spares the comparison."""
    counts = np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=BUCKETS)
    return counts.astype(np.int16) if len(s) and counts.max() < 1 << 15 else None


def cells(s: np.ndarray) -> np.ndarray:
    """A set's counters."""
    return (s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def needed(n: int) -> int:
    """How many shingles of n must be in the prefix."""
    return n - (PERCENT * n + 99) // 100 + 1


def entries(s: np.ndarray, classes: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's index entries and the least class of each entry's shingles; classes: each shingle's class in the order, from ``frequent`` on frequent."""
    n = len(s)
    if n == 0:
        return s, np.zeros(0, dtype=np.uint8)
    need = needed(n)
    order = np.lexsort((s, classes))
    s, classes = s[order], classes[order]
    rare = int(np.searchsorted(classes, frequent))
    if rare >= need:
        return s[:need], classes[:need]
    out, levels = [s[:rare]], [classes[:rare]]
    often, level = s[rare:], classes[rare:]
    for step in (size_step(n), size_step(n) + 1):
        parts = max(1, round(STEP**step * (100 - PERCENT) / 100 / PART))
        part = ((often >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
        first = np.zeros(len(often), dtype=bool)
        first[np.unique(part, return_index=True)[1]] = True
        upto = int(np.searchsorted(np.cumsum(~first), need - rare)) + 1
        by = np.argsort(part[:upto], kind="stable")
        part, held, of = part[:upto][by], often[:upto][by], level[:upto][by]
        distance = 1
        while distance < len(held):
            same = np.flatnonzero(part[distance:] == part[:-distance])
            if len(same) == 0:
                break
            low, high = np.minimum(held[same], held[same + distance]), np.maximum(held[same], held[same + distance])
            out.append(mix(low * _PLACE[0] + high * _PLACE[1] + np.uint64(step)))
            levels.append(np.minimum(of[same], of[same + distance]))
            distance += 1
    return np.concatenate(out), np.concatenate(levels)


def size_step(n: int) -> int:
    return math.floor(math.log(n) / math.log(STEP))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, key, n, hist of each document; besides, rows with n null, piece and counts: parts of a sketch, to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, rows = np.zeros(1 << SKETCH_BITS, dtype=np.uint16), 0

        def counters() -> Iterator[pa.RecordBatch]:
            for k, piece in enumerate(sketch.reshape(-1, 1 << PIECE_BITS)):
                if piece.any():
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.list_(pa.int16())), pa.array([k], pa.int64()), pa.array([np.minimum(piece, 255).astype(np.uint8).tobytes()], pa.binary())], names=names)

        for b in batches:
            sets = [shingle_set(x) for x in b.column(2).to_pylist()]
            for s in sets:
                np.add.at(sketch, cells(s), np.uint16(1))
            rows += len(sets)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([histogram(s) for s in sets], pa.list_(pa.int16())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)
            if rows >= COUNTED:
                yield from counters()
                sketch[:], rows = 0, 0
        if rows:
            yield from counters()

    names = ["doc_id", "text_key", "key", "n", "hist", "piece", "counts"]
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, text_key long, key long, n long, hist array<smallint>, piece long, counts binary")


def order_classes(scan: DataFrame) -> tuple[np.ndarray, int]:
    """The class of each counter in the order (bytes), and from which class on shingles are frequent. A task's part counts to 255, far above FREQUENT."""
    load = (scan.agg(F.sum("n")).first()[0] or 0) / (1 << SKETCH_BITS)
    noise = 4 + 4 * math.sqrt(load)
    level = lambda x: np.where(x < noise, 0, 1 + np.log2(np.maximum(x, 1))).astype(np.uint8)

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << PIECE_BITS, dtype=np.uint64)
        for x in pdf["counts"]:
            total += np.frombuffer(x, dtype=np.uint8 if len(x) == 1 << PIECE_BITS else "<u8")
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "counts": [total.astype("<u8").tobytes()]})

    def levels(pdf: pd.DataFrame) -> pd.DataFrame:
        out = added(pdf)
        beyond = np.frombuffer(out["counts"][0], dtype="<u8").astype(float) - load
        return out.assign(counts=[level(np.maximum(0, beyond)).tobytes()])

    classes = np.zeros(1 << SKETCH_BITS, dtype=np.uint8).reshape(-1, 1 << PIECE_BITS)
    parts = scan.filter("n is null and piece is not null").select("piece", "counts", F.pmod(F.xxhash64("counts"), F.lit(8)).alias("salt"))
    half = parts.groupBy("piece", "salt").applyInPandas(added, "piece long, counts binary")
    for r in half.groupBy("piece").applyInPandas(levels, "piece long, counts binary").toLocalIterator():  # 2**SKETCH_BITS bytes in all
        classes[r["piece"]] = np.frombuffer(r["counts"], dtype=np.uint8)
    return classes.reshape(-1), int(level(np.array([max(FREQUENT, noise)]))[0])


def indexed(docs: DataFrame, classes: np.ndarray, frequent: int) -> DataFrame:
    """entry, salts, salt, key, n, rare: the index, for each set at least once; salts: how many its entry is dealt to, salt: the set's; rare: how many in a
    thousand of the set's shingles are."""
    shared = docs.sparkSession.sparkContext.broadcast((classes, frequent))  # 2**SKETCH_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, often = shared.value
        seen: set[int] = set()
        for b in batches:
            held: list[tuple] = []
            for text in b.column(0).to_pylist():
                s = shingle_set(text)
                key = set_key(s)
                if len(s) == 0 or key in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(key)
                levels = of[cells(s)]
                e, level = entries(s, levels, often)
                salts = np.minimum(1 << 14, np.ceil(np.exp2(level.astype(float)) / SALTED)).astype(np.int16)
                rare = 1000 * np.count_nonzero(levels < often) // len(s)
                held.append((e.view(np.int64), salts, np.uint64(key & _MASK) % salts.astype(np.uint64), np.full(len(e), key, dtype=np.int64), np.full(len(e), len(s), dtype=np.int32), np.full(len(e), rare, dtype=np.int16)))
            if held:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                columns[2] = columns[2].astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["entry", "salts", "salt", "key", "n", "rare"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "entry long, salts smallint, salt smallint, key long, n int, rare smallint")


BLOCK = "struct<c: bigint, x: bigint, y: bigint>"


def token_sets(docs: DataFrame, nodes: DataFrame, fine: bool) -> DataFrame:
    """key, tokens, part, label, block of nodes (key, id, part, label, blocks); a row twice where documents has it twice. tokens: the sorted set, or if ``fine`` its upper 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x) for x in b.column(4).to_pylist()]
            same = pa.array([set_key(s) == k for s, k in zip(sets, b.column(0).to_pylist(), strict=True)], pa.bool_())
            held = [((s >> np.uint64(48)).astype("<u2") if fine else s.astype("<u8")).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary()), b.column(1), b.column(2), b.column(3)], names=["key", "tokens", "part", "label", "blocks"]).filter(same)

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")).join(small_side(nodes, ("blocks",)), "id").select("key", "part", "label", "blocks", "text")
    return rows.mapInArrow(run, f"key long, tokens binary, part long, label long, blocks array<{BLOCK}>").select("key", "tokens", "part", "label", F.explode("blocks").alias("block"))


def possible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose histograms allow the similarity: no set's intersection exceeds the sum of the buckets' minima."""
    of = lambda x: reps.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("hist").alias(f"h{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    most = F.aggregate(F.zip_with("ha", "hb", lambda x, y: F.least(x, y).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
    return both.filter(F.col("ha").isNull() | F.col("hb").isNull() | ((100 + PERCENT) * most >= PERCENT * (F.col("na") + F.col("nb")))).select("a", "b")


def most_shared(a: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """The sizes of a's intersections with the others as multisets of 16-bit values, each from above those of the sets."""
    counts = np.bincount(a, minlength=1 << 16)
    out = []
    for b in others:
        begins = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        out.append(int(np.minimum(counts[b[begins]], np.diff(np.append(begins, len(b)))).sum()))
    return out


def compared(pairs: DataFrame, reps: DataFrame, docs: DataFrame, where: str, name: str, fine: bool) -> DataFrame:
    """Of the pairs (a, b) of keys those whose sets reach the similarity; if ``fine``, those that may, by the upper 16 bits of their shingles' hashes.

    Pairs are compared in blocks, so that a set is sent once for a block and not for each of its pairs: what pairs connect is cut into parts of
    about BLOCK_TOKENS tokens (FINE_TOKENS of the short ones), and a block holds the pairs between two parts."""
    if pairs.isEmpty():
        return pairs
    near = components(pairs, f"{where}/{name}_near").select(F.col("node").alias("key"), F.col("component").alias("c"))
    sized = near.join(reps.select("key", "id", "n"), "key")
    parts = sized.groupBy("c").agg(F.ceil(F.sum("n") / (FINE_TOKENS if fine else BLOCK_TOKENS)).alias("parts"))
    slots = written(sized.join(parts, "c").select("key", "id", "c", F.pmod(F.xxhash64("key"), "parts").alias("part")), where, f"{name}_slots")
    of = lambda x: slots.select(F.col("key").alias(x), "c", F.col("part").alias(f"part_{x}"))
    block = F.struct("c", F.least("part_a", "part_b").alias("x"), F.greatest("part_a", "part_b").alias("y"))
    dealt = written(pairs.join(of("a"), "a").join(of("b").drop("c"), "b").select("a", "b", block.alias("block")), where, f"{name}_dealt")
    wanted = dealt.select(F.col("a").alias("key"), "block").union(dealt.select(F.col("b").alias("key"), "block")).groupBy("key").agg(F.collect_set("block").alias("blocks"))
    nodes = written(wanted.join(slots.select("key", "id", "part", F.col("c").alias("label")), "key"), where, f"{name}_nodes")
    sets = token_sets(docs, nodes, fine)

    def compare(these: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        tokens = {i: np.frombuffer(x, dtype="<u2" if fine else "<u8") for i, x in zip(held["key"].tolist(), held["tokens"], strict=True)}
        out = []
        for a, of_a in these.groupby("a")["b"]:
            ta = tokens.get(a)
            bs = [b for b in of_a if b in tokens]
            if ta is None or not bs:
                continue
            shared = most_shared(ta, [tokens[b] for b in bs]) if fine else [exactly_shared(ta, tokens[b]) for b in bs]
            out += [(a, b) for b, n in zip(bs, shared, strict=True) if 100 * n >= PERCENT * (len(ta) + len(tokens[b]) - n)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    found = dealt.groupBy("block.c", "block.x", "block.y").cogroup(sets.groupBy("block.c", "block.x", "block.y")).applyInPandas(compare, "a long, b long")
    links = written(found, where, f"{name}_links")
    forget(docs.sparkSession, where, *(f"{name}_{x}" for x in ("near", "slots", "dealt", "nodes")))
    return links


def exactly_shared(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b))


def flips(sets: list[np.ndarray], width: int) -> np.ndarray:
    """A row of bits for each set, in which each shingle flips one: two rows differ in at most as many bits as their sets in shingles."""
    out = np.zeros((len(sets), width), dtype=np.float32)
    for row, s in zip(out, sets, strict=True):
        row[:] = np.bincount(((s >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return out


def block_links(xs: list[np.ndarray], ys: list[np.ndarray] | None, labels_x: list[int], labels_y: list[int]) -> list[tuple[int, int]]:
    """Links (place in xs, place in ys) that join the labels which any links join; without ys, among xs. Sets that differ in d shingles reach the
    similarity if (100 + PERCENT) * d <= (100 - PERCENT) * (size + size)."""
    own = ys is None
    ys, labels_y = (xs, labels_x) if own else (ys, labels_y)
    width = 256
    while width < 4 * max(map(len, xs + ys)):
        width *= 2
    fx, nx = flips(xs, width), np.array([len(s) for s in xs])
    fy, ny = (fx, nx) if own else (flips(ys, width), np.array([len(s) for s in ys]))
    ox, oy, lx, ly = fx.sum(axis=1), fy.sum(axis=1), np.array(labels_x), np.array(labels_y)
    up: dict[int, int] = {}

    def top(a: int) -> int:
        while (b := up.get(a, a)) != a:
            up[a] = a = up.get(b, b)
        return a

    out = []
    for at in range(0, len(xs), 256):
        end = at + 256
        apart = ox[at:end, None] + oy[None, :] - 2 * (fx[at:end] @ fy.T)
        may = ((100 + PERCENT) * apart <= (100 - PERCENT) * (nx[at:end, None] + ny[None, :]) + 0.5) & (lx[at:end, None] != ly[None, :])
        if own:
            may &= np.arange(len(ys))[None, :] > np.arange(at, min(end, len(xs)))[:, None]
        for i, j in zip(*map(np.ndarray.tolist, np.nonzero(may)), strict=True):
            a, b = top(labels_x[at + i]), top(labels_y[j])
            if a != b:
                n = exactly_shared(xs[at + i], ys[j])
                if 100 * n >= PERCENT * (len(xs[at + i]) + len(ys[j]) - n):
                    up[max(a, b)] = min(a, b)
                    out.append((at + i, j))
    return out


def block_compared(members: DataFrame, reps: DataFrame, docs: DataFrame, where: str, room: float) -> DataFrame:
    """Links (a, b) that join the components c which any links join, among members (entry, key, n, c) of entries; about ``room`` tokens are sent at once."""
    spark = docs.sparkSession
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(STEP)).cast("long")
    near = components(members.groupBy("entry").agg(F.min("key").alias("a")).join(members.select("entry", F.col("key").alias("b")), "entry").select("a", "b"), f"{where}/block_near")
    distinct = members.select("key", F.col("n").cast("long").alias("n"), "c").distinct().join(near.select(F.col("node").alias("key"), F.col("component").alias("g")), "key", "left").withColumn("g", F.coalesce("g", "key")).withColumn("step", step)
    sizes = distinct.groupBy("g", "step").agg(F.ceil(F.greatest(F.sum("n") / PART_TOKENS, F.count(F.lit(1)) / BLOCK_SETS)).alias("parts"))
    part = F.shiftleft("step", 40) + F.pmod(F.xxhash64("key"), "parts")
    slots = written(distinct.join(sizes, ["g", "step"]).select("key", "n", "g", "step", "c", part.alias("part")), where, "block_slots")
    met = members.join(slots.select("key", "g", "part"), "key").groupBy("entry").agg(F.min("g").alias("g"), F.array_sort(F.collect_set("part")).alias("parts"))
    close = lambda p: F.filter("parts", lambda q: (q >= p) & (F.shiftright(q, 40) - F.shiftright(p, 40) <= 1))
    each = F.flatten(F.transform("parts", lambda p: F.transform(close(p), lambda q: F.struct(p.alias("x"), q.alias("y")))))
    blocks = written(met.select("g", F.inline(each)).distinct(), where, "block_blocks")
    block = F.struct(F.col("g").alias("c"), "x", "y").alias("block")
    ends = blocks.select("g", F.col("x").alias("part"), block).union(blocks.filter("x <> y").select("g", F.col("y").alias("part"), block))
    sent = ends.join(slots.groupBy("g", "part").agg(F.sum("n").alias("n")), ["g", "part"]).agg(F.sum("n")).first()[0] or 0
    rounds = max(1, math.ceil(sent / room))

    def compare(block: tuple, held: pd.DataFrame) -> pd.DataFrame:
        held = held.drop_duplicates("key")
        sets = [np.frombuffer(x, dtype="<u8") for x in held["tokens"]]
        keys, labels, left = held["key"].tolist(), held["label"].tolist(), (held["part"] == block[1]).tolist()
        own = block[1] == block[2]
        xs = [k for k in range(len(sets)) if left[k]]
        ys = xs if own else [k for k in range(len(sets)) if not left[k]]
        if not xs or not ys:
            return pd.DataFrame([], columns=["a", "b"], dtype="int64")
        found = block_links([sets[k] for k in xs], None if own else [sets[k] for k in ys], [labels[k] for k in xs], [labels[k] for k in ys])
        return pd.DataFrame([(keys[xs[i]], keys[ys[j]]) for i, j in found], columns=["a", "b"], dtype="int64")

    links = []
    for k in range(rounds):
        of = ends.filter(F.pmod(F.xxhash64("block"), F.lit(rounds)) == k).groupBy("g", "part").agg(F.collect_set("block").alias("blocks"))
        nodes = written(slots.join(of, ["g", "part"]).join(reps.select("key", "id"), "key").select("key", "id", "part", F.col("c").alias("label"), "blocks"), where, "block_nodes")
        links.append(written(token_sets(docs, nodes, False).groupBy("block.c", "block.x", "block.y").applyInPandas(compare, "a long, b long"), f"{where}/block_links", str(k)))
        forget(spark, where, "block_nodes")
    forget(spark, where, "block_near", "block_slots", "block_blocks")
    return reduce(DataFrame.union, links)


def starred(index: DataFrame, where: str) -> DataFrame:
    """entry, key, n, key0, n0 of the index's sets (entry, salts, salt, key, n, rare) that aren't their entry's or salt's centre, which is key0."""
    me = F.struct("rare", "n", "key")
    least = F.min(me).over(W.partitionBy("entry", "salt"))  # a salt has a bounded number of sets
    held = written(index.withColumn("least", least).filter((me != F.col("least")) | (F.col("salts") > 1)).select("entry", "key", "n", "rare", "least").distinct(), where, "starred")
    centres = held.filter(me == F.col("least")).select("entry", "key", "n", "rare")
    tops = centres.groupBy("entry").agg(F.min(me).alias("least"))
    of = lambda df: df.filter(me != F.col("least")).select("entry", "key", "n", F.col("least.key").alias("key0"), F.col("least.n").alias("n0"))
    return of(held).union(of(centres.join(tops, "entry")))


def labelled(members: DataFrame, label: DataFrame) -> DataFrame:
    """members (entry, key, n) with c, their component (node, component)."""
    return members.join(label.select(F.col("node").alias("key"), F.col("component").alias("of")), "key", "left").select("entry", "key", "n", F.coalesce("of", "key").alias("c"))


def mended(classes: np.ndarray, frequent: int, members: DataFrame) -> np.ndarray:
    """The order with the shingles of the members' entries frequent (and those of the same counters; a combination's mark is chance, which costs nothing but work)."""
    cell = F.col("entry").bitwiseAND(F.lit((1 << SKETCH_BITS) - 1)).cast("int").alias("cell")
    at = members.select(cell).distinct().toArrow().column(0).to_numpy()  # 2**SKETCH_BITS at most
    out = classes.copy()
    out[at] = np.maximum(out[at], frequent)
    return out


def classes_of(docs: DataFrame, where: str) -> DataFrame:
    """doc_id, text_key, key, n, c, component of each document; component is the smallest doc_id that links reach, c tells components with one such id apart."""
    spark = docs.sparkSession
    near = lambda n, m: 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)
    scan = written(scanned(docs), where, "scan")
    members = scan.filter("n is not null").select("doc_id", "text_key", "key", "n")
    reps = written(scan.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.max("hist").alias("hist")).filter("id is not null"), where, "classes")
    known = reps.select("key")
    room = max(ROOM_TOKENS, ROOM * (reps.agg(F.sum("n")).first()[0] or 0))
    classes, frequent = order_classes(scan)
    these, crowded, linked, tried, few, k = docs, math.inf, [], [], [], 0
    while True:
        met = written(starred(indexed(these, classes, frequent), where).join(known, "key", "left_semi").join(known.withColumnRenamed("key", "key0"), "key0", "left_semi"), where, "met")
        pairs = written(met.filter(near(F.col("n"), F.col("n0"))).select(F.col("key0").alias("a"), F.col("key").alias("b")).distinct(), where, f"pairs1_{k}")
        linked.append(compared(written(possible(pairs, reps), where, f"possible1_{k}"), reps, docs, where, f"first_{k}", False))
        tried.append(pairs)
        inside = met.select("entry", "key", "n").union(met.select("entry", F.col("key0").alias("key"), F.col("n0").alias("n"))).distinct()
        label = components(reduce(DataFrame.union, linked), f"{where}/label1_{k}")
        placed = written(labelled(inside, label), where, "placed")
        forget(spark, where, "starred", "met")
        sizes = placed.groupBy("entry").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("m")).filter("c0 <> c1").select("entry", "m")
        open_ = written(placed.join(sizes, "entry"), where, f"open_{k}")
        forget(spark, where, "placed")
        many = open_.filter(F.col("m") > PAIRED).drop("m")
        few.append(open_.filter(F.col("m") <= PAIRED).select("entry", "key", "n"))
        crowd = written(many.select("key", "n").distinct().join(reps.select("key", "id"), "key"), where, f"crowd_{k}")
        tokens = crowd.agg(F.sum("n")).first()[0] or 0
        rows = many.count()
        # all parts against all would send the tokens tokens / PART_TOKENS times; long entries of combinations stay when the order is mended
        if tokens * max(1, tokens / PART_TOKENS) <= room or rows > crowded / 2:
            break
        crowded, k = rows, k + 1
        classes = mended(classes, frequent, many)
        these = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small_side(crowd.select("id")), "id", "left_semi")
    links = reduce(DataFrame.union, linked)
    if not many.isEmpty():
        links = links.union(block_compared(many, reps, docs, where, room))
        label = components(links, f"{where}/label2")
    listed = labelled(reduce(DataFrame.union, few), label).groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("key", "n", "c"))).alias("s"))  # at most PAIRED of each index
    partners = lambda x: F.transform(F.filter("s", lambda y: (x["key"] < y["key"]) & (x["c"] != y["c"]) & near(x["n"], y["n"])), lambda y: F.struct(x["key"].alias("a"), y["key"].alias("b")))
    rest = listed.select(F.inline(F.flatten(F.transform("s", partners)))).distinct()
    done = reduce(DataFrame.union, tried).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs2 = written(possible(rest.join(done, ["a", "b"], "left_anti"), reps), where, "pairs2")
    forget(spark, where, *(f"{x}_{i}" for x in ("open", "crowd") for i in range(k + 1)))
    last = compared(compared(pairs2, reps, docs, where, "fine", True), reps, docs, where, "second", False)
    if not last.isEmpty():
        label = components(links.union(last), f"{where}/all")
    named = reps.join(label.select(F.col("node").alias("key"), F.col("component").alias("of")), "key", "left").select("key", "id", F.coalesce("of", "key").alias("c"))
    found = written(named.join(named.groupBy("c").agg(F.min("id").alias("component")), "c").select("key", "c", "component"), where, "found")
    forget(spark, where, *(f"{x}_{i}" for x in ("label1", "pairs1", "possible1") for i in range(k + 1)), *(f"first_{i}_links" for i in range(k + 1)))
    forget(spark, where, "label2", "all", "pairs2", "classes", "fine_links", "second_links", "block_links")
    return members.join(found, "key", "left").select("doc_id", "text_key", "key", "n", "c", F.coalesce("component", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents with their sets' sizes and components."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return classes_of(docs, shared_dir(spark)).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with its smallest doc_id, of several of its texts under this id the one of least hash, of repeated rows one. Rows
    without words, and those without doc_id whose component has none, stay."""
    prepare(spark)
    where = shared_dir(spark)
    rows = written(classes_of(docs.select("doc_id", "text"), where).filter("n > 0 and component is not null"), where, "members")
    me = F.struct("key", "text_key")
    first = rows.filter("doc_id = component")
    clash = written(first.groupBy("doc_id", "c").agg(F.min(me).alias("least"), F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1), where, "clash")
    clashing = first.join(clash, ["doc_id", "c"])
    gone = rows.filter("doc_id is null or doc_id <> component").select("doc_id", "text_key").union(clashing.filter(me != F.col("least")).select("doc_id", "text_key")).distinct()
    id_, key = unused(docs, "id", "key")
    this = docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(key))
    out = docs.join(written(gone, where, "gone").toDF(id_, key), this, "left_anti")
    if clash.isEmpty():
        return out
    twice = written(clashing.filter(me == F.col("least")).groupBy("doc_id", "text_key").count().filter(F.col("count") > 1).select("doc_id", "text_key"), where, "twice").toDF(id_, key)
    this = out["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(out["text"]) == F.col(key))
    return out.join(twice, this, "left_anti").unionByName(out.join(twice, this, "left_semi").dropDuplicates(["doc_id", "text"]))
