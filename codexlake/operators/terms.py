"""Which word n-grams can be among the most frequent: a first count by 64-bit hashes, packed, so that the n-grams of all texts needn't be shuffled as strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.session import ship

#: N-grams that a task of the first count holds before it packs them; bits of a hash that name its bucket, at least; bits of the filter (64 MB at most) as a power of two; words at once.
CHUNK, BUCKET_BITS, FILTER_BITS, WORDS = 2_000_000, 11, (20, 29), 1 << 19


def words(c: Column, stopwords: list[str]) -> Column:
    """The words of a text without stop-words; a word has two Latin letters or more and nothing else."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z]{2,}(?![\p{L}\p{N}_])"), F.lit(0)), lambda x: ~x.isin(stopwords))


def flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All values, and how many each row has (0 where it is null)."""
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut into rows of some WORDS words; their hashes and how many each row has."""
    for batch in batches:
        _, sizes = flat(batch.column("hashes"))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // WORDS)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            part = batch.slice(int(a), int(b - a))
            yield part, part.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64), sizes[a:b]


def gram_hashes(h: np.ndarray, sizes: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, places of the first word and hashes of the n-grams that lie within a row. h: the words' hashes, one row after another."""
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(h))
    at, x = np.arange(len(h)), h
    for n in range(1, high + 1):
        if n > 1:
            fits = left[at] >= n
            at, x = at[fits], x[fits]
            x = x * np.uint64(0x9E3779B97F4A7C15) + h[at + n - 1]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
        if n >= low:
            yield n, at, x


def summed(h: np.ndarray, code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of h and code in their order, with the sum of n (or the number) of each."""
    order = np.lexsort((code, h))
    h, code = h[order], code[order]
    starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (code[1:] != code[:-1])]) if len(h) else np.zeros(0, dtype=np.int64)
    return h[starts], code[starts], np.diff(np.r_[starts, len(h)]) if n is None or not len(h) else np.add.reduceat(n[order], starts)


def planes(a: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: they compress better."""
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def packed(h: np.ndarray, cluster: np.ndarray, n: np.ndarray) -> tuple[int, int, bytes]:
    """How many hashes and clusters there are, and sorted hashes as differences, the clusters' hashes by number, counts."""
    known, code = np.unique(cluster, return_inverse=True)
    data = pa.compress(planes(np.diff(h, prepend=np.uint64(0))) + planes(code.astype(np.uint32)) + planes(n.astype(np.uint64)) + known.tobytes(), codec="zstd", asbytes=True)
    return len(h), len(known), data


def unpacked(n: int, clusters: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, 20 * n + 8 * clusters, codec="zstd", asbytes=True), dtype=np.uint8)
    part = lambda a, b, kind: np.ascontiguousarray(raw[a * n : b * n].reshape(b - a, n).T).view(kind).ravel()
    return np.cumsum(part(0, 8, np.uint64), dtype=np.uint64), raw[20 * n :].view(np.int64)[part(8, 12, np.uint32)], part(12, 20, np.uint64).astype(np.int64)


def _packs(held: list[tuple[np.ndarray, np.ndarray]], bits: int) -> pa.RecordBatch:
    known, code = np.unique(np.concatenate([c for _, c in held]), return_inverse=True)
    h, code, n = summed(np.concatenate([h for h, _ in held]), code.astype(np.uint16 if len(known) < 1 << 16 else np.uint32))
    ends = np.searchsorted(h, np.arange(1, 1 << bits).astype(np.uint64) << np.uint64(64 - bits))
    rows = [(b, *packed(h[s:e], known[code[s:e]], n[s:e])) for b, (s, e) in enumerate(zip([0, *ends], [*ends, len(h)], strict=True)) if e > s]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["bucket", "n", "clusters", "data"])


def candidates(df: DataFrame, low: int, high: int, least: int, most: float, features: int, bits: int) -> DataFrame:
    """hash, total of the n-grams in ``least`` to ``most`` clusters, from df (cluster: a hash, hashes: of the words of a text); of a bucket, the ``features`` most frequent with ties."""

    def pack(batches):
        held, size = [], 0
        for batch, h, sizes in pieces(batches):
            of = np.repeat(batch.column("cluster").to_numpy(zero_copy_only=False), sizes)
            for _, at, x in gram_hashes(h, sizes, low, high):
                held.append((x, of[at]))
                size += len(x)
                if size >= CHUNK:
                    yield _packs(held, bits)
                    held, size = [], 0
        if size:
            yield _packs(held, bits)

    def found(packs: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        h, c, n = (np.concatenate(x) for x in zip(*(unpacked(*p) for p in packs), strict=True))
        h, _, n = summed(h, np.unique(c, return_inverse=True)[1], n)
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        within, total = np.diff(np.r_[starts, len(h)]), np.add.reduceat(n, starts)
        keep = (within >= least) & (within <= most)
        h, total = h[starts][keep], total[keep]
        if len(h) > features:
            keep = total >= np.partition(total, -features)[-features]
            h, total = h[keep], total[keep]
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(total)], ["hash", "total"])

    def count(batches):
        packs, now = [], None
        for batch in batches:
            for bucket, *p in zip(*(batch.column(k).to_pylist() for k in ("bucket", "n", "clusters", "data")), strict=True):
                if bucket != now and packs:
                    yield found(packs)
                    packs = []
                now = bucket
                packs.append(p)
        if packs:
            yield found(packs)

    return df.mapInArrow(pack, "bucket int, n long, clusters long, data binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "hash long, total long")


def _bits(h: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a filter of 2 ** size bits, both in the part of the hash's bucket."""
    inner = np.uint64((1 << (size - bits)) - 1)
    first = h >> np.uint64(64 - size)
    return first, (first & ~inner) | (h & inner)


def gram_filter(chosen: DataFrame, size: int, bits: int) -> np.ndarray:
    """Bytes of a filter of 2 ** size bits that knows all hashes of chosen (hash); each task makes the parts of its buckets."""
    width = 1 << (size - bits)

    def mark(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in _bits(h, size, bits):
                of = (at >> np.uint64(size - bits)).astype(np.int64)
                for b in np.unique(of):
                    x = (at[of == b] & np.uint64(width - 1)).astype(np.int64)
                    np.bitwise_or.at(parts.setdefault(int(b), np.zeros(width // 8, dtype=np.uint8)), x >> 3, (1 << (x & 7)).astype(np.uint8))
        for b, part in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part.tobytes()])], ["bucket", "part"])

    out = np.zeros((1 << bits, width // 8), dtype=np.uint8)
    for r in chosen.select("hash").mapInArrow(mark, "bucket int, part binary").collect():
        out[r["bucket"]] |= np.frombuffer(r["part"], dtype=np.uint8)
    return out.ravel()


def frequent_grams(df: DataFrame, stopwords: list[str], low: int, high: int, least: int, most: float, features: int) -> DataFrame:
    """cluster, term of the occurrences of n-grams from df (cluster, text), without those that can't be among the ``features`` most frequent in at least ``least`` clusters and at most
    the part ``most`` of them. Others can pass; who counts the terms finds them out.

    N-grams are counted by hash before: shuffled are some six bytes for each n-gram that a cluster has in a chunk of a task. Terms whose 64-bit hashes are the same count together there
    (for one of 100,000 terms among two billion about one case in 100,000). Runs three jobs while the query is built."""
    spark = ship(df.sparkSession)
    bits = max(BUCKET_BITS, (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    found = words(F.col("text"), stopwords)
    upto = most * df.agg(F.count_distinct("cluster")).first()[0]
    counted = candidates(df.select(F.xxhash64("cluster").alias("cluster"), F.transform(found, lambda w: F.xxhash64(w)).alias("hashes")), low, high, least, upto, features, bits).persist(StorageLevel.DISK_ONLY)
    try:
        totals = counted.groupBy("total").count().toPandas().sort_values("total", ascending=False)  # a row for each distinct total
        upper = totals["count"].cumsum()
        enough = upper[upper >= features]
        floor, n = (int(totals["total"].loc[enough.index[0]]), int(enough.iloc[0])) if len(enough) else (0, int(totals["count"].sum()))
        size = max(bits + 3, min(max((64 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1]))
        known = spark.sparkContext.broadcast(gram_filter(counted.filter(F.col("total") >= floor), size, bits))
    finally:
        counted.unpersist()

    def pick(batches):
        for batch, h, sizes in pieces(batches):
            texts, of = batch.column("words").flatten(), np.repeat(np.arange(len(sizes)), sizes)
            for n, at, x in gram_hashes(h, sizes, low, high):
                for k in (0, 1):  # the second bit of those that have the first
                    bit = _bits(x, size, bits)[k]
                    have = (known.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    at, x = at[have], x[have]
                if len(at):
                    term = pc.binary_join_element_wise(*(texts.take(pa.array(at + k)) for k in range(n)), " ")
                    yield pa.RecordBatch.from_arrays([batch.column("cluster").take(pa.array(of[at])), term], ["cluster", "term"])

    kind = df.schema["cluster"].dataType.simpleString()
    both = df.select("cluster", F.explode(F.array(found)).alias("words")).select("cluster", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    return both.mapInArrow(pick, f"cluster {kind}, term string")
