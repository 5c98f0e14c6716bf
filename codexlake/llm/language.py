"""Language identification with bit-sliced Bloom filters over character n-grams.

Row r of the table has bit l set if some n-gram of language l hashes to r: one lookup of HASHES rows, and-ed, returns all languages that hold an
n-gram. A language holds every n-gram of its training texts. For a text, the per-language counts of its n-grams are corrected for false positives
(a language with a part f of its rows set answers wrongly with f ** HASHES); an n-gram counts by its information, log of languages by holders, so that one which all
languages hold decides nothing. The largest sum decides; score is its part of the two largest, and where no n-gram tells languages apart the plain counts do.

The table is fitted on training texts of at most about SAMPLE documents a language, chosen by the hash of their ids, and is bounded by them; masks have as
many 64-bit words as there are languages by 64. Null text, or one without a letter, is `und` with score 0; texts whose n-grams no language holds get the most
frequent language with score 0; ties go to the more frequent language, then by name. Training rows with null lang are left out; with no training row at all
every text is `und`. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.llm.common import shared_dir, table, written

ORDERS, HASHES, ROW_BITS = (3, 4), 3, 21
SAMPLE = 2000
FOLDS, HELD_FOLD = 4, 2

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def codes(text: str) -> np.ndarray:
    """A mixed 64-bit code for each n-gram; runs of other characters are one mark."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = letter_table()[c]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, c, np.uint32(32))[keep].astype(np.uint64)
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    out = []
    for n in ORDERS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + c[k : len(c) - n + 1 + k]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            out.append(h * np.uint64(0xBF58476D1CE4E5B9))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def places(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(k * ROW_BITS)) & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """The bit-sliced table, rows of words of 64 languages each, and what is needed to read it."""

    def __init__(self, languages: list[str], rows: np.ndarray) -> None:
        self.languages, self.rows = languages, rows
        self.fill = np.array([np.count_nonzero(self.bit(rows, k)) / len(rows) for k in range(len(languages))])
        self.wrong = self.fill**HASHES

    @staticmethod
    def bit(masks: np.ndarray, k: int) -> np.ndarray:
        return masks[:, k // 64] & np.uint64(1 << (k % 64))

    @classmethod
    def of(cls, languages: list[str], held: np.ndarray, which: np.ndarray) -> Filters:
        """held: n-gram codes; which: the number of a language that holds each."""
        rows = np.zeros((1 << ROW_BITS, max(1, -(-len(languages) // 64))), dtype=np.uint64)
        for at in places(held):
            np.bitwise_or.at(rows, (at, which // 64), np.uint64(1) << (which % 64).astype(np.uint64))
        return cls(languages, rows)

    def holders(self, h: np.ndarray) -> np.ndarray:
        """The mask of languages for each n-gram."""
        first, *rest = places(h)
        found = self.rows[first]
        for at in rest:
            found = found & self.rows[at]
        return found

    def counts(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each language its n-grams' information and their number, both corrected for false positives."""
        n = len(self.languages)
        told, plain, total = np.zeros(n), np.zeros(n), 0.0
        for at in range(0, len(h), 1 << 16):
            found = self.holders(h[at : at + (1 << 16)])
            holds = np.stack([self.bit(found, k) != 0 for k in range(n)])
            worth = np.log(n / np.maximum(1, holds.sum(axis=0)))
            told, plain, total = told + holds @ worth, plain + holds.sum(axis=1), total + worth.sum()
        corrected = lambda raw, of: np.maximum(0, raw - of * self.wrong) / np.maximum(1 - self.wrong, 1e-9)
        return corrected(told, total), corrected(plain, len(h))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return "und", 0.0
        h = codes(text)
        if len(h) == 0 or not letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)].any():
            return "und", 0.0
        told, n = self.counts(h)
        if not told.any():
            told = n
        best = int(np.argmax(told))
        two = np.sort(told)[-2:].sum()
        return self.languages[best], float(told[best] / two) if two > 0 else 0.0


def fit(train: DataFrame) -> Filters:
    """train: doc_id, text, lang; lang is not null. One row a language is collected, and the sample's distinct n-grams."""
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not languages:
        return Filters.of([], np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    spark = train.sparkSession
    parts = spark.createDataFrame([(x, k, int(min(1.0, SAMPLE / sizes[x]) * (1 << 20))) for k, x in enumerate(languages)], "lang string, which int, part long")
    sample = train.join(F.broadcast(parts), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("part")).select("which", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: dict[int, list[np.ndarray]] = {}
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                of.setdefault(k, []).append(codes(text or ""))
            for k, each in of.items():
                got = np.unique(np.concatenate(each))
                yield pa.RecordBatch.from_pydict({"which": pa.array(np.full(len(got), k, dtype=np.int32)), "gram": got.view(np.int64)})

    held = written(sample.mapInArrow(grams, "which int, gram long").distinct(), shared_dir(spark), "grams").toPandas()  # bounded by the sample
    return Filters.of(languages, held["gram"].to_numpy(np.int64).view(np.uint64), held["which"].to_numpy(np.int64))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score for docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.rows))  # 2**ROW_BITS rows of 8 bytes for 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(*shared.value)
        for b in batches:
            got = [own.predict(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents with predicted languages."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    filters = fit(docs.filter((fold(FOLDS) != HELD_FOLD) & F.col("lang").isNotNull()))
    held = F.coalesce(fold(FOLDS) == HELD_FOLD, F.lit(False))
    return predict(docs, filters).select("doc_id", held.alias("held_out"), "lang_pred", "score")
