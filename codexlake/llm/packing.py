"""Packing documents into training sequences, in order, by dynamic programming over the places where a sequence may end.

A sequence may end after a document (free), after any sentence (SENTENCE_CUT) or, where neither comes within a sequence's length, after any token
between (HARD_CUT); it costs its padding and the penalty of its end. best(j) = min over i with pos(j) - pos(i) <= length of
best(i) + pos(i), plus length - pos(j) + penalty(j): the inner minimum over a sliding range comes from a monotone queue, so the work is
linear in the places. A sequence whose length is a power of two is not padded; those transitions are few and are tried one by one.

Each partition packs its own rows in the order in which they come, so nothing is shuffled; it works in runs of RUN_TOKENS, each of
which ends in at most a few short unpadded sequences. sequence_id is the partition's number times 2**32 plus a count. Null text is
empty and leaves the end id alone; an empty table gives no rows; equal rows are packed each on its own.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codexlake.llm.common import prepare, table, text_or_empty
from codexlake.llm.tokens import tokenizer, vocabulary_path

LENGTH, END_ID = 4096, 2
SENTENCE_CUT, HARD_CUT = 6, 40
RUN_TOKENS = 1 << 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def sentence_end_ids(names: list[str]) -> np.ndarray:
    """True at the ids of tokens that end a sentence."""
    return np.array([x.removesuffix("</w>").endswith((".", "!", "?")) for x in names])


def places(doc_ends: np.ndarray, sentence_ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a sequence may end, from 0 on, and their penalties."""
    total = int(doc_ends[-1])
    kind = np.full(total + 1, HARD_CUT, dtype=np.int64)
    kind[sentence_ends] = SENTENCE_CUT
    kind[doc_ends] = 0
    kind[0] = 0
    firm = np.flatnonzero(kind < HARD_CUT)
    more = [np.arange(firm[k] + 1, firm[k + 1]) for k in np.flatnonzero(np.diff(firm) > length)]
    pos = np.sort(np.concatenate([firm, *more]))
    return pos, kind[pos]


def window_ends(pos: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """The cheapest ends of sequences; pos starts with 0 and ends with the number of tokens, with no gap over length."""
    n = len(pos)
    exact: dict[int, list[int]] = {}
    power = 1
    while power < length:
        at = np.searchsorted(pos, pos - power)
        for j in np.flatnonzero((pos >= power) & (pos[np.minimum(at, n - 1)] == pos - power)):
            exact.setdefault(int(j), []).append(int(at[j]))
        power *= 2
    p, w = pos.tolist(), penalty.tolist()
    best, came = [0] * n, [0] * n
    queue = deque([0])
    keys = [0] * n
    for j in range(1, n):
        here = p[j]
        while here - p[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        cost = keys[i] + length - here
        for k in exact.get(j, ()):
            if best[k] < cost:
                cost, i = best[k], k
        best[j], came[j] = cost + w[j], i
        key = keys[j] = best[j] + here
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    ends, j = [], n - 1
    while j:
        ends.append(p[j])
        j = came[j]
    return ends[::-1]


def pack_run(doc_ids: list, ids: list[np.ndarray], is_end: np.ndarray, first: int, length: int = LENGTH) -> tuple[list[tuple], int]:
    """Rows of SCHEMA for some documents, whole, and the next sequence's number."""
    stream = np.concatenate(ids)
    doc_ends = np.cumsum([len(x) for x in ids])
    pos, penalty = places(doc_ends, np.flatnonzero(is_end[stream]) + 1, length)
    rows, d, begin = [], 0, 0
    for end in window_ends(pos, penalty, length):
        at = begin
        while at < end:
            doc_begin = int(doc_ends[d - 1]) if d else 0
            stop = min(end, int(doc_ends[d]))
            rows.append((doc_ids[d], at - doc_begin, stop - at, zlib.crc32(stream[at:stop].tobytes()), len(ids[d]), first, at - begin, end - begin))
            at = stop
            d += at == doc_ends[d]
        begin, first = end, first + 1
    return rows, first


def pack(docs: DataFrame, path: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Rows of SCHEMA, one for each piece of a document, from docs (doc_id, text; other columns are ignored)."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, spaces_kept=False)
        is_end = sentence_end_ids(t.token_strings())
        number = TaskContext.get().partitionId() << 32
        doc_ids, ids, held = [], [], 0
        for b in batches:
            for doc_id, x in zip(b.column(0).to_pylist(), t.ids(b.column(1).to_pylist()), strict=True):
                doc_ids.append(doc_id)
                ids.append(np.append(x, np.uint32(end_id)))
                held += len(x) + 1
                if held >= RUN_TOKENS:
                    rows, number = pack_run(doc_ids, ids, is_end, number, length)
                    yield _batch(rows)
                    doc_ids, ids, held = [], [], 0
        if ids:
            rows, number = pack_run(doc_ids, ids, is_end, number, length)
            yield _batch(rows)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents, packed to 4096 tokens."""
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path("word_bpe_49k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage."""
    prepare(spark)
    return pack(docs, vocabulary_path("word_bpe_49k.json"))
