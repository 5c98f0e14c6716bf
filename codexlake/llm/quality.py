"""Quality rules: base counts of a text, and robust multivariate outliers among texts of one language and source.

The statistic vector of a text (VECTOR) is compared with a minimum-covariance-determinant estimate of its group. There are STARTS first estimates: the medians with the
quartiles' spread, and the means and covariances of about ELEMENTS texts chosen by hash. A concentration step takes squared Mahalanobis distances, the half of the
group with the smallest ones, its mean and covariance. After TRIED steps the start with the least determinant goes on until no group's determinant falls by a part of
more than SETTLED, or STEPS are done. A group is never brought together: each step is one aggregate of counts, sums and products by group and bin of the distance, from
which the half is read off to a bin's edge (a bin is 2.5 hundredths of a distance). The last covariance is scaled, up or down, so that the group's median distance is the chi-square median.

Groups are estimated on three levels: language and source, language, all. A group's estimate is shrunk towards that of the level above, n parts of its own and SHRINK
of the other's, so small groups lean on what they are part of and none is left out. FLOOR then bounds the standard deviations from below, in every direction, as
clean groups have statistics that never vary (RIDGE of it keeps the covariance invertible until then), and texts beyond the chi-square quantile QUANTILE are rejected.
QUANTILE, of 1 - 10 ** -k, has the fewest errors on the labelled texts with an even doc_id of sf0.1.

Null language or source count as groups of their own. A null or empty text has no words and fails the base rules. Repeated rows are judged alike. An empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexlake.llm.common import shared_dir, small_side, table, text_or_empty, written

VECTOR = ("log words", "log mean word length", "root of symbols a word", "root of repeated lines", "root of repeated words", "log words a sentence", "log distinct words by log words")
FLOOR = (0.3, 0.04, 0.15, 0.15, 0.15, 0.2, 0.02)
STARTS, ELEMENTS, TRIED, STEPS, SETTLED = 4, 24, 2, 20, 1e-3
BINS, SHRINK = 480, 50
RIDGE, QUANTILE = 0.05, 0.99999
MIN_WORDS, MAX_REPEAT = 50, 50
D = len(VECTOR)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def base_counts(text: str) -> tuple[int, int, int, int, int, int, int]:
    """COUNTS, lines with a word, distinct words."""
    words = WORD.findall(text)
    n = len(words)
    seen, lines, dup = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return n, sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dup, repeated, lines, len(set(words))


def vector(counts: tuple, sentence_marks: int) -> list[float]:
    n, chars, symbols, dup, repeated, lines, distinct = counts
    return [math.log(n), math.log(chars / n), math.sqrt(symbols / n), math.sqrt(dup / max(1, lines)), math.sqrt(repeated / n), math.log(n / (1 + sentence_marks)), math.log(distinct) / math.log(max(2, n))]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed and x (null where it failed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in b.column(3).to_pylist():
                c = base_counts(text)
                failed = c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT * c[0]
                x = None if failed else vector(c, text.count(".") + text.count("!") + text.count("?"))
                for held, v in zip(cols, (*c[:5], failed, x), strict=True):
                    held.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "lang", "source", *COUNTS, "base_failed", "x"])

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, x array<double>"
    named = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text_or_empty().alias("text"))
    return named.mapInArrow(run, schema)


def chi_square(p: float, d: int = D) -> float:
    """The quantile, after Wilson and Hilferty."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * d))) ** 3


def grouped(rows: DataFrame) -> DataFrame:
    """pools (of the three levels), x and id of the rows that have x."""
    own = F.concat_ws("\x01", F.lit("s"), "lang", "source")
    return rows.filter("x is not null").select(F.array(own, F.concat_ws("\x01", F.lit("l"), "lang"), F.lit("a")).alias("pools"), "x", F.xxhash64("doc_id", "x").alias("id"))


KEY = ["pool", "start"]


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """For each key: n, sums and products of x."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(D)), *(F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in PAIRS))


def bin_of(d2: np.ndarray | float) -> np.ndarray:
    return np.clip(np.floor(40 * np.log(np.maximum(d2, 1e-300)) + 160), 0, BINS - 1).astype(int)


def bin_column() -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(40 * F.log(F.greatest("d2", F.lit(1e-300))) + 160))).cast("int")


def moments(near: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance, with RIDGE of FLOOR, of rows of sums."""
    n = near.n.sum()
    mean = near[[f"s{i}" for i in range(D)]].sum().to_numpy() / n
    cov = np.zeros((D, D))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = near[f"p{i}_{j}"].sum() / n - mean[i] * mean[j]
    values, vectors = np.linalg.eigh(cov)  # rounding can leave small negative ones
    return mean, (vectors * np.maximum(values, 0)) @ vectors.T + np.diag(np.square(FLOOR)) * RIDGE**2


def estimate(pool: str, start: int, mean: np.ndarray, cov: np.ndarray, n: int, settled: bool) -> pd.DataFrame:
    return pd.DataFrame({"pool": [pool], "start": [start], "mean": [mean.tolist()], "inverse": [np.linalg.inv(cov).ravel().tolist()], "logdet": [float(np.linalg.slogdet(cov)[1])], "n": [int(n)], "settled": [settled]})


ESTIMATE = "pool string, start int, mean array<double>, inverse array<double>, logdet double, n long, settled boolean"


def half_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of sums, by bin, of the half of least distance."""
    pdf = pdf.sort_values("bin")
    return pdf.iloc[: int(np.searchsorted(pdf.n.cumsum().to_numpy(), (pdf.n.sum() + D + 1) // 2)) + 1]


def concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
    """A start's next estimate, from its group's sums by bin of the squared distance; logdet is the determinant's, settled if it fell no more."""
    mean, cov = moments(half_of(pdf))
    out = estimate(pdf.pool.iloc[0], pdf.start.iloc[0], mean, cov, pdf.n.sum(), False)
    out["settled"] = bool(out.logdet[0] > pdf.logdet.iloc[0] - SETTLED)
    return out


def medians(pdf: pd.DataFrame) -> pd.DataFrame:
    """A pool's first estimate, from its counts by dimension and bin of width FLOOR / 2: the medians, and FLOOR and a bin as deviations."""
    mid, dev = np.zeros(D), np.ones(D)
    for k, of in pdf.groupby("k"):
        of = of.sort_values("at")
        upto, half = of.n.cumsum().to_numpy(), of.n.sum() / 2
        mid[k] = (of["at"].iloc[int(np.searchsorted(upto, half))] + 0.5) * FLOOR[k] / 2
        quarters = [of["at"].iloc[int(np.searchsorted(upto, q * of.n.sum()))] * FLOOR[k] / 2 for q in (0.25, 0.75)]
        dev[k] = math.hypot((quarters[1] - quarters[0]) / 1.349, FLOOR[k])
    return estimate(pdf.pool.iloc[0], 0, mid, np.diag(dev**2.0), pdf.n.sum() // D, False).assign(logdet=math.inf)


def elements(pdf: pd.DataFrame) -> pd.DataFrame:
    """A first estimate from the sums of few texts; FLOOR keeps their spread from being none."""
    mean, cov = moments(pdf)
    return estimate(pdf.pool.iloc[0], pdf.start.iloc[0], mean, cov + np.diag(np.square(FLOOR)), pdf.n.sum(), False).assign(logdet=math.inf)


def distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """rows (pool, x) with their d2 from each estimate of their pool."""
    at = [F.col("x")[i] - F.col("mean")[i] for i in range(D)]
    d2 = sum(((1 if i == j else 2) * at[i] * at[j] * F.col("inverse")[i * D + j] for i, j in PAIRS), F.lit(0.0))
    return rows.join(small_side(estimates, ("mean", "inverse")), "pool").withColumn("d2", d2)


def stepped(usable: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimates after a concentration step."""
    at = distances(usable, estimates.drop("n", "settled")).select(*KEY, "x", "logdet", bin_column().alias("bin"))
    return _sums(at, *KEY, "bin", "logdet").groupBy(*KEY).applyInPandas(concentrate, ESTIMATE)


def estimated(rows: DataFrame, where: str) -> DataFrame:
    """ESTIMATE of each pool of rows (pools, x, id): of its starts, the one of least determinant."""
    usable = rows.select(F.explode("pools").alias("pool"), "x")
    counts = rows.select(F.explode("pools").alias("pool"), "id", "x")
    each = F.array(*(F.struct(F.lit(i).alias("k"), F.floor(F.col("x")[i] * (2 / FLOOR[i])).alias("at")) for i in range(D)))
    middle = written(usable.select("pool", F.inline(each)).groupBy("pool", "k", "at").agg(F.count(F.lit(1)).alias("n")).groupBy("pool").applyInPandas(medians, ESTIMATE), where, "medians")
    part = F.lit(float(ELEMENTS)) / F.col("n") * (1 << 20)
    chosen = F.filter(F.array(*(F.lit(k) for k in range(1, STARTS))), lambda k: F.pmod(F.xxhash64("id", k), F.lit(1 << 20)) < part)
    picked = counts.join(small_side(middle.select("pool", "n"), ("pool",)), "pool").select("pool", F.explode(chosen).alias("start"), "x")
    first = _sums(picked, *KEY).groupBy(*KEY).applyInPandas(elements, ESTIMATE)
    now = written(middle.union(first), where, "start")
    for k in range(TRIED):
        now = written(stepped(usable, now), where, f"tried{k}")
    now = written(now.withColumn("r", F.row_number().over(W.partitionBy("pool").orderBy("logdet", "start"))).filter("r = 1").drop("r").withColumn("settled", F.lit(False)), where, "best")
    for k in range(STEPS):
        after = stepped(usable, now.filter("not settled"))
        now = written(now.filter("settled").unionByName(after), where, f"step{k}")
        if now.filter("not settled").isEmpty():
            break
    return now


def judged(docs: DataFrame, where: str) -> DataFrame:
    """docs' features with d2, squared distance by the chi-square scale (null where the base rules failed), and kept."""
    rows = written(features(docs), where, "features")
    usable = written(grouped(rows), where, "grouped")
    estimates = estimated(usable, where)
    half = distances(usable.select(F.explode("pools").alias("pool"), "x"), estimates).withColumn("bin", bin_column()).groupBy("pool", "bin").agg(F.count(F.lit(1)).alias("n"))
    scale = half.groupBy("pool").applyInPandas(_middle, "pool string, scale double")
    own = written(estimates.join(scale, "pool").select("pool", "mean", "inverse", "scale", F.col("n").alias("size")), where, "own")
    part = F.split("pool", "\x01")
    above = F.when(part[0] == "s", F.concat_ws("\x01", F.lit("l"), part[1])).when(part[0] == "l", F.lit("a"))
    up = lambda name: own.select(*(F.col(c).alias(f"{name}_{c}") for c in own.columns))
    joined = own.filter(part[0] == "s").withColumn("l", above).join(up("l"), F.col("l") == F.col("l_pool")).join(up("a"), F.col("a_pool") == "a")
    final = written(joined.mapInPandas(_shrunk, "pool string, mean array<double>, inverse array<double>"), where, "final")
    scored = distances(rows.filter("x is not null").withColumn("pool", F.concat_ws("\x01", F.lit("s"), "lang", "source")), final)
    rest = rows.filter("x is null").withColumn("d2", F.lit(None).cast("double"))
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= chi_square(QUANTILE))
    names = ["doc_id", "lang", "source", *COUNTS, "base_failed", "d2"]
    return scored.select(*names).unionByName(rest.select(*names)).withColumn("kept", kept)


def _middle(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("bin")
    b = int(pdf.bin.iloc[int(np.searchsorted(pdf.n.cumsum().to_numpy(), pdf.n.sum() / 2))])
    return pd.DataFrame({"pool": [pdf.pool.iloc[0]], "scale": [math.exp((b + 0.5 - 160) / 40) / chi_square(0.5)]})


def bounded(cov: np.ndarray) -> np.ndarray:
    """cov with no variance under FLOOR's, in any direction."""
    unit = np.outer(FLOOR, FLOOR)
    values, vectors = np.linalg.eigh(cov / unit)
    return (vectors * np.maximum(values, 1.0)) @ vectors.T * unit


def _shrunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Estimates scaled, shrunk towards those of the levels above (l, then a), and bounded."""
    for b in batches:
        out = []
        for r in b.to_dict("records"):
            mean, cov = np.array(r["a_mean"]), np.linalg.inv(np.reshape(r["a_inverse"], (D, D))) * r["a_scale"]
            for level in ("l_", ""):
                own = r[level + "size"] / (r[level + "size"] + SHRINK)
                mean = own * np.array(r[level + "mean"]) + (1 - own) * mean
                cov = own * np.linalg.inv(np.reshape(r[level + "inverse"], (D, D))) * r[level + "scale"] + (1 - own) * cov
            out.append((r["pool"], mean.tolist(), np.linalg.inv(bounded(cov)).ravel().tolist()))
        yield pd.DataFrame(out, columns=["pool", "mean", "inverse"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents with their counts and verdicts."""
    return judged(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), shared_dir(spark)).select("doc_id", *COUNTS, "base_failed", "kept", "d2")
