"""Statistical tests from one pass of aggregates; p-values are columns too, from the distributions' tails."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

BUCKETS = 1024


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with average ranks of a column: its distinct values are ranked within BUCKETS ranges of equal width, which the sums of the buckets below shift, so no task sees all of them."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ends = df.agg(F.min(column).cast("double").alias("_a"), F.max(column).cast("double").alias("_z"))  # one row
    width = F.nullif(F.col("_z") - F.col("_a"), F.lit(0.0))
    bucket = F.coalesce(F.least(F.floor((F.col(column).cast("double") - F.col("_a")) / width * BUCKETS), F.lit(BUCKETS - 1)), F.lit(0))
    placed = counts.crossJoin(F.broadcast(ends)).withColumn("_b", bucket).drop("_a", "_z")
    sums = placed.groupBy("_b").agg(F.sum("_n").alias("_s"))
    below = sums.select(F.col("_b"), (F.sum("_s").over(W.orderBy("_b")) - F.col("_s")).alias("_below"))  # at most BUCKETS rows
    upto = F.sum("_n").over(W.partitionBy("_b").orderBy(column).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranks = placed.join(F.broadcast(below), "_b").select(F.col(column).alias("_v"), (F.col("_below") + upto - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v")).drop("_v")


def _continued(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def beta_part(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _continued(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _continued(b, a, 1 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for i in range(1, 10_000):
        b += 2
        d = 1 / (b - i * (i - a) * d or 1e-300)
        c = b - i * (i - a) / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def correlation_p(n: int, r: float) -> float | None:
    """Two-sided."""
    if r is None or math.isnan(r) or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else beta_part((n - 2) / 2, 0.5, 1 - r * r)


def anova_p(k: int, n: int, f: float) -> float | None:
    return None if f is None or math.isnan(f) else beta_part((n - k) / 2, (k - 1) / 2, (n - k) / (n - k + (k - 1) * f))


def kruskal_p(k: int, h: float) -> float | None:
    return None if h is None or math.isnan(h) else gamma_tail((k - 1) / 2, h / 2)


def with_p(df: DataFrame, p: Callable[..., float | None], *columns: str, name: str = "p") -> DataFrame:
    """A result of a few rows with its p-value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf[list(columns)].astype(object).where(pdf[list(columns)].notna(), None)
            yield pdf.assign(**{name: pd.Series([p(*r) for r in rows.itertuples(index=False)], index=pdf.index, dtype="float64")})

    return df.mapInPandas(run, StructType([*df.schema.fields]).add(name, DoubleType()))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, r, p."""
    found = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    return with_p(found, correlation_p, "n", "r")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return pearson(average_ranks(average_ranks(both, x, "_rx"), y, "_ry"), "_rx", "_ry")


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """k, n, f, p over groups of two rows or more; null unless there are two."""
    g = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).filter("n > 1")
    t = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    found = t.select("k", "n", F.when(F.col("k") > 1, (between / (F.col("k") - 1)) / F.nullif(F.col("within") / (F.col("n") - F.col("k")), F.lit(0.0))).alias("f"))
    return with_p(found, anova_p, "k", "n", "f")


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """k, n, h, p, corrected for ties."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    sizes = rows.groupBy(group).count().filter("count > 1").select(group)
    rows = rows.join(sizes, group, "left_semi").select(group, value)
    ranked = average_ranks(rows, value, "_r").groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("_r").alias("s"))
    t = ranked.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"))
    ties = rows.groupBy(value).count().agg(F.sum(F.col("count").cast("double") ** 3 - F.col("count")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n**3 - n), F.lit(0.0))
    return with_p(t.crossJoin(ties).select("k", "n", F.when(F.col("k") > 1, h).alias("h")), kruskal_p, "k", "h")  # two single rows


def significant(p: Column, level: float = 0.05) -> Column:
    return p < level


def effect(df: DataFrame, metadata: str, delta: str) -> tuple[str, DataFrame]:
    """The test that fits: numeric metadata in two rows or more correlates, other metadata is compared by groups, by ANOVA and (h, p_h) Kruskal and Wallis. Which it is,
    a job over two rows at most decides."""
    x = F.expr(f"try_cast(`{metadata}` as double)")
    numeric = df.withColumn("_x", x).filter("_x is not null and not isnan(_x)")
    if numeric.limit(2).count() == 2:
        return "numeric", pearson(numeric, "_x", delta)
    ranks = kruskal(df, metadata, delta).select("h", F.col("p").alias("p_h"))
    return "categorical", anova(df, metadata, delta).crossJoin(ranks)  # two single rows


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
