"""Profiles, histograms, pivots, comparisons of reports, samples and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def null_shares(df: DataFrame) -> DataFrame:
    """column, null_proportion of every column, from one pass."""
    one = df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in df.columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("null_proportion")) for c in df.columns))))


def dense_counts(df: DataFrame, column: str) -> DataFrame:
    """column, n for every whole number from the least to the largest, 0 where there is none."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min(column).alias("a"), F.max(column).alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias(column))
    return span.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, c: Column, name: str = "value") -> DataFrame:
    return df.select(F.trim(c).alias(name)).filter(F.col(name) != "").groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, c: Column, width: int = 10) -> DataFrame:
    """bin, n for bins of a width from 0; the last bin holds its upper edge too."""
    x = df.select(c.cast("double").alias("x")).filter("x is not null")
    last = x.agg(F.greatest(F.ceil(F.max("x") / width) - 1, F.lit(0)).alias("last"))
    return x.crossJoin(F.broadcast(last)).select(F.least(F.floor(F.col("x") / width), F.col("last")).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))  # last is one row


def exploded_top(df: DataFrame, c: Column, separator: str = r"\|", k: int = 20) -> DataFrame:
    """value, n of the k most frequent parts of a list in a cell."""
    parts = df.select(F.explode(F.split(c, separator)).alias("value"))
    return value_counts(parts, F.col("value")).orderBy(F.desc("n"), "value").limit(k)


def confusion(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """tp, fn, fp, tn, n, agreement, truth_rate, said_rate (percent), accuracy, precision, recall; 0 where a rate has no base."""
    t, s = F.coalesce(truth, F.lit(False)), F.coalesce(said, F.lit(False))
    c = df.agg(F.count_if(t & s).alias("tp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & s).alias("fp"), F.count_if(~t & ~s).alias("tn"), F.count(F.lit(1)).alias("n"))
    rate = lambda a, b: F.coalesce(F.try_divide(a * F.lit(100.0), b), F.lit(0.0))
    x = F.col
    return c.select("*", rate(x("tp") + x("tn"), x("n")).alias("agreement"), rate(x("tp") + x("fn"), x("n")).alias("truth_rate"), rate(x("tp") + x("fp"), x("n")).alias("said_rate"), rate(x("tp"), x("tp") + x("fp")).alias("precision"), rate(x("tp"), x("tp") + x("fn")).alias("recall"))


def pass_rates(df: DataFrame, group: str, **flags: Column) -> DataFrame:
    """For each group and, with group null, overall: n and each flag's number and rate."""
    held = df.select(F.col(group).alias(group), *(F.coalesce(c, F.lit(False)).cast("int").alias(k) for k, c in flags.items()))
    aggs = [f(F.col(k)).alias(a) for k in flags for f, a in ((F.sum, k), (F.avg, f"{k}_rate"))]
    return held.rollup(group).agg(F.count(F.lit(1)).alias("n"), *aggs)


def mean_of_rates(df: DataFrame, group: str, flag: Column) -> DataFrame:
    """The unweighted mean of the groups' percentages."""
    return df.groupBy(group).agg(F.avg(F.when(flag, 100.0).otherwise(0.0)).alias("p")).agg(F.count(F.lit(1)).alias("groups"), F.avg("p").alias("mean_rate"))


def threshold_report(df: DataFrame, score: Column, passed: Column, threshold: float = 0.5) -> DataFrame:
    """agreement of a score's threshold with a verdict, the mean score of what leaks, and a suggestion 0.05 above it."""
    above = score >= threshold
    return df.agg(F.avg((above == passed).cast("double")).alias("agreement"), F.avg(F.when(above & ~passed, score)).alias("leaked_mean")).withColumn("suggested", F.col("leaked_mean") + 0.05)


def deltas(df: DataFrame) -> DataFrame:
    """paper_id, metadata, title, biased, unbiased, delta from rows (condition, paper_id, metadata, title, selected); null keys are left out."""
    keyed = df.filter("condition is not null and paper_id is not null and metadata is not null")
    mean = keyed.groupBy("paper_id", "metadata", "condition").agg(F.avg("selected").alias("m"), F.min("title").alias("title"))
    return mean.groupBy("paper_id", "metadata").pivot("condition", ["biased", "unbiased"]).agg(F.first("m")).join(mean.groupBy("paper_id", "metadata").agg(F.min("title").alias("title")), ["paper_id", "metadata"]).withColumn("delta", F.col("biased") - F.col("unbiased"))


def expanded(runs: DataFrame, papers: DataFrame) -> DataFrame:
    """A row for each run and paper of its topic, with selected; runs (topic, condition, iteration, citations), papers (topic, paper_id, title, metadata)."""
    return runs.join(papers, "topic").select("topic", "condition", "iteration", "paper_id", "title", "metadata", F.coalesce(F.array_contains("citations", F.col("paper_id")), F.lit(False)).cast("int").alias("selected"))


def rotated(df: DataFrame, runs: int, n: int) -> DataFrame:
    """df (rank from 0) for each of ``runs`` runs, its order turned by one more each time: run, place."""
    return df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("place", F.pmod(F.col("rank") - F.col("run"), F.lit(n)))


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def _drawn(key: str, seed: int) -> Column:
    """A random order of keys, the same for a seed, in any engine that knows md5."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def stratified(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, by the md5 of a key and a seed."""
    w = W.partitionBy(group).orderBy(_drawn(key, seed), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def reservoir(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A uniform sample of n rows, the same for a seed: the least hashes, kept partition by partition."""
    return df.orderBy(_drawn(key, seed), key).limit(n)


def topped_up(df: DataFrame, key: str, passed: Column, n: int, seed: int = 42, chunk: int = 2000, rounds: int = 10) -> DataFrame:
    """n rows that pass, drawn in rounds: round i takes the ``chunk`` (n in the first) rows of least hash by seed + i that no round before has taken, until n pass, a round adds
    none, or after ``rounds``. Each round is one job over the keys that are left; only counts reach the driver."""
    left, taken, have = df, None, 0
    for k in range(rounds):
        drawn = left.orderBy(_drawn(key, seed + k), key).limit(max(n, chunk) if k == 0 else chunk).withColumn("round", F.lit(k))
        new = drawn.filter(F.coalesce(passed, F.lit(False)))
        found = new.count()
        taken = new if taken is None else taken.unionByName(new)
        have += found
        if have >= n or not found:
            break
        left = left.join(drawn.select(key), key, "left_anti")
    return taken.orderBy("round", _drawn(key, seed), key).limit(n)


def budget_needed(df: DataFrame, group: str, rank: str, passed: Column, want: int = 20, first: int = 50, step: int = 20, last: int = 230) -> DataFrame:
    """group, budget: the least budget of first, first + step, ... up to last whose first ranks hold ``want`` passes; null if none does."""
    w = W.partitionBy(group).orderBy(rank)
    at = df.withColumn("_p", F.sum(passed.cast("int")).over(w)).filter(F.col("_p") >= want).groupBy(group).agg(F.min(rank).alias("at"))
    budget = F.when(F.col("at") <= first, first).otherwise(first + step * F.ceil((F.col("at") - first) / step))
    return df.select(group).distinct().join(at, group, "left").select(group, F.when(budget <= last, budget).cast("int").alias("budget"))


def best_by_name(df: DataFrame, name: Column, score: str, *order: str) -> DataFrame:
    w = W.partitionBy(name).orderBy(F.desc(score), *order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def fallback_choice(df: DataFrame, score: str, *tiers: Column) -> DataFrame:
    """The best row of the first tier that has any."""
    tier = F.coalesce(*(F.when(t, k) for k, t in enumerate(tiers)), F.lit(len(tiers)))
    return df.withColumn("tier", tier).orderBy("tier", F.desc(score), *[c for c in df.columns if c != score][:1]).limit(1)
