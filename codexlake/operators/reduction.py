"""Vectors reduced and clustered with pyspark.ml, in place of a manifold reduction and density clusters, whose labels it doesn't reproduce."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOISE = -1


def clustered(df: DataFrame, k: int, dims: int = 10, least: int = 50, seed: int = 42) -> DataFrame:
    """df (id, vector) with cluster: unit vectors, their ``dims`` principal components, k means; clusters of fewer than ``least`` rows are noise, -1. Null vectors are noise too."""
    have = df.filter(F.col("vector").isNotNull()).select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("_raw"))
    unit = Normalizer(inputCol="_raw", outputCol="_unit").transform(have)
    reduced = PCA(k=dims, inputCol="_unit", outputCol="features").fit(unit).transform(unit).select("id", "features")
    found = KMeans(k=k, seed=seed).fit(reduced).transform(reduced).select("id", F.col("prediction").alias("_c"))
    large = found.groupBy("_c").count().filter(F.col("count") >= least).select(F.col("_c").alias("_large"))  # at most k rows
    named = found.join(F.broadcast(large), F.col("_c") == F.col("_large"), "left").select("id", F.coalesce("_large", F.lit(NOISE)).cast("int").alias("cluster"))
    return df.join(named, "id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(NOISE)))


def rotating_runs(papers: DataFrame, group: str, key: str, runs: int, seed: int = 42) -> DataFrame:
    """A row for each run and paper of a group: the papers shuffled once, by md5 of key and seed, and turned by one place more each run: run, place from 0."""
    from pyspark.sql import Window as W

    w = W.partitionBy(group)
    drawn = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    ranked = papers.withColumns({"_rank": F.row_number().over(w.orderBy(drawn, key)) - 1, "_n": F.count(F.lit(1)).over(w)})
    return ranked.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("place", F.pmod(F.col("_rank") - F.col("run"), F.col("_n")).cast("int")).drop("_rank", "_n")
