"""Clusters of vectors: centroids, coherence, distinctiveness, scores, representatives, merging, diverse order, and class-based TF-IDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexlake.functions.vectors import cosine, dot, normalised
from codexlake.operators.terms import frequent_grams


def centroids(df: DataFrame) -> DataFrame:
    """cluster, centroid (normalised), mean, n from df (cluster, vector); noise, -1, is left out."""
    mean = df.filter("cluster <> -1").select("cluster", F.posexplode("vector").alias("at", "x")).groupBy("cluster", "at").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    whole = mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"), F.max("n").alias("n"))
    return whole.select("cluster", normalised(F.col("v"), 1e-12).alias("centroid"), F.col("v").alias("mean"), "n")


def coherence(df: DataFrame, c: DataFrame) -> DataFrame:
    """cluster, coherence: the members' mean cosine with their centroid. Centroids are one row a cluster; Spark broadcasts them if they are small."""
    return df.join(c.select("cluster", "centroid"), "cluster").groupBy("cluster").agg(F.avg(cosine(F.col("vector"), F.col("centroid"))).alias("coherence"))


#: Clusters whose centroids are compared pair by pair, at most.
MANY = 10_000


def sibling_similarities(c: DataFrame) -> DataFrame:
    """cluster, other, similarity of all pairs of centroids: the square of a number of clusters, which can't be over MANY (the query fails then)."""
    size = c.agg(F.assert_true(F.count(F.lit(1)) <= MANY, F.lit("too many clusters to compare all pairs")).alias("_ok"))
    c = c.join(F.broadcast(size), F.col("_ok").isNull()).drop("_ok")  # one row
    a, b = c.select("cluster", "centroid"), c.select(F.col("cluster").alias("other"), F.col("centroid").alias("of_other"))
    return a.join(b, F.col("cluster") != F.col("other")).select("cluster", "other", dot(F.col("centroid"), F.col("of_other")).alias("similarity"))


def distinctiveness(c: DataFrame, k: int = 1) -> DataFrame:
    """cluster, distinctiveness: 1 less the mean of the k largest similarities with other clusters; 1 where there is no other."""
    ranked = sibling_similarities(c).withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("similarity"), "other"))).filter(F.col("r") <= k)
    near = ranked.groupBy("cluster").agg(F.avg("similarity").alias("near"))
    return c.join(near, "cluster", "left").select("cluster", F.coalesce(1 - F.col("near"), F.lit(1.0)).alias("distinctiveness"))


def scores(df: DataFrame, cap: int = 2000, k: int = 1) -> DataFrame:
    """cluster, n, coherence, distinctiveness, score."""
    c = centroids(df)
    size = F.sqrt(F.least("n", F.lit(cap)) / cap)
    return c.join(coherence(df, c), "cluster").join(distinctiveness(c, k), "cluster").select("cluster", "n", "coherence", "distinctiveness", (F.col("coherence") * F.col("distinctiveness") * size).alias("score"))


def representatives(df: DataFrame, k: int = 5) -> DataFrame:
    """The k members of each cluster nearest its centroid: cluster, id, similarity, rank."""
    near = df.join(centroids(df).select("cluster", "centroid"), "cluster").withColumn("similarity", cosine(F.col("vector"), F.col("centroid")))
    return near.withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("similarity"), "id"))).filter(F.col("rank") <= k).select("cluster", "id", "similarity", "rank")


def diverse_order(df: DataFrame, weight: float = 0.7, block: int = 4096) -> DataFrame:
    """cluster, id, rank: all members of each cluster by maximal marginal relevance.

    Sequential by nature: a cluster is one task, which holds its vectors once and their largest similarity with the chosen ones, and takes the square
    of the cluster's size in time. Vectors are compared in blocks of ``block``; chosen ones leave as they become half. A zero vector is similar to nothing."""
    near = df.join(centroids(df).select("cluster", "centroid"), "cluster").withColumn("relevance", F.coalesce(cosine(F.col("vector"), F.col("centroid")), F.lit(0.0)))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["relevance", "id"], ascending=[False, True])
        v = np.empty((len(pdf), len(pdf["vector"].iloc[0])))
        for k, x in enumerate(pdf.pop("vector")):
            v[k] = x
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        rel, most, at = pdf["relevance"].to_numpy(), np.full(len(pdf), -np.inf), np.arange(len(pdf))
        left, chosen = np.ones(len(pdf), dtype=bool), []
        for k in range(len(pdf)):
            value = np.where(left, rel if k == 0 else weight * rel - (1 - weight) * most, -np.inf)
            i = int(np.argmax(value))
            chosen.append(at[i])
            left[i] = False
            last = v[i].copy()
            for b in range(0, len(v), block):
                np.maximum(most[b : b + block], v[b : b + block] @ last, out=most[b : b + block])
            if 2 * (len(pdf) - k - 1) < len(v):
                v, rel, most, at, left = v[left], rel[left], most[left], at[left], left[left]
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[0], "id": pdf["id"].to_numpy()[chosen], "rank": np.arange(1, len(pdf) + 1)})

    return near.select("cluster", "id", "vector", "relevance").groupBy("cluster").applyInPandas(order, "cluster int, id long, rank int")


def merged_clusters(c: DataFrame, least: float = 0.9, target: int = 1) -> DataFrame:
    """cluster, merged: the pair of clusters whose means (cluster, mean, n) have the largest cosine merges, again and again, down to ``target`` or to similarities under ``least``;
    the mean of a merged one is that of all its members.

    Sequential by nature; it works on one row for each cluster and refuses more than MANY."""
    rows = c.select("cluster", "mean", "n").orderBy("cluster").limit(MANY + 1).collect()
    if len(rows) > MANY:
        raise ValueError(f"merging is meant for at most {MANY} clusters")
    v, n = [np.array(r["mean"]) for r in rows], [r["n"] for r in rows]
    of, live = list(range(len(rows))), list(range(len(rows)))
    while len(live) > target:
        m = np.stack([v[i] / max(np.linalg.norm(v[i]), 1e-300) for i in live])
        s = m @ m.T
        np.fill_diagonal(s, -np.inf)
        a, b = divmod(int(np.argmax(s)), len(live))
        if s[a, b] < least:
            break
        i, j = live[min(a, b)], live[max(a, b)]
        v[i], n[i] = (v[i] * n[i] + v[j] * n[j]) / (n[i] + n[j]), n[i] + n[j]
        of = [i if x == j else x for x in of]
        live.remove(j)
    number = {i: k for k, i in enumerate(live)}
    return c.sparkSession.createDataFrame([(int(r["cluster"]), number[of[k]]) for k, r in enumerate(rows)], "cluster int, merged int")


def class_tfidf(df: DataFrame, stopwords: list[str], low: int = 2, high: int = 4, least: int = 3, most: float = 0.35, top: int = 10, features: int = 100_000) -> DataFrame:
    """cluster, term, n, weight, rank of the top terms from df (cluster, text): all texts of a cluster are one document.

    least, most: in how many clusters, and in which part of them at most, a term must occur; of those, the ``features`` most frequent count. A count by packed hashes
    leaves out n-grams that can't be among them before n-grams are shuffled; a term then has one entry a cluster."""
    terms = frequent_grams(df.select("cluster", "text"), stopwords, low, high, least, most, features).groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"))
    by_term = terms.groupBy("term").agg(F.collect_list(F.struct("cluster", "n")).alias("each"), F.sum("n").alias("total"))
    clusters = df.agg(F.count_distinct("cluster").alias("clusters"))  # one row
    kept = by_term.withColumn("df", F.size("each")).filter(F.col("df") >= least).crossJoin(F.broadcast(clusters)).filter(F.col("df") <= most * F.col("clusters"))
    counted = kept.orderBy(F.desc("total"), "term").limit(features).select("term", "df", "clusters", F.inline("each"))
    w = W.partitionBy("cluster")  # at most ``features`` rows
    tf = F.col("n") / (F.sum("n").over(w) + 1e-12)
    weighed = counted.withColumn("weight", F.round(tf * (F.log((F.col("clusters") + 1) / (F.col("df") + 1)) + 1), 9))
    ranked = weighed.withColumn("rank", F.row_number().over(w.orderBy(F.desc("weight"), "term")))
    return ranked.filter(F.col("rank") <= top).select("cluster", "term", "n", "weight", "rank")
