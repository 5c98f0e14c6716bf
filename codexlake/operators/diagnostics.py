"""Reports over a corpus: duplicate groups, counters, rates and the Markdown that shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.functions import text as T
from codexlake.operators.filters import SCANNED_TYPES


def duplicate_groups(df: DataFrame, key: Column, column: Column) -> DataFrame:
    """group (hash), n, keys (sorted) of texts that are equal but for case and white space."""
    norm = F.md5(F.lower(T.collapsed(column)))
    keyed = df.filter(column.isNotNull()).select(norm.alias("group"), key.alias("key"))
    repeated = keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")  # before keys are collected
    return keyed.join(repeated, "group").groupBy("group", "n").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def topic_counts(works: DataFrame, topic: str, is_open: Column, status: Column, threshold: int = 10_000) -> DataFrame:
    """topic, n, open, diamond and whether each passes a threshold, in one pass."""
    counts = works.groupBy(topic).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_open).alias("open"), F.count_if(status == "diamond").alias("diamond"))
    return counts.withColumns({"pass_any": F.col("n") > threshold, "pass_diamond": F.col("diamond") > threshold})


def field_summary(counts: DataFrame, field: str) -> DataFrame:
    """field, topics, pass_any, pass_diamond from topic_counts with a field."""
    return counts.groupBy(field).agg(F.count(F.lit(1)).alias("topics"), F.count_if("pass_any").alias("pass_any"), F.count_if("pass_diamond").alias("pass_diamond"))


def category_means(df: DataFrame, category: str, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """value, n in the order of numbers if all values are numbers, else of texts; place says where in it."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    numeric = counts.agg(F.bool_and(F.expr("try_cast(value as double) is not null")).alias("numeric"))
    order = F.struct(F.when(F.col("numeric"), F.expr("try_cast(value as double)")), F.col("value"))
    rows = counts.crossJoin(F.broadcast(numeric)).withColumn("o", order)  # numeric is one row
    places = rows.agg(F.transform(F.array_sort(F.collect_list("o")), lambda x: x["value"]).alias("order"))  # one entry a distinct value, as in the report
    return rows.crossJoin(F.broadcast(places)).select("value", "n", F.array_position("order", F.col("value")).cast("int").alias("place"))


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two reports' rows of one key side by side: a's columns and b's others."""
    return a.join(b.select(key, *[c for c in b.columns if c not in a.columns]), key)


def language_diagnostics(df: DataFrame, title: Column, abstract: Column) -> DataFrame:
    """total, title_pass, abstract_pass, both_pass and their percentages; title and abstract are flags."""
    t, a = F.coalesce(title, F.lit(False)), F.coalesce(abstract, F.lit(False))
    c = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(t).alias("title_pass"), F.count_if(a).alias("abstract_pass"), F.count_if(t & a).alias("both_pass"))
    return c.select("*", *(F.try_divide(F.col(k) * 100.0, "total").alias(f"{k}_rate") for k in ("title_pass", "abstract_pass", "both_pass")))


def failures(df: DataFrame, passed: Column, key: str, n: int = 10) -> DataFrame:
    """The first n rows that fail."""
    return df.filter(~F.coalesce(passed, F.lit(False))).orderBy(key).limit(n)


def corpus_diagnostics(df: DataFrame, abstract: Column, noisy: Column, foreign: Column, missing: Column, kind: Column) -> DataFrame:
    """scanned, duplicate_groups, noisy, foreign, missing, unexpected_type; flags are columns of df, groups are those of equal abstracts."""
    groups = df.filter(abstract.isNotNull()).groupBy(F.md5(F.lower(T.collapsed(abstract)))).count().filter("count > 1").agg(F.count(F.lit(1)).alias("duplicate_groups"))
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    totals = df.agg(F.count(F.lit(1)).alias("scanned"), count(noisy, "noisy"), count(foreign, "foreign"), count(missing, "missing"), count(~F.coalesce(kind.isin(SCANNED_TYPES), F.lit(False)), "unexpected_type"))
    return totals.crossJoin(groups)  # two single rows


def scanned(df: DataFrame, title: Column, abstract: Column, similarity: Column, threshold: float = 0.5) -> DataFrame:
    """df with heuristic_reason, similarity_score and classification: an empty title or abstract and paywall remains are garbage by heuristics, then low similarity by meaning."""
    empty = F.coalesce((title == "") | (abstract == ""), F.lit(True))
    reason = F.when(empty, "Empty Title or Abstract").otherwise(T.paywall_reason(abstract))
    score = F.when(empty, 0.0).otherwise(F.coalesce(similarity, F.lit(0.0)))
    out = df.withColumns({"heuristic_reason": reason, "similarity_score": score})
    return out.withColumn("classification", F.when(F.col("heuristic_reason") != "Passed", "HEURISTIC").when(F.col("similarity_score") < threshold, "SEMANTIC").otherwise("CLEAN"))


def scan_summary(df: DataFrame) -> DataFrame:
    """total, heuristic, semantic, garbage and their percentages of scanned rows."""
    of = lambda *k: F.count_if(F.col("classification").isin(*k))
    c = df.agg(F.count(F.lit(1)).alias("total"), of("HEURISTIC").alias("heuristic"), of("SEMANTIC").alias("semantic"), of("HEURISTIC", "SEMANTIC").alias("garbage"))
    return c.select("*", *(F.try_divide(F.col(k) * 100.0, "total").alias(f"{k}_rate") for k in ("heuristic", "semantic", "garbage")))


def markdown(report: DataFrame, title: str) -> str:
    """A report of few rows as a Markdown table under a heading."""
    rows = report.limit(1000).collect()
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(report.columns) + " |", "|" + " --- |" * len(report.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"
