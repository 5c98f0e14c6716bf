"""Topics, their labels and their papers: eligibility, flat rows, lookups by any form of an id, metrics, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.functions.text import ENGLISH_STOPWORDS, id_suffix


def _filled(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def eligible(topics: DataFrame, least: int = 8000) -> DataFrame:
    """Topics (id, works_count, field) of enough works, with an id and a field's name."""
    named = (F.trim("id") != "") & (F.trim("field.display_name") != "")
    return topics.filter(F.coalesce(named & (F.col("works_count") >= least), F.lit(False)))


def ids_by_field(topics: DataFrame) -> DataFrame:
    """field, ids (sorted) of the topics."""
    return topics.groupBy(F.trim("field.display_name").alias("field")).agg(F.array_sort(F.collect_list(F.trim("id"))).alias("ids"))


def flat_topics(topics: DataFrame) -> DataFrame:
    """topic_id, topic_name, field_id, field_name, domain_name; Unknown where there is none."""
    return topics.select(
        F.coalesce(id_suffix(F.col("id")), F.lit("")).alias("topic_id"),
        F.coalesce("display_name", F.lit("Unknown")).alias("topic_name"),
        _filled(id_suffix(F.col("field.id")), "Unknown").alias("field_id"),
        F.coalesce("field.display_name", F.lit("Unknown")).alias("field_name"),
        F.coalesce("domain.display_name", F.lit("Unknown")).alias("domain_name"),
    )


def topic_label(name: Column, bare_id: Column) -> Column:
    """'name (id)'; the id stands for a missing name."""
    return F.concat(F.coalesce(F.nullif(F.trim(name), F.lit("")), bare_id), F.lit(" ("), bare_id, F.lit(")"))


def field_label(name: Column, id_: Column) -> Column:
    """'name (id)', or what there is of them, or ''."""
    name, id_ = F.coalesce(F.trim(name), F.lit("")), F.coalesce(F.trim(id_), F.lit(""))
    return F.when((name != "") & (id_ != ""), F.concat(name, F.lit(" ("), id_suffix(id_), F.lit(")"))).when(name != "", name).otherwise(id_)


def with_topics(df: DataFrame, column: str, topics: DataFrame) -> DataFrame:
    """df, whose column names topics by full URL, URL with slashes at its end or bare id, with topic (a struct, null where no topic matches)."""
    known = topics.withColumn("_bare", id_suffix(F.col("id"))).filter("_bare <> ''").groupBy("_bare").agg(F.min_by(F.struct(*topics.columns), "id").alias("topic"))
    return df.withColumn("_bare", id_suffix(F.col(column))).join(known, "_bare", "left").drop("_bare")


def with_metrics(labels: DataFrame, metrics: DataFrame) -> DataFrame:
    """Labels by cluster with the clusters' metrics, null where there are none."""
    return labels.join(metrics, "cluster", "left")


def confident(labels: DataFrame, column: str = "confidence") -> DataFrame:
    return labels.filter(F.coalesce(F.lower(column) == "high", F.lit(False)))


def best(df: DataFrame, score: str, key: str) -> DataFrame:
    """The row of the largest score; of ties that of the least key."""
    return df.filter(F.col(score).isNotNull()).orderBy(F.desc(score), key).limit(1)


def verified(papers: DataFrame, audits: DataFrame) -> DataFrame:
    """The papers (id) whose audit (id, pass, ...) passed, with its other columns."""
    return papers.join(audits.filter("`pass`").drop("pass"), "id")


def labelled_papers(papers: DataFrame, labels: DataFrame) -> DataFrame:
    """Papers (folder, topic_name, ...) with the labels of their folder (folder, umbrella, label): field and topic; folders without labels or any topic's name are left out."""
    named = labels.select("folder", F.col("umbrella").alias("_u"), F.col("label").alias("_l"))
    topic = F.coalesce(F.nullif("_l", F.lit("")), F.nullif("topic_name", F.lit("")))
    joined = papers.join(named, "folder").withColumns({"field": F.coalesce(F.nullif("_u", F.lit("")), "folder"), "topic": topic})
    return joined.filter("topic is not null").drop("_u", "_l", "topic_name")


def preview(df: DataFrame, key: str, n: int = 15, seed: int = 42) -> DataFrame:
    """n rows, the same for a seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def stopwords(*extra: str) -> list[str]:
    """The English stop-words and others, each once, sorted."""
    return sorted({*ENGLISH_STOPWORDS, *(x.strip().lower() for x in extra if x.strip())})
