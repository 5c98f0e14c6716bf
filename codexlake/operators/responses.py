"""Prompts and answers of language models: assembly, citations, verdicts and scores; the model itself is a function over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StringType, StructType

VERDICT = "match boolean, eng boolean, clean boolean, explanation string, reason string"


def with_column(schema: StructType, name: str, kind: DataType) -> StructType:
    """A schema with a column at its end, or itself if it has it."""
    return schema if name in schema.names else StructType([*schema.fields]).add(name, kind)


def prompt(df: DataFrame, group: str, rank: str, features: list[str], head: str = "", definitions: dict[str, str] | None = None) -> DataFrame:
    """group, prompt: a line for each feature of each document, in the order of rank, after definitions of the features."""
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in features))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, lines.alias("t")))), lambda x: x["t"]), "\n\n")
    known = "\n".join(f"{k}: {v}" for k, v in (definitions or {}).items() if k in features)
    return df.groupBy(group).agg(F.concat_ws("\n\n", *(F.lit(x) for x in (head, known) if x), body).alias("prompt"))


def citations(answer: Column) -> Column:
    """The list in the first json fence, [] if there is none or it is no list of texts."""
    fence = F.regexp_extract(answer, r"(?s)```json\s*(.*?)```", 1)
    return F.coalesce(F.from_json(fence, "array<string>"), F.array().cast("array<string>"))


def without_fences(answer: Column) -> Column:
    return F.trim(F.regexp_replace(answer, r"(?s)```json.*?```", ""))


def topic_fence(answer: Column) -> Column:
    """The record of a json_topic fence, or null."""
    return F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)```json_topic\s*(.*?)```", 1), F.lit("")), "topic_name string, description string, keywords array<string>, confidence string")


def verdict(answer: Column) -> Column:
    """match, eng, clean, pass, explanation: from JSON, else a fence, else the first braces, else from what stands in the text."""
    raw = F.trim(answer)
    lower = F.lower(raw)
    braces = F.regexp_extract(raw, r"(?s)(\{.*?\})", 1)
    fence = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?is)```json(?:_topic)?\s*\n(.*?)\n```", 1), F.lit("")), F.regexp_extract(raw, r"(?s)```\s*\n(.*?)\n```", 1))
    usable = lambda x: F.when(F.trim(x).startswith("{") & F.get_json_object(x, "$").isNotNull(), F.from_json(x, "match string, eng string, clean string, explanation string, reason string"))
    found = F.coalesce(usable(raw), usable(fence), usable(braces))
    truthy = lambda x: F.coalesce((x != "") & ~F.lower(x).isin("false", "0", "null", "[]", "{}"), F.lit(False))
    flag = lambda k: F.when(found.isNotNull(), truthy(found[k])).otherwise(lower.contains(f'"{k}": true') | lower.contains(f'"{k}":true'))
    said = F.coalesce(F.nullif(found["explanation"], F.lit("")), F.nullif(found["reason"], F.lit("")))
    rest = F.concat(F.lit("[NLP Fallback] "), F.substring(F.trim(F.translate(F.regexp_replace(raw, "[{}\"']", ""), "\n", " ")), 1, 150), F.lit("..."))
    guess = F.coalesce(F.nullif(F.regexp_extract(raw, "(?i)[\"']explanation[\"']\\s*:\\s*[\"'](.*?)[\"']", 1), F.lit("")), rest)
    explanation = F.when(found.isNotNull(), F.coalesce(said, F.lit("Parsed."))).otherwise(guess)
    return F.struct(flag("match").alias("match"), flag("eng").alias("eng"), flag("clean").alias("clean"), (flag("match") & flag("eng") & flag("clean")).alias("pass"), explanation.alias("explanation"))


def related_score(answer: Column) -> Column:
    """The score in the outermost braces; without one that parses, 10 if the text speaks of redirects or html and else 50."""
    braces = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    score = F.when(F.get_json_object(braces, "$").isNotNull(), F.coalesce(F.get_json_object(braces, "$.related_score").try_cast("double").cast("int"), F.lit(0)))
    low = F.lower(answer).contains("redirect") | F.lower(answer).contains("html")
    return F.coalesce(score, F.when(low, 10).otherwise(50))


def asked(df: DataFrame, column: str, model: Callable[[list[str]], list[str]], name: str = "answer") -> DataFrame:
    """df with a model's answers to a column of prompts, a batch at a time; the model is loaded once in each worker if it is a class instance that loads lazily."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: model(pdf[column].tolist())})

    return df.mapInPandas(run, with_column(df.schema, name, StringType()))


#: Fixed text: what a labelling prompt adds when the answer had no topic fence.
REPAIR = "\n\nIMPORTANT: Your previous answer did not follow the required output format. Return exactly a json_topic fence with topic_name, description, keywords and confidence, and a json fence with []."


def template(text: str, **values: str) -> str:
    """A stripped prompt template with its {names} filled in; a missing one raises."""
    return text.strip().format(**values)


def labelled(df: DataFrame, column: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """df with label (topic_name, description, keywords, confidence) and raw_output from a model's answers to a column of prompts. Answers without a topic fence are asked for once more
    with REPAIR; what fails twice has an empty label of low confidence and its first answer."""
    first = asked(df, column, model, "_first").withColumn("_again", F.concat(column, F.lit(REPAIR)))

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = pdf["_first"].copy()
            todo = ~answers.fillna("").str.contains("```json_topic", regex=False)
            if todo.any():
                answers[todo] = model(pdf.loc[todo, "_again"].tolist())
            yield pdf.assign(_second=answers)

    both = first.mapInPandas(repair, with_column(first.schema, "_second", StringType()))
    found = F.coalesce(topic_fence(F.col("_first")), topic_fence(F.col("_second")))
    label = F.struct(
        F.coalesce(found["topic_name"], F.lit("")).alias("topic_name"),
        F.coalesce(found["description"], F.lit("")).alias("description"),
        F.coalesce(found["keywords"], F.array().cast("array<string>")).alias("keywords"),
        F.when(found.isNull(), "low").otherwise(F.coalesce(found["confidence"], F.lit("medium"))).alias("confidence"),
    )
    return both.withColumn("label", label).withColumn("raw_output", F.when(found.isNull(), F.col("_first"))).drop("_first", "_second", "_again")


def with_tries(model: Callable[[list[str]], list[str]], tries: int = 3) -> Callable[[list[str]], list[str]]:
    """A model that is asked again when it fails; after ``tries`` failures its answers are empty."""

    def call(prompts: list[str]) -> list[str]:
        for _ in range(tries):
            try:
                return model(prompts)
            except Exception:  # a backend's failure of any kind
                continue
        return [""] * len(prompts)

    return call


def embedded(df: DataFrame, column: str, encoder: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """df with vector, from an encoder that is given ``batch`` texts at a time; null texts have null vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            have = pdf[column].notna()
            texts, out = pdf.loc[have, column].tolist(), []
            for k in range(0, len(texts), batch):
                out += encoder(texts[k : k + batch])
            vectors = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            vectors[have] = pd.Series(out, index=pdf.index[have], dtype=object)
            yield pdf.assign(vector=vectors)

    return df.mapInPandas(run, with_column(df.schema, "vector", ArrayType(DoubleType())))


def audited(papers: DataFrame, log: DataFrame, budget: int, rank: str = "rank") -> DataFrame:
    """The papers up to a rank that the log (id) lacks."""
    return papers.filter(F.col(rank) <= budget).join(log.select("id"), "id", "left_anti")


def audit(papers: DataFrame, log: DataFrame, budget: int, column: str, model: Callable[[list[str]], list[str]], tries: int = 3, rank: str = "rank") -> DataFrame:
    """The papers up to a rank that the log (id) lacks, with the verdicts of a model on a column of prompts; a model that fails ``tries`` times passes nothing."""
    asked_ = asked(audited(papers, log, budget, rank), column, with_tries(model, tries), "_answer")
    return asked_.withColumn("verdict", verdict(F.col("_answer"))).drop("_answer")
