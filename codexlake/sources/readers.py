"""Readers and writers of the artefacts: catalogues, works, tolerant tables, partitioned folders, results, caches."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codexlake.functions.nested import WORK, abstract_text
from codexlake.functions.text import id_suffix

TOPIC = "id string, display_name string, description string, works_count bigint, field struct<id: string, display_name: string>, domain struct<display_name: string>"


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def topics(spark: SparkSession, path: str) -> DataFrame:
    return json_documents(spark, path, TOPIC)


def works(spark: SparkSession, path: str) -> DataFrame:
    return json_documents(spark, path, WORK)


def tolerant_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed lines are skipped."""
    return spark.read.schema(schema).options(header=True, mode="DROPMALFORMED", multiLine=True, escape='"').csv(path)


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(path)


def tsv_with(spark: SparkSession, path: str, **columns: str) -> DataFrame:
    """Columns by their names in the header, of the given types; a missing one raises, lines that don't parse are skipped."""
    df = spark.read.options(header=True, sep="\t").csv(path)
    if lost := set(columns) - set(df.columns):
        raise ValueError(f"{path}: no column {', '.join(sorted(lost))}")
    out = df.select(*(F.col(k).try_cast(v).alias(k) for k, v in columns.items()))
    return out.dropna(subset=list(columns))


def keyed_folders(spark: SparkSession, pattern: str, schema: str, key: str = "folder") -> DataFrame:
    """JSON files one folder below a path, with the folder's name as a column."""
    return json_documents(spark, pattern, schema).withColumn(key, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Metadata, Description, trimmed, blank ones left out."""
    df = typed_csv(spark, path, "Metadata string, Description string")
    return df.select(F.trim("Metadata").alias("Metadata"), F.trim("Description").alias("Description")).filter("Metadata <> '' and Description <> ''")


def result_name(prompt: str, topic: str, bias: str | None = None) -> str:
    clean = lambda x: x.replace("/", "_").replace(":", "_").replace(" ", "-")
    return "_".join(clean(x) for x in (prompt, topic, bias) if x) + ".json"


def results(spark: SparkSession, folder: str, prompt: str, topic: str, bias: str | None = None) -> DataFrame:
    """Runs of an experiment; Spark raises if there is no such file."""
    return json_documents(spark, f"{folder}/{result_name(prompt, topic, bias)}", "iteration int, order array<string>, answer string, citations array<string>")


def wanted_works(works: DataFrame, ids: DataFrame) -> DataFrame:
    """The works of ids (id, bare or a URL), with abstract."""
    want = ids.select(id_suffix(F.col("id")).alias("_id")).distinct()
    return works.withColumn("_id", id_suffix(F.col("id"))).join(want, "_id", "left_semi").drop("_id").withColumn("abstract", abstract_text(F.col("abstract_inverted_index")))


def one_work(works: DataFrame, id_: str) -> DataFrame:
    """The work with an id, as a JSON document."""
    return works.filter(id_suffix(F.col("id")) == id_.rstrip("/").rpartition("/")[2]).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def first_works(works: DataFrame, n: int, **equal: str | bool) -> DataFrame:
    """The first n works, by id, whose columns (nested ones with __ for the dot) have these values; filters reach the scan."""
    for name, value in equal.items():
        works = works.filter(F.col(name.replace("__", ".")) == value)
    return works.orderBy("id").limit(n)


def with_retries(call: Callable[[], tuple[int, Any]], tries: int = 6, wait: Callable[[float], None] = time.sleep) -> Any:
    """The body of a call that gives (status, body), tried again with growing waits on 429 and 5xx; other failures raise."""
    for k in range(tries):
        status, body = call()
        if status < 400:
            return body
        if status != 429 and status < 500:
            raise RuntimeError(f"status {status}")
        wait(min(60, 2**k) + random.random())
    raise RuntimeError(f"no answer after {tries} tries")


class PagedReader(DataSourceReader):
    """A partition for each seed; pages follow cursors until there is none. Equalities of top-level columns named in the option ``pushed`` become filters of the request."""

    def __init__(self, schema, options: dict) -> None:
        self.names, self.options, self.filters = schema.names, options, {}

    def pushFilters(self, filters: list) -> Iterator:
        from pyspark.sql.datasource import EqualTo

        allowed = self.options.get("pushed", "").split(",")
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in allowed:
                self.filters[f.attribute[0]] = str(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.options.get("seeds", "0").split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, name = self.options["client"].partition(":")
        fetch, cursor = getattr(importlib.import_module(module), name), "*"
        while cursor:
            page = with_retries(lambda c=cursor: fetch(c, partition.value, {**self.options, **({"filter": ",".join(f"{k}:{v}" for k, v in sorted(self.filters.items()))} if self.filters else {})}))
            for row in page["results"]:
                yield tuple(row.get(n) for n in self.names)
            cursor = page.get("next_cursor")


class PagedSource(DataSource):
    """A REST scan: ``client`` names a function (cursor, seed, options) -> (status, page); a page has results and next_cursor."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, dict(self.options))


def write_csv(df: DataFrame, path: str, *columns: str, bom: bool = False) -> None:
    """bom: each file starts with a byte order mark, before its header."""
    out = df.select(*columns) if columns else df
    out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0]) if bom else out
    out.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_scores(df: DataFrame, path: str) -> None:
    """Tab-separated, doubles with six decimals."""
    cols = [F.format_string("%.6f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").options(header=True, sep="\t").csv(path)


def write_nested(df: DataFrame, path: str, group: list[str], name: str) -> None:
    """A JSON line for each group, its other columns a list of records."""
    rest = [c for c in df.columns if c not in group]
    df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)).write.mode("overwrite").json(path)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame], **parameters: str) -> DataFrame:
    """The table at a path if it was written with these parameters, else computed and written."""
    from pyspark.errors import AnalysisException

    want = {k: str(v) for k, v in parameters.items()}
    try:
        held = {r["k"]: r["v"] for r in spark.read.schema("k string, v string").parquet(f"{path}/parameters").collect()}
        if held == want:
            return spark.read.parquet(f"{path}/rows")
    except AnalysisException:
        pass
    compute().write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame(list(want.items()), "k string, v string").write.mode("overwrite").parquet(f"{path}/parameters")
    return spark.read.parquet(f"{path}/rows")


def overlaid(cache: DataFrame, fresh: DataFrame, *overwritten: str) -> DataFrame:
    """Cached rows by id, with some columns from the fresh ones; fresh rows that the cache lacks follow; columns that a side lacks are null."""
    both = cache.drop(*overwritten).join(fresh.select("id", *overwritten), "id", "inner")
    return both.unionByName(fresh.join(cache.select("id"), "id", "left_anti"), allowMissingColumns=True)
