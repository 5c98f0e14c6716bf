"""Line dedup over overlapping three-line windows.

Each window of WINDOW consecutive lines is hashed (two 64-bit hashes, the key of 128 bits), the windows that occur more than once anywhere are found by one
aggregate, which combines before it shuffles, and all but a window's first occurrence, in the order of doc_id, text hash and line, lose their lines; covered
positions of overlapping windows merge, so a line goes once. The join that brings a repeated window back to its occurrences has one row for each window
on one side; a window that a third of all documents share is a skewed key there, which adaptive execution splits.

Native throughout. Texts of fewer than WINDOW lines have no window; windows of blank lines alone don't count. A null text stays null, an
empty one stays empty; rows without an id take no part and pass through; repeated rows (same id and text) count as one occurrence. Other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.llm.common import prepare, row_key, shared_dir, table, unused, written

WINDOW = 3


def line_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, text_key, i (first line, from 0), h1, h2 of every window that isn't blank."""
    lines = docs.filter("doc_id is not null").select(*row_key(), F.split("text", "\n").alias("ls")).filter(F.size("ls") >= size)
    joined = lambda i: F.array_join(F.slice("ls", i + 1, size), "\n")
    each = F.transform(F.sequence(F.lit(0), F.size("ls") - size), lambda i: F.struct(i.alias("i"), F.xxhash64(joined(i)).alias("h1"), F.xxhash64(F.lit(7), joined(i)).alias("h2"), F.length(F.regexp_replace(joined(i), r"\s+", "")).alias("solid")))
    return lines.select("doc_id", "text_key", F.inline(each)).filter("solid > 0").drop("solid")


def repeated_lines(windows: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, text_key, covered (sorted distinct line numbers to remove)."""
    here = F.struct("doc_id", "text_key", "i")
    first = windows.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.max(here).alias("last")).filter("first <> last").drop("last")
    later = windows.join(first, ["h1", "h2"]).filter(here != F.col("first"))
    starts = later.groupBy("doc_id", "text_key").agg(F.collect_set("i").alias("at"))
    return starts.select("doc_id", "text_key", F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + (size - 1)))))).alias("covered"))


def dedup(docs: DataFrame, where: str, size: int = WINDOW) -> DataFrame:
    """docs with text reduced to the lines that stay, and two columns at the end, the numbers of its lines before and of those removed."""
    id_, key, covered, n_lines, n_removed = unused(docs, "id", "key", "covered", "n_lines", "n_removed")
    gone = repeated_lines(written(line_windows(docs.select("doc_id", "text"), size), where, "windows"), size).toDF(id_, key, covered)
    joined = docs.join(gone, (docs["doc_id"] == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(key)), "left")
    lines = F.split("text", "\n")
    numbers = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(covered))
    # an array of one, so that a text is split once and not for each line that stays
    kept = F.get(F.transform(F.array(lines), lambda ls: F.array_join(F.transform(numbers(ls), lambda i: F.get(ls, i)), "\n")), 0)
    text = F.when(F.col(covered).isNull(), F.col("text")).otherwise(kept)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.withColumns({n_lines: n, n_removed: F.coalesce(F.size(covered), F.lit(0)).cast("long"), "text": text}).drop(id_, key, covered)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its lines, how many went, and the sum of what stays."""
    docs = dedup(table(spark, sf_dir, "documents", "doc_id", "text"), shared_dir(spark))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with repeated passages of lines removed; n_chars, where there is such a column, follows. A document that is left without a word (all of it
    stands in earlier ones) goes; one that had none before stays."""
    prepare(spark)
    out = dedup(docs, shared_dir(spark))
    n_lines, n_removed = out.columns[-2:]
    out = out.filter((F.col(n_removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(n_lines, n_removed)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


ORACLE = """
with l as (select doc_id, text, string_split(text, chr(10)) ls from documents),
k as (select doc_id, i, ls[i] a, ls[i + 1] b, ls[i + 2] c from (select doc_id, ls, unnest(range(1, len(ls) - 1)) i from l where len(ls) >= 3 and doc_id is not null)),
r as (select *, row_number() over (partition by a, b, c order by doc_id, i) rn from k where regexp_replace(a || b || c, '\\s+', '', 'g') <> ''),
g as (select distinct doc_id, unnest([i, i + 1, i + 2]) j from r where rn > 1),
n as (select doc_id, count(*) n_removed from g group by doc_id),
e as (select l.doc_id, unnest(ls) line, unnest(range(1, len(ls) + 1)) j from l where doc_id in (select doc_id from n)),
s as (select e.doc_id, string_agg(line, chr(10) order by e.j) kept from e left join g on g.doc_id = e.doc_id and g.j = e.j where g.j is null group by e.doc_id)
select l.doc_id, cast(coalesce(len(ls), 0) as bigint) n_lines, cast(coalesce(n_removed, 0) as bigint) n_removed, sha256(case when n_removed is null then coalesce(text, '') else coalesce(kept, '') end) kept_sha256
from l left join n on n.doc_id = l.doc_id left join s on s.doc_id = l.doc_id
"""
