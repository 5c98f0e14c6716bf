"""Benchmark decontamination by a distributed positional inverted index over the training texts.

Every benchmark item becomes windows of WINDOW words. A posting list holds the places (document, position) of one word; a window's lists are intersected from its
rarest words on, by the counts of the whole corpus (a window with a word that the corpus lacks can't occur):

1. One pass over the texts stores the postings of each window's FIRST rarest words, by document, with the document's number of words.
2. Shifted by a word's offset in its window, a list gives starts where the window may stand; starts in the lists of all FIRST words are candidates.
3. The lists of a window's other words are read for the documents of candidates alone and intersected at start plus offset: what is left are exact phrases.
   For proximity (all of a window's words within its length plus ``slop`` words), step 2 takes places that stand near enough instead of offsets.

Native: split, higher-order functions, joins and aggregates. A bit table made from the rarest words, BITS_PER_TERM bits for each up to 2 ** MOST_BITS, keeps other words'
postings from being made; false positives go in the join. The benchmark's sides are broadcast after a count shows that they are small and shuffled otherwise.

Nulls: a null text has no words; a null item_id is no item; documents without an id are matched like others. Rows with equal id and
text get equal results, each its own row; those with equal ids and different texts are kept apart. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.llm.common import lower_ascii, prepare, shared_dir, small_side, table, unused, written

WINDOW, MIN_ITEMS, FIRST = 8, 2, 2
BITS_PER_TERM, LEAST_BITS, MOST_BITS = 64, 12, 22
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(column: str = "text") -> Column:
    """The words of a text, [] for null."""
    found = F.filter(F.split(lower_ascii(F.col(column)), SEPARATORS), lambda x: x != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def row_key(column: str = "doc_id") -> list[Column]:
    """doc_key, text_key: equal for rows with equal id, null included, and text; never null themselves where there is a text."""
    return [F.coalesce(F.concat(F.lit("i"), F.col(column).cast("string")), F.lit("n")).alias("doc_key"), F.xxhash64("text").alias("text_key")]


DOC = ["doc_key", "text_key"]


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """Distinct windows of items (item_id, text): gram (words), gram_id, items (sorted texts of ids)."""
    w = items.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words().alias("w")).filter(F.size("w") > 0)
    grams = F.when(F.size("w") <= length, F.array("w")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (length - 1), F.lit(1))), lambda i: F.slice("w", i, length)))
    return w.select("item", F.explode(grams).alias("gram")).groupBy("gram").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("gram_id", F.monotonically_increasing_id())


def ranked(grams: DataFrame, docs: DataFrame) -> DataFrame:
    """gram_id, n (words of the gram), term, place, rank (from 0) of the FIRST rarest words of each gram; grams with a word that docs lack are left out."""
    terms = small_side(grams.select(F.explode("gram").alias("term")).distinct(), ("term",))
    counts = docs.select(F.explode(words()).alias("term")).join(terms, "term", "left_semi").groupBy("term").count()
    placed = grams.select("gram_id", F.posexplode("gram").alias("place", "term")).join(counts, "term", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "place", "term")))
    listed = placed.groupBy("gram_id").agg(order.alias("o")).filter(F.col("o")[0]["c"] > 0)
    return listed.select("gram_id", F.size("o").alias("n"), F.posexplode(F.slice("o", 1, FIRST)).alias("rank", "r")).select("gram_id", "n", "r.term", "r.place", "rank")


def _bit_table(terms: DataFrame) -> tuple[str, int]:
    """SQL for an array of bits, in longs, with a bit for each term's hash; and how many bits, less one."""
    n = terms.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_TERM * n).bit_length()))
    h = F.xxhash64("term").bitwiseAND(F.lit((1 << bits) - 1))
    rows = terms.select(F.shiftright(h, 6).alias("k"), F.expr("shiftleft(1L, cast(xxhash64(term) & 63 as int))").alias("bit")).groupBy("k").agg(F.bit_or("bit").alias("bits")).collect()  # 2**(MOST_BITS - 6) rows at most
    held = {r["k"]: r["bits"] for r in rows}
    text = ",".join(str(held.get(k, 0)) for k in range(1 << (bits - 6)))
    return f"cast(split('{text}', ',') as array<bigint>)", (1 << bits) - 1  # folded to a constant


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index by document: doc_id, doc_key, text_key, n_words, posts (term, pos) of the terms, and of few others."""
    table_, mask = _bit_table(terms)
    marks = f"transform(transform(w, x -> xxhash64(x)), (h, i) -> if(getbit(get({table_}, cast(shiftright(h & {mask}, 6) as int)), cast(h & 63 as int)) = 1, i, null))"
    at = docs.select("doc_id", *row_key(), words().alias("w")).select("doc_id", *DOC, "w", F.array_compact(F.expr(marks)).alias("at"))
    return at.select("doc_id", *DOC, F.size("w").cast("long").alias("n_words"), F.transform("at", lambda i: F.struct(F.get("w", i).alias("term"), i.alias("pos"))).alias("posts"))


def lists_of(docs: DataFrame, candidates: DataFrame, grams: DataFrame, where: str) -> DataFrame:
    """DOC, term, pos of every word of the candidates' grams in the candidates' documents."""
    chosen = small_side(written(candidates.select(*DOC).distinct(), where, "chosen"), ("doc_key",))  # else every text would be shuffled
    terms = small_side(grams.join(candidates.select("gram_id").distinct(), "gram_id", "left_semi").select(F.explode("gram").alias("term")).distinct(), ("term",))
    some = docs.select(*row_key(), "text").join(chosen, DOC, "left_semi")
    return some.dropDuplicates(DOC).select(*DOC, F.posexplode(words()).alias("pos", "term")).join(terms, "term", "left_semi")


def phrase_matches(index: DataFrame, docs: DataFrame, grams: DataFrame, first: DataFrame, where: str) -> DataFrame:
    """Exact occurrences: DOC, start, n (words), gram_id."""
    posts = index.select(*DOC, "n_words", F.inline("posts"))
    starts = posts.join(small_side(first, ("term",)), "term").withColumn("start", F.col("pos") - F.col("place")).filter("start >= 0 and start + n <= n_words")
    both = starts.groupBy(*DOC, "gram_id", "start").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("met"), F.first("n").alias("n"))
    candidates = written(both.filter(F.bit_count("met") == F.least("n", F.lit(FIRST))).select(*DOC, "gram_id", "start", "n"), where, "candidates")
    needs = candidates.join(small_side(grams.select("gram_id", "gram"), ("gram",)), "gram_id").select(*DOC, "gram_id", "start", "n", F.posexplode("gram").alias("place", "term"))
    met = needs.withColumn("pos", F.col("start") + F.col("place")).join(lists_of(docs, candidates, grams, where), [*DOC, "term", "pos"])
    return met.groupBy(*DOC, "gram_id", "start", "n").agg(F.count(F.lit(1)).alias("met")).filter("met = n").drop("met")


def proximity_matches(index: DataFrame, docs: DataFrame, grams: DataFrame, first: DataFrame, where: str, slop: int) -> DataFrame:
    """Places where all words of a window are found within its length plus slop words: DOC, pos (of its rarest word), gram_id."""
    posts = index.select(*DOC, F.inline("posts"))
    near = posts.join(small_side(first, ("term",)), "term").select(*DOC, "gram_id", "n", "rank", "pos")
    reach = F.col("n") + slop
    rarest, second = near.filter("rank = 0").drop("rank"), near.filter("rank = 1").select(*DOC, "gram_id", F.col("pos").alias("other"))
    paired = rarest.join(second, [*DOC, "gram_id"], "left").filter((F.col("n") == 1) | (F.abs(F.col("other") - F.col("pos")) < reach))
    candidates = written(paired.select(*DOC, "gram_id", "n", "pos").distinct(), where, "near")
    lists = lists_of(docs, candidates, grams, where).withColumnRenamed("pos", "at")
    needs = candidates.join(grams.select("gram_id", F.explode(F.array_distinct("gram")).alias("term"), F.size(F.array_distinct("gram")).alias("kinds")), "gram_id")
    held = needs.join(lists, [*DOC, "term"]).filter(F.abs(F.col("at") - F.col("pos")) < reach)
    each = held.groupBy(*DOC, "gram_id", "n", "kinds", "pos").agg(F.collect_set(F.struct("at", "term")).alias("s"))
    within = lambda lo: F.size(F.array_distinct(F.transform(F.filter("s", lambda x: (x["at"] >= lo) & (x["at"] < lo + F.col("n") + slop)), lambda x: x["term"]))) == F.col("kinds")
    return each.filter(F.exists(F.sequence(F.col("pos") - reach + 1, F.col("pos")), within)).select(*DOC, "pos", "gram_id")


def indexed(docs: DataFrame, items: DataFrame, where: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index of docs by document, the windows of items and their rarest words, written."""
    grams = written(windows(items), where, "windows")
    first = written(ranked(grams, docs), where, "first")
    return written(postings(docs, first.select("term").distinct()), where, "index"), grams, first


def near_items(docs: DataFrame, items: DataFrame, where: str, slop: int = 4) -> DataFrame:
    """doc_id, item_ids (sorted) of the documents with proximity matches; a phrase match is one."""
    index, grams, first = indexed(docs, items, where)
    found = proximity_matches(index, docs, grams, first, where, slop).join(grams.select("gram_id", F.explode("items").alias("item")), "gram_id")
    return index.join(found.groupBy(*DOC).agg(F.sort_array(F.collect_set("item")).alias("item_ids")), DOC).select("doc_id", "item_ids")


def hits(docs: DataFrame, items: DataFrame, where: str) -> tuple[DataFrame, DataFrame]:
    """The index of docs by document, a row for each; and DOC, n_hit, item_ids (sorted) of the documents with a match."""
    index, grams, first = indexed(docs, items, where)
    found = phrase_matches(index, docs, grams, first, where).join(small_side(grams.select("gram_id", "items"), ("items",)), "gram_id")
    merged = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["start"] + s["n"]).alias("upto"), (a["n"] + F.greatest(s["start"] + s["n"] - F.greatest(a["upto"], s["start"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    grouped = found.groupBy(*DOC).agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.collect_set("items").alias("sets"))
    return index, grouped.select(*DOC, merged.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("item_ids"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: how many of its words stand in benchmark windows, and of which items."""
    index, found = hits(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), shared_dir(spark))
    n_items = F.coalesce(F.size("item_ids"), F.lit(0))
    return index.select("doc_id", *DOC, "n_words").join(found, DOC, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        n_items.cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "item_ids"), F.lit("")), 256).alias("items_sha256"),
        (n_items >= MIN_ITEMS).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those of which WINDOW words or more stand in benchmark windows: any whole window goes, an item of a word or two alone doesn't."""
    prepare(spark)
    names = unused(docs, *DOC)
    bad = hits(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), shared_dir(spark))[1].filter(F.col("n_hit") >= WINDOW).select(*DOC).toDF(*names)
    doc_key, text_key = row_key()
    return docs.withColumns(dict(zip(names, (doc_key, text_key), strict=True))).join(bad, names, "left_anti").drop(*names)


ORACLE = """
with d as (select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> ''] w from documents),
b as (select cast(item_id as varchar) item, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> ''] w from benchmark where item_id is not null),
g as (select distinct item, least(len(w), 8) n, array_to_string(w[i:i + 7], ' ') gram from (select item, w, unnest(range(1, greatest(len(w) - 6, 2))) i from b where len(w) > 0)),
n as (select distinct n from g),
p as (select doc_id, i - 1 as start, n, array_to_string(w[i:i + n - 1], ' ') gram from (select doc_id, w, n.n n, unnest(range(1, len(w) - n.n + 2)) i from d, n)),
h as (select doc_id, start, p.n, item from p join g on p.gram = g.gram and p.n = g.n),
c as (select doc_id, count(distinct pos) n_hit from (select doc_id, unnest(range(start, start + n)) pos from h) group by doc_id),
s as (select doc_id, count(distinct item) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from d left join c on c.doc_id = d.doc_id left join s on s.doc_id = d.doc_id
"""
