"""Bibliographic records: abstracts from inverted indexes and the flat row of a work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.functions.text import pipe_joined

WORK = """id string, title string, type string, language string, abstract_inverted_index map<string, array<int>>, publication_year int, cited_by_count bigint,
primary_location struct<raw_source_name: string, source: struct<display_name: string, type: string>>,
authorships array<struct<author: struct<display_name: string>, countries: array<string>, institutions: array<struct<display_name: string, country_code: string>>>>,
institutions_distinct_count int, countries_distinct_count int, citation_normalized_percentile struct<value: double>, open_access struct<is_oa: boolean, oa_status: string>"""


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c as a variable: c is computed once a row, however often f names it."""
    return F.get(F.transform(F.array(c), f), 0)


def inverted_index(text: Column) -> Column:
    """The inverted index of a text of words between single blanks: each word's places, from 0. Built within the row: words sorted with their places, then cut where the word changes."""

    def of(s: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.array_size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]))
        run = lambda a, b: F.struct(F.get(s, a)["w"].alias("w"), F.transform(F.slice(s, a + 1, b - a), lambda x: x["at"]).alias("at"))
        return bound(firsts, lambda f: F.map_from_entries(F.transform(f, lambda a, k: run(a, F.coalesce(F.get(f, k + 1), F.array_size(s))))))

    return bound(F.sort_array(F.transform(F.split(text, " "), lambda w, i: F.struct(w.alias("w"), i.alias("at")))), of)


def abstract_text(index: Column, collisions: bool = True) -> Column:
    """The text of an inverted index. collisions: of several words on one position the last stands, positions below 0 don't count; otherwise all words stand."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.filter(e["value"], lambda p: p >= 0), lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    numbered = F.transform(pairs, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"), x["w"].alias("w")))

    def of(ordered: Column) -> Column:
        if not collisions:
            return F.array_join(F.transform(ordered, lambda x: x["w"]), " ")
        following = lambda i: F.get(ordered, i + 1)["p"]
        kept = F.filter(ordered, lambda x, i: following(i).isNull() | (following(i) != x["p"]))
        return F.array_join(F.transform(kept, lambda x: x["w"]), " ")

    return bound(bound(F.sort_array(numbered), of), lambda text: F.when(F.trim(text) != "", text))


def venue(location: Column) -> Column:
    return F.coalesce(F.nullif(location["raw_source_name"], F.lit("")), F.nullif(location["source"]["display_name"], F.lit("")), F.lit(""))


def authors(a: Column) -> Column:
    return pipe_joined(F.transform(a, lambda x: x["author"]["display_name"]))


def institutions(a: Column) -> Column:
    return pipe_joined(F.flatten(F.transform(a, lambda x: F.transform(F.coalesce(x["institutions"], F.array()), lambda i: i["display_name"]))))


def countries(a: Column) -> Column:
    """Countries of each authorship, then those of its institutions."""
    each = F.transform(a, lambda x: F.concat(F.coalesce(x["countries"], F.array().cast("array<string>")), F.transform(F.coalesce(x["institutions"], F.array()), lambda i: i["country_code"])))
    return pipe_joined(F.flatten(each))


def work_rows(works: DataFrame) -> DataFrame:
    """The flat table of works: 18 columns in a fixed order; field and topic come from works where it has them."""
    a = F.coalesce(F.col("authorships"), F.array().cast(works.schema["authorships"].dataType))
    distinct = lambda x: F.size(F.array_distinct(F.filter(F.flatten(x), lambda v: v.isNotNull() & (v != ""))))
    inst = distinct(F.transform(a, lambda x: F.transform(F.coalesce(x["institutions"], F.array()), lambda i: i["display_name"])))
    ctry = distinct(F.transform(a, lambda x: F.coalesce(x["countries"], F.array().cast("array<string>"))))
    have = lambda n: F.col(n) if n in works.columns else F.lit("")
    return works.select(
        have("field").alias("field"), have("topic").alias("topic"), "id", "title", abstract_text(F.col("abstract_inverted_index")).alias("abstract"), authors(a).alias("authors"), "publication_year",
        venue(F.col("primary_location")).alias("venue"), F.col("type").alias("paper_type"), F.trim(F.coalesce("primary_location.source.type", F.lit(""))).alias("venue_type"),
        institutions(a).alias("institutions"), countries(a).alias("countries"), F.coalesce("open_access.oa_status", F.lit("")).alias("open_access_status"), F.size(a).alias("author_count"),
        F.coalesce("institutions_distinct_count", inst).alias("institution_count"), F.coalesce("countries_distinct_count", ctry).alias("country_count"), F.col("cited_by_count").alias("citation_count"), F.coalesce(F.col("citation_normalized_percentile.value").cast("string"), F.lit("")).alias("citation_percentile"),
    )
