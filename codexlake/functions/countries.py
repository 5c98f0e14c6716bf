"""Country codes to names."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def iso_names(spark: SparkSession) -> dict[str, str]:
    """English names by two-letter code, as the JVM knows them; a caller may pass any other table of names."""
    locale = spark.sparkContext._jvm.java.util.Locale
    return {code: locale("", code).getDisplayCountry(locale.ENGLISH) for code in locale.getISOCountries()}


def plain_order(name: str) -> str:
    """'B, A' as 'A B'."""
    first, *rest = [x.strip() for x in name.split(",")]
    return " ".join([*rest, first])


def country_names(c: Column, names: dict[str, str]) -> Column:
    """A list of codes in a cell as ordered distinct names, ", " between; unknown codes stay, nothing left is nan."""
    known = F.create_map(*(F.lit(x) for code, name in names.items() for x in (code, plain_order(name))))
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    found = F.array_join(F.array_distinct(F.transform(parts, lambda x: F.coalesce(F.try_element_at(known, x), x))), ", ")
    return F.when(c.isNull() | (F.lower(c) == "nan") | (found == ""), "nan").otherwise(found)
