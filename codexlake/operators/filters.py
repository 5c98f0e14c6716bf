"""The screening cascade: each filter is a flag or a decision column, so that a plan stays one projection over the scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexlake.functions import text as T
from codexlake.functions import vectors as V

#: The types of complete works.
WORK_TYPES = ["article", "book-chapter", "preprint", "dissertation", "book", "review", "report"]
SCANNED_TYPES = ["article", "dissertation", "book-chapter", "preprint", "book"]

#: The texts of reasons; {} stands for a similarity or a threshold.
REASONS = {
    "mismatch": "Semantic Mismatch: Similarity is {} (threshold: {})",
    "match": "Passed vector verification (similarity: {})",
    "language": "Language check failed ({})",
    "matching": "Matching check failed ({})",
    "parse": "LLM json parse error",
    "none": "No reason provided.",
}

Detector = Callable[[Column], Column]


def stopword_detector(c: Column) -> Column:
    """A struct of label and confidence: en by the share of sentences' English stop-words and ASCII; stands in for a model."""
    return F.struct(F.when(T.suspicious_english(c), "other").otherwise("en").alias("label"), F.lit(1.0).alias("confidence"))


def complete(title: Column, abstract: Column, kind: Column, language: Column, least: int = 500) -> Column:
    return F.coalesce(kind.isin(WORK_TYPES) & (language == "en") & (title != "") & (abstract != "") & (F.length(T.combined(title, abstract)) >= least), F.lit(False))


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key in the order."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def english_title(c: Column, threshold: float = 0.5, detector: Detector = stopword_detector) -> Column:
    found = detector(c)
    return F.coalesce((F.trim(c) != "") & (F.length(c) >= 5) & (found["label"] == "en") & (found["confidence"] >= threshold), F.lit(False))


def foreign_share(c: Column, detector: Detector = stopword_detector, least: int = 5) -> Column:
    """The share of a text's sentences of ``least`` characters or more that aren't English; null if there is none."""
    valid = F.filter(T.sentences(c), lambda x: F.length(F.trim(x)) >= least)
    return F.size(F.filter(valid, lambda x: detector(x)["label"] != "en")) / F.nullif(F.size(valid), F.lit(0))


def english_abstract(c: Column, most: float = 0.2, empty_passes: bool = True, detector: Detector = stopword_detector) -> Column:
    return F.coalesce(foreign_share(c, detector) < most, F.lit(empty_passes))


def english_prefixes(c: Column, most: float = 0.2, detector: Detector = stopword_detector, least: int = 5) -> Column:
    """As english_abstract, but the share is tested after every sentence."""
    valid = F.filter(T.sentences(c), lambda x: F.length(F.trim(x)) >= least)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("bad"), F.lit(True).alias("ok"))

    def step(a: Column, x: Column) -> Column:
        n, bad = a["n"] + 1, a["bad"] + (detector(x)["label"] != "en").cast("int")
        return F.struct(n.alias("n"), bad.alias("bad"), (a["ok"] & (bad / n < most)).alias("ok"))

    return F.coalesce(F.aggregate(valid, start, step, lambda a: a["ok"]), F.lit(False))


def every_sentence_english(c: Column, detector: Detector = stopword_detector, threshold: float = 0.5) -> Column:
    return ~F.exists(T.sentences(c), lambda x: (detector(x)["label"] != "en") | (detector(x)["confidence"] < threshold))


def matching(a: Column, b: Column, least: float = 0.5) -> Column:
    """Two vectors agree; null vectors don't."""
    return F.coalesce(V.cosine(a, b) >= least, F.lit(False))


def broken_word_counts(df: DataFrame, key: str, column: str, dictionary: DataFrame) -> DataFrame:
    """key, n: hyphenated words whose joined form the dictionary (word) has and the written form not."""
    found = df.select(key, F.inline(T.broken_words(F.col(column))))
    have = dictionary.select(F.lower("word").alias("word")).distinct()
    joined = found.join(have.withColumnRenamed("word", "joined"), "joined", "left_semi").join(have.withColumnRenamed("word", "whole"), "whole", "left_anti")
    return joined.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def well_formed(df: DataFrame, key: str, column: str, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """df with well_formed: a text without boilerplate, markup, private characters and ``most`` broken words or more."""
    broken = broken_word_counts(df.filter(clean_format(F.col(column))), key, column, dictionary).filter(F.col("n") >= most).select(key, F.lit(True).alias("_broken"))
    return df.join(broken, key, "left").withColumn("well_formed", clean_format(F.col(column)) & F.col("_broken").isNull()).drop("_broken")


def present(df: DataFrame, *columns: str) -> DataFrame:
    """The rows in which no column is null or blank."""
    return df.filter(F.coalesce(F.least(F.lit(True), *(F.trim(F.col(c).cast("string")) != "" for c in columns)), F.lit(False)) & ~F.greatest(F.lit(False), *(F.col(c).isNull() for c in columns)))


def unexpected_type(c: Column) -> Column:
    return ~F.coalesce(c.isin(SCANNED_TYPES), F.lit(False))


def hard_rules(df: DataFrame, title: str, abstract: str, authors: str) -> DataFrame:
    """df with decision and reason: rows with missing metadata, then all rows of the rest whose abstract occurs twice, are rejected."""
    missing = missing_fields(title=F.col(title), abstract=F.col(abstract), authors=F.col(authors))
    marked = df.withColumn("_missing", missing)
    copied = marked.filter(F.size("_missing") == 0).groupBy(F.md5(abstract).alias("_h")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    joined = marked.join(copied, (F.md5(abstract) == F.col("_h")) & (F.size("_missing") == 0), "left")
    rules = [(F.size("_missing") > 0, F.concat(F.lit("missing: "), F.array_join("_missing", ", "))), (F.col("_n").isNotNull(), F.lit("duplicate abstract"))]
    return decided(joined, *rules).drop("_missing", "_h", "_n")


def rule_filter(df: DataFrame, text: Column, similarity: Column, threshold: float = 0.5, detector: Detector = stopword_detector) -> DataFrame:
    """df with decision and audit_reason by language, sentence after sentence, and then by the similarity of title and abstract (null where it is unknown, which passes)."""
    english = english_prefixes(text, detector=detector)
    language = F.when(english, "English detection passed.").otherwise("non-English content detected.")
    low = english & F.coalesce(similarity < threshold, F.lit(False))
    said = lambda reason, *values: F.format_string(REASONS[reason].replace("{}", "%s"), *values)
    shown = F.format_string("%.4f", similarity)
    match = F.when(low, said("mismatch", shown, F.lit(f"{threshold:.2f}"))).when(similarity.isNull() | ~english, "not compared.").otherwise(said("match", shown))
    rejected = F.concat_ws(" | ", F.when(~english, said("language", language)), F.when(low, said("matching", match)))
    return df.withColumns({"decision": F.when(english & ~low, "APPROVED").otherwise("REJECTED"), "audit_reason": F.when(english & ~low, F.concat_ws(" | ", language, match)).otherwise(rejected)})


def model_filter(df: DataFrame, answer: Column) -> DataFrame:
    """df with decision and audit_reason by a model's JSON answer (is_english, is_matching, reason); what is no record is rejected."""
    record = F.when(F.trim(answer).startswith("{"), F.from_json(answer, "is_english boolean, is_matching boolean, reason string"))
    parsed = F.when(F.get_json_object(answer, "$").isNotNull(), record)
    passed = F.coalesce(parsed["is_english"] & parsed["is_matching"], F.lit(False))
    reason = F.when(parsed.isNull(), REASONS["parse"]).otherwise(F.coalesce(parsed["reason"], F.lit(REASONS["none"])))
    return df.withColumns({"decision": F.when(passed, "APPROVED").otherwise("REJECTED"), "audit_reason": reason})


def clean_format(c: Column) -> Column:
    """The checks of format that need no dictionary, in one."""
    return F.coalesce((c != "") & ~T.has_garbage(c) & ~T.has_markup(c) & ~T.has_private_characters(c), F.lit(False))


def missing_fields(**fields: Column) -> Column:
    """The names of blank fields, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(F.trim(c) == "", F.lit(True)), name) for name, c in fields.items())))


def decided(df: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """df with decision and reason: the reasons of all rules that a row breaks."""
    reasons = F.array_compact(F.array(*(F.when(broken, reason) for broken, reason in rules)))
    return df.withColumn("reason", F.concat_ws(" | ", reasons)).withColumn("decision", F.when(F.col("reason") == "", "APPROVED").otherwise("REJECTED"))


def collisions(df: DataFrame, key: Column) -> DataFrame:
    """df with copies: how many rows share the key. The counts come from an aggregate, so that a hot key is combined before it is shuffled."""
    marked = df.withColumn("_key", key)
    counts = marked.groupBy("_key").agg(F.count(F.lit(1)).alias("copies"))
    return marked.join(counts.filter("copies > 1"), "_key", "left").withColumn("copies", F.coalesce("copies", F.lit(1))).drop("_key")


def without_nan_text(df: DataFrame) -> DataFrame:
    """The rows in no column of which the word nan stands."""
    return df.filter(~F.coalesce(F.greatest(F.lit(False), *(F.coalesce(F.col(f"`{c}`").cast("string").rlike(r"(?i)\bnan\b"), F.lit(False)) for c in df.columns)), F.lit(False)))


def true_text(c: Column, value: str = "TRUE") -> Column:
    return F.upper(F.trim(c.cast("string"))) == value
