"""Text columns: normalising, cleaning, splitting and flagging. Everything is a Column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Boilerplate of publishers' pages, matched anywhere without regard to case.
GARBAGE_PATTERNS = [
    r"cookies\s+to\s+enhance\s+your\s+experience",
    r"RETURN\s+TO\s+ISSUE",
    r"PREV\s*Article\s*NEXT",
    r"PREV\s*Nano\s*NEXT",
    r"ADVERTISEMENT\s+RETURN",
    r"Share\s+on\s*Facebook\s*Twitter",
    r"LEARN\s+ABOUT\s+THESE\s+METRICS",
    r"Article\s+Views\s+are\s+the\s+COUNTER-compliant",
    r"Altmetric\s+Attention\s+Score",
    r"Request\s+reuse\s+permissions",
    r"Get\s+e-Alerts",
    r"Add\s+Full\s+Text\s+with\s+Reference",
]
#: Web noise, reported by keyword.
NOISE_PATTERNS = [
    r"this content is only available as a pdf",
    r"you do not currently have access to this content",
    r"article pdf first page preview",
    r"search for other works by this author",
    r"oxford academic",
    r"pubmed",
    r"google scholar",
    r"download citation file",
    r"toolbar search",
    r"share icon share",
    r"share on",
    r"facebook",
    r"twitter",
    r"linkedin",
    r"wechat",
    r"reprints and permissions",
    r"cite icon cite",
    r"article views are the counter-compliant sum",
    r"altmetric attention score",
    r"clicking on the donut icon will load a page",
]
#: Marks of contaminated markup, in the order in which they are tried.
MARKUP_MARKS = ["<jats:p>", "<jats:sec>", "<jats:title>", "<jats:italic>", "<jats:bold>", "</jats:", "jats:p>", "<div", "<b>", "</b>", "<i>", "</i>", "<p>", "</p>", "<br", "&lt;jats:", "&lt;div"]
#: Marks of a paywall and their reasons, in order.
PAYWALL_MARKS = {
    "this content is only available as a pdf": "PDF Paywall Indicator",
    "you do not currently have access": "Access Denied Message",
    "log in to your account": "Login Prompt Redirection",
    "purchase this article": "Purchase Paywall Prompt",
    "download citation file:": "Citation Exporter Widget",
    "ris (zotero)": "Zotero Citation Reference block",
    "reference manager": "Reference Manager Reference block",
    "easybib": "EasyBib Widget",
    "refworks": "Refworks Reference block",
    "share on facebook": "Social Widget Residual",
    "share on twitter": "Social Widget Residual",
}
#: English words whose absence is suspicious; texts that count as null.
ENGLISH_STOPWORDS = ["the", "and", "of", "is", "to", "in", "that", "it", "with", "as", "for", "was"]
NULL_MARKS = ["", "nan", "NaN", "None", "null", "NULL", "N/A", "n/a"]


def id_suffix(c: Column) -> Column:
    """The last segment of an id that may be a URL."""
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def id_without_prefix(c: Column, prefix: str) -> Column:
    return F.replace(c, F.lit(prefix), F.lit(""))


def id_url(c: Column, prefix: str) -> Column:
    """A full URL from a bare id; URLs lose trailing slashes."""
    bare = F.regexp_replace(c, "/+$", "")
    return F.when(c.startswith("http"), bare).otherwise(F.concat(F.lit(prefix), bare))


def ordered_distinct(a: Column) -> Column:
    """Trimmed values that aren't blank, each once, in the order of first sight."""
    return F.array_distinct(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != ""))


def pipe_joined(a: Column) -> Column:
    return F.coalesce(F.array_join(ordered_distinct(a), "|"), F.lit(""))


def clean_labels(c: Column) -> Column:
    """A list in one cell: pipes and loose commas become ", "; nothing left is nan."""
    x = F.btrim(F.regexp_replace(F.regexp_replace(c, r"\|", ", "), r"\s*,\s*", ", "), F.lit(", "))
    return F.when(x.isNull() | x.isin("", ",", ", ,", "nan,", ", nan"), "nan").otherwise(x)


def hyphen_title(c: Column) -> Column:
    parts = F.transform(F.split(c, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2)))))
    return F.array_join(parts, "-")


def whole_number_text(c: Column) -> Column:
    """'2019.0' as '2019'; what is no finite number is nan."""
    x = number(c)
    return F.when(x.isNull() | (F.abs(x) > 9e18), "nan").otherwise(x.cast("bigint").cast("string"))


def number(c: Column) -> Column:
    """A double, null where the text isn't one or is NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def normalised(c: Column) -> Column:
    """Trimmed, lower case, dashes plain, white space single."""
    return F.regexp_replace(F.lower(F.translate(F.trim(c), "–—", "--")), r"\s+", " ")


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def null_marks_as_null(c: Column) -> Column:
    return F.when(~F.trim(c).isin(NULL_MARKS), c)


def content_hash(c: Column) -> Column:
    return F.md5(F.lower(F.trim(c)))


def combined(title: Column, abstract: Column) -> Column:
    return F.concat(title, F.lit(". "), abstract)


def split_combined(c: Column) -> Column:
    """title, abstract of a combined text: at the first full stop and space, else title is the first 100 characters and abstract the whole."""
    at = F.instr(c, ". ")
    return F.struct(F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(F.substring(c, 1, 100)).alias("title"), F.when(at > 0, F.substr(c, at + 2)).otherwise(c).alias("abstract"))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda x: x != "")


def letter_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z']+"), F.lit(0))


def non_ascii_share(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 0, F.length(F.regexp_replace(c, r"[\x00-\x7F]+", "")) / n).otherwise(0.0)


def file_name(c: Column) -> Column:
    return F.translate(c, "/: ", "__-")


def has_garbage(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)" + "|".join(GARBAGE_PATTERNS)), F.lit(False))


def noise_found(c: Column) -> Column:
    """The distinct keywords of web noise in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("(" + "|".join(NOISE_PATTERNS) + ")"), F.lit(1))))


def has_markup(c: Column) -> Column:
    return F.coalesce(c.rlike("<[a-zA-Z]") | (c.contains("&") & c.contains(";")), F.lit(False))


def has_private_characters(c: Column) -> Column:
    return F.coalesce(c.rlike("[-�]"), F.lit(False))


def paywall_reason(c: Column) -> Column:
    """The first reason to take a text for a paywall page or its remains, Passed if there is none. One search for any mark or form spares clean texts the rest."""
    return F.transform(F.array(F.struct(c.alias("c"), F.lower(c).alias("t"))), lambda x: _paywall_reason(x["c"], x["t"]))[0]  # lower once


#: What no text with a reason lacks, for the search that comes first.
_ANY_REASON = re.compile("[].[^$*+?{}|()\\\\]")


def _paywall_reason(c: Column, t: Column) -> Column:
    marks = "|".join(_ANY_REASON.sub(lambda m: "\\" + m[0], m) for m in [*MARKUP_MARKS, *PAYWALL_MARKS])
    clean = ~t.rlike(marks + r"|doi\.org/10\.\d|^vol|issn|^©")
    return F.when(F.coalesce(clean, F.lit(True)), "Passed").otherwise(_first_reason(c, t))


def _first_reason(c: Column, t: Column) -> Column:
    out = F.when(F.lit(False), "")
    for mark in MARKUP_MARKS:
        out = out.when(t.contains(mark), f"JATS/HTML Tag Found ('{mark}')")
    for mark, reason in PAYWALL_MARKS.items():
        out = out.when(t.contains(mark), reason)
    out = out.when(c.rlike(r"^.{0,150}https?://doi\.org/10\.\d{4,}"), "Early DOI Redirection Link")
    out = out.when(t.rlike(r"^(volume|vol\.?)\s+\d+,\s+(issue|iss\.?)\s+\d+"), "Volume/Issue Header Residual")
    out = out.when(t.rlike(r"(online issn|print issn|issn[:\s])\s*\d{4}-\d{3}[\dx]"), "ISSN Header Noise")
    return out.when(t.rlike(r"^©\s+\d{4}\s+[a-z][a-za-z\s]{3,60}$"), "Pure Copyright Line Abstract").otherwise("Passed")


def suspicious_english(c: Column) -> Column:
    """More than ten words and no English stop-word, or more than 0.15 of it outside ASCII."""
    w = letter_words(c)
    return ((F.size(w) > 10) & ~F.arrays_overlap(w, F.array(*map(F.lit, ENGLISH_STOPWORDS)))) | (non_ascii_share(c) > 0.15)


def broken_words(c: Column) -> Column:
    """Candidates for words broken by a hyphen: structs of whole (as written, blanks too) and joined."""
    found = F.regexp_extract_all(F.regexp_replace(c, "­\\s*", "-"), F.lit(r"\b[a-zA-Z]{2,}-\s*[a-zA-Z]{2,}\b"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.lower(x).alias("whole"), F.lower(F.regexp_replace(x, r"-\s*", "")).alias("joined")))
