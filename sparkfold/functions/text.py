"""String normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that define the results.
VOLUME_SUFFIX = r"(?i)\s*(?:\(\s*)?(?:vol(?:ume|\.)?)\s*\d+\s*\)?"
PUBLISHER_NOISE = r"(?i)\b(?:inc|incorporated|comics?|publishing|press|llc|ltd|publications?)\b\.?"
NOT_ALPHANUMERIC = r"[^a-z0-9]+"
YEAR_PARENS = r"\s*\(\s*\d{4}(?:\s*[-–]\s*\d{4})?\s*\)"
BLOCK_TAG = r"(?i)<\s*(?:br|/p|/div|/li|/tr|/h[1-6]|/ul|/ol|/blockquote)\s*/?\s*>"


def strip(x: Column) -> Column:
    """Text without white space at its ends; null is the empty string."""
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def clean_tabs(x: Column) -> Column:
    """Tabs become spaces, then ``strip``."""
    return strip(F.translate(x, "\t", " "))


def halves(x: Column) -> Column:
    """One half, as a sign or a fraction, becomes .5."""
    return F.regexp_replace(x, r"½|1/2", ".5")


def issue_name(x: Column) -> Column:
    """Issue without spaces, leading # and zeros, trailing dots; halves as .5."""
    x = F.translate(F.coalesce(x, F.lit("")), " ", "")
    x = F.regexp_replace(x, r"^#+", "")
    x = F.regexp_replace(x, r"^0+([0-9A-Za-z_])", "$1")
    return halves(F.regexp_replace(x, r"\.+$", ""))


def issue_number(x: Column) -> Column:
    """The leading number of an issue name, as text; null if there is none."""
    found = F.regexp_extract(x, r"^([0-9]*\.?[0-9]*)", 1)
    return F.when(found.rlike("[0-9]"), found)


def issue_suffix(x: Column) -> Column:
    """What follows the leading number of an issue name."""
    return F.regexp_extract(x, r"^[0-9]*\.?[0-9]*(.*)$", 1)


def strip_leading_zeros(x: Column) -> Column:
    """No zeros before a digit; a lone 0 stays."""
    return F.regexp_replace(x, r"^0+([0-9])", "$1")


def issue_int(x: Column) -> Column:
    """The integer that the whole text is, or null."""
    return F.when(F.trim(x).rlike(r"^[0-9]+$"), F.trim(x)).try_cast("bigint")


def first_year(x: Column) -> Column:
    """The first run of exactly four digits, or null."""
    return F.nullif(F.regexp_extract(x, r"\b([0-9]{4})\b", 1), F.lit("")).try_cast("int")


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, " +", " "))


def normalize_series(x: Column) -> Column:
    """Lower case, no volume suffix, only letters a-z and digits between single spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(x), VOLUME_SUFFIX, " "), NOT_ALPHANUMERIC, " "))


def normalize_publisher(x: Column) -> Column:
    """Lower case without the usual company words."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(x), PUBLISHER_NOISE, " "), NOT_ALPHANUMERIC, " "))


def strip_years(x: Column) -> Column:
    """No years in parentheses."""
    return F.trim(F.regexp_replace(x, YEAR_PARENS, ""))


def key_variations(x: Column) -> Column:
    """X11: distinct spellings under which an enumerated value is looked up."""
    low = F.lower(x)
    return F.array_distinct(F.array(low, F.replace(low, F.lit(" "), F.lit("")), F.regexp_replace(low, "[^a-z0-9]", "")))


def split_list(x: Column, pattern: str = "[,;]") -> Column:
    """Parts between separators, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), pattern), lambda v: F.trim(v)), lambda v: v != "")


def join_sorted(x: Column, separator: str = ",") -> Column:
    """Distinct values in order, joined."""
    return F.array_join(F.array_sort(F.array_distinct(x)), separator)


def strip_html(x: Column) -> Column:
    """Block ends become line feeds, scripts, styles, comments and tags go, at most two line feeds in a row."""
    x = F.regexp_replace(x, r"(?is)<(script|style)\b.*?</(?:script|style)\s*>", "")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, BLOCK_TAG, "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def is_empty(x: Column) -> Column:
    """Null or the empty string; 0 and false are not empty."""
    return x.isNull() | (x.cast("string") == "")


def keep_nonempty(values: Column) -> Column:
    """P06 for arrays: elements that are not empty."""
    return F.filter(values, lambda v: v.isNotNull() & (v.cast("string") != ""))


def filename_from_fields(series: Column, issue: Column, year: Column, title: Column, ext: Column) -> Column:
    """a file name from fields; path separators become underscores."""
    parts = F.concat_ws(" ", series, F.concat(F.lit("#"), F.lpad(issue, 3, "0")), F.concat(F.lit("("), year.cast("string"), F.lit(")")), title)
    return F.regexp_replace(F.concat(parts, F.lit("."), ext), r"[/\\]", "_")


def looks_like_document(x: Column) -> Column:
    """text that is a document, not a file name: its first line starts as markup or ends as a mapping."""
    first = F.trim(F.get(F.split(x, "\n"), F.lit(0)))
    return first.rlike(r"^<[?!]|[{:]$")
