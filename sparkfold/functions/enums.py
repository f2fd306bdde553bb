"""Enumerated values as dimensions: age ratings, roles, languages and countries."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import look_up
from .text import key_variations

# Age ratings by the MetronInfo rating that they stand for.
AGE_RATINGS = {
    "Unknown": ("Unknown", "Rating Pending"),
    "Everyone": ("Everyone", "All Ages", "A", "E", "Early Childhood", "Everyone 10+", "G", "Kids to Adults"),
    "Teen": ("Teen", "PG", "PSR", "T", "13+", "PG13"),
    "Teen Plus": ("Teen Plus", "PG+", "Parental Advisory", "PSR+", "T+", "15+", "MA15+"),
    "Mature": ("Mature", "M", "17+", "R", "Mature 17+", "R18+"),
    "Explicit": ("Explicit", "ExplicitContent", "Violent", "Violence", "X18+"),
    "Adult": ("Adult", "X", "XXX", "Porn", "Pornography", "Sex", "Sexually Explicit", "Adults Only 18+"),
}
# Roles that a ComicInfo tag stands for.
COMIC_INFO_ROLES = {
    "Colorist": ("Colorist", "Colourist", "colorer", "colourer", "colors", "colours", "painting", "painter", "Color Separations", "Color Assists", "Color Flats", "Gray Tone"),
    "CoverArtist": ("CoverArtist", "Cover Artist", "covers", "coverDesigner", "Cover"),
    "Editor": ("Editor", "edits", "editing", "Consulting Editor", "Assistant Editor", "Associate Editor", "Group Editor", "Senior Editor", "Managing Editor", "Collection Editor", "Production", "Supervising Editor", "Executive Editor", "Editor In Chief"),
    "Inker": ("Inker", "finishes", "inks", "painting", "painter", "Embellisher", "Ink Assists", "Artist"),
    "Letterer": ("Letterer", "letters"),
    "Penciller": ("Penciller", "breakdowns", "pencils", "painting", "painter", "Illustrator", "Layouts", "Artist"),
    "Translator": ("Translator", "translation"),
    "Writer": ("Writer", "Author", "plotter", "scripter", "script", "Story", "Plot", "Interviewer"),
}
# Country of a currency.
CURRENCIES = {"AUD": "AU", "BRL": "BR", "CAD": "CA", "CHF": "CH", "CNY": "CN", "EUR": "IT", "GBP": "GB", "INR": "IN", "ITL": "IT", "JPY": "JP", "KRW": "KR", "MXN": "MX", "USD": "US"}


@cache
def languages() -> dict[str, str]:
    """ISO 639-1 code of each language by its English name, its two and its three letters, as the Java runtime knows them."""
    locale, out = SparkSession.active()._jvm.java.util.Locale, {}
    for code in locale.getISOLanguages():
        one = locale.forLanguageTag(code)
        out |= {one.getDisplayLanguage(locale.ENGLISH).lower(): code, one.getISO3Language().lower(): code, code.lower(): code.lower()}
    return out


@cache
def countries() -> dict[str, str]:
    """ISO 3166 code of each country by its English name, its two and its three letters, as the Java runtime knows them."""
    locale, out = SparkSession.active()._jvm.java.util.Locale, {}
    for code in locale.getISOCountries():
        one = locale.forLanguageTag(f"und-{code}")
        out |= {one.getDisplayCountry(locale.ENGLISH).lower(): code, one.getISO3Country().lower(): code, code.lower(): code}
    return out


def dimension(spark: SparkSession, values: dict[str, tuple[str, ...]]) -> DataFrame:
    """Table (alias, canonical) of a many-to-many map."""
    return spark.createDataFrame([(a, c) for c, aliases in values.items() for a in aliases], "alias string, canonical string")


def metron_age_rating(x: Column) -> Column:
    """MetronInfo rating of any rating, without regard to case and spaces; null if unknown."""
    table = {a.lower(): c for c, aliases in AGE_RATINGS.items() for a in aliases}
    table |= {a.replace(" ", ""): c for a, c in list(table.items())}
    keys = key_variations(x)
    return F.coalesce(look_up(table, F.get(keys, F.lit(0))), look_up(table, F.replace(F.lower(x), F.lit(" "), F.lit(""))))


def language_code(x: Column) -> Column:
    """Two-letter code of a language given by code or English name; null if unknown."""
    return look_up(languages(), F.lower(F.trim(x)))


def country_code(x: Column) -> Column:
    """Two-letter code of a country given by code or English name; null if unknown."""
    return look_up(countries(), F.lower(F.trim(x)))


def country_of_currency(x: Column) -> Column:
    """Country of a currency."""
    return look_up(CURRENCIES, F.upper(x))
