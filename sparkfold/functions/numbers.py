"""Numbers, dates, ratings, bits and bytes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats that a date field accepts, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyyMMdd", "MMMM d, yyyy", "d MMMM yyyy", "yyyy-MM", "yyyy")
#: Waiting times in seconds by attempt, where the server gives no hint (fixed values).
RATE_LIMIT_SCHEDULE = (30, 60, 120, 300, 600, 600, 600, 600)


def integer(x: Column, low: int | None = None, high: int | None = None) -> Column:
    """First run of digits (a sign is lost), within the bounds."""
    return clamp(F.nullif(F.regexp_extract(x.cast("string"), "([0-9]+)", 1), F.lit("")).try_cast("bigint"), low, high)


def decimal(x: Column, places: int = 2) -> Column:
    """First decimal number, rounded half up."""
    x = F.regexp_replace(F.translate(x.cast("string"), " ", ""), "½|1/2", ".5")
    return F.round(F.nullif(F.regexp_extract(x, r"([0-9]*\.?[0-9]+)", 1), F.lit("")).try_cast("decimal(20,6)"), places)


def clamp(x: Column, low=None, high=None) -> Column:
    """X within the bounds; null stays null."""
    if low is not None:
        x = F.when(x.isNotNull(), F.greatest(x, F.lit(low)))
    if high is not None:
        x = F.when(x.isNotNull(), F.least(x, F.lit(high)))
    return x


def canonical_rating(value: Column) -> Column:
    """Any rating scale to 0..5 with one decimal: up to 10 it is halved, beyond it is scaled by its power of ten."""
    scale = F.pow(F.lit(10.0), F.ceil(F.log10(value))) / 5
    scaled = F.when(value <= 0, F.lit(0.0)).when(value <= 10, value / 2).otherwise(value / scale)
    return F.when(value.isNotNull(), F.least(F.round(scaled.cast("decimal(18,8)"), 1), F.lit(5).cast("decimal(18,1)"))).cast("double")


def rating_of_ten(canonical: Column) -> Column:
    """0..5 to an integer of 0..10."""
    return F.when(canonical.isNotNull(), F.least(F.greatest(F.round(canonical.cast("decimal(18,8)") * 2, 0), F.lit(0)), F.lit(10))).cast("int")


def compose_date(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts; null if they are no date."""
    dash = F.lit("-")  # plain concat: a missing part must not make a shorter, valid date
    return F.concat(F.lpad(year.cast("string"), 4, "0"), dash, F.lpad(month.cast("string"), 2, "0"), dash, F.lpad(day.cast("string"), 2, "0")).try_cast("date")


def parse_date(x: Column) -> Column:
    """A date in one of DATE_FORMATS, or null."""
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def iso_seconds(ts: Column) -> Column:
    """ISO 8601 in UTC with seconds and Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def reldate(notes: Column) -> Column:
    """The release date in a note, or null."""
    return parse_date(F.nullif(F.regexp_extract(notes, r"\[RELDATE:([^\]\s]+)\]", 1), F.lit("")))


def backoff(attempt: Column, most: int = 60) -> Column:
    """Exponential waiting time min(2^attempt, most)."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(float(most)))


def rate_limit_wait(attempt: Column, hint: Column | None = None) -> Column:
    """The server's hint (at most an hour) or the schedule by attempt (from 1)."""
    schedule = F.array(*[F.lit(x) for x in RATE_LIMIT_SCHEDULE])
    planned = F.element_at(schedule, F.least(F.greatest(attempt, F.lit(1)), F.lit(len(RATE_LIMIT_SCHEDULE))).cast("int"))
    return planned if hint is None else F.when(hint.isNotNull(), F.least(hint, F.lit(3600))).otherwise(planned)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in 16 hexadecimal digits; in halves, as 64 bits overflow a signed number."""

    def half(x: Column, start: int) -> Column:
        return F.conv(F.substring(x, start, 8), 16, 10).cast("bigint")

    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def hash_score(distance: Column) -> Column:
    """Similarity of covers from the distance of their hashes."""
    return F.greatest(F.lit(0.0), 1 - distance / F.lit(64.0))


#: First bytes of image formats (fixed values): name, position from 1, bytes in hexadecimal.
MAGIC = (("pdf", 1, "25504446"), ("jpeg", 1, "FFD8FF"), ("png", 1, "89504E470D0A1A0A"), ("gif", 1, "47494638"), ("tiff", 1, "49492A00"), ("tiff", 1, "4D4D002A"), ("jpx", 1, "0000000C6A5020200D0A870A"), ("webp", 9, "57454250"), ("pnm", 1, "5036"), ("pnm", 1, "5035"))


def sniff(content: Column) -> Column:
    """Image format by first bytes, or null."""
    out = F.lit(None).cast("string")
    for name, start, digits in reversed(MAGIC):
        out = F.when(F.hex(F.substring(content, start, len(digits) // 2)) == digits, F.lit(name)).otherwise(out)
    return out


#: First bytes of containers in the order in which they are tried (fixed values).
CONTAINERS = (("PDF", 1, "25504446"), ("CB7", 1, "377ABCAF271C"), ("CBZ", 1, "504B0304"), ("CBR", 1, "526172211A07"), ("CBT", 258, "7573746172"))
EXTENSIONS = {"pdf": "PDF", "cb7": "CB7", "7z": "CB7", "cbz": "CBZ", "zip": "CBZ", "cbr": "CBR", "rar": "CBR", "cbt": "CBT", "tar": "CBT"}


def container_type(path: Column, content: Column) -> Column:
    """Type of a container: what the extension says if the first bytes agree, else by first bytes; null if unknown."""
    by_magic = F.lit(None).cast("string")
    for name, start, digits in reversed(CONTAINERS):
        by_magic = F.when(F.hex(F.substring(content, start, len(digits) // 2)) == digits, F.lit(name)).otherwise(by_magic)
    return by_magic
