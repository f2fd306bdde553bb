"""Identifiers of catalogs: URLs, URNs and other spellings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import look_up

# Catalogs in rank order, with the hosts whose URLs name them.
SOURCES = ("metron", "comicvine", "grandcomicsdatabase", "leagueofcomicgeeks", "marvel", "panelsyndicate", "anilist", "kitsu", "mangadex", "mangaupdates", "myanimelist", "gtin", "isbn", "upc", "asin", "comixology")
HOSTS = (
    ("anilist.co", "anilist"), ("amazon.com", "asin"), ("amazon.ca", "asin"), ("amazon.co.uk", "asin"), ("amazon.co.jp", "asin"), ("amazon.com.mx", "asin"), ("amazon.com.br", "asin"),
    ("amazon.es", "asin"), ("amazon.de", "asin"), ("amazon.fr", "asin"), ("amazon.it", "asin"), ("comicvine.gamespot.com", "comicvine"), ("comicvine.com", "comicvine"),
    ("comixology.com", "comixology"), ("comics.org", "grandcomicsdatabase"), ("gs1.org", "gtin"), ("gs1us.org", "gtin"), ("gtinlookup.info", "gtin"), ("gtinlookup.org", "gtin"),
    ("isbnsearch.org", "isbn"), ("isbndb.com", "isbn"), ("kitsu.app", "kitsu"), ("kistu.app", "kitsu"), ("leagueofcomicgeeks.com", "leagueofcomicgeeks"), ("mangadex.org", "mangadex"),
    ("mangaupdates.com", "mangaupdates"), ("marvel.com", "marvel"), ("metron.cloud", "metron"), ("myanimelist.net", "myanimelist"), ("panelsyndicate.com", "panelsyndicate"),
    ("barcodelookup.com", "upc"), ("go-upc.com", "upc"),
)
# URL of an identifier by source: prefix, path template, and the path's word for each type.
URLS = {
    "anilist": ("https://anilist.co/", "{t}/{k}/s", {"series": "manga"}),
    "asin": ("https://www.amazon.com/", "dp/{k}", {"issue": "issue"}),
    "comicvine": ("https://comicvine.gamespot.com/", "c/{t}-{k}/", {"arc": "4045", "character": "4005", "creator": "4040", "issue": "4000", "location": "4020", "publisher": "4010", "series": "4050", "team": "4060"}),
    "comixology": ("https://www.comixology.com/", "c/{t}/{k}", {"issue": "digital-comic"}),
    "grandcomicsdatabase": ("https://comics.org/", "{t}/{k}/", {"character": "character", "creator": "creator", "issue": "issue", "series": "series", "publisher": "indicia_publisher", "universe": "universe"}),
    "isbn": ("https://isbndb.com/", "{t}/{k}", {"issue": "book", "series": "series"}),
    "kitsu": ("https://kitsu.app/", "{t}/{k}", {"series": "manga"}),
    "leagueofcomicgeeks": ("https://leagueofcomicgeeks.com/", "{t}/{k}/s", {"issue": "comic", "series": "comics/series", "publisher": "comics"}),
    "mangadex": ("https://mangadex.org/", "{t}/{k}/s", {"series": "title"}),
    "mangaupdates": ("https://mangaupdates.com/", "{t}/{k}/s", {"series": "series"}),
    "marvel": ("https://marvel.com/", "comics/{t}/{k}/s", {"issue": "issue", "series": "series"}),
    "metron": ("https://metron.cloud/", "{t}/{k}", {"arc": "arc", "character": "character", "creator": "creator", "imprint": "imprint", "issue": "issue", "publisher": "publisher", "series": "series", "team": "team", "universe": "universe"}),
    "myanimelist": ("https://myanimelist.net/", "{t}/{k}/s", {"series": "manga"}),
    "panelsyndicate": ("http://panelsyndicate.com/", "{t}/{k}", {"series": "comics"}),
    "upc": ("https://barcodelookup.com/", "{k}", {"issue": "issue"}),
}
# Path patterns by source; group 1 is the type's word, group 2 the key.
PATHS = {
    "anilist": r"(manga)/(\d+)", "asin": r"(dp)/(\S+)", "comicvine": r"(\d{4})-(\d+)", "comixology": r"c/(\S+)/(\d+)", "grandcomicsdatabase": r"([^/\s]+)/(\d+)",
    "isbn": r"(book)/([\d-]+)", "kitsu": r"(manga)/([^/\s]+)", "leagueofcomicgeeks": r"^/?(comics/series|comics|comic)/([^/\s]+)", "mangadex": r"(title)/([^/\s]+)", "mangaupdates": r"(series)/([^/\s]+)",
    "marvel": r"comics/(issue|series)/(\d+)", "metron": r"^/?([^/]+)/([^/]+)", "myanimelist": r"(manga)/(\d+)", "panelsyndicate": r"(comics)/(\w+)", "upc": r"()([\d-]+)",
}
TYPES = ("arc", "character", "creator", "genre", "imprint", "issue", "location", "publisher", "reprint", "role", "series", "story", "tag", "team", "universe", "volume")
ALIASES = {"cvdb": "comicvine", "cmxdb": "comixology"}
DEFAULT_TYPE = "issue"


def sources_table(spark: SparkSession) -> DataFrame:
    """Dimension of hosts: alias, source, rank, words (labels of the host)."""
    rank = {s: i for i, s in enumerate(SOURCES)}
    return spark.createDataFrame([(h, s, rank[s], h.count(".") + 1) for h, s in HOSTS], "alias string, source string, rank int, words int")


def _cases(table: dict[str, str] | dict[str, int], x: Column, default: Column) -> Column:
    """Value of the constant table entry whose key is x, or the default."""
    return F.coalesce(look_up(table, x), default)


def host_of(url: Column) -> Column:
    """Host of a URL, or null."""
    return F.try_parse_url(url, F.lit("HOST"))


def source_of_host(host: Column, hosts=HOSTS) -> Column:
    """The source of the longest host that is a suffix of this one in whole labels; the host itself if none is.

    ``hosts`` is a short list; for a table of hosts there is ``lookup.longest_suffix``.
    """
    low, out = F.lower(host), host
    for alias, source in sorted(hosts, key=lambda h: h[0].count(".")):  # the last that fits wins
        out = F.when((low == alias) | low.endswith("." + alias), F.lit(source)).otherwise(out)
    return out


def unknown_key(url: Column) -> Column:
    """Key of a URL of no known source: path, query and fragment."""
    path, query, fragment = (F.try_parse_url(url, F.lit(p)) for p in ("PATH", "QUERY", "REF"))
    return F.concat(F.regexp_replace(F.coalesce(path, F.lit("")), "^/", ""), F.coalesce(F.concat(F.lit("?"), query), F.lit("")), F.coalesce(F.concat(F.lit("#"), fragment), F.lit("")))


def url_type_and_key(source: Column, path: Column) -> Column:
    """struct(type, key) from the path of a known source's URL, without regard to case; null if it does not match."""
    out = F.lit(None).cast("struct<type:string,key:string>")
    for name, pattern in PATHS.items():
        pattern = f"(?i){pattern}"
        word, key = F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)
        words = URLS[name][2]
        kind = _cases({w.lower(): t for t, w in words.items()}, F.lower(word), F.lit(next(iter(words))))
        out = F.when((source == name) & (key != ""), F.struct(kind.alias("type"), key.alias("key"))).otherwise(out)
    return out


def url_of(source: Column, kind: Column, key: Column) -> Column:
    """URL of an identifier; empty if the key has a colon or the source has no page of that type."""
    table = {f"{name}|{t}": prefix + template.replace("{t}", word) for name, (prefix, template, words) in URLS.items() for t, word in words.items()}
    found = look_up(table, F.concat_ws("|", source, kind))
    return F.when(F.contains(key, F.lit(":")), F.lit("")).otherwise(F.coalesce(F.replace(found, F.lit("{k}"), key), F.lit("")))


def source_of_alias(alias: Column) -> Column:
    """A source by its name or an alternative one; null if unknown."""
    low = F.lower(alias)
    return _cases(ALIASES, low, F.when(low.isin(*SOURCES), low))


def normalize_key(source: Column, kind: Column, key: Column) -> Column:
    """struct(type, key) without the prefixes urn, type and own source; catalog codes such as 4050-160294 name their type."""
    own = F.concat(F.lit("^(?i)(?:(?:urn|"), source, F.lit("|" + "|".join(TYPES) + r")\s*:\s*)+"))
    head = F.call_function("regexp_extract", F.trim(key), own, F.lit(0))
    bare = F.trim(F.substring(F.trim(key), F.length(head) + 1, F.lit(1 << 20)))
    named = F.nullif(F.lower(F.regexp_extract(head, r"(?i)^.*\b(" + "|".join(TYPES) + r")\b\s*:", 1)), F.lit(""))
    code, number = F.regexp_extract(bare, r"^(\d{4})-(\d+)", 1), F.regexp_extract(bare, r"^(\d{4})-(\d+)", 2)
    of_code = _cases({w: t for t, w in URLS["comicvine"][2].items()}, code, F.coalesce(named, kind))
    long = (source == "comicvine") & (code != "")
    return F.struct(F.when(long, of_code).otherwise(F.coalesce(named, kind)).alias("type"), F.when(long, number).otherwise(bare).alias("key"))


def identifier(source: Column, kind: Column, key: Column, url: Column | None = None) -> Column:
    """struct(key, url) with a normalised key and, unless one is given, its URL."""


    def build(parts: Column) -> Column:
        made = url_of(source, parts["type"], parts["key"])
        return F.struct(parts["key"].alias("key"), F.nullif(made if url is None else F.coalesce(url, made), F.lit("")).alias("url"))

    # bound once: the URL names type and key in each of its cases
    return F.get(F.transform(F.array(normalize_key(source, F.coalesce(kind, F.lit(DEFAULT_TYPE)), key)), build), F.lit(0))


def parse_urn(urn: Column) -> Column:
    """struct(source, type, key) of urn:source:type:key; the type is the last part but one."""
    parts = F.split(urn, ":")
    n = F.size(parts)
    ok = F.lower(F.get(parts, F.lit(0))).eqNullSafe(F.lit("urn")) & (n >= 3)
    kind = F.when(n > 3, F.get(parts, n - 2)).otherwise(F.lit(DEFAULT_TYPE))
    return F.when(ok, F.struct(F.lower(F.get(parts, F.lit(1))).alias("source"), kind.alias("type"), F.get(parts, n - 1).alias("key")))


def urn_of(source: Column, kind: Column, key: Column) -> Column:
    """The URN of an identifier; empty if the source is a host name."""
    return F.when(F.contains(source, F.lit(".")), F.lit("")).otherwise(F.concat_ws(":", F.lit("urn"), source, kind, key))


def parse_other(text: Column) -> Column:
    """struct(source, type, key) of spellings such as CVDB1234, source:type:key or a bare catalog code."""
    code = F.regexp_extract(text, r"(\d{4})-(\d+)", 1)
    pattern = "(?i)(" + "|".join((*SOURCES, *ALIASES)) + "):?(?:(" + "|".join(TYPES) + r"):)?([\w-]+)"
    name, kind, key = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    of_code = _cases({w: t for t, w in URLS["comicvine"][2].items()}, code, F.lit(DEFAULT_TYPE))
    return (
        F.when(code != "", F.struct(F.lit("comicvine").alias("source"), of_code.alias("type"), F.regexp_extract(text, r"(\d{4})-(\d+)", 2).alias("key")))
        .when(key != "", F.struct(source_of_alias(name).alias("source"), F.coalesce(F.nullif(F.lower(kind), F.lit("")), F.lit(DEFAULT_TYPE)).alias("type"), key.alias("key")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("source"), F.lit(DEFAULT_TYPE).alias("type"), text.alias("key")))
    )


def rank_of(source: Column) -> Column:
    """Rank of a source, beyond all others if unknown."""
    return _cases({s: i for i, s in enumerate(SOURCES)}, F.lower(source), F.lit(len(SOURCES)))
