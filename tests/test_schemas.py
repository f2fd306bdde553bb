"""Schemas of all formats: what the writers make fits, documents with one fault each don't."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkfold.operators import records, validate
from sparkfold.sources import canonical, documents, xsd

DOCS = {
    "comic_info": "<ComicInfo><Title>a</Title><Year>1999</Year><Month>12</Month><Manga>Yes</Manga><CommunityRating>4.5</CommunityRating><Pages><Page Image=\"0\" Type=\"FrontCover\"/><Page Image=\"1\" DoublePage=\"true\"/></Pages></ComicInfo>",
    "metron_info": "<MetronInfo><IDS><ID source=\"Metron\" primary=\"true\">9</ID></IDS><Series lang=\"en\"><Name>A</Name><StartYear>1999</StartYear></Series><CoverDate>1999-02-01</CoverDate><Arcs><Arc id=\"3\"><Name>B</Name><Number>1</Number></Arc></Arcs><Credits><Credit><Creator id=\"1\">C</Creator><Roles><Role>Writer</Role></Roles></Credit></Credits></MetronInfo>",
    "comet": "<comet><title>a</title><genre>x</genre><issue>3</issue><genre>y</genre><date>1999-02-01</date><price>1.50</price></comet>",
    "comic_book_info": '{"appID": "x", "ComicBookInfo/1.0": {"series": "a", "issue": 3, "publicationMonth": 2, "credits": [{"person": "p", "role": "Writer", "primary": true}], "tags": ["t"]}}',
    "native_json": '{"record": {"title": "a", "page_count": 3, "date": {"cover_date": "1999-02-01"}, "characters": {"A": {"identifiers": null}}, "series_groups": ["g"]}}',
    "native_yaml": "record:\n  title: a\n  page_count: 3\n",
}
FAULTS = [
    ("comic_info", ("<Year>1999", "<Year>now")), ("comic_info", ("<Month>12", "<Month>Dec")), ("comic_info", ("FrontCover", "Cover")), ("comic_info", ("Manga>Yes", "Manga>Perhaps")), ("comic_info", ("4.5", "5.5")), ("comic_info", ("<Title>a</Title>", "<Title>a</Title><Title>b</Title>")),
    ("comic_info", ("<Title>a</Title>", "<Tittle>a</Tittle>")), ("comic_info", (' Image="0"', "")), ("comic_info", ('DoublePage="true"', 'DoublePage="often"')), ("comic_info", ("ComicInfo>", "ComicBook>")), ("comic_info", ("</ComicInfo>", "")),
    ("metron_info", ("<Name>A</Name>", "")), ("metron_info", ("1999-02-01", "1999-02-30")), ("metron_info", (' source="Metron"', "")), ("metron_info", ("<Number>1", "<Number>0")), ("metron_info", ("<Roles><Role>Writer</Role></Roles>", "<Roles><Job>Writer</Job></Roles>")), ("metron_info", ("StartYear>1999", "StartYear>99")),
    ("comet", ("<title>a</title>", "")), ("comet", ("<title>a</title>", "<title>a</title><title>b</title>")), ("comet", ("<issue>3", "<issue>-3")), ("comet", ("<date>1999-02-01</date>", "<date>1999-02-01</date><date>1999-02-02</date>")), ("comet", ("1.50", "free")),
    ("comic_book_info", ('"publicationMonth": 2', '"publicationMonth": 14')), ("comic_book_info", ('"person": "p"', '"person": 5')), ("comic_book_info", ('["t"]', '["t", 5]')), ("comic_book_info", ('"issue": 3', '"issue": "three"')), ("comic_book_info", ("}}", "}")),
    ("native_json", ('"record"', '"recort"')), ("native_json", ('"page_count": 3', '"page_count": "many"')), ("native_json", ("1999-02-01", "1999-13-01")), ("native_json", ('["g"]', '"g"')), ("native_json", ('{"identifiers": null}', "5")),
    ("native_yaml", ("page_count: 3", "page_count: [3]")), ("native_yaml", ("record:", "- record:")),
]


def test_each_fault_is_found(spark):
    rows = [(f"{fmt} as it is", fmt, text, True) for fmt, text in DOCS.items()] + [(f"{fmt} {new}", fmt, DOCS[fmt].replace(old, new), False) for fmt, (old, new) in FAULTS]
    assert all(DOCS[fmt].replace(old, new) != DOCS[fmt] for fmt, (old, new) in FAULTS)
    rows += [("null", "comet", None, False), ("empty", "native_json", "", False), ("no schema", "filename", "any", True)]
    found = validate.validate(spark.createDataFrame(rows, "path string, fmt string, payload string, want boolean"))
    assert {r.path: r.valid for r in found.collect()} == {p: want for p, _, _, want in rows}


def test_what_the_writers_make_fits(spark):
    raw = [("a", "s", "native_json", 0, DOCS["native_json"]), ("b", "s", "comic_book_info", 0, DOCS["comic_book_info"])]
    merged = records.merge_documents(documents.normalize(spark.createDataFrame(raw, "path string, source string, fmt string, ordinal int, payload string"), ["native_json", "comic_book_info"]))
    series = F.from_json(F.lit('{"name": "S", "start_year": 1999}'), canonical.FIELDS["series"])
    named = merged.withColumn("record", F.col("record").withField("title", F.coalesce("record.title", F.lit("t"))).withField("series", series))
    formats = [f for f in documents.WRITERS if f in validate.VALIDATORS]
    checked = documents.render(named, formats).select(*[F.struct(validate.VALIDATORS[f](F.col(f)).alias("ok"), F.col(f).alias("text")).alias(f) for f in formats]).collect()
    assert len(checked) == 2 and all(r[f].ok for r in checked for f in formats), [(f, r[f].text) for r in checked for f in formats if not r[f].ok]


def test_a_schema_is_shipped_once(spark):
    text = xsd.schema_text("r", {"a": "int 1..3", "b?": {"=": "text", "@id": "count?"}})
    assert xsd.shipped(text) == xsd.shipped(text)
    check = validate.fits_xsd("r", {"a": "int 1..3", "b?": {"=": "text", "@id": "count?"}})
    rows = spark.createDataFrame([("<r><a>3</a></r>", True), ("<r><b id='1'>x</b><a>1</a></r>", True), ("<r><a>4</a></r>", False), ("<r><a>1</a><b id='x'>x</b></r>", False), ("<r/>", False)], "x string, ok boolean")
    assert [r.found for r in rows.select(check(F.col("x")).alias("found")).collect()] == [r.ok for r in rows.collect()]


@pytest.mark.parametrize("fmt", ["comic_info", "comet", "metron_info"])
def test_schemas_are_well_formed(fmt):
    import xml.etree.ElementTree as E

    root, content = {"comic_info": ("ComicInfo", xsd.COMIC_INFO), "comet": ("comet", xsd.COMET), "metron_info": ("MetronInfo", xsd.METRON_INFO)}[fmt]
    assert E.fromstring(xsd.schema_text(root, content)).tag.endswith("schema")
