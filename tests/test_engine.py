"""Documents, records, archives, matching and settings on small literals."""

from __future__ import annotations

import io
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkfold import config
from sparkfold.functions import similarity as S
from sparkfold.operators import evaluate, lookup, match, merge, records, resolve, validate
from sparkfold.sources import archives, documents, sinks

COMIC_INFO = """<?xml version="1.0"?><ComicInfo><Title>The Beginning; The End</Title><Series>Captain Science</Series><Number>1</Number><Count>7</Count><Volume>1950</Volume><Year>1950</Year><Month>11</Month><Day>1</Day>
<Writer>Joe Orlando</Writer><Penciller>Wally Wood</Penciller><Inker>Wally Wood</Inker><Publisher>Youthful</Publisher><Genre>Science Fiction</Genre><Web>https://comicvine.gamespot.com/c/4000-145269/</Web><PageCount>5</PageCount>
<StoryArc>Captain Arc,Other Arc</StoryArc><StoryArcNumber>4,2</StoryArcNumber><Pages><Page Image="0" Type="FrontCover" ImageSize="4542"/><Page Image="1"/></Pages><GTIN>urn:comicvine:issue:145269</GTIN><Unknown>x</Unknown></ComicInfo>"""
INFO_JSON = '{"appID":"tool","ComicBookInfo/1.0":{"series":"Other","issue":2,"rating":84,"credits":[{"person":"Ann","role":"penciler","primary":true}],"genre":"Drama","publicationYear":1949}}'
NAME = "Captain Science #001 (1950) The Beginning - nothing.cbz"
RAW = "path string, source string, fmt string, ordinal int, payload string"


@pytest.fixture(scope="module")
def record(spark):
    rows = [("a", "archive_file", None, 0, COMIC_INFO), ("a", "archive_file", None, 0, INFO_JSON), ("a", "archive_filename", "filename", 0, NAME), ("b", "archive_file", "comic_info", 0, "<ComicInfo><Number>1234SUFFIX</Number><Tags>leagueofcomicgeeks:series:178012</Tags><Notes>Tagged with X dev on 1970-01-21T00:00:00Z [CVDB145269] [RELDATE:2025-04-11]</Notes></ComicInfo>")]
    found = records.read_records(spark.createDataFrame(rows, RAW), formats=["comic_info", "comic_book_info", "filename"])
    return {r.path: r.record.asDict(True) for r in found.collect()}


def test_documents_merge_by_precedence(record):
    a = record["a"]
    assert a["series"]["name"] == "Captain Science" and a["issue"]["number"] == 1 and a["ext"] == "cbz" and a["tagger"] == "tool"
    assert set(a["genres"]) == {"Science Fiction", "Drama"} and a["date"]["year"] == 1950 and str(a["date"]["cover_date"]) == "1950-11-01"
    assert {p: set(c["roles"]) for p, c in a["credits"].items()} == {"Joe Orlando": {"Writer"}, "Wally Wood": {"Penciller", "Inker"}, "Ann": {"Penciller"}}
    assert a["arcs"]["Captain Arc"]["number"] == 4 and a["pages"][0]["size"] == 4542 and float(a["critical_rating"]) == 4.2
    assert a["identifiers"]["comicvine"] == {"key": "145269", "url": "https://comicvine.gamespot.com/c/4000-145269/"}
    assert set(a["stories"]) == {"The Beginning", "The End"} and a["credit_primaries"] == {"Penciller": "Ann"}


def test_notes_tags_and_issue_parts_are_mined(record):
    b = record["b"]
    assert b["issue"]["suffix"] == "SUFFIX" and b["issue"]["number"] == 1234 and b["tagger"] == "X dev"
    assert b["identifiers"]["leagueofcomicgeeks"] == {"key": "178012", "url": "https://leagueofcomicgeeks.com/comics/series/178012/s"}
    assert b["identifiers"]["comicvine"]["key"] == "145269" and str(b["date"]["cover_date"]) == "2025-04-11" and b["updated_at"].day == 21


def test_round_trip_of_written_documents(spark):
    raw = spark.createDataFrame([("a", "archive_file", "comic_info", 0, COMIC_INFO)], RAW)
    out = documents.render(documents.normalize(raw, ["comic_info"]), ["comic_info"]).select("path", F.lit("archive_file").alias("source"), F.lit("comic_info").alias("fmt"), F.lit(0).alias("ordinal"), F.col("comic_info").alias("payload"))
    first, again = (documents.normalize(x, ["comic_info"]).select(F.to_json("record")).first()[0] for x in (raw, out))
    assert first == again


def test_native_documents(spark):
    texts = spark.createDataFrame([("record:\n  series:\n    name: S\n  pages:\n    0: {size: 5}\n  prices: {US: 1.5}",), ("]bad[",), (None,)], "p string")
    found = [r.r for r in texts.select(documents.native_yaml(F.col("p")).alias("r")).collect()]
    assert found[0].series.name == "S" and found[0].pages[0].size == 5 and float(found[0].prices["US"]) == 1.5 and found[1] is None and found[2] is None
    line = spark.createDataFrame([("series: {name: L}, page_count: 3",)], "p string").select(documents.native_line(F.col("p")).alias("r")).first().r
    assert line.series.name == "L" and line.page_count == 3


def test_archives_are_read_and_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / NAME, "w") as z:
        z.writestr("p2.jpg", b"\xff\xd8\xff2")
        z.writestr("P1.jpg", b"\xff\xd8\xff1")
        z.writestr("deep/ComicInfo.xml", "<ComicInfo><Series>Deep</Series></ComicInfo>")
        z.writestr("ComicInfo.xml", COMIC_INFO)
        z.writestr("__MACOSX/p3.jpg", b"")
        z.comment = INFO_JSON.encode()
    with tarfile.open(tmp_path / "in" / "t.cbt", "w") as t:
        info = tarfile.TarInfo("a.png")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "in" / "bad.cbz").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "in" / "r.cbr").write_bytes(b"Rar!\x1a\x07\x00")
    members = archives.members(spark, f"file://{tmp_path}/in")
    listing = archives.listing(spark, f"file://{tmp_path}/in")
    rows = members.collect()
    assert [r.name for r in rows if r.file_type == "CBZ" and not r.error] == ["__MACOSX/p3.jpg", "ComicInfo.xml", "deep/ComicInfo.xml", "P1.jpg", "p2.jpg"]
    assert sorted(r.path.rpartition("/")[2] for r in rows if r.error) == ["bad.cbz", "r.cbr"]
    assert [(r.name, r.page) for r in archives.pages(listing.where("file_type = 'CBZ'")).collect()] == [("P1.jpg", 0), ("p2.jpg", 1)]
    raw = archives.metadata_documents(listing)
    top = raw.where("fmt = 'comic_info'").collect()
    assert len(top) == 1 and "Captain Science" in top[0].payload and raw.where("source = 'archive_comment'").count() == 1
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/in").where("path LIKE '%cbz'").select("path", "content", F.create_map(F.lit("ComicInfo.xml"), F.lit("<ComicInfo/>")).alias("documents"))
    (tmp_path / "out").mkdir()
    done = {r.path.rpartition("/")[2]: r for r in sinks.write_archives(files, str(tmp_path / "out"), f"file://{tmp_path}/in").collect()}
    assert sum(r.written for r in done.values()) == 1 and done["bad.cbz"].error
    written = next(p for p in (tmp_path / "out").iterdir())
    with zipfile.ZipFile(written) as z:
        assert sorted(z.namelist()) == ["ComicInfo.xml", "P1.jpg", "__MACOSX/p3.jpg", "p2.jpg"] and z.read("ComicInfo.xml") == b"<ComicInfo/>"
    with pytest.raises(ValueError):
        sinks.safe_target("/tmp/x", "../y")
    spark.dataSource.register(archives.ArchiveSource)
    assert spark.read.format("archives").option("content", "false").load(str(tmp_path / "in")).where("error IS NULL").count() == 6


def test_merge_modes(spark):
    base = spark.sql("SELECT 1 AS k, named_struct('a', 1, 'm', map('x', 1), 'l', array(1, 2)) AS r")
    patch = spark.sql("SELECT 1 AS k, named_struct('a', CAST(NULL AS INT), 'm', map('y', 2), 'l', array(3, 4)) AS r UNION ALL SELECT 2, named_struct('a', 5, 'm', map('z', 3), 'l', array(9))")
    added = {r.k: r.r.asDict() for r in merge.merge_records(base, patch, ["k"], merge.ADDITIVE).collect()}
    assert added[1] == {"a": 1, "m": {"x": 1, "y": 2}, "l": [1, 2, 3, 4]} and added[2]["a"] == 5
    replaced = {r.k: r.r.asDict() for r in merge.merge_records(base, patch, ["k"], merge.REPLACE).collect()}
    assert replaced[1] == {"a": 1, "m": {"x": 1, "y": 2}, "l": [3, 4]}
    updated = [r.r.asDict() for r in merge.merge_records(base, patch, ["k"], merge.UPDATE).collect()]
    assert updated == [{"a": None, "m": {"y": 2}, "l": [3, 4]}]


def test_similarity_of_names():
    assert round(S.ratio("this is a test", "this is a test!"), 2) == 96.55 and S.partial_ratio("this is a test", "this is a test!") == 100
    assert S.token_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100 and S.token_ratio("fuzzy was a bear but not a dog", "fuzzy was a bear") == 100
    assert S.weighted_ratio("", "a") == 0 and S.weighted_ratio("a", "a") == 100 and S.ratio("", "") == 100
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert S.lcs(a, b) == table[-1][-1]


def test_tie_break_against_a_loop(spark):
    r, rows = random.Random(2), []
    for p in range(30):
        for i in range(r.randint(1, 8)):
            rows.append((p, i, r.choice([0.9, 0.8]), round(r.choice([0.9, 0.89, 0.88, 0.86]), 2), r.choice([None, 0.9, 0.92, 0.97]), r.choice([None, 3, 5, 9])))
    frame = spark.createDataFrame(rows, "profile int, issue int, metadata double, score double, cover double, volume int")
    found = {(x.profile, x.issue): x.final_place for x in match.tie_break(match.rank(frame, "profile", "score", "volume", "issue"), "profile").collect()}
    for p in range(30):
        mine = sorted((x for x in rows if x[0] == p), key=lambda x: (-x[3], x[5] is None, x[5] or 0, x[1]))
        out, i = [], 0
        while i < len(mine):
            j = i + 1
            while j < len(mine) and mine[j][2] == mine[i][2] and round(mine[i][3] - mine[j][3], 9) <= 0.02 and (mine[i][4] is None or mine[j][4] is None or abs(mine[i][4] - mine[j][4]) <= 0.03):
                j += 1
            out += sorted(mine[i:j], key=lambda x: (x[5] if x[5] is not None else 1 << 31, x[1]))
            i = j
        assert [found[p, x[1]] for x in out] == list(range(1, len(out) + 1))


def test_records_resolve_against_a_catalog(spark):
    people = spark.createDataFrame([("a", "Captain Science", "1", 1, 1950, "Youthful", 36, None), ("b", "Nobody", "9", 9, 1999, None, None, None)], "path string, series string, issue string, issue_int long, year int, publisher string, pages int, volume int")
    catalog = spark.createDataFrame([(1, "Captain Science", "1", 1950, "Youthful Comics", 36, 7), (2, "Captain Silence", "1", 1950, "Other", 20, 8), (3, "Captain Science", "2", 1950, "Youthful", 36, 7)], "issue_id long, series string, issue string, year int, publisher string, pages int, volume int")
    found = {r.path: r for r in resolve.resolutions(people, resolve.score(resolve.candidates(people, catalog))).collect()}
    assert (found["a"].resolution, found["a"].issue_id) == ("AUTO_WRITE", 1) and found["b"].resolution == "NO_MATCH"
    assert match.Policy(mode="ask") != match.Policy() and resolve.policies(match.Policy(), {"x": {"mode": "ask", "margin": None}})["x"].mode == "ask"


def test_reprints_consolidate(spark):
    rows = spark.sql("SELECT array(named_struct('s', 'A', 'n', CAST(NULL AS STRING)), named_struct('s', 'a', 'n', '1'), named_struct('s', 'B', 'n', '1')) AS r")
    assert [tuple(x) for x in rows.select(lookup.consolidate(F.col("r"), ["s", "n"]).alias("r")).first().r] == [("A", "1"), ("B", "1")]


def test_validation(spark):
    rows = [("a", "comic_info", COMIC_INFO.replace("<Unknown>x</Unknown>", "")), ("u", "comic_info", COMIC_INFO), ("b", "comic_info", "<ComicInfo><CommunityRating>7</CommunityRating></ComicInfo>"), ("c", "comic_info", "no xml"), ("d", "page_list", "anything"), ("f", "comet", "anything"), ("e", "comic_book_info", INFO_JSON.replace("84", "8"))]
    found = {r.path: r.valid for r in validate.validate(spark.createDataFrame(rows, "path string, fmt string, payload string")).collect()}
    assert found == {"a": True, "u": False, "b": False, "c": False, "d": True, "e": True, "f": False}


def test_page_slices(spark):
    pages = F.array(*[F.lit(i) for i in range(5)])
    row = spark.range(1).select(evaluate.page_slice(pages, 1, 3).alias("a"), evaluate.page_slice(pages, 3, None).alias("b"), evaluate.page_slice(pages, 4, 2).alias("c")).first()
    assert (row.a, row.b, row.c) == ([1, 2, 3], [3, 4], [])


def test_settings():
    s = config.layered({"read": "a,b", "margin": "0.2"}, env={"SPARKFOLD_MARGIN": "0.3"}, args={"read": None, "dry_run": True})
    assert s.read == ("a", "b") and s.margin == 0.3 and s.dry_run
    with pytest.raises(ValueError):
        config.layered({"nope": 1}, env={})
    assert config.ttl_seconds("7d") == 604800 and config.page_range("2:") == (2, None) and config.page_range("4") == (4, 4) and config.page_range("") is None
    assert config.redact("x?api_key=abc&b=1 secret", ["secret"]) == "x?api_key=***&b=1 ***" and config.masked("abcdefghij") == "ab***"
    assert config.formats_to_read(config.layered({"read_except": "b"}, env={}), ["a", "b", "c"]) == ["a", "c"]
