"""Collections of containers: one scan, error rows, writing, extraction, renaming, resolution and the command line."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfold.__main__ import main
from sparkfold.api import RAW, Collection
from sparkfold.config import Settings
from sparkfold.operators import derive, match, resolve, shape
from sparkfold.sources import archives, images, sinks

FEW = Settings(read=("comic_info", "filename", "native_line"))


def box(path, documents: dict[str, str], pages: int = 2, comment: str = "") -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        for i in range(pages):
            z.writestr(f"p{i}.jpg", f"page {i}")
        for name, text in documents.items():
            z.writestr(name, text)
        z.comment = comment.encode()


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "in"
    box(root / "a/x.cbz", {"ComicInfo.xml": "<ComicInfo><Series>One</Series><Number>1</Number><Year>1990</Year></ComicInfo>"}, 3)
    box(root / "b/x.cbz", {"ComicInfo.xml": "<ComicInfo><Series>Two</Series><Number>2</Number></ComicInfo>"})
    return root


def test_records_come_from_one_scan(spark, folder):
    rows = Collection.from_archives(spark, f"file://{folder}", FEW).records()
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Relation") == 1
    assert {r.record.series.name: r.record.page_count for r in rows.collect()} == {"One": 3, "Two": 2}


def test_page_images_are_not_decompressed(spark, folder):
    listed = archives.listing(spark, f"file://{folder}").select(F.explode("members").alias("m")).select("m.*").collect()
    assert {r.name for r in listed if r.content is not None} == {"ComicInfo.xml"} and len(listed) == 7


def test_damaged_containers_are_error_rows(spark, tmp_path):
    good, out = io.BytesIO(), tmp_path / "in"
    with zipfile.ZipFile(good, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ComicInfo.xml", "<ComicInfo><Series>" + "x" * 500 + "</Series></ComicInfo>")
        z.writestr("p.jpg", "page")
    data = bytearray(good.getvalue())
    out.mkdir()
    stream = bytearray(data)
    at = stream.index(b"ComicInfo.xml") + len("ComicInfo.xml")
    stream[at : at + 8] = b"\xff" * 8  # a damaged deflate stream
    (out / "stream.cbz").write_bytes(stream)
    method = bytearray(data)
    for mark, place in ((b"PK\x03\x04", 8), (b"PK\x01\x02", 10)):
        method[method.index(mark) + place : method.index(mark) + place + 2] = struct.pack("<H", 97)
    (out / "method.cbz").write_bytes(method)
    locked = bytearray(data)
    for mark, place in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(mark) + place] |= 1
    (out / "locked.cbz").write_bytes(locked)
    (out / "short.cbz").write_bytes(data[:-30])
    rows = {r.path.rpartition("/")[2]: r for r in archives.listing(spark, f"file://{out}").collect()}
    assert rows["short.cbz"].error and not rows["stream.cbz"].error
    for name in ("stream", "method", "locked"):
        members = {m.name: m for m in rows[f"{name}.cbz"].members}
        assert members["ComicInfo.xml"].error and not members["p.jpg"].error
    found = Collection.from_archives(spark, f"file://{out}", FEW).read().collect()
    assert len(found) == 4 and sum(r.error is not None for r in found) == 1


def test_equal_base_names_do_not_meet(spark, folder, tmp_path):
    found = Collection.from_archives(spark, f"file://{folder}", FEW)
    done = found.write(str(tmp_path / "out")).collect()
    assert sorted(r.target.removeprefix(f"{tmp_path}/out/") for r in done) == ["a/x.cbz", "b/x.cbz"] and all(r.written for r in done)
    box(folder / "a/x.cbt.cbz", {})
    same = spark.createDataFrame([(f"file:{folder}/a/x.cbz", bytearray(b"")), (f"file:{folder}/a/x.cbt", bytearray(b""))], "path string, content binary").withColumn("documents", F.create_map(F.lit("a"), F.lit("b")))
    clash = sinks.write_archives(same, str(tmp_path / "out2"), f"file://{folder}").collect()
    assert all("other files have the target" in r.error for r in clash)


@pytest.mark.parametrize("mode, genres", [("additive", "A,B"), ("update", "B")])
def test_patches_by_mode(spark, tmp_path, mode, genres):
    box(tmp_path / "in/x.cbz", {"ComicInfo.xml": "<ComicInfo><Series>S</Series><Genre>A</Genre></ComicInfo>"}, comment="kept?")
    found = Collection.from_archives(spark, f"file://{tmp_path}/in", FEW)
    path = found.listing.first().path
    patch = spark.createDataFrame([(path, "api", "comic_info", 0, "<ComicInfo><Genre>B</Genre><Title>T</Title></ComicInfo>")], RAW)
    dry = Collection(spark, found.raw, Settings(read=FEW.read, dry_run=True), found.listing, found.folder)
    assert dry.write(str(tmp_path / "none"), (), patch, mode).first().written is False and not (tmp_path / "none").exists()
    text = found.payloads(("comic_info",), patch, mode, ("title",)).first().documents["ComicInfo.xml"]
    assert f"<Genre>{genres}</Genre>" in text and "<Series>S</Series>" in text and "<Title>" not in text
    done = found.write(str(tmp_path / "out"), (), patch, mode).first()
    with zipfile.ZipFile(done.target) as z:
        assert sorted(z.namelist()) == ["ComicInfo.xml", "p0.jpg", "p1.jpg"] and z.comment == b"kept?" and z.getinfo("p0.jpg").compress_type == zipfile.ZIP_STORED


def test_exports_keep_their_records_apart(spark, folder, tmp_path):
    done = Collection.from_archives(spark, f"file://{folder}", FEW).export(str(tmp_path / "out"), "comic_info").collect()
    assert len(done) == 2 and "<Series>Two</Series>" in (tmp_path / "out/b/x/ComicInfo.xml").read_text()


def test_names_are_not_replaced(spark, tmp_path):
    for name in ("one.cbz", "two.cbz"):
        box(tmp_path / "in" / name, {"ComicInfo.xml": "<ComicInfo><Series>Same</Series><Number>1</Number></ComicInfo>"})
    box(tmp_path / "in/three.cbz", {"ComicInfo.xml": "<ComicInfo><Series>Own</Series><Number>1</Number></ComicInfo>"})
    done = Collection.from_archives(spark, f"file://{tmp_path}/in", FEW).rename().collect()
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == ["Own #001.cbz", "one.cbz", "two.cbz"]
    assert sum(r.written for r in done) == 1 and sum("other files" in (r.error or "") for r in done) == 2


def test_pages_and_covers_are_extracted(spark, folder, tmp_path):
    found = Collection.from_archives(spark, f"file://{folder}", FEW)
    assert sorted(r.target.removeprefix(f"{tmp_path}/p/") for r in found.extract_pages(str(tmp_path / "p"), "1:").collect()) == ["a/x/p1.jpg", "a/x/p2.jpg", "b/x/p1.jpg"]
    assert sorted(r.target.removeprefix(f"{tmp_path}/c/") for r in found.extract_covers(str(tmp_path / "c")).collect()) == ["a/x/p0.jpg", "b/x/p0.jpg"]
    assert (tmp_path / "c/a/x/p0.jpg").read_text() == "page 0"


def test_command_line(spark, folder, tmp_path, capsys):
    assert main([str(folder), "-m", "title: From the line", "--read", "comic_info,native_line", "--cbz", "-d", str(tmp_path / "out"), "-p", "names", "--stamp"]) == 0
    with zipfile.ZipFile(tmp_path / "out/a/x.cbz") as z:
        text = z.read("ComicInfo.xml").decode()
    assert "<Title>From the line</Title>" in text and "Tagged with sparkfold on" in text and "One #001" in capsys.readouterr().out


def test_decisions_caches_and_covers(spark):
    catalog = spark.createDataFrame([(1, "Alpha Beta", "1", 1990, None, None, 5, "ff00ff00ff00ff00"), (2, "Alpha Beta", "1", 1990, None, None, 6, "00ff00ff00ff00ff")], "issue_id long, series string, issue string, year int, publisher string, pages int, volume long, cover_hash string")
    people = spark.createDataFrame([("a", "Alpha Beta", "1", 1, 1990, None, None, None)], "path string, series string, issue string, issue_int long, year int, publisher string, pages int, volume int")
    asked = resolve.run(people, catalog, {}, match.Policy()).first()
    assert asked.resolution == "PROMPT"
    chosen = resolve.run(people, catalog, {}, match.Policy(), decisions=spark.createDataFrame([("alpha beta|1990|", 6)], "fingerprint string, volume_id long")).first()
    assert (chosen.resolution, chosen.issue_id) == ("DECIDED", 2)
    cached = resolve.run(people, catalog, {}, match.Policy(), cache=spark.createDataFrame([("alpha beta|1990|", 5)], "fingerprint string, volume_id long")).first()
    assert (cached.resolution, cached.issue_id) == ("CACHED", 1)
    covers = spark.createDataFrame([("a", "00ff00ff00ff00ff")], "path string, cover_hash string")
    found = resolve.run(people, catalog, {}, match.Policy(margin=0.1), covers=covers).first()
    assert (found.resolution, found.issue_id) == ("AUTO_WRITE", 2)


def test_stamps_and_nested_urls(spark):
    r = spark.sql("SELECT map('comicvine', named_struct('key', '5', 'url', CAST(NULL AS string)), 'metron', named_struct('key', '7', 'url', CAST(NULL AS string))) AS ids")
    note = r.select(derive.stamp(F.lit("me"), F.lit("2024-01-02").cast("timestamp"), F.col("ids")).alias("n")).first().n
    assert note == "Tagged with me on 2024-01-02T00:00:00Z [Issue ID 5] urn:comicvine:issue:5 urn:metron:issue:7"
    rows = Collection(spark, spark.createDataFrame([("a", "api", "metron_info", 0, '<MetronInfo><IDS><ID source="Metron" primary="true">9</ID></IDS><Arcs><Arc id="3"><Name>A</Name></Arc></Arcs></MetronInfo>')], RAW), Settings(read=("metron_info",), compute_pages=False)).records()
    assert rows.first().record.arcs["A"].identifiers["metron"].url == "https://metron.cloud/arc/3"


def test_lists_are_sorted_and_distinct(spark):
    rows = spark.sql("SELECT array(named_struct('a', 'y', 'n', 1), named_struct('a', CAST(NULL AS string), 'n', 2), named_struct('a', 'x', 'n', 3), named_struct('a', 'y', 'n', 4)) AS v")
    once, all_ = rows.select(shape.sorted_list(F.col("v"), ("a",)).alias("x"), shape.sorted_list(F.col("v"), ("a",), False).alias("y")).first()
    assert [e.n for e in once] == [2, 3, 1] and [e.n for e in all_] == [2, 3, 1, 4]


def _png(pixels: np.ndarray) -> bytes:
    """A PNG of pixels [height, width, 3]: red, green and blue."""
    height, width, _ = pixels.shape
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunks = ((b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(lines)), (b"IEND", b""))
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in chunks)


def _drawing(seed: int, height: int, width: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width] / np.array([height, width])[:, None, None]
    waves = [np.sin(r.uniform(2, 9) * x + r.uniform(2, 9) * y + r.uniform(0, 6)) for _ in range(3)]
    return np.stack([(w + 1) * 127 for w in waves], axis=2).astype(np.uint8)


def test_cover_hashes_survive_another_size(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for name, pixels in {"a": _drawing(1, 90, 61), "b": _drawing(1, 240, 170), "c": _drawing(2, 90, 61), "d": None}.items():
        with zipfile.ZipFile(root / f"{name}.cbz", "w") as z:
            z.writestr("0.png", b"no picture" if pixels is None else _png(pixels))
    found = Collection.from_archives(spark, f"file://{root}", FEW).cover_hashes(str(tmp_path / "covers"))
    hashes = {r.path.rpartition("/")[2][0]: int(r.cover_hash, 16) for r in found.collect()}
    assert sorted(hashes) == ["a", "b", "c"]  # what is no picture has no hash
    assert (hashes["a"] ^ hashes["b"]).bit_count() <= 4 < 16 < (hashes["a"] ^ hashes["c"]).bit_count()


def test_cosines_and_reduction_against_their_definitions():
    assert np.allclose(images.reduction(32), np.eye(32)) and np.allclose(images.reduction(100).sum(axis=1), 1)
    flat = images.reduction(77) @ np.full(77, 9.0)
    assert np.allclose(flat, 9)
    pixels = np.random.default_rng(5).integers(0, 256, (32, 32, 1)).astype(np.uint8)
    low = [[sum(int(pixels[y, x, 0]) * np.cos(np.pi * b * (2 * y + 1) / 64) * np.cos(np.pi * a * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for a in range(8)] for b in range(8)]
    bits = "".join("1" if v > np.median(low) else "0" for row in low for v in row)
    assert images.perceptual_hash(pixels) == f"{int(bits, 2):016x}"
