"""Folders of many files: the driver holds no file, the number of tasks doesn't follow that of files, workers open what they need."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from sparkfold.api import Collection
from sparkfold.config import Settings
from sparkfold.plans import fixtures
from sparkfold.sources import archives, sinks

FEW = Settings(read=("comic_info", "filename"))


@pytest.fixture()
def many(tmp_path):
    for i in range(300):
        at = tmp_path / "in" / ("flat" if i < 200 else f"deep{i}/below") / f"x{i}.cbz"
        at.parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(at, "w") as z:
            z.writestr("p0.jpg", "page")
            z.writestr("ComicInfo.xml", f"<ComicInfo><Series>S{i}</Series></ComicInfo>")
    for name in ("_hidden.cbz", ".hidden.cbz", "other.txt"):
        (tmp_path / "in" / name).write_text("")
    return tmp_path


def test_driver_holds_no_file(spark, many):
    found = archives.listing(spark, f"file://{many}/in")
    assert not found.inputFiles() and found.rdd.getNumPartitions() <= max(4 * spark.sparkContext.defaultParallelism, 4)
    source = archives.container_files(spark, f"file://{many}/in")
    assert sorted(r.path for r in found.select("path").collect()) == sorted(r.path for r in source.select("path").collect())
    assert {(r.path, r.m) for r in found.select("path", F.col("modified").alias("m")).collect()} == {(r.path, r.m) for r in source.select("path", F.col("modificationTime").alias("m")).collect()}


def test_parts_of_a_wide_folder_hold_each_file_once(many, monkeypatch):
    monkeypatch.setattr(archives, "FOLDERS", 8)
    parts = archives._folders(f"{many}/in")
    names = [n for p in parts for n in archives._names(*p)]
    assert len(parts) <= 17 and len(names) == len(set(names)) == 301  # the text file as well


def test_sinks_make_rows_once_and_shuffle_no_content(spark, many):
    found = Collection.from_archives(spark, f"file://{many}/in", FEW)
    done = found.write(str(many / "out"))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "content#" not in plan.split("target#")[0] and plan.count("binaryFile") == 0
    assert done.where("written").count() == 300
    pages = found.extract_pages(str(many / "pages"))
    assert "binaryFile" not in pages._jdf.queryExecution().optimizedPlan().toString() and pages.where("written").count() == 300


def test_missing_files_are_error_rows(spark, many):
    rows = spark.createDataFrame([(f"file:{many}/in/none.cbz",)], "path string").withColumn("documents", F.create_map(F.lit("a"), F.lit("b")))
    done = sinks.write_archives(rows, str(many / "out"), f"file://{many}/in").first()
    assert not done.written and "FileNotFoundError" in done.error


def test_containers_are_built_by_several_tasks(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    assert part.rdd.getNumPartitions() == 1 < fixtures._dealt(part).rdd.getNumPartitions()
    built = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(fixtures.pictures(lambda name: part))
    assert built.count() == part.count()
