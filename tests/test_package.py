"""The package on workers that don't have it, and edges of the interface."""

from __future__ import annotations

import os
import subprocess
import sys
import textwrap

import pytest

from sparkfold.api import RAW, Collection
from sparkfold.operators import lookup

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_get_the_package(tmp_path):
    """A program that finds the package only through its own path, from another folder."""
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession, functions as F
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        from sparkfold.functions import similarity
        from sparkfold.functions.shared import ship_package
        assert ship_package(spark) == ship_package(spark)
        print(spark.range(3).select(similarity.ratio_udf(F.lit("ab"), F.lit("abc")).alias("r")).first().r)
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.strip() == "80.0", done.stderr[-2000:]


def test_unknown_modes_and_empty_patches_are_refused(spark):
    found = Collection(spark, spark.createDataFrame([("a", "s", "comic_info", 0, "<ComicInfo/>")], RAW))
    with pytest.raises(ValueError, match="xyz"):
        found.payloads(("comic_info",), mode="xyz")
    with pytest.raises(ValueError, match="no rows"):
        found.write("/nowhere", ("comic_info",), patch=spark.createDataFrame([], RAW))


def test_what_counts_as_small(spark, monkeypatch):
    few = spark.range(10).selectExpr("id", "repeat('x', 100) AS text")
    hinted = lambda f: "broadcast" in f._jdf.queryExecution().logical().toString().lower()
    assert hinted(lookup.small(few)) and hinted(lookup.small(few.limit(0)))
    monkeypatch.setattr(lookup, "SMALL_TEXT", 500)
    assert not hinted(lookup.small(few))
    monkeypatch.setattr(lookup, "SMALL", 5)
    assert not hinted(lookup.small(few))
