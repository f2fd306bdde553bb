"""Catalogs that are code (E05, F11): a source of candidates as a table function.

A source names its fields and gives, for a profile, the entries that may be meant, and for a volume and an issue
the one entry.  It runs as an Arrow table function over the table of profiles, dealt out by profile.  What it finds
is a table like any catalog, so it is scored and resolved like one.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.numbers import RATE_LIMIT_SCHEDULE
from . import online as O
from .fold import to_arrow_type

#: Columns of a profile that a source may look at.
PROFILE = ("series", "issue", "issue_int", "year", "publisher", "pages", "volume")
#: Candidates that are handed on together.
TOGETHER = 1000


class CodeSource:
    """A catalog that is code; a subclass sets ``name`` and ``fields`` and overrides ``search``.  It travels to the workers."""

    name = "source"
    #: Fields of an entry, as DDL; a table for ``resolve`` has issue_id, series, issue, year, publisher, pages and volume.
    fields = "issue_id bigint, series string, issue string, year int, publisher string, pages int, volume bigint"

    def configured(self) -> bool:
        """Whether it has all that it needs, such as credentials; a source that has not gives nothing."""
        return True

    def search(self, profile: dict) -> Iterable[dict]:
        """Entries that a profile may mean."""
        raise NotImplementedError

    def wait(self, seconds: float) -> None:
        """Called before another try."""
        time.sleep(seconds)

    def lookup(self, volume: int, issue: str | None) -> dict | None:
        """The entry of an issue of a known volume; None where the source cannot tell or does not know."""
        return None


def failure_of(problem: Exception) -> str:
    """rate_limit, transient or permanent, by a ``status`` of the error or else by what it says."""
    status, text = getattr(problem, "status", None), str(problem).lower()
    if status in O.RATE_STATUS or "rate limit" in text:
        return "rate_limit"
    again = status in O.TRANSIENT_STATUS or re.search("timed? ?out|connection (?:reset|refused|aborted)", text)
    return "transient" if again else "permanent"


def persistent(source: CodeSource, profile: dict) -> list[dict]:
    """The entries of a profile; a failure that may pass is tried again, each time after a longer wait."""
    tries = {"rate_limit": O.RATE_TRIES, "transient": O.TRANSIENT_TRIES, "permanent": 1}
    attempt = 1
    while True:
        try:
            return list(source.search(profile))
        except Exception as problem:
            kind = failure_of(problem)
            if attempt >= tries[kind]:
                raise
            # The waiting times of both kinds
            source.wait(RATE_LIMIT_SCHEDULE[min(attempt, len(RATE_LIMIT_SCHEDULE)) - 1] if kind == "rate_limit" else min(60, 2**attempt))
            attempt += 1


def search_function(source: CodeSource, key: StructField):
    """The table function of a source: (TABLE of profiles) -> key, the fields, error; ``spark.udtf.register`` gives it to SQL."""
    fields, name = StructType.fromDDL(source.fields), key.name

    class Search:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            if not source.configured():
                return
            shape = pa.schema([pa.field(name, batch.schema.field(name).type), *[pa.field(f.name, to_arrow_type(f.dataType)) for f in fields.fields], pa.field("error", pa.string())])
            known, found = [c for c in PROFILE if c in batch.schema.names], []
            for row in batch.select([name, *known]).to_pylist():
                mine = row.pop(name)
                try:
                    found += [{**{f.name: entry.get(f.name) for f in fields.fields}, name: mine, "error": None} for entry in persistent(source, row)]
                except Exception as problem:  # one profile that a source cannot take must not end the others
                    found.append({name: mine, "error": f"{type(problem).__name__}: {problem}"})
                if len(found) >= TOGETHER:
                    yield pa.Table.from_pylist(found, schema=shape)
                    found = []
            if found:
                yield pa.Table.from_pylist(found, schema=shape)

    return F.arrow_udtf(Search, returnType=StructType([key, *fields.fields, StructField("error", StringType())]))


def search(people: DataFrame, source: CodeSource, key: str = "path") -> DataFrame:
    """Key, source, the fields of the entries, error; one row for each candidate of each profile, or for its failure."""
    if key not in people.columns:
        raise ValueError(f"the profiles have no column {key}")
    columns = [key, *[c for c in PROFILE if c in people.columns]]
    found = search_function(source, people.schema[key])(people.select(*columns).asTable().partitionBy(key))
    return found.withColumn("source", F.lit(source.name))


def search_in_turn(people: DataFrame, sources: list[CodeSource], key: str = "path") -> DataFrame:
    """the candidates of the first source, in their order, that has any for a profile."""
    found = None
    for i, source in enumerate(sources):
        rows = search(people, source, key).where("error IS NULL").withColumn("turn", F.lit(i))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    first = found.groupBy(key).agg(F.min("turn").alias("first"))
    return found.join(first, key).where("turn = first").drop("first", "turn")


def as_catalog(found: DataFrame) -> DataFrame:
    """What sources have found, as a catalog for ``resolve``; an entry that several profiles have met is one row."""
    return found.where("error IS NULL").drop("path", "error").dropDuplicates(["source", "issue_id"])
