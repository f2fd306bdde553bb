"""Command line: ``python -m sparkfold FOLDER [options]`` reads containers, prints, exports, extracts, renames, resolves, validates and writes."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .api import Collection
from .config import layered, load_yaml

PHASES = ["raw", "normalized", "merged", "records", "covers", "names", "validated"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkfold", description=__doc__)
    p.add_argument("folder")
    p.add_argument("-c", "--config", help="settings file (YAML)")
    p.add_argument("-r", "--recurse", action="store_true", default=None)
    p.add_argument("-n", "--dry-run", action="store_true", default=None)
    p.add_argument("-d", "--dest-path")
    p.add_argument("-m", "--metadata", action="append", default=[], help="one-line document for every container, above all others")
    p.add_argument("-i", "--import", dest="imports", action="append", default=[], help="document file for every container")
    p.add_argument("-D", "--delete-keys")
    p.add_argument("--delete-all-tags", action="store_true", default=None)
    p.add_argument("--delete-orig", dest="delete_original", action="store_true", default=None)
    p.add_argument("--read")
    p.add_argument("--read-except")
    p.add_argument("--mode", choices=["additive", "replace", "update"])
    p.add_argument("-R", "--replace", action="store_true", help="short for --mode replace")
    p.add_argument("--stamp", action="store_true", default=None, help="leave tagger, time and note in what is written")
    p.add_argument("-p", "--print", dest="phase", choices=PHASES)
    p.add_argument("--export", help="formats to export to the destination")
    p.add_argument("-e", "--extract-pages", dest="pages", help="range of pages such as 0:3 to extract to the destination")
    p.add_argument("-o", "--extract-covers", action="store_true")
    p.add_argument("--rename", action="store_true", help="rename the containers after their records")
    p.add_argument("--validate", action="store_true")
    p.add_argument("--cbz", action="store_true", help="write zips with the formats of --write to the destination")
    p.add_argument("-w", "--write")
    p.add_argument("--stop-on-error", action="store_true", default=None)
    p.add_argument("--online", metavar="CATALOG", help="Parquet table of catalog entries to resolve the records against")
    p.add_argument("--sources", help="catalogs in order of precedence")
    p.add_argument("--match", choices=["ask", "careful", "auto", "eager"])
    p.add_argument("--effort", choices=["minimal", "balanced", "thorough", "auto"])
    p.add_argument("--no-prompts", dest="prompts", action="store_false", default=None)
    return p


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    names = ("recurse", "dry_run", "dest_path", "delete_keys", "delete_all_tags", "delete_original", "read", "read_except", "mode", "export", "write", "stamp", "stop_on_error", "sources", "match", "effort", "prompts", "pages")
    if args["replace"]:
        args["mode"] = "replace"
    settings = layered(load_yaml(args["config"]) if args["config"] else {}, args={n: args[n] for n in names})
    spark = SparkSession.builder.appName("sparkfold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    extra = [("cli", "native_line", text) for text in args["metadata"]]
    for path in args["imports"]:  # a few small files
        row = Collection(spark, None, settings).add_files(path).raw.first()
        extra.append(("import_file", row.fmt or "native_yaml", row.payload))
    found = Collection.from_archives(spark, args["folder"], settings, tuple(extra))
    if args["phase"]:
        found.phase(args["phase"]).show(100, truncate=False)
    if args["validate"]:
        found.validate().show(100, truncate=False)
    tables = []
    if settings.export:
        tables.append(found.export(settings.dest_path, *settings.export))
    if args["pages"] is not None:
        tables.append(found.extract_pages(settings.dest_path))
    if args["extract_covers"]:
        tables.append(found.extract_covers(settings.dest_path))
    if args["online"]:
        tables.append(found.resolve(spark.read.parquet(args["online"])))
    if args["cbz"] or settings.delete_all_tags:
        tables.append(found.write(settings.dest_path))
    if args["rename"]:
        tables.append(found.rename())
    for table in tables:
        table.show(100, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
