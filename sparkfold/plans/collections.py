"""Queries of sources and sinks: containers are built from parts, read, patched, written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..api import Collection
from ..config import Settings, formats_to_write
from ..functions.shared import shared_folder
from ..operators import derive as R
from ..sources import archives as A
from ..sources import documents as D
from ..sources import images as I
from ..sources import sinks as K
from .fixtures import BOX, EDGE, FORMATS, PIXEL, containers, file_of, key_of, pictures
from .registry import query


def _collection(t, **changes) -> Collection:
    from dataclasses import replace

    spark = t("part").sparkSession
    return Collection.from_archives(spark, containers(t), replace(FORMATS, **changes))


def _local(t) -> str:
    """A new folder that the workers can write to."""
    return shared_folder(t("part").sparkSession).removeprefix("file://").removeprefix("file:")


@query(f"""WITH {BOX} SELECT file, kind AS file_type, CAST(CASE WHEN kind = 'PDF' THEN n ELSE n + 1 END AS INTEGER) AS members, CASE WHEN kind = 'PDF' THEN '0' ELSE 'ComicInfo.xml' END AS first,
CASE WHEN kind <> 'PDF' THEN CAST(n * (length(CAST(p_partkey AS VARCHAR)) + 2) AS BIGINT) END AS page_bytes FROM box WHERE kind IN ('CBZ', 'CBT', 'PDF')""")
def s02_s05_s06_s08_members(t):
    """Members of zips, tars and PDFs, sorted without regard to case."""
    rows = A.listing(t("part").sparkSession, containers(t)).where("error IS NULL")
    images = F.filter("members", lambda m: m["name"].endswith(".jpg"))
    total = F.when(F.col("file_type") != "PDF", F.aggregate(images, F.lit(0).cast("bigint"), lambda s, m: s + m["size"]))
    return rows.select(file_of().alias("file"), "file_type", F.size("members").alias("members"), F.get("members", F.lit(0))["name"].alias("first"), total.alias("page_bytes"))


@query(f"WITH {BOX} SELECT file, CASE kind WHEN 'BAD' THEN 'CBZ' ELSE kind END AS file_type, kind = 'BAD' AS damaged FROM box WHERE kind IN ('BAD', 'CBR')")
def s03_s04_unreadable_containers(t):
    """What cannot be read is a row with an error; RAR and 7Z are such."""
    rows = A.listing(t("part").sparkSession, containers(t)).where("error IS NOT NULL")
    return rows.select(file_of().alias("file"), "file_type", (~F.col("error").contains("cannot read")).alias("damaged"))


@query(f"WITH {BOX} SELECT file, CASE WHEN kind = 'CBZ' AND p_partkey % 2 = 0 THEN CAST(length('{{\"ComicBookInfo/1.0\":{{\"genre\":\"Drama\",\"publisher\":\"Other\"}}}}') AS INTEGER) END AS comment, p_name AS series FROM box WHERE kind IN ('CBZ', 'CBT')")
def s09_s10_p09_content_and_comment(t):
    """The bytes of the metadata member and the comment; no other content is taken out."""
    rows = A.listing(t("part").sparkSession, containers(t)).where("file_type IN ('CBZ', 'CBT') AND error IS NULL")
    taken = F.filter("members", lambda m: m["content"].isNotNull())
    text = F.decode(F.get(taken, F.lit(0))["content"], "UTF-8")
    return rows.where(F.size(taken) == 1).select(file_of().alias("file"), F.length("comment").alias("comment"), F.regexp_extract(text, "<Series>(.*)</Series>", 1).alias("series"))


@query(f"""WITH {BOX} SELECT source, fmt, count(*) AS n FROM (SELECT 'archive_filename' AS source, 'filename' AS fmt FROM box UNION ALL SELECT 'archive_file', 'comic_info' FROM box WHERE kind IN ('CBZ', 'CBT') UNION ALL
SELECT 'archive_comment', 'comic_book_info' FROM box WHERE kind = 'CBZ' AND p_partkey % 2 = 0 UNION ALL SELECT 'archive_pdf', 'mupdf' FROM box WHERE kind = 'PDF' UNION ALL SELECT 'archive_pages', 'page_list' FROM box WHERE kind IN ('CBZ', 'CBT', 'PDF')) GROUP BY ALL""")
def s14_s15_s16_documents_by_source(t):
    return _collection(t).raw.groupBy("source", "fmt").agg(F.count("*").alias("n"))


@query(f"WITH {BOX} SELECT file, CASE p_partkey WHEN 40 THEN 'From the API' ELSE 'From all' END AS title, 12 AS issues FROM box WHERE kind = 'CBZ'")
def s11_s12_s18_further_documents(t):
    """A one-line document for all containers, without braces and root, and one of the API for one of them."""
    found = Collection.from_archives(t("part").sparkSession, containers(t), FORMATS, (("cli", "native_line", "title: From all, volume: {issue_count: 12}"),))
    one = f"{containers(t)}/g0/p40.cbz".replace("file://", "file:")
    rows = found.add(one, "<ComicInfo><Title>From the API</Title></ComicInfo>", "api", "comic_info").records()
    return rows.where(file_of() != "").where("path LIKE '%.cbz'").where("record.series IS NOT NULL AND record.issue IS NOT NULL AND record.publisher IS NOT NULL").select(file_of().alias("file"), F.col("record.title").alias("title"), F.col("record.volume.issue_count").alias("issues"))


@query("SELECT n_name AS name, n_comment AS fmt, n_nationkey AS issue FROM (SELECT 'n' || n_nationkey AS n_name, CASE n_nationkey % 2 WHEN 0 THEN 'comic_info' ELSE 'native_json' END AS n_comment, CAST(n_nationkey AS INTEGER) AS n_nationkey FROM nation)")
def s13_import_files(t):
    """Text files whose names tell their formats."""
    nation = t("nation")
    folder = _local(t)
    xml = F.concat(F.lit("<ComicInfo><Number>"), "n_nationkey", F.lit("</Number></ComicInfo>"))
    text = F.concat(F.lit(f'{{"{D.NATIVE_ROOT}": {{"issue": {{"name": "'), "n_nationkey", F.lit('"}}}'))
    even = F.col("n_nationkey") % 2 == 0
    rows = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("path"), F.when(even, xml).alias("comic_info"), F.when(~even, text).alias("native_json"))
    K.export(rows, folder, "", ["comic_info", "native_json"]).collect()
    found = Collection(nation.sparkSession, None, Settings(recurse=True, read=("comic_info", "native_json"), compute_pages=False)).add_files(f"file://{folder}")
    return found.normalized().select(F.element_at(F.split("path", "/"), -2).alias("name"), "fmt", F.col("record.issue.name").cast("int").alias("issue"))


@query(f"WITH {BOX} SELECT regexp_extract(file, '[a-z0-9]+$') AS suffix, count(*) AS n FROM box GROUP BY 1")
def s21_l07_expanded_paths(t):
    """All containers below the folder, however deep; a sorted listing numbers them."""
    from ..operators.evaluate import global_places

    files = A.container_paths(t("part").sparkSession, containers(t))
    placed = global_places(files, ["path"])
    return placed.groupBy(F.regexp_extract("path", "([a-z0-9]+)$", 1).alias("suffix")).agg(F.count_if(F.col("place") > 0).alias("n"))


@query(f"WITH {BOX} SELECT CASE WHEN kind IN ('BAD', 'CBR') THEN 'error' WHEN p_partkey % 3 = 0 THEN 'skipped' ELSE 'read' END AS state, count(*) AS n, count(DISTINCT CASE WHEN kind IN ('CBZ', 'CBT') AND p_partkey % 3 > 0 THEN p_name END) AS series FROM box GROUP BY 1")
def s22_s23_bulk_read(t):
    """One row a container: read, skipped because it is not newer, or with its error."""
    found = _collection(t)
    old = found.listing.select("path", F.when(key_of() % 3 == 0, F.lit("2100-01-01")).otherwise(F.lit("1980-01-01")).cast("timestamp").alias("old"))
    state = F.when(F.col("error").isNotNull(), "error").when(~F.col("fresh"), "skipped").otherwise("read")
    return found.read(old).groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.count_distinct(F.when(file_of().rlike("cb[zt]$"), F.col("record.series.name"))).alias("series"))


@query(f"WITH {BOX} SELECT file, p_name AS series, CAST(p_size AS VARCHAR) AS issue, p_brand AS publisher, CASE WHEN kind = 'CBZ' AND p_partkey % 2 = 0 THEN 'Drama' END AS genre, CAST(n AS INTEGER) AS pages, CAST(p_size % 4 AS INTEGER) AS cover FROM box WHERE kind IN ('CBZ', 'CBT')")
def c02_records_of_containers(t):
    """Whole records: the comment gives the genre, the pages are counted, one beyond the last is dropped."""
    r = F.col("record")
    rows = _collection(t).records().where("path RLIKE 'cb[zt]$' AND record.publisher IS NOT NULL")
    covers = F.map_keys(F.map_filter(r["pages"], lambda k, v: v["page_type"] == "FrontCover"))
    return rows.where(F.size(r["pages"]) == r["page_count"]).select(file_of().alias("file"), r["series"]["name"].alias("series"), r["issue"]["name"].alias("issue"), r["publisher"]["name"].alias("publisher"), F.get(F.map_keys(r["genres"]), F.lit(0)).alias("genre"), r["page_count"].alias("pages"), F.get(covers, F.lit(0)).alias("cover"))


@query(f"WITH {BOX} SELECT file, '<Series>' || p_name || '</Series>' AS series, p_brand AS publisher FROM box WHERE kind IN ('CBZ', 'CBT')")
def k01_k02_k14_payloads(t):
    """What would be written, by member name."""
    found = _collection(t).payloads(("comic_info", "native_json")).where("path RLIKE 'cb[zt]$'")
    xml, native = F.col("documents")["ComicInfo.xml"], F.from_json(F.col("documents")["record.json"], f"{D.NATIVE_ROOT} struct<publisher:struct<name:string>>")
    publisher = native[D.NATIVE_ROOT]["publisher"]["name"]
    return found.where(publisher.isNotNull()).select(file_of().alias("file"), F.regexp_extract(xml, "(<Series>.*?</Series>)", 1).alias("series"), publisher.alias("publisher"))


@query(f"WITH {BOX} SELECT regexp_replace(file, '\\.[a-z0-9]+$', '') || '/' || f AS place, count(*) AS n FROM box, (VALUES ('ComicInfo.xml'), ('MetronInfo.xml')) v(f) WHERE kind IN ('CBZ', 'CBT') GROUP BY 1")
def k03_exported_files(t):
    """One file for each record and format, below the path of its container."""
    found = _collection(t)
    found.raw = found.raw.where("path RLIKE 'cb[zt]$'").where(key_of() % 20 != 3)
    folder = _local(t)
    done = found.export(folder, "comic_info", "metron_info").where("written")
    done.count()
    found_files = A.mounted_files(done.sparkSession, f"file://{folder}").where(A.size_of("path") > 20)
    return found_files.groupBy(F.regexp_extract("path", r"(g\d/p\d+/.*)$", 1).alias("place")).agg(F.count("*").alias("n"))


@query(f"""WITH {BOX} SELECT 'g' || p_partkey % 4 || '/p' || p_partkey || '.cbz' AS file, CAST(n + 1 AS INTEGER) AS members, 'Patched ' || p_partkey AS title, p_name AS series, CASE WHEN kind = 'CBZ' AND p_partkey % 2 = 0 THEN true ELSE false END AS comment, 'stored' AS pages
FROM box WHERE kind IN ('CBZ', 'CBT')""")
def k04_k05_k12_written_containers(t):
    """Zips and tars are patched and written as zips: pages and comments stay, the metadata is the merged one."""
    found, folder = _collection(t), _local(t)
    title = F.concat(F.lit("<ComicInfo><Title>Patched "), key_of(), F.lit("</Title></ComicInfo>"))
    patch = found.listing.where("error IS NULL AND file_type <> 'PDF'").select("path", F.lit("api").alias("source"), F.lit("comic_info").alias("fmt"), F.lit(0).alias("ordinal"), title.alias("payload"))
    found.write(folder, ("comic_info",), patch, "update").where("written").count()
    rows = A.listing(t("part").sparkSession, f"file://{folder}", wanted=A.all_content)
    xml = F.decode(A.shallowest(F.col("members"), "comicinfo.xml"), "UTF-8")
    pages = A.page_members(F.col("members"))
    body = F.decode(F.get(pages, F.lit(0))["content"], "UTF-8")
    state = F.when(body == F.concat(key_of().cast("string"), F.lit("-1")), "stored").otherwise("damaged")
    return rows.select(file_of().alias("file"), F.size("members").alias("members"), F.regexp_extract(xml, "<Title>(.*?)</Title>", 1).alias("title"), F.regexp_extract(xml, "<Series>(.*?)</Series>", 1).alias("series"), F.col("comment").isNotNull().alias("comment"), state.alias("pages"))


@query(f"WITH {BOX} SELECT kind, count(*) AS n FROM box WHERE kind IN ('BAD', 'CBR', 'PDF') GROUP BY kind")
def k06_not_writable(t):
    """A PDF, and what cannot be read, is not rewritten: each gives a result row with an error."""
    found = _collection(t)
    files = A.container_paths(t("part").sparkSession, containers(t))
    bad = files.where(key_of() % 20 % 2 == 1).where(key_of() % 20 != 1).where((key_of() % 20).isin(3, 5, 7)).withColumn("documents", F.create_map(F.lit("ComicInfo.xml"), F.lit("<ComicInfo/>")))
    done = K.write_archives(bad, _local(t), found.folder).where("error IS NOT NULL AND NOT written")
    kind = F.element_at(F.array(F.lit("BAD"), F.lit("CBR"), F.lit("PDF")), ((key_of() % 20 - 1) / 2).cast("int"))
    return done.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('PDF', '', 'comic_info'), ('CBZ', '', ''), ('PDF', 'comet', 'comet'), ('CBZ', 'comet', 'comet')) v(file_type, chosen, formats)")
def k07_formats_to_write(t):
    rows = [(k, w, ",".join(formats_to_write(Settings(write=(w,) if w else ()), k))) for w in ("", "comet") for k in ("PDF", "CBZ")]
    return t("region").sparkSession.createDataFrame(rows, "file_type string, chosen string, formats string")


@query(f"""WITH {BOX} SELECT p_name || ' #' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ' (' || (1950 + p_size) || ') Part ' || p_partkey || '.' || regexp_extract(file, '[a-z]+$') AS name, true AS written FROM box WHERE kind IN ('CBZ', 'CBT')""")
def k08_renamed_files(t):
    """Copies of the containers get the names that their records make."""
    spark, folder = t("part").sparkSession, _local(t)
    files = A.container_paths(spark, containers(t)).where(~(key_of() % 20).isin(3, 5, 7)).select("path", F.lit(None).cast("string").alias("error"), F.element_at(F.split("path", "/"), -1).alias("name"))
    K.extract(files, folder, containers(t)).count()
    found = Collection.from_archives(spark, f"file://{folder}", FORMATS)
    results = shared_folder(spark)
    found.rename().write.parquet(results)  # files are renamed once, however often the result is read
    return spark.read.schema(K.RESULT).parquet(results).where("error IS NULL").select(F.element_at(F.split("target", "/"), -1).alias("name"), "written")


@query(f"WITH {BOX} SELECT file, string_agg('P' || i || '.jpg', ',' ORDER BY i) AS pages, CAST(sum(length(CAST(p_partkey AS VARCHAR)) + 2) AS BIGINT) AS bytes FROM box, range(2, 4) r(i) WHERE kind IN ('CBZ', 'CBT') AND i <= n GROUP BY file")
def k09_k11_extracted_pages(t):
    """Pages 1 to 2, both inclusive and counted from 0, as files below the path of their container."""
    found, folder = _collection(t), _local(t)
    found.listing = found.listing.where("file_type <> 'PDF'")
    done = found.extract_pages(folder, "1:2").where("written")
    return done.groupBy(file_of().alias("file")).agg(F.array_join(F.array_sort(F.collect_list(F.element_at(F.split("target", "/"), -1))), ",").alias("pages"), F.sum("bytes").alias("bytes"))


@query(f"WITH {BOX} SELECT file, 'P' || n || '.jpg' AS cover FROM box WHERE kind IN ('CBZ', 'CBT')")
def k10_extracted_covers(t):
    """The page that the record types as front cover."""
    found, folder = _collection(t), _local(t)
    found.listing = found.listing.where("file_type <> 'PDF'")
    return found.extract_covers(folder).where("written").select(file_of().alias("file"), F.element_at(F.split("target", "/"), -1).alias("cover"))


@query("SELECT 'stop' AS run, true AS stopped, true AS all_rows, true AS some_done UNION ALL SELECT 'cancel', true, true, true UNION ALL SELECT 'go', false, true, true")
def k13_l08_t07_windows(t):
    """Windows of a bulk write: all run, or the rest is cancelled after an error or when asked to."""
    spark, root = t("part").sparkSession, containers(t)
    files = A.container_paths(spark, root).where((key_of() % 20).isin(0, 2, 3)).withColumn("documents", F.create_map(F.lit("ComicInfo.xml"), F.lit("<ComicInfo/>")))
    n, out = files.count(), None
    for run in ("stop", "cancel", "go"):
        begun: list[int] = []

        def cancelled(run=run, begun=begun) -> bool:
            return run == "cancel" and len(begun) > 2

        rows = files if run == "stop" else files.where(key_of() % 20 != 3)
        folder = _local(t)

        def write(part, folder=folder, begun=begun):
            begun.append(1)
            return K.write_archives(part, folder, root)

        done = K.in_windows(rows, write, shared_folder(spark), 6, run == "stop", cancelled)
        total = n if run == "stop" else rows.count()
        one = done.agg(F.lit(run).alias("run"), (F.count_if(F.col("error").isin("cancelled", "interrupted")) > 0).alias("stopped"), (F.count("*") == total).alias("all_rows"), (F.count_if("written") > 0).alias("some_done"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT * FROM (VALUES ('raw', 'path,source,fmt,ordinal,payload'), ('normalized', 'path,source,fmt,ordinal,payload,record,rank,error'), ('merged', 'path,record'), ('records', 'path,record'), ('covers', 'path,names'), ('names', 'path,name'), ('validated', 'path,valid')) v(phase, columns)")
def k15_phases(t):
    """The columns of the table of each phase."""
    found = _collection(t)
    rows = [(p, ",".join(found.phase(p).columns)) for p in ("raw", "normalized", "merged", "records", "covers", "names", "validated")]
    return t("region").sparkSession.createDataFrame(rows, "phase string, columns string")


@query(f"WITH {BOX} SELECT 'g' || p_partkey % 4 || '/p' || p_partkey || '.cbz' AS file, CAST(n AS INTEGER) AS members, false AS comment FROM box WHERE kind IN ('CBZ', 'CBT')")
def k16_all_tags_deleted(t):
    """Containers without documents and comments, their pages are still there."""
    found, folder = _collection(t, delete_all_tags=True), _local(t)
    found.write(folder).where("written").count()
    rows = A.listing(t("part").sparkSession, f"file://{folder}")
    return rows.select(file_of().alias("file"), F.size("members").alias("members"), F.col("comment").isNotNull().alias("comment"))


@query(f"WITH {BOX} SELECT file, 'Tagged with me on 2024-05-06T07:08:09Z' AS notes FROM box WHERE kind = 'CBT'")
def c04_stamped_records(t):
    rows = _collection(t).records().where("path LIKE '%.cbt'")
    stamped = R.stamped(rows, "me", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    return stamped.where("record.tagger = 'me'").select(file_of().alias("file"), F.col("record.notes").alias("notes"))


@query(f"""WITH k AS (SELECT CAST(range AS INTEGER) AS k FROM range(8)), v AS (SELECT CAST(range AS INTEGER) AS v FROM range({EDGE})), wave AS (SELECT k, v, 2 * cos(pi() * k * (2 * v + 1) / {2 * EDGE}) AS w FROM k, v),
pixels AS (SELECT p, x, y, CAST({PIXEL} AS DOUBLE) AS z FROM (SELECT p_partkey AS p FROM part), (SELECT v AS x FROM v), (SELECT v AS y FROM v)),
along AS (SELECT p, y, k AS a, sum(z * w) AS z FROM pixels JOIN wave ON v = x GROUP BY ALL), low AS (SELECT p, a, k AS b, sum(z * w) AS z FROM along JOIN wave ON v = y GROUP BY ALL),
bits AS (SELECT p, b * 8 + a AS i, CASE WHEN z > median(z) OVER (PARTITION BY p) THEN 1 ELSE 0 END AS bit FROM low), digits AS (SELECT p, i // 4 AS g, sum(bit << (3 - i % 4)) AS d FROM bits GROUP BY ALL)
SELECT p AS p_partkey, string_agg(substr('0123456789abcdef', CAST(d AS INTEGER) + 1, 1), '' ORDER BY g) AS cover_hash FROM digits GROUP BY p""")
def x25_e09_cover_hash(t):
    """Hashes of pictures drawn from the parts, decoded by Spark's image source."""
    return I.image_hashes(t("part").sparkSession, pictures(t)).select(key_of().alias("p_partkey"), "cover_hash")
