"""The training-data operators against brute force, round trips and held-out accuracy, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkfold.llm import decontaminate, graph, kernels, language_id, line_dedup, matroska, near_dup, packing, quality, queries, sharding, token_count, url_filter

SF = "/root/testdata/sf0.001"
WORDS = "the of and a red fox jumps over lazy dog while rivers carry stones under old bridges near quiet towns every spring morning".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "s", "ly", ","]) for _ in range(n))


ODD = [
    (1, "one two three four five six seven", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "one two three four five six seven", "de", None, 2), (1, "one two three four five six seven", "en", "s", 1),
    (5, "   \n\n\t ", "en", "s", 3), (6, "Ünïcödé «text» 日本語 🎉 don't we'll", "fr", "s", 4), (7, "a" * 5000, "en", "s", 5), (8, "x<|endoftext|>y", "en", "s", 6), (9, prose(1, 30000), "en", "s", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns whose names clash with what operators add."""
    extra = {c: F.lit("kept") for c in ("n_tokens", "score", "rule", "node", "id", "row", "lines", "runs", "doc", "version", "letters", "bits", "__lines", "__runs", "__doc", "__version", "__node", "__id", "__letters", "__quality")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# kernels ------------------------------------------------------------------


def test_pretokens_are_those_of_the_pattern():
    import regex

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    r = random.Random(0)
    texts = ["".join(r.choice("ab d'stmrevl'  \n\t.!12é½_ 　 \x1c") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    found = [[] for _ in texts]
    for data, offsets, rows in kernels.blocks(pa.array(texts)):
        points, at = kernels.code_points(data, offsets)
        starts = kernels.pretoken_starts(points, at)
        ends = np.append(starts[1:], len(points))
        for a, b, s in zip(starts, ends, np.searchsorted(at, starts, "right") - 1):
            found[rows[s]].append("".join(map(chr, points[a:b])))
    assert found == [pattern.findall(t) for t in texts]


def test_long_texts_without_spaces_are_cut(monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice("ab1'+/=é日本語。, ") for _ in range(3000)), "日本語。" * 800, "x=1;y='2';don't" * 200, "a" * 3000]
    whole = [kernels.word_hashes(pa.array([t]))[0] for t in texts]
    tokens = [packing_starts(t) for t in texts]
    monkeypatch.setattr(kernels, "SEGMENT_BYTES", 300)
    monkeypatch.setattr(kernels, "BLOCK_BYTES", 300)
    for t, w, k in zip(texts, whole, tokens):
        assert (kernels.word_hashes(pa.array([t]))[0] == w).all() and packing_starts(t) == k
        assert len(list(kernels.blocks(pa.array([t])))) > 5 or set(t) == {"a"}


def packing_starts(text: str) -> list[str]:
    out = []
    for data, offsets, _ in kernels.blocks(pa.array([text])):
        points, at = kernels.code_points(data, offsets)
        starts = kernels.pretoken_starts(points, at)
        out += ["".join(map(chr, points[a:b])) for a, b in zip(starts, np.append(starts[1:], len(points)))]
    return out


def test_letters_of_scripts_without_spaces_are_words():
    hashes, rows = kernels.word_hashes(pa.array(["abc日本語7", "日", "สวัสดี"]))
    assert np.bincount(rows).tolist() == [5, 1, 4] and hashes[1] == hashes[5]  # marks are no letters
    a = "".join(chr(0x4E00 + i) for i in range(500))
    b = a[:100] + "。" + a[100:300] + "x" + a[301:]
    x, y = (set(near_dup.shingles(pa.array([t]))[1].tolist()) for t in (a, b))
    assert len(x & y) / len(x | y) > 0.9


def test_long_texts_are_cut_where_no_word_is(monkeypatch):
    text = prose(2, 4000)
    whole, _ = kernels.word_hashes(pa.array([text, "x y"]))
    monkeypatch.setattr(kernels, "SEGMENT_BYTES", 500)
    monkeypatch.setattr(kernels, "BLOCK_BYTES", 700)
    parts, rows = kernels.word_hashes(pa.array([text, "x y"]))
    assert (whole == parts).all() and rows.tolist() == [0] * 4000 + [1, 1]


# 10 and 1: tokens ---------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_count.tokenizer_path())


def test_token_counts_are_those_of_the_library(odd, empty, library):
    rows = token_count.count_tokens(odd, token_count.tokenizer_path()).collect()
    assert len(rows) == len(ODD) and rows[0].score == "kept"
    for r in rows:
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
    assert token_count.op10_token_counts(empty, token_count.tokenizer_path()).count() == 0


def test_packing_places_every_token_once(odd, empty, library):
    pieces = packing.pack(odd, token_count.tokenizer_path()).collect()
    truth = Counter()
    for i, text, *_ in ODD:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        truth[i, len(ids)] += len(ids)
        for p in (p for p in pieces if p.doc_id == i and p.doc_tokens == len(ids)):
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    found = Counter()
    for p in pieces:
        found[p.doc_id, p.doc_tokens] += p.length
    assert found == truth
    bins = defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty, token_count.tokenizer_path()).count() == 0


def test_packing_pads_little():
    r = np.random.default_rng(0)
    docs = ((i, np.zeros(n, "<u4")) for i, n in enumerate(r.integers(1, 3000, 3000).tolist()))
    size = Counter()
    for p in packing.pack_stream(docs, 1024, 0):
        size[p[5]] += p[2]
    padding = sum(0 if not n & (n - 1) else 1024 - n for n in size.values())
    assert padding < 0.002 * sum(size.values())


# 2: shards ----------------------------------------------------------------


def test_two_writers_of_a_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "FLOOR_BYTES", 1 << 10)
    rows = spark.range(600).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    one, two = (sharding.ShardStore(spark, f"file://{tmp_path}/a", rows.schema, target_bytes=1 << 20) for _ in range(2))
    commit, raced = one._commit, []

    def late(change, base):
        if not raced:  # the other writer commits first
            raced.append(two.append(rows.where("id BETWEEN 100 AND 199")))
        return commit(change, base)

    monkeypatch.setattr(one, "_commit", late)
    assert one.append(rows.where("id < 100")) == 2 and raced == [1] and one.read().count() == 200
    assert one.append_each(rows.where("id >= 200"), F.col("id") % 4) == [3, 4, 5, 6]
    assert two.read().exceptAll(rows).count() == 0 and two.read().count() == 600 and two.read(2).count() == 200
    taken = [r.path for r in one.manifest().select("path").collect()]
    assert two._merge(taken, 1000) == 7
    folders = {n for n, _ in one._names("data")}
    assert one._merge(taken, 1000) is None and {n for n, _ in one._names("data")} == folders  # what lost the race is gone
    for i in range(12):  # beyond a whole manifest
        one.append(rows.where(F.col("id") == i))
    assert one._base(one.versions()[-1]) == 16 and one.read().count() == 612 and one.manifest().agg(F.sum("rows")).first()[0] == 612
    (tmp_path / "a/data/orphan").mkdir()
    assert one.vacuum(keep=2, grace_seconds=0) == len(taken) and one.read().count() == 612 and one.read(18).count() == 611
    assert one.versions() == [18, 19] and "orphan" not in {n for n, _ in one._names("data")}
    with pytest.raises(ValueError):
        one.read(5)
    assert one.append(rows.where("id = 1")) == 20 and one.read().count() == 613
    assert one.append_each(rows.limit(0), F.col("id")) == []


def test_shards_merge_in_tiers_and_versions_stay_whole(spark, tmp_path, empty, odd, monkeypatch):
    monkeypatch.setattr(sharding, "FLOOR_BYTES", 1 << 10)
    rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    store = sharding.ShardStore(spark, f"file://{tmp_path}/a", rows.schema, target_bytes=1 << 20, fan_in=4)
    assert store.read().count() == 0 and store.versions() == []
    for i in range(9):
        store.append(rows.where(F.col("id") % 9 == i).coalesce(1))
    before = store.versions()[-1]
    assert store.compact() >= 1
    small = store._tiers().groupBy("tier").count().collect()
    assert all(r["count"] < 4 for r in small)
    assert store.manifest().count() < store.manifest(before).count()
    assert store.read().exceptAll(rows).count() == 0 and store.read().count() == 4000
    assert store.read(before).count() == 4000  # old versions stay readable
    assert store.manifest().agg(F.sum("rows")).first()[0] == 4000
    assert store.vacuum(keep=1) > 0 and store.read().count() == 4000
    with pytest.raises(sharding.Conflict):
        store._commit(store.manifest(), store.versions()[-1] - 1)
    other = sharding.ShardStore(spark, f"file://{tmp_path}/b", empty.schema)
    other.append(empty)
    assert other.read().count() == 0
    assert sharding.op2_sharding(odd, f"file://{tmp_path}/c").count() == len(ODD)


# 3: media -----------------------------------------------------------------


@pytest.mark.parametrize("lacing", [1, 2, 3])
def test_media_round_trip(lacing):
    payload = bytes(random.Random(lacing).randbytes(192 * 300))
    media = matroska.parse(data := matroska.mux_samples(payload, lacing))
    assert media.error is None and b"".join(data[p.offset : p.offset + p.size] for p in media.packets) == payload
    assert [p.timestamp for p in media.packets] == [i * 24_000_000 for i in range(300)]
    assert len(media.cues) == media.clusters and all(data[at : at + 4] == bytes.fromhex("1F43B675") for _, _, at in media.cues)


def test_lacing_of_uneven_frames_and_faults():
    r = random.Random(4)
    for _ in range(200):
        frames = [r.randbytes(r.choice([0, 1, 126, 127, 254, 255, 510, 9000])) for _ in range(r.randint(1, 6))]
        for lacing in (1, 3):
            cluster = matroska.element(matroska.CLUSTER, matroska.element(matroska.TIMESTAMP, 100) + matroska.element(matroska.SIMPLE_BLOCK, matroska.block(3, -5, frames, lacing)))
            media = matroska.parse(data := matroska._HEAD + matroska.element(matroska.SEGMENT, cluster))
            assert [data[p.offset : p.offset + p.size] for p in media.packets] == frames and media.packets[0].timestamp == 95_000_000
    body = matroska.element(matroska.TIMESTAMP, 7) + matroska.element(matroska.SIMPLE_BLOCK, matroska.block(1, 0, [b"abc"], 0))
    unknown = matroska._HEAD + matroska.SEGMENT.to_bytes(4) + b"\x01" + b"\xff" * 7 + (matroska.CLUSTER.to_bytes(4) + b"\xff" + body) * 3
    assert matroska.parse(unknown).clusters == 3 and matroska.parse(unknown).error is None
    for cut in range(len(unknown)):
        matroska.parse(unknown[:cut])
    assert matroska.parse(unknown[:-2]).error and matroska.parse(None).error is None and matroska.parse(b"junk").error


def test_timestamps_beyond_64_bits_are_a_fault(spark):
    cluster = matroska.element(matroska.CLUSTER, matroska.element(matroska.TIMESTAMP, 1 << 63) + matroska.element(matroska.SIMPLE_BLOCK, matroska.block(1, 0, [b"abc"], 0)))
    data = matroska._HEAD + matroska.element(matroska.SEGMENT, cluster)
    rows = matroska.packet_table(spark.createDataFrame([("a", bytearray(data))], "path string, content binary")).collect()
    assert len(rows) == 1 and "64 bits" in rows[0].error


def test_media_of_odd_texts(spark, odd, empty):
    rows = matroska.op3_media(odd).collect()
    assert len(rows) == len(ODD)
    for i, text, *_ in ODD:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert any(r.doc_id == i and r.n_bytes == len(raw) and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:]) for r in rows)
    assert matroska.op3_media(empty).count() == 0
    files = spark.createDataFrame([("a", bytearray(matroska.mux_samples(b"x" * 192 * 9))), ("b", None), ("c", bytearray(b"junk"))], "path string, content binary")
    table = matroska.packet_table(files).collect()
    assert sum(r.key == "a" for r in table) == 9 and [r.error is not None for r in table if r.key == "c"] == [True] and not any(r.key == "b" for r in table)


# 4: near duplicates -------------------------------------------------------


def brute_classes(texts: list[str], threshold: float = 0.8) -> dict[str, str]:
    """Class of every distinct text by comparing all pairs."""
    held = Counter()
    for i in range(0, len(texts), 2000):
        held.update(near_dup.shingles(pa.array(texts[i : i + 2000]))[1].tolist())
    often = sorted(h for h, n in held.items() if n >= near_dup.RARE * len(texts))
    frequent = np.array(often, np.uint64), 1 + np.log(len(texts) / np.array([held[h] for h in often]))
    distinct = list(dict.fromkeys(texts))
    rows, hashes, counts = near_dup.shingles(pa.array(distinct))
    weight = near_dup.weights(hashes, counts, frequent)
    bags = [dict(zip(hashes[rows == i].tolist(), weight[rows == i].tolist())) for i in range(len(distinct))]
    parent = list(range(len(distinct)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(bags)):
        for b in range(a):
            low = sum(min(w, bags[b].get(h, 0)) for h, w in bags[a].items())
            total = sum(bags[a].values()) + sum(bags[b].values()) - low
            if total and low / total >= threshold:
                parent[root(a)] = root(b)
    return {t: root(i) for i, t in enumerate(distinct)}


def test_near_duplicates_against_all_pairs(spark):
    rows, r = [], random.Random(7)
    for g in range(25):
        base = prose(100 + g, 120).split()
        for k in range(5):
            words = list(base)
            for _ in range(k * 2):
                words[r.randrange(len(words))] = "changed"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000 + i, "one text of which there are many copies, all of them exactly the same") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {x.doc_id: x.class_id for x in near_dup.near_duplicates(docs).collect()}
    truth = brute_classes([t for _, t in rows])
    least = {}
    for i, t in rows:
        least.setdefault(truth[t], i)
    assert found == {i: least[truth[t]] for i, t in rows}
    kept = near_dup.keep_first(docs)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(least.values())


def edited_family(n: int, words: int, edits: int) -> list[str]:
    r, out = random.Random(8), []
    for _ in range(n):
        text = [f"w{i}" for i in range(words)]
        for _ in range(edits):
            text[r.randrange(words)] = f"x{r.randrange(10**9)}"
        out.append(" ".join(text))
    return out


def test_a_bucket_in_many_tasks(spark):
    """A family whose texts share band keys, dealt over more tasks than a bucket has rows on average."""
    texts = edited_family(400, 300, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    truth, least = brute_classes(texts), {}
    for i, t in enumerate(texts):
        least.setdefault(truth[t], i)
    assert found == {i: least[truth[t]] for i, t in enumerate(texts)}


@pytest.mark.parametrize("part", [4096, 300])
def test_all_pairs_of_a_family_about_the_threshold(spark, monkeypatch, part):
    monkeypatch.setattr(near_dup, "PART_TEXTS", part, raising=False)
    texts = edited_family(2000, 400, 3)
    # every shingle of the template has one place, so a text is the set of template places that it kept
    kept = np.zeros((len(texts), 396), np.float32)
    idf = 1 + np.log(16)
    for i, t in enumerate(texts):
        good = np.array([w[0] == "w" for w in t.split()])
        kept[i] = np.lib.stride_tricks.sliding_window_view(good, 5).all(axis=1)
    weight = 1 + np.log(len(texts) / kept.sum(axis=0))
    total = kept @ weight + (396 - kept.sum(axis=1)) * idf
    low = (kept * weight) @ kept.T
    similar = low / (total[:, None] + total - low)
    assert not (abs(similar - 0.8) < 1e-6).any() and np.median(similar) < 0.8
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in np.argwhere(np.triu(similar >= 0.8, 1)).tolist():
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    truth = {i: root(i) for i in range(len(texts))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert 1 < len(set(truth.values())) < len(texts)
    assert found == truth


def test_joined_components_are_those_of_all_pairs():
    r = np.random.default_rng(3)
    for n, levels in ((40, 1), (90, 3), (90, 40)):
        tables = []
        for _ in range(n):
            t = np.empty(25, near_dup._SHINGLE)
            t["h"], t["w"] = np.sort(r.permutation(34)[:25]), r.integers(1, levels + 1, 25)
            tables.append(t)
        start = np.arange(n) // 2
        threshold = 0.72 if levels == 1 else 0.45
        true = {(i, j) for i in range(n) for j in range(n) if near_dup.similarity([tables[i]], [tables[j]])[0] >= threshold}

        def classes(links):
            at = list(range(n))
            for a, b in links:
                x, y = at[a], at[b]
                at = [y if v == x else v for v in at]
            return {(i, j) for i in range(n) for j in range(n) if at[i] == at[j]}

        same = [(i, i ^ 1) for i in range(n)]
        links = near_dup.joined(tables, start * 2, threshold)
        assert classes([*links, *same]) == classes([*true, *same]) and len(links) < n / 2


def test_near_duplicates_of_odd_rows(odd, empty):
    found = near_dup.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    by_id = {r.doc_id: r.class_id for r in found}
    assert by_id[1] == by_id[None] == 1 and by_id[2] == by_id[3] == 2 and by_id[5] == 5
    kept = near_dup.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 7, 8, 9]
    assert near_dup.near_duplicates(empty).count() == 0


def test_sampling_estimates_weighted_similarity():
    a, b = prose(11, 400), prose(11, 400).replace("fox", "wolf").replace("stones", "sand")
    rows, hashes, counts = near_dup.shingles(pa.array([a, b]))
    weight = near_dup.weights(hashes, counts, (np.zeros(0, np.uint64), np.zeros(0)))
    _, samples = near_dup.signatures(rows, hashes, weight, 2)
    x, y = (dict(zip(hashes[rows == i].tolist(), weight[rows == i].tolist())) for i in (0, 1))
    low = sum(min(w, y.get(h, 0)) for h, w in x.items())
    true = low / (sum(x.values()) + sum(y.values()) - low)
    assert abs((samples[0] == samples[1]).mean() - true) < 0.08


@pytest.mark.parametrize("same, own", [(8, 1), (16, 2), (40, 5)])
def test_short_texts_share_a_band(same, own):
    """Pairs of ``same`` common shingles and ``own`` others each: of similarity 0.8."""
    r, n = np.random.default_rng(same), 4000
    both = r.integers(0, 1 << 52, (n, 1, same), dtype=np.uint64)
    parts = np.sort(np.concatenate([np.repeat(both, 2, axis=1), r.integers(0, 1 << 52, (n, 2, own), dtype=np.uint64)], axis=2), axis=2)
    size = same + own
    missed = 0
    for i in range(0, n, 1000):
        hashes = parts[i : i + 1000].reshape(-1)
        keys, _ = near_dup.band_rows(near_dup.signatures(np.repeat(np.arange(2000), size), hashes, np.full(len(hashes), 3.77, np.float32), 2000)[1])
        missed += int((~(keys[::2] == keys[1::2]).any(axis=1)).sum())
    assert missed <= 4


@pytest.mark.parametrize("ranges", [1, 64])
def test_every_shingle_has_its_exact_document_frequency(spark, monkeypatch, ranges):
    """The weights that samples are drawn by, against a count of all shingles of all texts, copies and frequent ones included."""
    monkeypatch.setattr(near_dup, "RANGES", ranges)
    texts = [prose(500 + i % 70, 60) + " " + prose(900 + i % 7, 12) for i in range(140)] + ["the same few words in all of these copies"] * 5 + ["a b", "", prose(3, 3000)]
    texts += [prose(3, 3000) + " and more"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    held = Counter(near_dup.shingles(pa.array(texts))[1].tolist())
    frequent = near_dup.frequent_shingles(docs)
    assert len(frequent[0]) and {1, 2, 3, 5} <= set(held.values())
    size = sum(len(t.encode()) for t in texts)
    found = {r.node: r.held for r in near_dup.document_frequencies(docs, frequent, size).collect()}
    nodes = [r.node for r in docs.orderBy("doc_id").select(F.xxhash64("text").alias("node")).collect()]
    rows, hashes, counts = near_dup.shingles(pa.array(texts))
    weight = near_dup.tf_idf(rows, hashes, counts, frequent, pa.array([found.get(n) for n in nodes], pa.binary()), len(texts))
    assert np.allclose(weight, counts * (1 + np.log(len(texts) / np.array([held[h] for h in hashes.tolist()]))))
    assert len(set(np.round(weight / counts, 4).tolist())) > 4


def repeating(loops: int, own: int, seed: int) -> str:
    """A text that says one thing again and again, and ends with words of its own."""
    return " ".join(["this step failed once more"] * loops + [f"id{seed}x{i}" for i in range(own)])


def test_pieces_keep_weights_and_similarity():
    rows, hashes, counts = near_dup.shingles(pa.array([repeating(90, 20, 1), repeating(70, 25, 2), "a b", ""]))
    weight = (counts * 2.5).astype(np.float32)
    row, piece, cut = near_dup.pieces(rows, hashes, weight, 3.25)
    assert np.allclose(np.bincount(row, cut), np.bincount(rows, weight)) and 0 < cut.min() and cut.max() <= 3.25 + 1e-5
    assert set(hashes.tolist()) <= set(piece.tolist()) and len(row) <= sum(counts)

    def similarity(rows, hashes, weight):
        x, y = (dict(zip(hashes[rows == i].tolist(), weight[rows == i].tolist())) for i in (0, 1))
        low = sum(min(w, y.get(h, 0)) for h, w in x.items())
        return low / (sum(x.values()) + sum(y.values()) - low)

    true = similarity(rows, hashes, weight)
    assert abs(similarity(row, piece, cut) - true) < 1e-5
    _, samples = near_dup.signatures(row, piece, cut, 4)
    assert abs((samples[0] == samples[1]).mean() - true) < 0.08
    empty = near_dup.pieces(rows[:0], hashes[:0], weight[:0], 3.25)
    assert all(len(x) == 0 for x in empty)


def test_texts_that_share_what_they_repeat_are_found(spark):
    """Pairs whose similarity lies in a few shingles that they repeat: 0.83 to 0.97 with counts, below 0.4 without."""
    import corpus_pipeline

    texts = []
    for i, (loops, own) in enumerate([(100, 10), (100, 40), (400, 60), (400, 180), (30, 6), (1000, 100)]):
        say = f"of{i} "  # each pair repeats something else
        texts += [say + repeating(loops, own, k).replace("step", f"step{i}") for k in (2 * i, 2 * i + 1)]
    texts += [prose(700 + i, 80) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    truth, least = brute_classes(texts), {}
    for i, t in enumerate(texts):
        least.setdefault(truth[t], i)
    assert [least[truth[t]] for t in texts[:12]] == [0, 0, 2, 2, 4, 4, 6, 6, 8, 8, 10, 10]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_the_pipeline_draws_samples_by_exact_tf_idf(spark, docs, monkeypatch):
    """The weights by which stage 3 draws its samples, against a count of all shingles of its input."""
    import corpus_pipeline

    texts = [r.text or "" for r in docs.select("text").collect()]
    held = Counter()
    for i in range(0, len(texts), 1000):
        held.update(near_dup.shingles(pa.array(texts[i : i + 1000]))[1].tolist())
    drawn = near_dup.candidate_links

    def checked(docs, frequent, known, documents, text):
        assert documents == len(texts)
        back = {r.node: r.held for r in known.collect()}
        some = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("node"), F.coalesce(text, F.lit("")).alias("text")).limit(300).collect()
        rows, hashes, counts = near_dup.shingles(pa.array([r.text for r in some]))
        weight = near_dup.tf_idf(rows, hashes, counts, frequent, pa.array([back.get(r.node) for r in some], pa.binary()), documents)
        assert np.allclose(weight, counts * (1 + np.log(len(texts) / np.array([held[h] for h in hashes.tolist()]))))
        checked.calls = 1
        return drawn(docs, frequent, known, documents, text)

    monkeypatch.setattr(near_dup, "candidate_links", checked)
    corpus_pipeline.drop_near_duplicates(spark, docs, SF).count()
    assert checked.calls == 1


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}, 200: 200, 201: 200}


# 5: language --------------------------------------------------------------


def test_language_of_held_out_texts(docs, odd, empty):
    rows = language_id.op5_language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r for r in language_id.op5_language_id(odd).collect()}
    assert found[2].lang_pred == found[3].lang_pred == found[5].lang_pred == "und" and found[9].lang_pred == "en"
    assert language_id.op5_language_id(empty).count() == 0


def test_parts_of_the_trees_give_the_same(spark, docs, monkeypatch):
    some = docs.where("doc_id < 60")
    whole = language_id.fit(some, F.lit(True))
    texts = pa.array([r.text for r in some.collect()] + ["", "zq 日本 \n", None])
    true = whole.part(0).code_lengths(texts)
    monkeypatch.setattr(language_id, "CELLS", 20_000)
    cut = language_id.fit(some, F.lit(True))
    assert whole.parts == 1 and cut.parts > 3
    assert np.allclose(sum(cut.part(i).code_lengths(texts) for i in range(cut.parts)), true, atol=1e-2)
    one, many = ({r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language_id.predict(some, t).collect()} for t in (whole, cut))
    assert one == many


def test_predictions_keep_other_columns(odd):
    found = language_id.predict(odd, language_id.fit(odd, F.lit(True)))
    assert found.columns == [*(c for c in odd.columns if c != "score"), "lang_pred", "score"] and {r["__letters"] for r in found.collect()} == {"kept"}


def test_code_lengths_are_those_of_the_tree():
    text = b"banana bandana"
    keys, n = np.unique(np.concatenate([k for k, _ in language_id.grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))]), return_counts=True)
    model = language_id.Model.build({"x": (keys, n.astype(float))})
    seen = [Counter() for _ in range(4)]
    padded = b"   " + text
    for i in range(3, len(padded)):
        for k in range(4):
            seen[k][padded[i - k : i], padded[i]] += 1

    def bits(context: bytes, symbol: int, k: int) -> float:
        if k < 0:
            return 8.0
        here = {s: c for (x, s), c in seen[k].items() if x == context[3 - k :]}
        if not here:
            return bits(context, symbol, k - 1)
        total = sum(here.values()) + len(here)
        return -np.log2(here[symbol] / total) if symbol in here else -np.log2(len(here) / total) + bits(context, symbol, k - 1)

    probe = b"anabz ban"
    wide = b"   " + probe
    true = sum(bits(wide[i - 3 : i], wide[i], 3) for i in range(3, len(wide)))
    assert abs(model.code_lengths(pa.array([probe.decode()]))[0, 0] - true) < 1e-3


# 6: URLs ------------------------------------------------------------------


def test_url_rules_and_model(spark):
    urls = [(1, "https://A.Example.ORG/es/1?x"), (2, "http://example.org/en/12#f"), (3, "http://x.org/a"), (4, "http://x.com/fr/1"), (5, "http://x.com/de/1"), (6, "http://net.example/q"), (7, None), (8, "nothing"), (9, ""), (9, ""), (10, "ftp://h.org"), (11, "http://notexample.org/es/"), (12, "x" * 20000)]
    pages = spark.createDataFrame([(i, u, "kept") for i, u in urls], "page_id long, url string, host string")
    found = {r.page_id: r for r in url_filter.judge(pages).collect()}
    rules = {i: r.rule for i, r in found.items()}
    assert rules == {1: "example.org/es/", 2: "example.org/en/1", 3: "org/", 4: "com/fr/", 5: "com/de/", 6: None, 7: None, 8: None, 9: None, 10: None, 11: "org/", 12: None}
    assert (found[1].host, found[1].path) == ("a.example.org", "/es/1") and (found[8].host, found[7].path) == ("", "")
    assert [found[i].verdict for i in (1, 2, 3, 4, 5, 11)] == ["block", "block", "allow", "allow", "block", "allow"]
    assert url_filter.op6_url_filter(pages.limit(0)).count() == 0


def test_url_model_separates_what_it_was_taught(spark):
    rows = [(i, f"http://good{i % 7}.example.net/news/{i}" if i % 2 else f"http://casino{i % 5}.example.net/win/{i}", bool(i % 2)) for i in range(400)]
    ratio, threshold = url_filter.fit(spark.createDataFrame(rows, "id long, url string, accept boolean"))
    keys, offsets = url_filter.symbol_grams(pa.array(["http://good9.example.net/news/999", "http://casino9.example.net/win/999"]))
    good, bad = ratio[keys[: offsets[1]]].mean(), ratio[keys[offsets[1] :]].mean()
    assert good >= threshold > bad


def test_url_model_is_that_of_the_definition(monkeypatch):
    """Witten-Bell by recursion over the contexts, on four symbols."""
    monkeypatch.setattr(url_filter, "SYMBOLS", 4)
    r, n = random.Random(2), Counter()
    for text in ["".join(r.choice("1123") for _ in range(r.randint(1, 9))) for _ in range(25)]:
        wide = "000" + text
        for i in range(3, len(wide)):
            n[wide[i - 3 : i + 1]] += 1
    counts = np.zeros(256)
    for key, k in n.items():
        counts[int(key, 4)] = k

    def p(context: str, symbol: str) -> float:
        here = {s: sum(k for key, k in n.items() if key.endswith(context + s)) for s in "0123"}
        kinds, total = sum(k > 0 for k in here.values()), sum(here.values())
        shorter = p(context[1:], symbol) if context else 1 / 4
        return (here[symbol] + kinds * shorter) / (total + kinds) if total else shorter

    found = url_filter.log_probabilities(counts)
    for a in "0123":
        for b in "0123":
            for c in "0123":
                for s in "0123":
                    assert abs(found[int(a + b + c + s, 4)] - np.log(p(a + b + c, s))) < 1e-9


def test_url_scores_are_mean_differences(spark):
    ratio = np.random.default_rng(1).normal(size=48**4).astype(np.float32)
    urls = ["http://a.example/B?c=1", "", None, "é//", "x" * 50]
    rows = spark.createDataFrame(list(enumerate(urls)), "i long, url string")
    found = {r.i: r.score for r in url_filter._scored(rows, spark.sparkContext.broadcast(ratio), "url", "score").collect()}
    known = "abcdefghijklmnopqrstuvwxyz0123456789/.-?=&#_%:"
    for i, url in enumerate(urls):
        symbols = [0, 0, 0, *(known.find(chr(b).lower()) + 1 or 47 if b < 128 else 47 for b in (url or "").encode())]
        each = [ratio[((symbols[k - 3] * 48 + symbols[k - 2]) * 48 + symbols[k - 1]) * 48 + symbols[k]] for k in range(3, len(symbols))]
        assert abs(found[i] - (np.mean(each) if each else 0)) < 1e-5


# 7: lines -----------------------------------------------------------------


def brute_lines(rows: list[tuple]) -> dict:
    first, windows = {}, []
    for i, text in sorted(rows):
        lines = [x.strip(" ") for x in text.split("\n")]
        for at in range(len(lines) - 2):
            w = tuple(lines[at : at + 3])
            if any(w):
                first.setdefault(w, (i, at))
                windows.append((w, i, at))
    gone = defaultdict(set)
    for w, i, at in windows:
        if first[w] != (i, at):
            gone[i] |= {at, at + 1, at + 2}
    return {i: "\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone[i]) for i, t in rows}


def test_line_windows_against_brute_force(spark, odd, empty):
    r = random.Random(3)
    rows = [(i, "\n".join(r.choice(["a", "b", " a", "c", "", "d e"]) for _ in range(r.randint(0, 14)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {x.doc_id: x.text for x in line_dedup.deduplicate_lines(docs).collect()}
    assert found == brute_lines(rows)
    kept = line_dedup.deduplicate_lines(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(ODD) and kept.where("text IS NULL").count() == 1 and line_dedup.op7_line_dedup(empty).count() == 0


# 8: quality ---------------------------------------------------------------


def test_quality_of_held_out_texts(spark, odd, empty):
    rows, r = [], random.Random(5)
    for i in range(400):
        good = i % 2
        rows.append((i, prose(i, 60) if good else " ".join([r.choice(["$$$", "win", "|", "||"]) for _ in range(40)]), good))
    both = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    found = quality.op8_quality(both.select("doc_id", "text"), both.select("doc_id", "quality")).collect()
    truth = {i: q for i, _, q in rows}
    held = [x for x in found if x.held_out]
    assert held and np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.97 and all(0 <= x.score <= 1 for x in found)
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (7, None), (9, 5), (None, 1)], "doc_id long, quality int")
    scored = quality.score(odd, quality.fit(odd, labels, ~quality.held_out()))
    assert scored.count() == len(ODD) and scored.where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert quality.op8_quality(empty, labels).count() == 0
    assert {x.score for x in quality.op8_quality(odd, labels.limit(0)).collect()} == {0.5}


def test_the_sample_of_the_fit_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 30) if i % 50 else "x " * 40_000) for i in range(600)] + [(3, "again")] * 500, "doc_id long, text string")
    labels = spark.range(600).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    seen, fit_model = [], quality.fit_model
    monkeypatch.setattr(quality, "fit_model", lambda texts, y: seen.append((len(texts), texts.nbytes)) or fit_model(texts, y))
    monkeypatch.setattr(quality, "MAX_TEXT", 50_000)
    quality.fit(docs, labels, F.lit(True), max_docs=200, max_bytes=20_000)
    assert 20 < seen[0][0] < 300 and seen[0][1] < 40_000


def test_word_vectors_are_sums_of_contexts():
    texts = ["a b a b c", "b a d a", "", "a a"]
    words, vectors = quality.word_vectors(pa.array(texts))
    tokens, rows, _ = (np.concatenate(x) for x in zip(*quality.tokens(pa.array(texts))))
    count, true = Counter(tokens.tolist()), {}
    for i, t in enumerate(tokens.tolist()):
        if count[t] > 1:
            sums = true.setdefault(t, np.zeros(quality.SIZE))
            for j in range(max(0, i - quality.REACH), min(len(tokens), i + quality.REACH + 1)):
                if j != i and rows[j] == rows[i]:
                    places, signs = quality.index_places(tokens[j : j + 1])
                    for at, sign in zip(places[0], signs[0]):
                        sums[at] += sign
    assert sorted(true) == words.tolist()
    for w, v in zip(words.tolist(), vectors):
        norm = np.linalg.norm(true[w])
        assert np.allclose(v, true[w] / norm if norm else 0, atol=1e-5)


def test_gradients_are_finite_differences():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(40, 6)), (r.random(40) < 0.5).astype(float)
    layers = [r.normal(size=(6, 5)), r.normal(size=5), r.normal(size=5), r.normal(size=1)]

    def loss() -> float:
        p = quality._sigmoid(np.tanh(x @ layers[0] + layers[1]) @ layers[2] + layers[3][0])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + quality.DECAY / 2 * ((layers[0] ** 2).sum() + (layers[2] ** 2).sum())

    for w, g in zip(layers, quality.gradients(layers, x, y)):
        for at in np.ndindex(w.shape):
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert abs(g[at] - (up - down) / 2e-5) < 1e-6


# 9: benchmark -------------------------------------------------------------


def edit_distance_within(item: str, text: str) -> int:
    last = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1))
        last = row
    return min(last)


def test_matches_are_those_of_dynamic_programming():
    r = random.Random(5)
    small = ["the", "of", "ntion", "er", "thanre", "and", "onhe", "that", "estin", "wh"]
    for _ in range(120):
        item = " ".join(r.choice(small) for _ in range(r.randint(12, 20)))
        budget, t = int(len(item) * 0.1), list(item)
        for _ in range(r.randint(0, budget + 3)):
            at, kind = r.randrange(len(t)), r.random()
            if kind < 0.34:
                t[at] = r.choice("abcdefgh ")
            elif kind < 0.67:
                del t[at]
            else:
                t.insert(at, r.choice("abcdefgh "))
        text = " ".join(r.choice(small) for _ in range(15)) + " " + "".join(t) + " " + " ".join(r.choice(small) for _ in range(15))
        true = edit_distance_within(item, text)
        found = decontaminate.Matcher([(7, item)], 0.1)(text)
        assert [(x[0], x[1]) for x in found] == ([(7, true)] if true <= budget else [])


def test_contaminated_rows(spark, odd, empty, monkeypatch):
    item = "A benchmark question, with enough words to be recognised in any text"
    rows = [(1, prose(1, 50) + " " + item.upper() + " " + prose(2, 50)), (2, item.replace("enough", "enouhg")), (3, prose(3, 90)), (4, None), (4, None), (None, item)]
    docs = spark.createDataFrame([(*x, "kept") for x in rows], "doc_id long, text string, item_id string")
    tests = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "short"), (14, item + " twice over and then some more")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_items(docs, tests).collect()}
    assert found == {(1, 10): 0, (2, 10): 2, (None, 10): 0}
    clean = decontaminate.remove_contaminated(docs, tests)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 4]
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)  # several blocks give the same
    assert {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_items(docs, tests).collect()} == found
    assert decontaminate.find_items(odd, tests).count() == 0 and decontaminate.find_items(empty, tests).count() == 0
    assert decontaminate.find_items(docs, tests.limit(0)).count() == 0


def test_short_items_occur_exactly_as_words(spark):
    rows = [(1, "Say: what is the CAPITAL of France?"), (2, "what is the capital of francium"), (3, "what is teh capital of france"), (4, "42"), (5, "x42 424"), (6, "a 42, b 42")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(10, "What is the capital of France"), (11, "42"), (12, "?!"), (13, "42")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.distance, r.end) for r in decontaminate.find_items(docs, tests).collect())
    assert found == [(1, 10, 0, 33), (4, 11, 0, 2), (4, 13, 0, 2), (6, 11, 0, 4), (6, 13, 0, 4)]


def test_matchers_of_different_budgets(spark):
    item = "a benchmark question with enough words to be recognised"
    docs = spark.createDataFrame([(1, item.replace("enough", "enouhg"))], "doc_id long, text string")
    tests = spark.createDataFrame([(10, item)], "item_id long, text string")
    assert [decontaminate.find_items(docs, tests, rate=rate).count() for rate in (0.1, 0.0, 0.1)] == [1, 0, 1]


# queries and pipeline -----------------------------------------------------


def test_shared_folder_is_named_or_local(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    from sparkfold.llm.session import fresh_name, shared_dir

    with pytest.raises(ValueError):
        shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "s3a://bucket/x/"}
    assert shared_dir(Session()).startswith("s3a://bucket/x/sparkfold-")
    assert fresh_name("a", ["A", "a_", "b"]) == "a__" and fresh_name("c", []) == "c"


def test_stages_keep_other_columns(spark, odd):
    import corpus_pipeline

    docs = odd.withColumn("text", F.coalesce("text", F.lit("a")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert all(r["__doc"] == r["__node"] == r["__quality"] == r["id"] == r["row"] == "kept" for r in kept.collect())


def test_registered_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        result = stage(spark, kept, SF)
        assert result.columns == docs.columns
        from sparkfold.llm.session import stored

        before, kept = kept, stored(result)
        assert kept.count() <= before.count()
        if i == 1:
            want = brute_lines([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id: r.text for r in kept.collect()} == want
        if i == 2:
            texts = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
            classes, least = brute_classes([t for _, t in texts]), {}
            for d, t in texts:
                least.setdefault(classes[t], d)
            assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, SF)
        assert empty_out.count() == 0
