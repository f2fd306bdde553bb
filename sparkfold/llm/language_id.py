"""Language identification by prediction by partial matching.

Every language has a context tree over bytes: three preceding bytes, then two, one, none.  A byte that was
seen behind a context costs its share there; one that was not pays the escape probability (method C: kinds
seen over occurrences plus kinds) and is coded in the next shorter context, at last uniformly over 256
bytes.  The statistics are frozen after training, so the code length of a text is a sum over its bytes and
each byte's cost depends on four bytes only; the language of least code length wins.

The counts come from all training texts, counted on the executors and summed by Spark, and no branch is
pruned: code lengths are exact at every size.  What a byte costs depends on the trees below the two bytes
before it alone, so the trees are cut by that pair into parts of at most CELLS costs (all languages
together; one pair's branches, 65 536 for each language at most, stay in one part).  A part is what the
driver collects and broadcasts at a time.  The code length of a text is the sum over the parts: with
several parts the texts pass each in turn, and the sums so far are written to the shared folder between.

Defined results: ``und`` with score 0 for a null text, a text without a letter, and where nothing was
learned; equal code lengths go to the language that sorts first; rows without text or language teach
nothing; repeated rows count each time; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import kernels as K
from .session import bounded, discard, fresh_name, stored

#: Costs that a part of the trees holds.
CELLS = 16_000_000
#: Bytes that one step works on.
CHUNK = 1 << 20
#: Code bits that halve the confidence; neighbouring bytes are no independent evidence.
SCALE = 8.0


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Each byte with the three before it as a 32-bit number, chunk by chunk, and where the chunk starts; spaces stand before a text."""
    starts, ends = offsets[:-1], offsets[1:]
    for a in range(0, len(data), CHUNK):
        b = min(len(data), a + CHUNK)
        wide = np.full(b - a + 3, 32, np.uint32)
        wide[3 - min(3, a) :] = data[max(0, a - 3) : b]
        out = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
        for k, keep, pad in ((0, 0xFF, 0x20202000), (1, 0xFFFF, 0x20200000), (2, 0xFFFFFF, 0x20000000)):
            at = starts + k
            at = at[(at < ends) & (at >= a) & (at < b)] - a
            out[at] = (out[at] & np.uint32(keep)) | np.uint32(pad)
        yield out, a


def _costs(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log2(whole) - np.log2(part)


def _tree(keys: np.ndarray, counts: np.ndarray, shift: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost of each sorted key in its own context; the contexts and the cost of their escapes."""
    context, first, inverse = np.unique(keys >> shift, return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(context))
    kinds = np.diff(np.append(first, len(keys)))
    return _costs(counts, (total + kinds)[inverse]), context, _costs(kinds, total + kinds)


def _shorter(keys: np.ndarray, counts: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    short, inverse = np.unique(keys & keys.dtype.type(mask), return_inverse=True)
    return short, np.bincount(inverse, weights=counts, minlength=len(short))


@dataclass
class Model:
    """Frozen code lengths (bits) of all languages; each table has a column for each language.

    ``within`` marks the pairs (of the two bytes before one) that this part answers for; None: all.
    """

    languages: list[str]
    four: np.ndarray
    four_cost: np.ndarray
    context: np.ndarray
    context_cost: np.ndarray
    three: np.ndarray
    three_cost: np.ndarray
    pair_escape: np.ndarray
    pair_cost: np.ndarray
    within: np.ndarray | None = None
    grid: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def build(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], pairs: dict[str, tuple[np.ndarray, np.ndarray]] | None = None, within: np.ndarray | None = None) -> Model:
        """``counts``: sorted 32-bit keys with their counts, by language; of a part, with the counts of all last two bytes in ``pairs``."""
        languages = sorted(counts)
        n = len(languages)
        four = np.unique(np.concatenate([k for k, _ in counts.values()])) if n else np.zeros(0, np.uint32)
        three, context = np.unique(four & np.uint32(0xFFFFFF)), np.unique(four >> 8)
        four_cost, three_cost = np.zeros((len(four), n), np.float32), np.zeros((len(three), n), np.float32)
        context_cost = np.zeros((len(context), n), np.float32)
        pair_escape, pair_cost = np.zeros((65536, n), np.float32), np.zeros((65536, n), np.float32)
        for i, language in enumerate(languages):
            k4, c4 = counts[language]
            k3, c3 = _shorter(k4, c4, 0xFFFFFF)
            k2, c2 = pairs[language] if pairs else _shorter(k3, c3, 0xFFFF)
            k1, c1 = _shorter(k2, c2, 0xFF)
            single = np.full(256, 8 + _costs(np.float64(len(k1)), c1.sum() + len(k1)))
            single[k1] = _costs(c1, c1.sum() + len(k1))
            cost, ctx, escape = _tree(k2, c2)
            alone = np.zeros(256)
            alone[ctx] = escape
            pair_cost[:, i] = (alone[:, None] + single[None, :]).ravel()
            pair_cost[k2, i] = cost
            cost, ctx, escape = _tree(k3, c3)
            pair_escape[ctx, i] = escape
            three_cost[:, i] = pair_escape[three >> 8, i] + pair_cost[three & np.uint32(0xFFFF), i]
            three_cost[np.searchsorted(three, k3), i] = cost
            cost, ctx, escape = _tree(k4, c4)
            context_cost[np.searchsorted(context, ctx), i] = escape
            four_cost[:, i] = context_cost[np.searchsorted(context, four >> 8), i] + three_cost[np.searchsorted(three, four & np.uint32(0xFFFFFF)), i]
            four_cost[np.searchsorted(four, k4), i] = cost
        return cls(languages, four, four_cost, context, context_cost, three, three_cost, pair_escape, pair_cost, within)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Row in ``four`` of each key, -1 if it has none."""
        if not len(self.four):
            return np.full(len(keys), -1)
        if self.grid is None:
            high, low = np.unique(self.four >> 16), np.unique(self.four & np.uint32(0xFFFF))
            if len(high) * len(low) > 1 << 23:  # then search instead of a table of up to 32 MB
                self.grid = (np.zeros(0), np.zeros(0), np.zeros(0))
            else:
                table = np.full((len(high) + 1, len(low) + 1), -1, np.int32)
                row, column = np.full(65536, len(high), np.int32), np.full(65536, len(low), np.int32)
                row[high], column[low] = np.arange(len(high)), np.arange(len(low))
                table[row[self.four >> 16], column[self.four & np.uint32(0xFFFF)]] = np.arange(len(self.four))
                self.grid = (row, column, table)
        row, column, table = self.grid
        if len(row):
            return table[row[keys >> 16], column[keys & np.uint32(0xFFFF)]]
        place = np.minimum(np.searchsorted(self.four, keys), len(self.four) - 1)
        return np.where(self.four[place] == keys, place, -1)

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each key's last byte behind its first three, 0 where another part answers: [keys, languages]."""
        if self.within is not None:
            mine = np.flatnonzero(self.within[keys >> 8 & np.uint32(0xFFFF)])
            out = np.zeros((len(keys), len(self.languages)), np.float32)
            out[mine] = self._own(keys[mine])
            return out
        return self._own(keys)

    def _own(self, keys: np.ndarray) -> np.ndarray:
        place = self._find(keys)
        out = self.four_cost[place] if len(self.four) else np.zeros((len(keys), len(self.languages)), np.float32)
        new = np.flatnonzero(place < 0)
        if len(new):
            k = keys[new]
            short = k & np.uint32(0xFFFFFF)
            out[new] = self.pair_escape[short >> 8] + self.pair_cost[short & np.uint32(0xFFFF)]
            if len(self.three):
                at = np.minimum(np.searchsorted(self.three, short), len(self.three) - 1)
                known = self.three[at] == short
                out[new[known]] = self.three_cost[at[known]]
                at = np.minimum(np.searchsorted(self.context, k >> 8), len(self.context) - 1)
                known = self.context[at] == k >> 8
                out[new[known]] += self.context_cost[at[known]]
        return out

    def code_lengths(self, column: pa.Array) -> np.ndarray:
        """Bits of each text under each language: [rows, languages]."""
        data, offsets = K.text_buffers(column)
        total = np.zeros((len(column), len(self.languages)))
        for keys, start in grams(data, offsets):
            # the texts that this chunk holds a part of
            first = int(np.searchsorted(offsets, start, "right")) - 1
            last = int(np.searchsorted(offsets, start + len(keys), "left"))
            edge = np.maximum(offsets[first:last], start) - start
            filled = np.flatnonzero(np.diff(np.append(edge, len(keys))) > 0)
            total[first + filled] += np.add.reduceat(self.costs(keys), edge[filled], axis=0, dtype=np.float64)
        return total


@dataclass
class Trees:
    """The counts of all branches (a stored table: lang, gram, n), and how they are cut into parts."""

    languages: list[str]
    counts: DataFrame | None
    pairs: dict[str, tuple[np.ndarray, np.ndarray]]
    part_of: np.ndarray  # of each of the 65 536 pairs of bytes
    parts: int

    def part(self, i: int) -> Model:
        """The model of part ``i``."""
        if not self.languages:
            return Model.build({})
        rows, within = self.counts, None
        if self.parts > 1:
            within = self.part_of == i
            pair = F.shiftright("gram", 8).bitwiseAND(0xFFFF)
            wanted = np.flatnonzero(within)
            rows = rows.where(pair.between(int(wanted[0]), int(wanted[-1])))  # parts are ranges of pairs
        found = rows.toArrow()
        names, keys, n = found["lang"].to_numpy(), found["gram"].to_numpy().astype(np.uint32), found["n"].to_numpy()
        counts = {}
        for language in self.languages:
            mine = np.flatnonzero(names == language)
            mine = mine[np.argsort(keys[mine])]
            counts[language] = keys[mine], n[mine].astype(np.float64)
        return Model.build(counts, self.pairs, within)


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang") -> Trees:
    """Trees from the texts of all rows where ``usable`` holds."""
    bounded(docs.sparkSession)
    taught = docs.where(usable & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(language: str) -> pa.RecordBatch:
            parts = held.pop(language)
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([language] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            languages = batch.column(0)
            for language in languages.unique().to_pylist():
                rows = pa.compute.equal(languages, language)
                data, offsets = K.text_buffers(batch.column(1).filter(rows))
                for keys, _ in grams(data, offsets):
                    held.setdefault(language, []).append(np.unique(keys, return_counts=True))
                if sum(len(k) for k, _ in held.get(language, ())) > 2_000_000:
                    yield flush(language)
        for language in list(held):
            yield flush(language)

    summed = stored(taught.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # of each language: the counts of its last two bytes, 65 536 rows at most
    last = summed.groupBy("lang", F.col("gram").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).orderBy("lang", "pair").toArrow()
    names, pair, n = last["lang"].to_numpy(), last["pair"].to_numpy(), last["n"].to_numpy().astype(np.float64)
    languages = sorted(set(names.tolist()))
    part_of = np.zeros(65536, np.int64)
    if not languages:
        return Trees([], None, {}, part_of, 1)
    # the branches below each pair, of all languages together
    sizes = np.zeros(65536, np.int64)
    for r in summed.groupBy(F.shiftright("gram", 8).bitwiseAND(0xFFFF).alias("pair")).agg(F.count("*").alias("k")).collect():
        sizes[r.pair] = r.k
    room, held, part = max(1, CELLS // len(languages)), 0, 0
    for i in np.flatnonzero(sizes):
        if held and held + sizes[i] > room:
            held, part = 0, part + 1
            part_of[i:] = part
        held += int(sizes[i])
    pairs = {language: (pair[names == language].astype(np.uint32), n[names == language]) for language in languages}
    return Trees(languages, summed, pairs, part_of, part + 1)


def _with_code_lengths(rows: DataFrame, model: Model, text: str, bits: str) -> DataFrame:
    """``rows`` with the code lengths of a part added to the sums in ``bits`` (array of double)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at, own = rows.columns.index(text), rows.columns.index(bits)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.code_lengths(batch.column(at))
            so_far = np.array(batch.column(own).to_pylist(), np.float64).reshape(found.shape)
            columns = list(batch.columns)
            columns[own] = pa.array(list(found + so_far), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, rows.schema)


def predict(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), which replace columns of these names."""
    spark = docs.sparkSession
    bounded(spark)
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    letters, bits = fresh_name("letters", [*own, "lang_pred", "score"]), fresh_name("bits", [*own, "lang_pred", "score"])
    target = docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias(letters))
    at, shared = target.columns.index(text), None
    if trees.parts == 1:
        shared = spark.sparkContext.broadcast(trees.part(0))
    else:
        target = target.withColumn(bits, F.array_repeat(F.lit(0.0), len(trees.languages)))
        for i in range(trees.parts):  # a part at a time: the next one is collected when this one has been used
            before, target = target, stored(_with_code_lengths(target, trees.part(i), text, bits))
            discard(before)
    schema = StructType([*(f for f in target.schema.fields if f.name in own), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    known_at, bits_at, languages = len(own), len(own) + 1, np.array(trees.languages, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(known_at).to_numpy(zero_copy_only=False) & bool(len(languages))
            names, score = np.full(len(known), "und", object), np.zeros(len(known))
            if known.any():
                kept = pa.array(known)
                cost = shared.value.code_lengths(batch.column(at).filter(kept)) if shared else np.array(batch.column(bits_at).filter(kept).to_pylist(), np.float64)
                names[known] = languages[cost.argmin(axis=1)]
                score[known] = 1 / np.exp2((cost.min(axis=1, keepdims=True) - cost) / SCALE).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(names, pa.string()), pa.array(score)], names=[f.name for f in schema.fields])

    return target.mapInArrow(run, schema)


def op5_language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; rows whose hash is 0 modulo 5 teach nothing."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    trees = fit(docs.select("doc_id", "text", "lang"), ~held_out)
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), trees).select("doc_id", "held_out", "lang_pred", "score")
