"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

*Random indexing*: every token (a lower-cased pre-token, so that runs of symbols and line ends count as
well) has a sparse ternary index vector, derived from its hash.  The vector of a token is the sum of the index
vectors of the tokens around it, over the training texts, scaled to unit length.

*Pooling*: mean and mean square of the vectors of a text's tokens, the mean product of successive vectors, the
shares of tokens that repeat the last or the last but one and of those without a vector, and logarithms of
the numbers of tokens and lines.

*Network*: one hidden layer of tanh units, trained with Adam on the cross-entropy; the logits are divided
by a temperature that minimises the cross-entropy on a fifth of the sample, which the network has not seen.

The fit uses a bounded sample of the labelled rows: about ``max_docs`` documents and ``max_bytes`` bytes at
most, one text of each doc_id, none above MAX_TEXT bytes, chosen by hashes of doc_id against thresholds that
are computed from the number of all labelled rows and the bytes of the documents so chosen.  The word vectors are part of this fit: words
outside the sample have none and count in the share of unknown tokens.  So what the driver holds and what
is broadcast is bounded; scoring reads every whole text, without a shuffle.

Defined results: null and empty texts get the score of a text without tokens; rows without a label, or
whose label is neither 0 nor 1, teach nothing; several labels of one doc_id count as their maximum; where one
of the classes has no row every score is the share of label 1 (0.5 without labels); an empty table gives an
empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import kernels as K
from .session import bounded, discard, stored

U64 = np.uint64
#: Bounds of the sample that the model is fitted on.
MAX_DOCS, MAX_BYTES = 4000, 16_000_000
#: Longer texts don't teach, so that no single one breaks the bound.
MAX_TEXT = 1 << 20
#: Size of a vector, nonzero places of an index vector, tokens to either side that count as context.
SIZE, NONZERO, REACH = 64, 4, 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.01, 1e-4
#: Tokens whose vectors are gathered at a time.
GATHER = 1 << 15
#: Score from which a text counts as good.
ACCEPT = 0.7


def tokens(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hash, row and line end (0 or 1) of each token, a block of texts at a time."""
    for data, offsets, rows in K.blocks(column):
        points, at = K.code_points(data, offsets)
        starts = K.pretoken_starts(points, at)
        hashes = K.span_hashes(K.lower_table()[points], starts, np.append(starts[1:], len(points)) if len(starts) else starts)
        yield hashes, rows[np.searchsorted(at, starts, "right") - 1], (points[starts] == 10).astype(np.int64)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def features(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Pooled features of each text."""
        n = len(column)
        total, square = np.zeros((n, SIZE)), np.zeros((n, SIZE))
        count, known, lines, product = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        again = np.zeros((2, n))
        for hashes, rows, ends in tokens(column):
            count += np.bincount(rows, minlength=n)
            lines += np.bincount(rows, weights=ends, minlength=n)
            for lag in (1, 2):
                same = (hashes[lag:] == hashes[:-lag]) & (rows[lag:] == rows[:-lag])
                again[lag - 1] += np.bincount(rows[lag:], weights=same, minlength=n)
            if not len(self.words):
                continue
            place = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = np.flatnonzero(self.words[place] == hashes)
            if not len(hit):
                continue
            known += np.bincount(rows[hit], minlength=n)
            for c in range(0, len(hit), GATHER):
                lead = int(c > 0)  # the token before the chunk, for its product with the first one
                part = hit[c - lead : c + GATHER]
                vectors, row = self.vectors[place[part]], rows[part]
                near = np.einsum("ij,ij->i", vectors[1:], vectors[:-1]) * (row[1:] == row[:-1])
                product += np.bincount(row[1:], weights=near, minlength=n)
                vectors, row = vectors[lead:], row[lead:]
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                # a text may come in several parts: its sums add up
                np.add.at(total, row[first], np.add.reduceat(vectors, first, axis=0))
                vectors *= vectors
                np.add.at(square, row[first], np.add.reduceat(vectors, first, axis=0))
        some = np.maximum(known, 1)[:, None]
        every = np.maximum(count, 1)
        extra = np.stack([1 - known / every, np.log1p(count), np.log1p(lines), product / some[:, 0], again[0] / every, again[1] / every], axis=1)
        return np.concatenate([total / some * 8, square / some * SIZE, extra], axis=1)

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((features - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def scores(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        return _sigmoid(self.logits(self.features(column)) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def index_places(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of the index vectors: [words, NONZERO]."""
    bits = K.mix64(words)[:, None] >> (U64(8) * np.arange(NONZERO, dtype=U64))[None, :]
    return (bits & U64(SIZE - 1)).astype(np.int64), np.where((bits >> U64(7)) & U64(1), 1.0, -1.0)


def word_vectors(column: pa.Array | pa.ChunkedArray, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the tokens that occur ``least`` times, and their unit vectors.

    Sums are added in place, a chunk of tokens at a time, so the driver holds little beside tokens and vectors.
    """
    hashes, rows = [np.zeros(0, U64)], [np.zeros(0, np.int32)]
    for h, r, _ in tokens(column):
        hashes.append(h)
        rows.append(r.astype(np.int32))
    hashes, rows = np.concatenate(hashes), np.concatenate(rows)
    words, count = np.unique(hashes, return_counts=True)
    words = words[count >= least]
    total = np.zeros(len(words) * SIZE, np.float32)
    if not len(words):
        return words, total.reshape(0, SIZE)
    step = 1 << 17
    for start in range(0, len(hashes), step):
        # the chunk with the tokens in reach on either side
        low, high = max(0, start - REACH), min(len(hashes), start + step + REACH)
        near, row = hashes[low:high], rows[low:high]
        own = np.arange(start, min(start + step, len(hashes))) - low
        place = np.minimum(np.searchsorted(words, near[own]), len(words) - 1)
        known = words[place] == near[own]
        own, place = own[known], place[known]
        places, signs = index_places(near)
        for lag in (*range(-REACH, 0), *range(1, REACH + 1)):
            other = own + lag
            ok = (other >= 0) & (other < len(near))
            ok[ok] = row[other[ok]] == row[own[ok]]
            at, context = place[ok] * SIZE, other[ok]
            for k in range(NONZERO):
                np.add.at(total, at + places[context, k], signs[context, k].astype(np.float32))
    vectors = total.reshape(-1, SIZE)
    vectors /= np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-9)
    return words, vectors


def gradients(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy and half of DECAY times the squares of the weights, for each layer."""
    hidden = np.tanh(x @ layers[0] + layers[1])
    error = (_sigmoid(hidden @ layers[2] + layers[3][0]) - y) / len(x)
    back = np.outer(error, layers[2]) * (1 - hidden * hidden)
    return [x.T @ back + DECAY * layers[0], back.sum(axis=0), hidden.T @ error + DECAY * layers[2], error.sum(keepdims=True)]


def train_network(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Weights of the two layers, by Adam over shuffled batches."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(EPOCHS):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            at = order[i : i + 128]
            step += 1
            for j, g in enumerate(gradients(layers, x[at], y[at])):
                first[j] += 0.1 * (g - first[j])
                second[j] += 0.001 * (g * g - second[j])
                layers[j] = layers[j] - rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    return layers


def fit_model(texts: pa.Array, y: np.ndarray) -> Model:
    """The model of a sample of texts with labels 0 and 1."""
    y = y.astype(float)
    if not len(y) or y.min() == y.max():
        empty = np.zeros((0, SIZE), np.float32)
        return Model(np.zeros(0, U64), empty, np.zeros(0), np.ones(0), [], 1.0, float(y.mean()) if len(y) else 0.5)
    held = np.random.default_rng(3).permutation(len(y)) % 5 == 0
    if len(y) < 50 or len(set(y[~held])) < 2:
        held[:] = False
    # the vectors see no labels; those of the held-out fifth come from the other texts alone as well
    model = Model(*word_vectors(texts.filter(pa.array(~held))), np.zeros(0), np.ones(0), [], 1.0)
    x = model.features(texts)
    model.mean, model.scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
    model.layers = train_network((x[~held] - model.mean) / model.scale, y[~held])
    if held.any():
        logits, truth = model.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(10), 120))
        p = np.clip(_sigmoid(logits[None, :] / grid[:, None]), 1e-12, 1 - 1e-12)
        model.temperature = float(grid[(-(truth * np.log(p) + (1 - truth) * np.log(1 - p))).mean(axis=1).argmin()])
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits on a bounded sample of the labelled rows (doc_id, label) where ``usable`` (on doc_id) holds."""
    bounded(docs.sparkSession)
    truth = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & usable).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    n = truth.count()

    def share(seed: int, wanted: float) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(min(1.0, wanted) * (1 << 30))

    # about max_docs rows of two numbers
    sample = F.broadcast(truth.where(share(11, max_docs / max(n, 1))))
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.octet_length("text") <= MAX_TEXT)
    chosen = stored(texts.join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")))
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = chosen.where(share(12, max_bytes / max(size, 1))).toArrow()
    discard(chosen)
    if not rows.num_rows:
        return fit_model(pa.array([], pa.large_string()), np.zeros(0))
    rows = rows.sort_by("doc_id")
    model = fit_model(rows["text"].combine_chunks(), rows["y"].to_numpy())
    del rows
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the probability of label 1."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    target = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out])
    at = target.columns.index(text)
    schema = StructType([*target.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch.column(at)))], names=schema.fieldNames())

    return target.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that teach nothing: crc32 of doc_id is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op8_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(docs, labels, ~held_out())
    scored = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
