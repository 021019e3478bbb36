"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in a cycle; each turn fits a shallow tree to
one feature's binned gradients and adds it to that feature's lookup table. Then
the pairs that explain most of what is left get tables over two features. A
score is the sum of one cell of each table, so scoring is vectorised bin
additions in the pass that reads the texts; nothing is shuffled.

Defined results
- Null or empty text: features of an empty text, scored like any other.
- Null doc_id: held_out is null; never learnt from. Repeated rows are scored row by row; of rows that share an id
  one is learnt from, that whose features come first.
- No labelled rows to learn from: every score is 0.5. One class only: its smoothed share.
- Empty table: no rows. Columns named in ``keep`` pass through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordnum import flat, slices, windows, word_hashes, word_spans

#: Labelled rows that the model is fitted on at most (a hash of the id chooses); only their features leave the executors.
SAMPLE_ROWS = 20_000
FOLDS, HELD_FOLD = 5, 0
THRESHOLD = 0.3
BINS, PAIR_BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 48, 12, 60, 8, 20, 0.15

_CLASS = np.full(256, 6, np.uint8)  # bytes above 127 and controls
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\v\f\r", ".,;:'\"?()-", "!#*$%&|<>=_{}~^@+/\\[]`")):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
FEATURES = ("log_words", "word_len", "lower", "upper", "digit", "blank", "stops", "marks", "high", "distinct", "repeat_3", "repeat_lines", "line_words", "upper_words", "mark_ends", "top_word", "long_words")


def text_features(column) -> np.ndarray:
    """One row of FEATURES a text, from whole texts."""
    data, offsets = flat(column)
    starts, ends, cut = word_spans(data, offsets)
    n, words = len(offsets) - 1, np.diff(cut).astype(float)
    safe, size = np.maximum(words, 1), np.maximum(np.diff(offsets), 1)
    out = np.zeros((n, len(FEATURES)), np.float32)

    def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1)
        np.cumsum(values, out=total[1:])
        return total[at[1:]] - total[at[:-1]]

    out[:, 0] = np.log1p(words)
    out[:, 1] = per_text(ends - starts, cut) / safe
    kinds = _CLASS[data]
    for k in range(7):
        out[:, 2 + k] = per_text(kinds == k, offsets) / size
    hashes = word_hashes(data, starts, ends)
    triples = windows(hashes, 3)
    breaks = np.concatenate([[0], np.cumsum(data == 10)]) if len(data) else np.zeros(1, np.int64)
    first = kinds[starts] if len(starts) else np.zeros(0, np.uint8)
    last = kinds[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    out[:, 13] = per_text((first == 1) & ((last == 1) | (last == 5) | (last == 6)), cut) / safe
    out[:, 14] = per_text(last == 5, cut) / safe
    out[:, 16] = per_text((ends - starts) > 14, cut) / safe
    line_of = breaks[starts] if len(starts) else np.zeros(0, np.int64)
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes, out=prefix[1:])
    for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if b == a:
            continue
        _, counts = np.unique(hashes[a:b], return_counts=True)
        out[i, 9], out[i, 15] = len(counts) / (b - a), counts.max() / (b - a)
        if b - a > 3:
            out[i, 10] = 1 - len(np.unique(triples[a : b - 2])) / (b - a - 2)
        heads = np.concatenate([[a], a + 1 + np.flatnonzero(np.diff(line_of[a:b])), [b]])
        out[i, 11] = 1 - len(np.unique(prefix[heads[1:]] - prefix[heads[:-1]])) / (len(heads) - 1)
        out[i, 12] = np.log1p((b - a) / (len(heads) - 1))
    return out


class AdditiveModel:
    """Lookup tables over binned features and pairs of features."""

    def __init__(self, n_features: int):
        self.cuts = [np.zeros(0)] * n_features
        self.base, self.tables, self.pairs = 0.0, [np.zeros(1)] * n_features, []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1).reshape(len(x), len(self.cuts))

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[b[:, j]]
        for i, j, si, sj, table in self.pairs:
            out += table[b[:, i] // si, b[:, j] // sj]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, lam: float = 1.0) -> np.ndarray:
    """Newton steps of a regression tree over ordered cells with gradient and curvature sums g and h."""
    out = np.full(len(g), g.sum() / (h.sum() + lam))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + lam) + gr**2 / (hr + lam)
        k = int(np.argmax(gain)) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + lam) + 1e-6:
            out[:k], out[k:] = _tree(g[:k], h[:k], depth - 1, lam), _tree(g[k:], h[k:], depth - 1, lam)
    return out


def _tree_2d(g: np.ndarray, h: np.ndarray, lam: float = 1.0) -> np.ndarray:
    """A cut along the better axis, then one along the other axis on each side."""
    best, out = -1.0, None
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        gs, hs = a.sum(1), b.sum(1)
        gl, hl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
        gain = gl**2 / (hl + lam) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + lam)
        if len(gain) == 0:
            continue
        k = int(np.argmax(gain)) + 1
        if gain[k - 1] > best:
            best, t = gain[k - 1], np.empty_like(a)
            for rows in (slice(0, k), slice(k, None)):
                t[rows] = _tree(a[rows].sum(0), b[rows].sum(0), 1, lam)
            out = t.T if flip else t
    return np.zeros_like(g) if out is None else out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    model = AdditiveModel(x.shape[1])
    if len(y) == 0:
        return model
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return model
    model.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    b, raw = model.bins(x), np.full(len(y), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slope()
            step = RATE * _tree(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)), 2)
            table += step
            raw += step[b[:, j]]

    def grid(i: int, j: int, si: int, sj: int, v: np.ndarray) -> np.ndarray:
        ni, nj = (len(model.tables[i]) - 1) // si + 1, (len(model.tables[j]) - 1) // sj + 1
        return np.bincount((b[:, i] // si) * nj + b[:, j] // sj, v, ni * nj).reshape(ni, nj)

    g, h = slope()
    found = []
    for i in range(x.shape[1]):
        for j in range(i):
            si, sj = (-(-len(model.tables[f]) // PAIR_BINS) for f in (i, j))
            gg, hh = grid(i, j, si, sj, g), grid(i, j, si, sj, h)
            t = _tree_2d(gg, hh)
            found.append(((t * gg).sum() - (t * t * hh).sum() / 2, i, j, si, sj))
    model.pairs = [(i, j, si, sj, np.zeros_like(grid(i, j, si, sj, g))) for _, i, j, si, sj in sorted(found, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, si, sj, table in model.pairs:
            g, h = slope()
            step = RATE * _tree_2d(grid(i, j, si, sj, g), grid(i, j, si, sj, h))
            table += step
            raw += step[b[:, i] // si, b[:, j] // sj]
    return model


def fold(ident, folds: int):
    return F.crc32(ident.cast("string").cast("binary")) % folds


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AdditiveModel:
    """Fits the model on at most sample_rows labelled documents outside the held-out fold."""
    known = labels.select(labels[id_col].alias("ident"), labels[label_col].cast("int").alias("label"))
    known = known.where(F.col("ident").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("ident"), FOLDS) != HELD_FOLD))
    known = known.orderBy(F.xxhash64("ident"), "ident", "label").limit(sample_rows)
    joined = docs.select(docs[id_col].alias("ident"), docs[text_col].alias("text")).join(F.broadcast(known), "ident")
    schema = T.StructType([T.StructField("ident", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = text_features(part.column("text"))
                yield pa.record_batch([part.column("ident"), part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["ident", "label", "x"])

    # one row an id and label, so no more than were chosen
    measured = joined.select(F.col("ident").cast("string").alias("ident"), "label", "text").mapInArrow(measure, schema)
    got = measured.groupBy("ident", "label").agg(F.min("x").alias("x")).toPandas()
    x = np.array([np.frombuffer(r, np.float32) for r in got["x"]], np.float32).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got["label"].to_numpy()))  # whatever order the rows came in
    return fit(x[order].astype(float), got["label"].to_numpy(float)[order])


def score_quality(docs: DataFrame, model: AdditiveModel, keep: Sequence[str] = ("doc_id",), text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """keep's columns with score and predicted; one pass, whole texts."""
    slim = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text_col].alias("text"))
    schema = T.StructType([slim.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = model.score(text_features(part.column("text")).astype(float))
                yield pa.record_batch([part.column("row"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["row", "score", "predicted"])

    return slim.mapInArrow(run, schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    out = score_quality(docs, model)
    return out.select("row.doc_id", (fold(F.col("row.doc_id"), FOLDS) == HELD_FOLD).alias("held_out"), "score", "predicted")
