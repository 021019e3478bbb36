"""Toxicity: bags of subword embeddings, averaged into a linear softmax.

A text's words (runs of letters, lower-cased) give their character n-grams,
word ends included; each hashed n-gram has a vector, the text's vector is their
mean, and a linear softmax reads it. Vectors and softmax are trained together
in numpy. A misspelling shares most n-grams with the word it comes from, so it
needs no entry of its own. Scores are calibrated: every sampled row is scored
by a model that has not seen it, and a slope and a bias are fitted to these
scores at the classes' rates among all labelled rows.

Defined results
- Null or empty text, or one without letters: the score of an empty bag (the model's bias).
- Null doc_id: held_out is null; never learnt from. Repeated rows are scored row by row; of rows that share an id
  one is learnt from, that whose n-grams come first.
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

from .additive import fold
from .wordnum import mix64, slices

#: Labelled rows of each class that the model is fitted on at most (a hash of the id chooses).
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_500, 2_500
FOLDS, HELD_FOLD = 4, 2
THRESHOLD = 0.3
BUCKET_BITS, DIMS, EPOCHS, MIN_STEPS, BATCH, RATE = 17, 4, 6, 150, 100, 0.02
PARTS = 3  # of the sampled rows, each scored by the model of the others
_GRAMS = (3, 4, 5)
_SCALE = 50.0  # of a mean vector, so that a rare word in a long text still counts
_LETTER = np.zeros(128, bool)
_LETTER[97:123] = True
_MUL = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(max(_GRAMS))]


def grams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts in order, and each text's slice in them (len + 1)."""
    low = [(t or "").lower() for t in texts]
    chars = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = chars >= 128
    small = ~letter
    letter[small] = _LETTER[chars[small]]
    code = np.where(letter, chars, 1).astype(np.uint64)
    places, hashes = [], []
    for n in _GRAMS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        ok = np.ones(m, bool)
        for k in range(1, n - 1):
            ok &= letter[k : k + m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h += code[at + k] * _MUL[k]
        hashes.append((mix64(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        places.append(at)
    ends = np.cumsum([len(t) + 1 for t in low])
    cuts = np.zeros(len(low) + 1, np.int64)
    if not hashes:
        return np.zeros(0, np.int32), cuts
    of = np.searchsorted(ends, np.concatenate(places), side="right")  # a gram starts at the break before its text at the earliest
    keep = of < len(low)
    ids, of = np.concatenate(hashes)[keep], of[keep]
    order = np.argsort(of, kind="stable")
    np.cumsum(np.bincount(of, minlength=len(low)), out=cuts[1:])
    return ids[order], cuts


class SubwordModel:
    """The trained model with its softmax folded into one weight an n-gram: the mean of products is the product of the mean."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def logits(self, ids: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
        """Of bags: distinct n-grams and how often each is there."""
        return np.array([self.bias + self.weights[i] @ c / max(1, c.sum()) for i, c in zip(ids, counts, strict=True)])

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        ids, cuts = grams(texts)
        total = np.zeros(len(ids) + 1)
        np.cumsum(self.weights[ids], out=total[1:])
        n = np.maximum(np.diff(cuts), 1)
        z = self.bias + (total[cuts[1:]] - total[cuts[:-1]]) / n
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(ids: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, seed: int = 11) -> SubwordModel:
    """Adam on the softmax loss of vectors and output weights together.

    The first dimension starts at each n-gram's log ratio of document rates, the others near zero.
    """
    size = 1 << BUCKET_BITS
    if len(y) == 0:
        return SubwordModel(np.zeros(size), 0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(np.unique(y)) < 2:
        return SubwordModel(np.zeros(size), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    seen = [np.ones(size), np.ones(size)]  # documents of each class with the n-gram, one more each
    for i, label in zip(ids, y, strict=True):
        seen[int(label)][i] += 1
    vectors = rng.normal(0, 0.01, (size, DIMS)).astype(np.float32)
    vectors[:, 0] = 0.5 * (np.log(seen[1] / (y.sum() + 2)) - np.log(seen[0] / (len(y) - y.sum() + 2)))
    out = rng.normal(0, 0.1, (DIMS, 2)).astype(np.float32)
    out[0] = (-1, 1)
    bias = np.log([1 - share, share]).astype(np.float32)
    shares = [c.astype(np.float32) * np.float32(_SCALE / max(1, c.sum())) for c in counts]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, out, bias)]
    step, batches = 0, -(-len(y) // BATCH)
    epochs = max(EPOCHS, -(-MIN_STEPS // batches))
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), batches):
            at = np.concatenate([ids[i] for i in part])
            w = np.concatenate([shares[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(ids[i]) for i in part])
            cells = vectors[at] * w[:, None]
            bag = np.stack([np.bincount(row, cells[:, k], len(part)) for k in range(DIMS)], axis=1).astype(np.float32)
            z = bag @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part].astype(int)] -= 1
            p /= len(part)
            back = (p @ out.T)[row] * w[:, None]
            g = np.stack([np.bincount(at, back[:, k], size) for k in range(DIMS)], axis=1).astype(np.float32)
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for q, grad, (m, v) in zip((vectors, out, bias), (g, bag.T @ p, p.sum(0)), state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    odds = out[:, 1] - out[:, 0]
    return SubwordModel((vectors @ odds).astype(np.float64) * _SCALE, float(bias[1] - bias[0]))


def calibrated(ids: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 11) -> SubwordModel:
    """fit() with the slope and bias that suit the logits of rows which the model has not seen, row i counted weight[i] times."""
    model = fit(ids, counts, y, seed)
    if min((y == v).sum() for v in (0, 1)) < 2 * PARTS:
        return model
    unseen, part = np.zeros(len(y)), np.random.default_rng(seed).permutation(np.arange(len(y)) % PARTS)
    for k in range(PARTS):
        rest, mine = np.flatnonzero(part != k), np.flatnonzero(part == k)
        other = fit([ids[i] for i in rest], [counts[i] for i in rest], y[rest], seed)
        unseen[mine] = other.logits([ids[i] for i in mine], [counts[i] for i in mine])
    x, weight = np.stack([unseen, np.ones_like(unseen)], axis=1), weight / weight.mean()
    start = np.array([1.0, np.log(weight[y == 1][0] / weight[y == 0][0])])
    line = start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 0.01 * (line - start)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), slope)
        line -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    a = max(0.1, line[0])
    return SubwordModel(model.weights * a, float(model.bias * a + line[1]))


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> SubwordModel:
    """Fits the model on at most toxic_rows + clean_rows labelled documents outside the held-out fold."""
    known = labels.select(labels[id_col].alias("ident"), labels[label_col].cast("int").alias("label"))
    known = known.where(F.col("ident").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("ident"), FOLDS) != HELD_FOLD))
    rate = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    picks = [known.where(F.col("label") == v).orderBy(F.xxhash64("ident"), "ident").limit(n) for v, n in ((1, toxic_rows), (0, clean_rows))]
    joined = docs.select(docs[id_col].alias("ident"), docs[text_col].alias("text")).join(F.broadcast(picks[0].unionByName(picks[1])), "ident")
    schema = T.StructType([T.StructField(c, t) for c, t in (("ident", T.StringType()), ("label", T.IntegerType()), ("ids", T.BinaryType()), ("counts", T.BinaryType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 18):
                ids, cuts = grams(part.column("text").to_pylist())
                bags = [np.unique(ids[a:b], return_counts=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.record_batch(
                    [part.column("ident"), part.column("label"), pa.array([u.astype(np.uint32).tobytes() for u, _ in bags], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in bags], pa.binary())],
                    ["ident", "label", "ids", "counts"],
                )

    joined = joined.select(F.col("ident").cast("string").alias("ident"), "label", "text")
    # one row an id and label, so no more than were chosen
    bags = joined.mapInArrow(measure, schema).groupBy("ident", "label").agg(F.min(F.struct("ids", "counts")).alias("bag"))
    got = bags.select("ident", "label", "bag.*").toPandas().sort_values(["ident", "label"])
    y = got["label"].to_numpy(float)
    weight = np.array([rate.get(int(v), 1) / (y == v).sum() for v in y])
    return calibrated([np.frombuffer(b, np.uint32).astype(np.int32) for b in got["ids"]], [np.frombuffer(b, np.uint32) for b in got["counts"]], y, weight)


def score_toxicity(docs: DataFrame, model: SubwordModel, keep: Sequence[str] = ("doc_id",), text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """keep's columns with score and predicted; one pass, whole texts."""
    slim = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text_col].alias("text"))
    schema = T.StructType([slim.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 19):
                s = model.score(part.column("text").to_pylist())
                yield pa.record_batch([part.column("row"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["row", "score", "predicted"])

    return slim.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    out = score_toxicity(docs, model)
    return out.select("row.doc_id", (fold(F.col("row.doc_id"), FOLDS) == HELD_FOLD).alias("held_out"), "score", "predicted")
