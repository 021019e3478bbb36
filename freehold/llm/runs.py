"""Periodic runs of words, by common extensions over a difference cover and a harmonic grid.

A run is a stretch of words that repeats with a period and can't be made longer.
For each period p the pairs (j, j + p) are tried where j is a multiple of
max(least - p, (times - 1) * p): every run of that period that is long enough
holds one of them. How far such a pair agrees to the right and to the left is a
common extension of two suffixes, of the words and of the words reversed.
Suffixes are sorted only where a difference cover has their position; two
positions get to sampled ones in a few words, which are compared, and the rest
is a range minimum over the sorted suffixes' common prefixes (sparse table).
All documents of a slice share one such index; a word of its own between them
keeps extensions inside a document.

Defined results
- Null, empty or blank texts have no words: no runs, four nulls, the digests of nothing.
- Repeated rows are judged row by row; columns that aren't asked for don't matter, whatever their names.
- Any length: a text is one row, the grid is tried in blocks of GRID_CELLS pairs. Empty table: no rows.
- Words are told apart by their bytes, never by a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WORD
from .wordnum import flat, slices, word_spans

#: A perfect difference set: every shift modulo COVER is the difference of two of these.
COVER, RESIDUES = 31, (0, 1, 3, 8, 12, 18)
#: Pairs of the grid that are tried at once.
GRID_CELLS = 1 << 20
LEAST_WORDS, LEAST_TIMES = 24, 3


def _shifts() -> np.ndarray:
    """For two positions modulo COVER, the least step that takes both into the cover."""
    inside = np.zeros(2 * COVER, bool)
    inside[[r + k for r in RESIDUES for k in (0, COVER)]] = True
    a, b = np.meshgrid(np.arange(COVER), np.arange(COVER), indexing="ij")
    steps = np.arange(COVER)
    return (inside[(a[..., None] + steps) % COVER] & inside[(b[..., None] + steps) % COVER]).argmax(axis=2)


_SHIFT = _shifts()


class Extensions:
    """Longest common prefixes of any two suffixes of a sequence of non-negative numbers whose last one stands nowhere else."""

    def __init__(self, seq: np.ndarray):
        self.n, self.seq = len(seq), np.concatenate([seq.astype(np.int64), np.full(COVER, -1, np.int64)])
        at = np.flatnonzero(np.isin(np.arange(self.n) % COVER, RESIDUES))
        self.slot = np.full(self.n + 1, -1, np.int64)
        self.slot[at] = np.arange(len(at))
        order, rank = self._first_words(at)
        levels, step = [(COVER, rank)], COVER
        while len(at) and rank[order[-1]] < len(at) - 1:
            ahead = at + step
            key = rank * (len(at) + 1) + np.where(ahead < self.n, rank[self.slot[np.minimum(ahead, self.n)]] + 1, 0)
            order = np.argsort(key, kind="stable")
            rank = np.empty(len(at), np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            step *= 2
            levels.append((step, rank))
        self.rank = rank
        self.table = self._minima(self._neighbours(at[order], levels))

    def _first_words(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and rank of the sampled suffixes by their first COVER words, some words packed into one key."""
        bits = int(self.seq.max(initial=0) + 2).bit_length()
        each = max(1, 62 // bits)
        keys = []
        for c in range(0, COVER, each):
            key = np.zeros(len(at), np.int64)
            for t in range(c, min(c + each, COVER)):
                key = (key << bits) | (self.seq[np.minimum(at + t, self.n)] + 1)
            keys.append(key)
        order = np.lexsort(keys[::-1])
        rank, change = np.empty(len(at), np.int64), np.zeros(len(at), bool)
        for key in keys:
            change[1:] |= np.diff(key[order]) != 0
        rank[order] = np.cumsum(change)
        return order, rank

    def _neighbours(self, sorted_at: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Common prefix of each two suffixes that are neighbours in the order."""
        i, j = sorted_at[:-1].copy(), sorted_at[1:].copy()
        length = np.zeros(len(i), np.int64)
        for step, rank in reversed(levels):
            same = np.flatnonzero((i < self.n) & (j < self.n))
            same = same[rank[self.slot[i[same]]] == rank[self.slot[j[same]]]]
            for x in (i, j, length):
                x[same] += step
        live = np.arange(len(i))
        for _ in range(COVER):
            live = live[self.seq[np.minimum(i[live], self.n)] == self.seq[np.minimum(j[live], self.n)]]
            if not len(live):
                break
            for x in (i, j, length):
                x[live] += 1
        return length

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        """Minima of all stretches whose length is a power of two."""
        table, width = [values], 1
        while 2 * width <= len(values):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at i and j (i != j, both within the sequence)."""
        out = np.zeros(len(i), np.int64)
        shift = _SHIFT[i % COVER, j % COVER]
        live, k, met = np.arange(len(i)), 0, []
        while len(live):
            ready = shift[live] == k
            met.append(live[ready])
            live = live[~ready]
            out[live] = k
            live = live[self.seq[i[live] + k] == self.seq[j[live] + k]]
            k += 1
        met = np.concatenate(met) if met else live
        if len(met):
            a, b = self.rank[self.slot[i[met] + shift[met]]], self.rank[self.slot[j[met] + shift[met]]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            least = np.empty(len(met), np.int64)
            for x in np.unique(level).tolist():
                rows = np.flatnonzero(level == x)
                least[rows] = np.minimum(self.table[x][low[rows]], self.table[x][high[rows] - (1 << x)])
            out[met] = shift[met] + least
        return out


def _grid(sizes: np.ndarray, starts: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, periods) to try, in blocks; a text of n words at starts[k] has periods up to n // times."""
    most = np.where(sizes >= least, sizes // times, 0)
    ends = np.cumsum(most)
    total, first = int(ends[-1]) if len(ends) else 0, 0
    while first < total:
        # at most GRID_CELLS // 8 (text, period) pairs at a time; their cells are dealt out below
        rows = np.arange(first, min(total, first + GRID_CELLS // 8))
        text = np.searchsorted(ends, rows, side="right")
        period = rows - (ends[text] - most[text]) + 1
        step = np.maximum(least - period, (times - 1) * period)
        cells = -(-(sizes[text] - period) // step)
        cum = np.concatenate([[0], np.cumsum(cells)])
        for low in range(0, int(cum[-1]), GRID_CELLS):
            cell = np.arange(low, min(int(cum[-1]), low + GRID_CELLS))
            row = np.searchsorted(cum, cell, side="right") - 1
            yield starts[text[row]] + (cell - cum[row]) * step[row], period[row]
        first += len(rows)


def find_runs(texts: Sequence[np.ndarray], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of the texts (arrays of word numbers), by text, start and period.

    A run has its smallest period q, at least max(least, times * q) words (times
    is 2 at least), and no neighbouring word carries it on.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    vocabulary = max((int(t.max()) for t in texts if len(t)), default=-1) + 1
    starts = np.cumsum(sizes + 1) - sizes  # a word of its own before each text, and one at the end
    seq = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    seq[np.concatenate([starts - 1, [len(seq) - 1]])] = vocabulary + np.arange(len(texts) + 1)
    for a, t in zip(starts.tolist(), texts, strict=True):
        seq[a : a + len(t)] = t
    right = left = None
    found = [np.zeros((3, 0), np.int64)]
    for at, period in _grid(sizes, starts, least, times):
        same = np.flatnonzero(seq[at] == seq[at + period])
        if not len(same):
            continue
        at, period = at[same], period[same]
        if right is None:
            right, left = Extensions(seq), Extensions(seq[::-1])
        end = at + period + right(at, at + period)
        start = at - left(len(seq) - at, len(seq) - at - period)
        long = np.flatnonzero(end - start >= np.maximum(least, times * period))
        found.append(np.unique(np.stack([start[long], end[long], period[long]]), axis=1))
    start, end, period = np.unique(np.concatenate(found, axis=1), axis=1)
    # of one stretch the least period; the others are its multiples
    first = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 0) | (np.diff(end) != 0)])) if len(start) else np.zeros(0, np.int64)
    start, end, period = start[first], end[first], period[first]
    text = np.searchsorted(starts, start, side="right") - 1
    order = np.lexsort((period, start, text))
    return text[order], (start - starts[text])[order], (end - start)[order], period[order]


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after another, and each text's slice in them (len + 1)."""
    data, offsets = flat(column)
    starts, ends, cut = word_spans(data, offsets)
    sizes = ends - starts
    to = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.arange(int(to[-1])) + np.repeat(starts - to[:-1], sizes)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside]))]), cut


def _judge(column: pa.Array, least: int, times: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Each text's runs (start, length, period), and its words without the later repeats of a run, joined by one space."""
    words, cut = _words(column)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text, start, length, period = find_runs([ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], least, times)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, cut[text] + start + period, 1)
    np.add.at(edge, cut[text] + start + length, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.searchsorted(kept, cut)), words.take(pa.array(kept))), pa.scalar(b" ", pa.large_binary()))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    for k, *run in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        runs[k].append(tuple(run))
    return runs, joined.to_pylist()


def periodic_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", least: int = LEAST_WORDS, times: int = LEAST_TIMES, with_text: bool = True) -> DataFrame:
    """(row, runs, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed, collapsed_sha256), a row a document.

    runs holds (start, length, period) of every run by start, then period;
    start to exponent_milli are of the run that repeats most often (ties: the
    first). collapsed is the text without what a run says again, null unless
    with_text.
    """
    slim = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text_col].alias("text"))
    run_type = "array<struct<start:bigint,length:bigint,period:bigint>>"
    names = ["runs", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed", "collapsed_sha256"]
    kinds = [run_type, *["bigint"] * 5, *["string"] * 3]
    schema = T.StructType([slim.schema["row"], *[T.StructField(n, T.DataType.fromDDL(k)) for n, k in zip(names, kinds, strict=True)]])
    as_struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                runs, collapsed = _judge(part.column("text"), least, times)
                best = [min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if r else (None, None, None) for r in runs]
                columns = [
                    pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs], as_struct),
                    pa.array([len(r) for r in runs], pa.int64()),
                    *[pa.array([b[k] for b in best], pa.int64()) for k in range(3)],
                    pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64()),
                    pa.array([hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in r).encode()).hexdigest() for r in runs]),
                    pa.array([x.decode() for x in collapsed] if with_text else [None] * len(runs), pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in collapsed]),
                ]
                yield pa.record_batch([part.column("row"), *columns], ["row", *names])

    return slim.mapInArrow(run, schema)


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): for a tenth of the ids, words from some word on are replaced by a loop of the next few.

    The words are a column of their own first, so they are split once, and of that tenth only.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    split = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("_words"))
    n, g = F.nullif(F.size("_words").cast("bigint"), F.lit(0)), F.floor(F.col("_h") / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    once = F.slice("_words", (a + 1).cast("int"), p.cast("int"))
    loop = F.slice(F.flatten(F.array_repeat(once, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return split.select("doc_id", F.when(n > 0, F.array_join(F.concat(F.slice("_words", F.lit(1), a.cast("int")), loop), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = periodic_runs(looped(docs), with_text=False)
    return out.select("row.doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
