"""Substring dedup by collinear chaining of shared word k-mers.

1. Seeds. Each text's word k-mers are winnowed (the least hash of every window),
   so two copies of a run of WINDOW + K - 1 words share a seed wherever they stand.
2. Matches. Each seed held by several documents names four heads, the least id
   in each of four lanes of hashed ids; every occurrence is matched with the
   heads only. A passage that thousands of documents share gives a few matches
   each, and its least document is always a head.
3. Chains. A document's matches with one head are chained: a chain's score is the
   words its seeds cover less a cost for each word of gap on either side. Best
   predecessors come from a Fenwick tree, within reach on both sides.
   The matches are all there are for seeds that stand once in each of so few
   documents that every one is a head (or that only two have).
4. Alignment. Chains of two matches or more are aligned word by word along their
   matches, extended at both ends, and kept if long and similar enough; of other
   chains the parts are kept that are.
5. Exact runs at crowded seeds. Where a seed has more places than heads, the runs
   of min_words words that hold it are hashed, and each is matched with the first
   document that has it. Two copies of a run select the same seeds inside it, so
   a run with a seed that no other document has stands nowhere else and is left
   out. A run within a passage that step 4 found in a lesser document can be the
   first of its kind, but needs no partner itself.
6. The rest. Crowded places that no passage found so far covers (those of lesser
   documents count) are matched with lesser documents by pairs of seeds, as a
   chain has two seeds within reach of each other at least. Seeds of which no
   document that is uncovered there has a lesser one have no pairs. Documents of
   a pair of seeds that few have meet each other; of one that many have, such as a
   quoted line's, each meets the least document, and where it is uncovered still,
   those that agree with it in three words at one distance from the seeds: an
   alignment that goes on beyond a line has more words that agree than twice those
   that don't, so it has such a run. Runs that many have are the line itself if all
   runs nearer to the seeds are such too, and give the least document only; others
   give all. Those that meet are chained by all their shared seeds and aligned as in
   steps 3 and 4.

Defined results
- Null or empty text, null ids, texts shorter than a seed: no passages; dedup keeps such rows as they are.
- Ids are integers. Repeats inside one document are not passages; repeated rows of one id are one document.
- A passage is reported once for each head it was matched with; an exact run that no lesser document's passage covers, with the first document that has it.
- Every passage of two shared seeds or more that a lesser document has is covered, whatever the number of documents that have its seeds.
- A copy of a lesser document's beginning, whole, is matched with others by that document.
- A long run whose words different first documents have is reported in pieces that overlap.
- Empty table: no rows. Extra columns pass through drop_repeated_passages(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BROADCAST_IDS, Scratch, pick_ids
from .wordnum import flat, mix64, slices, windows, word_hashes, word_spans

K, WINDOW, LANES = 5, 8, 4
#: Places of one seed that one task groups, and the share of documents (one in so many) that seeds of more are told by.
HOT_SEED, SHARE = 20_000, 16
#: Words a passage must have, and the least share of its words that stand in both texts.
MIN_WORDS, MIN_SIMILARITY = 50, 0.8
GAP_COST, MAX_GAP = 0.1, 60
#: Documents of one pair of seeds that meet each other, of more only those that agree in words around it; words on each side that alignment may extend into, and lines whose words are compared at once.
MANY, SIDE, BLOCK = 16, 96, 4000
#: Places of one task's batch of seed pairs, and pairs of documents in a batch that is put out.
_PLACES, _PAIRS = 1 << 15, 1 << 18
#: A text's places are told apart from the next text's in one rising column.
_FAR = 1 << 40
#: Words around a chain that alignment may extend into, and the step to which slices are rounded.
_MARGIN, _STEP = 64, 32
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _winnow(h: np.ndarray, a: int, b: int, window: int) -> np.ndarray:
    """Places of the least hash of every window of h[a:b], the leftmost of equals; all of a shorter run's least."""
    n = b - a
    if n <= 0:
        return np.zeros(0, np.int64)
    if n <= window:
        return np.array([a + int(np.argmin(h[a:b]))])
    view = np.lib.stride_tricks.sliding_window_view(h[a:b], window)
    return np.unique(a + np.arange(n - window + 1) + np.argmin(view, axis=1))


def seeds(docs: DataFrame) -> DataFrame:
    """(seed, doc, pos) of each row of (doc, text)."""
    schema = T.StructType([T.StructField("seed", T.LongType()), T.StructField("doc", docs.schema["doc"].dataType), T.StructField("pos", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 19):
                data, offsets = flat(part.column("text"))
                starts, ends, cut = word_spans(data, offsets)
                h = windows(word_hashes(data, starts, ends), K)
                found = [_winnow(h, a, b - K + 1, WINDOW) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                sizes = [len(f) for f in found]
                if sum(sizes):
                    at = np.concatenate(found)
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    yield pa.record_batch([pa.array(h[at].view(np.int64)), part.column("doc").take(pa.array(row)), pa.array((at - cut[row]).astype(np.int32))], ["seed", "doc", "pos"])

    return docs.mapInArrow(run, schema)


def met_at_seeds(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(seed, doc, pos, crowded, heads) of each place of a seed that several documents hold; heads has (head, y) of the least document of each lane but doc itself.

    Seeds are dealt once, and all that is asked of a seed is told where its places
    lie side by side. Seeds of more than HOT_SEED places, by the count in one
    document of SHARE, aren't dealt: their heads are aggregated and sent to the places.
    """
    found = seeds(docs)
    hot = seeds(docs.where(F.pmod(F.xxhash64("doc"), F.lit(SHARE)) == 0)).groupBy("seed").count().where(F.col("count") * SHARE > HOT_SEED).select("seed")
    hot = scratch.save(hot, "hot")  # at most places / HOT_SEED or so
    n_hot = hot.count()
    few = lambda t: F.broadcast(t) if n_hot <= BROADCAST_IDS else t
    lane = F.pmod(F.xxhash64("doc"), F.lit(LANES))
    kind = docs.schema["doc"].dataType
    heads = T.ArrayType(T.StructType([T.StructField("head", kind), T.StructField("y", T.IntegerType())]))
    schema = T.StructType([T.StructField("seed", T.LongType()), T.StructField("doc", kind), T.StructField("pos", T.IntegerType()), T.StructField("crowded", T.BooleanType()), T.StructField("heads", heads)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            seed = batch.column("seed").to_numpy()
            last = int(np.searchsorted(seed, seed[-1])) if len(seed) else 0
            if last or held and len(seed) and held[-1].column("seed")[-1].as_py() != seed[0]:
                yield from emit([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        yield from emit(held)

    def emit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(parts) if parts else None
        if not part or not part.num_rows:
            return
        seed, doc, pos, lane = (part.column(c).to_numpy() for c in ("seed", "doc", "pos", "lane"))
        start = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
        n = np.diff([*start, len(seed)])
        several = np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start)
        if not several.any():
            return
        kept = np.repeat(several, n)
        seed, doc, pos, lane, n = seed[kept], doc[kept], pos[kept], lane[kept], n[several]
        of = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((pos, doc, of))
        doc, pos, lane = doc[order], pos[order], lane[order]
        order = np.lexsort((lane, of))  # stable: documents rise within a lane
        first = np.flatnonzero(np.concatenate([[True], (of[order][1:] != of[order][:-1]) | (lane[order][1:] != lane[order][:-1])]))
        size = np.diff([*first, len(order)])
        head, y, last, group = doc[order[first]], pos[order[first]], doc[order[first + size - 1]], of[order[first]]
        lanes = np.bincount(group, minlength=len(n))
        pair = np.zeros(len(n), bool)
        pair[group] = (size == 2) & (head < last)
        crowded = (n > lanes) & ~(pair & (lanes == 1))
        begin = np.cumsum(lanes) - lanes  # of a seed's heads
        for a in range(0, len(of), 1 << 16):
            g = of[a : a + (1 << 16)]
            m = lanes[g]
            row = np.repeat(np.arange(len(g)), m)
            at = np.arange(len(row)) + np.repeat(begin[g] - np.cumsum(m) + m, m)
            other = head[at] != doc[a : a + len(g)][row]
            at, m = at[other], np.bincount(row[other], minlength=len(g))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(m)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(head[at]), pa.array(y[at])], ["head", "y"]))
            yield pa.record_batch([pa.array(seed[a : a + len(g)]), pa.array(doc[a : a + len(g)]), pa.array(pos[a : a + len(g)]), pa.array(crowded[g]), lists], schema.fieldNames())

    if not n_hot:
        return found.repartition("seed").sortWithinPartitions("seed").withColumn("lane", lane).mapInArrow(run, schema)
    found = scratch.save(found, "seeds")
    rare = found.join(few(hot), "seed", "left_anti")
    rare = rare.repartition("seed").sortWithinPartitions("seed").withColumn("lane", lane).mapInArrow(run, schema)
    often = found.join(few(hot), "seed", "left_semi")
    least = often.groupBy("seed", lane.alias("lane")).agg(F.min(F.struct("doc", "pos")).alias("h"), F.max("doc").alias("last"), F.count("*").alias("n"))
    pair = (F.count("*") == 1) & (F.max("n") == 2) & F.max(F.col("h.doc") < F.col("last"))
    per = least.groupBy("seed").agg(F.collect_list(F.struct(F.col("h.doc").alias("head"), F.col("h.pos").alias("y"))).alias("all"), ((F.sum("n") > F.count("*")) & ~pair).alias("crowded"), F.min("h.doc").alias("lo"), F.max("last").alias("hi")).where("lo < hi")
    often = often.join(few(scratch.save(per.select("seed", "all", "crowded"), "heads")), "seed").select("seed", "doc", "pos", "crowded", F.filter("all", lambda h: h["head"] != F.col("doc")).alias("heads"))
    return rare.unionByName(often)


class _Fenwick:
    """Greatest entry among the first ranks, as entries come; each entry is (value, match)."""

    def __init__(self, size: int):
        self.size, self.best = size, [(-1e18, -1)] * (size + 1)

    def put(self, rank: int, entry: tuple[float, int]) -> None:
        k = rank + 1
        while k <= self.size:
            if entry > self.best[k]:
                self.best[k] = entry
            k += k & -k

    def before(self, rank: int) -> tuple[float, int]:
        got, k = self.best[0], rank
        while k:
            if self.best[k] > got:
                got = self.best[k]
            k &= k - 1
        return got


def chain(x: np.ndarray, y: np.ndarray, k: int = K) -> list[tuple[int, int, int, int, float, list[int], list[int]]]:
    """Best local chains of matches (x, y), disjoint in x: (x from, x to, y from, y to, score, x and y of each match), ends exclusive.

    f(m) = k + max(0, best over earlier m' of f(m') - cost * (gap in x + gap in y)),
    over the m' that are at most MAX_GAP + k back on both sides. The gap part is
    split into terms of m and of m'; a Fenwick tree over the ranks of y gives the
    match of the greatest f + cost * (x + y) among all that come before on both
    sides, which is the best in reach if it is in reach. Where a long chain that
    ended out of reach comes out instead, the matches in reach are looked
    through. Matches of one diagonal need none of this. The tree begins anew where all it holds is out of reach in x. A
    match that overlaps its predecessor adds only the words it adds.
    """
    order = np.lexsort((-y, x))
    x, y = x[order], y[order]
    score, back, used = [0.0] * len(x), [-1] * len(x), [False] * len(x)
    xs, ys = x.tolist(), y.tolist()
    straight = (np.diff(x) > 0).all() and (np.diff(y - x) == 0).all()
    if straight:  # the match before is the best predecessor of all, as every match on the way adds more than its place costs
        gained = score[0] = float(k)
        for m, d in enumerate(np.diff(x).tolist(), 1):
            gained = gained + min(k, d) - GAP_COST * (2 * max(0, d - k)) if d <= MAX_GAP + k else 0.0
            if gained > k:
                back[m] = m - 1
            else:
                gained = float(k)
            score[m] = gained
        if back.count(-1) == 1 and score[-1] > max(score[:-1], default=0.0):
            return [(xs[0], xs[-1] + k, ys[0], ys[-1] + k, score[-1], xs, ys)]
    dense = not straight and len(xs) >= 24 * len(set(xs))
    if dense:
        _dense(x.astype(np.int64), y.astype(np.int64), k, score, back)
    place = {} if straight or dense else {v: n for n, v in enumerate(sorted(set(ys)))}
    rank = [] if straight or dense else [place[v] for v in ys]
    reach = MAX_GAP + k
    tree = _Fenwick(len(place))
    i = old = 0
    while i < len(xs) and not straight and not dense:
        if i and xs[i - 1] < xs[i] - reach:
            tree = _Fenwick(len(place))
        while xs[old] < xs[i] - reach:
            old += 1
        j = i
        while j < len(xs) and xs[j] == xs[i]:  # matches of one x don't precede each other
            best = tree.before(rank[j])
            if best[1] >= 0 and (best[1] < old or ys[best[1]] < ys[j] - reach):
                best = max([(score[m] + GAP_COST * (xs[m] + ys[m]), m) for m in range(old, i) if ys[j] - reach <= ys[m] < ys[j]], default=(-1e18, -1))
            score[j] = float(k)
            if best[1] >= 0:
                m = best[1]
                dx, dy = xs[j] - xs[m], ys[j] - ys[m]
                gain = score[m] + min(k, dx, dy) - GAP_COST * (max(0, dx - k) + max(0, dy - k))
                if gain > k:
                    score[j], back[j] = gain, m
            j += 1
        for m in range(i, j):
            tree.put(rank[m], (score[m] + GAP_COST * (xs[m] + ys[m]), m))
        i = j
    out = []
    for m in sorted(range(len(xs)), key=lambda m: (-score[m], xs[m], ys[m])):
        if used[m]:
            continue
        on = [m]
        used[m] = True
        while back[on[-1]] >= 0 and not used[back[on[-1]]]:
            on.append(back[on[-1]])
            used[on[-1]] = True
        on.reverse()
        out.append((xs[on[0]], xs[m] + k, ys[on[0]], ys[m] + k, score[m], [xs[i] for i in on], [ys[i] for i in on]))
    return out


def _dense(xs: np.ndarray, ys: np.ndarray, k: int, score: list[float], back: list[int]) -> None:
    """Scores and best predecessors of chain(), a column of one x at a time, for matches that are many to an x."""
    _, rank = np.unique(ys, return_inverse=True)
    n, reach = len(xs), MAX_GAP + k
    begin = np.flatnonzero(np.concatenate([[True], xs[1:] != xs[:-1]])).tolist()
    value, match = np.full(int(rank.max()) + 1, -1e18), np.full(int(rank.max()) + 1, -1)  # of each y, the greatest and the latest of equals
    f, prev, old = np.zeros(n), np.full(n, -1), 0
    for i, j in zip(begin, [*begin[1:], n], strict=True):
        x, y, r = int(xs[i]), ys[i:j], rank[i:j]
        if i and xs[i - 1] < x - reach:
            value[:], match[:] = -1e18, -1
        while xs[old] < x - reach:
            old += 1
        best = np.maximum.accumulate(value)
        new = np.cumsum(np.concatenate([[False], best[1:] > best[:-1]]))
        latest = np.maximum.accumulate(new * n + np.where(value == best, match, 0)) % n
        m = np.where((r > 0) & (best[r - 1] > -1e17), latest[r - 1], -1)
        for t in np.flatnonzero((m >= 0) & ((m < old) | (ys[m] < y - reach))).tolist():
            near = old + np.flatnonzero((ys[old:i] >= y[t] - reach) & (ys[old:i] < y[t]))
            total = f[near] + GAP_COST * (xs[near] + ys[near])
            m[t] = near[len(near) - 1 - int(np.argmax(total[::-1]))] if len(near) else -1
        dx, dy = x - xs[m], y - ys[m]
        gain = f[m] + np.minimum(k, np.minimum(dx, dy)) - GAP_COST * (np.maximum(0, dx - k) + np.maximum(0, dy - k))
        good = (m >= 0) & (gain > k)
        f[i:j], prev[i:j] = np.where(good, gain, float(k)), np.where(good, m, -1)
        total = f[i:j] + GAP_COST * (x + y)
        for t in range(j - i) if (r[1:] == r[:-1]).any() else ():  # a match that is there twice
            if total[t] >= value[r[t]]:
                value[r[t]], match[r[t]] = total[t], i + t
        more = total >= value[r]
        value[r[more]], match[r[more]] = total[more], np.arange(i, j)[more]
    score[:], back[:] = f.tolist(), prev.tolist()


def _chains_of(doc: np.ndarray, head: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Chains of one or more whole groups (doc, head): (row of the group, x from, x to, y from, y to, bytes of the matches' x, and y, as int32)."""
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (head[1:] != head[:-1])]))
    stop = np.concatenate([new[1:], [len(doc)]])
    step = np.diff(x, prepend=x[:1])
    good = (step > 0) & (GAP_COST * 2 * (step - K) < K) & (np.diff(y, prepend=y[:1]) == step)
    good[new] = True
    plain = np.logical_and.reduceat(good, new)  # on one diagonal, and so near that each match adds to the chain
    x4, y4 = x.astype(np.int32), y.astype(np.int32)
    out = []
    for a, b, one in zip(new.tolist(), stop.tolist(), plain.tolist(), strict=True):
        if b - a > 1 and one:
            out.append((a, int(x[a]), int(x[b - 1]) + K, int(y[a]), int(y[b - 1]) + K, x4[a:b].tobytes(), y4[a:b].tobytes()))
        elif b - a > 1:
            out += [(a, *c[:4], *(np.array(v, np.int32).tobytes() for v in c[5:])) for c in chain(x[a:b], y[a:b]) if len(c[5]) > 1]
    return out


def chains(matches: DataFrame) -> DataFrame:
    """(doc, head, x0, x1, y0, y1, sx, sy) from (doc, head, x, y), partitioned and sorted so that groups are contiguous.

    Chains of two matches are kept however short: where words are changed often, both texts select few seeds.
    """
    kinds = matches.schema
    schema = T.StructType([T.StructField("doc", kinds["doc"].dataType), T.StructField("head", kinds["head"].dataType)] + [T.StructField(c, T.IntegerType()) for c in ("x0", "x1", "y0", "y1")] + [T.StructField(c, T.BinaryType()) for c in ("sx", "sy")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            doc = held.column("doc").to_numpy()
            last = int(np.searchsorted(doc, doc[-1], side="left")) if len(doc) and (doc[:-1] <= doc[1:]).all() else 0
            if last:
                yield from emit(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from emit(held)

    def emit(part: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, head, x, y = (part.column(c).to_numpy() for c in ("doc", "head", "x", "y"))
        got = _chains_of(doc, head, x, y)
        if got:
            rows = np.array([g[:5] for g in got], np.int64)
            out = [pa.array(doc[rows[:, 0]], schema_doc), pa.array(head[rows[:, 0]], schema_doc)] + [pa.array(rows[:, k].astype(np.int32)) for k in range(1, 5)]
            out += [pa.array([g[k] for g in got], pa.binary()) for k in (5, 6)]
            yield pa.record_batch(out, ["doc", "head", "x0", "x1", "y0", "y1", "sx", "sy"])

    schema_doc = pa.int64() if isinstance(kinds["doc"].dataType, T.LongType) else pa.int32()
    return matches.repartition("doc").sortWithinPartitions("doc", "head", "x", "y").mapInArrow(run, schema)


def slices_of(requests: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, lo, hi, words): the hashes of words lo to hi of each requested text, as bytes of uint32."""
    asked = requests.distinct().groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("asked"))
    schema = T.StructType([T.StructField("doc", requests.schema["doc"].dataType), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = flat(part.column("text"))
                starts, ends, cut = word_spans(data, offsets)
                h = (word_hashes(data, starts, ends) >> np.uint64(32)).astype(np.uint32)
                rows = [(i, q["lo"], q["hi"]) for i, qs in enumerate(part.column("asked").to_pylist()) for q in qs]
                words = [h[cut[i] + lo : min(cut[i] + hi, cut[i + 1])].tobytes() for i, lo, hi in rows]
                take, lo, hi = (pa.array([r[k] for r in rows], pa.int32()) for k in range(3))
                yield pa.record_batch([part.column("doc").take(take), lo, hi, pa.array(words, pa.binary())], ["doc", "lo", "hi", "words"])

    return texts.join(asked, "doc").select("doc", "text", "asked").mapInArrow(run, schema)


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far two runs go on agreeing from their starts, and the words that agree: +1 a match, -2 a difference, best total."""
    n = min(len(a), len(b))
    if n == 0:
        return 0, 0
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1, -2))
    k = int(np.argmax(total)) + 1
    return (k, int(same[:k].sum())) if total[k - 1] > 0 else (0, 0)


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence of two short runs; equal beginnings and ends go together."""
    n, m = len(a), len(b)
    left = right = 0
    while left < min(n, m) and a[left] == b[left]:
        left += 1
    while right < min(n, m) - left and a[n - 1 - right] == b[m - 1 - right]:
        right += 1
    both = set(a[left : n - right]) & set(b[left : m - right])
    p = [i for i in range(left, n - right) if a[i] in both]
    q = [j for j in range(left, m - right) if b[j] in both]
    best = [[0] * (len(q) + 1)]  # of the runs from a place to the end, last places first
    for i in reversed(p):
        up, row = best[-1], [0]
        for t in range(1, len(q) + 1):
            row.append(up[t - 1] + 1 if a[i] == b[q[-t]] else max(up[t], row[-1]))
        best.append(row)
    out, i, j = [(k, k) for k in range(left)], 0, 0
    while i < len(p) and j < len(q):
        if a[p[i]] == b[q[j]]:
            out.append((p[i], q[j]))
            i, j = i + 1, j + 1
        elif best[len(p) - i - 1][len(q) - j] >= best[len(p) - i][len(q) - j - 1]:
            i += 1
        else:
            j += 1
    return out + [(n - k, m - k) for k in range(right, 0, -1)]


def align(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Places, rising in both texts, of equal words that go together along a chain of matches (sx, sy) and beyond its two ends.

    Between matches of one diagonal words go with those across from them; what
    differs for two words or more, and what lies between diagonals, is aligned by itself.
    """
    px: list[np.ndarray] = []
    py: list[np.ndarray] = []

    def between(a0: int, a1: int, b0: int, b1: int) -> None:
        if a0 < a1 and b0 < b1 and (got := _common(x[a0:a1].tolist(), y[b0:b1].tolist())):
            at = np.array(got)
            px.append(at[:, 0] + a0)
            py.append(at[:, 1] + b0)

    left, _ = _extend(x[: sx[0]][::-1], y[: sy[0]][::-1])
    right, _ = _extend(x[sx[-1] + k :], y[sy[-1] + k :])
    turns = np.flatnonzero(np.diff(sy - sx)) + 1
    u, v = int(sx[0]) - left, int(sy[0]) - left  # words before these are done
    for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(sx)], strict=True):
        d = int(sy[a] - sx[a])
        start, stop = max(int(sx[a]) if a else u, u, v - d), int(sx[b - 1]) + k + (right if b == len(sx) else 0)
        if start >= stop:
            continue
        between(u, start, v, start + d)
        same = np.concatenate([[True], x[start:stop] == y[start + d : stop + d], [True]])
        ends = np.flatnonzero(same)
        u = start
        for t in np.flatnonzero(np.diff(ends) > 2).tolist():  # two words or more that differ
            lo, hi = start + int(ends[t]), start + int(ends[t + 1]) - 1
            at = u + np.flatnonzero(same[u - start + 1 : lo - start + 1])
            px.append(at)
            py.append(at + d)
            between(lo, hi, lo + d, hi + d)
            u = hi
        at = u + np.flatnonzero(same[u - start + 1 : stop - start + 1])
        px.append(at)
        py.append(at + d)
        u, v = stop, stop + d
    return np.concatenate(px), np.concatenate(py)


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of bytes, and where each row's begin (one more than rows)."""
    column = column.cast(pa.large_binary())
    cut = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    if column.buffers()[2] is None or cut[0] == cut[-1]:
        return np.zeros(1, kind), (cut - cut[0]) // width
    return np.frombuffer(column.buffers()[2], np.uint8)[cut[0] : cut[-1]].view(kind), (cut - cut[0]) // width


def _agreeing(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """_extend() for many pairs of runs at once: how far those at x[i], y[j], of n words each, go on agreeing forwards or backwards."""
    out = np.zeros(len(n), np.int64)
    for a in range(0, len(n), 2048):
        m = n[a : a + 2048]
        if not (width := int(m.max())):
            continue
        k = np.arange(width)
        inside = k < m[:, None]
        at = np.where(inside, k * step, 0)
        near = [np.minimum(v[a : a + 2048], len(w) - 1)[:, None] + at for v, w in ((i, x), (j, y))]  # runs of no words may begin beyond the end
        total = np.cumsum(np.where(inside, np.where(x[near[0]] == y[near[1]], 1, -2), -width), axis=1)
        best = np.argmax(total, axis=1)
        out[a : a + 2048] = np.where(np.take_along_axis(total, best[:, None], 1)[:, 0] > 0, best + 1, 0)
    return out


def _too_short(x: pa.Array, y: pa.Array, sx: pa.Array, sy: pa.Array, xlo: np.ndarray, ylo: np.ndarray, min_words: int, k: int = K) -> np.ndarray:
    """Of chains, which align fewer than min_words words: align() goes from the left extension to the right one at most."""
    (wx, xcut), (wy, ycut), (px, cut), (py, _) = _values(x, np.uint32), _values(y, np.uint32), _values(sx, np.int32), _values(sy, np.int32)
    i, j, iend, jend = px[cut[:-1]] - xlo, py[cut[:-1]] - ylo, px[cut[1:] - 1] - xlo + k, py[cut[1:] - 1] - ylo + k
    at = np.flatnonzero((iend <= np.diff(xcut)) & (jend <= np.diff(ycut)))
    left = _agreeing(wx, wy, (xcut[:-1] + i - 1)[at], (ycut[:-1] + j - 1)[at], np.minimum(i, j)[at], -1)
    right = _agreeing(wx, wy, (xcut[:-1] + iend)[at], (ycut[:-1] + jend)[at], np.minimum(np.diff(xcut) - iend, np.diff(ycut) - jend)[at], 1)
    out = np.zeros(len(i), bool)
    out[at] = left + np.minimum(iend - i, jend - j)[at] + right < min_words
    return out


def passages(px: np.ndarray, py: np.ndarray, min_words: int, min_similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(x from, x to, y from, y to, similarity): the whole alignment if it is long and similar enough, else the parts that are.

    Similarity is the share of the longer span's words that agree. Parts start
    and end with a run of agreeing words; as many are given as cover what any
    good enough part covers.
    """
    n = len(px)
    if not n:
        return []

    def spans(i: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = px[j] - px[i] + 1, py[j] - py[i] + 1
        return np.minimum(a, b), (j - i + 1) / np.maximum(a, b)

    def row(i: int, j: int) -> tuple[int, int, int, int, float]:
        return int(px[i]), int(px[j]) + 1, int(py[i]), int(py[j]) + 1, float(spans(i, np.array([j]))[1][0])

    least, share = spans(0, np.array([n - 1]))
    if least[0] < min_words:
        return []
    if share[0] >= min_similarity:
        return [row(0, n - 1)]
    if n < min_words * min_similarity:
        return []
    breaks = np.flatnonzero((np.diff(px) > 1) | (np.diff(py) > 1))
    firsts, lasts = [0, *(breaks + 1).tolist()], np.concatenate([breaks, [n - 1]])
    good: list[tuple[int, int]] = []  # the farthest end of each start, where it lies beyond those before
    for t, i in enumerate(firsts):
        least, share = spans(i, lasts[t:])
        fits = np.flatnonzero((least >= min_words) & (share >= min_similarity))
        if len(fits) and (not good or lasts[t + fits[-1]] > good[-1][1]):
            good.append((i, int(lasts[t + fits[-1]])))
    out: list[tuple[int, int]] = []
    for t, g in enumerate(good):  # left out where the one before and the one after overlap
        if not (out and t + 1 < len(good) and good[t + 1][0] <= out[-1][1]):
            out.append(g)
    return [row(*g) for g in out]


def _run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h, width = mix64(words), 1  # of the runs of a power of two, doubled while they fit
    out, done = np.zeros(len(words) - n + 1, np.uint64), 0
    while width <= n:
        if n & width:
            out = out * _ODD[0] + h[done : done + len(out)]
            done += width
        h = mix64(h[:-width] * _ODD[1] + h[width:])
        width *= 2
    return mix64(out)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a list column, and the elements; null lists have none."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _within(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Of n places, which lie in one of the ranges."""
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0


def _all_shared(kmers: np.ndarray, held: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the runs of n words at the given places, whether all seeds that each selects by itself are held."""
    inside = n - K - WINDOW + 2  # windows that lie within a run
    if inside <= 0 or len(kmers) < WINDOW:
        return np.ones(len(at), bool)
    least = np.arange(len(kmers) - WINDOW + 1) + np.argmin(np.lib.stride_tricks.sliding_window_view(kmers, WINDOW), axis=1)
    lost = np.concatenate([[0], np.cumsum(~held[least])])
    return lost[at + inside] == lost[at]


def crowded_runs(marked: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """(run, doc, pos, free) of the runs of min_words words that hold a place of ``at`` and may stand elsewhere too.

    marked has (doc, at, shared, spans): the crowded and all the shared places of
    a document, and its spans (lo, hi) that are known. A run that a document
    repeats, as where it says one word over and over, is one row: pos is its
    first place, free lists those of its places that lie outside the spans.
    """
    kind = texts.schema["doc"].dataType
    schema = T.StructType([T.StructField("run", T.LongType()), T.StructField("doc", kind), T.StructField("pos", T.IntegerType()), T.StructField("free", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 19):
                data, offsets = flat(part.column("text"))
                begins, ends, cut = word_spans(data, offsets)
                h = word_hashes(data, begins, ends)
                base, runs = cut[:-1], np.maximum(0, np.diff(cut) - min_words + 1)  # a text's first word in the slice, and its runs
                if not runs.any():
                    continue
                clip = lambda row, place: base[row] + np.clip(place, 0, runs[row])  # noqa: B023, E731
                row, pos = _lists(part.column("at"))
                pos = pos.to_numpy()
                here = np.flatnonzero(_within(clip(row, pos + K - min_words), clip(row, pos + 1), len(h)))
                row, pos = _lists(part.column("shared"))
                pos = pos.to_numpy()
                held = np.zeros(len(h), bool)
                inner = pos <= np.diff(cut)[row] - K
                held[(base[row] + pos)[inner]] = True
                here = here[_all_shared(windows(h, K), held, here, min_words)]
                if not len(here):
                    continue
                row, span = _lists(part.column("spans"))
                lo, hi = (span.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
                known = _within(clip(row, lo), clip(row, np.maximum(lo, hi - min_words + 1)), len(h))
                got, row = _run_hashes(h, min_words), np.searchsorted(cut, here, side="right") - 1
                order = np.lexsort((here, got[here], row))
                here, row = here[order], row[order]
                same, free, pos = got[here], ~known[here], (here - cut[row]).astype(np.int32)
                starts = np.flatnonzero(np.concatenate([[True], (same[1:] != same[:-1]) | (row[1:] != row[:-1])]))
                lists = np.concatenate([[0], np.cumsum(np.add.reduceat(free.astype(np.int32), starts))]).astype(np.int32)
                yield pa.record_batch([pa.array(same[starts].view(np.int64)), part.column("doc").take(pa.array(row[starts])), pa.array(pos[starts]), pa.ListArray.from_arrays(pa.array(lists), pa.array(pos[free]))], ["run", "doc", "pos", "free"])

    return texts.join(marked, "doc").select("doc", "text", "at", "shared", "spans").mapInArrow(run, schema)


def _pieces(x: np.ndarray, y: np.ndarray, n: int, known: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(x from, x to, y from) of the fewest exact runs that cover the runs of n words at (x, y), x rising, but those within known spans."""
    cut = np.flatnonzero((np.diff(x) != 1) | (np.diff(y) != 1)) + 1
    firsts, lasts = [0, *cut.tolist()], [*(cut - 1).tolist(), len(x) - 1]
    runs = [(int(x[a]), int(x[b]) + n, int(y[a])) for a, b in zip(firsts, lasts, strict=True)]
    runs = [r for r in runs if not any(lo <= r[0] and r[1] <= hi for lo, hi in known)]
    out: list[tuple[int, int, int]] = []
    for t, r in enumerate(runs):
        if not (out and t + 1 < len(runs) and runs[t + 1][0] <= out[-1][1] - 1):
            out.append(r)
    return out


def exact_passages(runs: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """Rows like those of found: each free place of (run, doc, pos, free) with the first document that has the run, joined to longer ones, without what found has."""
    mine = F.size("free") > 0
    first = runs.groupBy("run").agg(F.min(F.struct("doc", "pos")).alias("h"), F.max(F.when(mine, F.col("doc"))).alias("last")).where("h.doc < last").select("run", F.col("h.doc").alias("head"), F.col("h.pos").alias("y"))
    hits = runs.where(mine).join(first, "run").where("doc <> head").select("doc", "head", F.col("free").alias("xs"), "y", F.lit(-1).alias("until"))
    both = hits.unionByName(found.select("doc", "head", F.array("doc_from").alias("xs"), F.lit(-1).alias("y"), F.col("doc_to").alias("until")))
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            doc = held.column("doc").to_numpy()
            last = int(np.searchsorted(doc, doc[-1], side="left")) if len(doc) else 0
            if last:
                yield from emit(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from emit(held)

    def emit(part: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, head, y, until = (part.column(c).to_numpy() for c in ("doc", "head", "y", "until"))
        lists = pa.concat_arrays(part.column("xs").chunks)
        cut, places = lists.offsets.to_numpy(), lists.values.to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (head[1:] != head[:-1])]))
        rows = []
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(doc)], strict=True):
            hit = y[a:b] >= 0
            if hit.any():
                x, of = places[cut[a] : cut[b]], np.repeat(np.arange(b - a), np.diff(cut[a : b + 1]))
                known = list(zip(x[~hit[of]].tolist(), until[a:b][~hit].tolist(), strict=True))
                x, of = x[hit[of]], of[hit[of]]
                order = np.argsort(x, kind="stable")
                rows += [(a, p, q, r, r + q - p) for p, q, r in _pieces(x[order], y[a:b][of[order]], min_words, known)]
        if rows:
            at = pa.array([r[0] for r in rows])
            ids = [part.column(c).combine_chunks().take(at) for c in ("doc", "head")]
            ids = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in ids]
            yield pa.record_batch([*ids, *[pa.array([r[k] for r in rows], pa.int32()) for k in range(1, 5)], pa.array([1.0] * len(rows))], names)

    return both.repartition("doc").sortWithinPartitions("doc", "head").mapInArrow(run, found.schema)


def aligned(runs: DataFrame, docs: DataFrame, scratch: Scratch, min_words: int, min_similarity: float) -> DataFrame:
    """The passages of chains, (doc, head, doc_from, doc_to, head_from, head_to, similarity), and whether one is all of doc and word by word the beginning of head."""
    down = lambda c: (F.floor(F.greatest(F.lit(0), F.col(c) - _MARGIN) / _STEP) * _STEP).cast("int")
    up = lambda c: (F.ceil((F.col(c) + _MARGIN) / _STEP) * _STEP).cast("int")
    runs = runs.select("*", down("x0").alias("xlo"), up("x1").alias("xhi"), down("y0").alias("ylo"), up("y1").alias("yhi"))
    asked = runs.select("doc", F.col("xlo").alias("lo"), F.col("xhi").alias("hi")).unionByName(runs.select(F.col("head").alias("doc"), F.col("ylo").alias("lo"), F.col("yhi").alias("hi")))
    texts = pick_ids(docs, asked.select("doc").distinct(), "doc").groupBy("doc").agg(F.min("text").alias("text"))
    cut = scratch.save(slices_of(asked, texts), "slices")
    side = lambda d, s, t: cut.select(F.col("doc").alias(d), F.col("lo").alias(f"{s}lo"), F.col("hi").alias(f"{s}hi"), F.col("words").alias(t))
    both = runs.join(side("doc", "x", "xs"), ["doc", "xlo", "xhi"]).join(side("head", "y", "ys"), ["head", "ylo", "yhi"])
    kind = docs.schema["doc"].dataType
    names = ("doc_from", "doc_to", "head_from", "head_to")
    schema = T.StructType([T.StructField("doc", kind), T.StructField("head", kind), *[T.StructField(n, T.IntegerType()) for n in names], T.StructField("similarity", T.DoubleType()), T.StructField("whole", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            short = _too_short(*(batch.column(c) for c in ("xs", "ys", "sx", "sy")), *(batch.column(c).to_numpy() for c in ("xlo", "ylo")), min_words)
            batch = batch.filter(pa.array(~short))
            cols = [batch.column(c).to_numpy() for c in ("x1", "y1", "xlo", "xhi", "ylo")]
            parts = [batch.column(c) for c in ("xs", "ys", "sx", "sy")]
            rows = []
            for i, (x1, y1, xlo, xhi, ylo) in enumerate(zip(*(c.tolist() for c in cols), strict=True)):
                x, y = (np.frombuffer(v[i].as_buffer(), np.uint32) for v in parts[:2])
                sx, sy = (np.frombuffer(v[i].as_buffer(), np.int32) for v in parts[2:])
                if len(x) < x1 - xlo or len(y) < y1 - ylo:
                    continue  # places of another row with the same id
                for a, b, c, d, similarity in passages(*align(x, y, sx - xlo, sy - ylo), min_words, min_similarity):
                    whole = similarity == 1.0 and a + xlo == 0 and c + ylo == 0 and b == len(x) < xhi - xlo
                    rows.append((i, a + xlo, b + xlo, c + ylo, d + ylo, similarity, whole))
            if rows:
                at = pa.array([r[0] for r in rows])
                yield pa.record_batch(
                    [batch.column("doc").take(at), batch.column("head").take(at), *[pa.array([r[k] for r in rows], pa.int32()) for k in range(1, 5)], pa.array([r[5] for r in rows]), pa.array([r[6] for r in rows])],
                    ["doc", "head", *names, "similarity", "whole"],
                )

    found = scratch.save(both.select("doc", "head", "x1", "y1", "xlo", "xhi", "ylo", "xs", "ys", "sx", "sy").mapInArrow(run, schema), "found")
    scratch.drop(cut)
    return found


def _reach(at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (i, j) with at[i] < at[j] <= at[i] + reach, of rising places."""
    lo = np.searchsorted(at, at, side="right")
    n = np.searchsorted(at, at + reach, side="right") - lo
    i = np.repeat(np.arange(len(at)), n)
    return i, np.arange(len(i)) + np.repeat(lo - np.cumsum(n) + n, n)


def _ends_of_runs(row: np.ndarray, seed: np.ndarray, pos: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Rows that stand for stretches in which one seed overlaps itself: ends and every eighth place between; mine is set for those it holds of."""
    order = np.lexsort((pos, seed, row))
    r, s, p = row[order], seed[order], pos[order]
    first = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (p[1:] - p[:-1] >= K)])
    begin = np.flatnonzero(first)
    kept = (np.arange(len(p)) - np.repeat(begin, np.diff([*begin, len(p)]))) % 8 == 0
    at = np.flatnonzero(kept)
    mine[order[at]] = np.logical_or.reduceat(mine[order], at)
    kept[np.flatnonzero(np.concatenate([first[1:], [True]]))] = True
    return np.sort(order[kept])


def _uncovered(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of places, which have one of their K words outside all ranges."""
    if not len(lo):
        return np.ones(len(at), bool)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    lo, hi = lo[first], hi[np.concatenate([first[1:] - 1, [len(hi) - 1]])]  # ranges that touch are one
    within = np.searchsorted(lo, at, side="right") - 1
    return (within < 0) | (hi[within] < at + K)


def _marked_places(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A slice of rows (doc, places, spans, ..), and of its places in rising order: row, seed, place, whether it is crowded and whether it is crowded and uncovered."""
    sizes = np.cumsum(batch.column("places").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) // _PLACES
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = batch.slice(a, b - a)
        row, place = _lists(part.column("places"))
        if not len(row):
            continue
        seed, pos, crowded = (place.field(c).to_numpy(zero_copy_only=False) for c in ("seed", "pos", "crowded"))
        order = np.lexsort((seed, pos, row))
        row, seed, pos, crowded = row[order], seed[order], pos[order].astype(np.int64), crowded[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (pos[1:] != pos[:-1]) | (seed[1:] != seed[:-1])])
        row, seed, pos, crowded = row[new], seed[new], pos[new], crowded[new]
        of, span = _lists(part.column("spans"))
        mine = crowded & _uncovered(row * _FAR + pos, of * _FAR + span.field("lo").to_numpy(), of * _FAR + span.field("hi").to_numpy())
        kept = _ends_of_runs(row, seed, pos, mine)
        yield part, row[kept], seed[kept], pos[kept], crowded[kept], mine[kept]


def _keyed(row: np.ndarray, seed: np.ndarray, pos: np.ndarray, crowded: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places (i, j) within reach of which one is crowded, a hash of their seeds (odd where it is one seed twice), and whether one is mine."""
    i, j = _reach(row * _FAR + pos, MAX_GAP + K)
    some = np.flatnonzero(crowded[i] | crowded[j])
    i, j = i[some], j[some]
    s = seed.view(np.uint64)
    key = mix64(s[i] * _ODD[0] + s[j] * _ODD[1]) & ~np.uint64(1) | (s[i] == s[j]).astype(np.uint64)
    return i, j, key.view(np.int64), mine[i] | mine[j]


def open_seeds(marked: DataFrame) -> DataFrame:
    """(doc, up, down): seeds at which a document of (doc, places, spans, whole) is mine and has a lesser one, and at which a greater one is mine; documents without either are left out."""
    schema = T.StructType([T.StructField("seed", T.LongType()), T.StructField("doc", marked.schema["doc"].dataType), T.StructField("mine", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, seed, _, _, mine in _marked_places(batch):
                order = np.lexsort((~mine, seed, row))
                row, seed, mine = row[order], seed[order], mine[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (seed[1:] != seed[:-1])])
                yield pa.record_batch([pa.array(seed[new]), part.column("doc").take(pa.array(row[new])), pa.array(mine[new])], ["seed", "doc", "mine"])

    places = marked.where("not whole").select("doc", "places", "spans").mapInArrow(run, schema)
    ends = places.groupBy("seed").agg(F.min("doc").alias("lo"), F.max(F.when(F.col("mine"), F.col("doc"))).alias("hi")).where("lo < hi")
    flags = places.join(ends, "seed").select("doc", F.expr("if(mine and doc > lo, seed, null)").alias("up"), F.expr("if(doc < hi, seed, null)").alias("down")).where("up is not null or down is not null")
    return flags.groupBy("doc").agg(F.collect_list("up").alias("up"), F.collect_list("down").alias("down"))


def _held(row: np.ndarray, seed: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which of the seeds are in the list of their row."""
    of, held = _lists(lists)
    return np.isin(seed ^ mix64(row.astype(np.uint64)).view(np.int64), held.to_numpy() ^ mix64(of.astype(np.uint64)).view(np.int64))


def seed_pairs(marked: DataFrame) -> DataFrame:
    """(key, doc, mine) of each pair of seeds that a document of (doc, places, spans, up, down) has, if it can meet another by it."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc", marked.schema["doc"].dataType), T.StructField("mine", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, seed, pos, crowded, mine in _marked_places(batch):
                up, down = (_held(row, seed, part.column(c)) for c in ("up", "down"))
                i, j, key, mine = _keyed(row, seed, pos, crowded, mine & up)
                some = mine | down[i] | down[j]
                of, key, mine = row[i][some], key[some], mine[some]
                order = np.lexsort((~mine, key, of))
                of, key, mine = of[order], key[order], mine[order]
                new = np.concatenate([[True], (of[1:] != of[:-1]) | (key[1:] != key[:-1])])[: len(of)]
                yield pa.record_batch([pa.array(key[new]), part.column("doc").take(pa.array(of[new])), pa.array(mine[new])], ["key", "doc", "mine"])

    return marked.select("doc", "places", "spans", "up", "down").mapInArrow(run, schema)


def meeting(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, doc, mine, n): rows of the keys by which a document that is mine meets a lesser one, and how many documents have the key."""
    ends = keys.groupBy("key").agg(F.min("doc").alias("lo"), F.max(F.when(F.col("mine"), F.col("doc"))).alias("hi"), F.count("*").alias("n")).where("lo < hi")
    ends = scratch.save(ends.select("key", "hi", "n"), "groups")
    few = ends.count() <= BROADCAST_IDS
    return keys.join(F.broadcast(ends) if few else ends, "key").where("mine or doc < hi").select("key", "doc", "mine", "n")


def _by_key(keys: DataFrame, schema: T.StructType, emit) -> DataFrame:
    """emit() of one or more whole keys of the rows at a time, each sorted by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last or held and len(key) and held[-1].column("key")[-1].as_py() != key[0]:
                yield from emit(pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks())
                held = []
            if len(key):
                held.append(batch.slice(last))
        if held:
            yield from emit(pa.Table.from_batches(held).combine_chunks())

    return keys.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(run, schema)


def _pairs(key: np.ndarray, doc: np.ndarray, mine: np.ndarray, many: int | None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(doc, head), in parts: each document that is mine with each lesser one of its key; of keys of over ``many`` documents, with the least. And which rows have such a key.

    Rows are sorted by key and document.
    """
    if not len(key):
        return [], np.zeros(0, bool)
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))  # a document of a key once
    row_of = np.repeat(np.arange(len(new)), np.diff([*new, len(key)]))
    mine = np.logical_or.reduceat(mine, new)
    key, doc = key[new], doc[new]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff([*begin, len(key)])
    start = np.repeat(begin, sizes)  # the least document of a row's key
    lesser = mine & (start < np.arange(len(key)))
    crowd = np.zeros(len(key), bool) if many is None else np.repeat((sizes > many) & np.logical_or.reduceat(lesser, begin), sizes)
    out = []
    at = np.flatnonzero(lesser & ~crowd)
    n = at - start[at]
    for t in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(n) // _PAIRS)) + 1):
        if len(t):
            m = n[t]
            out.append((np.repeat(doc[at[t]], m), doc[np.arange(m.sum()) + np.repeat(start[at[t]] - np.cumsum(m) + m, m)]))
    at = np.flatnonzero(lesser & crowd)
    return [*out, (doc[at], doc[start[at]])], crowd[row_of]


def _pair_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("doc", kind), T.StructField("head", kind)])


def _met(keys: DataFrame, many: int) -> DataFrame:
    """(doc, head) of _pairs() of (key, doc, mine)."""

    def emit(part: pa.Table) -> Iterator[pa.RecordBatch]:
        for doc, head in _pairs(*(part.column(c).to_numpy() for c in ("key", "doc", "mine")), many)[0]:
            yield pa.record_batch([pa.array(doc), pa.array(head)], ["doc", "head"])

    return _by_key(keys, _pair_schema(keys.schema["doc"].dataType), emit)


def words_around(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, doc, size, lo, words, at, to, mine): for each pair of seeds that (doc, places, spans, keys) names, the words around its places.

    size is the number of the document's words, words has those from lo on
    (uint32), and at, to and mine tell of the pair's places in that stretch. Places
    far apart are rows of their own.
    """
    kind = marked.schema["doc"].dataType
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc", kind), T.StructField("size", T.IntegerType()), T.StructField("lo", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("at", ints), T.StructField("to", ints), T.StructField("mine", T.ArrayType(T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, *places in _marked_places(batch):
                data, offsets = flat(part.column("text"))
                starts, ends, cut = word_spans(data, offsets)
                h, sizes, pos = (word_hashes(data, starts, ends) >> np.uint64(32)).astype(np.uint32), np.diff(cut), places[1]
                i, j, key, mine = _keyed(row, *places)
                named = np.flatnonzero(_held(row[i], key, part.column("keys")) & (pos[j] + K <= sizes[row[i]]))  # not the places of another row with the same id
                named = named[np.lexsort((pos[j[named]], pos[i[named]], key[named], row[i[named]]))]
                if not len(named):
                    continue
                r, key, at, to, mine = row[i[named]], key[named], pos[i[named]], pos[j[named]], mine[named]
                far = np.concatenate([[True], (r[1:] != r[:-1]) | (key[1:] != key[:-1]) | (np.diff(at) > MAX_GAP + 2 * (K + SIDE))])
                new = np.flatnonzero(far)
                lists = np.concatenate([new, [len(r)]]).astype(np.int32)
                lo = np.maximum(0, at[new] - SIDE)
                hi = np.minimum(sizes[r[new]], np.maximum.reduceat(to, new) + K + SIDE)
                words = [h[a:b].tobytes() for a, b in zip((cut[r[new]] + lo).tolist(), (cut[r[new]] + hi).tolist(), strict=True)]
                cols = [pa.array(key[new]), part.column("doc").take(pa.array(r[new])), pa.array(sizes[r[new]].astype(np.int32)), pa.array(lo.astype(np.int32)), pa.array(words, pa.binary())]
                yield pa.record_batch([*cols, *[pa.ListArray.from_arrays(pa.array(lists), pa.array(v)) for v in (at.astype(np.int32), to.astype(np.int32), mine)]], schema.fieldNames())

    return texts.join(marked, "doc").select("doc", "text", "places", "spans", "keys").mapInArrow(run, schema)


def _agree(doc: np.ndarray, near: np.ndarray, far: np.ndarray, mine: np.ndarray, grams: np.ndarray, step: int, many: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(doc, head) by runs of words on one side of a pair of seeds; a line begins at grams[near] and goes on for ``far`` runs, forwards or backwards.

    Runs of over ``many`` documents next to the seeds, with nothing between that
    fewer have, are the quoted line itself: there the least document is met. Other
    runs of many are met by all that have them.
    """
    lines = np.stack([doc, near, far])
    order = np.lexsort((mine, *lines[::-1]))
    lines, mine = lines[:, order], mine[order]
    new = np.flatnonzero(np.concatenate([[True], (lines[:, 1:] != lines[:, :-1]).any(axis=0)]))
    mine = np.logical_or.reduceat(mine, new)
    doc, near, far = lines[:, new]
    quoted = np.ones(len(doc), bool)  # so far
    wide, k = max(1, block // len(doc)), 0
    while k < far.max():
        on = np.flatnonzero(far > k)
        ks = np.arange(k, min(k + wide, int(far.max())))
        inside = ks < far[on][:, None]
        line, nth = np.nonzero(inside)
        said = mix64(grams[near[on][line] + step * ks[nth]]) + ks[nth].astype(np.uint64)
        order = np.argsort(said, kind="stable")
        line, nth, said = line[order], nth[order], said[order]
        same = said[1:] == said[:-1]
        some = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        line, nth, said = line[some], nth[some], said[some]
        found, crowd = _pairs(said, doc[on[line]], mine[on[line]], many)
        yield from found
        full = ~inside  # what lies beyond a line's end is as good as quoted
        full[line[crowd], nth[crowd]] = True
        before = np.logical_and.accumulate(np.concatenate([quoted[on][:, None], full], axis=1), axis=1)
        quoted[on] = before[:, -1]
        beyond = crowd & ~before[line, nth]
        yield from _pairs(said[beyond], doc[on[line[beyond]]], mine[on[line[beyond]]], None)[0]
        k += wide


def _met_by_words(around: DataFrame, many: int) -> DataFrame:
    """(doc, head) of words_around(): documents that agree in three words at one distance from a pair of seeds, or in the pair's length."""
    block = BLOCK

    def emit(part: pa.Table) -> Iterator[pa.RecordBatch]:
        key = part.column("key").to_numpy()
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True):
            held = [np.zeros((2, 0), np.int64)]
            for found in one(part.slice(a, b - a)):
                held.append(np.stack(found))
                if sum(v.shape[1] for v in held) > 4 * _PAIRS:
                    held = [np.unique(np.concatenate(held, axis=1), axis=1)]
                    if held[0].shape[1] > 2 * _PAIRS:
                        yield out(held.pop())
            if pairs := held:
                yield out(np.unique(np.concatenate(pairs, axis=1), axis=1))

    def one(part: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        part = part.combine_chunks()
        column = lambda c: pa.concat_arrays(part.column(c).chunks)
        row, at = _lists(column("at"))
        to, mine = (_lists(column(c))[1].to_numpy(zero_copy_only=False) for c in ("to", "mine"))
        at, (words, cut) = at.to_numpy(), _values(column("words"), np.uint32)
        doc, size, lo = (part.column(c).to_numpy().astype(np.int64)[row] for c in ("doc", "size", "lo"))
        grams, of = _run_hashes(words.astype(np.uint64), 3), cut[row] - lo
        inner = np.maximum(0, to - at - K).astype(np.int64)
        for near, far, step in ((of + at - 1, np.minimum(at, SIDE), -1), (of + to + K - 2, np.minimum(size - K - to, SIDE), 1), (of + at + K - 2, inner, 1)):
            on = np.flatnonzero(far > 0)
            if len(on):
                yield from _agree(doc[on], near[on], far[on].astype(np.int64), mine[on], grams, step, many, 256 * block)
        length = (to - at).astype(np.int64)
        order = np.lexsort((doc, length))
        yield from _pairs(length[order], doc[order], mine[order], many)[0]

    def out(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(v).cast(kind) for v in pairs], ["doc", "head"])

    kind = pa.int64() if isinstance(around.schema["doc"].dataType, T.LongType) else pa.int32()
    return _by_key(around, _pair_schema(around.schema["doc"].dataType), emit).distinct()


def chains_of_pairs(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows like those of chains() for pairs (doc, head), by all seeds that both have; chains that hold no uncovered crowded place are left out."""
    kind = pairs.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("head", kind)] + [T.StructField(c, T.IntegerType()) for c in ("x0", "x1", "y0", "y1")] + [T.StructField(c, T.BinaryType()) for c in ("sx", "sy")])
    slim = T.StructType([T.StructField("doc", kind), *[T.StructField(c, T.BinaryType()) for c in ("seeds", "at", "mine")]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, seed, pos, _, mine in _marked_places(batch):
                order = np.lexsort((pos, seed, row))
                seed, pos, cut = seed[order], pos[order].astype(np.int32), np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
                cols = [pa.array([v[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for v in (seed, pos, mine[order])]
                yield pa.record_batch([part.column("doc"), *cols], ["doc", "seeds", "at", "mine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column(c) for c in ("xseeds", "xat", "yseeds", "yat")]
            got = []
            for i in range(batch.num_rows):
                s, u = (np.frombuffer(parts[k][i].as_buffer(), np.int64) for k in (0, 2))
                p, q = (np.frombuffer(parts[k][i].as_buffer(), np.int32) for k in (1, 3))
                lo = np.searchsorted(u, s)
                n = np.searchsorted(u, s, side="right") - lo
                if n.sum() > 1:
                    y = q[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)]
                    mine = set(p[np.frombuffer(batch.column("mine")[i].as_buffer(), bool)].tolist())
                    got += [(i, *c[:4], *(np.array(v, np.int32).tobytes() for v in c[5:])) for c in chain(np.repeat(p, n), y) if len(c[5]) > 1 and not mine.isdisjoint(c[5])]
            if got:
                at = pa.array([g[0] for g in got])
                ids = [batch.column(c).take(at) for c in ("doc", "head")]
                yield pa.record_batch([*ids, *[pa.array([g[k] for g in got], pa.int32()) for k in range(1, 5)], *[pa.array([g[k] for g in got], pa.binary()) for k in (5, 6)]], schema.fieldNames())

    packed = marked.select("doc", "places", "spans").mapInArrow(pack, slim)
    side = lambda d, s, *more: packed.select(F.col("doc").alias(d), F.col("seeds").alias(f"{s}seeds"), F.col("at").alias(f"{s}at"), *more)
    return pairs.join(side("doc", "x", F.col("mine")), "doc").join(side("head", "y"), "head").select("doc", "head", "xseeds", "xat", "mine", "yseeds", "yat").mapInArrow(run, schema)


def spans_of(found: DataFrame) -> DataFrame:
    """(doc, spans) of the passages that lesser documents have."""
    return found.where("head < doc").groupBy("doc").agg(F.collect_set(F.struct(F.col("doc_from").alias("lo"), F.col("doc_to").alias("hi"))).alias("spans"))


def rest_of_passages(marked: DataFrame, docs: DataFrame, scratch: Scratch, min_words: int, min_similarity: float) -> DataFrame:
    """Passages at the crowded places of (doc, places, spans, whole) that no span covers, with lesser documents that have them."""
    marked = scratch.save(marked.where("not whole").select("doc", "places", "spans").join(open_seeds(marked), "doc"), "open")
    keys = scratch.save(seed_pairs(marked), "keys")
    meet = scratch.save(meeting(keys, scratch), "meeting")
    scratch.drop(keys)

    def aligned_pairs(pairs: DataFrame, marked: DataFrame) -> DataFrame:
        ids = pairs.select("doc").unionByName(pairs.select(F.col("head").alias("doc"))).distinct()
        runs = scratch.save(chains_of_pairs(pairs, pick_ids(marked, ids, "doc")), "chains")
        found = aligned(runs, docs, scratch, min_words, min_similarity).drop("whole")
        scratch.drop(runs)
        return found

    pairs = scratch.save(_met(meet.select("key", "doc", "mine"), MANY).distinct(), "pairs")
    found = aligned_pairs(pairs, marked)
    often = meet.where(F.col("n") > MANY).groupBy("doc").agg(F.collect_list("key").alias("keys"))
    more = spans_of(found).withColumnRenamed("spans", "more")
    named = marked.join(often, "doc").join(more, "doc", "left").select("doc", "places", F.when(F.col("more").isNull(), F.col("spans")).when(F.col("spans").isNull(), F.col("more")).otherwise(F.concat("spans", "more")).alias("spans"), "keys")
    named = scratch.save(named, "named")
    texts = pick_ids(docs, named.select("doc"), "doc").groupBy("doc").agg(F.min("text").alias("text"))
    again = _met_by_words(words_around(named, texts), MANY)
    again = scratch.save(again.join(pairs, ["doc", "head"], "left_anti"), "again")
    return found.unionByName(aligned_pairs(again, named))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(doc, head, doc_from, doc_to, head_from, head_to, similarity): passages of doc, by word places, that stand in head too."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text")).where("doc is not null and text is not null")
    met = scratch.save(met_at_seeds(docs, scratch), "places")
    marked = met.groupBy("doc").agg(F.collect_list(F.struct("seed", "pos", "crowded")).alias("places"), F.max("crowded").alias("some")).where("some").drop("some")
    marked = scratch.save(marked, "marked")
    matches = met.select("doc", F.col("pos").alias("x"), F.explode("heads").alias("h")).select("doc", F.col("h.head").alias("head"), "x", F.col("h.y").alias("y"))
    runs_table = scratch.save(chains(matches), "chains")
    scratch.drop(met)
    found = aligned(runs_table, docs, scratch, min_words, min_similarity)
    again = pick_ids(docs, marked.select("doc"), "doc").groupBy("doc").agg(F.min("text").alias("text"))
    split = marked.select("doc", F.expr("transform(filter(places, p -> p.crowded), p -> p.pos)").alias("at"), F.col("places.pos").alias("shared"))
    runs = scratch.save(crowded_runs(split.join(spans_of(found), "doc", "left"), again, min_words), "runs")
    plain = found.drop("whole")
    exact = scratch.save(exact_passages(runs, plain, min_words), "exact")
    scratch.drop(runs_table, runs)
    whole = found.where("head < doc and whole").select("doc", "whole").distinct()
    covered = scratch.save(marked.join(spans_of(plain.unionByName(exact)), "doc", "left").join(whole, "doc", "left").withColumn("whole", F.coalesce("whole", F.lit(False))), "covered")
    scratch.drop(marked)
    rest = rest_of_passages(covered, docs, scratch, min_words, min_similarity)
    return plain.unionByName(exact).unionByName(rest.join(plain, ["doc", "head", *plain.columns[2:6]], "left_anti"))


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the passages that a document of a lesser id has; a text that loses all its words goes, rows without repeats stay as they are."""
    scratch = Scratch(docs.sparkSession)
    spans = repeated_passages(docs, id_col, text_col, **options).where("head < doc")
    spans = scratch.save(spans.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("doc_from", "doc_to"))).alias("spans")), "spans")
    row = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"), row.alias("row"))
    ids = spans.select("doc")
    whole = pick_ids(rows, ids, "doc", "left_anti").select("row")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = flat(part.column("text"))
                starts, _, at = word_spans(data, offsets)
                out = []
                for i, asked in enumerate(part.column("spans").to_pylist()):
                    mine, end = starts[at[i] : at[i + 1]], int(offsets[i + 1])
                    keep, here = [], int(offsets[i])
                    for s in asked:
                        if s["doc_from"] >= len(mine):
                            continue
                        a, b = int(mine[s["doc_from"]]), int(mine[s["doc_to"]]) if s["doc_to"] < len(mine) else end
                        if a > here:
                            keep.append(data[here:a].tobytes())
                        here = max(here, b)
                    out.append(b"".join([*keep, data[here:end].tobytes()]).decode("utf-8"))
                yield pa.record_batch([part.column("row"), pa.array(out, pa.string())], ["row", "text"])

    touched = pick_ids(rows, ids, "doc").join(spans, "doc").select("row", "text", "spans").mapInArrow(cut, schema)
    touched = touched.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    columns = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return whole.select("row.*").unionByName(touched.select(*columns))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = repeated_passages(docs)
    return out.select(F.col("doc").alias("doc_id"), F.col("head").alias("other_id"), "doc_from", "doc_to", F.col("head_from").alias("other_from"), F.col("head_to").alias("other_to"), "similarity")
