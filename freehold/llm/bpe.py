"""Byte-level BPE encoding and decoding over padded numpy matrices.

A batch's distinct pieces (matches of the split pattern) are put in buckets of
like length, one row a piece in a padded matrix of token ids. Each round finds
every row's least-rank pair by a hashed pair lookup, merges its leftmost
occurrence, and closes the gap; rows without a pair left drop out. A piece
that is a token itself is that token.

Defined results
- Null or empty text: no tokens; the hash of nothing. Repeated rows are encoded row by row.
- Text that isn't valid UTF-8 doesn't occur in a Spark string column.
- Any length: a text is one row, its pieces are encoded apart. Empty table: no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordnum import slices

#: Pieces whose encoding a worker remembers; the memory starts anew when it is full.
CACHE_PIECES = 200_000
#: Cells of one padded matrix at most, unless one piece alone is longer.
MATRIX_CELLS = 1 << 19
_NONE = np.int64(1) << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """An open-addressing hash table from a pair of token ids to the id of their merge (its rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        keys = np.array([(a << 20) | b for a, b, _ in pairs], np.int64)
        values = np.array([r for _, _, r in pairs], np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int64)
        self.probes, slot, left = 0, self._slot(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 20) | right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], _NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[open_]]
            out[open_[at == keys[open_]]] = self.values[slot[open_[at == keys[open_]]]]
            open_ = open_[(at != keys[open_]) & (at >= 0)]
        return out


class Codec:
    """Encodes and decodes with one rank file; built once in each task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values(), default=0) >= 1 << 20:
            raise ValueError("ids must be below 2**20")
        self.whole, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = PairTable(ranks)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known: dict[str, bytes] = {}

    def merge(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Token ids (little-endian uint32) of each piece, by merging rows of padded matrices."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(sizes, kind="stable")
        ordered = sizes[order]
        start = 0
        while start < len(order):
            # a bucket: lengths up to half as long again as the shortest, as many rows as the matrix may hold
            longest = int(ordered[start] * 1.5) + 1
            stop = min(int(np.searchsorted(ordered, longest, side="right")), start + max(1, MATRIX_CELLS // longest))
            rows = order[start:stop].tolist()
            for live, flat, n in self._merge_bucket([pieces[i] for i in rows]):
                ids, cuts = flat.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(4 * n)]).tolist()
                for k, i in enumerate(live.tolist()):
                    out[rows[i]] = ids[cuts[k] : cuts[k + 1]]
            start = stop
        return out

    def _merge_bucket(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, their ids one after another, how many each) as rows run out of pairs."""
        n = np.array([len(p) for p in pieces], np.int64)
        width = int(n.max())
        inside = np.arange(width)[None, :] < n[:, None]
        ids = np.zeros((len(pieces), width), np.int64)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(pieces), width), _NONE)
        has = inside[:, 1:]
        if width > 1:
            rank[:, :-1][has] = self.pairs.ranks(ids[:, :-1][has], ids[:, 1:][has])
        live = np.arange(len(pieces))
        while len(live):
            at = np.argmin(rank, axis=1)  # the leftmost of the least
            best = rank[np.arange(len(live)), at]
            more = best < _NONE
            if not more.all():
                over = np.flatnonzero(~more)
                yield live[over], ids[over][np.arange(width)[None, :] < n[over][:, None]], n[over]
                ids, rank, n, live, at, best = ids[more], rank[more], n[more], live[more], at[more], best[more]
                if not len(live):
                    break
                width = int(n.max())
                ids, rank = ids[:, :width], rank[:, :width]
            rows = np.arange(len(live))
            # close the gap right of the merged pair
            cols = np.arange(width - 1)[None, :]
            shift = cols > at[:, None]
            ids[rows, at] = best
            ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(shift, rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            n = n - 1
            # the merged token's pairs with its neighbours
            right = np.flatnonzero(at < n - 1)
            rank[rows, at] = _NONE
            rank[right, at[right]] = self.pairs.ranks(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pairs.ranks(ids[left, at[left] - 1], ids[left, at[left]])
            width = max(1, int(n.max()))
            ids, rank = ids[:, :width], rank[:, :width]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Each text's token ids as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        new = list({p for pieces in split for p in pieces if p not in self.known})
        todo = []
        for p in new:
            rank = self.whole.get(p.encode())
            if rank is None:
                todo.append(p)
            else:
                self.known[p] = rank.to_bytes(4, "little")
        self.known.update(zip(todo, self.merge([p.encode() for p in todo]), strict=True))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(row, n_tokens, ids, ids_sha256, decoded_sha256); ids is null unless with_ids.

    The rank file is read on the driver and broadcast: its size is that of one
    vocabulary, whatever the documents.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    slim = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text_col].alias("text"))
    schema = T.StructType(
        [slim.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = codec.encode(part.column("text").to_pylist())
                yield pa.record_batch(
                    [
                        part.column("row"),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids if with_ids else [None] * len(ids), pa.binary()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    ["row", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    return slim.mapInArrow(run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return out.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
