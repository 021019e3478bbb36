"""SentencePiece (BPE) encoding and decoding through a table of distinct chunks.

A space is a marker, and a text starts with one. Where no piece of the model
holds a marker after another letter, no merge can cross from a word into the
next marker, so a text is a row of chunks, markers and the word after them,
that are segmented apart. A slice of texts becomes its distinct chunks and an
index at each position (Arrow's dictionary encoding). Each distinct chunk is
looked up in the task's table, or segmented and put there, and the ids and the
decoded bytes are joined back by position with array passes. A model whose
pieces do cross markers is used with whole texts as chunks: same ids, no gain.

The table belongs to a task and is begun anew beyond TABLE_CHUNKS entries, so
its memory is bounded and a lost executor costs nothing but its own tasks; no
text is shuffled. A chunk longer than LONG_CHUNK isn't kept in it.

Chunks of one length up to LONG_CHUNK letters are merged together, one row a
chunk in a matrix of piece numbers: in each round every row merges its pair of
the best score, of equal ones the leftmost. Longer chunks, and those with
letters outside the model or with pieces whose scores are equal, are merged one
by one by a heap of neighbouring pairs over a linked list, which is n log n for
any length.

Defined results
- Null or empty text: the begin and end ids only; it decodes to nothing. Repeated rows are encoded row by row.
- Characters that no piece holds become the ids of their bytes. A marker in the text is a space, as the model sees it.
- Any length: a text is one row. Empty table: no rows. Columns that aren't asked for don't matter, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import struct
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PairTable
from .wordnum import flat, slices

#: Chunks that a task's table holds at most, and letters of the longest that is kept there and merged in a matrix.
TABLE_CHUNKS, LONG_CHUNK = 400_000, 32
#: Bytes of text that share one table of distinct chunks.
SLICE_BYTES = 1 << 22
MARKER = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
_NO_ID = (1 << 20) - 1

codecs.register_error("freehold-each-byte", lambda e: ("�", e.start + 1))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message; strings and messages come as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, data[at : at + size]
        at += size


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id. Raises for models that this module doesn't follow.

    Those must be BPE with byte fallback, add a marker in front, keep all
    spaces, change no letter, and have no symbols of a user.
    """
    pieces, trainer, normal = [], {}, {}
    with open(path, "rb") as file:
        for field, value in _fields(file.read()):
            if field == 1:
                part = dict(_fields(value))
                pieces.append((part.get(1, b"").decode(), struct.unpack("<f", part.get(2, bytes(4)))[0], part.get(3, NORMAL)))
            elif field in (2, 3):
                (trainer if field == 2 else normal).update(_fields(value))
    # field numbers of the trainer's and the normaliser's settings
    fits = trainer.get(3) == 2 and trainer.get(35) == 1 and not trainer.get(24) and not normal.get(2) and normal.get(3, 1) == 1 and not normal.get(4, 1) and normal.get(5, 1) == 1
    if not fits or any(kind in (USER, UNUSED) for _, _, kind in pieces) or len(pieces) >= _NO_ID:
        raise ValueError("not a BPE model with byte fallback that keeps texts as they are")
    return pieces


class Segmenter:
    """Encodes and decodes with one model's pieces; built once in each task."""

    def __init__(self, pieces: Sequence[tuple[str, float, int]]):
        self.kinds = [kind for _, _, kind in pieces]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte_ids = [0] * 256
        self.surface = [b""] * len(pieces)
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.surface[i] = bytes([int(piece[1:-1], 16)])
            elif kind == NORMAL:
                self.surface[i] = piece.replace(MARKER, " ").encode()
            elif kind == UNKNOWN:
                self.surface[i] = " ⁇ ".encode()
        self.first, self.last = (next((i for i, (p, _, kind) in enumerate(pieces) if kind == CONTROL and p == name), None) for name in ("<s>", "</s>"))
        self.apart = not any(a != MARKER and b == MARKER for p in self.ids for a, b in zip(p, p[1:], strict=False))
        # pieces of one score share a rank, and of those the leftmost pair is merged first
        rank = {score: k for k, score in enumerate(sorted({pieces[i][1] for i in self.ids.values()}, reverse=True))}
        self.pairs = {
            (self.ids[p[:k]] << 20) | self.ids[p[k:]]: (rank[pieces[i][1]], i)
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if p[:k] in self.ids and p[k:] in self.ids
        }
        self.table: dict[bytes, bytes] = {}
        # for matrices: pieces numbered by score, and what stands for each letter
        self.by_score = np.array(sorted(self.ids.values(), key=lambda i: -pieces[i][1]), np.int64)
        number = {pieces[i][0]: k for k, i in enumerate(self.by_score.tolist())}
        self.merges = PairTable(number)
        self.letter = np.full(0x110000, _NO_ID, np.int64)
        for p, k in number.items():
            if len(p) == 1:
                self.letter[ord(p)] = k
        uses = Counter(pieces[i][1] for i in self.ids.values())
        tied = [p for p, i in self.ids.items() if len(p) > 1 and uses[pieces[i][1]] > 1]
        self.tied = [p for p in tied if not any(q in p for q in tied if q != p)]
        self.surface_sizes = np.array([len(x) for x in self.surface], np.int64)
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.surfaces = np.frombuffer(b"".join(self.surface), np.uint8)

    def segment_all(self, texts: Sequence[str]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each text whose spaces are markers already."""
        out, by_size = [b""] * len(texts), defaultdict(list)
        for k, t in enumerate(texts):
            by_size[len(t) if len(t) <= LONG_CHUNK and not any(p in t for p in self.tied) else 0].append(k)
        for size, rows in by_size.items():
            one_by_one = rows
            if size:
                numbers = self.letter[np.frombuffer("".join([texts[k] for k in rows]).encode("utf-32-le"), "<u4")].reshape(-1, size)
                known = (numbers < _NO_ID).all(axis=1)
                one_by_one = [k for k, good in zip(rows, known.tolist(), strict=True) if not good]
                where = [k for k, good in zip(rows, known.tolist(), strict=True) if good]
                for live, ids in self._merge(numbers[known]):
                    for k, row in zip(live.tolist(), ids, strict=True):
                        out[where[k]] = row
            for k in one_by_one:
                out[k] = np.array(self.segment(texts[k]), "<u4").tobytes()
        return out

    def _merge(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """(rows, their ids) of a matrix of letters, as rows run out of pairs."""
        live, none = np.arange(len(numbers)), np.int64(1) << 40
        best = np.full(numbers.shape, none)
        best[:, :-1] = self.merges.ranks(numbers[:, :-1].ravel(), numbers[:, 1:].ravel()).reshape(len(numbers), -1) if numbers.size else none
        while len(live):
            rows, width = np.arange(len(live)), numbers.shape[1]
            at = best.argmin(axis=1)
            made = best[rows, at]
            over = made >= none
            if over.any():
                ids = self.by_score[numbers[over]].astype("<u4").tobytes()
                yield live[over], [ids[k : k + 4 * width] for k in range(0, len(ids), 4 * width)]
                live, numbers, best, at, made = (x[~over] for x in (live, numbers, best, at, made))
                rows = rows[: len(live)]
                if not len(live):
                    break
            # every row loses one symbol a round, so all rows stay of one width
            right = np.arange(width - 1)[None, :] > at[:, None]
            numbers[rows, at] = made
            numbers = np.where(right, numbers[:, 1:], numbers[:, :-1])
            best = np.where(right, best[:, 1:], best[:, :-1])
            best[:, -1] = none
            best[rows, at] = none
            inner = rows[at < width - 2]
            best[inner, at[inner]] = self.merges.ranks(numbers[inner, at[inner]], numbers[inner, at[inner] + 1])
            inner = rows[at > 0]
            best[inner, at[inner] - 1] = self.merges.ranks(numbers[inner, at[inner] - 1], numbers[inner, at[inner]])

    def segment(self, text: str) -> list[int]:
        """Ids of a text whose spaces are markers already."""
        ids = [self.ids.get(c, _NO_ID) for c in text]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pairs, heap = self.pairs, []
        for k in range(len(ids) - 1):
            merge = pairs.get((ids[k] << 20) | ids[k + 1])
            if merge:
                heap.append((merge[0], k, ids[k], ids[k + 1], merge[1]))
        heapq.heapify(heap)
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            right = after[k]
            if ids[k] != a or right >= len(ids) or ids[right] != b:
                continue  # one of the two was merged meanwhile
            ids[k], ids[right] = made, -1
            after[k] = right = after[right]
            left = before[k]
            if right < len(ids):
                before[right] = k
                merge = pairs.get((made << 20) | ids[right])
                if merge:
                    heapq.heappush(heap, (merge[0], k, made, ids[right], merge[1]))
            if left >= 0:
                merge = pairs.get((ids[left] << 20) | made)
                if merge:
                    heapq.heappush(heap, (merge[0], left, ids[left], made, merge[1]))
        out, k = [], 0
        while k < len(ids):
            if ids[k] == _NO_ID:
                out += [self.byte_ids[b] for b in text[k].encode()]
            else:
                out.append(ids[k])
            k = after[k]
        return out

    def _text(self, ids: Sequence[int]) -> str:
        """What ids say, the first marker included; bytes that are no letter become U+FFFD, each."""
        out, raw = [], b""
        for i in ids:
            if self.kinds[i] == BYTE:
                raw += self.surface[i]
                continue
            out += [raw.decode("utf-8", "freehold-each-byte"), self.surface[i].decode()]
            raw = b""
        return "".join(out) + raw.decode("utf-8", "freehold-each-byte")

    def decode(self, ids: Sequence[int]) -> str:
        """The text of any ids; a marker that the first piece to say something starts with is the one that encoding added."""
        told = next((i for i in ids if self.kinds[i] != CONTROL), None)
        text = self._text(ids)
        return text[1:] if told is not None and self.kinds[told] == NORMAL and self.surface[told].startswith(b" ") else text

    def _look_up(self, chunks: Sequence[bytes]) -> list[bytes]:
        """Ids of distinct chunks, from the table or put there."""
        if len(self.table) > TABLE_CHUNKS:
            self.table.clear()
        rows = list(map(self.table.get, chunks))
        new = [k for k, row in enumerate(rows) if row is None]
        texts = [chunks[k].decode().replace(" ", MARKER) for k in new]
        for k, text, ids in zip(new, texts, self.segment_all(texts), strict=True):
            rows[k] = ids
            if len(text) <= LONG_CHUNK:
                self.table[chunks[k]] = ids
        return rows

    def encode(self, texts: pa.Array) -> tuple[list[bytes], list[bytes]]:
        """Each text's ids (with begin and end), and the bytes they decode to."""
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), MARKER, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        data, offsets = flat(texts)
        starts = data == 0x20 if self.apart else np.zeros(len(data), bool)
        starts[1:] &= data[:-1] != 0x20
        starts[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(starts)
        edges = np.concatenate([at, [len(data)]])
        distinct = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        rows = self._look_up(distinct.dictionary.to_pylist())
        sizes = np.array([len(r) for r in rows], np.int64) // 4
        ids, to = _gather(np.frombuffer(b"".join(rows), "<u4"), np.cumsum(sizes) - sizes, sizes, distinct.indices.to_numpy(zero_copy_only=False))
        cut = to[np.searchsorted(at, offsets)]  # where each text's ids begin
        # the ids stand for whole letters, so what they say is their bytes one after another; the first is the marker put in front
        said, to = _gather(self.surfaces, self.surface_starts, self.surface_sizes, ids)
        first, last = (b"" if i is None else i.to_bytes(4, "little") for i in (self.first, self.last))
        return [first + x + last for x in _parts(ids, cut)], [x[1:] for x in _parts(said, to[cut])]


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of values that rows name, one after another, and where each begins (len + 1)."""
    each = sizes[rows]
    to = np.concatenate([[0], np.cumsum(each)])
    return values[np.arange(int(to[-1])) + np.repeat(starts[rows] - to[:-1], each)], to


def _parts(values: np.ndarray, cut: np.ndarray) -> list[bytes]:
    data, edges = values.tobytes(), (cut * values.itemsize).tolist()
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def encode_documents(docs: DataFrame, model_path: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(row, n_tokens, ids, ids_sha256, decoded, decoded_sha256); ids and decoded are null unless with_ids.

    The model is read on the driver and broadcast: its size is that of one
    vocabulary, whatever the documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(model_path))
    slim = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text_col].alias("text"))
    names = ["n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"]
    kinds = [T.LongType(), T.BinaryType(), *[T.StringType()] * 3]
    schema = T.StructType([slim.schema["row"], *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Segmenter(shared.value)
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                ids, decoded = model.encode(part.column("text"))
                columns = [
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids if with_ids else [None] * len(ids), pa.binary()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([x.decode() for x in decoded] if with_ids else [None] * len(ids), pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                ]
                yield pa.record_batch([part.column("row"), *columns], ["row", *names])

    return slim.mapInArrow(run, schema)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
    return out.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
