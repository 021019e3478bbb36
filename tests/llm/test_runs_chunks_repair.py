"""Periodic runs, SentencePiece chunks and conversation repair against brute force and the library, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from freehold.llm import chunks, repair, runs

from .conftest import WORD, prose

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# ---- periodic runs


def brute_runs(w, least=24, times=3):
    """(start, length, period): maximal stretches of each period, the least period of each stretch."""
    n, out = len(w), {}
    for p in range(1, n // times + 1):
        j = 0
        while j + p < n:
            a = j
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > a and j + p - a >= max(least, times * p):
                out.setdefault((a, j + p - a), p)
            j += j == a
    return sorted((a, n, p) for (a, n), p in out.items())


def brute_looped(i, text):
    w = WORD.findall(text or "")
    if i is None or not w:
        return w
    h = zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return w[:a] + [w[a + k % p] for k in range(len(w) - a)]


def brute_row(i, w):
    found = brute_runs(w)
    best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
    gone = {k for a, n, p in found for k in range(a + p, a + n)}
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{a},{n},{p}\n" for a, n, p in found)), sha(kept))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(1, 4), st.integers(1, 30), st.integers(0, 10**6)), max_size=5))
def test_runs_are_those_of_brute_force(shapes):
    texts = []
    for n, letters, p, seed in shapes:
        r = random.Random(seed)
        w = [r.randrange(letters) for _ in range(n)]
        a = r.randrange(n + 1)
        w[a:] = [w[a + k % p] for k in range(n - a)]
        texts.append(np.array(w, np.int64))
    found = [[] for _ in texts]
    for k, *run in zip(*(x.tolist() for x in runs.find_runs(texts)), strict=True):
        found[k].append(tuple(run))
    assert found == [brute_runs(t.tolist()) for t in texts]


def test_extensions_reach_any_length():
    r = random.Random(2)
    seq = np.array([*([r.randrange(3) for _ in range(700)] * 3), 9])
    lce = runs.Extensions(seq)
    i, j = (np.array([r.randrange(len(seq)) for _ in range(500)]) for _ in range(2))
    i, j = i[i != j], j[i != j]
    want = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        n = 0
        while max(a, b) + n < len(seq) and seq[a + n] == seq[b + n]:
            n += 1
        want.append(n)
    assert lce(i, j).tolist() == want


def test_op11_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted(brute_row(d.doc_id, brute_looped(d.doc_id, d.text)) for d in docs)
    assert sorted(map(tuple, runs.op11_periodic_runs(spark, SF).collect())) == want
    assert any(x[1] for x in want)


def test_runs_of_odd_rows(spark, odd, odd_rows, empty):
    loop = "x y z " * 4000
    rows = odd.unionByName(odd.limit(1).withColumn("doc_id", F.lit(99).cast("bigint")).withColumn("text", F.lit(loop)))
    got = runs.periodic_runs(rows, keep=("doc_id", "row", "size")).collect()
    assert len(got) == len(odd_rows) + 1
    for x in got:
        text = loop if x.row.doc_id == 99 else next(t for i, t, *_ in odd_rows if i == x.row.doc_id and (i is not None or sha(" ".join(WORD.findall(t or ""))) == x.collapsed_sha256))
        if x.row.doc_id in (11, 99):  # long
            assert [tuple(r) for r in x.runs] == ([] if x.row.doc_id == 11 else [(0, 12000, 3)])
        else:
            assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256) == brute_row(0, WORD.findall(text or ""))[1:]
    assert next(x for x in got if x.row.doc_id == 99).collapsed == "x y z"
    assert runs.periodic_runs(empty).count() == 0


# ---- SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return chunks.Segmenter(chunks.read_pieces(MODEL))


ODD_TEXTS = ["", " ", None, "a", "  a b ", "\n", "x▁y", "▁▁ a", "\x00a", "日本é́ 　 x", "<s> hi</s>", "<0x41>", " " * 77 + "x" + " " * 33, "😀" * 3, "aaaa" * 50, "�", "a b"]


def test_ids_and_texts_are_the_librarys(library, model):
    texts = [*ODD_TEXTS, prose(3, 500), *[prose(k, 40).replace("a", "é").replace("b", "が") for k in range(20)]]
    for _ in range(2):  # the second time from the table
        ids, said = model.encode(pa.array(texts, pa.string()))
        for t, i, d in zip(texts, ids, said, strict=True):
            want = library.encode(t or "", add_bos=True, add_eos=True)
            assert np.frombuffer(i, "<u4").tolist() == want
            assert d.decode() == library.decode(want) == model.decode(want)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("▁  atheinr\né日😀\t1<>"), max_size=60))
def test_any_text(library, model, text):
    (ids,), _ = model.encode(pa.array([text], pa.string()))
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 262), max_size=10))
def test_any_ids(library, model, ids):
    assert model.decode(ids) == library.decode(ids)


def test_long_pieces_and_whole_texts(library, model):
    long = "".join(random.Random(1).choices("abcdefgh", k=20000))
    whole = chunks.Segmenter(chunks.read_pieces(MODEL))
    whole.apart = False  # as for a model whose pieces cross markers
    for m in (model, whole):
        ids, _ = m.encode(pa.array([long, "a  b c", ""], pa.string()))
        assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [library.encode(t, add_bos=True, add_eos=True) for t in (long, "a  b c", "")]


def test_table_starts_anew(library, monkeypatch):
    monkeypatch.setattr(chunks, "TABLE_CHUNKS", 3)
    m = chunks.Segmenter(chunks.read_pieces(MODEL))
    for k in range(4):
        text = prose(k, 9)
        (ids,), _ = m.encode(pa.array([text], pa.string()))
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert len(m.table) <= 12


def test_op12_equals_the_library(spark, library):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = chunks.op12_sentencepiece(spark, SF).collect()
    assert len(got) == len(docs)
    for x in got:
        ids = library.encode(docs[x.doc_id] or "", add_bos=True, add_eos=True)
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids)))


def test_chunks_of_odd_rows(library, odd, odd_rows, empty):
    got = chunks.encode_documents(odd, MODEL, keep=("doc_id", "row", "size")).collect()
    want = sorted(library.decode(library.encode(t or "")) for _, t, *_ in odd_rows)
    assert sorted(x.decoded for x in got) == want
    assert chunks.encode_documents(empty, MODEL).count() == 0


def test_another_model_is_refused(tmp_path):
    path = tmp_path / "none.model"
    path.write_bytes(b"")
    with pytest.raises(ValueError):
        chunks.read_pieces(str(path))


# ---- conversations


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(conv, [])
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def brute_repair(rows):
    """Least (cost, letters) from every (row, state), from the last row back; then what the letters make."""
    kinds, seen = [], set()
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+", "", text)[-1:]
        kinds.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    after, keeps = (2, 2, 3, 2), {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    below = {}
    for i in range(len(rows), -1, -1):
        best = {s: [(0, "")] if i == len(rows) and s in (0, 3) else [] for s in range(4)}
        for s in range(4) if i < len(rows) else ():
            extra = kinds[i] == "truncated"
            moves = [(3, "D", s)]
            if kinds[i] in ("", "truncated"):
                moves.append((2 + extra, "R", after[s]))
                if (rows[i][1][:1], s) in keeps:
                    moves.append((extra, "K", keeps[rows[i][1][:1], s]))
            best[s] += [(c + below[i + 1, t][0], x + below[i + 1, t][1]) for c, x, t in moves if (i + 1, t) in below]
        for _ in range(4):
            for s in range(4):
                best[s] += [(2 + c, "I" + x) for c, x in best[after[s]][:1]]
                best[s] = sorted(best[s])[:1]
        below = {k: v for k, v in below.items() if k[0] > i} | {(i, s): b[0] for s, b in best.items() if b}
    cost, letters = below[0, 0]
    said, s, k = [], 0, 0
    for x in letters:
        if x in "KR":
            s = keeps[rows[k][1][:1], s] if x == "K" else after[s]
            said.append(f"{rows[k][1] if x == 'K' else ('user', 'assistant')[s == 3]}:{rows[k][2]}")
        elif x == "I":
            s = after[s]
            said.append(f"{('user', 'assistant')[s == 3]}:")
        k += x != "I"
    turns = {t for t, _, _ in rows if t is not None}
    jumps = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(kinds.count, ("blank", "duplicate", "truncated")), jumps, cost, letters, sha("\n".join(said)))


def brute_all(rows):
    return sorted(((c, *brute_repair(r)) for c, r in brute_damage(rows).items()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suuaa-"), st.sampled_from((0, 0, 1, 2))), min_size=1, max_size=14), st.sampled_from((1, 3, 64)))
def test_auction_finds_the_cheapest_and_least(rows, window):
    codes = bytes(repair.row_code(role, fault) for role, fault in rows)
    before, repair.WINDOW = repair.WINDOW, window
    try:
        windows = repair.prices_back(codes, repair._END)
        letters, state = repair.follow(codes, windows, 0)
        between = repair.costs_between(codes)
    finally:
        repair.WINDOW = before
    texts = ["" if f == 2 else f"{k}" + "." * (f == 0) for k, (_, f) in enumerate(rows)]
    cost, audit = brute_repair([(k, r, t) for k, ((r, _), t) in enumerate(zip(rows, texts, strict=True))])[5:7]
    assert (windows[-1][1][0], letters + repair._END_LETTERS[state]) == (cost, audit)
    assert min(between[b] + repair._END[b] for b in range(4)) == cost


@pytest.mark.parametrize("piece", [1, 3, repair.PIECE_ROWS])
def test_op13_equals_brute_force(spark, piece):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    got = repair.repair_conversations(repair.damage(rows), "dropped", piece)
    assert sorted(map(tuple, got.collect()), key=str) == brute_all([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


def odd_conversations():
    r = random.Random(4)
    rows = []
    for conv in [None, *range(40)]:
        for k in range(r.randrange(1, 12)):
            turn = r.choice([None, k, k, k, 3])
            rows.append((conv, turn, r.choice(["system", "user", "user", "assistant", "assistant", None, "", "tool"]), r.choice(["Yes.", "No", "  ", "", None, "So?\n", "same.", "x" * 5000 + "!"])))
    rows += [(77, k, "ua"[k % 2], f"{k % 300}.") for k in range(1500)]  # one of many rows
    return rows + rows[:5]


@pytest.mark.parametrize("piece", [2, repair.PIECE_ROWS])
def test_odd_conversations(spark, piece):
    rows = odd_conversations()
    frame = spark.createDataFrame([(*x, 1, "y") for x in rows], "conv_id bigint, turn bigint, role string, text string, part int, k string")
    got = repair.repair_conversations(repair.damage(frame), "dropped", piece)
    assert sorted(map(tuple, got.collect()), key=str) == brute_all(rows)
    assert repair.repair_conversations(repair.damage(frame.limit(0)), "dropped").count() == 0
