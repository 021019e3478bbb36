"""Passages that op4 must find, each against what was planted."""

import numpy as np
import pytest

from freehold.llm import chaining

from .conftest import prose


def brute_chain_scores(pairs, k):
    """The best score of a chain that ends at each match, with every predecessor in reach tried; matches that don't overlap only."""
    best = {}
    for m in sorted(pairs):
        gains = [k]
        for p, f in best.items():
            dx, dy = m[0] - p[0], m[1] - p[1]
            if 0 < dx <= chaining.MAX_GAP + k and 0 < dy <= chaining.MAX_GAP + k:
                gains.append(f + min(k, dx, dy) - chaining.GAP_COST * (max(0, dx - k) + max(0, dy - k)))
        best[m] = max(gains)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_chains_beyond_reach_match_brute_force(seed):
    r = np.random.default_rng(seed)
    pairs = sorted({(5 * int(a), 5 * int(a + b)) for a, b in zip(r.integers(0, 80, 60), r.integers(0, 3, 60), strict=True)})
    x, y = (np.array(v) for v in zip(*pairs, strict=True))
    got = chaining.chain(x, y)
    assert got[0][4] == pytest.approx(max(brute_chain_scores(pairs, chaining.K).values()))


def test_chain_restarts_beyond_reach():
    x = np.array([*range(0, 100, 5), *range(200, 400, 5)])
    assert [(c[0], c[1]) for c in chaining.chain(x, x)] == [(200, 400), (0, 100)]


def found(spark, texts):
    """(doc_from, doc_to) of document 2 in document 1, or of the last document in any."""
    rows = chaining.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).where(f"doc = {max(texts)}").collect()
    return sorted((r["doc_from"], r["doc_to"]) for r in rows)


def test_second_passage_after_a_long_gap(spark):
    a, b = prose(100, 100), prose(101, 100)
    texts = {1: f"{a} {prose(102, 150)} {b}", 2: f"{a} {prose(103, 150)} {b}"}
    got = found(spark, texts)
    assert len(got) == 2 and got[0][0] == 0 and 100 <= got[0][1] <= 102 and 248 <= got[1][0] <= 250 and got[1][1] == 350


@pytest.mark.parametrize(("words", "gap"), [(50, 26), (50, 50), (100, 53)])
def test_two_passages_chained_into_one(spark, words, gap):
    a, b = prose(110, words), prose(111, words)
    texts = {1: f"{prose(112, 20)} {a} {prose(113, gap)} {b}", 2: f"{a} {prose(114, gap)} {b} {prose(115, 20)}"}
    got = found(spark, texts)
    assert len(got) == 2 and got[0] == (0, words) and got[1] == (words + gap, 2 * words + gap)


def test_passages_on_another_diagonal(spark):
    a, b, c = prose(120, 60), prose(121, 60), prose(122, 60)
    got = found(spark, {1: f"{a} {b} {prose(123, 55)} {c}", 2: f"{a} {prose(124, 55)} {b} {c}"})
    assert all(any(p <= lo and hi <= q for p, q in got) for lo, hi in ((0, 60), (115, 175), (175, 235)))


@pytest.mark.parametrize("seed", range(30))
def test_parts_cover_what_any_good_part_covers(seed):
    r = np.random.default_rng(seed)
    px, py = (np.flatnonzero(r.random(150) < r.choice([0.6, 0.9, 0.98], 6).repeat(25)) for _ in range(2))
    n = min(len(px), len(py))
    px, py = px[:n], py[:n]
    least, share = 20, 0.8
    want = set()
    for i in range(n):
        for j in range(i, n):
            a, b = px[j] - px[i] + 1, py[j] - py[i] + 1
            if min(a, b) >= least and (j - i + 1) / max(a, b) >= share:
                want.update(range(i, j + 1))
    got = chaining.passages(px, py, least, share)
    covered = {i for i in range(n) for a, b, *_ in got if a <= px[i] < b}
    assert want <= covered and all(g[4] >= share for g in got)
    assert covered == want or len(got) == 1 and want == set(range(n))


def test_passage_whose_seeds_have_other_heads(spark):
    lines = [prose(130 + k, 15) for k in range(4)]
    texts = {1000 * k + i: f"{prose(2000 + 40 * k + i, 30)} {line} {prose(3000 + 40 * k + i, 30)}" for k, line in enumerate(lines) for i in range(1, 25)}
    passage = " ".join(lines)
    texts |= {8000: f"{passage} {prose(140, 40)}", 9000: f"{prose(141, 40)} {passage}"}
    rows = chaining.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert [(r["doc"], r["head"], r["doc_from"], r["doc_to"]) for r in rows if r["head"] < r["doc"]] == [(9000, 8000, 40, 100)]
    assert {(r["doc"], r["head"]) for r in rows} <= {(9000, 8000), (8000, 9000)}  # the seeds where two lines meet have both as heads


def test_passage_half_of_which_the_head_has_twice(spark):
    a, b = prose(150, 30), prose(151, 30)
    got = found(spark, {1: f"{a} {prose(152, 100)} {a} {b}", 2: f"{a} {b} {prose(153, 50)}"})
    assert any(p == 0 and q == 60 for p, q in got)


def test_run_hashes_tell_runs_apart():
    w = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    for n in (1, 5, 7, 50):
        runs = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        assert len({*zip(runs, chaining._run_hashes(w, n).tolist(), strict=True)}) == len({*runs}) == len({*chaining._run_hashes(w, n).tolist()})


def test_recall_with_a_word_changed_every_ten(spark):
    docs = []
    for i in range(60):
        p = prose(f"p10-{i}", 60).split()
        q = [f"changed{i}x{j}" if j % 10 == 5 else w for j, w in enumerate(p)]
        docs += [(2 * i, prose(f"a10-{i}", 40) + " " + " ".join(p)), (2 * i + 1, " ".join(q) + " " + prose(f"b10-{i}", 40))]
    got = chaining.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).where("doc = head + 1 and doc_to - doc_from >= 50")
    assert got.select("doc").distinct().count() >= 0.85 * 60


@pytest.mark.parametrize("seed", [1, 2])
def test_every_exact_run_of_fifty_words_is_found(spark, seed, monkeypatch):
    """Against brute force: fragments that many documents share, in between and inside the passages, hide none of them."""
    monkeypatch.setattr(chaining, "HOT_SEED", 40)
    r = np.random.default_rng(seed)
    lines = [prose(f"line{seed}-{k}", 12) for k in range(12)]
    passages = [" ".join([prose(f"own{seed}-{k}", 20), lines[k], lines[k + 1], prose(f"end{seed}-{k}", 9)]) for k in range(6)]
    texts = {}
    for i in range(200):
        parts = [prose(f"{seed}-{i}-{j}", int(r.integers(5, 40))) for j in range(4)]
        parts += [lines[k] for k in r.integers(0, 12, 3)] + ([passages[r.integers(0, 6)]] if r.random() < 0.3 else []) + ([" ".join(lines[k] for k in r.integers(0, 12, 6))] if r.random() < 0.2 else [])
        texts[i] = " ".join(parts[k] for k in r.permutation(len(parts)))
    first, want = {}, []
    for i, t in texts.items():
        w = t.split()
        runs = {p: tuple(w[p : p + 50]) for p in range(len(w) - 49)}
        want += [(i, p) for p, g in runs.items() if first.setdefault(g, i) != i]
    spans = {}
    for x in chaining.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).where("head < doc").collect():
        spans.setdefault(x["doc"], []).append((x["doc_from"], x["doc_to"]))
    covered = {(i, k) for i, s in spans.items() for a, b in s for k in range(a, b)}
    assert len(want) > 100 and all((i, k) in covered for i, p in want for k in range(p, p + 50))


def test_a_word_said_over_and_over_is_one_run_a_document(spark):
    say = lambda i, n: f"{prose(700 + i, 30)} {'again ' * n}{prose(800 + i, 30)}"
    docs = spark.createDataFrame([(i, say(i, 60 + 10 * i)) for i in range(12)], "doc_id bigint, text string")
    got = {}
    for r in chaining.repeated_passages(docs).where("head < doc").collect():
        got.setdefault(r["doc"], set()).update(range(r["doc_from"], r["doc_to"]))
    assert all(got[i] >= set(range(30, 90 + 10 * i)) for i in range(1, 12))
    marked = spark.createDataFrame([(i, [30, 31], list(range(30, 86 + 10 * i)), []) for i in range(12)], "doc bigint, at array<int>, shared array<int>, spans array<struct<lo:int,hi:int>>")
    runs = chaining.crowded_runs(marked, docs.withColumnRenamed("doc_id", "doc"), 50)
    assert runs.count() == runs.select("run", "doc").distinct().count()


def changed(text, every, tag):
    return " ".join(f"{tag}{k}" if k % every == every // 2 else w for k, w in enumerate(text.split()))


@pytest.mark.parametrize("every", [20, 30])
@pytest.mark.parametrize("many", [1, 50])
def test_fuzzy_passage_of_which_lesser_documents_have_pieces(spark, monkeypatch, every, many):
    monkeypatch.setattr(chaining, "MANY", many)
    monkeypatch.setattr(chaining, "BLOCK", 7)
    passage = prose(900, 120)
    words = passage.split()
    texts = {i: f"{prose(1000 + i, 40)} {' '.join(words[5 * i % 109 : 5 * i % 109 + 12])} {prose(2000 + i, 40)}" for i in range(1, 191)}
    texts |= {500: f"{prose(901, 40)} {passage}", 600: f"{prose(902, 40)} {changed(passage, every, 'other')} {prose(903, 40)}"}
    got = found(spark, {k: v for k, v in texts.items() if k <= 600})
    assert any(lo <= 42 and hi >= 158 for lo, hi in got)


@pytest.mark.parametrize(("seed", "many"), [(1, 50), (2, 50), (3, 1)])
def test_passages_are_those_of_heads_without_number(spark, monkeypatch, seed, many):
    """What lesser documents cover where every document is a head of its seeds is covered with four heads too, but for ends of passages."""
    r = np.random.default_rng(seed)
    lines = [prose(f"quoted{seed}-{k}", 14) for k in range(8)]
    passages = [" ".join([prose(f"mine{seed}-{k}", 15), lines[k], prose(f"and{seed}-{k}", 10), lines[k + 1], prose(f"last{seed}-{k}", 15)]) for k in range(6)]
    rows = []
    for i in range(150):
        parts = [prose(f"{seed}-{i}-{j}", int(r.integers(5, 40))) for j in range(4)] + [lines[k] for k in r.integers(0, 8, 3)]
        if r.random() < 0.4:
            parts.append(changed(passages[r.integers(0, 6)], int(r.choice([8, 12, 20])), f"c{i}x"))
        rows.append((i, " ".join(parts[k] for k in r.permutation(len(parts)))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")

    def covered():
        out = set()
        for x in chaining.repeated_passages(docs).where("head < doc").collect():
            out |= {(x["doc"], k) for k in range(x["doc_from"], x["doc_to"])}
        return out

    monkeypatch.setattr(chaining, "MANY", many)
    monkeypatch.setattr(chaining, "BLOCK", 20)
    got = covered()
    monkeypatch.setattr(chaining, "LANES", 1 << 20)
    want = covered()
    beyond = [w for w in want - got if not any((w[0], w[1] + k) in got for k in range(-chaining.WINDOW - chaining.K + 1, chaining.WINDOW + chaining.K))]
    assert len(want) > 1000 and not beyond and len(want - got) < 0.01 * len(want)  # another document may agree in a few words more at an end


@pytest.mark.parametrize("quoted", [prose(950, 16), "again " * 27], ids=["line", "stretch"])
def test_documents_that_quote_a_line_are_not_met_pair_by_pair(spark, monkeypatch, quoted):
    met, whole = [], chaining.chains_of_pairs
    monkeypatch.setattr(chaining, "chains_of_pairs", lambda pairs, marked: met.append(pairs.count()) or whole(pairs, marked))
    texts = {i: f"{prose(4000 + i, 40)} {quoted} {prose(5000 + i, 40)}" for i in range(40)}
    passage = f"{prose(951, 25)} {quoted} {prose(952, 25)}"
    texts |= {1000: f"{prose(953, 30)} {passage}", 2000: f"{changed(passage, 14, 'other')} {prose(954, 30)}"}
    assert any(hi - lo >= 50 for lo, hi in found(spark, texts))
    assert 0 < sum(met) <= 4 * len(texts)  # 861 pairs in all


@pytest.mark.parametrize("seed", range(3))
def test_chains_of_crowded_columns_match_brute_force(seed):
    r = np.random.default_rng(seed)
    pairs = [(5 * a, 5 * b) for a in range(0, 40, 2) for b in range(90) if r.random() < 0.8]
    x, y = (np.array(v) for v in zip(*pairs, strict=True))
    score, back = [0.0] * len(x), [-1] * len(x)
    chaining._dense(x, y, chaining.K, score, back)
    want = brute_chain_scores(pairs, chaining.K)
    assert score == pytest.approx([want[p] for p in pairs])
    assert chaining.chain(x, y)[0][4] == pytest.approx(max(want.values()))


def test_chains_too_short_are_those_that_give_no_long_alignment():
    r = np.random.default_rng(5)
    rows, column = [], lambda k: chaining.pa.array([v[k].tobytes() for v in rows], chaining.pa.binary())
    while len(rows) < 200:
        x = r.integers(0, 1 << 32, 160).astype(np.uint32)
        y = np.where(r.random(160) < r.choice([0.05, 0.1, 0.3]), 7, x).astype(np.uint32)
        same = np.flatnonzero([(x[p : p + 5] == y[p : p + 5]).all() for p in range(156)]).astype(np.int32)
        at = same[(same >= 60) & (same < 90)]
        rows += [(x, y, at, at)] if len(at) > 1 else []
    zero = np.zeros(len(rows), np.int64)
    short = chaining._too_short(*(column(k) for k in range(4)), zero, zero, 50)
    assert 0 < short.sum() < len(rows)
    for row, is_short in zip(rows, short, strict=True):
        px, _ = chaining.align(*row)
        assert is_short == (px[-1] - px[0] + 1 < 50)


def test_words_around_a_stretch_are_a_row_a_document(spark, monkeypatch):
    """Not one for each place of the stretch, side, distance and run of words."""
    counts, whole = [], chaining.words_around

    def counted(marked, texts):
        out = whole(marked, texts)
        counts.append(out.count())
        return out

    monkeypatch.setattr(chaining, "words_around", counted)
    texts = {i: f"{prose(6000 + i, 40)} {'again ' * 60}{prose(7000 + i, 40)}" for i in range(30)}
    found(spark, texts)
    assert counts and sum(counts) <= 4 * len(texts)
