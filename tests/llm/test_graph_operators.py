"""Components, URL filters, nearest neighbours and the pipeline."""

import random

import numpy as np
import pytest

from freehold.llm import hilbert, urls
from freehold.llm.shared import Scratch, connected_components, pick_ids


def brute(edges):
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("hot", [3, 1000])
@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind, hot, monkeypatch):
    monkeypatch.setattr("freehold.llm.shared.HOT_KEY", hot)
    r = random.Random(3)
    edges = {"chain": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 40)], "random": [(r.randrange(60), r.randrange(60)) for _ in range(45)], "none": []}[kind]
    df = spark.createDataFrame([*edges, *edges[:3], (None, 5)], "a bigint, b bigint")
    got = {x["node"]: x["label"] for x in connected_components(df, Scratch(spark)).collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])


def test_pick_ids_beyond_the_bound(spark, monkeypatch):
    rows, ids = spark.range(10), spark.range(4)
    monkeypatch.setattr("freehold.llm.shared.BROADCAST_IDS", 2)
    assert pick_ids(rows, ids, "id").count() == 4 and pick_ids(rows, ids, "id", "left_anti").count() == 6


def test_url_filter(spark):
    link = lambda u: f'<html><head><LINK rel="canonical" href="{u}"></head></html>'
    refresh = '<meta http-equiv="refresh" content="0; url=/en/1x">'
    pages = [
        (1, "https://A.example.org/es/x?utm_source=f#t", None), (2, "http://plain.net/a", link("https://a.example.org/es/x")), (3, "http://plain.net/b", link("//plain.net/a")), (4, "http://other.org/q", link("http://plain.net/a")),
        (5, "http://plain.net/c", None), (6, "no host", None), (7, None, None), (8, "http://w.com/fr/1", None), (9, "http://xcom/fr/1", None), (10, "https://x.example.org/zz", refresh), (11, "http://plain.net/b/", None), (1, "https://A.example.org/es/x?utm_source=f#t", None),
    ]
    df = spark.createDataFrame([(*p, "r", "n") for p in pages], "page_id bigint, url string, html string, row string, node string")
    out = {r["row"]["page_id"]: r["judged"] for r in urls.judge_urls(df).collect()}
    verdict = {k: (v["rule"], v["verdict"]) for k, v in out.items()}
    assert (out[1]["host"], out[1]["path"]) == ("a.example.org", "/es/x") and verdict[1] == ("example.org/es/", "block")
    assert verdict[2] == verdict[3] == verdict[11] == (None, "block")
    assert verdict[4] == ("org/", "allow")  # an explicit allow stands in a blocked component
    assert verdict[5] == (None, "allow") and (out[6]["host"], out[6]["path"]) == ("", "") and verdict[7] == (None, "allow")
    assert verdict[8] == ("com/fr/", "allow") and verdict[9] == (None, "allow") and verdict[10] == ("org/", "allow")
    assert urls.judge_urls(df).count() == len(pages) and urls.judge_urls(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.judge_urls(df, [urls.Rule("allow", "x", "/")] * 1001)
    log = spark.createDataFrame([("http://plain.net/c", "http://b.example.org/es/")], "from_url string, to_url string")
    assert {r["row"]["page_id"]: r["judged"]["verdict"] for r in urls.judge_urls(df, redirects=log).collect()}[5] == "block"


def test_vectors_are_kept_once_and_curves_in_passes_find_the_same(spark, monkeypatch):
    """No saved table has a vector once a curve, and one curve at a time gives what all at once give."""
    r = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(900, 12)).round(3))], "vec_id bigint, embedding array<float>")
    kept, save = [], hilbert.Scratch.save

    def counted(self, table, name):
        out = save(self, table, name)
        kept.append(out.count() if "v" in out.columns else 0)
        return out

    monkeypatch.setattr(hilbert.Scratch, "save", counted)
    rows = lambda: sorted(map(tuple, hilbert.nearest(df, planes=2).collect()))
    want = rows()
    assert len(want) == 45 * 20 and max(kept) == 900
    monkeypatch.setattr(hilbert, "PASS_BYTES", 1)
    assert rows() == want


def test_hilbert_curve_is_continuous():
    grid = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    walk = grid[np.argsort(hilbert.hilbert_keys(grid, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 24))
    x[5] = x[200] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (920, [0.0] * 24), (940, [float("nan")] * 24), (960, [1.0] * 3), (980, [None] * 24), (None, x[0].tolist()), rows[0]]
    df = spark.createDataFrame([(*r, "q") for r in rows + odd], "vec_id bigint, embedding array<double>, rep string")
    got = hilbert.nearest(df).toPandas()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    recall = []
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in g["vec_id"].tolist()
        assert np.allclose(g["score"], x[g["vec_id"]] @ x[q]) and (np.diff(g["score"]) <= 1e-12).all()
        recall.append(len(set(g["vec_id"]) & set(np.argsort(-s[q], kind="stable")[:20])) / 20)
    assert got["query_id"].nunique() == 40 and np.mean(recall) >= 0.9
    first = got[got["query_id"] == 40].sort_values("rank")["vec_id"].tolist()
    assert first[:2] == [5, 200]
    few = hilbert.nearest(df.where("vec_id < 4")).collect()
    assert len(few) == 3 and hilbert.nearest(df.limit(0)).count() == 0


def test_neighbours_of_clusters_stay_in_first_windows(spark):
    """The windows follow the clusters, not the number of vectors; recall against brute force."""
    rng = np.random.default_rng(3)
    reaches = []
    for n in (2000, 8000):
        x = rng.normal(size=(n // 100, 32))[rng.integers(0, n // 100, n)] + 0.2 * rng.normal(size=(n, 32))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        got = hilbert.nearest(df, query_every=50).toPandas()
        recall = []
        for q, g in got.groupby("query_id"):
            s = x @ x[q]
            s[q] = -np.inf
            recall.append(len(set(g["vec_id"]) & set(np.argsort(-s, kind="stable")[:20])) / 20)
        assert len(recall) == n // 50 and np.mean(recall) >= 0.9
        reaches.append(got["reach"].median())
    assert reaches == [hilbert.REACH] * 2


def test_neighbours_of_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = df.where("embedding is not null").toPandas().drop_duplicates("vec_id").set_index("vec_id")["embedding"]
    x, ids = np.stack(rows.to_numpy()).astype(float), rows.index.to_numpy()
    got, recall = hilbert.nearest(df).toPandas(), []
    for q, g in got.groupby("query_id"):
        s = np.where(ids == q, -np.inf, x @ np.asarray(rows[q], float))
        recall.append(len(set(g["vec_id"]) & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    assert len(recall) == (ids % 20 == 0).sum() and np.mean(recall) >= 0.9


def test_pipeline_keeps_clean_rows(spark, tmp_path):
    import corpus_pipeline

    from .conftest import prose

    docs = [(i, prose(i, 90), "en", f"s{i % 3}", 0) for i in range(60)] + [(100, prose(1, 90), "en", "s0", 0), (101, "### $$$ " * 60, "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(60), 101]], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        d = Scratch(spark).save(stage(spark, d, f"file://{tmp_path}"), "s")
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r["doc_id"] for r in d.collect()} >= set(range(60)) and d.where("doc_id = 100").count() == 0
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 30


def test_pipeline_stages_on_odd_rows(spark, odd, odd_rows, empty, tmp_path):
    """Nulls in any column, blanks, repeats, clashing names and empty tables, stage by stage; near duplicates and the mix against brute force."""
    import corpus_pipeline

    from .conftest import WORD
    from .test_text_operators import brute_components

    spark.createDataFrame([(i, int(i not in (12, 13)), 0) for i in range(1, 15)], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
    assert corpus_pipeline.quality(spark, odd, sf).columns == odd.columns
    kept = corpus_pipeline.near_duplicates(spark, odd, sf)
    label = brute_components([r[:2] for r in odd_rows])[1]
    want = [r for r in dict.fromkeys(odd_rows) if r[0] is not None and (label[r[0]] == r[0] or not (r[1] or "").strip())] + [r for r in odd_rows if r[0] is None]
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(str(spark_row) for spark_row in spark.createDataFrame(want, odd.schema).collect())
    cut = Scratch(spark).save(corpus_pipeline.repeated_passages(spark, kept, sf), "s")
    assert cut.columns == odd.columns and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut.collect())
    mixed = Scratch(spark).save(corpus_pipeline.source_mix(spark, cut, sf), "s")
    words = lambda d: sum(len(WORD.findall(r["text"] or "")) for r in d.collect())
    assert mixed.columns == odd.columns and abs(words(mixed) - words(cut)) <= 4
    assert corpus_pipeline.encode(spark, mixed, sf).count() == mixed.count()


def test_near_duplicates_keeps_different_texts_of_an_id(spark):
    import corpus_pipeline

    rows = [(1, "a b c d e f", "en"), (1, "a b c d e f", "fr"), (1, "u v w x y z", "en"), (2, "a b c d e f", "en")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "").collect()
    assert sorted(map(tuple, got)) == [(1, "a b c d e f", "en"), (1, "u v w x y z", "en")]
