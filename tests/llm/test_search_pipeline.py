"""Top-k search and SQL against brute force; the pipeline's stages."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from statloom.llm.common import components, written
from statloom.llm.queries import QUERIES, SQL
from statloom.llm.search import TopK, top_k, whole_vectors


def brute_force(ids, x, queries, k):
    out = []
    for q in np.flatnonzero(queries):
        score = x @ x[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out += [(ids[q], r + 1, ids[i], score[i]) for r, i in enumerate(order)]
    return out


@pytest.mark.parametrize("spread", [1, 40])
def test_bounds_lose_nothing(spread):
    rng = np.random.default_rng(spread)
    x = (rng.standard_normal((3000, 30)) * 20 + rng.standard_normal((3000, 1)) * spread).astype(np.int64)
    x[100:200] = x[0]
    ids = rng.permutation(9000)[:3000]
    best = TopK(ids[::30], x[::30], 7)
    for a in range(0, 3000, 700):
        best.add(ids[a : a + 700], x[a : a + 700])
    q, found, score = best.rows()
    got = [(a, b, c) for a, b, c in zip(q, found, score)]
    want = [(a, c, s) for a, _, c, s in brute_force(ids, x, np.arange(3000) % 30 == 0, 7)]
    assert sorted(got) == sorted(want)
    if spread > 1:
        assert best.exact < best.compared / 2


def test_odd_vectors(spark):
    rows = [(20, [1.0, 2.0]), (40, [0.5, -1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [3.0]), (60, None), (8, []), (1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = top_k(whole_vectors(df), F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got if r.query_id == 20] == [(20, 1, 7, 64 * 192), (20, 2, 1, 64 * 64 + 128 * 128), (20, 3, 1, 64 * 64 + 128 * 128)][:3] or got[0].vec_id in (1, 7)
    assert {r.query_id for r in got} == {20, 40}
    small = top_k(whole_vectors(df), F.col("vec_id") % 20 == 0, 50, block=1)
    assert small.where("query_id = 20").count() == 6
    assert top_k(whole_vectors(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    order = lambda d: d[sorted(d.columns)].sort_values(sorted(d.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(QUERIES[name](spark, sf).toPandas()), order(con.sql(SQL[name]).df()))


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(1, 40)] + [(int(a), int(b)) for a, b in rng.integers(100, 200, (60, 2))] + [(500, 500), (7, 3)]
    root = {n: n for e in links for n in e}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n in got} and set(root) - set(got) <= {n for n in root if root[n] == n}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], sf), "stage"))
        assert kept[-1].columns == names and kept[-1].schema == docs.schema
        assert kept[-1].join(kept[-2].select("doc_id"), "doc_id", "left_anti").count() == 0
        assert 0 < kept[-1].count() <= kept[-2].count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = labels.where("quality = 1")
    assert docs.join(good, "doc_id").count() - kept[1].join(good, "doc_id").count() <= 2
    assert kept[1].join(labels.where("quality = 0"), "doc_id").count() <= 4
    assert kept[3].select("text").distinct().count() == kept[3].count()
    assert kept[4].where(F.char_length("text") != F.col("n_chars")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[4], sf)
    assert pieces.select("doc_id").distinct().count() == kept[4].count()


def test_pipeline_of_odd_and_no_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "It is a text of some words and it is here", "en", "s", 41), (2, "", "en", "s", 0), (3, "It is a text of some words and it is here", None, None, 1), (3, "It is a text of some words and it is here", None, None, 1)], docs.schema)
    for given in (docs, odd):
        for _, stage in corpus_pipeline.STAGES:
            given = stage(spark, given, sf)
            assert given.count() >= 0
