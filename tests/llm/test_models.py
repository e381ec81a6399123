"""The trained models: exact gradients and recursions, held-out accuracy, odd rows."""

import zlib
from itertools import product

import numpy as np
import pytest

from statloom.llm import language, quality
from statloom.llm.queries import op6_quality, op10_language


def test_chain_recursions_equal_enumeration():
    rng = np.random.default_rng(1)
    before, trans = np.array([0, 1, 5, 8]), rng.standard_normal((2, 2))
    unary = rng.standard_normal(8)
    chains = quality.Chains(before)
    z, p, state = chains.run(unary, trans)
    want = np.zeros((2, 2))
    for d, (a, b) in enumerate(zip(before[:-1], before[1:])):
        paths = list(product((0, 1), repeat=b - a))
        score = np.array([sum(unary[a + i] for i, y in enumerate(s) if y) + sum(trans[x, y] for x, y in zip(s, s[1:])) for s in paths])
        assert z[d] == pytest.approx(np.log(np.exp(score).sum()))
        weight = np.exp(score - z[d])
        for i in range(b - a):
            assert p[a + i] == pytest.approx(sum(w for w, s in zip(weight, paths) if s[i]))
        for w, s in zip(weight, paths):
            for x, y in zip(s, s[1:]):
                want[x, y] += w * (d + 1)
    np.testing.assert_allclose(chains.transitions(unary, trans, state, np.array([1.0, 2.0, 3.0])), want)


def test_recurrent_gradients_equal_differences():
    rng = np.random.default_rng(2)
    h, steps = 3, rng.integers(0, 5, (6, 4))
    d = language.Direction(rng.standard_normal((256, 3 * h)).astype(np.float32), rng.standard_normal((h, 3 * h)).astype(np.float32))
    pull = rng.standard_normal((6, 4, h)).astype(np.float32)
    g_byte, g_state = d.learn(steps, d.read(steps, True)[1], pull)
    loss = lambda: float((d.read(steps).astype(np.float64) * pull).sum())
    for w, g, at in ((d.byte, g_byte, (1, 0)), (d.byte, g_byte, (2, 4)), (d.byte, g_byte, (3, 8)), (d.state, g_state, (0, 1)), (d.state, g_state, (1, 5)), (d.state, g_state, (2, 7))):
        old = w[at]
        w[at] = old + 1e-2
        high = loss()
        w[at] = old - 1e-2
        low = loss()
        w[at] = old
        assert (high - low) / 2e-2 == pytest.approx(float(g[at]), abs=2e-2)


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    held = rows[rows.held_out]
    assert held.score.between(0, 1).all() and (held.predicted == (held.score >= 0.3)).all()
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert (good.to_numpy()[:, None] > bad.to_numpy()).mean() > 0.97
    assert (held.predicted == held.quality).mean() > 0.95


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = op10_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    held = rows[rows.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and held.score.between(0, 1).all()


ODD = [(1, None, None, 1), (2, "", "en", 0), (3, "123 !!", None, 0), (4, "word " * 20000, "en", 1), (None, "some text", "en", 1), (5, "\n\n", None, None), (6, "déjà vu 日本", "fr", 1), (6, "déjà vu 日本", "fr", 1)]


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, t, l, 0) for i, t, l, _ in ODD], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in ODD], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        model = quality.train(docs, given)
        rows = quality.score_documents(docs, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 6}) == 1
        assert {r.n_lines for r in rows if r.doc_id == 5} == {3}
        assert quality.keep_documents(docs, model, 0.0).collect() == docs.collect()
        assert quality.score_documents(docs.limit(0), model).count() == 0
    for given in (docs, docs.limit(0)):
        model = language.train(given)
        rows = language.identify(docs, model).collect()
        assert len(rows) == len(ODD)
        assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 3, 5))
        assert language.identify(docs.limit(0), model).count() == 0
    kept = language.keep_documents(docs, language.train(docs), 0.0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, None, 6}


def test_windows_do_not_change_a_text_of_one_window():
    model = language.fit([b"the cat and", b"der hund und"] * 5, ["en", "de"] * 5, steps=30)
    alone = model.documents(["the cat"])
    among = model.documents(["x" * 500, "the cat", ""])
    np.testing.assert_allclose(alone[0], among[1], rtol=1e-5)
    assert not among[2].any()
