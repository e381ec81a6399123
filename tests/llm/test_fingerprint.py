"""I-Match fingerprints: exact columns, equal texts, likeness of edited texts, odd rows."""

import hashlib
import re

import pytest

from statloom.llm import fingerprint
from statloom.llm.fingerprint import fingerprints
from statloom.llm.queries import op1_fingerprint

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edited(text, following):
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


@pytest.mark.parametrize("pieces", [1, 7, 1024])
def test_order_edits_and_equal_texts(spark, pieces):
    rows = [(3, "alpha beta gamma delta " * 3), (1, "é😀 one two three four"), (7, None), (8, ""), (20, "alpha beta gamma delta " * 3), (15, "x"), (30, "12345678")]
    df = spark.createDataFrame([(i, t, 1, None) for i, t in rows], "doc_id long, text string, piece int, term string")
    got = {r.doc_id: r for r in fingerprints(df, pieces=pieces).collect()}
    order = sorted(rows)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited(t, following).encode()).hexdigest()
    assert got[3].fingerprint == got[20].fingerprint and got[7].fingerprint == got[8].fingerprint != got[15].fingerprint
    assert got[7].near_next == 1.0 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_lexicon_is_the_band_of_document_frequencies(spark):
    df = spark.createDataFrame([(i, "common " + ("middle " if i % 3 == 0 else "") + f"rare{i}") for i in range(60)], "doc_id long, text string")
    found = fingerprint.lexicon(df, idf_low=0.5, idf_high=2.0)
    assert found.count() == 1
    words = [w for w in re.split(r"[^a-z0-9]+", "common middle rare1") if w]
    assert len(words) == 3


def test_whole_table(spark, sf):
    rows = op1_fingerprint(spark, sf).toPandas()
    assert list(rows.columns) == COLUMNS and len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (rows.near_edited > rows.near_next).mean() > 0.9
    assert (rows.near_edited >= rows.near_next).mean() > 0.98
    shuffled = fingerprints(spark.read.parquet(f"{sf}/documents.parquet"), broadcast_terms=0).toPandas()
    assert set(map(tuple, shuffled.values)) == set(map(tuple, rows.values))


def agreement(a, b):
    """Likeness by the two fingerprint texts alone."""
    if a == b:
        return 1.0
    parts = lambda f: [f[i : i + fingerprint.HEX] for i in range(16, len(f), fingerprint.HEX)]
    pairs = [(x, y) for x, y in zip(parts(a), parts(b)) if x != "-" * fingerprint.HEX or y != "-" * fingerprint.HEX]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def test_likeness_is_that_of_the_returned_fingerprints(spark, sf):
    """Every row of the table, and texts of few terms of which the edited one has more, or fewer."""
    whole = op1_fingerprint(spark, sf).toPandas().sort_values("doc_id")
    body = " ".join(f"w{k}" for k in range(30))
    few = [(i, f"{body} x{i}") for i in range(40)] + [(50, "rare1 rare2 rare3"), (51, body), (52, "rare4 w1 w2 w3 w4 w5 w6 w7 rare5 rare6 rare7 rare8"), (53, "")]
    small = fingerprints(spark.createDataFrame(few, "doc_id long, text string"), idf_high=3.0).toPandas().sort_values("doc_id")
    for rows in (whole, small):
        following = rows.fingerprint.tolist()[1:] + rows.fingerprint.tolist()[:1]
        for r, after in zip(rows.itertuples(), following):
            assert abs(r.near_edited - agreement(r.fingerprint, r.edited_fingerprint)) < 1e-12, r.doc_id
            assert abs(r.near_next - agreement(r.fingerprint, after)) < 1e-12, r.doc_id


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (4, "c d")], "doc_id long, text string")
    assert fingerprints(df.limit(0)).count() == 0
    assert fingerprints(df).count() == 2
    one = fingerprints(df.where("doc_id = 4")).first()
    assert one.near_next == 1.0
    twice = fingerprints(df.where("doc_id = 4").unionByName(df.where("doc_id = 4"))).collect()
    assert len(twice) == 2 and all(r.near_next == 1.0 for r in twice)


def test_text_of_a_third_of_the_rows_and_texts_of_rare_terms(spark):
    hot = " ".join(f"hot{k}" for k in range(60))
    other = [" ".join(f"w{i * 7 % 50 + k}" for k in range(40)) for i in range(80)]
    near = hot.replace("hot30 ", "")
    rows = [(i, t) for i, t in enumerate(other)] + [(1000 + i, hot) for i in range(40)] + [(2000, near)]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1039].near_next > 0.3 and got[1039].near_edited > 0.05 and got[2000].near_edited > 0.05
    assert len({got[1000 + i].fingerprint for i in range(40)}) == 1
    rare = [(i, t) for i, t in enumerate(other)] + [(3000, " ".join(f"rare{k}" for k in range(60))), (3001, " ".join(f"rare{k}" for k in range(59)) + " plain")]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rare, "doc_id long, text string"), idf_high=3.0).collect()}
    #: The edited text has enough terms in the band, the text has not: their fingerprints are over other terms, and only these count.
    assert got[3000].near_next > 0.3 and got[3001].near_edited == agreement(got[3001].fingerprint, got[3001].edited_fingerprint) == 0.0
