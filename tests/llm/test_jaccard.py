"""The Jaccard join against all pairs, on texts whose similarities lie close to the threshold."""

import random
import re
from itertools import combinations

import pytest

import numpy as np
from pyspark.sql import functions as F

from statloom.llm import jaccard
from statloom.llm.jaccard import Bounds, jaccard_components, one_of_each, overlap_links
from statloom.llm.shingles import shingle_sets, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_force(rows, n, num, den):
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, families=6, copies=30, words=90):
    """Families of texts, each text an edited copy of an earlier one: words changed, dropped or put in, so that links form chains and balls."""
    rng, rows = random.Random(seed), []
    for f in range(families):
        size = rng.choice([3, 6, 12, 20, words, 3 * words])
        made = [[f"w{rng.randint(0, 5000)}" for _ in range(size)]]
        for _ in range(copies):
            new = list(rng.choice(made[: rng.choice([1, len(made)])]))
            for _ in range(rng.randint(0, max(1, size // 25))):
                at = rng.randrange(len(new))
                new[at : at + 1] = rng.choice([[], [new[at], "new"], [f"x{rng.randint(0, 99999)}"], []]) if len(new) > 2 else [new[0]]
            made.append(new)
        rows += [" ".join(m) for m in made]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "n", "threshold"), [(1, 4, (85, 100)), (2, 5, (80, 100)), (3, 1, (85, 100))])
def test_components_equal_all_pairs(spark, seed, n, threshold):
    rows = near_copies(seed)
    want = brute_force(rows, n, *threshold)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, threshold).collect()}
    assert got == want
    assert 5 < len({c for _, c in want.values()}) < len(rows)


def test_large_families_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 400)
    rows = near_copies(4, families=3, copies=40)
    want = brute_force(rows, 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize(("light", "columns"), [(1, 1), (2, 8), (16, 2048)])
def test_product_against_all_pairs(monkeypatch, light, columns):
    monkeypatch.setattr(jaccard, "LIGHT", light)
    monkeypatch.setattr(jaccard, "BLOCK_COLUMNS", columns)
    rows = near_copies(5, families=4, copies=20)
    want = brute_force([(i, t) for i, (_, t) in enumerate(rows)], 4, 85, 100)
    values, ends = shingle_sets([t for _, t in rows], 4)
    assert overlap_links(np.diff(ends), values, Bounds(85, 100)).tolist() == [c for _, c in want.values()]


def test_words_of_one_polynomial_hash_are_told_apart(spark):
    """Thue-Morse words have equal polynomial hashes modulo 2 ** 64 in any base."""
    for size in (1024, 2048, 4096):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
        b = a.translate({97: 98, 98: 97})
        assert len(set(words([a, b])[0].tolist())) == 2
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame([(1, f"x {a}"), (2, f"x {b}")], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2}


def test_near_copies_of_rows_without_a_key(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text), (5, text + " end"), (7, "the " + text), (None, "else " * 9)]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (0, 5), (5, 5), (7, 5)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, "é É"), (8, "a " * 3000), (9, "a " * 3000), (None, "one"), (10, None), (11, "x y z w v"), (11, "x y z w v")]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, node string, size int")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_components(df).collect()}
    assert got[(1, 0)] == 1 and got[(2, 0)] == 2 and got[(3, 0)] == 3 and got[(10, 0)] == 10
    assert got[(4, 1)] == got[(5, 1)] == 4 and got[(7, 1)] == 7 and got[(9, 1)] == 8
    assert jaccard_components(df.limit(0)).count() == 0
    kept = one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted(((r.doc_id or 0), r.text) for r in kept.collect() if r.doc_id in (4, 5, 8, 9, 11, None))
    assert [i for i, _ in ids] == [0, 4, 8, 11]


def test_bounds_hold():
    b = Bounds(85, 100)
    for a in range(1, 400):
        i = int(b.classes(a))
        assert b.lows[i] <= a < b.lows[i + 1]
        for c in range(a, a * 100 // 85 + 1):
            if b.needed(a, c) <= a:
                assert int(b.classes(c)) in (i, i + 1)
                assert a + c - 2 * b.needed(a, c) <= b.blocks(i)[0]


def probe(spark, n, seed=0):
    """Documents of 100 common words and 100 of their own: far from any link."""
    common = " ".join(f"boiler{i}" for i in range(100))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(common + " "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), F.col("id") * 100 + i)), " ")).alias("text"))


def test_boilerplate_makes_no_families(spark):
    """Common shingles join nobody: no copy of a set is sent, at twice the documents as well."""
    bounds = jaccard.Bounds(85, 100)
    for n in (300, 600):
        docs = probe(spark, n)
        assert len(jaccard.common_grams(docs, 4, "text")) == 97
        base = jaccard.summaries(docs, 4, "doc_id", "text")
        assert jaccard.near_sets(docs, base, 4, bounds, "text").count() == 0


@pytest.mark.parametrize("share", [0.0005, 0.9])
def test_links_do_not_depend_on_what_is_common(spark, share, monkeypatch):
    rng = random.Random(8)
    lines = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(14)) for _ in range(12)]
    texts = []
    for i in range(160):
        words = " ".join(rng.sample(lines, rng.randint(1, 6))).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"new{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {}
    for held in (np.zeros(0, np.uint64), jaccard.common_grams(docs, 4, "text", share=share), jaccard.common_grams(docs, 4, "text", share=0.05)):
        monkeypatch.setattr(jaccard, "common_grams", lambda *a, held=held: held)
        found = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs, 4, (80, 100)).collect())
        rows.setdefault("links", found)
        assert found == rows["links"]
        monkeypatch.undo()
    grams = [{tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert rows["links"] == list(enumerate(label))
