"""Repeated passages against brute force over all 50-word windows, and removal of passages."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statloom.llm import passages
from statloom.llm.common import small_batches
from statloom.llm.passages import band_signatures, compact_windows, repeated_passages, shared_stretches, window_hashes, without_passages
from statloom.llm.shingles import joined, mix, place_weights, shingles, word_spans, word_starts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_words(docs, size=50):
    """Word positions in windows of ``size`` words that a document of smaller id has too."""
    first, need, length = {}, defaultdict(set), {}
    for i, t in sorted(docs):
        w = [x.lower() for x in WORD.findall(t or "")]
        length[i], own = len(w), []
        for a in range(len(w) - size + 1):
            g = tuple(w[a : a + size])
            if first.get(g, i) != i:
                need[i].update(range(a, a + size))
            own.append(g)
        for g in own:
            first.setdefault(g, i)
    return need, length


def text(rng, n):
    return [f"w{rng.randint(0, 3000)}" for _ in range(n)]


def test_windows_hold_the_least_hash():
    rng = random.Random(1)
    texts = [" ".join(text(rng, n)) for n in (0, 3, 49, 80, 300)] + ["the same " * 100]
    value, ends = shingles(texts, 5)
    for least in (10, 46):
        owner, h, left, c, right = compact_windows(value, ends, least, 2)
        covered = set()
        for t, l, m, r in zip(owner, left, c, right):
            assert 0 <= l <= m <= r < ends[t + 1] - ends[t] and r - l + 1 >= least
            covered |= {(t, s) for s in range(l, r - least + 2) if l <= s <= m < s + least}
        want = {(t, s) for t in range(len(texts)) for s in range(int(ends[t + 1] - ends[t]) - least + 1)}
        assert covered == want


def test_planted_passages_are_found_and_others_left(spark):
    rng = random.Random(2)
    passages = [text(rng, 60) for _ in range(4)]
    docs = []
    for i in range(60):
        w = text(rng, rng.choice([0, 20, 120, 400]))
        if i % 3 == 0 and w:
            p = list(passages[i // 3 % 4])
            if i % 2:
                p[30] = f"changed{i}"
            at = rng.randint(0, len(w))
            w = w[:at] + p + w[at:]
        docs.append((i * 2 + 1, " ".join(w)))
    docs += [(500, docs[5][1]), (501, docs[5][1]), (502, None), (503, "")]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, start_word int, source string")
    rows = repeated_passages(df).collect()
    got = defaultdict(set)
    for r in rows:
        assert r.source < r.doc_id and r.stop_word - r.start_word >= 50 and r.likeness >= 0.8
        got[r.doc_id].update(range(r.start_word, r.stop_word))
    need, length = repeated_words(docs)
    assert all(need[i] <= got[i] for i in need)
    planted = {i * 2 + 1 for i in range(60) if i % 3 == 0} | {500, 501}
    assert set(got) <= planted and all(len(got[i]) <= max(70, length[i]) for i in got)
    changed = [i * 2 + 1 for i in range(60) if i % 6 == 3 and docs[i][1]]
    assert sum(i in got for i in changed) >= len(changed) - 4
    cut = {r.doc_id: r for r in without_passages(df, repeated_passages(df)).collect()}
    assert len(cut) == len(docs) and cut[502].text is None and cut[501].source == "s"
    for i, t in docs:
        w = WORD.findall(t or "")
        assert WORD.findall(cut[i].text or "") == [x for k, x in enumerate(w) if k not in got[i]]


def test_table_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    need, _ = repeated_words(docs)
    got, found = defaultdict(set), repeated_passages(df).collect()
    for r in found:
        got[r.doc_id].update(range(r.start_word, r.stop_word))
    assert all(need[i] <= got[i] for i in need)
    texts = dict(docs)
    extra = [r for r in found if r.doc_id not in need]
    assert all(r.likeness >= 0.8 and likeness_by_force(texts[r.doc_id], r.start_word, r.stop_word, texts[r.source]) >= r.likeness - 1e-9 for r in extra)


def likeness_by_force(text, start, stop, source):
    """The highest Jaccard similarity, over 5-word shingles, of a stretch of a text to any stretch of 50 words or more of another one."""
    grams = lambda t: [tuple(w[i : i + 5]) for w in [WORD.findall(t.lower())] for i in range(len(w) - 4)]
    mine, other, best = set(grams(text)[start : stop - 4]), grams(source), 0.0
    where = [i for i, g in enumerate(other) if g in mine]
    for p in where:
        theirs = set(other[p : p + 45])
        for q in range(p + 45, len(other)):
            theirs.add(other[q])
            best = max(best, len(mine & theirs) / len(mine | theirs)) if q in where or q == p + 45 else best
    for q in where:  # from the left of a short one
        p = max(q - 45, 0)
        best = max(best, len(mine & set(other[p : q + 1])) / len(mine | set(other[p : q + 1])))
    return best


def test_window_hashes_tell_windows_apart():
    value = np.array([5, 7, 5, 7, 9, 5, 7, 5, 7, 9, 1], np.uint64)
    for least in (1, 2, 3, 5, 7):
        h = window_hashes(value, least).tolist()
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (value[i : i + least].tolist() == value[j : j + least].tolist())
    assert len(window_hashes(value, 12)) == 0


def test_words_and_empty_tables(spark):
    texts = ["A b\tC\n", "", "é  É", " x"]
    h, before, start, stop = words(texts)
    assert before.tolist() == [0, 3, 3, 5, 6] and [texts[0].encode()[a:b] for a, b in zip(start[:3], stop[:3])] == [b"A", b"b", b"C"]
    assert h[0] == words(["a"])[0][0] and h[3] != h[4]
    assert len(np.unique(h)) == len(h)
    df = spark.createDataFrame([(None, "a " * 200), (1, None)], "doc_id long, text string")
    assert repeated_passages(df).count() == 0 and repeated_passages(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "q w e r t " * 20), (1, "q w e r t " * 20)], "doc_id long, text string")
    assert repeated_passages(same).count() == 0


def best_likeness(g, s, least):
    """Greatest Jaccard similarity of a stretch of ``g`` and one of ``s``, each of at least ``least`` shingles."""
    best = 0.0
    for x in range(len(g) - least + 1):
        for y in range(x + least, len(g) + 1):
            mine = set(g[x:y])
            for p in range(len(s) - least + 1):
                other = set(s[p : p + least - 1])
                for q in range(p + least - 1, len(s)):
                    other.add(s[q])
                    common = len(mine & other)
                    best = max(best, common / (len(mine) + len(other) - common))
    return best


def grams(w):
    return shingles([" ".join(w)], 5)[0].view(np.int64)


def test_stretches_against_brute_force():
    rng = random.Random(5)
    for _ in range(30):
        p = text(rng, rng.choice([30, 34, 38]))
        c = list(p)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(c))
            c[i : i + rng.randint(0, 1)] = text(rng, rng.randint(1, 4))
        g, s = grams(text(rng, 4) + c + text(rng, 4)), grams(text(rng, 3) + p + text(rng, 5))
        assert bool(shared_stretches(g, s, 5, 24, 0.8)) == (best_likeness(g.tolist(), s.tolist(), 24) >= 0.8)


def test_stretches_with_inserted_block_or_weak_neighbour():
    rng = random.Random(6)
    p, tail = text(rng, 84), text(rng, 40)
    g, s = grams(p[:42] + text(rng, 7) + p[42:]), grams(text(rng, 20) + p)
    (a, b, like), = shared_stretches(g, s, 5, 46, 0.8)
    assert (a, b) == (0, len(g)) and round(like, 3) == 0.835
    p = text(rng, 60)
    weak = [x for i, w in enumerate(tail) for x in ([w] if i % 6 else [f"k{i}"])]
    (a, b, like), = shared_stretches(grams(p[:30] + ["changed"] + p[31:] + weak), grams(p + tail), 5, 46, 0.8)
    assert a == 0 and b >= 56 and like >= 0.8


def test_changed_passages_at_the_threshold_are_found(spark):
    rng = random.Random(8)
    docs, want = [], set()
    for i in range(120):
        p = text(rng, 50)
        c = [*p[:25], f"changed{i}", *p[26:]]
        docs += [(2 * i, " ".join(text(rng, 30) + p + text(rng, 30))), (2 * i + 1, " ".join(text(rng, 30) + c + text(rng, 30)))]
        want.add((2 * i + 1, 2 * i))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.source) for r in repeated_passages(df).collect()}
    assert len(want & found) >= 0.98 * len(want)


def test_repeats_led_elsewhere_are_found_word_for_word(spark):
    rng = random.Random(7)
    passages = [text(rng, 50) for _ in range(20)]
    value = [grams(p) for p in passages]
    docs = []
    for i, p in enumerate(passages):
        at = {int(compact_windows(value[i].view(np.uint64), np.array([0, 46]), 46, k)[3][0]) for k in range(8)}
        for k, c in enumerate(sorted(at)):  # earlier documents with each least shingle alone
            docs.append((100 * i + k, " ".join(text(rng, 60) + p[c : c + 5] + text(rng, 60))))
        docs += [(10_000 + i, " ".join(text(rng, 80) + p + text(rng, 80))), (20_000 + i, " ".join(text(rng, 80) + p + text(rng, 80)))]
        stock = [x for c in sorted(at) for x in p[c : c + 5] + text(rng, 50)]  # and earlier in the lead itself
        own = text(rng, 50)
        docs += [(30_000 + i, " ".join(stock + own)), (40_000 + i, " ".join(text(rng, 40) + own))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = defaultdict(set)
    for r in repeated_passages(df).collect():
        got[r.doc_id].update(range(r.start_word, r.stop_word))
    need, _ = repeated_words(docs)
    assert len(need) >= 40 and all(need[i] <= got[i] for i in need)


def test_pairs_that_one_function_groups_are_compared(spark):
    rng, docs = random.Random(9), []
    least = lambda w: {(k, int(compact_windows(grams(w).view(np.uint64), np.array([0, 46]), 46, k)[1][0])) for k in range(4)}
    while len(docs) < 16:
        p = text(rng, 50)
        c = [*p[:4], "changed", *p[5:]]
        if len(least(p) & least(c)) == 1:
            docs += [(len(docs), " ".join(p)), (len(docs) + 1, " ".join(c))]
    found = {(r.doc_id, r.source) for r in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {(i + 1, i) for i in range(0, 16, 2)}


def test_band_signatures_are_of_the_window_alone():
    rng = random.Random(10)
    p = grams(text(rng, 60))
    long = np.r_[grams(text(rng, 30)), p, grams(text(rng, 30))]
    at = 26
    assert (long[at : at + len(p)] == p).all()
    for least in (1, 5, 46):
        a, b = (np.array(list(band_signatures(x, least))) for x in (p, long))
        assert a.shape == (8, len(p) - least + 1) and (b[:, at : at + a.shape[1]] == a).all()
        assert len({int(x) for x in a[:, 0]}) == 8
    assert np.array(list(band_signatures(p[:3], 46))).shape == (8, 0)


@pytest.mark.parametrize("pool", [40, 80, 200, 20000])
def test_near_copies_of_formulaic_text_are_found(spark, pool):
    rng = random.Random(pool)
    stock = [text(rng, 8) for _ in range(pool)]
    phrases = lambda n: [w for _ in range(n) for w in rng.choice(stock)]
    docs, want = [(i, " ".join(phrases(25))) for i in range(600)], set()
    for i in range(150):
        p = phrases(8)[:60]
        c = [*p[:30], f"changed{i}", *p[31:]]
        docs += [(1000 + 2 * i, " ".join(text(rng, 40) + p + text(rng, 40))), (1001 + 2 * i, " ".join(text(rng, 40) + c + text(rng, 40)))]
        if likeness(p, c) >= 0.8:
            want.add((1001 + 2 * i, 1000 + 2 * i))
    rows = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.source) for r in rows}
    assert len(want) > 100 and len(want & found) >= 0.95 * len(want)


def likeness(a, b):
    a, b = set(grams(a).tolist()), set(grams(b).tolist())
    return len(a & b) / len(a | b)


def test_long_texts_come_in_few_bytes(spark):
    rows = spark.range(600, numPartitions=1).select("id", F.repeat(F.lit("word and "), 14_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    with small_batches(spark):
        n, most = rows.mapInArrow(sizes, "n bigint, bytes bigint").agg(F.sum("n"), F.max("bytes")).first()
    assert n == 600 and most < 5 << 20, most


def test_many_passages_are_cut_over_several_blocks(spark):
    docs = spark.range(700, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d "), F.col("id").cast("string")).alias("text"))
    spans = docs.selectExpr("doc_id", "1L as start_word", "3L as stop_word", "0L as source", "1D as likeness").where("doc_id % 7 <> 0")
    got = {r.doc_id: r.text for r in without_passages(docs, spans).collect()}
    assert got == {i: f"a d {i}" if i % 7 else f"a b c d {i}" for i in range(700)}


def pairs_of_all_kinds():
    """Texts of pairs: equal, changed in places, with repeated words, of many runs, apart, short and empty."""
    rng, out = random.Random(11), []
    for i in range(120):
        p = text(rng, rng.choice([0, 3, 30, 60, 90]))
        c = [w if rng.random() > 0.02 * (i % 4) else f"c{rng.randint(0, 99)}" for w in p]
        out.append((text(rng, i % 7) + c + text(rng, 5), text(rng, 9) + p + text(rng, i % 5)))
        if i % 6 == 0:
            again = (["a", "b", "c", "d"] * 40)[: 70 + i]
            out += [(again + p, p + again[3:]), (p + p[:50], p[10:] + p), (text(rng, 60), text(rng, 60))]
    long = text(rng, 700)
    return out + [([w if k % 8 else f"k{k}" for k, w in enumerate(long)], long), ([w if k % 30 else f"k{k}" for k, w in enumerate(long * 2)], long)]


def test_pairs_of_a_batch_are_compared_together_and_apart_alike(monkeypatch):
    pairs = pairs_of_all_kinds()
    joined_pairs = lambda j: shingles([" ".join(x[j]) for x in pairs], 5)
    (g, g_ends), (s, s_ends) = joined_pairs(0), joined_pairs(1)
    calls = []
    monkeypatch.setattr(passages, "window_hashes", lambda *a: calls.append(1) or window_hashes(*a))
    together = passages.Pairs(g, g_ends, s, s_ends)
    for least in (12, 46):
        calls.clear()
        near, exact = passages.near_stretches(together, least, 0.8), passages.exact_stretches(together, least)
        assert len(calls) == 2  # not two for each pair
        alone, want = [], []
        for i in range(len(pairs)):
            mine, other = g[g_ends[i] : g_ends[i + 1]], s[s_ends[i] : s_ends[i + 1]]
            alone += [(i, *x) for x in shared_stretches(mine, other, 5, least, 0.8)]
            windows = {tuple(other[k : k + least].tolist()) for k in range(len(other) - least + 1)}
            hit = [k for k in range(len(mine) - least + 1) if tuple(mine[k : k + least].tolist()) in windows]
            want += [(i, k) for k in sorted({x for k in hit for x in range(k, k + least)})]
        assert sorted(near) == alone and len({i for i, *_ in near}) > 40
        assert sorted({(i, k) for i, x, y in exact for k in range(x, y)}) == want
        for i, x, y, like in near:
            mine, other = g[g_ends[i] + x : g_ends[i] + y], s[s_ends[i] : s_ends[i + 1]]
            assert like >= 0.8 and y - x >= least and np.isin(np.unique(mine), other).mean() >= like - 1e-9


def test_words_are_hashed_by_their_bytes_and_places():
    rng = random.Random(12)
    texts = ["", " ", "x" * 5000 + " y\t" + "Z" * 24 + " " + "q" * 25 + " " + "q" * 23, "\n\n", "é" * 300, *["".join(rng.choice("ab \tÉZ") for _ in range(300)) for _ in range(20)]]
    data, _ = joined(texts)
    value, start, stop = word_spans(data)
    blob = data.tobytes()
    assert [blob[a:b] for a, b in zip(start, stop)] == re.findall(rb"[^\x20\x09-\x0D]+", blob) and word_starts(data).tolist() == start.tolist()
    of_byte, weight = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), place_weights(5000)
    for v, a, b in zip(value, start, stop):
        word = np.frombuffer(bytes(c + 32 if 65 <= c <= 90 else c for c in blob[a:b]), np.uint8)
        with np.errstate(over="ignore"):
            assert v == mix(np.array([(of_byte[word] * weight[: b - a]).sum() + np.uint64(b - a) * np.uint64(0x94D049BB133111EB)]))[0]
