"""Importance resampling against a plain version: every run spelled out, every number by the formula."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from statloom.llm.queries import op11_resampling
from statloom.llm.resample import resample, resampled, ring_buckets, word_stream


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_buckets(text, n, buckets):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]


def plain(docs, target, n, buckets, percent, least, seed=2024):
    raw = Counter(b for _, t in docs for b in plain_buckets(t, n, buckets))
    aim = Counter(b for t in target for b in plain_buckets(t, n, buckets))
    S, T = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (S + buckets) / ((raw[b] + 1) * (T + buckets)))) for b in raw}
    rows = []
    for i, t in docs:
        f = plain_buckets(t, n, buckets)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(t))])
    enough = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for k, r in enumerate(enough[: len(enough) * percent // 100]):
        r[4] = k + 1
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("n", [1, 2, 5])
def test_ring_finds_all_runs(n):
    text = "The cat, THE hat: é中x 9a -- " * 40
    found = [b for part in ring_buckets(word_stream(text.encode()), n, 10_000) for b in part.tolist()]
    assert Counter(found) == Counter(plain_buckets(text, n, 10_000))


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(op11_resampling(spark, sf)) == plain(docs, target, 1, 10_000, 10, 20)


@pytest.mark.parametrize("n", [1, 3])
def test_odd_rows(spark, n):
    docs = [(i, f"word{i % 5} and more É {i % 3}. " * (1 + i % 4)) for i in range(60)] + [(60, None), (61, ""), (62, " ... "), (63, "x " * 70_000), (7, "again and again and again"), (7, "again and again and again"), (None, "a b c d e f"), (None, None), (None, "b c a")]
    target = ["word1 and more", None, "", "word1 word2 again"]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'b' as bucket", "0 as weight", "1 as rank", "2 as key", "3 as piece")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resample(df, aim, n=n, buckets=97, percent=50, least_words=3)) == plain(docs, target, n, 97, 50, 3)
    assert resample(df.limit(0), aim).count() == 0
    assert got(resample(df, aim.limit(0), n=n, buckets=97, percent=50, least_words=3)) == plain(docs, [], n, 97, 50, 3)


def test_drawn_texts_resemble_the_target(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat(if(id % 4 = 0, repeat('apple pear plum ', 8), repeat('stone iron clay ', 8)), id) as text", "'k' as lang")
    aim = spark.createDataFrame([("apple pear plum " * 50,)], "text string")
    drawn = resampled(docs, aim, percent=20)
    assert drawn.columns == docs.columns and drawn.count() == 80
    assert drawn.where("text like 'apple%'").count() == 80
