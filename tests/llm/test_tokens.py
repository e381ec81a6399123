"""Encoding, counting, packing and sharding against brute force on small inputs."""

import hashlib
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from statloom.llm import bpe, packing
from statloom.llm.bpe import default_path, loaded
from statloom.llm.packing import hilbert_key, pack_documents
from statloom.llm.sharding import shard_documents
from statloom.llm.tokens import TokenTree, count_edits, encode_documents, sample_edits

HARD = ["", " ", "a", "  a", "a  ", " \n a", "\n\na b\n", "it's 'str 's x's' can't we'll I'm 'LL 'd've", "a '", "''s", " 's", "\t's", "1'23's", "aaa" * 50, "x<|endoftext|> y <|endoftext|><|endoftext|>", "é'é 'é", "日本語 テスト　x", "\x1c\x1d a\x85b", "=====''''== 12ab34", "q" * 3000 + "x" * 1500, "😀😀 's😀", "word " * 5000]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(default_path())


def noise(n, size=40):
    rng, letters = random.Random(5), list(" \n\t''''srtmdvel aZ19.,!é ß中😀<|>")
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_ids_equal_the_library(reference):
    texts = HARD + noise(2000)
    ids, count = loaded(default_path()).encode(texts)
    ends = np.cumsum(count)
    for t, a, b, e in zip(texts, ends - count, ends, reference.encode_batch(texts, add_special_tokens=False)):
        assert ids[a:b].tolist() == e.ids, t
        assert loaded(default_path()).decode(ids[a:b]).decode() == t == reference.decode(e.ids, skip_special_tokens=False)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids int, at string")


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, [(i, t, None, 1, "x") for i, t in enumerate(HARD)] + [(100, None, "en", None, None), (101, "same", None, 0, ""), (102, "same", None, 0, ""), (102, "same", None, 0, "")])


def test_encode_documents(spark, odd, reference):
    rows = encode_documents(odd, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in rows:
        ids = reference.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert encode_documents(odd.limit(0)).count() == 0


def test_tree_follows_random_edits(reference):
    rng, bpe = random.Random(3), loaded(default_path())
    for text in [*HARD[:19], " ".join(noise(60))]:
        tree = TokenTree(text, bpe)
        for new in noise(12, 9):
            a = rng.randint(0, len(text) + 1)
            b = a + rng.choice([0, 1, 3, len(text) // 3])
            tree.edit(a, b, new)
            a = min(a, len(text))
            text = text[:a] + new + text[max(a, min(b, len(text))) :]
            assert tree.text == text
            assert tree.total == len(reference.encode(text, add_special_tokens=False).ids)


def test_an_edit_leaves_the_rest_alone():
    tree = TokenTree("word " * 20000, loaded(default_path()))
    before = tree.encoded_chars
    tree.edit(50_000, 50_002, "x y")
    assert tree.encoded_chars - before < 60


def test_count_edits_over_a_table(spark, odd, reference):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = count_edits(odd.withColumn("edits", sample_edits())).collect()
    assert len(rows) == odd.count()
    for r in rows:
        t = texts[r.doc_id]
        first, n = t[:25], len(t)
        t = t[: n // 4] + " [see note 3] " + t[n // 4 :]
        t = t[: n // 2] + t[n // 2 + 40 :]
        t = t[: max(len(t) - 10, 0)] + first
        assert r.edited_sha256 == hashlib.sha256(t.encode()).hexdigest(), texts[r.doc_id]
        assert r.edited_n_tokens == len(reference.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("length", [7, 1024])
def test_packing_covers_each_id_once(spark, odd, reference, length):
    rows = pack_documents(odd, length=length, with_ids=True).collect()
    texts, pieces, seqs = {r.doc_id: r.text or "" for r in odd.collect()}, defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for doc, own in pieces.items():
        ids = reference.encode(texts[doc], add_special_tokens=False).ids + [0]
        times = 2 if doc == 102 else 1
        covered = sorted((r.start + i, t) for r in own for i, t in enumerate(r.ids))
        assert covered == sorted((i, t) for i, t in enumerate(ids) for _ in range(times))
        assert {r.doc_tokens for r in own} == {len(ids)}
    assert set(pieces) == set(texts)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    assert sum(sum(r.length for r in own) < length for own in seqs.values()) <= 4
    assert pack_documents(odd.limit(0)).count() == 0


def test_packing_takes_texts_a_few_megabytes_at_once(spark, odd, monkeypatch):
    asked = []
    monkeypatch.setattr(packing, "written", lambda df, name: asked.append(int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))) or df)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert pack_documents(odd).count() and asked == [packing.BATCH_BYTES] and packing.BATCH_BYTES <= 8 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_a_large_batch_is_cut_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    n = np.r_[rng.integers(1, 9000, 4000), 3_000_000, 1]
    ids = rng.integers(0, 65536, n.sum()).astype("<u2")
    ends = np.r_[0, np.cumsum(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array([ids[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["key", "n", "ids"])
    tracemalloc.start()
    pieces, most = [], 0
    for columns in packing.cut_pieces([batch, batch.slice(0, 0), batch], 1024, np.dtype("<u2"), 7 << 40):
        most = max(most, tracemalloc.get_traced_memory()[1])
        pieces.append(np.column_stack([np.asarray(c) for c in columns]))
    tracemalloc.stop()
    assert most < ids.nbytes  # the whole batch in 32 bits alone would be twice that
    key, start, length, crc, total, seq, offset = np.concatenate(pieces).T
    at = np.cumsum(length) - length
    np.testing.assert_array_equal((seq - (7 << 40)) * 1024 + offset, at)
    both = np.r_[ids, ids].astype("<u4")
    assert length.sum() == len(both) and (length <= 1024).all() and (offset + length <= 1024).all()
    assert crc.tolist() == [zlib.crc32(both[a : a + b].tobytes()) for a, b in zip(at, length)]
    np.testing.assert_array_equal(total, n[key])
    np.testing.assert_array_equal(start, at % ends[-1] - ends[key])


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert_key(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_sharding_moves_rows_only_into_the_new_shard(spark, odd):
    rows = shard_documents(odd).collect()
    assert len(rows) == odd.count()
    slots, where = defaultdict(list), {}
    for r in rows:
        t = next(x.text or "" for x in odd.collect() if x.doc_id == r.doc_id)
        assert (r.size, r.text_crc32, r.law) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "key")
        assert r.grown_shard in (r.shard, 16)
        assert where.setdefault(r.doc_id, r.shard) == r.shard
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = spark.range(40000).selectExpr("id as doc_id", "'x' as text")
    heavy = {r.shard: r["count"] for r in shard_documents(many, [1.0, 3.0], [1.0, 3.0, 1.0]).groupBy("shard").count().collect()}
    assert abs(heavy[1] / heavy[0] - 3) < 0.15
    moved = shard_documents(many, [1.0, 3.0], [1.0, 3.0, 1.0]).where("shard <> grown_shard")
    assert moved.where("grown_shard <> 2").count() == 0 and abs(moved.count() / 8000 - 1) < 0.1
    assert shard_documents(odd.limit(0)).count() == 0
    assert shard_documents(spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string")).select("shard").distinct().count() == 1


@pytest.mark.parametrize("hashes", ["usual", "all equal"])
def test_words_that_share_a_hash(reference, monkeypatch, hashes):
    """Thue-Morse words collide under any polynomial hash modulo 2 ** 64; with equal hashes only the bytes tell words of one length apart."""
    if hashes == "all equal":
        monkeypatch.setattr(bpe, "BYTE_HASH", np.zeros(256, np.uint64))
    coder = bpe.Bpe(default_path())
    for size in (1024, 2048):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
        b = a.translate({97: 98, 98: 97})
        for texts in ([a, b, "ab ba", "ba ab"], [b, a, *noise(300)], noise(300)):
            ids, count = coder.encode(texts)
            ends = np.cumsum(count)
            assert [ids[i:j].tolist() for i, j in zip(ends - count, ends)] == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
