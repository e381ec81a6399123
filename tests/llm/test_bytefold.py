"""The folded byte-level BPE against the library, on every code point, odd texts and a whole table."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from statloom.llm import bytefold
from statloom.llm.queries import op13_byte_bpe

HARD = ["", " ", "a", "  a", "a  ", " \n a", "\n\na b\n", "it's 'str 's x's' can't we'll I'm 'LL 'd've", "''s", "\t's", "1'23's", "aaa" * 50, "é'é 'é", "日本語 テスト　x", "\x1c\x1d a\x85b", "=====''''== 12ab34", "q" * 3000 + "x" * 1500, "x" * 50_000, "😀😀 's😀", "word " * 5000, "ࡰࡱ \U00010d40 1'ſ", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(bytefold.token_bytes(bytefold.default_path())) if t}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_of_every_code_point(library):
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    ranks = bytefold.rank_of(bytefold.default_path())
    for text in ("".join(c + " " for c in every), "".join("a" + c + "1" for c in every)):
        words = bytefold.words_of([text.encode()])[0]
        assert b"".join(words) == text.encode()
        assert [i for w in words for i in bytefold.merge_long(w, ranks)] == library.encode_ordinary(text)


def test_odd_texts_equal_the_library(spark, library):
    rng, letters = random.Random(3), list(" \n\t''''srtmdvel aZ19.,!é ß中😀<|>ࡰ")
    texts = [*HARD, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)), "".join(chr(c) + " " for c in range(1, 0x110000, 3) if not 0xD800 <= c <= 0xDFFF)]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, "b"), (900, None)], "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as block", "0 as key", "'w' as word")
    rows = bytefold.fold_documents(df, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(rows) == len(texts) + 4 and sum(r.doc_id == 3 for r in rows) == 3
    for r in rows:
        text = "b" if r.doc_id is None else "" if r.doc_id == 900 else texts[r.doc_id]
        ids = library.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids), text[:50]
        assert bytes(r.decoded) == text.encode() == library.decode_bytes(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bytefold.fold_documents(df.limit(0)).count() == 0


def test_fold_and_heap_agree(spark, library):
    rng = random.Random(9)
    words = [bytes(rng.choice(b"theraxz =0\xc3\xa9") for _ in range(rng.randint(1, 200))) for _ in range(300)] + [b"a" * 256, bytes(range(256))]
    ranks = bytefold.rank_of(bytefold.default_path())
    rows = bytefold.fold_words(spark.createDataFrame([(bytearray(w),) for w in words], "word binary"), bytefold.default_path()).collect()
    for r in rows:
        assert r.ids == bytefold.merge_long(bytes(r.word), ranks)
        assert b"".join(bytefold.token_bytes(bytefold.default_path())[i] for i in r.ids) == bytes(r.word)


def test_blocks_are_bounded_and_share_words(spark, library, monkeypatch):
    monkeypatch.setattr(bytefold, "BLOCK_CHARS", 300)
    texts = [f"the same words here, number {i % 7}. " * (1 + i % 5) for i in range(200)]
    rows = bytefold.fold_documents(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")).collect()
    assert len(rows) == 200 and all(r.ids == library.encode_ordinary(texts[r.doc_id]) for r in rows)


def test_query(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op13_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_distinct_words_are_those_of_the_texts(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab  c\n1é字'"), int(n))).encode() for n in rng.integers(0, 60, 300)] + [b"", b"x" * 3000, b""]
    words, count = bytefold.words_of(texts)
    for step, weights in ((1 << 20, bytefold.WEIGHTS), (50, bytefold.WEIGHTS), (50, np.ones(1, np.uint64))):  # the last: words of one hash differ
        monkeypatch.setattr(bytefold, "HASH_BYTES", step)
        found, which, each = bytefold.distinct_words(texts, weights)
        assert len(set(found)) == len(found) < len(words)
        assert [found[i] for i in which] == words
        np.testing.assert_array_equal(each, count)
    for none in ([], [b"", b""]):
        assert bytefold.distinct_words(none)[0] == []


def test_words_that_share_pieces_or_hashes(monkeypatch):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("ab\0é"), int(n))) for n in rng.integers(1, 40, 400)] + ["x" * 8, "x" * 8 + "\0", "x" * 16, "x" * 7]
    texts = [w.encode() for w in rng.choice(words, 3000)]
    for weights in (bytefold.WEIGHTS, np.zeros(1, np.uint64), np.ones(2, np.uint64)):
        found, which, count = bytefold.distinct_words(texts, weights)
        assert len(set(found)) == len(found) and [found[i] for i in which] == bytefold.words_of(texts)[0]


def test_cutting_in_parts_changes_nothing(monkeypatch):
    texts = [t.encode() for t in HARD * 3]
    usual = bytefold._cut(texts)
    monkeypatch.setattr(bytefold, "CUT_BYTES", 100)
    for a, b in zip(usual, bytefold._cut(texts)):
        np.testing.assert_array_equal(a, b)


def test_telling_words_apart_takes_few_bytes_a_character():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdé"), int(n))) for n in rng.integers(3, 12, 3000)]
    texts = [" ".join(rng.choice(words, 500)).encode() for _ in range(2000)]
    bytefold.distinct_words(texts[:1])
    tracemalloc.start()
    bytefold.distinct_words(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 9 * sum(map(len, texts))


def test_ids_are_spelled_together():
    path = bytefold.default_path()
    ids = np.random.default_rng(0).integers(0, len(bytefold.token_bytes(path)), 1000).astype("<u4")
    whole, at = bytefold.spell(ids, bytefold.token_array(path))
    assert [whole[a:b] for a, b in zip(at.tolist(), at[1:].tolist())] == [bytefold.token_bytes(path)[i] for i in ids]
    assert bytefold.spell(ids[:0], bytefold.token_array(path))[0] == b"" == bytefold.spell(ids[:0], pa.array([], pa.large_binary()))[0]
