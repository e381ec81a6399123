"""Byte-level BPE in Spark's own functions: a fold of ranked merges over the bytes of distinct words.

Texts are cut into words by a pattern. Each distinct word of the corpus is encoded once: a fold joins the lowest-ranked pair of
neighbours, the first from the left among equals, until no pair has a rank. Ranks come from a literal: buckets by a
token's hash, which a lookup searches by the token's bytes. The encoded words go back to the blocks of texts that have
them by joins, and a block's texts are put together from them. Decoding joins the bytes of the ids' tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.bpe import pretoken_starts
from statloom.llm.common import discard, small_batches, written
from statloom.llm.shingles import mix

#: Buckets of the rank literal.
BUCKETS = 1 << 13
#: Longer words, in bytes, are merged through a heap by the worker that cuts them, as a fold copies the whole word at each step.
LONG_WORD = 256
#: Characters of a block of texts, and its rows at most: what is put together at once.
BLOCK_CHARS, BLOCK_ROWS = 8_000_000, 8192
#: Weights of the places of a word's pieces of eight bytes (of its size: the last), bytes of text that are hashed at once, and what is kept of a piece of so many bytes.
WEIGHTS, HASH_BYTES = mix(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1), 1 << 20
KEPT = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of texts that are cut into words at once, and words whose ids are put in their places at once.
CUT_BYTES, PLACED_WORDS = 1 << 20, 1 << 18
#: No rank, and the mark of a pair that has been joined.
NONE, GONE = 2**31 - 1, -1
# Letters and numbers that Unicode has had since version 14, up to version 16; a JVM may know fewer.
NEW_LETTERS = [(0x870, 0x887), (0x889, 0x88E), (0x8B5, 0x8B5), (0x8C8, 0x8C9), (0xC5D, 0xC5D), (0xCDD, 0xCDD), (0x170D, 0x170D), (0x171F, 0x171F), (0x1B4C, 0x1B4C), (0x1C89, 0x1C8A), (0x2C2F, 0x2C2F), (0x2C5F, 0x2C5F), (0x9FFD, 0x9FFF), (0xA7C0, 0xA7C1), (0xA7CB, 0xA7CD), (0xA7D0, 0xA7D1), (0xA7D3, 0xA7D3), (0xA7D5, 0xA7DC), (0xA7F2, 0xA7F4), (0x10570, 0x1057A), (0x1057C, 0x1058A), (0x1058C, 0x10592), (0x10594, 0x10595), (0x10597, 0x105A1), (0x105A3, 0x105B1), (0x105B3, 0x105B9), (0x105BB, 0x105BC), (0x105C0, 0x105F3), (0x10780, 0x10785), (0x10787, 0x107B0), (0x107B2, 0x107BA), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x10F70, 0x10F81), (0x11071, 0x11072), (0x11075, 0x11075), (0x1123F, 0x11240), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11740, 0x11746), (0x11AB0, 0x11ABF), (0x11BC0, 0x11BE0), (0x11F02, 0x11F02), (0x11F04, 0x11F10), (0x11F12, 0x11F33), (0x12F90, 0x12FF0), (0x1342F, 0x1342F), (0x13441, 0x13446), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16A70, 0x16ABE), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1AFF0, 0x1AFF3), (0x1AFF5, 0x1AFFB), (0x1AFFD, 0x1AFFE), (0x1B11F, 0x1B122), (0x1B132, 0x1B132), (0x1B155, 0x1B155), (0x1DF00, 0x1DF1E), (0x1DF25, 0x1DF2A), (0x1E030, 0x1E06D), (0x1E290, 0x1E2AD), (0x1E4D0, 0x1E4EB), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0), (0x1E7E0, 0x1E7E6), (0x1E7E8, 0x1E7EB), (0x1E7ED, 0x1E7EE), (0x1E7F0, 0x1E7FE), (0x2A6DE, 0x2A6DF), (0x2B735, 0x2B739), (0x2EBF0, 0x2EE5D), (0x31350, 0x323AF)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x11F50, 0x11F59), (0x16130, 0x16139), (0x16AC0, 0x16AC9), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1D2C0, 0x1D2D3), (0x1E4F0, 0x1E4F9), (0x1E5F1, 0x1E5FA)]


def _cut(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 texts one after the other, where each of their words begins and the last ends, and how many each text has.

    Texts of CUT_BYTES (or one text) are cut at once, as that takes many bytes a character.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = [*np.flatnonzero(np.diff((np.cumsum(size) - size) // CUT_BYTES, prepend=-1)).tolist(), len(texts)]
    starts, counts, data, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
    for i, j in zip(edges, edges[1:]):
        body, start, count = _cut_together(texts[i:j])
        data.append(body)
        starts.append(start + at)
        counts.append(count)
        at += len(body)
    return b"".join(data), np.concatenate([*starts, [at]]), np.concatenate(counts)


def _cut_together(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The same of a few texts, without the end of the last word."""
    body = [t.decode("utf-8", "replace") for t in texts]
    chars = np.fromiter(map(len, body), np.int64, len(body))
    whole = "".join(body)
    cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32).copy()
    if not len(cp):
        return b"", np.zeros(0, np.int64), chars
    begin = np.cumsum(chars) - chars
    first = np.zeros(len(cp), bool)
    first[begin[chars > 0]] = True
    high = np.flatnonzero(cp >= NEW_LETTERS[0][0])
    for ranges, stand_in in ((NEW_LETTERS, "a"), (NEW_NUMBERS, "1")):
        edges = np.array(ranges).ravel() + np.tile([0, 1], len(ranges))
        cp[high[np.searchsorted(edges, cp[high], side="right") % 2 == 1]] = ord(stand_in)
    at = np.flatnonzero(pretoken_starts(cp, first))
    owner = np.searchsorted(at, np.r_[begin, len(cp)])
    data = whole.encode()
    if len(data) != len(cp):  # a character begins at each byte but those of the form 10xxxxxx
        at = np.flatnonzero(np.frombuffer(data, np.int8) >= -64)[at]
    return data, at, np.diff(owner)


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of UTF-8 texts, one text after the other, and how many each text has."""
    data, cuts, count = _cut(texts)
    cuts = cuts.tolist()
    return [data[i:j] for i, j in zip(cuts, cuts[1:])], count


def _pieces(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the last byte."""
    return np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))


def distinct_words(texts: list[bytes], weights: np.ndarray = WEIGHTS) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of UTF-8 texts, which of them each word is, one text after the other, and how many words each text has.

    Words meet by a hash of their size and pieces of eight bytes and are compared piece by piece; where two of one hash differ, all are told apart by a
    dictionary. Only distinct words become objects.
    """
    data, cuts, count = _cut(texts)
    n, eight, at, size = len(cuts) - 1, _pieces(data), cuts[:-1], np.diff(cuts)
    parts = np.unique(np.r_[np.searchsorted(cuts, np.arange(0, len(data), HASH_BYTES)), n]).tolist() if len(data) else []
    hashes = size.astype(np.uint64) * weights[-1]
    for i, j in zip(parts, parts[1:]):
        k, rows = 0, np.arange(i, j)
        while len(rows):
            hashes[rows] += (eight[at[rows] + 8 * k] & KEPT[np.minimum(size[rows] - 8 * k, 8)]) * weights[k % len(weights)]
            k += 1
            rows = rows[size[rows] > 8 * k]
    met = pa.array(mix(hashes)).dictionary_encode()
    which = np.asarray(met.indices).astype(np.int64)
    first = np.empty(len(met.dictionary), np.int64)
    first[which[::-1]] = np.arange(n)[::-1]
    for i, j in zip(parts, parts[1:]):
        k, rows, lead = 0, np.arange(i, j), first[which[i:j]]
        same = np.array_equal(size[lead], size[i:j])
        while same and len(rows):
            same = not ((eight[at[rows] + 8 * k] ^ eight[at[lead] + 8 * k]) & KEPT[np.minimum(size[rows] - 8 * k, 8)]).any()
            k += 1
            more = size[rows] > 8 * k
            rows, lead = rows[more], lead[more]
        if not same:
            ends = cuts.tolist()
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip(ends, ends[1:])], np.int64)
            return list(number), which, count
    return [data[a:b] for a, b in zip(cuts[first].tolist(), cuts[first + 1].tolist())], which, count


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[bytes, ...]:
    """The bytes of every id of a rank file (a token in base64 and its rank on each line); ids without a token have none."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f) if b}
    return tuple(ranks.get(i, b"") for i in range(max(ranks, default=-1) + 1))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, null or not. The maximum of one element is that element, and its type is asked for only once."""
    return F.array_max(F.transform(F.array(value), use))


def with_table(rows: list[tuple[bytes, object]], kind: str, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``use(lookup)``, where lookup searches a literal of (bytes, value) rows and is null for bytes that it does not hold."""
    keys: list[list[str]] = [[] for _ in range(BUCKETS)]
    values: list[list[object]] = [[None] for _ in range(BUCKETS)]  # what is not found has position 0
    for key, value in rows:
        h = xxhash.xxh64_intdigest(key, seed=42) % 2**64
        h = (h - 2**64 if h >= 2**63 else h) % BUCKETS
        keys[h].append(base64.b64encode(key).decode())
        values[h].append(value)
    held = F.from_json(F.lit(json.dumps(keys, separators=(",", ":"))), "array<array<binary>>")
    given = F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), f"array<array<{kind}>>")

    def lookup(k: Column, v: Column, key: Column) -> Column:
        h = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        return F.get(F.get(v, h), F.array_position(F.get(k, h), key).cast("int"))

    return let(held, lambda k: let(given, lambda v: use(lambda key: lookup(k, v, key))))


def fold_word(word: Column, rank: Callable[[Column], Column]) -> Column:
    """The ids (array<int>) of a word's bytes: a word that is a token is that; else pairs are joined by rank."""
    none = lambda r: F.coalesce(r, F.lit(NONE))

    def join(state: Column) -> Column:
        starts, ranks = state["starts"], state["ranks"]

        def at(p: Column) -> Column:  # the first of the two parts, from 1
            piece = lambda i, j: none(rank(F.substring(word, F.get(starts, i), F.get(starts, j) - F.get(starts, i))))
            around = F.transform(ranks, lambda r, i: F.when(i == p - 1, GONE).when(i == p - 2, piece(p - 2, p + 1)).when(i == p, piece(p - 1, p + 2)).otherwise(r))
            return F.struct(F.array_remove(starts, F.get(starts, p)).alias("starts"), F.array_remove(around, GONE).alias("ranks"))

        return let(F.array_min(ranks), lambda m: F.when(none(m) < NONE, let(F.array_position(ranks, m).cast("int"), at)).otherwise(state))

    def fold(n: Column) -> Column:
        steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        first = F.transform(steps, lambda i: none(rank(F.substring(word, i, F.lit(2)))))
        start = F.struct(F.sequence(F.lit(1), n + 1).alias("starts"), first.alias("ranks"))
        parts = lambda acc: F.transform(F.slice(acc["starts"], F.lit(1), F.size(acc["starts"]) - 1), lambda s, i: rank(F.substring(word, s, F.get(acc["starts"], i + 1) - s)))
        return F.aggregate(steps, start, lambda acc, _: join(acc), parts)

    whole = lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(let(F.octet_length(word), fold))
    return let(rank(word), whole)


def fold_words(words: DataFrame, path: str, word: str = "word") -> DataFrame:
    """Adds ids (array<int>) to rows of words (binary, not null)."""
    table = [(t, i) for i, t in enumerate(token_bytes(path)) if t]
    return words.withColumn("ids", with_table(table, "int", lambda rank: fold_word(F.col(word), rank)))


#: Bytes of an id on its way to the blocks.
ID_BYTES = 3


def packed_ids(ids: str) -> Column:
    """Ids one after the other, each in ID_BYTES bytes, the highest first."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 2 * ID_BYTES, "0")), ""))


def unpacked_ids(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words, one word after the other, and where each begins and the last ends."""
    body = packed.to_pylist()
    size = np.fromiter(map(len, body), np.int64, len(body)) // ID_BYTES
    raw = np.frombuffer(b"".join(body), np.uint8).reshape(-1, ID_BYTES).astype(np.int32)
    return raw[:, 0] << 16 | raw[:, 1] << 8 | raw[:, 2], np.r_[0, np.cumsum(size)]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word, pair by pair through a heap over a linked list of its parts."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    nxt, prv, alive = [*range(1, n + 1), n], [-1, *range(n)], [True] * n
    pair = lambda i: ranks.get(word[i : nxt[nxt[i]]], NONE) if nxt[i] < n else NONE
    heap = [(r, i) for i in range(n) if (r := pair(i)) < NONE]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or pair(i) != r:
            continue
        j = nxt[i]
        alive[j], nxt[i] = False, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for k in (prv[i], i):
            if k >= 0 and (s := pair(k)) < NONE:
                heapq.heappush(heap, (s, k))
    return [ranks[word[i : nxt[i]]] for i in range(n) if alive[i]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch], list[bytes]]]:
    """Blocks of a task's (key, text) rows, however they come in batches, with a number made of what they hold; nulls are empty texts.

    Blocks of one number share their words, which does no harm.
    """

    def numbered(rows: list[pa.RecordBatch], texts: list[bytes]) -> tuple[int, list[pa.RecordBatch], list[bytes]]:
        digest = hashlib.blake2b(digest_size=4)
        for t in texts:
            digest.update(len(t).to_bytes(8, "little") + t)
        return int.from_bytes(digest.digest(), "little", signed=True), rows, texts

    rows, texts, size = [], [], 0
    for batch in batches:
        first = 0
        for i, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            t = t or b""
            if texts and (len(texts) == BLOCK_ROWS or size + len(t) > BLOCK_CHARS):
                yield numbered([*rows, batch.slice(first, i - first)], texts)
                rows, texts, size, first = [], [], 0, i
            texts.append(t)
            size += len(t)
        rows.append(batch.slice(first))
    if texts:
        yield numbered(rows, texts)


def block_words(docs: DataFrame, path: str) -> DataFrame:
    """Rows (block, word): the distinct words of each block of texts, without the long ones and those that are tokens. Rows in: key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = rank_of(path)
        for block, _, texts in _blocks(batches):
            words = [w for w in distinct_words(texts)[0] if len(w) <= LONG_WORD and w not in ranks]
            for i in range(0, len(words), 20_000):
                part = pa.array(words[i : i + 20_000], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int32)), part], names=["block", "word"])

    return docs.mapInArrow(run, "block int, word binary")


def packed_blocks(docs: DataFrame) -> DataFrame:
    """Rows (block, body): each block of texts with its keys, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, _ in _blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in rows:
                    out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "body"])

    return docs.mapInArrow(run, "block int, body binary")


OUTPUTS = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def fold_documents(docs: DataFrame, outputs: tuple[str, ...] = ("n_tokens", "ids"), key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode every whole text by a rank file, each word separately and without special tokens, and decode the ids again.

    Rows: key and the asked ``OUTPUTS``: n_tokens, ids, decoded (bytes), ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256. A null
    text counts as empty and has no ids; repeated rows stay; an empty table gives no rows; other columns are not carried.
    The file must rank every single byte. A word that is a token is that one; words beyond LONG_WORD bytes are merged through a heap.

    Each task emits the distinct words of its blocks of texts, of at most BLOCK_CHARS bytes (or one text) each; distinct words are folded once; two joins
    bring their ids to the blocks that have them. So rows that move grow with the blocks' distinct words, and texts move once, compressed, to meet their words.
    A word that all blocks have is one row a block. Nothing is broadcast, no group is larger than a block.
    """
    path = path or default_path()
    body = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        pairs = written(block_words(body, path), "block-words")
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # folding is work by the word, so few bytes are not few tasks
        folded = fold_words(pairs.select("word").repartition(tasks, "word").distinct(), path)
        vocabulary = written(folded.select("word", packed_ids("ids").alias("ids")), "vocabulary")
        known = written(pairs.join(vocabulary, "word").select("block", "ids"), "block-ids")
        discard(pairs, vocabulary)
    kind = dict(docs.dtypes)[key]

    def put_together(bodies: pa.Table, words: pa.Table) -> pa.Table:
        pieces, ranks = token_array(path), rank_of(path)
        flat, ends = unpacked_ids(words.column("ids"))
        spelled, at = spell(flat, pieces)
        at = at[ends].tolist()
        place = {spelled[a:b]: k for k, (a, b) in enumerate(zip(at, at[1:]))}
        made: list[pa.Table] = []
        for packed in bodies.column("body").to_pylist():
            rows = pa.ipc.open_stream(packed).read_all()
            found, each, count = distinct_words([t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()])
            # Tokens, long words; and any, should another split of the input have made other blocks.
            others = {w: merge_long(w, ranks) for w in found if w not in place}
            sizes = np.fromiter(map(len, others.values()), np.int64, len(others))
            place |= {w: len(ends) - 1 + k for k, w in enumerate(others)}
            flat = np.r_[flat, np.array([i for x in others.values() for i in x], np.int32)]
            ends = np.r_[ends, ends[-1] + np.cumsum(sizes)]
            which = np.array([place[w] for w in found], np.int64)[each]
            n = np.diff(ends)[which]
            total = np.r_[0, np.cumsum(n)]
            ids = np.empty(total[-1], "<u4")
            for i in range(0, len(which), PLACED_WORDS):
                own = slice(i, i + PLACED_WORDS)
                a, b = total[i], total[min(i + PLACED_WORDS, len(which))]
                ids[a:b] = flat[np.repeat(ends[which[own]] - total[own][: len(which[own])], n[own]) + np.arange(a, b)]
            cuts = total[np.r_[0, np.cumsum(count)]].tolist()
            made.append(_columns(rows.column("key"), ids, cuts, pieces, outputs))
        return pa.concat_tables(made)

    blocks = packed_blocks(body).groupBy("block").cogroup(known.groupBy("block"))
    return blocks.applyInArrow(lambda a, b: put_together(a, b) if a.num_rows else _columns(pa.array([], pa.int64()), np.zeros(0, "<u4"), [0], token_array(path), outputs), f"key {kind}, " + ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs)).withColumnRenamed("key", key)


def _columns(keys, ids: np.ndarray, cuts: list[int], pieces: pa.Array, outputs: tuple[str, ...]) -> pa.Table:
    """The asked columns of texts whose ids lie one after the other, cut at ``cuts``."""
    raw, spans = memoryview(ids.tobytes()), list(zip(cuts, cuts[1:]))
    made: dict = {"n_tokens": pa.array(np.diff(cuts).astype(np.int64))}
    if "ids" in outputs:
        made["ids"] = pa.ListArray.from_arrays(pa.array(np.array(cuts, np.int32)), pa.array(ids.astype(np.int32)))
    if "ids_sha256" in outputs:
        made["ids_sha256"] = pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans], pa.string())
    if {"decoded", "decoded_sha256"} & set(outputs):
        whole, at = spell(ids, pieces)
        at = at[cuts].tolist()
        decoded = [whole[a:b] for a, b in zip(at, at[1:])]
        made |= {"decoded": pa.array(decoded, pa.binary()), "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())}
    return pa.table({"key": keys, **{o: made[o] for o in outputs}})


def spell(ids: np.ndarray, pieces: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes that ids stand for: their pieces, one after the other; and where each begins and the last ends."""
    taken = pieces.take(pa.array(ids, pa.int32()))
    at = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1)
    return taken.buffers()[2].to_pybytes()[at[0] : at[-1]], at - at[0]


@lru_cache(maxsize=2)
def token_array(path: str) -> pa.Array:
    """``token_bytes`` as an array that takes together as many bytes as there are."""
    return pa.array(token_bytes(path), pa.large_binary())


@lru_cache(maxsize=2)
def rank_of(path: str) -> dict[bytes, int]:
    return {t: i for i, t in enumerate(token_bytes(path)) if t}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
