"""Packing of token sequences along a space-filling curve.

A document's token ids are hashed into a vector, the vector is projected to three dimensions, and the documents are put in
order of the Hilbert key of that point: neighbours on the curve share vocabulary. The ordered id stream is cut every ``LENGTH``
ids, so only the last sequence of each range of the curve has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.bpe import default_path, loaded
from statloom.llm.common import small_batches, written
from statloom.llm.tokens import text_blocks

LENGTH, END_ID = 1024, 0
DIMS, BITS, HASHED = 3, 10, 512
#: Ids for each range of the curve: at least so many while there are few, at most so many however many there are.
RANGE_IDS_LEAST, RANGE_IDS_MOST = 1024 * 256, 2**26
#: Bytes of texts that a worker gets at once, and ids (or one document's) that it cuts at once.
BATCH_BYTES, CUT_IDS = 6 << 20, 1 << 20


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n x dims, each below 2 ** bits): Gray code undone bit by bit, then interleaved."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection(vocabulary: int, seed: int = 11) -> np.ndarray:
    """For each id the projected unit vector of its hash bucket."""
    rows = np.random.default_rng(seed).standard_normal((HASHED, DIMS)).astype(np.float32)
    bucket = (np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASHED.bit_length() + 1)
    return rows[bucket.astype(np.int64)]


def curve_position(ids: np.ndarray, count: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert key of each document, for documents' ids one after the other (every count at least 1)."""
    mean = np.add.reduceat(table[ids], np.cumsum(count) - count, axis=0) / count[:, None]
    grid = ((1 << BITS) / (1 + np.exp(-6.0 * mean))).astype(np.int64)
    return hilbert_key(np.clip(grid, 0, (1 << BITS) - 1))


def cut_pieces(batches: Iterable[pa.RecordBatch], length: int, dtype: np.dtype, base: int, with_ids: bool = False) -> Iterator[list[pa.Array]]:
    """Cut a stream of documents (key, number of ids, ids as bytes of ``dtype``) every ``length`` ids; sequences are numbered from ``base``.

    Columns: those of ``pack_documents``. A batch is worked on CUT_IDS ids (or one document) at a time, however large it is.
    """
    at = 0
    for whole in batches:
        total = np.cumsum(np.asarray(whole.column(1)))
        first = np.flatnonzero(np.diff((total - np.asarray(whole.column(1))) // CUT_IDS, prepend=-1)).tolist()
        for i, j in zip(first, [*first[1:], whole.num_rows]):
            batch = whole.slice(i, j - i)
            n = np.asarray(batch.column(1))
            ids = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype).astype("<u4")
            begin = at + np.cumsum(n) - n
            first_seq, last_seq = begin // length, (begin + n - 1) // length
            pieces = last_seq - first_seq + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = first_seq[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            left = np.maximum(begin[row], seq * length)
            right = np.minimum(begin[row] + n[row], (seq + 1) * length)
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((left - at).tolist(), (right - at).tolist())]
            columns = [batch.column(0).take(pa.array(row)), left - begin[row], right - left, np.array(crc, np.int64), n[row], base + seq, left - seq * length]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(right - left)].astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
            at += int(n.sum())


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pack every document, its ids and END_ID, into sequences of at most ``length`` ids.

    One row for each piece: key, start (the document's ids before it), length, ids_crc32 (of its ids as little-endian 32-bit
    numbers), doc_tokens (with END_ID), sequence_id, offset (in its sequence), and with ``with_ids`` the ids. A null text counts
    as empty and is END_ID alone; repeated rows are packed each; an empty table gives no rows; other columns are not carried.

    Texts are encoded once; the ids are written to the shared folder, so that sampling for the ranges and lost tasks do not encode
    again. Rows are dealt by (Hilbert key, hash of the row), so copies, which share a key, spread over ranges. Each range
    numbers its own sequences, from range x 2^40 on, and is cut while it streams through: no step needs a range in memory, and workers
    get texts and ids a few megabytes at once.
    """
    path = path or default_path()
    kind = dict(docs.dtypes)[key]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        table, dtype = projection(bpe.size), np.dtype("<u2" if bpe.size <= 65536 else "<u4")
        for batch in batches:
            for keys, body in text_blocks(batch.column(0), batch.column(1)):
                if not body:
                    continue
                ids, count = bpe.encode(body)
                ids = np.insert(ids, np.cumsum(count), END_ID)
                count = count + 1
                where = curve_position(ids, count, table)
                ends = np.r_[0, np.cumsum(count)] * dtype.itemsize
                raw = pa.Array.from_buffers(pa.large_binary(), len(body), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype(dtype).tobytes())])
                yield pa.RecordBatch.from_arrays([keys, pa.array(where), pa.array(count), raw.cast(pa.binary())], names=[key, "curve", "n", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype("<u2" if loaded(path).size <= 65536 else "<u4")
        for columns in cut_pieces(batches, length, dtype, TaskContext.get().partitionId() << 40, with_ids):
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    with small_batches(docs.sparkSession, 8192, BATCH_BYTES):
        encoded = written(docs.select(key, text).mapInArrow(encode, f"`{key}` {kind}, curve bigint, n bigint, ids binary"), "encoded")
    total = encoded.agg(F.sum("n")).first()[0] or 0
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = int(max(1, min(usual, total // RANGE_IDS_LEAST), total // RANGE_IDS_MOST))
    spread = encoded.withColumn("row", F.xxhash64(key, "n"))
    ordered = spread.repartitionByRange(ranges, "curve", "row").sortWithinPartitions("curve", "row", key)
    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return ordered.select(key, "n", "ids").mapInArrow(cut, schema)
