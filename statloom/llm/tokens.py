"""Encoding and decoding of whole texts on executors, and token counts that follow edits."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.bpe import SPACES, Bpe, default_path, loaded

OUTPUTS = {"n_tokens": ("bigint", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
#: Texts of about so many characters are encoded in one go.
BATCH_CHARS = 1_500_000


def text_blocks(keys: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, list[str]]]:
    """Pieces of a batch with at most BATCH_CHARS characters, or one text, each; nulls become empty texts."""
    body = ["" if t is None else t for t in texts.to_pylist()]
    i = 0
    while i < len(body):
        j, chars = i, 0
        while j < len(body) and (j == i or chars + len(body[j]) <= BATCH_CHARS):
            chars += len(body[j])
            j += 1
        yield keys.slice(i, j - i), body[i:j]
        i = j


def encode_documents(docs: DataFrame, outputs: tuple[str, ...] = ("n_tokens", "ids"), key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode every whole text with a tokenizer file and decode the ids again.

    Rows: key and the asked outputs of OUTPUTS: n_tokens, ids, decoded, ids_sha256 (of the ids as little-endian 32-bit
    numbers) and decoded_sha256 (of the decoded text in UTF-8). A null text counts as empty, repeated rows stay, an empty table gives no
    rows, other columns are not carried. Texts are worked on in blocks, so memory is bounded by the longest text.
    No shuffle: each input partition is encoded where it is read.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for keys, body in text_blocks(batch.column(0), batch.column(1)):
                ids, count = bpe.encode(body)
                ends = np.cumsum(count)
                cuts = list(zip((ends - count).tolist(), ends.tolist()))
                made: dict = {"n_tokens": count}
                if "ids" in outputs:
                    made["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids))
                if "ids_sha256" in outputs:
                    wide = memoryview(ids.astype("<u4").tobytes())
                    made["ids_sha256"] = [hashlib.sha256(wide[4 * a : 4 * b]).hexdigest() for a, b in cuts]
                if {"decoded", "decoded_sha256"} & set(outputs):
                    raw = [bpe.decode(ids[a:b]).decode("utf-8", "replace") for a, b in cuts]
                    made |= {"decoded": raw, "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in raw]}
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(made[o], OUTPUTS[o][1]) if not isinstance(made[o], pa.Array) else made[o] for o in outputs]], names=[key, *outputs])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, ", ".join([f"`{key}` {kind}", *[f"{o} {OUTPUTS[o][0]}" for o in outputs]]))


_BLANK = "".join(re.escape(chr(c)) for c in SPACES)
#: Spaces and the word after them. No pre-token goes from a word into a following space, so units are encoded apart.
UNIT = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
LEAF_UNITS = 64


class TokenTree:
    """Token count of a text under edits: a segment tree over runs of units, with characters and tokens summed in each node.

    An edit re-encodes the units it touches and their neighbours, since a unit's tokens depend on nothing
    outside it, and corrects the sums on the path to the root.
    """

    def __init__(self, text: str, bpe: Bpe, units: list[str] | None = None, counts: list[int] | None = None):
        self.bpe, self.encoded_chars = bpe, 0
        units = UNIT.findall(text) if units is None else units
        self._build(units, self._count(units) if counts is None else counts)

    def _count(self, units: list[str]) -> list[int]:
        self.encoded_chars += sum(map(len, units))
        return self.bpe.encode(units)[1].tolist()

    def _build(self, units: list[str], counts: list[int]) -> None:
        cut = range(0, max(len(units), 1), LEAF_UNITS)
        self.units, self.counts = [units[i : i + LEAF_UNITS] for i in cut], [counts[i : i + LEAF_UNITS] for i in cut]
        self.width = 1 << (len(self.units) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (u, c) in enumerate(zip(self.units, self.counts)):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(map(len, u)), sum(c)
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join("".join(u) for u in self.units)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, unit in it and that unit's first character, for a character position (the end: the last unit)."""
        at = max(0, min(at, self.chars[1] - 1))
        node, left = 1, 0
        while node < self.width:
            node *= 2
            if at >= left + self.chars[node]:
                left += self.chars[node]
                node += 1
        leaf = node - self.width
        ends = list(accumulate(map(len, self.units[leaf])))
        unit = bisect_right(ends, at - left)
        return leaf, unit, left + ends[unit] - len(self.units[leaf][unit])

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters start..stop by ``new``; positions beyond the text count as its end."""
        plan = self.plan(start, stop, new)
        self.apply(plan, self._count(plan[0]))

    def plan(self, start: int, stop: int, new: str) -> tuple:
        """The units to encode for an edit, and where they go: first leaf and unit, last leaf and unit."""
        size = self.chars[1]
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        if not size:
            return UNIT.findall(new), None
        leaf, unit, left = self._find(start - 1)
        last_leaf, last_unit, right = self._find(stop)
        right += len(self.units[last_leaf][last_unit])
        if last_unit + 1 < len(self.units[last_leaf]):  # the unit after the edited ones may join them
            last_unit += 1
            right += len(self.units[last_leaf][last_unit])
        else:
            later = next((i for i in range(last_leaf + 1, len(self.units)) if self.units[i]), None)
            if later is not None:
                last_leaf, last_unit = later, 0
                right += len(self.units[later][0])
        touched = self.units[leaf][unit:] if leaf != last_leaf else self.units[leaf][unit : last_unit + 1]
        if leaf != last_leaf:
            touched = touched + [u for i in range(leaf + 1, last_leaf) for u in self.units[i]] + self.units[last_leaf][: last_unit + 1]
        old = "".join(touched)
        return UNIT.findall(old[: start - left] + new + old[stop - left :]), (leaf, unit, last_leaf, last_unit)

    def apply(self, plan: tuple, counts: list[int]) -> None:
        """Put a plan's units, now counted, into their place and correct the sums."""
        units, place = plan
        if place is None:
            self._build(units, counts)
            return
        leaf, unit, last_leaf, last_unit = place
        tail_units, tail_counts = self.units[last_leaf][last_unit + 1 :], self.counts[last_leaf][last_unit + 1 :]
        self.units[leaf] = self.units[leaf][:unit] + units + (tail_units if leaf == last_leaf else [])
        self.counts[leaf] = self.counts[leaf][:unit] + counts + (tail_counts if leaf == last_leaf else [])
        for i in range(leaf + 1, last_leaf):
            self.units[i], self.counts[i] = [], []
        if leaf != last_leaf:
            self.units[last_leaf], self.counts[last_leaf] = tail_units, tail_counts
        if len(self.units[leaf]) > 4 * LEAF_UNITS:
            self._build([u for b in self.units for u in b], [c for b in self.counts for c in b])
            return
        for i in range(leaf, last_leaf + 1):
            node = self.width + i
            self.chars[node], self.tokens[node] = sum(map(len, self.units[i])), sum(self.counts[i])
            while node > 1:
                node //= 2
                self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]


def count_edits(docs: DataFrame, edits: str = "edits", key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Token counts before and after edits, without encoding the edited texts anew.

    ``edits`` is a column array<struct<start:int,stop:int,new:string>>, applied in order, each to the text the last one
    left, in code points. Rows: key, n_tokens, edited_n_tokens, edited_chars, edited_sha256, reencoded_chars (what the edits encoded).
    Null texts count as empty, null edits or replacements as none; positions beyond the text count as its end; repeated rows
    stay; an empty table gives no rows; other columns are not carried. No shuffle.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            changes, at = batch.column(2).to_pylist(), 0
            for keys, body in text_blocks(batch.column(0), batch.column(1)):
                units = [UNIT.findall(t) for t in body]
                counts, i = bpe.encode([u for x in units for u in x])[1].tolist(), 0
                trees, todo = [], []
                for k, own in enumerate(units):
                    trees.append(TokenTree("", bpe, own, counts[i : i + len(own)]))
                    todo.append(changes[at + k] or ())
                    i += len(own)
                before = [t.total for t in trees]
                for step in range(max(map(len, todo), default=0)):  # one edit of each text at a time, encoded together
                    plans = [(t, t.plan(e[step]["start"] or 0, e[step]["stop"] or 0, e[step]["new"] or "")) for t, e in zip(trees, todo) if step < len(e)]
                    fresh, j = bpe.encode([u for _, p in plans for u in p[0]])[1].tolist(), 0
                    for t, p in plans:
                        t.encoded_chars += sum(map(len, p[0]))
                        t.apply(p, fresh[j : j + len(p[0])])
                        j += len(p[0])
                texts = [t.text for t in trees]
                out = [(b, t.total, len(x), hashlib.sha256(x.encode()).hexdigest(), t.encoded_chars) for b, t, x in zip(before, trees, texts)]
                at += len(body)
                columns = list(zip(*out)) if out else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=[key, "n_tokens", "edited_n_tokens", "edited_chars", "edited_sha256", "reencoded_chars"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text, edits).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, edited_n_tokens bigint, edited_chars bigint, edited_sha256 string, reencoded_chars bigint")


def sample_edits(text: str = "text") -> Column:
    """Three edits of a text made from itself: a phrase put in at a quarter, 40 characters cut at the middle, the last 10 replaced by the first 25."""
    n = F.char_length(F.coalesce(F.col(text), F.lit("")))
    one = lambda a, b, new: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), new.alias("new"))
    mid = F.floor(n / 2)
    end = n + 14 - F.least(F.lit(40), n + 14 - mid)
    return F.array(
        one(F.floor(n / 4), F.floor(n / 4), F.lit(" [see note 3] ")), one(mid, mid + 40, F.lit("")), one(F.greatest(end - 10, F.lit(0)), end, F.substr(F.coalesce(F.col(text), F.lit("")), F.lit(1), F.lit(25)))
    )
