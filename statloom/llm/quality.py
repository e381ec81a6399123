"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad; its score comes from its own and its neighbours' features, and adjacent lines' labels
influence each other. Labels exist for whole documents only: a good document has good lines throughout, a bad one has at least one bad line, so
training raises P(all lines good) for the one and lowers it for the other; both follow exactly from the forward recursion. A document's score is
the length-weighted mean of its lines' forward-backward marginals, put on the scale of a probability by a logistic fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.shingles import joined, mix, word_spans
from statloom.llm.tokens import text_blocks

#: Labelled documents to learn from at most, chosen by the hash of their ids.
TRAIN_DOCS = 4000
STEPS, RATE, PENALTY = 160, 0.08, 1e-4
_GROUPS = [range(65, 91), range(48, 58), b" \t", b"!", b"|", b"#$%&*@^~<>{}[]=+_\\/", b".,;:?", b"\"'()-", range(128, 192), b"aeiouAEIOU"]
_TABLES = np.zeros((len(_GROUPS), 256), np.uint8)
for _i, _g in enumerate(_GROUPS):
    _TABLES[_i, list(_g)] = 1


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text (lines x features), lines before each text, and line lengths in bytes plus 1.

    Per line: length, shares of capitals, digits, blanks and several groups of signs, words and their mean and longest length, share of
    words equal to the word before, share of word pairs met earlier in the text, first letter a capital, end of sentence at the end. Then the mean
    of the same features over the line before and the line after, and whether either is missing.
    """
    data, begin = joined(texts)
    stop = np.flatnonzero(data == 10)
    start = np.r_[0, stop[:-1] + 1]
    before = np.searchsorted(start, begin)
    size = (stop - start).astype(np.float32)
    safe = np.maximum(size, 1)
    shares = [np.add.reduceat(t[data], start, dtype=np.int32) / safe for t in _TABLES]
    word, at, end = word_spans(data)
    line = np.searchsorted(start, at, side="right") - 1
    many = np.bincount(line, minlength=len(start)).astype(np.float32)
    some = np.maximum(many, 1)
    longest = np.zeros(len(start), np.float32)
    np.maximum.at(longest, line, (end - at).astype(np.float32))
    text = np.searchsorted(begin, at, side="right") - 1
    same = np.r_[False, (word[1:] == word[:-1]) & (line[1:] == line[:-1])][: len(word)]
    pair = mix(word + np.roll(word, 1) * np.uint64(3) + mix(text.astype(np.uint64)))
    order = np.argsort(pair, kind="stable")
    met = np.zeros(len(word), bool)
    met[order[1:]] = pair[order][1:] == pair[order][:-1]
    count = lambda mask: np.bincount(line[mask], minlength=len(start)) / some
    first, last = data[np.minimum(start, len(data) - 1)], data[np.maximum(stop - 1, 0)]
    x = np.stack(
        [np.log1p(size), *shares, np.log1p(many), size / some, np.log1p(longest), count(same), count(met), (first >= 65) & (first < 91) | (first >= 192), np.isin(last, list(b".!?")) & (size > 0)], axis=1, dtype=np.float32, casting="unsafe"
    )
    edge = np.zeros(len(start), bool)
    edge[before[:-1][np.diff(before) > 0]] = True
    final = np.r_[edge[1:], True][: len(edge)]
    up = np.where(edge[:, None], 0, np.roll(x, 1, axis=0))
    down = np.where(final[:, None], 0, np.roll(x, -1, axis=0))
    around = (up + down) / np.maximum(2 - edge.astype(np.float32) - final, 1)[:, None]
    return np.concatenate([x, around, edge[:, None], final[:, None]], axis=1, dtype=np.float32), before, size + 1


class Chains:
    """Forward and backward recursions over many documents' lines at once, longest documents first."""

    def __init__(self, before: np.ndarray):
        self.count = np.diff(before)
        self.order = np.argsort(-self.count, kind="stable")
        self.start = before[:-1][self.order]
        longest = int(self.count.max()) if len(self.count) else 0
        self.live = np.searchsorted(-self.count[self.order], -np.arange(longest), side="left")

    def run(self, unary: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For scores of 'good' (that of 'bad' is 0) and trans[from, to]: ln Z per document, P(good) per line, expected transitions (bad, good) x (bad, good)."""
        good, bad = np.zeros(len(unary)), np.zeros(len(unary))
        for t, k in enumerate(self.live):
            i = self.start[:k] + t
            if t:
                g, b = good[i - 1], bad[i - 1]
                good[i] = unary[i] + np.logaddexp(b + trans[0, 1], g + trans[1, 1])
                bad[i] = np.logaddexp(b + trans[0, 0], g + trans[1, 0])
            else:
                good[i] = unary[i]
        z = np.zeros(len(self.count))
        z[self.order] = np.logaddexp(*[a[self.start + self.count[self.order] - 1] for a in (good, bad)])
        after_good, after_bad = np.zeros(len(unary)), np.zeros(len(unary))
        expected = np.zeros((2, 2))
        total = np.zeros(len(unary))
        total[self._lines()] = np.repeat(z[self.order], self.count[self.order])
        for t in range(len(self.live) - 1, 0, -1):
            i = self.start[: self.live[t]] + t
            g, b = unary[i] + after_good[i], after_bad[i]
            after_good[i - 1] = np.logaddexp(b + trans[1, 0], g + trans[1, 1])
            after_bad[i - 1] = np.logaddexp(b + trans[0, 0], g + trans[0, 1])
        return z, np.exp(np.clip(good + after_good - total, -700, 0)), (good, bad, after_good, after_bad, total, expected)

    def _lines(self) -> np.ndarray:
        n = self.count[self.order]
        return np.repeat(self.start - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def transitions(self, unary: np.ndarray, trans: np.ndarray, state: tuple, weight: np.ndarray) -> np.ndarray:
        """Sum over documents, each with its weight, of the expected number of each transition."""
        good, bad, after_good, after_bad, total, _ = state
        w = np.zeros(len(unary))
        w[self._lines()] = np.repeat(weight[self.order], self.count[self.order])
        later = np.ones(len(unary), bool)
        later[self.start] = False
        i = np.flatnonzero(later)
        out = np.empty((2, 2))
        for a, left in enumerate((bad, good)):
            for b, right in enumerate((after_bad, unary + after_good)):
                out[a, b] = (w[i] * np.exp(np.clip(left[i - 1] + trans[a, b] + right[i] - total[i], -700, 0))).sum()
        return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.concatenate([z, z * z / 4, np.ones((len(z), 1), z.dtype)], axis=1)

    def marginals(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        return Chains(before).run((self.expand(x) @ self.weight).astype(np.float64), self.trans)[1]

    def scores(self, marginal: np.ndarray, before: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each document, as a calibrated probability."""
        some = np.add.reduceat(size, before[:-1])
        mean = np.clip(np.add.reduceat(marginal * size, before[:-1]) / some, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(mean / (1 - mean)) + self.shift)))


def fit(x: np.ndarray, before: np.ndarray, size: np.ndarray, good: np.ndarray, steps: int = STEPS) -> QualityModel:
    """Train on documents' lines (see line_features; each document has at least one) and labels, by Adam on the exact gradient."""
    if not len(good):
        f = 2 * max(x.shape[1], 1) + 1
        return QualityModel(np.zeros(x.shape[1], np.float32), np.ones(x.shape[1], np.float32), np.zeros(f), np.zeros((2, 2)))
    model = QualityModel(x.mean(0), x.std(0) + 1e-3, np.zeros(2 * x.shape[1] + 1), np.zeros((2, 2)))
    z = model.expand(x).astype(np.float64)
    chains, count = Chains(before), np.diff(before)
    total, steps_in = z.cumsum(0), count - 1
    total = np.r_[np.zeros((1, z.shape[1])), total]
    all_good = total[before[1:]] - total[before[:-1]]
    share = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1))
    m, v, m2, v2 = 0.0, 0.0, 0.0, 0.0
    for step in range(1, steps + 1):
        unary = z @ model.weight
        ln_z, p, state = chains.run(unary, model.trans)
        ln_all = np.minimum(all_good @ model.weight + steps_in * model.trans[1, 1] - ln_z, -1e-9)
        pull = share * np.where(good, 1.0, -np.exp(ln_all) / -np.expm1(ln_all))  # d objective / d ln P(all good)
        line = np.zeros(len(unary))
        line[:] = np.repeat(pull, count) * p
        grad = pull @ all_good - line @ z - PENALTY * model.weight
        grad_t = -chains.transitions(unary, model.trans, state, pull)
        grad_t[1, 1] += pull @ steps_in
        grad_t -= PENALTY * model.trans
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        m2, v2 = 0.9 * m2 + 0.1 * grad_t, 0.99 * v2 + 0.01 * grad_t**2
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        model.weight = model.weight + RATE * fix * m / (np.sqrt(v) + 1e-9)
        model.trans = model.trans + RATE * fix * m2 / (np.sqrt(v2) + 1e-9)
    mean = model.scores(chains.run(z @ model.weight, model.trans)[1], before, size)
    logit, y = np.log(mean / (1 - mean)), good.astype(float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic fit
        q = 1 / (1 + np.exp(-(a * logit + b)))
        h = np.maximum(q * (1 - q), 1e-9)
        g = np.array([((y - q) * logit).sum() - 0.01 * (a - 1), (y - q).sum() - 0.01 * b])
        hess = np.array([[(h * logit * logit).sum() + 0.01, (h * logit).sum()], [(h * logit).sum(), h.sum() + 0.01]])
        a, b = np.array([a, b]) + np.linalg.solve(hess, g)
    model.slope, model.shift = float(max(a, 1e-3)), float(b)
    return model


def held_out(key: str, modulus: int, rest: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", train_docs: int = TRAIN_DOCS, fold: tuple[int, int] = (5, 0)) -> QualityModel:
    """Learn from at most ``train_docs`` labelled rows outside the held-out fold crc32(key) mod fold[0] = fold[1], taken by hash; only their line features reach the driver."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key, *fold)).select(key, F.col(label).cast("int").alias("good"))
    chosen = marked.orderBy(F.xxhash64(key), key).limit(train_docs)
    rows = docs.select(key, text).join(F.broadcast(chosen), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, body in text_blocks(batch.column(0), batch.column(1)):
                x, before, size = line_features(body)
                cut = [(a, b) for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(body)), batch.column(2).slice(at, len(body)), pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([size[a:b].tobytes() for a, b in cut], pa.binary())], names=["key", "good", "x", "size"])
                at += len(body)

    got = rows.select(key, text, "good").mapInArrow(run, f"key {dict(docs.dtypes)[key]}, good int, x binary, size binary").collect()
    got.sort(key=lambda r: (r.key, r.good, r.x))
    size = [np.frombuffer(r.size, np.float32) for r in got]
    width = line_features([""])[0].shape[1]
    x = np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(-1, width)
    return fit(x, np.r_[0, np.cumsum([len(s) for s in size], dtype=np.int64)].astype(np.int64), np.concatenate([np.zeros(0, np.float32), *size]), np.array([r.good == 1 for r in got], bool))


def score_documents(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, score, n_lines, bad_lines): score 0..1, higher for better documents, and the numbers of lines more likely bad.

    A null text counts as empty; an empty text is one empty line and is scored as such; repeated rows stay; an empty
    table gives no rows; other columns are not carried. Equal texts get equal scores. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, body in text_blocks(batch.column(0), batch.column(1)):
                if not body:
                    continue
                x, before, size = line_features(body)
                p = model.marginals(x, before)
                bad = np.flatnonzero(p < 0.5)
                ends = np.searchsorted(bad, before)
                number = bad - np.repeat(before[:-1], np.diff(ends))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(number.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(model.scores(p, before, size)), pa.array(np.diff(before)), lists], names=[key, "score", "n_lines", "bad_lines"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, score double, n_lines bigint, bad_lines array<int>")


def keep_documents(docs: DataFrame, model: QualityModel, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores at least ``least``; a null text is scored as an empty one. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, i = batch.schema.get_field_index(text), 0
            for _, body in text_blocks(batch.column(at), batch.column(at)):
                x, before, size = line_features(body)
                yield batch.slice(i, len(body)).filter(pa.array(model.scores(model.marginals(x, before), before, size) >= least))
                i += len(body)

    return docs.mapInArrow(run, docs.schema)
