"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes are cut into windows; within each, one network reads forwards and one backwards, and every position gets
language probabilities from both states. A document's probability of a language is the mean over all its positions. Training is
backpropagation through time in numpy, on windows of a bounded sample of documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.quality import held_out
from statloom.llm.tokens import text_blocks

HIDDEN, WINDOW = 8, 64
#: Windows read at once; documents to learn from for each language, and windows of each; training steps, windows in each.
PARALLEL = 4096
SAMPLE_DOCS, SAMPLE_WINDOWS = 1200, 2
STEPS, BATCH, RATE = 220, 256, 0.02
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_READ = np.arange(256, dtype=np.uint8)  # A-Z are read as a-z
_READ[65:91] += 32


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Direction:
    """One direction's weights: gates' inputs per byte (256 x 3h: update, reset, candidate) and from the state (h x 3h)."""

    byte: np.ndarray
    state: np.ndarray

    def read(self, steps: np.ndarray, keep: bool = False):
        """States after each step, for bytes (steps x windows); with ``keep`` also what backpropagation needs."""
        h = self.state.shape[0]
        s = np.zeros((steps.shape[1], h), np.float32)
        out = np.empty((*steps.shape, h), np.float32)
        kept = []
        for t, b in enumerate(steps):
            x = self.byte[b]
            gate = sigmoid(np.clip(x[:, : 2 * h] + s @ self.state[:, : 2 * h], -30, 30))
            z, r = gate[:, :h], gate[:, h:]
            rs = r * s
            n = sigmoid(np.clip(2 * (x[:, 2 * h :] + rs @ self.state[:, 2 * h :]), -30, 30))
            n *= 2
            n -= 1
            if keep:
                kept.append((s, z, r, rs, n))
            s = s + z * (n - s)
            out[t] = s
        return (out, kept) if keep else out

    def learn(self, steps: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the weights from those of the states, last step first."""
        h = self.state.shape[0]
        g_byte, g_state = np.zeros_like(self.byte), np.zeros_like(self.state)
        d_all = np.empty((*steps.shape, 3 * h), np.float32)
        d_s = np.zeros((steps.shape[1], h), np.float32)
        for t in range(len(steps) - 1, -1, -1):
            s, z, r, rs, n = kept[t]
            d_s = d_s + d_out[t]
            d_n = d_s * z * (1 - n * n)
            d_z = d_s * (n - s) * z * (1 - z)
            d_rs = d_n @ self.state[:, 2 * h :].T
            d_r = d_rs * s * r * (1 - r)
            d_gate = np.concatenate([d_z, d_r], axis=1)
            g_state[:, : 2 * h] += s.T @ d_gate
            g_state[:, 2 * h :] += rs.T @ d_n
            d_s = d_s * (1 - z) + d_rs * r + d_gate @ self.state[:, : 2 * h].T
            d_all[t, :, : 2 * h], d_all[t, :, 2 * h :] = d_gate, d_n
        flat, rows = steps.ravel(), d_all.reshape(-1, 3 * h)
        order = np.argsort(flat, kind="stable")
        seen, first = np.unique(flat[order], return_index=True)
        g_byte[seen] = np.add.reduceat(rows[order], first, axis=0)
        return g_byte, g_state


@dataclass
class LanguageModel:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray
    bias: np.ndarray

    def positions(self, steps: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Language probabilities of every position (steps x windows x languages), zero where ``mask`` is false."""
        h = self.out.shape[0] // 2
        logit = self.forward.read(steps) @ self.out[:h]
        logit += self.backward.read(steps[::-1])[::-1] @ self.out[h:]
        logit += self.bias
        logit -= logit.max(axis=2, keepdims=True)
        np.exp(logit, out=logit)
        logit *= (mask / logit.sum(axis=2))[:, :, None]
        return logit

    def documents(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities of each text (texts x languages); zeros for an empty text."""
        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        windows = -(-size // WINDOW)
        owner = np.repeat(np.arange(len(raw)), windows)
        data = np.r_[_READ[np.frombuffer(b"".join(raw), np.uint8)], np.zeros(WINDOW, np.uint8)]
        first = np.repeat(np.cumsum(size) - size, windows) + (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
        length = np.minimum(np.repeat(np.cumsum(size), windows) - first, WINDOW)
        total = np.zeros((len(owner), len(self.languages)))
        step = np.arange(WINDOW)[:, None]
        for i in range(0, len(owner), PARALLEL):
            mask = step < length[i : i + PARALLEL]
            total[i : i + PARALLEL] = self.positions(np.where(mask, data[first[i : i + PARALLEL] + step], 0), mask.astype(np.float32)).sum(axis=0)
        sums = np.zeros((len(raw), len(self.languages)))
        if len(owner):
            full = np.flatnonzero(windows)
            sums[full] = np.add.reduceat(total, (np.cumsum(windows) - windows)[full], axis=0)
        return sums / np.maximum(size, 1)[:, None]


def fit(windows: list[bytes], language: list[str], steps: int = STEPS, seed: int = 7) -> LanguageModel:
    """Train on windows of at most WINDOW bytes and their languages, each language weighted alike."""
    names = sorted(set(language)) or [UNKNOWN]
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    directions = [Direction(draw(256, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN)) for _ in range(2)]
    model = LanguageModel(names, *directions, draw(2 * HIDDEN, len(names)), np.zeros(len(names), np.float32))
    if len(names) < 2:
        return model
    y = np.array([names.index(x) for x in language])
    size = np.array([len(w) for w in windows])
    data = np.zeros((len(windows), WINDOW), np.uint8)
    for i, w in enumerate(windows):
        data[i, : len(w)] = np.frombuffer(w[:WINDOW], np.uint8)
    data = _READ[data]
    chance = (1 / np.bincount(y, minlength=len(names)))[y]
    chance /= chance.sum()
    weights = [model.forward.byte, model.forward.state, model.backward.byte, model.backward.state, model.out, model.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        pick = rng.choice(len(windows), BATCH, p=chance)
        x, mask = data[pick].T, (np.arange(WINDOW)[:, None] < size[pick]).astype(np.float32)
        back = x[::-1]
        hf, kept_f = model.forward.read(x, True)
        hb, kept_b = model.backward.read(back, True)
        both = np.concatenate([hf, hb[::-1]], axis=2)
        logit = both @ model.out + model.bias
        logit -= logit.max(axis=2, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(BATCH), y[pick]] -= 1
        p *= (mask / mask.sum())[:, :, None]
        d_both = p @ model.out.T
        f_byte, f_state = model.forward.learn(x, kept_f, d_both[:, :, :HIDDEN])
        b_byte, b_state = model.backward.learn(back, kept_b, d_both[::-1, :, HIDDEN:])
        grads = [f_byte, f_state, b_byte, b_state, both.reshape(-1, 2 * HIDDEN).T @ p.reshape(-1, len(names)), p.sum(axis=(0, 1))]
        rate = RATE * min(1.0, 2.5 * (1 - step / (steps + 1))) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * m / (np.sqrt(v) + 1e-8)
    return model


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", sample_docs: int = SAMPLE_DOCS, fold: tuple[int, int] = (4, 2)) -> LanguageModel:
    """Learn from about ``sample_docs`` documents of each language outside the fold crc32(key) mod fold[0] = fold[1], taken by the hash of their keys; SAMPLE_WINDOWS windows of each, at places given by the hash."""
    usable = docs.where(F.col(language).isNotNull() & F.col(text).rlike(r"\p{L}") & ~held_out(key, *fold) & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(language).count().collect()}
    if not counts:
        return fit([], [])
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(2**40)) / float(2**40)
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_docs / n))])
    some = usable.where(draw < rate[F.col(language)])
    n = F.char_length(text)
    place = lambda i: (F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.greatest(n - WINDOW + 1, F.lit(1))) + 1).cast("int")
    rows = some.select(F.col(language).alias("language"), F.col(key).alias("key"), *[F.substring(text, place(i), F.lit(WINDOW)).alias(f"w{i}") for i in range(SAMPLE_WINDOWS)]).collect()
    got = sorted({(r.key, r[f"w{i}"], r.language) for r in rows for i in range(SAMPLE_WINDOWS)})
    return fit([w.encode()[:WINDOW] for _, w, _ in got], [x for _, _, x in got])


def decide(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    p = model.documents(texts)
    best = p.argmax(axis=1)
    known = np.array([_LETTER.search(t) is not None and model.languages != [UNKNOWN] for t in texts], bool)
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known)], np.where(known, np.clip(p[np.arange(len(texts)), best], 0, 1), 0.0)


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, lang_pred, score): the likeliest language of the whole text and its mean probability.

    A null text, or one without a letter, is UNKNOWN with score 0; so is every text if no language was learned. Repeated rows
    stay; an empty table gives no rows; other columns are not carried. Ties go to the first language by name. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, body in text_blocks(batch.column(0), batch.column(1)):
                names, score = decide(model, body)
                yield pa.RecordBatch.from_arrays([keys, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, lang_pred string, score double")


def keep_documents(docs: DataFrame, model: LanguageModel, least: float = 0.4, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a language with a score of at least ``least``; null and letterless texts go. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, i = batch.schema.get_field_index(text), 0
            for _, body in text_blocks(batch.column(at), batch.column(at)):
                names, score = decide(model, body)
                yield batch.slice(i, len(body)).filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, score.tolist())], pa.bool_()))
                i += len(body)

    return docs.mapInArrow(run, docs.schema)
