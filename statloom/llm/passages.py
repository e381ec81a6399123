"""Near-duplicate passages through compact windows.

A passage's tokens are its 5-word shingles. Under a hash of the tokens, the compact window (l, c, r) stands for all passages within l..r
that contain position c: c has their least hash. The windows wide enough to hold a passage of the least length are the
nodes of the Cartesian tree over the hashes whose span is that wide; their roots are the least positions of some
window of that length, so the tree is built over these positions alone. Windows of two texts with one least hash group passages
that share this signature. Each window meets the first window of its group; windows of one pair of texts are joined by
overlap across the hash functions, and stretches that enough functions share are compared shingle by shingle.
Windows that the first of their group leaves without a word-for-word repeat are grouped again by all their shingles, and by signatures of several
least hashes at once, which separate what shares only a frequent shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import discard, small_batches, written
from statloom.llm.shingles import joined, mix, shingles, word_starts
from statloom.llm.tokens import text_blocks

SHINGLE, MIN_WORDS, SIMILARITY = 5, 50, 0.8
#: Hash functions, and how many of them must group two stretches before they are compared.
HASHES, HASHES_NEEDED = 4, 1
#: Signatures by which windows that meet nothing near meet again, and the least hashes that make one.
BANDS, BAND_HASHES = 8, 4
#: Texts that are cut at once.
TEXTS = 256


def compact_windows(value: np.ndarray, ends: np.ndarray, least: int, function: int) -> tuple[np.ndarray, ...]:
    """Compact windows of at least ``least`` tokens under one hash function, for texts' token hashes one after the other.

    Arrays: text number, hash at c, and l, c, r as positions in the text.
    """
    n = len(value)
    none = (np.zeros(0, np.int64),) * 5
    size = np.diff(ends)
    if n < least or not (size >= least).any():
        return none
    h = mix(value ^ mix(np.array([function + 1], np.uint64))[0])
    low = np.uint64((1 << max(23, n.bit_length())) - 1)
    m = (h & ~low) | np.arange(n, dtype=np.uint64)  # ties go to the first position
    width = 1
    while 2 * width <= least:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < least:
        m = np.minimum(m[: n - least + 1], m[least - width : n - width + 1])
    inside = np.ones(n + least, bool)
    for end in ends[1:].tolist():
        inside[max(end - least + 1, 0) : end] = False
    c = (m[inside[: len(m)]] & low).astype(np.int64)
    c = c[np.r_[True, c[1:] != c[:-1]]]
    owner = np.searchsorted(ends, c, side="right") - 1
    rank = h[c] & ~low
    before, after = _smaller(rank, owner)
    left = np.where(before >= 0, c[before] + 1, ends[owner])
    right = np.where(after >= 0, c[after] - 1, ends[owner + 1] - 1)
    base = ends[owner]
    return owner, h[c], left - base, c - base, right - base


def _smaller(rank: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the last one before it whose rank is no greater, and the first one behind it whose rank is smaller, of the same owner; else -1.

    These are the turns of the Cartesian tree. All places skip greater ranks at once: what a neighbour has skipped, its neighbour skips too.
    """
    n = len(rank)
    near = np.flatnonzero(owner[1:] == owner[:-1])
    before, after = np.full(n, -1), np.full(n, -1)
    before[near + 1], after[near] = near, near + 1
    for to, wrong in ((before, np.greater), (after, np.greater_equal)):
        open_ = np.flatnonzero(to >= 0)
        while len(open_):
            seen = to[open_]
            skip = wrong(rank[seen], rank[open_])
            open_, seen = open_[skip], seen[skip]
            to[open_] = to[seen]
            open_ = open_[to[open_] >= 0]
    return before, after


def window_rows(docs: DataFrame, key: str, text: str, shingle: int, least: int, hashes: int) -> DataFrame:
    """Rows (sig, doc, at, before, after): signature with the hash function in its low bits, position c, c - l and r - c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, body in text_blocks(batch.column(0), batch.column(1)):
                value, ends = shingles(body, shingle)
                ids = np.asarray(keys)
                for k in range(hashes):
                    owner, h, left, c, right = compact_windows(value, ends, least, k)
                    if len(owner):
                        sig = (mix(h + np.uint64(k)) & ~np.uint64(7)) | np.uint64(k)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sig.view(np.int64), ids[owner], c, c - left, right - c)], names=["sig", "doc", "at", "before", "after"])

    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), text).mapInArrow(run, "sig bigint, doc bigint, at bigint, before bigint, after bigint")


def window_hashes(value: np.ndarray, least: int) -> np.ndarray:
    """A hash of each run of ``least`` tokens, put together from runs of 1, 2, 4 ... tokens."""
    n = max(len(value) - least + 1, 0)
    out, part, at, width = np.zeros(n, np.uint64), value.view(np.uint64), 0, 1
    factor = np.uint64(0x9E3779B97F4A7C15)
    while n:
        if least & width:
            out = mix(out * factor + part[at : at + n])
            at += width
        if 2 * width > least:
            break
        part = mix(part[:-width] * factor + part[width:])
        width *= 2
    return out


def band_signatures(value: np.ndarray, least: int, bands: int = BANDS, depth: int = BAND_HASHES) -> Iterator[np.ndarray]:
    """For each band one hash a run of ``least`` tokens: of the run's least hashes under ``depth`` functions."""
    n = max(len(value) - least + 1, 0)
    value = mix(value.view(np.uint64))
    seeds = mix(np.arange(1, 2 * bands * depth + 1, dtype=np.uint64)).reshape(bands, depth, 2)
    for band in range(bands):
        out = np.zeros(n, np.uint64)
        for flip, factor in seeds[band] if n else ():
            m, width = (value ^ flip) * (factor | np.uint64(1)), 1
            while 2 * width <= least:
                m = np.minimum(m[:-width], m[width:])
                width *= 2
            if width < least:
                m = np.minimum(m[:n], m[least - width : n + least - width])
            out = out * np.uint64(0x9E3779B97F4A7C15) + m
        yield mix(out)


class Pairs:
    """Pairs of stretches (``g`` and ``s`` hold their shingles, one pair after the other), with equal shingles of a pair numbered alike.

    All positions are places in ``g`` and ``s`` as a whole; a number belongs to one pair.
    """

    def __init__(self, g: np.ndarray, g_ends: np.ndarray, s: np.ndarray, s_ends: np.ndarray) -> None:
        self.g_ends, self.s_ends, self.pairs, n = g_ends, s_ends, len(g_ends) - 1, len(g)
        self.of_g, self.of_s = (np.repeat(np.arange(self.pairs), np.diff(e)) for e in (g_ends, s_ends))
        of = np.r_[self.of_g, self.of_s]
        self.tagged = np.r_[g, s].view(np.uint64) ^ mix(of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(self.tagged, kind="stable")
        ranked = self.tagged[order]
        number = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
        numbers = int(number[-1]) + 1 if len(number) else 0
        every = np.empty(len(order), np.int64)
        every[order] = number
        self.number, other = every[:n], every[n:]
        of_g, of_s = order < n, order >= n
        self.before, self.earlier = _last_seen(order[of_g], number[of_g]), _last_seen(order[of_s] - n, number[of_s])
        self.count = np.bincount(other, minlength=numbers)
        self.low = np.cumsum(self.count) - self.count
        self.room = len(s) + 1
        self.places = np.r_[number[of_s] * self.room + (order[of_s] - n), np.iinfo(np.int64).max]  # no place is behind the last
        self.hit, self.hit_s = self.count[self.number] > 0, np.bincount(self.number, minlength=numbers)[other] > 0
        self.hits = np.r_[0, np.cumsum(self.hit)]
        self.once = np.bincount(self.of_g[self.before >= 0], minlength=self.pairs) + np.bincount(self.of_s[self.earlier >= 0], minlength=self.pairs) == 0

    def aligned(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``g`` whose shingle ``s`` has, and for each the place in ``s`` nearest to where the last shingle that ``s`` has once leads."""
        where = np.flatnonzero(self.hit)
        if not len(where):
            return where, where
        u, of = self.number[where], self.of_g[where]
        low, count = self.low[u], self.count[u]
        first = self.places[low] - u * self.room
        is_sure = count == 1
        head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        is_sure[head] |= np.bincount(of[is_sure], minlength=self.pairs)[of[head]] == 0
        sure = np.flatnonzero(is_sure)
        lead = np.searchsorted(sure, np.arange(len(where)), side="right") - 1
        lead = sure[np.maximum(lead, np.searchsorted(of[sure], of))]  # what comes before the first one is led by it
        guess = np.clip(first[lead] + where - where[lead], self.s_ends[of], self.s_ends[of + 1] - 1)
        up = np.clip(np.searchsorted(self.places, u * self.room + guess), low, low + count - 1)
        down = np.maximum(up - 1, low)
        up, down = self.places[up] - u * self.room, self.places[down] - u * self.room
        return where, np.where(np.abs(up - guess) <= np.abs(down - guess), up, down)

    def likeness(self, x: int, y: int, p: int, q: int) -> float:
        """Jaccard similarity of the sets of g[x:y] and s[p:q]."""
        fresh = self.before[x:y] < x
        u = self.number[x:y][fresh & self.hit[x:y]] * self.room
        common = int(np.count_nonzero(self.places[np.searchsorted(self.places, u + p)] - u < q))
        return common / (int(np.count_nonzero(fresh)) + int(np.count_nonzero(self.earlier[p:q] < p)) - common)

    def stretch(self, i: int, x: int, y: int, p: int, q: int, least: int, similarity: float) -> tuple[int, int, float] | None:
        """(x, y, similarity) of g[x:y] and s[p:q], moved out to ``least`` shingles at either end within pair ``i``, if they are similar enough."""
        short = max(least - (y - x), least - (q - p), 0)
        for left in sorted({0, short // 2, short}):
            x1, p1, y1, q1 = x - left, p - left, y + short - left, q + short - left
            if x1 >= self.g_ends[i] and p1 >= self.s_ends[i] and y1 <= self.g_ends[i + 1] and q1 <= self.s_ends[i + 1]:
                like = self.likeness(x1, y1, p1, q1)
                if like >= similarity:
                    return x1, y1, like
        return None


#: Pairs of so many aligned runs at most are looked through together.
RUNS_TOGETHER = 40


def near_stretches(pairs: Pairs, least: int, similarity: float) -> list[tuple[int, int, int, float]]:
    """Longest stretches (pair, first, last + 1 shingle, similarity) of ``g`` that are near-duplicates of stretches of their ``s``, both of at least ``least`` shingles.

    A stretch goes from the start of one aligned run of common shingles to the end of the same or a later one, whatever lies between; one
    that is too short takes in shingles at its ends. None lies in another.
    """
    where, place = pairs.aligned()
    enough = int(np.ceil(2 * least * similarity / (1 + similarity) - 1e-9))  # common shingles of two stretches without repeats
    if not len(where):
        return []
    of = pairs.of_g[where]
    step = np.flatnonzero((np.diff(where) != 1) | (np.diff(place) != 1) | (np.diff(of) != 0))
    begin, end = np.r_[0, step + 1], np.r_[step, len(where) - 1]
    x, y, p, q, of = where[begin], where[end] + 1, place[begin], place[end] + 1, of[begin]
    runs = np.searchsorted(of, np.arange(pairs.pairs + 1))
    left = pairs.hits[pairs.g_ends[of + 1]] - pairs.hits[x]  # common shingles from a run on
    size, out = np.diff(runs), []

    together = pairs.once & (size <= RUNS_TOGETHER)
    a = np.flatnonzero(together[of] & (left >= enough))
    later = runs[of[a] + 1] - a
    a = np.repeat(a, later)
    b = runs[of[a] + 1] - 1 - (np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later))  # of each run the last one first
    wide, other, common = y[b] - x[a], q[b] - p[a], pairs.hits[y[b]] - pairs.hits[x[a]]
    may = (common >= similarity * (wide + np.maximum(other, 1) - common)) | (wide < least) | (other < least)
    may &= (wide >= enough) & (other >= enough)
    a, b = a[may], b[may]
    done, reached = -1, 0
    for k, i, u, v, r, t in zip(*[c.tolist() for c in (a, of[a], x[a], y[b], p[a], q[b])]):
        if k != done and v > reached:
            found = pairs.stretch(i, u, v, r, t, least, similarity)
            if found:
                done = k
                if found[1] > reached:
                    out.append((i, *found))
                    reached = found[1]

    for i in np.flatnonzero(~together & (pairs.hits[pairs.g_ends[1:]] > pairs.hits[pairs.g_ends[:-1]])).tolist():
        first, last, once = runs[i], runs[i + 1], pairs.once[i]
        reached, most = pairs.g_ends[i], int(y[first:last].max())
        before, hit, earlier = pairs.before[: pairs.g_ends[i + 1]], pairs.hit[: pairs.g_ends[i + 1]], pairs.earlier[: pairs.s_ends[i + 1]]
        if most - x[first] < enough:
            continue
        for k in range(first, last):
            if reached == most or (once and left[k] < enough) or most - x[k] < enough:
                break
            wide, other = y[k:last] - x[k], q[k:last] - p[k]
            room = (wide >= enough) & (other >= enough) & (y[k:last] > reached)
            if not room.any():
                continue
            fresh = before[x[k] :] < x[k]
            mine = np.cumsum(fresh)[wide - 1]
            common = np.cumsum(fresh & hit[x[k] :])[wide - 1]
            theirs = np.cumsum(earlier[p[k] :] < p[k])[np.maximum(other, 1) - 1]
            may = room & ((common >= similarity * (mine + theirs - common)) | (wide < least) | (other < least))  # common counts all of s
            for v in (np.flatnonzero(may)[::-1] + k).tolist():
                found = pairs.stretch(i, int(x[k]), int(y[v]), int(p[k]), int(q[v]), least, similarity)
                if found:
                    if found[1] > reached:
                        out.append((i, *found))
                        reached = found[1]
                    break
    return [(i, u - int(pairs.g_ends[i]), v - int(pairs.g_ends[i]), like) for i, u, v, like in out]


def exact_stretches(pairs: Pairs, least: int) -> list[tuple[int, int, int]]:
    """Stretches (pair, first, last + 1 shingle) of ``g`` of which each window of ``least`` shingles is one of their ``s``."""

    def whole(hit: np.ndarray, of: np.ndarray) -> np.ndarray:
        n = max(len(hit) - least + 1, 0)
        so_far = np.r_[0, np.cumsum(hit)]
        return np.flatnonzero((so_far[least : least + n] - so_far[:n] == least) & (of[:n] == of[least - 1 : least - 1 + n]))

    mine, other = whole(pairs.hit, pairs.of_g), whole(pairs.hit_s, pairs.of_s)
    shared = np.zeros(pairs.pairs, bool)
    shared[pairs.of_s[other]] = True
    mine = mine[shared[pairs.of_g[mine]]]
    shared[:] = False
    shared[pairs.of_g[mine]] = True
    other = other[shared[pairs.of_s[other]]]
    if not len(mine):
        return []

    def hashes(value: np.ndarray, p: np.ndarray) -> np.ndarray:
        token = np.cumsum(np.bincount(p, minlength=len(value) + least) - np.bincount(p + least, minlength=len(value) + least))[: len(value)] > 0
        return window_hashes(value[token], least)[(np.cumsum(token) - 1)[p]]

    n = len(pairs.number)
    hit = mine[np.isin(hashes(pairs.tagged[:n], mine), hashes(pairs.tagged[n:], other))]
    if not len(hit):
        return []
    of = pairs.of_g[hit]
    step = np.flatnonzero((np.diff(hit) > 1) | (np.diff(of) != 0))
    begin, base = np.r_[0, step + 1], pairs.g_ends[of]
    end = np.r_[step, len(hit) - 1]
    return list(zip(of[begin].tolist(), (hit - base)[begin].tolist(), ((hit - base)[end] + least).tolist()))


def _last_seen(at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For each position the one before it of the same number, or -1; ``at`` lists the positions by number, ascending within one."""
    out = np.full(len(at), -1)
    same = np.flatnonzero(number[1:] == number[:-1])
    out[at[same + 1]] = at[same]
    return out


def shared_stretches(g: np.ndarray, s: np.ndarray, shingle: int, least: int, similarity: float) -> list[tuple[int, int, float]]:
    """``near_stretches`` (first, last + 1 shingle, similarity) of one pair."""
    return [found[1:] for found in near_stretches(Pairs(g, np.array([0, len(g)]), s, np.array([0, len(s)])), least, similarity)]


def _edges(word: np.ndarray, start: np.ndarray, words: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """First bytes of words of texts one after the other; where a text has no further word (``words``: of all texts up to it), its end."""
    return np.where(word < words, np.r_[start, 0][word], stop - 1)


def _covered(spans: pa.ListArray, ends: np.ndarray) -> np.ndarray:
    """Which positions of texts one after the other lie in one of their text's spans (low, high)."""
    row = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = spans.flatten()
    low, high = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("low", "high"))
    size = np.diff(ends)[row]
    first, last = (ends[row] + np.minimum(x, size) for x in (low, np.maximum(high + 1, low)))
    return np.cumsum(np.bincount(first, minlength=ends[-1] + 1) - np.bincount(last, minlength=ends[-1] + 1))[:-1] > 0


def unmatched_windows(body: DataFrame, members: DataFrame, spans: DataFrame, shingle: int, least: int) -> DataFrame:
    """Rows (band, window, doc, at, open) of the windows of ``least`` shingles that may meet again: band 0 has hashes of whole
    windows, the bands from 1 on have signatures, one row for a run of equal ones. ``open``: no passage that was found holds the window.

    body: (of, text). members: (doc, begins, bit), the first shingles of the windows whose least hash, under the function of ``bit``, put the row
    into a group of more than two; all but each group's lead row. spans: (doc, start_word, stop_word, exact), what was found so far.

    Windows that repeat a lead word for word are left out of all bands: the text they repeat stands for them. Others are in
    the bands from 1 on even where a passage holds them, as they may lead texts that nothing else is near.
    """
    words = least + shingle - 1
    todo = members.groupBy("doc").agg(F.collect_set(F.when(F.col("bit") == 1, F.col("begins"))).alias("begins"), F.collect_set("begins").alias("wider"))
    span = F.struct(F.col("start_word").alias("low"), (F.col("stop_word") - words).alias("high"))
    done = spans.groupBy("doc").agg(F.collect_set(F.when(F.col("exact"), span)).alias("done"), F.collect_set(span).alias("held"))
    asked = body.withColumnRenamed("of", "doc").join(todo.join(done, "doc", "left"), "doc").select("doc", "text", "begins", "wider", "done", "held")
    names = ["band", "window", "doc", "at", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, ends = shingles(batch.column(1).to_pylist(), shingle)
            if len(value) < least:
                continue
            begins, wider, done, held = (_covered(batch.column(j), ends) for j in range(2, 6))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            room = np.zeros(len(value), bool)
            room[: len(value) - least + 1] = row[: len(value) - least + 1] == row[least - 1 :]
            doc = batch.column(0).to_numpy()

            def rows(band: int, h: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
                columns = [np.full(len(p), band, np.int32), h.view(np.int64), doc[row[p]], p - ends[row[p]], ~held[p]]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

            p = np.flatnonzero(begins & room & ~done)
            if len(p):
                yield rows(0, window_hashes(value, least)[p], p)
            p = np.flatnonzero(wider & room & ~done)
            if not len(p):
                continue
            edge = np.bincount(p, minlength=len(value) + 1) - np.bincount(p + least, minlength=len(value) + 1)[: len(value) + 1]
            token = np.cumsum(edge)[:-1] > 0  # the tokens of these windows alone are hashed
            place = (np.cumsum(token) - 1)[p]
            apart = np.r_[True, (np.diff(p) != 1) | (row[p[1:]] != row[p[:-1]]) | (held[p[1:]] != held[p[:-1]])]
            for band, h in enumerate(band_signatures(value[token], least), 1):
                h = h[place]
                new = apart.copy()
                new[1:] |= h[1:] != h[:-1]
                yield rows(band, h[new], p[new])

    return asked.mapInArrow(run, "band int, window bigint, doc bigint, at bigint, open boolean")


def exact_again(left: DataFrame, shingle: int, least: int) -> DataFrame:
    """Word-for-word repeats among unmatched windows, rows as of the passages.

    Windows that are equal have one least hash, so they are in one group. If its lead row has the window, all others are
    found already; else the first text that has it is here, as it repeats nothing earlier, and so is each other.
    """
    words = least + shingle - 1
    left = left.where("band = 0").select("window", "doc", "at")
    first = left.groupBy("window").agg(F.min("doc").alias("source"), F.max("doc").alias("last")).where("source <> last").drop("last")
    met = left.join(first, "window").where("doc <> source").select("doc", "source", "at").distinct()
    met = met.withColumn("run", F.expr("at - row_number() over (partition by doc, source order by at)"))
    runs = met.groupBy("doc", "source", "run").agg(F.min("at").alias("start_word"), (F.max("at") + words).alias("stop_word"))
    return runs.select("doc", "start_word", "stop_word", "source", F.lit(1.0).alias("likeness"))


def near_again(left: DataFrame, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of stretches (doc, source, a, b, sa, sb, bit) of open windows and the first window that shares a band's signature, and the tables they are read from.

    A signature takes several hashes to agree, so windows that share only a frequent shingle are apart here. Groups and leads are
    written first, so that AQE can split a join that a large group makes uneven.
    """
    left = left.where("band > 0")
    groups = left.groupBy("band", "window").agg(F.min("doc").alias("source"), F.max("doc").alias("last"), F.bool_or("open").alias("any"))
    groups = written(groups.where("any and source <> last").drop("last", "any"), "groups")
    met = written(left.join(groups.hint("shuffle_hash"), ["band", "window"]).where("open or doc = source"), "met")
    leads = written(met.where("doc = source").groupBy("band", "window").agg(F.min("at").alias("sa")), "leads")
    discard(groups)
    pairs = met.where("open and doc <> source").join(leads.hint("shuffle_hash"), ["band", "window"])
    return pairs.selectExpr("doc", "source", "at as a", f"at + {least - 1} as b", "sa", f"sa + {least - 1} as sb", "1L as bit").distinct(), [met, leads]


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, shingle: int = SHINGLE, hashes: int = HASHES, needed: int = HASHES_NEEDED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages of at least ``min_words`` words that repeat, word for word or nearly, a passage of a row with a smaller key.

    Rows: key, start_word, stop_word (from 0, end excluded; words as in shingles.py), source (the smaller key), likeness (Jaccard of the
    passages' shingle sets). Passages that overlap are listed for each source. A text that equals one with a smaller key is one
    passage. Rows with a null key or text take no part; rows of one key are not compared with each other; empty and short texts
    have no passages; an empty table gives no rows; other columns are not carried. The key must be a whole number.

    Every window meets one other, the first of its group, so the pairs grow with the text and not with the square of a group.
    What that leaves unmatched meets again by hashes of whole windows (``exact_again``), so no word-for-word repeat is lost if
    ``needed`` is 1, and by signatures of several least hashes (``near_again``), so that near copies whose shingles are
    frequent elsewhere are found too, with a probability that the tests measure.
    Groups are found by an aggregation with map-side combine, joined back by an equi-join that AQE may split.
    """
    with small_batches(docs.sparkSession):
        found, tables = _repeated(docs, min_words, similarity, shingle, hashes, needed, key, text)
        passages = written(found, "passages")
        discard(*tables)
    return passages


def group_members(docs: DataFrame, key: str, text: str, shingle: int, least: int, hashes: int) -> DataFrame:
    """Rows (sig, doc, at, before, after, source, source_at, source_before, source_after, windows) of every window that another text
    has a window of equal signature to: with it the first window of its group and the number of windows there."""
    windows = window_rows(docs, key, text, shingle, least, hashes)
    groups = windows.groupBy("sig").agg(F.min("doc").alias("source"), F.max("doc").alias("last"), F.count("*").alias("windows")).where("source <> last").drop("last")
    groups = written(groups, "groups")
    met = written(windows.join(groups.hint("shuffle_hash"), "sig"), "met")
    leads = met.where("doc = source").groupBy("sig").agg(F.min(F.struct("at", "before", "after")).alias("lead"))
    leads = written(leads.select("sig", *[F.col(f"lead.{c}").alias(f"source_{c}") for c in ("at", "before", "after")]), "leads")
    members = written(met.join(leads.hint("shuffle_hash"), "sig").where("doc <> source or (sig & 7 = 0 and at <> source_at)"), "members")
    discard(groups, met, leads)
    return members


def compared(body: DataFrame, near: DataFrame, similarity: float, shingle: int, least: int, needed: int) -> DataFrame:
    """Passages that the pairs of stretches in ``near`` (doc, source, a, b, sa, sb, bit: first and last shingle in either text) hold, as a written table.

    Pairs of two texts that overlap are one stretch, which is compared if ``needed`` bits are among its pairs. kind: 0 near, 1 word for word, 2 word for
    word within one of kind 0.
    """
    order = "partition by doc, source order by a, b, sa, sb, bit"
    near = near.withColumn("new", F.expr(f"case when a > max(b) over ({order} rows between unbounded preceding and 1 preceding) then 1 else 0 end"))
    near = near.withColumn("stretch", F.expr(f"sum(new) over ({order} rows between unbounded preceding and current row)"))
    cand = near.groupBy("doc", "source", "stretch").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("sa").alias("sa"), F.max("sb").alias("sb"), F.bit_or("bit").alias("bits")).where(F.bit_count("bits") >= needed)
    cand = written(cand.selectExpr("doc", "source", "stretch", f"greatest(a - {least}, 0) as a", f"b + {least} as b", f"greatest(sa - {least}, 0) as sa", f"sb + {least} as sb"), "stretches")
    own = cand.select("doc", "source", "stretch", "a", F.col("doc").alias("of"), F.col("a").alias("start"), F.col("b").alias("stop"), F.lit(0).alias("side"))
    other = cand.select("doc", "source", "stretch", "a", F.col("source").alias("of"), F.col("sa").alias("start"), F.col("sb").alias("stop"), F.lit(1).alias("side"))
    asked = own.unionByName(other).join(body, "of").select("text", "doc", "source", "stretch", "a", "side", "start", "stop")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            own = [0, *accumulate(t != u for t, u in zip(texts[1:], texts))][: len(texts)]  # rows of one text follow each other
            data, begin = joined([t for i, t in enumerate(texts) if not i or own[i] != own[i - 1]])
            start, body = word_starts(data), data.tobytes()
            before = np.searchsorted(start, begin)
            own = np.array(own, np.int64)
            low, high = (_edges(before[own] + np.minimum(batch.column(j).to_numpy() + more, before[own + 1] - before[own]), start, before[own + 1], begin[own + 1]) for j, more in ((6, 0), (7, shingle)))
            found = [body[i:j].decode() for i, j in zip(low.tolist(), high.tolist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(j) for j in range(1, 6)], pa.array(found, pa.string())], names=["doc", "source", "stretch", "a", "side", "piece"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, source, first = (batch.column(j).to_pylist() for j in range(3))
            pairs = Pairs(*shingles(batch.column(3).to_pylist(), shingle), *shingles(batch.column(4).to_pylist(), shingle))
            near, inner = near_stretches(pairs, least, similarity), {}
            for i, x, y, _ in near:
                inner.setdefault(i, []).append((x, y))
            rows = [(i, x, y, like, 0) for i, x, y, like in near]
            rows += [(i, x, y, 1.0, 2 if any(u <= x and y <= v for u, v in inner.get(i, ())) else 1) for i, x, y in exact_stretches(pairs, least)]
            found = [(doc[i], first[i] + x, first[i] + y + shingle - 1, source[i], like, kind) for i, x, y, like, kind in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) if found else [()] * 6, [pa.int64()] * 4 + [pa.float64(), pa.int64()])], names=["doc", "start_word", "stop_word", "source", "likeness", "kind"])

    pieces = written(asked.mapInArrow(cut, "doc bigint, source bigint, stretch bigint, a bigint, side int, piece string"), "pieces")
    at = ["doc", "source", "stretch", "a"]
    both = pieces.where("side = 0").select(*at, F.col("piece").alias("g")).join(pieces.where("side = 1").select(*at, F.col("piece").alias("s")), at)
    spans = both.select("doc", "source", "a", "g", "s").mapInArrow(compare, "doc bigint, start_word bigint, stop_word bigint, source bigint, likeness double, kind bigint")
    spans = written(spans, "spans")
    discard(pieces, cand)
    return spans


def _repeated(docs: DataFrame, min_words: int, similarity: float, shingle: int, hashes: int, needed: int, key: str, text: str) -> tuple[DataFrame, list[DataFrame]]:
    """The passages, and the tables to discard when they are written."""
    least = min_words - shingle + 1
    same = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), F.octet_length(text).alias("n"))
    twins = written(same.groupBy("h1", "h2", "n").agg(F.min("doc").alias("source"), F.max("doc").alias("last")).where("source <> last").drop("last"), "texts")
    twins = written(same.join(twins, ["h1", "h2", "n"]).where("doc <> source").select("doc", "source").distinct(), "twins")
    every = group_members(docs, key, text, shingle, least, hashes)
    group = every.join(twins.select("doc"), "doc", "left_anti")
    near = group.withColumns({"low": F.least("before", "source_before"), "high": F.least("after", "source_after"), "bit": F.expr("1L << cast(sig & 7 as int)")})
    begins = F.struct(F.greatest(F.col("at") - F.col("before"), F.col("at") - (least - 1)).alias("low"), F.least(F.col("at") + F.col("after") - (least - 1), F.col("at")).alias("high"))
    members = near.where("windows > 2").select("doc", begins.alias("begins"), "bit")
    near = near.where("doc <> source").selectExpr("doc", "source", "at - low as a", "at + high as b", "source_at - low as sa", "source_at + high as sb", "bit")
    body = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("of"), F.col(text).alias("text"))
    first = compared(body, near, similarity, shingle, least, needed)
    left = written(unmatched_windows(body, members, first.selectExpr("doc", "start_word", "stop_word", "kind > 0 as exact"), shingle, least), "unmatched")
    again, tables = near_again(left, least)
    second = compared(body, again, similarity, shingle, least, 1)
    discard(*tables)
    spans = first.unionByName(second).where("kind < 2").drop("kind").unionByName(exact_again(left, shingle, least))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin = joined(batch.column(1).to_pylist())
            n = np.diff(np.searchsorted(word_starts(data), begin))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], names=["doc", "stop_word", "source"])

    copies = body.withColumnRenamed("of", "doc").join(twins, "doc").select("doc", "text", "source").mapInArrow(lengths, "doc bigint, stop_word bigint, source bigint").where(F.col("stop_word") >= min_words)
    whole = copies.select("doc", F.lit(0).cast("bigint").alias("start_word"), "stop_word", "source", F.lit(1.0).alias("likeness"))
    return spans.unionByName(whole).distinct().withColumnRenamed("doc", key), [twins, every, first, second, left]


def without_passages(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the words of each row's passages cut out of its text, and the white space behind them; all columns stay.

    A text is unchanged if its key has no passage; a null text stays null; a text may become empty.
    """
    cuts = passages.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_of")).agg(F.array_sort(F.collect_set(F.struct("start_word", "stop_word"))).alias("_cuts"))
    names = docs.columns
    rows = docs.join(cuts, docs[key].cast("bigint") == F.col("_of"), "left").drop("_of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            at, cut_at = batch.schema.get_field_index(text), batch.schema.get_field_index("_cuts")
            texts, cuts = batch.column(at).to_pylist(), batch.column(cut_at).to_pylist()
            for i, c in enumerate(cuts):
                if c and texts[i]:
                    data, _ = joined([texts[i]])
                    start = word_starts(data)
                    edge = np.r_[start, len(data) - 1]
                    keep = np.ones(len(data) - 1, bool)
                    for span in c:
                        a, b = (min(span[x], len(start)) for x in ("start_word", "stop_word"))
                        keep[edge[a] : edge[b]] = False
                    texts[i] = data[:-1][keep].tobytes().decode("utf-8", "replace")
            columns = [pa.array(texts, pa.string()) if j == at else batch.column(j) for j in range(batch.num_columns) if j != cut_at]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, docs.schema)
