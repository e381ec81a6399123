"""Exact n-gram Jaccard join as a blocked sparse matrix product.

Think of the 0/1 matrix of documents by n-grams; the overlaps of all pairs are its product with its transpose. Most of that product is
nothing, so the work goes in two steps.

1. Rows are brought into families such that each link lies in one. The columns are hashed into blocks, as many that a
   pair at the similarity threshold, whose sets differ in a bounded number of n-grams, must agree in a whole block:
   this size-derived bound joins documents that share a block's content, and nothing else has to be multiplied. N-grams that a sample shows
   to be common take no part in blocks, so that common lines and passages join nobody; sets with few others also give their first
   n-grams, the common ones last. Whichever n-grams count as common, no link is lost.
2. Families are cut into blocks of rows of bounded size, and a tile multiplies two blocks in numpy: it adds up overlap counts over blocks of
   columns and discards rows all of whose pairs have fallen below what their sizes ask. A tile gives the links of
   a spanning forest, never its pairs. Small families share tiles. In a large one every block is first multiplied by the family's first
   block, which links most near copies; then by the other blocks, but for those that lie in one component already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import components, discard, small_batches, written
from statloom.llm.shingles import mix, shingle_sets

#: Sets and n-grams of a block of rows: what a task holds at once. Their number only sets how many blocks there are.
BLOCK_SETS, BLOCK_GRAMS = 512, 500_000
#: Columns multiplied at once, and the sets up to which a column is added pair by pair instead.
BLOCK_COLUMNS, LIGHT = 2048, 16
#: Texts in the sample that tells common n-grams, and the share of them that have such a one.
SAMPLE, COMMON = 10_000, 0.001
#: Characters of the texts whose sets are made at once.
TEXT_CHARS = 300_000
NAME = "decimal(38,0)"


class Bounds:
    """Size classes and block numbers for Jaccard similarity >= num / den. Class i holds sizes low(i)..low(i + 1) - 1; a partner at least as large lies in class i or i + 1."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lows = [1]
        while self.lows[-1] < 2**40:
            self.lows.append(self.lows[-1] * den // num + 1)
        self.low = np.array(self.lows)

    def classes(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1

    def needed(self, a, b):
        """Least overlap of sets of sizes a and b at the threshold."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def needed_of(self, size: int) -> int:
        """Least overlap of a set of a size with any other one at the threshold."""
        return -(-self.num * size // self.den)

    @lru_cache(maxsize=None)  # noqa: B019
    def blocks(self, i: int) -> tuple[int, int, int]:
        """For class i: most n-grams in which a pair differs, column blocks, and how many of these may be empty in a document."""
        top = self.lows[i + 1] - 1
        differ = (top + top * self.den // self.num) * (self.den - self.num) // (self.num + self.den)
        empty = 0
        for _ in range(20):
            mean = (differ + 1 + empty) * exp(-self.lows[i] / (differ + 1 + empty))
            empty = ceil(mean + 2 * sqrt(mean))
        return differ, differ + 1 + empty, empty


def signatures(values: np.ndarray, i: int, bounds: Bounds, is_common: np.ndarray) -> np.ndarray:
    """Signatures of one set (ascending hashes) as a member of class i; ``is_common`` marks n-grams that are common in all sets that have them.

    A pair of the class at the threshold has a signature in common:
    - if it may differ in one n-gram, the whole set or the set without one n-gram;
    - else a column block of n-grams that are not common, with at least one in it. The pair's sets of these differ in no more n-grams than the whole ones;
      so if one of the two has as few empty blocks as are allowed for, one of its blocks is not touched. Two with more empty blocks
      both give their first n-grams, the common ones last and by hash otherwise, of which such a pair shares one.
    """
    differ, blocks, empty = bounds.blocks(i)
    tag = mix(np.array([i], np.uint64))[0]
    if differ == 0:
        return np.zeros(0, np.uint64)
    mixed = mix(values + tag)
    if differ == 1:
        total = mixed.sum(dtype=np.uint64)
        return mix(np.r_[total, total - mixed] ^ tag)
    rare = ~is_common
    block = (values[rare] % np.uint64(blocks)).astype(np.int64)
    sums = np.zeros(blocks, np.uint64)
    np.add.at(sums, block, mixed[rare])
    full = np.flatnonzero(np.bincount(block, minlength=blocks))
    sig = mix(sums[full] + mix(full.astype(np.uint64) + tag))
    if blocks - len(full) > empty:
        first = np.r_[values[rare], values[is_common]][: len(values) - bounds.needed_of(len(values)) + 1]
        sig = np.r_[sig, mix(mix(first) ^ ~tag)]
    return sig


def names_of(values: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """A 120-bit name of each set (null: empty), and its low 63 bits, by which sets are brought together."""
    raw, full = memoryview(values.tobytes()), np.diff(ends) > 0
    digest = b"".join(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=15).digest() + b"\0" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()))
    low = np.frombuffer(digest, "<i8")[::2] & np.int64(2**63 - 1)
    valid = pa.py_buffer(np.packbits(full, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(full), [valid, pa.py_buffer(digest)]), low


#: What tells a row of documents: its key, null or not, and two hashes of its text.
ROW = ["no_key", "row_key", "h1", "h2"]


def row_columns(key: str, text: str) -> list[Column]:
    return [F.col(key).isNull().alias("no_key"), F.coalesce(F.col(key), F.lit(0)).cast("bigint").alias("row_key"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2")]


def _over_texts(rows: DataFrame, n: int, text: str, schema: str, made) -> DataFrame:
    """``made(columns, values, ends)`` of each block of texts: the other columns, and the texts' sets one after the other."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, i = [t or "" for t in batch.column(at).to_pylist()], 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars + len(texts[j]) <= TEXT_CHARS):
                    chars += len(texts[j])
                    j += 1
                part = batch.slice(i, j - i)
                yield from made({c: part.column(c) for c in part.schema.names}, *shingle_sets(texts[i:j], n))
                i = j

    return rows.mapInArrow(run, schema)


def summaries(docs: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """Rows (key, n_shingles, name, near, ROW) of every document; equal sets have one name, ``near`` is its low bits."""

    def made(columns, values, ends):
        name, low = names_of(values, ends)
        yield pa.RecordBatch.from_arrays([columns[key], pa.array(np.diff(ends)), name, pa.array(low), *[columns[c] for c in ROW]], names=[key, "n_shingles", "name", "near", *ROW])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_shingles bigint, name {NAME}, near bigint, no_key boolean, row_key bigint, h1 bigint, h2 int"
    return _over_texts(docs.select(key, text, *row_columns(key, text)), n, text, schema, made)


def common_grams(docs: DataFrame, n: int, text: str, sample: int = SAMPLE, share: float = COMMON) -> np.ndarray:
    """N-grams (ascending) that at least ``share`` of about ``sample`` texts have, 10 texts at least: no more than the sets' mean size / share.

    The texts are taken by hash. Only speed depends on what is found.
    """
    total = docs.count()
    some = docs.where(F.pmod(F.xxhash64(F.col(text), F.lit("sample")), F.lit(max(1, total // sample))) == 0)

    def made(columns, values, ends):
        for a in range(0, len(values), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(values[a : a + 100_000].view(np.int64))], names=["gram"])

    rows = _over_texts(some.select(text), n, text, "gram bigint", made).groupBy("gram").count().where(F.col("count") >= max(10, int(share * min(total, sample)))).select("gram").collect()
    return np.sort(np.array([r.gram for r in rows], np.int64).view(np.uint64))


def signature_rows(docs: DataFrame, n: int, bounds: Bounds, text: str, common: np.ndarray) -> DataFrame:
    """Rows (sig, near): signatures of every document's set, for its own class and the one before."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def made(columns, values, ends):
        low, size = names_of(values, ends)[1], np.diff(ends)
        known = sent.value
        is_common = known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)
        sigs, nears = [], []
        for d in np.flatnonzero(size).tolist():
            v, hot, i = values[ends[d] : ends[d + 1]], is_common[ends[d] : ends[d + 1]], int(bounds.classes(size[d]))
            for c in range(max(i - 1, 0), i + 1):
                sigs.append(signatures(v, c, bounds, hot))
                nears.append(np.full(len(sigs[-1]), low[d]))
        if sigs:
            sig, near = np.concatenate(sigs).view(np.int64), np.concatenate(nears)
            for a in range(0, len(sig), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(sig[a : a + 100_000]), pa.array(near[a : a + 100_000])], names=["sig", "near"])

    return _over_texts(docs.select(text), n, text, "sig bigint, near bigint", made)


def set_rows(docs: DataFrame, chosen: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """Rows (name, n, grams, further columns of ``chosen``): the sets of chosen rows (name, ROW), from one text each.

    The texts are shuffled once, to meet the chosen rows; repeated rows go after that. A text that the hashes of ROW do not tell from the chosen one is left out by its set's name.
    """
    both = docs.select(*row_columns(key, text), F.col(text).alias("text")).join(chosen, ROW)
    carried = [c for c in both.columns if c not in (*ROW, "name")]
    rows = both.groupBy(*ROW, "name").agg(*[F.first(c).alias(c) for c in carried]).drop(*ROW)
    others = [c for c in rows.columns if c not in ("text", "name")]

    def made(columns, values, ends):
        name, size = names_of(values, ends)[0], np.diff(ends)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))
        batch = pa.RecordBatch.from_arrays([name, pa.array(size), lists, *[columns[c] for c in others]], names=["name", "n", "grams", *others])
        yield batch.filter(pc.fill_null(pc.equal(name, columns["name"]), False))

    kinds = dict(rows.dtypes)
    return _over_texts(rows, n, "text", f"name {NAME}, n bigint, grams array<bigint>, " + ", ".join(f"{c} {kinds[c]}" for c in others), made)


def overlap_links(size: np.ndarray, values: np.ndarray, bounds: Bounds) -> np.ndarray:
    """For each of some sets (sizes, n-grams one after the other) the first set of its component under the links between them.

    Overlaps are added up over columns, those of few sets first. A set that can reach the threshold with no other one by
    what it and the others have left is discarded on the way.
    """
    num, den = bounds.num, bounds.den
    _, column, held = np.unique(values, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(size)), size)
    shared = held[column] > 1
    while True:  # what is shared with others must be enough by the set's own size
        own = np.bincount(row[shared], minlength=len(size))
        alive = own * den >= num * size
        now = shared & alive[row]
        now[now] = np.bincount(column[now], minlength=len(held))[column[now]] > 1
        if np.array_equal(now, shared):
            break
        shared = now
    label = np.arange(len(size))
    where = np.flatnonzero(alive & (own > 0))
    if len(where) < 2:
        return label
    row, column = np.searchsorted(where, row[shared]), column[shared]
    order = np.lexsort((row, np.bincount(column, minlength=len(held))[column] * np.int64(len(held)) + column))
    row, column = row[order], column[order]
    n, left, need = len(where), own[where], size[where]
    need = -(-num * (need[:, None] + need[None, :]) // (num + den))
    np.fill_diagonal(need, np.iinfo(np.int64).max)
    start = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
    held = np.diff(np.r_[start, len(column)])
    light = int(start[np.searchsorted(held, LIGHT, side="right")]) if held[-1] > LIGHT else len(column)
    counts = np.zeros((n, n), np.int64)
    for step in range(1, LIGHT):
        same = np.flatnonzero(column[step:light] == column[: max(light - step, 0)])
        counts += np.bincount(row[same] * n + row[same + step], minlength=n * n).reshape(n, n)
    counts += counts.T
    left = left - np.bincount(row[:light], minlength=n)
    first = int(np.searchsorted(start, light))
    live = np.arange(n)
    while first < len(start):
        may = (counts[np.ix_(live, live)] + np.minimum(left[live][:, None], left[live]) >= need[np.ix_(live, live)]).any(1)
        live = live[may]
        if not len(live):
            break
        stop = min(first + BLOCK_COLUMNS, len(start))
        a, b = start[first], start[stop] if stop < len(start) else len(column)
        seat = np.full(n, -1)
        seat[live] = np.arange(len(live))
        r, c = seat[row[a:b]], np.repeat(np.arange(stop - first), held[first:stop])
        block = np.zeros((len(live), stop - first), np.float32)
        block[r[r >= 0], c[r >= 0]] = 1
        counts[np.ix_(live, live)] += (block @ block.T).astype(np.int64)
        left = left - np.bincount(row[a:b], minlength=n)
        first = stop
    linked = counts >= need  # what was discarded on the way has no link
    lowest = np.arange(n)
    while True:
        now = np.minimum(lowest, np.where(linked, lowest[None, :], n).min(1))
        now = now[now]
        if np.array_equal(now, lowest):
            break
        lowest = now
    label[where] = where[lowest]
    return label


def tile_links(rows: DataFrame, bounds: Bounds) -> DataFrame:
    """Links (a, b) that join the same sets as the links within each tile do. Rows: tile, name, n, grams."""

    def product(tile: pa.Table) -> pa.Table:
        name, lists = tile.column("name").combine_chunks(), tile.column("grams").combine_chunks()
        size = np.asarray(lists.value_lengths(), np.int64)
        label = overlap_links(size, np.asarray(lists.flatten()), bounds)
        a = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": name.take(pa.array(a)), "b": name.take(pa.array(label[a]))})

    return rows.select("tile", "name", "n", "grams").groupBy("tile").applyInArrow(product, f"a {NAME}, b {NAME}").distinct()


def blocks_for(sets: Column | str, grams: Column | str) -> Column:
    """Blocks of rows for so many sets with so many n-grams, 1 at least."""
    sets, grams = (F.col(x) if isinstance(x, str) else x for x in (sets, grams))
    return F.greatest(F.ceil(sets / BLOCK_SETS), F.ceil(grams / BLOCK_GRAMS), F.lit(1)).cast("bigint")


def block_of(name: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(name)), blocks)


def first_links(chosen: DataFrame, large: DataFrame, total: tuple[int, int], sets_of, bounds: Bounds) -> DataFrame:
    """Links within small families, and in large ones (family, blocks) those of each block and the family's first block."""
    shares = max(1, ceil(2 * total[0] / BLOCK_SETS), ceil(2 * total[1] / BLOCK_GRAMS))
    own = block_of("name", F.col("blocks"))
    tiles = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("bigint"))).when(own == 0, F.sequence(F.lit(1).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array(own))
    place = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("family"), F.lit(shares))).otherwise(F.col("family"))
    tile = F.transform(tiles, lambda t: F.struct(F.col("blocks").isNotNull().alias("whole"), place.alias("place"), t.alias("tile")))
    return tile_links(at_tiles(chosen.join(large, "family", "left").withColumn("tiles", tile), sets_of), bounds)


def at_tiles(seats: DataFrame, sets_of) -> DataFrame:
    """Each set once for every tile that its rows of ``seats`` name; it is made once."""
    one = seats.groupBy("name", *ROW).agg(F.array_distinct(F.flatten(F.collect_list("tiles"))).alias("tiles"))
    return sets_of(one).withColumn("tile", F.explode("tiles")).drop("tiles")


def further_links(chosen: DataFrame, large: DataFrame, found: DataFrame, sets_of, bounds: Bounds) -> DataFrame:
    """Links of large families between blocks that do not lie in one component ``found`` already.

    A component of at least a block's size has blocks of its own, the others of a family share blocks.
    """
    sets = chosen.join(large.select("family"), "family", "left_semi").join(found.withColumnRenamed("node", "name"), "name", "left")
    sets = written(sets.withColumn("component", F.coalesce("component", "name")), "large-sets")
    counts = sets.groupBy("family", "component").agg(F.count("*").alias("sets"), F.sum("n").alias("grams"))
    counts = written(counts.withColumn("whole", F.when((F.col("sets") >= BLOCK_SETS) | (F.col("grams") >= BLOCK_GRAMS), F.col("component"))), "counts")
    parts = counts.groupBy("family", "whole").agg(F.sum("sets").alias("sets"), F.sum("grams").alias("grams"), F.count("*").alias("components"))
    parts = written(parts.withColumn("blocks", blocks_for("sets", "grams")), "parts")
    unit = parts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select("family", F.struct("whole", "block").alias("block"), "components")
    left, right = (unit.select("family", F.col("block").alias(c), F.col("components").alias(f"of_{c}")) for c in "xy")
    apart = F.expr("not (x.whole <=> y.whole) or (x.whole is null and of_x > 1)")
    number = unit.groupBy("family").agg(F.count("*").alias("k"))
    pairs = left.join(right, "family").where("x <= y").where(apart).join(number, "family").where("x <> y or k = 1").select("family", "x", "y")
    tiles = pairs.withColumn("block", F.explode(F.array_distinct(F.array("x", "y")))).groupBy("family", "block").agg(F.collect_list(F.struct("family", F.xxhash64("x", "y").alias("tile"))).alias("tiles"))
    seats = sets.join(counts.select("family", "component", "whole"), ["family", "component"]).alias("s").join(parts.alias("p"), F.expr("s.family = p.family and s.whole <=> p.whole"))
    seats = seats.select("s.family", "s.name", *[f"s.{c}" for c in ROW], F.struct(F.col("s.whole").alias("whole"), block_of("s.name", F.col("p.blocks")).alias("block")).alias("block"))
    seats = written(seats.join(tiles, ["family", "block"]).drop("block"), "tiles")
    out = written(tile_links(at_tiles(seats, sets_of), bounds), "further-links")
    discard(sets, counts, parts, seats)
    return out


def near_sets(docs: DataFrame, base: DataFrame, n: int, bounds: Bounds, text: str) -> DataFrame:
    """Rows (name, near, family, n, ROW) of the sets that share a signature with another one, one for each family that they are in.

    A family is all sets with a signature that one set, its first, leads; two sets with a common signature have its first set's family in common.
    """
    sigs = signature_rows(docs, n, bounds, text, common_grams(docs, n, text))
    groups = written(sigs.groupBy("sig").agg(F.min("near").alias("family"), F.max("near").alias("last")).where("family <> last").drop("last"), "groups")
    members = written(sigs.join(groups, "sig").select("near", "family").distinct(), "members")
    discard(groups)
    rows = base.where("name is not null").groupBy("name").agg(F.min(F.struct("near", *ROW)).alias("r"), F.max("n_shingles").alias("n"))
    chosen = written(rows.select("name", "n", "r.*").join(members, "near"), "chosen")
    discard(members)
    return chosen


def jaccard_components(docs: DataFrame, n: int = 4, threshold: tuple[int, int] = (85, 100), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents under links at threshold[0] / threshold[1] Jaccard similarity of their n-word shingle sets.

    Rows: key, n_shingles, component_id (smallest key reachable), node (equal for equal sets), copies (rows in the component).
    A text of fewer words is one shingle. Null and wordless texts have an empty set and are linked with nothing: they are
    components of their own. Rows of equal key are one vertex of the graph only if their sets are equal. Rows with a null key take part like others; a component
    of these alone has no id. An empty table gives no rows; other columns are not carried. The key must be a whole number.

    Every link counts; shingles are told apart by 64 bits, sets by 120. Equal sets are one node, so groups of copies never meet each other. Signature
    groups are found by an aggregation with map-side combine and joined back by an equi-join that AQE may split; no family
    is gathered in a task, only bounded blocks of it.
    """
    with small_batches(docs.sparkSession):
        return _components(docs, n, Bounds(*threshold), key, text)


def _components(docs: DataFrame, n: int, bounds: Bounds, key: str, text: str) -> DataFrame:
    base = written(summaries(docs, n, key, text), "sets-of")
    chosen = near_sets(docs, base, n, bounds, text)
    sets_of = lambda rows: set_rows(docs, rows, n, key, text)
    families = chosen.groupBy("family").agg(F.count("*").alias("sets"), F.sum("n").alias("grams")).withColumn("blocks", blocks_for("sets", "grams"))
    families = written(families, "families")
    total = families.where("blocks = 1").agg(F.coalesce(F.sum("sets"), F.lit(0)), F.coalesce(F.sum("grams"), F.lit(0))).first()
    large = written(families.where("blocks > 1").select("family", "blocks"), "large")
    links = written(first_links(chosen, large, (total[0], total[1]), sets_of, bounds), "links")
    found = written(components(links), "components")
    if large.count():
        more = further_links(chosen, large, found, sets_of, bounds)
        if more.count():
            discard(found)
            found = written(components(links.unionByName(more)), "components")
        discard(more)
    discard(chosen, families, large, links)
    copies = base.where("name is not null").groupBy("name").agg(F.min(key).alias("least"), F.count("*").alias("rows"))
    placed = written(copies.join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("c", F.coalesce("component", "name")), "placed")
    groups = placed.groupBy("c").agg(F.min("least").alias("component_id"), F.sum("rows").alias("copies"))
    named = written(placed.join(groups, "c").select("name", "component_id", "copies"), "named")
    discard(found, placed)
    named = base.join(named, "name", "left")
    return named.select(key, "n_shingles", F.when(F.col("name").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id"), F.col("name").alias("node"), F.coalesce("copies", F.lit(1)).alias("copies"))


def one_of_each(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that are linked, directly or not, to a row of smaller key.

    Of repeated rows of one key and text one stays. Rows with a null key or an empty set stay.
    """
    found = written(jaccard_components(docs, n, threshold, key, text), "found")
    kept = docs.join(found.where(F.col("component_id") != F.col(key)).select(key).distinct(), key, "left_anti")
    again = written(found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "repeated")
    if again.count():
        alone = kept.join(again, key, "left_anti")
        kept = alone.unionByName(kept.join(again, key, "left_semi").dropDuplicates([key, text]))
    return kept.select(*docs.columns)
