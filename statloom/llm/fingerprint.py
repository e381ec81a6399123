"""I-Match document fingerprints: hashes of a document's mid-frequency terms over randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency ln(N / df) lies in a chosen band. A document's
terms inside the band are sorted and hashed whole, and once for each random subset of the lexicon. Subsets come in
``SERIES`` nested chains: the first of a chain keeps one term in 2 ** ``FIRST_BITS``, each further one half of the last, ``DEPTH`` in all,
so that short and very long documents both meet subsets in which they have a handful of terms. A document with fewer than ``FEW`` terms
in the band is hashed over all its terms instead. Built from DataFrame and SQL functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import written

SERIES, DEPTH, FIRST_BITS = 6, 8, 3
#: Idf band of the lexicon: a term of fewer than N * exp(-IDF_HIGH) documents is noise, of more than N * exp(-IDF_LOW) a stop word.
IDF_LOW, IDF_HIGH = 1.6, 7.6
#: A document with fewer terms in the band is fingerprinted over all its terms.
FEW = 8
#: A larger lexicon is joined by a shuffle instead of a broadcast.
BROADCAST_TERMS = 2_000_000
HEX = 8
#: Marks of a term in its low three bits, which no hash keeps.
OWN, EDITED, KNOWN = 1, 2, 4


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of the lower-case words (runs of letters and digits) of a text."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", idf_low: float = IDF_LOW, idf_high: float = IDF_HIGH) -> DataFrame:
    """Hashes of the terms in the idf band, counted over all distinct texts, so that copies do not lift their terms out of it: rows (term).

    Each text has each term once, so terms in at least N * exp(-idf_high) texts number at most
    exp(idf_high) times the mean number of distinct terms of a text, however large the corpus is.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    n = docs.select(F.xxhash64(body), F.hash(body), F.octet_length(body)).distinct().count()
    counts = docs.select(body.alias("body")).distinct().select(F.explode(term_hashes(F.col("body"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(max(n, 1))) / F.col("df"))
    return counts.where(idf.between(idf_low, idf_high)).select("term")


def subset_hashes(terms: Column) -> Column:
    """Array of 1 + SERIES * DEPTH hashes of a sorted term array; null where a subset has no term of it."""

    bits = FIRST_BITS + DEPTH - 1

    def chain(first: int) -> Column:
        """Hashes of the nested subsets given by ``bits`` bits of each term, from bit ``first`` on."""
        mask = ((1 << FIRST_BITS) - 1) << first
        base = F.filter(terms, lambda t: t.bitwiseAND(F.lit(mask)) == mask)
        halve = lambda acc, j: F.array_append(acc, F.filter(F.element_at(acc, -1), lambda t: F.getbit(t, j) == 1))
        steps = F.aggregate(F.sequence(F.lit(first + FIRST_BITS), F.lit(first + bits - 1)), F.array(base), halve)
        return F.transform(steps, lambda a: F.when(F.size(a) > 0, F.xxhash64(a)))

    chains = [chain(s * bits) for s in range(SERIES)]
    return F.concat(F.array(F.when(F.size(terms) > 0, F.xxhash64(terms))), *chains)


def encode(hashes: Column, fallback: Column) -> Column:
    """Fingerprint text: 16 hex digits of the whole set's hash (of the text, if no term is in the band), then HEX for each subset."""
    whole = F.lpad(F.lower(F.hex(F.coalesce(hashes[0], fallback))), 16, "0")
    rest = F.transform(F.slice(hashes, 2, SERIES * DEPTH), lambda h: F.when(h.isNull(), F.lit("-" * HEX)).otherwise(F.substring(F.lpad(F.lower(F.hex(h)), 16, "0"), 9, HEX)))
    return F.concat(whole, F.array_join(rest, ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with a term of either document whose hashes agree, for two arrays of ``subset_hashes``; 1 for arrays that agree in all."""
    low = lambda h: h.bitwiseAND(F.lit((1 << 4 * HEX) - 1))
    #: 2: both have the same, 1: one has none or they differ, 0: neither has any.
    parts = F.zip_with(F.slice(a, 2, SERIES * DEPTH), F.slice(b, 2, SERIES * DEPTH), lambda x, y: F.when(low(x) == low(y), 2).when(F.coalesce(x, y).isNull(), 0).otherwise(1))
    live, agree = SERIES * DEPTH - F.size(F.filter(parts, lambda p: p == 0)), F.size(F.filter(parts, lambda p: p == 2))
    return F.when(live == 0, 0.0).otherwise(agree / live)


def range_bounds(docs: DataFrame, key: str, pieces: int) -> list[int]:
    """At most ``pieces`` keys that cut the rows into ranges of about equal counts, the smallest key first."""
    cuts = docs.select(F.percentile_approx(key, [i / pieces for i in range(pieces)], pieces * 20).alias("c")).first()[0]
    return sorted(set(cuts or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of the range a key lies in, by a two-step search; a null key lies in the last range."""
    step = max(1, int(len(bounds) ** 0.5))
    top, full = F.array(*[F.lit(b) for b in bounds[::step]]), F.array(*[F.lit(b) for b in bounds])
    coarse = F.greatest(F.size(F.filter(top, lambda b: b <= key)) - 1, F.lit(0))
    fine = F.size(F.filter(F.slice(full, coarse * step + 1, F.lit(step)), lambda b: b <= key))
    return F.when(key.isNull(), len(bounds) - 1).otherwise(coarse * step + fine - 1).cast("int")


def with_next(docs: DataFrame, bounds: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, text, next_text, piece, guest, at): with each text that of the next row in ascending key order, after the last the first's.

    Rows are dealt to ranges of the key. Each bound is a key of its own, so a range's first row is known beforehand
    and also sits, as a guest, at the end of the range before it. Rows of one key follow each other by text;
    null keys come last. (piece, at) tells rows apart.
    """
    body = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    piece = range_of(F.col(key), bounds)
    first = F.array_position(F.array(*[F.lit(b) for b in bounds]), F.col(key)) > 0
    seat = lambda p, g: F.struct(p.alias("piece"), F.lit(g).alias("guest"))
    seats = F.when(first, F.array(seat(piece, 0), seat(F.pmod(piece - 1, F.lit(len(bounds))), 1))).otherwise(F.array(seat(piece, 0)))
    dealt = body.withColumn("seat", F.explode(seats)).select(key, "text", "seat.piece", "seat.guest")
    over = f"over (partition by piece order by guest, `{key}` nulls last, text)"
    return dealt.selectExpr(f"`{key}`", "text", "piece", "guest", f"lead(text) {over} as next_text", f"row_number() {over} as at")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", pieces: int = 1024, idf_low: float = IDF_LOW, idf_high: float = IDF_HIGH, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Fingerprint every text and its edited form, in which the last quarter gives way to the start of the next row's text.

    Rows: key, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    (likeness to the edited text's and to the next row's fingerprint). A null text counts as empty. A text with fewer than ``FEW`` terms in
    the band is fingerprinted over all its terms; a text without terms
    is fingerprinted by its own hash, so equal texts agree and others do not. Repeated rows stay; a lone row is its own
    next; an empty table gives no rows; other columns are not carried. Null keys come last in the order.

    One shuffle moves the texts, into ranges of the key; terms meet the lexicon by a broadcast join whose size is checked
    (a shuffled join beyond ``broadcast_terms``) and are gathered again within the same ranges.
    """
    bounds = range_bounds(docs, key, pieces) or [0]
    terms = written(lexicon(docs, text, idf_low, idf_high).select(F.col("term").bitwiseAND(F.lit(-8)).alias("term")).distinct(), "lexicon").withColumn("known", F.lit(True))
    if terms.count() <= broadcast_terms:
        terms = F.broadcast(terms)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = with_next(docs, bounds, key, text).withColumn("edited", edited)
    rows = rows.select(
        "at", "piece", "guest", F.col(key).alias("key"), n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("sha"), F.xxhash64("text").alias("own_hash"), F.xxhash64("edited").alias("edited_hash"), term_hashes(F.col("text")).alias("own"), term_hashes(F.col("edited")).alias("other")
    )
    #: A term with its marks in the low bits: OWN, EDITED, both. The first element has neither and carries the row's own columns.
    side = lambda hashes, s: F.transform(hashes, lambda h: h.bitwiseAND(F.lit(-8)).bitwiseOR(F.lit(s)))
    spread = F.concat(
        F.array(F.lit(0).cast("bigint")), side(F.array_intersect("own", "other"), OWN | EDITED), side(F.array_except("own", "other"), OWN), side(F.array_except("other", "own"), EDITED)
    )
    rows = rows.withColumns({"head": F.struct("key", "n_chars", "sha", "own_hash", "edited_hash", "guest"), "t": spread})
    rows = rows.select("at", "piece", "head", F.explode("t").alias("t"))
    rows = rows.select("at", "piece", F.when(F.col("t") == 0, F.col("head")).alias("head"), "t", F.col("t").bitwiseAND(F.lit(-8)).alias("term"))
    rows = rows.join(terms, "term", "left").select("at", "piece", "head", F.when(F.col("known"), F.col("t").bitwiseOR(F.lit(KNOWN))).otherwise(F.col("t")).alias("t"))
    sets = rows.groupBy("at", "piece").agg(F.first("head", ignorenulls=True).alias("head"), F.array_sort(F.collect_list(F.when(F.col("t") != 0, F.col("t")))).alias("t"))
    sets = sets.select("at", "piece", "head.*", "t")
    with_marks = lambda m: F.transform(F.filter("t", lambda x: x.bitwiseAND(F.lit(m)) == m), lambda x: F.shiftright(x, 3))
    sets = sets.withColumns({"own": with_marks(OWN | KNOWN), "other": with_marks(EDITED | KNOWN)}).withColumns({"own_few": F.size("own") < FEW, "other_few": F.size("other") < FEW})
    chosen = lambda name, mark: F.when(F.col(f"{name}_few"), with_marks(mark)).otherwise(F.col(name))
    hashed = sets.withColumns({"own": subset_hashes(chosen("own", OWN)), "other": subset_hashes(chosen("other", EDITED))})
    #: Texts without terms have no hashes; their own hash tells them apart.
    coded = hashed.withColumns({"fingerprint": encode(F.col("own"), F.col("own_hash")), "edited_fingerprint": encode(F.col("other"), F.col("edited_hash"))})
    near = likeness(F.col("own"), F.col("other"))
    coded = coded.withColumn("near", F.when(F.col("fingerprint") == F.col("edited_fingerprint"), 1.0).otherwise(near))
    coded = coded.withColumn("next", F.expr("lead(struct(fingerprint, own)) over (partition by piece order by at)")).where("guest = 0")
    near_next = F.when(F.col("fingerprint") == F.col("next.fingerprint"), 1.0).otherwise(F.coalesce(likeness(F.col("own"), F.col("next.own")), F.lit(0.0)))
    return coded.select(
        F.col("key").alias(key), "n_chars", F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint", F.col("near").alias("near_edited"), near_next.alias("near_next")
    )
