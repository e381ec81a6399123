"""Rendezvous sharding: each record goes to the shard whose draw for the record's key wins.

Every shard s draws u(key, s) in (0, 1] and the smallest -ln(u) / weight wins, so a shard gets rows in
proportion to its weight and adding one shard only moves rows into it. Built from SQL functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_draw(text: Column) -> Column:
    """A uniform number in (0, 1] from 52 bits of the md5 digest of a string."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + F.lit(1)).cast("double") / F.lit(float(2**52))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard number 0..len(weights)-1 for a string key; a null key counts as its own key value."""
    key = F.coalesce(key, F.lit("null"))
    draws = [F.struct((-F.ln(unit_draw(F.concat(key, F.lit(f":{s}")))) / F.lit(float(w))).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def shard_documents(docs: DataFrame, weights: list[float] | None = None, grown_weights: list[float] | None = None, key: str = "doc_id", text: str = "text", ranges: int = 256) -> DataFrame:
    """Place every row into a weighted shard, with its position there.

    Adds size (UTF-8 bytes of the text plus 1; a null text counts as none), text_crc32, law ('key'), shard,
    slot (0, 1, ... without gaps within a shard, in order of the key's own draw) and grown_shard (the shard
    under ``grown_weights``, by default one more shard of weight 1). Null keys share one key; repeated rows get
    slots of their own; an empty table gives no rows; other columns are not carried.

    A shard holds a large share of all rows, so slots are not numbered in one window per shard: the draw's
    range is cut into ``ranges`` pieces, rows are numbered within (shard, piece), and the pieces' row counts,
    at most shards x ranges numbers whatever the input, are broadcast as offsets.
    """
    weights = weights or [1.0] * 16
    grown_weights = grown_weights or [*weights, 1.0]
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    place = F.least(F.floor((F.col("draw") * F.lit(float(ranges)))), F.lit(ranges - 1)).cast("int")
    drawn = unit_draw(F.concat(name, F.lit(":slot")))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), rendezvous(name, weights).alias("shard"), rendezvous(name, grown_weights).alias("grown_shard"), drawn.alias("draw")
    ).withColumn("piece", place)
    counts = docs.select(rendezvous(name, weights).alias("shard"), drawn.alias("draw")).withColumn("piece", place).groupBy("shard", "piece").agg(F.count("*").alias("n"))
    offsets = counts.selectExpr("shard", "piece", "sum(n) over (partition by shard order by piece rows between unbounded preceding and current row) - n as before")
    numbered = rows.withColumn("at", F.expr(f"row_number() over (partition by shard, piece order by draw, `{key}`, text_crc32, size) - 1"))
    return numbered.join(F.broadcast(offsets), ["shard", "piece"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("at")).cast("bigint").alias("slot"), "grown_shard"
    )
