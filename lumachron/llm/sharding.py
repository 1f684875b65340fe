"""Sharding by sampled splitters. DataFrame operations only.

Records get a key: a hash of the text, then the id, then a row number, so that copies lie together and a large group of
copies can still be divided, even if they have one id. A sample, drawn with a chance in proportion to a record's size, gives splitters: quantiles of bytes, not of rows. Records
are counted by range; ranges that came out overfull, in bytes or in rows, are divided by quantiles of a sample of their own, until none is.
Within a range, running sums of bytes and rows (the ranges before it come from the counts) place each record in the
sequence of all bytes, and equal parts of that sequence are the shards, so their sizes differ by less than a record. A slot is the
record's place in its shard.

Only keys and sizes are shuffled, a range a window. There are as many ranges as it takes for each to have some ROWS_A_RANGE records, so a task's
work doesn't grow with the table; the driver sees the sample, a few rows a range, and one row a range. Null and empty texts have the overhead as size. Repeated rows (even of one id) are placed each by itself.
An empty table gives no rows.
"""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

#: Sampled records a range, the least number of top bits of the key by which splitters are looked up, and records that a range is to have at most, more or less.
SAMPLED, TOP_BITS, ROWS_A_RANGE = 12, 10, 2_000_000


Key = tuple[int, int, int]
KEY = ["k", "i", "u"]


def splitter_table(spark: SparkSession, splitters: list[Key], bits: int) -> DataFrame:
    """top, base, inside: for each value of the key's top bits, the splitters below it and those with it. 2^bits rows."""
    inside: dict[int, list[dict]] = {}
    for key in sorted(splitters):
        inside.setdefault((key[0] >> (64 - bits)) + (1 << (bits - 1)), []).append(dict(zip(KEY, key)))
    rows, base = [], 0
    for top in range(1 << bits):
        rows.append({"top": top, "base": base, "inside": inside.get(top, [])})
        base += len(rows[-1]["inside"])
    schema = "array<struct<top: int, base: int, inside: array<struct<k: bigint, i: bigint, u: bigint>>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def with_range(rows: DataFrame, splitters: list[Key]) -> DataFrame:
    """rows (k, i, u) with `range`: how many splitters are at or before them."""
    bits = max(TOP_BITS, len(splitters).bit_length())  # so a value of the top bits has about one splitter, however many there are
    top = (F.shiftright("k", 64 - bits) + (1 << (bits - 1))).cast("int")
    before = F.filter("inside", lambda s: s <= F.struct(*KEY))
    table = splitter_table(rows.sparkSession, splitters, bits)
    return rows.withColumn("top", top).join(F.broadcast(table), "top").withColumn("range", F.col("base") + F.size(before)).drop("top", "base", "inside")


def sample(rows: DataFrame, rate: float, seed: int) -> list[tuple[Key, int]]:
    """Key and weight of records drawn with chance size * rate, one at least drawn surely from each 1 / rate bytes of a record."""
    drawn = F.floor(F.col("size") * rate + (F.pmod(F.xxhash64("i", "k", "u", F.lit(seed)), F.lit(1 << 30)) / (1 << 30))).cast("long")
    return sorted(((r["k"], r["i"], r["u"]), r["w"]) for r in rows.select(*KEY, drawn.alias("w")).where("w > 0").collect())


def quantiles(points: list[tuple[Key, int]], parts: int) -> list[Key]:
    total, seen, found = sum(w for _, w in points), 0, []
    for key, w in points:
        seen += w
        if seen * parts >= total * (len(found) + 1) and len(found) < parts - 1:
            found.append(key)
            while seen * parts >= total * (len(found) + 1) and len(found) < parts - 1:
                found.append(key)
    return sorted(set(found))


def ranged(rows: DataFrame, total: int, n: int, most_rows: int) -> tuple[DataFrame, dict[int, Row]]:
    """rows with range, and bytes and rows by range: n ranges of near equal bytes, those with more than twice their share of bytes or more than twice
    most_rows rows divided again. Only records that are equal in key can be more."""
    splitters = quantiles(sample(rows, n * SAMPLED / max(1, total), 0), n)
    for attempt in range(1, 12):
        held = with_range(rows, splitters)
        counted = {r["range"]: r for r in held.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min(F.struct(*KEY)).alias("a"), F.max(F.struct(*KEY)).alias("z")).collect()}
        over = {r: max(int(x["bytes"] * n / total), int(x["rows"] / most_rows)) + 2 for r, x in counted.items() if (x["bytes"] > 2 * total / n or x["rows"] > 2 * most_rows) and x["a"] != x["z"]}
        if not over:
            break
        points = []
        for scale in {parts.bit_length() for parts in over.values()}:  # ranges that need about as many parts are sampled at one rate
            alike = [r for r, parts in over.items() if parts.bit_length() == scale]
            points += sample(held.where(F.col("range").isin(alike)), 4 * SAMPLED * sum(over[r] for r in alike) / sum(counted[r]["bytes"] for r in alike), attempt)
        points.sort()
        known, keys = set(splitters), [p[0] for p in points]
        for r, parts in over.items():
            known |= set(quantiles(points[bisect_right(keys, tuple(counted[r]["a"])) : bisect_right(keys, tuple(counted[r]["z"]))], parts))
        if len(known) == len(splitters):
            break
        splitters = sorted(known)
    return held, counted


def assigned(docs: DataFrame, shards: int, overhead: int = 8, ranges_a_shard: int = 8, row: Column | None = None, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """doc_id, size, text_crc32, u, shard, slot: shards of equal bytes, to within a record. u numbers the rows; it is `row` if that is given.
    The number of ranges changes no result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("i"), (F.monotonically_increasing_id() if row is None else row).alias("u"))
    rows = written(rows, "keys")
    whole = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total = whole["bytes"] or 0
    held, counted = ranged(rows, total, max(shards * ranges_a_shard, -(-whole["rows"] // rows_a_range)), rows_a_range)
    before_bytes = before_rows = 0
    starts = []
    for r in sorted(counted):
        starts.append({"range": r, "bytes0": before_bytes, "rows0": before_rows})
        before_bytes, before_rows = before_bytes + counted[r]["bytes"], before_rows + counted[r]["rows"]
    base = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(starts)), "array<struct<range: int, bytes0: bigint, rows0: bigint>>")))
    inner = Window.partitionBy("range").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
    placed = held.withColumn("upto", F.sum("size").over(inner)).withColumn("row", F.count("*").over(inner)).join(F.broadcast(base), "range")
    middle = F.col("bytes0") + F.col("upto") - F.col("size") / 2
    shard = F.least(F.floor(middle * shards / F.lit(float(max(1, total)))), F.lit(shards - 1)).cast("int")
    placed = written(placed.select("doc_id", "size", "text_crc32", "u", shard.alias("shard"), (F.col("rows0") + F.col("row") - 1).alias("place")), "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "u", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int) -> None:
    """docs, with shard and slot, as Parquet, a folder a shard, in slot order within each file. Rows meet their shards by a row number
    that is written first, so ids may be null or repeated."""
    numbered = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "rows")
    where = assigned(numbered.select("doc.doc_id", "doc.text", "row"), shards, row=F.col("row")).select(F.col("u").alias("row"), "shard", "slot")
    rows = numbered.join(where, "row").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    rows.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
