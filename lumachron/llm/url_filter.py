"""URL filters: host and path rules, and exact key lists by a Bloom filter cascade.

The cascade knows the corpus's complete key universe. Level 1 is a Bloom filter of the listed keys; level 2 one of the keys
not listed that level 1 takes for listed; level 3 one of the listed keys that level 2 takes for such, and so on until
no key is mistaken. A key of the universe is listed if the first level that lacks it is even (or, past the last level,
if the number of levels is odd), so membership is exact, and rows are tested by a map, without a join.

Keys are dealt to buckets by hash, each with a cascade of its own that one task builds, as distinct keys spread evenly and the number of buckets follows
their number; a frequent key is one distinct key. The filters are some bits a listed key. They are sent to all executors
if their measured size is within a bound; otherwise rows are dealt once, by bucket and a salt that divides frequent keys, to where
copies of their bucket's filter go.

A null key is never listed. Repeated rows are judged alike. A key outside the universe may be mistaken, so the universe must be that of
the rows judged. With no listed keys all levels are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

#: Keys a bucket is meant to have, and bytes of filters that are broadcast at once.
BUCKET_KEYS, MOST_FILTER_BYTES = 50_000, 48 << 20
#: Parts that a bucket's rows are dealt to where filters aren't broadcast.
SALTS = 16


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, with A-Z lower-cased; empty without one."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without a host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (`host/path`, from (rule, verdict) pairs) whose host is the url's or a parent of it and whose path
    begins the url's path; null if none. Of rules of one length the first stands."""
    chain = None
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        chain = F.when(fits, F.lit(rule)) if chain is None else chain.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if chain is None else chain


def bit_places(x: np.ndarray, y: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """hashes x n places of keys in a filter, from their two hashes."""
    with np.errstate(over="ignore"):
        salt = np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) % 2**64)
        a, b = (x ^ salt) * np.uint64(0xBF58476D1CE4E5B9), ((y + salt) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
        a, b = a ^ (a >> np.uint64(29)), b ^ (b >> np.uint64(31)) | np.uint64(1)
        return np.stack([((a + np.uint64(k) * b) >> np.uint64(11)) % np.uint64(bits) for k in range(hashes)]).astype(np.int64)


def build_levels(x: np.ndarray, y: np.ndarray, listed: np.ndarray) -> bytes:
    """The cascade of one bucket: a level after another as (hashes: int32, bits: int32, words)."""
    inside, outside, out, level = np.flatnonzero(listed), np.flatnonzero(~listed), [], 0
    while len(inside):
        # the first level is sized so that as many false positives as listed keys are left, about; later ones halve
        share = min(0.5, len(inside) / max(1, len(outside)) / 1.41) if level == 0 else 0.5
        hashes = max(1, round(-np.log2(share)))
        bits = max(64, int(np.ceil(-len(inside) * np.log(share) / np.log(2) ** 2 / 64)) * 64)
        words = np.zeros(bits, bool)
        words[bit_places(x[inside], y[inside], level, bits, hashes).ravel()] = True
        out.append(np.array([hashes, bits], np.int32).tobytes() + np.packbits(words, bitorder="little").tobytes())
        mistaken = outside[words[bit_places(x[outside], y[outside], level, bits, hashes)].all(0)]
        inside, outside, level = mistaken, inside, level + 1
    return b"".join(out)


def test_levels(blob: bytes, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which keys of a bucket are listed."""
    found, left, at, level = np.zeros(len(x), bool), np.arange(len(x)), 0, 0
    while at < len(blob):
        hashes, bits = np.frombuffer(blob, np.int32, 2, at).tolist()
        words = np.frombuffer(blob, np.uint8, bits // 8, at + 8)
        places = bit_places(x[left], y[left], level, bits, hashes)
        left = left[((words[places >> 3] >> (places & 7).astype(np.uint8)) & 1).astype(bool).all(0)]
        found[left] = level % 2 == 0
        # keys that this level lacks keep what the level before said
        at, level = at + 8 + bits // 8, level + 1
    return found


def cascade(universe: DataFrame, listed: DataFrame, key: str = "key", bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """(bucket, levels) rows, written, and the number of buckets: exact for every key of the universe.

    Keys are known by 128 bits of hash. Listed keys that the universe lacks take no room.
    """
    hashed = lambda df: df.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("x"), F.xxhash64(F.lit(7), F.col(key)).alias("y"))
    marked = hashed(universe).withColumn("in", F.lit(1)).withColumn("on", F.lit(0)).union(hashed(listed).withColumn("in", F.lit(0)).withColumn("on", F.lit(1)))
    keys = written(marked.groupBy("x", "y").agg(F.max("in").alias("in"), F.max("on").alias("on")).where("`in` = 1").select("x", "y", (F.col("on") == 1).alias("listed")), "keys")
    buckets = max(1, -(-keys.count() // bucket_keys))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = (rows[c].to_numpy().view(np.uint64) for c in "xy")
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "levels": [build_levels(x, y, rows["listed"].to_numpy())]})

    filters = keys.withColumn("bucket", F.pmod("x", F.lit(buckets)).cast("int")).groupBy("bucket").applyInPandas(build, "bucket int, levels binary")
    return written(filters, "cascade"), buckets


def with_membership(rows: DataFrame, filters: DataFrame, buckets: int, key: str, out: str = "listed", most_bytes: int = MOST_FILTER_BYTES) -> DataFrame:
    """rows with a boolean column: whether the key is listed. Each key must be in the filters' universe."""
    rows = rows.select(*[f"`{c}`" for c in rows.columns if c != out])
    kind = T.StructType([*rows.schema.fields, T.StructField(out, T.BooleanType())])
    known, x = F.col(key).isNotNull(), F.xxhash64(key)
    bucket = F.when(known, F.pmod(x, F.lit(buckets))).otherwise(-1).cast("int")
    hashed = rows.select(F.struct(*[f"`{c}`" for c in rows.columns]).alias("row"), x.alias("x"), F.xxhash64(F.lit(7), F.col(key)).alias("y"), bucket.alias("bucket"))

    def tested(part: pa.RecordBatch, levels: dict[int, bytes]) -> pa.RecordBatch:
        x, y = (np.asarray(part.column(i)).view(np.uint64) for i in (1, 2))
        of, found = np.asarray(part.column(3)), np.zeros(part.num_rows, bool)
        for b in np.unique(of).tolist():
            if b in levels:
                own = np.flatnonzero(of == b)
                found[own] = test_levels(levels[b], x[own], y[own])
        return pa.RecordBatch.from_arrays([*part.column(0).flatten(), pa.array(found)], kind.names)

    sized = filters.agg(F.sum(F.octet_length("levels"))).first()[0] or 0
    if sized <= most_bytes:
        shared = rows.sparkSession.sparkContext.broadcast({r["bucket"]: bytes(r["levels"]) for r in filters.collect()})

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield tested(batch, shared.value)

        return hashed.mapInArrow(test, kind)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's filter comes before its rows."""
        levels: dict[int, bytes] = {}
        for batch in batches:
            starts = np.flatnonzero(np.asarray(batch.column(5).is_valid())).tolist()
            for at, end in zip([-1, *starts], [*starts, batch.num_rows]):
                if at >= 0:
                    levels = {batch.column(3)[at].as_py(): batch.column(5)[at].as_py()}
                if end > at + 1:
                    yield tested(batch.slice(at + 1, end - at - 1), levels)

    data = hashed.select("*", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("levels"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    none = F.lit(None).cast(data.schema["row"].dataType).alias("row")
    sent = filters.select(none, F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "bucket", salts, "levels")
    dealt = data.union(sent).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("levels").isNull())
    return dealt.mapInArrow(meet, kind)


def judged_urls(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, key: Column) -> DataFrame:
    """page_id, host, path, rule, verdict, key, listed of every page: the rule's verdict, else block if its key is listed.

    `key` is an expression over host and path. Null urls and those without :// have empty host and path.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", key)
    rows = written(rows, "urls")
    filters, buckets = cascade(rows, listed)
    verdicts = F.create_map(*[F.lit(x) for pair in rules for x in pair]) if rules else F.lit(None).cast("map<string, string>")
    judged = with_membership(rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)), filters, buckets, "key")
    return judged.withColumn("verdict", F.coalesce(F.get(F.array(F.element_at(verdicts, F.col("rule"))), F.lit(0)), F.when(F.col("listed"), "block").otherwise("allow"))).select("page_id", "host", "path", "rule", "verdict", "key", "listed")
