"""Line dedup by site-relative frequency. DataFrame operations only.

For each site, the documents that contain a line are divided by the documents of the site; lines over a ratio are
boilerplate there and are dropped from the site's documents, wherever they stand. Lines are compared by 128 bits of hash, so
only hashes move until the dropped lines of each document are known. Counting combines before the shuffle, keys are (site,
line), and joins on hot keys are left to adaptive skew handling; a large site never comes together in one task.

Lines are what newlines separate; lines without a word are kept. A null text stays null, an empty one empty. Documents
without a site form one site. A line of fewer than `least` documents is kept, so small sites lose nothing. Repeated rows
count as many times as they stand there. Rows are judged by site and text alone, so ids may be null or repeated; other
columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Boilerplate lines of all sites (16 bytes each) up to which the lists are broadcast.
MOST_LINES = 200_000
WORDY = r"[^\x20\x09-\x0D]"


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit(1), line).alias("y"))


def site_of(site: str) -> Column:
    return F.coalesce(F.col(site).cast("string"), F.lit(""))


def line_keys(docs: DataFrame, site: str, *keep: Column) -> DataFrame:
    """site, x, y (and what is kept of a row): a row for each distinct line with a word of each document."""
    wordy = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORDY))
    keys = F.array_distinct(F.transform(wordy, line_key))
    return docs.select(site_of(site).alias("site"), *keep, F.explode(keys).alias("key")).select("site", "key.x", "key.y", *[f"`{c}`" for c in docs.select(*keep).columns])


def boilerplate(docs: DataFrame, site: str, ratio: float, least: int) -> DataFrame:
    """site, x, y of the lines that more than `ratio` of the site's documents have, and at least `least`."""
    lines = line_keys(docs, site).groupBy("site", "x", "y").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = docs.groupBy(site_of(site).alias("site")).agg(F.count("*").alias("total"))
    return lines.join(total, "site").where(F.col("n") > F.col("total") * ratio).select("site", "x", "y")


def without_boilerplate(docs: DataFrame, site: str = "source", ratio: float = 0.1, least: int = 5) -> DataFrame:
    """docs with the boilerplate lines of their sites taken out of `text`, and n_dropped, the lines taken out.

    A site has no more boilerplate lines than its documents have lines on average, divided by the ratio; while all sites together
    have at most MOST_LINES, their lists are sent to the documents, which then don't move. Beyond that, each document's own lines meet
    the lists by hash, and what is found meets the documents by site and hash of the text.
    """
    frequent = written(boilerplate(docs, site, ratio, least), "frequent")
    row = docs.select(F.struct(F.lit(0).alias(""), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), site_of(site).alias("site"), F.col("text").cast("string").alias("text"))
    lists = F.collect_set(F.struct("x", "y")).alias("dropped")
    if frequent.count() <= MOST_LINES:
        rows = row.join(F.broadcast(frequent.groupBy("site").agg(lists)), "site", "left")
    else:
        key = [F.xxhash64("text").alias("tx"), F.xxhash64(F.lit(1), "text").alias("ty")]
        own = line_keys(docs, site, *key).join(frequent, ["site", "x", "y"], "left_semi").groupBy("site", "tx", "ty").agg(lists)
        rows = row.select("*", *key).join(own, ["site", "tx", "ty"], "left")
    kept = F.filter(F.split("text", "\n"), lambda x: ~(F.array_contains("dropped", line_key(x)) & x.rlike(WORDY)))
    rows = rows.select("row", "text", F.when(F.col("dropped").isNotNull(), kept).alias("kept"))
    n_dropped = F.coalesce(F.size(F.split("text", "\n")) - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped")
    text = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "n_dropped"], n_dropped)
