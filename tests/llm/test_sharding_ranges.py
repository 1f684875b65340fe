"""Ranges of the sharding follow rows as well as bytes, and change no result."""

from pyspark.sql import functions as F

from lumachron.llm import sharding
from lumachron.llm.shared import written


def rows_of(spark, n=6000):
    """A third of all rows without text, a third one text, the rest of many lengths; ids are repeated or null."""
    text = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("the same words " * 40)).otherwise(F.repeat(F.concat(F.col("id"), F.lit(" ")), (F.col("id") % 97).cast("int")))
    doc_id = F.when(F.col("id") % 10 != 0, F.col("id") % 500)
    return written(spark.range(n).select(doc_id.alias("doc_id"), text.cast("string").alias("text"), F.col("id").alias("row")), "documents")


def test_ranges_change_no_result(spark):
    docs = rows_of(spark)
    few, many = (sorted(map(tuple, sharding.assigned(docs, 5, row=F.col("row"), rows_a_range=k).collect()), key=str) for k in (10**6, 40))
    assert few == many and len(few) == 6000
    sizes = [sum(r[1] for r in few if r[4] == s) for s in range(5)]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in few)


def test_ranges_are_bounded_in_rows(spark):
    text = F.coalesce("text", F.lit(""))
    rows = written(rows_of(spark).select((F.octet_length(text) + 8).cast("long").alias("size"), F.xxhash64(text).alias("k"), F.coalesce("doc_id", F.lit(-1)).cast("long").alias("i"), F.col("row").alias("u")), "keys")
    total = rows.agg(F.sum("size")).first()[0]
    held, counted = sharding.ranged(rows, total, 150, 40)
    assert max(c["rows"] for c in counted.values()) <= 80
    assert sum(c["rows"] for c in counted.values()) == 6000 == held.count()
    spans = sorted((tuple(c["a"]), tuple(c["z"])) for c in counted.values())
    assert all(z < a for (_, z), (a, _) in zip(spans, spans[1:]))  # ranges don't overlap
