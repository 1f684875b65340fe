"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, with score intervals that close.

The index is cut into shards of documents, so that no list of a frequent term lies in one task. In a shard a term's list
holds its documents from the greatest impact down. A search reads all lists of an item side by side, ever deeper. What a
document has been read with is its lower bound; what the lists could still give it, by the last impact read from each list
where it wasn't seen, makes the upper bound; a document not seen at all is bounded by the sum of those impacts. Nothing is
looked up out of turn. Reading goes on until no document outside can reach the last place, not even by a tie, and the
intervals of all that can are closed, so membership, ties and scores are exact. Each shard gives its best k of an item,
which hold the best k of all; those few rows are ranked.

Terms are runs of letters, digits and characters beyond ASCII, only A-Z lower-cased. A document is a row: repeated rows and
ids are ranked each by itself, rows without an id come after others of their score. Null, empty and wordless texts are no
documents, and items without a term that some document has give no rows. Items are rows too: two with one id have a
ranking each. Counts and frequencies are over all documents. Only doc_id, item_id and text are read, so other columns may
have any name. Scores are sums of integers below 2^53, which doubles hold exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written
from .words import SIGNS, slices, split_words

#: Bytes of item texts that are searched for at once, and so sent to all executors; more are searched in blocks.
MOST_ITEM_BYTES = 8 << 20
#: Postings that a shard is to have, more or less: some tens of MB in a task.
POSTINGS_A_SHARD = 500_000
#: Entries that are read from each list at first; each further read doubles the depth.
FIRST_READ = 128
#: Length normalisation: m = 100 - SHARE + SHARE * n * N div L.
SHARE = 90


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the vocabulary, ascending) and tfs of each row; whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(shared.value, pa.binary())
        size = max(1, len(asked))
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column(1), SIGNS)
                place = words.places(asked)
                found = place >= 0
                key, tf = np.unique(words.texts()[found] * size + place[found], return_counts=True)
                offsets = pa.array(np.searchsorted(key // size, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % size, tf)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(words.at).astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def impacts_of(n: np.ndarray, tf: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term gives a document before its weight, in whole numbers."""
    m = 100 - SHARE + SHARE * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def impact_index(counts: DataFrame, shards: int, documents: int, length: int) -> DataFrame:
    """shard, term, docs and impacts (from the greatest down), ids: the lists of each shard, and, as term -1, the ids that
    the places in docs stand for, ascending, those without an id last. counts has a row number, by which rows are dealt."""

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("row", "ascending")])  # nulls come last
        terms, tfs = (rows.column(c).combine_chunks() for c in ("terms", "tfs"))
        many = np.asarray(terms.value_lengths()).astype(np.int64)
        doc = np.repeat(np.arange(rows.num_rows), many)
        term, tf = (np.asarray(x.flatten()).astype(np.int64) for x in (terms, tfs))
        impact = impacts_of(np.repeat(np.asarray(rows.column("n")), many), tf, documents, length)
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order], impact[order]
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        offsets = pa.array(np.append(first, [len(term), len(term)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (doc, impact)]
        ids = pa.array([[]] * len(first) + [rows.column("doc_id").to_pylist()], pa.list_(pa.int64()))
        shard = pa.array([key[0].as_py()] * (len(first) + 1), pa.int64())
        return pa.Table.from_arrays([shard, pa.array(np.append(term[first], -1).astype(np.int32)), *lists, ids], ["shard", "term", "docs", "impacts", "ids"])

    dealt = counts.where(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(build, "shard long, term int, docs array<int>, impacts array<int>, ids array<long>")


def best_of(lists: list[tuple[np.ndarray, np.ndarray]], documents: int, k: int, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best of some documents by impact-sorted lists (places, weighted impacts), ties by place, and
    how many entries were read."""
    lower, at, depth = np.zeros(documents), 0, first_read
    longest = max((len(docs) for docs, _ in lists), default=0)
    while True:
        bound, passed = 0.0, np.zeros(documents)
        for docs, weighted in lists:
            lower[docs[at:depth]] += weighted[at:depth]
            if depth < len(docs):  # what the rest of the list can give, at most
                frontier = weighted[depth - 1]
                bound += frontier
                passed[docs[:depth]] += frontier
        reach = np.where(lower > 0, bound - passed, bound)  # to a document's upper bound, from where it was not seen
        last = np.partition(lower, documents - k)[documents - k] if documents > k else 0.0
        last = max(last, 0.0)
        open_ = (lower + reach >= last) & (reach > 0)
        if depth >= longest or (last > 0 and bound < last and not open_.any()):
            top = np.flatnonzero((lower >= last) & (lower > 0))
            top = top[np.lexsort((top, -lower[top]))][:k]
            return top, lower[top].astype(np.int64), sum(min(depth, len(docs)) for docs, _ in lists)
        at, depth = depth, 2 * depth


def top_of_shards(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, k: int) -> DataFrame:
    """item, doc_id, score, entries: the best k of each shard for each item (the places of its terms)."""
    shared = index.sparkSession.sparkContext.broadcast((items, weights))

    def search(rows: pa.Table) -> pa.Table:
        items, weights = shared.value
        terms = rows.column("term").to_pylist()
        docs, impacts = (rows.column(c).combine_chunks() for c in ("docs", "impacts"))
        held = {t: (np.asarray(docs[i].values), np.asarray(impacts[i].values).astype(np.float64) * weights[t]) for i, t in enumerate(terms) if t >= 0}
        ids = rows.column("ids").combine_chunks()[terms.index(-1)].values
        out: list[tuple[np.ndarray, np.ndarray, int]] = []
        for terms_of in items:
            out.append(best_of([held[t] for t in terms_of.tolist() if t in held and weights[t] > 0], len(ids), k))
        many = [len(x) for x, _, _ in out]
        top = pa.array(np.concatenate([x for x, _, _ in out]), pa.int64())
        score = pa.array(np.concatenate([x for _, x, _ in out]))
        entries = pa.array(np.repeat(np.array([n for _, _, n in out], np.int64), many))
        return pa.Table.from_arrays([pa.array(np.repeat(np.arange(len(items)), many)), ids.take(top), score, entries], ["item", "doc_id", "score", "entries"])

    return index.groupBy("shard").applyInArrow(search, "item long, doc_id long, score long, entries long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item (a number of the item's row), item_id, rank, doc_id, score: the k best documents of each item, those with a score above 0."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // MOST_ITEM_BYTES) or 1
    result = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow().combine_chunks()  # bounded by MOST_ITEM_BYTES
        words = split_words(rows.column("text").chunk(0) if rows.num_rows else pa.array([], pa.string()), SIGNS)
        vocabulary, codes = words.distinct.to_pylist(), words.codes
        terms = [np.unique(codes[a:b]) for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist())]
        found = best(docs, terms, vocabulary, k)
        names = docs.sparkSession.createDataFrame([(i, block, x) for i, x in enumerate(rows.column("item_id").to_pylist())], "item long, block int, item_id long")
        found = found.join(F.broadcast(names), "item").select((F.col("block").cast("long") * (1 << 32) + F.col("item")).alias("item"), "item_id", "doc_id", "score")
        result = found if result is None else result.union(found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "item_id", "rank", "doc_id", "score")


def best(docs: DataFrame, terms: list[np.ndarray], vocabulary: list[bytes], k: int) -> DataFrame:
    """item, doc_id, score: rows that hold the k best documents for each list of terms (places in the vocabulary)."""
    counts = written(counted(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), "counts")
    sums = counts.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length"), F.sum(F.size("terms")).alias("postings")).first()
    often = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # no longer than the vocabulary
        often[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * (sums["documents"] or 0) + 2) / (2 * int(df) + 1))) if df else 0 for df in often], np.int64)
    shards = -(-(sums["postings"] or 0) // POSTINGS_A_SHARD) or 1
    index = written(impact_index(counts, shards, sums["documents"] or 1, sums["length"] or 1), "index")
    return written(top_of_shards(index, terms, weights, k).select("item", "doc_id", "score"), "best")
