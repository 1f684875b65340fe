"""Benchmark decontamination by a distributed positional inverted index of the training words.

The index holds postings: word, document, ascending positions. It is built for the words that searches ask for (or all),
and a word's list lies in as many rows as documents have it, so no task gathers a frequent word. A search works from the
rarest test words: document frequencies are counted over all documents, each window of an item names its two rarest
words, and a posting of one of them at position p, less the word's place q in the item, tells where the item would lie in
the document. Where both lists of a window meet at the same shift, the document's words are compared with the item's
along that shift, so matches are exact; one comparison serves all windows of an item at that shift.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A window is `size` consecutive words of
an item, or the whole of a shorter item; null or wordless items and documents match nothing. Repeated windows and items
are each reported. Postings name a document by two hashes of its text, so each row is judged by its own text, whether
its doc_id is unique, repeated or null. An item without an id covers words but is not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import SIGNS, Words, slices, split_words

#: Bytes of test texts that are searched for at once, and so sent to all executors; more are searched in blocks.
MOST_TEST_BYTES = 32 << 20
#: Candidate places (8 bytes each, and four a document) up to which they are broadcast.
MOST_PLACES = 2_000_000
#: Contaminated texts (16 bytes each) up to which they are broadcast.
MOST_CONTAMINATED = 300_000


def split(texts: pa.Array) -> Words:
    return split_words(texts, SIGNS)


def document_frequencies(docs: DataFrame, vocabulary: pa.Array) -> np.ndarray:
    """In how many documents each word of the vocabulary occurs, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        n = np.zeros(len(asked), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words = split(part.column(0))
                place = words.places(asked)
                found = place >= 0
                n += np.bincount(np.unique(words.texts()[found] * len(asked) + place[found]) % max(1, len(asked)), minlength=len(asked))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["place", "n"])

    rows = docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(vocabulary), np.int64)
    n[np.asarray(rows.column("place"))] = np.asarray(rows.column("n"))
    return n


def text_key() -> list[Column]:
    """Two hashes, x and y, that a text is known by."""
    return [F.xxhash64("text").alias("x"), F.xxhash64(F.lit(7), "text").alias("y")]


def positional_index(docs: DataFrame, vocabulary: pa.Array | None = None) -> DataFrame:
    """Postings (word, doc_id, x, y, positions) of whole texts, for the words of the vocabulary or all words; x and y are
    hashes of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = split(part.column(3))
                place = words.codes if asked is None else words.places(asked)
                found = np.flatnonzero(place >= 0)
                text, place = words.texts()[found], place[found]
                order = np.lexsort((found, place, text))
                text, place, found = text[order], place[order], found[order]
                first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (place[1:] != place[:-1]))[: len(text)])
                positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(text)), pa.int32()), pa.array(found - words.at[text], pa.int32()))
                spelled = (words.distinct if asked is None else asked).take(pa.array(place[first])).cast(pa.string())
                own = pa.array(text[first])
                yield pa.RecordBatch.from_arrays([spelled, *(c.take(own) for c in part.columns[:3]), positions], ["word", "doc_id", "x", "y", "positions"])

    return docs.select("doc_id", *text_key(), "text").mapInArrow(post, "word string, doc_id long, x long, y long, positions array<int>")


def anchors(words: Words, frequency: np.ndarray, size: int) -> np.ndarray:
    """The words, by their places in `words`, that are among the two rarest of a window of their item; of equally rare ones the first. frequency is that of the
    distinct words."""
    total, text = len(words.words), words.texts()
    lengths = np.minimum(np.diff(words.at)[text], size)  # of an item's windows
    starts = np.flatnonzero(np.arange(total) + lengths <= words.at[1:][text]) if total else np.zeros(0, np.int64)
    rank, none = frequency[words.codes] * (total + 1) + np.arange(total), np.iinfo(np.int64).max
    first, second = np.full(len(starts), none), np.full(len(starts), none)
    for j in range(size):
        inside = j < lengths[starts]
        here = np.full(len(starts), none)
        here[inside] = rank[starts[inside] + j]
        second = np.minimum(second, np.maximum(first, here))
        first = np.minimum(first, here)
    chosen = np.concatenate([first, second])
    return np.unique(chosen[chosen < none] % (total + 1))


def candidates(index: DataFrame, words: Words, chosen: np.ndarray) -> DataFrame:
    """x, y and its places, (item, shift) where the lists of two chosen words of the item meet (one for an item of one word)."""
    item = words.texts()[chosen]
    columns = {"word": words.words.take(pa.array(chosen)).cast(pa.string()), "item": pa.array(item.astype(np.int32)), "place": pa.array((chosen - words.at[item]).astype(np.int32)), "need": pa.array(np.minimum(2, np.diff(words.at)[item]).astype(np.int32))}
    asked = index.sparkSession.createDataFrame(pa.table(columns))
    # bounded by MOST_TEST_BYTES
    met = index.join(F.broadcast(asked), "word").select("x", "y", "item", "need", "place", F.explode("positions").alias("position"))
    starts = met.groupBy("x", "y", "item", (F.col("position") - F.col("place")).alias("shift")).agg(F.count("*").alias("n"), F.first("need").alias("need"))
    return starts.where("n >= need").groupBy("x", "y").agg(F.collect_list(F.struct("item", "shift")).alias("places"))


def matched(docs: DataFrame, found: DataFrame, tested: Words, ids: pa.Array, size: int) -> DataFrame:
    """doc_id, x, y, n_words, spans (item_id, start, length: longest runs of whole windows) for every row of docs, and its row
    if it has one. A few candidates are sent to the documents; many meet them by hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast((tested.distinct, tested.codes, tested.at, ids))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, codes, at, ids = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = split(part.column(1))
                tried = part.column(2)
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for r in np.flatnonzero(np.asarray(tried.is_valid())).tolist():
                    own = Words(words.words[words.at[r] : words.at[r + 1]], words.at[:1]).places(asked)
                    for c in tried[r].as_py():
                        item, shift = codes[at[c["item"]] : at[c["item"] + 1]], c["shift"]
                        a, b = max(0, -shift), min(len(item), len(own) - shift)
                        if b - a < min(size, len(item)):
                            continue
                        same = np.concatenate(([0], own[a + shift : b + shift] == item[a:b], [0]))
                        edge = np.diff(same.astype(np.int8))
                        for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                            if y - x >= min(size, len(item)):
                                spans[r].append({"item_id": ids[c["item"]].as_py(), "start": a + shift + x, "length": y - x})
                kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(words.at)), pa.array(spans, kind), *part.columns[3:]], ["doc_id", "n_words", "spans", *key, "x", "y"])

    key = [c for c in docs.columns if c == "row"]
    found = written(found, "places")
    few = (found.agg(F.sum(F.size("places") + 4)).first()[0] or 0) <= MOST_PLACES
    found = F.broadcast(found) if few else found
    rows = docs.select("doc_id", "text", *key, *text_key()).join(found, ["x", "y"], "left").select("doc_id", "text", "places", *key, "x", "y")
    return rows.mapInArrow(verify, "doc_id long, n_words long, spans array<struct<item_id: string, start: int, length: int>>" + ", row long" * len(key) + ", x long, y long")


def benchmark_matches(docs: DataFrame, tests: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, x, y (hashes of the text), n_words, spans (item_id, start, length) of every document: where windows of test items lie in it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = tests.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // MOST_TEST_BYTES) or 1
    if blocks > 1:  # results of the blocks meet by row, as ids may be null or repeated
        docs = written(docs.withColumn("row", F.monotonically_increasing_id()), "documents")
    result = None
    for k in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow().combine_chunks()
        text = rows.column("text").chunk(0) if rows.num_rows else pa.array([], pa.string())
        words = split(text)
        chosen = anchors(words, document_frequencies(docs, words.distinct), size)
        index = written(positional_index(docs, words.distinct.take(pa.array(np.unique(words.codes[chosen])))), "index")
        hits = matched(docs, candidates(index, words, chosen), words, rows.column("item_id").chunk(0) if rows.num_rows else text, size)
        result = hits if result is None else result.union(hits)
    if blocks > 1:
        merged = result.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("x").alias("x"), F.first("y").alias("y"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"))
        result = merged.select("doc_id", "x", "y", "n_words", "spans")
    return result


def covered(spans: str = "spans") -> Column:
    """Words that spans (item_id, start, length) cover, each once."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["length"]).alias("end"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    add = lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).alias("n"))
    return F.aggregate(ordered, zero, add, lambda acc: acc["n"].cast("long"))


def contamination(docs: DataFrame, tests: DataFrame, size: int = 13, percent: int = 5) -> DataFrame:
    """doc_id, x, y (hashes of the text), n_words, n_hit, n_items, item_ids, contaminated of every document: hit words, items with
    windows in it, and whether at least `percent` of its words are hit."""
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("spans", lambda x: x["item_id"]), lambda x: x.isNotNull())))
    hits = benchmark_matches(docs, tests, size).select("doc_id", "x", "y", "n_words", covered().alias("n_hit"), ids.alias("item_ids"))
    bad = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return hits.select("doc_id", "x", "y", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", bad.alias("contaminated"))


def clean_documents(docs: DataFrame, tests: DataFrame, size: int = 13, percent: int = 5) -> DataFrame:
    """The rows of docs, with all columns, whose texts aren't contaminated. Rows are judged by their texts, so ids may be null or repeated."""
    bad = written(contamination(docs, tests, size, percent).where("contaminated").select("x", "y").distinct(), "contaminated")
    few = bad.count() <= MOST_CONTAMINATED
    key = F.struct(F.xxhash64(F.col("text").cast("string")).alias("x"), F.xxhash64(F.lit(7), F.col("text").cast("string")).alias("y"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("k"))
    rows = rows.join(F.broadcast(bad) if few else bad, (F.col("k.x") == bad["x"]) & (F.col("k.y") == bad["y"]), "left_anti")
    return rows.select("row.*")


def proximity_matches(index: DataFrame, phrases: DataFrame, within: int) -> DataFrame:
    """phrase_id, doc_id, position: where all words of a phrase (phrase_id, words) occur, in any order, no farther than
    `within` words from one occurrence of the word that is rarest in the index.

    Postings meet by (phrase, document), so a group is no larger than a document. A document is known by its id and the hashes of its text, so rows that
    share an id, or have none, are matched each by its own text; rows equal in both give their matches once.
    """
    asked = phrases.select("phrase_id", F.explode(F.array_distinct("words")).alias("word"), F.size(F.array_distinct("words")).alias("need"))
    rows = index.join(asked, "word").dropDuplicates(["phrase_id", "word", "doc_id", "x", "y"])
    often = rows.groupBy("phrase_id", "word").agg(F.count("*").alias("often"))
    lists = rows.join(often, ["phrase_id", "word"]).groupBy("phrase_id", "doc_id", "x", "y").agg(F.first("need").alias("need"), F.sort_array(F.collect_list(F.struct("often", "word", "positions"))).alias("lists"))
    near = lambda p: F.forall("lists", lambda x: F.exists(x["positions"], lambda q: F.abs(q - p) <= within))
    whole = lists.where(F.size("lists") == F.col("need"))
    return whole.select("phrase_id", "doc_id", F.explode(F.filter(F.get(F.col("lists"), F.lit(0))["positions"], near)).alias("position"))
