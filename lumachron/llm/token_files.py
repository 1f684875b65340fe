"""Token ids as Parquet list columns that allow selective reads.

Files hold documents in ascending id order, one range of ids a file: the id and the number of tokens delta-encoded, the
token list dictionary-encoded (a row group's distinct ids become a dictionary, its pages bit-packed indices). Row groups
and pages are bounded, and the writer adds column and offset indexes, so a reader that wants some documents or only
metadata skips the other pages and columns.

A null or empty text is the end id alone. Documents with the same id keep rows of their own, in no stated order among
each other. Columns other than the id and the text are not stored. A null id comes first.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .words import BLANKS, LOWER, flat_text, gather_ranges, slices, split_words

#: Words whose ids a worker remembers.
REMEMBERED = 400_000
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 2_000
#: Input bytes of a file, at most and, where there are few files, at least.
FILE_BYTES, LEAST_BYTES = 128 << 20, 1 << 20
FILE_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


#: A letter or digit beside a full stop, comma and the like: the tokenizer's pattern never joins them.
PLAIN = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
STOPS = np.isin(np.arange(256), [ord(c) for c in ".,;!?"])
CUTS = (PLAIN[:, None] & STOPS[None, :]) | (STOPS[:, None] & PLAIN[None, :])


#: The normalizer and the splitting of the tokenizer files for which words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def by_words(path: str) -> bool:
    """Whether the tokenizer of a file encodes runs without ASCII blanks on their own, in either case, and cuts at stops."""
    with open(path, encoding="utf-8") as file:
        it = json.load(file)
    model = it["model"]
    plain = model["type"] == "BPE" and not model.get("dropout") and model.get("continuing_subword_prefix") is None
    splits = it["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTE_LEVEL]}
    return plain and splits and it["normalizer"] == NORMALIZER and all(x["content"].startswith("<|") for x in it["added_tokens"])


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [i for i in range(256) if i not in shown]
    return {i: chr(i) for i in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokens:
    """Ids by the tokenizers library. If the tokenizer drops white space and tokenises what lies between on its own, each
    distinct run without ASCII blanks is encoded once; lower-case Latin letters go straight to the library's model, as all
    that comes before it leaves them as they are. By any other tokenizer whole texts are encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.letters, self.by_words = self.library.model, byte_letters(), by_words(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        ids: list[list[int]] = [[]] * len(words)
        others, tokenize, number = [], self.model.tokenize, attrgetter("id")
        for k, word in enumerate(words):
            if word.isalpha() and word.islower():  # ASCII alone, as these are bytes
                ids[k] = list(map(number, tokenize(word.decode())))
                continue
            text = word.decode()
            if text.isalpha() and text.islower() and max(text) < "\u0180":
                ids[k] = list(map(number, tokenize(word.decode("latin-1").translate(self.letters))))
            else:
                others.append((k, text))
        for at in range(0, len(others), 4096):
            some = others[at : at + 4096]
            for (k, _), x in zip(some, self.library.encode_batch_fast([t for _, t in some], add_special_tokens=False)):
                ids[k] = x.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())))
        self.sizes = np.append(self.sizes, sizes)

    def encode(self, texts: pa.Array, end: int | None) -> pa.ListArray:
        if not self.by_words:
            found = [x.ids + ([] if end is None else [end]) for x in self.library.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            return pa.array(found, pa.list_(pa.int32()))
        special = b"<|" in flat_text(texts)[0].tobytes()  # a special token's case counts
        words = split_words(texts, BLANKS, None if special else LOWER, CUTS)
        distinct = words.distinct.to_pylist()
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        if new := [w for w in distinct if w not in self.known]:
            self.learn(new)
        word = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[words.codes] if distinct else words.codes
        tokens = self.ids[gather_ranges(self.starts[word], self.sizes[word])]
        at = np.append(0, np.cumsum(self.sizes[word]))[words.at]
        if end is not None:
            tokens, at = np.insert(tokens, at[1:], end), at + np.arange(len(at))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens, pa.int32()))


def input_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of the files that docs are read from, which takes no column; of the texts, if docs aren't read from files."""
    try:
        files = docs.select("_metadata.file_path", "_metadata.file_size").distinct()
        return files.agg(F.sum("file_size")).first()[0] or 0
    except AnalysisException:
        return docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes the whole texts and writes them to `path`, files and rows in ascending order of the id.

    One shuffle: texts (smaller than their ids) are dealt by range of the id, and of a row number where many have one id; the
    measured bytes of the input decide how many files there are. A worker encodes a bounded slice at a time.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokens(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = coder.encode(part.column(1), end)
                sizes = np.diff(np.asarray(ids.offsets)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), ids], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    total = input_bytes(docs, text)
    files = max(1, -(-total // FILE_BYTES), min(2 * docs.sparkSession.sparkContext.defaultParallelism, total // LEAST_BYTES))
    (
        rows.repartitionByRange(files, "doc_id", "row")
        .sortWithinPartitions("doc_id", "row")
        .drop("row")
        .mapInArrow(encode, FILE_SCHEMA)
        .write.option("parquet.writer.version", "v2")  # delta encoding where there is no dictionary
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids"), low: int | None = None, high: int | None = None) -> DataFrame:
    """The stored columns asked for, of documents low to high (both included): both reach the scan."""
    df = spark.read.schema(FILE_SCHEMA).parquet(path)
    if low is not None:
        df = df.where(F.col("doc_id") >= low)
    if high is not None:
        df = df.where(F.col("doc_id") <= high)
    return df.select(*columns)


def with_starts(rows: DataFrame) -> DataFrame:
    """rows (doc_id, n_tokens, file and more) with `start`, the tokens of all documents before: from metadata alone.

    Files are ranges of ids, so a running sum within each file and the totals of the files before it suffice; of all
    files together only one row each is sorted.
    """
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"), F.count("doc_id").alias("known"))
    order = Window.orderBy(F.col("known") > 0, "least", "greatest", "file").rowsBetween(Window.unboundedPreceding, 0)
    before = files.select("file", (F.sum("total").over(order) - F.col("total")).alias("before"))
    inner = Window.partitionBy("file").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum("n_tokens").over(inner)).join(before, "file").withColumn("start", F.col("before") + F.col("upto") - F.col("n_tokens")).drop("before", "upto")


def document_sums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, n_tokens, ids_crc32 of each stored document, from the stored ids: the checksum is of the ids as
    little-endian unsigned 32-bit integers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            at = np.asarray(ids.offsets).astype(np.int64) * 4
            raw = memoryview(np.ascontiguousarray(np.asarray(ids.values), "<u4").view(np.uint8))
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(at) // 4, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "file", "n_tokens", "ids_crc32"])

    stored = spark.read.schema(FILE_SCHEMA).parquet(path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"))
    return stored.mapInArrow(sums, "doc_id long, file string, n_tokens long, ids_crc32 long")
