"""N-gram Jaccard join: parity sketches, pigeonhole candidates, exact verification, linked classes.

A document's set is its distinct word shingles. Each set becomes a parity sketch: a long bit vector in which every
shingle flips one bit, kept sparsely as P cells of 2^57 bits, a cell being known by the XOR of the hashes of its bits.
A shingle in one set alone changes one cell at most, so the number of unequal cells, like the Hamming distance of the
bits, is a lower bound of the symmetric difference. Two sets of sizes a and b with similarity s or more differ in at
most (1 - s) / (1 + s) * (a + b) shingles, d of them, so at least P - d cells are equal: of the d + 1 cells that come first
in one order for all documents, two such sets share one (pigeonhole). P goes by size band; a set near a band's border
is sketched in both bands. The order puts cells made of very common shingles last and fuller ones first, so that the
cells chosen are rare; it needs no exactness, as any common order finds all pairs.

Copies are one node, known by a fingerprint. Nodes of a small cell become pairs; those of a larger one a family with a pivot,
compared with two members first, and then, in blocks of sketches, across the classes found so far. So a large group of
near copies never becomes all its pairs, and no pair that could join two classes is left out. Dense sketches refuse pairs
by their Hamming distance before texts are fetched. Cells of common shingles only don't pair two documents of which both
have so many rare shingles that similar ones must share one: these meet in cells of the widest sketch, of one shingle each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import scratch, written
from .words import BLANKS, gather_ranges, mixed, sequence_hash, shingle_hashes, slices, split_words

#: Least and most bits of the dense sketches that pairs are refused by; a set has about two bits a shingle.
DENSE_BITS = 512, 65536
#: Most shingles that the broadcast list of common ones may have (8 bytes each).
MOST_COMMON = 250_000
#: A shingle is looked at as common if this many documents of one slice have it.
COMMON_IN_SLICE = 6
#: Rows of a few numbers (some 30 MB in memory) up to which they are broadcast.
FEW = 300_000
#: Members up to which a family is compared as a whole; those of larger ones meet in blocks.
SMALL = 64
#: Pairs whose sketches are compared at once.
PAIRS_AT_ONCE = 20_000
#: Nodes of a block in which a family's sketches are compared; families of more than 64 * LEAST_BLOCK have larger blocks.
LEAST_BLOCK, MOST_BLOCK = 256, 4096
#: Added to the level of families of cells of common shingles.
HOT = 64
#: Documents of one band: sizes from 16^k up to 16^(k + 1).
BAND_BASE = 16


def document_sets(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Of each text: its distinct shingles as sorted 64-bit hashes, and a 128-bit fingerprint of its words (0, 0: none)."""
    words = split_words(texts, BLANKS)
    hashes = words.hashes()
    windows = shingle_hashes(hashes, size)
    for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist()):
        own = hashes[a:b]
        if b - a >= size:
            found = np.unique(windows[a : b - size + 1])
        else:
            found = mixed(np.array([sequence_hash(own, 7)] if b > a else [], np.uint64))
        yield found, sequence_hash(own, 1) if b > a else 0, sequence_hash(own, 2) if b > a else 0


def common_shingles(docs: DataFrame, size: int, most: int = MOST_COMMON) -> np.ndarray:
    """Hashes of the shingles most documents have, `most` at most: each slice of texts is counted by itself, and what is
    common in it is summed up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                seen, sets = set(), []
                for found, one, two in document_sets(part.column(0), size):
                    if (one, two) not in seen:
                        seen.add((one, two))
                        sets.append(found)
                key, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                often = n >= COMMON_IN_SLICE
                yield pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["shingle", "n"])

    counted = written(docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "common")
    by_count = counted.groupBy(F.floor(F.log2("n") * 8).alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    least, total = None, 0
    for row in by_count:
        total += row["n"]
        if total > most:
            break
        least = row["level"]
    if least is None:
        return np.zeros(0, np.uint64)
    rows = counted.where(F.floor(F.log2("n") * 8) >= least).select("shingle").toArrow()
    return np.sort(np.concatenate([np.asarray(x) for x in rows.column(0).chunks]).view(np.uint64))


def cells(found: np.ndarray, content: np.ndarray, rare: np.ndarray, band: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the `first` cells of a set's sketch in a band, in the order that all documents use, and which of them are
    made of common shingles only. The order goes by a cell's content alone."""
    p = max(16, BAND_BASE ** (band + 1) // 2)
    cell = (found % np.uint64(p)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    value = np.bitwise_xor.reduceat(content[order], starts)
    count = np.diff(np.append(starts, len(cell)))
    rarely = np.add.reduceat(rare[order], starts)
    key = mixed(value + mixed(cell[starts].astype(np.uint64) * np.uint64(64) + np.uint64(band)))
    chosen = np.lexsort((key, -count, -rarely))[:first]
    keys, hot = key[chosen], rarely[chosen] == 0
    if len(keys) < first:  # empty cells come last
        empty = np.setdiff1d(np.arange(p), cell[starts])[: first - len(keys)]
        keys = np.append(keys, mixed(mixed(empty.astype(np.uint64) * np.uint64(64) + np.uint64(band))))
        hot = np.append(hot, np.ones(len(empty), bool))
    return keys, hot


def parity_width(n: int) -> int:
    """Bits of the dense sketch of a set of n shingles."""
    width = DENSE_BITS[0]
    while width < 2 * n and width < DENSE_BITS[1]:
        width *= 2
    return width


def dense_sketch(found: np.ndarray) -> bytes:
    """Parities of the shingles by a hash; folding its halves on each other gives the sketch of half the width."""
    width = parity_width(len(found))
    bits = np.bincount((mixed(found + np.uint64(11)) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Dense sketches of one width, of at least `width` bytes, as rows of that many bytes."""
    rows = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while rows.shape[1] * 8 > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Hamming distance of each two dense sketches, by the narrower width."""
    sizes, far = np.array([[len(x), len(y)] for x, y in zip(left, right)]).reshape(-1, 2), np.zeros(len(left), np.int64)
    for a, b in np.unique(sizes, axis=0).tolist():
        rows = np.flatnonzero((sizes == (a, b)).all(1)).tolist()
        x, y = folded([left[i] for i in rows], min(a, b)), folded([right[i] for i in rows], min(a, b))
        far[rows] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return far


def chosen_cells(found: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The cells of a set in all bands where a similar set may be: rare ones, and those of common shingles only; and
    whether the set is distinct, so that two distinct ones need no common cells to meet.

    If the shares of rare shingles in two sets are such that, rare shingles being unequal, the difference were already too large, similar
    sets must have a rare shingle in common. A distinct set so adds cells of the widest sketch, in which each shingle has a
    cell of its own; of its rare shingles as many as a similar set may lack, and one more, in an order for all sets.
    """
    k = len(found)
    # sizes that can be similar: from k * percent / 100 to k * 100 / percent
    most = (100 - percent) * (k + k * 100 // percent) // (100 + percent)
    low, high = band_of(-(-k * percent // 100)), band_of(k * 100 // percent)
    content = mixed(found ^ np.uint64(0x5851F42D4C957F2D))
    rare = (common[np.minimum(np.searchsorted(common, found), len(common) - 1)] != found).astype(np.int64) if len(common) else np.ones(k, np.int64)
    parts = [cells(found, content, rare, band, most + 1) for band in range(low, high + 1)]
    keys, hot = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    distinct = bool(hot.any()) and int(rare.sum()) * (100 + percent) > (100 - percent) * k
    single = np.sort(mixed(content[rare == 1] + np.uint64(0x9E3779B97F4A7C15)))[: k * (100 - percent) // 100 + 1] if distinct else np.zeros(0, np.uint64)
    return np.concatenate((keys[~hot], single)), keys[hot], distinct


def sketches(docs: DataFrame, common: np.ndarray, size: int, percent: int) -> DataFrame:
    """A row for each document: doc_id, x, y (hashes of the text), one, two (fingerprint), n_shingles, dense, cells, hot_cells, distinct;
    of copies within one slice only the first has cells."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in parts])), pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, none = shared.value, np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                seen: set[tuple[int, int]] = set()
                one, two, n, dense, keys = [], [], [], [], []
                for found, a, b in document_sets(part.column(3), size):
                    fresh = len(found) > 0 and (a, b) not in seen
                    seen.add((a, b))
                    keys.append(chosen_cells(found, common, percent) if fresh else (none, none, False))
                    dense.append(dense_sketch(found) if fresh else None)
                    one.append(a)
                    two.append(b)
                    n.append(len(found))
                columns = [*part.columns[:3], *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)), pa.array(n, pa.int64()), pa.array(dense, pa.binary()), *(lists([x[i] for x in keys]) for i in (0, 1)), pa.array([x[2] for x in keys])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "x", "y", "one", "two", "n_shingles", "dense", "cells", "hot_cells", "distinct"])

    kind = "doc_id long, x long, y long, one long, two long, n_shingles long, dense binary, cells array<long>, hot_cells array<long>, distinct boolean"
    return docs.select("doc_id", *text_key(), "text").mapInArrow(sketch, kind)


def text_key(text: Column | str = "text") -> list[Column]:
    """Two hashes, x and y, that a text is known by."""
    return [F.xxhash64(text).alias("x"), F.xxhash64(F.lit(7), text).alias("y")]


def broadcast_if_few(table: DataFrame) -> DataFrame:
    """A written table with a hint to broadcast it, if it has few rows."""
    return F.broadcast(table) if table.count() <= FEW else table


def band_of(n: int) -> int:
    band = 0
    while BAND_BASE ** (band + 1) <= n:
        band += 1
    return band


def with_nodes(sketched: DataFrame) -> DataFrame:
    """Documents with shingles, and the node that stands for all copies: the fingerprint's first half, or, where two fingerprints share that, a hash of both."""
    some = sketched.where("n_shingles > 0")
    unsure = written(some.groupBy("one").agg(F.min("two").alias("x"), F.max("two").alias("y")).where("x <> y").select("one"), "unsure")
    if unsure.isEmpty():
        return some.withColumn("node", F.col("one"))
    marked = some.join(broadcast_if_few(unsure).withColumn("twice", F.lit(True)), "one", "left")
    return marked.withColumn("node", F.when(F.col("twice"), F.xxhash64("one", "two")).otherwise(F.col("one"))).drop("twice")


def candidates(some: DataFrame) -> DataFrame:
    """a, b, level, distinct: nodes that share a cell.

    The single large shuffle: 16 bytes a cell. A cell of two nodes gives that pair, as a row of level 0. The nodes of another cell
    become members b of a family, known by a pivot a (that member of the cell whose hash is least) and by a level (the
    magnitude of the cell). As near copies share many cells of similar nodes and so the pivot, their cells fall into few
    families, and rows grow with the documents. Cells of common shingles only, which may have very many nodes, skip the
    windows and meet in partial aggregates; their families are apart, with pivots that aren't distinct.
    """
    cell, first = Window.partitionBy("cell"), F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("pivot"))
    rare = some.select("node", F.explode("cells").alias("cell"))
    rare = rare.withColumns({"least": F.min("node").over(cell), "greatest": F.max("node").over(cell)}).where("least < greatest").select("node", "cell")
    rare = rare.withColumns({"k": F.count("*").over(cell), "pivot": F.min(first).over(cell)["pivot"]})
    level = F.ceil(F.log2("k")).cast("int")
    rare = rare.where("k > 2 or node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), F.when(F.col("k") > 2, level).otherwise(0).alias("level"), F.lit(False).alias("distinct"))
    hot = some.select("node", "distinct", F.explode("hot_cells").alias("cell"))
    least = F.min(F.struct("distinct", F.xxhash64("node").alias("h"), F.col("node").alias("pivot")))
    crowds = written(hot.groupBy("cell").agg(least.alias("p"), F.min("node").alias("least"), F.max("node").alias("greatest"), F.count("*").alias("k")).where("least < greatest and not p.distinct").select("cell", F.col("p.pivot").alias("a"), (level + HOT).alias("level")), "crowds")
    hot = hot.join(broadcast_if_few(crowds), "cell").select("a", F.col("node").alias("b"), "level", "distinct")
    return rare.union(hot).distinct()


def with_sides(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, textA, textB of pairs (a, b). Pairs are written; few of them are sent to where the texts are, so that only
    texts named in pairs move; and texts move to pairs, so a hub's pairs lie apart."""
    few = pairs.count() <= FEW

    def side(x: str) -> DataFrame:
        own = texts.select(F.col("node").alias(x), F.col("text").alias(f"text{x.upper()}"))
        return own.join(F.broadcast(pairs) if few else pairs, x)

    return side("a").join(side("b").hint("merge"), ["a", "b"]).select("a", "b", "textA", "textB")


def near_enough(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of similar sizes whose dense sketches are no farther apart than their sizes allow."""

    def refuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield batch.select([0, 1]).filter(pa.array((100 + percent) * far <= (100 - percent) * np.asarray(batch.column(4))))

    side = lambda x: sets.select(F.col("node").alias(x), *[F.col(c).alias(c + x.upper()) for c in ("n", "dense")])
    joined = side("b").join(broadcast_if_few(pairs), "b").join(side("a").hint("merge"), "a")  # one sketch a pair moves
    sized = joined.where((F.col("nA") * 100 >= F.col("nB") * percent) & (F.col("nB") * 100 >= F.col("nA") * percent))
    return sized.select("a", "b", "denseA", "denseB", (F.col("nA") + F.col("nB")).alias("n")).mapInArrow(refuse, "a long, b long")


def similar(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union holds; whole texts are compared."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            for part in slices(batch, "textB"):
                keep = []
                for a, text, (y, _, _) in zip(part.column(0).to_pylist(), part.column(2), document_sets(part.column(3), size)):
                    if a != last:
                        last, x = a, next(document_sets(pa.array([text.as_py()], pa.string()), size))[0]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return with_sides(pairs, texts).mapInArrow(verify, "a long, b long")


def classes(links: DataFrame) -> DataFrame:
    """node, root: the least node reachable by links (a, b), for each node with a link.

    Rounds of the star algorithm: larger neighbours of a node move to its least neighbour, until every node hangs at
    its root; keys are nodes, the least neighbour comes from a partial aggregate, and a hub's rows are split by join.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = edges.count()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u hang at the least of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: of the neighbours below u, all but the least hang at the least, and so does u
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = written(small, "edges")
        n, same = now.count(), now.join(edges, ["u", "v"], "left_semi").count()
        if n == same == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges, before = now, n


def second_pivots(families: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member of a family with one more member that isn't distinct, in families that aren't small."""
    least = F.min(F.struct("distinct", F.xxhash64(F.lit(3), "b").alias("h"), F.col("b").alias("p"))).alias("p")
    of = families.groupBy("a", "level").agg(least, F.count("*").alias("k")).where(f"not p.distinct and k > {SMALL}").select("a", "level", "p.p")
    return families.join(broadcast_if_few(written(of, "second")), ["a", "level"]).where("b <> p").select(F.least("b", "p").alias("a"), F.greatest("b", "p").alias("b"))


def across_classes(families: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one family but of different classes, of which sizes and dense sketches allow a link.

    A small family lies in one place. A larger one's members meet, in blocks, those outside of the family's largest class, or those that aren't distinct, whichever
    are fewer: two members of the largest class need no link, and two distinct ones have none by this family. Sketches are
    compared where they lie, so refused pairs are never rows.
    """

    def whole(part: pa.RecordBatch) -> pa.RecordBatch:
        """The pairs of whole families, which lie one after another."""
        edge = np.append(True, np.diff(np.asarray(part.column(0))) != 0) | np.append(True, np.diff(np.asarray(part.column(1))) != 0)
        ends = np.append(np.flatnonzero(edge)[1:], part.num_rows)[np.cumsum(edge) - 1]
        rows = np.arange(part.num_rows)
        i, j = np.repeat(rows, ends - rows - 1), gather_ranges(rows + 1, ends - rows - 1)
        node, n, c, u = (np.asarray(part.column(k)) if k < 5 else part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5))
        kept = (c[i] != c[j]) & (n[i] * 100 >= n[j] * percent) & (n[j] * 100 >= n[i] * percent) & ~(u[i] & u[j])
        i, j = i[kept], j[kept]
        dense, near = part.column(6).to_pylist(), np.zeros(len(i), bool)
        for at in range(0, len(i), PAIRS_AT_ONCE):
            x, y = i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]
            far = distances([dense[k] for k in x.tolist()], [dense[k] for k in y.tolist()])
            near[at : at + PAIRS_AT_ONCE] = (100 + percent) * far <= (100 - percent) * (n[x] + n[y])
        a, b = node[i[near]], node[j[near]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def by_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            last = np.flatnonzero((np.asarray(rows.column(0)) != rows.column(0)[-1].as_py()) | (np.asarray(rows.column(1)) != rows.column(1)[-1].as_py()))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last family may go on
            if cut:
                yield whole(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield whole(held)

    def compare(docs: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        docs, found = docs.sort_values("n"), [np.zeros((0, 2), np.int64)]
        for width, part in docs.groupby(docs["dense"].map(len)):
            node, n, c, u = (part[k].to_numpy() for k in ("node", "n", "c", "distinct"))
            for wide, other in others.groupby(others["dense"].map(len)):
                x, y = folded(part["dense"].tolist(), min(width, wide)), folded(other["dense"].tolist(), min(width, wide))
                for k, (p, m, of, v) in enumerate(zip(other["node"].tolist(), other["n"].tolist(), other["c"].tolist(), other["distinct"].tolist())):
                    i, j = np.searchsorted(n, -(-m * percent // 100)), np.searchsorted(n, m * 100 // percent, "right")
                    far = np.bitwise_count(x[i:j] ^ y[k]).sum(1, dtype=np.int64)
                    near = ((100 + percent) * far <= (100 - percent) * (n[i:j] + m)) & (c[i:j] != of)
                    hit = node[i:j][near & ~u[i:j] if v else near]
                    found.append(np.stack((np.minimum(hit, p), np.maximum(hit, p)), 1))
        return pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    rows = families.join(known.select(F.col("node").alias("b"), "root"), "b", "left").select("a", "level", F.col("b").alias("node"), "distinct", F.coalesce("root", "b").alias("c"))
    rows = written(rows, "members")
    crowds = rows.groupBy("a", "level", "c").agg(F.count("*").alias("n"), F.sum((~F.col("distinct")).cast("long")).alias("plain"))
    sums = crowds.groupBy("a", "level").agg(F.count("*").alias("classes"), F.sum("n").alias("k"), F.sum("plain").alias("plain"), F.max(F.struct("n", "c")).alias("most")).where("classes > 1 and plain > 0")
    outside = F.col("k") - F.col("most.n")
    block = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("k") / 64)))
    sums = sums.select("a", "level", "k", F.col("most.c").alias("largest"), (F.col("plain") < outside).alias("by_plain"), F.ceil(F.col("k") / block).alias("nl"), F.ceil(F.least("plain", outside) / block).alias("nr"))
    rows = written(rows.join(broadcast_if_few(written(sums, "crowds")), ["a", "level"]), "mixed")
    rows = rows.join(sets.select("node", "n", "dense"), "node")
    some = rows.where(F.col("k") <= SMALL).select("a", "level", "node", "n", "c", "distinct", "dense")
    near = some.repartition("a", "level").sortWithinPartitions("a", "level").mapInArrow(by_families, "a long, b long")
    rows = rows.where(F.col("k") > SMALL)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("long")
    columns = ["node", "n", "c", "distinct", "dense"]
    left = rows.select("a", "level", own("nl").alias("i"), every("nr").alias("j"), *columns)
    right = rows.where(F.when(F.col("by_plain"), ~F.col("distinct")).otherwise(F.col("c") != F.col("largest"))).select("a", "level", every("nl").alias("i"), own("nr").alias("j"), *columns)
    key = ["a", "level", "i", "j"]
    right = right.select(*[F.col(c).alias(c) for c in [*key, *columns]])  # columns of its own, for the cogroup
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "a long, b long").union(near).distinct()


def node_classes(docs: DataFrame, some: DataFrame, size: int, percent: int) -> DataFrame:
    """node, root of the nodes with links.

    Two rounds, whatever the data are: pairs of small cells, and members of families with two pivots, are verified and
    make classes; then members of a family that are of different classes meet, all of them, so no link is left out.
    """
    found = written(candidates(some), "candidates")
    families = found.where("level > 0")
    direct = found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(direct.union(second_pivots(families)).distinct(), "pairs")
    needed = broadcast_if_few(written(found.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed"))
    sketch = F.min(F.struct(F.col("n_shingles").alias("n"), "dense", "x", "y")).alias("s")
    sets = written(some.where("dense is not null").join(needed, "node", "left_semi").groupBy("node").agg(sketch).select("node", "s.*"), "sets")
    near = written(near_enough(pairs, sets, percent), "near")
    both = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        """node, text; few of the nodes' keys are sent to the documents, so that only their texts move."""
        keys = broadcast_if_few(written(nodes.distinct().join(sets.select("node", "x", "y"), "node"), "of_texts"))
        return written(docs.select("text", *text_key()).join(keys, ["x", "y"]).groupBy("node").agg(F.min("text").alias("text")), "texts")

    # documents are read for each round while few texts are wanted; beyond that once, for all members of families
    wanted = written(both(near).union(families.select(F.col("b").alias("node"))).distinct(), "wanted")
    texts = texts_of(both(near) if wanted.count() <= FEW else wanted)
    known = written(classes(similar(near, texts, size, percent)), "classes")
    more = written(across_classes(families, known, sets, percent).join(near, ["a", "b"], "left_anti"), "near")
    if more.isEmpty():
        return known
    texts = texts_of(both(more)) if wanted.count() <= FEW else texts
    links = known.select(F.col("node").alias("a"), F.col("root").alias("b")).union(similar(more, texts, size, percent))
    return classes(links)


def with_components(sketched: DataFrame, some: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, chosen, x, y of all sketched rows, as `jaccard_classes` gives, by the nodes of those with shingles and
    the roots of linked nodes."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x", "y")
    nodes = written(some.groupBy("node").agg(F.min(first).alias("first"), F.count("*").alias("copies")), "nodes")
    linked = nodes.join(known, "node")
    least = linked.groupBy("root").agg(F.min("first").alias("first"))
    of_class = linked.select("node", "root").join(least, "root").select("node", "first")
    alone = nodes.where("copies > 1").join(known, "node", "left_anti").select("node", "first")
    groups = broadcast_if_few(written(of_class.union(alone), "groups"))  # a row that is alone in its class isn't in it
    rows = some.select("doc_id", "n_shingles", "node", "x", "y").join(groups, "node", "left")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("x") == F.col("first.x")) & (F.col("y") == F.col("first.y"))
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    judged = rows.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("first").isNull() | same).alias("chosen"), "x", "y")
    empty = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("chosen"), "x", "y")
    return judged.union(empty)


def jaccard_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, chosen, x, y of each row: the size of its set, and the least doc_id reachable by links.

    Words are runs without ASCII blanks, A-Z lower-cased; a text of fewer words than `size` is one shingle. Null or
    wordless texts have no shingles and link with nothing. Rows are told apart by their texts, not by their ids: each row
    of a repeated id is judged by its own text, and a class's component_id is null only if none of its rows has an id.
    chosen marks the rows of a class's least (doc_id, x, y), x and y being hashes of the text (ids before null), and all rows
    without shingles. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = written(sketches(docs, common_shingles(docs, size), size, percent), "sketches")
    some = with_nodes(sketched)
    with scratch(docs.sparkSession):
        known = written(node_classes(docs, some, size, percent), "classes", keep=True)
    return with_components(sketched, some, known)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those that another row of their class stands for: a class keeps its chosen row, one of them if they are equal
    in id and text; rows without shingles all stay. All columns are kept."""
    found = written(jaccard_classes(docs, size, percent), "judged")
    dropped = broadcast_if_few(written(found.where("not chosen").select("doc_id", "x", "y").distinct(), "dropped"))
    repeated = written(found.where("chosen and n_shingles > 0").groupBy("doc_id", "x", "y").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    text = F.col("text").cast("string")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), *text_key(text)).alias("k"))

    def meet(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(keys, F.col("k.doc_id").eqNullSafe(keys["doc_id"]) & (F.col("k.x") == keys["x"]) & (F.col("k.y") == keys["y"]), how)

    kept = meet(own, dropped, "left_anti")
    if not repeated.isEmpty():
        repeated = broadcast_if_few(repeated)
        kept = meet(kept, repeated, "left_anti").select("row").union(meet(kept, repeated, "left_semi").groupBy("k").agg(F.first("row").alias("row")).select("row"))
    return kept.select("row.*")
