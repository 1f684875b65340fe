"""MinHash near-dedup: universal hash minima, bands, verification, and connected components by alternating stars.

A document's set is its distinct word shingles. Its signature is the least value of each of BANDS * BAND_ROWS universal hashes
over the whole set; two sets have as many equal minima as they are similar, on average. Minima go by bands: two documents
of which all minima of a band are equal share a bucket. At a similarity of 0.85 a pair misses all 40 bands with a chance of 2e-13.

Copies are one node, known by a fingerprint. A bucket is known by its least node, the pivot, and by the magnitude of its
size; buckets of near copies have few pivots, so their rows are few. First each node meets the least of its pivots:
signatures (a byte of each minimum) refuse, whole sets verify, and stars make classes. Then members of a bucket that are still
of different classes meet each other, all of them: large families in blocks, small ones many to a task. Signatures
tell which members have a counterpart at all, and only these move with their texts; a block gives the verified links
that join its classes, no more, so neither refused pairs nor the pairs of a class are ever rows. No partner is left out.
Signatures refuse a pair of similarity 0.85 with a chance below 1e-9.

Words are runs without ASCII blanks, A-Z lower-cased; a text of fewer words than a shingle is one. Null, empty and wordless texts
have no shingles and link with nothing. Rows are told apart by their texts, so ids may be null or repeated. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard_join import broadcast_if_few, classes, document_sets, similar, text_key, with_components, with_nodes
from .shared import scratch, written
from .words import gather_ranges, mixed, slices

BANDS, BAND_ROWS = 40, 4
MINIMA = BANDS * BAND_ROWS
#: Standard deviations below the expected number of equal minima up to which a pair isn't refused.
SLACK = 7.0
#: Shingles that are hashed at once.
SHINGLES_AT_ONCE = 4096
#: Nodes and shingles of a block, and rows of small families that share a group; families of fewer nodes are small.
BLOCK_NODES, BLOCK_SHINGLES, PACKED, SMALL = 2048, 400_000, 4096, 512

_RANDOM = np.random.default_rng(20181)
_FACTORS = (_RANDOM.integers(0, 1 << 63, MINIMA, np.uint64) << np.uint64(1)) | np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, MINIMA, np.uint64)


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each hash (a x + b) mod 2^64 div 2^32 over a set of shingles."""
    least = np.full(MINIMA, 1 << 32, np.uint64)
    for k in range(0, len(found), SHINGLES_AT_ONCE):
        hashed = _FACTORS[:, None] * found[None, k : k + SHINGLES_AT_ONCE] + _TERMS[:, None]
        np.minimum(least, hashed.min(1) >> np.uint64(32), out=least)
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    """A key for each band."""
    rows = least.reshape(BANDS, BAND_ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def fewest_equal(percent: int) -> int:
    """Equal minima below which a pair is refused."""
    share = percent / 100
    return int(MINIMA * share - SLACK * (MINIMA * share * (1 - share)) ** 0.5)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document: doc_id, x, y (hashes of the text), one, two (fingerprint), n_shingles, signature, bands; of copies within
    one slice only the first has the last two."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                seen: set[tuple[int, int]] = set()
                one, two, n, signature, bands = [], [], [], [], []
                for found, a, b in document_sets(part.column(3), size):
                    fresh = len(found) > 0 and (a, b) not in seen
                    seen.add((a, b))
                    least = minima(found) if fresh else None
                    signature.append(least.astype(np.uint8).tobytes() if fresh else None)
                    bands.append(bands_of(least) if fresh else np.zeros(0, np.uint64))
                    one.append(a)
                    two.append(b)
                    n.append(len(found))
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in bands])), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bands).view(np.int64)))
                columns = [*part.columns[:3], *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)), pa.array(n, pa.int64()), pa.array(signature, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "x", "y", "one", "two", "n_shingles", "signature", "bands"])

    kind = "doc_id long, x long, y long, one long, two long, n_shingles long, signature binary, bands array<long>"
    return docs.select("doc_id", *text_key(), "text").mapInArrow(sketch, kind)


def families(some: DataFrame) -> DataFrame:
    """a, level, node: nodes that share a bucket, known by its least node a and the magnitude of its size.

    Buckets are counted by partial aggregates and joined back, so a large one isn't gathered anywhere.
    """
    rows = some.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("k")).where("a < z")
    shared = shared.select("bucket", "a", F.ceil(F.log2("k")).cast("int").alias("level"))
    return rows.join(shared, "bucket").select("a", "level", "node").distinct()


def near_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of similar sizes that signatures don't refuse."""
    least = fewest_equal(percent)

    def refuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, MINIMA) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= least))

    side = lambda x: sets.select(F.col("node").alias(x), *[F.col(c).alias(c + x.upper()) for c in ("n", "signature")])
    joined = side("b").join(broadcast_if_few(pairs), "b").join(side("a").hint("merge"), "a")
    sized = joined.where((F.col("nA") * 100 >= F.col("nB") * percent) & (F.col("nB") * 100 >= F.col("nA") * percent))
    return sized.select("a", "b", "signatureA", "signatureB").mapInArrow(refuse, "a long, b long")


def crossing(members: DataFrame, payload: list[str], compare: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], kind: str) -> DataFrame:
    """What `compare` gives of each family's members (a, level, node, c, n, payload) of different classes c.

    compare gets the rows of a block of one family, and which of them to hold against which: together the blocks hold all members against those outside of the
    family's largest class. Members of families with one class are left out.
    """
    by_class = members.groupBy("a", "level", "c").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    sums = by_class.groupBy("a", "level").agg(F.count("*").alias("classes"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.max(F.struct("k", "n", "c")).alias("most")).where("classes > 1")
    blocks = lambda k, n: F.ceil(F.greatest(k / F.lit(BLOCK_NODES), n / F.lit(BLOCK_SHINGLES)))
    whole, outside = (F.col("k"), F.col("n")), (F.col("k") - F.col("most.k"), F.col("n") - F.col("most.n"))
    small = (F.col("k") < SMALL) & (F.col("n") < BLOCK_SHINGLES)
    sums = written(sums.select(F.col("a").alias("_a"), F.col("level").alias("_level"), "k", F.col("most.c").alias("largest"), small.alias("small"), blocks(*whole).alias("nl"), blocks(*outside).alias("nr")), "mixed")
    packs = -(-(sums.where("small").agg(F.sum("k")).first()[0] or 0) // PACKED) or 1
    rows = members.join(broadcast_if_few(sums), (F.col("a") == F.col("_a")) & (F.col("level") == F.col("_level")))
    columns = ["a", "level", "node", "c", "n", *payload]
    none, out = F.lit(-1).cast("long"), F.col("c") != F.col("largest")
    packed = rows.where("small").select(F.pmod(F.xxhash64("a", "level"), F.lit(packs)).alias("p"), none.alias("i"), none.alias("j"), F.when(out, 3).otherwise(1).alias("side"), *columns)
    large, p = rows.where("not small"), F.xxhash64("a", "level").alias("p")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = large.select(p, own("nl").alias("i"), every("nr").alias("j"), F.lit(1).alias("side"), *columns)
    right = large.where(out).select(p, every("nl").alias("i"), own("nr").alias("j"), F.lit(2).alias("side"), *columns)

    def each_family(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("a", "ascending"), ("level", "ascending"), ("node", "ascending")]).combine_chunks()
        a, level, side = (np.asarray(rows.column(c)) for c in ("a", "level", "side"))
        edge = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (level[1:] != level[:-1])))
        found = []
        for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(a)]):
            here = side[s:e]
            found.append(compare(rows.slice(s, e - s), np.flatnonzero(here & 1), np.flatnonzero(here & 2)))
        return pa.concat_tables(found)

    return packed.union(left).union(right).groupBy("p", "i", "j").applyInArrow(each_family, kind)


def candidates_of(rows: pa.Table, percent: int, least: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which of some rows (places) may be linked with row r, by sizes and signatures."""
    n = np.asarray(rows.column("n"))
    signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(-1, MINIMA)

    def near(r: int, others: np.ndarray) -> np.ndarray:
        others = others[(n[others] * 100 >= n[r] * percent) & (n[r] * 100 >= n[others] * percent)]
        return others[(signature[others] == signature[r]).sum(1) >= least] if len(others) else others

    return near


def with_counterparts(members: DataFrame, percent: int) -> DataFrame:
    """a, level, node of the members that signatures would link with a member of another class of their family."""
    least = fewest_equal(percent)

    def compare(rows: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.Table:
        near, c = candidates_of(rows, percent, least), np.asarray(rows.column("c"))
        hit = np.zeros(rows.num_rows, bool)
        for r in right.tolist():
            found = near(r, left[c[left] != c[r]])
            hit[found] = True
            hit[r] |= len(found) > 0
        return rows.filter(pa.array(hit)).select(["a", "level", "node"])

    return crossing(members, ["signature"], compare, "a long, level int, node long").distinct()


def joining_links(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked, whole sets compared, and that join different classes of members (with signature and text)."""
    least = fewest_equal(percent)

    def compare(rows: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.Table:
        near, c = candidates_of(rows, percent, least), np.asarray(rows.column("c")).copy()
        node, links = np.asarray(rows.column("node")), []
        sets = [found for found, _, _ in document_sets(rows.column("text").chunk(0), size)]
        many = np.array([len(x) for x in sets])
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        starts, mark = np.cumsum(many) - many, np.zeros(int(code.max(initial=0)) + 1, bool)
        for r in right.tolist():
            others = near(r, left[c[left] != c[r]])
            if not len(others):
                continue
            own = code[starts[r] : starts[r] + many[r]]
            mark[own] = True
            both = np.add.reduceat(mark[code[gather_ranges(starts[others], many[others])]], np.cumsum(many[others]) - many[others], dtype=np.int64)
            mark[own] = False
            for k in others[100 * both >= percent * (many[others] + many[r] - both)].tolist():
                if c[k] != c[r]:
                    links.append((node[k], node[r]))
                    c[c == c[k]] = c[r]
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return crossing(members, ["signature", "text"], compare, "a long, b long")


def node_classes(docs: DataFrame, some: DataFrame, size: int, percent: int) -> DataFrame:
    """node, root of the nodes with links."""
    found = written(families(some), "families")
    needed = broadcast_if_few(written(found.select("node").distinct(), "needed"))
    sketch = F.min(F.struct(F.col("n_shingles").alias("n"), "signature", "x", "y")).alias("s")
    sets = written(some.where("signature is not null").join(needed, "node", "left_semi").groupBy("node").agg(sketch).select("node", "s.*"), "sets")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """node, text; few of the nodes' keys are sent to the documents, so that only their texts move."""
        keys = broadcast_if_few(written(nodes.distinct().join(sets.select("node", "x", "y"), "node"), "of_texts"))
        return written(docs.select("text", *text_key()).join(keys, ["x", "y"]).groupBy("node").agg(F.min("text").alias("text")), "texts")

    first = written(found.where("a < node").groupBy("node").agg(F.min("a").alias("a")).select("a", F.col("node").alias("b")), "first")
    near = written(near_pairs(first, sets, percent), "near")
    links = written(similar(near, texts_of(near.select(F.explode(F.array("a", "b")).alias("node"))), size, percent), "links")
    known = written(classes(links), "classes")
    of_class = F.coalesce("root", "node").alias("c")
    members = found.join(known, "node", "left").select("a", "level", "node", of_class)
    members = written(members.join(sets.select("node", "n", "signature"), "node").select("a", "level", "node", "c", "n", "signature"), "members")
    crossed = written(with_counterparts(members, percent), "crossed")
    if crossed.isEmpty():
        return known
    texts = texts_of(crossed.select("node"))
    some_members = members.join(crossed, ["a", "level", "node"], "left_semi").join(texts, "node").select(*members.columns, "text")
    more = written(joining_links(some_members, size, percent), "links")
    return classes(more.union(known.select("node", "root")))


def minhash_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, chosen, x, y of each row: the size of its set, and the least doc_id reachable by links.

    chosen marks the rows of a class's least (doc_id, x, y), x and y being hashes of the text, and all rows without shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = written(sketches(docs, size), "sketches")
    some = with_nodes(sketched)
    with scratch(docs.sparkSession):
        known = written(node_classes(docs, some, size, percent), "classes", keep=True)
    return with_components(sketched, some, known)
