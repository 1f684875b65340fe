"""Divergences of all pairs of series by blocked products, nearest series by a metric index, and single-linkage clusters.

A series is a vector of its components a and b over frequencies. Series are dealt to tiles, frequencies to chunks; a pair of tiles is a few matrix
products a chunk, with frequencies summed inside, so no row is a pair and frequency: what moves is each tile once a tile
that it meets.

With the weights of the trapezoid on one band, J is a squared distance of these vectors, so its root obeys the triangle
inequality. Distances to a few pivots bound all others from below; `nearest_by_pivots` computes only what the bounds leave.

`single_linkage` merges by Boruvka rounds: every component's least edge to another one, then components joined by them are one. A round
goes over the tiles and gives a row for each series and tile, not for each pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumachron.operators.blocks import written

#: Series of a tile, and frequencies of a chunk, more or less.
TILE, CHUNK = 128, 2048
#: Components of a tile's series that a task of a clustering round holds.
MOST_HELD = 4_000_000
#: alpha (1 - alpha) / 2 pi for alpha 1/2.
FACTOR = 0.25 / (2 * np.pi)
BLOCK = "tile long, chunk long, names array<string>, tops array<long>, a binary, b binary"


def blocks_of(parts: DataFrame, tops: DataFrame | int, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """tile, chunk, names, tops, a, b: matrices (series by frequencies of a chunk) of parts (series_id, freq_id, a, b). tops: each
    series' last frequency (series_id, top), or one of all. Frequencies without a row count as 0. Written."""
    tall = parts.select(F.col("series_id").cast("string").alias("series_id"), F.col("freq_id").cast("long").alias("freq_id"), "a", "b")
    if isinstance(tops, int):
        tall = tall.withColumn("top", F.lit(tops).cast("long"))
        n = tall.select("series_id").distinct().count()
    else:
        tops = written(tops.select(F.col("series_id").cast("string").alias("series_id"), F.col("top").cast("long").alias("top")), "tops")
        tall = tall.join(tops, "series_id")
        n = tops.count()
    tiles = -(-n // tile) or 1
    tall = tall.withColumns({"tile": F.pmod(F.xxhash64("series_id"), F.lit(tiles)), "chunk": F.floor((F.col("freq_id") - 1) / chunk)})

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        names = rows.column("series_id").combine_chunks().dictionary_encode()
        order = np.argsort(np.array(names.dictionary.to_pylist(), object))
        place = np.argsort(order)[np.asarray(names.indices)]
        at = np.asarray(rows.column("freq_id")) - 1 - key[1].as_py() * chunk
        shape, top = (len(order), chunk), np.zeros(len(order), np.int64)
        top[place] = np.asarray(rows.column("top"))
        out = []
        for c in ("a", "b"):
            m = np.zeros(shape)
            m[place, at] = np.asarray(rows.column(c))
            out.append(m.tobytes())
        listed = pa.array([names.dictionary.take(pa.array(order)).to_pylist()], pa.list_(pa.string()))
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), listed, pa.array([top.tolist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in out)], ["tile", "chunk", "names", "tops", "a", "b"])

    return written(tall.groupBy("tile", "chunk").applyInArrow(pack, BLOCK), "tiles")


def own(df: DataFrame) -> DataFrame:
    """df with columns of its own, as the two sides of a cogroup may not share any."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def weights(tops: np.ndarray, chunk: int, width: int, step: float) -> np.ndarray:
    """Weights of the trapezoid for each top: end points count half, nothing beyond the top."""
    k = chunk * width + np.arange(1, width + 1)
    w = np.where((k == 1) | (k == tops[:, None]), 0.5, 1.0) * step
    return np.where(k <= tops[:, None], w, 0.0)


def matrices(block: dict, width: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    shape = len(block["names"]), width
    return block["names"], np.array(block["tops"]), *(np.frombuffer(block[c]).reshape(shape) for c in "ab")


def tile_pairs(blocks: DataFrame, both_ways: bool) -> tuple[DataFrame, DataFrame]:
    """Left and right sides of all tile pairs: each block once for each tile that it meets."""
    tiles = (blocks.agg(F.max("tile")).first()[0] or 0) + 1
    columns = ["chunk", "names", "tops", "a", "b"]
    low, high = (F.lit(0), F.lit(0)) if both_ways else (F.col("tile"), F.col("tile"))
    left = blocks.select(F.col("tile").alias("i"), F.explode(F.sequence(low.cast("long"), F.lit(tiles - 1).cast("long"))).alias("j"), *columns)
    last = F.lit(tiles - 1) if both_ways else high
    right = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("i"), F.col("tile").alias("j"), *columns)
    return left, right


PAIR = "series1 string, series2 string, ix double, iy double, ixy double"


def product(left: dict, right: dict, width: int, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], list[str]]:
    """Ix, Iy and Ixy of one chunk for two blocks, on the band of the left series."""
    names, tops, a, b = matrices(left, width)
    others, _, a2, b2 = matrices(right, width)
    w = weights(tops, left["chunk"], width, step)
    ix = (w * 0.5 * (a * a + b * b)).sum(1)
    iy = w @ (0.5 * (a2 * a2 + b2 * b2)).T
    ixy = 0.5 * ((w * a) @ a2.T + (w * b) @ b2.T)
    return np.broadcast_to(ix[:, None], iy.shape), iy, ixy, names, others


def pair_divergences(parts: DataFrame, tops: DataFrame | int, step: float, both_ways: bool = False, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """series1, series2, ix, iy, ixy, j of all pairs of series, on the band of the first; ordered pairs if both_ways, else series1 < series2,
    where all series have one band."""
    left, right = tile_pairs(blocks_of(parts, tops, tile, chunk), both_ways)

    def multiply(key: tuple[pa.Scalar, ...], one: pa.Table, two: pa.Table) -> pa.Table:
        out = []
        for x, y in zip(one.to_pylist(), two.to_pylist()):
            ix, iy, ixy, names, others = product(x, y, chunk, step)
            p, q = np.array(names, object)[:, None], np.array(others, object)[None, :]
            kept = (p != q) if both_ways else (p < q) if key[0].as_py() == key[1].as_py() else np.ones(ix.shape, bool)
            i, j = np.nonzero(kept)
            turn = np.array([names[a] > others[b] for a, b in zip(i, j)], bool) & (not both_ways)
            first, second = np.where(turn, q[0, j], p[i, 0]), np.where(turn, p[i, 0], q[0, j])
            ix, iy = np.where(turn, iy[i, j], ix[i, j]), np.where(turn, ix[i, j], iy[i, j])
            out.append(pa.Table.from_arrays([pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(ix), pa.array(iy), pa.array(ixy[i, j])], ["series1", "series2", "ix", "iy", "ixy"]))
        return pa.concat_tables(out) if out else pa.table({"series1": pa.array([], pa.string()), "series2": pa.array([], pa.string()), **{c: pa.array([], pa.float64()) for c in ("ix", "iy", "ixy")}})

    chunks = left.groupBy("i", "j", "chunk").cogroup(own(right).groupBy("i", "j", "chunk")).applyInArrow(multiply, PAIR)
    sums = chunks.groupBy("series1", "series2").agg(*[F.sum(c).alias(c) for c in ("ix", "iy", "ixy")])
    return sums.withColumn("j", F.lit(FACTOR) * (F.col("ix") + F.col("iy") - 2 * F.col("ixy")))


# nearest series


def scaled(block: dict, width: int, step: float) -> np.ndarray:
    """Vectors whose squared distances are J: a and b times the root of weight and factor."""
    _, tops, a, b = matrices(block, width)
    root = np.sqrt(weights(tops, block["chunk"], width, step) * FACTOR / 2)
    return np.concatenate([a * root, b * root], 1)


def pivot_distances(blocks: DataFrame, pivots: int, step: float, chunk: int) -> DataFrame:
    """name, tile, d: distances (roots of J) of each series to the pivots, those of the least hashed names. A pivot's vector is sent to every
    tile, a chunk at a time."""
    names = blocks.select(F.explode("names").alias("name")).distinct().orderBy(F.xxhash64("name"), "name").limit(pivots)
    chosen = [r["name"] for r in names.collect()]  # bounded by the parameter

    def vectors(rows: pa.Table) -> pa.Table:
        out = []
        for block in rows.to_pylist():
            v = scaled(block, chunk, step)
            out += [(block["chunk"], n, v[i].tobytes()) for i, n in enumerate(block["names"]) if n in chosen]
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "name": pa.array([x[1] for x in out], pa.string()), "v": pa.array([x[2] for x in out], pa.binary())})

    own = blocks.groupBy("tile", "chunk").applyInArrow(vectors, "chunk long, name string, v binary")
    own = written(own.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("name", "v"))).alias("pivots")), "pivots")  # a row a chunk, of `pivots` vectors

    def squared(rows: pa.Table) -> pa.Table:
        names, tiles, d = [], [], []
        for block in rows.to_pylist():
            v, p = scaled(block, chunk, step), np.stack([np.frombuffer(x["v"]) for x in block["pivots"]])
            names += block["names"]
            tiles += [block["tile"]] * len(v)
            d += ((v[:, None, :] - p[None, :, :]) ** 2).sum(2).tolist()
        return pa.table({"name": pa.array(names, pa.string()), "tile": pa.array(tiles, pa.int64()), "d": pa.array(d, pa.list_(pa.float64()))})

    each = blocks.join(own, "chunk").groupBy("tile", "chunk").applyInArrow(squared, "name string, tile long, d array<double>")
    places = each.select("name", "tile", F.posexplode("d").alias("pivot", "d")).groupBy("name", "tile", "pivot").agg(F.sqrt(F.sum("d")).alias("d"))
    return written(places.groupBy("name", "tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("pivot", "d"))), lambda x: x["d"]).alias("d")), "distances")


#: Added to bounds, as they are rounded.
MARGIN = 1e-9


def nearest_by_pivots(parts: DataFrame, count: int, step: float, k: int, pivots: int = 8, tile: int = TILE, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(series1, series2, j, rank): the k series of least J from each, ties by name; and (tile_pairs, pairs, refused): a row of counts.

    The k-th least of d(x, p) + d(p, y), over y near a pivot p, bounds how far x needs to look; a pair is refused if for a pivot
    |d(x, p) - d(y, p)| is more than that for both of its series. Series are cut into ranges of their distance to the first pivot, so ranges that are too far
    apart don't meet at all; in ranges that meet, bounds are compared in blocks, and only pairs that are left are rows. They get
    their exact J by tiles.
    """
    blocks = blocks_of(parts, count, tile, chunk)
    far = pivot_distances(blocks, pivots, step, chunk)
    close = far.select("name", F.posexplode("d").alias("pivot", "d")).withColumn("r", F.row_number().over(Window.partitionBy("pivot").orderBy("d", "name"))).where(F.col("r") <= k + 1)
    hubs = close.groupBy("pivot").agg(F.collect_list(F.struct("name", "d")).alias("near"))  # pivots * (k + 1) entries
    hubs = hubs.agg(F.collect_list(F.struct("pivot", "near")).alias("hubs"))
    ways = F.flatten(F.transform("hubs", lambda h: F.transform(F.filter(h["near"], lambda y: y["name"] != F.col("name")), lambda y: F.struct((F.get("d", h["pivot"]) + y["d"]).alias("far"), y["name"].alias("to")))))
    best = F.aggregate(F.array_sort(ways), F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<double>").alias("d")), lambda acc, w: F.when(F.array_contains(acc["seen"], w["to"]), acc).otherwise(F.struct(F.array_append(acc["seen"], w["to"]).alias("seen"), F.array_append(acc["d"], w["far"]).alias("d"))))
    reach = F.coalesce(F.get(best["d"], F.lit(k - 1)), F.lit(float("inf")))
    known = far.withColumn("key", F.lit(1)).join(F.broadcast(hubs.withColumn("key", F.lit(1))), "key").select("name", "tile", "d", (reach * (1 + MARGIN) + MARGIN).alias("reach"))  # one row of hubs
    ranges = max(1, -(-far.count() // (8 * tile)))
    known = written(known.repartitionByRange(ranges, F.get("d", F.lit(0)), "name").withColumn("range", F.spark_partition_id()), "known")
    bounds = known.groupBy("range").agg(F.min(F.get("d", F.lit(0))).alias("low"), F.max(F.get("d", F.lit(0))).alias("high"), F.max("reach").alias("reach")).orderBy("range").collect()  # a row a range
    low, high = np.array([b["low"] for b in bounds]), np.array([b["high"] for b in bounds])
    meet = [(int(b["range"]), int(bounds[m]["range"])) for i, b in enumerate(bounds) for m in np.flatnonzero((low <= high[i] + max(b["reach"], 0)) & (high >= low[i] - b["reach"])).tolist()]
    meet = sorted({(min(p), max(p)) for p in meet})
    table = parts.sparkSession.createDataFrame(meet, "p int, q int")
    left = known.join(F.broadcast(table), F.col("range") == F.col("p")).select("p", "q", "name", "tile", "d", "reach")
    right = known.join(F.broadcast(table), F.col("range") == F.col("q")).select("p", "q", "name", "tile", "d", "reach")

    def left_over(key: tuple[pa.Scalar, ...], one: pa.Table, two: pa.Table) -> pa.Table:
        x, y = (np.array(t.column("d").to_pylist()).reshape(t.num_rows, -1) for t in (one, two))
        rx, ry = np.asarray(one.column("reach")), np.asarray(two.column("reach"))
        nx, ny = (np.array(t.column("name").to_pylist(), object) for t in (one, two))
        gap = np.zeros((len(x), len(y)))
        for p in range(x.shape[1]):
            np.maximum(gap, np.abs(x[:, p : p + 1] - y[None, :, p]), out=gap)
        kept = gap <= np.maximum(rx[:, None], ry[None, :])
        if key[0].as_py() == key[1].as_py():
            kept &= nx[:, None] < ny[None, :]
        i, j = np.nonzero(kept)
        turn = np.asarray(one.column("tile"))[i] > np.asarray(two.column("tile"))[j]
        sides = [(np.where(turn, b, a)) for a, b in ((nx[i], ny[j]), (np.asarray(one.column("tile"))[i], np.asarray(two.column("tile"))[j]))] + [(np.where(turn, a, b)) for a, b in ((nx[i], ny[j]), (np.asarray(one.column("tile"))[i], np.asarray(two.column("tile"))[j]))]
        return pa.table({"name1": pa.array(sides[0], pa.string()), "i": pa.array(sides[1], pa.int64()), "name2": pa.array(sides[2], pa.string()), "j": pa.array(sides[3], pa.int64())})

    pairs = written(left.groupBy("p", "q").cogroup(own(right).groupBy("p", "q")).applyInArrow(left_over, "name1 string, i long, name2 string, j long"), "left-over")
    matrix = written(exact_pairs(blocks, pairs, step, chunk), "matrix")
    both = matrix.select("series1", "series2", "j").union(matrix.select(F.col("series2"), F.col("series1"), "j"))
    found = both.withColumn("rank", F.row_number().over(Window.partitionBy("series1").orderBy("j", "series2"))).where(F.col("rank") <= k)
    n = far.count()
    counts = pairs.agg(F.count("*").alias("pairs")).select(F.lit(len(meet)).alias("tile_pairs"), "pairs", (F.lit(n * (n - 1) // 2) - F.col("pairs")).alias("refused"))
    return found, counts


def exact_pairs(blocks: DataFrame, pairs: DataFrame, step: float, chunk: int) -> DataFrame:
    """series1, series2, j of pairs (name1, i, name2, j; i and j their tiles): blocks move to the tile pairs that are asked for."""
    asked = pairs.groupBy("i", "j").agg(F.collect_list("name1").alias("one"), F.collect_list("name2").alias("two"))  # no more than the pairs of two tiles
    wanted = written(asked, "asked")
    columns = ["chunk", "names", "tops", "a", "b"]
    left = wanted.join(blocks, wanted["i"] == blocks["tile"]).select("i", "j", *columns, "one", "two")
    right = wanted.select("i", "j").join(blocks, F.col("j") == blocks["tile"]).select("i", "j", *columns)

    def measure(one: pa.Table, two: pa.Table) -> pa.Table:
        out = [[], [], []]
        for x, y in zip(one.to_pylist(), two.to_pylist()):
            v, w = scaled(x, chunk, step), scaled(y, chunk, step)
            p, q = (np.array([{n: i for i, n in enumerate(block["names"])}[n] for n in names], np.int64) for block, names in ((x, x["one"]), (y, x["two"])))
            for at in range(0, len(p), 4096):
                out[2] += ((v[p[at : at + 4096]] - w[q[at : at + 4096]]) ** 2).sum(1).tolist()
            out[0] += x["one"]
            out[1] += x["two"]
        return pa.table({"series1": pa.array(out[0], pa.string()), "series2": pa.array(out[1], pa.string()), "j": pa.array(out[2], pa.float64())})

    each = left.groupBy("i", "j", "chunk").cogroup(own(right).groupBy("i", "j", "chunk")).applyInArrow(measure, "series1 string, series2 string, j double")
    return each.groupBy("series1", "series2").agg(F.sum("j").alias("j"))


# clusters


def least_edges(left: DataFrame, right: DataFrame, step: float, chunk: int) -> Callable[[DataFrame], DataFrame]:
    """Gives, for (name, root), a row (root, j, a, b) of each series' least edge to another component in each tile that it meets."""

    def run(roots: DataFrame) -> DataFrame:
        by_tile = roots.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("name", "root"))).alias("roots"))  # a tile's series
        one = left.join(by_tile, F.col("i") == by_tile["tile"]).select("i", "j", "chunk", "names", "tops", "a", "b", "roots")
        two = right.join(by_tile, F.col("j") == by_tile["tile"]).select("i", "j", "chunk", "names", "tops", "a", "b", "roots")

        def best(x: pa.Table, y: pa.Table) -> pa.Table:
            total, first, second = None, None, None
            theirs = {r["chunk"]: r for r in y.to_pylist()}
            for r in sorted(x.to_pylist(), key=lambda r: r["chunk"]):
                v, w = scaled(r, chunk, step), scaled(theirs[r["chunk"]], chunk, step)
                own = np.maximum((v * v).sum(1)[:, None] + (w * w).sum(1)[None, :] - 2 * v @ w.T, 0)
                total, first, second = own if total is None else total + own, r, theirs[r["chunk"]]
            p, q = (np.array(b["names"], object) for b in (first, second))
            rp, rq = (np.array([dict(b["roots"])[n] for n in b["names"]], object) for b in (first, second))
            total = np.where(rp[:, None] == rq[None, :], np.inf, np.round(total, 15))
            out = []
            for mine, other, root, d in ((p, q, rp, total), (q, p, rq, total.T)):
                order = np.argsort(other, kind="stable")
                at = order[np.argmin(d[:, order], 1)]
                for i in np.flatnonzero(np.isfinite(d[np.arange(len(mine)), at])).tolist():
                    out.append((root[i], d[i, at[i]], *sorted((mine[i], other[at[i]]))))
            return pa.table({c: pa.array([o[k] for o in out], t) for k, (c, t) in enumerate((("root", pa.string()), ("j", pa.float64()), ("a", pa.string()), ("b", pa.string())))})

        return one.groupBy("i", "j").cogroup(own(two).groupBy("i", "j")).applyInArrow(best, "root string, j double, a string, b string")

    return run


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots (name, tile, root) after the least edges (root, j, a, b) of the components joined them: each component follows its edge, the
    lesser one of two that chose the same edge stays, and following is doubled until all are at their new root."""
    ends = edges.join(roots.select(F.col("name").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("name").alias("b"), F.col("root").alias("rb")), "b")
    to = ends.select("root", F.when(F.col("ra") == F.col("root"), F.col("rb")).otherwise(F.col("ra")).alias("to"))
    back = to.select(F.col("root").alias("to"), F.col("to").alias("root"))
    mutual = to.join(back, ["root", "to"], "left_semi").where(F.col("root") < F.col("to")).select("root", F.lit(True).alias("stays"))
    follow = written(to.join(mutual, "root", "left").select("root", F.when(F.col("stays"), F.col("root")).otherwise(F.col("to")).alias("to")), "follow")
    while True:
        twice = follow.select(F.col("root").alias("to"), F.col("to").alias("end"))
        new = written(follow.join(twice, "to").select("root", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "follow")
        moved = not new.where("moved").isEmpty()
        follow = new.select("root", "to")
        if not moved:
            break
    return written(roots.join(follow, "root", "left").select("name", "tile", F.coalesce("to", "root").alias("root")), "roots")


def single_linkage(parts: DataFrame, count: int, step: float, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """a, b, j: the merges of single linkage over J, as the edges of a least spanning tree; ties by j (to 15 places), a, b. One series gives no row. Written."""
    blocks = blocks_of(parts, count, min(tile, max(1, MOST_HELD // count)), chunk)
    left, right = tile_pairs(blocks, False)
    edges_of = least_edges(left, right, step, chunk)
    roots = written(blocks.where("chunk = 0").select("tile", F.explode("names").alias("name")).select("name", "tile", F.col("name").alias("root")), "roots")
    tree = None
    while True:
        least = edges_of(roots).groupBy("root").agg(F.min(F.struct("j", "a", "b")).alias("e")).select("root", "e.*")
        least = written(least, "least")
        if least.isEmpty():
            break
        tree = least.select("a", "b", "j") if tree is None else tree.union(least.select("a", "b", "j"))
        roots = joined(roots, least)
    return written(tree.distinct(), "tree") if tree is not None else parts.sparkSession.createDataFrame([], "a string, b string, j double")


def cut(tree: DataFrame, names: DataFrame, clusters: int | None = None, height: float | None = None) -> DataFrame:
    """series_id, cluster (its least series): the tree without its clusters - 1 highest merges, or without those above a height."""
    order = [F.desc("j"), F.desc("a"), F.desc("b")]
    if clusters is not None:  # a bounded top list
        high = tree.orderBy(*order).limit(clusters - 1)
        kept = tree.join(high, ["a", "b"], "left_anti")
    else:
        kept = tree.where(F.col("j") <= height)
    kept = written(kept.select("a", "b"), "kept")
    label = written(names.select(F.col("series_id").cast("string").alias("series_id"), F.col("series_id").cast("string").alias("cluster")), "labels")
    both = kept.union(kept.select("b", "a")).toDF("series_id", "other")
    while True:  # least label of the neighbours, then the label's own label
        near = both.join(label.select(F.col("series_id").alias("other"), "cluster"), "other").groupBy("series_id").agg(F.min("cluster").alias("least"))
        lower = label.join(near, "series_id", "left").select("series_id", F.least("cluster", F.coalesce("least", "cluster")).alias("cluster"))
        lower = written(lower, "labels")
        jumped = lower.join(lower.select(F.col("series_id").alias("cluster"), F.col("cluster").alias("of")), "cluster").select("series_id", F.col("of").alias("cluster"))
        new = written(jumped, "labels")
        if new.join(label, ["series_id", "cluster"], "left_anti").isEmpty():
            return new
        label = new
