"""First-order autoregression on irregular times, and phase folding."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumachron.functions.numeric import TAU
from lumachron.operators.blocks import ORDER, blocked, same, written
from lumachron.operators.divergence import BETA
from lumachron.operators.moments import COUNT, STEP
from lumachron.operators.tapers import band_integrals, deviations, run_integrals, tapers_at, wave_components


def previous(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, block, last: the values of the last row before each block of rows, null for a key's first block."""
    ends = rows.groupBy(*keys, "block").agg(F.max_by(F.struct(*values), F.struct(*ORDER)).alias("end"))
    return ends.select(*keys, "block", F.lag("end").over(Window.partitionBy(*keys).orderBy("block")).alias("last"))


def lagged(series: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """series with gap and before: time and value from the observation before; ties in time by row_id.

    Each block looks back within itself, its first row to the end of the block before. Rows with block are taken as blocked."""
    given = "block" in series.columns
    rows = series if given else blocked(series, keys)
    w = Window.partitionBy(*keys, "block").orderBy(*ORDER)
    own = rows.withColumn("ahead", F.lag(F.struct("t", "x")).over(w))
    own = same(own, previous(rows, list(keys), ["t", "x"]), [*keys, "block"], "left")
    ahead = F.coalesce(F.col("ahead"), F.col("last"))
    found = own.withColumn("gap", F.col("t") - ahead["t"]).withColumn("before", ahead["x"]).drop("ahead", "last")
    return found if given else found.drop("block")


def fitted(phi: Column) -> Column:
    """phi^gap times the value before; 0 for the first observation."""
    return F.coalesce(F.pow(phi, F.col("gap")) * F.col("before"), F.lit(0.0))


def likelihood(rows: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """keys, phi, nll: half the sum of log v + e^2 / v, v = 1 - phi^(2 gap), of standardised lagged rows with phi.

    Observations at one time have no variance left and are passed over."""
    v = 1 - F.pow("phi", 2 * F.col("gap"))
    e = F.col("x") - F.pow("phi", F.col("gap")) * F.col("before")
    terms = F.when(F.col("gap").isNull(), F.col("x") * F.col("x")).when(F.col("gap") > 0, F.log(v) + e * e / v)
    return rows.groupBy(*keys, "phi").agg((F.sum(terms) / 2).alias("nll"))


def powers(phi: float, d: np.ndarray) -> np.ndarray:
    """phi^d by the C library, as SQL engines have it: what 1 - phi^d keeps of a tiny d is the power's last digits."""
    return np.fromiter(map(math.pow, repeat(phi), d.tolist()), np.float64, len(d))


def grid_likelihood(rows: DataFrame, phis: Iterable[float], keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """`likelihood` of lagged rows for each of phis: sums by key of a batch are all that leaves a task."""
    phis = [float(p) for p in phis]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: dict[tuple, list[int]] = {}
            for r, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(len(keys))))):
                at.setdefault(key, []).append(r)
            x, gap, before = (np.asarray(batch.column(c)) for c in ("x", "gap", "before"))
            known = np.asarray(batch.column("x").is_valid())
            start = np.asarray(batch.column("gap").is_null()) & known
            later = (gap > 0) & known & np.asarray(batch.column("before").is_valid())
            total = []
            for places in at.values():
                r = np.array(places)
                first, own = r[start[r]], r[later[r]]
                head = float((x[first] ** 2).sum())
                for phi in phis:
                    v, e = 1 - powers(phi, 2 * gap[own]), x[own] - phi ** gap[own] * before[own]
                    total.append(head + float((np.log(v) + e * e / v).sum()) if len(first) + len(own) else None)
            fixed = [pa.array([v for v in column for _ in phis], batch.column(c).type) for c, column in enumerate(zip(*at))] if at else [batch.column(c) for c in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(phis * len(at), pa.float64()), pa.array(total, pa.float64())], [*keys, "phi", "nll"])

    kinds = dict(rows.dtypes)
    found = rows.select(*keys, "x", "gap", "before").mapInArrow(summed, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", phi double, nll double")
    return found.groupBy(*keys, "phi").agg((F.sum("nll") / 2).alias("nll"))


def standardised(series: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    stats = series.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    return same(series, stats, list(keys)).withColumn("x", (F.col("x") - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def estimated(series: DataFrame, count: int = 49, rounds: int = 1, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """keys, phi, nll: the phi of least nll on an even grid of (0, 1), refined about it for further rounds."""
    rows = lagged(standardised(series, keys), keys)
    best = least(grid_likelihood(rows, [k / (count + 1) for k in range(1, count + 1)], keys), keys)
    width = 1.0 / (count + 1)
    for _ in range(rounds - 1):
        about = F.transform(F.sequence(F.lit(-10), F.lit(10)), lambda k: F.col("phi") + k * F.lit(width / 10))
        near = best.select(*keys, F.explode(about).alias("phi")).where("phi > 0 and phi < 1")
        best = least(likelihood(rows.join(near, list(keys)), keys), keys)
        width /= 10
    return best


#: Widths of the bracket, and steps, below which an estimate counts as found; and rounds at most.
FOUND, MOST_ROUNDS = 1e-9, 40


def slopes(phi: Column) -> tuple[Column, Column]:
    """First and second derivative by phi of a lagged row's share of the likelihood; null for the first row and for rows at the time of the row before."""
    d, y = F.col("gap"), F.col("before")
    p = F.pow(phi, d)
    p1, p2 = d * p / phi, d * (d - 1) * p / (phi * phi)
    v, v1, v2 = 1 - p * p, -2 * p * p1, -2 * (p1 * p1 + p * p2)
    e, e1, e2 = F.col("x") - p * y, -p1 * y, -p2 * y
    first = (v1 / v + 2 * e * e1 / v - e * e * v1 / (v * v)) / 2
    second = (v2 / v - v1 * v1 / (v * v) + 2 * (e1 * e1 + e * e2) / v - 4 * e * e1 * v1 / (v * v) - e * e * v2 / (v * v) + 2 * e * e * v1 * v1 / (v * v * v)) / 2
    return F.when(d > 0, first), F.when(d > 0, second)


def maximum_likelihood(series: DataFrame, count: int = 49, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """keys, phi, nll, status, rounds: the phi in (0, 1) of least nll, of standardised series.

    The best of an even grid gives a bracket, its neighbours. Safeguarded Newton goes on from there: score and curvature are sums over rows, one
    aggregate a round for all series; the score's sign narrows the bracket, and a step that would leave it, or curves the wrong way, halves it instead.
    status: "ok"; "boundary" where the score has one sign to the end of (0, 1), phi being the bracket's last; "open" after MOST_ROUNDS; "none" for a
    series without two times.
    """
    rows = written(lagged(standardised(series, keys), keys), "lagged")
    grid = F.explode(F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: k / F.lit(float(count + 1))))
    best = least(likelihood(rows.withColumn("phi", grid), keys), keys)
    width = 1.0 / (count + 1)
    state = best.select(*keys, "phi", F.greatest(F.col("phi") - width, F.lit(1e-12)).alias("low"), F.least(F.col("phi") + width, F.lit(1 - 1e-12)).alias("high"), F.lit(0).alias("rounds"), F.lit(False).alias("done"))
    state = written(state, "state")
    for _ in range(MOST_ROUNDS):
        going = state.where(~F.col("done"))
        if going.isEmpty():
            break
        first, second = slopes(F.col("phi"))
        sums = same(rows, going.select(*keys, "phi"), list(keys)).groupBy(*keys).agg(F.sum(first).alias("score"), F.sum(second).alias("curve"))
        moved = same(going, sums, list(keys), "left")
        low = F.when(F.col("score") < 0, F.col("phi")).otherwise(F.col("low"))
        high = F.when(F.col("score") > 0, F.col("phi")).otherwise(F.col("high"))
        moved = moved.withColumns({"low": low, "high": high})
        step = F.col("phi") - F.try_divide(F.col("score"), F.col("curve"))
        newton = (F.col("curve") > 0) & (step > F.col("low")) & (step < F.col("high"))
        to = F.when(F.col("score") == 0, F.col("phi")).when(newton, step).otherwise((F.col("low") + F.col("high")) / 2)
        moved = moved.withColumn("to", to)
        done = F.col("score").isNull() | (F.col("score") == 0) | (F.abs(F.col("to") - F.col("phi")) < FOUND) | (F.col("high") - F.col("low") < FOUND)
        moved = moved.select(*keys, F.coalesce("to", "phi").alias("phi"), "low", "high", (F.col("rounds") + 1).alias("rounds"), done.alias("done"))
        state = written(moved.union(state.where("done")), "state")
    scored = likelihood(same(rows, state.select(*keys, "phi"), list(keys)), keys).drop("phi")
    edge = (F.col("phi") < 1e-8) | (F.col("phi") > 1 - 1e-8)
    usable = rows.where("gap > 0").select(*keys).distinct().withColumn("usable", F.lit(True))
    found = same(same(state, scored, list(keys), "left"), usable, list(keys), "left")
    status = F.when(F.col("usable").isNull(), "none").when(~F.col("done"), "open").when(edge, "boundary").otherwise("ok")
    return found.select(*keys, F.when(status != "none", F.col("phi")).alias("phi"), "nll", status.alias("status"), "rounds")


def least(scored: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    return scored.groupBy(*keys).agg(F.min_by("phi", F.struct("nll", "phi")).alias("phi"), F.min("nll").alias("nll"))


def noise(seed: int) -> Column:
    """A standard normal number from the row's series_id, t, row_id and true_phi alone, so that it is the same wherever it is drawn."""
    drawn = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(2 * seed + k), "series_id", "t", "row_id", "true_phi"), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return F.sqrt(-2 * F.log(drawn(0))) * F.cos(F.lit(6.283185307179586) * drawn(1))


def hashed_on(seeds: np.ndarray, value: float) -> np.ndarray:
    """xxHash64 of a double's 8 bytes from hashes as seeds: what `xxhash64` gives of their columns and the value."""
    a, b, c, d, e = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    h = (seeds + e + np.uint64(8)) ^ (turned(np.array([value]).view(np.uint64) * b, 31) * a)
    h = turned(h, 27) * a + d
    h = (h ^ (h >> np.uint64(33))) * b
    h = (h ^ (h >> np.uint64(29))) * c
    return h ^ (h >> np.uint64(32))


def shocks(one: np.ndarray, two: np.ndarray, phis: list[float]) -> np.ndarray:
    """rows x phis: the numbers that `noise` gives, of the hashes of what a row has but for true_phi."""
    drawn = lambda seeds, p: ((hashed_on(seeds, p) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    one, two = one.view(np.uint64), two.view(np.uint64)
    return np.stack([np.sqrt(-2 * np.log(drawn(one, p))) * np.cos(TAU * drawn(two, p)) for p in phis], 1)


#: Blocks that are folded in one list.
BLOCKS_A_LIST = 1000


def carried(ends: DataFrame, keys: tuple[str, ...], many: int = BLOCKS_A_LIST) -> DataFrame:
    """keys, block, carry: what reaches each block, of ends (keys, block, x, decay) where a block passes on x plus decay times what reached it.

    A scan in two levels: blocks in lists of at most `many`, each folded from 0 along with its product of decays, then the lists' own ends. So a list is short
    for any number of blocks that a table may have.
    """
    start = lambda of: F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("decay"), F.array().cast(f"array<struct<{of}: bigint, carry: double, rate: double>>").alias("out"))

    def scan(rows: DataFrame, by: list[str], of: str) -> DataFrame:
        def step(acc: Column, o: Column) -> Column:
            reached = F.array(F.struct(o[of].cast("long").alias(of), acc["x"].alias("carry"), acc["decay"].alias("rate")))
            return F.struct((o["x"] + o["decay"] * acc["x"]).alias("x"), (acc["decay"] * o["decay"]).alias("decay"), F.concat(acc["out"], reached).alias("out"))

        lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(of, "x", "decay"))).alias("o"))
        return lists.select(*by, F.aggregate("o", start(of), step).alias("z"))

    own = scan(ends.withColumn("list", F.floor(F.col("block") / many)), [*keys, "list"], "block")
    heads = scan(own.select(*keys, "list", "z.x", "z.decay"), list(keys), "list").select(*keys, F.inline("z.out"))
    within = own.select(*keys, "list", F.inline("z.out").alias("block", "own", "rate"))
    found = same(within, heads.select(*keys, "list", "carry"), [*keys, "list"])
    return found.select(*keys, F.col("block").cast("int").alias("block"), (F.col("own") + F.col("rate") * F.col("carry")).alias("carry"))


def simulated_sweep(times: DataFrame, phis: Iterable[float], seed: int = 1, shock: Column | None = None) -> DataFrame:
    """times (series_id, t, row_id) with x for each true_phi of phis, and block: x_j = phi^gap x_(j-1) + sqrt(1 - phi^(2 gap)) e_j, e standard
    normal, drawn anew for each phi, or `shock` if that is given.

    With T the time since the start, x_j phi^-T_j is a sum of independent terms, but it overflows; so each block is folded in
    order from 0. A block's last value is its own plus phi^(its span) times the last value before, which a pass over the
    blocks' ends works out; each row then adds phi^(time since the block before) times that carry.
    """
    rows = blocked(times.select("series_id", "t", "row_id"))
    ends = previous(rows, ["series_id"], ["t"]).select("series_id", "block", F.col("last.t").alias("since"))
    each = F.explode(F.array(*[F.lit(float(p)) for p in phis]))
    drawn = same(rows, ends, ["series_id", "block"]).withColumn("true_phi", each).withColumn("e", noise(seed) if shock is None else shock)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "row_id"], kind="stable")
        phi, since = float(part["true_phi"].iloc[0]), part["since"].iloc[0]
        t = part["t"].to_numpy()
        gap = t.copy()
        gap[1:] -= t[:-1]
        gap[0] = float("inf") if pd.isna(since) else t[0] - since
        decay = phi**gap
        shock = (1 - decay * decay) ** 0.5 * part["e"].to_numpy()
        out, x = [], 0.0
        for d, s in zip(decay.tolist(), shock.tolist()):
            x = d * x + s
            out.append(x)
        return part.assign(x=out)[["series_id", "t", "row_id", "block", "since", "true_phi", "x"]]

    kinds = dict(rows.dtypes)
    schema = f"series_id {kinds['series_id']}, t double, row_id {kinds['row_id']}, block int, since double, true_phi double, x double"
    own = drawn.groupBy("series_id", "block", "true_phi").applyInPandas(fold, schema)
    tails = own.groupBy("series_id", "true_phi", "block").agg(F.max_by(F.struct("t", "since", "x"), F.struct("t", "row_id")).alias("z"))
    decay = F.coalesce(F.pow("true_phi", F.col("z.t") - F.col("z.since")), F.lit(0.0))
    carries = carried(tails.select("series_id", "true_phi", "block", F.col("z.x").alias("x"), decay.alias("decay")), ("series_id", "true_phi"))
    carry = F.coalesce(F.pow("true_phi", F.col("t") - F.col("since")) * F.col("carry"), F.lit(0.0))
    return same(own, carries, ["series_id", "true_phi", "block"]).select("series_id", "t", "row_id", "block", "true_phi", (F.col("x") + carry).alias("x"))


def simulated(times: DataFrame, phi: float, seed: int = 1) -> DataFrame:
    """times (series_id, t, row_id) with x, a simulated series of one phi."""
    return simulated_sweep(times, [phi], seed).select("series_id", "t", "row_id", "x")


#: Blocks of a file of packed blocks, and rows that are worked on at once under tapers.
BLOCKS_A_FILE, ROWS_AT_ONCE = 8, 1024


def packed(times: DataFrame, values: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Blocks (series_id, block, o: t, row_id and values in order), few to a file and in order; and series_id, block, since and values (of the row before the
    block), start (rows before it), n (rows of the series). Both written."""
    rows = blocked(times.select("series_id", F.col("t").cast("double").alias("t"), "row_id", *values))
    row = F.struct("t", "row_id", *values)
    ends = written(rows.groupBy("series_id", "block").agg(F.count("*").alias("rows"), F.max_by(row, F.struct(*ORDER)).alias("end")), "ends")
    files = max(rows.sparkSession.sparkContext.defaultParallelism, -(-ends.count() // BLOCKS_A_FILE))
    lists = rows.repartitionByRange(files, "series_id", "block").groupBy("series_id", "block").agg(F.array_sort(F.collect_list(row)).alias("o"))  # bounded by a block
    w = Window.partitionBy("series_id")
    upto = F.sum("rows").over(w.orderBy("block")) - F.col("rows")
    last = F.lag("end").over(w.orderBy("block"))
    heads = ends.select("series_id", "block", last["t"].alias("since"), *[last[v].alias(v) for v in values], upto.alias("start"), F.sum("rows").over(w).alias("n"))
    return written(lists.sortWithinPartitions("series_id", "block"), "packed"), written(heads, "heads")


def streamed(blocks: DataFrame, heads: DataFrame, seed: int) -> DataFrame:
    """Rows of packed blocks in order: series_id, place in the block, t, the two hashes of the row's shocks, and on a block's first row what heads tells of it."""
    told = [c for c in heads.columns if c != "series_id"]
    rows = same(blocks, heads, ["series_id", "block"]).select("series_id", *told, F.posexplode("o").alias("place", "r"))
    rows = rows.select("series_id", *told, "place", "r.t", "r.row_id")
    hashes = [F.xxhash64(F.lit(2 * seed + k), "series_id", "t", "row_id").alias(f"h{k}") for k in (0, 1)]
    return rows.select("series_id", "place", "t", *hashes, *[F.when(F.col("place") == 0, F.col(c)).alias(c) for c in told])


def walked(batches: Iterator[pa.RecordBatch], phis: list[float]) -> Iterator[tuple]:
    """Streamed rows by runs of rows of one block: the block's head, place of the first row, t, gap (infinite for a series' first row), and the
    simulated values before and at each row (rows x phis)."""
    p, head, x, last = np.array(phis), {}, np.zeros(len(phis)), -math.inf
    for batch in batches:
        place, times = np.asarray(batch.column("place")), np.asarray(batch.column("t"))
        e = shocks(np.asarray(batch.column("h0")), np.asarray(batch.column("h1")), phis)
        cuts = sorted({0, len(times), *np.flatnonzero(place == 0).tolist()})
        for a, b in zip(cuts, cuts[1:]):
            if place[a] == 0:
                head = {c: batch.column(c)[a].as_py() for c in batch.schema.names if c not in ("place", "t", "h0", "h1")}
                head["id"] = batch.column("series_id").slice(a, 1)
                x, last = np.array(head.get("carry") or np.zeros(len(phis))), -math.inf if head["since"] is None else head["since"]
            t = times[a:b]
            gap = np.diff(t, prepend=last)
            decay = p ** gap[:, None]
            shock = np.sqrt(1 - decay * decay) * e[a:b]
            out = np.empty((len(t) + 1, len(phis)))
            out[0] = x
            for before, after, d, s in zip(out, out[1:], decay, shock):
                np.multiply(d, before, after)
                after += s
            x, last = out[-1], t[-1]
            yield head, int(place[a]), t, gap, out[:-1], out[1:]


def repeated(head: dict, times: int) -> pa.Array:
    return head["id"].take(pa.array([0] * times, pa.int32()))


def tails(rows: DataFrame, phis: list[float]) -> DataFrame:
    """series_id, block, k, x, decay: each block's last value folded from 0, for each of phis, and what is left there of the value before the block."""

    def handed(head: dict, end: float, x: np.ndarray) -> pa.RecordBatch:
        decay = np.zeros(len(phis)) if head["since"] is None else np.array(phis) ** (end - head["since"])
        fixed = [repeated(head, len(phis)), pa.array([head["block"]] * len(phis), pa.int32()), pa.array(range(len(phis)), pa.int32())]
        return pa.RecordBatch.from_arrays([*fixed, pa.array(x), pa.array(decay)], ["series_id", "block", "k", "x", "decay"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for head, place, t, _, _, x in walked(batches, phis):
            if place == 0 and open_:
                yield handed(*open_)
            open_ = head, t[-1], x[-1]
        if open_:
            yield handed(*open_)

    return rows.mapInArrow(run, f"series_id {dict(rows.dtypes)['series_id']}, block int, k int, x double, decay double")


class Likelihoods:
    """Sums of a series' rows from which come, by true phi, mean and deviation, and the likelihood of standardised values at candidates.

    A row's e^2 / v is (change + q before)^2 / v, q = 1 - phi^gap, v = q (2 - q): three products of what depends on the candidate and what on the values, so
    that all candidates and true phis are matrix products, and no digits go at small gaps."""

    def __init__(self, candidates: list[np.ndarray]) -> None:
        self.candidates, self.alike = candidates, {}
        for k, c in enumerate(candidates):
            self.alike.setdefault(c.tobytes(), []).append(k)
        self.plain, self.sums = np.zeros((6, len(candidates))), np.zeros((8, len(candidates), max(map(len, candidates))))

    def add(self, gap: np.ndarray, before: np.ndarray, x: np.ndarray) -> None:
        first, later = np.isinf(gap), np.isfinite(gap) & (gap > 0)
        self.plain += np.stack([np.full(x.shape[1], float(len(x))), x.sum(0), (x * x).sum(0), x[first].sum(0), (x[first] ** 2).sum(0), before.sum(0)])
        u, change = before[later], (x - before)[later]
        for code, own in self.alike.items():
            q = -np.expm1(gap[later, None] * np.log(np.frombuffer(code)))
            v, d, one = u[:, own], change[:, own], np.ones((len(own), 1))
            w = 1 / (q * (2 - q)), 2 / (2 - q), q / (2 - q)
            logs = np.log(q * (2 - q)).sum(0)
            parts = [(d * d).T @ w[0], (d * v).T @ w[1], (v * v).T @ w[2], d.T @ w[1], v.T @ w[2], one * w[2].sum(0), one * logs, v.T @ q]
            self.sums[:, own, : q.shape[1]] += np.stack(parts)

    def packed(self) -> bytes:
        return np.concatenate([self.plain.ravel(), self.sums.ravel()]).tobytes()

    def added(self, packed: bytes) -> None:
        total = np.frombuffer(packed)
        self.plain += total[: self.plain.size].reshape(self.plain.shape)
        self.sums += total[self.plain.size :].reshape(self.sums.shape)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By true phi: the candidate of least likelihood, the mean of values, and that of their fits."""
        n, s, ss, f, ff, u = self.plain
        d2, dv, v2, d, v, w, logs, q = self.sums
        with np.errstate(all="ignore"):
            mean = s / n
            var = (np.maximum(ss - s * mean, 0) / np.where(n > 1, n - 1, np.nan))[:, None]
            m, start = mean[:, None], (ff - 2 * mean * f + mean**2)[:, None]
            nll = 0.5 * ((start + d2 + dv - m * d + v2 - 2 * m * v + m * m * w) / var + logs)
        nll = np.where(np.isnan(nll), np.inf, nll)
        at = [int(nll[k, : len(c)].argmin()) for k, c in enumerate(self.candidates)]
        return np.array([c[j] for c, j in zip(self.candidates, at)]), mean, (u - q[np.arange(len(at)), at]) / n


#: Values of phi on the first grid of `sweep`.
GRID = 49


def candidates(about: list[float] | None, count: int) -> list[np.ndarray]:
    """Of each of so many true phis, the values of phi that are tried: the grid, or, about its best, ten steps of a tenth of the grid's to both sides."""
    if about is None:
        return [np.arange(1, GRID + 1) / (GRID + 1)] * count
    near = [b + np.arange(-10, 11) * (1 / (GRID + 1) / 10) for b in about]
    return [c[(c > 0) & (c < 1)] for c in near]


def most_likely(rows: DataFrame, phis: list[float]) -> DataFrame:
    """series_id, best, mx, my: by true phi the likeliest of the candidates (those about the heads' best, if they have one), mean of the values and of their fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(head: dict, held: Likelihoods) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([repeated(head, 1), pa.array([head.get("best")], pa.list_(pa.float64())), pa.array([held.packed()], pa.binary())], ["series_id", "about", "sums"])

        open_, held = None, None
        for head, _, _, gap, before, x in walked(batches, phis):
            if open_ is None or open_["series_id"] != head["series_id"]:
                if held:
                    yield handed(open_, held)
                open_, held = head, Likelihoods(candidates(head.get("best"), len(phis)))
            held.add(gap, before, x)
        if held:
            yield handed(open_, held)

    def settled(table: pa.Table) -> pa.Table:
        held = Likelihoods(candidates(table.column("about")[0].as_py(), len(phis)))
        for sums in table.column("sums").to_pylist():
            held.added(sums)
        lists = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in held.best()]
        return pa.Table.from_arrays([table.column("series_id").slice(0, 1), *lists], ["series_id", "best", "mx", "my"])

    kind = dict(rows.dtypes)["series_id"]
    sums = rows.mapInArrow(run, f"series_id {kind}, about array<double>, sums binary")
    return sums.groupBy("series_id").applyInArrow(settled, f"series_id {kind}, best array<double>, mx array<double>, my array<double>")


def tapered_sweep(rows: DataFrame, phis: list[float], bands: dict[int, int], count: int, step: float) -> DataFrame:
    """series_id, k, nw, ix, iy, ixy of streamed rows whose heads have best, mx and my: values against their fits, by true phi and bandwidth.

    Waves and tapers are made once a row for all true phis; a task hands on sums by series and true phi, or the results of a series that it had whole."""
    omega, size, wide = TAU * step * np.arange(1, count + 1), sum(bands.values()), len(phis)

    def integrals_of(wave: np.ndarray, plain: np.ndarray, own: np.ndarray) -> np.ndarray:
        """true phis x bands x 3, of sums of waves (5 x count), of tapered values (2 x tapers x 2 x true phis) and of both (2 x count x tapers x 2 x true phis)."""
        n, own = wave[0, 0], own.transpose(0, 3, 4, 2, 1)
        mean, sd = (v.transpose(1, 2, 0)[..., None] for v in deviations(n, *plain))
        a, b = wave_components(n, mean, sd, wave[1:], own, omega)
        each = band_integrals((a[0], b[0]), (a[1], b[1]), step)
        starts = np.cumsum([0, *bands.values()])
        return np.stack([each[:, :, s : s + int(min(k, n))].mean(2).T for s, k in zip(starts, bands.values())], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(head: dict, wave: np.ndarray, plain: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            whole = integrals_of(wave, plain, own.reshape(2, count, size, 2, wide)).reshape(wide, -1).tolist() if wave[0, 0] == head["n"] else [None] * wide
            own = own.reshape(2, count, size, 2, wide)
            for k, found in enumerate(whole):
                sums = None if found else np.concatenate([wave.ravel(), plain[..., k].ravel(), own[..., k].ravel()]).tobytes()
                yield pa.RecordBatch.from_arrays([repeated(head, 1), pa.array([k], pa.int32()), pa.array([found], pa.list_(pa.float64())), pa.array([sums], pa.binary())], ["series_id", "k", "found", "sums"])

        open_, held = None, ()
        for head, place, t, gap, before, x in walked(batches, phis):
            if open_ is None or open_["series_id"] != head["series_id"]:
                if held:
                    yield from handed(open_, *held)
                open_, held = head, (np.zeros((5, count)), np.zeros((2, size, 2, wide)), np.zeros((2 * count, size * 2 * wide)))
            fit = np.array(head["best"]) ** gap[:, None] * before
            both = np.concatenate([x - np.array(head["mx"]), fit - np.array(head["my"])], 1)
            i, n = head["start"] + place + 1 + np.arange(len(t)), head["n"]
            for a in range(0, len(t), ROWS_AT_ONCE):
                at = slice(a, a + ROWS_AT_ONCE)
                v = np.zeros((len(t[at]), size))
                for s, (nw, k) in zip(np.cumsum([0, *bands.values()]), bands.items()):
                    v[:, s : s + min(k, n)] = tapers_at(i[at], n, k, nw) if nw else 1.0
                under = (v[:, :, None] * both[at, None, :]).reshape(len(v), -1)
                z = np.cumprod(np.broadcast_to(np.exp(1j * TAU * step * t[at])[:, None], (len(v), count)), 1)
                one, two = z.sum(0), np.einsum("ij,ij->j", z, z)
                held[0][:] += np.stack([np.full(count, float(len(v))), one.real, one.imag, two.real, two.imag])
                held[1][:] += np.stack([under.sum(0), np.einsum("ij,ij->j", under, under)]).reshape(held[1].shape)
                held[2][:] += np.concatenate([z.real, z.imag], 1).T @ under
        if held:
            yield from handed(open_, *held)

    def settled(table: pa.Table) -> pa.Table:
        found = table.column("found")[0].as_py()
        if found is None:
            total = sum(np.frombuffer(s) for s in table.column("sums").to_pylist())
            wave, plain = total[: 5 * count].reshape(5, count), total[5 * count : 5 * count + 4 * size].reshape(2, size, 2, 1)
            found = integrals_of(wave, plain, total[5 * count + 4 * size :].reshape(2, count, size, 2, 1)).ravel().tolist()
        fixed = [table.column(c).slice(0, 1).combine_chunks().take(pa.array([0] * len(bands), pa.int32())) for c in ("series_id", "k")]
        return pa.Table.from_arrays([*fixed, pa.array(list(bands), pa.int32()), *(pa.array(found[c::3], pa.float64()) for c in range(3))], ["series_id", "k", "nw", "ix", "iy", "ixy"])

    kind = dict(rows.dtypes)["series_id"]
    sums = rows.mapInArrow(run, f"series_id {kind}, k int, found array<double>, sums binary")
    return sums.groupBy("series_id", "k").applyInArrow(settled, f"series_id {kind}, k int, nw int, ix double, iy double, ixy double")


def sweep(times: DataFrame, phis: Iterable[float], widths: Iterable[int] = (2, 3, 4, 5), count: int = COUNT, step: float = STEP, seed: int = 7) -> DataFrame:
    """series_id, true_phi, nw, phi, ix, iy, ixy, j: a series simulated on the times for each true_phi, against its fit with the phi
    estimated from it (as `estimated` does in two rounds). nw 0 is the plain divergence; for each nw of widths integrals are averaged over 2 nw tapers.

    Only the times are written, in packed blocks. Simulated values are never rows: as a shock knows its row alone, they are drawn anew in each of four passes
    (last values of blocks, likelihoods on a grid, likelihoods about its best, tapered sums), and what leaves a task is sums by series and true phi.
    """
    phis = [float(p) for p in phis]
    blocks, heads = packed(times)
    ends = written(tails(streamed(blocks, heads, seed), phis), "tails")
    carries = carried(ends, ("series_id", "k")).groupBy("series_id", "block").agg(F.array_sort(F.collect_list(F.struct("k", "carry"))).alias("o"))
    heads = written(same(heads, carries.select("series_id", "block", F.col("o.carry").alias("carry")), ["series_id", "block"]), "heads")
    grid = written(most_likely(streamed(blocks, heads, seed), phis).select("series_id", "best"), "grid")
    fits = written(most_likely(streamed(blocks, same(heads, grid, ["series_id"]), seed), phis), "fits")
    found = tapered_sweep(streamed(blocks, same(heads, fits, ["series_id"]), seed), phis, {0: 1, **{nw: 2 * nw for nw in widths}}, count, step)
    rows = same(found, fits.select("series_id", "best"), ["series_id"])
    j = F.lit(BETA / TAU) * (F.col("ix") + F.col("iy") - 2 * F.col("ixy"))
    at = lambda values: F.get(values, F.col("k"))
    return rows.select("series_id", at(F.array(*[F.lit(p) for p in phis])).alias("true_phi"), "nw", at("best").alias("phi"), "ix", "iy", "ixy", j.alias("j"))


def run_fits(series: DataFrame, phis: Iterable[float], length: int, widths: tuple[int, ...], count: int = COUNT, step: float = STEP) -> DataFrame:
    """series_id, phi, nw, runs, ix, iy, ixy, j: multitaper divergences of standardised values from their autoregressive fit for each of phis, by `runs` of
    so many rows, averaged over a series' runs.

    A block's own runs are worked out where it is, and leave as sums by phi and width; only rows of runs that blocks cut are brought together.
    """
    phis, widths = [float(p) for p in phis], tuple(widths)
    blocks, heads = packed(series.select("series_id", "t", "row_id", F.col("x").cast("double").alias("x")), ("x",))
    stats = written(blocks.select("series_id", F.explode("o.x").alias("x")).groupBy("series_id").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")), "stats")
    heads = same(heads.withColumnRenamed("x", "before"), stats, ["series_id"])
    told = [c for c in heads.columns if c != "series_id"]
    rows = same(blocks, heads, ["series_id", "block"]).select("series_id", *told, F.posexplode("o").alias("place", "r"))
    rows = rows.select("series_id", "place", "r.t", "r.x", *[F.when(F.col("place") == 0, F.col(c)).alias(c) for c in told])
    sums, cut = ["phi", "nw", "runs", "ix", "iy", "ixy"], ["run", "rows", "i", "t", "x", "gap", "before"]

    def counted(id_: pa.Array, t: np.ndarray, x: np.ndarray, gap: np.ndarray, before: np.ndarray) -> list[pa.Array]:
        """Sums over runs (runs x rows), a row a phi and width."""
        total = run_integrals(t, x, np.stack([p**gap * before for p in phis]), widths, count, step).reshape(-1, 3)
        fixed = [id_.take(pa.array([0] * len(total), pa.int32())), pa.array(np.repeat(phis, len(widths))), pa.array(np.tile(widths, len(phis)), pa.int32())]
        return [*fixed, pa.array([len(t)] * len(total), pa.int64()), *map(pa.array, total.T)]

    def of_block(head: dict, t: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        sd = math.nan if head["sd"] is None else head["sd"]
        with np.errstate(all="ignore"):
            x = (x - head["mean"]) / sd
            first = 0.0 if head["since"] is None else (head["before"] - head["mean"]) / np.float64(sd)
        gap, before = np.diff(t, prepend=-math.inf if head["since"] is None else head["since"]), np.concatenate([[first], x[:-1]])
        start, n = head["start"], head["n"]
        size, last, end = min(length, n), max(-(-n // length) - 1, 0), start + len(t)
        run = np.unique([last, *range(start // length, min(last, end // length) + 1)])
        at = np.maximum(np.minimum(run * length, n - length), 0)
        run, at = run[(at < end) & (at + size > start)], at[(at < end) & (at + size > start)]
        own = (at >= start) & (at + size <= end)
        if own.any():
            r = (at[own] - start)[:, None] + np.arange(size)
            found = counted(head["id"], t[r], x[r], gap[r], before[r])
            yield pa.RecordBatch.from_arrays([*found, *(pa.nulls(len(found[0]), k) for k in kinds)], ["series_id", *sums, *cut])
        for number, begin in zip(run[~own].tolist(), at[~own].tolist()):
            r = slice(max(begin - start, 0), min(begin + size, end) - start)
            m = r.stop - r.start
            i = np.arange(r.start, r.stop) + start - begin
            values = [pa.array([number] * m, pa.int64()), pa.array([size] * m, pa.int32()), pa.array(i.astype(np.int32)), *(pa.array(v[r]) for v in (t, x, gap, before))]
            yield pa.RecordBatch.from_arrays([repeated(head, m), *(pa.nulls(m, k) for k in (pa.float64(), pa.int32(), pa.int64(), *[pa.float64()] * 3)), *values], ["series_id", *sums, *cut])

    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 4]

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = {}, []
        for batch in batches:
            place, t, x = (np.asarray(batch.column(c)) for c in ("place", "t", "x"))
            cuts = sorted({0, len(t), *np.flatnonzero(place == 0).tolist()})
            for a, b in zip(cuts, cuts[1:]):
                if place[a] == 0:
                    if held:
                        yield from of_block(head, *(np.concatenate(v) for v in zip(*held)))
                    head, held = {c: batch.column(c)[a].as_py() for c in told}, []
                    head["id"] = batch.column("series_id").slice(a, 1)
                held.append((t[a:b], x[a:b]))
        if held:
            yield from of_block(head, *(np.concatenate(v) for v in zip(*held)))

    def of_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                values = (np.asarray(batch.column(c)[k].values)[None] for c in ("t", "x", "gap", "before"))
                yield pa.RecordBatch.from_arrays(counted(batch.column(0).slice(k, 1), *values), ["series_id", *sums])

    kind = dict(rows.dtypes)["series_id"]
    of_sums = f"series_id {kind}, phi double, nw int, runs bigint, ix double, iy double, ixy double"
    found = written(rows.mapInArrow(by_block, f"{of_sums}, run bigint, rows int, i int, t double, x double, gap double, before double"), "runs")
    lists = found.where("run is not null").groupBy("series_id", "run").agg(F.array_sort(F.collect_list(F.struct("i", "t", "x", "gap", "before"))).alias("o"))  # a run's rows
    mended = lists.select("series_id", "o.t", "o.x", "o.gap", "o.before").mapInArrow(of_cut, of_sums)
    every = found.where("run is null").select("series_id", *sums).union(mended).groupBy("series_id", "phi", "nw")
    means = every.agg(F.sum("runs").alias("runs"), *[(F.sum(c) / F.sum("runs")).alias(c) for c in ("ix", "iy", "ixy")])
    return means.withColumn("j", F.lit(BETA / TAU) * (F.col("ix") + F.col("iy") - 2 * F.col("ixy")))


def folded(series: DataFrame, frequency: float) -> DataFrame:
    """series with phase in [0, 1): cycles since the series' first time, whole cycles dropped."""
    first = series.groupBy("series_id").agg(F.min("t").alias("first"))
    return same(series, first, ["series_id"]).withColumn("phase", F.pmod((F.col("t") - F.col("first")) * frequency, F.lit(1.0))).drop("first")
