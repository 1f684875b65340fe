"""Registered queries, and the SQL that each is held against.

Queries work on the driver's tables as series: events by type, orders by priority. Their SQL takes the direct way (shift
first, then components by observation), not the sums that the operators use. Values are rounded in both.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumachron.functions.numeric import TAU, epoch_days, is_finite, rounded
from lumachron.functions.sql import register
from lumachron.operators import autoregression, cleaning, divergence, frontier, integrals, prefixes, spectra, tapers, tiles, transforms
from lumachron.operators.blocks import numbered, written
from lumachron.operators.moments import COUNT, STEP, components, moments, sampling, with_grid, with_own_grid
from lumachron.sources.series import event_series, finite_pairs, light_curve_lines, order_series, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SERIES, PAIR = ("series_id", "freq_id"), ("series1", "series2", "freq_id")


def query(name: str, sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


EVENTS = "ev as (select event_type as series_id, epoch_us(ts) / 1e6 / 86400 as t, value as x, event_id as row_id from events where ts is not null and isfinite(value))"
ORDERS = "od as (select o_orderpriority as series_id, epoch_us(o_orderdate) / 1e6 / 86400 as t, o_totalprice as x, o_orderkey as row_id from orders where o_orderdate is not null and isfinite(o_totalprice))"


def parts_sql(rows: str = "ev", keys: str = "series_id", omega: str = "2 * pi() * range * 0.001", name: str = "comp", grid: str = "range(1, 201)") -> str:
    """Components by observation: grid, statistics, shift, then sums; a, b standardised, ar, br demeaned, am, bm raw."""
    return f"""g as (select range as freq_id, range * 0.001 as f, {omega} as omega from {grid}),
st as (select {keys}, count(*) as n, avg(x) as mu, stddev_samp(x) as sd from {rows} group by all),
sm as (select {keys}, freq_id, f, omega, sum(sin(2 * omega * t)) as s2, sum(cos(2 * omega * t)) as c2 from {rows}, g group by all),
sh as (select {keys}, freq_id, f, omega, atan(s2 / c2) / (2 * pi()) as tau from sm),
cp as (select {keys}, freq_id, f, omega, tau, any_value(n) as n, any_value(sd) as sd,
  sum(cos((tau - t) * omega) * (x - mu)) as nc, sum(sin((tau - t) * omega) * (x - mu)) as ns,
  sum(cos((tau - t) * omega) ** 2) as dc, sum(sin((tau - t) * omega) ** 2) as ds,
  sum((x - mu) * cos(omega * t)) as uc, sum((x - mu) * sin(omega * t)) as us
  from {rows} join st using ({keys}) join sh using ({keys}) group by all),
{name} as (select {keys}, freq_id, f, omega, tau, n, nc / sd / sqrt(dc) as a, ns / sd / sqrt(ds) as b, nc / sqrt(dc) as ar, ns / sqrt(ds) as br,
  nc / dc as pc, -ns / ds as ps, uc / n as u, us / n as v from cp)"""


def r(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0"


COMP = f"with {EVENTS},\n{parts_sql()}"
PAIRS = COMP + """,
pr as (select l.series_id as series1, r.series_id as series2, l.freq_id, l.f, l.a as a1, l.b as b1, r.a as a2, r.b as b2,
  l.ar as ar1, l.br as br1, r.ar as ar2, r.br as br2, l.u as u1, l.v as v1, r.u as u2, r.v as v2
  from comp l join comp r on l.freq_id = r.freq_id and l.series_id < r.series_id)"""
CO, QU = "0.5 * (a1 * a2 + b1 * b2)", "0.5 * (a1 * b2 - b1 * a2)"
CO0, QU0 = "(ar1 * ar2 + br1 * br2)", "(ar1 * br2 - br1 * ar2)"


def event_parts(spark: SparkSession, d: str, **options) -> DataFrame:
    return components(moments(event_series(spark, d)), **options)


def event_pairs(spark: SparkSession, d: str, **options) -> DataFrame:
    return spectra.pairs(event_parts(spark, d, **options))


def values(df: DataFrame, keys: tuple[str, ...], places: int = 6, **columns: Column) -> DataFrame:
    return df.select(*keys, *[rounded(c, places).alias(n) for n, c in columns.items()])


# sources, statistics, filters


@query("series_stats", f"with {EVENTS} select series_id, count(*) as n, {r('min(t)')} as t_min, {r('max(t)')} as t_max, {r('avg(x)')} as mean, {r('stddev_samp(x)')} as sd, {r('(max(t) - min(t)) / count(*)', 9)} as delta_t, {r('1 / (2 * (max(t) - min(t)) / count(*))')} as f_max from ev group by 1")
def series_stats(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return sampling(event_series(spark, d)).select("series_id", "n", *[rounded(c(x)).alias(x) for x in ("t_min", "t_max", "mean", "sd")], rounded(c("delta_t"), 9).alias("delta_t"), rounded(c("f_max")).alias("f_max"))


@query("sampling_grid", f"with {EVENTS}, st as (select series_id, 1 / (2 * (max(t) - min(t)) / count(*)) as f_max from ev group by 1) select series_id, range as freq_id, {r('range * 0.001')} as f, {r('2 * pi() * range * 0.001')} as omega from st, range(1, 1001) where range * 0.001 <= f_max")
def sampling_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = with_grid(sampling(event_series(spark, d)).select("series_id", "f_max"), 1000).where("f <= f_max")
    return grid.select("series_id", "freq_id", rounded(F.col("f")).alias("f"), rounded(F.col("omega")).alias("omega"))


@query("sampling_grid_whole", f"with {EVENTS}, st as (select series_id, 1 / (2 * (max(t) - min(t)) / count(*)) as f_max from ev group by 1), g as (select series_id, f_max, unnest(range(1, cast(floor(f_max / 0.001) as bigint) + 2)) as freq_id from st) select series_id, freq_id, {r('freq_id * 0.001')} as f, {r('2 * pi() * freq_id * 0.001')} as omega from g where freq_id * 0.001 <= f_max")
def sampling_grid_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every frequency up to each series' own f_max; sampling_grid stops at 1000 points, as its SQL does."""
    grid = with_own_grid(sampling(event_series(spark, d)).select("series_id", "f_max"))
    return grid.select("series_id", "freq_id", rounded(F.col("f")).alias("f"), rounded(F.col("omega")).alias("omega"))


@query("finite_filter", "select user_id, count(*) as n, round(sum(value), 4) + 0.0 as total from events where ts is not null and value is not null and isfinite(value) group by 1")
def finite_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("user_id", F.col("ts").alias("when"), F.col("value").alias("x"))
    return rows.where(F.col("when").isNotNull() & is_finite(F.col("x"))).groupBy("user_id").agg(F.count("*").alias("n"), rounded(F.sum("x"), 4).alias("total"))


# spectra of one series


@query("tau", f"{COMP} select series_id, freq_id, {r('tau')} as tau from comp")
def tau(spark: SparkSession, d: str) -> DataFrame:
    return values(event_parts(spark, d), SERIES, tau=F.col("tau"))


@query("pgram_components", f"{COMP} select series_id, freq_id, {r('a')} as a, {r('b')} as b from comp")
def pgram_components(spark: SparkSession, d: str) -> DataFrame:
    return values(event_parts(spark, d), SERIES, a=F.col("a"), b=F.col("b"))


@query("phase_components", f"{COMP} select series_id, freq_id, {r('pc')} as p_cos, {r('ps')} as p_sin from comp")
def phase_components(spark: SparkSession, d: str) -> DataFrame:
    return values(event_parts(spark, d, standardise=False), SERIES, p_cos=F.col("p_cos"), p_sin=F.col("p_sin"))


@query("power_spectrum", f"{COMP} select series_id, freq_id, {r('0.5 * (a * a + b * b)')} as power from comp")
def power_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return values(event_parts(spark, d), SERIES, power=spectra.power())


@query("sql_periodogram", f"{COMP} select series_id, freq_id, {r('f')} as f, {r('0.5 * (a * a + b * b)')} as power from comp")
def sql_periodogram(spark: SparkSession, d: str) -> DataFrame:
    """The power spectrum by SQL alone: a table function over the series of a query, joined with a table of frequencies."""
    register(spark)
    days = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 86400000000D"
    series = f"SELECT event_type AS series_id, {days} AS t, value AS x FROM parquet.`{d}/events.parquet` WHERE ts IS NOT NULL AND abs(value) < double('Infinity')"
    return spark.sql(f"SELECT p.series_id, p.freq_id, round(g.f, 6) + 0D AS f, round(p.power, 6) + 0D AS power FROM periodogram(TABLE({series}) PARTITION BY (series_id), 200, 0.001D) p JOIN freq_grid(200, 0.001D) g ON g.freq_id = p.freq_id")


@query("amplitude_spectrum", f"with {ORDERS},\n{parts_sql('od')} select series_id, freq_id, {r('0.5 * (a * a + b * b)')} as amplitude from comp")
def amplitude_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return values(components(moments(order_series(spark, d))), SERIES, amplitude=spectra.power())


@query("auto_spectrum", f"{COMP} select series_id, freq_id, {r('0.5 * (a * a + b * b)')} as re, 0.0 as im from comp")
def auto_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return values(event_parts(spark, d), SERIES, re=spectra.power(), im=0.5 * (F.col("a") * F.col("b") - F.col("b") * F.col("a")))


@query("phase_spectrum", f"{COMP} select series_id, freq_id, {r('cos(atan2(-ps, pc))')} as cos_phase, {r('sin(atan2(-ps, pc))')} as sin_phase from comp")
def phase_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """The phase by its cosine and sine, as angles near 0 may fall on either side of the cut."""
    return values(event_parts(spark, d, standardise=False), SERIES, cos_phase=F.cos(spectra.phase()), sin_phase=F.sin(spectra.phase()))


@query("legacy_auto", f"{COMP} select series_id, freq_id, {r('u * u + v * v')} as re from comp")
def legacy_auto(spark: SparkSession, d: str) -> DataFrame:
    rows = spectra.fourier_sums(moments(event_series(spark, d)))
    return values(rows, SERIES, re=F.col("u") * F.col("u") + F.col("v") * F.col("v"))


# spectra of pairs


@query("cospectrum", f"{PAIRS} select series1, series2, freq_id, {r(CO)} as co from pr")
def cospectrum(spark: SparkSession, d: str) -> DataFrame:
    return values(event_pairs(spark, d), PAIR, co=spectra.cospectrum())


@query("quadrature", f"{PAIRS} select series1, series2, freq_id, {r(QU)} as qu from pr")
def quadrature(spark: SparkSession, d: str) -> DataFrame:
    return values(event_pairs(spark, d), PAIR, qu=spectra.quadrature())


@query("cross_spectrum", f"{PAIRS} select series1, series2, freq_id, {r(CO)} as re, {r(QU)} as im from pr")
def cross_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return values(event_pairs(spark, d), PAIR, re=spectra.cospectrum(), im=spectra.quadrature())


@query("cross_amplitude", f"{PAIRS} select series1, series2, freq_id, {r(f'({CO0} ** 2 + {QU0} ** 2) / 1e6', 4)} as amplitude from pr")
def cross_amplitude(spark: SparkSession, d: str) -> DataFrame:
    """In millions, as it is a product of four values."""
    return values(event_pairs(spark, d, standardise=False), PAIR, 4, amplitude=spectra.cross_amplitude() / F.lit(1e6))


@query("cross_phase_compat", f"{PAIRS}, ph as (select *, atan2(-{QU0}, {CO0}) as p from pr) select series1, series2, freq_id, {r('cos((p - 2 * floor(p / 2)) * pi())')} as cos_phase, {r('sin((p - 2 * floor(p / 2)) * pi())')} as sin_phase from ph")
def cross_phase_compat(spark: SparkSession, d: str) -> DataFrame:
    rows = event_pairs(spark, d, standardise=False)
    return values(rows, PAIR, cos_phase=F.cos(spectra.cross_phase()), sin_phase=F.sin(spectra.cross_phase()))


@query("cross_phase", f"{PAIRS} select series1, series2, freq_id, {r(f'cos(atan2(-{QU0}, {CO0}))')} as cos_phase, {r(f'sin(atan2(-{QU0}, {CO0}))')} as sin_phase from pr")
def cross_phase(spark: SparkSession, d: str) -> DataFrame:
    rows = event_pairs(spark, d, standardise=False)
    return values(rows, PAIR, cos_phase=F.cos(spectra.cross_phase(True)), sin_phase=F.sin(spectra.cross_phase(True)))


@query("coherence", f"{PAIRS} select series1, series2, freq_id, {r(f'({CO0} ** 2 + {QU0} ** 2) / (0.5 * (ar1 ** 2 + br1 ** 2) * 0.5 * (ar2 ** 2 + br2 ** 2))')} as coherence from pr")
def coherence(spark: SparkSession, d: str) -> DataFrame:
    return values(event_pairs(spark, d, standardise=False), PAIR, coherence=spectra.squared_coherence())


@query("legacy_cross", f"{PAIRS} select series1, series2, freq_id, {r('u1 * u2 + v1 * v2')} as re, {r('u1 * v2 - v1 * u2')} as im from pr")
def legacy_cross(spark: SparkSession, d: str) -> DataFrame:
    re, im = spectra.legacy_cross()
    return values(spectra.pairs(spectra.fourier_sums(moments(event_series(spark, d))), "u", "v"), PAIR, re=re, im=im)


# integrals and divergences

W = "case when freq_id in (1, 200) then 0.5 else 1.0 end * 0.001"


@query("integral_trapz", f"{PAIRS} select series1, series2, {r(f'sum({W} * {CO})', 8)} as integral from pr group by 1, 2")
def integral_trapz(spark: SparkSession, d: str) -> DataFrame:
    return values(integrals.trapezoid(event_pairs(spark, d), ["series1", "series2"], spectra.cospectrum(), COUNT, STEP), ("series1", "series2"), 8, integral=F.col("integral"))


@query("integral_points", f"{COMP}, y as (select series_id, f, 0.5 * (a * a + b * b) as y from comp where freq_id % 7 <> 3), w as (select series_id, (f - lag(f) over (partition by series_id order by f)) * (y + lag(y) over (partition by series_id order by f)) / 2 as area from y) select series_id, {r('sum(area)', 8)} as integral from w group by 1")
def integral_points(spark: SparkSession, d: str) -> DataFrame:
    """Integral over an uneven grid, as some frequencies are left out."""
    points = event_parts(spark, d).where("freq_id % 7 <> 3").select("series_id", "f", spectra.power().alias("y"))
    return values(integrals.trapezoid_of_points(points, ["series_id"], "f", "y"), ("series_id",), 8, integral=F.col("integral"))


@query("integral_omega", f"with {EVENTS},\n{parts_sql(omega='range * 0.001')} select series_id, {r(f'sum({W} * 0.5 * (a * a + b * b))', 8)} as integral from comp group by 1")
def integral_omega(spark: SparkSession, d: str) -> DataFrame:
    parts = components(moments(event_series(spark, d), variable="omega"))
    return values(divergence.auto_integral(parts, COUNT, STEP), ("series_id",), 8, integral=F.col("integral"))


@query("integral_adaptive", None)
def integral_adaptive(spark: SparkSession, d: str) -> DataFrame:
    """Power of order series over a narrow band by adaptive quadrature, with ever wider tolerances for series that don't settle and
    a trapezoid of 20001 points in the end; `way` is the step that gave the result."""
    blocks, stats = integrals.at_times(order_series(spark, d).withColumn("t", F.col("t") - 8000))

    def some(keys: DataFrame | None) -> DataFrame:
        return blocks if keys is None else blocks.join(keys.select(F.col("key").alias("series_id")), "series_id", "left_semi")

    def attempt(tolerance: float) -> Callable[[DataFrame | None], DataFrame]:
        return lambda keys: integrals.adaptive(spark, 0.001, 0.05, lambda nodes: integrals.power_at(components(integrals.node_sums(some(keys), stats, nodes), mode="paper")), tolerance, 7, 16)

    def grid(keys: DataFrame) -> DataFrame:
        step = (0.05 - 0.001) / 20000
        parts = components(integrals.even_moments(some(keys), stats, 20001, step, 0.001), mode="paper")
        return divergence.auto_integral(parts, 20001, step).select(F.col("series_id").alias("key"), "integral", F.lit(0.0).alias("error"))

    found = integrals.with_ladder([attempt(t) for t in (1e-10, 1e-8, 1e-6)], 1e-6, grid)
    return found.select(F.col("key").alias("series_id"), rounded(F.col("integral"), 4).alias("integral"), "way")


@query("legacy_integral", f"{PAIRS} select series1, series2, {r(f'sum({W} * (u1 * u2 + v1 * v2))', 8)} as integral from pr group by 1, 2")
def legacy_integral(spark: SparkSession, d: str) -> DataFrame:
    rows = spectra.pairs(spectra.fourier_sums(moments(event_series(spark, d))), "u", "v")
    return values(integrals.trapezoid(rows, ["series1", "series2"], spectra.legacy_cross()[0], COUNT, STEP), ("series1", "series2"), 8, integral=F.col("integral"))


#: Cells and nodes of the dense rule that the SQL takes: 5-point Gauss on 60 cells.
GAUSS5 = "(values (-0.906179845938664, 0.236926885056189), (-0.538469310105683, 0.478628670499366), (0.0, 0.568888888888889), (0.538469310105683, 0.478628670499366), (0.906179845938664, 0.236926885056189)) as z(place, weight)"
DENSE = f"""with bare as (select event_type as series_id, epoch_us(ts) / 1e6 / 86400 as t, value as x from events where ts is not null and isfinite(value)),
ev as (select series_id, t - mid as t, x from bare, (select (min(t) + max(t)) / 2 as mid from bare)),
nodes as (select row_number() over (order by c.range, place) as freq_id, 0.001 + 0.015 / 60 * (c.range + (1 + place) / 2) as f, 0.015 / 120 * weight as weight from range(0, 60) c, {GAUSS5}),
{parts_sql(omega='2 * pi() * f', grid='nodes').replace('range as freq_id, range * 0.001 as f', 'freq_id, f')}"""


@query("pair_integrals", f"""{DENSE},
pr as (select l.series_id as series1, r.series_id as series2, weight, l.a as a1, l.b as b1, r.a as a2, r.b as b2, l.u as u1, l.v as v1, r.u as u2, r.v as v2 from comp l join comp r on l.freq_id = r.freq_id and l.series_id <= r.series_id join nodes on nodes.freq_id = l.freq_id)
select series1, series2, {r(f'sum(weight * {CO})', 8)} as co, {r('sum(weight * (u1 * u2 + v1 * v2))', 8)} as legacy from pr group by 1, 2""")
def pair_integrals(spark: SparkSession, d: str) -> DataFrame:
    """Integrals of the cross spectra and pair periodograms of all event series by adaptive quadrature, on a band below where a shift jumps."""
    found = frontier.pair_integrals(*middle_events(spark, d, ("co", "legacy")), 0.001, 0.016)
    wide = found.groupBy("series1", "series2").agg(*[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("co", "legacy")])
    return values(wide, ("series1", "series2"), 8, co=F.col("co"), legacy=F.col("legacy"))


def middle_events(spark: SparkSession, d: str, kinds: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Event series with times from the middle of all, and their pairs, each series with itself too."""
    series = event_series(spark, d)
    mid = series.agg((F.min("t") + F.max("t")) / 2).first()[0] or 0.0
    names = series.select("series_id").distinct()
    pairs = names.select(F.col("series_id").alias("series1")).join(names.select(F.col("series_id").alias("series2")), F.col("series1") <= F.col("series2"))
    return series.withColumn("t", F.col("t") - F.lit(mid)), pairs.withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))


@query("adaptive_divergence", f"""{DENSE},
ow as (select series_id, sum(weight * 0.5 * (a * a + b * b)) as own from comp join nodes using (freq_id) group by 1),
pr as (select l.series_id as series1, r.series_id as series2, sum(weight * 0.5 * (l.a * r.a + l.b * r.b)) as ixy from comp l join comp r on l.freq_id = r.freq_id and l.series_id < r.series_id join nodes on nodes.freq_id = l.freq_id group by 1, 2)
select series1, series2, {r('x.own', 8)} as ix, {r('y.own', 8)} as iy, {r('ixy', 8)} as ixy, {r('0.25 * (x.own + y.own - 2 * ixy) / (2 * pi())', 8)} as j, 'ok' as status, 'OK' as message
from pr join ow x on x.series_id = series1 join ow y on y.series_id = series2""")
def adaptive_divergence(spark: SparkSession, d: str) -> DataFrame:
    """J of event pairs by adaptive quadrature, with the status and message of the cross term."""
    found = frontier.pair_integrals(*middle_events(spark, d, ("co",)), 0.001, 0.016)
    rows = frontier.divergence_integrals(found).join(found.select("series1", "series2", "status", "message"), ["series1", "series2"])
    return values(rows, ("series1", "series2", "status", "message"), 8, ix=F.col("ix"), iy=F.col("iy"), ixy=F.col("ixy"), j=F.col("j"))


DIV = f"sum({W} * 0.5 * (a1 * a1 + b1 * b1)) as ix, sum({W} * 0.5 * (a2 * a2 + b2 * b2)) as iy, sum({W} * {CO}) as ixy"


@query("divergence_matrix", f"{PAIRS}, dv as (select series1, series2, {DIV} from pr group by 1, 2) select series1, series2, {r('ix', 8)} as ix, {r('iy', 8)} as iy, {r('ixy', 8)} as ixy, {r('0.25 * (ix + iy - 2 * ixy) / (2 * pi())', 8)} as j from dv")
def divergence_matrix(spark: SparkSession, d: str) -> DataFrame:
    found = tiles.pair_divergences(event_parts(spark, d), COUNT, STEP)
    return values(found, ("series1", "series2"), 8, ix=F.col("ix"), iy=F.col("iy"), ixy=F.col("ixy"), j=F.col("j"))


@query("jensen_divergence", f"{PAIRS}, dv as (select series1, series2, {DIV} from pr where series1 = 'click' and series2 = 'view' group by 1, 2) select {r('0.25 * (ix + iy - 2 * ixy) / (2 * pi())', 8)} as j from dv")
def jensen_divergence(spark: SparkSession, d: str) -> DataFrame:
    """J of two series; the others are dropped by the scan."""
    series = event_series(spark, d).where(F.col("series_id").isin("click", "view"))
    found = divergence.divergences(spectra.pairs(components(moments(series))), ["series1", "series2"], COUNT, STEP)
    return found.select(rounded(F.col("j"), 8).alias("j"))


TOPS = "tp as (select series_id, cast(ceil(1 / (2 * (max(t) - min(t)) / count(*)) / 0.001) as bigint) as top from od group by 1)"


@query("own_band_divergence", f"""with {ORDERS}, {TOPS},
{parts_sql('od', grid='(select unnest(range(1, (select max(top) + 1 from tp))) as range)')},
pr as (select l.series_id as series1, r.series_id as series2, l.freq_id, l.a as a1, l.b as b1, r.a as a2, r.b as b2, top
  from comp l join comp r on l.freq_id = r.freq_id and l.series_id <> r.series_id join tp on tp.series_id = l.series_id where l.freq_id <= top),
w as (select *, case when freq_id in (1, top) then 0.5 else 1.0 end * 0.001 as w from pr),
dv as (select series1, series2, any_value(top) as top, sum(w * 0.5 * (a1 * a1 + b1 * b1)) as ix, sum(w * 0.5 * (a2 * a2 + b2 * b2)) as iy, sum(w * {CO}) as ixy from w group by 1, 2)
select series1, series2, top, {r('ix')} as ix, {r('iy')} as iy, {r('ixy')} as ixy, {r('0.25 * (ix + iy - 2 * ixy) / (2 * pi())')} as j from dv""")
def own_band_divergence(spark: SparkSession, d: str) -> DataFrame:
    """J of all ordered pairs of order series, on the grid from the step to the pseudo-Nyquist frequency of the first series."""
    series = order_series(spark, d)
    found = divergence.first_band_divergences(series, divergence.band_tops(sampling(series), STEP, False), STEP)
    return values(found, ("series1", "series2", "top"), ix=F.col("ix"), iy=F.col("iy"), ixy=F.col("ixy"), j=F.col("j"))


@query("own_grid_components", f"""with {ORDERS}, {TOPS},
{parts_sql('od', grid='(select unnest(range(1, (select max(top) + 1 from tp))) as range)')}
select series_id, freq_id, {r('a')} as a, {r('b')} as b from comp join tp using (series_id) where freq_id <= top""")
def own_grid_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of order series, each on its own whole grid, by the fast transform; whole days make the sines vanish at half a cycle a day. What the
    transform can't round for certain comes from direct sums."""
    series = order_series(spark, d)
    parts = transforms.band_components(series, divergence.band_tops(sampling(series), STEP, False), STEP, places=6)
    return values(parts, SERIES, a=F.col("a"), b=F.col("b"))


@query("two_band_divergence", f"""with {ORDERS}, {TOPS},
{parts_sql('od', grid='(select unnest(range(1, (select max(top) + 1 from tp))) as range)')},
pw as (select series_id, sum(case when freq_id in (1, top) then 0.5 else 1.0 end * 0.001 * 0.5 * (a * a + b * b)) as own from comp join tp using (series_id) where freq_id <= top group by 1),
pr as (select l.series_id as series1, r.series_id as series2, case when l.freq_id in (1, top) then 0.5 else 1.0 end * 0.001 * 0.5 * (l.a * r.a + l.b * r.b) as c
  from comp l join comp r on l.freq_id = r.freq_id and l.series_id <> r.series_id join tp on tp.series_id = l.series_id where l.freq_id <= top),
dv as (select series1, series2, sum(c) as ixy from pr group by 1, 2)
select series1, series2, {r('x.own')} as ix, {r('y.own')} as iy, {r('ixy')} as ixy, {r('0.25 * (x.own + y.own - 2 * ixy) / (2 * pi())')} as j
from dv join pw x on x.series_id = series1 join pw y on y.series_id = series2""")
def two_band_divergence(spark: SparkSession, d: str) -> DataFrame:
    """J of order series with a band of its own for each: Ix and Ixy up to the first's pseudo-Nyquist frequency, Iy up to the second's."""
    series = order_series(spark, d)
    found = divergence.two_band_divergences(series, divergence.band_tops(sampling(series), STEP, False), STEP)
    return values(found, ("series1", "series2"), ix=F.col("ix"), iy=F.col("iy"), ixy=F.col("ixy"), j=F.col("j"))


@query("band_divergence", f"""{COMP}, tp as (select series_id, least(200, 60 + 20 * (row_number() over (order by series_id))) as top from (select distinct series_id from ev)),
pr as (select l.series_id as series1, r.series_id as series2, l.freq_id, l.a as a1, l.b as b1, r.a as a2, r.b as b2, t1.top as top1, t2.top as top2
  from comp l join comp r on l.freq_id = r.freq_id and l.series_id < r.series_id join tp t1 on t1.series_id = l.series_id join tp t2 on t2.series_id = r.series_id),
w as (select *, case when freq_id > top1 then 0 when freq_id in (1, top1) then 0.5 else 1 end * 0.001 as w1, case when freq_id > top2 then 0 when freq_id in (1, top2) then 0.5 else 1 end * 0.001 as w2 from pr),
dv as (select series1, series2, sum(w1 * 0.5 * (a1 * a1 + b1 * b1)) as ix, sum(w2 * 0.5 * (a2 * a2 + b2 * b2)) as iy, sum(w1 * {CO}) as ixy from w group by 1, 2)
select series1, series2, {r('0.25 * (ix + iy - 2 * ixy) / (2 * pi())', 8)} as j from dv""")
def band_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Each series with a band of its own."""
    series = event_series(spark, d)
    bands = numbered(series.select("series_id").distinct(), (), ("series_id",)).select("series_id", F.least(F.lit(COUNT), 60 + 20 * F.col("i")).alias("top"))
    found = divergence.band_divergences(spectra.pairs(components(moments(series))), bands, STEP)
    return found.select("series1", "series2", rounded(F.col("j"), 8).alias("j"))


@query("nearest_series", f"{PAIRS}, dv as (select series1, series2, {DIV} from pr group by 1, 2), m as (select series1, series2, 0.25 * (ix + iy - 2 * ixy) / (2 * pi()) as j from dv), b as (select * from m union all select series2, series1, j from m), k as (select *, row_number() over (partition by series1 order by j, series2) as rank from b) select series1, series2, rank from k where rank <= 2")
def nearest_series(spark: SparkSession, d: str) -> DataFrame:
    found, _ = tiles.nearest_by_pivots(event_parts(spark, d), COUNT, STEP, 2)
    return found.select("series1", "series2", "rank")


PANELS = f"""with pn as (select 'p' || lpad(cast(user_id % 60 as varchar), 2, '0') as series_id, epoch_us(ts) / 1e6 / 86400 as t, value as x from events where ts is not null and isfinite(value)),
{parts_sql('pn')},
dv as (select l.series_id as series1, r.series_id as series2, sum({W.replace('freq_id', 'l.freq_id')} * 0.5 * ((l.a - r.a) ** 2 + (l.b - r.b) ** 2)) * 0.25 / (2 * pi()) as j
  from comp l join comp r on l.freq_id = r.freq_id and l.series_id <> r.series_id group by 1, 2),
k as (select *, row_number() over (partition by series1 order by j, series2) as rank from dv)"""


def panel_parts(spark: SparkSession, d: str) -> DataFrame:
    """Components of 60 series: events by the panel of their user."""
    panel = F.concat(F.lit("p"), F.lpad((F.col("user_id") % 60).cast("string"), 2, "0"))
    users = read(spark, d, "events").select(panel.alias("series_id"), epoch_days(F.col("ts")).alias("t"), F.col("value").alias("x"))
    return written(components(moments(finite_pairs(users))).select("series_id", "freq_id", "a", "b"), "panels")


@query("nearest_panels", f"{PANELS} select series1, series2, rank, {r('j', 9)} as j from k where rank <= 3")
def nearest_panels(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest of each of 60 series, exactly, by distances to pivots and what their bounds leave."""
    found, _ = tiles.nearest_by_pivots(panel_parts(spark, d), COUNT, STEP, 3, tile=16)
    return found.select("series1", "series2", F.col("rank").cast("long").alias("rank"), rounded(F.col("j"), 9).alias("j"))


@query("panel_clusters", PANELS.replace("with pn", "with recursive pn", 1) + """, h as (select avg(j) as h from k where rank = 1), e as (select series1, series2 from dv, h where j <= h),
reach as (select distinct series1 as series_id, series1 as other from dv union select reach.series_id, e.series2 from reach join e on reach.other = e.series1)
select series_id, min(other) as cluster from reach group by 1""")
def panel_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Single-linkage clusters of 60 series, cut at the mean J of nearest neighbours."""
    parts = panel_parts(spark, d)
    nearest, _ = tiles.nearest_by_pivots(parts, COUNT, STEP, 1, tile=16)
    height = nearest.agg(F.avg("j")).first()[0] or 0.0
    return tiles.cut(tiles.single_linkage(parts, COUNT, STEP, 16), parts.select("series_id").distinct(), height=height)


@query("prefix_divergence", f"""with {EVENTS}, rk as (select *, row_number() over (partition by series_id order by t, row_id) as rank from ev),
pf as (select series_id, length, t, x from rk, (values (100), (150), (200)) as p(length) where rank <= length),
{parts_sql('pf', 'series_id, length')},
pr as (select l.series_id as series1, r.series_id as series2, l.length, l.freq_id, l.a as a1, l.b as b1, r.a as a2, r.b as b2 from comp l join comp r on l.freq_id = r.freq_id and l.length = r.length and l.series_id < r.series_id),
dv as (select series1, series2, length, {DIV} from pr group by 1, 2, 3)
select series1, series2, length, {r('0.25 * (ix + iy - 2 * ixy) / (2 * pi())', 8)} as j from dv""")
def prefix_divergence(spark: SparkSession, d: str) -> DataFrame:
    parts = components(moments(cleaning.prefixes(event_series(spark, d), [100, 150, 200]), keys=("series_id", "length")))
    side = lambda k: parts.select("length", "freq_id", F.col("series_id").alias(f"series{k}"), F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}"))
    joined = side(1).join(side(2), ["length", "freq_id"]).where("series1 < series2")
    found = divergence.divergences(joined, ["series1", "series2", "length"], COUNT, STEP)
    return found.select("series1", "series2", "length", rounded(F.col("j"), 8).alias("j"))


def prefix_sql(rows: str, name: str) -> str:
    """J of every pair and length, each prefix from its own observations."""
    return f"""with {rows}, rk as (select *, row_number() over (partition by series_id order by t, row_id) as rank, count(*) over (partition by series_id) as n from {name}),
pf as (select series_id, length, t, x from rk, (select unnest(range(100, (select max(n) + 1 from rk), 50)) as length) where rank <= length and length <= n),
{parts_sql('pf', 'series_id, length')},
pr as (select l.series_id as series1, r.series_id as series2, l.length, l.freq_id, l.a as a1, l.b as b1, r.a as a2, r.b as b2 from comp l join comp r on l.freq_id = r.freq_id and l.length = r.length and l.series_id < r.series_id),
dv as (select series1, series2, length, {DIV} from pr group by 1, 2, 3)
select series1, series2, length, {r('0.25 * (ix + iy - 2 * ixy) / (2 * pi())', 8)} as j from dv"""


@query("growing_events", prefix_sql(EVENTS, "ev"))
def growing_events(spark: SparkSession, d: str) -> DataFrame:
    """J of event pairs for their first 100 observations, 150, and so on up to the whole length."""
    return prefixes.prefix_divergences(event_series(spark, d)).select("series1", "series2", "length", rounded(F.col("j"), 8).alias("j"))


@query("growing_orders", prefix_sql(ORDERS, "od"))
def growing_orders(spark: SparkSession, d: str) -> DataFrame:
    """The same of order pairs."""
    return prefixes.prefix_divergences(order_series(spark, d)).select("series1", "series2", "length", rounded(F.col("j"), 8).alias("j"))


@query("multitaper", None)
def multitaper(spark: SparkSession, d: str) -> DataFrame:
    parts = tapers.multitaper_components(order_series(spark, d), 4)
    return values(tapers.multitaper_cross(parts), PAIR, co=F.col("co"))


# cleaning and conversion


@query("flux_to_mag", f"with {ORDERS}, m as (select series_id, median(x) as m from od group by 1) select series_id, row_id, {r('-2.5 * log10(x / m)')} as mag, {r('2.5 / ln(10) * 0.01')} as mag_err from od join m using (series_id)")
def flux_to_mag(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.magnitudes(order_series(spark, d).withColumn("x_err", F.col("x") * 0.01))
    return values(rows, ("series_id", "row_id"), mag=F.col("mag"), mag_err=F.col("mag_err"))


@query("positive_clip", f"with {ORDERS}, s as (select series_id, row_id, x - 50000 as x from od), m as (select series_id, min(x) filter (where x > 0) as m from s group by 1) select series_id, row_id, {r('case when x > 0 then x else m end', 4)} as x from s join m using (series_id)")
def positive_clip(spark: SparkSession, d: str) -> DataFrame:
    return values(cleaning.positive_clip(order_series(spark, d).withColumn("x", F.col("x") - 50000)), ("series_id", "row_id"), 4, x=F.col("x"))


@query("sigma_clip", f"with {EVENTS}, m as (select series_id, median(x) as m, stddev_pop(x) as s from ev group by 1), k as (select ev.* from ev join m using (series_id) where abs(x - m) <= 3 * s), m2 as (select series_id, median(x) as m, stddev_pop(x) as s from k group by 1) select k.series_id, k.row_id, {r('k.x')} as x from k join m2 using (series_id) where abs(x - m) <= 3 * s")
def sigma_clip(spark: SparkSession, d: str) -> DataFrame:
    return values(cleaning.sigma_clip(event_series(spark, d), 3.0, 2), ("series_id", "row_id"), x=F.col("x"))


@query("time_offset", f"with {EVENTS}, m as (select series_id, median(t) as m from ev group by 1) select series_id, row_id, {r('case when m < 1e5 then t + 2454833 else t end', 4)} as t from ev join m using (series_id)")
def time_offset(spark: SparkSession, d: str) -> DataFrame:
    return values(cleaning.absolute_time(event_series(spark, d), cleaning.OFFSETS["Kepler"]), ("series_id", "row_id"), 4, t=F.col("t"))


@query("sampled_series", f"with {EVENTS}, k as (select *, row_number() over (partition by series_id order by md5('7:' || row_id), row_id) as place from ev) select series_id, row_id, {r('x')} as x from k where place <= 300")
def sampled_series(spark: SparkSession, d: str) -> DataFrame:
    """300 random observations of each event series."""
    return values(cleaning.sampled(event_series(spark, d), 300, 7), ("series_id", "row_id"), x=F.col("x"))


@query("stitch", f"with {EVENTS}, s as (select *, floor(t / 10) as segment from ev), m as (select series_id, segment, median(x) as m from s group by 1, 2) select s.series_id, s.row_id, {r('s.x / m.m')} as x from s join m using (series_id, segment)")
def stitch(spark: SparkSession, d: str) -> DataFrame:
    return values(cleaning.stitched(event_series(spark, d).withColumn("segment", F.floor(F.col("t") / 10))), ("series_id", "row_id"), x=F.col("x"))


@query("label_consensus", "select o_custkey, case when count(distinct o_orderstatus) = 1 then min(o_orderstatus) else 'MIXED_FLUX' end as label from orders group by 1")
def label_consensus(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg(cleaning.label_consensus("o_orderstatus").alias("label"))


@query("text_format", f"with {EVENTS} select series_id, row_id, printf('%.8f %.6f %.6f', floor(t * 64) / 64, x, x / 100) as value from ev")
def text_format(spark: SparkSession, d: str) -> DataFrame:
    """Times are cut to 1/64 day, so that their decimals are exact in both engines."""
    curves = event_series(spark, d).select(F.struct("series_id", "row_id").alias("series_id"), (F.floor(F.col("t") * 64) / 64).alias("time"), F.col("x").alias("mag"), (F.col("x") / 100).alias("mag_err"))
    return light_curve_lines(curves).select("series_id.series_id", "series_id.row_id", "value")


# autoregression and folding


@query("phase_fold", f"with {EVENTS}, m as (select series_id, min(t) as m from ev group by 1), p as (select series_id, row_id, (t - m) * 0.7 as p from ev join m using (series_id)) select series_id, row_id, {r('cos(2 * pi() * (p - floor(p)))')} as cos_phase, {r('sin(2 * pi() * (p - floor(p)))')} as sin_phase from p")
def phase_fold(spark: SparkSession, d: str) -> DataFrame:
    angle = F.lit(2 * 3.141592653589793) * F.col("phase")
    return values(autoregression.folded(event_series(spark, d), 0.7), ("series_id", "row_id"), cos_phase=F.cos(angle), sin_phase=F.sin(angle))


LAG = f"with {EVENTS}, st as (select series_id, avg(x) as mu, stddev_samp(x) as sd from ev group by 1), z as (select series_id, row_id, t, (x - mu) / sd as x from ev join st using (series_id)), lg as (select *, t - lag(t) over w as gap, lag(x) over w as before from z window w as (partition by series_id order by t, row_id))"


@query("iar_fit", f"{LAG} select series_id, row_id, {r('coalesce(0.4 ** gap * before, 0)')} as fit from lg")
def iar_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = autoregression.lagged(autoregression.standardised(event_series(spark, d)))
    return values(rows, ("series_id", "row_id"), fit=autoregression.fitted(F.lit(0.4)))


@query("iar_mle_grid", f"{LAG}, c as (select range / 50.0 as phi from range(1, 50)), l as (select series_id, phi, sum(case when gap is null then x * x when gap > 0 then ln(1 - phi ** (2 * gap)) + (x - phi ** gap * before) ** 2 / (1 - phi ** (2 * gap)) end) / 2 as nll from lg, c group by 1, 2) select series_id, {r('arg_min(phi, nll)')} as phi, {r('min(nll) / 1000', 2)} as nll from l group by 1")
def iar_mle_grid(spark: SparkSession, d: str) -> DataFrame:
    """The likelihood in thousands, as tiny gaps make its last digits differ between engines."""
    found = autoregression.estimated(event_series(spark, d))
    return found.select("series_id", rounded(F.col("phi")).alias("phi"), rounded(F.col("nll") / 1000, 2).alias("nll"))


@query("iar_mle", f"""with recursive {ORDERS}, wv as (select series_id, row_id, t, x + 200000 * sin(t / 20) as x from od),
st as (select series_id, avg(x) as mu, stddev_samp(x) as sd from wv group by 1), z as (select series_id, row_id, t, (x - mu) / sd as x from wv join st using (series_id)),
lg as (select *, t - lag(t) over w as gap, lag(x) over w as before from z window w as (partition by series_id order by t, row_id)), use as (select * from lg where gap > 0),
c as (select range / 50.0 as phi from range(1, 50)), l as (select series_id, phi, sum(ln(1 - phi ** (2 * gap)) + (x - phi ** gap * before) ** 2 / (1 - phi ** (2 * gap))) as nll from use, c group by 1, 2),
b as (select series_id, cast(0 as bigint) as k, {{'low': arg_min(phi, nll) - 0.02, 'high': arg_min(phi, nll) + 0.02}} as w from l group by 1
  union all
  select b.series_id, b.k + 1, case when sum((-gap * phi ** (2 * gap - 1)) / (1 - phi ** (2 * gap)) - (x - phi ** gap * before) * gap * phi ** (gap - 1) * before / (1 - phi ** (2 * gap)) + (x - phi ** gap * before) ** 2 * gap * phi ** (2 * gap - 1) / (1 - phi ** (2 * gap)) ** 2) < 0
      then {{'low': any_value(phi), 'high': any_value(b.w.high)}} else {{'low': any_value(b.w.low), 'high': any_value(phi)}} end
  from (select *, (w.low + w.high) / 2 as phi from b where k < 34) b join use using (series_id) group by 1, 2)
select series_id, {r('(w.low + w.high) / 2')} as phi, 'ok' as status from b where k = 34""")
def iar_mle(spark: SparkSession, d: str) -> DataFrame:
    """The most likely phi of order series with a slow wave added, so that neighbours resemble each other; SQL halves the score's sign change."""
    wave = order_series(spark, d).withColumn("x", F.col("x") + 200000 * F.sin(F.col("t") / 20))
    found = autoregression.maximum_likelihood(wave)
    return found.select("series_id", rounded(F.col("phi")).alias("phi"), "status")


def drawn_sql(start: int) -> str:
    return f"(('0x' || md5('7:' || row_id)[{start}:{start + 11}])::bigint + 0.5::double) / 2::double ** 48"


@query("iar_simulation", f"""with {EVENTS}, e as (select * replace (floor(t * 1024) / 1024 as t), sqrt(-2 * ln({drawn_sql(1)})) * cos(2 * pi() * {drawn_sql(13)}) as e from ev),
g as (select *, t - lag(t) over w as gap, row_number() over w as i from e window w as (partition by series_id order by t, row_id)),
s as (select series_id, row_id, t, i, phi, case when gap is null then e else sqrt(1 - phi ** (2 * gap)) * e end as s from g, (select unnest([0.3, 0.9])::double as phi))
select l.series_id, l.row_id, l.phi, {r('sum(l.phi ** (l.t - r.t) * r.s)')} as x from s l join s r on l.series_id = r.series_id and l.phi = r.phi and r.i <= l.i group by 1, 2, 3""")
def iar_simulation(spark: SparkSession, d: str) -> DataFrame:
    """Autoregressive series on the events' own times for two values of phi, of normal shocks that both sides draw from row ids. Times are cut
    to 1/1024 day, as small gaps would show the last digits of a time."""
    hashed = F.md5(F.concat(F.lit("7:"), F.col("row_id").cast("string")))
    u = lambda start: (F.conv(F.substring(hashed, start, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**48)
    shock = F.sqrt(-2 * F.log(u(1))) * F.cos(F.lit(TAU) * u(13))
    times = event_series(spark, d).withColumn("t", F.floor(F.col("t") * 1024) / F.lit(1024.0))
    found = autoregression.simulated_sweep(times, (0.3, 0.9), shock=shock)
    return found.select("series_id", "row_id", F.col("true_phi").alias("phi"), rounded(F.col("x")).alias("x"))


#: Rows a run, tapers by nw, frequencies and their step, and values of phi of the fits by runs.
RUN, RUN_BANDS, RUN_COUNT, RUN_STEP, RUN_PHIS = 64, (2, 3), 40, 0.005, (0.3, 0.7)


def taper_rows() -> str:
    """The tapers of a run as rows of SQL (nw, taper, i, w), from their definition: leading eigenvectors of the kernel sin(2 pi W d) / (pi d)."""
    d = np.subtract.outer(np.arange(RUN), np.arange(RUN))
    rows = []
    for nw in RUN_BANDS:
        v = np.linalg.eigh(2 * nw / RUN * np.sinc(2 * nw / RUN * d))[1][:, ::-1]
        rows += [f"({nw}, {k + 1}, {i + 1}, {v[i, k]!r})".replace("np.float64(", "").replace("))", ")") for k in range(2 * nw) for i in range(RUN)]
    return ", ".join(rows)


RUN_W = f"case when freq_id in (1, {RUN_COUNT}) then 0.5 else 1.0 end * {RUN_STEP}"
RUN_PARTS = parts_sql("tp", "series_id, run, phi, nw, taper, val", f"2 * pi() * range * {RUN_STEP}", "comp", f"range(1, {RUN_COUNT + 1})").replace("range * 0.001", f"range * {RUN_STEP}").replace("\nst as", "\nss as").replace("join st ", "join ss ")


@query("multitaper_runs", f"""{LAG}, nb as (select *, row_number() over (partition by series_id order by t, row_id) as i, count(*) over (partition by series_id) as n from lg),
rn as (select *, unnest(range(0, (n + {RUN - 1}) // {RUN})) as run from nb where n >= {RUN}),
rr as (select series_id, run, t, x, gap, before, i - least(run * {RUN}, n - {RUN}) as k from rn where i > least(run * {RUN}, n - {RUN}) and i <= least(run * {RUN}, n - {RUN}) + {RUN}),
ph as (select unnest({list(RUN_PHIS)})::double as phi),
xy as (select series_id, run, phi, 'x' as val, k, t, x as v from rr, ph union all select series_id, run, phi, 'y', k, t, coalesce(phi ** gap * before, 0) from rr, ph),
dm as (select * replace (v - avg(v) over (partition by series_id, run, phi, val) as v) from xy),
w(nw, taper, k, w) as (values {taper_rows()}),
tp as (select series_id, run, phi, nw, taper, val, t, v * w as x from dm join w using (k)),
{RUN_PARTS},
pr as (select series_id, run, phi, nw, taper, freq_id, l.a as a1, l.b as b1, r.a as a2, r.b as b2 from comp l join comp r using (series_id, run, phi, nw, taper, freq_id) where l.val = 'x' and r.val = 'y'),
dv as (select series_id, run, phi, nw, taper, sum({RUN_W} * 0.5 * (a1 * a1 + b1 * b1)) as ix, sum({RUN_W} * 0.5 * (a2 * a2 + b2 * b2)) as iy, sum({RUN_W} * {CO}) as ixy from pr group by all),
ta as (select series_id, run, phi, nw, avg(ix) as ix, avg(iy) as iy, avg(ixy) as ixy from dv group by all)
select series_id, phi, nw, count(*) as runs, {r('avg(ix)')} as ix, {r('avg(iy)')} as iy, {r('avg(ixy)')} as ixy, {r('avg(0.25 * (ix + iy - 2 * ixy) / (2 * pi()))')} as j from ta group by 1, 2, 3""")
def multitaper_runs(spark: SparkSession, d: str) -> DataFrame:
    """Divergence of each series from its autoregressive fit for two values of phi, by multitaper with two bandwidths, by runs of 64 observations."""
    found = autoregression.run_fits(event_series(spark, d), RUN_PHIS, RUN, RUN_BANDS, RUN_COUNT, RUN_STEP)
    return values(found, ("series_id", "phi", "nw", "runs"), ix=F.col("ix"), iy=F.col("iy"), ixy=F.col("ixy"), j=F.col("j"))


@query("iar_sweep", None)
def iar_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Divergence of simulated series on the events' own times from their fits, by phi, on one grid (nw 0) and by multitaper."""
    found = autoregression.sweep(event_series(spark, d), [0.01 + 0.025 * k for k in range(40)], (2, 3, 4, 5))
    return values(found, ("series_id",), phi=F.col("true_phi"), nw=F.col("nw"), estimate=F.col("phi"), j=F.col("j"))


@query("table_filter_pairs", f"with {ORDERS} select series_id, count(*) as n, {r('avg(x)', 4)} as mean from od where t > 9000 and x < 200000 group by 1")
def table_filter_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A time and value cut that reaches the scan, then statistics of what is left."""
    rows = finite_pairs(order_series(spark, d)).where("t > 9000 and x < 200000")
    return rows.groupBy("series_id").agg(F.count("*").alias("n"), rounded(F.avg("x"), 4).alias("mean"))
