"""Registered queries on light curves as text and as mission flux, on series of two catalogues, and on dimensions of series."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumachron.functions.numeric import is_finite, rounded
from lumachron.jobs.registry import CO, COMP, EVENTS, ORDERS, QU, event_parts, parts_sql, query, r, values
from lumachron.operators import cleaning, spectra
from lumachron.operators.blocks import shared_folder
from lumachron.operators.moments import components, moments, sampling
from lumachron.sources.series import event_series, order_series, parsed, read, read_light_curves, tokens_of, write_light_curves


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """series_id, row_id, value: events as lines of text, some with comments, bad values, bad errors, or two columns."""
    rows = event_series(spark, d).select("series_id", "row_id", F.col("row_id").cast("string").alias("t"), F.format_string("%.6f", "x").alias("x"))
    k = lambda n: F.col("row_id") % n == 0
    mag = F.when(k(7), F.lit("abc")).otherwise(F.col("x"))
    error = F.when(k(11), F.lit(" nan")).when(k(5), F.lit("")).otherwise(F.lit("  0.25"))
    line = F.when(k(13), F.lit("# # a comment")).otherwise(F.concat(F.lit(" "), "t", F.lit("\t"), mag, error, F.when(k(3), F.lit(" # note")).otherwise(F.lit(""))))
    return rows.select("series_id", "row_id", line.alias("value"))


LINES = f"with {EVENTS}, ln as (select series_id, row_id, x, row_id % 7 = 0 as bad, row_id % 11 = 0 as nan, row_id % 11 <> 0 and row_id % 5 = 0 as two from ev where row_id % 13 <> 0)"


@query("strict_reader", f"{LINES} select series_id, row_id, cast(row_id as double) as time, {r('x')} as mag, case when two then null else 0.25 end as mag_err from ln where not bad and not nan")
def strict_reader(spark: SparkSession, d: str) -> DataFrame:
    """Lines as a strict reader takes them: rows with a value that is no number go, also for the error alone."""
    return parsed(tokens_of(event_lines(spark, d)), "strict", "row_id").select("series_id", "row_id", "time", rounded(F.col("mag")).alias("mag"), "mag_err")


@query("loose_reader", f"{LINES} select series_id, row_id, cast(row_id as double) as time, case when bad then null else {r('x')} end as mag, case when two or nan then null else 0.25 end as mag_err from ln")
def loose_reader(spark: SparkSession, d: str) -> DataFrame:
    """Lines as a loose reader takes them: nothing goes, what is no number is null (here NaN too, so that engines compare alike)."""
    rows = parsed(tokens_of(event_lines(spark, d)), "loose", "row_id")
    return rows.select("series_id", "row_id", "time", rounded(F.col("mag")).alias("mag"), F.when(is_finite(F.col("mag_err")), F.col("mag_err")).alias("mag_err"))


@query("mission_to_text", f"""with {ORDERS}, fl as (select series_id, row_id, t, x - 3000 as x, case when row_id % 9 = 0 then -1.0 else x * 0.01 end as e, floor(t / 90) as segment from od),
m as (select series_id, segment, median(x) as m from fl group by 1, 2), st as (select series_id, row_id, t, x / m as x, e / m as e from fl join m using (series_id, segment)),
c1 as (select series_id, median(x) as m, stddev_pop(x) as s from st group by 1), k1 as (select st.* from st join c1 using (series_id) where abs(x - m) <= 2 * s),
c2 as (select series_id, median(x) as m, stddev_pop(x) as s from k1 group by 1), k2 as (select k1.* from k1 join c2 using (series_id) where abs(x - m) <= 2 * s),
o as (select series_id, median(t) as mt, min(x) filter (where x > 0) as least from k2 group by 1),
p as (select series_id, row_id, case when mt < 1e5 then t + 2454833 else t end as t, case when x > 0 then x else least end as x, e from k2 join o using (series_id)),
f as (select series_id, median(x) as m from p group by 1)
select series_id, round(t, 8) as time, count(*) as n, {r('sum(round(-2.5 * log10(x / m), 6))')} as mag, {r('sum(round(2.5 / ln(10) * e / x, 6))')} as mag_err from p join f using (series_id) where e > 0 group by 1, 2""")
def mission_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Order prices as mission flux: converted to light curves, written as text, and read again. Rows whose error isn't
    positive are written with NaN, and the strict reader drops them. Summed up by time, as several orders have one."""
    flux = order_series(spark, d).withColumn("x_err", F.when(F.col("row_id") % 9 == 0, F.lit(-1.0)).otherwise(F.col("x") * 0.01))
    flux = flux.withColumn("pdcsap_flux", F.col("x") - 3000).withColumn("segment", F.floor(F.col("t") / 90)).drop("x")
    path = f"{shared_folder(spark)}/light-curves-{uuid.uuid4().hex}"
    write_light_curves(cleaning.light_curves(flux, "Kepler", 2.0, 2), path)
    rows = read_light_curves(spark, path, by_folder=True)
    return rows.groupBy("series_id", "time").agg(F.count("*").alias("n"), rounded(F.sum("mag"), 6).alias("mag"), rounded(F.sum("mag_err"), 6).alias("mag_err"))


@query("cross_catalogue", f"""with {EVENTS}, {ORDERS},
{parts_sql('ev')}, {parts_sql('od', name='comp2').replace('g as (', 'g2 as (').replace('st as (', 'st2 as (').replace('sm as (', 'sm2 as (').replace('sh as (', 'sh2 as (').replace('cp as (', 'cp2 as (').replace('from od, g ', 'from od, g2 ').replace('from sm)', 'from sm2)').replace('join st using', 'join st2 using').replace('join sh using', 'join sh2 using').replace('from cp)', 'from cp2)')},
pr as (select l.series_id as series1, r.series_id as series2, l.freq_id, l.a as a1, l.b as b1, r.a as a2, r.b as b2 from comp l join comp2 r on l.freq_id = r.freq_id)
select series1, series2, freq_id, {r(CO)} as re, {r(QU)} as im from pr""")
def cross_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Cross spectra of each event series with each order series: pairs across two catalogues."""
    both = event_series(spark, d).withColumn("catalogue", F.lit("events")).unionByName(order_series(spark, d).withColumn("catalogue", F.lit("orders")))
    parts = components(moments(both, keys=("catalogue", "series_id")))
    rows = spectra.pairs(parts, "a", "b", "catalogue", across=(F.col("catalogue1") == "events") & (F.col("catalogue2") == "orders"))
    return values(rows, ("series1", "series2", "freq_id"), re=spectra.cospectrum(), im=spectra.quadrature())


@query("spectrum_range", f"{COMP}, p as (select 0.5 * (a * a + b * b) as p, a, b from comp) select {r('min(p)')} as least, {r('max(p)')} as greatest, {r('max(abs(a))')} as largest_a, {r('max(abs(b))')} as largest_b from p")
def spectrum_range(spark: SparkSession, d: str) -> DataFrame:
    """Least and greatest power of all series and frequencies, and the largest components: limits for axes and diagnostics."""
    parts = event_parts(spark, d)
    return parts.agg(*[rounded(c).alias(n) for n, c in {"least": F.min(spectra.power()), "greatest": F.max(spectra.power()), "largest_a": F.max(F.abs("a")), "largest_b": F.max(F.abs("b"))}.items()])


@query("target_dimension", f"with sr as (select c_mktsegment as series_id, epoch_us(o_orderdate) / 1e6 / 86400 as t, o_totalprice as x from orders join customer on o_custkey = c_custkey where o_orderdate is not null and isfinite(o_totalprice)) select series_id, count(*) as n, {r('min(t)')} as t_min, {r('max(t)')} as t_max, {r('avg(x)', 4)} as mean, {r('stddev_samp(x)', 4)} as sd from sr group by 1")
def target_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Orders as series by their customers' market segment: a dimension joined to the observations."""
    targets = read(spark, d, "customer").select(F.col("c_custkey").alias("target"), F.col("c_mktsegment").alias("segment"))
    keyed = read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("target"))
    rows = order_series(spark, d).drop("series_id").join(keyed, "row_id").join(targets, "target").withColumnRenamed("segment", "series_id")
    stats = sampling(rows)
    return stats.select("series_id", "n", rounded(F.col("t_min")).alias("t_min"), rounded(F.col("t_max")).alias("t_max"), rounded(F.col("mean"), 4).alias("mean"), rounded(F.col("sd"), 4).alias("sd"))
