"""Series: long tables (series_id, t, x), a row an observation; from tables and from light-curve text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumachron.functions.numeric import epoch_days, is_finite

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(?i)[+-]?(inf|infinity|nan)$"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def finite_pairs(series: DataFrame) -> DataFrame:
    """Observations whose time and value are both finite."""
    return series.where(is_finite(F.col("t")) & is_finite(F.col("x")))


def event_series(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "events").select(F.col("event_type").alias("series_id"), epoch_days(F.col("ts")).alias("t"), F.col("value").alias("x"), F.col("event_id").alias("row_id"))
    return finite_pairs(rows)


def order_series(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "orders").select(F.col("o_orderpriority").alias("series_id"), epoch_days(F.col("o_orderdate")).alias("t"), F.col("o_totalprice").alias("x"), F.col("o_orderkey").alias("row_id"))
    return finite_pairs(rows)


def tokens_of(lines: DataFrame) -> DataFrame:
    """Blank-separated tokens of lines without what follows a #; empty lines go."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), r"[\s]+", " "))
    return lines.withColumn("value", bare).where("value <> ''").withColumn("tokens", F.split("value", " "))


def read_light_curves(spark: SparkSession, path: str | list[str], mode: str = "strict", skip_first_row: bool = False, by_folder: bool = False) -> DataFrame:
    """series_id, time, mag, mag_err of light-curve text files, a series a file name, or a folder series_id=... as they are written here.

    strict: a file has 2 or 3 columns, as many as its widest line, or reading fails; rows with a value that isn't a number or is missing are dropped, also
    for the error column alone; infinities stay. loose: at least 2 columns, bad values are null, nothing is dropped. Copies of a file
    that differ in a .txt ending alone are read once. skip_first_row: as readers do that take it for a header.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    series = F.regexp_replace(F.regexp_replace("file", r"\.txt$", ""), r"\.dat$", "")
    if by_folder:  # names of folders are escaped, and paths are once more
        name = F.regexp_extract(F.col("_metadata.file_path"), "/series_id=([^/]*)/", 1)
        series = F.url_decode(F.url_decode(F.replace(name, F.lit("+"), F.lit("%252B"))))
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), series.alias("folder"))
        series = F.col("folder")
    rows = lines.withColumn("series_id", series).withColumn("line", F.monotonically_increasing_id())
    if not by_folder:
        first = rows.groupBy("series_id").agg(F.min("file").alias("file"))
        rows = rows.join(first, ["series_id", "file"], "left_semi")
    rows = tokens_of(rows)
    if mode == "strict":  # a file has as many columns as its widest line
        widths = rows.groupBy("file").agg(F.max(F.size("tokens")).alias("columns"))
        rows = rows.join(widths, "file")
    if skip_first_row:
        first = rows.groupBy("file").agg(F.min(F.struct("block", "line")).alias("first"))
        rows = rows.join(first, "file").where(F.struct("block", "line") != F.col("first"))
    return parsed(rows, mode)


def parsed(rows: DataFrame, mode: str = "strict", *keep: str) -> DataFrame:
    """series_id, time, mag, mag_err (and columns to keep) of tokenised lines, as read_light_curves has them; errors name series_id. Lines
    without `columns`, the number of their file's columns, are judged each by its own."""
    columns = F.col("columns") if "columns" in rows.columns else F.size("tokens")
    number = lambda k: F.when(F.get("tokens", F.lit(k)).rlike(NUMBER), F.expr(f"try_cast(get(tokens, {k}) as double)"))
    if mode == "strict":  # part of the values, so that no filter on them comes before it
        wrong = F.raise_error(F.concat(F.col("series_id"), F.lit(": expected 2 or 3 columns"))).cast("double")
        plain, number = number, lambda k: F.when((columns < 2) | (columns > 3), wrong).otherwise(plain(k))
    values = rows.select("series_id", *keep, number(0).alias("time"), number(1).alias("mag"), number(2).alias("mag_err"), columns.alias("width"))
    if mode == "strict":
        good = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
        values = values.where(good("time") & good("mag") & ((F.col("width") == 2) | good("mag_err")))
    return values.drop("width")


def name_parts(series_id: str = "series_id") -> list[F.Column]:
    """survey, field, class and star of names like SURVEY-FIELD-CLASS-00001."""
    pattern = r"^([A-Z]+)-([A-Z]+)-([A-Z]+)-(\d+)$"
    return [F.regexp_extract(series_id, pattern, k).alias(n) for k, n in enumerate(("survey", "field", "class", "star"), 1)]


def light_curve_lines(curves: DataFrame) -> DataFrame:
    """series_id, time, value: each observation as a line of text, 8 and 6 decimals."""
    with_error = F.format_string("%.8f %.6f %.6f", "time", "mag", "mag_err")
    line = F.when(F.col("mag_err").isNull(), F.format_string("%.8f %.6f", "time", "mag")).otherwise(with_error)
    return curves.select("series_id", "time", line.alias("value"))


def write_light_curves(curves: DataFrame, path: str) -> None:
    """A folder a series, lines in order of time; a very long series has several files, each a range of times."""
    lines = light_curve_lines(curves).repartitionByRange("series_id", "time").sortWithinPartitions("series_id", "time")
    lines.select("series_id", "value").write.partitionBy("series_id").text(path)
