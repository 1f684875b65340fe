"""Quality rules: text statistics, and a decision list learned from labelled ones. DataFrame operations only.

Sequential covering: a rule for low quality is grown condition by condition (a statistic at least or below a threshold,
the pair with the largest information gain), cut back to the prefix that does best on rows kept apart, and accepted if it
is precise there; the rows it covers leave, and the next rule is grown. A rule that isn't precise sets its first condition aside, and another is grown
in its place. The list becomes one ordered conditional expression. Rules learn from labelled rows that the base rules let pass; these, bounded by a
parameter, are counted by bins of all statistics in one aggregate, and the covering works on those counts.

Words are runs without ASCII blanks. A null or empty text has no words and all counts 0. Repeated rows each get a row.
Without labels, or with labels of one kind only, no rule is learned and the base rules alone decide. A document labelled
more than once is bad if any label says so; null labels are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

BLANKS = r"[\x20\x09-\x0D]+"
WORDY = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Labelled documents that rules are fitted to, at most.
MOST_LABELLED = 20_000
BINS, MOST_CONDITIONS, MOST_RULES = 24, 3, 8


def repeated(windows: str, size: int, spare: int = 0) -> Column:
    """Words in windows that occur more than once: places with an equal window elsewhere are found by sorting window hashes,
    and overlapping windows count their words once.

    Places lie in the low bits of the hashes as long as the bits that are left (fewer by `spare`) tell all windows of the text apart;
    where they don't, as may be in very long texts, pairs of hash and place are sorted.
    """
    n = F.size(windows)
    bits = F.ceil(F.log2(n + 1)).cast("int") + spare
    left, right = (lambda c, k: F.call_function("shiftleft", c, k)), (lambda c, k: F.call_function("shiftright", c, k))
    high = lambda h: right(h, bits)
    packed = F.sort_array(F.transform(windows, lambda h, i: left(high(h), bits).bitwiseOR(i.cast("long"))))
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731  evaluates c once

    def places(s: Column, head: Callable[[Column], Column], place: Callable[[Column], Column]) -> Column:
        at = lambda k: head(F.get(s, k))
        twin = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (at(k) == at(k - 1)) | (at(k) == at(k + 1)))
        return F.sort_array(F.transform(twin, lambda k: place(F.get(s, k))))

    def words(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(size).cast("long")), F.lit(size).cast("long")))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    told_apart = F.size(F.array_distinct(F.transform(windows, high))) == F.size(F.array_distinct(windows))
    by_bits = once(packed, lambda s: places(s, high, lambda x: x.bitwiseAND(left(F.lit(1).cast("long"), bits) - 1)))
    by_pairs = once(pairs, lambda s: places(s, lambda x: x["h"], lambda x: x["i"]))
    return once(F.when(told_apart, by_bits).otherwise(by_pairs), words)


def text_statistics(docs: DataFrame, *keep: str, size: int = 5) -> DataFrame:
    """The columns to keep (in a struct `kept_columns`) and the counts: words, code points in words, symbols, lines equal to
    an earlier line with a word, words in repeated windows of `size` words; also upper-case letters, marks and distinct
    words. One narrow pass over whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(F.struct(*keep).alias("kept_columns"), text.alias("text"))
    split = lines.select(
        "kept_columns",
        F.array_remove(F.split("text", BLANKS), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORDY)).alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[!?]+", ""))).cast("long").alias("n_marks"),
    )
    word = lambda i: F.get(F.col("words"), i)
    hashed = F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda i: F.xxhash64(*[word(i + j) for j in range(size)]))
    counted = split.select(
        "kept_columns",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        "n_upper",
        "n_marks",
        F.when(F.size("words") > size, hashed).alias("windows"),
    )
    some = F.col("windows").isNotNull() & (F.size(F.array_distinct("windows")) < F.size("windows"))
    return counted.withColumn("n_repeat_words", F.when(some, repeated("windows", size)).otherwise(F.lit(0).cast("long"))).drop("windows")


def rates() -> dict[str, Column]:
    """Statistics that rules may use, by name, from the counts."""
    each = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": each("word_chars", "n_words"),
        "symbols": each("n_symbols", "word_chars"),
        "upper": each("n_upper", "word_chars"),
        "marks": each("n_marks", "n_words"),
        "distinct": each("n_distinct", "n_words"),
        "repeats": each("n_repeat_words", "n_words"),
        "dup_lines": F.col("n_dup_lines").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    bin: int
    threshold: float
    at_least: bool

    def meets(self, bin_: int) -> bool:
        return bin_ >= self.bin if self.at_least else bin_ < self.bin

    def on_rates(self) -> Column:
        c = rates()[self.statistic]
        return c >= self.threshold if self.at_least else c < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def bin_of(name: str, thresholds: list[float]) -> Column:
    """How many of the thresholds a statistic reaches."""
    if not thresholds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col(name)))


@dataclass(frozen=True)
class Cell:
    """Labelled rows with one bin of each statistic: how many, whether they are bad, and whether they are kept apart."""

    bins: tuple[int, ...]
    bad: bool
    apart: bool
    n: int


def grown(cells: list[Cell], grid: dict[str, list[float]], least_rows: int, aside: set[tuple[str, bool]]) -> list[Condition]:
    """A rule for bad rows: conditions of the largest information gain, one after another; the first is none of those set aside."""
    names, rule = list(grid), []
    while len(rule) < MOST_CONDITIONS:
        p0, n0 = sum(c.n for c in cells if c.bad), sum(c.n for c in cells if not c.bad)
        if not p0 or not n0:
            break
        best, choice = 0.0, None
        for place, x in enumerate(names):
            at = [[0, 0] for _ in range(len(grid[x]) + 1)]
            for c in cells:
                at[c.bins[place]][c.bad] += c.n
            up = [0, 0]
            for k in range(len(grid[x]), 0, -1):
                up = [up[0] + at[k][0], up[1] + at[k][1]]
                for at_least, m, p in ((True, *up), (False, n0 - up[0], p0 - up[1])):
                    if p >= least_rows and (rule or (x, at_least) not in aside):
                        gain = p * (math.log2(p / (p + m)) - math.log2(p0 / (p0 + n0)))
                        if gain > best + 1e-9:
                            best, choice = gain, Condition(x, k, float(grid[x][k - 1]), at_least)
        if choice is None:
            break
        rule.append(choice)
        cells = [c for c in cells if choice.meets(c.bins[names.index(choice.statistic)])]
    return rule


def covered_rules(cells: list[Cell], grid: dict[str, list[float]], least_precision: float, least_rows: int) -> list[list[Condition]]:
    """Sequential covering over counted rows: rules are grown on two parts of three, cut back to the prefix that does best on the rest, and accepted
    if it is precise there. What isn't sets its first condition aside, and the next is grown."""
    names, rules, aside = list(grid), [], set()
    meets = lambda c, rule: all(x.meets(c.bins[names.index(x.statistic)]) for x in rule)
    while len(rules) < MOST_RULES:
        rule = grown([c for c in cells if not c.apart], grid, least_rows, aside)
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            held = [c for c in cells if c.apart and meets(c, rule[:k])]
            p, n = sum(c.n for c in held if c.bad), sum(c.n for c in held)
            worth.append((round(p / max(1, n), 2), p, -k, p / max(1, n)))
        _, p, k, precision = max(worth)
        if precision < least_precision or p < least_rows // 2:
            aside.add((rule[0].statistic, rule[0].at_least))
            continue
        rules.append(rule[:-k])
        cells = [c for c in cells if not meets(c, rules[-1])]
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, least_precision: float = 0.95, least_rows: int = 8, most_labelled: int = MOST_LABELLED, least_words: int = 10, most_repeats: int = 20) -> list[list[Condition]]:
    """Ordered rules for bad documents that the base rules let pass, from labels (doc_id, quality; 0 is bad) and at most `most_labelled` labelled
    documents, those whose hashed ids are least. The driver sees these rows as counts by bins, no more."""
    bad = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") < 1).alias("bad"))
    chosen = bad.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)  # bounded by the parameter
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    counted = text_statistics(labelled, "doc_id", "bad").withColumn("failed", base_failed(least_words, most_repeats))
    rows = written(counted.select("kept_columns.*", "failed", *[c.alias(n) for n, c in rates().items()]), "labelled").where("not failed")
    names = list(rates())
    # thresholds are quantiles of all rows and of the bad, with their least and greatest
    cuts = rows.agg(*[F.percentile_approx(x, [k / BINS for k in range(1, BINS)], 10_000).alias(x) for x in names]).first()
    tails = rows.where("bad").agg(*[F.percentile_approx(x, [k / BINS for k in range(BINS + 1)], 10_000).alias(x) for x in names]).first()
    grid = {x: sorted(set(cuts[x] or []) | set(tails[x] or [])) for x in names}
    apart = (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("apart")
    binned = rows.select(apart, "bad", *[bin_of(x, grid[x]).alias(f"b_{x}") for x in names])
    cells = binned.groupBy("apart", "bad", *[f"b_{x}" for x in names]).agg(F.count("*").alias("n")).collect()  # no more than the labelled rows
    return covered_rules([Cell(tuple(r[f"b_{x}"] for x in names), r["bad"], r["apart"], r["n"]) for r in cells], grid, least_precision, least_rows)


def base_failed(least_words: int, most_repeats: int) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def verdict(rules: list[list[Condition]]) -> Column:
    """The place in the list, from 1, of the first rule that a document meets; null if none."""
    if not rules:
        return F.lit(None).cast("int")
    chain = F
    for k, rule in enumerate(rules, 1):
        chain = chain.when(every([c.on_rates() for c in rule]), k)
    return chain


def judged(docs: DataFrame, labels: DataFrame, *keep: str, least_words: int = 10, most_repeats: int = 20) -> DataFrame:
    """The columns to keep (doc_id if none is named), the counts, base_failed (fewer than `least_words` words, or over
    `most_repeats` percent of them in repeated windows), rule (the learned rule it meets) and kept (neither). Once rules
    are learned, a narrow pass over all documents. Columns to keep that are named like a count are not given twice: the
    count stands."""
    own = [c for c in keep or ("doc_id",) if c not in (*COUNTS, "base_failed", "rule", "kept")]
    rules = learn_rules(docs, labels, least_words=least_words, most_repeats=most_repeats)
    found = text_statistics(docs, *own).withColumn("base_failed", base_failed(least_words, most_repeats)).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return found.select("kept_columns.*", *COUNTS, "base_failed", "kept", "rule")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs whatever their names."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    placed = plain.withColumns({"doc_id": F.col(names[docs.columns.index("doc_id")]), "text": F.col(names[docs.columns.index("text")])})
    # a filter would be pushed below the projections and copy each statistic many times over; a generator stays above them
    row = F.struct(*names)
    return judged(placed, labels, *names).select(F.inline(F.when(F.col("kept"), F.array(row)).otherwise(F.array().cast(f"array<{row_type(plain)}>")))).toDF(*docs.columns)


def row_type(df: DataFrame) -> str:
    return df.schema.simpleString()
