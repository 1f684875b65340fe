"""Quality classifier by co-training of two views.

The text view sees hashed byte trigrams of the whole text and how they repeat; the metadata view sees the other columns
(categories hashed, numbers as logarithms). In each round both views judge all documents in one narrow pass. Where a view is sure (as
labelled rows kept apart show), its pseudo-label teaches the other view: the slopes of all such documents are added up, each
with its own features, and the other view takes a Newton step down the sum of the labelled rows' loss and theirs; a few steps a round. Only how far a step
goes rests on a bounded sample: the curvature is that of the labelled rows and of CURVED pseudo-labelled ones of each label, those of the least
hashes. After the last round each view is calibrated on labelled rows kept apart, and a second regression
over the calibrated views gives the score of every document.

Only the labelled rows are bounded: at most `most_labelled` ids, those whose hashes are least, and one row (of the least
text) of a repeated id. Sums are of integers, so they don't depend on the order of tasks. Null and empty texts have no trigrams, null metadata
a category of its own; very long texts are taken whole, a text at a time. Without labels of both kinds every document scores the share of good labels (1 without labels) and
is kept. Repeated rows each get a score. The threshold is one half, or less if over a hundredth of the good rows kept apart
would fall below it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written
from .words import flat_text, slices

TRIGRAM_BINS, CATEGORY_BINS, ROUNDS = 1024, 64, 3
#: Passes over all documents in a round, each a step of both learners.
STEPS = 2
#: Pseudo-labelled documents of a label, those of the least hashes, whose curvature stands for that of all of them.
CURVED = 500
#: The most that a step changes a logit of the rows whose curvature is known.
FARTHEST = 4.0
#: Labelled documents that are fitted to, at most.
MOST_LABELLED = 8_000
#: Units of a feature in sums.
UNIT = 1 << 20
#: Texts turned into rows of features at once.
BLOCK = 512


def text_features(texts: pa.Array) -> np.ndarray:
    """A row a text: unit vector of log counts of hashed trigrams, and four measures of repetition and length."""
    raw, at = flat_text(texts)
    n = len(texts)
    out = np.zeros((n, TRIGRAM_BINS + 4), np.float32)
    if len(raw) >= 3:
        wide = raw.astype(np.uint32)
        bin_of = (((wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16) * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(at))[:-2]
        inside = np.arange(len(row)) + 3 <= at[1:][row]
        counts = np.bincount(row[inside] * TRIGRAM_BINS + bin_of[inside], minlength=n * TRIGRAM_BINS).reshape(n, TRIGRAM_BINS)
        total = np.maximum(counts.sum(1), 1)
        logs = np.log1p(counts)
        out[:, :TRIGRAM_BINS] = logs / np.maximum(np.linalg.norm(logs, axis=1, keepdims=True), 1e-9)
        out[:, -4] = counts.max(1) / total * 4
        out[:, -3] = (counts > 0).sum(1) / np.minimum(total, TRIGRAM_BINS)
        out[:, -2] = (counts.astype(np.float64) ** 2).sum(1) / total.astype(np.float64) ** 2 * 8
    out[:, -1] = np.log1p(np.diff(at)) / 10
    return out


def metadata_features(columns: list[pa.Array]) -> np.ndarray:
    parts = []
    for column in columns:
        if pa.types.is_string(column.type):
            coded = column.fill_null("\0").dictionary_encode()
            place = np.array([xxhash.xxh3_64_intdigest(x) % CATEGORY_BINS for x in coded.dictionary.to_pylist()], np.int64)
            hot = np.zeros((len(column), CATEGORY_BINS), np.float32)
            if len(column):
                hot[np.arange(len(column)), place[np.asarray(coded.indices)]] = 1
            parts.append(hot)
        else:
            value = np.nan_to_num(np.asarray(column.cast(pa.float64()).fill_null(0)).astype(np.float64), posinf=0, neginf=0)
            parts.append((np.log1p(np.abs(value))[:, None] / 10).astype(np.float32))
    return np.concatenate(parts, 1)


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1e-4, steps: int = 250) -> np.ndarray:
    """Weights and, last, bias of a logistic regression by accelerated gradient steps, over rows of some weight."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    share = np.full(len(x), 1 / len(x), np.float32) if weight is None else (weight / weight.sum()).astype(np.float32)
    rate = 4 / (share @ np.einsum("ij,ij->i", x, x) + penalty)
    w = v = np.zeros(x.shape[1], np.float32)
    for t in range(steps):
        ahead = w + t / (t + 3) * (w - v)
        slope = x.T @ (share * (1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - y)) + penalty * ahead
        v, w = w, (ahead - rate * slope).astype(np.float32)
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Views:
    """Weights of both views, (slope, offset) that calibrate each, of the combination, and the threshold."""

    text: np.ndarray
    metadata: np.ndarray
    calibration: list[np.ndarray]
    combination: np.ndarray
    threshold: float

    def scores(self, views: list[np.ndarray]) -> list[np.ndarray]:
        each = [logits(logits(x, w)[:, None], c) for x, w, c in zip(views, (self.text, self.metadata), self.calibration)]
        both = logits(np.stack(each, 1), self.combination)
        return [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*each, both)]


def sure_from(z: np.ndarray, y: np.ndarray, precision: float = 0.95, least: int = 10) -> tuple[float, float]:
    """Logits up to which rows are surely bad, and from which they are surely good: beyond each, the labels of at least
    `least` rows are right in that share. A label never goes against the sign of the logit."""
    cuts = []
    for side, own in ((z, y == 0), (-z, y > 0)):
        order = np.argsort(side, kind="stable")
        right = np.cumsum(own[order]) >= precision * np.arange(1, len(z) + 1)
        right[: least - 1] = False
        right &= np.append(side[order][1:] > side[order][:-1], True)[: len(z)]  # equal logits go together
        last = np.flatnonzero(right)
        cuts.append(min(0.0, float(side[order[last[-1]]])) if len(last) else -np.inf)
    return cuts[0], -cuts[1]


@dataclass
class Lesson:
    """What a pass over all documents needs: the weights by which views judge, the logits that are sure, and the weights of the learners."""

    judges: list[np.ndarray]
    sure: list[tuple[float, float]]
    learners: list[np.ndarray]
    first: bool = True

    def labels(self, views: list[np.ndarray], k: int) -> np.ndarray:
        """1, 0, or -1 where view k isn't sure."""
        z, (low, high) = logits(views[k], self.judges[k]), self.sure[k]
        return np.where(z <= low, 0, np.where(z >= high, 1, -1))


def row_hashes(x: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes()) >> 1 for r in np.ascontiguousarray(x, np.float32)], np.int64)


class Slopes:
    """Of all documents of which one view is sure, numbers and sums of the other view's slopes (residual times features, and the residual), by
    learner and label; and, in a round's first pass, the features of the CURVED least hashes."""

    def __init__(self, lesson: Lesson):
        self.lesson = lesson
        self.count = [np.zeros(2, np.int64) for _ in lesson.learners]
        self.total = [np.zeros((2, len(w)), np.int64) for w in lesson.learners]
        self.least: list[list[dict[int, np.ndarray]]] = [[{}, {}] for _ in lesson.learners]

    def add(self, views: list[np.ndarray]) -> None:
        for k in (0, 1):
            x, label = views[k], self.lesson.labels(views, 1 - k)
            wrong = 1 / (1 + np.exp(-np.clip(logits(x, self.lesson.learners[k]), -30, 30))) - label
            for y in (0, 1):
                own = label == y
                self.count[k][y] += own.sum()
                self.total[k][y, :-1] += np.rint(x[own] * (wrong[own] * UNIT)[:, None]).astype(np.int64).sum(0)
                self.total[k][y, -1] += np.rint(wrong[own] * UNIT).astype(np.int64).sum()
                if self.lesson.first:
                    self.keep(k, y, row_hashes(x[own]), x[own])

    def keep(self, k: int, y: int, hashes: np.ndarray, rows: np.ndarray) -> None:
        held = self.least[k][y]
        last = max(held) if len(held) >= CURVED else None
        for i in np.flatnonzero(hashes < last).tolist() if last is not None else range(len(hashes)):
            held[int(hashes[i])] = np.array(rows[i], np.float32)
        if len(held) > CURVED:
            self.least[k][y] = {h: held[h] for h in sorted(held)[:CURVED]}

    def curved(self, k: int, good: float) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows that stand for all of learner k, and their weights, which add up to 1."""
        bad, fine = (np.array([r for _, r in sorted(self.least[k][y].items())]) for y in (0, 1))
        if not len(bad) or not len(fine):
            return None
        return np.concatenate([bad, fine]), np.concatenate([np.full(len(bad), (1 - good) / len(bad)), np.full(len(fine), good / len(fine))])

    def slope(self, k: int, good: float) -> np.ndarray | None:
        """Mean slope of learner k with good and bad documents in a proportion; None if one kind is missing."""
        if not self.count[k].all():
            return None
        return sum(share * self.total[k][y] / UNIT / self.count[k][y] for y, share in ((0, 1 - good), (1, good)))


def newton_step(x: np.ndarray, y: np.ndarray, w: np.ndarray, taught: np.ndarray, curved: tuple[np.ndarray, np.ndarray], penalty: float = 1e-4) -> np.ndarray:
    """Weights after a step down the sum of two losses, that of labelled rows and that of all pseudo-labelled ones: their slope is given, and their
    curvature is that of some rows and weights."""
    wide = lambda v: np.concatenate([v, np.ones((len(v), 1), np.float32)], 1).astype(np.float64)
    chance = lambda v: 1 / (1 + np.exp(-np.clip(v @ w, -30, 30)))
    x, (other, weight) = wide(x), (wide(curved[0]), curved[1])
    p, q = chance(x), chance(other)
    slope = x.T @ (p - y) / len(x) + taught + 2 * penalty * w
    curve = (x.T * (p * (1 - p))) @ x / len(x) + (other.T * (q * (1 - q) * weight)) @ other
    curve[np.diag_indices_from(curve)] += 2 * penalty + 1e-3 * np.trace(curve) / len(curve)
    step = np.linalg.solve(curve, slope)
    far = max(1.0, float(np.abs(np.concatenate([x, other]) @ step).max()) / FARTHEST)  # curvature is trusted so far
    return (w - step / far).astype(np.float32)


def cotrained(views: list[np.ndarray], y: np.ndarray, summed_by: Callable[[Lesson], Slopes], rounds: int = ROUNDS, steps: int = STEPS) -> Views:
    """Fits on rows of two views with labels y and on all documents: in each round the views' judgements stand, and each learns from what the other is sure
    of, by steps whose slopes `summed_by` adds up over all documents. Pseudo-labelled documents weigh together as much as the labelled rows, good and bad ones
    in the labels' proportion."""
    apart = np.arange(len(y)) % 4 == 3
    own = [x[~apart] for x in views]
    good = float(y[~apart].mean())
    weights = [fitted(x, y[~apart]) for x in own]
    for _ in range(rounds):
        judges = weights
        sure = [sure_from(logits(x[apart], w), y[apart]) for x, w in zip(views, judges)]
        for step in range(steps):
            slopes = summed_by(Lesson(judges, sure, weights, step == 0))
            if step == 0:
                curved = [slopes.curved(k, good) for k in (0, 1)]
            taught = [slopes.slope(k, good) for k in (0, 1)]
            weights = [w if t is None or c is None else newton_step(x, y[~apart], w, t, c) for x, w, t, c in zip(own, weights, taught, curved)]
    held, own = y[apart], [logits(x[apart], w) for x, w in zip(views, weights)]
    calibration = [fitted(z[:, None].astype(np.float32), held) for z in own]
    each = np.stack([logits(z[:, None], c) for z, c in zip(own, calibration)], 1).astype(np.float32)
    model = Views(*weights, calibration, fitted(each, held), 0.5)
    score = model.scores([x[apart] for x in views])[2]
    model.threshold = float(min(0.5, np.quantile(score[held > 0], 0.01))) if (held > 0).any() else 0.5
    return model


def score_quality(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("lang", "source", "n_chars"), most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, text_score, metadata_score, score (chances that it is good) and kept, of every document."""
    columns = [F.col(c).cast("double") if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal") else F.col(c).cast("string") for c, t in docs.select(*metadata).dtypes]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[c.alias(f"m{k}") for k, c in enumerate(columns)])

    def features(part: pa.RecordBatch) -> list[np.ndarray]:
        return [text_features(part.column(1)), metadata_features(part.columns[2 : 2 + len(metadata)])]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for at in range(0, part.num_rows, BLOCK):
                    yield part.slice(at, BLOCK)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            both = [[r.astype(np.float32).tobytes() for r in x] for x in features(part)]
            yield pa.RecordBatch.from_arrays([part.column(part.num_columns - 1), *(pa.array(x, pa.binary()) for x in both)], ["y", "a", "b"])

    def summed_by(lesson: Lesson) -> Slopes:
        """A narrow pass over all documents; a task sends its sums, which meet in a partial aggregate."""
        sent = docs.sparkSession.sparkContext.broadcast(lesson)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slopes = Slopes(sent.value)
            for part in blocks(batches):
                slopes.add(features(part))
            names = ["learner", "label", "place", "n", "data"]
            for k in (0, 1):
                both = np.concatenate([slopes.count[k][:, None], slopes.total[k]], 1)
                label, place = np.nonzero(both)
                columns = [np.full(len(label), k), label, place, both[label, place]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.nulls(len(label), pa.binary())], names)
                for y in (0, 1):
                    held = slopes.least[k][y]
                    columns = [np.full(len(held), c) for c in (k, y, -1)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.array(list(held), pa.int64()), pa.array([r.tobytes() for r in held.values()], pa.binary())], names)

        told = written(rows.mapInArrow(add_up, "learner long, label long, place long, n long, data binary"), "slopes")
        sums = told.where("place >= 0").groupBy("learner", "label", "place").agg(F.sum("n").alias("n")).toArrow()
        learner, label, place, n = (np.asarray(c.combine_chunks()).astype(np.int64) for c in sums.columns)
        slopes = Slopes(lesson)
        for k in (0, 1):
            many, own = (learner == k) & (place == 0), (learner == k) & (place > 0)
            slopes.count[k][label[many]] = n[many]
            slopes.total[k][label[own], place[own] - 1] = n[own]
        if lesson.first:
            order = Window.partitionBy("learner", "label").orderBy("n")
            least = told.where("place < 0").dropDuplicates(["learner", "label", "n"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= CURVED)
            for r in least.select("learner", "label", "n", "data").toArrow().to_pylist():  # bounded by CURVED
                slopes.least[r["learner"]][r["label"]][r["n"]] = np.frombuffer(r["data"], np.float32)
        return slopes

    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)  # bounded by the parameter
    one = F.min(F.struct("text", *[f"m{k}" for k in range(len(metadata))], "y")).alias("r")
    labelled = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "r.*")
    got = labelled.mapInArrow(sampled, "y int, a binary, b binary").toArrow()
    y = np.asarray(got.column("y")).astype(np.float32) if got.num_rows else np.zeros(0, np.float32)
    a, b = ([np.frombuffer(v.as_buffer(), np.float32) for v in got.column(c).combine_chunks()] if got.num_rows else [] for c in "ab")
    order = np.array(sorted(range(len(y)), key=lambda i: xxhash.xxh3_64_intdigest(a[i].tobytes() + b[i].tobytes())), np.int64)
    y = y[order] if len(y) else y
    model, share = None, float((y > 0).mean()) if len(y) else 1.0
    if len(set(y[np.arange(len(y)) % 4 != 3].tolist())) == 2 and len(set(y[3::4].tolist())) == 2:
        model = cotrained([np.stack([x[i] for i in order]) for x in (a, b)], y, summed_by)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in blocks(batches):
            if model is None:
                found, kept = [np.full(part.num_rows, share)] * 3, np.ones(part.num_rows, bool)
            else:
                found = [np.round(x.astype(np.float64), 6) for x in model.scores(features(part))]
                kept = found[2] >= model.threshold
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found), pa.array(kept)], ["doc_id", "text_score", "metadata_score", "score", "kept"])

    return rows.mapInArrow(score, "doc_id long, text_score double, metadata_score double, score double, kept boolean")
