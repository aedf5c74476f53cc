"""Quality classification by Bradley-Terry ranking: all pairs of a better and a worse document, logistic loss on the
difference of their features, and a threshold at a quantile of the scores of all labelled rows.

The features of a whole text are shares (of each ASCII sign, capitals, digits, repeated words, runs and lines, ...), in
tenth powers too where they are small, brought to one scale by the labelled rows. A document's strength is linear in them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.cuts import cut, scratch
from scriptorium.llm.batches import text_slices
from scriptorium.llm.features import byte_shares, repeats
from scriptorium.llm.folds import held_out
from scriptorium.llm.graphs import small
from scriptorium.llm.hashing import Words, mix, slices

#: Steps of the fit, and how far they go beyond the bound's own (under 2); weight of the squared weights in the loss.
ROUNDS, OVER, RIDGE = 10, 1.8, 1e-4
#: Strengths are counted in steps of so much; places between which the slope of a row is interpolated.
STEP, GRID = 1 / 32, 512


def features(words: Words, lines: Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text, whatever its length."""
    hashes, begin = words(data, offsets)
    n = np.diff(begin).astype(np.float64)
    chars = np.diff(offsets)
    shares = byte_shares(data, offsets)
    line_hash, line_begin = lines(data, offsets)
    of = np.repeat(np.arange(len(n)), np.diff(line_begin))
    once = np.unique(mix(line_hash, 31) + mix(of.astype(np.uint64), 32), return_index=True)[1]
    distinct = np.bincount(of[once], minlength=len(n))
    same_lines = 1 - distinct / np.maximum(np.diff(line_begin), 1)
    again = repeats(hashes, begin)
    expected = again[:, 1] / np.maximum(np.log1p(n), 1)  # long texts repeat words by themselves
    length = chars / np.maximum(n, 1)
    plain = np.concatenate([shares, again, same_lines[:, None], expected[:, None]], axis=1)
    return np.concatenate([np.minimum(plain * 10, 1), np.sqrt(plain), np.log1p(n)[:, None], np.log1p(length)[:, None]], axis=1)


def _tools() -> tuple[Words, Words]:
    return Words(), Words(b"\n")


@dataclass
class QualityModel:
    """Strength is weights on the features after centre and scale; score is a half at the threshold."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    spread: float = 1.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.threshold) / self.spread, -30, 30)))


def _featured(rows: DataFrame, key: str) -> DataFrame:
    """(key, x) of rows (key, text): the features of each text as bytes of 8-byte floats, as they are scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lines = _tools()
        for part in text_slices(batches):
            for first, data, offsets in slices(part.column("text")):
                x = features(words, lines, data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(key).slice(first, len(x)), pa.array([r.tobytes() for r in x], pa.binary())], [key, "x"])

    found = rows.select(key, "text")
    return found.mapInArrow(run, f"{key} {found.schema[key].dataType.simpleString()}, x binary")


def _each(table: DataFrame, run: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], schema: str) -> pa.Table:
    """What run makes of the labels and features of a batch of table (label, x), summed up by the columns of schema but its last (n), for each task."""
    names = [x.split()[0] for x in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(len(batch), -1)
                made = pa.table(run(batch.column("label").to_numpy(), x), names)
                total = _summed(made if total is None else pa.concat_tables([total, made]))
        if total is not None:
            yield from total.combine_chunks().to_batches()

    return _summed(table.mapInArrow(task, schema).toArrow())


def _summed(table: pa.Table) -> pa.Table:
    *keys, n = table.column_names
    return table.group_by(keys).aggregate([(n, "sum")]).select([*keys, f"{n}_sum"]).rename_columns([*keys, n]).sort_by([(k, "ascending") for k in keys])


def _sums(table: DataFrame, run: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of the vectors that run makes of batches."""
    return _each(table, lambda y, x: [np.arange(len(v := run(y, x))), v], "at long, n double").column("n").to_numpy()


def _counts(table: DataFrame, model: QualityModel, width: float, low: float = -np.inf, high: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many rows of each label have which strengths from low to under high: labels, strengths in steps of width (rounded down), rows; by strength."""

    def run(y: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        s = model.strength(x)
        there = (s >= low) & (s < high)
        step = np.floor(s[there] / width).astype(np.int64)
        return [step, y[there].astype(np.int64), np.ones(len(step), np.int64)]

    got = _each(table, run, "step long, label long, n long")
    return got.column("label").to_numpy(), got.column("step").to_numpy(), got.column("n").to_numpy()


def _lost(at: np.ndarray, others: np.ndarray, n: np.ndarray, sign: float) -> np.ndarray:
    """At each strength the mean probability that a comparison with the others (strengths, rows) goes wrong; sign: 1 for better rows, -1 for worse."""
    out = np.empty(len(at))
    for a in range(0, len(at), 64):
        out[a : a + 64] = (1 / (1 + np.exp(np.clip(sign * (at[a : a + 64, None] - others), -30, 30)))) @ n / n.sum()
    return out


def fit(labelled: DataFrame, rounds: int = ROUNDS, share: float | None = None) -> QualityModel:
    """A model from labelled, which has text and label (1 better, 0 worse, null ignored).

    With one label only there is nothing to rank: all scores are that label's side of a half. The threshold lies at the
    quantile of all strengths that the worse rows have in labelled, or at share.
    """
    with scratch(labelled.sparkSession):
        rows = labelled.filter("label in (0, 1) and text is not null").withColumn("label", F.col("label").cast("int"))
        return _fit(cut(_featured(rows, "label"), "features"), rounds, share)


def _fit(table: DataFrame, rounds: int, share: float | None) -> QualityModel:
    """A model from all rows of table (label, x), by passes whose results have a size of their own, whatever the rows.

    The loss is that of every better row with every worse one. Its slope at a row depends on the others' strengths alone, whose
    counts (in steps of STEP) a pass takes before the next one sums up the slope. The curvature is bounded by that at equal strengths,
    which moments give (Boehning and Lindsay, "Monotonicity of quadratic-approximation algorithms", 1988).
    """
    wide = features(*_tools(), np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    plain = _sums(table, lambda y, x: np.concatenate([[len(y) - y.sum(), y.sum()], x.sum(axis=0), (x**2).sum(axis=0)]))
    n = plain[:2] if len(plain) else np.zeros(2)
    model = QualityModel(np.zeros(wide), np.ones(wide), np.zeros(wide))
    if not n.all():
        model.threshold = 1.0 if n[0] else -1.0
        return model
    model.centre = plain[2 : 2 + wide] / n.sum()
    model.scale = np.maximum(np.sqrt(np.maximum(plain[2 + wide :] / n.sum() - model.centre**2, 0)), 0.02)

    def moments(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = model.scaled(x)
        return np.concatenate([part for k in (0, 1) for own in [z[y == k]] for part in (own.sum(axis=0), (own.T @ own).ravel())])

    worse, better = (np.split(m / n[k], [wide]) for k, m in enumerate(np.split(_sums(table, moments), 2)))
    cross = np.outer(worse[0], better[0])
    curve = ((worse[1] + better[1]).reshape(wide, wide) - cross - cross.T) / 4 + RIDGE * np.eye(wide)
    slope = (better[0] - worse[0]) / 2  # at equal strengths every comparison is even
    for k in range(rounds):
        if k:
            label, step, count = _counts(table, model, STEP)
            at = (step + 0.5) * STEP
            grid = np.linspace(at[0], at[-1], GRID)
            lost = [_lost(grid, at[label == 1 - y], count[label == 1 - y], 2.0 * y - 1) * (2 * y - 1) / n[y] for y in (0, 1)]

            def slopes(y: np.ndarray, x: np.ndarray, grid: np.ndarray = grid, lost: list[np.ndarray] = lost) -> np.ndarray:
                s = model.strength(x)
                return np.where(y == 1, np.interp(s, grid, lost[1]), np.interp(s, grid, lost[0])) @ model.scaled(x)

            slope = _sums(table, slopes)
        model.weights = model.weights + OVER * np.linalg.solve(curve, slope - RIDGE * model.weights)
    _, step, count = _counts(table, model, STEP)
    at = (step + 0.5) * STEP
    mean = at @ count / n.sum()
    model.spread = max(1e-6, float(np.sqrt((at - mean) ** 2 @ count / n.sum())) / 4)
    model.threshold = _quantile(table, model, (n[0] / n.sum() if share is None else share) * n.sum())
    return model


def _quantile(table: DataFrame, model: QualityModel, below: float) -> float:
    """A strength that so many rows are under (one at least, not all): midway to the next one, or the rows' own where equal ones lie on both sides."""
    width, low, high, before, limit = STEP, -np.inf, np.inf, 0, np.inf
    for _ in range(3):
        _, step, count = _counts(table, model, width, low, high)
        steps, of = np.unique(step, return_inverse=True)
        ends = before + np.cumsum(np.bincount(of, count))
        k = min(int(np.searchsorted(ends, max(1, below) - 1e-6)), len(steps) - 1)
        after = (steps[k + 1] + 0.5) * width if k + 1 < len(steps) else limit
        if ends[k] <= below + 1e-6 and np.isfinite(after):
            return float((steps[k] + 0.5) * width + after) / 2
        before, low, high, limit = (ends[k - 1] if k else before), steps[k] * width, (steps[k] + 1) * width, after
        width /= 4096
    return float(low)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs' columns, and two more (which replace any of those names): score and predicted (1 if score >= 0.5).

    A null text is scored as an empty one. Whole texts are used; repeated rows get equal scores.
    """
    kept = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lines = _tools()
        for part in text_slices(batches):
            found = [model(features(words, lines, data, offsets)) for _, data, offsets in slices(part.column("text"))]
            if found:
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(found))], [*part.schema.names, "score"])

    return kept.mapInArrow(run, f"{schema}, score double").withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, learned from all labels (doc_id, quality) outside the held-out fold."""
    marks = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out()).select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    texts = docs.select("doc_id", "text").filter("text is not null")
    few = small(marks)
    # beyond a broadcast features meet the labels by a shuffle, as texts are larger
    known = _featured(texts.join(few, "doc_id"), "label") if few is not marks else _featured(texts.filter(~held_out()), "doc_id").join(marks, "doc_id").select("label", "x")
    with scratch(docs.sparkSession):
        model = _fit(cut(known, "features"), ROUNDS, None)
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
