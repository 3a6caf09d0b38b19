"""Many linear SVMs trained together.

Every fold, treatment, group, C and removal step is a model of its own, and all
of them read the same rows.  Here one pass over the rows serves one iteration
of *all* models: the weights of all models go to the tasks as one (models x d)
matrix, each row carries the ids of the training sets it belongs to, and the
pass returns a loss and a d-sized gradient per model, summed map-side per task
and then by Spark.  The driver keeps what is d-sized only: each model's own
L-BFGS state.  Models take steps independently of each other; one whose trial
step was too long tries a shorter one in the next pass while the others go on,
and a finished model is left out.  The number of passes is bounded by
``MAX_PASSES``, not by the number of models.

The objective of a model is that of a linear SVM with cost C on standardised
features, ``sum(w_i hinge(y_i m_i)) / sum(w) + |beta|^2 / (2 C sum(w))``.  The
hinge is rounded off over a width that shrinks from level to level
(``WIDTHS``), so that a quasi-Newton method converges; at the last level the
objective differs from the hinge's by less than half that width.

Input rows: ``train`` and ``val`` (arrays of training-set ids that a row trains
or validates), ``y`` (label 0 or 1), ``g`` (group code 0 or 1), ``x`` (features).
Rows with null features, label or group take part in nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import LinearModel

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

WIDTHS = (0.5, 0.1, 0.02)   # rounding of the hinge, level by level
LEVEL_PASSES = 20           # trials of one model at one level, at most
MAX_PASSES = len(WIDTHS) * LEVEL_PASSES
HISTORY = 10                # remembered steps of a model
TOLERANCE = 1e-2            # of the gradient's largest entry, times the width's root
NEWTON_STEPS = 15           # of the calibration line, at most
MARGINS = 1 << 15           # held at a time: rows times models, small enough for a core's cache


@dataclass(frozen=True)
class Task:
    """One model to train: on the rows of training set ``rows``."""

    key: tuple
    rows: int
    c: float
    target: str = "label"        # "label" or "group"
    balanced: bool = True        # class weights n / (2 n_c)
    reweighed: bool = False      # weights n_g n_y / (n n_gy) besides
    drop: frozenset = frozenset()  # features without weight
    start: LinearModel | None = None


@dataclass(frozen=True)
class SetStats:
    """What a training set needs to be known by: cell counts [g][y], mean and 1 / standard deviation."""

    cells: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def set_stats(rows: DataFrame) -> dict[int, SetStats]:
    """M1 for every training set in one aggregate: partial sums per (set, g, y), merged on the driver (4 rows a set)."""
    v = array_to_vector("x")
    per = rows.select(F.explode("train").alias("rows"), "g", "y", v.alias("v")).groupBy("rows", "g", "y").agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("v")).alias("m"), Summarizer.variance(F.col("v")).alias("s"))
    parts: dict[int, list] = {}
    for r in per.select("rows", "g", "y", "n", vector_to_array("m").alias("m"), vector_to_array("s").alias("s")).collect():
        parts.setdefault(r.rows, []).append((r.g, r.y, r.n, np.array(r.m), np.array(r.s)))
    out = {}
    for key, found in parts.items():
        cells = np.zeros((2, 2))
        for g, y, n, _, _ in found:
            cells[g, y] += n
        n = cells.sum()
        mean = sum(k * m for _, _, k, m, _ in found) / n
        square = sum((k - 1) * s + k * (m - mean) ** 2 for _, _, k, m, s in found)
        std = np.sqrt(square / (n - 1)) if n > 1 else np.zeros_like(mean)
        out[key] = SetStats(cells, mean, np.divide(1.0, std, out=np.zeros_like(std), where=std > 1e-12))
    return out


def cell_weights(task: Task, stats: SetStats) -> np.ndarray:
    """Weight of a row by its (g, y): class balance times reweighing."""
    c, w = stats.cells, np.ones((2, 2))
    n = c.sum()
    if task.balanced:
        axis = 0 if task.target == "label" else 1
        count = c.sum(axis=axis)
        by = np.divide(n, 2.0 * count, out=np.zeros(2), where=count > 0)
        w = w * (by[None, :] if axis == 0 else by[:, None])
    if task.reweighed:  # M9
        expected = np.outer(c.sum(axis=1), c.sum(axis=0))
        w = w * np.divide(expected, n * c, out=np.zeros((2, 2)), where=c > 0)
    return w


# ---------------------------------------------------------------- one pass over the rows

def by_set(lists: pa.Array, wanted: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(set id, indices of the rows that list it), for the wanted sets."""
    lengths = np.diff(lists.offsets.to_numpy())
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(ids, kind="stable")
    ids, at = ids[order], at[order]
    names, first = np.unique(ids, return_index=True)
    for name, part in zip(names, np.split(at, first[1:])):
        if int(name) in wanted:
            yield int(name), part


def columns_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (x.reshape(batch.num_rows, -1), batch.column("y").to_numpy(zero_copy_only=False),
            batch.column("g").to_numpy(zero_copy_only=False))


class Pass:
    """Sends per-model numbers to the tasks, lets them add up one row of results per model, returns the sums."""

    def __init__(self, rows: DataFrame, tasks: Sequence[Task]):
        self.rows, self.tasks = rows, tasks

    def sums(self, which: str, models: Sequence[int], weights: np.ndarray, bias: np.ndarray, size: int, add) -> np.ndarray:
        """For each of ``models`` the sum over its rows of what ``add`` returns, a vector of ``size``.

        ``add(i, x, margins, y, g)`` gets the positions i (in ``models``) of the models of one training set and
        that set's rows of a batch, and returns one vector per model.
        """
        sc = self.rows.sparkSession.sparkContext
        of: dict[int, list[int]] = {}
        for i, m in enumerate(models):
            of.setdefault(self.tasks[m].rows, []).append(i)
        sent = sc.broadcast((weights, bias, {s: np.array(i) for s, i in of.items()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b, sets = sent.value
            total = np.zeros((len(w), size))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, g = columns_of(batch)
                for name, at in by_set(batch.column(which), set(sets)):
                    i = sets[name]
                    wt, step = w[i].T, max(MARGINS // len(i), 1)
                    for some in (at[k:k + step] for k in range(0, len(at), step)):
                        xs = x[some]
                        total[i] += add(i, xs, xs @ wt + b[i], y[some], g[some])
            met = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(list(total[met]), pa.list_(pa.float64()))],
                                             names=["model", "total"])

        parts = self.rows.select(which, "y", "g", "x").mapInArrow(run, "model int, total array<double>")
        merged = parts.groupBy("model").agg(Summarizer.sum(array_to_vector("total")).alias("total"))
        out = np.zeros((len(models), size))
        for r in merged.select("model", vector_to_array("total").alias("total")).collect():  # models x size numbers
            out[r.model] = r.total
        sent.destroy()
        return out


# ---------------------------------------------------------------- training

class Lbfgs:
    """The optimiser of one model, fed one evaluation (value, gradient) at a time."""

    def __init__(self, start: np.ndarray, free: np.ndarray):
        self.x, self.free = start, free
        self.level, self.trials, self.done = 0, 0, False
        self.trial = start.copy()
        self._begin()

    def _begin(self) -> None:
        self.f = self.g = None
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.trial, self.tried = self.x.copy(), 0

    @property
    def width(self) -> float:
        return WIDTHS[self.level]

    def _direction(self) -> np.ndarray:
        q, coef = self.g.copy(), []
        for s, y in reversed(self.steps):
            a = (s @ q) / (s @ y)
            coef.append(a)
            q -= a * y
        if self.steps:
            s, y = self.steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.steps, reversed(coef)):
            q += s * (a - (y @ q) / (s @ y))
        return -q

    def _next_level(self) -> None:
        if self.level + 1 == len(WIDTHS):
            self.done = True
        else:
            self.level += 1
            self._begin()

    def feed(self, f: float, g: np.ndarray) -> None:
        """Take the value and gradient at ``trial``; set the next ``trial``."""
        g = np.where(self.free, g, 0.0)
        self.tried += 1
        if self.f is not None:
            if f > self.f + 1e-4 * self.step * (self.g @ self.p):  # not enough: a shorter step
                self.step *= 0.3
                if self.step < 1e-6 or self.tried >= LEVEL_PASSES:
                    self._next_level()
                else:
                    self.trial = self.x + self.step * self.p
                return
            s, y = self.trial - self.x, g - self.g
            if s @ y > 1e-12 * (y @ y):
                self.steps = [*self.steps[-(HISTORY - 1):], (s, y)]
        self.x, self.f, self.g = self.trial, f, g
        if np.abs(g).max(initial=0.0) <= TOLERANCE * self.width ** 0.5 or self.tried >= LEVEL_PASSES:
            self._next_level()
            return
        self.p = self._direction()
        if self.p @ g >= 0:
            self.steps, self.p = [], -g
        self.step = 1.0 if self.steps else min(1.0, 1.0 / max(np.linalg.norm(g), 1e-12))
        self.trial = self.x + self.step * self.p


def train(rows: DataFrame, tasks: Sequence[Task], stats: dict[int, SetStats] | None = None) -> dict[tuple, LinearModel]:
    """M2: the models of all tasks, trained in at most ``MAX_PASSES`` passes over ``rows`` (cached by the caller).

    A training set without rows, or with one class only, has no model.
    """
    stats = set_stats(rows) if stats is None else stats

    def trainable(t: Task) -> bool:
        s = stats.get(t.rows)
        return s is not None and (s.cells.sum(axis=0 if t.target == "label" else 1) > 0).all()

    tasks = [t for t in tasks if trainable(t)]
    if not tasks:
        return {}
    weight = [cell_weights(t, stats[t.rows]) for t in tasks]
    mass = np.array([(w * stats[t.rows].cells).sum() for t, w in zip(tasks, weight)])
    ridge = np.array([1.0 / (t.c * m) for t, m in zip(tasks, mass)])
    mean, scale = (np.array([getattr(stats[t.rows], k) for t in tasks]) for k in ("mean", "scale"))
    d = mean.shape[1]
    free = np.ones((len(tasks), d + 1), bool)
    for i, t in enumerate(tasks):
        free[i, list(t.drop)] = False
    free[:, :d] &= scale > 0
    states = []
    for i, t in enumerate(tasks):
        x = np.zeros(d + 1) if t.start is None else np.array([*t.start.coef, t.start.intercept])
        states.append(Lbfgs(np.where(free[i], x, 0.0), free[i]))
    cells, by_group = np.array(weight) / mass[:, None, None], np.array([t.target == "group" for t in tasks])
    over = Pass(rows, tasks)
    while active := [i for i, s in enumerate(states) if not s.done]:
        at = np.array([states[i].trial for i in active])
        raw = at[:, :d] * scale[active]
        bias = at[:, d] - (raw * mean[active]).sum(axis=1)
        add = hinge_sums(cells[active], by_group[active], np.array([states[i].width for i in active]))
        total = over.sums("train", active, raw, bias, d + 2, add)
        for k, i in enumerate(active):
            loss, slope, along = total[k, 0], total[k, 1], total[k, 2:]
            beta = at[k, :d]
            grad = np.append(scale[i] * (along - mean[i] * slope) + ridge[i] * beta, slope)
            states[i].feed(loss + 0.5 * ridge[i] * (beta @ beta), grad)
    return {t.key: LinearModel(t.c, tuple(mean[i].tolist()), tuple(scale[i].tolist()), tuple(s.x[:d].tolist()), float(s.x[d]))
            for i, (t, s) in enumerate(zip(tasks, states))}


def hinge_sums(cells: np.ndarray, by_group: np.ndarray, width: np.ndarray):
    """Loss, sum of slopes and slopes along the features, of the rounded hinge."""
    def add(i: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, g: np.ndarray) -> np.ndarray:
        cell, h = 2 * g + y, width[i]
        w = cells[i].reshape(-1, 4).T  # by cell: few rows to take from
        sign = np.where(by_group[i], [[-1.0], [-1.0], [1.0], [1.0]], [[-1.0], [1.0], [-1.0], [1.0]])
        short = 1.0 - sign.take(cell, axis=0) * m
        inner = np.minimum(np.maximum(short, 0.0), h)
        short -= h
        loss = w.take(cell, axis=0) * (inner * inner / (2.0 * h) + np.maximum(short, 0.0))
        slope = (-w * sign).take(cell, axis=0) * inner / h
        return np.column_stack([loss.sum(axis=0), slope.sum(axis=0), slope.T @ x])
    return add


# ---------------------------------------------------------------- validation and calibration

def confusion_sums(by_group: np.ndarray):
    def add(i: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, g: np.ndarray) -> np.ndarray:
        t = np.where(by_group[i][None, :], g[:, None], y[:, None]) == 1
        p = m > 0
        return np.column_stack([(~t & ~p).sum(axis=0), (~t & p).sum(axis=0), (t & ~p).sum(axis=0), (t & p).sum(axis=0)])
    return add


def macro_f1(tn: float, fp: float, fn: float, tp: float) -> float:
    """A3: the mean over the labels present of their F1 (0 when undefined)."""
    each = [2 * a / (2 * a + fp + fn) if 2 * a + fp + fn else 0.0 for a in (tp, tn)]
    there = [float(tp + fn + fp > 0), float(tn + fp + fn > 0)]
    return sum(f * h for f, h in zip(each, there)) / sum(there) if sum(there) else 0.0


def validate(rows: DataFrame, tasks: Sequence[Task], models: dict[tuple, LinearModel]) -> dict[tuple, float]:
    """Macro-F1 of every model on the rows that list its training set in ``val``: one pass."""
    tasks = [t for t in tasks if t.key in models]
    if not tasks:
        return {}
    w, b = (np.array([getattr(models[t.key], k) for t in tasks]) for k in ("weights", "bias"))
    counts = Pass(rows, tasks).sums("val", range(len(tasks)), w, b, 4, confusion_sums(np.array([t.target == "group" for t in tasks])))
    return {t.key: macro_f1(*c) for t, c in zip(tasks, counts.tolist())}


def calibrate(rows: DataFrame, tasks: Sequence[Task], models: dict[tuple, LinearModel]) -> dict[tuple, LinearModel]:
    """M5: the sigmoid of every model's training margins, by Newton steps of all lines together."""
    tasks = [t for t in tasks if t.key in models]
    if not tasks:
        return {}
    w, b = (np.array([getattr(models[t.key], k) for t in tasks]) for k in ("weights", "bias"))
    by_group, line, over = np.array([t.target == "group" for t in tasks]), np.zeros((len(tasks), 2)), Pass(rows, tasks)
    active, size = list(range(len(tasks))), np.ones(len(tasks))
    for _ in range(NEWTON_STEPS):
        sums = over.sums("train", active, w[active], b[active], 6, logistic_sums(by_group[active], line[active]))
        for k, i in enumerate(active):
            n, ga, gb, haa, hab, hbb = sums[k]
            ridge = 1e-9 * max(n, 1.0)
            step = np.linalg.solve([[haa + ridge, hab], [hab, hbb + ridge]], [ga, gb])
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))  # separable rows would run away
            line[i] -= step
            size[i] = np.abs(step).max()
        active = [i for i in active if size[i] > 1e-5 and np.abs(line[i]).max() < 30.0]
        if not active:
            break
    return {t.key: replace(models[t.key], slope=float(a), offset=float(c)) for t, (a, c) in zip(tasks, line)}


def logistic_sums(by_group: np.ndarray, line: np.ndarray):
    """Rows, gradient and second derivatives of the log loss in slope and offset."""
    def add(i: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, g: np.ndarray) -> np.ndarray:
        t = np.where(by_group[i][None, :], g[:, None], y[:, None])
        p = 1.0 / (1.0 + np.exp(-np.clip(line[i, 0] * m + line[i, 1], -500, 500)))
        e, h = p - t, p * (1.0 - p)
        return np.column_stack([np.full(len(i), len(y)), (e * m).sum(axis=0), e.sum(axis=0), (h * m * m).sum(axis=0),
                                (h * m).sum(axis=0), h.sum(axis=0)])
    return add


# ---------------------------------------------------------------- selection

def grid_search(rows: DataFrame, tasks: Sequence[Task], grid: Sequence[float]) -> tuple[dict[tuple, LinearModel], dict[tuple, list[tuple[float, float]]]]:
    """Every task with every C, the best macro-F1 on its validation rows (ties: the smallest C), calibrated.

    Returns the chosen models and all (C, macro-F1) by task key.
    """
    stats = set_stats(rows)
    each = [replace(t, key=(*t.key, c), c=c) for t in tasks for c in sorted(grid)]
    models = train(rows, each, stats)
    f1 = validate(rows, each, models)
    results = {t.key: [(c, f1[(*t.key, c)]) for c in sorted(grid) if (*t.key, c) in f1] for t in tasks}
    chosen = {key: max(found, key=lambda e: (e[1], -e[0]))[0] for key, found in results.items() if found}
    final = [replace(t, c=chosen[t.key]) for t in tasks if t.key in chosen]
    return calibrate(rows, final, {t.key: models[(*t.key, t.c)] for t in final}), results


def cross_validated(rows: DataFrame, tasks: Sequence[Task], parts: dict[tuple, Sequence[int]],
                    grid: Sequence[float]) -> tuple[dict[tuple, LinearModel], dict[tuple, list[tuple[float, float]]]]:
    """F8 / M4: C by the mean macro-F1 over the training sets ``parts[key]`` (each validated on the rows it leaves
    out), then a fit on the whole training set of the task.  All folds, parts and C are one batch, the refits another."""
    stats = set_stats(rows)
    each = [replace(t, key=(*t.key, p, c), rows=p, c=c) for t in tasks for p in parts[t.key] for c in sorted(grid)]
    f1 = validate(rows, each, train(rows, each, stats))
    results = {}
    for t in tasks:
        per = [(c, [f1.get((*t.key, p, c), 0.0) for p in parts[t.key]]) for c in sorted(grid)]
        results[t.key] = [(c, sum(v) / len(v)) for c, v in per]
    final = [replace(t, c=max(results[t.key], key=lambda e: (e[1], -e[0]))[0]) for t in tasks]
    return calibrate(rows, final, train(rows, final, stats)), results


def remove_and_retrain(rows: DataFrame, tasks: Sequence[Task], orders: dict[tuple, Sequence[int]],
                       models: dict[tuple, LinearModel]) -> dict[tuple, LinearModel]:
    """For each task the models without its top-i features, i = 0 .. d - 2, keyed (*key, i).

    All steps are one batch; each starts from the weights of the task's model with all features.
    """
    steps = [replace(t, key=(*t.key, i), c=models[t.key].c, drop=frozenset(orders[t.key][:i]), start=models[t.key])
             for t in tasks if t.key in models for i in range(max(len(orders[t.key]) - 1, 1))]
    return calibrate(rows, steps, train(rows, steps))
