"""Regularised multinomial probes with MLlib."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import land
from .metrics import CLASSES, class_metrics
from .windows import nested_subsets

SCALE_FLOOR = 1e-6


@dataclass(frozen=True)
class Probe:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weight: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]
    strength: float
    iterations: int
    objective: float
    gradient: float

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, list(self.weight[k]), self.bias[k], list(self.mean), list(self.scale)) for k in range(CLASSES)]
        return spark.createDataFrame(rows, "class int, weight array<double>, bias double, mean array<double>, scale array<double>")


def assemble(*parts: Column) -> Column:
    """Statistics and representation columns side by side; each part is an ``ARRAY<DOUBLE>``."""
    return F.concat(*parts)


def two_view_mean(first: Column, second: Column) -> Column:
    return F.zip_with(first, second, lambda a, b: (a + b) / 2)


def fit_scaler(df: DataFrame, features: str = "x") -> tuple[list[float], list[float]]:
    """Mean and population deviation of each position, on the fitted rows only; the deviation has a floor."""
    per_position = df.select(F.posexplode(features).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    rows = per_position.orderBy("i").collect()
    return [r.m for r in rows], [max(r.s, SCALE_FLOOR) for r in rows]


def standardise(x: Column, mean: Sequence[float], scale: Sequence[float]) -> Column:
    centre = F.array(*[F.lit(float(m)) for m in mean])
    width = F.array(*[F.lit(float(s)) for s in scale])
    return F.zip_with(F.zip_with(x, centre, lambda a, m: a - m), width, lambda a, s: a / s)


def gradient(train: DataFrame, probe: Probe, label: str = "label") -> DataFrame:
    """Slope of the penalised objective by class and position; position -1 is the intercept."""
    scored = predict_probe(train, probe)
    z = F.concat(F.array(F.lit(1.0)), standardise(F.col("x"), probe.mean, probe.scale))
    miss = lambda k: (F.col("p")[k] - (F.col(label) == k).cast("double")) * F.col("z")
    misses = scored.select(label, "p", F.posexplode(z).alias("at", "z")).select((F.col("at") - 1).alias("i"), *[miss(k).alias(f"m{k}") for k in range(CLASSES)])
    slopes = misses.groupBy("i").agg(*[F.avg(f"m{k}").alias(f"m{k}") for k in range(CLASSES)])
    long = slopes.select("i", F.inline(F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"m{k}").alias("slope")) for k in range(CLASSES)])))
    weights = probe.to_frame(train.sparkSession).select("class", F.posexplode("weight").alias("i", "w"))
    penalty = 2 * probe.strength * F.coalesce("w", F.lit(0.0))
    return long.join(weights, ["class", "i"], "left").select("class", "i", (F.col("slope") + penalty).alias("slope"))


def fit_probe(
    train: DataFrame, strength: float, label: str = "label", max_iter: int = 500, gradient_tolerance: float = 1e-5
) -> Probe:
    """Minimise mean cross entropy plus ``strength`` times the squared weights; the intercepts are free.

    MLlib penalises half the squared weights, hence ``regParam = 2 * strength``. A fit counts as
    converged only if the objective is flat where it stopped; any other is refused.
    """
    seen = train.agg(*[F.count_if(F.col(label) == k).alias(f"n{k}") for k in range(CLASSES)]).first()
    if not all(seen):
        raise ValueError("A probe needs rows of all three classes")
    mean, scale = fit_scaler(train)
    ready = train.select(
        array_to_vector(standardise(F.col("x"), mean, scale)).alias("features"), F.col(label).cast("double").alias("label")
    )
    model = LogisticRegression(
        family="multinomial", regParam=2 * strength, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-9
    ).fit(ready)
    weight = tuple(tuple(map(float, row)) for row in model.coefficientMatrix.toArray())
    summary = model.summary
    probe = Probe(
        tuple(mean), tuple(scale), weight, tuple(map(float, model.interceptVector)), float(strength),
        summary.totalIterations, float(summary.objectiveHistory[-1]), float("nan"),
    )
    steepest = gradient(train, probe, label).agg(F.max(F.abs("slope"))).first()[0]
    if not steepest <= gradient_tolerance:
        raise RuntimeError(f"The probe did not converge: gradient {steepest} at strength {strength}")
    return dataclasses.replace(probe, gradient=steepest)


def predict_probe(df: DataFrame, probe: Probe) -> DataFrame:
    """Add ``p``: softmax of the standardised features, all in generated code."""
    z = standardise(F.col("x"), probe.mean, probe.scale)
    logits = []
    for k in range(CLASSES):
        weights = F.array(*[F.lit(float(w)) for w in probe.weight[k]])
        dot = F.aggregate(F.zip_with(F.col("_z"), weights, lambda a, w: a * w), F.lit(0.0), lambda a, v: a + v)
        logits.append(dot + F.lit(float(probe.bias[k])))
    top = F.array_max(F.col("_l"))
    total = F.aggregate(F.col("_e"), F.lit(0.0), lambda a, v: a + v)
    return (
        df.withColumn("_z", z)
        .withColumn("_l", F.array(*logits))
        .withColumn("_e", F.transform("_l", lambda v: F.exp(v - top)))
        .withColumn("p", F.transform("_e", lambda v: v / total))
        .drop("_z", "_l", "_e")
    )


def select_probe(train: DataFrame, val: DataFrame, grid: Sequence[float], label: str = "label") -> tuple[Probe, list[dict]]:
    """Fit every strength, keep the lowest validation loss (first best wins) and the whole candidate table.

    The fits are independent Spark jobs, so they are submitted together.
    """

    def one(strength: float) -> tuple[Probe, float]:
        probe = fit_probe(train, strength, label)
        return probe, class_metrics(predict_probe(val, probe), [], label).first().nll

    with ThreadPoolExecutor(max_workers=len(grid)) as pool:
        fits = list(pool.map(inheritable_thread_target(train.sparkSession)(one), grid))
    best = min(range(len(grid)), key=lambda i: (fits[i][1], i))
    candidates = [
        {
            "strength": float(s), "val_nll": loss, "objective": probe.objective, "gradient": probe.gradient,
            "iterations": probe.iterations, "selected": i == best,
        }
        for i, (s, (probe, loss)) in enumerate(zip(grid, fits))
    ]
    return fits[best][0], candidates


def subset_counts(subset: DataFrame, ident: Sequence[str], label: str = "label") -> DataFrame:
    """Class counts and an order-free digest of the ids of a training subset, to show methods share it."""
    classes = [F.count_if(F.col(label) == k).alias(f"class_{k}") for k in range(CLASSES)]
    each = F.conv(F.substring(F.md5(F.concat_ws("|", *ident)), 1, 12), 16, 10).cast("decimal(20,0)")
    return subset.groupBy("seed", "budget").agg(
        F.count(F.lit(1)).alias("n"), *classes, F.sum(each).cast("string").alias("ids_digest")
    )


def budget_subsets(train: DataFrame, ident: Sequence[str], seeds: Sequence[int], budgets: Sequence[int]) -> DataFrame:
    """(seed, budget, ident): each budget takes a prefix of the seed's one ranking, and too large a one is an error."""
    largest = max(budgets)
    if train.limit(largest).count() < largest:
        raise ValueError(f"Fewer than {largest} training examples")
    ranked = nested_subsets(train, ident, seeds, budgets)
    each = ranked.withColumn("budget", F.explode(F.array(*[F.lit(b).cast("bigint") for b in budgets])))
    return each.where(F.col("rank") <= F.col("budget"))


def probe_grid(
    examples: DataFrame,
    methods: dict[str, Column],
    ident: Sequence[str],
    tasks: dict[str, str],
    seeds: Sequence[int],
    budgets: Sequence[int | str],
    grid: Sequence[float],
) -> Grid:
    """Probes of every task x seed x budget x method x strength, all fitted together, and their metrics.

    A budget is a number of training labels, or ``all`` of them. ``methods`` maps a name to its feature array; ``tasks`` maps a name to its
    label column. The strength with the lowest validation loss is selected (the first of equals); ``frequency`` is the class prior.
    """
    columns = [*ident, *[c for c in ("split",) if c not in ident]]
    base = land(examples.select(*columns, *tasks.values(), *[x.alias(f"x_{m}") for m, x in methods.items()]), "grid")
    train = base.where("split = 'train'")
    sets = [(seed, budget) for seed in seeds for budget in budgets]
    numbers = [b for b in budgets if b != "all"]
    if numbers:
        chosen = budget_subsets(train, ident, seeds, numbers)
        marks = chosen.groupBy(*ident).agg(F.collect_set(F.concat_ws(" ", "seed", "budget")).alias("_sets"))
        train = train.join(marks, list(ident), "left")
    else:
        train = train.withColumn("_sets", F.array().cast("array<string>"))
    member = [F.lit(1) if b == "all" else F.when(F.array_contains("_sets", f"{s} {b}"), 1).otherwise(0) for s, b in sets]
    rows = land(train.select(F.array(*[m.cast("double") for m in member]).alias("member"), *tasks.values(), *[f"x_{m}" for m in methods]), "grid-train")
    candidates = [Candidate(t, s, b, m, float(g)) for t in tasks for s, b in sets for m in methods for g in grid]
    fitted = Fits(rows, candidates, sets, tasks).run()
    scored = _grid_losses(base, fitted, ident, tasks)
    return Grid(base.sparkSession, fitted, scored, _grid_counts(rows, sets, tasks), columns)


@dataclass(frozen=True)
class Candidate:
    task: str
    seed: int
    budget: int | str
    method: str
    strength: float

    @property
    def set(self) -> tuple[int, int | str]:
        return self.seed, self.budget


class Fits:
    """All candidates' multinomial fits in step: one pass over the rows gives every candidate's loss and slope.

    A candidate's rows are standardised by its own training set, which is a linear map, so blocks of rows meet all weights of a method in
    one matrix product. The driver holds weights and slopes of the candidates alone and moves each by limited-memory quasi-Newton
    steps that are halved until the loss falls enough; candidates that have arrived take no further part.
    """

    def __init__(self, rows: DataFrame, candidates: Sequence[Candidate], sets: Sequence[tuple], tasks: dict[str, str], tolerance: float = 1e-6, passes: int = 400):
        self.rows, self.candidates, self.sets, self.tasks = rows, list(candidates), list(sets), dict(tasks)
        self.tolerance, self.passes = tolerance, passes

    def _summed(self, work, columns: Sequence[str]) -> np.ndarray:
        """Sum over the rows of the arrays that ``work`` makes of each batch; tasks first, then the driver: one row for each task."""
        def part(batches):
            total = None
            for batch in batches:
                got = work({c: _matrix(batch.column(c)) for c in columns})
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel() for a in total]).tobytes()])], ["sums"])

        found = [np.frombuffer(r.sums) for r in self.rows.select(*columns).mapInArrow(part, "sums binary").collect()]
        if not found:
            raise ValueError("A probe needs rows of all three classes")
        return np.sum(found, axis=0)

    def run(self) -> dict[Candidate, Probe]:
        methods = list(dict.fromkeys(c.method for c in self.candidates))
        columns = ["member", *self.tasks.values(), *[f"x_{m}" for m in methods]]
        sets, tasks, labels = self.sets, list(self.tasks), list(self.tasks.values())

        def shape(data):
            n = data["member"].sum(axis=0)
            classes = [np.stack([data["member"].T @ (data[label][:, 0] == k) for k in range(CLASSES)]) for label in labels]
            return [n, np.concatenate([c.ravel() for c in classes]), *[data["member"].T @ data[f"x_{m}"] for m in methods]]

        widths = {m: self.rows.select(F.max(F.size(f"x_{m}"))).first()[0] for m in methods}
        flat = self._summed(shape, columns)
        n, at = flat[: len(sets)], len(sets)
        classes = flat[at : at + len(tasks) * CLASSES * len(sets)].reshape(len(tasks), CLASSES, len(sets))
        at += classes.size
        if not classes.all():
            raise ValueError("A probe needs rows of all three classes")
        means = {}
        for m in methods:
            means[m] = flat[at : at + len(sets) * widths[m]].reshape(len(sets), widths[m]) / n[:, None]
            at += means[m].size
        spread = self._summed(lambda data: [np.stack([data["member"][:, s] @ (data[f"x_{m}"] - means[m][s]) ** 2 for s in range(len(sets))]) for m in methods], columns)
        scales, at = {}, 0
        for m in methods:
            scales[m] = np.maximum(np.sqrt(spread[at : at + means[m].size].reshape(means[m].shape) / n[:, None]), SCALE_FLOOR)
            at += means[m].size
        states = [_State(CLASSES * (widths[c.method] + 1), self.tolerance) for c in self.candidates]
        for _ in range(self.passes):
            active = [i for i, s in enumerate(states) if not s.done]
            if not active:
                break
            self._step(states, active, methods, columns, n, means, scales)
        else:
            raise RuntimeError(f"{len(active)} probes did not converge in {self.passes} passes")
        out = {}
        for c, state in zip(self.candidates, states, strict=True):
            s, w = sets.index(c.set), state.x.reshape(CLASSES, -1)
            out[c] = Probe(tuple(means[c.method][s].tolist()), tuple(scales[c.method][s].tolist()), tuple(map(tuple, w[:, 1:].tolist())), tuple(w[:, 0].tolist()),
                           c.strength, state.steps, float(state.f), float(np.abs(state.g).max()))
        return out

    def _step(self, states, active, methods, columns, n, means, scales) -> None:
        """Loss and slope of every active candidate at its trial point, in one pass."""
        plans = {}
        for m in methods:
            own = [i for i in active if self.candidates[i].method == m]
            if own:
                at = [self.sets.index(self.candidates[i].set) for i in own]
                w = np.stack([states[i].trial.reshape(CLASSES, -1) for i in own])
                slope = w[:, :, 1:] / scales[m][at][:, None, :]
                bias = w[:, :, 0] - np.einsum("ckd,cd->ck", slope, means[m][at])
                plans[m] = (own, at, slope.reshape(-1, slope.shape[2]), bias, [self.tasks[self.candidates[i].task] for i in own])

        def work(data):
            out = []
            for m, (own, at, slope, bias, labels) in plans.items():
                x = data[f"x_{m}"]
                logits = (x @ slope.T).reshape(len(x), len(own), CLASSES) + bias
                logits -= logits.max(axis=2, keepdims=True)
                total = np.log(np.exp(logits).sum(axis=2, keepdims=True))
                member = data["member"][:, at]
                y = np.stack([data[label][:, 0] for label in labels], axis=1)[:, :, None] == np.arange(CLASSES)
                loss = -((logits - total) * y).sum(axis=2) * member
                miss = (np.exp(logits - total) - y) * member[:, :, None]
                out += [loss.sum(axis=0), miss.sum(axis=0), miss.reshape(len(x), -1).T @ x]
            return out

        flat, at = self._summed(work, columns), 0
        for m, (own, sets, slope, _, _) in plans.items():
            c, d = len(own), slope.shape[1]
            loss, first, raw = flat[at : at + c], flat[at + c : at + c + c * CLASSES].reshape(c, CLASSES), flat[at + c * (1 + CLASSES) : at + c * (1 + CLASSES + CLASSES * d)].reshape(c, CLASSES, d)
            at += c * (1 + CLASSES + CLASSES * d)
            for k, (i, s) in enumerate(zip(own, sets, strict=True)):
                w = states[i].trial.reshape(CLASSES, -1)
                strength = self.candidates[i].strength
                g = np.empty_like(w)
                g[:, 0] = first[k] / n[s]
                g[:, 1:] = (raw[k] - first[k][:, None] * means[m][s]) / scales[m][s] / n[s] + 2 * strength * w[:, 1:]
                states[i].told(float(loss[k] / n[s] + strength * (w[:, 1:] ** 2).sum()), g.ravel())


class _State:
    """One candidate on its way down: limited-memory quasi-Newton steps, each halved until the loss falls enough."""

    def __init__(self, size: int, tolerance: float, memory: int = 12):
        self.x = np.zeros(size)
        self.trial, self.f, self.g = self.x.copy(), np.inf, np.zeros(size)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.tolerance, self.memory, self.length, self.steps, self.done = tolerance, memory, 1.0, 0, False
        self.direction: np.ndarray | None = None

    def told(self, f: float, g: np.ndarray) -> None:
        """Loss and slope at the trial point: take it and choose the next one, or go half as far."""
        if self.direction is not None:
            fall = 1e-4 * self.length * float(self.g @ self.direction)
            if not f <= self.f + fall + 1e-15 * abs(self.f):
                self.length /= 2
                if self.length < 1e-10:  # as flat as sums of doubles can tell
                    self.direction, self.pairs = None, []
                    self.done = float(np.abs(self.g).max()) <= 100 * self.tolerance
                    if not self.done:
                        raise RuntimeError(f"A probe did not converge: gradient {np.abs(self.g).max()}")
                    return
                self.trial = self.x + self.length * self.direction
                return
            s, y = self.trial - self.x, g - self.g
            if s @ y > 1e-14 * (y @ y):
                self.pairs = [*self.pairs[1 - self.memory :], (s, y)]
            self.steps += 1
        self.x, self.f, self.g = self.trial, f, g
        if np.abs(g).max() <= self.tolerance:
            self.done = True
            return
        self.direction = -self._turned(g)
        self.length = 1.0 if self.pairs else min(1.0, 1.0 / float(np.abs(g).sum()))
        self.trial = self.x + self.length * self.direction

    def _turned(self, g: np.ndarray) -> np.ndarray:
        q, back = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            back.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(back), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        return q


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, or a plain column as one position."""
    if pa.types.is_list(column.type):
        return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return np.asarray(column.to_numpy(zero_copy_only=False), np.float64)[:, None]


def _grid_counts(rows: DataFrame, sets: Sequence[tuple], tasks: dict[str, str]) -> DataFrame:
    """Training rows and classes of every task, seed and budget."""
    pairs = F.explode(F.array(*[F.struct(F.lit(int(s)).cast("bigint").alias("seed"), F.lit(str(b)).alias("budget"), F.get("member", F.lit(i)).alias("m")) for i, (s, b) in enumerate(sets)]))
    each = rows.select(pairs.alias("p"), *tasks.values())
    long = each.where("p.m > 0").select("p.seed", "p.budget", F.inline(F.array(*[F.struct(F.lit(t).alias("task"), F.col(label).cast("int").alias("label")) for t, label in tasks.items()])))
    return long.groupBy("task", "seed", "budget").agg(F.count(F.lit(1)).alias("n_train"), *[F.count_if(F.col("label") == k).alias(f"train_{k}") for k in range(CLASSES)])


def _grid_losses(base: DataFrame, fitted: dict[Candidate, Probe], ident: Sequence[str], tasks: dict[str, str]) -> DataFrame:
    """Every candidate's class probabilities for every row outside training: (ident, split, label, candidate, p)."""
    names = list(fitted)
    methods = list(dict.fromkeys(c.method for c in names))
    packed = {}
    for m in methods:
        own = [i for i, c in enumerate(names) if c.method == m]
        w = np.stack([np.array(fitted[names[i]].weight) / np.array(fitted[names[i]].scale) for i in own])
        b = np.stack([np.array(fitted[names[i]].bias) - w[k] @ np.array(fitted[names[i]].mean) for k, i in enumerate(own)])
        packed[m] = (own, w, b, [tasks[names[i].task] for i in own])
    columns = [*ident, *[c for c in ("split",) if c not in ident]]
    kept = base.where("split <> 'train'").select(*columns, *tasks.values(), *[f"x_{m}" for m in methods])
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*columns).schema)

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            for m, (own, w, b, labels) in packed.items():
                logits = np.einsum("nd,ckd->nck", _matrix(batch.column(f"x_{m}")), w) + b
                e = np.exp(logits - logits.max(axis=2, keepdims=True))
                p = e / e.sum(axis=2, keepdims=True)
                rows = pa.array(np.repeat(np.arange(n), len(own)))
                y = np.stack([_matrix(batch.column(label))[:, 0] for label in labels], axis=1)
                parts = [*[batch.column(c).take(rows) for c in columns], pa.array(np.tile(np.array(own, np.int32), n)), pa.array(y.ravel().astype(np.int32)),
                         pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, CLASSES, dtype=np.int32)), pa.array(p.ravel()))]
                yield pa.RecordBatch.from_arrays(parts, [*columns, "candidate", "label", "p"])

    return kept.mapInArrow(score, f"{shape}, candidate int, label int, p array<double>")


class Grid:
    """What a grid of probes gives: ``candidates``, the ``heads`` of the selected ones, and metrics by split and by session."""

    def __init__(self, spark: SparkSession, fitted: dict[Candidate, Probe], scored: DataFrame, counts: DataFrame, columns: Sequence[str]):
        self.spark, self.fitted, self.counts, self.columns = spark, fitted, counts, list(columns)
        names = list(fitted)
        validation = {r.candidate: r.nll for r in class_metrics(scored.where("split = 'val'"), ["candidate"]).collect()}
        self.selected: dict[tuple, int] = {}
        for i, c in enumerate(names):
            best = self.selected.setdefault((c.task, c.seed, c.budget, c.method), i)
            if validation[i] < validation[best]:
                self.selected[c.task, c.seed, c.budget, c.method] = i
        rows = [
            (i, c.task, c.method, str(c.budget), c.seed, c.strength, validation[i], p.objective, p.gradient, p.iterations, i in self.selected.values())
            for i, (c, p) in enumerate(fitted.items())
        ]
        schema = "candidate int, task string, method string, budget string, seed long, strength double, val_nll double, objective double, gradient double, iterations int, selected boolean"
        self.candidates = spark.createDataFrame(rows, schema)
        chosen = F.broadcast(self.candidates.where("selected").select("candidate", "task", "method", "budget", "seed", "strength"))  # one row for each probe
        self.predictions = scored.join(chosen, "candidate").drop("candidate")

    @property
    def heads(self) -> DataFrame:
        """Selected probes with everything needed to score: one row for each class."""
        out = None
        for (task, seed, budget, method), i in self.selected.items():
            probe = list(self.fitted.values())[i]
            names = [F.lit(task).alias("task"), F.lit(method).alias("method"), F.lit(str(budget)).alias("budget"), F.lit(seed).cast("bigint").alias("seed"), F.lit(probe.strength).alias("strength")]
            one = probe.to_frame(self.spark).select(*names, "*")
            out = one if out is None else out.unionByName(one)
        return out

    def priors(self) -> DataFrame:
        """Predictions of the class priors of every training set, as method ``frequency``."""
        share = F.array(*[(F.col(f"train_{k}") + 1.0) / (F.col("n_train") + CLASSES) for k in range(CLASSES)])
        table = self.counts.select("task", "seed", "budget", share.alias("p"))  # one row for each training set
        methods = self.predictions.groupBy("task", "seed", "budget").agg(F.min("method").alias("method"))
        rows = self.predictions.drop("p").join(F.broadcast(methods), ["task", "seed", "budget", "method"]).drop("method", "strength")
        return rows.join(F.broadcast(table), ["task", "seed", "budget"]).withColumn("method", F.lit("frequency")).withColumn("strength", F.lit(None).cast("double"))

    def metrics(self, groups: Sequence[str] = ("split",)) -> DataFrame:
        """Metrics of every selected probe and prior by ``groups``, with the training counts beside them."""
        keys = ["task", "method", "budget", "seed", "strength", *groups]
        measured = class_metrics(self.predictions.unionByName(self.priors()), keys)
        return measured.join(F.broadcast(self.counts), ["task", "seed", "budget"])


def audit_probe(df: DataFrame, probe: Probe, ident: Sequence[str]) -> DataFrame:
    """Largest difference between stored ``p`` and probabilities rebuilt by joining saved parameters."""
    spark = df.sparkSession
    saved = probe.to_frame(spark).withColumn("_i", F.sequence(F.lit(0), F.size("weight") - 1))
    flat = saved.select("class", "bias", F.inline(F.arrays_zip("_i", "weight", "mean", "scale")))
    long = df.select(*ident, "p", F.posexplode("x").alias("_i", "v"))
    # The parameters are one row per class and feature.
    dots = long.join(F.broadcast(flat), "_i").groupBy(*ident, "class").agg(
        (F.sum((F.col("v") - F.col("mean")) / F.col("scale") * F.col("weight")) + F.first("bias")).alias("logit"),
        F.first(F.element_at("p", F.col("class") + 1)).alias("stored"),
    )
    whole = dots.groupBy(*ident).agg(F.collect_list("logit").alias("ls"), F.collect_list(F.struct("logit", "stored")).alias("cells"))
    total = F.aggregate("ls", F.lit(0.0), lambda a, v: a + F.exp(v))
    error = F.array_max(F.transform("cells", lambda c: F.abs(F.exp(c["logit"]) / total - c["stored"])))
    return whole.agg(F.max(error).alias("max_probability_error"), F.count(F.lit(1)).alias("rows"))
