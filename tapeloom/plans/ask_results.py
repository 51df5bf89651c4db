"""Questions about scoring, probes, comparison of methods and integrity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KEY, SPLITS
from ..operators import clock, compare, integrity, labels, metrics, probes, tokens, windows
from ..runtime import shared_dir
from . import frozen
from .ask_labels import AUDIT_SQL, DISTRIBUTION_SQL
from .ask_models import BATCH, COVERAGE_SQL, SEEDS, pairs, stream_at, totals
from .prepare import Prepared
from .questions import question

BUDGETS = (20, 80)
IDENT = [*KEY, "anchor"]
METHODS = ("prior_20", "prior_80", "prior_all", "uniform")
COHORTS = {"seen": ["click", "view", "purchase"], "all": ["click", "view", "purchase", "error"], "error": ["error"]}
PAIRS = (("prior_80", "prior_20"), ("prior_all", "uniform"))
REPLICATES = 200


def subset(p: Prepared) -> DataFrame:
    train = p.examples.where("split = 'train'")
    chosen = probes.budget_subsets(train, IDENT, SEEDS, BUDGETS)
    return chosen.join(train.select(*IDENT, "label"), IDENT)


def priors(p: Prepared) -> DataFrame:
    """Class shares of every method and seed: a dozen fitted rows."""
    seeds = F.explode(F.array(*[F.lit(s).cast("bigint") for s in SEEDS])).alias("seed")
    budget = metrics.class_prior(subset(p), ["seed", "budget"]).select("seed", F.concat(F.lit("prior_"), F.col("budget").cast("string")).alias("method"), "p")
    whole = metrics.class_prior(p.examples.where("split = 'train'")).select(seeds, F.lit("prior_all").alias("method"), "p")
    third = F.array(*[F.lit(1 / 3)] * 3)
    even = p.spark.range(1).select(seeds, F.lit("uniform").alias("method"), third.alias("p"))
    return budget.unionByName(whole).unionByName(even)


def predictions(p: Prepared) -> DataFrame:
    """Every method's probabilities for every evaluation example, on identical rows."""

    def make(p):
        fitted = [F.struct(F.lit(r.seed).alias("seed"), F.lit(r.method).alias("method"), F.array(*[F.lit(v) for v in r.p]).alias("p")) for r in priors(p).collect()]
        rows = p.examples.where("split <> 'train'").select("split", *IDENT, "label", F.inline(F.array(*fitted)))
        return rows.withColumn("nll", metrics.row_nll())

    return p.landed("predictions", make)


def metric(p: Prepared) -> DataFrame:
    return p.landed("metrics", lambda p: metrics.class_metrics(predictions(p), ["split", "method", "seed"]))


def symbol_days(p: Prepared) -> DataFrame:
    return predictions(p).groupBy("date", "symbol", "seed", "method").agg(F.avg("nll").alias("nll"))


NAMED = ("policy", "interaction", "incremental")


def named_contrasts() -> dict:
    a, b, c, d = (F.col(m) for m in METHODS)
    return dict(zip(NAMED, (b - a, (b - a) - (c - d), b - d)))


def daily(p: Prepared) -> DataFrame:
    """Contrasts per cohort and date: seeds averaged in a symbol's day, then symbols in the day."""

    def make(p):
        cohort = compare.by_cohort(symbol_days(p), COHORTS)
        means = compare.hierarchical_mean(cohort, ["cohort", "date", "method"], ["symbol", "seed"])
        wide = compare.pivot_metrics(means, ["cohort", "date"], "method", METHODS, "mean")
        return compare.contrasts(wide, ["cohort", "date"], named_contrasts())

    return p.landed("daily", make)


CONFUSION = [f"confusion_{i}{j}" for i in range(3) for j in range(3)]
METRIC_SQL = (
    "SELECT *, ("
    + " + ".join(f"CASE WHEN support_{k} > 0 THEN confusion_{k}{k} / support_{k} ELSE 0 END" for k in range(3))
    + ") / 3 AS balanced_accuracy, ("
    + " + ".join(f"CASE WHEN support_{k} + guess_{k} > 0 THEN 2 * confusion_{k}{k} / (support_{k} + guess_{k}) ELSE 0 END" for k in range(3))
    + ") / 3 AS macro_f1 FROM (SELECT {keys}, count(*) AS examples, avg(nll) AS nll, avg(brier) AS brier, avg((predicted = label)::INT) AS accuracy, "
    + ", ".join(f"count(*) FILTER (label = {i} AND predicted = {j}) AS confusion_{i}{j}" for i in range(3) for j in range(3))
    + ", "
    + ", ".join(f"count(*) FILTER (label = {k}) AS support_{k}, count(*) FILTER (predicted = {k}) AS guess_{k}" for k in range(3))
    + " FROM pred GROUP BY {keys})"
)
METRIC_COLUMNS = "examples:i nll:r brier:r accuracy:r balanced_accuracy:r macro_f1:r " + " ".join(f"{c}:i" for c in (*CONFUSION, "support_0", "support_1", "support_2"))


@question(f"split method seed:i {METRIC_COLUMNS}", METRIC_SQL.format(keys="split, method, seed"))
def class_metrics(p: Prepared):
    return metric(p)


@question(f"split method seed:i symbol date {METRIC_COLUMNS}", METRIC_SQL.format(keys="split, method, seed, symbol, date"))
def session_metrics(p: Prepared):
    return metrics.class_metrics(predictions(p), ["split", "method", "seed", *KEY])


@question("rows:i invalid:i", "SELECT count(*) AS rows, 0 AS invalid FROM pred")
def probability_check(p: Prepared):
    return metrics.bad_probabilities(predictions(p))


@question("split symbol date anchor:i seed:i method label:i p0:r p1:r p2:r predicted:i nll:r", "SELECT * FROM pred")
def prediction_table(p: Prepared):
    return metrics.predictions(predictions(p), ["split", *IDENT, "seed", "method"])


@question("seed:i method p0:r p1:r p2:r", "SELECT * FROM priors")
def class_priors(p: Prepared):
    return priors(p).select("seed", "method", *[F.col("p")[k].alias(f"p{k}") for k in range(3)])


@question(
    "symbol method seed:i brier:r accuracy:r mean_confidence:r predicted_class0:r predicted_class1:r predicted_class2:r observed_class0:r observed_class1:r observed_class2:r",
    """SELECT symbol, method, seed, avg(brier) AS brier, avg((predicted = label)::INT) AS accuracy, avg(greatest(p0, p1, p2)) AS mean_confidence,
       avg(p0) AS predicted_class0, avg(p1) AS predicted_class1, avg(p2) AS predicted_class2, avg((label = 0)::INT) AS observed_class0,
       avg((label = 1)::INT) AS observed_class1, avg((label = 2)::INT) AS observed_class2 FROM pred GROUP BY 1, 2, 3""",
)
def calibration(p: Prepared):
    return metrics.calibration(predictions(p), ["symbol", "method", "seed"])


@question(
    "task split n:i class_0:i class_1:i class_2:i fraction_0:r fraction_1:r fraction_2:r",
    f"""SELECT *, class_0 / n AS fraction_0, class_1 / n AS fraction_1, class_2 / n AS fraction_2 FROM (
        SELECT task, split, sum(n) AS n, sum(class_0) AS class_0, sum(class_1) AS class_1, sum(class_2) AS class_2 FROM ({DISTRIBUTION_SQL}) GROUP BY 1, 2)""",
    clock=True,
)
def class_fractions(p: Prepared):
    return metrics.class_fractions(clock.class_distribution(p.clock_labels))


@question(
    "split reason n:i",
    f"""UNPIVOT (SELECT split, sum(candidates)::BIGINT AS candidates, sum(retained)::BIGINT AS retained, {', '.join(f'sum({r})::BIGINT AS {r}' for r in clock.REASONS)}
        FROM ({AUDIT_SQL}) GROUP BY 1) ON candidates, retained, {', '.join(clock.REASONS)} INTO NAME reason VALUE n""",
    clock=True,
)
def exclusion_totals(p: Prepared):
    return metrics.exclusion_totals(clock.exclusion_counts(p.anchors), clock.REASONS)


@question(
    "split low:r median:r high:r",
    "SELECT split, min(seconds) AS low, median(seconds) AS median, max(seconds) AS high FROM ex GROUP BY 1",
)
def horizon_spans(p: Prepared):
    return metrics.span_stats(p.examples, "horizon_seconds", SPLITS)


@question(
    "split label_0:i label_1:i label_2:i",
    "SELECT split, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1, count(*) FILTER (label = 2) AS label_2 FROM ex GROUP BY 1",
)
def label_distribution(p: Prepared):
    return metrics.label_distribution(p.examples)


# Probes -----------------------------------------------------------------------------------------


def probe_rows(p: Prepared) -> DataFrame:
    """Clock anchors with their statistics ``x`` and the volatility label."""
    return p.landed(
        "probe-rows", lambda p: p.clock_labels.select("split", *IDENT, F.array(*clock.FEATURES).alias("x"), F.col("T2_label").alias("label"), "T3_label")
    )


def fitted(p: Prepared) -> tuple[probes.Probe, list[dict]]:
    rows = probe_rows(p)
    train, val = (rows.where(F.col("split") == split) for split in ("train", "val"))
    return p.once("probe", lambda p: probes.select_probe(train, val, (0.001, 0.01, 0.1)))


SCALER_SQL = " UNION ALL ".join(
    f"SELECT {i} AS i, '{f}' AS feature, avg({f}) AS mean, greatest(stddev_pop({f}), 1e-6) AS scale FROM cex WHERE split = 'train'" for i, f in enumerate(clock.FEATURES)
)


@question("i:i feature mean:r scale:r", SCALER_SQL, clock=True)
def probe_scaler(p: Prepared):
    mean, scale = probes.fit_scaler(probe_rows(p).where("split = 'train'"))
    rows = [(i, f, mean[i], scale[i]) for i, f in enumerate(clock.FEATURES)]
    return p.spark.createDataFrame(rows, "i int, feature string, mean double, scale double")


@question("i:i classes:i weight_sum:r", "SELECT i, 3 AS classes, 0.0 AS weight_sum FROM range(13) f(i)", clock=True)
def probe_parameters(p: Prepared):
    """Weights of the chosen volatility probe, summed over the classes: the penalty is the same for all, so at the optimum they cancel."""
    frame = fitted(p)[0].to_frame(p.spark)
    weights = frame.select("class", F.posexplode("weight").alias("i", "weight"))
    return weights.groupBy("i").agg(F.count("*").alias("classes"), (F.round(F.sum("weight"), 4) + F.lit(0.0)).alias("weight_sum"))


@question("class:i i:i optimal", "SELECT c.i AS class, f.i - 1 AS i, true AS optimal FROM range(3) c(i), range(14) f(i), (SELECT count(*) FROM cex)", clock=True)
def probe_gradient(p: Prepared):
    """The penalised objective is flat at the fitted weights; position -1 is the intercept."""
    slopes = probes.gradient(probe_rows(p).where("split = 'train'"), fitted(p)[0])
    return slopes.select("class", "i", (F.abs("slope") < 1e-5).alias("optimal"))


@question("split symbol date anchor:i label:i proper", "SELECT *, T2_label AS label, true AS proper FROM clab WHERE split <> 'train'", clock=True)
def probe_predictions(p: Prepared):
    """Every row outside training scored: three probabilities that sum to one, the likeliest class and its loss."""
    found = metrics.predictions(probes.predict_probe(probe_rows(p).where("split <> 'train'"), fitted(p)[0]), ["split", *IDENT])
    values = [F.col(f"p{k}") for k in range(3)]
    own = F.when(F.col("label") == 0, values[0]).when(F.col("label") == 1, values[1]).otherwise(values[2])
    likeliest = F.when(F.col("predicted") == 0, values[0]).when(F.col("predicted") == 1, values[1]).otherwise(values[2])
    fits = (F.abs(values[0] + values[1] + values[2] - 1) < 1e-9) & (likeliest == F.greatest(*values)) & (F.abs(F.exp(-F.col("nll")) - own) < 1e-9)
    return found.select("split", *IDENT, "label", fits.alias("proper"))


@question("strength:r converged selected_is_lowest", "SELECT unnest([0.001, 0.01, 0.1]) AS strength, true AS converged, true AS selected_is_lowest")
def probe_selection(p: Prepared):
    """The candidate table: each fit is flat where it stopped, and the selected one has the lowest validation loss."""
    table = p.spark.createDataFrame(fitted(p)[1], "strength double, val_nll double, objective double, gradient double, iterations int, selected boolean")
    lowest = min(row["val_nll"] for row in fitted(p)[1])
    return table.select("strength", (F.col("gradient") <= 1e-5).alias("converged"), (F.col("selected") == (F.col("val_nll") == lowest)).alias("selected_is_lowest"))


@question("rows:i rebuilt", "SELECT count(*) AS rows, true AS rebuilt FROM cex WHERE split <> 'train'", clock=True)
def probe_audit(p: Prepared):
    """Probabilities rebuilt from the saved parameters by joins agree with the scored ones."""
    scored = probes.predict_probe(probe_rows(p).where("split <> 'train'"), fitted(p)[0])
    return probes.audit_probe(scored, fitted(p)[0], IDENT).select("rows", (F.col("max_probability_error") < 1e-9).alias("rebuilt"))


def representation(tokens_column: str):
    return F.transform(tokens_column, lambda t: t / 512)


def two_views(p: Prepared) -> DataFrame:
    """Mean of the current and the older (event policy) context, for anchors where both exist."""
    older = clock.older_windows(p.clock_examples, p.usable_trades, p.clock_spec, p.clean_spec, p.context, p.context)
    older = older.where("usable and policy = 'event'").select(*IDENT, (F.col("older_r") - 1).alias("e"))
    now = labels.context_codes(p.clock_examples, p.coded, p.context, last="last_code_index").withColumnRenamed("tokens", "now")
    then = labels.context_codes(older, p.coded, p.context).withColumnRenamed("tokens", "then")
    both = now.join(then, IDENT)
    return both.select(*IDENT, probes.two_view_mean(representation("now"), representation("then")).alias("view"))


@question(
    "symbol date anchor:i first:r last:r total:r",
    """SELECT c.symbol, c.date, c.anchor, (a.t11 + b.t11) / 1024 AS first, (a.token + b.token) / 1024 AS last, (a.t + b.t) / 1024 AS total FROM cex c
       JOIN (SELECT symbol, date, e, token, lag(token, 11) OVER w AS t11, sum(token) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS t FROM coded
             WINDOW w AS (PARTITION BY symbol, date ORDER BY e)) a ON a.symbol = c.symbol AND a.date = c.date AND a.e = c.last_code_index
       JOIN (SELECT symbol, date, e, token, lag(token, 11) OVER w AS t11, sum(token) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS t FROM coded
             WINDOW w AS (PARTITION BY symbol, date ORDER BY e)) b ON b.symbol = c.symbol AND b.date = c.date AND b.e = c.last_code_index - 12
       WHERE c.last_raw_trade_index - 12 >= 12""",
    clock=True,
)
def two_view_features(p: Prepared):
    view = F.col("view")
    total = F.aggregate(view, F.lit(0.0), lambda a, v: a + v)
    return two_views(p).select(*IDENT, view[0].alias("first"), view[p.context - 1].alias("last"), total.alias("total"))


GRID = dict(tasks={"T1": "T1_label", "T2": "T2_label", "T3": "T3_label"}, seeds=(42, 43), budgets=(150, "all"), grid=(0.01, 0.1))


def grid(p: Prepared) -> probes.Grid:
    """Three tasks, two seeds, 150 and all labels, statistics with and without a representation: 48 probes fitted together."""
    def make(p: Prepared) -> probes.Grid:
        # T1 counts few events in a small table, so its lower tertile is 0, on which ties would go up and leave no lower class.
        low, high = p.thresholds["T1"]
        strict = (F.col("T1_target") > low).cast("int") + (F.col("T1_target") > high).cast("int")
        rows = p.clock_labels.withColumn("T1_label", strict).select("split", *IDENT, F.array(*clock.FEATURES).alias("x"), *GRID["tasks"].values())
        rows = rows.join(two_views(p), IDENT).withColumn("both", probes.assemble(F.col("x"), F.col("view")))
        return probes.probe_grid(rows, {"stats": F.col("x"), "stats_views": F.col("both")}, IDENT, **GRID)

    return p.once("grid", make)


#: The grid's rows, training sets and class priors; every other figure of a probe is a fit, of which SQL can say that it is there.
GRID_CTES = """
grows AS (SELECT clab.* REPLACE ((T1_target > q1[1])::INT + (T1_target > q1[2])::INT AS T1_label) FROM clab, thr WHERE last_raw_trade_index - 12 >= 12),
gset AS (
  SELECT seed, '150' AS budget, symbol, date, anchor, T1_label, T2_label, T3_label FROM (
    SELECT *, row_number() OVER (PARTITION BY seed ORDER BY ('0x' || substr(md5(concat_ws('|', seed, symbol, date, anchor)), 1, 8))::BIGINT, symbol, date, anchor) AS rank
    FROM grows, (SELECT unnest([42, 43]) AS seed) WHERE split = 'train') WHERE rank <= 150
  UNION ALL SELECT seed, 'all', symbol, date, anchor, T1_label, T2_label, T3_label FROM grows, (SELECT unnest([42, 43]) AS seed) WHERE split = 'train'),
glong AS (
  SELECT 'T1' AS task, * EXCLUDE (T1_label, T2_label, T3_label), T1_label AS label FROM gset UNION ALL SELECT 'T2', * EXCLUDE (T1_label, T2_label, T3_label), T2_label FROM gset
  UNION ALL SELECT 'T3', * EXCLUDE (T1_label, T2_label, T3_label), T3_label FROM gset),
gcount AS (SELECT task, seed, budget, count(*) AS n_train, count(*) FILTER (label = 0) AS train_0, count(*) FILTER (label = 1) AS train_1,
  count(*) FILTER (label = 2) AS train_2 FROM glong GROUP BY 1, 2, 3),
gtest AS (
  SELECT 'T1' AS task, split, symbol, date, anchor, T1_label AS label FROM grows WHERE split <> 'train'
  UNION ALL SELECT 'T2', split, symbol, date, anchor, T2_label FROM grows WHERE split <> 'train'
  UNION ALL SELECT 'T3', split, symbol, date, anchor, T3_label FROM grows WHERE split <> 'train'),
gscored AS (SELECT t.*, c.* EXCLUDE (task), -ln((CASE label WHEN 0 THEN train_0 WHEN 1 THEN train_1 ELSE train_2 END + 1.0) / (n_train + 3)) AS nll FROM gtest t JOIN gcount c USING (task)),
gmethod AS (SELECT unnest(['frequency', 'stats', 'stats_views']) AS method)
"""


def grid_rows(p: Prepared, groups: list[str]) -> DataFrame:
    table = grid(p).metrics(groups)
    prior = F.col("method") == "frequency"
    sound = F.col("nll").between(1e-6, 50) & F.col("brier").between(0, 2) & F.col("accuracy").between(0, 1) & (prior | F.col("strength").isin(*GRID["grid"]))
    return table.select(
        "task", "method", "budget", "seed", *groups, "examples", "n_train", *[f"train_{k}" for k in range(3)], F.when(prior, F.col("nll")).alias("prior_nll"), sound.alias("sound")
    )


def grid_sql(groups: str) -> str:
    return f"""SELECT task, method, budget, seed, {groups}, count(*) AS examples, any_value(n_train) AS n_train, any_value(train_0) AS train_0, any_value(train_1) AS train_1,
       any_value(train_2) AS train_2, CASE WHEN method = 'frequency' THEN avg(nll) END AS prior_nll, true AS sound FROM gscored, gmethod GROUP BY task, method, budget, seed, {groups}"""


GRID_COLUMNS = "examples:i n_train:i train_0:i train_1:i train_2:i prior_nll:r sound"


@question(f"task method budget seed:i split {GRID_COLUMNS}", grid_sql("split"), GRID_CTES, clock=True)
def probe_grid(p: Prepared):
    """Metrics of the selected probes and of the class priors by split, with their training counts."""
    return grid_rows(p, ["split"])


@question(f"task method budget seed:i split symbol date {GRID_COLUMNS}", grid_sql("split, symbol, date"), GRID_CTES, clock=True)
def probe_sessions(p: Prepared):
    """The same by session."""
    return grid_rows(p, ["split", *KEY])


@question(
    "task method budget seed:i strength:r optimal selected_is_lowest",
    """SELECT task, method, budget, seed, strength, true AS optimal, true AS selected_is_lowest FROM gcount, gmethod, (SELECT unnest([0.01, 0.1]) AS strength)
       WHERE method <> 'frequency'""",
    GRID_CTES,
    clock=True,
)
def probe_candidates(p: Prepared):
    """All 48 candidates: flat where they stopped, and of each pair the one with the lower validation loss is selected."""
    table, keys = grid(p).candidates, ["task", "method", "budget", "seed"]
    lowest = table.groupBy(*keys).agg(F.min("val_nll").alias("lowest"))
    chosen = F.col("selected") == (F.col("val_nll") == F.col("lowest"))
    return table.join(lowest, keys).select(*keys, "strength", (F.col("gradient") <= 1e-5).alias("optimal"), chosen.alias("selected_is_lowest"))


@question(
    "seed:i budget:i n:i class_0:i class_1:i class_2:i ids_digest",
    """SELECT seed, budget, count(*) AS n, count(*) FILTER (label = 0) AS class_0, count(*) FILTER (label = 1) AS class_1, count(*) FILTER (label = 2) AS class_2,
         CAST(sum(('0x' || substr(md5(concat_ws('|', symbol, date, anchor)), 1, 12))::BIGINT) AS VARCHAR) AS ids_digest
       FROM subset, (SELECT unnest([20, 80]) AS budget) WHERE rank <= budget GROUP BY 1, 2""",
)
def subset_counts(p: Prepared):
    return probes.subset_counts(subset(p), IDENT)


@question(
    "split symbol date anchor:i tokens T1_label:i T2_label:i T3_label:i proper",
    """SELECT c.*, h.tokens, true AS proper FROM clab c JOIN history h ON h.symbol = c.symbol AND h.date = c.date AND h.e = c.last_code_index WHERE c.split = 'heldout'""",
    clock=True,
)
def frozen_scoring(p: Prepared):
    """Held-out prints scored anew by a bundle of edges, thresholds and probe that was stored and opened again."""
    path = f"{shared_dir(p.spark)}/tapeloom/bundle-{uuid.uuid4().hex}"
    fitted_ = frozen.Bundle(p.binner, p.thresholds, {"T2": fitted(p)[0]}, tuple(clock.FEATURES), p.token_spec, p.clock_spec, p.clean_spec)
    opened = frozen.open_bundle(p.spark, path, frozen.write_bundle(p.spark, fitted_, path))
    scored = frozen.apply_frozen(p.kept.where("split = 'heldout'"), opened).score("T2")
    total = F.aggregate("p", F.lit(0.0), lambda a, v: a + v)
    return scored.select("split", *IDENT, F.array_join("tokens", ",").alias("tokens"), "T1_label", "T2_label", "T3_label", (F.abs(total - 1) < 1e-9).alias("proper"))


# Comparison -------------------------------------------------------------------------------------


@question(
    "split method mean:r seed_std:r seeds:i",
    "SELECT split, method, avg(nll) AS mean, stddev_samp(nll) AS seed_std, count(nll) AS seeds FROM metric GROUP BY 1, 2",
)
def seed_summary(p: Prepared):
    return compare.seed_summary(metric(p), ["split", "method"])


WIDE_SQL = "SELECT split, seed, " + ", ".join(f"max(nll) FILTER (method = '{m}') AS {m}" for m in METHODS) + " FROM metric GROUP BY 1, 2"


@question("split seed:i " + " ".join(f"{m}:r" for m in METHODS), WIDE_SQL)
def pivoted_metrics(p: Prepared):
    return compare.pivot_metrics(metric(p), ["split", "seed"], "method", METHODS)


DELTA_SQL = " UNION ALL ".join(f"SELECT split, seed, '{a} - {b}' AS comparison, {a} - {b} AS delta FROM ({WIDE_SQL})" for a, b in PAIRS)


@question(
    "split comparison mean_delta:r std_delta:r seeds:i negative:i",
    f"""SELECT split, comparison, avg(delta) AS mean_delta, stddev_samp(delta) AS std_delta, count(delta) AS seeds, count(*) FILTER (delta < 0) AS negative
        FROM ({DELTA_SQL}) GROUP BY 1, 2""",
)
def paired_differences(p: Prepared):
    return compare.paired_differences(metric(p), PAIRS, ["split"])


@question("split symbol date anchor:i seed:i a:r b:r", """SELECT a.split, a.symbol, a.date, a.anchor, a.seed, a.nll AS a, b.nll AS b FROM pred a
  JOIN pred b USING (symbol, date, anchor, seed) WHERE a.method = 'prior_20' AND b.method = 'prior_80'""")
def one_to_one_join(p: Prepared):
    a, b = (predictions(p).where(F.col("method") == m) for m in ("prior_20", "prior_80"))
    on = [*IDENT, "seed"]
    return compare.checked_join(a.select("split", *on, F.col("nll").alias("a")), b.select(*on, F.col("nll").alias("b")), on, "one_to_one")


@question(
    "split comparison mean_delta:r wins:i ties:i seed_42:r seed_43:r seed_44:r",
    f"""SELECT split, comparison, avg(delta) AS mean_delta, count(*) FILTER (delta < -1e-7) AS wins, count(*) FILTER (abs(delta) <= 1e-7) AS ties,
        max(delta) FILTER (seed = 42) AS seed_42, max(delta) FILTER (seed = 43) AS seed_43, max(delta) FILTER (seed = 44) AS seed_44 FROM ({DELTA_SQL}) GROUP BY 1, 2""",
)
def wins_ties(p: Prepared):
    deltas = compare.all_pairs(metric(p), PAIRS, ["split", "seed"])
    return compare.wins_ties(deltas, ["split", "comparison"], SEEDS)


@question(
    "split seed:i method nll:r baseline:r gain:r",
    "SELECT m.split, m.seed, m.method, m.nll, b.nll AS baseline, b.nll - m.nll AS gain FROM metric m JOIN metric b ON b.method = 'uniform' AND b.split = m.split AND b.seed = m.seed WHERE m.method <> 'uniform'",
)
def baseline_gains(p: Prepared):
    return compare.gains(metric(p), "uniform", ["split", "seed"]).select("split", "seed", "method", "nll", "baseline", "gain")


@question(
    "split seed:i old_gap:r new_gap:r shrink:r left_improvement:r right_improvement:r",
    f"""SELECT split, seed, prior_20 - uniform AS old_gap, prior_80 - uniform AS new_gap, (prior_20 - prior_80) / nullif(prior_20 - uniform, 0) AS shrink,
        prior_20 - prior_80 AS left_improvement, 0.0 AS right_improvement FROM ({WIDE_SQL})""",
)
def gap_change(p: Prepared):
    """Gap to the even guess in a study with 20 labels and in one with 80."""
    base = metric(p).select("split", "seed", "method", "nll")
    studies = None
    for study, prior in (("small", "prior_20"), ("large", "prior_80")):
        part = base.where(F.col("method").isin(prior, "uniform")).withColumn("study", F.lit(study))
        part = part.withColumn("method", F.when(F.col("method") == prior, "prior").otherwise(F.col("method")))
        studies = part if studies is None else studies.unionByName(part)
    return compare.gap_change(studies, "study", "small", "large", "prior", "uniform", ["split", "seed"])


@question(
    "split method seed:i n:i",
    """SELECT g.split, g.method, g.seed, count(m.nll) AS n FROM (SELECT unnest(['val', 'test', 'heldout', 'train']) AS split) s
       CROSS JOIN (SELECT unnest(['prior_20', 'prior_80', 'prior_all', 'uniform']) AS method) t CROSS JOIN (SELECT unnest([42, 43, 44]) AS seed) u
       CROSS JOIN LATERAL (SELECT s.split, t.method, u.seed) g LEFT JOIN metric m ON m.split = g.split AND m.method = g.method AND m.seed = g.seed
       GROUP BY 1, 2, 3 HAVING count(m.nll) <> 1""",
)
def grid_gaps(p: Prepared):
    """Cells a grid over all four splits lacks: training rows are never scored."""
    dims = {"split": ("val", "test", "heldout", "train"), "method": METHODS, "seed": SEEDS}
    return compare.grid_problems(metric(p), dims).select("split", "method", "seed", "n")


@question(
    "split window_index:i side",
    """SELECT *, 'left' AS side FROM (SELECT split, window_index FROM located EXCEPT ALL SELECT split, window_index FROM small)
       UNION ALL SELECT *, 'right' FROM (SELECT split, window_index FROM small EXCEPT ALL SELECT split, window_index FROM located)""",
    """small AS (SELECT split, CASE WHEN m = 1 THEN 0 WHEN k = m - 1 THEN n - 1 ELSE CAST(floor(k * ((n - 1)::DOUBLE / (m - 1))) AS BIGINT) END AS window_index
       FROM (SELECT split, n, least(n, 400) AS m FROM totals), LATERAL (SELECT unnest(range(m)) AS k))""",
)
def differing_rows(p: Prepared):
    """Windows that two evaluation plans do not share."""
    fewer = windows.evaluation_subset(totals(p), 400)
    return compare.key_differences(pairs(p), fewer, ["split", "window_index"])


@question(
    "supervision seed:i step:i sessions:i unique_targets:i",
    f"""SELECT c.supervision, c.seed, c.step, h.sessions, c.unique_targets FROM ({COVERAGE_SQL}) c JOIN (
          SELECT seed, s.step, count(DISTINCT (symbol, date)) AS sessions FROM stream_at a JOIN (SELECT unnest([1, 10, 40]) AS step) s ON a.step <= s.step GROUP BY 1, 2) h
        ON h.seed = c.seed AND h.step = c.step""",
)
def learning_curves(p: Prepared):
    """A history of sessions reached, joined to the target coverage of the same steps."""
    marks = F.explode(F.filter(F.array(*[F.lit(s).cast("bigint") for s in (1, 10, 40)]), lambda s: s >= F.col("step")))
    reached = stream_at(p).select("seed", *KEY, marks.alias("step")).groupBy("seed", "step").agg(F.count_distinct(*KEY).alias("sessions"))
    history = reached.withColumn("supervision", F.explode(F.array(F.lit("last"), F.lit("dense"))))
    covered = windows.coverage(stream_at(p), p.context, BATCH, (1, 10, 40))
    return compare.learning_curves(history, covered).select("supervision", "seed", "step", "sessions", "unique_targets")


@question("cohort date comparison delta:r", "SELECT * FROM daily")
def daily_contrasts(p: Prepared):
    return daily(p)


@question(
    "method mean:r",
    """SELECT method, avg(x) AS mean FROM (SELECT method, date, avg(x) AS x FROM (SELECT method, date, symbol, avg(nll) AS x FROM sd GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""",
)
def hierarchical_mean(p: Prepared):
    return compare.hierarchical_mean(symbol_days(p), ["method"], ["date", "symbol", "seed"])


@question("cohort method n:i nll:r", "SELECT cohort, method, count(*) AS n, avg(nll) AS nll FROM pred JOIN cohorts USING (symbol) GROUP BY 1, 2")
def cohort_scores(p: Prepared):
    return compare.by_cohort(predictions(p), COHORTS).groupBy("cohort", "method").agg(F.count(F.lit(1)).alias("n"), F.avg("nll").alias("nll"))


BOOT = """days AS (SELECT cohort, date, row_number() OVER (PARTITION BY cohort ORDER BY date) - 1 AS day, count(*) OVER (PARTITION BY cohort) AS n
  FROM (SELECT DISTINCT cohort, date FROM daily)),
draws{b} AS (
  SELECT cohort, replicate, slot, step, (start + step) % n AS day FROM (
    SELECT cohort, n, replicate, slot, ('0x' || substr(md5('7|' || replicate || '|' || slot), 1, 8))::BIGINT % n AS start
    FROM (SELECT DISTINCT cohort, n FROM days), (SELECT unnest(range(200)) AS replicate), (SELECT unnest(range(40)) AS slot) WHERE slot < ceil(n / {b}.0)),
    (SELECT unnest(range({b})) AS step) WHERE slot * {b} + step < n),
means{b} AS (
  SELECT d.cohort, v.comparison, d.replicate, avg(v.delta) AS mean FROM draws{b} d JOIN days y ON y.cohort = d.cohort AND y.day = d.day
  JOIN daily v ON v.cohort = d.cohort AND v.date = y.date GROUP BY 1, 2, 3),
boot{b} AS (
  SELECT m.cohort, m.comparison, t.delta, quantile_cont(m.mean, 0.025) AS ci95_low, quantile_cont(m.mean, 0.975) AS ci95_high,
    (count(*) FILTER (abs(m.mean - t.delta) >= abs(t.delta)) + 1) / 201.0 AS p_two_sided, {b} AS block_days, t.dates
  FROM means{b} m JOIN (SELECT cohort, comparison, avg(delta) AS delta, count(*) AS dates FROM daily GROUP BY 1, 2) t
    ON t.cohort = m.cohort AND t.comparison = m.comparison GROUP BY 1, 2, 3, 8)"""
BOOT_ONE = BOOT.format(b=1).split("draws1", 1)[1]
BOOT_COLUMNS = "cohort comparison delta:r ci95_low:r ci95_high:r p_two_sided:r block_days:i dates:i"


@question(BOOT_COLUMNS, "SELECT * FROM boot2 UNION ALL SELECT * FROM boot1", BOOT.format(b=2), "draws1" + BOOT_ONE)
def block_bootstrap(p: Prepared):
    parts = [compare.block_bootstrap(daily(p), block, REPLICATES, 7) for block in (2, 1)]
    return parts[0].unionByName(parts[1])


@question(
    "cohort comparison p_two_sided:r holm_p:r",
    """SELECT cohort, comparison, p_two_sided, least(1, max(p_two_sided * (4 - k)) OVER (PARTITION BY cohort ORDER BY k)) AS holm_p
       FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY p_two_sided, comparison) AS k FROM boot2)""",
    BOOT.format(b=2),
)
def holm_adjusted(p: Prepared):
    tests = compare.block_bootstrap(daily(p), 2, REPLICATES, 7)
    return compare.holm(tests, ["cohort"]).select("cohort", "comparison", "p_two_sided", "holm_p")


@question(
    "cohort comparison omitted_date delta:r",
    """SELECT a.cohort, a.comparison, a.date AS omitted_date, avg(b.delta) AS delta FROM daily a JOIN daily b
       ON a.cohort = b.cohort AND a.comparison = b.comparison AND a.date <> b.date GROUP BY 1, 2, 3""",
)
def leave_one_date_out(p: Prepared):
    return compare.leave_one_out(daily(p))


SEED_SQL = """SELECT cohort, seed, comparison, avg(delta) AS delta FROM (
  SELECT cohort, seed, date, unnest(['policy', 'interaction', 'incremental']) AS comparison, unnest([b - a, (b - a) - (c - d), b - d]) AS delta FROM (
    SELECT cohort, seed, date, avg(nll) FILTER (method = 'prior_20') AS a, avg(nll) FILTER (method = 'prior_80') AS b,
      avg(nll) FILTER (method = 'prior_all') AS c, avg(nll) FILTER (method = 'uniform') AS d FROM sd JOIN cohorts USING (symbol) GROUP BY 1, 2, 3)) GROUP BY 1, 2, 3"""


def per_seed(p: Prepared) -> DataFrame:
    cohort = compare.by_cohort(symbol_days(p), COHORTS)
    means = compare.hierarchical_mean(cohort, ["cohort", "seed", "date", "method"], ["symbol"])
    wide = compare.pivot_metrics(means, ["cohort", "seed", "date"], "method", METHODS, "mean")
    return compare.contrasts(wide, ["cohort", "seed", "date"], named_contrasts()).groupBy("cohort", "seed", "comparison").agg(F.avg("delta").alias("delta"))


@question("cohort seed:i comparison delta:r", SEED_SQL)
def contrasts_by_seed(p: Prepared):
    return per_seed(p)


@question(
    "cohort comparison improving_seeds:i seeds:i",
    f"SELECT cohort, comparison, count(*) FILTER (delta < -1e-7) AS improving_seeds, count(*) AS seeds FROM ({SEED_SQL}) GROUP BY 1, 2",
)
def improving_seeds(p: Prepared):
    return compare.seed_contrasts(per_seed(p))


@question("split symbol date anchor:i seed:i method nll:r", "SELECT * FROM pred")
def pointwise_losses(p: Prepared):
    return predictions(p).select("split", *IDENT, "seed", "method", "nll")


@question(
    "date symbols:i missing:i",
    """SELECT d.date, count(s.symbol) AS symbols, 4 - count(s.symbol) AS missing FROM (SELECT DISTINCT date FROM placed) d
       LEFT JOIN (SELECT DISTINCT symbol, date FROM pred) s ON s.date = d.date GROUP BY 1""",
)
def declared_coverage(p: Prepared):
    """Declared days of all four symbols against the sessions that were scored."""
    days = [(d, s) for d in (*p.split_spec.train, *p.split_spec.val, *p.split_spec.test) for s in COHORTS["all"]]
    declared = p.spark.createDataFrame(days, "date string, symbol string").withColumn("date", F.col("date").cast("date"))
    return compare.undeclared_gaps(predictions(p), declared)


# Integrity --------------------------------------------------------------------------------------


@question(
    "symbol date rows:i hash_sum",
    """SELECT symbol, date, count(*) AS rows, CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', symbol, date, e, c0, c1, c2)), 1, 15))::BIGINT AS HUGEINT)) AS VARCHAR) AS hash_sum
       FROM coded GROUP BY 1, 2""",
)
def session_fingerprints(p: Prepared):
    """Fingerprints of the coded events of each session, which SQL repeats."""
    return integrity.portable_fingerprints(p.coded, KEY, [*KEY, "e", "c0", "c1", "c2"])


@question(
    "value rows:i one_side:i max_gap:r beyond:i",
    "SELECT unnest(['nll', 'accuracy', 'brier']) AS value, count(*) AS rows, 0 AS one_side, 0.0 AS max_gap, 0 AS beyond FROM metric",
)
def results_audit(p: Prepared):
    """Stored metrics against a second derivation from single predictions."""
    single = metrics.predictions(predictions(p), ["split", "method", "seed"])
    share = [F.when(F.col("label") == k, 1.0).otherwise(0.0) for k in range(3)]
    brier = sum((F.pow(F.col(f"p{k}") - share[k], 2) for k in range(3)), F.lit(0.0))
    again = single.groupBy("split", "method", "seed").agg(
        F.avg("nll").alias("nll"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"), F.avg(brier).alias("brier")
    )
    return integrity.audit_results(metric(p), again, ["split", "method", "seed"], ["nll", "accuracy", "brier"], 1e-9)
