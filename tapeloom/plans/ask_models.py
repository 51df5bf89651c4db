"""Questions about windows, sampling, frequency and Markov models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KEY
from ..operators import markov, metrics, windows
from ..operators.ordering import framed, positions
from .prepare import Prepared
from .questions import question

SEEDS = (42, 43, 44)
STEPS, BATCH = 40, 16
STRENGTHS = (1.0, 10.0, 100.0, 1000.0)
EVALUATED = 500


def totals(p: Prepared) -> DataFrame:
    return windows.split_totals(p.counts)


def located(p: Prepared) -> DataFrame:
    return windows.locate(windows.evaluation_subset(totals(p), EVALUATED), p.counts)


def pairs(p: Prepared) -> DataFrame:
    return p.landed("pairs", lambda p: markov.evaluation_pairs(located(p), p.coded, p.context))


def counts(p: Prepared) -> DataFrame:
    return p.landed("transitions", lambda p: markov.transition_counts(p.coded.where("split = 'train'"), p.context))


def frequency(p: Prepared) -> DataFrame:
    return p.landed("frequency", lambda p: markov.fit_frequency(p.coded.where("split = 'train'"), p.vocab, p.context))


def stream(p: Prepared) -> DataFrame:
    return windows.sample_stream(totals(p).where("split = 'train'"), SEEDS, STEPS, BATCH)


def stream_at(p: Prepared) -> DataFrame:
    return p.landed("stream", lambda p: windows.locate(stream(p), p.counts))


def strength(p: Prepared) -> float:
    val = pairs(p).where("split = 'val'")
    return markov.select_strength(markov.strength_scores(val, counts(p), frequency(p), STRENGTHS, p.vocab)).first().strength


def scores(p: Prepared) -> DataFrame:
    keys = [*KEY, "split", "window_index", "e", "nll"]
    plain = markov.frequency_nll(pairs(p), frequency(p), p.vocab).select(F.lit("frequency").alias("variant"), *keys)
    chained = markov.markov_nll(pairs(p), counts(p), frequency(p), strength(p), p.vocab).select(F.lit("markov").alias("variant"), *keys)
    return plain.unionByName(chained)


@question("symbol date split windows:i first:i last:i", "SELECT *, first + windows AS last FROM wc")
def window_counts(p: Prepared):
    return p.counts.select(*KEY, "split", "windows", "first", "last")


WINDOW_SQL = """SELECT symbol, date, split, e - 12 AS start, tokens, e FROM (
  SELECT symbol, date, split, e, string_agg(token, ',' ORDER BY e) OVER (PARTITION BY symbol, date ORDER BY e ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS tokens
  FROM coded) WHERE e >= 12"""


@question("symbol date split start:i tokens", WINDOW_SQL)
def event_windows(p: Prepared):
    found = windows.windows(p.coded, p.context)
    return found.select(*KEY, "split", "start", F.array_join("tokens", ",").alias("tokens"))


@question("symbol date split start:i tokens", f"SELECT * FROM ({WINDOW_SQL}) WHERE (e - 12) % 9 = 0")
def strided_windows(p: Prepared):
    found = windows.windows(p.coded, p.context, stride=9)
    return found.select(*KEY, "split", "start", F.array_join("tokens", ",").alias("tokens"))


@question("split window_index:i symbol date start:i", "SELECT * FROM located")
def evaluation_windows(p: Prepared):
    return located(p).select("split", "window_index", *KEY, "start")


@question("seed:i step:i slot:i window_index:i", "SELECT * FROM stream")
def sampled_stream(p: Prepared):
    return stream(p).select("seed", "step", "slot", "window_index")


@question(
    "seed:i budget:i symbol date anchor:i rank:i",
    "SELECT *, b.budget FROM subset, (SELECT unnest([20, 80]) AS budget) b WHERE rank <= b.budget",
)
def nested_subsets(p: Prepared):
    train = p.examples.where("split = 'train'")
    ranked = windows.nested_subsets(train, [*KEY, "anchor"], SEEDS, (20, 80))
    each = ranked.withColumn("budget", F.explode(F.array(F.lit(20), F.lit(80))))
    return each.where("rank <= budget").select("seed", "budget", *KEY, "anchor", "rank")


@question(
    "supervision seed:i symbol date e:i exposures:i",
    "SELECT supervision, seed, symbol, date, e, count(*) AS exposures FROM stream_targets GROUP BY ALL",
)
def expanded_targets(p: Prepared):
    parts = []
    for mode in ("last", "dense"):
        targets = windows.expand_targets(stream_at(p), p.context, mode)
        parts.append(targets.groupBy(F.lit(mode).alias("supervision"), "seed", *KEY, "e").agg(F.count(F.lit(1)).alias("exposures")))
    return parts[0].unionByName(parts[1])


COVERAGE_SQL = """SELECT supervision, f.seed, c.step, c.step * 16 AS sampled_windows,
    c.step * 16 * CASE supervision WHEN 'dense' THEN 12 ELSE 1 END AS target_exposures, count(*) AS unique_targets
  FROM (SELECT supervision, seed, symbol, date, e, min(step) AS step FROM stream_targets GROUP BY ALL) f
  JOIN (SELECT unnest([1, 10, 40]) AS step) c ON f.step <= c.step GROUP BY 1, 2, 3"""


@question("supervision seed:i step:i sampled_windows:i target_exposures:i unique_targets:i", COVERAGE_SQL)
def target_coverage(p: Prepared):
    return windows.coverage(stream_at(p), p.context, BATCH, (1, 10, 40))


@question(
    "split stride:i n:i",
    "SELECT split, stride, count(*) AS n FROM coded, (SELECT unnest([1, 3]) AS stride) WHERE e >= 12 AND (e - 12) % stride = 0 GROUP BY ALL",
)
def eligible_targets(p: Prepared):
    parts = [p.coded.where(windows.eligible(p.context, s)).groupBy("split").agg(F.lit(s).alias("stride"), F.count(F.lit(1)).alias("n")) for s in (1, 3)]
    return parts[0].unionByName(parts[1])


@question("token:i n:i p:r", "SELECT * FROM freq")
def frequency_model(p: Prepared):
    return frequency(p)


@question("prev:i next:i n:i", "SELECT * FROM tc")
def transition_counts(p: Prepared):
    return counts(p)


@question(
    "split prev:i next:i n:i",
    "SELECT split, prev, token AS next, count(*) AS n FROM coded WHERE e >= 12 AND (e - 12) % 3 = 0 GROUP BY 1, 2, 3",
)
def strided_transitions(p: Prepared):
    return markov.transition_counts(p.coded, p.context, stride=3, keys=["split"])


@question("supervision seed:i prev:i next:i n:i", "SELECT * FROM sampled")
def sampled_transitions(p: Prepared):
    parts = []
    for mode in ("last", "dense"):
        targets = windows.expand_targets(stream_at(p), p.context, mode)
        parts.append(markov.sampled_transitions(targets, p.coded).withColumn("supervision", F.lit(mode)))
    return parts[0].unionByName(parts[1])


def matched_counts(p: Prepared) -> DataFrame:
    return markov.sampled_transitions(windows.expand_targets(stream_at(p), p.context, "last"), p.coded)


@question("seed:i token:i n:i p:r", "SELECT * FROM matched")
def matched_prior(p: Prepared):
    return markov.matched_prior(matched_counts(p), p.vocab, ["seed"])


@question(
    "seed:i strength:r nll:r",
    """SELECT m.seed, s.strength, avg(-ln((coalesce(n.n, 0) + s.strength * m.p) / (coalesce(t.n, 0) + s.strength))) AS nll
       FROM pairs p JOIN matched m ON m.token = p.next CROSS JOIN strengths s
       LEFT JOIN (SELECT * FROM sampled WHERE supervision = 'last') n ON n.seed = m.seed AND n.prev = p.prev AND n.next = p.next
       LEFT JOIN (SELECT seed, prev, sum(n) AS n FROM sampled WHERE supervision = 'last' GROUP BY 1, 2) t ON t.seed = m.seed AND t.prev = p.prev
       WHERE p.split = 'val' GROUP BY 1, 2""",
)
def matched_strengths(p: Prepared):
    """Validation losses of the exposure-matched models, one per seed."""
    sampled = matched_counts(p)
    prior = markov.matched_prior(sampled, p.vocab, ["seed"])
    val = pairs(p).where("split = 'val'").withColumn("seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in SEEDS])))
    return markov.strength_scores(val, sampled, prior, STRENGTHS, p.vocab, ["seed"])


@question(
    "split window_index:i prev:i next:i p:r",
    "SELECT split, window_index, prev, next, (n + 100 * prior_p) / (row_n + 100) AS p FROM scored",
)
def shrunk_probabilities(p: Prepared):
    return markov.shrinkage_prob(pairs(p), counts(p), frequency(p), 100.0, p.vocab).select("split", "window_index", "prev", "next", "p")


@question("strength:r nll:r", "SELECT * FROM strength_nll")
def strength_grid(p: Prepared):
    return markov.strength_scores(pairs(p).where("split = 'val'"), counts(p), frequency(p), STRENGTHS, p.vocab)


@question("strength:r nll:r", "SELECT s.strength, s.nll FROM strength_nll s JOIN chosen c ON s.strength = c.strength")
def selected_strength(p: Prepared):
    val = pairs(p).where("split = 'val'")
    return markov.select_strength(markov.strength_scores(val, counts(p), frequency(p), STRENGTHS, p.vocab))


@question("split window_index:i symbol date e:i prev:i next:i", "SELECT * FROM pairs")
def evaluation_pairs(p: Prepared):
    return pairs(p).select("split", "window_index", *KEY, "e", "prev", "next")


@question(
    "variant split window_index:i sid:i symbol date e:i nll:r",
    "SELECT n.*, s.sid FROM nlls n JOIN sess s ON n.symbol = s.symbol AND n.date = s.date",
)
def score_table(p: Prepared):
    """Loss of every evaluated event with its identity, for both models."""
    return scores(p).join(p.sessions.select(*KEY, "sid"), list(KEY)).select("variant", "split", "window_index", "sid", *KEY, "e", "nll")


NLL_SQL = """SELECT variant, split, avg(nll) AS nll_per_event, avg(session_nll) AS session_macro_nll, count(*) AS evaluated_events FROM (
  SELECT variant, split, nll, CASE WHEN row_number() OVER s = 1 THEN avg(nll) OVER (PARTITION BY variant, split, symbol, date) END AS session_nll
  FROM nlls WINDOW s AS (PARTITION BY variant, split, symbol, date ORDER BY e)) GROUP BY 1, 2"""


@question("variant split nll_per_event:r session_macro_nll:r evaluated_events:i", NLL_SQL)
def nll_summary(p: Prepared):
    """How predictable is the next event, per split: alone, and from the event before it?"""
    return metrics.nll_summary(scores(p), ["variant", "split"])


@question("variant split symbol date mean_nll:r n:i", "SELECT variant, split, symbol, date, avg(nll) AS mean_nll, count(*) AS n FROM nlls GROUP BY ALL")
def session_nll(p: Prepared):
    return metrics.session_nll(scores(p), ["variant", "split"])


FIELD_SQL = """SELECT s.split, s.window_index, s.symbol, s.date, s.n AS n, -ln(qd) AS interval_nll, ln(qd) - ln(qp) AS price_nll, ln(qp) - ln(q) AS size_nll, -ln(q) AS nll FROM (
  SELECT s.*, (n + 100 * prior_p) / (row_n + 100) AS q,
    (coalesce((SELECT sum(tc.n) FROM tc WHERE tc.prev = s.prev AND tc.next // 64 = s.next // 64), 0) + 100 * (SELECT sum(p) FROM freq WHERE token // 64 = s.next // 64)) / (row_n + 100) AS qd,
    (coalesce((SELECT sum(tc.n) FROM tc WHERE tc.prev = s.prev AND tc.next // 8 = s.next // 8), 0) + 100 * (SELECT sum(p) FROM freq WHERE token // 8 = s.next // 8)) / (row_n + 100) AS qp
  FROM scored s) s"""


@question("split window_index:i interval_nll:r price_nll:r size_nll:r nll:r", FIELD_SQL)
def field_nll(p: Prepared):
    scored = markov.field_nll(pairs(p), counts(p), frequency(p), 100.0, 8)
    return scored.select("split", "window_index", "interval_nll", "price_nll", "size_nll", "nll")


@question(
    "split symbol date field nll:r events:i",
    f"""SELECT split, coalesce(symbol, 'every') AS symbol, coalesce(date, 'every') AS date, field, avg(nll) AS nll, count(*) AS events FROM (
        UNPIVOT (SELECT split, symbol, date, interval_nll AS interval, price_nll AS price, size_nll AS size FROM ({FIELD_SQL})) ON interval, price, size INTO NAME field VALUE nll)
        GROUP BY GROUPING SETS ((split, field), (split, symbol, date, field))""",
)
def field_nll_means(p: Prepared):
    """Field losses per split and per session."""
    scored = markov.field_nll(pairs(p), counts(p), frequency(p), 100.0, 8)
    per_split = markov.field_nll_summary(scored, ["split"]).select("split", F.lit("every").alias("symbol"), F.lit("every").alias("date"), "field", "nll", "events")
    per_session = markov.field_nll_summary(scored, ["split", *KEY]).withColumn("date", F.col("date").cast("string"))
    return per_split.unionByName(per_session)


@question(
    "prev:i rank:i next:i p:r seconds:r return_bps:r size:r",
    """SELECT t.*, exp(a.center) - 1 AS seconds, b.center AS return_bps, exp(d.center) - 1 AS size FROM (
         SELECT r.prev, f.token AS next, (coalesce(tc.n, 0) + 100 * f.p) / (r.row_n + 100) AS p,
           row_number() OVER (PARTITION BY r.prev ORDER BY round((coalesce(tc.n, 0) + 100 * f.p) / (r.row_n + 100), 12) DESC, f.token) AS rank
         FROM tr r CROSS JOIN freq f LEFT JOIN tc ON tc.prev = r.prev AND tc.next = f.token) t
       JOIN centers a ON a.field = 0 AND a.bin = t.next // 64 JOIN centers b ON b.field = 1 AND b.bin = (t.next // 8) % 8 JOIN centers d ON d.field = 2 AND d.bin = t.next % 8
       WHERE rank <= 3""",
)
def likeliest_next(p: Prepared):
    return markov.top_next(counts(p), frequency(p), 100.0, p.binner, 3)


LINE_SQL = """SELECT *, lag(token) OVER (PARTITION BY session ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS prev FROM (
  SELECT l_returnflag || l_linestatus || strftime(l_shipdate, '%Y-%m') AS session, l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CAST(floor((l_quantity - 1) / 10) AS BIGINT) AS token FROM lineitem)"""


@question("prev:i next:i n:i", f"SELECT prev, token AS next, count(*) AS n FROM ({LINE_SQL}) WHERE prev IS NOT NULL GROUP BY 1, 2", raw=True)
def lineitem_transitions(spark, sf_dir):
    """The transition counter over order lines: sessions of one flag, status and ship month."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat("l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM")).alias("session"), *order,
        F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("token"),
    )
    placed = positions(lines, ["session"], order, "e").select("session", "e", "token")
    paired = framed(placed, ["session"], "e", lambda w: {"prev": F.lag("token").over(w)}, before=1)
    return markov.transition_counts(paired, 1)
