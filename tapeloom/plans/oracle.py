"""The same questions in plain SQL, by other plans: window functions over whole sessions and no chunks."""

from __future__ import annotations

# Every common table expression the bodies may use; unused ones cost nothing.
TAPE = """
tape AS (
  SELECT event_id AS seq, event_type AS root, CASE WHEN user_id % 29 = 0 THEN 'A' ELSE '' END AS suffix, ts,
         value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size,
         CASE WHEN user_id % 17 = 0 THEN '01' WHEN user_id % 3 = 0 THEN '0' ELSE '00' END AS corr,
         CASE WHEN user_id % 11 = 0 THEN 'T' WHEN user_id % 7 = 0 THEN '@F' WHEN user_id % 2 = 0 THEN '@' ELSE '' END AS cond
  FROM events),
placed AS (
  SELECT *, root || CASE WHEN suffix <> '' THEN '.' || suffix ELSE '' END AS symbol, epoch_us(ts) * 1000 AS ts_ns,
         strftime(ts, '%Y-%m-%d') AS date, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS clock
  FROM tape),
with_split AS (
  SELECT *, CASE WHEN symbol IN ('click', 'view', 'purchase') AND date BETWEEN '2024-01-01' AND '2024-01-18' THEN 'train'
                 WHEN symbol IN ('click', 'view', 'purchase') AND date BETWEEN '2024-01-19' AND '2024-01-24' THEN 'val'
                 WHEN symbol IN ('click', 'view', 'purchase') AND date BETWEEN '2024-01-25' AND '2024-01-30' THEN 'test'
                 WHEN symbol = 'error' AND date BETWEEN '2024-01-25' AND '2024-01-30' THEN 'heldout' END AS split
  FROM placed),
marked AS (
  SELECT *, CASE WHEN ts IS NULL THEN 'invalid_timestamp'
                 WHEN NOT (price > 0 AND size > 0) THEN 'invalid_price_or_size'
                 WHEN corr NOT IN ('0', '00') THEN 'excluded_correction'
                 WHEN cond NOT IN ('', '@', '@F') THEN 'excluded_condition'
                 WHEN clock >= 82800 THEN 'outside_session'
                 WHEN split IS NULL THEN 'outside_fixed_split' END AS first_fail
  FROM with_split),
kept AS (SELECT * FROM marked WHERE first_fail IS NULL),
trades AS (
  SELECT symbol, date, split, ts_ns, seq, price, size, row_number() OVER w - 1 AS r,
         count(*) OVER (PARTITION BY symbol, date) AS trades,
         ts_ns - lag(ts_ns) OVER w AS gap, lag(price) OVER w AS before
  FROM kept WINDOW w AS (PARTITION BY symbol, date ORDER BY ts_ns, seq)),
all_ev AS (
  SELECT symbol, date, split, r - 1 AS e, trades - 1 AS events, ts_ns, ln(1 + gap / 1e9) AS f0,
         10000 * ln(price / before) AS f1, ln(1 + size) AS f2
  FROM trades WHERE r > 0),
ev AS (SELECT * FROM all_ev WHERE events > 12),
shares AS (SELECT [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875] AS s),
edges AS (
  SELECT quantile_cont(f0, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q0,
         quantile_cont(f1, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q1,
         quantile_cont(f2, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q2,
         min(f0) AS lo0, max(f0) AS hi0, min(f1) AS lo1, max(f1) AS hi1, min(f2) AS lo2, max(f2) AS hi2
  FROM ev WHERE split = 'train'),
binned AS (
  SELECT ev.*, ((f0 >= q0[1])::INT + (f0 >= q0[2])::INT + (f0 >= q0[3])::INT + (f0 >= q0[4])::INT + (f0 >= q0[5])::INT + (f0 >= q0[6])::INT + (f0 >= q0[7])::INT) AS c0, ((f1 >= q1[1])::INT + (f1 >= q1[2])::INT + (f1 >= q1[3])::INT + (f1 >= q1[4])::INT + (f1 >= q1[5])::INT + (f1 >= q1[6])::INT + (f1 >= q1[7])::INT) AS c1,
         ((f2 >= q2[1])::INT + (f2 >= q2[2])::INT + (f2 >= q2[3])::INT + (f2 >= q2[4])::INT + (f2 >= q2[5])::INT + (f2 >= q2[6])::INT + (f2 >= q2[7])::INT) AS c2
  FROM ev, edges),
tokened AS (SELECT *, (c0 * 8 + c1) * 8 + c2 AS token FROM binned),
coded AS (SELECT *, lag(token) OVER (PARTITION BY symbol, date ORDER BY e) AS prev FROM tokened),
long_bins AS (
  SELECT symbol, date, split, e, 0 AS field, c0 AS bin, f0 AS v FROM coded
  UNION ALL SELECT symbol, date, split, e, 1, c1, f1 FROM coded
  UNION ALL SELECT symbol, date, split, e, 2, c2, f2 FROM coded),
bin_grid AS (SELECT f.i AS field, b.i AS bin FROM range(3) f(i), range(8) b(i)),
centers AS (
  SELECT g.field, g.bin, coalesce(median(l.v), 0) AS center, count(l.v) AS n
  FROM bin_grid g LEFT JOIN (SELECT * FROM long_bins WHERE split = 'train') l ON g.field = l.field AND g.bin = l.bin
  GROUP BY 1, 2),
sess AS (
  SELECT symbol, date, split, events, row_number() OVER (ORDER BY symbol, date) - 1 AS sid,
         row_number() OVER (PARTITION BY split ORDER BY symbol, date) - 1 AS k
  FROM (SELECT symbol, date, any_value(split) AS split, max(events) AS events FROM ev GROUP BY 1, 2)),
wc AS (
  SELECT *, coalesce(sum(windows) OVER (PARTITION BY split ORDER BY symbol, date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM (SELECT *, greatest(0, events - 12) AS windows FROM sess)),
totals AS (SELECT split, CAST(sum(windows) AS BIGINT) AS n FROM wc GROUP BY 1),
idx AS (
  SELECT split, CASE WHEN m = 1 THEN 0 WHEN k = m - 1 THEN n - 1 ELSE CAST(floor(k * ((n - 1)::DOUBLE / (m - 1))) AS BIGINT) END AS window_index
  FROM (SELECT split, n, least(n, 500) AS m FROM totals), LATERAL (SELECT unnest(range(m)) AS k)),
located AS (
  SELECT i.split, i.window_index, wc.symbol, wc.date, wc.sid, CAST(i.window_index - wc.first AS BIGINT) AS start
  FROM idx i JOIN wc ON i.split = wc.split AND i.window_index >= wc.first AND i.window_index < wc.first + wc.windows),
pairs AS (
  SELECT l.split, l.window_index, l.symbol, l.date, c.e, c.prev, c.token AS next, c.c0, c.c1, c.c2
  FROM located l JOIN coded c ON l.symbol = c.symbol AND l.date = c.date AND c.e = l.start + 12),
freq AS (
  SELECT t.i AS token, count(c.token) AS n, (count(c.token) + 1.0) / (sum(count(c.token)) OVER () + 512) AS p
  FROM range(512) t(i) LEFT JOIN (SELECT token FROM coded WHERE split = 'train' AND e >= 12) c ON c.token = t.i GROUP BY 1),
tc AS (SELECT prev, token AS next, count(*) AS n FROM coded WHERE split = 'train' AND e >= 12 GROUP BY 1, 2),
tr AS (SELECT prev, CAST(sum(n) AS BIGINT) AS row_n FROM tc GROUP BY 1),
scored AS (
  SELECT p.*, coalesce(tc.n, 0) AS n, coalesce(tr.row_n, 0) AS row_n, f.p AS prior_p
  FROM pairs p LEFT JOIN tc ON p.prev = tc.prev AND p.next = tc.next LEFT JOIN tr ON p.prev = tr.prev JOIN freq f ON f.token = p.next),
strengths AS (SELECT unnest([1.0, 10.0, 100.0, 1000.0])::DOUBLE AS strength),
strength_nll AS (
  SELECT strength, avg(-ln((n + strength * prior_p) / (row_n + strength))) AS nll FROM scored, strengths WHERE split = 'val' GROUP BY 1),
chosen AS (SELECT strength FROM strength_nll ORDER BY nll, strength LIMIT 1),
nlls AS (
  SELECT 'frequency' AS variant, split, window_index, symbol, date, e, -ln(prior_p) AS nll FROM scored
  UNION ALL
  SELECT 'markov', split, window_index, symbol, date, e, -ln((n + strength * prior_p) / (row_n + strength)) FROM scored, chosen),
stream AS (
  SELECT t.split, seed, step, slot, ('0x' || substr(md5(seed || '|' || step || '|' || slot), 1, 8))::BIGINT % t.n AS window_index
  FROM totals t, (SELECT unnest([42, 43, 44]) AS seed), (SELECT unnest(range(1, 41)) AS step), (SELECT unnest(range(16)) AS slot)
  WHERE t.split = 'train'),
stream_at AS (
  SELECT s.seed, s.step, s.slot, s.window_index, wc.symbol, wc.date, CAST(s.window_index - wc.first AS BIGINT) AS start
  FROM stream s JOIN wc ON s.split = wc.split AND s.window_index >= wc.first AND s.window_index < wc.first + wc.windows),
stream_targets AS (
  SELECT 'last' AS supervision, seed, step, symbol, date, start + 12 AS e FROM stream_at
  UNION ALL
  SELECT 'dense', seed, step, symbol, date, start + d FROM stream_at, (SELECT unnest(range(1, 13)) AS d)),
sampled AS (
  SELECT s.supervision, s.seed, c.prev, c.token AS next, count(*) AS n
  FROM stream_targets s JOIN coded c ON s.symbol = c.symbol AND s.date = c.date AND s.e = c.e GROUP BY 1, 2, 3, 4),
matched AS (
  SELECT g.seed, g.token, coalesce(m.n, 0) AS n, (coalesce(m.n, 0) + 1.0) / (sum(coalesce(m.n, 0)) OVER (PARTITION BY g.seed) + 512) AS p
  FROM (SELECT seed, token FROM (SELECT unnest([42, 43, 44]) AS seed), (SELECT unnest(range(512)) AS token)) g
  LEFT JOIN (SELECT seed, next AS token, sum(n) AS n FROM sampled WHERE supervision = 'last' GROUP BY 1, 2) m ON g.seed = m.seed AND g.token = m.token),
ahead AS (
  SELECT *, sum(f1) OVER h AS future, sum(exp(f0) - 1) OVER h AS seconds
  FROM coded WINDOW h AS (PARTITION BY symbol, date ORDER BY e ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
labelled AS (
  SELECT *, CASE WHEN future < -8000 THEN 0 WHEN future > 8000 THEN 2 ELSE 1 END AS label FROM ahead WHERE e + 4 < events),
history AS (
  SELECT *, sum(f1) OVER w5 AS s5, stddev_pop(f1) OVER w5 AS d5, avg(abs(f1)) OVER w5 AS a5, avg(f0) OVER w5 AS i5, avg(f2) OVER w5 AS z5, stddev_pop(f2) OVER w5 AS v5,
         sum(f1) OVER w12 AS s12, stddev_pop(f1) OVER w12 AS d12, avg(abs(f1)) OVER w12 AS a12, avg(f0) OVER w12 AS i12, avg(f2) OVER w12 AS z12, stddev_pop(f2) OVER w12 AS v12,
         string_agg(token, ',' ORDER BY e) OVER w12 AS tokens
  FROM coded
  WINDOW w5 AS (PARTITION BY symbol, date ORDER BY e ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
         w12 AS (PARTITION BY symbol, date ORDER BY e ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
ex AS (
  SELECT symbol, date, split, e AS anchor, e - 11 AS input_start, e + 4 AS label_end, label, future, seconds, token,
         row_number() OVER (PARTITION BY split ORDER BY symbol, date, e) - 1 AS example_index
  FROM labelled WHERE e >= 11 AND (e - 11) % 16 = 0),
subset AS (
  SELECT seed, symbol, date, anchor, label, rank FROM (
    SELECT seed, symbol, date, anchor, label,
           row_number() OVER (PARTITION BY seed ORDER BY ('0x' || substr(md5(concat_ws('|', seed, symbol, date, anchor)), 1, 8))::BIGINT, symbol, date, anchor) AS rank
    FROM ex, (SELECT unnest([42, 43, 44]) AS seed) WHERE split = 'train') WHERE rank <= 80),
priors AS (
  SELECT seed, 'prior_' || budget AS method, (count(*) FILTER (label = 0) + 1.0) / (count(*) + 3) AS p0,
         (count(*) FILTER (label = 1) + 1.0) / (count(*) + 3) AS p1, (count(*) FILTER (label = 2) + 1.0) / (count(*) + 3) AS p2
  FROM subset, (SELECT unnest([20, 80]) AS budget) WHERE rank <= budget GROUP BY seed, budget
  UNION ALL
  SELECT seed, 'prior_all', (count(*) FILTER (label = 0) + 1.0) / (count(*) + 3), (count(*) FILTER (label = 1) + 1.0) / (count(*) + 3),
         (count(*) FILTER (label = 2) + 1.0) / (count(*) + 3)
  FROM ex, (SELECT unnest([42, 43, 44]) AS seed) WHERE split = 'train' GROUP BY seed
  UNION ALL SELECT unnest([42, 43, 44]), 'uniform', 1.0 / 3, 1.0 / 3, 1.0 / 3),
pred AS (
  SELECT e.split, e.symbol, e.date, e.anchor, e.label, p.seed, p.method, p.p0, p.p1, p.p2,
         CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS predicted,
         -ln(greatest(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-12)) AS nll,
         power(p0 - (label = 0)::INT, 2) + power(p1 - (label = 1)::INT, 2) + power(p2 - (label = 2)::INT, 2) AS brier
  FROM ex e, priors p WHERE e.split <> 'train'),
metric AS (
  SELECT split, method, seed, count(*) AS examples, avg(nll) AS nll, avg(brier) AS brier, avg((predicted = label)::INT) AS accuracy FROM pred GROUP BY 1, 2, 3),
sd AS (SELECT date, symbol, seed, method, avg(nll) AS nll FROM pred GROUP BY 1, 2, 3, 4),
cohorts AS (
  SELECT * FROM (VALUES ('seen', 'click'), ('seen', 'view'), ('seen', 'purchase'), ('all', 'click'), ('all', 'view'), ('all', 'purchase'),
                        ('all', 'error'), ('error', 'error')) t(cohort, symbol)),
daily_method AS (
  SELECT cohort, date, method, avg(nll) AS nll FROM (SELECT cohort, date, symbol, method, avg(nll) AS nll FROM sd JOIN cohorts USING (symbol) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
daily_wide AS (
  SELECT cohort, date, max(nll) FILTER (method = 'prior_20') AS a, max(nll) FILTER (method = 'prior_80') AS b,
         max(nll) FILTER (method = 'prior_all') AS c, max(nll) FILTER (method = 'uniform') AS d FROM daily_method GROUP BY 1, 2),
daily AS (
  SELECT cohort, date, 'policy' AS comparison, b - a AS delta FROM daily_wide
  UNION ALL SELECT cohort, date, 'interaction', (b - a) - (c - d) FROM daily_wide
  UNION ALL SELECT cohort, date, 'incremental', b - d FROM daily_wide)
"""


def clock(name: str = "", prices: str = "SELECT symbol, date, split, r, ts_ns, price, size FROM trades WHERE trades - 1 > 12") -> str:
    """CTEs of the clock tasks under a name suffix, over the trades that ``prices`` selects."""
    n = name
    return f"""
ct{n} AS (
  SELECT *, ts_ns - epoch_us(CAST(date AS TIMESTAMP)) * 1000 AS x FROM ({prices})),
run{n} AS (
  SELECT *, count(*) OVER w AS cum_n, sum(size) OVER w AS cum_size, sum(price * size) OVER w AS cum_value, ln(price) AS lp,
         sum(price * size) OVER t AS trail_value, sum(size) OVER t AS trail_size, lag(x, 11) OVER (PARTITION BY symbol, date ORDER BY r) AS context_x,
         CAST(ceil(x / 72e9) AS BIGINT) AS g
  FROM ct{n} WINDOW w AS (PARTITION BY symbol, date ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              t AS (PARTITION BY symbol, date ORDER BY r ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
cell{n} AS (SELECT * FROM run{n} QUALIFY row_number() OVER (PARTITION BY symbol, date, g ORDER BY r DESC) = 1),
cellrv{n} AS (
  SELECT *, sum(coalesce(sq, 0)) OVER (PARTITION BY symbol, date ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rv
  FROM (SELECT *, power(lp - lag(lp) OVER (PARTITION BY symbol, date ORDER BY g), 2) AS sq FROM cell{n})),
anchor{n} AS (SELECT symbol, date, split, unnest(range(300, 1116, 40)) AS anchor FROM sess),
probe{n} AS (SELECT symbol, date, split, anchor, unnest([-300, -30, -20, -5, 0, 10, 25, 30, 35]) AS o FROM anchor{n}),
probed{n} AS (
  SELECT p.symbol, p.date, p.split, p.anchor, p.o, c.cum_n, c.cum_size, c.cum_value, c.rv, c.lp, c.price, c.r, c.x, c.trail_value, c.trail_size, c.context_x
  FROM (SELECT *, anchor + o AS g FROM probe{n}) p ASOF LEFT JOIN cellrv{n} c ON p.symbol = c.symbol AND p.date = c.date AND p.g >= c.g),
wide{n} AS (
  SELECT symbol, date, split, anchor,
    coalesce(max(cum_n) FILTER (o = -300), 0) AS n_m300, coalesce(max(cum_n) FILTER (o = -30), 0) AS n_m30, coalesce(max(cum_n) FILTER (o = -5), 0) AS n_m5,
    coalesce(max(cum_n) FILTER (o = 0), 0) AS n0, coalesce(max(cum_n) FILTER (o = 10), 0) AS n10, coalesce(max(cum_n) FILTER (o = 25), 0) AS n25,
    coalesce(max(cum_n) FILTER (o = 35), 0) AS n35,
    coalesce(max(cum_size) FILTER (o = -300), 0) AS s_m300, coalesce(max(cum_size) FILTER (o = 0), 0) AS s0,
    coalesce(max(cum_size) FILTER (o = 25), 0) AS s25, coalesce(max(cum_size) FILTER (o = 35), 0) AS s35,
    coalesce(max(cum_value) FILTER (o = 25), 0) AS v25, coalesce(max(cum_value) FILTER (o = 35), 0) AS v35,
    coalesce(max(rv) FILTER (o = -300), 0) AS rv_m300, coalesce(max(rv) FILTER (o = -30), 0) AS rv_m30, coalesce(max(rv) FILTER (o = 0), 0) AS rv0,
    coalesce(max(rv) FILTER (o = 30), 0) AS rv30,
    max(lp) FILTER (o = -300) AS lp_m300, max(lp) FILTER (o = -30) AS lp_m30, max(lp) FILTER (o = -5) AS lp_m5, max(lp) FILTER (o = 0) AS lp0,
    max(price) FILTER (o = 0) AS price0, max(r) FILTER (o = 0) AS r0, max(r) FILTER (o = -20) AS r_m20, max(x) FILTER (o = 0) AS x0,
    max(trail_value) FILTER (o = 0) AS tv0, max(trail_size) FILTER (o = 0) AS ts0, max(context_x) FILTER (o = 0) AS cx0
  FROM probed{n} GROUP BY 1, 2, 3, 4),
amark{n} AS (
  SELECT *, CASE WHEN NOT coalesce(r0 >= 12, false) THEN 'short_event_context'
                 WHEN NOT (n_m300 > 0 AND n0 > n_m300) THEN 'incomplete_history'
                 WHEN NOT coalesce(anchor - x0 / 72e9 <= 60, false) THEN 'stale_last_trade'
                 WHEN NOT (rv0 - rv_m300 > 0) THEN 'zero_past_volatility'
                 WHEN NOT (n35 > n25) THEN 'empty_future_vwap' END AS first_fail FROM wide{n}),
cex{n} AS (
  SELECT split, symbol, date, anchor, r0 AS last_raw_trade_index, r0 - 1 AS last_code_index, x0 / 72e9 AS last_trade, anchor + 35 AS future_end,
    n0 - n_m300 AS past_trade_count, n10 - n0 AS future_activity_count, n35 - n25 AS future_vwap_count, (x0 - cx0) / 72e9 AS context_span, r_m20 AS older_trade_index,
    ln(1 + (n0 - n_m300) / 300.0) AS log_rate_history,
    ln(((n0 - n_m5) / 5.0 + 1 / 300.0) / ((n0 - n_m300) / 300.0 + 1 / 300.0)) AS log_rate_ratio_short,
    ln(((n0 - n_m30) / 30.0 + 1 / 300.0) / ((n0 - n_m300) / 300.0 + 1 / 300.0)) AS log_rate_ratio_long,
    ln(sqrt((rv0 - rv_m300) / 300)) AS log_vol_history, sqrt(greatest(0, rv0 - rv_m30) / (0.1 * (rv0 - rv_m300))) AS vol_ratio_long,
    (lp0 - lp_m5) / sqrt((rv0 - rv_m300) * 5 / 300) AS return_z_short, (lp0 - lp_m30) / sqrt((rv0 - rv_m300) * 30 / 300) AS return_z_long,
    (lp0 - lp_m300) / sqrt(rv0 - rv_m300) AS return_z_history, ln(1 + (s0 - s_m300) / (n0 - n_m300)) AS log_mean_size_history,
    ln(price0 / (tv0 / ts0)) / sqrt(0.1 * (rv0 - rv_m300)) AS last_price_vs_vwap_z, anchor - x0 / 72e9 AS trade_age,
    sin(2 * pi() * anchor / 1150) AS clock_sin, cos(2 * pi() * anchor / 1150) AS clock_cos,
    (n10 - n0) * 30.0 / (n0 - n_m300) AS T1_target, sqrt(greatest(0, rv30 - rv0) / (0.1 * (rv0 - rv_m300))) AS T2_target,
    ln(((v35 - v25) / (s35 - s25)) / (tv0 / ts0)) / sqrt(0.1 * (rv0 - rv_m300)) AS T3_target
  FROM amark{n} WHERE first_fail IS NULL),
thr{n} AS (
  SELECT quantile_cont(T1_target, [1 / 3.0::DOUBLE, 2 / 3.0::DOUBLE]) AS q1, quantile_cont(T2_target, [1 / 3.0::DOUBLE, 2 / 3.0::DOUBLE]) AS q2,
         quantile_cont(T3_target, [1 / 3.0::DOUBLE, 2 / 3.0::DOUBLE]) AS q3 FROM cex{n} WHERE split = 'train'),
clab{n} AS (
  SELECT cex{n}.*, ((T1_target >= q1[1])::INT + (T1_target >= q1[2])::INT) AS T1_label, ((T2_target >= q2[1])::INT + (T2_target >= q2[2])::INT) AS T2_label,
         ((T3_target >= q3[1])::INT + (T3_target >= q3[2])::INT) AS T3_label FROM cex{n}, thr{n}),
clong{n} AS (
  SELECT split, symbol, date, anchor, 'T1' AS task, T1_label AS label FROM clab{n}
  UNION ALL SELECT split, symbol, date, anchor, 'T2', T2_label FROM clab{n}
  UNION ALL SELECT split, symbol, date, anchor, 'T3', T3_label FROM clab{n})
"""


def ask(body: str, *more: str) -> str:
    return "WITH " + ",".join(part.strip() for part in (TAPE, *more)) + "\n" + body.strip()


def ask_clock(body: str, *more: str) -> str:
    return ask(body, clock(), *more)
