"""SQL of the queries, for another engine over the same tables; written from the definitions, not from the plans."""

from __future__ import annotations

from collections.abc import Sequence

from gridpulse.plans import queries

CUTOFF = 28404000.0

EV = """ev AS (
  SELECT user_id, event_id, ts, date_trunc('hour', ts) AS ts_h, value, event_type,
         CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS error,
         CASE WHEN value >= 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS high, epoch_us(ts) / 60000000.0 AS t
  FROM events)"""
STEP = """st AS (
  SELECT *, t - lag(t) OVER w AS raw_dt, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000.0 AS dt, lag(value) OVER w AS pv,
         lag(ts) OVER w AS pts, lag(event_id) OVER w AS pid, lag(high) OVER w AS ph,
         (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 60000000.0 AS dt_after
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
SAMPLES = """sa AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS idx, t AS ts_min, value FROM ev)"""
CROSSINGS = """cr AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY idx) AS event_id, idx AS crossing_index, ts_min AS crossing_ts,
         (SELECT min(b.idx) FROM sa b WHERE b.user_id = a.user_id AND b.idx > a.idx AND b.value < 100) AS recovery_index,
         (SELECT min(b.ts_min) FROM sa b WHERE b.user_id = a.user_id AND b.idx > a.idx AND b.value < 100) AS recovery_ts
  FROM (SELECT *, lag(value) OVER w AS pv, lag(ts_min) OVER w AS pt FROM sa WINDOW w AS (PARTITION BY user_id ORDER BY idx)) a
  WHERE ts_min > pt AND pv < 100 AND value >= 100)"""
ZONES = """zo AS (
  SELECT *, greatest(crossing_ts - 60.0, coalesce(lag(recovery_ts) OVER (PARTITION BY user_id ORDER BY event_id), -1e18)) AS zone_start FROM cr)"""
INDEXED = """zi AS (
  SELECT s.*, z.event_id, z.crossing_ts FROM sa s LEFT JOIN zo z
    ON s.user_id = z.user_id AND s.ts_min > z.zone_start AND (z.recovery_ts IS NULL OR s.ts_min <= z.recovery_ts))"""
STATE = """se AS (
  SELECT *, max(CASE WHEN value IS NOT NULL THEN ts_min END) OVER b AS prev_t FROM zi
  WINDOW b AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), sv AS (
  SELECT *, last_value(CASE WHEN value IS NOT NULL AND (prev_t IS NULL OR ts_min > prev_t) THEN value END IGNORE NULLS) OVER b AS prev_v FROM se
  WINDOW b AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
NORMAL = """nz AS (
  SELECT * FROM (
    SELECT z.user_id, coalesce(lag(coalesce(recovery_ts, t1)) OVER (PARTITION BY z.user_id ORDER BY event_id), t0) AS span_start, zone_start AS span_end
    FROM zo z JOIN (SELECT user_id, min(ts_min) AS t0, max(ts_min) AS t1 FROM sa GROUP BY 1) p USING (user_id)
    UNION ALL
    SELECT p.user_id, coalesce(e, t0), t1
    FROM (SELECT user_id, min(ts_min) AS t0, max(ts_min) AS t1 FROM sa GROUP BY 1) p
    LEFT JOIN (SELECT z.user_id, max(coalesce(recovery_ts, m)) AS e FROM zo z JOIN (SELECT user_id, max(ts_min) AS m FROM sa GROUP BY 1) USING (user_id) GROUP BY 1) USING (user_id)
  ) WHERE span_end > span_start)"""
BASE = (EV, SAMPLES, CROSSINGS, ZONES)

SQL: dict[str, str] = {}


def _add(name: str, parts: Sequence[str], select: str) -> None:
    SQL[name] = f"WITH {', '.join(parts)}\n{select}" if parts else select


def _q(expr: str, p: float, places: int = 6) -> str:
    return f"round(quantile_cont({expr}, {p}), {places})"


_add("inventory", [EV], """
SELECT count(*) AS n_rows, count(DISTINCT ts_h) AS n_unique_timestamps, count(*) - count(DISTINCT ts_h) AS n_duplicate_timestamp_rows,
  count(*) - count(DISTINCT (ts_h, value, error, high)) AS n_exact_duplicate_rows, strftime(min(ts_h), '%Y-%m-%d %H:%M:%S') AS timestamp_min,
  strftime(max(ts_h), '%Y-%m-%d %H:%M:%S') AS timestamp_max, count(*) FILTER (value IS NULL) + count(*) FILTER (error IS NULL) AS missing_values_total FROM ev""")
_add("coercion_failures", [EV], """
SELECT * FROM (SELECT 'value' AS "column", count(*) FILTER (NOT value >= 1) AS n_missing FROM ev
  UNION ALL SELECT 'high', count(*) FILTER (high = 0) FROM ev) WHERE n_missing > 0""")


def groups(table: str, keys: str, ts: str, order: str, sensors: Sequence[str], flags: Sequence[str]) -> str:
    """Repeated groups; sensors hold no missing values here."""
    differs = {c: f"(max({c}) <> min({c}))" for c in sensors}
    named = " || ".join(f"CASE WHEN {d} THEN '{c},' ELSE '' END" for c, d in differs.items())
    texts = " || ".join(f"CASE WHEN {d} THEN '{c}=' || min({c}) || '..' || max({c}) || ';' ELSE '' END" for c, d in differs.items())
    spread = ", ".join(f"max({c}) - min({c})" for c in sensors)
    n = " + ".join(f"{d}::INT" for d in differs.values())
    by = f"{keys}, {ts}" if keys else ts
    return f"""gr AS (
  SELECT {keys + ',' if keys else ''} strftime({ts}, '%Y-%m-%d %H:%M:%S') AS timestamp, strftime({ts}, '%Y-%m') AS month, count(*) AS n_records,
    array_to_string(list_sort(list({order})), ',') AS raw_lines, max({order}) - min({order}) AS raw_line_span,
    max({order}) - min({order}) = count(*) - 1 AS raw_lines_adjacent, ({n}) = 0 AS identical_group, CAST({n} AS BIGINT) AS n_conflicting_columns,
    rtrim({named}, ',') AS conflicting_columns, rtrim({texts}, ';') AS conflicting_value_spreads, greatest({spread}) AS max_conflict_magnitude, {' OR '.join(differs[f] for f in flags) if flags else 'false'} AS flags_conflict
  FROM {table} GROUP BY {by} HAVING count(*) > 1)"""


GROUPS = groups("ev", "user_id", "ts_h", "event_id", ("value", "error", "high"), ("error", "high"))
_add("repeated_groups", [EV, GROUPS], "SELECT * REPLACE (round(max_conflict_magnitude, 6) AS max_conflict_magnitude) FROM gr")
_add("conflict_summary", [EV, GROUPS], f"""
SELECT count(*) AS repeated_groups, count(*) FILTER (identical_group) AS identical_groups, count(*) FILTER (NOT identical_group) AS conflicting_groups,
  count(*) FILTER (flags_conflict) AS groups_with_flag_conflicts, {_q('max_conflict_magnitude', 0.5)} AS median_max_conflict_magnitude,
  round(max(max_conflict_magnitude), 6) AS max_conflict_magnitude, bool_and(raw_lines_adjacent) AS all_groups_raw_line_adjacent FROM gr""")
_add("duplicate_summary", [EV, groups("ev", "event_type", "ts_h", "event_id", ("value", "high"), ())], """
SELECT event_type, count(*) AS duplicate_timestamp_groups, count(*) FILTER (identical_group) AS identical_groups, count(*) FILTER (NOT identical_group) AS conflicting_groups,
  max(n_records) AS max_records_per_timestamp, rtrim(CASE WHEN bool_or(contains(conflicting_columns, 'high')) THEN 'high,' ELSE '' END ||
  CASE WHEN bool_or(contains(conflicting_columns, 'value')) THEN 'value,' ELSE '' END, ',') AS conflicting_columns_seen FROM gr GROUP BY event_type""")
_add("value_distribution", [f"lo AS ({' UNION ALL '.join(f'''SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS v FROM lineitem''' for c in ('l_quantity', 'l_discount', 'l_tax', 'l_linenumber'))})",
  'co AS (SELECT "column", v, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, v) AS r FROM lo GROUP BY 1, 2)'], f"""
SELECT * FROM (SELECT "column", count(DISTINCT v) AS n_unique, min(v) AS "min", {_q('v', 0.25)} AS p25, {_q('v', 0.5)} AS median, round(avg(v), 6) AS mean, {_q('v', 0.75)} AS p75, max(v) AS "max",
  CASE WHEN bool_and(v IN (0, 1)) AND count(DISTINCT v) = 2 THEN 'binary' WHEN count(DISTINCT v) <= 30 THEN 'categorical' ELSE 'continuous' END AS behaviour FROM lo GROUP BY 1)
JOIN (SELECT "column", string_agg(printf('%.4f:%d', v, n), ';' ORDER BY r) AS top_values FROM co WHERE r <= 5 GROUP BY 1) USING ("column")""")
_add("multiplicity", [EV], """
SELECT n AS records_per_timestamp, count(*) AS n_timestamps, CAST(round_even(count(*) / sum(count(*)) OVER () * 100, 3) AS DOUBLE) AS share_of_timestamps_pct
FROM (SELECT count(*) AS n FROM ev GROUP BY user_id, ts_h) GROUP BY n""")
_add("flag_consistency", [EV], """
SELECT count(*) FILTER ((value >= 100) = (error = 1)) AS rule_ok, count(*) FILTER ((value >= 100) <> (error = 1)) AS violations, count(*) AS n_records FROM ev""")
_add("high_in_repeated", [EV], """
SELECT count(*) AS n_high_records, count(*) FILTER (n > 1) AS n_high_records_in_repeated_groups, 100.0::DOUBLE AS threshold
FROM (SELECT value, count(*) OVER (PARTITION BY user_id, ts_h) AS n FROM ev) WHERE value >= 100""")
_add("band_unimodality", ["v AS (SELECT value AS v FROM events WHERE value > 50)",
  "b AS (SELECT CAST(round_even(v, -1) AS DOUBLE) AS band, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM v GROUP BY 1)",
  "k AS (SELECT band, band - lag(band) OVER (ORDER BY band) AS gap FROM b WHERE share > 0.005)"], f"""
SELECT (SELECT count(*) FROM v) AS n_values, (SELECT {_q('v', 0.01)} FROM v) AS p01, (SELECT {_q('v', 0.5)} FROM v) AS median, (SELECT {_q('v', 0.99)} FROM v) AS p99,
  (SELECT band FROM b ORDER BY n DESC, band LIMIT 1) AS dominant_decade_band, (SELECT count(*) FROM k) AS n_populated_decade_bands,
  (SELECT count(*) FROM k WHERE gap IS NULL OR gap > 10) AS n_contiguous_band_clusters, 'value' AS "column" """)
_add("neighbour_fit", [EV, """g AS (SELECT user_id, ts_h, count(*) AS n, arg_min(value, event_id) AS a, arg_max(value, event_id) AS z, count(DISTINCT value) AS u FROM ev GROUP BY 1, 2)""",
  """f AS (SELECT *, last_value(CASE WHEN n = 1 THEN a END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts_h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
   first_value(CASE WHEN n = 1 THEN a END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts_h ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM g)"""], """
SELECT count(*) AS n_conflicting_groups_with_neighbors, CAST(round_even(avg(abs(a - p) + abs(a - q)), 2) AS DOUBLE) AS mean_fit_error_first_branch,
  CAST(round_even(avg(abs(z - p) + abs(z - q)), 2) AS DOUBLE) AS mean_fit_error_last_branch, avg(abs(a - p) + abs(a - q)) < avg(abs(z - p) + abs(z - q)) AS first_fits_better
FROM f WHERE n > 1 AND u > 1 AND p IS NOT NULL AND q IS NOT NULL""")
PIVOT = "pi AS (SELECT ts_h, " + ", ".join(f"round(avg(value) FILTER (event_type = '{k}'), 6) AS {k}" for k in ("click", "view", "signup", "purchase", "error")) + ", round(sum(value) / 100, 6) AS kva FROM events_h GROUP BY ts_h)"
_add("power_approximation_errors", ["events_h AS (SELECT date_trunc('hour', ts) AS ts_h, event_type, value FROM events)", PIVOT, """er AS (
  SELECT abs((click * purchase + view * error + signup * view) / 1000 - kva) / kva * 100 AS a,
    abs(sqrt(3.0::DOUBLE) * list_avg([click, view, signup]) * list_avg([purchase, error, view]) / 1000 - kva) / kva * 100 AS b FROM pi WHERE click > 0 AND kva > 0)"""], f"""
SELECT count(*) AS n_compared, {_q('a', 0.5, 4)} AS per_phase_sum_median_abs_err_pct, {_q('a', 0.95, 4)} AS per_phase_sum_p95_abs_err_pct,
  {_q('b', 0.5, 4)} AS sqrt3_median_abs_err_pct, {_q('b', 0.95, 4)} AS sqrt3_p95_abs_err_pct FROM er""")
_add("correlation", [], """SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr_all,
  round(corr(CASE WHEN l_discount < 0.05 THEN l_quantity END, CASE WHEN l_discount < 0.05 THEN l_extendedprice END), 6) AS corr_normal FROM lineitem""")
_add("monthly_repeated_groups", [], """SELECT month, count(*) AS repeated_groups FROM (
  SELECT strftime(o_orderdate, '%Y-%m') AS month FROM orders GROUP BY o_orderdate HAVING count(*) > 1) GROUP BY month ORDER BY month""")
_add("row_confusion", [EV, "c AS (SELECT count(*) FILTER (high = 1 AND error = 1) AS row_tp, count(*) FILTER (high = 1 AND error = 0) AS row_fp, count(*) FILTER (high = 0 AND error = 1) AS row_fn FROM ev)"], """
SELECT *, round(row_tp / nullif(row_tp + row_fp, 0), 6) AS row_precision, round(row_tp / nullif(row_tp + row_fn, 0), 6) AS row_recall,
  round(2 * row_tp / nullif(2 * row_tp + row_fp + row_fn, 0), 6) AS row_f1 FROM c""")
_add("headline_scalars", [EV], """SELECT max(value) FILTER (error = 1) AS max_error_value, min(value) FILTER (error = 1) AS min_error_value,
  count(*) FILTER (error = 1 AND value >= 100) AS n_high_errors, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM ev""")
_add("quantiles", [], "SELECT l_returnflag, " + ", ".join(f"{_q('l_extendedprice', p)} AS q{i}" for i, p in enumerate((0.01, 0.5, 0.99, 0.999))) + " FROM lineitem GROUP BY 1")
POS = "CASE WHEN dt > 0 THEN dt END"
_add("interval_summary", [EV, STEP], f"""
SELECT count(*) AS n_intervals, count(*) FILTER (dt <= 0) AS n_nonpositive_intervals, count(*) FILTER (dt = 0) AS n_zero_intervals, round(min({POS}), 6) AS min_minutes,
  {_q(POS, 0.5)} AS median_minutes, {_q(POS, 0.95)} AS p95_minutes, {_q(POS, 0.99)} AS p99_minutes, round(max({POS}), 6) AS max_minutes, round(avg({POS}), 6) AS mean_minutes,
  count(*) FILTER (dt > 30) AS n_intervals_gt_30min, count(*) FILTER (dt > 60) AS n_intervals_gt_60min, count(*) FILTER (dt > 1440) AS n_intervals_gt_1440min FROM st WHERE dt IS NOT NULL""")
VIEWS = {
    "P1_preserve": "SELECT * FROM ev",
    "P2_first": "SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, ts_h ORDER BY event_id) = 1",
    "P3_last": "SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, ts_h ORDER BY event_id DESC) = 1",
    "P4_identical": "SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, ts_h, value, error, high ORDER BY event_id) = 1",
}
POLICY = "po AS (" + " UNION ALL ".join(f"SELECT '{p}' AS policy, * FROM ({q})" for p, q in VIEWS.items()) + ")"
# the identical view takes every sensor of the table, the type of event included
IDENTICAL = VIEWS["P4_identical"].replace("error, high", "error, high, event_type")
_add("onset_counts", [EV, "vi AS (" + " UNION ALL ".join(f"SELECT '{p}' AS policy, * FROM ({q})" for p, q in {**VIEWS, "P4_identical": IDENTICAL}.items() if p != "P1_preserve") + ")",
  "la AS (SELECT policy, high AS f, lag(high) OVER (PARTITION BY policy, user_id ORDER BY ts_h, event_id) AS p FROM vi)"], """
SELECT 'high' AS flag, policy AS duplicate_policy, count(*) FILTER (f = 1) AS n_active_rows, count(*) FILTER (p = 0 AND f = 1) AS onsets_0_to_1,
  count(*) FILTER (p = 1 AND f = 0) AS offsets_1_to_0 FROM la GROUP BY policy""")
_add("flag_transitions", [EV, STEP], """
SELECT user_id, 'high' AS flag, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CAST(ph::INT AS VARCHAR) || '->' || CAST(high::INT AS VARCHAR) AS transition,
  round(dt, 6) AS interval_before_minutes, round(dt_after, 6) AS interval_after_minutes FROM st WHERE ph <> high""")
RATE = "ra AS (SELECT *, CASE WHEN dt > 0 THEN (value - pv) / dt END AS rate, high = 1 OR coalesce(ph, 0) = 1 AS exc FROM st WHERE dt IS NOT NULL)"
NORM = "CASE WHEN NOT exc THEN abs(rate) END"
_add("rate_summary", [EV, STEP, RATE], f"""
SELECT 'value' AS value_column, count(rate) AS n_rates_computed, count(*) - count(rate) AS n_intervals_excluded_nonpositive_or_missing, round(min(rate), 6) AS rate_min_per_min,
  {_q('rate', 0.5)} AS rate_median_per_min, {_q('abs(rate)', 0.95)} AS rate_p95_abs_per_min, {_q('abs(rate)', 0.99)} AS rate_p99_abs_per_min, round(max(rate), 6) AS rate_max_per_min,
  round(min(abs(rate)), 6) AS rate_min_abs_per_min, count({NORM}) AS normal_mode_n_rates, {_q(NORM, 0.99)} AS normal_mode_p99_abs_per_min, round(max({NORM}), 6) AS normal_mode_max_abs_per_min,
  count(rate) FILTER (exc) AS excursion_mode_n_rates, round(max(abs(rate)) FILTER (exc), 6) AS excursion_mode_max_abs_per_min FROM ra""")
_add("top_rate_transitions", [EV, STEP, RATE], """
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, strftime(pts, '%Y-%m-%d %H:%M:%S') AS prev_timestamp, round(dt, 6) AS dt_minutes, pv AS prev_value, value,
  round(rate, 6) AS rate_per_min, event_id AS raw_line, pid AS prev_raw_line FROM ra WHERE abs(rate) > 1 ORDER BY abs(rate) DESC, ts, event_id LIMIT 30""")
_add("autocorrelation", [EV], " UNION ALL ".join(f"""SELECT 'value' AS "column", CAST({k} AS BIGINT) AS lag_samples, CAST({k * 15} AS BIGINT) AS approx_time_if_15min_cadence_minutes, round(corr(v, l), 6) AS autocorrelation, count(l) AS n_pairs
FROM (SELECT value AS v, lag(value, {k}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM ev)""" for k in (1, 2, 4, 8)))
_add("value_gaps", ["g AS (SELECT v, lead(v) OVER (ORDER BY v) AS n FROM (SELECT DISTINCT value AS v FROM events))"], """
SELECT v AS lower_observed_value, n AS upper_observed_value, round(n - v, 6) AS gap_size, CAST(0 AS BIGINT) AS n_values_in_between_observed FROM g WHERE n - v > 1""")
_add("threshold_separability", [EV, "lo AS (SELECT 'error' AS flag, value AS v, error AS f FROM ev UNION ALL SELECT 'high', value, high FROM ev)",
  """c AS (SELECT flag, v, count(*) FILTER (f = 1) AS n1, count(*) FILTER (f = 0) AS n0 FROM lo GROUP BY 1, 2)""",
  """s AS (SELECT *, sum(n1) OVER w AS c1, sum(n0) OVER w AS c0, sum(n1) OVER (PARTITION BY flag) AS t1, sum(n0) OVER (PARTITION BY flag) AS t0 FROM c WINDOW w AS (PARTITION BY flag ORDER BY v))""",
  """tr AS (SELECT flag, v, '>=' AS d, 1 AS up, (t1 - c1 + n1 + c0 - n0) / (t1 + t0) AS acc FROM s UNION ALL SELECT flag, v, '<=', 0, (c1 + t0 - c0) / (t1 + t0) FROM s)""",
  "be AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY flag ORDER BY acc DESC, v, up DESC) = 1)"], """
SELECT 'value' AS value_column, flag, n_flag_1, lo1, hi1, n_flag_0, lo0, hi0, lo1 <= hi0 AND lo0 <= hi1 AS classes_overlap, v AS best_threshold, d AS best_threshold_direction, round(acc, 6) AS threshold_rule_accuracy
FROM (SELECT flag, count(*) FILTER (f = 1) AS n_flag_1, min(v) FILTER (f = 1) AS lo1, max(v) FILTER (f = 1) AS hi1, count(*) FILTER (f = 0) AS n_flag_0, min(v) FILTER (f = 0) AS lo0, max(v) FILTER (f = 0) AS hi0 FROM lo GROUP BY 1)
JOIN be USING (flag)""")
_add("band_transitions", [EV, STEP], """
SELECT user_id, event_id, CASE WHEN value >= 100 THEN 'rise' ELSE 'fall' END AS direction, round(dt, 6) AS dt_minutes, pv AS prev_value, value FROM st
WHERE dt > 0 AND ((pv < 100 AND value >= 100) OR (pv >= 100 AND value < 100))""")
_add("policy_metrics", [EV, POLICY, """r AS (SELECT *, (epoch_us(ts_h) - epoch_us(lag(ts_h) OVER w)) / 60000000.0 AS d, lag(value) OVER w AS pv FROM po WINDOW w AS (PARTITION BY policy, user_id ORDER BY ts_h, event_id))"""], """
SELECT policy, count(*) AS n_records, round(max(CASE WHEN d > 0 THEN (value - pv) / d END), 6) AS max_positive_rate_per_min, round(min(CASE WHEN d > 0 THEN (value - pv) / d END), 6) AS max_negative_rate_per_min,
  count(*) FILTER (d > 0 AND pv < 100 AND value >= 100) AS high_rising_transitions, count(*) FILTER (d <= 0) AS n_intervals_excluded_nonpositive,
  count(DISTINCT (user_id, ts_h)) AS n_unique_timestamps, round(avg(((value >= 236) = (error = 1))::INT), 6) AS rule_accuracy FROM r GROUP BY policy""")
_add("policy_rows", [EV, POLICY], "SELECT policy, user_id, event_id, value FROM po")
_add("policy_mean", [EV], "SELECT user_id, ts_h, round(avg(value), 6) AS value, round(avg(high), 6) AS high, min(event_id) AS event_id FROM ev GROUP BY 1, 2")
_add("occurrence_report", [EV], """SELECT count(*) AS n_timestamps, CAST(round_even(avg((n > 1)::INT), 4) AS DOUBLE) AS share_of_timestamps_with_repeats, max(n) AS max_records_per_timestamp,
  avg((n > 1)::INT) > 0.9 AS verdict_supports_stable_occurrence_streams FROM (SELECT count(*) AS n FROM ev GROUP BY user_id, ts_h)""")
PAIRS = "pa AS (SELECT abs((value - pv) / dt) AS rate, abs(value - pv) AS jump FROM st WHERE dt > 0 AND dt <= {} AND pv IS NOT NULL)"
_add("valid_pairs", [EV, STEP, PAIRS.format(600)], f"SELECT count(*) AS n, round(max(rate), 6) AS max_rate, round(max(jump), 6) AS max_jump, {_q('jump', 0.99)} AS q99_jump FROM pa")


def runs(gap: float, flag: str = "high", name: str = "pe") -> str:
    return f"""{name}_m AS (SELECT *, ({flag} = 1 AND (coalesce(lag({flag}) OVER w, 0) <> 1 OR dt > {gap}))::INT AS fresh FROM st WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), {name}_r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM {name}_m
), {name} AS (SELECT user_id, '{flag}' AS flag, min(ts) AS "start", max(ts) AS "end", count(*) AS n_samples, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 AS duration_minutes,
  coalesce(max(CASE WHEN fresh = 0 THEN dt END), 0.0) AS max_intra_event_gap_minutes, {gap}::DOUBLE AS continuity_gap_definition_minutes FROM {name}_r WHERE {flag} = 1 GROUP BY user_id, island)"""


def merged(tol: float, source: str = "pe", name: str = "me") -> str:
    return f"""{name}_m AS (SELECT *, coalesce(({tol} <= 0 OR (epoch_us("start") - epoch_us(lag("end") OVER w)) / 60000000.0 > {tol})::INT, 1) AS f2 FROM {source} WINDOW w AS (PARTITION BY user_id, flag ORDER BY "start")
), {name}_g AS (SELECT *, sum(f2) OVER (PARTITION BY user_id, flag ORDER BY "start") AS g FROM {name}_m
), {name} AS (SELECT user_id, flag, min("start") AS "start", max("end") AS "end", sum(n_samples)::BIGINT AS n_samples, count(*) AS n_primitive_events,
  (epoch_us(max("end")) - epoch_us(min("start"))) / 60000000.0 AS duration_minutes FROM {name}_g GROUP BY user_id, flag, g)"""


_add("primitive_events", [EV, STEP, runs(1440)], "SELECT * REPLACE (round(duration_minutes, 6) AS duration_minutes, round(max_intra_event_gap_minutes, 6) AS max_intra_event_gap_minutes) FROM pe")
_add("merged_events", [EV, STEP, runs(1440), merged(2880)], "SELECT * REPLACE (round(duration_minutes, 6) AS duration_minutes) FROM me")
_grid = [(f, g, t) for f in ("high", "error") for g in (60, 720, 1440) for t in (0, 720, 2880)]
_add("event_sensitivity", [EV, STEP, *[runs(g, f, f"pe{f}{g}") for f in ("high", "error") for g in (60, 720, 1440)], *[merged(t, f"pe{f}{g}", f"me{f}{g}x{t}") for f, g, t in _grid]],
  " UNION ALL ".join(f"""SELECT '{f}' AS flag, {g}::DOUBLE AS continuity_gap_minutes, {t}::DOUBLE AS merge_tolerance_minutes, sum(n_primitive_events)::BIGINT AS n_primitive_events, count(*) AS n_events_after_merge,
  sum(n_samples)::BIGINT AS total_active_samples, {_q('duration_minutes', 0.5)} AS median_event_duration_minutes, round(max(duration_minutes), 6) AS max_event_duration_minutes FROM me{f}{g}x{t}""" for f, g, t in _grid))
_add("electrical_context", [EV], """
SELECT o.user_id, o.event_id AS onset_id, count(e.ts) AS n_rows_in_window, round(min(abs(epoch_us(e.ts) - epoch_us(o.ts)) / 60000000.0), 6) AS nearest_delta_minutes, min(e.value) AS v_min, max(e.value) AS v_max, round(avg(e.value), 6) AS v_avg
FROM ev o LEFT JOIN ev e ON e.user_id = o.user_id AND abs(epoch_us(e.ts) - epoch_us(o.ts)) <= 43200000000 WHERE o.value >= 236 GROUP BY 1, 2""")
_add("local_maximum", [EV, STEP], """
SELECT o.user_id, o.event_id, count(e.ts) AS n_rows_in_window, max(e.value) AS local_max FROM st o LEFT JOIN ev e
  ON e.user_id = o.user_id AND abs(epoch_us(e.ts) - epoch_us(o.ts)) <= 1800000000 WHERE o.dt > 0 AND o.pv < 100 AND o.value >= 100 GROUP BY 1, 2""")
_add("cross_alignment", ["u AS (SELECT DISTINCT event_type AS s, ts AS t FROM events)", "p AS (SELECT a.s AS file_a, b.s AS file_b FROM (SELECT DISTINCT s FROM u) a JOIN (SELECT DISTINCT s FROM u) b ON a.s < b.s)",
  "x AS (SELECT p.*, u.t FROM p JOIN u ON u.s = p.file_a)",
  """n AS (SELECT x.*, before.t AS tb, after.t AS ta FROM x ASOF LEFT JOIN u before ON before.s = x.file_b AND before.t <= x.t ASOF LEFT JOIN u after ON after.s = x.file_b AND after.t >= x.t)""",
  "d AS (SELECT *, least(floor(abs(epoch_us(t) - epoch_us(tb)) / 1000000.0), floor(abs(epoch_us(t) - epoch_us(ta)) / 1000000.0)) / 60.0 AS delta FROM n)"], f"""
SELECT file_a, file_b, count(*) AS n_timestamps_a, (SELECT count(*) FROM u WHERE u.s = file_b) AS n_timestamps_b, count(*) FILTER (delta = 0) AS exact_matches, count(*) FILTER (delta <= 15) AS matches_within_15min,
  round(min(delta), 6) AS nearest_delta_min_minutes, {_q('delta', 0.5)} AS nearest_delta_median_minutes, {_q('delta', 0.95)} AS nearest_delta_p95_minutes, round(max(delta), 6) AS nearest_delta_max_minutes FROM d GROUP BY file_a, file_b""")
_add("shared_by_all", [EV], """SELECT (SELECT count(DISTINCT event_type) FROM ev) AS n_sources, count(*) AS n_shared_timestamps
FROM (SELECT ts_h FROM ev GROUP BY ts_h HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM ev))""")
_add("shared_repeats", [EV, "r AS (SELECT event_type AS s, ts_h AS t FROM ev GROUP BY 1, 2 HAVING count(*) > 1)", "k AS (SELECT s, count(*) AS n FROM r GROUP BY 1)"], """
SELECT a.s AS file_a, b.s AS file_b, a.n AS repeated_groups_a, b.n AS repeated_groups_b, (SELECT count(*) FROM r x JOIN r y ON x.t = y.t WHERE x.s = a.s AND y.s = b.s) AS shared_repeated_timestamps
FROM k a JOIN k b ON a.s < b.s""")
_add("set_intersection", [EV], "SELECT count(*) AS n_shared FROM (SELECT ts_h FROM ev WHERE event_type = 'error' INTERSECT SELECT ts_h FROM ev WHERE event_type = 'click')")
_add("rising_crossings", BASE[:3], "SELECT * REPLACE (round(crossing_ts, 6) AS crossing_ts, round(recovery_ts, 6) AS recovery_ts) FROM cr")
_add("event_zones", BASE, "SELECT user_id, event_id, round(zone_start, 6) AS zone_start, round(recovery_ts, 6) AS recovery_ts FROM zo")
_add("normal_zones", [*BASE, NORMAL], "SELECT user_id, round(span_start, 6) AS span_start, round(span_end, 6) AS span_end FROM nz")
_add("zone_index", [*BASE, INDEXED], "SELECT user_id, idx, event_id FROM zi")


def decision(kind: str, x: dict, behaviour: str, gap: float, v: str = "value", t: str = "ts_min") -> dict[str, str]:
    """Each part of the decision, by order of the contract."""
    dt = f"({t} - prev_t)"
    up = f"coalesce({v} > {x['upper']}, false)" if "upper" in x else "false"
    lo = f"coalesce({v} < {x['lower']}, false)" if "lower" in x else "false"
    case = lambda missing, first, late, gapped, steady: f"CASE WHEN {v} IS NULL THEN {missing} WHEN prev_t IS NULL THEN {first} WHEN {dt} <= 0 THEN {late} WHEN {dt} > {gap} AND '{behaviour}' = 'reset' THEN {gapped} ELSE {steady} END"
    ranged = f"CASE WHEN {up} THEN 'upper' WHEN {lo} THEN 'lower' ELSE '' END"
    fast = f"abs({v} - prev_v) / {dt} > {x.get('rate', 'NULL')}"
    steady = {
        "range": ranged, "rate": f"CASE WHEN {fast} THEN 'rate' ELSE '' END", "jump": f"CASE WHEN abs({v} - prev_v) > {x.get('jump', 'NULL')} THEN 'jump' ELSE '' END",
        "combined": f"CASE WHEN {fast} AND {ranged} <> '' THEN 'rate+' || {ranged} WHEN {fast} THEN 'rate' ELSE {ranged} END",
    }[kind]
    none = "CAST(NULL AS DOUBLE)"
    return {
        "reason": case("''", ranged, ranged, ranged, steady),
        "rate": case(none, none, none, none, f"abs({v} - prev_v) / {dt}" if kind in ("rate", "combined") else none),
        "jump": case(none, none, none, none, f"abs({v} - prev_v)" if kind == "jump" else none),
        "data_anomaly": case("true", "false", "true", "false", "false"), "state_updated": case("false", "true", "false", "true", "true"),
        "note": case("'missing'", "'first'", "'nonpositive_dt'", "'gap_reset'", "''"),
    }


ARRIVAL = """ar AS (SELECT user_id, event_id, epoch_us(ts_h) / 60000000.0 AS th, CASE WHEN event_id % 17 <> 0 THEN value END AS v FROM ev
), a1 AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN th END) OVER b AS prev_t FROM ar WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), a2 AS (SELECT *, last_value(CASE WHEN v IS NOT NULL AND (prev_t IS NULL OR th > prev_t) THEN v END IGNORE NULLS) OVER b AS prev_v FROM a1
  WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
for _kind, _x in (("rate", {"rate": 0.2}), ("range", {"upper": 100.0, "lower": 1.0}), ("combined", {"rate": 0.2, "upper": 100.0}), ("jump", {"jump": 60.0})):
    for _b in ("reset", "continue"):
        _d = decision(_kind, _x, _b, 1440.0, "v", "th")
        _add(f"rule_{_kind}_{_b}", [EV, ARRIVAL], f"""SELECT user_id, event_id, ({_d['reason']}) <> '' AS flagged, {_d['reason']} AS reason, round({_d['rate']}, 6) AS rate, round({_d['jump']}, 6) AS jump,
  {_d['data_anomaly']} AS data_anomaly, {_d['state_updated']} AS state_updated, {_d['note']} AS note FROM a2""")


def flagged(kind: str, x: dict, behaviour: str = "reset", gap: float = 60.0) -> str:
    d = decision(kind, x, behaviour, gap)
    return f"fl AS (SELECT user_id, idx, ts_min, value, event_id, crossing_ts, ({d['reason']}) <> '' AS flagged, {d['data_anomaly']} AS data_anomaly FROM sv)"


def full(kind: str, x: dict, behaviour: str = "reset", gap: float = 60.0) -> list[str]:
    return [*BASE, INDEXED, STATE, flagged(kind, x, behaviour, gap)]


PER = """pv AS (
  SELECT z.user_id, z.event_id, z.crossing_index, z.crossing_ts, min(f.ts_min) FILTER (f.flagged AND f.ts_min <= z.crossing_ts) IS NOT NULL AS detected, min(f.ts_min) FILTER (f.flagged) IS NOT NULL AS detected_in_zone,
    min(f.ts_min) FILTER (f.flagged) AS first_flag_ts, z.crossing_ts - min(f.ts_min) FILTER (f.flagged) AS lead_min,
    coalesce(min(f.ts_min) FILTER (f.flagged AND f.ts_min <= z.crossing_ts) < z.crossing_ts, false) AS first_flag_pre_crossing
  FROM {zones} z LEFT JOIN {rows} f ON f.user_id = z.user_id AND f.event_id = z.event_id GROUP BY 1, 2, 3, 4)"""
ROUND_PER = "SELECT * REPLACE (round(crossing_ts, 6) AS crossing_ts, round(first_flag_ts, 6) AS first_flag_ts, round(lead_min, 6) AS lead_min) FROM pv"
_add("per_event_metrics", [*full("jump", {"jump": 60.0}), PER.format(zones="zo", rows="fl")], ROUND_PER)
EPISODES = """ef AS (SELECT *, (flagged AND NOT coalesce(lag(flagged) OVER w, false))::INT AS fresh FROM fl WINDOW w AS (PARTITION BY user_id ORDER BY idx)
), er AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM ef), ep AS (SELECT user_id, run, min(ts_min) AS "start" FROM er WHERE flagged AND event_id IS NULL GROUP BY 1, 2)"""
TOTALS = """SELECT {name} (SELECT count(*) FROM fl WHERE flagged) AS total_flagged_rows, (SELECT count(*) FROM fl WHERE data_anomaly) AS data_anomaly_rows, count(*) AS events_total,
  count(*) FILTER (detected) AS events_detected, count(*) FILTER (detected_in_zone) AS events_detected_in_zone, CAST(round_even(avg(lead_min) FILTER (detected), 3) AS DOUBLE) AS mean_lead_time_min,
  CAST(round_even(quantile_cont(lead_min, 0.5) FILTER (detected), 3) AS DOUBLE) AS median_lead_time_min, (SELECT count(*) FROM ep) AS false_alarm_episodes,
  round((SELECT sum(span_end - span_start) / 1440.0 FROM nz), 3) AS normal_days, round((SELECT count(*) FROM ep) / (SELECT sum(span_end - span_start) / 1440.0 FROM nz), 3) AS false_alarm_rate_per_day FROM pv"""
_add("evaluate_flags", [*full("combined", {"rate": 0.2, "upper": 80.0}), PER.format(zones="zo", rows="fl"), EPISODES, NORMAL], TOTALS.format(name=""))
_add("baseline_threshold", [], "SELECT count(*) FILTER (value >= 90) AS n_flagged, count(*) AS n FROM events")
_add("baseline_percentile", [], "SELECT count(*) FILTER (value > (SELECT quantile_cont(value, 0.99) FROM events)) AS n_flagged FROM events")


def sweep_sql() -> str:
    """One configuration at a time, from the same state."""
    configs = []
    for b in ("reset", "continue"):
        configs += [("rate", b, {"rate": r}) for r in (0.02, 0.1, 0.5, 2.0)] + [("jump", b, {"jump": j}) for j in (40.0, 80.0, 160.0)]
        configs += [("combined", b, {"rate": r, "upper": u}) for r in (0.02, 0.1, 0.5, 2.0) for u in (80.0, 120.0, 200.0)]
    configs += [("range", "reset", {"upper": u}) for u in (80.0, 120.0, 200.0)]
    rows = []
    for k, b, x in configs:
        d = decision(k, x, b, 1440.0)
        name = f"{k}/{b}/{x.get('rate')}/{x.get('upper')}/{x.get('jump')}"
        rows.append(f"SELECT '{name}' AS config_id, user_id, idx, ts_min, event_id, crossing_ts, ({d['reason']}) <> '' AS flagged, {d['data_anomaly']} AS data_anomaly FROM sv")
    fl = "fl AS (" + " UNION ALL ".join(rows) + ")"
    parts = [*BASE, INDEXED, STATE, fl, NORMAL, "co AS (SELECT DISTINCT config_id FROM fl)", """pv AS (
  SELECT c.config_id, z.user_id, z.event_id, min(f.ts_min) FILTER (f.flagged AND f.ts_min <= z.crossing_ts) IS NOT NULL AS detected, min(f.ts_min) FILTER (f.flagged) IS NOT NULL AS in_zone,
    z.crossing_ts - min(f.ts_min) FILTER (f.flagged) AS lead_min FROM zo z CROSS JOIN co c LEFT JOIN fl f ON f.config_id = c.config_id AND f.user_id = z.user_id AND f.event_id = z.event_id
  GROUP BY c.config_id, z.user_id, z.event_id, z.crossing_ts)""", """ef AS (SELECT *, (flagged AND NOT coalesce(lag(flagged) OVER w, false))::INT AS fresh FROM fl WINDOW w AS (PARTITION BY config_id, user_id ORDER BY idx)
), er AS (SELECT *, sum(fresh) OVER (PARTITION BY config_id, user_id ORDER BY idx) AS run FROM ef), ep AS (SELECT config_id, count(*) AS n FROM (SELECT DISTINCT config_id, user_id, run FROM er WHERE flagged AND event_id IS NULL) GROUP BY 1)"""]  # fmt: skip
    return f"WITH {', '.join(parts)}" + """
SELECT config_id, total_flagged_rows, data_anomaly_rows, events_total, events_detected, events_detected_in_zone, mean_lead_time_min, median_lead_time_min, coalesce(ep.n, 0) AS false_alarm_episodes,
  round(d, 3) AS normal_days, round(coalesce(ep.n, 0) / d, 3) AS false_alarm_rate_per_day
FROM (SELECT config_id, count(*) FILTER (flagged) AS total_flagged_rows, count(*) FILTER (data_anomaly) AS data_anomaly_rows FROM fl GROUP BY 1)
JOIN (SELECT config_id, count(*) AS events_total, count(*) FILTER (detected) AS events_detected, count(*) FILTER (in_zone) AS events_detected_in_zone,
  CAST(round_even(avg(lead_min) FILTER (detected), 3) AS DOUBLE) AS mean_lead_time_min, CAST(round_even(quantile_cont(lead_min, 0.5) FILTER (detected), 3) AS DOUBLE) AS median_lead_time_min FROM pv GROUP BY 1) USING (config_id)
LEFT JOIN ep USING (config_id) CROSS JOIN (SELECT sum(span_end - span_start) / 1440.0 AS d FROM nz)"""


SQL["filter_sweep"] = sweep_sql()
_add("pareto_frontier", ["o AS (SELECT o_custkey, count(*) AS detected, CAST(floor(sum(o_totalprice) / 1000) AS BIGINT) AS alarms FROM orders GROUP BY 1)"], """
SELECT * FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.detected >= a.detected AND b.alarms <= a.alarms AND (b.detected > a.detected OR b.alarms < a.alarms))""")
_add("roc_series", [], "SELECT count(*) FILTER (value > 100) AS detected, count(*) AS alarms FROM events WHERE event_type = 'error' GROUP BY user_id")
_add("lead_histogram", [*full("jump", {"jump": 60.0}), PER.format(zones="zo", rows="fl")], """
SELECT CAST(CASE WHEN lead_min < -60 THEN 0 WHEN lead_min >= 60 THEN 21 ELSE floor((lead_min + 60) / 6.0) + 1 END AS BIGINT) AS bin, count(*) AS n FROM pv WHERE detected GROUP BY 1""")
_add("first_alert_classes", [*full("jump", {"jump": 60.0}), PER.format(zones="zo", rows="fl")], """
SELECT CASE WHEN first_flag_ts IS NULL THEN 'none' WHEN first_flag_ts < crossing_ts THEN 'before' WHEN first_flag_ts = crossing_ts THEN 'at' ELSE 'after' END AS first_alert_class, count(*) AS n_events FROM pv GROUP BY 1""")
CAL_EV = EV.replace("FROM events", f"FROM events WHERE epoch_us(ts) / 60000000.0 < {CUTOFF}")
_cal = [("F1_rate", "primary", "SELECT quantile_cont(rate, 0.999) FROM pa"), ("F1_rate", "sensitivity:q:0.99", "SELECT quantile_cont(rate, 0.99) FROM pa"), ("F1_rate", "sensitivity:q:0.9999", "SELECT quantile_cont(rate, 0.9999) FROM pa"), ("F1_rate", "sensitivity:max", "SELECT max(rate) FROM pa"),
  ("F2_upper", "primary", "SELECT max(value) FROM ev"), ("F2_upper", "sensitivity:q:0.99", "SELECT quantile_cont(value, 0.99) FROM ev"), ("F2_upper", "sensitivity:q:0.999", "SELECT quantile_cont(value, 0.999) FROM ev"),
  ("F4_jump", "primary", "SELECT quantile_cont(jump, 0.999) FROM pa"), ("F4_jump", "sensitivity:q:0.99", "SELECT quantile_cont(jump, 0.99) FROM pa"), ("F4_jump", "sensitivity:q:0.9999", "SELECT quantile_cont(jump, 0.9999) FROM pa"), ("F4_jump", "sensitivity:max", "SELECT max(jump) FROM pa")]
_add("calibration", [CAL_EV, STEP, PAIRS.format(60)], " UNION ALL ".join(f"SELECT '{r}' AS rule, '{v}' AS variant, CAST(round_even(({q}), 4) AS DOUBLE) AS threshold, (SELECT count(*) FROM ev) AS n_records, (SELECT count(*) FROM pa) AS n_valid_pairs" for r, v, q in _cal))
_add("chronological_split", [EV], f"SELECT count(*) FILTER (t < {CUTOFF}) AS n_calibration, count(*) FILTER (t >= {CUTOFF}) AS n_test FROM ev")
_add("frozen_replay", [*full("range", {"upper": 120.0}), f"lz AS (SELECT * FROM zo WHERE crossing_ts >= {CUTOFF})", f"lf AS (SELECT * FROM fl WHERE ts_min >= {CUTOFF})", PER.format(zones="lz", rows="lf")], ROUND_PER)


def sustained(source: str, keys: str, on: str, ks: Sequence[int]) -> list[str]:
    return [f"su_a AS (SELECT *, ({on}) AS o, sum((NOT ({on}))::INT) OVER (PARTITION BY {keys} ORDER BY idx) AS grp FROM {source})",
            f"su_b AS (SELECT *, row_number() OVER (PARTITION BY {keys}, grp ORDER BY idx) AS n FROM su_a WHERE o)",
            f"su AS (SELECT {keys}, " + ", ".join(f"round(min(CASE WHEN n >= {k} THEN ts_min END), 6) AS sustained_k{k}_ts_min" for k in ks) + f" FROM su_b GROUP BY {keys})"]


_add("sustained_alerts", [*BASE[:2], *sustained("sa", "user_id", "value > 60 AND value >= 1", (1, 2, 3))], "SELECT * FROM su")
_add("persistence_in_zone", [*full("range", {"upper": 60.0}), "iz AS (SELECT * FROM fl WHERE event_id IS NOT NULL)", *sustained("iz", "user_id, event_id", "flagged AND value IS NOT NULL", (1, 2))], "SELECT * FROM su")
_add("pre_window_stats", full("range", {"upper": 60.0}), """
SELECT z.user_id, z.event_id, min(f.ts_min) FILTER (f.flagged) IS NOT NULL AS window_hit, round(min(f.ts_min) FILTER (f.flagged), 6) AS first_alert_ts, round(avg(f.flagged::INT), 6) AS duty_cycle, count(f.idx) AS n_valid_samples
FROM zo z LEFT JOIN fl f ON f.user_id = z.user_id AND f.event_id = z.event_id AND f.ts_min <= z.crossing_ts GROUP BY 1, 2""")
_add("episodes_by_day", [*full("jump", {"jump": 60.0}), EPISODES], """
SELECT day, coalesce(n, 0) AS n_episodes FROM (SELECT DISTINCT CAST(floor(ts_min / 1440) AS BIGINT) AS day FROM fl WHERE event_id IS NULL)
LEFT JOIN (SELECT CAST(floor("start" / 1440) AS BIGINT) AS day, count(*) AS n FROM ep GROUP BY 1) USING (day)""")
_add("replay_episodes_by_day", full("jump", {"jump": 60.0}), """
SELECT day, coalesce(n, 0) AS n_episodes FROM (SELECT DISTINCT CAST(floor(ts_min / 1440) AS BIGINT) AS day FROM fl WHERE event_id IS NULL)
LEFT JOIN (
  SELECT CAST(floor(ts_min / 1440) AS BIGINT) AS day, count(*) AS n
  FROM (SELECT ts_min, alarm, lag(alarm) OVER (PARTITION BY user_id ORDER BY idx) AS before
    FROM (SELECT *, coalesce(flagged, false) AND event_id IS NULL AS alarm FROM fl))
  WHERE alarm AND NOT coalesce(before, false) GROUP BY 1) USING (day)""")
WINDOWS = """sp AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM ev GROUP BY 1
), ws AS (SELECT user_id, t0, t0 + k * 1440.0 AS window_start FROM sp, range(0, 60) r(k) WHERE t0 + k * 1440.0 + 2880.0 <= t1
), wr AS (SELECT w.user_id, w.window_start, e.t, e.value FROM ws w JOIN ev e ON e.user_id = w.user_id AND e.t >= w.window_start AND e.t < w.window_start + 2880.0
), wg AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, window_start ORDER BY t) AS gap FROM wr
), hf AS (SELECT user_id, window_start, arg_max(value, t) AS last, max(value) AS maximum, avg(value) AS mean,
  CASE WHEN max(t) > min(t) THEN (arg_max(value, t) - arg_min(value, t)) / (max(t) - min(t)) ELSE 0.0 END AS slope_per_min, stddev_pop(value) AS variability, coalesce(max(gap), 0.0) AS max_gap_min,
  greatest(0.0, 1 - count(*) / ((max(t) - min(t)) / 15.0 + 1)) AS missing_frac FROM wg GROUP BY 1, 2)"""
_add("horizon_features", [EV, WINDOWS], "SELECT user_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("window_start", "last", "maximum", "mean", "slope_per_min", "variability", "max_gap_min", "missing_frac")) + " FROM hf")
_add("horizon_thresholds", [EV, WINDOWS], "SELECT " + ", ".join(f"{_q(c, 0.99, 4)} AS {c}" for c in ("last", "maximum", "mean", "variability")) + " FROM hf")
_FEATURES = ("last", "maximum", "mean", "slope_per_min", "variability", "max_gap_min", "missing_frac")
_long = lambda frm: " UNION ALL ".join(f"SELECT h, '{c}' AS feature, {c} AS x FROM {frm}" for c in _FEATURES)
#: Windows of rows (user_id, h, w, ts_min, value), each with its features.
_features = lambda rows, name: f"""{name}g AS (SELECT *, ts_min - lag(ts_min) OVER (PARTITION BY user_id, h, w ORDER BY ts_min) AS gap FROM {rows}
), {name} AS (SELECT user_id, h, w, arg_max(value, ts_min) AS last, max(value) AS maximum, avg(value) AS mean,
  CASE WHEN max(ts_min) > min(ts_min) THEN (arg_max(value, ts_min) - arg_min(value, ts_min)) / (max(ts_min) - min(ts_min)) ELSE 0.0 END AS slope_per_min,
  stddev_pop(value) AS variability, coalesce(max(gap), 0.0) AS max_gap_min, greatest(0.0, 1 - count(*) / ((max(ts_min) - min(ts_min)) / 15.0 + 1)) AS missing_frac FROM {name}g GROUP BY 1, 2, 3
), {name}x AS ({_long(name)})"""  # noqa: E731
_sliding = lambda frm, name: f"""{name} AS (
  SELECT s.user_id, h, p.t0 + k * 60.0 AS w, ts_min, value
  FROM (SELECT user_id, min(ts_min) AS t0, max(ts_min) AS t1 FROM {frm} GROUP BY 1) p, hs, range(0, 3000) r(k), {frm} s
  WHERE s.user_id = p.user_id AND p.t0 + k * 60.0 + h <= p.t1 AND ts_min >= p.t0 + k * 60.0 AND ts_min < p.t0 + k * 60.0 + h)"""  # noqa: E731
_add("horizon_study", [EV, SAMPLES, CROSSINGS, f"""zo AS (
  SELECT *, greatest(crossing_ts - 60.0, coalesce(lag(recovery_ts) OVER (PARTITION BY user_id ORDER BY event_id), -1e18)) AS zone_start FROM cr WHERE crossing_ts >= {CUTOFF})""",
    "hs AS (SELECT unnest([60.0::DOUBLE, 360.0, 1440.0]) AS h)", f"ca AS (SELECT * FROM sa WHERE ts_min < {CUTOFF})",
    f"""no AS (SELECT * FROM sa s WHERE ts_min >= {CUTOFF} AND NOT EXISTS (
  SELECT 1 FROM zo z WHERE z.user_id = s.user_id AND s.ts_min > z.zone_start AND (z.recovery_ts IS NULL OR s.ts_min <= z.recovery_ts)))""",
    _sliding("ca", "cw"), _features("cw", "cf"), _sliding("no", "nw"), _features("nw", "nf"),
    "ew AS (SELECT s.user_id, h, z.event_id AS w, s.ts_min, s.value FROM zo z, hs, sa s WHERE s.user_id = z.user_id AND s.ts_min >= z.crossing_ts - h AND s.ts_min < z.crossing_ts)",
    _features("ew", "ef"), "th AS (SELECT h, feature, quantile_cont(x, 0.99) AS q FROM cfx GROUP BY 1, 2)"], """
SELECT h AS horizon_min, feature, round(q, 4) AS calibration_q99_threshold,
  (SELECT count(*) FROM efx e WHERE e.h = th.h AND e.feature = th.feature AND x > q) AS event_windows_flagged, (SELECT count(*) FROM zo) AS n_events,
  (SELECT round(count(*) FILTER (x > q) / count(*), 4) FROM nfx n WHERE n.h = th.h AND n.feature = th.feature) AS normal_windows_flagged_frac,
  (SELECT count(*) FROM nfx n WHERE n.h = th.h AND n.feature = th.feature) AS n_normal_windows FROM th""")
BAND = "ba AS (SELECT user_id, event_id, pv AS t0, value AS t1, 20.0::DOUBLE AS ta, dt FROM st WHERE dt > 0 AND ((pv < 100 AND value >= 100) OR (pv >= 100 AND value < 100)))"
_values = lambda xs, n: "(VALUES " + ", ".join(f"({float(x)}::DOUBLE)" for x in xs) + f") {n}({n})"
_add("tau_sensitivity", [EV, STEP, BAND, f"g AS (SELECT *, ta + o AS u, dt * m AS d FROM ba, {_values((-10, -5, 0, 5, 10), 'o')}, {_values((0.5, 1, 2), 'm')})"], """
SELECT user_id, event_id, round(t0, 4) AS t0, round(t1, 4) AS t1, o AS ta_offset_units, u AS ta_used, round(d, 4) AS dt_used_minutes,
  round(CASE WHEN t0 <> u AND (t1 - u) / (t0 - u) > 0 AND (t1 - u) / (t0 - u) < 1 THEN -d / ln((t1 - u) / (t0 - u)) END, 4) AS tau_minutes,
  CASE WHEN t0 - u <= 0 THEN 'start not above ambient' WHEN t1 - u <= 0 THEN 'end at or below ambient' WHEN (t1 - u) / (t0 - u) >= 1 THEN 'not decaying (end excess >= start excess)' ELSE 'valid' END AS domain_status FROM g""")
_add("mass_sensitivity", [EV, STEP, BAND], f"""
SELECT user_id, event_id, round(dt, 6) AS dt_minutes, round(t1 - t0, 6) AS rise, p AS power_kw, c AS c_kj_per_kg_k, round(p * dt * 60, 6) AS energy_kj, round(p * dt * 60 / (c * (t1 - t0)), 6) AS critical_mass_kg
FROM ba, {_values((5, 20, 60, 120), 'p')}, {_values((1.67, 2.2), 'c')} WHERE t1 > t0""")
_add("power_curves", [EV, STEP, BAND], f"""
SELECT user_id, event_id, round(dt, 8) AS dt_minutes, round(t1 - t0, 8) AS rise, m AS mass_kg, round(m * 2.0 * (t1 - t0) / (dt * 60), 8) AS required_power_kw, round(40.0 * dt * 60 / (m * 2.0), 8) AS achievable_rise
FROM ba, {_values((10, 100, 1000), 'm')} WHERE t1 > t0""")
_add("cost_table", [], """SELECT approach, class, CAST(o AS BIGINT) AS total_ops_per_sample, CAST(s AS BIGINT) AS state_bytes_float32, CAST(x AS BIGINT) AS state_bytes_fixedpoint, CAST(m AS BIGINT) AS model_storage_bytes,
  CAST(a AS BIGINT) AS est_cycles_m0_fixedpoint, CAST(b AS BIGINT) AS est_cycles_m0_softfloat FROM (VALUES
  ('F1_rate', 'rule', 10, 12, 8, 8, 29, 271), ('F2_range', 'rule', 1, 4, 2, 2, 18, 37), ('F3_combined', 'rule', 11, 16, 10, 10, 30, 291), ('F4_jump', 'rule', 9, 12, 8, 8, 28, 221), ('B1_threshold', 'rule', 1, 2, 2, 2, 18, 37),
  ('MLP_28_16_8_1', 'model', 609, NULL, NULL, 2436, 3529, 61986), ('GBDT_100_trees', 'model', 600, NULL, NULL, 152400, 3000, NULL)) v(approach, class, o, s, x, m, a, b)""")
_add("timestamp_parsing", [], """SELECT event_id, CASE WHEN event_id % 6 IN (0, 4) THEN strftime(ts, '%Y-%m-%d %H:%M:00') WHEN event_id % 6 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
_add("label_numbers", [], "SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, '([0-9.]+)', 1), '') AS DOUBLE) AS brand_number, regexp_matches(p_type, '^(ECO|PRO|STA)') AS listed FROM part")
_add("decade_rounding", [], "SELECT CAST(round_even(p_size::DOUBLE, -1) AS DOUBLE) AS band, count(*) AS n FROM part GROUP BY 1")
_add("json_configs", [], """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"k":' || json_extract_string(props, '$.k') || ',"e":"' || event_type || '"}' AS config FROM events""")
_add("calendar_buckets", [EV], "SELECT strftime(ts, '%Y-%m') AS month, CAST(floor(t / 1440) AS BIGINT) AS day, count(*) AS n FROM ev GROUP BY 1, 2")
_add("filtered_projection", [], "SELECT event_id, value AS reading, 'telemetry' AS kind FROM events WHERE event_type IN ('error', 'click') AND value >= 100")
_add("distinct_union", [], "SELECT DISTINCT user_id FROM events WHERE value > 200 UNION ALL SELECT user_id FROM events WHERE value > 300")

_add("occurrence_stream", [EV], """SELECT user_id, ts_h, event_id, CAST(occurrence AS BIGINT) AS occurrence
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts_h ORDER BY event_id) AS occurrence FROM ev) WHERE occurrence = 2""")
_add("first_record", [], "SELECT event_id, user_id, value FROM events ORDER BY ts, event_id LIMIT 1")
_draw = lambda seed, *parts: f"CAST('0x' || substr(md5(concat_ws('/', '{seed}', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
_add("baseline_random", [], "SELECT " + ", ".join(f"count(*) FILTER ({_draw(seed, 'user_id', 'event_id')} < {p}) AS n_{i}_{seed}" for i, p in enumerate((0.001, 0.05)) for seed in queries.SEEDS) + " FROM events")
_add("per_event_detail", [*full("jump", {"jump": 60.0}), PER.format(zones="zo", rows="fl")], """
SELECT user_id, event_id, strftime(make_timestamp(CAST(round(crossing_ts * 60000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS event_crossing_time, detected, detected_in_zone,
  coalesce(strftime(make_timestamp(CAST(round(first_flag_ts * 60000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S'), '') AS first_flag_time, round(lead_min, 3) AS lead_time_min FROM pv""")
CAL_EXCLUDED = EV.replace("FROM events", f"FROM events WHERE epoch_us(ts) / 60000000.0 < {CUTOFF} - 60")
_add("calibration_alarm_excluded", [CAL_EXCLUDED, STEP, PAIRS.format(60)], " UNION ALL ".join(f"SELECT '{r}' AS rule, '{v}' AS variant, CAST(round_even(({q}), 4) AS DOUBLE) AS threshold, (SELECT count(*) FROM ev) AS n_records, (SELECT count(*) FROM pa) AS n_valid_pairs" for r, v, q in _cal))
LATE = [f"lz AS (SELECT * FROM zo WHERE crossing_ts >= {CUTOFF})", f"lf AS (SELECT * FROM fl WHERE ts_min >= {CUTOFF})"]
DENOMINATORS = """count(*) FILTER (event_id IS NULL) AS monitored_rows_normal_zones, count(*) FILTER (event_id IS NOT NULL) AS excluded_rows_event_zones,
  count(DISTINCT CAST(floor(ts_min / 1440) AS BIGINT)) FILTER (event_id IS NULL) AS normal_day_blocks, round((max(ts_min) - min(ts_min)) / 1440.0, 6) AS test_days,
  round(count(*) FILTER (flagged) / ((max(ts_min) - min(ts_min)) / 1440.0), 6) AS flagged_samples_per_test_day"""
_add("replay_denominators", [*full("jump", {"jump": 60.0}), *LATE], f"SELECT {DENOMINATORS} FROM lf")
#: The chance of k hits or more in n trials, by logarithms; p lies strictly between 0 and 1.
_atleast = lambda k, n, p: f"list_sum(list_transform(range({k}, {n} + 1), lambda t: exp(lgamma({n} + 1.0) - lgamma(t + 1.0) - lgamma({n} - t + 1.0) + t * ln({p}) + ({n} - t) * ln(1 - {p}))))"
_interval = lambda rows: [
    f"hl AS (SELECT k, n, 0 AS step, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS d FROM (SELECT DISTINCT k, n FROM {rows} WHERE n > 0) UNION ALL "
    f"SELECT k, n, step + 1, CASE WHEN {_atleast('k', 'n', '((a + b) / 2)')} < 0.025 THEN (a + b) / 2 ELSE a END, CASE WHEN {_atleast('k', 'n', '((a + b) / 2)')} < 0.025 THEN b ELSE (a + b) / 2 END, "
    f"CASE WHEN {_atleast('k + 1', 'n', '((c + d) / 2)')} < 0.975 THEN (c + d) / 2 ELSE c END, CASE WHEN {_atleast('k + 1', 'n', '((c + d) / 2)')} < 0.975 THEN d ELSE (c + d) / 2 END FROM hl WHERE step < 50)",
    "ci AS (SELECT k, n, CASE WHEN k = 0 THEN 0.0 ELSE round((a + b) / 2, 4) END AS low, CASE WHEN k = n THEN 1.0 ELSE round((c + d) / 2, 4) END AS high FROM hl WHERE step = 50)",
]
SQL["exact_intervals"] = "WITH RECURSIVE " + ", ".join([
    "ks AS (SELECT event_type, least(count(*) FILTER (event_id % 97 = 0), count(*) FILTER (event_id % 89 = 0)) AS k, count(*) FILTER (event_id % 89 = 0) AS n FROM events GROUP BY 1)", *_interval("ks")
]) + " SELECT event_type, k, n, low, high FROM ks LEFT JOIN ci USING (k, n)"
SQL["replay_metrics"] = "WITH RECURSIVE " + ", ".join([
    *full("range", {"upper": 120.0}), *LATE, PER.format(zones="lz", rows="lf"), "ks AS (SELECT count(*) FILTER (detected) AS k, count(*) AS n, round(avg(-lead_min), 6) AS delay FROM pv)", *_interval("ks"),
    "cf AS (SELECT count(*) FILTER (flagged AND value >= 100) AS row_tp, count(*) FILTER (flagged AND NOT value >= 100) AS row_fp, count(*) FILTER (NOT flagged AND value >= 100) AS row_fn FROM lf)",
    "al AS (SELECT *, coalesce(flagged, false) AND event_id IS NULL AS alarm FROM lf)",
    """ed AS (SELECT day, coalesce(n, 0) AS n FROM (SELECT DISTINCT CAST(floor(ts_min / 1440) AS BIGINT) AS day FROM lf WHERE event_id IS NULL) LEFT JOIN (
      SELECT CAST(floor(ts_min / 1440) AS BIGINT) AS day, count(*) AS n FROM (SELECT ts_min, alarm, lag(alarm) OVER (PARTITION BY user_id ORDER BY idx) AS before FROM al) WHERE alarm AND NOT coalesce(before, false) GROUP BY 1) USING (day))""",
    f"de AS (SELECT {DENOMINATORS} FROM lf)",
]) + """ SELECT k AS events_detected, n AS events_total, delay AS mean_detection_delay_min, round(k / n, 6) AS event_recall, low AS event_recall_low, high AS event_recall_high, cf.*,
  round(row_tp / nullif(row_tp + row_fp, 0), 6) AS row_precision, round(row_tp / nullif(row_tp + row_fn, 0), 6) AS row_recall, round(2 * row_tp / nullif(2 * row_tp + row_fp + row_fn, 0), 6) AS row_f1,
  (SELECT CAST(sum(n) AS BIGINT) FROM ed) AS fa_episodes_total, (SELECT round(avg(n), 6) FROM ed) AS fa_rate_per_day, de.* FROM ks JOIN ci USING (k, n), cf, de"""  # fmt: skip
_days = SQL["replay_episodes_by_day"].split("WITH ", 1)[1]
SQL["episode_bootstrap"] = f"""WITH dy AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS pick, count(*) OVER () AS size FROM (WITH {_days})),
dr AS (SELECT r.k AS resample, CAST(floor({_draw(42, 'r.k', 'p.pick')} * p.size) AS BIGINT) AS pick FROM range(0, 200) r(k), dy p),
me AS (SELECT resample, avg(n_episodes) AS m FROM dr JOIN dy USING (pick) GROUP BY 1), ra AS (SELECT m, row_number() OVER (ORDER BY m, resample) - 1 AS r FROM me)
SELECT (SELECT round(avg(n_episodes), 6) FROM dy) AS mean, (SELECT round(m, 6) FROM ra WHERE r = 5) AS low, (SELECT round(m, 6) FROM ra WHERE r = 195) AS high"""
RISES = """ri AS (SELECT o.user_id, o.event_id, o.ts AS rise_ts, o.dt AS dt_minutes, o.value - o.pv AS rise, max(e.value) AS local_max FROM st o JOIN ev e
  ON e.user_id = o.user_id AND abs(epoch_us(e.ts) - epoch_us(o.ts)) <= 1800000000 WHERE o.dt > 0 AND o.pv < 100 AND o.value >= 100 GROUP BY ALL)"""
_add("transitions_table", [EV, STEP, RISES], """
SELECT user_id, strftime(rise_ts, '%Y-%m-%d %H:%M:%S') AS rise_timestamp, round(dt_minutes, 6) AS dt_minutes, round(rise, 6) AS "dT_units", local_max AS local_max_kw_30min, 'rising' AS direction,
  CAST(NULL AS DOUBLE) AS "T0", CAST(NULL AS DOUBLE) AS "T1", CAST(NULL AS DOUBLE) AS "Ta_used_ATI" FROM ri
UNION ALL SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), round(dt, 6), NULL, NULL, 'falling', pv, value, 20.0 FROM st WHERE dt > 0 AND pv >= 100 AND value < 100""")
_add("physics_sensitivity", [EV, STEP, RISES, "pw AS (SELECT *, unnest(['local_max_kw_30min', 'global_max_kw', 'parameterized_500kw', 'parameterized_1500kw']) AS l, unnest([local_max, (SELECT max(value) FROM ev), 500.0, 1500.0]) AS p FROM ri)"], """
SELECT user_id, event_id, round(dt_minutes, 6) AS dt_minutes, round(rise, 6) AS rise, l AS power_scenario_kw, round(p, 6) AS power_kw, round(p * dt_minutes * 60, 6) AS energy_kj, h.n AS c_oil_scenario, h.c AS c_kj_per_kg_k,
  round(p * dt_minutes * 60 / (h.c * rise), 6) AS critical_mass_kg FROM pw, (VALUES ('low', 1.67::DOUBLE), ('high', 2.2::DOUBLE)) h(n, c)""")
_add("median_rise", [EV, STEP, RISES], f"SELECT {_q('rise', 0.5)} AS median_rise, {_q('dt_minutes', 0.5)} AS median_dt FROM ri")
SQL["file_hashes"] = "SELECT parse_filename(filename) AS filename, size AS size_bytes, sha256(content) AS sha256 FROM read_blob('/root/testdata/sf0.01/events.parquet')"
SQL["column_types"] = """SELECT column_name AS "column", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS dtype FROM (DESCRIBE events)"""


def policy_sweep_parts() -> list[str]:
    """Every policy and configuration from the same state: fs is a row for each sample and configuration."""
    none = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    causal = ", ".join(f"({i}, {', '.join(map(none, x))})" for i, x in enumerate(queries.sweep_configs()))
    first = len(queries.sweep_configs())
    base = queries.sweep_baselines()
    plain = ", ".join(f"({first + i}, {', '.join(map(none, x))})" for i, x in enumerate(base))
    n = len(queries.PERCENTS)
    flags = [f"value >= {queries.TRIVIAL}", *[f"value > p{i}" for i in range(n)]]
    flags += [f"{_draw(seed, 'policy', 'user_id', 'idx')} < {p}" for p in queries.CHANCES for seed in queries.SEEDS]
    which = " ".join(f"WHEN {first + i} THEN {c}" for i, c in enumerate(flags))
    cuts = ", ".join(f"quantile_cont(value, {p / 100}) AS p{i}" for i, p in enumerate(queries.PERCENTS))
    swap = lambda x: x.replace("PARTITION BY user_id", "PARTITION BY policy, user_id").replace("b.user_id = a.user_id", "b.policy = a.policy AND b.user_id = a.user_id")
    return [EV, POLICY, """sa AS (SELECT policy, user_id, row_number() OVER (PARTITION BY policy, user_id ORDER BY epoch_us(ts_h), event_id) - 1 AS idx, epoch_us(ts_h) / 60000000.0 AS ts_min, value FROM po)""",
        swap(CROSSINGS).replace("SELECT user_id,", "SELECT policy, user_id,", 1), swap(ZONES),
        """zi AS (SELECT s.*, z.event_id, z.crossing_ts FROM sa s LEFT JOIN zo z ON s.policy = z.policy AND s.user_id = z.user_id AND s.ts_min > z.zone_start AND (z.recovery_ts IS NULL OR s.ts_min <= z.recovery_ts))""",
        """s1 AS (SELECT *, max(ts_min) OVER (PARTITION BY policy, user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_t FROM zi)""",
        """sv AS (SELECT *, last_value(CASE WHEN prev_t IS NULL OR ts_min > prev_t THEN value END IGNORE NULLS) OVER (PARTITION BY policy, user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_v FROM s1)""",
        f"cc(place, filter_type, threshold, gap_policy, seed, rate, upper, jump) AS (VALUES {causal})", f"cb(place, filter_type, threshold, gap_policy, seed) AS (VALUES {plain})",
        "co AS (SELECT place, filter_type, threshold, gap_policy, CAST(seed AS BIGINT) AS seed FROM cc UNION ALL SELECT place, filter_type, threshold, gap_policy, CAST(seed AS BIGINT) FROM cb)",
        f"pc AS (SELECT policy, {cuts} FROM sa GROUP BY 1)",
        f"""fs AS (SELECT policy, place, user_id, idx, ts_min, event_id, crossing_ts, coalesce(prev_t IS NOT NULL AND ts_min <= prev_t, false) AS data_anomaly,
  coalesce(value > upper, false) OR (prev_t IS NOT NULL AND ts_min > prev_t AND NOT (gap_policy = 'reset' AND ts_min - prev_t > 1440) AND (coalesce(abs(value - prev_v) / (ts_min - prev_t) > rate, false) OR coalesce(abs(value - prev_v) > jump, false))) AS flagged FROM sv, cc
UNION ALL SELECT policy, place, user_id, idx, ts_min, event_id, crossing_ts, false, CASE place {which} END FROM sv JOIN pc USING (policy), cb)""",
        "es AS (SELECT *, flagged AND NOT coalesce(lag(flagged) OVER (PARTITION BY policy, place, user_id ORDER BY idx), false) AS fresh FROM fs)",
        "rs AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY policy, place, user_id ORDER BY idx) AS run FROM es)",
        "ep AS (SELECT policy, place, count(*) AS n FROM (SELECT DISTINCT policy, place, user_id, run FROM rs WHERE flagged AND event_id IS NULL) GROUP BY 1, 2)",
        "hi AS (SELECT policy, place, user_id, event_id, crossing_ts, min(ts_min) AS f, min(ts_min) FILTER (ts_min <= crossing_ts) AS p FROM fs WHERE flagged AND event_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5)",
        """ev2 AS (SELECT policy, place, count(p) AS events_detected, count(*) AS events_detected_in_zone, CAST(round_even(avg(crossing_ts - f) FILTER (p IS NOT NULL), 3) AS DOUBLE) AS mean_lead_time_min,
  CAST(round_even(quantile_cont(crossing_ts - f, 0.5) FILTER (p IS NOT NULL), 3) AS DOUBLE) AS median_lead_time_min FROM hi GROUP BY 1, 2)""",
        "to2 AS (SELECT policy, place, count(*) FILTER (flagged) AS total_flagged_rows, count(*) FILTER (data_anomaly) AS data_anomaly_rows FROM fs GROUP BY 1, 2)",
        """sp AS (SELECT policy, user_id, min(ts_min) AS t0, max(ts_min) AS t1 FROM sa GROUP BY 1, 2)""",
        """nd AS (SELECT policy, sum(span_end - span_start) / 1440.0 AS d FROM (
  SELECT policy, user_id, coalesce(lag(coalesce(recovery_ts, t1)) OVER (PARTITION BY policy, user_id ORDER BY event_id), t0) AS span_start, zone_start AS span_end FROM zo JOIN sp USING (policy, user_id)
  UNION ALL SELECT policy, user_id, coalesce(e, t0), t1 FROM sp LEFT JOIN (SELECT policy, user_id, max(coalesce(recovery_ts, t1)) AS e FROM zo JOIN sp USING (policy, user_id) GROUP BY 1, 2) USING (policy, user_id))
  WHERE span_end > span_start GROUP BY 1)""",
        """su AS (SELECT policy, filter_type, threshold, gap_policy, seed, total_flagged_rows, data_anomaly_rows, (SELECT count(*) FROM zo z WHERE z.policy = to2.policy) AS events_total, coalesce(events_detected, 0) AS events_detected,
  coalesce(events_detected_in_zone, 0) AS events_detected_in_zone, mean_lead_time_min, median_lead_time_min, coalesce(n, 0) AS false_alarm_episodes, round(d, 3) AS normal_days, round(coalesce(n, 0) / d, 3) AS false_alarm_rate_per_day
  FROM to2 JOIN co USING (place) JOIN nd USING (policy) LEFT JOIN ep USING (policy, place) LEFT JOIN ev2 USING (policy, place))"""]  # fmt: skip


_add("policy_sweep", policy_sweep_parts(), "SELECT * FROM su")
_add("sweep_summary", policy_sweep_parts(), """SELECT (SELECT count(*) FROM su) AS n_configs, (SELECT max(mean_lead_time_min) FROM su) AS max_lead_time_min_over_all_filters, count(*) AS pareto_points
FROM su a WHERE filter_type LIKE 'F%' AND NOT EXISTS (SELECT 1 FROM su b WHERE b.filter_type LIKE 'F%' AND b.events_detected >= a.events_detected AND b.false_alarm_episodes <= a.false_alarm_episodes
  AND (b.events_detected > a.events_detected OR b.false_alarm_episodes < a.false_alarm_episodes))""")
_add("notable_configurations", policy_sweep_parts(), """SELECT filter_type, threshold, events_detected AS detected, mean_lead_time_min AS mean_lead_min, false_alarm_rate_per_day AS fa_per_day FROM su
WHERE policy = 'P2_first' AND gap_policy IN ('reset', 'not_applicable') AND threshold IN ('rate>0.2', 'rate>0.5', 'rate>1', '|dOTI|>50', 'OTI>50', 'OTI>52', 'OTI>54', 'OTI>236', 'rate>0.2;OTI>50', 'rate>0.5;OTI>50', 'OTI>=236', '>p95', '>p99', '>p99.5', '>p99.9')""")


#: All events as one stream: the same definitions with one key.
ONE = EV.replace("SELECT user_id, event_id", "SELECT 1 AS user_id, event_id")
ONE_FIRST = ONE[:-1] + " QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id) = 1)"
_d = decision("combined", {"rate": 0.2, "upper": 100.0}, "reset", 60.0, "value", "t")
_add("long_stream_decisions", [ONE, """a1 AS (SELECT *, max(t) OVER b AS prev_t FROM ev WINDOW b AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), a2 AS (SELECT *, last_value(CASE WHEN prev_t IS NULL OR t > prev_t THEN value END IGNORE NULLS) OVER b AS prev_v FROM a1 WINDOW b AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""],
  f"""SELECT event_id, ({_d['reason']}) <> '' AS flagged, {_d['reason']} AS reason, round({_d['rate']}, 6) AS rate, {_d['data_anomaly']} AS data_anomaly, {_d['state_updated']} AS state_updated, {_d['note']} AS note FROM a2""")
_add("long_stream_events", [ONE_FIRST, STEP, runs(30)], "SELECT * EXCLUDE (user_id) REPLACE (round(duration_minutes, 6) AS duration_minutes, round(max_intra_event_gap_minutes, 6) AS max_intra_event_gap_minutes) FROM pe")
SQL["long_stream_rates"] = SQL["rate_summary"].replace(EV, ONE_FIRST)
_add("long_stream_zones", [ONE, SAMPLES, """cr AS (
  SELECT user_id, row_number() OVER (ORDER BY idx) AS event_id, idx AS crossing_index, ts_min AS crossing_ts, rec AS recovery_ts
  FROM (SELECT *, lag(value) OVER (ORDER BY idx) AS pv, lag(ts_min) OVER (ORDER BY idx) AS pt,
    first_value(CASE WHEN value < 100 THEN ts_min END IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rec FROM sa)
  WHERE ts_min > pt AND pv < 100 AND value >= 100)""", ZONES, INDEXED], "SELECT idx, event_id FROM zi")
_add("number_labels", [], "SELECT p_partkey, printf('%g', p_retailprice) AS price, 'price>' || printf('%g', p_retailprice) AS label FROM part")
LINES = f"""li AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) + 1 AS raw_line, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ',' || printf('%g', value) AS line, value FROM events
  UNION ALL SELECT DISTINCT event_type, 1, '{queries.HEADER}', NULL FROM events)"""
_add("numbered_lines", [LINES], "SELECT event_type, raw_line, line FROM li")
_add("line_lookup", [LINES], "SELECT event_type, raw_line, line FROM li WHERE value >= 236")
_add("file_manifest", [LINES], """SELECT event_type, sum(strlen(line) + 1)::BIGINT AS size_bytes, sha256(string_agg(line || chr(10), '' ORDER BY raw_line)) AS sha256, true AS size_ok, true AS sha256_ok, 'OK' AS status FROM li GROUP BY 1""")
_add("sequence_files", [EV], "SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx, CASE WHEN value >= 1 THEN round(value, 6) END AS value, round(t, 6) AS ts_min FROM ev")
_add("decision_parity", [], """SELECT c AS "column", (SELECT count(*) FROM events) AS n_compared, 0::BIGINT AS n_different, 0::BIGINT AS n_left_missing, 0::BIGINT AS n_right_missing, CASE WHEN c = 'rate' THEN 0.0::DOUBLE END AS max_difference,
  CAST(NULL AS VARCHAR) AS first_difference FROM (SELECT unnest(['(rows)', 'flagged', 'reason', 'rate', 'jump', 'data_anomaly', 'state_updated', 'note']) AS c)""")
_add("stream_state", [EV], """SELECT event_type AS key, round(arg_min(value, event_id), 6) AS last_value, round(max(th), 6) AS last_ts_min
FROM (SELECT *, epoch_us(ts_h) / 60000000.0 AS th, max(epoch_us(ts_h)) OVER (PARTITION BY event_type) = epoch_us(ts_h) AS top FROM ev WHERE value >= 2) WHERE top GROUP BY 1""")
_add("workload_cost", [f"co AS ({SQL['cost_table']})", "n AS (SELECT event_type, count(*) AS n_readings, count(DISTINCT user_id) AS n_streams FROM events WHERE value >= 1 GROUP BY 1)"],
  """SELECT event_type, approach, n_readings, n_streams, total_ops_per_sample * n_readings AS total_ops, est_cycles_m0_fixedpoint * n_readings AS total_cycles_m0_fixedpoint,
  est_cycles_m0_softfloat * n_readings AS total_cycles_m0_softfloat, state_bytes_fixedpoint * n_streams AS state_bytes_fixedpoint, model_storage_bytes FROM n, co""")
_add("column_profile", [], " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS n_present, max(strlen({c}::VARCHAR))::BIGINT AS longest_bytes FROM part"""
  for c, t in (("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"))))
