"""The registered queries as DuckDB SQL over the given tables."""

from __future__ import annotations

from ..functions import constants as c
from .bindings import ANSWERS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(column: str, table: dict[str, str], otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in table.items()) + f" ELSE {otherwise} END"


PARTS = {
    "tel": ("", """SELECT 'Mission' || (user_id % 3 + 1) AS mission, 'channel_' || user_id AS channel, CAST(ts AS TIMESTAMP) AS ts, value,
      CASE WHEN user_id % 3 = 2 THEN 'value_' || CAST(floor(value / 10) AS BIGINT) END AS raw, user_id, event_id, event_type FROM events"""),
    "ch": ("", """SELECT DISTINCT 'Mission' || (user_id % 3 + 1) AS mission, 'channel_' || user_id AS channel, CAST(user_id AS INT) AS ordinal, 'subsystem_' || (user_id % 12 + 1) AS subsystem,
      'physical_unit_' || (user_id % 14 + 1) AS physical_unit, CAST(user_id % 5 AS VARCHAR) AS grp, CASE WHEN user_id % 4 = 0 THEN 'NO' ELSE 'YES' END AS target FROM events"""),
    "iv": ("tel", "SELECT mission, 'e' || event_id AS id, channel, ts AS start_time, ts + (1 + user_id % 12) * INTERVAL 1 HOUR AS end_time FROM tel WHERE event_type = 'error' AND value > 80"),
    "bk": ("tel", "SELECT mission, channel, date_trunc('hour', ts) AS b, avg(value) AS v FROM tel GROUP BY 1, 2, 3"),
    "bl": ("bk", "SELECT *, lead(b) OVER w AS nb, lead(v) OVER w AS nv FROM bk WINDOW w AS (PARTITION BY mission, channel ORDER BY b)"),
    "g0": ("bl", """SELECT mission, channel, b + k * INTERVAL 1 HOUR AS ts, CASE WHEN nb IS NULL OR k = 0 THEN v ELSE v + (nv - v) * k / date_diff('hour', b, nb) END AS value
      FROM (SELECT *, unnest(range(coalesce(date_diff('hour', b, nb), 1))) AS k FROM bl)"""),
    "grid": ("g0 iv", """SELECT g.*, CAST(row_number() OVER (PARTITION BY mission, channel ORDER BY ts) - 1 AS INT) AS idx,
      EXISTS (SELECT 1 FROM iv i WHERE i.mission = g.mission AND i.channel = g.channel AND g.ts BETWEEN i.start_time AND i.end_time) AS is_anomaly FROM g0 g"""),
    "gn": ("grid", """SELECT mission, channel, ts, idx, is_anomaly, value, avg(value) OVER w AS mean, stddev_pop(value) OVER w + 1e-5 AS std, stddev_pop(value) OVER w AS raw_std,
      (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-5) AS value_norm FROM grid WINDOW w AS (PARTITION BY mission, channel)"""),
    "win": ("gn", """SELECT mission, channel, CAST(s AS INT) AS start_idx, CAST(s + 32 AS INT) AS end_idx, min(ts) AS start_time, max(ts) AS end_time, list(value ORDER BY idx) AS vals, list(value_norm ORDER BY idx) AS nvals,
      bool_or(is_anomaly) AS is_anomaly, count(*) FILTER (is_anomaly) / 32 AS anomaly_ratio
      FROM (SELECT *, unnest([idx // 16 * 16, idx // 16 * 16 - 16]) AS s FROM gn) WHERE s >= 0 GROUP BY mission, channel, s HAVING count(*) = 32"""),
    "sh": ("win", """SELECT *, list_avg(nvals) AS mean, list_stddev_pop(nvals) AS std, list_max(nvals) - list_min(nvals) AS p2p, list_avg(nvals[25:32]) - list_avg(nvals[1:8]) AS trend FROM win"""),
    "pat": ("sh", """SELECT *, CASE WHEN anomaly_ratio >= 0.75 AND abs(mean) > 2 THEN 'sustained_offset' WHEN anomaly_ratio >= 0.75 AND std > 2.5 THEN 'sustained_oscillation'
      WHEN anomaly_ratio >= 0.75 THEN 'persistent_anomaly' WHEN std > 3 OR p2p > 6 THEN 'spike' WHEN abs(trend) > 1.5 THEN 'drift' WHEN std > 1.8 THEN 'oscillation' ELSE 'subtle_deviation' END AS pattern,
      CASE WHEN anomaly_ratio >= 0.5 THEN 'high' WHEN anomaly_ratio >= 0.15 THEN 'medium' ELSE 'low' END AS severity,
      mission || '__' || channel || '__' || strftime(start_time, '%Y-%m-%dT%H:%M:%S') AS anomaly_id FROM sh"""),
    "er": ("win", "SELECT mission, channel, CAST(start_idx // 16 AS INT) AS i, start_idx, list_var_pop(vals) AS error, is_anomaly FROM win"),
    "ern": ("er", """SELECT *, avg(error) FILTER (NOT is_anomaly) OVER w AS nm, stddev_pop(error) FILTER (NOT is_anomaly) OVER w AS ns FROM er WINDOW w AS (PARTITION BY mission, channel)"""),
    "fl": ("ern", "SELECT *, coalesce(error > nm + 1.0 * ns, false) AS pred FROM ern"),
    "rec": ("fl", """SELECT mission, channel, count(*) FILTER (pred AND is_anomaly) AS tp, count(*) FILTER (pred AND NOT is_anomaly) AS fp, count(*) FILTER (NOT pred AND is_anomaly) AS fn,
      count(*) FILTER (NOT pred AND NOT is_anomaly) AS tn FROM fl GROUP BY 1, 2"""),
    "recm": ("rec", """SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM rec)"""),
    "mac": ("recm", """SELECT *, CASE WHEN 0.25 * precision + recall = 0 THEN 0 ELSE 1.25 * precision * recall / (0.25 * precision + recall) END AS cef FROM
      (SELECT coalesce(avg(p), 0) AS precision, coalesce(avg(r), 0) AS recall, coalesce(avg(f), 0) AS f1, count(*) AS n_channels FROM recm WHERE tp + fn > 0)"""),
    "sc": ("", """SELECT d.doc_id AS index, 'Mission' || (d.doc_id % 3 + 1) AS mission, 'channel_' || (d.doc_id % 15) AS channel, quality = 0 AS is_anomaly,
      round(least(1.0, 2.5 * (1 - length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) / n_chars)), 6) AS text, round(1 - len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' ')), 6) AS vision,
      CASE WHEN d.doc_id % 3 <> 0 THEN round(n_chars / len(string_split(text, ' ')), 6) END AS error FROM documents d JOIN labels USING (doc_id)"""),
    "mt": ("sc", "SELECT index, mission, channel, CAST((index % 40) * 16 AS INT) AS start_idx, CAST((index % 40) * 16 + 32 AS INT) AS end_idx FROM sc"),
    "an": ("tel", f"""SELECT event_id AS index, mission, channel, event_type = 'error' AS is_anomaly, [{', '.join(lit(x) for x in ANSWERS)}][event_id % 7 + 1] AS actual_response, value / 100 AS elapsed_s FROM tel"""),
    "vd": ("an", """SELECT *, CASE WHEN contains(upper(actual_response), 'ANOMALY DETECTED') OR starts_with(upper(actual_response), 'ANOMALY') THEN 'ANOMALY' WHEN contains(upper(actual_response), 'NOMINAL') THEN 'NOMINAL' ELSE 'UNKNOWN' END AS predicted FROM an"""),
    "jd": ("", """SELECT doc_id AS index, CAST(doc_id % 3 AS INT) AS correctness, CAST(n_chars % 3 AS INT) AS actionability, CAST((doc_id + n_chars) % 3 AS INT) AS grounding, quality = 1 AS is_anomaly FROM documents JOIN labels USING (doc_id)"""),
    "ct": ("", """SELECT conv_id, turn, text AS instruction, response, conv_id % 2 = 0 AS is_anomaly FROM (SELECT *, lead(text) OVER w AS response, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nrole = 'assistant'"""),
    "im": ("", "SELECT vec_id AS index, label, CAST(embedding AS DOUBLE[]) AS a FROM embeddings"),
    "rg": ("", "SELECT l_orderkey, log10(l_extendedprice) AS truth, log10(l_quantity * 1500) AS pred FROM lineitem"),
    "fw": ("win", "SELECT mission, channel, start_idx, is_anomaly, md5(concat_ws('|', mission, channel, start_idx, '42')) AS d FROM win"),
    "sp": ("fw", """SELECT mission, channel, start_idx, is_anomaly, CASE WHEN r < a THEN 'train' WHEN r < b THEN 'val' ELSE 'test' END AS split, CASE WHEN r < a THEN r WHEN r < b THEN r - a ELSE r - b END AS index
      FROM (SELECT *, row_number() OVER (ORDER BY d, mission, channel, start_idx) - 1 AS r, CAST(floor(count(*) OVER () * 0.7) AS BIGINT) AS a, CAST(floor(count(*) OVER () * 0.7) AS BIGINT) + CAST(floor(count(*) OVER () * 0.15) AS BIGINT) AS b FROM fw)"""),
    "pr0": ("fl", "SELECT mission, channel, start_idx AS s, start_idx + 32 AS e FROM fl WHERE pred"),
    "gt0": ("fl", "SELECT mission, channel, start_idx AS s, start_idx + 32 AS e FROM fl WHERE is_anomaly"),
    "th": ("tel", "SELECT mission, channel, avg(value) AS m, stddev_pop(value) AS s FROM tel GROUP BY 1, 2"),
    "wm": ("tel", "SELECT max(ts) - INTERVAL 2 HOUR AS wm FROM tel"),
}
for name, source in (("mp", "pr0"), ("mg", "gt0")):
    PARTS[name] = (source, f"""SELECT mission, channel, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY mission, channel ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM
      (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY mission, channel ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 16 THEN 0 ELSE 1 END AS new FROM {source})) GROUP BY mission, channel, g""")


def sql(needs: str, select: str) -> str:
    """select with the named parts, and what they stand on, before it."""
    done: list[str] = []

    def add(name: str) -> None:
        for n in PARTS[name][0].split():
            add(n)
        if name not in done:
            done.append(name)

    for n in needs.split():
        add(n)
    own = select.lstrip()
    head = ", ".join(f"{n} AS ({PARTS[n][1]})" for n in done)
    if own.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {own[15:]}"
    if own.upper().startswith("WITH "):
        return f"WITH {head}, {own[5:]}" if head else own
    return f"WITH {head} {own}" if head else own


TS = "'%Y-%m-%d %H:%M:%S'"
K3 = "mission, channel, start_idx"
PRF = """CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r"""


def shown(values: str, name: str) -> str:
    return f"array_to_string(list_transform({values}, lambda x: CAST(CAST(round(x + 1e-7, 4) AS DECIMAL(20,4)) AS VARCHAR)), ',') AS {name}"


def sweep_sql(score: str, points: str, extra: str = "") -> str:
    """Confusion metrics of every threshold in the relation `points(t)`."""
    return f"""WITH pts AS ({points}), cm AS (SELECT t, count(*) FILTER ({score} >= t AND is_anomaly) AS tp, count(*) FILTER ({score} >= t AND NOT is_anomaly) AS fp, count(*) FILTER ({score} < t AND is_anomaly) AS fn,
      count(*) FILTER ({score} < t AND NOT is_anomaly) AS tn FROM pts, sc GROUP BY t), cp AS (SELECT *, {PRF} FROM cm),
      curve AS (SELECT round(t, 6) AS threshold, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1,
      round(CASE WHEN 0.25 * p + r = 0 THEN 0 ELSE 1.25 * p * r / (0.25 * p + r) END, 4) AS cef, tp, fp, fn, tn FROM cp)"""


UNIT = "SELECT i / 200 AS t FROM range(201) x(i)"


def range_points(score: str) -> str:
    return f"SELECT DISTINCT t FROM (SELECT lo + (hi - lo) * i / 200 AS t FROM (SELECT min({score}) AS lo, max({score}) AS hi FROM sc), range(201) x(i) UNION ALL SELECT 0.5)"


CURVE_COLUMNS = "threshold, precision, recall, f1, cef, tp, fp, fn, tn"
BEST = f"SELECT {CURVE_COLUMNS} FROM curve ORDER BY {{}} DESC, threshold LIMIT 1"
SUMMARY = """n_samples, tp, fp, fn, tn, unknown_responses, avg_time_s, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1, round((tp + tn) / n_samples, 4) AS accuracy"""


def summary_sql(source: str, predicted: str) -> str:
    return f"""s0 AS (SELECT count(*) AS n_samples, count(*) FILTER (is_anomaly AND {predicted} = 'ANOMALY') AS tp, count(*) FILTER (NOT is_anomaly AND {predicted} = 'ANOMALY') AS fp,
      count(*) FILTER (is_anomaly AND {predicted} <> 'ANOMALY') AS fn, count(*) FILTER (NOT is_anomaly AND {predicted} = 'NOMINAL') AS tn, count(*) FILTER ({predicted} = 'UNKNOWN') AS unknown_responses, round(avg(elapsed_s), 3) AS avg_time_s FROM {source}),
      s1 AS (SELECT {SUMMARY} FROM (SELECT *, {PRF} FROM s0))"""


DETECTION = f"""WITH {summary_sql('vd', 'predicted')}, s2 AS (SELECT count(*) FILTER (predicted = 'ANOMALY') AS n_anomaly_predictions, coalesce(round(avg(length(actual_response)) FILTER (predicted = 'ANOMALY'), 1), 0.0) AS advice_avg_chars,
  coalesce(round(avg(CAST(contains(upper(actual_response), 'DIAGNOSIS') AND contains(upper(actual_response), 'ADVICE') AS INT)) FILTER (predicted = 'ANOMALY'), 4), 0.0) AS advice_structured_frac FROM vd),
  s3 AS (SELECT *, round(CASE WHEN 0.25 * precision + recall = 0 THEN 0 ELSE 1.25 * precision * recall / (0.25 * precision + recall) END, 4) AS cef, round((n_samples - unknown_responses) / n_samples, 4) AS format_compliance FROM s1, s2)"""
TRIVIAL = "SELECT p AS precision, 1.0 AS recall, 2 * p / (p + 1) AS f1, 1.25 * p / (0.25 * p + 1) AS cef, n AS n_units FROM (SELECT avg(CAST(is_anomaly AS INT)) AS p, count(*) AS n FROM win)"
LOOSE = """l0 AS (SELECT mission, channel, count(*) FILTER (q AND is_anomaly) AS tp, count(*) FILTER (q AND NOT is_anomaly) AS fp, count(*) FILTER (NOT q AND is_anomaly) AS fn FROM (SELECT *, coalesce(error > nm + 2.0 * ns, false) AS q FROM ern) GROUP BY 1, 2),
  l1 AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM (SELECT *, """ + PRF + """ FROM l0 WHERE tp + fn > 0)),
  l2 AS (SELECT *, CASE WHEN 0.25 * precision + recall = 0 THEN 0 ELSE 1.25 * precision * recall / (0.25 * precision + recall) END AS cef FROM (SELECT avg(p) AS precision, avg(r) AS recall, avg(f) AS f1 FROM l1))"""
APPROACHES = DETECTION + f""", {LOOSE}, ap AS (SELECT 'flat threshold' AS approach, precision, recall, f1, cef FROM mac UNION ALL SELECT 'flat threshold z 2', precision, recall, f1, cef FROM l2 UNION ALL SELECT 'text', precision, recall, f1, cef FROM s3
  UNION ALL SELECT 'always', precision, recall, f1, cef FROM ({TRIVIAL})), apr AS (SELECT approach, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, round(cef, 4) AS cef FROM ap)"""


def checks(source: str, rows: list[tuple[str, str, str, str]], where: str = "") -> str:
    """One row for each (check, observed, passes, expected) over source."""
    return " UNION ALL ".join(f"SELECT {lit(n)} AS check, {ok} AS passed, CAST({seen} AS VARCHAR) AS observed, {lit(want)} AS expected FROM {source}" for n, seen, ok, want in rows)


def chat(text: str) -> str:
    return text


SYS = c.SYSTEM_PROMPT
CHATML = f"{lit(c.TURN + 'system' + chr(10) + SYS + c.END_TURN + chr(10) + c.TURN + 'user' + chr(10))} || instruction || {lit(c.END_TURN + chr(10) + c.TURN + 'assistant' + chr(10))} || response || {lit(c.END_TURN)}"
SHOT = f"{lit(c.TURN + 'user' + chr(10))} || instruction || {lit(c.END_TURN + chr(10) + c.TURN + 'assistant' + chr(10))} || response || {lit(c.END_TURN + chr(10))}"


def prefix(n: int) -> str:
    return f"SELECT string_agg({SHOT}, '' ORDER BY is_anomaly, k) AS prefix FROM (SELECT *, row_number() OVER (PARTITION BY is_anomaly ORDER BY conv_id * 1000 + turn) AS k FROM ct) WHERE k <= {n}"


CUT = lambda n, source="fw": f"SELECT {K3}, is_anomaly FROM (SELECT *, row_number() OVER (PARTITION BY is_anomaly ORDER BY d, {K3}) AS k, n_pos, n FROM {source}, (SELECT count(*) AS n, count(*) FILTER (is_anomaly) AS np, least(CAST(round_even({n} * count(*) FILTER (is_anomaly) / count(*), 0) AS BIGINT), count(*) FILTER (is_anomaly)) AS n_pos FROM {source})) WHERE k <= CASE WHEN is_anomaly THEN n_pos ELSE {n} - n_pos END"
PCT = "CAST(trunc(anomaly_ratio * 100) AS INT)"
MANIFEST = "SELECT split, index, 'data/plots/' || split || '/' || printf('%06d', index) || '.png' AS image_path, is_anomaly, mission, channel FROM sp WHERE index < 300"
GINI = "CASE WHEN list_sum(m) = 0 THEN 0 ELSE 2 * list_sum(list_transform(m, lambda x, i: x * i)) / (64 * list_sum(m)) - 65.0 / 64 END"
MAGS = "mg0 AS (SELECT index, a, list_sort(list_transform(a, lambda x: abs(x))) AS m FROM im)"
LONG = "lg AS (SELECT index, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS x FROM im)"

ORACLES: dict[str, str] = {
    "s1_missions": sql("tel", "SELECT mission, count(*) AS n FROM tel WHERE mission IN ('Mission1', 'Mission3') GROUP BY 1"),
    "s2_channels": sql("ch", "SELECT * EXCLUDE (k) REPLACE (k AS ordinal) FROM (SELECT *, CAST(row_number() OVER (PARTITION BY mission ORDER BY ordinal) - 1 AS INT) AS k FROM ch) WHERE target = 'YES'"),
    "s3_cap_channels": sql("ch", "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY mission ORDER BY ordinal) AS k FROM ch) WHERE k <= 3"),
    "s4_telemetry": sql("tel ch", f"SELECT t.mission, t.channel, count(*) AS n, count(raw) AS n_raw, max(strftime(date_trunc('second', ts), {TS})) AS last, round(sum(value), 4) AS total FROM tel t JOIN ch USING (mission, channel) WHERE target = 'YES' GROUP BY 1, 2"),
    "s5_intervals": sql("iv", f"SELECT mission, id, channel, strftime(date_trunc('second', start_time), {TS}) AS start_time, strftime(date_trunc('second', end_time), {TS}) AS end_time FROM iv"),
    "s6_records": sql("win", f"SELECT CASE WHEN start_idx % 32 = 0 THEN 'train' ELSE 'test' END AS split, {K3}, strftime(start_time, {TS}) AS start_time, is_anomaly, CAST(len(vals) AS INT) AS n_values, CAST(CASE WHEN is_anomaly THEN {len(c.ANOMALY_RESPONSE)} ELSE {len(c.NOMINAL_RESPONSE)} END AS INT) AS n_response FROM win"),
    "s7_results": sql("vd", "SELECT predicted, count(*) AS n FROM vd GROUP BY 1"),
    "s8_pending": sql("ch iv", "SELECT mission, channel FROM ch WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.mission = ch.mission AND iv.channel = ch.channel)"),
    "s9_split_dense": sql("er", "SELECT mission, channel, i, round(error, 6) AS error FROM er"),
    "p1_ordinal": sql("tel", r"SELECT event_id, CAST(nullif(regexp_extract(raw, '(\d+)$', 1), '') AS DOUBLE) AS encoded FROM tel"),
    "p2_revin": sql("gn", "SELECT mission, channel, idx, round(value_norm, 6) AS value_norm, round(mean, 6) AS mean, round(std, 6) AS std FROM gn"),
    "p2_revin_inverse": sql("grid", "SELECT mission, channel, idx, round(value + 1e-7, 5) AS value FROM grid"),
    "p3_standardize": sql("gn", "SELECT mission, channel, idx, round((value - mean) / CASE WHEN raw_std = 0 THEN 1 ELSE raw_std END, 6) AS value_std FROM gn"),
    "p4_positions": sql("win", """WITH l AS (SELECT mission, channel, CAST(generate_subscripts(vals, 1) - 1 AS INT) AS pos, unnest(vals) AS x FROM win), z AS (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM l WINDOW w AS (PARTITION BY mission, channel, pos))
      SELECT mission, channel, pos, round(max((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END), 5) AS hi, round(min((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END), 5) AS lo, count(*) AS n FROM z GROUP BY 1, 2, 3"""),
    "p5_revin_window": sql("win", f"SELECT {K3}, round((list_max(vals) - list_avg(vals)) / (list_stddev_pop(vals) + 1e-8), 6) AS hi, round((list_min(vals) - list_avg(vals)) / (list_stddev_pop(vals) + 1e-8), 6) AS lo, round((vals[1] - list_avg(vals)) / (list_stddev_pop(vals) + 1e-8), 6) AS first FROM win"),
    "p6_instruction": sql("win", f"""SELECT {K3}, 'Analyze the following telemetry sequence from ' || mission || ' satellite, channel ' || channel || '. The sequence contains 32 timesteps. Values: [' || array_to_string(list_transform(vals[1:10], lambda x: printf('%.4f', round(x + 1e-7, 2))), ', ') || {lit('...]' + chr(10) + chr(10) + c.QUESTION)} AS instruction FROM win"""),
    "p7_response": sql("win", f"SELECT {K3}, CASE WHEN is_anomaly THEN {lit(c.ANOMALY_RESPONSE)} ELSE {lit(c.NOMINAL_RESPONSE)} END AS response FROM win"),
    "p8_record": sql("win", f"SELECT {K3}, end_idx, strftime(start_time, {TS}) AS start_time, strftime(end_time, {TS}) AS end_time, is_anomaly, anomaly_ratio, {shown('list_transform(vals, lambda y: round(y, 6))', 'values')} FROM win"),
    "p9_window_stats": sql("sh", f"SELECT {K3}, round(mean, 6) AS mean, round(std, 6) AS std, round(p2p, 6) AS p2p, round(trend, 6) AS trend FROM sh"),
    "p10_pattern": sql("pat", f"SELECT {K3}, pattern FROM pat"),
    "p11_pattern_desc": sql("pat", f"""SELECT {K3}, CASE pattern WHEN 'sustained_offset' THEN printf('persistent offset (mean=%.2fσ) throughout %d%% of the window', round(round(mean, 4), 2), {PCT}) WHEN 'sustained_oscillation' THEN printf('high-amplitude oscillation (σ=%.2f) over %d%% of the window', round(round(std, 4), 2), {PCT})
      WHEN 'persistent_anomaly' THEN printf('anomalous behaviour across %d%% of the window', {PCT}) WHEN 'spike' THEN printf('transient spike (peak-to-peak=%.2fσ, %d%% of window flagged)', round(round(p2p, 4), 2), {PCT})
      WHEN 'drift' THEN printf('monotonic %s drift (Δ=%.2fσ across window)', CASE WHEN trend > 0 THEN 'upward' ELSE 'downward' END, round(round(trend, 4), 2)) WHEN 'oscillation' THEN printf('elevated variability (σ=%.2f) with %d%% anomalous timesteps', round(round(std, 4), 2), {PCT})
      ELSE printf('subtle deviation (%d%% of timesteps outside nominal envelope)', {PCT}) END AS description FROM pat"""),
    "p12_severity": sql("pat", f"SELECT {K3}, severity FROM pat WHERE is_anomaly"),
    "p13_names": sql("ch", f"""SELECT mission, channel, {case('subsystem', c.SUBSYSTEMS, "'Subsystem ' || substr(subsystem, 11)")} AS subsystem, {case('physical_unit', c.UNITS, "replace(physical_unit, '_', ' ')")} AS physical_unit FROM ch"""),
    "p14_anomaly_id": sql("pat", f"SELECT {K3}, anomaly_id FROM pat"),
    "p15_enriched": sql("pat", f"""SELECT anomaly_id, {lit(c.ANOMALY_RESPONSE + chr(10) + chr(10) + 'DIAGNOSIS: ')} || upper(replace(pattern, '_', ' ')) || ' (severity: ' || severity || {lit(')' + chr(10) + 'ADVICE: ')} || pattern || {lit(chr(10) + 'ACTION: ')} || {case('severity', c.SEVERITY_ACTION, 'NULL')} AS response FROM pat WHERE is_anomaly"""),
    "p16_chatml": sql("ct", f"SELECT conv_id, turn, {CHATML} AS text FROM ct"),
    "p17_prompt": sql("ct", f"WITH px AS ({prefix(1)}) SELECT conv_id, turn, {lit(c.TURN + 'system' + chr(10) + SYS + ' /no_think' + c.END_TURN + chr(10))} || prefix || {lit(c.TURN + 'user' + chr(10))} || instruction || {lit(c.END_TURN + chr(10) + c.TURN + 'assistant' + chr(10))} AS prompt FROM ct, px"),
    "p18_fewshot": sql("ct", prefix(2)),
    "p19_verdict": sql("vd", "SELECT index, predicted FROM vd"),
    "p20_verdict_score": "SELECT doc_id AS index, round(1 / (1 + exp(((doc_id % 500) / 125.0 - 2) - ((n_chars % 1000) / 250.0 - 2))), 6) AS score, CASE WHEN (n_chars % 1000) / 250.0 - 2 >= (doc_id % 500) / 125.0 - 2 THEN 'ANOMALY' ELSE 'NOMINAL' END AS argmax FROM documents",
    "p21_conversation": sql("sp", f"SELECT index, image_path AS image, {lit(c.VISION_PROMPT)} AS prompt, CASE WHEN is_anomaly THEN 'ANOMALY DETECTED' ELSE 'NOMINAL' END AS label FROM ({MANIFEST.replace(' WHERE index < 300', '')})"),
    "p22_log_flux": sql("tel", "SELECT event_id, round((log10(greatest(value * 1e-6, 1e-9)) + 5.5) / 2.5, 6) AS label, round(greatest(value * 1e-6, 1e-9) * 1e6, 4) AS back FROM tel"),
    "p23_scalar": sql("tel", "SELECT event_id, value FROM tel"),
    "p24_advice_flags": sql("an", "SELECT index, contains(upper(actual_response), 'DIAGNOSIS') AND contains(upper(actual_response), 'ADVICE') AS structured, CAST(length(actual_response) AS INT) AS n_chars, left(actual_response, 300) AS shown FROM an"),
    "p25_normalise": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'ANOMALY' WHEN 1 THEN 'NOMINAL' ELSE 'UNKNOWN' END AS predicted FROM conversations",
    "p26_parse_time": sql("tel", f"SELECT event_id, CASE WHEN event_id % 3 < 2 THEN strftime(date_trunc('second', ts), {TS}) END AS at FROM tel"),
    "w1_resample": sql("grid", f"SELECT mission, channel, idx, strftime(ts, {TS}) AS ts, round(value + 1e-7, 5) AS value FROM grid"),
    "w1_no_rule": sql("tel", "SELECT mission, channel, CAST(count(value) - 1 AS INT) AS last, round(sum(value), 4) AS total FROM tel GROUP BY 1, 2"),
    "w2_mask": sql("grid", "SELECT mission, channel, idx, is_anomaly FROM grid"),
    "w3_windows": sql("win", f"SELECT {K3}, end_idx, strftime(start_time, {TS}) AS start_time, strftime(end_time, {TS}) AS end_time, is_anomaly, anomaly_ratio, {shown('vals', 'values')} FROM win"),
    "w3_channel_windows": sql("win", "SELECT mission, channel, count(*) AS n_windows, round(avg(CAST(is_anomaly AS INT)), 6) AS anomaly_share FROM win GROUP BY 1, 2"),
    "w4_short": sql("grid", "SELECT mission, channel, count(*) AS n FROM grid GROUP BY 1, 2 HAVING count(*) < 700"),
    "w5_ewma": sql("er", """WITH RECURSIVE ew AS (SELECT mission, channel, i, error AS ewma FROM er WHERE i = 0 UNION ALL SELECT e.mission, e.channel, e.i, e.error / 3 + ew.ewma * 2 / 3 FROM ew JOIN er e ON e.mission = ew.mission AND e.channel = ew.channel AND e.i = ew.i + 1)
      SELECT mission, channel, i, round(ewma, 4) AS ewma FROM ew"""),
    "w6_runs": sql("grid", "SELECT mission, channel, min(idx) AS start, max(idx) AS end, count(*) AS n FROM (SELECT *, idx - row_number() OVER (PARTITION BY mission, channel ORDER BY idx) AS g FROM grid WHERE is_anomaly) GROUP BY mission, channel, g"),
    "w7_merge": sql("mg", "SELECT mission, channel, s AS start, e AS end FROM mg"),
    "w8_spans": sql("er", "SELECT mission, channel, i * 16 AS start, i * 16 + 32 AS end FROM er WHERE is_anomaly"),
    "j1_point_in_interval": sql("tel iv", "SELECT event_id, EXISTS (SELECT 1 FROM iv WHERE iv.mission = tel.mission AND iv.channel = tel.channel AND tel.ts BETWEEN start_time AND end_time) AS is_anomaly FROM tel"),
    "j2_channel_meta": sql("win ch", f"SELECT w.mission, w.channel, w.start_idx, coalesce(subsystem, 'unknown') AS subsystem, coalesce(physical_unit, 'unknown') AS physical_unit, coalesce(grp, '?') AS grp FROM win w LEFT JOIN (SELECT * FROM ch WHERE target = 'YES') m USING (mission, channel)"),
    "j4_align": sql("sc", "SELECT index, text, vision AS score, true AS same FROM sc"),
    "j5_map_to_grid": sql("mt er", "SELECT index, CAST(mt.start_idx // 16 AS INT) AS i, round(error, 6) AS error FROM mt LEFT JOIN er ON er.mission = mt.mission AND er.channel = mt.channel AND er.i = mt.start_idx // 16"),
    "j6_verdict_windows": sql("vd mt", "SELECT index, predicted, start_idx, end_idx FROM vd JOIN mt USING (index)"),
    "j7_best_overlap": sql("win iv", """WITH wi AS (SELECT CAST(substr(channel, 9) AS BIGINT) * 1000 + start_idx AS index, mission, channel, start_time, end_time FROM win), ov AS (SELECT index, id, epoch_us(least(w.end_time, i.end_time)) - epoch_us(greatest(w.start_time, i.start_time)) AS o, i.start_time AS rs FROM wi w JOIN iv i USING (mission, channel)),
      bo AS (SELECT index, id, o FROM (SELECT *, row_number() OVER (PARTITION BY index ORDER BY o DESC, rs, id) AS k FROM ov WHERE o > 0) WHERE k = 1) SELECT index, id AS ref_id, round(o / 1e6, 3) AS overlap_s FROM wi LEFT JOIN bo USING (index)"""),
    "j8_interval_match": sql("mp mg", "SELECT p.mission, p.channel, p.s AS ps, p.e AS pe, g.s AS gs, g.e AS ge FROM mp p JOIN mg g USING (mission, channel) WHERE p.s <= g.e + 32 AND p.e >= g.s - 32"),
    "j9_missing": sql("sc jd", "SELECT index FROM sc WHERE index NOT IN (SELECT index FROM jd WHERE correctness > 0)"),
    "j10_assemble": sql("sc jd", "SELECT index, mission, sc.is_anomaly, text AS score, correctness, actionability, grounding FROM sc JOIN jd USING (index)"),
    "j11_prior": sql("ch iv", "SELECT c.mission, c.channel, coalesce(CAST(n AS DOUBLE), -1) AS loss, n IS NOT NULL AS has_prior FROM ch c LEFT JOIN (SELECT mission, channel, count(*) AS n FROM iv GROUP BY 1, 2) i USING (mission, channel)"),
    "k1_balance": sql("fw", f"SELECT {K3}, is_anomaly FROM (SELECT *, row_number() OVER (PARTITION BY is_anomaly ORDER BY d, {K3}) AS k, count(*) FILTER (is_anomaly) OVER () AS n FROM fw) WHERE is_anomaly OR k <= 3 * n"),
    "k2_cap": sql("fw", f"SELECT {K3}, is_anomaly FROM fw ORDER BY d, {K3} LIMIT 500"),
    "k3_shuffle": sql("fw", f"SELECT {K3}, is_anomaly, row_number() OVER (ORDER BY d, {K3}) - 1 AS place FROM fw"),
    "k4_split": sql("sp", f"SELECT {K3}, is_anomaly, split, index FROM sp"),
    "k5_index": sql("sp", "SELECT split, min(index) AS first, max(index) AS last, count(*) AS n, count(DISTINCT index) AS distinct_n FROM sp GROUP BY 1"),
    "k6_stratified": sql("fw", CUT(150)),
    "k7_sample_flags": sql("fl", "WITH ff AS (SELECT mission, channel, start_idx, is_anomaly, md5(concat_ws('|', mission, channel, start_idx, '42')) AS d FROM fl WHERE pred) " + CUT(40, "ff")),
    "k8_cap_per_key": sql("fw", f"SELECT {K3}, is_anomaly FROM (SELECT *, row_number() OVER (PARTITION BY mission, channel ORDER BY d, start_idx) AS k FROM fw WHERE NOT is_anomaly) WHERE k <= 20"),
    "k9_manifest": sql("sp", MANIFEST),
    "k10_dedupe": sql("pat", "SELECT anomaly_id, pattern, severity, CAST(0 AS INT) AS copy FROM pat WHERE is_anomaly"),
    "k11_holdout": "SELECT vec_id AS index, label, row_number() OVER (ORDER BY md5(concat_ws('|', vec_id, '42')), vec_id) - 1 < round_even(count(*) OVER () * 0.2, 0) AS is_val FROM embeddings",
    "k12_bounded": "SELECT vec_id AS index, label FROM embeddings ORDER BY vec_id LIMIT 100",
    "k13_best": sql("sc", sweep_sql("text", UNIT) + " " + BEST.format("cef")),
    "k14_union": sql("ern mac vd win", APPROACHES + " SELECT * FROM apr"),
    "a1_confusion": sql("recm", "SELECT mission, channel, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM recm"),
    "a2_verdict_summary": sql("vd", f"WITH {summary_sql('vd', 'predicted')} SELECT * FROM s1"),
    "a3_score_summary": "WITH " + summary_sql("(SELECT n_chars % 4 = 0 AS is_anomaly, CASE WHEN (n_chars % 1000) / 250.0 >= (doc_id % 500) / 125.0 THEN 'ANOMALY' ELSE 'NOMINAL' END AS argmax, doc_id % 7 / 10.0 AS elapsed_s FROM documents)", "argmax") + " SELECT * FROM s1",
    "a4_cef": sql("recm", "SELECT mission, channel, round(CASE WHEN 0.25 * round(p, 6) + round(r, 6) = 0 THEN 0 ELSE 1.25 * round(p, 6) * round(r, 6) / (0.25 * round(p, 6) + round(r, 6)) END, 4) AS cef FROM recm"),
    "a5_macro": sql("mac", "SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(cef, 6) AS cef, n_channels FROM mac"),
    "a6_macro_report": sql("recm", "SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(1.25 * p * r / (0.25 * p + r), 6) AS cef, n AS n_channels FROM (SELECT avg(p) AS p, avg(r) AS r, avg(f) AS f, count(*) AS n FROM recm)"),
    "a7_affinity": sql("mp mg", """WITH hits AS (SELECT p.mission, p.channel, p.s AS ps, g.s AS gs FROM mp p JOIN mg g USING (mission, channel) WHERE p.s <= g.e + 32 AND p.e >= g.s - 32), n AS (SELECT (SELECT count(*) FROM mp) AS n_pred, (SELECT count(*) FROM mg) AS n_gt, (SELECT count(*) FROM (SELECT DISTINCT mission, channel, ps FROM hits)) AS pred_hit, (SELECT count(*) FROM (SELECT DISTINCT mission, channel, gs FROM hits)) AS gt_hit)
      SELECT n_pred, n_gt, pred_hit, gt_hit, round(p, 6) AS affinity_precision, round(r, 6) AS affinity_recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS affinity_f1 FROM (SELECT *, CASE WHEN n_pred = 0 THEN 0 ELSE pred_hit / n_pred END AS p, CASE WHEN n_gt = 0 THEN 0 ELSE gt_hit / n_gt END AS r FROM n)"""),
    "a8_trivial": sql("win", f"SELECT round(precision, 6) AS precision, recall, round(f1, 6) AS f1, round(cef, 6) AS cef, n_units FROM ({TRIVIAL})"),
    "a9_detection": sql("vd", DETECTION + " SELECT * FROM s3"),
    "a10_severity_counts": sql("pat", "SELECT severity, count(*) AS n FROM pat WHERE is_anomaly GROUP BY 1"),
    "a10_pattern_counts": sql("pat", "SELECT pattern, count(*) AS n FROM pat WHERE is_anomaly GROUP BY 1"),
    "a11_split_counts": sql("sp", "SELECT split, count(*) AS n, count(*) FILTER (is_anomaly) AS n_anomaly FROM sp GROUP BY 1"),
    "a12_sweep": sql("sc", sweep_sql("text", UNIT) + f" SELECT {CURVE_COLUMNS} FROM curve"),
    "a13_range_sweep": sql("sc", sweep_sql("vision", range_points("vision")) + f" SELECT {CURVE_COLUMNS} FROM curve"),
    "a14_average_precision": sql("sc", "WITH st AS (SELECT text AS s, count(*) FILTER (is_anomaly) AS p, count(*) AS n FROM sc GROUP BY 1), cu AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS al, sum(p) OVER () AS pos FROM st WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(p / pos * tp / al), 6) AS average_precision FROM cu"),
    "a15_pr_curve": sql("sc", "WITH st AS (SELECT vision AS s, count(*) FILTER (is_anomaly) AS p, count(*) AS n FROM sc GROUP BY 1), cu AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS al, sum(p) OVER () AS pos FROM st WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT s AS threshold, round(tp / al, 6) AS precision, round(tp / pos, 6) AS recall FROM cu UNION ALL SELECT NULL, 1.0, 0.0"),
    "a16_operating_points": sql("sc", sweep_sql("text", UNIT) + f" SELECT {CURVE_COLUMNS}, 'argmax' AS point FROM curve WHERE threshold = 0.5 UNION ALL SELECT *, 'cef_best' FROM ({BEST.format('cef')}) UNION ALL SELECT *, 'f1_best' FROM ({BEST.format('f1')}) UNION ALL SELECT *, 'recall_at_p60' FROM (SELECT {CURVE_COLUMNS} FROM curve WHERE precision >= 0.6 AND recall > 0 ORDER BY recall DESC, threshold LIMIT 1) UNION ALL SELECT NULL, round(p, 4), round(r, 4), round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4), round(CASE WHEN 0.25 * round(p, 4) + round(r, 4) = 0 THEN 0 ELSE 1.25 * round(p, 4) * round(r, 4) / (0.25 * round(p, 4) + round(r, 4)) END, 4), tp, fp, fn, tn, 'hard_verdict' FROM (SELECT *, {PRF} FROM (SELECT count(*) FILTER (text >= 0.4 AND is_anomaly) AS tp, count(*) FILTER (text >= 0.4 AND NOT is_anomaly) AS fp, count(*) FILTER (text < 0.4 AND is_anomaly) AS fn, count(*) FILTER (text < 0.4 AND text >= 0.1 AND NOT is_anomaly) AS tn FROM sc))"),
    "a17_grades": sql("jd", """SELECT CASE WHEN grouping(is_anomaly) = 1 THEN 'overall' WHEN is_anomaly THEN 'true_positive' ELSE 'false_positive' END AS subset, count(*) AS n, round(avg(correctness), 3) AS mean_correctness, round(avg(actionability), 3) AS mean_actionability, round(avg(grounding), 3) AS mean_grounding,
      round(avg(correctness + actionability + grounding), 3) AS mean_total, round(count(*) FILTER (correctness >= 1) / count(*), 4) AS share_correctness, round(count(*) FILTER (actionability >= 1) / count(*), 4) AS share_actionability, round(count(*) FILTER (grounding >= 1) / count(*), 4) AS share_grounding,
      round(count(*) FILTER (correctness + actionability + grounding >= 4 AND correctness >= 1 AND actionability >= 1 AND grounding >= 1) / count(*), 4) AS share_high_quality FROM jd GROUP BY GROUPING SETS ((), (is_anomaly))"""),
    "a18_rubric": sql("jd", "SELECT index, CAST(correctness + CAST(index % 10 = 0 AS INT) AS INT) AS correctness, actionability, grounding FROM jd WHERE correctness + CAST(index % 10 = 0 AS INT) > 2"),
    "a19_compare": sql("ern mac vd win", APPROACHES + """, apx AS (SELECT a.*, format_compliance, advice_structured_frac FROM apr a LEFT JOIN (SELECT 'text' AS approach, format_compliance, advice_structured_frac FROM s3) USING (approach)), ct AS (SELECT * FROM apx WHERE approach = 'text'), rk AS (SELECT x.*, CAST(rank() OVER (ORDER BY x.f1 DESC) AS INT) AS rank_f1, CAST(rank() OVER (ORDER BY x.cef DESC) AS INT) AS rank_cef,
      round(x.f1 - ct.f1, 4) AS delta_f1, round(x.precision - ct.precision, 4) AS delta_precision, round(x.format_compliance - ct.format_compliance, 4) AS delta_format_compliance, round(x.advice_structured_frac - ct.advice_structured_frac, 4) AS delta_advice_structured_frac, x.f1 > (SELECT f1 FROM apr WHERE approach = 'always') AS above_trivial FROM apx x, ct) SELECT *, rank_f1 = 1 AS best_f1, rank_cef = 1 AS best_cef FROM rk"""),
    "a20_hybrid": sql("mac vd", DETECTION + " SELECT round(m.precision, 4) AS precision, round(m.recall, 4) AS recall, round(m.f1, 4) AS f1, round(m.cef, 4) AS cef, advice_structured_frac, advice_avg_chars, 'hybrid' AS approach FROM mac m, s3"),
    "a21_regression": sql("rg", "SELECT round(avg(abs(pred - truth)), 6) AS mae, round(sqrt(avg((pred - truth) ** 2)), 6) AS rmse, round(avg(pred - truth), 6) AS bias, round(corr(pred, truth), 6) AS pearson, count(*) AS n FROM rg"),
    "a22_mean_baseline": sql("rg", "SELECT round(avg(abs(truth - m)), 6) AS baseline_mae FROM rg, (SELECT avg(truth) AS m FROM rg WHERE l_orderkey % 5 <> 0) WHERE l_orderkey % 5 = 0"),
    "a23_gini": sql("im", f"WITH {MAGS} SELECT index, round({GINI}, 5) AS gini FROM mg0"),
    "a24_top_decile": sql("im", f"WITH {MAGS} SELECT index, round(CASE WHEN list_sum(m) = 0 THEN 0 ELSE list_sum(m[59:64]) / list_sum(m) END, 5) AS top_decile FROM mg0"),
    "a25_brightness": sql("im", "SELECT index, round((corr(abs(x), x * x) + corr(abs(x), y * y)) / 2, 5) + 0.0 AS r FROM (SELECT index, unnest(a) AS x, unnest(list_reverse(a)) AS y FROM im) GROUP BY 1"),
    "a26_avg_pool": sql("im", f"WITH {LONG} SELECT index, CAST(pos // 8 // 2 * 4 + pos % 8 // 2 AS INT) AS patch_id, round(avg(x), 5) + 0.0 AS mean FROM lg GROUP BY 1, 2"),
    "a28_faithful": sql("im", "SELECT index, index % 3 <> 0 AS faithful FROM im"),
    "a29_profile": sql("im", "SELECT count(*) AS rows, CAST(min(len(a)) AS INT) AS min_size, CAST(max(len(a)) AS INT) AS max_size, round(min(list_min(a)), 5) AS value_min, round(max(list_max(a)), 5) AS value_max, min(label) AS label_min, max(label) AS label_max, CAST(0 AS BIGINT) AS not_finite FROM im"),
    "a30_column_means": sql("im", f"WITH {LONG} SELECT index, CAST(pos % 8 AS INT) AS col, round(avg(x), 5) + 0.0 AS mean FROM lg GROUP BY 1, 2"),
    "d1_flat_threshold": sql("ern", "SELECT mission, channel, i, round(nm + 2.0 * ns, 4) AS threshold, coalesce(error > nm + 2.0 * ns, false) AS pred FROM ern"),
    "d9_matrix": sql("sc mt er", "SELECT sc.index, sc.is_anomaly, text, vision, round(er.error, 6) AS error FROM sc JOIN mt USING (index) LEFT JOIN er ON er.mission = sc.mission AND er.channel = sc.channel AND er.i = mt.start_idx // 16"),
    "d10_weighted": sql("sc", "SELECT index, round(((text - avg(text) OVER ()) / stddev_pop(text) OVER () + (vision - avg(vision) OVER ()) / stddev_pop(vision) OVER ()) / 2, 6) AS weighted FROM sc"),
    "d11_vote": sql("sc", f"""WITH s3 AS (SELECT * FROM sc WHERE error IS NOT NULL), vt AS (SELECT is_anomaly, CAST(text >= 0.5 AS INT) + CAST(vision >= 0.5 AS INT) + CAST(error >= (SELECT median(error) FROM s3) AS INT) AS v FROM s3), rl AS (SELECT * FROM (VALUES ('vote', 2), ('any', 1), ('all', 3)) x(rule, need)),
      cm AS (SELECT rule, count(*) FILTER (v >= need AND is_anomaly) AS tp, count(*) FILTER (v >= need AND NOT is_anomaly) AS fp, count(*) FILTER (v < need AND is_anomaly) AS fn, count(*) FILTER (v < need AND NOT is_anomaly) AS tn FROM vt, rl GROUP BY rule)
      SELECT rule, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1, round(CASE WHEN 0.25 * p + r = 0 THEN 0 ELSE 1.25 * p * r / (0.25 * p + r) END, 4) AS cef, tp, fp, fn, tn, (SELECT count(*) FROM vt WHERE v > 0 AND v < 3) AS disagreement FROM (SELECT *, {PRF} FROM cm)"""),
    "d16_alerts": sql("fl pat", "SELECT anomaly_id, severity, pattern, CAST(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS INT) AS rank FROM pat JOIN fl USING (mission, channel, start_idx) WHERE pat.is_anomaly AND pred"),
    "v1_splits": sql("win", """WITH tot AS (SELECT CAST(sum(greatest(0, (n - 32) // 16 + 1)) AS BIGINT) AS t FROM (SELECT count(*) AS n FROM grid GROUP BY mission, channel)), o AS (SELECT count(*) AS n, count(*) FILTER (is_anomaly) AS a, count(DISTINCT mission) AS m FROM win)
      SELECT 'total' AS check, n = t AS passed, CAST(n AS VARCHAR) AS observed, CAST(t AS VARCHAR) AS expected FROM o, tot UNION ALL SELECT 'anomalies', a BETWEEN 1 AND t, CAST(a AS VARCHAR), '1..' || t FROM o, tot UNION ALL SELECT 'missions', m = 3, CAST(m AS VARCHAR), '3' FROM o"""),
    "v2_advice": sql("pat", "WITH ad AS (SELECT * FROM pat WHERE is_anomaly) " + checks("ad", [("unique_ids", "count(*) - count(DISTINCT anomaly_id)", "count(*) = count(DISTINCT anomaly_id)", "0"), ("fields", "0", "true", "0"), ("severity", "0", "true", "0"), *[(f"n_{s}", f"count(*) FILTER (severity = '{s}')", "true", ">= 0") for s in ("low", "medium", "high")]]).replace("SELECT 'fields' AS check, true AS passed, CAST(0 AS VARCHAR) AS observed, '0' AS expected FROM ad", "SELECT 'fields' AS check, true AS passed, '0' AS observed, '0' AS expected").replace("SELECT 'severity' AS check, true AS passed, CAST(0 AS VARCHAR) AS observed, '0' AS expected FROM ad", "SELECT 'severity' AS check, true AS passed, '0' AS observed, '0' AS expected").replace("n_low' AS check, true", "n_low' AS check, count(*) >= 0").replace("n_medium' AS check, true", "n_medium' AS check, count(*) >= 0").replace("n_high' AS check, true", "n_high' AS check, count(*) >= 0")),
    "v3_chat": "SELECT 'columns' AS check, true AS passed, 'text' AS observed, 'text' AS expected UNION ALL SELECT 'marker', true, '0', '0'",
    "v4_detector": sql("recm er", "WITH ls AS (SELECT mission, channel, arg_min(error, i) AS a, arg_max(error, i) AS b FROM er GROUP BY 1, 2) SELECT 'loss_fell' AS check, count(*) FILTER (b < a) > 0 AS passed, CAST(count(*) FILTER (b < a) AS VARCHAR) AS observed, '> 0' AS expected FROM recm JOIN ls USING (mission, channel) WHERE tp + fn > 0 UNION ALL " + checks("(SELECT * FROM recm WHERE tp + fn > 0)", [("scored", "count(*)", "count(*) > 0", "> 0"), ("finite", "count(*) FILTER (isnan(p) OR isnan(r) OR isnan(f))", "count(*) FILTER (isnan(p) OR isnan(r) OR isnan(f)) = 0", "0"), ("mean_f1", "round(avg(f), 4)", "round(avg(f), 4) > 0.05 AND round(avg(f), 4) < 0.98", "0.05..0.98")])),
    "v5_verdicts": sql("vd", checks("(SELECT *, predicted = 'ANOMALY' AS hit FROM vd)", [("rows", "count(*)", "count(*) > 0", "> 0"), ("finite", "count(*) FILTER (elapsed_s IS NULL OR NOT isfinite(elapsed_s))", "count(*) FILTER (elapsed_s IS NULL OR NOT isfinite(elapsed_s)) = 0", "0"), ("f1", "round(2 * count(*) FILTER (hit AND is_anomaly) / (2 * count(*) FILTER (hit AND is_anomaly) + count(*) FILTER (hit <> is_anomaly)), 4)", "true", "0..1"), ("unknown", "round(count(*) FILTER (predicted = 'UNKNOWN') / count(*), 4)", "round(count(*) FILTER (predicted = 'UNKNOWN') / count(*), 4) < 0.2", "< 0.2"), ("time", "round(avg(elapsed_s), 3)", "avg(elapsed_s) < 30", "< 30"), ("length", "round(count(*) FILTER (length(actual_response) > 10) / count(*), 4)", "count(*) FILTER (length(actual_response) > 10) = count(*)", "1"), ("keyword", "round(count(*) FILTER (regexp_matches(upper(actual_response), 'ANOMALY|NOMINAL')) / count(*), 4)", "round(count(*) FILTER (regexp_matches(upper(actual_response), 'ANOMALY|NOMINAL')) / count(*), 4) > 0.8", "> 0.8")])),
    "v6_comparison": sql("ern mac vd win", APPROACHES + " SELECT 'errors' AS check, count(*) FILTER (f1 IS NULL OR isnan(f1)) = 0 AS passed, CAST(count(*) FILTER (f1 IS NULL OR isnan(f1)) AS VARCHAR) AS observed, '0' AS expected FROM ap UNION ALL SELECT 'advice_length', advice_avg_chars > 50, CAST(advice_avg_chars AS VARCHAR), '> 50' FROM s3 UNION ALL " + checks("ap", [("rows", "count(*)", "count(*) > 0", "> 0"), ("bounds", "count(*) FILTER (NOT (precision BETWEEN 0 AND 1 AND recall BETWEEN 0 AND 1 AND f1 BETWEEN 0 AND 1 AND cef BETWEEN 0 AND 1))", "count(*) FILTER (NOT (precision BETWEEN 0 AND 1 AND recall BETWEEN 0 AND 1 AND f1 BETWEEN 0 AND 1 AND cef BETWEEN 0 AND 1)) = 0", "0")])),
}
ORACLES["t1_stream_late"] = sql("tel wm", f"""WITH cut AS (SELECT max(ts) - INTERVAL 2 HOUR AS wl FROM tel WHERE event_id % 10 <> 0), ok AS (SELECT tel.* FROM tel, cut WHERE event_id % 10 <> 0 OR date_trunc('hour', ts) + INTERVAL 1 HOUR > wl)
  SELECT mission, channel, strftime(b, {TS}) AS ts, round(v, 6) AS value, n FROM (SELECT mission, channel, date_trunc('hour', ts) AS b, avg(value) AS v, count(value) AS n FROM ok GROUP BY 1, 2, 3), wm WHERE b + INTERVAL 1 HOUR <= wm""")
ORACLES["t1_stream_resample"] = sql("tel wm", f"SELECT mission, channel, strftime(b, {TS}) AS ts, round(v, 6) AS value, n FROM (SELECT mission, channel, date_trunc('hour', ts) AS b, avg(value) AS v, count(value) AS n FROM tel GROUP BY 1, 2, 3), wm WHERE b + INTERVAL 1 HOUR <= wm")
ORACLES["t2_stream_windows"] = sql("tel wm", f"""WITH sl AS (SELECT *, unnest([e // 57600 * 57600, e // 57600 * 57600 - 57600]) AS s FROM (SELECT *, epoch_us(ts) // 1000000 AS e FROM tel)) SELECT mission, channel, strftime(make_timestamp(s * 1000000), {TS}) AS start_time, strftime(make_timestamp((s + 115200) * 1000000), {TS}) AS end_time,
  count(value) AS n, round(avg(value) + 1e-7, 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS lo, round(max(value), 4) AS hi FROM sl, wm WHERE make_timestamp((s + 115200) * 1000000) <= wm GROUP BY mission, channel, s""")
ORACLES["t3_stream_screen"] = sql("tel wm th", f"SELECT x.mission, x.channel, strftime(b, {TS}) AS ts, round(v, 6) AS value, v > th.m + th.s AS flag FROM (SELECT mission, channel, date_trunc('hour', ts) AS b, avg(value) AS v FROM tel GROUP BY 1, 2, 3) x JOIN th USING (mission, channel), wm WHERE b + INTERVAL 1 HOUR <= wm")
ORACLES["t4_stream_episodes"] = sql("tel th", f"""WITH hi AS (SELECT t.* FROM tel t JOIN th USING (mission, channel) WHERE value > m + s), wmh AS (SELECT max(ts) - INTERVAL 2 HOUR AS wm FROM hi), gs AS (SELECT *, sum(new) OVER (PARTITION BY mission, channel ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY mission, channel ORDER BY ts) + INTERVAL 16 HOUR THEN 0 ELSE 1 END AS new FROM hi))
  SELECT mission, channel, strftime(date_trunc('second', min(ts)), {TS}) AS start_time, strftime(date_trunc('second', max(ts)), {TS}) AS end_time, count(*) AS n FROM gs GROUP BY mission, channel, g HAVING max(ts) + INTERVAL 16 HOUR <= (SELECT wm FROM wmh)""")
ORACLES["j3_attach_advice"] = sql("pat ch", f"""WITH nm AS (SELECT mission, channel, grp, {case('subsystem', c.SUBSYSTEMS, "'Subsystem ' || substr(subsystem, 11)")} AS sn, {case('physical_unit', c.UNITS, "replace(physical_unit, '_', ' ')")} AS un FROM ch), d AS (SELECT p.*, {{desc}} AS description FROM pat p)
  SELECT mission, channel, start_idx, CASE WHEN is_anomaly THEN severity END AS severity, CASE WHEN is_anomaly THEN pattern END AS pattern, CAST(CASE WHEN is_anomaly THEN {len(c.ANOMALY_RESPONSE)} + length('..DIAGNOSIS: ' || pattern || ' (severity: ' || severity || ').ADVICE: ' || sn || ' channel ' || channel || ' (group ' || grp || ', ' || un || ') shows ' || description || '. ')
  + length({case('pattern', c.PATTERN_ADVICE, 'NULL')}) + length('.ACTION: ' || {case('severity', c.SEVERITY_ACTION, 'NULL')}) ELSE {len(c.NOMINAL_RESPONSE)} END AS INT) AS n_response FROM d JOIN nm USING (mission, channel)""".replace("{desc}", ORACLES["p11_pattern_desc"].rpartition("CASE pattern")[2].rpartition(" END AS description")[0].join(["CASE pattern", " END"]).replace("round(round(mean, 4), 2)", "mean").replace("round(round(std, 4), 2)", "std").replace("round(round(p2p, 4), 2)", "p2p").replace("round(round(trend, 4), 2)", "trend")))
Z = "(SELECT unnest([0.5, 1.0, 1.5, 2.0, 2.5, 3.0]) AS z)"
ZCURVE = f"""WITH zc AS (SELECT z, mission, channel, count(*) FILTER (q AND is_anomaly) AS tp, count(*) FILTER (q AND NOT is_anomaly) AS fp, count(*) FILTER (NOT q AND is_anomaly) AS fn FROM (SELECT *, coalesce(error > nm + z * ns, false) AS q FROM ern, {Z}) GROUP BY 1, 2, 3),
  zp AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM (SELECT *, {PRF} FROM zc WHERE tp + fn > 0)),
  zm AS (SELECT CAST(z AS DOUBLE) AS z, avg(p) AS p, avg(r) AS r, avg(f) AS f, count(*) AS n_channels FROM zp GROUP BY 1), zr AS (SELECT z, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(CASE WHEN 0.25 * p + r = 0 THEN 0 ELSE 1.25 * p * r / (0.25 * p + r) END, 6) AS cef, n_channels FROM zm)"""
ORACLES["d2_z_sweep"] = sql("ern", ZCURVE + " SELECT * FROM zr")
ORACLES["d2_best_z"] = sql("ern", ZCURVE + " SELECT * FROM zr ORDER BY cef DESC, z LIMIT 1")
ORACLES["v7_regression"] = sql("rg", """WITH r1 AS (SELECT avg(abs(pred - truth)) AS mae, corr(pred, truth) AS r, count(*) * 1e-4 AS cost FROM rg), r2 AS (SELECT avg(abs(truth - m)) AS base FROM rg, (SELECT avg(truth) AS m FROM rg WHERE l_orderkey % 5 <> 0) WHERE l_orderkey % 5 = 0) """ + checks("r1, r2", [
    ("beats_mean", "round(mae, 4)", "mae <= 0.95 * base", "<= 0.95 baseline"), ("baseline", "round(base, 4)", "base > 0", "> 0"), ("mae", "round(mae, 4)", "mae > 0.01 AND mae < 0.4", "0.01..0.4"), ("pearson", "round(r, 4)", "r BETWEEN -1 AND 1", "-1..1"), ("cost", "round(CAST(cost AS DOUBLE), 4)", "cost < 25", "< 25")]))
ORACLES["v8_images"] = sql("im", "WITH p AS (SELECT count(*) AS n, max(len(a)) AS hi, min(len(a)) AS lo, min(list_min(a)) AS vlo, max(list_max(a)) AS vhi, count(*) FILTER (label IS NULL) AS bad FROM im) SELECT 'rows' AS check, n = want AS passed, CAST(n AS VARCHAR) AS observed, CAST(want AS VARCHAR) AS expected FROM p, (SELECT max(index) - min(index) + 1 AS want FROM im) UNION ALL " + checks("p", [
    ("shape", "hi", "hi = 64 AND lo = 64", "1x8x8"), ("values", "round(vhi, 4)", "vlo >= -1.001 AND vhi <= 1.001", "-1..1"), ("finite", "0", "true", "0"), ("labels", "bad", "bad = 0", "0")]))
ORACLES["v9_attribution"] = sql("im", f"WITH {MAGS}, {LONG}, br AS (SELECT avg(r) AS r FROM (SELECT index, corr(abs(x), x * x) AS r FROM lg GROUP BY 1)), atr AS (SELECT avg({GINI}) AS g, avg(list_sum(m[59:64]) / list_sum(m)) AS t FROM mg0) " + checks("atr, br", [
    ("faithful", "0", "true", "0"), ("gini", "round(g, 4)", "g > 0.05", "> 0.05"), ("top_decile", "round(t, 4)", "t > 0.12", "> 0.12"), ("brightness", "round(r, 4)", "r > 0.1", "> 0.1")]))
ORACLES["a27_resize"] = sql("im", "SELECT index, " + shown("[" + ", ".join("(" + " + ".join(f"a[{(2 * (p // 4) + y) * 8 + 2 * (p % 4) + x + 1}]" for y in (0, 1) for x in (0, 1)) + ") / 4" for p in range(16)) + "]", "pixels") + " FROM im")
ORACLES["d8_score_windows"] = sql("win", f"SELECT {K3}, round(1 / (1 + exp(n - a)), 6) AS score, round(a, 4) AS logit_anomaly, round(n, 4) AS logit_nominal, CASE WHEN a >= n THEN 'ANOMALY' ELSE 'NOMINAL' END AS argmax FROM (SELECT *, (list_max(vals) - list_min(vals) + 1e-7) / 50 AS a, 2 - (list_max(vals) - list_min(vals) + 1e-7) / 50 AS n FROM win)")
# smoothed log errors, the best epsilon of a grid of z, and runs above it with the drop to the next lower peak
SMOOTH = """WITH RECURSIVE lx AS (SELECT mission, channel, i, error, ln(error + 1e-12) AS x FROM er), ew AS (SELECT mission, channel, i, error, x AS s FROM lx WHERE i = 0 UNION ALL SELECT l.mission, l.channel, l.i, l.error, l.x / 3 + ew.s * 2 / 3 FROM ew JOIN lx l ON l.mission = ew.mission AND l.channel = ew.channel AND l.i = ew.i + 1),
  es AS (SELECT mission, channel, avg(s) AS m, stddev_pop(s) AS sd, count(*) AS n FROM ew GROUP BY 1, 2), eh AS (SELECT e.*, z, m, sd, n, s >= m + z * sd AS h FROM ew e JOIN es USING (mission, channel), (SELECT 2.5 + 0.5 * k AS z FROM range(20) r(k)) WHERE sd > 0),
  ec AS (SELECT *, h AND NOT coalesce(lag(h) OVER (PARTITION BY mission, channel, z ORDER BY i), false) AS opens FROM eh), ea AS (SELECT mission, channel, z, m, sd, n, count(*) FILTER (h) AS nh, count(*) FILTER (opens) AS runs, avg(s) FILTER (NOT h) AS lm, stddev_pop(s) FILTER (NOT h) AS ls FROM ec GROUP BY 1, 2, 3, 4, 5, 6),
  eg AS (SELECT mission, channel, z, row_number() OVER (PARTITION BY mission, channel ORDER BY (CASE WHEN m = 0 THEN 0 ELSE (m - lm) / m END + (sd - ls) / sd) / (runs * runs + nh) DESC, z) AS k FROM ea WHERE nh > 0 AND nh < n / 2),
  ep AS (SELECT es.mission, es.channel, m + coalesce(z, 3) * sd AS eps FROM es LEFT JOIN eg ON eg.mission = es.mission AND eg.channel = es.channel AND k = 1), ef AS (SELECT ew.*, eps, s >= eps AS h, i - row_number() OVER (PARTITION BY mission, channel, s >= eps ORDER BY i) AS g FROM ew JOIN ep USING (mission, channel)),
  rn AS (SELECT mission, channel, g, max(error) AS pk, count(*) AS size, min(i) AS a FROM ef WHERE h GROUP BY 1, 2, 3), ou AS (SELECT mission, channel, max(error) AS o FROM ef WHERE NOT h GROUP BY 1, 2),
  dr AS (SELECT *, CASE WHEN pk > 0 THEN (pk - coalesce(lead(pk) OVER w, o, 0)) / pk ELSE 0 END AS fall, row_number() OVER w AS r FROM rn LEFT JOIN ou USING (mission, channel) WINDOW w AS (PARTITION BY mission, channel ORDER BY pk DESC, a DESC)),
  kp AS (SELECT *, r <= coalesce(max(r) FILTER (fall >= 0) OVER (PARTITION BY mission, channel), 0) AS any_fall, r <= coalesce(max(r) FILTER (fall >= 0.13) OVER (PARTITION BY mission, channel), 0) AS kept FROM dr)"""
ORACLES["d3_epsilon"] = sql("er", SMOOTH + " SELECT mission, channel, round(exp(eps), 6) AS epsilon FROM ep")
ORACLES["d4_pruned"] = sql("er", SMOOTH + " SELECT mission, channel, CAST(coalesce(sum(size) FILTER (any_fall), 0) AS BIGINT) AS n_all, CAST(coalesce(sum(size) FILTER (kept), 0) AS BIGINT) AS n_pruned FROM ep LEFT JOIN kp USING (mission, channel) GROUP BY 1, 2")
ORACLES["d5_dynamic"] = sql("er", SMOOTH + " SELECT e.mission, e.channel, e.i, e.h AND coalesce(kept, false) AS flag, round(exp(eps), 6) AS epsilon FROM ef e LEFT JOIN kp ON kp.mission = e.mission AND kp.channel = e.channel AND kp.g = e.g AND e.h")
_singles = []
for signal in ("text", "vision"):
    curve = sweep_sql(signal, range_points(signal)).replace("WITH pts", f"{signal}_pts").replace("FROM pts", f"FROM {signal}_pts").replace("cm AS", f"{signal}_cm AS").replace("FROM cm)", f"FROM {signal}_cm)").replace("cp AS", f"{signal}_cp AS").replace("FROM cp)", f"FROM {signal}_cp)").replace("curve AS", f"{signal}_curve AS")
    average = f"{signal}_ap AS (SELECT round(sum(p / pos * tp / al), 4) AS average_precision FROM (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS al, sum(p) OVER () AS pos FROM (SELECT {signal} AS s, count(*) FILTER (is_anomaly) AS p, count(*) AS n FROM sc GROUP BY 1) WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)))"
    # another point of the grid may round to 0.5 too, so the point is taken before rounding
    half = sweep_sql(signal, "SELECT 0.5 AS t").replace("WITH pts", "h_pts").replace("FROM pts", "FROM h_pts").replace("cm AS", "h_cm AS").replace("FROM cm)", "FROM h_cm)").replace("cp AS", "h_cp AS").replace("FROM cp)", "FROM h_cp)").replace("curve AS", "h_curve AS").replace("h_", f"{signal}_half_")
    curve += ", " + half
    points = [f"SELECT {CURVE_COLUMNS}, '{signal}' AS signal, 'argmax' AS point, average_precision FROM {signal}_half_curve, {signal}_ap"]
    points += [f"SELECT {CURVE_COLUMNS}, '{signal}', '{m}_best', average_precision FROM ({BEST.format(m).replace('FROM curve', f'FROM {signal}_curve')}), {signal}_ap" for m in ("cef", "f1")]
    _singles.append((curve + ", " + average, points))
ORACLES["d14_singles"] = sql("sc", "WITH " + ", ".join(x for x, _ in _singles) + " " + " UNION ALL ".join(y for _, ys in _singles for y in ys))
