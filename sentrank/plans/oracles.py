"""SQL twins of the registered queries, for a cross-check in another engine."""

from ..constants import FEATURES

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"

ALERTS = f"""alerts AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS "timestamp",
         'agent-' || CAST(user_id % 5 AS VARCHAR) AS agent,
         event_type || '-' || CAST({_K} % 12 AS VARCHAR) AS rule_id,
         CAST(least(15, 1 + floor(value / 20)) AS INTEGER) AS rule_level,
         'dec-' || CAST({_K} % 11 AS VARCHAR) AS decoder
  FROM events)"""

RAW = f"""raw AS (
  SELECT 'evt-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS "_id",
         strftime(ts, '%b %d, %Y @ %H:%M:%S.%g') AS "_source.timestamp",
         'agent-' || CAST(user_id % 5 AS VARCHAR) AS "_source.agent.name",
         event_type || '-' || CAST({_K} % 12 AS VARCHAR) AS "_source.rule.id",
         CAST(CAST(least(15, 1 + floor(value / 20)) AS INTEGER) AS VARCHAR) AS "_source.rule.level",
         CASE WHEN {_K} % 8 <> 0 THEN 'dec-' || CAST({_K} % 11 AS VARCHAR) END AS "_source.decoder.name",
         CASE WHEN {_K} % 6 = 0 THEN '10.0.0.' || CAST({_K} AS VARCHAR) END AS "_source.data.srcip",
         CASE WHEN event_type = 'click' THEN CAST({_K} % 3 AS VARCHAR) END AS "_source.data.status"
  FROM events)"""
RAW_COLUMNS = ["_id", "_source.timestamp", "_source.agent.name", "_source.rule.id",
               "_source.rule.level", "_source.decoder.name", "_source.data.srcip", "_source.data.status"]

T1 = """t1 AS (SELECT * FROM alerts WHERE CAST("timestamp" AS DATE) <= DATE '2024-01-20')"""
T2 = """t2 AS (SELECT * FROM alerts
  WHERE CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-21' AND DATE '2024-01-25')"""

FORMULA = """level_stats AS (SELECT avg(rule_level) AS m, stddev_pop(rule_level) AS s FROM alerts),
pair AS (SELECT agent, rule_id, count(*) AS n FROM alerts GROUP BY ALL),
plain AS (
  SELECT a.*, 0.5 * (a.rule_level - l.m) / l.s
         + CASE WHEN hour(a."timestamp") <= 6 THEN 1.0 ELSE 0.0 END
         + 2.0 / (1.0 + p.n) AS s
  FROM alerts a CROSS JOIN level_stats l JOIN pair p ON a.agent = p.agent AND a.rule_id = p.rule_id),
lim AS (SELECT min(s) AS lo, max(s) AS hi FROM plain),
scored AS (
  SELECT p.event_id, p."timestamp", p.agent, p.rule_id, p.rule_level, p.decoder,
         CAST((p.s - l.lo) / (l.hi - l.lo + 1e-9) AS DOUBLE) AS anomaly_score
  FROM plain p CROSS JOIN lim l)"""

LABELLED = """labelled AS (
  SELECT *, CASE WHEN rule_level >= 8 AND hour("timestamp") <= 6 THEN 1 ELSE 0 END AS y,
         row_number() OVER (ORDER BY round(anomaly_score, 9) DESC, event_id) AS rnk FROM scored)"""


def _stats(keys: str = "agent") -> str:
    """Statistics frozen on t1."""
    return f"""gaps1 AS (
  SELECT (epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (PARTITION BY {keys} ORDER BY "timestamp", event_id))
         / 1e6 AS s FROM t1),
med AS (SELECT median(s) AS m FROM gaps1),
hs AS (SELECT agent, avg(rule_level) AS mu, coalesce(stddev_samp(rule_level), 0) AS sd FROM t1 GROUP BY agent),
cf AS (SELECT agent, rule_id, CAST(floor(hour("timestamp") / 2) * 2 AS INTEGER) AS hb, count(*) AS cnt
       FROM t1 GROUP BY ALL)"""


def _apply(rows: str, keys: str = "agent") -> str:
    """Features of ``rows`` from the frozen statistics."""
    return f"""base_{rows} AS (
  SELECT t.*, CAST(hour("timestamp") AS INTEGER) AS hour_local,
         CASE WHEN hour("timestamp") <= 6 THEN 1 ELSE 0 END AS is_off_hours,
         CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
         CASE WHEN isodow("timestamp") >= 6 THEN 1 ELSE 0 END AS is_weekend,
         CAST(minute("timestamp") * 60 + second("timestamp") AS INTEGER) AS second_in_hour,
         CAST(minute("timestamp") AS INTEGER) AS seconds_in_hour_bucketed,
         CAST(floor(hour("timestamp") / 2) * 2 AS INTEGER) AS hour_bucket,
         greatest(coalesce((epoch_us("timestamp") - lag(epoch_us("timestamp"))
           OVER (PARTITION BY {keys} ORDER BY "timestamp", event_id)) / 1e6, (SELECT m FROM med)), 0.0)
           AS rule_time_since_last_host
  FROM {rows} t),
feat_{rows} AS (
  SELECT b.*, coalesce((b.rule_level - hs.mu) / nullif(hs.sd, 0), 0.0) AS rule_level_z_host,
         ln(1 + b.rule_time_since_last_host) AS rule_time_since_last_host_log1p,
         CAST(('0x' || right(md5(b.agent || '||' || b.rule_id || '||' || CAST(b.hour_bucket AS VARCHAR)), 8)) AS UBIGINT)
           / 4294967295.0 AS agent_rule_hour_hash01,
         ln(1 + coalesce(cf.cnt, 0)) AS agent_rule_hour_freq_log1p
  FROM base_{rows} b LEFT JOIN hs ON b.agent = hs.agent
  LEFT JOIN cf ON b.agent = cf.agent AND b.rule_id = cf.rule_id AND b.hour_bucket = cf.hb),
full_{rows} AS (
  SELECT *, rule_time_since_last_host_log1p * rule_level AS recency_x_rule_level,
         CAST(is_off_hours * rule_level AS DOUBLE) AS offhours_x_rule_level,
         is_off_hours * rule_level_z_host AS offhours_x_rule_level_z,
         is_weekend * rule_level_z_host AS weekend_x_rule_level_z
  FROM feat_{rows})"""


def _features(rows: str) -> str:
    return f"{_stats()}, {_apply(rows)}"


def _rounded(names: list[str]) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


_AT = FEATURES.index("rule_level")
INT_FEATURES = FEATURES[:_AT]
REAL_FEATURES = [*FEATURES[_AT + 1:], "rule_time_since_last_host"]


def oracle_sql() -> dict[str, str]:
    w = f"WITH {ALERTS}"
    out: dict[str, str] = {}

    # formula score and slices
    score_cols = "event_id, agent, rule_id, rule_level, round(anomaly_score, 6) AS anomaly_score"
    out["formula_score"] = f"{w}, {FORMULA} SELECT {score_cols} FROM scored"
    out["topk_formula_score"] = f"""{w}, {FORMULA}, {LABELLED}
SELECT rnk AS "rank", event_id, "timestamp", agent, rule_id, decoder, rule_level,
       round(anomaly_score, 6) AS anomaly_score FROM labelled WHERE rnk <= 50"""
    out["topk_ascending_level"] = f"""{w} SELECT * FROM (
SELECT row_number() OVER (ORDER BY rule_level, event_id) AS "rank", event_id, rule_level FROM alerts) WHERE "rank" <= 25"""
    out["topp_slice"] = f"""{w}, {FORMULA}, {LABELLED}
SELECT rnk AS "rank", event_id, round(anomaly_score, 6) AS anomaly_score FROM labelled
WHERE rnk <= greatest(1, ceil(CAST(0.01 AS DOUBLE) * (SELECT count(*) FROM alerts)))"""
    out["topp_per_day"] = f"""{w}, {FORMULA}, ranked AS (
SELECT CAST("timestamp" AS DATE) AS day, event_id, anomaly_score,
       row_number() OVER (PARTITION BY CAST("timestamp" AS DATE) ORDER BY round(anomaly_score, 9) DESC, event_id) AS "rank",
       count(*) OVER (PARTITION BY CAST("timestamp" AS DATE)) AS n FROM scored)
SELECT day, "rank", event_id, round(anomaly_score, 6) AS anomaly_score FROM ranked
WHERE "rank" <= greatest(1, ceil(CAST(0.01 AS DOUBLE) * n))"""
    out["threshold_select"] = f"""{w}, {FORMULA}
SELECT event_id, round(anomaly_score, 6) AS anomaly_score FROM scored WHERE anomaly_score >= 0.5"""
    out["score_summary"] = f"""{w}, {FORMULA}
SELECT round(min(anomaly_score), 6) AS score_min, round(max(anomaly_score), 6) AS score_max,
       round(avg(anomaly_score), 6) AS score_mean, count(*) AS "rows" FROM scored"""

    # features
    out["temporal_features"] = f"""{w}, {T1}, {T2}, {_features('t2')}
SELECT event_id, {', '.join(INT_FEATURES)} FROM base_t2"""
    for name, keys in (("recency_per_agent", "agent"), ("recency_per_agent_rule", "agent, rule_id")):
        out[name] = f"""{w} SELECT event_id, round((epoch_us("timestamp") - lag(epoch_us("timestamp"))
OVER (PARTITION BY {keys} ORDER BY "timestamp", event_id)) / 1e6, 6) AS recency_s FROM alerts"""
    out["host_zscore_frozen"] = f"""{w}, {T1}, {T2}, {_features('t2')}
SELECT event_id, round(rule_level_z_host, 6) AS rule_level_z_host FROM full_t2"""
    out["combo_freq_frozen"] = f"""{w}, {T1}, {T2}, {_features('t2')}
SELECT event_id, round(agent_rule_hour_freq_log1p, 6) AS agent_rule_hour_freq_log1p FROM full_t2"""
    out["cross_features"] = f"""{w}, {T1}, {T2}, {_features('t2')}
SELECT event_id, {_rounded(REAL_FEATURES[2:6])} FROM full_t2"""
    out["hash01_md5"] = f"""{w}, {T1}, {T2}, {_features('t2')}
SELECT DISTINCT agent, rule_id, hour_bucket, round(agent_rule_hour_hash01, 9) AS hash01 FROM full_t2"""
    out["features_full"] = f"""{w}, {T1}, {T2}, {_features('t2')}
SELECT event_id, agent, rule_id, rule_level, {', '.join(INT_FEATURES)}, {_rounded(REAL_FEATURES)} FROM full_t2"""
    out["features_on_batch"] = f"""{w}, t1 AS (SELECT * FROM alerts), {_features('t1')}
SELECT event_id, {', '.join(INT_FEATURES)}, {_rounded(REAL_FEATURES)} FROM full_t1"""
    out["fit_host_stats"] = f"""{w}, {T1} SELECT agent, round(avg(rule_level), 6) AS mu,
round(coalesce(stddev_samp(rule_level), 0), 6) AS sd FROM t1 GROUP BY agent"""
    out["fit_combo_freq"] = f"""{w}, {T1} SELECT agent, rule_id,
CAST(floor(hour("timestamp") / 2) * 2 AS INTEGER) AS hour_bucket, count(*) AS cnt FROM t1 GROUP BY ALL"""
    out["fit_recency_median"] = f"""{w}, {T1}, {T2}, {_features('t2')}
SELECT round(m, 6) AS recency_median FROM med"""

    # ingest, cleaning, split
    out["canonicalise"] = f"""WITH {RAW} SELECT "_id" AS event_id,
strptime("_source.timestamp", '%b %d, %Y @ %H:%M:%S.%g') AS "timestamp", "_source.agent.name" AS agent,
"_source.rule.id" AS rule_id, CAST("_source.rule.level" AS INTEGER) AS rule_level,
"_source.decoder.name" AS decoder FROM raw"""
    out["export_time_roundtrip"] = """SELECT CAST(event_id AS VARCHAR) AS event_id,
strftime(ts, '%b %d, %Y @ %H:%M:%S.%g') AS export_text, date_trunc('millisecond', ts) AS parsed,
strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso_text FROM events"""
    out["dedup_keep_first"] = f"""{w}, twice AS (
SELECT * FROM alerts UNION ALL
SELECT event_id, "timestamp" + INTERVAL 1 HOUR, agent, rule_id, 0, decoder FROM alerts WHERE rule_level <= 2)
SELECT event_id, "timestamp", agent, rule_id, rule_level, decoder FROM (
SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY "timestamp") AS rn FROM twice) WHERE rn = 1"""
    out["dedup_rows"] = f"""{w} SELECT DISTINCT agent, rule_id, decoder, rule_level FROM alerts"""
    split_case = """CASE WHEN CAST("timestamp" AS DATE) <= DATE '2024-01-20' THEN 'T1'
WHEN CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-21' AND DATE '2024-01-25' THEN 'T2' ELSE 'T3' END"""
    out["temporal_split"] = f"""{w} SELECT event_id, {split_case} AS split FROM alerts"""
    out["split_summary"] = f"""{w} SELECT {split_case} AS split, count(*) AS "rows",
min("timestamp") AS min_time, max("timestamp") AS max_time FROM alerts GROUP BY 1"""
    out["union_by_name"] = f"""{w} SELECT event_id, agent, decoder, NULL AS rule_id FROM alerts WHERE rule_level >= 5
UNION ALL SELECT event_id, agent, NULL, rule_id FROM alerts WHERE rule_level < 5"""
    out["time_sorted_positions"] = f"""{w} SELECT row_number() OVER (ORDER BY "timestamp", event_id) AS pos, event_id FROM alerts"""

    # quality and description
    def profile(c: str, rows: str = "raw") -> str:
        return f"""SELECT '{c}' AS "column", count("{c}") AS non_null, count(*) AS total,
round(count("{c}") / count(*), 6) AS coverage, count(*) FILTER (WHERE TRY_CAST("{c}" AS DOUBLE) = 0) AS zeros,
(SELECT coalesce(string_agg(x, '; ' ORDER BY x), '') FROM (SELECT DISTINCT left("{c}", 120) AS x FROM {rows} WHERE "{c}" IS NOT NULL
ORDER BY x LIMIT 5)) AS examples FROM {rows}"""
    out["long_examples"] = " UNION ALL ".join(profile(c, "documents") for c in ("text", "lang", "source"))
    out["coverage_report"] = f"WITH {RAW} " + " UNION ALL ".join(profile(c) for c in RAW_COLUMNS)
    out["select_high_coverage"] = f"""WITH {RAW} SELECT "_id", "_source.timestamp", "_source.agent.name",
"_source.rule.id", "_source.rule.level", "_source.decoder.name" FROM raw"""
    types = {c: "string" for c in RAW_COLUMNS}
    out["null_counts"] = f"WITH {RAW} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS "rows", count(*) - count("{c}") AS nulls FROM raw"""
        for c, t in types.items())
    out["distinct_counts"] = f"WITH {RAW} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT "{c}") AS n_distinct FROM raw""" for c in RAW_COLUMNS)
    out["uniform_sample"] = f"""{w} SELECT event_id, agent FROM alerts ORDER BY md5('42:sample:' || event_id) LIMIT 500"""
    out["cleaning_report"] = f"""WITH {RAW}, nul(key, n) AS (
SELECT 'event_id', 0 UNION ALL SELECT 'timestamp', 0 UNION ALL SELECT 'agent', 0 UNION ALL SELECT 'rule_id', 0
UNION ALL SELECT 'rule_level', 0
UNION ALL SELECT 'decoder', (SELECT count(*) - count("_source.decoder.name") FROM raw))
SELECT 'null_count' AS metric, key, CAST(n AS VARCHAR) AS "value" FROM nul
UNION ALL SELECT 'rows_raw', '', CAST(count(*) AS VARCHAR) FROM raw
UNION ALL SELECT 'rows_clean', '', CAST(count(*) AS VARCHAR) FROM raw
UNION ALL SELECT * FROM (VALUES ('cols_raw', '', '8'), ('cols_clean', '', '6'), ('duplicates_removed', 'event_id', '0'),
('mapping', 'event_id', '_id'), ('mapping', 'timestamp', '_source.timestamp'), ('mapping', 'agent', '_source.agent.name'),
('mapping', 'rule_id', '_source.rule.id'), ('mapping', 'rule_level', '_source.rule.level'),
('mapping', 'decoder', '_source.decoder.name'), ('dropped_column', '_source.data.srcip', ''),
('dropped_column', '_source.data.status', ''), ('dtype', 'event_id', 'string'), ('dtype', 'timestamp', 'timestamp_ntz'),
('dtype', 'agent', 'string'), ('dtype', 'rule_id', 'string'), ('dtype', 'rule_level', 'int'), ('dtype', 'decoder', 'string'))"""
    out["corpus_summary"] = f"""{w} SELECT count(*) AS "rows", min("timestamp") AS min_time, max("timestamp") AS max_time,
count(DISTINCT agent) AS n_agents, count(DISTINCT rule_id) AS n_rules, count(DISTINCT decoder) AS n_decoders FROM alerts"""
    out["events_per_day"] = f"""{w} SELECT CAST("timestamp" AS DATE) AS day, count(*) AS alerts FROM alerts GROUP BY 1"""
    out["hour_hist"] = f"""{w} SELECT CAST(hour("timestamp") AS INTEGER) AS hour, count(*) AS alerts FROM alerts GROUP BY 1"""
    out["weekday_hist"] = f"""{w} SELECT CAST(isodow("timestamp") - 1 AS INTEGER) AS weekday, count(*) AS alerts FROM alerts GROUP BY 1"""
    out["offhours_share"] = f"""{w} SELECT count(*) AS alerts, count(*) FILTER (WHERE hour("timestamp") <= 6) AS off_hours,
round(count(*) FILTER (WHERE hour("timestamp") <= 6) / count(*), 6) AS share FROM alerts"""
    days = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
    out["hour_weekday_matrix"] = f"""{w} SELECT CAST(hour("timestamp") AS INTEGER) AS hour, """ + ", ".join(
        f"""count(*) FILTER (WHERE isodow("timestamp") = {i + 1}) AS {d}""" for i, d in enumerate(days)
    ) + " FROM alerts GROUP BY 1"
    for name, col in (("level_dist", "rule_level"), ("agent_dist", "agent")):
        out[name] = f"""{w} SELECT {col}, count(*) AS alerts,
round(count(*) / (SELECT count(*) FROM alerts), 6) AS share FROM alerts GROUP BY 1"""
    for name, col in (("top_rules", "rule_id"), ("top_decoders", "decoder")):
        out[name] = f"""{w} SELECT {col}, count(*) AS alerts FROM alerts GROUP BY 1 ORDER BY alerts DESC, {col} LIMIT 10"""
    out["top_rule_groups"] = """SELECT "group", count(*) AS alerts FROM (
SELECT unnest([event_type, 'all', CASE WHEN value >= 100 THEN 'high' ELSE 'low' END]) AS "group" FROM events)
GROUP BY 1 ORDER BY alerts DESC, "group" LIMIT 5"""
    out.update(_more(w))
    out.update(_storage(w, out))
    return out


MODEL = FEATURES
_VEC = "[" + ", ".join(f"coalesce(CAST({f} AS DOUBLE), 0)" for f in MODEL) + "]"
_Y = """CASE WHEN rule_level >= 8 AND hour("timestamp") <= 6 THEN 1 ELSE 0 END"""

VECTORS = f"""{T1}, {T2}, {_stats()}, {_apply('t1')}, {_apply('t2')},
vt AS (SELECT event_id, {_VEC} AS v FROM full_t1),
vq AS (SELECT event_id, {_VEC} AS v, {_Y} AS y FROM full_t2)"""


def _near(k: int, q: str = "vq", extra: str = "") -> str:
    return f"""near AS (
  SELECT q.event_id{extra}, min({{'d': list_distance(q.v, t.v), 'o': t.event_id}}, {k}) AS n
  FROM {q} q CROSS JOIN vt t GROUP BY q.event_id{extra})"""


def _mean_d(k: int) -> str:
    return f"list_avg(list_transform(n[1:{k}], lambda x: x.d))"


def _figures(tp: str, k: str, n: str, pos: str) -> str:
    return f"""round({tp} / {k}, 6) AS "precision", round({tp} / nullif({pos}, 0), 6) AS recall,
round(({tp} / {k}) / nullif({pos} / {n}, 0), 6) AS lift, round(({k} - {tp}) / nullif({n} - {pos}, 0), 6) AS fpr"""


def _draw(purpose: str) -> str:
    return f"CAST(('0x' || left(md5('42:{purpose}:' || event_id), 8)) AS UBIGINT)"


LIGHT = ALERTS.replace("user_id % 5", "user_id")

INJECT = f"""{T1}, {T2},
nn AS (SELECT CAST(greatest(1, round_even(0.03 * count(*), 0)) AS BIGINT) AS n FROM t2),
ranked AS (SELECT t2.*, row_number() OVER (ORDER BY md5('42:assign:' || event_id)) AS rk FROM t2),
marked AS (SELECT r.* EXCLUDE (rk), CASE WHEN rk <= n // 4 + least(n % 4, 1) THEN 'offhours'
  WHEN rk <= 2 * (n // 4) + least(n % 4, 2) THEN 'rule_new' WHEN rk <= 3 * (n // 4) + least(n % 4, 3) THEN 'decoder_new'
  WHEN rk <= n THEN 'level_out' ELSE '' END AS synth_usecase FROM ranked r CROSS JOIN nn),
hosts AS (SELECT DISTINCT agent FROM t2),
free_r AS (SELECT agent, v, row_number() OVER (PARTITION BY agent ORDER BY v) - 1 AS rn, count(*) OVER (PARTITION BY agent) AS free
  FROM hosts CROSS JOIN (SELECT rule_id AS v FROM t1 UNION SELECT rule_id FROM t2)
  WHERE (agent, v) NOT IN (SELECT (agent, rule_id) FROM t1)),
free_d AS (SELECT agent, v, row_number() OVER (PARTITION BY agent ORDER BY v) - 1 AS rn, count(*) OVER (PARTITION BY agent) AS free
  FROM hosts CROSS JOIN (SELECT decoder AS v FROM t1 UNION SELECT decoder FROM t2)
  WHERE (agent, v) NOT IN (SELECT (agent, decoder) FROM t1)),
nfree_r AS (SELECT agent, max(free) AS free FROM free_r GROUP BY agent),
nfree_d AS (SELECT agent, max(free) AS free FROM free_d GROUP BY agent),
means AS (SELECT agent, avg(rule_level) AS mu FROM t1 GROUP BY agent),
changed AS (SELECT m.event_id,
  CASE WHEN synth_usecase = 'offhours' THEN CAST(CAST("timestamp" AS DATE) AS TIMESTAMP)
    + to_hours(CAST({_draw('hour')} % 7 AS BIGINT)) + to_minutes(CAST({_draw('minute')} % 60 AS BIGINT))
    + to_seconds(CAST({_draw('second')} % 60 AS BIGINT)) + to_milliseconds(CAST({_draw('milli')} % 1000 AS BIGINT))
    ELSE "timestamp" END AS "timestamp", m.agent,
  CASE WHEN synth_usecase = 'rule_new' THEN coalesce(
    (SELECT v FROM free_r f WHERE f.agent = m.agent AND f.rn = {_draw('rule_id')} % (SELECT free FROM nfree_r z WHERE z.agent = m.agent)),
    '9' || CAST(1000000 + {_draw('rule_id:none')} % 8999999 AS VARCHAR)) ELSE rule_id END AS rule_id,
  CASE WHEN synth_usecase = 'level_out' THEN CAST(least(15, greatest(0, ceil(coalesce(mu, 3.0) + 4
    + {_draw('bump')} % 2))) AS INTEGER) ELSE rule_level END AS rule_level,
  CASE WHEN synth_usecase = 'decoder_new' THEN coalesce(
    (SELECT v FROM free_d f WHERE f.agent = m.agent AND f.rn = {_draw('decoder')} % (SELECT free FROM nfree_d z WHERE z.agent = m.agent)),
    'dec_' || CAST(1000000 + {_draw('decoder:none')} % 8999999 AS VARCHAR)) ELSE decoder END AS decoder,
  synth_usecase FROM marked m LEFT JOIN means ON m.agent = means.agent)"""

_CELL = f"""cells AS (SELECT CAST(event_id AS VARCHAR) AS event_id, k, value,
  '{{"top_features":[{{"feature":"rule_level","delta_score_if_replaced_by_train_median":' || CAST(k / 8.0 AS VARCHAR)
  || '}},{{"feature":"hour_local","delta_score_if_replaced_by_train_median":"n/a"}},{{"feature":"second_in_hour"}},{{"feature":"z"}}]}}' AS good
  FROM (SELECT *, {_K} AS k FROM events))"""


def _more(w: str) -> dict[str, str]:
    light = f"WITH {LIGHT}"
    out: dict[str, str] = {}

    # injection
    out["seen_rules_per_host"] = f"{light}, {T1} SELECT DISTINCT agent, rule_id FROM t1"
    out["host_level_mean"] = f"{light}, {T1} SELECT agent, round(avg(rule_level), 6) AS mu FROM t1 GROUP BY agent"
    out["unseen_candidates"] = f"{light}, {INJECT} SELECT agent, v AS rule_id FROM free_r"
    cols = 'event_id, "timestamp", agent, rule_id, rule_level, decoder'
    tail = "CAST(synth_usecase <> '' AS INTEGER) AS is_synth_anom, CAST(synth_usecase <> '' AS INTEGER) AS y_true_synth, 1 AS y_mask_eval, synth_usecase"
    out["inject_replace"] = f"""{light}, {INJECT} SELECT {cols}, 'T2_synth' AS split, {tail} FROM changed
UNION ALL SELECT {cols}, 'T1', 0, NULL, 0, '' FROM t1"""
    out["inject_append"] = f"""{light}, {INJECT}, al AS (SELECT event_id || '-synth' AS event_id, * EXCLUDE (event_id) FROM changed
WHERE synth_usecase <> '' UNION ALL SELECT {cols}, '' AS synth_usecase FROM t2)
SELECT {cols}, 'T2_synth' AS split, {tail} FROM al"""
    out["inject_counts"] = f"{w}, {INJECT} SELECT synth_usecase, count(*) AS alerts FROM marked WHERE synth_usecase <> '' GROUP BY 1"

    # metrics
    n, pos = "(SELECT count(*) FROM labelled)", "(SELECT sum(y) FROM labelled)"
    counts = f"tp, k - tp AS fp, {pos} - tp AS fn, {n} - {pos} - (k - tp) AS tn"
    out["metrics_at_p"] = f"""{w}, {FORMULA}, {LABELLED}, b AS (
SELECT p, CAST(greatest(1, ceil(p * (SELECT count(*) FROM labelled))) AS BIGINT) AS k
FROM (SELECT CAST(unnest([0.005, 0.01, 0.02, 0.03]) AS DOUBLE) AS p)),
t AS (SELECT p, k, (SELECT sum(y) FROM labelled WHERE rnk <= k) AS tp FROM b)
SELECT p, k, {counts}, {_figures('tp', 'k', n, pos)} FROM t"""
    out["metrics_at_k"] = f"""{w}, {FORMULA}, {LABELLED}, b AS (SELECT unnest([25, 50, 100]) AS k),
t AS (SELECT k, (SELECT sum(y) FROM labelled WHERE rnk <= k) AS tp FROM b)
SELECT k, {counts}, {_figures('tp', 'k', n, pos)} FROM t"""
    per_day = f"""{w}, {FORMULA}, {LABELLED}, ranked AS (
SELECT *, CAST("timestamp" AS DATE) AS day,
       row_number() OVER (PARTITION BY CAST("timestamp" AS DATE) ORDER BY round(anomaly_score, 9) DESC, event_id) AS dr,
       count(*) OVER (PARTITION BY CAST("timestamp" AS DATE)) AS nd FROM labelled),
g AS (SELECT day, count(*) AS n, sum(y) AS positives,
      count(*) FILTER (WHERE dr <= greatest(1, ceil(CAST(0.02 AS DOUBLE) * nd))) AS k,
      coalesce(sum(y) FILTER (WHERE dr <= greatest(1, ceil(CAST(0.02 AS DOUBLE) * nd))), 0) AS tp FROM ranked GROUP BY day)"""
    out["metrics_per_day"] = f"{per_day} SELECT day, k, tp, n, positives, {_figures('tp', 'k', 'n', 'positives')} FROM g"
    stab = " UNION ALL ".join(
        f"""SELECT '{c}' AS figure, round(quantile_cont({e}, 0.25), 6) AS q25, round(quantile_cont({e}, 0.5), 6) AS q50,
round(quantile_cont({e}, 0.75), 6) AS q75 FROM g""" for c, e in (
            ("precision", "tp / k"), ("recall", "tp / nullif(positives, 0)"),
            ("lift", "(tp / k) / nullif(positives / n, 0)"), ("fpr", "(k - tp) / nullif(n - positives, 0)")))
    out["day_stability"] = f"{per_day} {stab}"
    out["metrics_by_family"] = f"""{w}, {FORMULA}, {LABELLED}
SELECT split_part(rule_id, '-', 1) AS family, sum(y) AS positives, coalesce(sum(y) FILTER (WHERE rnk <= 100), 0) AS hits,
round(coalesce(sum(y) FILTER (WHERE rnk <= 100), 0) / sum(y), 6) AS recall FROM labelled GROUP BY 1 HAVING sum(y) > 0"""
    out["score_histogram"] = f"""{w}, {FORMULA}, l AS (SELECT min(round(anomaly_score, 9)) AS a, max(round(anomaly_score, 9)) AS b FROM scored)
SELECT least(50, 1 + CAST(floor((round(anomaly_score, 9) - a) / (b - a) * 50) AS BIGINT)) AS bin, count(*) AS alerts
FROM scored CROSS JOIN l GROUP BY 1"""
    out["selection_rate"] = f"""{w}, {FORMULA} SELECT CAST("timestamp" AS DATE) AS day, count(*) AS alerts,
count(*) FILTER (WHERE anomaly_score >= 0.5) AS selected,
round(count(*) FILTER (WHERE anomaly_score >= 0.5) / count(*), 6) AS rate FROM scored GROUP BY 1"""
    out["drift_by_day"] = f"""{w}, {FORMULA}, e AS (
SELECT quantile_cont(round(anomaly_score, 9), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q
FROM scored WHERE CAST("timestamp" AS DATE) <= DATE '2024-01-20'),
b AS (SELECT CAST("timestamp" AS DATE) AS day,
  1 + len(list_filter(q, lambda x: round(anomaly_score, 9) > x)) AS bin FROM scored CROSS JOIN e
  WHERE CAST("timestamp" AS DATE) > DATE '2024-01-20')
SELECT day, bin, count(*) AS alerts, round(count(*) / sum(count(*)) OVER (PARTITION BY day), 6) AS share FROM b GROUP BY day, bin"""
    out["run_metadata"] = f"""{w}, {FORMULA} SELECT 'formula' AS version, min("timestamp") AS window_start,
max("timestamp") AS window_end, count(*) AS "rows", CAST(ceil(CAST(0.01 AS DOUBLE) * count(*)) AS BIGINT) AS selected,
round(ceil(CAST(0.01 AS DOUBLE) * count(*)) / count(*), 6) AS selection_rate, TRUE AS timed FROM scored"""

    # neighbours
    out["knn_score"] = f"{w}, {VECTORS}, {_near(35)} SELECT event_id, round({_mean_d(35)}, 6) AS anomaly_score FROM near"
    knn_rank = f"""{w}, {VECTORS}, {_near(35)}, ks AS (SELECT event_id, round({_mean_d(35)}, 9) AS s FROM near),
kr AS (SELECT *, row_number() OVER (ORDER BY s DESC, event_id) AS rnk FROM ks)"""
    out["knn_topp"] = f"""{knn_rank} SELECT rnk AS "rank", event_id, round(s, 6) AS anomaly_score FROM kr
WHERE rnk <= greatest(1, ceil(CAST(0.01 AS DOUBLE) * (SELECT count(*) FROM vq)))"""
    scaled = ", ".join(
        f"(list_extract(v, {i}) - (SELECT m{i} FROM sc)) / (SELECT CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END FROM sc)"
        for i in range(1, 17))
    facts = ", ".join(f"avg(v[{i}]) AS m{i}, stddev_pop(v[{i}]) AS s{i}" for i in range(1, 17))
    out["knn_score_scaled"] = f"""{w}, {VECTORS.replace("vt AS (", "vt0 AS (").replace("vq AS (", "vq0 AS (")},
sc AS (SELECT {facts} FROM vt0), vt AS (SELECT event_id, [{scaled}] AS v FROM vt0),
vq AS (SELECT event_id, [{scaled}] AS v FROM vq0), {_near(10)}
SELECT event_id, round({_mean_d(10)}, 6) AS anomaly_score FROM near"""
    out["lof_score"] = f"""{w}, {VECTORS}, own AS (
SELECT a.event_id, min({{'d': list_distance(a.v, b.v), 'o': b.event_id}}, 20) AS n
FROM vt a CROSS JOIN vt b WHERE a.event_id <> b.event_id GROUP BY a.event_id),
kd AS (SELECT event_id, n[20].d AS kdist, n FROM own),
lt AS (SELECT l.event_id, 1 / (avg(greatest(l.x.d, k.kdist)) + 1e-10) AS lrd
  FROM (SELECT event_id, unnest(n) AS x FROM own) l JOIN kd k ON k.event_id = l.x.o GROUP BY l.event_id),
{_near(20)}, ql AS (SELECT event_id, unnest(n) AS x FROM near),
qd AS (SELECT ql.event_id, 1 / (avg(greatest(ql.x.d, k.kdist)) + 1e-10) AS lrd, avg(lt.lrd) AS around
  FROM ql JOIN kd k ON k.event_id = ql.x.o JOIN lt ON lt.event_id = ql.x.o GROUP BY ql.event_id)
SELECT event_id, round(around / lrd, 6) AS anomaly_score FROM qd"""
    out["sweep_best_k"] = f"""{w}, {VECTORS}, {_near(50, extra=', y')}, kk AS (
SELECT event_id, y, k, round(list_avg(list_transform(n[1:k], lambda x: x.d)), 9) AS s
FROM near CROSS JOIN (SELECT unnest([5, 10, 20, 35, 50]) AS k)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, event_id) AS rnk FROM kk),
b AS (SELECT p, CAST(greatest(1, ceil(p * (SELECT count(*) FROM vq))) AS BIGINT) AS budget
  FROM (SELECT CAST(unnest([0.005, 0.01, 0.02, 0.03]) AS DOUBLE) AS p)),
t AS (SELECT p, k, budget, coalesce(sum(y) FILTER (WHERE rnk <= budget), 0) AS tp FROM r CROSS JOIN b GROUP BY p, k, budget),
m AS (SELECT p, k, tp / budget AS pr, tp / (SELECT sum(y) FROM vq) AS rc,
  (tp / budget) / ((SELECT sum(y) FROM vq) / (SELECT count(*) FROM vq)) AS li,
  (budget - tp) / ((SELECT count(*) FROM vq) - (SELECT sum(y) FROM vq)) AS fp,
  row_number() OVER (PARTITION BY p ORDER BY tp / budget DESC, k) AS best FROM t)
SELECT p, k, round(pr, 6) AS "precision", round(rc, 6) AS recall, round(li, 6) AS lift, round(fp, 6) AS fpr FROM m WHERE best = 1"""

    out["iforest_score"] = _forest()
    out["model_runs"] = " UNION ALL ".join(
        f"""SELECT '{kind}' AS kind, (list(anomaly_score ORDER BY anomaly_score DESC))[CAST(ceil(CAST(0.01 AS DOUBLE) * count(*)) AS BIGINT)] AS least_score,
count(*) AS n_scored, CAST(ceil(CAST(0.01 AS DOUBLE) * count(*)) AS BIGINT) AS n_selected FROM ({sql})"""
        for kind, sql in (("knn", out["knn_score"]), ("lof", out["lof_score"]), ("iforest", _forest(trees=40))))
    out.update(_review(w))

    # explanations
    names = "[" + ", ".join(f"'{f}'" for f in MODEL) + "]"
    med = "[" + ", ".join(f"(SELECT median(v[{i}]) FROM vt)" for i in range(1, 17)) + "]"
    out["occlusion_topn"] = f"""{knn_rank}, top10 AS (SELECT rnk, kr.event_id, v FROM kr JOIN vq ON vq.event_id = kr.event_id WHERE rnk <= 10),
bl AS (SELECT {med} AS b), mods AS (
SELECT rnk, event_id, j, list_transform(range(1, 17), lambda i: CASE WHEN i = j THEN b[i] ELSE v[i] END) AS v, v AS orig, b
FROM top10 CROSS JOIN bl CROSS JOIN (SELECT unnest(range(0, 17)) AS j)),
sc AS (SELECT rnk, m.event_id, j, min(list_distance(m.v, t.v), 35) AS ds, any_value(orig) AS orig, any_value(b) AS b
  FROM mods m CROSS JOIN vt t GROUP BY rnk, m.event_id, j),
sv AS (SELECT *, list_avg(ds) AS s FROM sc)
SELECT x.rnk AS "rank", x.event_id, ({names})[x.j] AS feature, round(o.s, 6) AS score, round(x.orig[x.j], 6) AS "value",
round(x.b[x.j], 6) AS baseline, round(o.s - x.s, 6) AS contribution, round(abs(o.s - x.s), 6) AS abs_contribution
FROM sv x JOIN sv o ON o.event_id = x.event_id AND o.j = 0 WHERE x.j > 0"""
    occluded = f"""{out["occlusion_topn"].split("SELECT x.rnk AS")[0]}, eff AS (
SELECT x.rnk, x.event_id, ({names})[x.j] AS feature, x.j, o.s - x.s AS c FROM sv x JOIN sv o ON o.event_id = x.event_id AND o.j = 0 WHERE x.j > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(abs(c), 9) DESC, feature) AS place FROM eff)"""
    out["top_reasons"] = f"""{occluded} SELECT rnk AS "rank", event_id, place, feature, round(c, 6) AS contribution FROM best WHERE place <= 3"""
    out["reason_entries"] = f"""{occluded},
nb AS (SELECT t.event_id, unnest(n).o AS o FROM top10 t JOIN near ON near.event_id = t.event_id),
md AS (SELECT nb.event_id, b.j, median(vt.v[b.j]) AS m FROM nb JOIN vt ON vt.event_id = nb.o JOIN best b ON b.event_id = nb.event_id AND b.place <= 3
  GROUP BY nb.event_id, b.j),
fl AS (SELECT event_id, array_to_string(list_filter([
CASE WHEN hour("timestamp") <= 6 AND rule_level >= 10 THEN 'off-hours × high severity' END,
CASE WHEN (agent, rule_id) NOT IN (SELECT (agent, rule_id) FROM t1) THEN 'new rule on this host' END,
CASE WHEN (agent, decoder) NOT IN (SELECT (agent, decoder) FROM t1) THEN 'new decoder on this host' END],
lambda x: x IS NOT NULL), '; ') AS flags FROM t2)
SELECT b.event_id, b.feature, round(b.c, 6) AS delta, flags, round(m, 6) AS neighbor_median FROM best b
JOIN md ON md.event_id = b.event_id AND md.j = b.j JOIN fl ON fl.event_id = b.event_id WHERE place <= 3"""
    out["reason_codes_neighbor"] = f"""{knn_rank}, top10 AS (SELECT rnk, kr.event_id, v FROM kr JOIN vq ON vq.event_id = kr.event_id WHERE rnk <= 10),
nb AS (SELECT t.rnk, t.event_id, t.v, unnest(n).o AS o FROM top10 t JOIN near ON near.event_id = t.event_id),
j AS (SELECT unnest(range(1, 17)) AS j),
iq AS (SELECT j, quantile_cont(v[j], 0.75) - quantile_cont(v[j], 0.25) AS iqr FROM vt CROSS JOIN j GROUP BY j),
md AS (SELECT rnk, nb.event_id, j, any_value(nb.v[j]) AS x, median(vt.v[j]) AS m FROM nb JOIN vt ON vt.event_id = nb.o CROSS JOIN j GROUP BY rnk, nb.event_id, j)
SELECT rnk AS "rank", event_id, ({names})[md.j] AS feature, round(x, 6) AS "value", round(m, 6) AS neighbor_median,
round(abs(x - m) / nullif(iqr, 0), 6) AS scaled_contribution FROM md JOIN iq ON iq.j = md.j"""
    out["context_flags"] = f"""{light}, {T1}, {T2} SELECT event_id, array_to_string(list_filter([
CASE WHEN hour("timestamp") <= 6 AND rule_level >= 10 THEN 'off-hours × high severity' END,
CASE WHEN (agent, rule_id) NOT IN (SELECT (agent, rule_id) FROM t1) THEN 'new rule on this host' END,
CASE WHEN (agent, decoder) NOT IN (SELECT (agent, decoder) FROM t1) THEN 'new decoder on this host' END],
lambda x: x IS NOT NULL), '; ') AS flags FROM t2"""
    out["parse_explanations"] = f"""WITH {_CELL} SELECT event_id,
CASE WHEN k % 5 IN (0, 1) THEN 4 END AS n_features, CASE WHEN k % 5 = 2 THEN 'not json ' || CAST(k AS VARCHAR) END AS raw_text FROM cells"""
    out["reason_summary"] = f"""WITH {_CELL} SELECT event_id, CASE WHEN k % 5 IN (0, 1)
THEN 'rule_level:' || CAST(CAST(k / 8.0 AS DOUBLE) AS VARCHAR) || ', second_in_hour:0' END AS summary FROM cells"""
    out["label_to_score"] = f"""SELECT CAST(event_id AS VARCHAR) AS event_id, CASE k % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0
WHEN 2 THEN 1.0 ELSE CAST(k AS DOUBLE) END AS score FROM (SELECT *, {_K} AS k FROM events)"""
    out["records_json"] = f"""{w} SELECT event_id, '{{"event_id":"' || event_id || '","timestamp":"'
|| strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || '","agent":"' || agent || '","rule_level":' || CAST(rule_level AS VARCHAR)
|| ',"decoder":' || CASE WHEN rule_level = 1 THEN 'null' ELSE '"' || decoder || '"' END || '}}' AS record FROM alerts"""

    # streams: the drained stream equals the batch result
    out["stream_canonical"] = f"""WITH {RAW} SELECT "_id" AS event_id,
strptime("_source.timestamp", '%b %d, %Y @ %H:%M:%S.%g') AS "timestamp", "_source.agent.name" AS agent,
"_source.rule.id" AS rule_id, CAST("_source.rule.level" AS INTEGER) AS rule_level, "_source.decoder.name" AS decoder FROM raw"""
    out["stream_dedup"] = f"{w} SELECT {cols} FROM alerts"
    out["stream_recency"] = f"""{w} SELECT event_id, round((epoch_us("timestamp") - lag(epoch_us("timestamp"))
OVER (PARTITION BY agent ORDER BY "timestamp", event_id)) / 1e6, 6) AS recency_s FROM alerts"""
    out["stream_monitor"] = f"""{w} SELECT date_trunc('hour', "timestamp") AS hour, agent, count(*) AS alerts,
count(*) FILTER (WHERE rule_level >= 8) AS selected, round(avg(rule_level / 15), 6) AS mean_score FROM alerts GROUP BY ALL"""
    out["stream_enrich_topk"] = f"""{w}, {T1}, {T2},
ls AS (SELECT avg(rule_level) AS m, stddev_pop(rule_level) AS s FROM t1),
pr AS (SELECT agent, rule_id, count(*) AS n FROM t1 GROUP BY ALL),
both_ AS (SELECT 1 AS w, * FROM t1 UNION ALL SELECT 2, * FROM t2),
raw_s AS (SELECT b.*, 0.5 * (rule_level - m) / s + CASE WHEN hour("timestamp") <= 6 THEN 1.0 ELSE 0.0 END
  + 2.0 / (1.0 + coalesce(n, 0)) AS s FROM both_ b CROSS JOIN ls LEFT JOIN pr ON pr.agent = b.agent AND pr.rule_id = b.rule_id),
li AS (SELECT min(s) AS lo, max(s) AS hi FROM raw_s WHERE w = 1),
sc AS (SELECT CAST("timestamp" AS DATE) AS day, event_id, round(CAST((s - lo) / (hi - lo + 1e-9) AS DOUBLE), 9) AS x
  FROM raw_s CROSS JOIN li WHERE w = 2),
rk AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY x DESC, event_id) AS "rank", event_id, round(x, 6) AS anomaly_score FROM sc)
SELECT * FROM rk WHERE "rank" <= 10"""
    out["stream_features"] = f"""{w}, {T1}, {T2}, {_features('t2')}
SELECT event_id, agent, rule_id, rule_level, {', '.join(INT_FEATURES)}, {_rounded(REAL_FEATURES)} FROM full_t2"""
    return out


def _review(w: str) -> dict[str, str]:
    """The review screen: formula frozen on t1, scores of t2, slice, replaced features."""
    score = "({0} - lo) / (hi - lo + 1e-9)"
    plain = "0.5 * ({0} - m) / s + CASE WHEN hour(\"timestamp\") <= 6 THEN 1.0 ELSE 0.0 END + 2.0 / (1.0 + coalesce(n, 0))"
    base = f"""{w}, {T1}, {T2},
ls AS (SELECT avg(rule_level) AS m, stddev_pop(rule_level) AS s, median(rule_level) AS ml, median(hour("timestamp")) AS mh FROM t1),
pr AS (SELECT agent, rule_id, count(*) AS n FROM t1 GROUP BY ALL),
li AS (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT {plain.format("rule_level")} AS x FROM t1 CROSS JOIN ls
  JOIN pr ON pr.agent = t1.agent AND pr.rule_id = t1.rule_id)),
sc AS (SELECT 'evt-' || lpad(event_id, 10, '0') AS event_id, rule_level, hour("timestamp") AS h, ml, mh,
  CAST({score.format("(" + plain.format("rule_level") + ")")} AS DOUBLE) AS a,
  CAST({score.format("(" + plain.format("ml") + ")")} AS DOUBLE) AS b
  FROM t2 CROSS JOIN ls CROSS JOIN li LEFT JOIN pr ON pr.agent = t2.agent AND pr.rule_id = t2.rule_id),
rk AS (SELECT *, row_number() OVER (ORDER BY a DESC, event_id) AS "rank", count(*) OVER () AS total FROM sc),
sl AS (SELECT * FROM rk WHERE "rank" <= greatest(1, ceil(CAST(0.005 AS DOUBLE) * total))),
ex AS (SELECT "rank", event_id, 'rule_level' AS feature, a, CAST(rule_level AS DOUBLE) AS v, ml AS bl, a - b AS c FROM sl WHERE "rank" <= 5
  UNION ALL SELECT "rank", event_id, 'hour_local', a, h, mh, 0.0 FROM sl WHERE "rank" <= 5)"""
    return {
        "review_explanations": f"""{base} SELECT row_number() OVER (ORDER BY "rank", abs(c) DESC, feature) AS place, "rank", event_id, feature,
round(a, 6) AS score, round(v, 6) AS "value", round(bl, 6) AS baseline, round(c, 6) AS contribution FROM ex""",
        "review_tables": f"""{base}, n AS (SELECT least(50, count(*)) AS n FROM t2)
SELECT 'alerts_preview' AS name, n AS n_rows FROM n UNION ALL SELECT 'features_preview', n FROM n
UNION ALL SELECT 'top', count(*) FROM sl UNION ALL SELECT 'chart_features', count(*) FROM ex""",
    }


def _forest(trees: int = 600, seed: int = 42, share: float = 0.5, kept: int = 12, levels: int = 18) -> str:
    """The isolation forest grown and walked level by level, up to ``levels`` (enough for 2**18 sampled rows).

    Draws are chains of 64-bit hashes, which this engine's ``hash`` of a whole number equals.
    """
    width = len(MODEL)

    def chain(*parts: str, start: str = "CAST(0 AS UBIGINT)") -> str:
        for part in parts:
            start = f"hash(xor({start}, CAST({part} AS UBIGINT)))"
        return start

    def uniform(h: str) -> str:
        return f"((CAST({h} >> 11 AS DOUBLE) + 0.5) / 9007199254740992.0)"

    low, high = (", ".join(f"{f}(k.v[{i}])" for i in range(1, width + 1)) for f in ("min", "max"))
    leaf = "CASE WHEN {0} <= 1 THEN 0.0 WHEN {0} <= 2 THEN 1.0 ELSE 2 * (ln({0} - 1) + 0.5772156649015329) - 2 * ({0} - 1) / {0} END"
    parts = [f"""fv AS (SELECT min(event_id) AS id, count(*) AS w, v FROM (
  SELECT event_id, list_transform(v, lambda x: x + 0.0) AS v FROM vt) GROUP BY v),
fn AS (SELECT CAST(sum(w) AS BIGINT) AS total, greatest(1, CAST(floor({share} * sum(w)) AS BIGINT)) AS sample FROM fv),
fp AS (SELECT CAST(sample AS DOUBLE) / total AS rate, sample, CAST(ceil(log2(greatest(sample, 2))) AS INTEGER) AS depth FROM fn),
keyed AS MATERIALIZED (SELECT row_number() OVER () AS i, w, v,
  {chain(str(seed), "1", "'0x' || left(md5(id), 15)")} AS h FROM fv),
pois(w, j, term, total) AS (
  SELECT w, 0, exp(-w * rate), exp(-w * rate) FROM (SELECT DISTINCT w FROM fv) CROSS JOIN fp
  UNION ALL SELECT p.w, j + 1, term * (p.w * rate) / (j + 1), total + term * (p.w * rate) / (j + 1) FROM pois p CROSS JOIN fp WHERE j < 100),
cumulated AS (SELECT w, list(total ORDER BY j) FILTER (total < 1.0) AS c FROM pois GROUP BY w),
trees AS (SELECT CAST(unnest(range({trees})) AS BIGINT) AS tree),
drawn AS (SELECT tree, i, w, {uniform(chain("tree", start="h"))} AS u FROM keyed CROSS JOIN trees),
subset AS MATERIALIZED (SELECT tree, f FROM trees CROSS JOIN (SELECT unnest(range({width})) AS f)
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY {chain(str(seed), "2", "tree", "f")} >> 11) <= {kept}),
l0 AS MATERIALIZED (SELECT tree, CAST(1 AS BIGINT) AS node, i, len(list_filter(c, lambda t: u > t)) AS n
  FROM drawn JOIN cumulated USING (w) WHERE u > c[1]),
asked AS MATERIALIZED (SELECT row_number() OVER () AS q, event_id, list_transform(v, lambda x: x + 0.0) AS v FROM vq),
q0 AS MATERIALIZED (SELECT tree, CAST(1 AS BIGINT) AS node, q FROM asked CROSS JOIN trees)"""]
    for d in range(levels):
        parts.append(f"""e{d} AS MATERIALIZED (SELECT tree, node, sum(n) AS size, [{low}] AS lo, [{high}] AS hi
  FROM l{d} JOIN keyed k USING (i) GROUP BY tree, node),
p{d} AS MATERIALIZED (SELECT tree, node, f, CASE WHEN cut < hi[f + 1] THEN cut ELSE lo[f + 1] END AS cut FROM (
  SELECT *, lo[f + 1] + {uniform(chain(str(seed), "4", "tree", "node"))} * (hi[f + 1] - lo[f + 1]) AS cut
  FROM e{d} JOIN subset USING (tree) CROSS JOIN fp WHERE size > 1 AND {d} < depth AND hi[f + 1] > lo[f + 1]
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {chain(str(seed), "3", "tree", "node", "f")} >> 11) = 1)),
l{d + 1} AS MATERIALIZED (SELECT tree, 2 * node + CASE WHEN k.v[f + 1] > cut THEN 1 ELSE 0 END AS node, i, n
  FROM l{d} JOIN p{d} USING (tree, node) JOIN keyed k USING (i)),
r{d} AS MATERIALIZED (SELECT q, sum({d} + {leaf.format("size")}) AS paths
  FROM q{d} JOIN e{d} USING (tree, node) ANTI JOIN p{d} USING (tree, node) GROUP BY q),
q{d + 1} AS MATERIALIZED (SELECT tree, 2 * node + CASE WHEN a.v[f + 1] > cut THEN 1 ELSE 0 END AS node, q
  FROM q{d} JOIN p{d} USING (tree, node) JOIN asked a USING (q))""")
    paths = " UNION ALL ".join(f"SELECT * FROM r{d}" for d in range(levels))
    return f"""WITH RECURSIVE {ALERTS}, {VECTORS}, {", ".join(parts)}, walked AS ({paths})
SELECT event_id, round(power(2, -(sum(paths) / {trees}) / any_value({leaf.format("sample")})), 6) AS anomaly_score
FROM walked JOIN asked USING (q) CROSS JOIN fp GROUP BY event_id"""


def _storage(w: str, done: dict[str, str]) -> dict[str, str]:
    """Queries that go through files."""
    out: dict[str, str] = {}
    number = """CAST(right("_id", 10) AS BIGINT)"""
    names = [c for c in RAW_COLUMNS if c != "_source.rule.level"]
    absent = [c for c in RAW_COLUMNS if c not in names[:4] and c != "_source.rule.level"]
    quoted = lambda cs: ", ".join(f'"{c}"' for c in cs)
    none = lambda cs: ", ".join(f'NULL AS "{c}"' for c in cs)
    exports = f"""exports AS (
SELECT {quoted(names[:4])}, "_source.rule.level", {none(absent)} FROM raw WHERE {number} % 2 = 0
UNION ALL BY NAME SELECT {quoted(names)}, NULL AS "_source.rule.level" FROM raw WHERE {number} % 2 = 1
UNION ALL BY NAME SELECT "_id" || '-short' AS "_id", "_source.timestamp" FROM raw WHERE {number} % 50 = 0 AND {number} % 3 <> 0)"""
    out["csv_union_scan"] = f"WITH {RAW}, {exports} SELECT * FROM exports"
    out["merged_exports"] = f"""WITH {RAW}, {exports} SELECT DISTINCT "_id", "_source.timestamp" AS time_text,
"_source.agent.name" AS agent FROM exports"""
    even = f"(SELECT count(*) FROM raw WHERE {number} % 2 = 0)"
    odd = f"(SELECT count(*) FROM raw WHERE {number} % 2 = 1)"
    short = f"(SELECT count(*) FROM raw WHERE {number} % 50 = 0 AND {number} % 3 <> 0)"
    first, second = f"({even} + {short})", odd

    def cover(c: str) -> str:
        inside = [g for g, has in ((first, c in [*names[:4], "_source.rule.level"]), (second, c in names)) if has]
        total = " + ".join(inside)
        return f"""SELECT '{c}' AS "column", count("{c}") AS non_null, {total} AS total,
round(count("{c}") / greatest({total}, 1), 6) AS coverage,
count(*) FILTER (WHERE TRY_CAST("{c}" AS DOUBLE) = 0) AS zeros FROM exports"""
    out["profiled_exports"] = f"""WITH {RAW}, {exports}, report AS ({" UNION ALL ".join(cover(c) for c in RAW_COLUMNS)})
SELECT *, coverage >= 0.9 AS kept FROM report"""
    out["clean_table"] = done["canonicalise"]
    out["service_columns"] = f"""SELECT event_id, "timestamp", 'canon-' || agent AS agent, rule_id, rule_level, decoder FROM ({done["canonicalise"]})"""
    out["strict_times"] = """SELECT CAST(event_id AS VARCHAR) AS event_id,
CASE event_id % 3 WHEN 0 THEN date_trunc('millisecond', ts) WHEN 1 THEN date_trunc('second', ts) END AS lenient,
CASE event_id % 3 WHEN 0 THEN date_trunc('millisecond', ts) END AS "strict" FROM events"""
    out["sorted_table"] = f"""WITH {RAW} SELECT row_number() OVER (ORDER BY CASE WHEN {number} % 9 <> 0 THEN
strptime("_source.timestamp", '%b %d, %Y @ %H:%M:%S.%g') END NULLS LAST, "_id") AS place, "_id" FROM raw"""
    out["existing_scores"] = f"""{w}, x AS (SELECT *, rule_level + hour("timestamp") / 100.0 AS s FROM alerts),
r AS (SELECT row_number() OVER (ORDER BY s DESC, event_id) AS "rank", event_id, rule_level, round(CAST(s AS DOUBLE), 6) AS anomaly_score FROM x)
SELECT * FROM r WHERE "rank" <= 20"""
    out["typed_csv"] = f"""{w} SELECT event_id, CASE WHEN CAST(event_id AS BIGINT) % 2 = 0
THEN date_trunc('millisecond', "timestamp") ELSE date_trunc('second', "timestamp") END AS "timestamp",
agent, rule_id, rule_level, decoder FROM alerts"""
    out["projected_scan"] = f"{w} SELECT event_id, agent, 2 AS n_some, 6 AS n_every FROM alerts"
    out["split_table"] = f"""{w}, {T2} SELECT event_id, agent, (SELECT count(*) FROM alerts) AS n_input,
0 AS dropped_no_time FROM t2"""
    out["stored_statistics"] = done["features_full"]
    out["scored_table"] = f"""{w}, {FORMULA}, n AS (SELECT count(*) AS n, CAST(greatest(1, ceil(CAST(0.01 AS DOUBLE) * count(*))) AS BIGINT) AS k
FROM alerts), top AS (SELECT anomaly_score FROM scored ORDER BY anomaly_score DESC, event_id LIMIT (SELECT k FROM n))
SELECT count(*) AS n_top, round(min(anomaly_score), 6) AS least_score, TRUE AS timed, (SELECT n FROM n) AS n_scored,
(SELECT k FROM n) AS n_selected FROM top"""
    out["service_reply"] = f"""SELECT "rank", event_id, rule_level, anomaly_score FROM ({done["topk_formula_score"]})"""

    def evaluated(inject: str) -> str:
        return f"""WITH inj AS MATERIALIZED (SELECT * FROM ({done[inject]}) WHERE y_mask_eval = 1),
alerts AS (SELECT event_id, "timestamp", agent, rule_id, rule_level, decoder FROM inj), {FORMULA},
labelled AS (SELECT s.event_id, i.y_true_synth AS y, i.synth_usecase,
row_number() OVER (ORDER BY round(anomaly_score, 9) DESC, s.event_id) AS rnk FROM scored s JOIN inj i USING (event_id))"""

    n, pos = "(SELECT count(*) FROM labelled)", "(SELECT sum(y) FROM labelled)"
    out["injected_metrics"] = f"""{evaluated("inject_replace")}, b AS (
SELECT p, CAST(greatest(1, ceil(p * (SELECT count(*) FROM labelled))) AS BIGINT) AS k
FROM (SELECT CAST(unnest([0.01, 0.02, 0.05]) AS DOUBLE) AS p)),
t AS (SELECT p, k, (SELECT sum(y) FROM labelled WHERE rnk <= k) AS tp FROM b)
SELECT p, k, tp, k - tp AS fp, {pos} - tp AS fn, {n} - {pos} - (k - tp) AS tn, {_figures('tp', 'k', n, pos)} FROM t"""
    out["injected_families"] = f"""{evaluated("inject_append")}
SELECT synth_usecase AS family, count(*) AS positives, count(*) FILTER (WHERE rnk <= 100) AS hits,
round(count(*) FILTER (WHERE rnk <= 100) / count(*), 6) AS recall FROM labelled WHERE y = 1 GROUP BY 1"""
    return out
