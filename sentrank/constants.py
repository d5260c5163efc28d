"""Fixed values shared by the whole package.

Everything below has to keep its exact spelling and order: downstream consumers
of the alert tables rely on these names, patterns and weights.
"""

# --- fixed values: canonical alert schema --------------------------------
CANONICAL = ["event_id", "timestamp", "agent", "rule_id", "rule_level", "decoder"]

# --- fixed values: raw column candidates, first present wins ---------------
CLEAN_CANDIDATES = {
    "event_id": ["_id", "event_id", "id"],
    "timestamp": ["_source.timestamp", "timestamp", "@timestamp", "event.timestamp"],
    "agent_name": ["agent.name", "_source.agent.name", "agentName"],
    "agent_id": ["agent.id", "_source.agent.id", "agentId"],
    "rule_id": ["rule.id", "_source.rule.id", "ruleId"],
    "rule_level": ["rule.level", "_source.rule.level", "ruleLevel", "level"],
    "decoder": ["decoder.name", "_source.decoder.name", "decoder"],
}
SERVICE_CANDIDATES = {
    "event_id": ["event_id", "_id", "id"],
    "timestamp": ["timestamp", "_source.timestamp", "@timestamp", "_source.@timestamp"],
    "agent": ["agent", "_source.agent.name", "_source.agent.id", "agent.name", "agent.id"],
    "rule_id": ["rule_id", "_source.rule.id", "rule.id"],
    "rule_level": ["rule_level", "_source.rule.level", "rule.level"],
    "decoder": ["decoder", "_source.decoder.name", "decoder.name"],
}
RAW_TIMESTAMP = "_source.@timestamp"

# --- fixed values: the sixteen model features, in model order ---------------
FEATURES = [
    "hour_local", "is_off_hours", "day_of_week", "is_weekend",
    "second_in_hour", "seconds_in_hour_bucketed", "hour_bucket",
    "rule_level", "rule_level_z_host",
    "rule_time_since_last_host_log1p", "recency_x_rule_level",
    "offhours_x_rule_level", "offhours_x_rule_level_z", "weekend_x_rule_level_z",
    "agent_rule_hour_hash01", "agent_rule_hour_freq_log1p",
]

# --- fixed values: time text patterns (export text, optional fraction) ------
EXPORT_PATTERN = "MMM d, yyyy '@' H:mm:ss[.SSSSSS]"
EXPORT_PATTERN_STRICT = "MMM d, yyyy '@' H:mm:ss.SSSSSS"
EXPORT_FORMAT = "MMM dd, yyyy '@' HH:mm:ss.SSS"
ISO_SECONDS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"

# --- fixed values: injection families, in allocation order ------------------
FAMILIES = ["offhours", "rule_new", "decoder_new", "level_out"]
DEFAULT_HOST_LEVEL = 3.0

# --- fixed values: label words that mean "anomalous" -------------------------
LABEL_TOKENS = ["anom", "outlier", "attack", "malicious", "fraud", "bad", "novel"]

# --- fixed values: formula score weights -------------------------------------
W_LEVEL, W_OFF_HOURS, W_RARITY, MINMAX_EPS = 0.5, 1.0, 2.0, 1e-9

# --- fixed values: reply columns in reply order -------------------------------
REPLY_COLUMNS = [
    "rank", "event_id", "timestamp", "agent", "rule_id", "decoder",
    "rule_level", "anomaly_score", "explanations",
]
DELTA_KEY = "delta_score_if_replaced_by_train_median"

# --- fixed values: cells a CSV scan reads as missing (the usual NA spellings) ---
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
