"""Ingestion, data-quality, merge, calendar and serving queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.digests import manifest_digest, ordered_set_sha256, tree_digest
from riskloom.functions.expr import business_key, castable, in_force, record_hash, semver, shown
from riskloom.operators import merge as G
from riskloom.operators import resolve as V
from riskloom.operators import risk as R
from riskloom.operators import serving as S
from riskloom.operators.calendar import calendar_checks, date_spine, session_pairs as pair_sessions, trading_calendar as make_calendar
from riskloom.operators.rules import QUARANTINE, REJECT, WARN, WARNING, Rule, judged, summarise, violations
from riskloom.plans import driver_tables as T
from riskloom.plans.catalog import query
from riskloom.sources.landing import ingestion_plan as plan_ingestion
from riskloom.sources.landing import with_lineage
from riskloom.sources.providers import normalised_actions, normalised_prices
from riskloom.sources.synthetic import basis_points, price_paths

M = T.money


# ---- typing and rules -------------------------------------------------------------------------------------------

@query(
    f"WITH {T.RAW} SELECT source_record_id, l_orderkey, raw_quantity, raw_price, raw_date, {M('quantity', 2)} AS quantity, {M('price', 2)} AS price, CAST(ship_date AS VARCHAR) AS ship_date, "
    + ", ".join(f"NOT (NULLIF(TRIM({r}), '') IS NOT NULL AND {t} IS NULL) AS {t}_castable" for r, t in (("raw_quantity", "quantity"), ("raw_price", "price"), ("raw_date", "ship_date")))
    + " FROM typed"
)
def typed_casts_with_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.typed_items(spark, sf_dir)
    flags = [castable(r, t).alias(f"{t}_castable") for r, t in (("raw_quantity", "quantity"), ("raw_price", "price"), ("raw_date", "ship_date"))]
    return rows.select("source_record_id", "l_orderkey", "raw_quantity", "raw_price", "raw_date", shown(F.col("quantity"), 2).alias("quantity"), shown(F.col("price"), 2).alias("price"), F.col("ship_date").cast("string").alias("ship_date"), *flags)


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.table(spark, sf_dir, "part").where("p_size > 2").select("p_partkey", "p_brand")
    return T.typed_items(spark, sf_dir).join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")


def _rules() -> list[Rule]:
    lost = ~castable("raw_quantity", "quantity") | ~castable("raw_price", "price") | ~castable("raw_date", "ship_date")
    missing = F.col("quantity").isNull() | F.col("price").isNull() | F.col("ship_date").isNull()
    return [
        Rule("REQUIRED_FIELDS", missing, message="a required field is missing", observed=("raw_quantity", "raw_price", "raw_date")),
        Rule("TYPES_CASTABLE", lost, message="a value can't be cast"),
        Rule("POSITIVE_VALUES", F.col("price") <= 0, field_name="price", expected="> 0", observed=("raw_price",)),
        Rule("INSTRUMENT_MAPPING", F.col("p_partkey").isNull(), disposition=QUARANTINE, field_name="l_partkey", expected="an active part"),
        Rule("VOLUME_LARGE", F.col("quantity") > 45, severity=WARNING, disposition=WARN, field_name="quantity", expected="<= 45"),
    ]


_ENRICHED = f"WITH {T.RAW}, enriched AS (SELECT typed.*, p_partkey FROM typed LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 2) ON l_partkey = p_partkey)"
_VIOLATIONS = f"""{_ENRICHED}, violations AS (
SELECT source_record_id, 'REQUIRED_FIELDS' AS rule_id, 'ERROR' AS severity, 'REJECT' AS disposition, '' AS affected_field, raw_quantity || ';' || raw_price || ';' || raw_date AS observed, '' AS expected, 'a required field is missing' AS message FROM enriched WHERE quantity IS NULL OR price IS NULL OR ship_date IS NULL
UNION ALL SELECT source_record_id, 'TYPES_CASTABLE', 'ERROR', 'REJECT', '', NULL, '', 'a value can''t be cast' FROM enriched WHERE (TRIM(raw_quantity) <> '' AND quantity IS NULL) OR (TRIM(raw_price) <> '' AND price IS NULL) OR (TRIM(raw_date) <> '' AND ship_date IS NULL)
UNION ALL SELECT source_record_id, 'POSITIVE_VALUES', 'ERROR', 'REJECT', 'price', raw_price, '> 0', '' FROM enriched WHERE price <= 0
UNION ALL SELECT source_record_id, 'INSTRUMENT_MAPPING', 'ERROR', 'QUARANTINE', 'l_partkey', NULL, 'an active part', '' FROM enriched WHERE p_partkey IS NULL
UNION ALL SELECT source_record_id, 'VOLUME_LARGE', 'WARNING', 'WARN_AND_ACCEPT', 'quantity', NULL, '<= 45', '' FROM enriched WHERE quantity > 45),
summary AS (SELECT source_record_id, COUNT(*) AS violation_count, COUNT(*) FILTER (severity = 'WARNING') AS warning_count, BOOL_OR(disposition = 'REJECT') AS has_reject, BOOL_OR(disposition = 'QUARANTINE') AS has_quarantine, BOOL_OR(severity = 'ERROR') AS has_error FROM violations GROUP BY 1)"""


@query(f"{_VIOLATIONS} SELECT * FROM violations")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven fields; the observed values, a JSON text, are compared value by value."""
    rows = violations(_enriched(spark, sf_dir), _rules(), ["source_record_id"])
    values = F.concat_ws(";", *[F.get_json_object("observed_value", f"$.{c}") for c in ("raw_quantity", "raw_price", "raw_date")])
    return rows.withColumn("observed", F.when(F.col("observed_value").isNotNull(), values)).drop("observed_value")


@query(f"{_VIOLATIONS} SELECT * FROM summary")
def violation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(violations(_enriched(spark, sf_dir), _rules(), ["source_record_id"]), ["source_record_id"])


@query(f"{_VIOLATIONS} SELECT source_record_id, COALESCE(violation_count, 0) AS violation_count, COALESCE(warning_count, 0) AS warning_count, COALESCE(has_reject, FALSE) AS has_reject, COALESCE(has_quarantine, FALSE) AS has_quarantine, COALESCE(has_error, FALSE) AS has_error FROM enriched LEFT JOIN summary USING (source_record_id)")
def judged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary beside every row, by one projection."""
    return judged(_enriched(spark, sf_dir), _rules()).select("source_record_id", "violation_count", "warning_count", "has_reject", "has_quarantine", "has_error")


# ---- duplicates, conflicts, corrections -------------------------------------------------------------------------

_KEY = ["l_orderkey", "l_linenumber"]
_MARKET = """market AS (SELECT *, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS key_count, MIN(record_hash) OVER (PARTITION BY l_orderkey, l_linenumber) <> MAX(record_hash) OVER (PARTITION BY l_orderkey, l_linenumber) AS is_conflict,
ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber, record_hash ORDER BY source_row_number) AS duplicate_rank, MIN(source_row_number) OVER (PARTITION BY l_orderkey, l_linenumber, record_hash) AS winner FROM typed)"""
_VERSIONED = """versioned AS (SELECT t.*, h.hash_count > 1 AS is_conflict, ROW_NUMBER() OVER (PARTITION BY t.l_orderkey, t.l_linenumber ORDER BY source_row_number) AS key_rank FROM typed t JOIN (SELECT l_orderkey, l_linenumber, COUNT(DISTINCT record_hash) AS hash_count FROM typed GROUP BY 1, 2) h USING (l_orderkey, l_linenumber))"""
# the canonical table: the first row of every key with l_linenumber <= 3, every seventh order with other content, at version 1.<linenumber>.0
_CURRENT = """current AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN sha256(record_hash) ELSE record_hash END AS current_hash, '1.' || CAST(l_linenumber AS VARCHAR) || '.0' AS current_version FROM typed WHERE l_linenumber <= 3 QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY source_row_number) = 1)"""
_COMPARE_M = f"WITH {T.RAW}, {_MARKET}, {_CURRENT}, compared AS (SELECT m.*, CASE WHEN current_hash IS NULL THEN 'NEW' WHEN current_hash = record_hash THEN 'UNCHANGED' ELSE 'CORRECTION' END AS comparison FROM market m LEFT JOIN current USING (l_orderkey, l_linenumber))"
_COMPARE_V = f"""WITH {T.RAW}, {_VERSIONED}, {_CURRENT}, v AS (SELECT versioned.*, CASE WHEN l_orderkey % 3 = 0 THEN '1.10.0' ELSE '1.' || CAST(l_linenumber AS VARCHAR) || '.0' END AS version FROM versioned),
compared AS (SELECT v.*, current_version, CASE WHEN current_hash IS NULL THEN 'NEW' WHEN current_hash = record_hash AND current_version = version THEN 'UNCHANGED' WHEN current_hash <> record_hash AND CAST(split_part(version, '.', 2) AS INT) > CAST(split_part(current_version, '.', 2) AS INT) THEN 'CORRECTION' ELSE 'REJECTED' END AS comparison FROM v LEFT JOIN current USING (l_orderkey, l_linenumber))"""


def _market(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    return V.same_batch_market(T.typed_items(spark, sf_dir) if items is None else items, _KEY, "record_hash", ["source_row_number"])


def _versioned(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    return V.same_batch_versioned(T.typed_items(spark, sf_dir) if items is None else items, business_key(_KEY), "source_record_id", "record_hash", ["source_row_number"])


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.typed_items(spark, sf_dir).where("l_linenumber <= 3").groupBy(*_KEY).agg(F.min_by("record_hash", "source_row_number").alias("h"))
    return rows.select(*_KEY, F.when(F.col("l_orderkey") % 7 == 0, F.sha2("h", 256)).otherwise(F.col("h")).alias("record_hash"), F.concat(F.lit("1."), F.col("l_linenumber").cast("string"), F.lit(".0")).alias("version"))


def _long(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


@query(f"WITH {T.RAW}, {_MARKET} SELECT source_record_id, key_count, is_conflict, duplicate_rank, winner, duplicate_rank > 1 AS is_duplicate FROM market")
def same_batch_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _market(spark, sf_dir).select("source_record_id", *_long("key_count", "duplicate_rank", "winner"), "is_conflict", "is_duplicate")


@query(f"WITH {T.RAW}, {_VERSIONED} SELECT source_record_id, key_rank, is_conflict, NOT is_conflict AND key_rank > 1 AS is_duplicate FROM versioned")
def same_batch_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versioned(spark, sf_dir).select("source_record_id", *_long("key_rank"), "is_conflict", "is_duplicate")


def _compared_market(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    return V.compare_market(_market(spark, sf_dir, items), _current(spark, sf_dir), _KEY, "record_hash")


def _compared_versioned(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    rows = _versioned(spark, sf_dir, items).withColumn("version", F.when(F.col("l_orderkey") % 3 == 0, "1.10.0").otherwise(F.concat(F.lit("1."), F.col("l_linenumber").cast("string"), F.lit(".0"))))
    return V.compare_versioned(rows, _current(spark, sf_dir), _KEY, "record_hash", "version")


@query(f"{_COMPARE_M} SELECT source_record_id, comparison FROM compared")
def canonical_compare_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared_market(spark, sf_dir).select("source_record_id", "comparison")


@query(f"{_COMPARE_V} SELECT source_record_id, version, comparison FROM compared")
def canonical_compare_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared_versioned(spark, sf_dir).select("source_record_id", "version", "comparison")


_FINAL_M = f"""{_VIOLATIONS}, {_MARKET}, {_CURRENT}, compared AS (SELECT m.*, CASE WHEN current_hash IS NULL THEN 'NEW' WHEN current_hash = record_hash THEN 'UNCHANGED' ELSE 'CORRECTION' END AS comparison FROM market m LEFT JOIN current USING (l_orderkey, l_linenumber)),
final AS (SELECT source_record_id, CASE WHEN COALESCE(has_reject, FALSE) THEN 'REJECTED' WHEN COALESCE(has_quarantine, FALSE) OR is_conflict THEN 'QUARANTINED' WHEN duplicate_rank > 1 THEN 'DEDUPLICATED' WHEN comparison = 'NEW' THEN 'ACCEPTED_NEW' WHEN comparison = 'UNCHANGED' THEN 'UNCHANGED' ELSE 'ACCEPTED_CORRECTION' END AS outcome FROM compared LEFT JOIN summary USING (source_record_id))"""


def _final_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _compared_market(spark, sf_dir, judged(_enriched(spark, sf_dir), _rules()))
    blocked = F.col("has_quarantine") | F.col("is_conflict")
    return rows.select("source_record_id", V.outcome_market(F.col("has_reject"), blocked, F.col("is_duplicate"), F.col("comparison")).alias("outcome"))


@query(f"{_FINAL_M} SELECT * FROM final")
def final_outcomes_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final_market(spark, sf_dir)


@query(
    f"{_VIOLATIONS}, {_COMPARE_V[len('WITH ' + T.RAW) + 2:]} SELECT source_record_id, CASE WHEN COALESCE(has_error, FALSE) OR is_conflict THEN 'REJECTED' WHEN key_rank > 1 THEN 'DEDUPLICATED' WHEN comparison = 'NEW' THEN 'ACCEPTED_NEW' WHEN comparison = 'UNCHANGED' THEN 'UNCHANGED' WHEN comparison = 'CORRECTION' THEN 'ACCEPTED_CORRECTION' ELSE 'REJECTED' END AS outcome FROM compared LEFT JOIN summary USING (source_record_id)"
)
def final_outcomes_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _compared_versioned(spark, sf_dir, judged(_enriched(spark, sf_dir), _rules()))
    return rows.select("source_record_id", V.outcome_versioned(F.col("has_error"), F.col("is_conflict"), F.col("is_duplicate"), F.col("comparison")).alias("outcome"))


_BATCH = "SELECT source_record_id, 'LINE_SAME_BATCH_CONFLICT' AS rule_id, 'ERROR' AS severity, '{0}' AS disposition FROM {1} WHERE is_conflict UNION ALL SELECT source_record_id, 'LINE_SAME_BATCH_IDENTICAL_DUPLICATE', 'WARNING', 'DEDUPLICATE' FROM {1} WHERE {2} > 1 AND NOT is_conflict"


@query(f"WITH {T.RAW}, {_MARKET} " + _BATCH.format("QUARANTINE", "market", "duplicate_rank"))
def batch_violations_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.batch_violations(_market(spark, sf_dir), ["source_record_id"], "LINE", QUARANTINE).select("source_record_id", "rule_id", "severity", "disposition")


@query(f"WITH {T.RAW}, {_VERSIONED} " + _BATCH.format("REJECT", "versioned", "key_rank"))
def batch_violations_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.batch_violations(_versioned(spark, sf_dir), ["source_record_id"], "LINE", REJECT).select("source_record_id", "rule_id", "severity", "disposition")


@query(f"{_COMPARE_V} SELECT source_record_id, 'LINE_INVALID_CORRECTION' AS rule_id, version AS observed_version, current_version FROM compared WHERE comparison = 'REJECTED'")
def invalid_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.correction_violations(_compared_versioned(spark, sf_dir), ["source_record_id"], "LINE", "version")
    return rows.select("source_record_id", "rule_id", F.get_json_object("observed_value", "$.version").alias("observed_version"), F.get_json_object("observed_value", "$.current_version").alias("current_version"))


@query(
    f"{_FINAL_M}, counts AS (SELECT COUNT(*) AS evaluated, {', '.join(f'COUNT(*) FILTER (outcome = $${k}$$) AS {k.lower()}' for k in ('ACCEPTED_NEW', 'ACCEPTED_CORRECTION', 'UNCHANGED', 'DEDUPLICATED', 'QUARANTINED', 'REJECTED'))} FROM final) "
    "SELECT *, accepted_new + accepted_correction + unchanged + deduplicated + quarantined + rejected = evaluated AS is_conserved, CASE WHEN rejected > 0 OR quarantined > 0 THEN 'FAILED' WHEN deduplicated > 0 THEN 'SUCCEEDED_WITH_WARNINGS' ELSE 'SUCCEEDED' END AS status, rejected = 0 AND quarantined = 0 AND accepted_new + accepted_correction > 0 AS published FROM counts"
)
def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.publication(V.conservation(_final_market(spark, sf_dir)))


# ---- merges -----------------------------------------------------------------------------------------------------

_ORDERS = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))


def _state(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", "o_orderstatus", shown(F.col("amount"), 2).alias("amount"))


# the table holds finished and open orders; the batch brings open and pending ones, all of them changed
@query(f"WITH {_ORDERS} SELECT o_orderkey, o_orderstatus, {M('CASE WHEN o_orderstatus <> $$F$$ THEN amount + 1 ELSE amount END', 2)} AS amount FROM o")
def prospective_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    source = o.where("o_orderstatus <> 'F'").withColumn("amount", (F.col("amount") + 1).cast("decimal(18,2)"))
    return _state(G.upsert(o.where("o_orderstatus <> 'P'"), source, ["o_orderkey"]))


@query(f"WITH {_ORDERS} SELECT o_orderkey, o_orderstatus, {M('CASE WHEN o_orderstatus = $$P$$ THEN amount + 1 ELSE amount END', 2)} AS amount FROM o")
def insert_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    source = o.where("o_orderstatus <> 'F'").withColumn("amount", (F.col("amount") + 1).cast("decimal(18,2)"))
    return _state(G.insert_only(o.where("o_orderstatus <> 'P'"), source, ["o_orderkey"]))


@query(f"WITH {_ORDERS} SELECT o_orderkey, o_orderstatus, {M('CASE WHEN o_orderstatus = $$F$$ THEN amount * 2 ELSE amount END', 2)} AS amount FROM o WHERE o_orderstatus <> 'F' OR amount > 1000")
def partition_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    source = o.where("o_orderstatus = 'F' AND amount > 1000").withColumn("amount", (F.col("amount") * 2).cast("decimal(18,2)"))
    return _state(G.replace_partition(o, source, F.col("o_orderstatus") == "F"))


@query(f"WITH {_ORDERS} SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'INSERT' WHEN amount > 100000 THEN 'UPDATE' ELSE 'UNCHANGED' END AS action, {M('CASE WHEN o_orderstatus = $$P$$ OR amount > 100000 THEN amount + 1 ELSE amount END', 2)} AS amount FROM o")
def conditional_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next state of every order beside the action that led to it."""
    hashed = lambda df: df.withColumn("record_hash", record_hash(["o_orderkey", "o_orderstatus", "amount"]))
    o = _orders(spark, sf_dir)
    changes = (F.col("amount") > 100000) | (F.col("o_orderstatus") == "P")
    source = o.withColumn("amount", F.when(changes, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(18,2)"))
    state, actions = G.conditional_upsert(hashed(o.where("o_orderstatus <> 'P'")), hashed(source), ["o_orderkey"], "record_hash")
    return state.join(actions.select("o_orderkey", "action"), "o_orderkey").select("o_orderkey", "action", shown(F.col("amount"), 2).alias("amount"))


@query("WITH a AS (SELECT event_type, CAST(ts AS DATE) AS d FROM events WHERE event_id % 2 = 0), b AS (SELECT event_type, CAST(ts AS DATE) AS d FROM events WHERE event_id % 2 = 1), x AS (SELECT COUNT(*) AS only_left FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)), y AS (SELECT COUNT(*) AS only_right FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) SELECT only_left, only_right, only_left = 0 AND only_right = 0 AS is_equal FROM x, y")
def bag_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("date").alias("d"), "event_id")
    return G.bag_difference(rows.where("event_id % 2 = 0").drop("event_id"), rows.where("event_id % 2 = 1").drop("event_id"))


# ---- hashes -----------------------------------------------------------------------------------------------------

_HASH = "sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), COALESCE(o_orderstatus, '<NULL>'), COALESCE(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '<NULL>'), COALESCE(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '<NULL>')))"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders")
    return o.withColumn("record_hash", record_hash(["o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderdate").cast("date")]))


@query(f"SELECT o_orderkey, {_HASH} AS record_hash, sha256(concat_ws('|', 'run-1', CAST(o_orderkey AS VARCHAR))) AS outcome_id FROM orders")
def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir).select("o_orderkey", "record_hash", F.sha2(F.concat_ws("|", F.lit("run-1"), F.col("o_orderkey").cast("string")), 256).alias("outcome_id"))


@query("SELECT COUNT(*) AS row_count, sha256(string_agg(concat_ws('|', CAST(p_partkey AS VARCHAR), p_brand, p_type), chr(10) ORDER BY p_partkey)) AS digest FROM part")
def ordered_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.table(spark, sf_dir, "part")
    return parts.agg(F.count(F.lit(1)).alias("row_count"), ordered_set_sha256(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_brand", "p_type"), F.col("p_partkey")).alias("digest"))


@query("SELECT p_brand, COUNT(*) AS row_count, sha256(string_agg(concat_ws('|', CAST(p_partkey AS VARCHAR), p_type), chr(10) ORDER BY p_partkey)) AS digest FROM part GROUP BY 1")
def grouped_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.table(spark, sf_dir, "part")
    return parts.groupBy("p_brand").agg(F.count(F.lit(1)).alias("row_count"), ordered_set_sha256(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_type"), F.col("p_partkey")).alias("digest"))


@query(
    # for up to 16**3 leaves of 4,096 rows, which have two levels
    f"WITH k AS (SELECT CASE WHEN COUNT(*) <= 4096 THEN 0 ELSE CAST(CEIL(LOG2(COUNT(*) / 4096.0) / 4) AS INT) END AS digits FROM orders), b AS (SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, digits) AS b, string_agg({_HASH}, chr(10) ORDER BY o_orderkey) AS members, COUNT(*) AS n FROM orders, k GROUP BY 1) SELECT 'orders' AS dataset, CAST(SUM(n) AS BIGINT) AS row_count, sha256(string_agg(sha256(members), chr(10) ORDER BY b)) AS digest FROM b"
)
def tree_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashed(spark, sf_dir).withColumn("dataset", F.lit("orders"))
    return tree_digest(rows, ["dataset"], F.col("record_hash"), F.col("o_orderkey")).select("dataset", F.col("rows").cast("bigint").alias("row_count"), "digest")


@query(
    "WITH e AS (SELECT 'nation' AS dataset, COUNT(*) AS n, sha256(string_agg(concat_ws('|', CAST(n_nationkey AS VARCHAR), n_name), chr(10) ORDER BY n_nationkey)) AS d FROM nation UNION ALL SELECT 'region', COUNT(*), sha256(string_agg(concat_ws('|', CAST(r_regionkey AS VARCHAR), r_name), chr(10) ORDER BY r_regionkey)) FROM region) "
    "SELECT COUNT(*) AS datasets, sha256(string_agg(concat_ws('|', dataset, '1.0.0', 'snapshot-1', 'all', CAST(n AS VARCHAR), d), chr(10) ORDER BY dataset)) AS manifest_sha256 FROM e"
)
def input_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    def entry(name: str, prefix: str) -> DataFrame:
        key = f"{prefix}_{name}key"
        rows = T.table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("rows"), ordered_set_sha256(F.concat_ws("|", F.col(key).cast("string"), f"{prefix}_name"), F.col(key)).alias("digest"))
        return rows.select(F.lit(name).alias("dataset"), F.lit("1.0.0").alias("contract_version"), F.lit("snapshot-1").alias("snapshot_ref"), F.lit("all").alias("scope"), "rows", "digest")

    return manifest_digest(entry("nation", "n").unionByName(entry("region", "r")))


# ---- runs, ranges, coverage -------------------------------------------------------------------------------------

_RUNS = "runs AS (SELECT o_orderkey AS run_id, o_custkey AS portfolio_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS as_of, CAST(o_orderdate AS DATE) AS published_at, o_orderstatus AS status FROM orders)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("portfolio_id"), F.trunc(day, "month").alias("as_of"), day.alias("published_at"), F.col("o_orderstatus").alias("status"))


@query(f"WITH {_RUNS} SELECT portfolio_id, CAST(as_of AS VARCHAR) AS as_of, run_id FROM runs WHERE status = 'F' QUALIFY ROW_NUMBER() OVER (PARTITION BY portfolio_id, as_of ORDER BY published_at DESC, run_id DESC) = 1")
def latest_published_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.latest_published(_runs(spark, sf_dir), ["portfolio_id", "as_of"], ["published_at", "run_id"], F.col("status") == "F")
    return rows.select("portfolio_id", F.col("as_of").cast("string").alias("as_of"), "run_id")


@query(f"WITH {_RUNS} SELECT run_id, ROW_NUMBER() OVER w AS attempt_number, CAST(LAG(run_id) OVER w AS VARCHAR) AS reprocess_of FROM runs WINDOW w AS (PARTITION BY portfolio_id ORDER BY published_at, run_id)")
def attempt_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.attempts(_runs(spark, sf_dir), ["portfolio_id"], ["published_at", "run_id"], "run_id").select("run_id", *_long("attempt_number"), F.col("reprocess_of").cast("string").alias("reprocess_of"))


@query(f"WITH {_RUNS} SELECT portfolio_id, CAST(as_of AS VARCHAR) AS as_of, COUNT(*) AS run_count, COUNT(*) = 1 AS is_single FROM runs GROUP BY 1, 2")
def published_run_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.exactly_one_run(_runs(spark, sf_dir), ["portfolio_id", "as_of"])
    return rows.withColumn("as_of", F.col("as_of").cast("string"))


_RANGES = "ranges AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS f, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INT) END AS t FROM orders)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.struct(day, "o_orderkey").alias("at"), day.alias("effective_from"), F.when(F.col("o_orderkey") % 10 != 0, F.date_add(day, (F.col("o_orderkey") % 200).cast("int"))).alias("effective_to"))


@query(f"WITH {_RANGES}, n AS (SELECT *, LEAD(f) OVER (PARTITION BY o_custkey ORDER BY f) AS nf FROM (SELECT o_custkey, f, MAX(COALESCE(t, DATE '9999-12-31')) AS t FROM ranges GROUP BY 1, 2)) SELECT o_custkey, CAST(f AS VARCHAR) AS effective_from, CAST(nf AS VARCHAR) AS next_start FROM n WHERE nf IS NOT NULL AND t >= nf")
def effective_range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranges(spark, sf_dir).groupBy("o_custkey", "effective_from").agg(F.max(F.coalesce("effective_to", F.lit("9999-12-31").cast("date"))).alias("effective_to"))
    found = S.effective_overlaps(rows, ["o_custkey"], "effective_from", "effective_to")
    return found.select("o_custkey", F.col("effective_from").cast("string").alias("effective_from"), F.col("next_start").cast("string").alias("next_start"))


@query(f"WITH {_RANGES} SELECT o_orderkey, o_custkey FROM ranges WHERE f <= DATE '1998-01-01' AND (t IS NULL OR t >= DATE '1998-01-01')")
def effective_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir).where(in_force("effective_from", "effective_to", F.lit("1998-01-01").cast("date"))).select("o_orderkey", "o_custkey")


@query(f"SELECT l_orderkey AS portfolio_id, {', '.join(f'{M(e)} AS {n}' for n, e in (('long_weight', 'SUM(CASE WHEN w > 0 THEN w ELSE 0 END)'), ('short_weight', 'SUM(CASE WHEN w < 0 THEN -w ELSE 0 END)'), ('gross_weight', 'SUM(ABS(w))'), ('net_weight', 'SUM(w)')))} FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS DECIMAL(18,2)) ELSE CAST(l_quantity AS DECIMAL(18,2)) END AS w FROM lineitem) GROUP BY 1")
def allocation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("decimal(18,2)")
    rows = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("portfolio_id"), F.when(F.col("l_returnflag") == "R", -q).otherwise(q).alias("target_weight"))
    return S.allocation_totals(rows).select("portfolio_id", *[shown(F.col(c)).alias(c) for c in ("long_weight", "short_weight", "gross_weight", "net_weight")])


@query("SELECT u.user_id, CAST(d.d AS VARCHAR) AS d FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') u CROSS JOIN (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND CAST(e.ts AS DATE) = d.d AND e.event_type = 'purchase')")
def expected_grid_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").cast("string").alias("d"), "event_type")
    bought = events.where("event_type = 'purchase'")
    return R.expected_grid_missing(bought.select("user_id").distinct(), events.select("d").distinct(), bought, ["user_id", "d"])


@query("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS row_count FROM orders WHERE o_orderpriority SIMILAR TO '[0-9]-[A-Z ]+' AND lower(o_orderpriority) LIKE '%i%' AND o_orderstatus IN ('F', 'O') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1, 2")
def predicate_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular expressions, folded substrings, membership and inclusive date windows in one filter."""
    o = T.table(spark, sf_dir, "orders")
    kept = o.where(F.col("o_orderpriority").rlike("^[0-9]-[A-Z ]+$") & F.lower("o_orderpriority").contains("i") & F.col("o_orderstatus").isin("F", "O") & F.col("o_orderdate").cast("date").between(F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date")))
    return kept.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("row_count"))


@query("SELECT v, CAST(split_part(v, '.', 1) AS BIGINT) AS major, CAST(split_part(v, '.', 2) AS BIGINT) AS minor, CAST(split_part(v, '.', 3) AS BIGINT) AS patch, COUNT(*) AS row_count FROM (SELECT CAST(l_linenumber AS VARCHAR) || '.' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.0' AS v FROM lineitem) GROUP BY 1, 2, 3, 4")
def semver_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.lit("0"))
    rows = T.table(spark, sf_dir, "lineitem").select(v.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("row_count"))
    return rows.withColumn("s", semver("v")).select("v", "s.major", "s.minor", "s.patch", "row_count")


# ---- calendar ---------------------------------------------------------------------------------------------------

_HOLIDAYS = {"2016-01-01": "New Year's Day", "2016-07-04": "Independence Day", "2016-12-26": "Christmas Day"}
_CALENDAR = """cal AS (SELECT m AS exchange_mic, d AS calendar_date, CASE d WHEN DATE '2016-01-01' THEN 'New Year''s Day' WHEN DATE '2016-07-04' THEN 'Independence Day' WHEN DATE '2016-12-26' THEN 'Christmas Day' END AS holiday_name, dayofweek(d) IN (0, 6) AS is_weekend
FROM (SELECT CAST(UNNEST(generate_series(DATE '2016-01-01', DATE '2016-12-31', INTERVAL 1 DAY)) AS DATE) AS d) CROSS JOIN (SELECT UNNEST(['XNYS', 'XNAS']) AS m)), calendar AS (SELECT *, NOT is_weekend AND holiday_name IS NULL AS is_trading_day, d.e AS is_early_close FROM cal, LATERAL (SELECT calendar_date = DATE '2016-11-25' AS e) d)"""
# New York is at UTC-5, and at UTC-4 from 13 March to 5 November 2016
_UTC = "CAST(calendar_date AS TIMESTAMP) + INTERVAL 1 MINUTE * ({minutes} + CASE WHEN calendar_date BETWEEN DATE '2016-03-13' AND DATE '2016-11-05' THEN 240 ELSE 300 END)"


def _calendar(spark: SparkSession) -> DataFrame:
    return make_calendar(spark, "2016-01-01", "2016-12-31", ["XNYS", "XNAS"], _HOLIDAYS, ["2016-11-25"])


@query(
    f"WITH {_CALENDAR} SELECT exchange_mic, CAST(calendar_date AS VARCHAR) AS calendar_date, is_trading_day, is_early_close, holiday_name, CASE WHEN is_trading_day THEN strftime({_UTC.format(minutes=570)}, '%Y-%m-%d %H:%M') END AS market_open_utc, CASE WHEN is_trading_day THEN strftime({_UTC.format(minutes='CASE WHEN is_early_close THEN 780 ELSE 960 END')}, '%Y-%m-%d %H:%M') END AS market_close_utc FROM calendar"
)
def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown_utc = [F.date_format(F.convert_timezone(None, F.lit("UTC"), F.col(c).cast("timestamp_ntz")), "yyyy-MM-dd HH:mm").alias(c) for c in ("market_open_utc", "market_close_utc")]
    return _calendar(spark).select("exchange_mic", F.col("calendar_date").cast("string").alias("calendar_date"), "is_trading_day", "is_early_close", "holiday_name", *shown_utc)


@query(f"WITH {_CALENDAR} SELECT exchange_mic, COUNT(*) AS days, COUNT(*) FILTER (is_trading_day) AS sessions, COUNT(*) FILTER (is_early_close) AS early_closes, date_diff('day', MIN(calendar_date), MAX(calendar_date)) + 1 = COUNT(DISTINCT calendar_date) AS is_contiguous, BOOL_AND(NOT is_trading_day OR CASE WHEN is_early_close THEN 780 ELSE 960 END - 570 = CASE WHEN is_early_close THEN 210 ELSE 390 END) AS has_right_durations FROM calendar GROUP BY 1")
def calendar_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar_checks(_calendar(spark))


@query(f"WITH {_CALENDAR}, n AS (SELECT exchange_mic, calendar_date, LEAD(calendar_date) OVER (PARTITION BY exchange_mic ORDER BY calendar_date) AS next_date FROM calendar WHERE is_trading_day) SELECT exchange_mic, CAST(calendar_date AS VARCHAR) AS calendar_date, CAST(next_date AS VARCHAR) AS next_date FROM n WHERE next_date IS NOT NULL")
def session_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pair_sessions(_calendar(spark).where("is_trading_day"))
    return rows.select("exchange_mic", F.col("calendar_date").cast("string").alias("calendar_date"), F.col("next_date").cast("string").alias("next_date"))


@query("WITH s AS (SELECT MIN(CAST(o_orderdate AS DATE)) AS lo, MAX(CAST(o_orderdate AS DATE)) AS hi FROM orders), d AS (SELECT CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM s) SELECT CAST(d AS VARCHAR) AS date_value, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, strftime(d, '%B') AS month_name FROM d")
def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.dim_date(T.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")))
    return rows.withColumn("date_value", F.col("date_value").cast("string"))


# ---- ingestion and serving --------------------------------------------------------------------------------------

_ORDER_RAW = "concat_ws(',', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), COALESCE(o_orderstatus, ''))"


@query(f"SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS source_row_number, {_ORDER_RAW} AS raw_record, sha256({_ORDER_RAW}) AS source_record_sha256, 'batch-1' AS batch_id, 'batch-1:' || CAST(ROW_NUMBER() OVER (ORDER BY o_orderkey) AS VARCHAR) AS source_record_id FROM orders")
def bronze_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    rows = with_lineage(o, ["o_orderkey", "o_custkey", "o_orderstatus"], ["o_orderkey"], "batch-1", "DRIVER", f"{sf_dir}/orders.parquet", "", "1.0.0", "2024-01-01 00:00:00")
    return rows.select("o_orderkey", *_long("source_row_number"), "source_record_id", "raw_record", "source_record_sha256", "batch_id")


@query(
    "WITH log AS (SELECT n_nationkey % 5 AS k, 'batch-' || CAST(n_nationkey AS VARCHAR) AS batch_id FROM nation WHERE n_nationkey IN (1, 2, 7)), p AS (SELECT k, COUNT(*) AS n, MIN(batch_id) AS b FROM log GROUP BY 1) "
    "SELECT 'dataset-' || CAST(r_regionkey AS VARCHAR) AS dataset_name, COALESCE(n, 0) AS prior_batches, CASE COALESCE(n, 0) WHEN 0 THEN 'WRITE' WHEN 1 THEN 'SKIPPED_DUPLICATE' ELSE 'ERROR' END AS decision, CASE COALESCE(n, 0) WHEN 0 THEN 'request-' || CAST(r_regionkey AS VARCHAR) WHEN 1 THEN b END AS effective_batch_id FROM region LEFT JOIN p ON k = r_regionkey"
)
def ingestion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = [F.lit("SRC").alias("source_id"), F.lit("sha").alias("source_sha256")]
    log = T.table(spark, sf_dir, "nation").where("n_nationkey in (1, 2, 7)").select(F.concat(F.lit("dataset-"), (F.col("n_nationkey") % 5).cast("string")).alias("dataset_name"), *same, F.concat(F.lit("batch-"), F.col("n_nationkey").cast("string")).alias("batch_id"), F.lit("SUCCEEDED").alias("status"))
    key = F.col("r_regionkey").cast("string")
    requests = T.table(spark, sf_dir, "region").select(F.concat(F.lit("dataset-"), key).alias("dataset_name"), *same, F.concat(F.lit("request-"), key).alias("request_id"))
    return plan_ingestion(requests, log).select("dataset_name", *_long("prior_batches"), "decision", "effective_batch_id")


# closes with ten digits, so that rounding to eight has work to do; the low is above the close for large quantities
_PROVIDER = """p AS (SELECT concat_ws(':', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS instrument_id, CAST(l_shipdate AS DATE) AS price_date, CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1.0000000050 AS DECIMAL(11,10)) AS c,
CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_quantity > 45 THEN CAST(1.01 AS DECIMAL(3,2)) ELSE CAST(0.99 AS DECIMAL(3,2)) END AS low FROM lineitem),
r AS (SELECT instrument_id, price_date, CAST(ROUND(c, 8) AS DECIMAL(20,8)) AS c, CAST(ROUND(low, 8) AS DECIMAL(20,8)) AS low FROM p)"""


@query(f"WITH {_PROVIDER} SELECT instrument_id, CAST(c AS VARCHAR) AS close_price, CAST(low AS VARCHAR) AS low_price, low <= c AS is_consistent, sha256(concat_ws('|', instrument_id, CAST(price_date AS VARCHAR), 'DRIVER', c, c, low, c, c, 'USD')) AS record_hash FROM r")
def provider_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    c = price * F.lit("1.0000000050").cast("decimal(11,10)")
    low = price * F.when(F.col("l_quantity") > 45, F.lit("1.01")).otherwise(F.lit("0.99")).cast("decimal(3,2)")
    rows = T.table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("instrument_id"),
        F.col("l_shipdate").cast("date").alias("price_date"),
        F.lit("DRIVER").alias("source_id"),
        F.lit("USD").alias("quote_currency"),
        *[v.alias(n) for n, v in (("open_price", c), ("high_price", c), ("low_price", low), ("close_price", c), ("adjusted_close_price", c))],
    )
    return normalised_prices(rows).select("instrument_id", F.col("close_price").cast("string").alias("close_price"), F.col("low_price").cast("string").alias("low_price"), "is_consistent", "record_hash")


@query(
    "WITH a AS (SELECT event_id, CASE WHEN event_type IN ('purchase', 'view') THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END AS d, CASE WHEN event_type IN ('error', 'view') THEN 2 WHEN event_type = 'click' THEN 1 ELSE 0 END AS s FROM events), k AS (SELECT *, CASE WHEN d > 0 AND s = 2 THEN 'ERROR' WHEN d > 0 THEN 'CASH_DIVIDEND' WHEN s = 2 THEN 'STOCK_SPLIT' END AS action_type FROM a) "
    "SELECT event_id, action_type, CAST(CASE WHEN action_type = 'CASH_DIVIDEND' THEN d END AS DOUBLE) AS dividend_amount_per_share, CAST(CASE WHEN action_type = 'STOCK_SPLIT' THEN s END AS DOUBLE) AS split_ratio FROM k WHERE action_type IS NOT NULL"
)
def provider_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = T.table(spark, sf_dir, "events").select("event_id", F.when(kind.isin("purchase", "view"), F.col("value").cast("decimal(18,2)")).otherwise(0).alias("dividend"), F.when(kind.isin("error", "view"), 2).when(kind == "click", 1).otherwise(0).alias("split"))
    return normalised_actions(rows).select("event_id", "action_type", F.col("dividend_amount_per_share").cast("double").alias("dividend_amount_per_share"), F.col("split_ratio").cast("double").alias("split_ratio"))


@query(f"WITH {_RUNS}, g AS (SELECT portfolio_id, as_of, COUNT(*) AS n FROM runs GROUP BY 1, 2) SELECT 'runs' AS view_name, CAST(SUM(n) AS BIGINT) AS row_count, COUNT(*) AS distinct_keys, COUNT(*) FILTER (n > 1) AS duplicate_keys, CAST(COALESCE(SUM(n) FILTER (portfolio_id IS NULL OR as_of IS NULL), 0) AS BIGINT) AS null_keys FROM g")
def serving_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.key_checks(_runs(spark, sf_dir), ["portfolio_id", "as_of"], "runs")


@query(f"WITH {_RUNS}, served AS (SELECT * FROM runs WHERE status = 'F' QUALIFY ROW_NUMBER() OVER (PARTITION BY portfolio_id, as_of ORDER BY published_at DESC, run_id DESC) = 1), gold AS (SELECT portfolio_id, as_of FROM runs WHERE status <> 'P' GROUP BY 1, 2), n AS (SELECT (SELECT COUNT(*) FROM served) AS served_rows, (SELECT COUNT(*) FROM gold) AS gold_rows) SELECT 'latest_published_run' AS view_name, served_rows, gold_rows, served_rows = gold_rows AS is_equal FROM n")
def serving_row_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _runs(spark, sf_dir).where("status <> 'P'").select("portfolio_id", "as_of").distinct()  # open runs too, so that the check has something to find
    return S.row_parity(latest_published_run(spark, sf_dir), gold, "latest_published_run")


@query("SELECT 'customer' AS table_name, COUNT(*) AS row_count FROM customer UNION ALL SELECT 'nation', COUNT(*) FROM nation UNION ALL SELECT 'orders', COUNT(*) FROM orders UNION ALL SELECT 'part', COUNT(*) FROM part")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("customer", "nation", "orders", "part"):
        one = T.table(spark, sf_dir, name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH r AS (SELECT i.v AS instrument_id, d.d, CAST('0x' || substr(sha256('seed-1|INSTRUMENT|' || i.v || '|' || CAST(d.d AS VARCHAR)), 1, 8) AS BIGINT) % 71 - 35 AS bp FROM (SELECT UNNEST(['AAA', 'BBB']) AS v) i CROSS JOIN (SELECT CAST(UNNEST(generate_series(DATE '2016-01-04', DATE '2016-03-31', INTERVAL 1 DAY)) AS DATE) AS d) d) SELECT instrument_id, CAST(d AS VARCHAR) AS price_date, bp FROM r")
def synthetic_basis_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = date_spine(spark, "2016-01-04", "2016-03-31").crossJoin(spark.createDataFrame([("AAA",), ("BBB",)], "instrument_id string"))  # two generated dimensions
    return grid.select("instrument_id", F.col("calendar_date").cast("string").alias("price_date"), basis_points("seed-1", F.concat(F.lit("INSTRUMENT|"), "instrument_id", F.lit("|"), F.col("calendar_date").cast("string")), 35).alias("bp"))


def _points(label: str, most: int) -> str:
    return f"CAST('0x' || substr(sha256('seed-1|' || {label}), 1, 8) AS BIGINT) % {2 * most + 1} - {most}"


@query(
    "WITH i AS (SELECT p_brand AS instrument_id, MAX(CAST(p_retailprice AS DECIMAL(18,2))) AS anchor FROM part GROUP BY 1), d AS (SELECT d, date_diff('day', DATE '2016-01-10', d) AS n, CAST(d AS VARCHAR) AS day FROM (SELECT CAST(UNNEST(generate_series(DATE '2016-01-11', DATE '2016-12-30', INTERVAL 1 DAY)) AS DATE) AS d) WHERE dayofweek(d) NOT IN (0, 6)), "
    f"s AS (SELECT instrument_id, anchor, d, CASE WHEN n % 29 = 0 THEN 0 ELSE {_points(chr(39) + 'MARKET|' + chr(39) + ' || day', 120)} + {_points(chr(39) + 'CLUSTER|C1|' + chr(39) + ' || day', 55)} + {_points(chr(39) + 'INSTRUMENT|' + chr(39) + ' || instrument_id || ' + chr(39) + '|' + chr(39) + ' || day', 35)} END AS bp FROM i CROSS JOIN d), "
    "f AS (SELECT *, LIST(CAST((10000 + bp) / 10000.0 AS DECIMAL(20,8))) OVER (PARTITION BY instrument_id ORDER BY d) AS steps FROM s) "
    "SELECT instrument_id, CAST(d AS VARCHAR) AS price_date, bp AS return_bp, CAST(list_reduce(list_prepend(CAST(anchor AS DECIMAL(20,8)), steps), lambda a, x: CAST(ROUND(a * x, 8) AS DECIMAL(20,8))) AS VARCHAR) AS close_price FROM f"
)
def deterministic_price_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequentially rounded fold."""
    parts = T.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("instrument_id"), F.lit("C1").alias("cluster_id")).agg(F.max(F.col("p_retailprice").cast("decimal(18,2)")).alias("anchor_price"))
    dates = date_spine(spark, "2016-01-11", "2016-12-30").where(F.dayofweek("calendar_date").between(2, 6)).select(F.col("calendar_date").alias("price_date"), (F.datediff("calendar_date", F.lit("2016-01-10"))).alias("date_index"))
    rows = price_paths(parts, dates, "seed-1")
    return rows.select("instrument_id", F.col("price_date").cast("string").alias("price_date"), "return_bp", F.col("close_price").cast("string").alias("close_price"))
