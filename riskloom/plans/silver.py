"""Source-aligned batches and their way into canonical tables.

``ingest`` lands files as source-aligned rows after a preflight of all of them; ``process`` types a batch, judges, compares and publishes it
with its outcomes, violations and run audit in one commit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.expr import surrogate_id
from riskloom.operators import resolve as V
from riskloom.operators import snapshot_rules as K
from riskloom.operators.merge import upsert
from riskloom.operators.rules import QUARANTINE, REJECT, Rule, judged, violations
from riskloom.plans import contracts as C
from riskloom.plans import domain_rules as D
from riskloom.plans.contracts import Contract
from riskloom.plans.pipeline import AUDIT, digest, next_attempt
from riskloom.sources.landing import Manifest, ingestion_plan, read_landed, reconcile_file, with_lineage
from riskloom.sources.scratch import stash
from riskloom.sources.store import SnapshotStore

BATCHES = "batch_id string, dataset_name string, source_id string, source_sha256 string, status string, decision string, row_count long, completed_at_utc string"
RECORD = "lineage_record_id"
VIOLATION = ("source_record_id", "rule_id", "severity", "disposition", "affected_field", "observed_value", "expected", "message")


@dataclass(frozen=True)
class Dataset:
    """How a batch is judged. ``enrich`` adds what the rules look up; ``checks`` are made on the whole prospective snapshot;
    with ``version_col`` corrections need a higher version, without it any change of content is one."""

    contract: Contract
    rules: Callable[[], list[Rule]]
    enrich: Callable[[DataFrame, SnapshotStore], DataFrame] = lambda rows, store: rows
    checks: Callable[[DataFrame], list[DataFrame]] = lambda snapshot: []
    version_col: str = ""

    @property
    def table(self) -> str:
        return f"silver_{self.contract.name}"

    @property
    def bronze(self) -> str:
        return f"bronze_{self.contract.name}"


def _market(date_col: str) -> Callable[[DataFrame, SnapshotStore], DataFrame]:
    return lambda rows, store: D.enriched(rows, store.read("silver_instruments"), store.read("silver_trading_calendar"), date_col)


def _allocated(rows: DataFrame, store: SnapshotStore) -> DataFrame:
    return D.referenced(rows, portfolio=(store.read("silver_portfolios"), ["portfolio_id"]), instrument=(store.read("silver_instruments"), ["instrument_id"]))


def _shocked(rows: DataFrame, store: SnapshotStore) -> DataFrame:
    scenarios = store.read("silver_stress_scenarios")
    return D.scenario_versions(D.referenced(rows, scenario=(scenarios, ["scenario_id"]), instrument=(store.read("silver_instruments"), ["instrument_id"])), scenarios)


@dataclass(frozen=True)
class Universe:
    """What the domain's snapshots must hold."""

    portfolios: int = 2
    instruments: int = 15
    scenarios: tuple[str, ...] = D.SCENARIOS
    prices: int | None = None
    totals: dict[str, tuple[float, float]] = field(default_factory=dict)  # of each portfolio its long and short weight


def datasets(universe: Universe = Universe()) -> dict[str, Dataset]:
    """The seven datasets of the domain with their rules and snapshot checks."""
    u = universe

    def weights(df: DataFrame) -> list[DataFrame]:
        active = df.where("effective_to is null")
        out = [K.key_unique(df, "ALLOCATION_KEY_UNIQUE", ["portfolio_id", "instrument_id", "effective_from"]), K.complete_grid(active, "ALLOCATION_ACTIVE_COVERAGE", "portfolio_id", "instrument_id", u.instruments)]
        out.append(K.ranges_disjoint(df, "ALLOCATION_RANGES_NONOVERLAPPING", ["portfolio_id", "instrument_id"], "effective_from", "effective_to"))
        return out + [K.totals(active.where(F.col("portfolio_id") == p), f"ALLOCATION_TOTALS_{p}", *w) for p, w in sorted(u.totals.items())]

    def price_grid(df: DataFrame) -> list[DataFrame]:
        out = [K.key_unique(df, "PRICE_BUSINESS_KEY_UNIQUE", ["instrument_id", "price_date", "source_id"]), K.complete_grid(df, "PRICE_EXPECTED_DATE_GRID", "price_date", "instrument_id", u.instruments)]
        return out + ([K.row_count(df, "PRICE_EXPECTED_COVERAGE", u.prices)] if u.prices is not None else [])

    def scenario_set(df: DataFrame) -> list[DataFrame]:
        wanted = df.sparkSession.createDataFrame([(s,) for s in u.scenarios], "scenario_id string")
        active = df.where("is_active").select("scenario_id")
        return [K.contained(wanted, active, "SCENARIO_ACTIVE_SET"), K.contained(active, wanted, "SCENARIO_ACTIVE_SET"), K.key_unique(df, "SCENARIO_ID_UNIQUE", ["scenario_id"])]

    found = (
        Dataset(C.PORTFOLIOS, D.portfolio_rules, checks=lambda df: [K.row_count(df.where("is_active"), "PORTFOLIO_ACTIVE_COUNT", u.portfolios), K.key_unique(df, "PORTFOLIO_ID_UNIQUE", ["portfolio_id"])], version_col="config_version"),
        Dataset(C.INSTRUMENTS, D.instrument_rules, checks=lambda df: [K.row_count(df.where("is_active"), "INSTRUMENT_ACTIVE_COUNT", u.instruments), K.key_unique(df, "INSTRUMENT_ID_UNIQUE", ["instrument_id"]), K.key_unique(df, "INSTRUMENT_PROVIDER_SYMBOL_UNIQUE", ["yfinance_symbol"])], version_col="config_version"),
        Dataset(C.TARGET_ALLOCATIONS, D.allocation_rules, _allocated, weights, "allocation_version"),
        Dataset(C.STRESS_SCENARIOS, D.scenario_rules, checks=scenario_set, version_col="scenario_version"),
        Dataset(C.STRESS_SCENARIO_SHOCKS, D.shock_rules, _shocked, lambda df: [K.complete_grid(df, "SHOCK_PAIR_GRID", "scenario_id", "instrument_id", u.instruments)], "scenario_version"),
        Dataset(C.DAILY_PRICES, D.price_rules, _market("price_date"), price_grid),
        Dataset(C.CORPORATE_ACTIONS, D.action_rules, _market("effective_date"), lambda df: [K.key_unique(df, "ACTION_BUSINESS_KEY_UNIQUE", ["instrument_id", "effective_date", "action_type", "source_id"])]),
    )
    return {d.contract.name: d for d in found}


def ingest(spark: SparkSession, store: SnapshotStore, manifests: Sequence[Manifest], clock: str) -> dict[str, str]:
    """Land files as source-aligned rows: the batch id that holds each dataset's rows.

    All files are checked against manifest and contract before anything is written (ValueError names every fault). A file that
    an earlier batch holds already is skipped, with an audit row, and the earlier batch's id returned. All rows and
    audit rows of the call become visible in one commit.
    """
    faults = []
    for m in manifests:
        contract = C.CONTRACTS.get(m.dataset_name)
        faults += [f"{m.dataset_name}: {x}" for x in reconcile_file(m)]
        if contract is None:
            faults.append(f"{m.dataset_name}: UNKNOWN_DATASET")
        elif m.source_columns != [f.name for f in contract.fields] or m.source_contract_version != contract.version:
            faults.append(f"{m.dataset_name}: CONTRACT")
    if faults:
        raise ValueError("; ".join(sorted(faults)))
    log = store.read("ingestion_batches") if store.exists("ingestion_batches") else spark.createDataFrame([], BATCHES)
    requests = spark.createDataFrame([(m.dataset_name, m.source_id, m.source_sha256, f"{m.dataset_name}-{m.source_sha256[:16]}") for m in manifests], "dataset_name string, source_id string, source_sha256 string, request_id string")
    plan = {r["dataset_name"]: r for r in ingestion_plan(requests, log).collect()}  # one row a file
    if any(r["decision"] == "ERROR" for r in plan.values()):
        raise ValueError("a file is in several successful batches")
    appended, audits, batches = {}, [], {}
    for m in manifests:
        decision, batch = plan[m.dataset_name]["decision"], plan[m.dataset_name]["effective_batch_id"]
        if decision == "WRITE":
            appended[f"bronze_{m.dataset_name}"] = [store.stage(f"bronze_{m.dataset_name}", _source_aligned(read_landed(spark, m), m, batch, clock))]
        batches[m.dataset_name] = batch
        audits.append((batch, m.dataset_name, m.source_id, m.source_sha256, "SUCCEEDED" if decision == "WRITE" else decision, decision, m.source_record_count, clock))
    appended["ingestion_batches"] = [store.stage("ingestion_batches", spark.createDataFrame(audits, BATCHES))]
    store.commit_staged({}, appended)
    return batches


def _source_aligned(source: DataFrame, m: Manifest, batch: str, clock: str) -> DataFrame:
    """The file's columns beside their lineage; lineage of a name that files have too is called ``lineage_...``."""
    texts = [f"s_{c}" for c in m.source_columns]
    rows = source.select([F.col(c).alias(f"s_{c}") for c in m.source_columns])
    rows = with_lineage(rows, texts, texts, batch, m.source_id, m.landed_object_path, m.source_sha256, m.source_contract_version, clock)
    lineage = {"source_id": "lineage_source_id", "source_record_id": RECORD}
    return rows.select(*[F.col(c).alias(lineage.get(c, c)) for c in rows.columns if c not in texts], *[F.col(f"s_{c}").alias(c) for c in m.source_columns])


def process(spark: SparkSession, store: SnapshotStore, dataset: Dataset, batch_id: str, run_id: str, clock: str) -> dict:
    """Judge a batch and publish it, all or nothing: the run's audit row.

    The evaluated rows are computed once and stored; outcomes, violations and the prospective snapshot are read from there. The canonical
    table, its outcomes and violations and the audit row become current in one commit; a blocked batch leaves the canonical table.
    """
    contract, prefix = dataset.contract, dataset.contract.rule_prefix
    rows = store.read(dataset.bronze).where(F.col("batch_id") == batch_id)
    own = [f.name for f in contract.fields]
    typed = contract.typed(rows)
    rules = [*contract.rules(), *dataset.rules()]
    enriched = dataset.enrich(typed, store)
    current = store.read(dataset.table) if store.exists(dataset.table) else spark.createDataFrame([], contract.schema())
    if dataset.version_col:
        evidence = V.same_batch_versioned(judged(enriched, rules), F.col("business_key"), "source_row_number", "computed_hash", ["source_row_number"])
        compared = V.compare_versioned(evidence, current, list(contract.key), "record_hash", dataset.version_col)
        outcome = V.outcome_versioned(F.col("has_error"), F.col("is_conflict"), F.col("is_duplicate"), F.col("comparison"))
    else:
        evidence = V.same_batch_market(judged(enriched, rules), list(contract.key), "computed_hash", ["source_row_number"])
        compared = V.compare_market(evidence, current, list(contract.key), "record_hash")
        blocking = F.col("has_quarantine") | F.coalesce("is_conflict", F.lit(False))
        outcome = V.outcome_market(F.col("has_reject"), blocking, F.col("is_duplicate"), F.col("comparison"))
    evaluated = stash(compared.withColumn("outcome", outcome), "evaluated")

    found = violations(evaluated, rules, [RECORD]).unionByName(V.batch_violations(evaluated, [RECORD], prefix, REJECT if dataset.version_col else QUARANTINE))
    if dataset.version_col:
        eligible = evaluated.where(~F.col("has_error") & ~F.col("is_conflict") & ~F.col("is_duplicate"))
        found = found.unionByName(V.correction_violations(eligible, [RECORD], prefix, dataset.version_col))
    found = found.withColumnRenamed(RECORD, "source_record_id").select(F.lit(run_id).alias("run_id"), surrogate_id(F.lit(run_id), "source_record_id", "rule_id").alias("violation_id"), *VIOLATION)
    outcomes = evaluated.select(F.lit(run_id).alias("run_id"), surrogate_id(F.lit(run_id), RECORD).alias("outcome_id"), F.col(RECORD).alias("source_record_id"), "business_key", "outcome")

    counts = V.publication(V.conservation(outcomes)).first()  # one row
    failed = [] if counts["is_conserved"] else [f"{prefix}_OUTCOMES_CONSERVED"]
    accepted = evaluated.where(F.col("outcome").isin("ACCEPTED_NEW", "ACCEPTED_CORRECTION")).select(*own)
    folder = store.stage(dataset.table, upsert(current, accepted, list(contract.key)))
    snapshot = store.read_folders([folder])
    clean = counts["rejected"] == 0 and counts["quarantined"] == 0
    if clean:
        failed += K.failures(*dataset.checks(snapshot))
    blocked = sorted({r["rule_id"] for r in found.where("severity = 'ERROR'").select("rule_id").distinct().collect()}) if not clean else []  # at most one a rule
    before = digest(store.read(dataset.table), list(contract.key))[1] if store.exists(dataset.table) else ""
    rows_after, after = digest(snapshot, list(contract.key))
    ok = clean and not failed
    published = ok and bool(counts["published"])
    status = counts["status"] if ok or not clean else "FAILED"
    audit = {"run_id": run_id, "dataset": dataset.table, "attempt": next_attempt(store, dataset.table), "status": status, "published": published, "row_count": rows_after if ok else counts["evaluated"], "before_digest": before, "after_digest": after if ok else before, "failed_rule_ids": sorted({*failed, *blocked}), "error": None, "completed_at_utc": clock}
    names = [x.split()[0] for x in AUDIT.split(", ")]
    appended = {
        "silver_outcomes": [store.stage("silver_outcomes", outcomes)],
        "silver_violations": [store.stage("silver_violations", found)],
        "runs": [store.stage("runs", spark.createDataFrame([tuple(audit[n] for n in names)], AUDIT))],
    }
    store.commit_staged({dataset.table: [folder]} if published else {}, appended)
    if published and digest(store.read(dataset.table), list(contract.key)) != (rows_after, after):
        raise RuntimeError(f"{dataset.table}: what was read back isn't what was written")
    return audit
