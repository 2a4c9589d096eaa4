"""Initialization and the daily risk run over the golden year, from files to served measures."""

import csv
import hashlib
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from riskloom.plans import contracts as C
from riskloom.plans import workflows as W
from riskloom.plans.pipeline import RunParameters
from riskloom.plans.silver import Universe, datasets, ingest, process
from riskloom.sources.landing import land
from riskloom.sources.store import SnapshotStore
from test_golden import HOLIDAYS, INSTRUMENTS, NAVS, PORTFOLIOS, STRESS, VAR, year  # noqa: F401

SCENARIOS = {"BROAD": "BROAD_MARKET_DOWN_10", "TECHNOLOGY": "TECHNOLOGY_CORRECTION", "SUPPLY": "GEOPOLITICAL_SUPPLY_SHOCK"}
CALENDAR = W.Calendar("2016-01-01", "2016-12-30", ("XNAS", "XNYS"), {d: "Holiday" for d in {*HOLIDAYS, "2016-01-01"}})
UNIVERSE = Universe(prices=3780, totals={PORTFOLIOS[0]: (1.0, 0.0), PORTFOLIOS[1]: (1.3, 0.3)})
CLUSTERS = {"TECH": "SYSTEMIC_CORE_TECHNOLOGY", "SEMIS": "SEMICONDUCTOR_INFRASTRUCTURE", "CONSUMER": "CONSUMER_AND_LOGISTICS", "HEALTHCARE": "HEALTHCARE_AND_POLICY_SENSITIVITY", "FINANCIALS": "FINANCIAL_FOUNDATIONS", "MACRO": "MACRO_AND_GEOPOLITICAL_SENSITIVITY"}


def canonical(kind, text):
    if text == "":
        return "<NULL>"
    if kind.startswith("decimal"):
        return f"{D(text):.{kind.rstrip(')').split(',')[1]}f}"
    return text


def landed(root, contract, rows, changes=lambda row: row):
    """A landed file of a dataset; rows are dicts without the hash, missing fields are empty."""
    path = root / f"{contract.name}.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow([x.name for x in contract.fields])
        for row in rows:
            own = {x.name: str(row.get(x.name, "")) for x in contract.fields}
            parts = [(own[n] or "<NULL>") if contract.raw_hash else canonical(x.kind, own[n]) for x in contract.fields for n in [x.name] if n != "record_hash"]
            own["record_hash"] = hashlib.sha256("|".join(parts).encode()).hexdigest()
            own = changes(own)
            out.writerow([own[x.name] for x in contract.fields])
    return land(str(path), str(root / "landed"), contract.name, "PROJECT_GIT_FIXTURE", "1.0.0")


def reference_rows():
    portfolios = [
        {"portfolio_id": p, "portfolio_name": p.title(), "strategy_code": s, "base_currency": "USD", "target_inception_date": "2016-01-04", "actual_inception_date": "2016-01-04", "initial_nav": "1000000.00", "target_long_ratio": r[0], "target_short_ratio": r[1], "target_gross_ratio": r[2], "target_net_ratio": r[3], "rebalance_policy": "BUY_AND_HOLD", "cash_policy": "RETAIN_DIVIDENDS_NO_INTEREST", "is_active": "true", "config_version": "1.0.0"}
        for p, s, r in ((PORTFOLIOS[0], "LONG_ONLY", (1, 0, 1, 1)), (PORTFOLIOS[1], "LONG_SHORT_130_30", (1.3, 0.3, 1.6, 1)))
    ]
    instruments = [
        {"instrument_id": n, "display_symbol": n[:-3], "yfinance_symbol": n[:-3], "instrument_name": n, "asset_class": "EQUITY", "security_type": "COMMON_STOCK", "exchange_mic": ("XNAS", "XNYS")[k % 2], "quote_currency": "USD", "issuer_country_code": "US", "official_sector_name": "Industrials", "risk_cluster_id": CLUSTERS[c], "classification_source": "TEST", "classification_as_of_date": "2016-01-01", "active_from": "2010-01-01", "is_active": "true", "config_version": "1.0.0"}
        for k, (n, c, *_) in enumerate(INSTRUMENTS)
    ]
    allocations = [{"portfolio_id": p, "instrument_id": n, "effective_from": "2016-01-04", "target_weight": w, "allocation_version": "1.0.0"} for n, _, a, b, *_ in INSTRUMENTS for p, w in zip(PORTFOLIOS, (a, b))]
    scenarios = [{"scenario_id": s, "scenario_name": s, "scenario_description": "A hypothetical move.", "scenario_type": "DETERMINISTIC_HYPOTHETICAL", "is_active": "true", "scenario_version": "1.0.0", "effective_from": "2016-01-01"} for s in SCENARIOS.values()]
    shocks = [{"scenario_id": SCENARIOS[s], "instrument_id": n, "shock_ratio": x, "shock_rationale": "why", "scenario_version": "1.0.0"} for n, *_, tech, supply in INSTRUMENTS for s, x in (("BROAD", "-0.1"), ("TECHNOLOGY", tech), ("SUPPLY", supply))]
    return {C.PORTFOLIOS: portfolios, C.INSTRUMENTS: instruments, C.TARGET_ALLOCATIONS: allocations, C.STRESS_SCENARIOS: scenarios, C.STRESS_SCENARIO_SHOCKS: shocks}


def market_rows(rows):
    price = lambda r, c: f"{r[c]:.8f}"
    prices = [
        {"instrument_id": r.instrument_id, "price_date": r.price_date.isoformat(), "source_id": "PROJECT_GIT_FIXTURE", "source_symbol": r.instrument_id[:-3], **{f"{x}_price": price(r, "close_price") for x in ("open", "high", "low", "close")}, "adjusted_close_price": price(r, "adjusted_close_price"), "volume": "1000", "quote_currency": "USD", "source_record_id": f"{r.instrument_id}-{r.price_date}"}
        for r in rows
    ]
    common = {"source_id": "PROJECT_GIT_FIXTURE"}
    actions = [
        {"instrument_id": "WMT_US", "effective_date": "2016-01-06", "action_type": "CASH_DIVIDEND", "source_symbol": "WMT", "dividend_amount_per_share": "1.00000000", "dividend_currency": "USD", "source_record_id": "a1", **common},
        {"instrument_id": "NVDA_US", "effective_date": "2016-01-07", "action_type": "STOCK_SPLIT", "source_symbol": "NVDA", "split_ratio": "2.0000000000", "source_record_id": "a2", **common},
    ]
    return {C.DAILY_PRICES: prices, C.CORPORATE_ACTIONS: actions}


@pytest.fixture(scope="module")
def run(spark, year, tmp_path_factory):  # noqa: F811
    root = tmp_path_factory.mktemp("golden")
    store = SnapshotStore(spark, str(root / "store"))
    manifests = [landed(root, c, rows) for c, rows in (reference_rows() | market_rows(year.collect())).items()]
    parameters = [RunParameters(p, "2016-12-30", "abcdef1") for p in PORTFOLIOS]
    first = W.initialization(store, manifests, UNIVERSE, "init-1", "2017-01-01T00:00:00").run(spark)
    second = W.daily_risk(store, manifests, CALENDAR, UNIVERSE, parameters, "daily-1", "2017-01-01T00:00:00").run(spark)
    return root, store, manifests, parameters, first, second


def test_initialization_and_daily_run(run):
    _, store, _, _, first, second = run
    assert list(first) == ["bronze_portfolio_initialization", "silver_process_portfolios", "bronze_reference_ingestion", "silver_process_instruments", "silver_process_target_allocations", "silver_process_stress_scenarios", "silver_process_stress_scenario_shocks"]
    assert list(second) == ["bronze_market_ingestion", "generate_trading_calendar", "silver_process_daily_prices", "silver_process_corporate_actions", "derive_positions", "derive_cash_balances", "calculate_position_market_values", "calculate_portfolio_daily_metrics", "calculate_risk_measures", "validate_serving_outputs"]
    counts = {n: store.read(n).count() for n in ("silver_portfolios", "silver_instruments", "silver_target_allocations", "silver_stress_scenario_shocks", "silver_daily_prices", "silver_positions", "silver_cash_balances", "gold_position_market_values", "gold_portfolio_daily_metrics", "gold_historical_pnl")}
    assert counts == {"silver_portfolios": 2, "silver_instruments": 15, "silver_target_allocations": 30, "silver_stress_scenario_shocks": 45, "silver_daily_prices": 3780, "silver_positions": 7560, "silver_cash_balances": 504, "gold_position_market_values": 7560, "gold_portfolio_daily_metrics": 504, "gold_historical_pnl": 502}
    assert {r.status for r in store.read("runs").collect()} == {"SUCCEEDED"} and all(r.published for r in store.read("runs").collect())
    assert store.read("silver_outcomes").where("run_id = 'daily-1'").count() == 3782


def test_golden_values(run):
    store = run[1]
    metrics = store.read("gold_portfolio_daily_metrics")
    for p in PORTFOLIOS:
        rows = metrics.where((F.col("portfolio_id") == p) & (F.col("valuation_date") <= "2016-01-07")).orderBy("valuation_date").collect()
        assert [float(r.nav) for r in rows] == pytest.approx(NAVS[p], abs=1e-6) and float(rows[0].baseline) == 1000000
    views = W.served(store)
    var = {(r.run_id, str(r.confidence_level)): r for r in views["var"].collect()}
    assert {k: float(r.var_amount) for k, r in var.items()} == pytest.approx({k: v[0] for k, v in VAR.items()}, abs=1e-3)
    assert {k: r.scenario_date.isoformat() for k, r in var.items()} == {k: v[1] for k, v in VAR.items()}
    names = {v: k for k, v in SCENARIOS.items()}
    assert {(r.run_id, names[r.scenario_id]): float(r.stress_pnl) for r in views["stress"].collect()} == pytest.approx(STRESS, abs=1e-3)


def test_a_repeated_run_publishes_nothing(spark, run):
    root, store, manifests, parameters, *_ = run
    before = store.versions()
    W.daily_risk(store, manifests, CALENDAR, UNIVERSE, parameters, "daily-2", "2017-01-02T00:00:00").run(spark)
    again = store.read("runs").where("run_id = 'daily-2'").collect()
    assert len(again) == 6 and not any(r.published for r in again) and {r.attempt for r in again} == {2}
    derived = [t for t in before if t.startswith(("silver_", "gold_p")) and t not in ("silver_outcomes", "silver_violations", "silver_trading_calendar")]
    assert all(store.versions()[t] == before[t] for t in derived)
    assert [r.decision for r in store.read("ingestion_batches").where("completed_at_utc like '2017-01-02%'").collect()] == ["SKIPPED_DUPLICATE"] * 2


def test_a_bad_batch_is_blocked(spark, run, tmp_path):
    store = run[1]
    instruments = reference_rows()[C.INSTRUMENTS]
    bad = landed(tmp_path, C.INSTRUMENTS, [r | {"config_version": "1.1.0"} for r in instruments[:2]] + [instruments[2] | {"asset_class": "BOND"}, instruments[3] | {"instrument_name": "other"}])
    batch = ingest(spark, store, [bad], "2017-01-03T00:00:00")["instruments"]
    before = store.versions()["silver_instruments"]
    audit = process(spark, store, datasets(UNIVERSE)["instruments"], batch, "bad-1", "2017-01-03T00:00:00")
    assert audit["status"] == "FAILED" and not audit["published"] and audit["failed_rule_ids"] == ["INSTRUMENT_ALLOWED_VALUES", "INSTRUMENT_INVALID_CORRECTION"]
    assert store.versions()["silver_instruments"] == before and audit["before_digest"] == audit["after_digest"]
    found = {r.outcome: r["count"] for r in store.read("silver_outcomes").where("run_id = 'bad-1'").groupBy("outcome").count().collect()}
    assert found == {"ACCEPTED_CORRECTION": 2, "REJECTED": 2}


def test_preflight_of_all_files_before_any_write(spark, run, tmp_path):
    store = run[1]
    good = landed(tmp_path, C.STRESS_SCENARIOS, [r | {"scenario_version": "2.0.0"} for r in reference_rows()[C.STRESS_SCENARIOS]])
    changed = landed(tmp_path, C.TARGET_ALLOCATIONS, reference_rows()[C.TARGET_ALLOCATIONS][:3])
    with open(changed.landed_object_path, "a") as f:
        f.write("x\n")
    before = store.versions()
    with pytest.raises(ValueError, match="target_allocations: LANDED_FILE"):
        ingest(spark, store, [good, changed], "2017-01-04T00:00:00")
    assert store.versions() == before


def test_a_missing_price_fails_the_run(spark, year, run, tmp_path):  # noqa: F811
    store = SnapshotStore(spark, str(tmp_path / "store"))
    manifests = [landed(tmp_path, c, rows) for c, rows in reference_rows().items()]
    W.initialization(store, manifests, UNIVERSE, "init", "2017-01-05T00:00:00").run(spark)
    short = [r for r in year.where("price_date <= '2016-01-08'").collect() if (r.instrument_id, r.price_date.isoformat()) != ("UNH_US", "2016-01-07")]
    market = [landed(tmp_path, c, rows) for c, rows in market_rows(short).items()]
    with pytest.raises(W.RunFailed) as failed:
        W.daily_risk(store, market, CALENDAR, Universe(), [RunParameters(p, "2016-01-08", "abcdef1") for p in PORTFOLIOS], "daily", "2017-01-05T00:00:00").run(spark)
    assert failed.value.failed_rule_ids == ["PRICE_EXPECTED_DATE_GRID"]
    runs = store.read("runs").where("dataset = 'silver_daily_prices'").collect()
    assert [(r.status, r.failed_rule_ids) for r in runs] == [("FAILED", ["PRICE_EXPECTED_DATE_GRID"])] and not store.exists("silver_daily_prices") and not store.exists("silver_positions")


def test_provider_runs(spark, year, tmp_path):  # noqa: F811
    store = SnapshotStore(spark, str(tmp_path / "store"))
    manifests = [landed(tmp_path, c, rows) for c, rows in (reference_rows() | market_rows(year.where("price_date <= '2016-01-08'").collect())).items()]
    clock = "2017-01-06T00:00:00"
    W.initialization(store, manifests, Universe(), "init", clock).run(spark)
    entries = [{"dataset_name": m.dataset_name, "publication_status": "APPROVED", "snapshot_sha256": "s1"} for m in manifests[-2:]]
    with pytest.raises(W.RunFailed):
        W.landing_validation(store, [entries[0] | {"publication_status": "PENDING"}], manifests, clock).run(spark)
    with pytest.raises(ValueError):
        W.landing_validation(store, [entries[0], entries[1] | {"snapshot_sha256": "s2"}], manifests, clock).run(spark)
    batches = W.landing_validation(store, entries, manifests, clock).run(spark)["ingest_market_data"]
    assert W.reconciliation(store, Universe()).run(spark)["reconcile_bronze"] == {"instruments": 15, "least": 5, "most": 5}
    W.publication(store, batches, CALENDAR, Universe(), "pub", clock).run(spark)
    assert W.admission(store).run(spark)["admit_silver"] == {"PRICES_ARE_SESSIONS": True, "ACTIONS_IN_SESSIONS": True}
    with pytest.raises(W.RunFailed, match="BRONZE_INSTRUMENT_DATES"):
        W.reconciliation(store, Universe(instruments=14)).run(spark)
    store.commit({"silver_daily_prices": store.read("silver_daily_prices").where("price_date <> '2016-01-06'")})
    with pytest.raises(W.RunFailed, match="PRICES_ARE_SESSIONS"):
        W.admission(store).run(spark)
