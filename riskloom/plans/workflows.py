"""The runs of the domain: initialization, the daily risk run, and the market-data runs, as ordered stages over a snapshot store.

Every stage publishes its dataset with an audit row in one commit, or fails the run; a run that is repeated with the same inputs
publishes nothing new. Derived data are computed for all dates up to the as-of date at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.expr import AMOUNT, record_hash, share
from riskloom.operators import positions as P
from riskloom.operators import risk as R
from riskloom.operators import serving as S
from riskloom.operators.guards import single_batch
from riskloom.operators.merge import bag_difference
from riskloom.operators.calendar import calendar_checks, publish_calendar, trading_calendar
from riskloom.plans import derived_rules as DR
from riskloom.plans.pipeline import Failures, Pipeline, RunFailed, RunParameters, audited, publish
from riskloom.plans.silver import Universe, datasets, ingest, process
from riskloom.sources.landing import Manifest, one_snapshot
from riskloom.sources.store import SnapshotStore

POSITION_KEY, CASH_KEY, VALUE_KEY, METRIC_KEY = ["portfolio_id", "instrument_id", "position_date"], ["portfolio_id", "cash_date"], ["portfolio_id", "instrument_id", "valuation_date"], ["portfolio_id", "valuation_date"]


@dataclass(frozen=True)
class Calendar:
    """The trading calendar to publish."""

    start: str
    end: str
    exchanges: tuple[str, ...]
    holidays: dict[str, str]
    early_closes: tuple[str, ...] = ()
    version: str = "1.0.0"


def _require(audit: dict) -> dict:
    if audit["status"] == "FAILED":
        raise RunFailed(audit["dataset"], audit["failed_rule_ids"], audited=True)
    return audit


def _silver(store: SnapshotStore, universe: Universe, name: str, ingested: str, run_id: str, clock: str) -> Callable[[SparkSession, dict], dict]:
    def stage(spark: SparkSession, done: dict) -> dict:
        dataset = datasets(universe)[name]
        return audited(store, dataset.table, run_id, clock, lambda: _require(process(spark, store, dataset, done[ingested][name], run_id, clock)))

    return stage


def _bronze(store: SnapshotStore, manifests: Sequence[Manifest], names: Sequence[str], clock: str) -> Callable[[SparkSession, dict], dict]:
    return lambda spark, done: ingest(spark, store, [m for m in manifests if m.dataset_name in names], clock)


def initialization(store: SnapshotStore, manifests: Sequence[Manifest], universe: Universe, run_id: str, clock: str) -> Pipeline:
    """Portfolios first, then the reference data in the order of their keys; seven stages."""
    reference = ("instruments", "target_allocations", "stress_scenarios", "stress_scenario_shocks")
    stages = [("bronze_portfolio_initialization", _bronze(store, manifests, ("portfolios",), clock)), ("silver_process_portfolios", _silver(store, universe, "portfolios", "bronze_portfolio_initialization", run_id, clock))]
    stages.append(("bronze_reference_ingestion", _bronze(store, manifests, reference, clock)))
    return Pipeline(stages + [(f"silver_process_{n}", _silver(store, universe, n, "bronze_reference_ingestion", run_id, clock)) for n in reference])


def _calendar(store: SnapshotStore, calendar: Calendar, clock: str) -> Callable[[SparkSession, dict], dict]:
    def stage(spark: SparkSession, done: dict) -> dict:
        rows = trading_calendar(spark, calendar.start, calendar.end, list(calendar.exchanges), calendar.holidays, list(calendar.early_closes)).drop("is_weekend")
        rows = rows.withColumns({"exchange_timezone": F.lit("America/New_York"), "calendar_source": F.lit("GENERATED"), "calendar_version": F.lit(calendar.version)})
        rows = rows.withColumn("record_hash", record_hash(sorted(rows.columns))).withColumn("generated_at_utc", F.lit(clock).cast("timestamp"))
        checks = calendar_checks(rows).where("not (is_contiguous and has_right_durations)").count()
        if checks:
            raise RunFailed("silver_trading_calendar", ["CALENDAR_VALID"])
        if store.exists("silver_trading_calendar"):
            rows = publish_calendar(store.read("silver_trading_calendar"), rows)
        folder = store.stage("silver_trading_calendar", rows)
        store.commit_staged({"silver_trading_calendar": [folder]})
        return {"days": store.read("silver_trading_calendar").count()}

    return stage


def market_data(store: SnapshotStore, manifests: Sequence[Manifest], calendar: Calendar, universe: Universe, run_id: str, clock: str) -> Pipeline:
    """Source rows, calendar, prices and actions of one snapshot; the first four stages of the daily run."""
    names = ("daily_prices", "corporate_actions")
    return Pipeline(
        [
            ("bronze_market_ingestion", _bronze(store, manifests, names, clock)),
            ("generate_trading_calendar", _calendar(store, calendar, clock)),
            *[(f"silver_process_{n}", _silver(store, universe, n, "bronze_market_ingestion", run_id, clock)) for n in names],
        ]
    )


def landing_validation(store: SnapshotStore, entries: Sequence[dict], manifests: Sequence[Manifest], clock: str) -> Pipeline:
    """Provider files: all approved entries must be of one snapshot, then they are ingested."""

    def validate(spark: SparkSession, done: dict) -> str:
        if any(e.get("publication_status") != "APPROVED" for e in entries):
            raise RunFailed("landing", ["LANDING_APPROVED"])
        return one_snapshot(list(entries))

    return Pipeline([("validate_landing", validate), ("ingest_market_data", _bronze(store, manifests, ("daily_prices", "corporate_actions"), clock))])


def publication(store: SnapshotStore, batches: dict[str, str], calendar: Calendar, universe: Universe, run_id: str, clock: str) -> Pipeline:
    """The exchange's calendar, then the prices and the actions of batches that were ingested before."""
    stages = [("publish_exchange_calendar", _calendar(store, calendar, clock)), ("batches", lambda spark, done: batches)]
    return Pipeline(stages + [(f"process_{n}", _silver(store, universe, n, "batches", run_id, clock)) for n in ("daily_prices", "corporate_actions")])


def reconciliation(store: SnapshotStore, universe: Universe) -> Pipeline:
    """Source-aligned rows against their audit rows; prices of every instrument on equally many dates."""

    def reconcile(spark: SparkSession, done: dict) -> dict:
        log, failed = store.read("ingestion_batches"), []
        for name in ("daily_prices", "corporate_actions"):
            rows = store.read(f"bronze_{name}")
            if not single_batch(rows, log.where(F.col("dataset_name") == name)).where("not is_reconciled").isEmpty():
                failed.append(f"BRONZE_{name.upper()}_RECONCILED")
        dates = store.read("bronze_daily_prices").groupBy("instrument_id").agg(F.count_distinct("price_date").alias("dates"))
        spread = dates.agg(F.count(F.lit(1)).alias("instruments"), F.min("dates").alias("least"), F.max("dates").alias("most")).first()  # one row
        if spread["instruments"] != universe.instruments or spread["least"] != spread["most"]:
            failed.append("BRONZE_INSTRUMENT_DATES")
        if failed:
            raise RunFailed("bronze", failed)
        return spread.asDict()

    return Pipeline([("reconcile_bronze", reconcile)])


def admission(store: SnapshotStore) -> Pipeline:
    """Published prices have exactly their exchange's sessions, and actions fall on sessions."""

    def admit(spark: SparkSession, done: dict) -> dict:
        mics = store.read("silver_instruments").where("is_active").select("instrument_id", "exchange_mic")
        sessions = store.read("silver_trading_calendar").where("is_trading_day").select("exchange_mic", F.col("calendar_date").alias("price_date"))
        prices = store.read("silver_daily_prices").join(mics, "instrument_id").select("instrument_id", "exchange_mic", "price_date")
        bounds = prices.agg(F.min("price_date").alias("lo"), F.max("price_date").alias("hi"))
        due = mics.join(sessions.crossJoin(F.broadcast(bounds)).where("price_date between lo and hi").drop("lo", "hi"), "exchange_mic").select("instrument_id", "exchange_mic", "price_date")  # one row of bounds
        actions = store.read("silver_corporate_actions").join(mics, "instrument_id").select("exchange_mic", F.col("effective_date").alias("price_date"))
        checks = {
            "PRICES_ARE_SESSIONS": bag_difference(prices, due).first()["is_equal"],
            "ACTIONS_IN_SESSIONS": actions.join(sessions, ["exchange_mic", "price_date"], "left_anti").isEmpty(),
        }
        failed = sorted(k for k, ok in checks.items() if not ok)
        if failed:
            raise RunFailed("silver", failed)
        return checks

    return Pipeline([("admit_silver", admit)])


@dataclass(frozen=True)
class _Inputs:
    """What the derived datasets of a run are computed from, up to the as-of date."""

    store: SnapshotStore
    as_of: str
    portfolios: tuple[str, ...]

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def active(self) -> DataFrame:
        return self.table("silver_portfolios").where(F.col("is_active") & F.col("portfolio_id").isin(*self.portfolios))

    def sessions(self) -> DataFrame:
        first = self.active().agg(F.min("actual_inception_date").alias("first"))
        days = self.table("silver_trading_calendar").where(F.col("is_trading_day") & (F.col("calendar_date") <= F.lit(self.as_of).cast("date"))).select("calendar_date").distinct()
        return days.crossJoin(F.broadcast(first)).where("calendar_date >= first").select(F.col("calendar_date").alias("position_date"))  # one row of first

    def closes(self) -> DataFrame:
        return self.table("silver_daily_prices").where(F.col("price_date") <= F.lit(self.as_of).cast("date")).select("instrument_id", "price_date", "close_price", "adjusted_close_price", "quote_currency", "record_hash")

    def allocations(self) -> DataFrame:
        return self.table("silver_target_allocations").where("effective_to is null").join(self.active().select("portfolio_id"), "portfolio_id")

    def multipliers(self) -> DataFrame:
        return P.split_multipliers(self.table("silver_corporate_actions"))

    def dividends(self) -> DataFrame:
        return self.table("silver_corporate_actions").where("action_type = 'CASH_DIVIDEND'").select("instrument_id", "effective_date", "dividend_amount_per_share")

    def inception(self) -> DataFrame:
        """Quantities at each portfolio's first date, at that date's closes."""
        starts = self.active().select("portfolio_id", "initial_nav", F.col("actual_inception_date").alias("position_date"))
        first = starts.join(self.closes(), F.col("position_date") == F.col("price_date")).select("portfolio_id", "instrument_id", "position_date", "close_price")
        rows = self.allocations().select("portfolio_id", "instrument_id", "target_weight").join(first, ["portfolio_id", "instrument_id"])
        out = P.inception_quantities(rows.drop("close_price"), starts.select("portfolio_id", "initial_nav"), self.closes().join(starts.select(F.col("position_date").alias("price_date")).distinct(), "price_date").select("instrument_id", "close_price"))
        return out.select("portfolio_id", "instrument_id", "position_date", "signed_quantity")


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("record_hash", record_hash([F.col(c) for c in sorted(df.columns)]))


def _with_computed(df: DataFrame) -> DataFrame:
    own = sorted(c for c in df.columns if c != "record_hash")
    return df.withColumn("computed_hash", record_hash([F.col(c) for c in own]))


def _rules(found: DataFrame) -> list[str]:
    """The sorted ids of the rules that are broken; at most one row a rule reaches the driver."""
    return sorted(r["rule_id"] for r in found.where("severity = 'ERROR'").select("rule_id").distinct().collect())


def _positions(i: _Inputs, universe: Universe) -> tuple[DataFrame, Callable[[DataFrame], list[str]]]:
    multipliers = i.multipliers()
    rows = P.carry_forward(i.inception(), i.sessions(), multipliers)
    splits = multipliers.select("instrument_id", "position_date", F.lit(True).alias("splits"))
    rows = rows.join(splits, ["instrument_id", "position_date"], "left")
    basis = F.when(F.col("basis") == "INCEPTION", "INITIAL_ALLOCATION").when(F.col("splits"), "SPLIT_ADJUSTED_CARRY_FORWARD").otherwise("BUY_AND_HOLD_CARRY_FORWARD")
    out = _hashed(rows.select(*POSITION_KEY, F.col("carried_quantity").alias("signed_quantity"), basis.alias("basis")))

    def checks(staged: DataFrame) -> list[str]:
        dividends = i.dividends().select("instrument_id", F.col("effective_date").alias("position_date"))
        broken = DR.position_violations(_with_computed(staged), i.sessions(), i.multipliers(), dividends, i.active(), i.table("silver_instruments"), i.inception().withColumnRenamed("signed_quantity", "expected_quantity"))
        thin = DR.coverage_violations(staged, "POSITION_DAILY_COVERAGE", ["portfolio_id", "position_date"], "instrument_id", universe.instruments)
        return sorted({*_rules(broken), *_rules(thin)})

    return out, checks


def _flows(i: _Inputs) -> DataFrame:
    return P.dividend_flows(i.table("silver_positions").select(*POSITION_KEY, "signed_quantity"), i.dividends())


def _opening(i: _Inputs) -> DataFrame:
    first = i.table("silver_positions").where("basis = 'INITIAL_ALLOCATION'").join(i.closes().withColumnRenamed("price_date", "position_date"), ["instrument_id", "position_date"])
    return P.opening_cash(i.active().select("portfolio_id", "initial_nav"), P.market_values(first))


def _cash(i: _Inputs, universe: Universe) -> tuple[DataFrame, Callable[[DataFrame], list[str]]]:
    flows = _flows(i).join(_opening(i), "portfolio_id").join(i.active().select("portfolio_id", "base_currency"), "portfolio_id")
    rows = P.cash_roll_forward(flows.withColumnRenamed("dividend_positions", "action_count"))
    out = _hashed(rows.select(*CASH_KEY, "base_currency", "opening_cash", "dividend_flow", "closing_cash", "action_count"))

    def checks(staged: DataFrame) -> list[str]:
        expected = _flows(i).select(*CASH_KEY, F.col("dividend_flow").alias("expected_flow"), F.col("dividend_positions").alias("expected_actions"))
        return _rules(DR.cash_violations(_with_computed(staged), expected, _opening(i), i.active(), i.sessions().withColumnRenamed("position_date", "cash_date")))

    return out, checks


def _values(i: _Inputs, universe: Universe) -> tuple[DataFrame, Callable[[DataFrame], list[str]]]:
    positions = i.table("silver_positions").select("portfolio_id", "instrument_id", F.col("position_date").alias("valuation_date"), "signed_quantity")
    closes = i.closes().select("instrument_id", F.col("price_date").alias("valuation_date"), "price_date", "close_price", "quote_currency")
    rows = P.market_values(positions.join(closes, ["instrument_id", "valuation_date"]))
    out = _hashed(rows.select(*VALUE_KEY, "price_date", F.col("quote_currency").alias("currency"), "signed_market_value", "absolute_market_value", "position_side"))

    def checks(staged: DataFrame) -> list[str]:
        broken = DR.market_value_violations(_with_computed(staged), positions, closes)
        thin = DR.coverage_violations(staged, "POSITION_MARKET_VALUE_INPUT_COVERAGE", ["portfolio_id", "valuation_date"], "instrument_id", universe.instruments)
        return sorted({*_rules(broken), *_rules(thin)})

    return out, checks


def _metrics(i: _Inputs, universe: Universe) -> tuple[DataFrame, Callable[[DataFrame], list[str]]]:
    values = i.table("gold_position_market_values").select(*VALUE_KEY, "signed_market_value")
    cash = i.table("silver_cash_balances").select("portfolio_id", F.col("cash_date").alias("valuation_date"), "closing_cash")
    initial = i.active().select("portfolio_id", "initial_nav", "base_currency")
    out = _hashed(_from_initial(P.daily_metrics(values, cash), initial))

    def checks(staged: DataFrame) -> list[str]:
        return _rules(DR.daily_metric_violations(_with_computed(staged), values, cash, initial, universe.instruments))

    return out, checks


def _from_initial(rows: DataFrame, initial: DataFrame) -> DataFrame:
    """Metrics with the portfolio's currency, the P&L of its first date being against its initial NAV."""
    first = F.lag("nav").over(Window.partitionBy("portfolio_id").orderBy("valuation_date")).isNull()
    rows = rows.join(initial, "portfolio_id").withColumn("baseline", F.when(first, F.col("initial_nav").cast(AMOUNT)).otherwise(F.col("baseline")))
    rows = rows.withColumn("pnl", (F.col("nav") - F.col("baseline")).cast(AMOUNT))
    return rows.withColumn("daily_return", share(F.col("pnl"), F.col("baseline"))).drop("initial_nav")


def _derived(i: _Inputs, universe: Universe, table: str, keys: list[str], make: Callable, run_id: str, clock: str) -> Callable[[SparkSession, dict], dict]:
    def work() -> dict:
        rows, checks = make(i, universe)
        return _require(publish(i.store, table, rows, keys, Failures(), run_id, clock, checks=checks))

    return lambda spark, done: audited(i.store, table, run_id, clock, work)


def _risk(i: _Inputs, universe: Universe, run_id: str, clock: str) -> Callable[[SparkSession, dict], dict]:
    """The bundle of a run: exposures, scenarios, measures and stress results, and the run that marks them as complete."""

    def work(spark: SparkSession) -> dict:
        store, as_of = i.store, F.lit(i.as_of).cast("date")
        frozen = i.table("silver_positions").where(F.col("position_date") == as_of).select(F.col("portfolio_id").alias("run_id"), "instrument_id", "signed_quantity")
        exposures = R.static_exposures(frozen, i.closes().where(F.col("price_date") == as_of))
        cash = i.table("silver_cash_balances").where(F.col("cash_date") == as_of).select(F.col("portfolio_id").alias("run_id"), "closing_cash")
        navs = exposures.groupBy("run_id").agg(F.sum("market_value").alias("value")).join(cash, "run_id").select("run_id", (F.col("value") + F.col("closing_cash")).alias("static_nav"))
        returns = R.adjusted_returns(i.closes())
        components = R.component_pnl(exposures, returns)
        scenarios = R.price_scenarios(components)
        shocks = i.table("silver_stress_scenario_shocks").join(i.table("silver_stress_scenarios").where("is_active").select("scenario_id"), "scenario_id").select("scenario_id", "instrument_id", "shock_ratio")
        bundle = {
            "gold_risk_exposures": exposures,
            "gold_historical_pnl": scenarios,
            "gold_var_measures": R.discrete_var(scenarios),
            "gold_stress_results": R.stress(exposures, shocks, navs),
        }
        staged = {name: store.stage(name, rows) for name, rows in bundle.items()}
        read = {name: store.read_folders([f]) for name, f in staged.items()}
        observations = i.closes().select("price_date").distinct().count() - 1
        broken = DR.risk_violations(read["gold_historical_pnl"], read["gold_var_measures"], read["gold_stress_results"], components.drop("prior_date"), read["gold_risk_exposures"], shocks, navs, observations, universe.instruments, universe.scenarios, (universe.scenarios[0], "-0.1"))
        failed = _rules(broken)
        runs = navs.select("run_id", as_of.alias("as_of_date"), "static_nav", F.lit(observations).cast("long").alias("observations"), F.lit(run_id).alias("audit_run_id"), F.lit("SUCCEEDED").alias("status"))
        if failed:
            raise RunFailed("gold_risk_runs", failed)
        store.commit_staged({**{n: [f] for n, f in staged.items()}, "gold_risk_runs": [store.stage("gold_risk_runs", runs)]})
        return {"observations": observations, "runs": store.read("gold_risk_runs").count()}

    return lambda spark, done: audited(i.store, "gold_risk_runs", run_id, clock, lambda: work(spark))


def served(store: SnapshotStore) -> dict[str, DataFrame]:
    """The serving views: the latest complete run of each portfolio with its measures and stress results."""
    runs = S.latest_published(store.read("gold_risk_runs"), ["run_id"], ["as_of_date", "audit_run_id"], F.col("status") == "SUCCEEDED")
    return {"latest_runs": runs, **S.bundle(runs, store.read("gold_var_measures"), store.read("gold_stress_results"))}


def _validate_serving(i: _Inputs, universe: Universe) -> Callable[[SparkSession, dict], dict]:
    def stage(spark: SparkSession, done: dict) -> dict:
        views = served(i.store)
        complete = S.bundle_completeness(views["latest_runs"], views["var"], views["stress"], len(R.LEVELS), len(universe.scenarios))
        checks = {
            "SERVING_BUNDLE_COMPLETE": complete.where("not is_complete").isEmpty(),
            "SERVING_RUN_PER_PORTFOLIO": views["latest_runs"].count() == len(i.portfolios),
            "SERVING_KEYS_UNIQUE": reduce(lambda a, b: a and b, (S.key_checks(views[n], k, n).where("duplicate_keys > 0 or null_keys > 0").isEmpty() for n, k in (("var", ["run_id", "confidence_level"]), ("stress", ["run_id", "scenario_id"])))),
        }
        failed = sorted(k for k, ok in checks.items() if not ok)
        if failed:
            raise RunFailed("serving", failed)
        return checks

    return stage


def daily_risk(store: SnapshotStore, manifests: Sequence[Manifest], calendar: Calendar, universe: Universe, parameters: Sequence[RunParameters], run_id: str, clock: str) -> Pipeline:
    """The ten stages of the daily run, for all given portfolios (of one as-of date) at once."""
    dates = {p.as_of_date for p in parameters}
    if len(dates) != 1:
        raise ValueError("a run has one as-of date")
    i = _Inputs(store, dates.pop(), tuple(p.portfolio_id for p in parameters))
    stages = list(market_data(store, manifests, calendar, universe, run_id, clock).stages)
    for name, table, keys, make in (
        ("derive_positions", "silver_positions", POSITION_KEY, _positions),
        ("derive_cash_balances", "silver_cash_balances", CASH_KEY, _cash),
        ("calculate_position_market_values", "gold_position_market_values", VALUE_KEY, _values),
        ("calculate_portfolio_daily_metrics", "gold_portfolio_daily_metrics", METRIC_KEY, _metrics),
    ):
        stages.append((name, _derived(i, universe, table, keys, make, run_id, clock)))
    stages.append(("calculate_risk_measures", _risk(i, universe, run_id, clock)))
    stages.append(("validate_serving_outputs", _validate_serving(i, universe)))
    return Pipeline(stages)
