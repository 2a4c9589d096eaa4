"""Ordered stages with run audits, gates and validated parameters."""

from __future__ import annotations

import datetime as dt
import re
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.digests import tree_digest
from riskloom.sources.store import SnapshotStore

_ID = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*")
_GIT = re.compile(r"[0-9a-f]{7,40}")
TRIGGERS = ("MANUAL", "SCHEDULED", "REPROCESS")


@dataclass(frozen=True)
class RunParameters:
    """ValueError for ids, dates, code versions and triggers of another form."""

    portfolio_id: str
    as_of_date: str
    code_version: str
    trigger: str = "MANUAL"

    def __post_init__(self) -> None:
        if not _ID.fullmatch(self.portfolio_id):
            raise ValueError(f"not an identifier: {self.portfolio_id!r}")
        if dt.date.fromisoformat(self.as_of_date).isoformat() != self.as_of_date:
            raise ValueError(f"not an ISO date: {self.as_of_date!r}")
        if not _GIT.fullmatch(self.code_version):
            raise ValueError(f"not a code version: {self.code_version!r}")
        if self.trigger not in TRIGGERS:
            raise ValueError(f"not a trigger: {self.trigger!r}")


@dataclass
class Failures:
    """Ids of the rules that a run has broken, sorted and without repeats."""

    found: set[str] = field(default_factory=set)

    def require(self, met: bool, rule_id: str) -> None:
        if not met:
            self.found.add(rule_id)

    def sorted(self) -> list[str]:
        return sorted(self.found)


AUDIT = "run_id string, dataset string, attempt int, status string, published boolean, row_count long, before_digest string, after_digest string, failed_rule_ids array<string>, error string, completed_at_utc string"


def digest(df: DataFrame, keys: list[str]) -> tuple[int, str]:
    """Rows and digest of a snapshot, whatever the order of its rows."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")) for c in sorted(df.columns)])
    found = tree_digest(df.withColumn("__all", F.lit(1)), ["__all"], row, F.concat_ws("|", *[F.col(k).cast("string") for k in keys])).first()
    return (int(found["rows"]), found["digest"]) if found else (0, "")


def next_attempt(store: SnapshotStore, dataset: str) -> int:
    """One more than the runs of the dataset so far."""
    return 1 + (store.read("runs").where(F.col("dataset") == dataset).count() if store.exists("runs") else 0)


def publish(store: SnapshotStore, dataset: str, prospective: DataFrame, keys: list[str], failures: Failures, run_id: str, clock: str, expected_rows: int | None = None, checks: Callable[[DataFrame], list[str]] | None = None) -> dict:
    """Publish a snapshot and its audit row in one commit if no rule failed; only the audit row otherwise.

    The frame is computed once, into a staged folder; rows, digest, keys and ``checks`` (which returns the ids of failed rules) are
    read from there. A snapshot equal to the current one isn't made current again (published is false), so reruns change nothing.
    """
    folder = store.stage(dataset, prospective)
    staged = store.read_folders([folder])
    before = digest(store.read(dataset), keys)[1] if store.exists(dataset) else ""
    rows, after = digest(staged, keys)
    failures.require(staged.groupBy(*keys).count().where("count > 1").isEmpty(), "BUSINESS_KEY_UNIQUE")
    failures.require(expected_rows is None or rows == expected_rows, "EXPECTED_ROW_COUNT")
    for rule_id in checks(staged) if checks else ():
        failures.require(False, rule_id)
    ok = not failures.found
    published = ok and after != before
    audit = {"run_id": run_id, "dataset": dataset, "attempt": next_attempt(store, dataset), "status": "SUCCEEDED" if ok else "FAILED", "published": published, "row_count": rows, "before_digest": before, "after_digest": after if ok else before, "failed_rule_ids": failures.sorted(), "error": None, "completed_at_utc": clock}
    _commit(store, {dataset: [folder]} if published else {}, audit)
    if published and digest(store.read(dataset), keys) != (rows, after):
        raise RuntimeError(f"{dataset}: what was read back isn't what was written")
    return audit


def _commit(store: SnapshotStore, tables: dict[str, list[str]], audit: dict) -> None:
    names = [x.split()[0] for x in AUDIT.split(", ")]
    row = store.spark.createDataFrame([tuple(audit[n] for n in names)], AUDIT)
    store.commit_staged(tables, {"runs": [store.stage("runs", row)]})


class RunFailed(RuntimeError):
    """A stage was not published; ``failed_rule_ids`` says why, ``audited`` whether its run has an audit row already."""

    def __init__(self, dataset: str, failed_rule_ids: list[str], audited: bool = False) -> None:
        super().__init__(f"{dataset}: {', '.join(failed_rule_ids) or 'rejected rows'}")
        self.failed_rule_ids, self.audited = failed_rule_ids, audited


def audited(store: SnapshotStore, dataset: str, run_id: str, clock: str, work: Callable[[], dict]) -> dict:
    """Run ``work``; an exception leaves one FAILED audit row, with the broken rules if it names any, and is raised again."""
    try:
        return work()
    except Exception as e:
        if not getattr(e, "audited", False):
            failed = getattr(e, "failed_rule_ids", ["UNHANDLED_EXCEPTION"])
            _commit(store, {}, {"run_id": run_id, "dataset": dataset, "attempt": next_attempt(store, dataset), "status": "FAILED", "published": False, "row_count": 0, "before_digest": "", "after_digest": "", "failed_rule_ids": failed, "error": traceback.format_exc(), "completed_at_utc": clock})
        raise


@dataclass
class Pipeline:
    """Stages in order; each takes the session and what the earlier ones returned. The first failure ends the run."""

    stages: list[tuple[str, Callable[[SparkSession, dict], object]]]

    def run(self, spark: SparkSession) -> dict:
        done: dict[str, object] = {}
        for name, stage in self.stages:
            done[name] = stage(spark, done)
        return done
