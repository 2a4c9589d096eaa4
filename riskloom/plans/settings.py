"""Settings from the environment, and a report on what a run needs: ``python -m riskloom.plans.settings [--spark]``."""

from __future__ import annotations

import importlib.util
import os
import shutil
import sys
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_PYTHON = (3, 10)


@dataclass(frozen=True)
class Settings:
    """environment names where the code runs; store is the root of the snapshot store, any path that Spark reaches."""

    environment: str
    store: str

    @classmethod
    def from_environment(cls, root: Path) -> Settings:
        store = os.environ.get("RISKLOOM_STORE", "store")
        known = "://" in store or Path(store).is_absolute()
        return cls(os.environ.get("RISKLOOM_ENV", "local"), store if known else str((root / store).resolve()))


@dataclass(frozen=True)
class Check:
    name: str
    passed: bool
    detail: str


def diagnose(root: Path) -> list[Check]:
    """What can be said without starting anything or changing the machine."""
    settings = Settings.from_environment(root)
    out = [Check("Python", sys.version_info[:2] >= LEAST_PYTHON, ".".join(map(str, sys.version_info[:3]))), Check("Java", bool(os.environ.get("JAVA_HOME") or shutil.which("java")), "java on PATH or JAVA_HOME")]
    out += [Check(f"Package {name}", importlib.util.find_spec(name) is not None, name) for name in ("pyspark", "pyarrow", "pandas", "numpy")]
    out.append(Check("Settings", bool(settings.environment and settings.store), f"environment={settings.environment}, store={settings.store}"))
    return out


def session_smoke(spark: SparkSession) -> DataFrame:
    """One row: whom and what the session is connected to, and that it computes."""
    return spark.range(1).select(F.current_user().alias("user_name"), F.current_catalog().alias("catalog_name"), F.current_schema().alias("schema_name"), F.version().alias("spark_version"), (F.lit(1) + F.lit(1)).alias("two"))


def main(arguments: list[str] | None = None) -> int:
    checks = diagnose(Path.cwd())
    if "--spark" in (sys.argv[1:] if arguments is None else arguments):
        row = session_smoke(SparkSession.builder.getOrCreate()).first()
        checks.append(Check("Session", row["two"] == 2, f"{row['user_name']} {row['catalog_name']}.{row['schema_name']} {row['spark_version']}"))
    for c in checks:
        print(f"[{'PASS' if c.passed else 'FAIL'}] {c.name}: {c.detail}")
    return int(not all(c.passed for c in checks))


if __name__ == "__main__":
    raise SystemExit(main())
