"""Declarative data-quality rules, compiled to one projection over the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARNING = "ERROR", "WARNING"
REJECT, QUARANTINE, WARN, DEDUPLICATE = "REJECT", "QUARANTINE", "WARN_AND_ACCEPT", "DEDUPLICATE"


@dataclass(frozen=True)
class Rule:
    """``violated`` is true where the rule is broken; null counts as kept."""

    rule_id: str
    violated: Column
    severity: str = ERROR
    disposition: str = REJECT
    field_name: str = ""
    expected: str = ""
    message: str = ""
    observed: Sequence[str] = field(default_factory=tuple)


def _struct(rule: Rule) -> Column:
    observed = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in rule.observed])) if rule.observed else F.lit(None).cast("string")
    return F.when(
        F.coalesce(rule.violated, F.lit(False)),
        F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.severity).alias("severity"),
            F.lit(rule.disposition).alias("disposition"),
            F.lit(rule.field_name).alias("affected_field"),
            observed.alias("observed_value"),
            F.lit(rule.expected).alias("expected"),
            F.lit(rule.message).alias("message"),
        ),
    )


def broken(rules: Sequence[Rule]) -> Column:
    """Array of the violations of a row."""
    return F.filter(F.array(*[_struct(r) for r in rules]), lambda v: v.isNotNull())


def violations(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """One row per row and broken rule; a single scan whatever the number of rules."""
    return df.select(*keys, F.inline(broken(rules)))


def summarise(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per row: counts of violations and warnings, and whether any rejects or quarantines."""
    return found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("violation_count"),
        F.count_if(F.col("severity") == WARNING).alias("warning_count"),
        F.bool_or(F.col("disposition") == REJECT).alias("has_reject"),
        F.bool_or(F.col("disposition") == QUARANTINE).alias("has_quarantine"),
        F.bool_or(F.col("severity") == ERROR).alias("has_error"),
    )


def judged(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The columns of ``summarise`` beside each row, without exploding: a projection, no shuffle. Rows without violations have 0 and false."""
    hit = [(r, F.coalesce(r.violated, F.lit(False))) for r in rules]

    def count(parts: list[Column]) -> Column:
        return sum((p.cast("long") for p in parts), F.lit(0).cast("long"))

    def any_of(parts: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, parts, F.lit(False))

    return df.withColumns(
        {
            "violation_count": count([v for _, v in hit]),
            "warning_count": count([v for r, v in hit if r.severity == WARNING]),
            "has_reject": any_of([v for r, v in hit if r.disposition == REJECT]),
            "has_quarantine": any_of([v for r, v in hit if r.disposition == QUARANTINE]),
            "has_error": any_of([v for r, v in hit if r.severity == ERROR]),
        }
    )
