"""Running rules: one union of all, or one materialised step per rule with failures kept apart."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gainsay.operators.order import numbered, sorted_in_parts
from gainsay.plans import rules as r
from gainsay.schemas import FINDINGS, STRING, struct
from gainsay.session import checkpointed
from gainsay.sources.case import CaseTables


class Rule(NamedTuple):
    """A rule is any function from case tables to findings; bind parameters with a closure."""

    name: str
    evaluate: Callable[[CaseTables], DataFrame]


# Fixed order: findings of equal severity come out in this order.
DEFAULT_RULES = (
    Rule(r.PREFETCH_WITHOUT_EVENT, r.prefetch_execution_without_event),
    Rule(r.PERSISTENCE_WITHOUT_EXECUTION, r.persistence_without_execution),
    Rule(r.HASH_MISMATCH, r.prefetch_hash_mismatch),
    Rule(r.RECORD_GAP, r.record_number_gap),
    Rule(r.TIMESTOMPING, r.mft_timestomping),
)

FAILURES = struct(rule_name=STRING, error=STRING)


def run(
    tables: CaseTables, rules: Iterable[Rule] | None = None, ordered: bool = True
) -> DataFrame:
    """Findings of all rules, highest severity first.

    None means the default rules, an empty list means none. A failing rule fails the whole; use
    ``run_isolated`` to keep the others. Unordered findings are a lazy plan, but for a small job that
    sizes the index of names of the first rule and the gaps of the fourth, which are written. A sort reads its
    input twice, so ordered ones are written to the checkpoint folder first rather than found twice.
    """
    chosen = DEFAULT_RULES if rules is None else tuple(rules)
    parts = [_evaluate(rule, place, tables) for place, rule in enumerate(chosen)]
    found = _union(tables.events.sparkSession, parts, ordered=False)
    return sorted_in_parts(checkpointed(found), _severity_order()) if ordered and parts else found


def run_isolated(
    tables: CaseTables, rules: Iterable[Rule] | None = None, ordered: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Findings of all rules that work, and one row (rule_name, error) per rule that does not.

    A rule's error only shows when it runs, so each rule is written to the checkpoint folder.
    """
    spark = tables.events.sparkSession
    parts, failed = [], []
    for place, rule in enumerate(DEFAULT_RULES if rules is None else tuple(rules)):
        try:
            parts.append(checkpointed(_evaluate(rule, place, tables)))
        except Exception as error:  # noqa: BLE001 - one rule must not stop the others
            failed.append((rule.name, str(error).strip().split("\n", 1)[0]))
    return _union(spark, parts, ordered), spark.createDataFrame(failed, FAILURES)


def _evaluate(rule: Rule, place: int, tables: CaseTables) -> DataFrame:
    result = rule.evaluate(tables)
    missing = set(FINDINGS.names) - set(result.columns)
    if missing:
        raise ValueError(f"rule {rule.name} lacks finding columns: {sorted(missing)}")
    return result.select(*FINDINGS.names).withColumn("rule_ordinal", F.lit(place))


def _union(spark: SparkSession, parts: list[DataFrame], ordered: bool) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], FINDINGS)
    found = reduce(DataFrame.unionByName, parts)
    return sorted_in_parts(found, _severity_order()) if ordered else found


def ranked(
    tables: CaseTables, rules: Iterable[Rule] | None = None, columns: Sequence[str] = FINDINGS.names
) -> DataFrame:
    """The named columns of all findings with their ``position``, from 1, in the order of ``by_severity``.

    Texts that are not asked for are never rendered. Findings alike in the whole order come in any order.
    """
    chosen = DEFAULT_RULES if rules is None else tuple(rules)
    parts = [_evaluate(rule, place, tables) for place, rule in enumerate(chosen)]
    keys = ["severity_rank", "rule_ordinal", "case_id", "source_paths", "ordinal", "details"]
    found = _union(tables.events.sparkSession, parts, ordered=False)
    # Finding the bounds of the parts reads the rows once more, so they are written first.
    slim = checkpointed(found.select(*dict.fromkeys([*keys, *columns])))
    return numbered(slim, [F.col(keys[0]).desc(), *keys[1:]]).select(*columns, "position")


def by_severity(found: DataFrame) -> DataFrame:
    """Highest severity first; equal ones by rule, source and place in the source."""
    return found.orderBy(*_severity_order())


def _severity_order() -> list[Column | str]:
    return [F.col("severity_rank").desc(), "rule_ordinal", "case_id", "source_paths", "ordinal", "details"]


def by_rule(found: DataFrame) -> DataFrame:
    return found.orderBy(
        "rule_name", F.col("severity_rank").desc(), "case_id", "source_paths", "ordinal", "details"
    )
