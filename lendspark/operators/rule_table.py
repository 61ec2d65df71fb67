"""Business rules from a table.

A rule table has a row per rule: id, position, predicate, multiplier and words for people.  The predicate is a SQL
expression over the columns of an application (``rules.RULE_INPUTS``).  Spark's own analyser parses
it and checks names and types against that schema; what is not a plain condition on one row
(an aggregate, a window, a subquery, a random value) is refused.  Rules that cannot be used are reported with the
reason and left out; the others keep their order.  Where a usable predicate cannot be computed for a row (a
division by zero, say) it does not hold there.  A table is at most ``MAX_RULES`` rows, counted before they are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import RULE_INPUTS, Rule, lenient

MAX_RULES = 200

#: columns of a rule table; only the first four are required
RULE_TABLE_SCHEMA = ("rule_id string, position int, predicate string, multiplier double, label string, condition string, impact string, "
                     "reason string, rule_version string")
REQUIRED = ["rule_id", "position", "predicate", "multiplier"]

REJECTED_SCHEMA = "rule_id string, position int, predicate string, multiplier double, reason string, detail string"


@dataclass(frozen=True)
class RuleSet:
    """The usable rules in their order (numbered from 1), the refused ones, and the table's version."""

    rules: list[Rule]
    rejected: list[tuple]
    version: str

    def rejected_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rejected, REJECTED_SCHEMA)


def read_rules(spark: SparkSession, path: str, fmt: str = "parquet") -> RuleSet:
    """A rule table in storage (Parquet, JSON or CSV with a header), checked."""
    if fmt == "csv":
        table = spark.read.option("header", "true").option("enforceSchema", "false").csv(path)
    else:
        table = spark.read.format(fmt).load(path)
    return check_rules(table)


def check_rules(table: DataFrame) -> RuleSet:
    """The rules of a table, each tried against the application schema."""
    spark = table.sparkSession
    missing = [c for c in REQUIRED if c not in table.columns]
    if missing:
        raise ValueError(f"a rule table needs {', '.join(missing)}")
    if table.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    typed = [(F.col(c).try_cast(k) if c in table.columns else F.lit(None).cast(k)).alias(c)
             for c, k in (f.split(" ") for f in RULE_TABLE_SCHEMA.split(", "))]
    rows = table.select(*typed).collect()
    inputs = spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in RULE_INPUTS.items()))
    ids = [r["rule_id"] for r in rows]
    places = [r["position"] for r in rows]
    rules, rejected = [], []
    # equal and missing positions are refused, so the order is the table's own statement
    for r in sorted(rows, key=lambda r: (r["position"] is None, r["position"] or 0, r["rule_id"] or "")):
        reason, detail = _fault(r, ids, places, inputs)
        if reason:
            rejected.append((r["rule_id"], r["position"], r["predicate"], r["multiplier"], reason, detail))
            continue
        m = float(r["multiplier"])
        rules.append(Rule(len(rules) + 1, r["rule_id"], r["label"] or r["rule_id"], r["condition"] or r["predicate"], m, r["impact"] or "",
                          "reduce" if m < 1 else "increase" if m > 1 else "none",
                          r["reason"] or f"{r['predicate']}: multiply default probability by {m:g}.", r["predicate"]))
    versions = sorted({r["rule_version"] for r in rows if r["rule_version"]})
    return RuleSet(rules, rejected, "+".join(versions))


def _fault(row, ids: list, places: list, inputs: DataFrame) -> tuple[str, str]:
    """Why a rule cannot be used; ('', '') if it can."""
    if not row["rule_id"]:
        return "no id", ""
    if "," in row["rule_id"]:
        return "id holds a comma", ""
    if ids.count(row["rule_id"]) > 1:
        return "id not unique", ""
    if row["position"] is None:
        return "no position", ""
    if places.count(row["position"]) > 1:
        return "position not unique", ""
    m = row["multiplier"]
    if m is None or not math.isfinite(m) or m < 0:
        return "multiplier not a number of 0 or more", ""
    if not (row["predicate"] or "").strip():
        return "no predicate", ""
    return predicate_fault(row["predicate"], inputs)


def predicate_fault(predicate: str, inputs: DataFrame) -> tuple[str, str]:
    """What the analyser finds wrong with a condition on these inputs; ('', '') if nothing."""
    try:
        with lenient(inputs.sparkSession):
            # a filter takes a condition on one row: no aggregate, window or generator
            plan = inputs.where(F.expr(predicate))._jdf.queryExecution().analyzed()
    except ParseException as e:
        return "does not parse", e.getCondition() or ""
    except AnalysisException as e:
        condition = e.getCondition() or ""
        for start, reason in (("UNRESOLVED_COLUMN", "unknown column"), ("UNRESOLVED_ROUTINE", "unknown function"),
                              ("DATATYPE_MISMATCH.FILTER_NOT_BOOLEAN", "not a condition"), ("DATATYPE_MISMATCH", "types do not fit")):
            if condition.startswith(start):
                return reason, condition
        return "not a condition on one application", condition
    if not plan.subqueriesAll().isEmpty():
        return "holds a subquery", ""
    if not plan.deterministic():
        return "not the same each time", ""
    if "cast" not in predicate.lower() and "::" not in predicate and (made := _text_as_number(plan.toString(), inputs)):
        return "types do not fit", made
    return "", ""


def _text_as_number(plan: str, inputs: DataFrame) -> str:
    """A cast of text that the analyser had to add to compare it with a number; '' if none."""
    kinds = dict(inputs.dtypes)
    for what, kind in re.findall(r"cast\(([^()]*) as (\w+)\)", plan):
        column = what.partition("#")[0]
        if kind in ("double", "int", "bigint", "boolean", "date", "timestamp") and (
                kinds.get(column) == "string" if "#" in what else not re.fullmatch(r"[-+]?[0-9.]+(E[-+]?[0-9]+)?", what.strip())):
            return f"cast({column} as {kind})"
    return ""
