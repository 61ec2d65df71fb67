"""V1: per-row constraint check of applications.

Each broken rule yields a violation code ``<field>:<check>``; a row is valid
when it has none.  Valid rows go on to scoring, the rest to a quarantine
table with their codes, so nothing is dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORICAL_COLUMNS

# --- Fixed values: field constraints of the typed application ----------------------
# (field, kind, bound check) -- kind is "int" or "float"; check is (op, bound) or None
NUMERIC_CONSTRAINTS = [
    ("Age", "int", (">=", 18)),
    ("Income", "float", (">", 0)),
    ("LoanAmount", "float", (">=", 0)),
    ("CreditScore", "int", None),
    ("MonthsEmployed", "int", (">=", 0)),
    ("NumCreditLines", "int", (">=", 0)),
    ("InterestRate", "float", (">=", 0)),
    ("LoanTerm", "int", (">", 0)),
]

_OP_NAME = {">=": "ge", ">": "gt"}


INTEGRAL_TYPES = ("tinyint", "smallint", "int", "bigint")
FLOAT_TYPES = ("float", "double")


def _numeric_value(df: DataFrame, name: str) -> Column:
    """The field as a double: a plain cast for numeric columns, ``try_cast`` for text."""
    if dict(df.dtypes)[name] in INTEGRAL_TYPES + FLOAT_TYPES:
        return F.col(name).cast("double")
    return F.expr(f"try_cast(`{name}` AS DOUBLE)")


def _checks(df: DataFrame) -> list[tuple[str, Column]]:
    """(violation code, condition that is true when the row breaks the rule)."""
    checks: list[tuple[str, Column]] = []
    for name, kind, bound in NUMERIC_CONSTRAINTS:
        if name not in df.columns:
            checks.append((f"{name}:required", F.lit(True)))
            continue
        raw = F.col(name)
        dtype = dict(df.dtypes)[name]
        checks.append((f"{name}:required", raw.isNull()))
        if dtype in INTEGRAL_TYPES:
            # typed integers cannot be fractional, NaN or unparsable: only the bound is left
            value, bad_type = raw, None
        elif dtype in FLOAT_TYPES:
            value = raw
            bad_type = F.isnan(raw)
            if kind == "int":
                bad_type = bad_type | (raw != F.floor(raw))
        else:
            value = _numeric_value(df, name)
            bad_type = raw.isNotNull() & (value.isNull() | F.isnan(value))
            if kind == "int":
                bad_type = bad_type | (value != F.floor(value))
        if bad_type is not None:
            checks.append((f"{name}:type", bad_type))
        if bound is not None:
            op, b = bound
            # a NaN compares greater than everything in Spark; it is already a type error
            broken = value < F.lit(b) if op == ">=" else value <= F.lit(b)
            if dtype not in INTEGRAL_TYPES:
                broken = broken & ~F.isnan(value)
            checks.append((f"{name}:{_OP_NAME[op]}_{b}", broken))
    # optional and always recomputed, but what is sent must be a number
    if "DTIRatio" in df.columns and dict(df.dtypes)["DTIRatio"] not in INTEGRAL_TYPES + FLOAT_TYPES:
        checks.append(("DTIRatio:type", F.col("DTIRatio").isNotNull() & _numeric_value(df, "DTIRatio").isNull()))
    for name in CATEGORICAL_COLUMNS:
        checks.append((f"{name}:required", F.col(name).isNull() if name in df.columns else F.lit(True)))
    return checks


def validate_applications(df: DataFrame) -> DataFrame:
    """Add ``violations`` (array<string>) and ``is_valid`` (boolean).

    Built from plain boolean and string expressions (no lambda functions),
    so the check stays inside whole-stage code generation.
    """
    checks = _checks(df)
    bad = [F.coalesce(cond, F.lit(False)) for _, cond in checks]
    any_bad = bad[0]
    for b in bad[1:]:
        any_bad = any_bad | b
    codes = F.concat_ws(",", *[F.when(b, F.lit(code)) for (code, _), b in zip(checks, bad)])
    violations = F.when(codes == "", F.array().cast("array<string>")).otherwise(F.split(codes, ","))
    return df.withColumns({"violations": violations, "is_valid": ~any_bad})


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violation codes)."""
    checked = validate_applications(df)
    return checked.filter("is_valid"), checked.filter("NOT is_valid")
