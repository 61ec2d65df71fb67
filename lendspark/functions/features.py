"""Column expressions for features and loan profile fields.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CREDIT_BAND_LOWEST, CREDIT_BANDS, MISSING_DISPLAY

INF = float("inf")


def coerce_numeric(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """absent column -> default; unparsable, null or NaN -> default.

    ``try_cast`` keeps ANSI mode from failing on junk text.
    """
    if name not in df.columns:
        return F.lit(float(default))
    as_double = F.expr(f"try_cast(`{name}` AS DOUBLE)")
    return F.coalesce(F.nanvl(as_double, F.lit(None).cast("double")), F.lit(float(default)))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient with zero denominators and infinities mapped to NULL."""
    q = F.when(denominator == 0, F.lit(None).cast("double")).otherwise(numerator / denominator)
    return F.when(F.abs(q) == F.lit(INF), F.lit(None).cast("double")).otherwise(q)


def dti_ratio(loan_amount: Column, income: Column) -> Column:
    """F2: LoanAmount / Income; zero income or an infinite result -> 0.0."""
    return F.coalesce(safe_ratio(loan_amount, income), F.lit(0.0))


def engineer_features(df: DataFrame) -> DataFrame:
    """the shared training/scoring feature step.

    Income, LoanAmount and Age are coerced (F1); ``DTIRatio`` is always
    recomputed (a client-sent value is overwritten) and the interaction term
    is added.  The raw Income/LoanAmount/Age columns themselves are kept.
    """
    income = coerce_numeric(df, "Income")
    loan = coerce_numeric(df, "LoanAmount")
    age = coerce_numeric(df, "Age")
    return df.withColumns({
        "DTIRatio": dti_ratio(loan, income),
        "Age_Income_Interaction": age * income,
    })


def monthly_payment(principal: Column, annual_rate_pct: Column, term_months: Column) -> Column:
    """annuity payment; NULL without principal or term, P/n at zero rate."""
    r = annual_rate_pct / F.lit(100.0) / F.lit(12.0)
    growth = F.pow(F.lit(1.0) + r, term_months.cast("double"))
    annuity = principal * (r * growth) / (growth - F.lit(1.0))
    no_principal = principal.isNull() | F.isnan(principal) | (principal == 0)
    no_term = term_months.isNull() | (term_months == 0)
    zero_rate = r.isNull() | F.isnan(r) | (r == 0)
    return (F.when(no_principal | no_term, F.lit(None).cast("double"))
            .when(zero_rate, principal / term_months.cast("double"))
            .otherwise(annuity))


def credit_band(score: Column) -> Column:
    """credit band from the score; '-' for a missing or non-positive score."""
    out = F.lit(CREDIT_BAND_LOWEST)
    for floor, label in reversed(CREDIT_BANDS):
        out = F.when(score >= floor, F.lit(label)).otherwise(out)
    return F.when(score.isNull() | (score <= 0), F.lit(MISSING_DISPLAY)).otherwise(out)


def loan_income_ratio(loan_amount: Column, income: Column) -> Column:
    """loan/income, NULL when income is not positive (unlike F2's 0)."""
    return F.when(income > 0, loan_amount / income)


def loan_profile(df: DataFrame) -> DataFrame:
    """F5-F7 for a whole table: payment, band, loan/income ratio and percent."""
    ratio = loan_income_ratio(F.col("LoanAmount"), F.col("Income"))
    return df.withColumns({
        "monthly_payment": monthly_payment(F.col("LoanAmount"), F.col("InterestRate"), F.col("LoanTerm")),
        "credit_band": credit_band(F.col("CreditScore")),
        "loan_income_ratio": F.round(ratio, 4),
        "loan_income_pct": F.round(ratio * F.lit(100.0), 1),
    })
