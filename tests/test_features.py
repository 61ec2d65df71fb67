import math

from pyspark.sql import functions as F

from lendspark.functions.features import (coerce_numeric, credit_band, dti_ratio, engineer_features, loan_profile,
                                          monthly_payment)
from lendspark.functions.text import decision_label, format_money, format_percent, scenario_profile


def test_coerce_numeric_rules(spark):
    df = spark.createDataFrame([("12.5",), ("abc",), (None,), ("nan",), ("-3",)], "Income string")
    out = [r[0] for r in df.select(coerce_numeric(df, "Income").alias("v")).collect()]
    assert out == [12.5, 0.0, 0.0, 0.0, -3.0]
    # absent column -> the default for every row
    assert [r[0] for r in df.select(coerce_numeric(df, "Age").alias("v")).collect()] == [0.0] * 5


def test_dti_guards(spark):
    df = spark.createDataFrame([(1000.0, 0.0), (1000.0, 4000.0), (100.0, -50.0), (1.0, 5e-324)],
                               "LoanAmount double, Income double")
    out = [r[0] for r in df.select(dti_ratio(F.col("LoanAmount"), F.col("Income"))).collect()]
    assert out == [0.0, 0.25, -2.0, 0.0]   # zero income -> 0, negative kept, infinity -> 0


def test_engineer_overwrites_client_dti(spark):
    df = spark.createDataFrame([(30, 50000.0, 25000.0, 9.99)], "Age int, Income double, LoanAmount double, DTIRatio double")
    r = engineer_features(df).first()
    assert r["DTIRatio"] == 0.5 and r["Age_Income_Interaction"] == 1_500_000.0


def test_monthly_payment_and_band(spark):
    df = spark.createDataFrame([(18000.0, 9.8, 36, 790), (12000.0, 0.0, 12, 650), (0.0, 5.0, 12, 0),
                                (1000.0, 5.0, 0, 599)],
                               "LoanAmount double, InterestRate double, LoanTerm int, CreditScore int")
    rows = df.select(monthly_payment(F.col("LoanAmount"), F.col("InterestRate"), F.col("LoanTerm")).alias("p"),
                     credit_band(F.col("CreditScore")).alias("b")).collect()
    r = 9.8 / 100 / 12
    expected = 18000.0 * (r * (1 + r) ** 36) / ((1 + r) ** 36 - 1)
    assert math.isclose(rows[0]["p"], expected, rel_tol=1e-12)
    assert rows[1]["p"] == 1000.0
    assert rows[2]["p"] is None and rows[3]["p"] is None
    assert [x["b"] for x in rows] == ["Prime", "Orta", "-", "Zayıf"]


def test_loan_profile_ratio_null_for_zero_income(spark):
    df = spark.createDataFrame([(10000.0, 0.0, 5.0, 12, 700), (10000.0, 40000.0, 5.0, 12, 700)],
                               "LoanAmount double, Income double, InterestRate double, LoanTerm int, CreditScore int")
    rows = loan_profile(df).collect()
    assert rows[0]["loan_income_ratio"] is None
    assert rows[1]["loan_income_ratio"] == 0.25 and rows[1]["loan_income_pct"] == 25.0


def test_text_formats(spark):
    df = spark.createDataFrame([(92000.7, 8.24, 0), (1234567.0, None, 1)], "m double, p double, d int")
    rows = df.select(format_money(F.col("m")).alias("m"), format_percent(F.col("p")).alias("p"),
                     decision_label(F.col("d")).alias("d")).collect()
    assert rows[0]["m"] == "92.000 $" and rows[1]["m"] == "1.234.567 $"
    assert rows[0]["p"] == "%8.24" and rows[1]["p"] == "-"
    assert rows[0]["d"] == "Onaylanabilir Profil" and rows[1]["d"] == "Manuel İnceleme"


def test_scenario_profile_map(spark):
    df = spark.createDataFrame([(92000.0, 18000.0, 790, "Full-time", 84, "Yes")],
                               "i double, l double, s int, e string, m int, c string")
    prof = df.select(scenario_profile(*[F.col(c) for c in "ilsemc"]).alias("p")).first()["p"]
    assert prof == {"Gelir": "92.000 $", "Kredi Tutarı": "18.000 $", "Kredi Notu": "790", "İstihdam": "Full-time",
                    "Çalışma Süresi": "84 ay", "Kefil": "Var"}
