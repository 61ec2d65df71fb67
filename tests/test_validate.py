from lendspark.constants import CATEGORICAL_COLUMNS
from lendspark.operators.validate import split_valid, validate_applications


def test_invalid_case_rejected(spark):
    # The reference's negative case: Age 17, Income 0, everything else missing.
    df = spark.createDataFrame([(17, 0.0)], "Age int, Income double")
    r = validate_applications(df).first()
    assert not r["is_valid"]
    assert "Age:ge_18" in r["violations"] and "Income:gt_0" in r["violations"]
    assert "LoanTerm:required" in r["violations"]
    assert all(f"{c}:required" in r["violations"] for c in CATEGORICAL_COLUMNS)


def test_integer_fields_accept_integral_values_only(spark):
    cols = ("Age string, Income double, LoanAmount double, CreditScore double, MonthsEmployed int, "
            "NumCreditLines int, InterestRate double, LoanTerm int, " + ", ".join(f"{c} string" for c in CATEGORICAL_COLUMNS))
    base = [5000.0, 1000.0, 700.0, 10, 2, 5.0, 12] + ["x"] * 7
    df = spark.createDataFrame([["38"] + base, ["38.0"] + base, ["38.5"] + base, ["abc"] + base,
                                ["40"] + [5000.0, 1000.0, 700.5, 10, 2, 5.0, 12] + ["x"] * 7], cols)
    rows = validate_applications(df).collect()
    assert [r["is_valid"] for r in rows] == [True, True, False, False, False]
    assert rows[2]["violations"] == ["Age:type"] and rows[4]["violations"] == ["CreditScore:type"]


def test_split_keeps_every_row(tiny_apps):
    valid, bad = split_valid(tiny_apps)
    assert valid.count() + bad.count() == tiny_apps.count()
    assert bad.filter("Income > 0").count() == 0   # only zero incomes fail on the fixture


def test_float_columns_nan_and_fraction(spark):
    cols = ("Age double, Income double, LoanAmount double, CreditScore int, MonthsEmployed int, "
            "NumCreditLines int, InterestRate double, LoanTerm int, " + ", ".join(f"{c} string" for c in CATEGORICAL_COLUMNS))
    ok = [40.0, 5000.0, 1000.0, 700, 10, 2, 5.0, 12] + ["x"] * 7
    rows = [ok, [40.5] + ok[1:], [40.0, float("nan")] + ok[2:], [40.0, 5000.0, 1000.0, 700, 10, 2, -1.0, 12] + ["x"] * 7]
    got = [r["violations"] for r in validate_applications(spark.createDataFrame(rows, cols)).collect()]
    assert got == [[], ["Age:type"], ["Income:type"], ["InterestRate:ge_0"]]
