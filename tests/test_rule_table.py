import pytest
from pyspark.sql import functions as F

from lendspark.operators import rule_table
from lendspark.operators.rules import RULES, apply_rules, explode_audit, rule_audit_column, with_flags

COLUMNS = "rule_id string, position int, predicate string, multiplier double"
APPLICATION = "id int, p double, CreditScore int, DTIRatio double, MonthsEmployed string, EmploymentType string, Income double, LoanAmount double"


def made(spark, rows):
    return rule_table.check_rules(spark.createDataFrame(rows, COLUMNS))


def test_order_is_the_tables_position_and_steps_are_clamped(spark):
    """Increases first reach 1 and are cut there, so reductions start from 1; the built-in order cannot show that."""
    found = made(spark, [("half", 30, "CreditScore > 700", 0.5), ("much", 10, "Income > 0", 3.0), ("more", 20, "Income > 0", 3.0),
                         ("never", 40, "Income < 0", 0.1)])
    assert [r.id for r in found.rules] == ["much", "more", "half", "never"] and not found.rejected
    df = spark.createDataFrame([(1, 0.4, 750, 0.1, "7", "Full-time", 10.0, 1.0), (2, 0.05, 600, 0.1, "7", "Full-time", 10.0, 1.0)], APPLICATION)
    got = {r["id"]: r for r in apply_rules(df, "p", rules=found.rules).withColumn("audit", rule_audit_column(rules=found.rules)).collect()}
    assert got[1]["adjusted_probability"] == 0.5 and got[2]["adjusted_probability"] == pytest.approx(0.45)
    assert [(a["id"], a["before"], a["after"]) for a in got[1]["audit"]] == [("much", 40.0, 100.0), ("more", 100.0, 100.0), ("half", 100.0, 50.0)]
    steps = explode_audit(apply_rules(df, "p", rules=found.rules), "id", rules=found.rules).where("id = 1").orderBy("step").collect()
    assert [(s["step"], s["rule_id"]) for s in steps] == [(1, "much"), (2, "more"), (3, "half")]
    assert df.columns == apply_rules(df, "p", rules=found.rules).columns[:len(df.columns)]


def test_missing_values_read_as_zero_and_empty(spark):
    found = made(spark, [("zero", 1, "CreditScore = 0", 1.1), ("none", 2, "Education = ''", 1.1), ("ratio", 3, "LoanAmount / Income > 1", 1.1),
                         ("text", 4, "cast(EmploymentType AS double) > 1", 1.1), ("months", 5, "MonthsEmployed >= 6", 1.1)])
    assert len(found.rules) == 5
    df = spark.createDataFrame([(1, 0.5, None, None, "x", None, 0.0, 5.0), (2, 0.5, 5, 0.1, "6", "2.5", 4.0, 5.0)], APPLICATION)
    flags = {r["id"]: [r[f"_f{i}"] for i in range(1, 6)] for r in with_flags(df, found.rules).collect()}
    assert flags == {1: [True, True, False, False, False], 2: [False, True, True, True, True]}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


BAD = [("(Age > 1", "does not parse"), ("Age > 1; DROP TABLE x", "does not parse"), ("Wage > 1", "unknown column"), ("no_function(Age)", "unknown function"),
       ("Age + 1", "not a condition"), ("Education", "not a condition"), ("sum(Age) > 1", "not a condition on one application"),
       ("row_number() OVER (ORDER BY Age) > 1", "not a condition on one application"), ("explode(array(Age)) > 1", "not a condition on one application"),
       ("Age IN (SELECT id FROM range(3))", "holds a subquery"), ("rand() > 0.5", "not the same each time"),
       ("reflect('java.lang.System', 'getProperty', 'user.home') = 'x'", "not the same each time"), ("Education > 3", "types do not fit"),
       ("Age = 'old'", "types do not fit"), ("Age > array(1)", "types do not fit"), (None, "no predicate"), ("  ", "no predicate")]


def test_unusable_predicates_are_reported(spark):
    rows = [(f"bad{i}", i, p, 1.1) for i, (p, _) in enumerate(BAD)] + [("good", 99, "Age > 30", 1.1)]
    found = made(spark, rows)
    assert [r.id for r in found.rules] == ["good"] and found.rules[0].position == 1
    got = {r["rule_id"]: r["reason"] for r in found.rejected_frame(spark).collect()}
    assert got == {f"bad{i}": why for i, (_, why) in enumerate(BAD)}


def test_unusable_records_are_reported(spark):
    ok = "Age > 1"
    found = made(spark, [("a", 1, ok, 1.1), ("a", 2, ok, 1.1), (None, 3, ok, 1.1), ("b", None, ok, 1.1), ("c", 4, ok, 1.1), ("d", 4, ok, 1.1),
                         ("e", 5, ok, None), ("f", 6, ok, -0.1), ("g", 7, ok, float("nan")), ("h", 8, ok, float("inf")), ("i", 9, ok, 0.0), ("x,y", 10, ok, 1.0)])
    assert [r.id for r in found.rules] == ["i"] and len(found.rejected) == 11
    assert made(spark, []).rules == []
    with pytest.raises(ValueError):
        rule_table.check_rules(spark.createDataFrame([("a", 1)], "rule_id string, position int"))
    with pytest.raises(ValueError):
        made(spark, [(f"r{i}", i, ok, 1.1) for i in range(rule_table.MAX_RULES + 1)])


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_read_from_storage(spark, tmp_path, fmt):
    path = str(tmp_path / "rules")
    table = spark.createDataFrame([(r.id, r.position * 10, r.predicate, r.multiplier, "v2") for r in reversed(RULES)], COLUMNS + ", rule_version string")
    writer = table.write.option("header", "true")
    getattr(writer, fmt)(path)
    found = rule_table.read_rules(spark, path, fmt)
    assert [(r.position, r.id, r.multiplier, r.direction, r.predicate) for r in found.rules] == [
        (r.position, r.id, r.multiplier, r.direction, r.predicate) for r in RULES]
    assert found.version == "v2" and not found.rejected


def test_no_rules_leave_scores_alone(spark):
    df = spark.createDataFrame([(1, 0.4, 750, 0.1, "7", "Full-time", 10.0, 1.0)], APPLICATION)
    out = apply_rules(df, "p", rules=[]).withColumn("audit", rule_audit_column(rules=[])).first()
    assert out["adjusted_probability"] == 0.4 and out["audit"] == []
    assert explode_audit(apply_rules(df, "p"), "id").agg(F.count("step")).first()[0] > 0
