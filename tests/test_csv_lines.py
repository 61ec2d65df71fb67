import random

import pytest

from lendspark.constants import ID_COL
from lendspark.sources.applications import APPLICATION_SCHEMA, read_applications, read_checked
from lendspark.sources.csv_lines import numbered_lines, read_lines

NAMES = [f.name for f in APPLICATION_SCHEMA.fields]


def record(i, **changes):
    row = {"LoanID": str(i), "Age": "30", "Income": "1000.5", "LoanAmount": "10", "CreditScore": "700", "MonthsEmployed": "5", "NumCreditLines": "1",
           "InterestRate": "3", "LoanTerm": "12", "DTIRatio": "", "Education": "PhD", "EmploymentType": "Full-time", "MaritalStatus": "Single",
           "HasMortgage": "Yes", "HasDependents": "No", "LoanPurpose": "Auto", "HasCoSigner": "No", "Default": "0"}
    return ",".join({**row, **changes}[n] for n in NAMES)


def test_lines_of_every_kind(spark, tmp_path):
    """Each line is a header, blank, a record or malformed, with its raw text and its place in the file."""
    lines = [",".join(NAMES), record(1), record(2) + ",extra", "", record(3)[:30], '"' + record(4), record(5, Education='"PhD, ""hon."""'), record("x", Age="old"),
             ",", "   ", record(6, LoanPurpose="Auto,Home"), record(7)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "b.csv").write_text("\r\n".join([lines[0], record(8), "x"]))
    apps, malformed, counts = read_checked(spark, str(tmp_path / "in"))
    got = {(r.file.rsplit("/", 1)[1], r.line): (r.reason, r.raw) for r in malformed.collect()}
    assert got == {("a.csv", 3): ("long", lines[2]), ("a.csv", 5): ("short", lines[4]), ("a.csv", 6): ("unclosed quote", lines[5]),
                   ("a.csv", 9): ("short", ","), ("a.csv", 11): ("long", lines[10]), ("b.csv", 3): ("short", "x")}
    assert {r[ID_COL]: (r.Age, r.Education) for r in apps.collect()} == {
        "1": (30, "PhD"), "5": (30, 'PhD, "hon."'), "x": (None, "PhD"), "7": (30, "PhD"), "8": (30, "PhD")}
    for r in counts.collect():
        assert r.n_lines == r.n_header + r.n_blank + r.n_records + r.n_malformed
    assert {r.file.rsplit("/", 1)[1]: (r.n_lines, r.n_header, r.n_blank, r.n_malformed) for r in counts.collect()} == {"a.csv": (12, 1, 2, 5), "b.csv": (3, 1, 0, 1)}


@pytest.mark.parametrize("parts", [1, 3])
def test_line_numbers_over_blocks(spark, tmp_path, parts):
    """Files are cut into many blocks; the numbers are those of the whole file."""
    r = random.Random(parts)
    (tmp_path / "in").mkdir()
    want = {}
    for f in range(parts):
        lines = [f"{f}-{i}-{'x' * r.randint(0, 300)}" for i in range(400 + 50 * f)]
        (tmp_path / "in" / f"{f}.txt").write_text("\n".join(lines) + "\n")
        want |= {line: i for i, line in enumerate(lines, 1)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        rows = numbered_lines(spark, str(tmp_path / "in"))
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 10
        assert {r.raw: r.line for r in rows.collect()} == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_equal_rows_without_an_id_have_keys_of_their_own(spark, tmp_path):
    names = [n for n in NAMES if n != "LoanID"]
    rows = [record(0).split(",", 1)[1]] * 3 + [record(0, Age="31").split(",", 1)[1]]
    (tmp_path / "a.csv").write_text("\n".join([",".join(names), *rows]))
    apps, _, _ = read_checked(spark, str(tmp_path / "a.csv"))
    keys = [r[ID_COL] for r in apps.collect()]
    assert len(set(keys)) == 4 and all(k.startswith("row-") for k in keys)
    plain = {r[ID_COL] for r in read_applications(spark, str(tmp_path / "a.csv")).where("Age = 31").collect()}
    assert plain <= set(keys)               # a row of its own keeps the key that its fields give


def test_without_a_header_and_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n3\n")
    found = read_lines(spark, str(tmp_path / "a.csv"), ["a", "b"])
    assert [(r.a, r.b, r["_line"]) for r in found.records.collect()] == [("1", "2", 1)]
    assert [(r.line, r.reason, r.n_fields) for r in found.malformed.collect()] == [(2, "short", 1)]
    (tmp_path / "e.csv").write_text("")
    empty = read_lines(spark, str(tmp_path / "e.csv"), ["a", "b"])
    assert empty.records.count() == empty.malformed.count() == empty.counts.count() == 0
