import pytest
from pyspark.sql import functions as F

from lendspark.operators import sampling
from lendspark.operators.smote import smote_oversample
from lendspark.sources.applications import APPLICATION_SCHEMA, load_applications, read_applications

SF = "/root/testdata/sf0.001"
COLUMNS = [f.name for f in APPLICATION_SCHEMA.fields if f.name != "DTIRatio"]


@pytest.fixture(scope="module")
def apps(spark):
    return load_applications(spark, SF).select(*COLUMNS).cache()


def write(df, path):
    df.write.option("header", "true").csv(str(path))
    return str(path)


def same(got, want):
    cols = [c for c in COLUMNS if c != "LoanID"]
    return got.select(*cols).exceptAll(want.select(*cols)).isEmpty() and got.count() == want.count()


def test_columns_in_any_order(spark, apps, tmp_path):
    got = read_applications(spark, write(apps.select(*reversed(COLUMNS), F.lit("x").alias("other")), tmp_path / "a"))
    assert got.columns == APPLICATION_SCHEMA.names and same(got, apps)
    assert {r[0] for r in got.select("LoanID").collect()} == {str(r[0]) for r in apps.select("LoanID").collect()}


def test_without_an_id_no_row_is_lost(spark, apps, tmp_path):
    got = read_applications(spark, write(apps.drop("LoanID"), tmp_path / "a"))
    assert same(got, apps) and got.filter("LoanID IS NULL").isEmpty()
    flagged = sampling.stratified_split(got)
    n = {r["is_test"]: r["count"] for r in flagged.groupBy("is_test").count().collect()}
    assert sum(n.values()) == apps.count() and 0.1 < n[True] / apps.count() < 0.3


def test_string_ids_go_through_the_splits_and_oversampling(spark, apps, tmp_path):
    keyed = apps.withColumn("LoanID", F.when(F.col("LoanID") % 50 != 0, F.concat(F.lit("L-"), F.col("LoanID"))))
    got = read_applications(spark, write(keyed, tmp_path / "a"))
    assert same(got, apps) and got.filter("LoanID IS NULL").isEmpty()
    exact = sampling.stratified_split_exact(got)
    assert exact.count() == apps.count() and exact.filter("is_test").count() == -(-apps.count() // 5)
    train = got.select("LoanID", "Default", F.array(F.col("Age").cast("double"), F.col("Income")).alias("x"))
    out = smote_oversample(train, "LoanID", "x", "Default")
    assert {r["count"] for r in out.groupBy("label").count().collect()} == {max(
        r["count"] for r in train.groupBy("Default").count().collect())}


def test_missing_columns_and_bad_fields(spark, apps, tmp_path):
    with pytest.raises(ValueError, match="Income, LoanTerm"):
        read_applications(spark, write(apps.drop("Income", "LoanTerm"), tmp_path / "a"))
    bad = apps.withColumn("Age", F.when(F.col("LoanID") % 2 == 0, F.lit("forty")).otherwise(F.col("Age").cast("string")))
    got = read_applications(spark, write(bad, tmp_path / "b"), key_type="long")
    assert got.filter("Age IS NULL").count() == apps.filter("LoanID % 2 = 0").count()


def test_sample_of_an_exact_size(spark, apps):
    got = sampling.stratified_sample(apps, cap=333)
    share = {r["Default"]: r["count"] for r in got.groupBy("Default").count().collect()}
    assert sum(share.values()) == 333
    whole = {r["Default"]: r["count"] for r in apps.groupBy("Default").count().collect()}
    assert share == sampling.share_rows(whole, 333)
    assert sampling.share_rows({0: 8 * 10**11, 1: 10**11}, 80_000) == {0: 71_111, 1: 8_889}


def test_a_cluster_must_name_its_checkpoint_folder(spark, monkeypatch):
    from lendspark import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
