import os
import tempfile

from pyspark.sql import functions as F

from lendspark.functions.features import engineer_features
from lendspark.operators import encode
from lendspark.operators.sampling import group_sample, stratified_split


def test_split_is_deterministic_and_stratified(tiny_apps):
    a = stratified_split(tiny_apps).select("LoanID", "is_test").orderBy("LoanID").collect()
    b = stratified_split(tiny_apps).select("LoanID", "is_test").orderBy("LoanID").collect()
    assert a == b
    share = sum(r["is_test"] for r in a) / len(a)
    assert 0.15 < share < 0.25
    by_class = stratified_split(tiny_apps).groupBy("Default").agg(F.avg(F.col("is_test").cast("double"))).collect()
    assert all(0.1 < r[1] < 0.3 for r in by_class)


def test_group_sample_bounded(tiny_apps):
    df = tiny_apps.withColumn("grp", F.when(F.col("LoanID") % 3 == 0, "a").otherwise("b"))
    out = group_sample(df, "grp", ["a", "b"], k=100)
    counts = {r["grp"]: r["count"] for r in out.groupBy("grp").count().collect()}
    assert counts == {"a": 100, "b": 100}
    small = group_sample(df, "grp", ["a"], k=10 ** 6)
    assert small.count() == df.filter("grp = 'a'").count()


def test_onehot_drop_first_and_unseen(spark, tiny_apps):
    eng = engineer_features(tiny_apps)
    spec = encode.learn_spec(eng)
    assert len(spec.names) == 25
    assert "Education_Bachelor's" not in spec.names and "Education_High School" in spec.names
    new = spark.createDataFrame([(1, "Doctorate", None)], "LoanID long, Education string, HasCoSigner string")
    row = encode.onehot(new, spec).first()
    assert all(row[n] == 0 for n in spec.dummy_names)      # unseen / NULL / absent -> baseline
    assert row["Income"] == 0.0                            # absent numeric -> 0


def test_scaler_population_std_and_roundtrip(spark, tiny_apps):
    eng = engineer_features(tiny_apps)
    spec = encode.learn_spec(eng)
    enc = encode.onehot(eng, spec).withColumn("const", F.lit(1.0))
    spec2 = encode.FeatureSpec(spec.numeric + ("const",), spec.categories)
    fitted = encode.fit_scaler(enc, spec2)
    i = fitted.names.index("const")
    assert fitted.stds[i] == 1.0 and fitted.means[i] == 1.0
    pdf = enc.select("Income").toPandas()
    j = fitted.names.index("Income")
    assert abs(fitted.stds[j] - pdf["Income"].std(ddof=0)) < 1e-6
    path = os.path.join(tempfile.mkdtemp(), "spec")
    encode.save_spec(spark, fitted, path, None)
    loaded, t = encode.load_spec(spark, path)
    assert loaded == fitted and t == 0.5                   # missing threshold falls back to 0.50


def test_exact_split_hits_class_quotas(tiny_apps):
    from lendspark.operators.sampling import class_quotas, stratified_split_exact
    counts = {r["Default"]: r["count"] for r in tiny_apps.groupBy("Default").count().collect()}
    quota = class_quotas(counts, 0.2)
    out = stratified_split_exact(tiny_apps, "LoanID", "Default")
    got = {r["Default"]: r["n"] for r in out.filter("is_test").groupBy("Default").agg(F.count("*").alias("n")).collect()}
    assert got == quota and sum(quota.values()) == -(-sum(counts.values()) * 2 // 10)
    again = stratified_split_exact(tiny_apps, "LoanID", "Default").filter("is_test").select("LoanID")
    assert sorted(r[0] for r in again.collect()) == sorted(r[0] for r in out.filter("is_test").select("LoanID").collect())
    assert out.count() == tiny_apps.count()
