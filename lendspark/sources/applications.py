"""Application tables: typed schema, file readers (S1, S2) and the derivation
of applications from the driver's ``orders`` and ``customer`` tables.

The derivation is pure integer arithmetic on the two keys, so every engine
computes identical values.  The one product that could leave 64 bits for
large keys (``k * 2654435761``) is reduced modulo the divisor first
(``(k*a) % m == ((k % m) * (a % m)) % m`` for non-negative keys); the other
factors are below 2^16, safe for keys up to about 2e14.  Keeping the
expressions short matters: they are inlined wherever validation and rules
read a column, and the generated code must stay small enough to be compiled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CATEGORICAL_COLUMNS, ID_COL, TARGET_COL
from ..session import read_table, tune_session
from . import csv_lines

APPLICATION_SCHEMA = T.StructType([
    T.StructField("LoanID", T.LongType()),
    T.StructField("Age", T.IntegerType()),
    T.StructField("Income", T.DoubleType()),
    T.StructField("LoanAmount", T.DoubleType()),
    T.StructField("CreditScore", T.IntegerType()),
    T.StructField("MonthsEmployed", T.IntegerType()),
    T.StructField("NumCreditLines", T.IntegerType()),
    T.StructField("InterestRate", T.DoubleType()),
    T.StructField("LoanTerm", T.IntegerType()),
    T.StructField("DTIRatio", T.DoubleType()),
    *[T.StructField(c, T.StringType()) for c in CATEGORICAL_COLUMNS],
    T.StructField("Default", T.IntegerType()),
])

# --- Fixed values: category words picked by key residue --------------------------
EDUCATION_BY_CUST = ["High School", "Bachelor's", "Master's", "PhD"]
EMPLOYMENT_BY_ORDER = ["Full-time", "Part-time", "Self-employed", "Unemployed"]
MARITAL_BY_CUST = ["Divorced", "Married", "Single"]
PURPOSE_BY_PRIORITY = [("1-URGENT", "Auto"), ("2-HIGH", "Business"), ("3-MEDIUM", "Education"),
                       ("4-NOT SPECIFIED", "Home")]
PURPOSE_OTHER = "Other"
# furniture is a purpose outside the known domain
RAW_PURPOSE_BY_SEGMENT = [("AUTOMOBILE", "Auto"), ("MACHINERY", "Business"), ("HOUSEHOLD", "Education"), ("FURNITURE", "Furniture")]


def _mulmod(x: Column, factor: int, mod: int) -> Column:
    """(x * factor) % mod; pre-reduced only when the factor is large enough to overflow."""
    if factor < (1 << 16):
        return (x * F.lit(factor)) % F.lit(mod)
    return ((x % F.lit(mod)) * F.lit(factor % mod)) % F.lit(mod)


def _pick(index: Column, words: list[str]) -> Column:
    out = F.lit(words[-1])
    for i in range(len(words) - 2, -1, -1):
        out = F.when(index == i, F.lit(words[i])).otherwise(out)
    return out


def _yes_no(cond: Column) -> Column:
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))


def score_hash(k: Column) -> Column:
    """Residue used by the fixture's stand-in model score and label."""
    return _mulmod(k, 2654435761, 10007)


def applications_from_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """One application per order whose customer exists.

    Only ``c_custkey`` is needed from ``customer`` (all values derive from the
    keys), so this is a left-semi join: no customer columns are carried, no row
    can be duplicated, and Spark/AQE broadcasts the key set when it is small or
    shuffles both sides on the customer key when it is not.
    """
    o = orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    keys = customer.select(F.col("c_custkey"))
    o = o.join(keys, o["o_custkey"] == keys["c_custkey"], "left_semi")
    k = F.col("o_orderkey")
    c = F.col("o_custkey")
    h = score_hash(k)
    purpose = F.lit(PURPOSE_OTHER)
    for prio, word in reversed(PURPOSE_BY_PRIORITY):
        purpose = F.when(F.col("o_orderpriority") == prio, F.lit(word)).otherwise(purpose)
    income = F.when(k % 97 == 0, F.lit(0)).otherwise(F.lit(15000) + (c * 7919 + k * 13) % 135000)
    default = F.when((k * 40503 + c * 7001) % 40009 < h, 1).otherwise(0)
    return o.select(
        k.alias("LoanID"),
        (F.lit(18) + (c * 7 + k) % 52).cast("int").alias("Age"),
        income.cast("double").alias("Income"),
        (F.lit(5000) + (k * 6151) % 245000).cast("double").alias("LoanAmount"),
        (F.lit(300) + (k * 131 + c * 17) % 550).cast("int").alias("CreditScore"),
        ((k * 37) % 120).cast("int").alias("MonthsEmployed"),
        (F.lit(1) + c % 4).cast("int").alias("NumCreditLines"),
        ((F.lit(200) + (k * 53) % 2300).cast("double") / F.lit(100).cast("double")).alias("InterestRate"),
        (F.lit(12) * (F.lit(1) + k % 5)).cast("int").alias("LoanTerm"),
        _pick(c % 4, EDUCATION_BY_CUST).alias("Education"),
        _pick(k % 4, EMPLOYMENT_BY_ORDER).alias("EmploymentType"),
        _pick(c % 3, MARITAL_BY_CUST).alias("MaritalStatus"),
        _yes_no(c % 2 == 0).alias("HasMortgage"),
        _yes_no(k % 7 < 3).alias("HasDependents"),
        purpose.alias("LoanPurpose"),
        _yes_no(k % 11 < 5).alias("HasCoSigner"),
        (h.cast("double") / F.lit(10007).cast("double")).alias("model_probability"),
        default.cast("int").alias("Default"),
        F.col("o_orderdate").alias("application_ts"),
    )


def raw_applications_from_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Applications as a careless source sends them: amounts from order totals and account
    balances (negative ones too), purposes from market segments, and by key residue
    missing, unparsable and out-of-range fields and words no model has seen."""
    o = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    k = F.col("o_orderkey")

    def text(offset: int, good: Column, low: str) -> Column:
        """An integer field as text: residue 0 missing, 1 no number, 2 a fraction, 3 out of range."""
        r = (k + offset) % 43
        return (F.when(r == 0, F.lit(None).cast("string")).when(r == 1, "n/a").when(r == 2, "20.5").when(r == 3, low)
                .otherwise(good.cast("string")))

    def amount(offset: int, good: Column, low: Column) -> Column:
        r = (k + offset) % 47
        return F.when(r == 0, F.lit(None).cast("double")).when(r == 1, F.lit(float("nan"))).when(r == 2, low).otherwise(good)

    def word(offset: int, good: Column) -> Column:
        r = (k + offset) % 53
        return F.when(r == 0, F.lit(None).cast("string")).when(r == 1, "Unseen").otherwise(good)

    purpose = F.lit("Home")
    for segment, name in RAW_PURPOSE_BY_SEGMENT:
        purpose = F.when(F.col("c_mktsegment") == segment, name).otherwise(purpose)
    total, balance = F.col("o_totalprice"), F.col("c_acctbal")
    return o.select(
        k.alias("LoanID"),
        text(0, F.lit(18) + k % 50, "17").alias("Age"),
        amount(0, balance * F.lit(12.0), F.lit(0.0)).alias("Income"),
        amount(5, total, -total).alias("LoanAmount"),
        text(5, F.lit(300) + k % 550, "299").alias("CreditScore"),
        text(10, k % 120, "-1").alias("MonthsEmployed"),
        text(15, k % 5, "-2").alias("NumCreditLines"),
        amount(10, (k % 25).cast("double"), F.lit(-1.0)).alias("InterestRate"),
        text(20, F.lit(12) * (F.lit(1) + k % 5), "0").alias("LoanTerm"),
        F.when(k % 59 == 0, "high").when(k % 59 == 1, F.lit(None).cast("string")).otherwise("0.4").alias("DTIRatio"),
        word(0, _pick(k % 4, EDUCATION_BY_CUST)).alias("Education"),
        word(5, _pick(k % 4, EMPLOYMENT_BY_ORDER)).alias("EmploymentType"),
        word(10, _pick(k % 3, MARITAL_BY_CUST)).alias("MaritalStatus"),
        word(15, _yes_no(k % 2 == 0)).alias("HasMortgage"),
        word(20, _yes_no(k % 3 == 0)).alias("HasDependents"),
        word(25, purpose).alias("LoanPurpose"),
        word(30, _yes_no(k % 5 == 0)).alias("HasCoSigner"),
    )


def load_raw_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune_session(spark)
    return raw_applications_from_orders(
        read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
        read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"))


def load_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune_session(spark)
    return applications_from_orders(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"))


REQUIRED_COLUMNS = [f.name for f in APPLICATION_SCHEMA.fields if f.name not in (ID_COL, "DTIRatio", TARGET_COL)]


def read_applications(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None,
                      header: bool = True, key_type: str = "string") -> DataFrame:
    """Read an application file with typed columns (never inferred).

    Columns are found by name, in any order; further columns are ignored, a
    missing required one is an error, and optional ones (id, ratio, target) that
    are missing become NULL.  Fields that do not parse become NULL and are caught
    later by validation.  The id may be of any type (``key_type``) or absent; a row
    without one gets a hash of its fields, so that no row is lost in the splits.  It is
    a row key and never a feature.  Files without a header are read by position.
    """
    schema = schema or APPLICATION_SCHEMA
    if fmt == "csv" and not header:
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
        raw = spark.read.schema(text).option("mode", "PERMISSIVE").csv(path)
    elif fmt == "csv":
        # a file whose header differs from the first one's is refused
        raw = spark.read.option("header", "true").option("enforceSchema", "false").option("mode", "PERMISSIVE").csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    return typed_applications(raw, schema, key_type, path)


def typed_applications(raw: DataFrame, schema: T.StructType | None = None, key_type: str = "string", path: str = "") -> DataFrame:
    """Application columns, found by name and cast; see ``read_applications``.

    Rows without an id that hold the same fields have one key, unless the rows carry their place (``_file`` and
    ``_line``, as those of ``read_checked`` do): then rows that repeat get the place added to it.
    """
    schema = schema or APPLICATION_SCHEMA
    columns = [c for c in raw.columns if c not in ("_file", "_line")]
    missing = [c for c in REQUIRED_COLUMNS if c in schema.names and c not in columns]
    if missing:
        raise ValueError(f"missing columns in {path}: {', '.join(missing)}")
    typed = [(F.col(f.name).try_cast(f.dataType) if f.name in columns else F.lit(None).cast(f.dataType)).alias(f.name)
             for f in schema.fields if f.name != ID_COL]
    if ID_COL not in schema.names:
        return raw.select(*typed)
    fields = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    given = F.col(ID_COL).try_cast(key_type) if ID_COL in columns else F.lit(None).cast(key_type)
    if "_line" in raw.columns:
        raw = raw.withColumn("_own", F.when(given.isNull(), fields))
        # equal rows are counted in each task before the shuffle; the join is one whose large partitions Spark splits
        again = raw.where(F.col("_own").isNotNull()).groupBy("_own").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_own", F.lit(True).alias("_again"))
        raw = raw.join(again, "_own", "left")
        fields = F.when(F.col("_again"), F.xxhash64("_own", "_file", "_line")).otherwise(fields)
    own = F.concat(F.lit("row-"), F.hex(fields)) if key_type == "string" else fields
    return raw.select(F.coalesce(given, own.cast(key_type)).alias(ID_COL), *typed)


def read_checked(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True,
                 key_type: str = "string") -> tuple[DataFrame, DataFrame, DataFrame]:
    """S1 with a quarantine: (applications, malformed records with file, line and reason, counts per file).

    The applications are those of ``read_applications`` without the lines that are no records.
    """
    schema = schema or APPLICATION_SCHEMA
    found = csv_lines.read_lines(spark, path, None if header else schema.names)
    return typed_applications(found.records, schema, key_type, path), found.malformed, found.counts


def require_target(df: DataFrame, target: str = TARGET_COL) -> DataFrame:
    """Fail fast when the label is missing; otherwise cast it to int."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' was not found")
    return df.withColumn(target, F.col(target).cast("int"))

