"""DuckDB oracle SQL for the queries in ``catalog.SQL_QUERIES``.

Written independently of the Spark code, in the most direct form: the
threshold sweep is a brute-force grid x rows join and order statistics use
``row_number``, so they check the distributed algorithms rather than
repeat them.  Literals that meet doubles are cast to DOUBLE (DuckDB reads
``0.35`` as DECIMAL).
"""

from __future__ import annotations

APPS = """
apps AS (
  SELECT k AS "LoanID",
    CAST(18 + (c*7 + k) % 52 AS INTEGER) AS "Age",
    CAST(CASE WHEN k % 97 = 0 THEN 0 ELSE 15000 + (c*7919 + k*13) % 135000 END AS DOUBLE) AS "Income",
    CAST(5000 + (k*6151) % 245000 AS DOUBLE) AS "LoanAmount",
    CAST(300 + (k*131 + c*17) % 550 AS INTEGER) AS "CreditScore",
    CAST((k*37) % 120 AS INTEGER) AS "MonthsEmployed",
    CAST(1 + c % 4 AS INTEGER) AS "NumCreditLines",
    CAST(200 + (k*53) % 2300 AS DOUBLE) / CAST(100 AS DOUBLE) AS "InterestRate",
    CAST(12*(1 + k % 5) AS INTEGER) AS "LoanTerm",
    CASE c % 4 WHEN 0 THEN 'High School' WHEN 1 THEN 'Bachelor''s' WHEN 2 THEN 'Master''s' ELSE 'PhD' END
      AS "Education",
    CASE k % 4 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part-time' WHEN 2 THEN 'Self-employed' ELSE 'Unemployed' END
      AS "EmploymentType",
    CASE c % 3 WHEN 0 THEN 'Divorced' WHEN 1 THEN 'Married' ELSE 'Single' END AS "MaritalStatus",
    CASE WHEN c % 2 = 0 THEN 'Yes' ELSE 'No' END AS "HasMortgage",
    CASE WHEN k % 7 < 3 THEN 'Yes' ELSE 'No' END AS "HasDependents",
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Auto' WHEN '2-HIGH' THEN 'Business' WHEN '3-MEDIUM' THEN 'Education'
      WHEN '4-NOT SPECIFIED' THEN 'Home' ELSE 'Other' END AS "LoanPurpose",
    CASE WHEN k % 11 < 5 THEN 'Yes' ELSE 'No' END AS "HasCoSigner",
    CAST((k*2654435761) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS model_probability,
    CAST(CASE WHEN (k*40503 + c*7001) % 40009 < (k*2654435761) % 10007 THEN 1 ELSE 0 END AS INTEGER) AS "Default",
    o_orderdate AS application_ts
  FROM (SELECT o.o_orderkey AS k, o.o_custkey AS c, o.o_orderpriority, o.o_orderdate
        FROM orders o JOIN customer cu ON o.o_custkey = cu.c_custkey) src
)"""

ENG = """
eng AS (
  SELECT *,
    CASE WHEN "Income" = 0 THEN CAST(0 AS DOUBLE) ELSE "LoanAmount" / "Income" END AS "DTIRatio",
    CAST("Age" AS DOUBLE) * "Income" AS "Age_Income_Interaction"
  FROM apps
)"""

VALID = """
valid AS (
  SELECT * FROM eng
  WHERE "Age" >= 18 AND "Income" > 0 AND "LoanAmount" >= 0 AND "CreditScore" IS NOT NULL
    AND "MonthsEmployed" >= 0 AND "NumCreditLines" >= 0 AND "InterestRate" >= 0 AND "LoanTerm" > 0
    AND "Education" IS NOT NULL AND "EmploymentType" IS NOT NULL AND "MaritalStatus" IS NOT NULL
    AND "HasMortgage" IS NOT NULL AND "HasDependents" IS NOT NULL AND "LoanPurpose" IS NOT NULL
    AND "HasCoSigner" IS NOT NULL
)"""


def _step(i: int, flag: str, mult: str) -> str:
    return (f"CASE WHEN {flag} THEN greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), p{i - 1} * "
            f"CAST({mult} AS DOUBLE))) ELSE p{i - 1} END AS p{i}")


RULED = """
ruled AS (
  SELECT *,
    "CreditScore" >= 750 AS f1,
    "DTIRatio" <= CAST(0.35 AS DOUBLE) AS f2,
    "MonthsEmployed" >= 36 AND "EmploymentType" = 'Full-time' AS f3,
    lower("HasCoSigner") = 'yes' AS f4,
    "DTIRatio" >= CAST(0.50 AS DOUBLE) AS f5,
    "CreditScore" < 600 AS f6,
    "EmploymentType" = 'Unemployed' OR "MonthsEmployed" < 6 AS f7,
    model_probability AS p0,
    """ + ",\n    ".join(_step(i, f"f{i}", m) for i, m in
                         enumerate(["0.80", "0.90", "0.90", "0.90", "1.20", "1.15", "1.15"], start=1)) + """
  FROM valid
)"""

# --- Fixed values: rule ids, multipliers and directions, stated apart from the library ---
RULE_IDS = ["strong_credit_score", "low_dti", "stable_full_time_employment", "cosigner_present", "high_dti",
            "weak_credit_score", "unstable_employment"]
RULE_MULTS = ["0.80", "0.90", "0.90", "0.90", "1.20", "1.15", "1.15"]
RULE_DIRS = ["reduce"] * 4 + ["increase"] * 3


def curve_cte(name: str, source: str, lo: int, hi: int, label: str = '"Default"',
              prob: str = "model_probability") -> str:
    """Brute-force sweep: every grid threshold against every row."""
    t = "CAST(g.step AS DOUBLE) / CAST(1000 AS DOUBLE)"
    return f"""
{name} AS (
  SELECT step, threshold, tp, fp, fn, tn,
    CASE WHEN tp + fn = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall,
    CASE WHEN tp + fp = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision
  FROM (
    SELECT g.step AS step, {t} AS threshold,
      CAST(SUM(CASE WHEN s.{label} = 1 AND s.{prob} >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS tp,
      CAST(SUM(CASE WHEN s.{label} = 0 AND s.{prob} >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS fp,
      CAST(SUM(CASE WHEN s.{label} = 1 AND NOT (s.{prob} >= {t}) THEN 1 ELSE 0 END) AS BIGINT) AS fn,
      CAST(SUM(CASE WHEN s.{label} = 0 AND NOT (s.{prob} >= {t}) THEN 1 ELSE 0 END) AS BIGINT) AS tn
    FROM (SELECT range AS step FROM range({lo}, {hi + 1})) g CROSS JOIN {source} s
    GROUP BY g.step
  ) x
)"""


def pick_cte(name: str, curve: str) -> str:
    return f"""
{name} AS (
  SELECT * FROM {curve}
  ORDER BY abs(recall - CAST(0.69 AS DOUBLE)), precision DESC, step LIMIT 1
)"""


SCORED = """
scored AS (
  SELECT r.*, t.threshold AS t,
    CASE WHEN r.model_probability >= t.threshold THEN 1 ELSE 0 END AS model_class,
    CASE WHEN r.p7 >= t.threshold THEN 1 ELSE 0 END AS final_class
  FROM ruled r JOIN thr_all t ON TRUE
)"""

BASE_SCORED = ("WITH " + ",".join([APPS, ENG, VALID, RULED, curve_cte("curve_all", "apps", 100, 900),
                                   pick_cte("thr_all", "curve_all"), SCORED]))

SPLIT_EXPR = ("(('0x' || substr(md5(CAST(\"LoanID\" AS VARCHAR) || '#42'), 1, 8))::BIGINT % 10000 < 2000)")

DUMMIES = [
    ("Education", "High School"), ("Education", "Master's"), ("Education", "PhD"),
    ("EmploymentType", "Part-time"), ("EmploymentType", "Self-employed"), ("EmploymentType", "Unemployed"),
    ("MaritalStatus", "Married"), ("MaritalStatus", "Single"),
    ("HasMortgage", "Yes"), ("HasDependents", "Yes"),
    ("LoanPurpose", "Business"), ("LoanPurpose", "Education"), ("LoanPurpose", "Home"), ("LoanPurpose", "Other"),
    ("HasCoSigner", "Yes"),
]
NUMERIC = ["Age", "Income", "LoanAmount", "CreditScore", "MonthsEmployed", "NumCreditLines", "InterestRate",
           "LoanTerm", "DTIRatio", "Age_Income_Interaction"]


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FEATURES = [n for n in NUMERIC] + [f"{c}_{v}" for c, v in DUMMIES]
ENC_COLS = ",\n    ".join([f"CAST({_q(n)} AS DOUBLE) AS {_q(n)}" for n in NUMERIC] +
                          [f"CAST(CASE WHEN {_q(c)} = {_lit(v)} THEN 1 ELSE 0 END AS INTEGER) AS {_q(c + '_' + v)}"
                           for c, v in DUMMIES])

TEST_BASE = ("WITH " + ",".join([APPS, ENG, f"""
test AS (SELECT * FROM eng WHERE {SPLIT_EXPR})""", curve_cte("curve_test", "test", 100, 900),
                                 pick_cte("thr_test", "curve_test"), f"""
analysis AS (
  SELECT "LoanID",
    {ENC_COLS},
    "Default" AS "TrueLabel",
    CASE WHEN model_probability >= (SELECT threshold FROM thr_test) THEN 1 ELSE 0 END AS "PredictedLabel",
    model_probability AS "DefaultProbability"
  FROM test
),
typed AS (
  SELECT *, CASE
    WHEN "TrueLabel" = 1 AND "PredictedLabel" = 1 THEN 'True_Positive'
    WHEN "TrueLabel" = 0 AND "PredictedLabel" = 0 THEN 'True_Negative'
    WHEN "TrueLabel" = 0 AND "PredictedLabel" = 1 THEN 'False_Positive'
    WHEN "TrueLabel" = 1 AND "PredictedLabel" = 0 THEN 'False_Negative'
    ELSE 'Unknown' END AS "ErrorType"
  FROM analysis
),
cm AS (
  SELECT
    CAST(SUM(CASE WHEN "TrueLabel" = 1 AND "PredictedLabel" = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(SUM(CASE WHEN "TrueLabel" = 0 AND "PredictedLabel" = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(SUM(CASE WHEN "TrueLabel" = 0 AND "PredictedLabel" = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(SUM(CASE WHEN "TrueLabel" = 1 AND "PredictedLabel" = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    avg("DefaultProbability") AS mean_p
  FROM typed
)"""]))


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def _sum_if(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def _monthly_payment() -> str:
    r = '("InterestRate" / CAST(100 AS DOUBLE) / CAST(12 AS DOUBLE))'
    g = f"pow(CAST(1 AS DOUBLE) + {r}, CAST(\"LoanTerm\" AS DOUBLE))"
    return (f"CASE WHEN \"LoanAmount\" IS NULL OR isnan(\"LoanAmount\") OR \"LoanAmount\" = 0 OR \"LoanTerm\" IS NULL "
            f"OR \"LoanTerm\" = 0 THEN NULL "
            f"WHEN {r} IS NULL OR isnan({r}) OR {r} = 0 THEN \"LoanAmount\" / CAST(\"LoanTerm\" AS DOUBLE) "
            f"ELSE \"LoanAmount\" * ({r} * {g}) / ({g} - CAST(1 AS DOUBLE)) END")


def _money(col: str) -> str:
    return f"replace(format('{{:,}}', CAST(trunc({col}) AS BIGINT)), ',', '.') || ' $'"


def _decision_metrics(keys: str, src: str) -> str:
    return f"""
  SELECT {keys},
    CAST(COUNT(*) AS BIGINT) AS n,
    {_sum_if('"Default" = 1')} AS n_default,
    {_sum_if('final_class = 0')} AS n_approvable,
    {_sum_if('"Default" = 1 AND final_class = 1')} AS tp,
    {_sum_if('"Default" = 0 AND final_class = 1')} AS fp,
    {_sum_if('"Default" = 1 AND final_class = 0')} AS fn,
    {_sum_if('"Default" = 0 AND final_class = 0')} AS tn,
    avg(p7) AS mean_p
  FROM {src} GROUP BY ALL"""


def _rates(extra: str = "") -> str:
    return f"""*,
    round({_div('tp', 'tp + fn')}, 6) AS recall,
    round({_div('tp', 'tp + fp')}, 6) AS precision,
    round({_div('n_default', 'n')}, 6) AS default_rate,
    round(mean_p, 6) AS mean_adjusted_probability{extra}"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["applications"] = (f"WITH {APPS} SELECT * REPLACE (CAST(application_ts AS VARCHAR) AS application_ts) "
                         f"FROM apps")
    q["engineer_features"] = (f"WITH {APPS},{ENG} SELECT \"LoanID\", \"Age\", \"Income\", \"LoanAmount\", "
                              f"\"DTIRatio\", \"Age_Income_Interaction\" FROM eng")
    q["loan_profile"] = f"""WITH {APPS}
SELECT "LoanID", round({_monthly_payment()}, 6) AS monthly_payment,
  CASE WHEN "CreditScore" IS NULL OR "CreditScore" <= 0 THEN '-' WHEN "CreditScore" >= 750 THEN 'Prime'
       WHEN "CreditScore" >= 670 THEN 'Güçlü' WHEN "CreditScore" >= 600 THEN 'Orta' ELSE 'Zayıf' END AS credit_band,
  CASE WHEN "Income" > 0 THEN round("LoanAmount" / "Income", 4) END AS loan_income_ratio,
  CASE WHEN "Income" > 0 THEN round("LoanAmount" / "Income" * CAST(100 AS DOUBLE), 1) END AS loan_income_pct
FROM apps"""
    q["application_display"] = f"""WITH {APPS}
SELECT "LoanID", {_money('"Income"')} AS income_text, {_money('"LoanAmount"')} AS loan_text,
  '%' || format('{{:.2f}}', round(model_probability * CAST(100 AS DOUBLE), 2)) AS model_score_text,
  CAST("MonthsEmployed" AS VARCHAR) || ' ay' AS months_text,
  CASE WHEN "HasCoSigner" = 'Yes' THEN 'Var' ELSE 'Yok' END AS cosigner_text
FROM apps"""
    q["validate_applications"] = f"""WITH {APPS}
SELECT "LoanID", viol = '' AS is_valid, viol AS violations FROM (
  SELECT "LoanID", concat_ws(',',
    CASE WHEN "Age" IS NULL THEN 'Age:required' END,
    CASE WHEN "Age" < 18 THEN 'Age:ge_18' END,
    CASE WHEN "Income" IS NULL THEN 'Income:required' END,
    CASE WHEN isnan("Income") THEN 'Income:type' END,
    CASE WHEN "Income" <= 0 THEN 'Income:gt_0' END,
    CASE WHEN "LoanAmount" IS NULL THEN 'LoanAmount:required' END,
    CASE WHEN "LoanAmount" < 0 THEN 'LoanAmount:ge_0' END,
    CASE WHEN "CreditScore" IS NULL THEN 'CreditScore:required' END,
    CASE WHEN "MonthsEmployed" IS NULL THEN 'MonthsEmployed:required' END,
    CASE WHEN "MonthsEmployed" < 0 THEN 'MonthsEmployed:ge_0' END,
    CASE WHEN "NumCreditLines" IS NULL THEN 'NumCreditLines:required' END,
    CASE WHEN "NumCreditLines" < 0 THEN 'NumCreditLines:ge_0' END,
    CASE WHEN "InterestRate" IS NULL THEN 'InterestRate:required' END,
    CASE WHEN "InterestRate" < 0 THEN 'InterestRate:ge_0' END,
    CASE WHEN "LoanTerm" IS NULL THEN 'LoanTerm:required' END,
    CASE WHEN "LoanTerm" <= 0 THEN 'LoanTerm:gt_0' END,
    CASE WHEN "Education" IS NULL THEN 'Education:required' END,
    CASE WHEN "EmploymentType" IS NULL THEN 'EmploymentType:required' END,
    CASE WHEN "MaritalStatus" IS NULL THEN 'MaritalStatus:required' END,
    CASE WHEN "HasMortgage" IS NULL THEN 'HasMortgage:required' END,
    CASE WHEN "HasDependents" IS NULL THEN 'HasDependents:required' END,
    CASE WHEN "LoanPurpose" IS NULL THEN 'LoanPurpose:required' END,
    CASE WHEN "HasCoSigner" IS NULL THEN 'HasCoSigner:required' END) AS viol
  FROM apps) v"""
    rule_ids = "concat_ws(',', " + ", ".join(f"CASE WHEN f{i} THEN '{rid}' END"
                                             for i, rid in enumerate(RULE_IDS, start=1)) + ")"
    n_rules = " + ".join(f"CAST(f{i} AS INTEGER)" for i in range(1, 8))
    q["score_applications"] = f"""{BASE_SCORED}
SELECT "LoanID", model_probability, p7 AS adjusted_probability, model_class, final_class,
  round(model_probability * CAST(100 AS DOUBLE), 2) AS model_score_pct,
  round(p7 * CAST(100 AS DOUBLE), 2) AS adjusted_score_pct,
  round("DTIRatio", 4) AS dti, {rule_ids} AS applied_rules, {n_rules} AS n_rules,
  'default-review-2026-04-19' AS rule_version, round(t, 3) AS threshold,
  CASE WHEN final_class = 0 THEN 'Onaylanabilir Profil' ELSE 'Manuel İnceleme' END AS decision
FROM scored"""
    # the stream scorer writes exactly the batch decision rows
    q["stream_score"] = q["score_applications"]
    audit_rows = " UNION ALL ".join(
        f"SELECT \"LoanID\", {i} AS pos, '{rid}' AS rule_id, CAST({m} AS DOUBLE) AS multiplier, "
        f"round(p{i - 1} * CAST(100 AS DOUBLE), 2) AS before_pct, round(p{i} * CAST(100 AS DOUBLE), 2) AS after_pct "
        f"FROM scored WHERE f{i}"
        for i, (rid, m) in enumerate(zip(RULE_IDS, RULE_MULTS), start=1))
    q["rule_audit"] = f"""{BASE_SCORED}, audit AS ({audit_rows})
SELECT "LoanID", CAST(row_number() OVER (PARTITION BY "LoanID" ORDER BY pos) AS INTEGER) AS step,
  rule_id, multiplier, before_pct, after_pct FROM audit"""
    usage_rows = " UNION ALL ".join(
        f"SELECT {i} AS position, '{rid}' AS rule_id, '{d}' AS direction, CAST({m} AS DOUBLE) AS multiplier, "
        f"{_sum_if(f'f{i}')} AS n_fired, {_sum_if(f'f{i} AND model_class <> final_class')} AS n_decision_changed, "
        f"CAST(COUNT(*) AS BIGINT) AS n_total FROM scored"
        for i, (rid, m, d) in enumerate(zip(RULE_IDS, RULE_MULTS, RULE_DIRS), start=1))
    q["rule_usage"] = f"""{BASE_SCORED}
SELECT CAST(position AS INTEGER) AS position, rule_id, direction, multiplier, n_fired, n_decision_changed,
  round({_div('n_fired', 'n_total')}, 6) AS fire_rate FROM ({usage_rows}) u"""
    q |= _user_rule_oracles()
    own_hash = "('0x' || substr(md5(CAST(\"LoanID\" AS VARCHAR) || '#sample42'), 1, 8))::BIGINT"
    q["stratified_sample_capped"] = f"""WITH {APPS}, train AS (SELECT * FROM apps WHERE NOT {SPLIT_EXPR}),
n AS (SELECT count(*) AS n FROM train),
c AS (SELECT "Default" AS c, count(*) AS k FROM train GROUP BY 1),
f AS (SELECT c, 5000 * k // n AS quota, 5000 * k % n AS rest, 5000 - sum(5000 * k // n) OVER () AS open FROM c, n),
q AS (SELECT c, quota + CASE WHEN row_number() OVER (ORDER BY rest DESC, CAST(c AS VARCHAR)) <= open THEN 1 ELSE 0 END AS quota FROM f),
r AS (SELECT "LoanID", "Default", row_number() OVER (PARTITION BY "Default" ORDER BY {own_hash}, "LoanID") AS i FROM train)
SELECT "LoanID", "Default" FROM r JOIN q ON q.c = r."Default", n WHERE n.n <= 5000 OR i <= quota"""
    q["split_fingerprint"] = f"""WITH {APPS}, s AS (
SELECT "Default", CASE WHEN {SPLIT_EXPR} THEN 'test'
  WHEN ('0x' || substr(md5(CAST("LoanID" AS VARCHAR) || '#calibration42'), 1, 8))::BIGINT % 10000 < 1000 THEN 'calibration'
  ELSE 'train' END AS split, ('0x' || substr(md5("LoanID" || '|' || "Default" || '#print'), 1, 8))::BIGINT AS h FROM apps)
SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum("Default") AS BIGINT) AS n_default, CAST(sum(h) AS BIGINT) AS hash_sum, bit_xor(h) AS hash_xor
FROM s GROUP BY split"""
    q["target_guard"] = f"""WITH {APPS} SELECT "EmploymentType", "Default", count(*) AS n FROM apps GROUP BY 1, 2"""
    q["metric_sinks"] = f"""WITH {APPS} SELECT "MaritalStatus", "Default", count(*) AS n, sink FROM apps, (VALUES ('json'), ('csv')) AS v(sink)
GROUP BY 1, 2, sink"""
    q["application_profile"] = f"""WITH {APPS} SELECT "LoanID", {_money('"Income"')} AS field_1, {_money('"LoanAmount"')} AS field_2,
  CAST("CreditScore" AS VARCHAR) AS field_3, "EmploymentType" AS field_4, "MonthsEmployed" || ' ay' AS field_5,
  CASE WHEN "HasCoSigner" = 'Yes' THEN 'Var' ELSE 'Yok' END AS field_6 FROM apps"""
    q["csv_records"] = f"""WITH {APPS}, k AS (SELECT "LoanID" % 40 AS k, "EmploymentType" = 'Full-time' AS whole_day FROM apps),
r AS (SELECT CASE k WHEN 0 THEN 'short' WHEN 1 THEN 'long' WHEN 2 THEN 'unclosed quote' WHEN 3 THEN CASE WHEN whole_day THEN 'long' ELSE 'records' END
             WHEN 4 THEN 'blank' ELSE 'records' END AS reason FROM k)
SELECT reason, count(*) AS n, count(*) AS n_places FROM r GROUP BY reason
UNION ALL SELECT 'lines', count(*), count(*) FROM r
UNION ALL SELECT 'applications', count(*), count(*) FROM r WHERE reason = 'records'"""
    # rule effect: re-fold the chain without each rule
    variants = [("all_rules", None)] + [(f"without_{rid}", i) for i, rid in enumerate(RULE_IDS, start=1)]
    var_ctes = []
    for vi, (name, skip) in enumerate(variants):
        steps = ["model_probability AS q0"]
        for i, m in enumerate(RULE_MULTS, start=1):
            if i == skip:
                steps.append(f"q{i - 1} AS q{i}")
            else:
                steps.append(f"CASE WHEN f{i} THEN greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), "
                             f"q{i - 1} * CAST({m} AS DOUBLE))) ELSE q{i - 1} END AS q{i}")
        var_ctes.append(f"SELECT '{name}' AS variant, {vi} AS variant_order, "
                        f"{_sum_if('\"Default\" = 1 AND q7 >= t')} AS tp, {_sum_if('\"Default\" = 0 AND q7 >= t')} AS fp, "
                        f"{_sum_if('\"Default\" = 1 AND NOT (q7 >= t)')} AS fn, "
                        f"{_sum_if('\"Default\" = 0 AND NOT (q7 >= t)')} AS tn "
                        f"FROM (SELECT \"Default\", t, f1, f2, f3, f4, f5, f6, f7, {', '.join(steps)} FROM scored) z")
    q["rule_effect"] = f"""{BASE_SCORED}, v AS ({' UNION ALL '.join(var_ctes)}),
r AS (SELECT *, {_div('tp', 'tp + fn')} AS recall, {_div('tp', 'tp + fp')} AS precision FROM v),
b AS (SELECT fp AS base_fp, recall AS base_recall FROM r WHERE variant_order = 0)
SELECT variant, CAST(variant_order AS INTEGER) AS variant_order, tp, fp, fn, tn, round(recall, 6) AS recall,
  round(precision, 6) AS precision, fp - base_fp AS fp_added_without_rule,
  round(base_recall - recall, 6) AS recall_lost_without_rule
FROM r JOIN b ON TRUE"""
    q["decision_summary"] = f"""{BASE_SCORED}
SELECT model_class, final_class, CAST(COUNT(*) AS BIGINT) AS n FROM scored GROUP BY model_class, final_class"""
    curve_sel = "step, threshold, tp, fp, fn, tn, round(recall, 6) AS recall, round(precision, 6) AS precision"
    q["threshold_curve"] = f"WITH {APPS},{curve_cte('curve', 'apps', 100, 900)} SELECT {curve_sel} FROM curve"
    q["pick_threshold"] = (f"WITH {APPS},{curve_cte('curve', 'apps', 100, 900)},{pick_cte('pick', 'curve')} "
                           f"SELECT {curve_sel} FROM pick")
    q["cost_threshold"] = f"""WITH {APPS},{curve_cte('curve', 'apps', 100, 900)}
SELECT step, threshold, tp, fp, fn, tn, CAST(5 AS DOUBLE) * fn + CAST(1 AS DOUBLE) * fp AS cost,
  round(recall, 6) AS recall, round(precision, 6) AS precision
FROM curve ORDER BY cost, step LIMIT 1"""
    q["pr_curve"] = (f"WITH {APPS},{curve_cte('curve', 'apps', 0, 1000)} "
                     f"SELECT step, threshold, tp, fp, round(recall, 6) AS recall, round(precision, 6) AS precision "
                     f"FROM curve")
    q["binary_metrics"] = f"""{TEST_BASE}
SELECT tp, fp, tn, fn, round({_div('tp + tn', 'tp + fp + tn + fn')}, 6) AS accuracy,
  round({_div('tp', 'tp + fp')}, 6) AS precision, round({_div('tp', 'tp + fn')}, 6) AS recall,
  round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, round(mean_p, 6) AS mean_predicted_default_probability
FROM cm"""
    q["classification_report"] = f"""{TEST_BASE},
w AS (SELECT {_div('tn', 'tn + fn')} AS p0, {_div('tn', 'tn + fp')} AS r0, {_div('2 * tn', '2 * tn + fn + fp')} AS f0,
        CAST(tn + fp AS DOUBLE) AS s0,
        {_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1, {_div('2 * tp', '2 * tp + fp + fn')} AS f1,
        CAST(tp + fn AS DOUBLE) AS s1, {_div('tp + tn', 'tp + fp + tn + fn')} AS acc,
        CAST(tp + fp + tn + fn AS DOUBLE) AS n FROM cm),
rows AS (
  SELECT '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM w
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM w
  UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM w
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM w
  UNION ALL SELECT 'weighted avg', CASE WHEN n = 0 THEN 0 ELSE (p0 * s0 + p1 * s1) / n END,
    CASE WHEN n = 0 THEN 0 ELSE (r0 * s0 + r1 * s1) / n END, CASE WHEN n = 0 THEN 0 ELSE (f0 * s0 + f1 * s1) / n END,
    n FROM w)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
  CAST(support AS BIGINT) AS support FROM rows"""
    q["confusion_matrix"] = f"""{TEST_BASE}
SELECT 0 AS actual, tn AS predicted_0, fp AS predicted_1 FROM cm
UNION ALL SELECT 1, fn, tp FROM cm"""
    q["error_types"] = f"""{TEST_BASE}
SELECT "LoanID", "TrueLabel", "PredictedLabel", "DefaultProbability", "ErrorType" FROM typed"""
    q["error_counts"] = f"""{TEST_BASE}
SELECT "ErrorType", CAST(COUNT(*) AS BIGINT) AS count FROM typed GROUP BY "ErrorType" """
    means = ", ".join(f"round(avg({_q(n)}), 4) AS {_q(n)}" for n in FEATURES + ["TrueLabel", "PredictedLabel",
                                                                               "DefaultProbability"])
    q["error_feature_means"] = f"""{TEST_BASE}
SELECT "ErrorType", {means} FROM typed GROUP BY "ErrorType" """
    gh = "('0x' || substr(md5(CAST(\"LoanID\" AS VARCHAR) || '#group42'), 1, 8))::BIGINT"
    q["group_sample"] = f"""{TEST_BASE}
SELECT "LoanID", "ErrorType" FROM (
  SELECT "LoanID", "ErrorType", row_number() OVER (PARTITION BY "ErrorType" ORDER BY {gh}, "LoanID") AS rn
  FROM typed WHERE "ErrorType" IN ('False_Positive', 'False_Negative')) s WHERE rn <= 500"""
    q["stratified_split"] = f"WITH {APPS} SELECT \"LoanID\", \"Default\", {SPLIT_EXPR} AS is_test FROM apps"
    hh = "('0x' || substr(md5(CAST(\"LoanID\" AS VARCHAR) || '#42'), 1, 8))::BIGINT"
    q["stratified_split_exact"] = f"""WITH {APPS},
c AS (SELECT "Default" AS c, COUNT(*) AS k FROM apps GROUP BY 1),
t AS (SELECT SUM(k) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * CAST(SUM(k) AS DOUBLE)) AS BIGINT) AS nt FROM c),
q0 AS (SELECT c.c, CAST(t.nt * c.k AS DOUBLE) / CAST(t.n AS DOUBLE) AS ex,
              floor(CAST(t.nt * c.k AS DOUBLE) / CAST(t.n AS DOUBLE)) AS fl, t.nt FROM c JOIN t ON TRUE),
q AS (SELECT c, fl + CASE WHEN row_number() OVER (ORDER BY ex - fl DESC, CAST(c AS VARCHAR))
                             <= nt - SUM(fl) OVER () THEN 1 ELSE 0 END AS quota FROM q0),
r AS (SELECT "LoanID", "Default",
        row_number() OVER (PARTITION BY "Default" ORDER BY {hh}, "LoanID") AS rn FROM apps)
SELECT r."LoanID", r."Default", r.rn <= q.quota AS is_test FROM r JOIN q ON r."Default" = q.c"""
    q["read_applications_csv"] = f"""WITH {APPS}
SELECT "LoanID", "Age", "Income", "LoanAmount", "CreditScore", "MonthsEmployed", "NumCreditLines", "InterestRate",
  "LoanTerm", CAST(NULL AS DOUBLE) AS "DTIRatio", "Education", "EmploymentType", "MaritalStatus", "HasMortgage",
  "HasDependents", "LoanPurpose", "HasCoSigner", "Default" FROM apps"""
    def pct(x: str) -> str:
        return "'%' || format('{:.2f}', round(" + x + " * CAST(100 AS DOUBLE), 2))"
    q["decision_memo"] = f"""{BASE_SCORED}
SELECT "LoanID", CASE WHEN final_class = 0 THEN printf(
  'Başvuru onaylanabilir bölgede. Model skoru %s, iş kuralları sonrası skor %s. DTI %s ve %s kural etkisiyle profil düşük risk bandında kaldı.',
  {pct('model_probability')}, {pct('p7')}, format('{{:.4f}}', round(round("DTIRatio", 4), 4)),
  CAST({n_rules} AS VARCHAR))
ELSE printf(
  'Başvuru manuel inceleme bandında. Model skoru %s, iş kuralları sonrası skor %s. DTI %s; gelir yükü, kredi notu ve istihdam sinyalleri kredi uzmanı tarafından gözden geçirilmeli.',
  {pct('model_probability')}, {pct('p7')}, format('{{:.4f}}', round(round("DTIRatio", 4), 4)))
END AS memo FROM scored"""
    q["smote_oversample"] = f"""WITH {APPS},
c AS (SELECT "Default" AS label, CAST(COUNT(*) AS BIGINT) AS n FROM apps WHERE NOT {SPLIT_EXPR} GROUP BY 1),
m AS (SELECT arg_min(label, (n, label)) AS minor, MAX(n) - MIN(n) AS extra FROM c)
SELECT label, false AS is_synthetic, n FROM c
UNION ALL SELECT minor, true, extra FROM m WHERE extra > 0"""
    q["class_balance"] = f"""WITH {APPS}
SELECT CASE WHEN {SPLIT_EXPR} THEN 'test' ELSE 'train' END AS split, "Default", CAST(COUNT(*) AS BIGINT) AS n
FROM apps GROUP BY ALL"""
    sh = "('0x' || substr(md5(CAST(\"LoanID\" AS VARCHAR) || '#sample42'), 1, 8))::BIGINT % 10000"
    q["stratified_sample"] = f"""WITH {APPS}, train AS (SELECT * FROM apps WHERE NOT {SPLIT_EXPR}),
n AS (SELECT COUNT(*) AS n FROM train)
SELECT "LoanID", "Default" FROM train, n
WHERE n.n <= 80000 OR {sh} < CAST(floor(10000 * 80000 / n.n) AS BIGINT)"""
    q["onehot_train"] = f"WITH {APPS},{ENG} SELECT \"LoanID\", {ENC_COLS} FROM eng"
    enc_train = f"""WITH {APPS},{ENG}, enc AS (SELECT "LoanID", {ENC_COLS} FROM eng WHERE NOT {SPLIT_EXPR})"""
    stat_rows = " UNION ALL ".join(
        f"SELECT {i} AS position, {_lit(n)} AS feature, avg({_q(n)}) AS mean, stddev_pop({_q(n)}) AS sd FROM enc"
        for i, n in enumerate(FEATURES, start=1))
    q["scaler_fit"] = f"""{enc_train}, s AS ({stat_rows})
SELECT CAST(position AS INTEGER) AS position, feature, round(mean, 6) AS mean,
  round(CASE WHEN sd < 10 * 2.220446049250313e-16 THEN 1 ELSE sd END, 6) AS std FROM s"""
    stat_cols = ", ".join(f"avg({_q(n)}) AS m{i}, stddev_pop({_q(n)}) AS s{i}" for i, n in enumerate(FEATURES))
    scaled = ", ".join(f"round(({_q(n)} - m{i}) / (CASE WHEN s{i} < 10 * 2.220446049250313e-16 THEN 1 ELSE s{i} END),"
                       f" 6) AS {_q(n)}" for i, n in enumerate(FEATURES))
    q["prepare_inference"] = f"""WITH {APPS},{ENG},
train AS (SELECT "LoanID", {ENC_COLS} FROM eng WHERE NOT {SPLIT_EXPR}),
test AS (SELECT "LoanID", {ENC_COLS} FROM eng WHERE {SPLIT_EXPR}),
st AS (SELECT {stat_cols} FROM train)
SELECT "LoanID", {scaled} FROM test JOIN st ON TRUE"""
    q["rebuild_test"] = f"""{TEST_BASE}
SELECT "LoanID", "TrueLabel" AS "Default", {', '.join(_q(n) for n in FEATURES)} FROM typed"""
    q["latency_summary"] = """
WITH calls AS (SELECT CAST(ts AS DATE) AS day, value AS latency_ms, event_type = 'error' AS is_error FROM events),
ranked AS (SELECT day, latency_ms, row_number() OVER (PARTITION BY day ORDER BY latency_ms) AS rn,
                  COUNT(*) OVER (PARTITION BY day) AS n FROM calls),
p AS (SELECT day, latency_ms AS p95 FROM ranked
      WHERE rn = greatest(1, CAST(floor(CAST(n AS DOUBLE) * CAST(0.95 AS DOUBLE)) AS BIGINT))),
s AS (SELECT day, CAST(COUNT(*) AS BIGINT) AS n_calls, CAST(SUM(CASE WHEN is_error THEN 1 ELSE 0 END) AS BIGINT)
             AS n_errors, avg(latency_ms) AS a, min(latency_ms) AS mi, max(latency_ms) AS ma FROM calls GROUP BY day)
SELECT CAST(s.day AS VARCHAR) AS day, n_calls, n_errors, round(a, 2) AS avg_ms, round(mi, 2) AS min_ms, round(ma, 2) AS max_ms,
  round(p95, 2) AS p95_ms FROM s JOIN p ON s.day = p.day"""
    q["check_rollup"] = f"""WITH {APPS}, v AS (
  SELECT "LoanPurpose", ("Age" >= 18 AND "Income" > 0 AND "LoanAmount" >= 0 AND "MonthsEmployed" >= 0
     AND "NumCreditLines" >= 0 AND "InterestRate" >= 0 AND "LoanTerm" > 0) AS ok FROM apps)
SELECT "LoanPurpose", CAST(COUNT(*) AS BIGINT) AS n_checks, {_sum_if('ok')} AS n_passed,
  {_sum_if('NOT ok')} AS n_failed, bool_and(ok) AS all_passed FROM v GROUP BY "LoanPurpose" """
    drift_feats = ["Income", "LoanAmount", "CreditScore", "InterestRate", "DTIRatio", "model_probability"]
    unpivot = " UNION ALL ".join(
        f"SELECT {_lit(f)} AS feature, CAST({_q(f)} AS DOUBLE) AS x, application_ts >= TIMESTAMP '1998-01-01' "
        f"AS is_current FROM eng" for f in drift_feats)
    q["feature_drift"] = f"""WITH {APPS},{ENG}, long AS ({unpivot}),
base AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS rn,
                COUNT(*) OVER (PARTITION BY feature) AS n FROM long WHERE NOT is_current),
edges AS (SELECT b.feature, b.x AS e FROM base b JOIN range(1, 10) r(i) ON b.rn = (r.i * b.n + 9) // 10),
binned AS (SELECT l.feature, l.is_current,
             (SELECT COUNT(*) FROM edges e WHERE e.feature = l.feature AND e.e < l.x) AS bin FROM long l),
cnt AS (SELECT feature, bin, {_sum_if('NOT is_current')} AS nb, {_sum_if('is_current')} AS nc
        FROM binned GROUP BY feature, bin),
tot AS (SELECT feature, SUM(nb) AS total_b, SUM(nc) AS total_c FROM cnt GROUP BY feature),
grid AS (SELECT t.feature, t.total_b, t.total_c, r.bin FROM tot t JOIN (SELECT range AS bin FROM range(0, 10)) r ON TRUE),
full_ AS (SELECT g.feature, g.total_b, g.total_c, COALESCE(c.nb, 0) AS nb, COALESCE(c.nc, 0) AS nc
          FROM grid g LEFT JOIN cnt c ON g.feature = c.feature AND g.bin = c.bin),
parts AS (SELECT feature, total_b, total_c,
            greatest({_div('nb', 'total_b')}, CAST(0.0001 AS DOUBLE)) AS b,
            greatest({_div('nc', 'total_c')}, CAST(0.0001 AS DOUBLE)) AS c FROM full_),
res AS (SELECT feature, SUM((c - b) * ln(c / b)) AS psi, first(total_b) AS nb, first(total_c) AS nc
        FROM parts GROUP BY feature)
SELECT feature, round(psi, 6) AS psi,
  CASE WHEN psi < CAST(0.10 AS DOUBLE) THEN 'stable' WHEN psi < CAST(0.25 AS DOUBLE) THEN 'moderate'
       ELSE 'significant' END AS level,
  CAST(nb AS BIGINT) AS n_baseline, CAST(nc AS BIGINT) AS n_current FROM res"""
    q["periodic_metrics"] = f"""{BASE_SCORED},
agg AS ({_decision_metrics("CAST(CAST(date_trunc('quarter', application_ts) AS DATE) AS VARCHAR) AS period_start",
                          "scored")})
SELECT period_start, n, n_default, n_approvable, tp, fp, fn, tn, {_rates()[2:]} FROM agg"""
    # N6 on the stream: 90-day tumbling windows counted from 1970-01-01 (Spark's window origin)
    win = "DATE '1970-01-01' + CAST(floor(date_diff('day', DATE '1970-01-01', application_ts) / 90.0) * 90 AS INTEGER)"
    q["periodic_metrics_stream"] = f"""{BASE_SCORED},
agg AS ({_decision_metrics(f"CAST({win} AS VARCHAR) AS window_start, CAST({win} + 90 AS VARCHAR) AS window_end",
                          "scored")})
SELECT window_start, window_end, n, n_default, n_approvable, tp, fp, fn, tn, {_rates()[2:]} FROM agg"""
    attrs = ["Education", "EmploymentType", "MaritalStatus", "LoanPurpose"]
    long = " UNION ALL ".join(f"SELECT {_lit(a)} AS attribute, {_q(a)} AS value, \"Default\", final_class, p7 "
                              f"FROM scored" for a in attrs)
    q["group_error_rates"] = f"""{BASE_SCORED}, long AS ({long}),
agg AS ({_decision_metrics("attribute, value", "long")})
SELECT attribute, value, n, n_default, n_approvable, tp, fp, fn, tn, {_rates()[2:]},
  round({_div('fp', 'fp + tn')}, 6) AS false_positive_rate, round({_div('fn', 'fn + tp')}, 6) AS false_negative_rate,
  round({_div('n_approvable', 'n')}, 6) AS approval_rate FROM agg"""
    # fixed values: the known words of each column
    domains = {
        "Education": ["High School", "Bachelor's", "Master's", "PhD"],
        "EmploymentType": ["Full-time", "Part-time", "Self-employed", "Unemployed"],
        "MaritalStatus": ["Married", "Single", "Divorced"],
        "HasMortgage": ["Yes", "No"], "HasDependents": ["Yes", "No"],
        "LoanPurpose": ["Auto", "Business", "Education", "Home", "Other"], "HasCoSigner": ["Yes", "No"],
    }
    dom_rows = " UNION ALL ".join(
        f"SELECT {_lit(c)} AS column_name, CAST(COUNT(*) AS BIGINT) AS n_rows, {_sum_if(f'{_q(c)} IS NULL')} AS n_null, "
        f"{_sum_if(f'{_q(c)} IS NOT NULL AND {_q(c)} NOT IN (' + ', '.join(_lit(v) for v in vals) + ')')} AS n_unknown "
        f"FROM apps" for c, vals in domains.items())
    q["domain_report"] = f"""WITH {APPS}, d AS ({dom_rows})
SELECT column_name, n_rows, n_null, n_unknown, n_null + n_unknown AS n_encoded_as_baseline FROM d"""
    q["calibration_split"] = f"""WITH {APPS}, s AS (
SELECT "Default", CASE WHEN {SPLIT_EXPR} THEN 'test'
  WHEN ('0x' || substr(md5(CAST("LoanID" AS VARCHAR) || '#calibration42'), 1, 8))::BIGINT % 10000 < 1000 THEN 'calibration'
  ELSE 'train' END AS split FROM apps)
SELECT split, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM("Default") AS BIGINT) AS n_default FROM s GROUP BY split"""
    q["model_checks"] = f"""WITH {APPS}, {ENG}, {VALID}, t AS (
SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM("Default") AS BIGINT) AS d FROM apps WHERE {SPLIT_EXPR}),
v AS (SELECT CAST(COUNT(*) AS BIGINT) AS n FROM valid)
SELECT q AS query, c AS "check", CAST(x AS BIGINT) AS value FROM (
  SELECT q, unnest(['test_rows', 'test_rows_default', 'improbable_rows']) AS c, unnest([t.n, t.d, 0]) AS x
  FROM t, (SELECT unnest(['train_gbt', 'train_logistic', 'train_forest']) AS q) AS m
  UNION ALL SELECT 'train_gbt', 'threshold_steps_off', 0
  UNION ALL SELECT 'train_gbt', 'trees', 220
  UNION ALL SELECT 'train_forest', 'trees', 160
  UNION ALL SELECT 'validation_snapshot', 'confusion_total', t.n FROM t
  UNION ALL SELECT 'validation_snapshot', unnest(['scenarios', 'fields_off', 'comparison_rows', 'comparison_off']), unnest([4, 0, 3, 0])
  UNION ALL SELECT 'contribution_summary', 'margin_off_rows', 0
  UNION ALL SELECT 'top_risk_signals', unnest(['rows', 'off_rows']), unnest([t.n, 0]) FROM t
  UNION ALL SELECT 'contribution_summary', 'attributed_rows', t.n FROM t
  UNION ALL SELECT 'linear_contribution_summary', 'margin_off_rows', 0
  UNION ALL SELECT 'score_with_model', 'scored_rows', v.n FROM v
  UNION ALL SELECT 'smote_oversample', 'off_segment_rows', 0
  UNION ALL SELECT 'smote_oversample', 'uneven_sources', 0
  UNION ALL SELECT 'model_comparison', unnest(['models', 'off_rows']), unnest([3, 0])) AS x"""
    q |= _raw_oracles(domains)
    return q


# --- Fixed values: the user's rule table, stated apart from the library: id, condition, multiplier ---
USER_RULES = [
    ("thin_file", '"NumCreditLines" < 2', "1.30"),
    ("steep_rate", '"InterestRate" >= CAST(18.5 AS DOUBLE) AND "LoanTerm" >= 36', "1.45"),
    ("heavy_loan", '"Income" <> 0 AND "LoanAmount" / "Income" > 4', "1.25"),
    ("young_borrower", '"Age" >= 18 AND "Age" <= 24', "1.10"),
    ("graduate", "\"Education\" = 'Master''s' OR \"Education\" = 'PhD'", "0.85"),
    ("married_owner", "\"MaritalStatus\" = 'Married' AND \"HasMortgage\" = 'Yes'", "0.90"),
    ("dependents", "\"HasDependents\" = 'Yes'", "1.05"),
    ("weak_score", '"CreditScore" < 580', "1.60"),
    ("long_service", '"MonthsEmployed" >= 60', "0.70"),
    ("business_purpose", "\"LoanPurpose\" = 'Business'", "1.15"),
    ("half_of_all", '"DTIRatio" > CAST(0.5 AS DOUBLE)', "0.50"),
    ("cleared", "\"CreditScore\" >= 800 AND \"HasCoSigner\" = 'Yes'", "0.0"),
]
USER_RULES_REFUSED = [("open_bracket", "does not parse"), ("no_such_field", "unknown column"), ("number", "not a condition"),
                      ("of_many", "not a condition on one application"), ("mixed", "types do not fit")]


def _user_rule_oracles() -> dict[str, str]:
    flags = ", ".join(f"coalesce({c}, FALSE) AS f{i}" for i, (_, c, _) in enumerate(USER_RULES, 1))
    steps = ",\n    ".join(_step(i, f"f{i}", m) for i, (_, _, m) in enumerate(USER_RULES, 1))
    n = len(USER_RULES)
    base = "WITH " + ",".join([APPS, ENG, VALID, f"""
flagged AS (SELECT *, {flags}, model_probability AS p0 FROM valid),
ruled AS (SELECT *, {steps} FROM flagged)""", curve_cte("curve_all", "apps", 100, 900), pick_cte("thr_all", "curve_all"), f"""
scored AS (
  SELECT r.*, t.threshold AS t,
    CASE WHEN r.model_probability >= t.threshold THEN 1 ELSE 0 END AS model_class,
    CASE WHEN r.p{n} >= t.threshold THEN 1 ELSE 0 END AS final_class
  FROM ruled r JOIN thr_all t ON TRUE)"""])
    ids = "concat_ws(',', " + ", ".join(f"CASE WHEN f{i} THEN '{r}' END" for i, (r, _, _) in enumerate(USER_RULES, 1)) + ")"
    trail = "concat_ws(',', " + ", ".join(
        f"CASE WHEN f{i} THEN '{r}:' || CAST(CAST(round(p{i} * CAST(100 AS DOUBLE), 2) AS DECIMAL(20, 2)) AS VARCHAR) END"
        for i, (r, _, _) in enumerate(USER_RULES, 1)) + ")"
    fired = " + ".join(f"CAST(f{i} AS INTEGER)" for i in range(1, n + 1))
    usage = " UNION ALL ".join(
        f"SELECT {i} AS position, '{r}' AS rule_id, CAST({m} AS DOUBLE) AS multiplier, "
        f"{_sum_if(f'f{i}')} AS n_fired, {_sum_if(f'f{i} AND model_class <> final_class')} AS n_decision_changed, "
        f"CAST(COUNT(*) AS BIGINT) AS n_total FROM scored" for i, (r, _, m) in enumerate(USER_RULES, 1))
    refused = " UNION ALL ".join(
        f"SELECT CAST(NULL AS INTEGER), '{r}', CAST(NULL AS VARCHAR), CAST(1.1 AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), "
        f"CAST(NULL AS DOUBLE), '{why}'" for r, why in USER_RULES_REFUSED)
    return {"user_rule_scores": f"""{base}
SELECT "LoanID", model_probability, p{n} AS adjusted_probability, model_class, final_class,
  round(model_probability * CAST(100 AS DOUBLE), 2) AS model_score_pct,
  round(p{n} * CAST(100 AS DOUBLE), 2) AS adjusted_score_pct,
  round("DTIRatio", 4) AS dti, {ids} AS applied_rules, {fired} AS n_rules, {trail} AS rule_audit,
  'user-1' AS rule_version, round(t, 3) AS threshold,
  CASE WHEN final_class = 0 THEN 'Onaylanabilir Profil' ELSE 'Manuel İnceleme' END AS decision
FROM scored""", "user_rule_usage": f"""{base}
SELECT CAST(position AS INTEGER) AS position, rule_id, CASE WHEN multiplier < 1 THEN 'reduce' ELSE 'increase' END AS direction, multiplier,
  n_fired, n_decision_changed, round({_div('n_fired', 'n_total')}, 6) AS fire_rate, '' AS rejected FROM ({usage}) u
UNION ALL {refused}"""}


def _raw_apps() -> str:
    def text(name: str, offset: int, good: str, low: str) -> str:
        return (f"CASE (k + {offset}) % 43 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN '20.5' WHEN 3 THEN '{low}' "
                f"ELSE CAST({good} AS VARCHAR) END AS {_q(name)}")

    def amount(name: str, offset: int, good: str, low: str) -> str:
        return (f"CASE (k + {offset}) % 47 WHEN 0 THEN NULL WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST({low} AS DOUBLE) "
                f"ELSE CAST({good} AS DOUBLE) END AS {_q(name)}")

    def word(name: str, offset: int, good: str) -> str:
        return f"CASE (k + {offset}) % 53 WHEN 0 THEN NULL WHEN 1 THEN 'Unseen' ELSE {good} END AS {_q(name)}"

    def yes(cond: str) -> str:
        return f"CASE WHEN {cond} THEN 'Yes' ELSE 'No' END"

    return "raw AS (SELECT k AS \"LoanID\", " + ", ".join([
        text("Age", 0, "18 + k % 50", "17"), amount("Income", 0, "bal * 12", "0"), amount("LoanAmount", 5, "total", "-total"),
        text("CreditScore", 5, "300 + k % 550", "299"), text("MonthsEmployed", 10, "k % 120", "-1"),
        text("NumCreditLines", 15, "k % 5", "-2"), amount("InterestRate", 10, "k % 25", "-1"),
        text("LoanTerm", 20, "12 * (1 + k % 5)", "0"),
        "CASE k % 59 WHEN 0 THEN 'high' WHEN 1 THEN NULL ELSE '0.4' END AS \"DTIRatio\"",
        word("Education", 0, "CASE k % 4 WHEN 0 THEN 'High School' WHEN 1 THEN 'Bachelor''s' WHEN 2 THEN 'Master''s' ELSE 'PhD' END"),
        word("EmploymentType", 5, "CASE k % 4 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part-time' WHEN 2 THEN 'Self-employed' ELSE 'Unemployed' END"),
        word("MaritalStatus", 10, "CASE k % 3 WHEN 0 THEN 'Divorced' WHEN 1 THEN 'Married' ELSE 'Single' END"),
        word("HasMortgage", 15, yes("k % 2 = 0")), word("HasDependents", 20, yes("k % 3 = 0")),
        word("LoanPurpose", 25, "CASE seg WHEN 'AUTOMOBILE' THEN 'Auto' WHEN 'MACHINERY' THEN 'Business' WHEN 'HOUSEHOLD' THEN 'Education' "
                                "WHEN 'FURNITURE' THEN 'Furniture' ELSE 'Home' END"),
        word("HasCoSigner", 30, yes("k % 5 = 0")),
    ]) + (" FROM (SELECT o_orderkey AS k, o_totalprice AS total, c_acctbal AS bal, c_mktsegment AS seg "
          "FROM orders JOIN customer ON o_custkey = c_custkey) AS j)")


def _raw_oracles(domains: dict[str, list[str]]) -> dict[str, str]:
    raw = _raw_apps()
    codes = []
    for name, kind, bound in (("Age", "text", ("ge_18", "< 18")), ("Income", "amount", ("gt_0", "<= 0")),
                              ("LoanAmount", "amount", ("ge_0", "< 0")), ("CreditScore", "text", None),
                              ("MonthsEmployed", "text", ("ge_0", "< 0")), ("NumCreditLines", "text", ("ge_0", "< 0")),
                              ("InterestRate", "amount", ("ge_0", "< 0")), ("LoanTerm", "text", ("gt_0", "<= 0"))):
        c, v = _q(name), f"TRY_CAST({_q(name)} AS DOUBLE)"
        codes.append(f"CASE WHEN {c} IS NULL THEN '{name}:required' END")
        odd = f"isnan({c})" if kind == "amount" else f"({v} IS NULL OR {v} <> floor({v}))"
        codes.append(f"CASE WHEN {c} IS NOT NULL AND {odd} THEN '{name}:type' END")
        if bound:
            codes.append(f"CASE WHEN {v} {bound[1]} AND NOT isnan({v}) THEN '{name}:{bound[0]}' END")
    codes.append("CASE WHEN \"DTIRatio\" IS NOT NULL AND TRY_CAST(\"DTIRatio\" AS DOUBLE) IS NULL THEN 'DTIRatio:type' END")
    codes += [f"CASE WHEN {_q(c)} IS NULL THEN '{c}:required' END" for c in domains_order()]
    checked = f"{raw}, v AS (SELECT \"LoanID\", concat_ws(',', {', '.join(codes)}) AS violations FROM raw)"
    num = {c: f"coalesce(CASE WHEN isnan(TRY_CAST({_q(c)} AS DOUBLE)) THEN NULL ELSE TRY_CAST({_q(c)} AS DOUBLE) END, 0)"
           for c in ("Age", "Income", "LoanAmount")}
    whole = "CAST(sign(\"LoanAmount\") * floor(abs(\"LoanAmount\") + 0.5) AS BIGINT)"
    q = {
        "raw_validate": f"WITH {checked} SELECT \"LoanID\", violations = '' AS is_valid, violations FROM v",
        "raw_violations": f"""WITH {checked} SELECT violation, CAST(COUNT(*) AS BIGINT) AS n
FROM (SELECT unnest(string_split(violations, ',')) AS violation FROM v WHERE violations <> '') AS u GROUP BY violation""",
        "raw_features": f"""WITH {raw} SELECT "LoanID",
  round(CASE WHEN {num['Income']} = 0 THEN 0 ELSE {num['LoanAmount']} / {num['Income']} END, 9) + CAST(0 AS DOUBLE) AS "DTIRatio",
  round({num['Age']} * {num['Income']}, 6) + CAST(0 AS DOUBLE) AS "Age_Income_Interaction",
  CASE WHEN "LoanAmount" IS NULL OR isnan("LoanAmount") THEN '-'
       ELSE (CASE WHEN {whole} < 0 THEN '-$' ELSE '$' END) || replace(format('{{:,}}', abs({whole})), ',', '.') END AS loan_text FROM raw""",
        "raw_domain_report": f"WITH {raw}, d AS (" + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST(COUNT(*) AS BIGINT) AS n_rows, {_sum_if(f'{_q(c)} IS NULL')} AS n_null, "
            f"{_sum_if(f'{_q(c)} IS NOT NULL AND {_q(c)} NOT IN (' + ', '.join(_lit(v) for v in vals) + ')')} AS n_unknown FROM raw"
            for c, vals in domains.items())
        + ") SELECT column_name, n_rows, n_null, n_unknown, n_null + n_unknown AS n_encoded_as_baseline FROM d",
        "raw_onehot": f"WITH {raw} SELECT \"LoanID\", " + ", ".join(
            f"CAST(CASE WHEN {_q(c)} = {_lit(v)} THEN 1 ELSE 0 END AS INTEGER) AS {_q(f'{c}_{v}')}" for c, v in DUMMIES) + " FROM raw",
    }
    return q


def domains_order() -> list[str]:
    return ["Education", "EmploymentType", "MaritalStatus", "HasMortgage", "HasDependents", "LoanPurpose", "HasCoSigner"]
