"""Fixed values that must equal the reference's for identical results.

Everything in this module is data, not logic: names, labels, rule
parameters and display strings, written plainly and in their natural
order.  The code that uses them lives in ``functions`` and ``operators``.
"""

from __future__ import annotations

# --- Fixed values: application schema and target -----------------------------------

TARGET_COL = "Default"
ID_COL = "LoanID"

NUMERIC_COLUMNS = [
    "Age",
    "Income",
    "LoanAmount",
    "CreditScore",
    "MonthsEmployed",
    "NumCreditLines",
    "InterestRate",
    "LoanTerm",
]

CATEGORICAL_COLUMNS = [
    "Education",
    "EmploymentType",
    "MaritalStatus",
    "HasMortgage",
    "HasDependents",
    "LoanPurpose",
    "HasCoSigner",
]

ENGINEERED_COLUMNS = ["DTIRatio", "Age_Income_Interaction"]

# --- Fixed values: advisory UI domains of the categorical fields --------------------

DOMAINS = {
    "Education": ["High School", "Bachelor's", "Master's", "PhD"],
    "EmploymentType": ["Full-time", "Part-time", "Self-employed", "Unemployed"],
    "MaritalStatus": ["Married", "Single", "Divorced"],
    "HasMortgage": ["Yes", "No"],
    "HasDependents": ["Yes", "No"],
    "LoanPurpose": ["Auto", "Business", "Education", "Home", "Other"],
    "HasCoSigner": ["Yes", "No"],
}

# --- Fixed values: business rules, in evaluation order ------------------------------
# (id, label, condition text, multiplier, impact text, direction, reason)

BUSINESS_RULE_VERSION = "default-review-2026-04-19"

RULE_TABLE = [
    ("strong_credit_score", "Güçlü Kredi Notu", "CreditScore >= 750", 0.80,
     "Temerrüt olasılığını %20 azalt", "reduce",
     "CreditScore >= 750: reduce default probability by 20%."),
    ("low_dti", "Düşük DTI", "DTIRatio <= 0.35", 0.90,
     "Temerrüt olasılığını %10 azalt", "reduce",
     "DTIRatio <= 0.35: reduce default probability by 10%."),
    ("stable_full_time_employment", "Stabil Full-time İstihdam", "MonthsEmployed >= 36 ve Full-time", 0.90,
     "Temerrüt olasılığını %10 azalt", "reduce",
     "Full-time employment for at least 36 months: reduce default probability by 10%."),
    ("cosigner_present", "Kefil Var", "HasCoSigner = Yes", 0.90,
     "Temerrüt olasılığını %10 azalt", "reduce",
     "Co-signer present: reduce default probability by 10%."),
    ("high_dti", "Yüksek DTI", "DTIRatio >= 0.50", 1.20,
     "Temerrüt olasılığını %20 artır", "increase",
     "DTIRatio >= 0.50: increase default probability by 20%."),
    ("weak_credit_score", "Zayıf Kredi Notu", "CreditScore < 600", 1.15,
     "Temerrüt olasılığını %15 artır", "increase",
     "CreditScore < 600: increase default probability by 15%."),
    ("unstable_employment", "Dengesiz İstihdam", "Unemployed veya MonthsEmployed < 6", 1.15,
     "Temerrüt olasılığını %15 artır", "increase",
     "Unemployed or employed less than 6 months: increase default probability by 15%."),
]

# --- Fixed values: model and calibration parameters ---------------------------------

TARGET_RECALL = 0.69
RECALL_FLOOR = 0.67
DEFAULT_THRESHOLD = 0.50
THRESHOLD_GRID_LOW = 100      # thresholds are step / 1000 for step in [100, 900]
THRESHOLD_GRID_HIGH = 900
THRESHOLD_GRID_SCALE = 1000
TEST_SIZE = 0.2
RANDOM_STATE = 42
COMPARISON_TRAIN_CAP = 80000
ATTRIBUTION_GROUP_SAMPLE = 500
ATTRIBUTION_TOP_K = 20

GBT_PARAMS = {
    "learning_rate": 0.08,
    "max_depth": 3,
    "n_estimators": 220,
    "subsample": 0.7,
    "colsample_bytree": 0.85,
    "gamma": 1.0,
}
LOGISTIC_MAX_ITER = 1000
FOREST_MAX_DEPTH = 12
FOREST_TREES = 160
SMOTE_NEIGHBOURS = 5

# --- Fixed values: display strings ---------------------------------------------------

DECISION_LABELS = {0: "Onaylanabilir Profil", 1: "Manuel İnceleme"}

CREDIT_BANDS = [(750, "Prime"), (670, "Güçlü"), (600, "Orta")]
CREDIT_BAND_LOWEST = "Zayıf"
MISSING_DISPLAY = "-"

ERROR_TYPE_LABELS = {
    (1, 1): "True_Positive",
    (0, 0): "True_Negative",
    (0, 1): "False_Positive",
    (1, 0): "False_Negative",
}
ERROR_TYPE_UNKNOWN = "Unknown"

# Scenario profile keys (income, loan amount, credit score, employment,
# months employed, co-signer), the months suffix and co-signer words.
PROFILE_KEYS = ["Gelir", "Kredi Tutarı", "Kredi Notu", "İstihdam", "Çalışma Süresi", "Kefil"]
MONTHS_SUFFIX = " ay"
COSIGNER_WORDS = {True: "Var", False: "Yok"}

# Decision memo templates; %s placeholders: model %, adjusted %, DTI (4 dp), rule count.
MEMO_APPROVABLE = (
    "Başvuru onaylanabilir bölgede. Model skoru %s, iş kuralları sonrası skor %s. "
    "DTI %s ve %s kural etkisiyle profil düşük risk bandında kaldı."
)
MEMO_REVIEW = (
    "Başvuru manuel inceleme bandında. Model skoru %s, iş kuralları sonrası skor %s. "
    "DTI %s; gelir yükü, kredi notu ve istihdam sinyalleri kredi uzmanı tarafından gözden geçirilmeli."
)

# Training notes of the comparison table.
NOTE_BOOSTED = "SMOTE + tuned params + calibrated threshold"
NOTE_SAMPLE = "Stratified {n}-row training sample"

# --- Fixed values: golden scenarios and their published results ---------------------

SCENARIO_TITLES = {
    "low_risk": "Düşük Risk",
    "manual_review": "Manuel İnceleme",
    "high_risk": "Yüksek Risk",
    "edge_case_strong_score_weak_employment": "Güçlü Skor, Zayıf İstihdam",
}
SCENARIO_SNAPSHOT_KEYS = {
    "low_risk": "safe",
    "manual_review": "review",
    "high_risk": "risky",
    "edge_case_strong_score_weak_employment": "edge",
}

# id, Age, Income, LoanAmount, CreditScore, MonthsEmployed, NumCreditLines,
# InterestRate, LoanTerm, Education, EmploymentType, MaritalStatus,
# HasMortgage, HasDependents, LoanPurpose, HasCoSigner, expected decision
SCENARIOS = [
    ("low_risk", 38, 92000.0, 18000.0, 790, 84, 2, 9.8, 36, "Master's", "Full-time",
     "Married", "No", "No", "Auto", "Yes", 0),
    ("manual_review", 31, 54000.0, 29500.0, 665, 22, 4, 16.4, 48, "Bachelor's", "Self-employed",
     "Single", "No", "Yes", "Business", "No", 1),
    ("high_risk", 24, 36000.0, 34000.0, 560, 4, 6, 23.5, 60, "High School", "Unemployed",
     "Single", "Yes", "Yes", "Other", "No", 1),
    ("edge_case_strong_score_weak_employment", 29, 68000.0, 30000.0, 780, 3, 3, 13.8, 48,
     "Bachelor's", "Full-time", "Single", "No", "No", "Business", "No", 1),
]

# Published model score (percent) per scenario and the published results.
SCENARIO_MODEL_SCORES = {
    "low_risk": 8.24,
    "manual_review": 40.01,
    "high_risk": 58.04,
    "edge_case_strong_score_weak_employment": 26.68,
}
SCENARIO_EXPECTED = {
    # adjusted %, DTI, applied rules
    "low_risk": (4.81, 0.1957, ["strong_credit_score", "low_dti", "stable_full_time_employment", "cosigner_present"]),
    "manual_review": (48.02, 0.5463, ["high_dti"]),
    "high_risk": (92.11, 0.9444, ["high_dti", "weak_credit_score", "unstable_employment"]),
    "edge_case_strong_score_weak_employment": (24.54, 0.4412, ["strong_credit_score", "unstable_employment"]),
}
PUBLISHED_THRESHOLD = 0.231

# Published confusion matrix of the final model.
PUBLISHED_CONFUSION = {"tn": 30773, "fp": 14366, "tp": 4093, "fn": 1838}
PUBLISHED_METRICS = {"accuracy": 0.6827, "precision": 0.2217, "recall": 0.6901, "f1": 0.3356}

# Version tag written into the validation snapshot.
SNAPSHOT_VERSION = "lendspark-final-validation-1"
