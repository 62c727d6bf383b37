"""Thresholds, word lists and texts that results must reproduce exactly."""

# Tokens a CSV reader treats as a missing value.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Separators a delimited file may use, in order of preference on a tie.
SEPARATORS = [",", "\t", ";", "|"]

# Column roles.
CUSTOMER_NUMBERS = ["avg_session_time_min", "wishlist_items_count"]
TRANSACTION_NUMBERS = ["quantity", "unit_price", "total_amount"]
TRANSACTION_REQUIRED = ["order_id", "customer_id", "order_datetime", "total_amount"]
CUSTOMER_ATTRIBUTES = [
    "name", "device_type", "avg_session_time_min", "wishlist_items_count", "location",
]
CHURN_FEATURES = [
    "recencyDays", "frequency90d", "monetary90d", "avg_session_time_min",
    "wishlist_items_count",
]

# Windows and limits.
DEFAULT_DAYS = 30
MIN_DAYS = 7
MAX_DAYS = 365
TRAILING_DAYS = 90
CHURN_DAYS = 60
MIN_TRAINING_ROWS = 50
MIN_GROUP_ROWS = 5
SIGNIFICANCE = 0.05
HIGH_QUANTILE = 0.75
MID_QUANTILE = 0.50
HIGH_RISK = 0.7
MEDIUM_RISK = 0.3
AT_RISK_SHARE = 0.15
TEST_SHARE = 0.25
TREND_MONTHS = 6
TOP_CUSTOMERS = 12
MAX_INSIGHTS = 6
SUMMARY_INSIGHTS = 3

# Segment names.
AT_RISK = "At-Risk"
TOP_BUYER = "Top Buyer"
MODERATE = "Moderate"

# Model record texts.
LOGISTIC = "logistic_regression"
RULE_ONLY = "rule_only"
LOGISTIC_LABEL_RULE = "churned if no purchase in last 60 days"
RULE_LABEL_RULE = "churned if recencyDays >= 60"

# Delta captions of the KPI cards.
KPI_DELTA_LABELS = {
    "activeCustomers": "vs previous period",
    "avgCustomerValue": "vs previous period",
    "churnRiskCustomers": "needs attention",
    "retentionRate": "vs previous period",
}

# Insight texts.
AT_RISK_TITLE = "At-risk segment is sizable"
AT_RISK_EVIDENCE = "At-risk customers are %s%% of all customers in the model base."
AT_RISK_ACTION = (
    "Target customers inactive 45–90 days with a win-back offer or reminder campaign."
)
TEST_TITLE = "Statistically significant pattern detected"
TEST_EVIDENCE = "%s (p=%s)."
TEST_ACTION = "Use this segment dimension when designing offers or UX changes."

# Fact and answer texts.
ACTIVE_FACT = "Active customers: %s"
RETENTION_FACT = "Retention rate: %s%%"
CHURN_FACT = "Churn-risk customers: %s"
AUC_FACT = "Churn model AUC: %s"
TEST_ANSWER = "%s was significant (p=%s)."
NO_TEST_ANSWER = (
    "No statistically significant tests were detected for the current dataset and range."
)
SUMMARY_ANSWER = "Here are the top insights for the last %s days: %s"
SUMMARY_BULLET = "- %s: %s Action: %s"
FALLBACK_ANSWER = (
    "I can answer questions about active customers, retention, churn risk, and detected "
    "patterns, but I don't have enough computed insights yet."
)

# Error text when the data holds no usable order date.
NO_DATE_ERROR = "No valid order_datetime found in transactions"
