"""Fixed values that must equal the reference application's for right results.

Everything here is stated plainly and in the order the reference states it:
thresholds, label texts, default feature values and the HS section list.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — score bands, categories, payment terms and UI action labels
# ---------------------------------------------------------------------------
LOW_BAND_UPPER = 30      # score < 30  -> low risk
MEDIUM_BAND_UPPER = 60   # score < 60  -> medium risk, else high risk

CATEGORY_LOW = "Low Risk"
CATEGORY_MEDIUM = "Medium Risk"
CATEGORY_HIGH = "High Risk"

TERMS_LOW = "Credit terms acceptable (net 30/60)"
TERMS_MEDIUM = "Letter of Credit (LC) required"
TERMS_HIGH = "Advance payment only"

ACTION_LOW = "CREDIT OK"
ACTION_MEDIUM = "LC REQUIRED"
ACTION_HIGH = "ADVANCE PAYMENT"

# ---------------------------------------------------------------------------
# FIXED VALUES — feature defaults used when a deal has no buyer / country match
# ---------------------------------------------------------------------------
DEFAULT_DELAY_DAYS = 30.0
DEFAULT_DISPUTE_RATE = 0.05
DEFAULT_PAID_IN_FULL_RATE = 0.9
DEFAULT_TOTAL_ORDERS = 0
DEFAULT_TOTAL_VALUE = 0.0
DEFAULT_ORDER_RANK = 1
DEFAULT_STABILITY = 0.6
DEFAULT_VOLATILITY = 0.3
DEFAULT_SANCTIONS = 0
DEFAULT_PAYMENT_TERMS = "credit_30"
CONSTANT_FALLBACK_SCORE = 50.0

# The 12 model features, in the order the model is trained on.
FEATURE_COLUMNS = [
    "invoice_value_usd",
    "payment_delay_days",
    "political_stability_score",
    "currency_volatility_index",
    "trade_sanctions_flag",
    "buyer_total_orders",
    "buyer_total_value",
    "buyer_avg_delay",
    "buyer_dispute_rate",
    "buyer_avg_invoice",
    "buyer_paid_in_full_rate",
    "buyer_order_rank",
]
LABEL_COLUMN = "payment_default_risk"

# ---------------------------------------------------------------------------
# FIXED VALUES — rule-based score (points per rule) and its reason texts
# ---------------------------------------------------------------------------
RULE_DELAY_HIGH, RULE_DELAY_HIGH_POINTS = 60, 30
RULE_DELAY_MID, RULE_DELAY_MID_POINTS = 30, 10
RULE_DISPUTE_HIGH, RULE_DISPUTE_HIGH_POINTS = 0.1, 25
RULE_DISPUTE_MID, RULE_DISPUTE_MID_POINTS = 0.05, 10
RULE_STABILITY_LOW, RULE_STABILITY_LOW_POINTS = 0.3, 20
RULE_STABILITY_MID, RULE_STABILITY_MID_POINTS = 0.5, 10
RULE_SANCTIONS_POINTS = 15
RULE_PAID_LOW, RULE_PAID_LOW_POINTS = 0.7, 15
RULE_INVOICE_MULTIPLE, RULE_INVOICE_POINTS = 3, 10
RULE_SCORE_CAP = 100

TEXT_RULE_DELAY = "High average payment delay (%d days)"
TEXT_RULE_DISPUTE = "Elevated dispute rate (%.1f%%)"
TEXT_RULE_STABILITY = "Low political stability in buyer's country"
TEXT_RULE_SANCTIONS = "Trade sanctions active on buyer's country"
TEXT_RULE_PAID = "Low payment completion rate (%.1f%%)"
TEXT_RULE_INVOICE = "Invoice value ($%,d) is 3x buyer's average — verify capacity"
TEXT_NO_INDICATORS = "No significant risk indicators found"

# ---------------------------------------------------------------------------
# FIXED VALUES — model explanation texts (file and warehouse variants)
# ---------------------------------------------------------------------------
TEXT_NEW_BUYER = "New buyer — no prior transaction history available"
TEXT_NEW_BUYER_WAREHOUSE = "Buyer not found in BigQuery — using country-level risk only"
TEXT_NEW_BUYER_OFFLINE = "Fallback scoring — BigQuery unavailable, using country & value only"
TEXT_LIMITED_HISTORY = "Limited history — only %d prior orders"
TEXT_ESTABLISHED = "Established buyer with %d prior orders"
TEXT_DELAY_ABOVE = "Average payment delay of %d days — above threshold"
TEXT_DELAY_MODERATE = "Moderate payment delay (%d days)"
TEXT_STABILITY_LOW = "Country stability score is low (%.2f)"
TEXT_STABILITY_HIGH = "Relatively stable country (stability: %.2f)"
TEXT_SANCTIONS = "Destination country has active trade sanctions"
TEXT_DISPUTE_HIGH = "Buyer dispute rate is high (%.1f%%)"

REASON_LIMITED_ORDERS = 5
REASON_DELAY_HIGH = 60
REASON_DELAY_MID = 30
REASON_STABILITY_LOW = 0.4
REASON_STABILITY_HIGH = 0.7
REASON_DISPUTE_HIGH = 0.15
MAX_REASONS = 3

# ---------------------------------------------------------------------------
# FIXED VALUES — default-risk label (S1/S2) weights and thresholds
# ---------------------------------------------------------------------------
LABEL_DELAY_SCALE = 180.0
LABEL_W_DELAY = 0.3
LABEL_W_DISPUTE = 0.4
LABEL_W_NONPAYMENT = 0.3
LABEL_DISPUTE_PENALTY = 0.5
LABEL_NONPAYMENT_PENALTY = 0.3
LABEL_THRESHOLD = 0.3

# ---------------------------------------------------------------------------
# FIXED VALUES — buyer-history value trend, buyer view score, country index
# ---------------------------------------------------------------------------
TREND_DECLINING_BELOW = 0.7
TREND_GROWING_ABOVE = 1.3

# ---------------------------------------------------------------------------
# FIXED VALUES — dashboard display bands
# ---------------------------------------------------------------------------
STABILITY_BAND_HIGH = 0.6
STABILITY_BAND_MID = 0.3
VOLATILITY_BAND_HIGH = 0.5
RELIABILITY_BAND_HIGH = 70
RELIABILITY_BAND_MID = 40

LEADERBOARD_SIZE = 20
TOP_COUNTRIES = 10
RECENT_DEALS = 30
TREND_LOOKUP_MONTHS = 100
TREND_LAST_MONTHS = 12
TOP_FEATURES = 10

# ---------------------------------------------------------------------------
# FIXED VALUES — HS section labels, codes 1..21
# ---------------------------------------------------------------------------
HS_SECTIONS = [
    (1, "Textiles"), (2, "Chemicals"), (3, "Machinery"), (4, "Electronics"),
    (5, "Automotive"), (6, "Pharma"), (7, "Plastics"), (8, "Agricultural"),
    (9, "Steel"), (10, "Ceramics"), (11, "Leather"), (12, "Paper"),
    (13, "Wood"), (14, "Minerals"), (15, "Food"), (16, "Rubber"),
    (17, "Glass"), (18, "Precious Metals"), (19, "Base Metals"), (20, "Footwear"),
    (21, "Optical"),
]

# Reference payment-term codes.
PAYMENT_TERMS = ["advance", "lc", "credit_30", "credit_60", "credit_90"]
