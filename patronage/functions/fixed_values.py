"""Names, bounds, word lists and texts that decide results and so must not change."""

from __future__ import annotations

RAW_COLUMN_NAMES = {
    "Invoice": "invoice_id",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "Price": "unit_price",
    "Customer ID": "customer_id",
    "Country": "country",
}

CLEAN_COLUMNS = [
    "invoice_id", "stock_code", "description", "quantity", "invoice_date", "unit_price", "customer_id",
    "country", "revenue", "invoice_year", "invoice_month", "invoice_yearmonth", "invoice_date_only",
]

FEATURE_COLUMNS = [
    "customer_id", "country_mode",
    "first_purchase_date", "last_purchase_date", "customer_tenure_days", "recency_days",
    "active_purchase_span_days",
    "total_invoices", "total_line_items", "total_quantity", "unique_products", "unique_purchase_days",
    "avg_days_between_purchases",
    "total_revenue", "average_invoice_value", "average_line_revenue", "average_unit_price",
    "max_invoice_value", "min_invoice_value",
    "is_repeat_buyer", "purchase_frequency_per_month", "quantity_per_invoice", "products_per_invoice",
    "total_returns", "return_quantity_abs", "has_returned", "return_rate",
]

SEGMENT_ACTIONS = {
    "Champions": "Reward with VIP offers and early access.",
    "Cannot Lose": "Prioritize personalized retention outreach.",
    "Loyal Customers": "Offer loyalty benefits and cross-sell bundles.",
    "Big Spenders": "Provide premium service and personalized offers.",
    "At Risk": "Trigger win-back campaign and discount offer.",
    "Potential Loyalists": "Encourage repeat purchase with targeted promotions.",
    "New Customers": "Send onboarding offers and product recommendations.",
    "Hibernating": "Send reactivation campaign.",
    "Low Value": "Use low-cost automated campaigns.",
    "Needs Attention": "Monitor behaviour and test targeted messaging.",
}

RECENCY_EDGES = [-1, 30, 60, 90, 180, 365, float("inf")]
RECENCY_LABELS = ["0-30d", "31-60d", "61-90d", "91-180d", "181-365d", "365+d"]
FREQUENCY_EDGES = [0, 1, 3, 5, 10, float("inf")]
FREQUENCY_LABELS = ["1 invoice", "2-3", "4-5", "6-10", "11+"]
MONETARY_LABELS = ["Low", "Low-Mid", "Mid", "Mid-High", "High"]

CHURN_BASE_COLUMNS = [
    "customer_id", "churned", "purchased_in_prediction",
    "obs_first_purchase_date", "obs_last_purchase_date", "obs_tenure_days", "obs_recency_days",
    "obs_total_invoices", "obs_total_line_items", "obs_total_quantity", "obs_unique_products",
    "obs_unique_purchase_days", "obs_total_revenue", "obs_average_invoice_value",
    "obs_average_line_revenue", "obs_average_unit_price", "obs_purchase_frequency_per_month",
    "obs_products_per_invoice", "obs_quantity_per_invoice", "obs_country_mode",
    "obs_avg_days_between_purchases", "obs_r_score", "obs_f_score", "obs_m_score", "obs_rfm_total_score",
]
LEAKAGE_COLUMNS = ["total_revenue", "total_invoices", "recency_days", "rfm_segment", "customer_health_score"]
NO_SEGMENT = "No Segment (obs-window only)"

RISK_TIERS = [(0.30, "Low Risk"), (0.60, "Medium Risk"), (0.80, "High Risk")]
TOP_RISK_TIER = "Critical Risk"
RISK_ORDER = ["Critical Risk", "High Risk", "Medium Risk", "Low Risk", "Not Scored"]
HEALTH_TIERS = [(80.0, "Excellent"), (60.0, "Healthy"), (40.0, "Watchlist"), (20.0, "At Risk")]
LOWEST_HEALTH_TIER = "Critical"
HEALTH_ORDER = ["Excellent", "Healthy", "Watchlist", "At Risk", "Critical"]
VALUE_TIERS = [(0.90, "Top 10% Value"), (0.70, "High Value"), (0.30, "Mid Value")]
LOWEST_VALUE_TIER = "Low Value"
VALUE_ORDER = ["Top 10% Value", "High Value", "Mid Value", "Low Value"]
PRIORITY_ORDER = ["Priority 1", "Priority 2", "Priority 3", "Priority 4", "Priority 5"]

PRIORITY_ACTIONS = {
    "Priority 1": "Immediate win-back outreach with personalized offer.",
    "Priority 2": "Assign retention priority and protect high-value relationship.",
    "Priority 3": "Encourage repeat purchase with targeted product recommendations.",
    "Priority 4": "Reward loyalty and offer premium cross-sell opportunities.",
    "Priority 5": "Use automated email nurture and monitor future activity.",
}
UNSCORED_ACTION = "Monitor customer until enough history exists for churn scoring."
PRIORITY_STRATEGIES = {
    "Priority 1": "Immediate win-back outreach. Personal calls + discount codes for Critical/At-Risk customers.",
    "Priority 2": "Retention priority. Protect high-value / Cannot Lose relationships with dedicated CSM touch.",
    "Priority 3": "Growth nurture. Drive repeat purchase via targeted recommendations and onboarding flows.",
    "Priority 4": "Loyalty & upsell. Reward Champions with early access, premium bundles, and referral programs.",
    "Priority 5": "Automated nurture. Low-cost email drip; monitor for re-engagement signals.",
}

COMPLAINT_COLUMNS = [
    "complaint_id", "date_received", "product", "sub_product", "issue", "sub_issue", "company", "state",
    "submitted_via", "date_sent_to_company", "company_response", "timely_response",
    "complaint_what_happened", "company_public_response",
]
COMPLAINT_COLUMN_NAMES = {
    "Complaint ID": "complaint_id",
    "Date received": "date_received",
    "Product": "product",
    "Sub-product": "sub_product",
    "Issue": "issue",
    "Sub-issue": "sub_issue",
    "Company": "company",
    "State": "state",
    "ZIP code": "zip_code",
    "Tags": "tags",
    "Submitted via": "submitted_via",
    "Date sent to company": "date_sent_to_company",
    "Company response to consumer": "company_response",
    "Timely response?": "timely_response",
    "Consumer complaint narrative": "complaint_what_happened",
    "Company public response": "company_public_response",
}
NARRATIVE_CANDIDATES = ["Consumer complaint narrative", "complaint_what_happened", "Complaint what happened"]
ID_CANDIDATES = ["complaint_id", "Complaint ID"]

THEMES = {
    1: "Debt verification / FDCPA",
    2: "Transactions / funds disputes",
    3: "False credit reporting",
    4: "Credit-report accuracy / rights",
    5: "Debt collection / validation",
    6: "Debt legitimacy / authorization",
    7: "Banking / account servicing",
    8: "Credit reporting / identity",
}
OTHER_THEME = "Other"

POSITIVE_WORDS = [
    "helpful", "resolved", "resolution", "satisfied", "excellent", "good", "great", "thank", "thanks",
    "appreciate", "successful", "easy", "quick", "prompt",
]
NEGATIVE_WORDS = [
    "fraud", "scam", "wrong", "error", "problem", "issue", "complaint", "angry", "terrible", "horrible",
    "bad", "unfair", "failed", "failure", "charged", "charge", "refund", "delay", "delayed", "denied",
    "refused", "cancel", "cancellation", "dispute", "stolen", "unauthorized", "misleading", "incorrect",
    "difficult", "unable",
]

URL_PATTERN = r"http\S+|www\S+"
EMAIL_PATTERN = r"\S+@\S+"
REDACTION_PATTERN = r"\bx+\b"
NON_LETTER_PATTERN = r"[^a-z\s]"
SPACE_PATTERN = r"\s+"

SIMILARITY_TARGETS = [
    "fraud", "payment", "account", "credit", "loan", "refund", "charge", "transaction", "debt", "mortgage",
]
CONCEPTS = {
    "fraud": ["fraud", "unauthorized", "identity"],
    "payments": ["payment", "payments", "transaction"],
    "credit": ["credit", "reporting", "score"],
    "debt": ["debt", "collection", "collector"],
    "service": ["service", "customer", "support"],
    "refund": ["refund", "charge", "charged"],
}

PRIORITY_EDGES = [float("-inf"), 33, 66, float("inf")]
PRIORITY_LABELS = ["Lower Priority", "Medium Priority", "High Priority"]

WILSON_Z = 1.959963984540054
EFFECT_SIZES = [(0.2, "Negligible"), (0.5, "Small"), (0.8, "Medium")]
LARGEST_EFFECT = "Large"

DESCRIBED_METRICS = [
    "customer_health_score", "churn_probability", "total_revenue", "total_invoices", "recency_days",
    "purchase_frequency_per_month", "return_rate",
]
RISK_GROUP_METRICS = [
    "total_revenue", "total_invoices", "recency_days", "purchase_frequency_per_month", "unique_purchase_days",
]
CORRELATED_METRICS = [
    "recency_days", "purchase_frequency_per_month", "total_revenue", "total_invoices", "return_rate",
    "customer_health_score", "churn_probability",
]
HEALTH_REGRESSORS = [
    "recency_days", "purchase_frequency_per_month", "total_revenue", "total_invoices", "return_rate",
    "unique_products",
]
CHURN_REGRESSORS = [
    "recency_days", "total_invoices", "total_revenue", "unique_products", "return_rate",
    "purchase_frequency_per_month",
]

# Conclusions of the test of health against returns.
HEALTH_DIFFERS = "There is statistically significant evidence that customer health differs between customers with and without returns."
HEALTH_SAME = "There is not sufficient statistical evidence to conclude that customer health differs between the two groups."
