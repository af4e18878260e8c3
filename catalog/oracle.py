"""Independent SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

from catalog.queries import CHANNEL_ROWS, CONTRIBUTION_WEIGHTS, HABITS, LOOKED_UP, NEGATIVE, POSITIVE, STOP_WORDS
from patronage.functions import fixed_values as fv
from patronage.plans.customer360 import CUTOFF

ORACLE: dict[str, str] = {}


# ---- expressions --------------------------------------------------------------------------------


def rnd(x: str, digits: int) -> str:
    factor = f"{10**digits}.0"
    return f"(floor(({x}) * {factor} + 0.5) / {factor})"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def pct(a: str, b: str) -> str:
    return f"({ratio(a, b)} * 100.0)"


def money(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(20,4))) AS DOUBLE)"


def mean(x: str, kind: str = "DECIMAL(20,4)") -> str:
    return ratio(f"CAST(SUM(CAST({x} AS {kind})) AS DOUBLE)", f"COUNT({x})")


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def case_of(x: str, mapping: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {k!r} THEN {quoted([v])}" for k, v in mapping.items())
    return f"CASE {x} {arms} ELSE {default} END"


def position_of(x: str, labels: list[str]) -> str:
    arms = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(labels, 1))
    return f"CASE {x} {arms} ELSE {len(labels) + 1} END"


def sql(name: str, ctes: list[str], body: str) -> None:
    seen: list[str] = []
    for c in ctes:
        if c not in seen:
            seen.append(c)
    ORACLE[name] = ("WITH " + ",\n".join(seen) + "\n" if seen else "") + body


# ---- transactions -------------------------------------------------------------------------------

JOINED = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
 JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""
LINE = """l_orderkey AS invoice_id, o_custkey AS customer_id, o_orderdate AS invoice_date, l_partkey AS stock_code,
 p_name AS description, l_extendedprice AS revenue, l_extendedprice / l_quantity AS unit_price, n_name AS country,
 strftime(o_orderdate, '%Y-%m') AS ym"""
SALES = f"sales AS (SELECT {LINE}, CAST(l_quantity AS BIGINT) AS quantity {JOINED} WHERE l_returnflag <> 'R')"
RETURNS = f"back AS (SELECT {LINE}, -CAST(l_quantity AS BIGINT) AS quantity {JOINED} WHERE l_returnflag = 'R')"

sql("monthly_revenue", [SALES], f"SELECT ym AS invoice_yearmonth, {money('revenue')} AS total_revenue FROM sales GROUP BY 1")
sql("monthly_customers", [SALES], "SELECT ym AS invoice_yearmonth, COUNT(DISTINCT customer_id) AS unique_customers FROM sales GROUP BY 1")
sql("dataset_overview", [SALES], f"""SELECT COUNT(*) AS total_rows, COUNT(DISTINCT customer_id) AS unique_customers,
 COUNT(DISTINCT invoice_id) AS unique_invoices, COUNT(DISTINCT stock_code) AS unique_products,
 COUNT(DISTINCT country) AS unique_countries, {stamp('MIN(invoice_date)')} AS date_min, {stamp('MAX(invoice_date)')} AS date_max FROM sales""")
PER_INVOICE = "per_invoice AS (SELECT invoice_id, SUM(CAST(revenue AS DECIMAL(20,4))) AS v, SUM(quantity) AS q FROM sales GROUP BY 1)"
sql("revenue_metrics", [SALES, PER_INVOICE], f"""SELECT CAST(SUM(v) AS DOUBLE) AS total_revenue, {big('SUM(q)')} AS total_quantity,
 COUNT(*) AS total_invoices, {ratio('SUM(v)', 'COUNT(*)')} AS avg_order_value,
 quantile_cont(CAST(v AS DOUBLE), 0.5) AS median_order_value FROM per_invoice""")
sql("order_value_trend", [SALES], f"""SELECT ym AS invoice_yearmonth, {rnd(ratio('SUM(v)', 'COUNT(*)'), 4)} AS avg_order_value
 FROM (SELECT ym, invoice_id, SUM(CAST(revenue AS DECIMAL(20,4))) AS v FROM sales GROUP BY 1, 2) GROUP BY 1""")
for name, keys, tie in [
    ("country_revenue_top10", "country", "country"),
    ("product_revenue_top10", "stock_code, description", "stock_code"),
    ("product_name_top10", "description", "description"),
    ("customer_revenue_top10", "customer_id", "customer_id"),
]:
    sql(name, [SALES], f"SELECT {keys}, {money('revenue')} AS total_revenue FROM sales GROUP BY {keys} ORDER BY total_revenue DESC, {tie} LIMIT 10")
FREQ = "freq AS (SELECT customer_id, COUNT(DISTINCT invoice_id) AS num_orders FROM sales GROUP BY 1)"
CREV = f"crev AS (SELECT customer_id, {money('revenue')} AS total_revenue FROM sales GROUP BY 1)"
sql("purchase_frequency", [SALES, FREQ], "SELECT * FROM freq")
sql("order_distribution", [SALES, FREQ], f"""SELECT COUNT(*) AS n, CAST(MIN(num_orders) AS DOUBLE) AS min, CAST(MAX(num_orders) AS DOUBLE) AS max,
 CAST(quantile_cont(num_orders, 0.5) AS DOUBLE) AS median, {ratio('SUM(num_orders)', 'COUNT(*)')} AS mean FROM freq""")
sql("revenue_distribution", [SALES, CREV], f"""SELECT COUNT(*) AS n, MIN(total_revenue) AS min, MAX(total_revenue) AS max,
 {rnd('quantile_cont(total_revenue, 0.5)', 4)} AS median, {rnd(mean('total_revenue'), 4)} AS mean FROM crev""")
sql("repeat_behaviour", [SALES], f"""SELECT COUNT(*) AS total_customers, CAST(SUM(v) AS DOUBLE) AS total_revenue,
 COUNT(*) FILTER (o > 1) AS repeat_customers, COALESCE(CAST(SUM(v) FILTER (o > 1) AS DOUBLE), 0) AS repeat_revenue,
 COUNT(*) FILTER (o <= 1) AS one_time_customers, COALESCE(CAST(SUM(v) FILTER (o <= 1) AS DOUBLE), 0) AS one_time_revenue,
 {rnd(pct('COUNT(*) FILTER (o > 1)', 'COUNT(*)'), 4)} AS repeat_customer_pct,
 {rnd(pct('COALESCE(CAST(SUM(v) FILTER (o > 1) AS DOUBLE), 0)', 'SUM(v)'), 4)} AS repeat_revenue_pct,
 {rnd(pct('COUNT(*) FILTER (o <= 1)', 'COUNT(*)'), 4)} AS one_time_customer_pct,
 {rnd(pct('COALESCE(CAST(SUM(v) FILTER (o <= 1) AS DOUBLE), 0)', 'SUM(v)'), 4)} AS one_time_revenue_pct
 FROM (SELECT customer_id, COUNT(DISTINCT invoice_id) AS o, SUM(CAST(revenue AS DECIMAL(20,4))) AS v FROM sales GROUP BY 1)""")
sql("repeat_revenue", [SALES, FREQ], f"SELECT {money('revenue')} AS revenue FROM sales WHERE customer_id IN (SELECT customer_id FROM freq WHERE num_orders > 1)")


def histogram_sql(source: str, column: str, bins: int, cap: str, by: str = "") -> str:
    group, first = (f"{by}, ", "1, 2") if by else ("", "1")
    return f"""SELECT {group}CAST(CASE WHEN hi = lo THEN 0 ELSE LEAST(floor((v - lo) / ((hi - lo) / {bins}.0)), {bins - 1}) END AS BIGINT) AS bin,
 COUNT(*) AS n, MIN(v) AS low, MAX(v) AS high FROM (SELECT {group}v, MIN(v) OVER () AS lo, MAX(v) OVER () AS hi FROM
 (SELECT {group}CAST({column} AS DOUBLE) AS v FROM {source}) WHERE v <= (SELECT {cap} FROM {source})) GROUP BY {first}"""


sql("frequency_histogram", [SALES, FREQ], histogram_sql("freq", "num_orders", 50, "floor(quantile_cont(num_orders, 0.95))"))
sql("revenue_histogram", [SALES, CREV], histogram_sql("crev", "total_revenue", 60, "quantile_cont(total_revenue, 0.95)"))
sql("peak_month", [SALES, f"m AS (SELECT ym, {money('revenue')} AS r FROM sales GROUP BY 1)"], """SELECT
 (SELECT ym FROM m ORDER BY r DESC, ym LIMIT 1) AS peak_invoice_yearmonth, (SELECT MAX(r) FROM m) AS peak_total_revenue,
 (SELECT ym FROM m ORDER BY r, ym LIMIT 1) AS low_invoice_yearmonth, (SELECT MIN(r) FROM m) AS low_total_revenue""")
MONTHS = f"""SELECT ym AS invoice_month, {rnd(money('revenue'), 2)} AS total_revenue, COUNT(DISTINCT invoice_id) AS total_invoices,
 COUNT(DISTINCT customer_id) AS active_customers, {big('SUM(quantity)')} AS total_quantity,
 {rnd(ratio(money('revenue'), 'COUNT(DISTINCT invoice_id)'), 2)} AS avg_order_value FROM sales GROUP BY 1"""
sql("monthly_report", [SALES], MONTHS)
sql("product_report", [SALES], f"""SELECT stock_code, description, {rnd(money('revenue'), 2)} AS total_revenue, {big('SUM(quantity)')} AS total_quantity,
 COUNT(DISTINCT invoice_id) AS total_invoices, COUNT(DISTINCT customer_id) AS unique_customers,
 {rnd(mean('unit_price', 'DECIMAL(24,8)'), 4)} AS avg_unit_price FROM sales WHERE description IS NOT NULL AND TRIM(description) <> ''
 GROUP BY 1, 2 ORDER BY total_revenue DESC, stock_code, description LIMIT 50""")

# ---- raw lines ----------------------------------------------------------------------------------

RAW_LINE = """CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS invoice_id,
 CAST(l_partkey AS VARCHAR) AS stock_code, CASE WHEN p_size <> 1 THEN p_name END AS description,
 CAST(l_quantity * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS BIGINT) AS quantity, o_orderdate AS invoice_date,
 CASE WHEN l_tax = 0.08 AND l_discount = 0.0 THEN 0.0 ELSE l_extendedprice / l_quantity END AS unit_price,
 CASE WHEN NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW') THEN CAST(o_custkey AS DOUBLE) END AS customer_id,
 n_name AS country"""
RAW = f"""raw AS (SELECT {RAW_LINE} {JOINED} UNION ALL
 SELECT {RAW_LINE} {JOINED} WHERE l_linenumber = 1 AND l_linestatus = 'F' AND l_tax = 0.0)"""
CLEAN = """clean AS (SELECT DISTINCT invoice_id, stock_code, description, quantity, invoice_date, unit_price,
 CAST(customer_id AS BIGINT) AS customer_id, country, quantity * unit_price AS revenue FROM raw
 WHERE NOT starts_with(invoice_id, 'C') AND customer_id IS NOT NULL AND quantity > 0 AND unit_price > 0 AND description IS NOT NULL)"""
RAW_NAMES = {v: k for k, v in fv.RAW_COLUMN_NAMES.items()}
AUDIT = {f"null_{k}": f"COUNT(*) FILTER ({v} IS NULL)" for k, v in fv.RAW_COLUMN_NAMES.items()} | {
    "duplicate_rows": "COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw))",
    "quantity_negative": "COUNT(*) FILTER (quantity < 0)",
    "quantity_zero": "COUNT(*) FILTER (quantity = 0)",
    "price_negative": "COUNT(*) FILTER (unit_price < 0)",
    "price_zero": "COUNT(*) FILTER (unit_price = 0)",
    "missing_customer_id": "COUNT(*) FILTER (customer_id IS NULL)",
    "cancelled_invoices": "COUNT(*) FILTER (starts_with(invoice_id, 'C'))",
    "unique_customers": "COUNT(DISTINCT customer_id)",
    "unique_invoices": "COUNT(DISTINCT invoice_id)",
    "unique_products": "COUNT(DISTINCT stock_code)",
    "unique_countries": "COUNT(DISTINCT country)",
    "total_rows": "COUNT(*)",
    "date_min": stamp("MIN(invoice_date)"),
    "date_max": stamp("MAX(invoice_date)"),
}
sql("dq_audit", [RAW], "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS \"check\", CAST({v} AS VARCHAR) AS value FROM raw" for k, v in AUDIT.items()
) + ") WHERE NOT (starts_with(\"check\", 'null_') AND value = '0')")
sql("clean_transactions", [RAW, CLEAN], f"""SELECT invoice_id, stock_code, description, quantity, {stamp('invoice_date')} AS invoice_date,
 unit_price, customer_id, country, revenue, {big('year(invoice_date)')} AS invoice_year, {big('month(invoice_date)')} AS invoice_month,
 strftime(invoice_date, '%Y-%m') AS invoice_yearmonth, {day('invoice_date')} AS invoice_date_only FROM clean""")
sql("returns_split", [RAW], f"""SELECT DISTINCT invoice_id, stock_code, description, quantity, {stamp('invoice_date')} AS invoice_date,
 unit_price, customer_id, country FROM raw WHERE starts_with(invoice_id, 'C')""")
STEP = """CASE WHEN starts_with(invoice_id, 'C') THEN 'returns' WHEN customer_id IS NULL THEN 'missing_customer'
 WHEN quantity <= 0 THEN 'bad_quantity' WHEN unit_price <= 0 THEN 'bad_price' WHEN description IS NULL THEN 'missing_description' ELSE 'clean' END"""
sql("cleaning_steps", [RAW, "uniq AS (SELECT DISTINCT * FROM raw)", f"judged AS (SELECT {STEP} AS step FROM uniq)"],
    "SELECT 'raw' AS step, COUNT(*) AS rows FROM raw UNION ALL "
    "SELECT 'duplicates', (SELECT COUNT(*) FROM raw) - (SELECT COUNT(*) FROM uniq) UNION ALL " + " UNION ALL ".join(
        f"SELECT '{s}', COUNT(*) FILTER (step = '{s}') FROM judged"
        for s in ["returns", "missing_customer", "bad_quantity", "bad_price", "missing_description", "clean"]
    ))


def rule_rows(source: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{r}' AS rule, {big(v)} AS violations, ({v}) = 0 AS passed FROM {source}" for r, v in rules.items()
    )


NO_NULL = " AND ".join(f"{c} IS NOT NULL" for c in [*RAW_NAMES, "revenue"])
sql("clean_rules", [RAW, CLEAN], rule_rows("clean", {
    "no_nulls": f"COUNT(*) FILTER (NOT ({NO_NULL}))",
    "quantity_positive": "COUNT(*) FILTER (quantity <= 0)",
    "unit_price_positive": "COUNT(*) FILTER (unit_price <= 0)",
    "revenue_positive": "COUNT(*) FILTER (revenue <= 0)",
    "no_cancellations": "COUNT(*) FILTER (starts_with(invoice_id, 'C'))",
    "no_duplicates": "COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM clean))",
}))
sql("stored_clean_rules", [RAW, CLEAN], "SELECT *, (SELECT COUNT(*) FROM clean) AS rows FROM (" + rule_rows("clean", {
    "no_nulls": f"COUNT(*) FILTER (NOT ({NO_NULL}))",
    "quantity_positive": "COUNT(*) FILTER (quantity <= 0)",
    "unit_price_positive": "COUNT(*) FILTER (unit_price <= 0)",
    "revenue_positive": "COUNT(*) FILTER (revenue <= 0)",
    "no_cancellations": "COUNT(*) FILTER (starts_with(invoice_id, 'C'))",
    "no_duplicates": "COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM clean))",
}) + ")")
sql("envelope_ranges", [], """SELECT event_type, COUNT(*) AS events, COUNT(DISTINCT user_id) AS users, MAX(CAST(event_id AS VARCHAR)) AS last_id
 FROM events GROUP BY 1""")
sql("null_profile", [RAW], " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER ({c} IS NULL) AS nulls FROM raw" for c in RAW_NAMES))
sql("table_profile", [RAW], " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER ({c} IS NULL) AS nulls, COUNT(*) AS rows, "
    f"{stamp('MIN(invoice_date)')} AS date_min, {stamp('MAX(invoice_date)')} AS date_max FROM raw" for c in RAW_NAMES))
sql("key_metrics", [RAW, CLEAN], f"""SELECT COUNT(*) AS total_rows, COUNT(DISTINCT customer_id) AS unique_customers,
 COUNT(DISTINCT invoice_id) AS unique_invoices, COUNT(DISTINCT stock_code) AS unique_products, COUNT(DISTINCT country) AS unique_countries,
 {stamp('MIN(invoice_date)')} AS date_min, {stamp('MAX(invoice_date)')} AS date_max, {rnd(money('revenue'), 2)} AS total_revenue,
 (SELECT {rnd(ratio('SUM(v)', 'COUNT(*)'), 2)} FROM (SELECT SUM(CAST(revenue AS DECIMAL(20,4))) AS v FROM clean GROUP BY invoice_id)) AS avg_order_value
 FROM clean""")
sql("dedup_key", [], """SELECT d.doc_id, d.lang, d.source, d.n_chars FROM documents d
 JOIN (SELECT MIN(doc_id) AS doc_id FROM documents GROUP BY text) k ON d.doc_id = k.doc_id""")

# ---- features -----------------------------------------------------------------------------------


def feature_ctes(source: str, p: str) -> list[str]:
    """Feature tables of one set of lines, table by table, then joined; ``p`` names the set."""
    return [
        f"""{p}inv AS (SELECT customer_id, invoice_id, MIN(invoice_date) AS d, SUM(CAST(revenue AS DECIMAL(20,4))) AS rev,
 {big('SUM(quantity)')} AS qty, COUNT(revenue) AS n FROM {source} GROUP BY 1, 2)""",
        f"""{p}per_inv AS (SELECT customer_id, MIN(d) AS first_purchase_date, MAX(d) AS last_purchase_date, COUNT(*) AS total_invoices,
 COUNT(DISTINCT CAST(d AS DATE)) AS unique_purchase_days, CAST(SUM(rev) AS DOUBLE) AS total_revenue,
 CAST(MAX(rev) AS DOUBLE) AS max_invoice_value, CAST(MIN(rev) AS DOUBLE) AS min_invoice_value FROM {p}inv GROUP BY 1)""",
        f"""{p}per_line AS (SELECT customer_id, COUNT(invoice_id) AS total_line_items, {big('SUM(quantity)')} AS total_quantity,
 COUNT(DISTINCT stock_code) AS unique_products FROM {source} GROUP BY 1)""",
        f"""{p}days AS (SELECT DISTINCT customer_id, CAST(invoice_date AS DATE) AS d FROM {source})""",
        f"""{p}gaps AS (SELECT customer_id, d, CAST(d - LAG(d) OVER (PARTITION BY customer_id ORDER BY d) AS BIGINT) AS gap FROM {p}days)""",
        f"""{p}gap AS (SELECT customer_id, COALESCE({ratio('SUM(gap)', 'COUNT(gap)')}, 0.0) AS avg_days_between_purchases FROM {p}gaps GROUP BY 1)""",
        f"""{p}country AS (SELECT customer_id, country AS country_mode FROM (SELECT customer_id, country,
 ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY COUNT(*) DESC, country) AS r FROM {source} GROUP BY 1, 2) WHERE r = 1)""",
        f"""{p}base AS (SELECT * FROM {p}per_inv JOIN {p}per_line USING (customer_id) JOIN {p}gap USING (customer_id) JOIN {p}country USING (customer_id))""",
    ]


RATIOS = f"""total_invoices / GREATEST(CAST(tenure AS DOUBLE) / 30.0, 1.0) AS purchase_frequency_per_month,
 {ratio('total_revenue', 'total_invoices')} AS average_invoice_value, {ratio('total_revenue', 'total_line_items')} AS average_line_revenue,
 {ratio('total_revenue', 'total_quantity')} AS average_unit_price, {ratio('total_quantity', 'total_invoices')} AS quantity_per_invoice,
 {ratio('unique_products', 'total_invoices')} AS products_per_invoice"""
SNAPSHOT = "(SELECT MAX(invoice_date) + INTERVAL 1 DAY FROM sales)"
BACK = f"ret AS (SELECT customer_id, COUNT(invoice_id) AS total_returns, {big('SUM(ABS(quantity))')} AS return_quantity_abs FROM back GROUP BY 1)"
FEATURES = [SALES, RETURNS, *feature_ctes("sales", "s_"), BACK, f"""features AS (SELECT t.*, tenure AS customer_tenure_days,
 {big(f"datesub('day', last_purchase_date, {SNAPSHOT})")} AS recency_days, tenure AS active_purchase_span_days, {RATIOS},
 {big('CASE WHEN total_invoices > 1 THEN 1 ELSE 0 END')} AS is_repeat_buyer,
 COALESCE(total_returns, 0) AS total_returns, COALESCE(return_quantity_abs, 0) AS return_quantity_abs,
 {big('CASE WHEN total_returns IS NULL THEN 0 ELSE 1 END')} AS has_returned, {ratio('COALESCE(total_returns, 0)', 'total_invoices')} AS return_rate
 FROM (SELECT *, {big("datesub('day', first_purchase_date, last_purchase_date)")} AS tenure FROM s_base) t LEFT JOIN ret USING (customer_id))"""]


def plain_feature_columns(columns: list[str]) -> str:
    return ", ".join(f"{stamp(c)} AS {c}" if c.endswith("purchase_date") else c for c in columns)


sql("invoice_rollup", [SALES, feature_ctes("sales", "s_")[0]], f"""SELECT customer_id, invoice_id, {stamp('d')} AS invoice_date,
 CAST(rev AS DOUBLE) AS invoice_revenue, qty AS invoice_qty, n AS invoice_lines FROM s_inv""")
sql("date_features", FEATURES, "SELECT customer_id, " + plain_feature_columns(
    ["first_purchase_date", "last_purchase_date", "customer_tenure_days", "recency_days", "active_purchase_span_days"]) + " FROM features")
sql("frequency_features", FEATURES, "SELECT customer_id, total_invoices, total_line_items, total_quantity, unique_products, unique_purchase_days FROM features")
sql("revenue_features", FEATURES, "SELECT customer_id, total_revenue, max_invoice_value, min_invoice_value FROM features")
sql("country_mode", FEATURES, "SELECT customer_id, country_mode FROM features")
sql("purchase_gap", FEATURES, "SELECT customer_id, avg_days_between_purchases FROM features")
sql("purchase_gap_lag", FEATURES, f"SELECT customer_id, {day('d')} AS purchase_day, gap AS gap_days FROM s_gaps")
sql("return_features", [SALES, RETURNS, BACK], "SELECT *, CAST(1 AS BIGINT) AS has_returned FROM ret WHERE customer_id IN (SELECT customer_id FROM sales)")
sql("customer_features", FEATURES, "SELECT " + plain_feature_columns(fv.FEATURE_COLUMNS) + " FROM features")
sql("feature_rules", FEATURES, rule_rows("features", {
    "customer_id_present": "COUNT(*) FILTER (customer_id IS NULL)",
    "revenue_positive": "COUNT(*) FILTER (NOT total_revenue > 0)",
    "invoices_at_least_one": "COUNT(*) FILTER (NOT total_invoices >= 1)",
    "quantity_positive": "COUNT(*) FILTER (NOT total_quantity > 0)",
    "recency_not_negative": "COUNT(*) FILTER (NOT recency_days >= 0)",
    "tenure_not_negative": "COUNT(*) FILTER (NOT customer_tenure_days >= 0)",
    "invoice_value_positive": "COUNT(*) FILTER (NOT average_invoice_value > 0)",
    "frequency_positive": "COUNT(*) FILTER (NOT purchase_frequency_per_month > 0)",
    "customer_id_unique": "COUNT(*) - COUNT(DISTINCT customer_id)",
}))

# ---- scores -------------------------------------------------------------------------------------


def rank_score(x: str, higher: bool, key: str = "customer_id") -> str:
    """Rank percentile cut into five equal widths over [1/n, 1]."""
    n = "CAST(COUNT(*) OVER () AS DOUBLE)"
    place = f"(CAST(ROW_NUMBER() OVER (ORDER BY {x}, {key}) AS DOUBLE) / {n})"
    edges = " + ".join(f"CASE WHEN {place} > {k}.0 * ((1.0 - 1.0 / {n}) / 5.0) + 1.0 / {n} THEN 1 ELSE 0 END" for k in range(1, 5))
    score = f"(1 + {edges})"
    return big(score if higher else f"6 - {score}")


def quantile_score(x: str, source: str, higher: bool) -> str:
    """Bins at the quantiles; by rank where the quantile edges do not make five filled bins."""
    q = f"(SELECT quantile_cont(CAST({x} AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) FROM {source})"
    cut = "1 + " + " + ".join(f"CASE WHEN {x} > {q}[{k}] THEN 1 ELSE 0 END" for k in range(1, 5))
    full = f"(SELECT COUNT(DISTINCT b) = 5 FROM (SELECT {cut} AS b FROM {source}))"
    return f"CASE WHEN {full} THEN {big(cut if higher else f'6 - ({cut})')} ELSE {rank_score(x, higher)} END"


def average_rank(x: str, partition: str = "") -> str:
    over = f"PARTITION BY {partition} " if partition else ""
    ties = f"PARTITION BY {partition}, {x}" if partition else f"PARTITION BY {x}"
    return f"(RANK() OVER ({over}ORDER BY {x}) + (COUNT(*) OVER ({ties}) - 1) / 2.0)"


def rank_share(x: str) -> str:
    return f"(CAST({average_rank(x)} AS DOUBLE) / COUNT(*) OVER ())"


sql("rank_quintile", FEATURES, f"""SELECT customer_id, total_invoices, recency_days, {rank_score('total_invoices', True)} AS frequency_score,
 {rank_score('recency_days', False)} AS recency_score FROM features""")
RFM_SCORES = f"""scores AS (SELECT *, {quantile_score('recency_days', 'features', False)} AS r_score,
 {quantile_score('total_invoices', 'features', True)} AS f_score, {quantile_score('total_revenue', 'features', True)} AS m_score FROM features)"""
sql("quantile_quintile", [*FEATURES, RFM_SCORES], "SELECT customer_id, recency_days, total_invoices, total_revenue, r_score, f_score, m_score FROM scores")
sql("avg_rank_pct", FEATURES, f"""SELECT customer_id, total_invoices, purchase_frequency_per_month, {rank_share('total_invoices')} AS total_invoices_rank,
 {rank_share('purchase_frequency_per_month')} AS purchase_frequency_per_month_rank FROM features""")
sql("exact_quantiles", FEATURES, " UNION ALL ".join(
    f"SELECT '{m}' AS metric, COUNT(*) AS n, CAST(MIN({m}) AS DOUBLE) AS min, CAST(MAX({m}) AS DOUBLE) AS max, " + ", ".join(
        f"{rnd(f'quantile_cont(CAST({m} AS DOUBLE), {q})', 6)} AS {name}" for name, q in [("median", 0.5), ("p80", 0.8), ("p95", 0.95)]
    ) + " FROM features" for m in ["recency_days", "total_revenue"]))
SEGMENT = """CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
 WHEN r_score <= 2 AND f_score >= 4 AND m_score >= 4 THEN 'Cannot Lose' WHEN r_score >= 3 AND f_score >= 4 AND m_score >= 3 THEN 'Loyal Customers'
 WHEN m_score >= 5 AND f_score <= 3 THEN 'Big Spenders' WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'At Risk'
 WHEN r_score >= 4 AND f_score BETWEEN 2 AND 3 THEN 'Potential Loyalists' WHEN r_score >= 4 AND f_score = 1 THEN 'New Customers'
 WHEN r_score <= 2 AND f_score <= 2 THEN 'Hibernating' WHEN r_score + f_score + m_score <= 6 THEN 'Low Value' ELSE 'Needs Attention' END"""
RFM = [*FEATURES, RFM_SCORES, f"segmented AS (SELECT *, {SEGMENT} AS rfm_segment FROM scores)",
       f"""rfm AS (SELECT *, CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_score,
 r_score + f_score + m_score AS rfm_total_score, {ratio('r_score + f_score + m_score', '3')} AS rfm_average_score,
 {case_of('rfm_segment', fv.SEGMENT_ACTIONS)} AS recommended_action FROM segmented)"""]
RFM_COLUMNS = "r_score, f_score, m_score, rfm_score, rfm_total_score, rfm_average_score, rfm_segment, recommended_action"
sql("rfm_segments", RFM, f"SELECT customer_id, {RFM_COLUMNS} FROM rfm")
sql("rfm_rules", RFM, rule_rows("rfm", {
    **{f"{c}_in_range": f"COUNT(*) FILTER (NOT {c} BETWEEN 1 AND 5)" for c in ["r_score", "f_score", "m_score"]},
    "segment_present": "COUNT(*) FILTER (COALESCE(rfm_segment, '') = '')",
    "action_present": "COUNT(*) FILTER (recommended_action IS NULL)",
}))
ALL_REVENUE = f"SUM(SUM(CAST(total_revenue AS DECIMAL(20,4)))) OVER ()"
sql("rfm_segment_overview", RFM, f"""SELECT rfm_segment, COUNT(*) AS customer_count, {rnd(pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 2)} AS customer_percent,
 {rnd(money('total_revenue'), 2)} AS total_revenue, {rnd(mean('total_revenue'), 2)} AS avg_revenue_per_customer,
 {rnd(mean('recency_days'), 1)} AS avg_recency_days, {rnd(mean('total_invoices'), 2)} AS avg_total_invoices,
 {rnd(pct(money('total_revenue'), ALL_REVENUE), 2)} AS revenue_percent FROM rfm GROUP BY 1""")

# ---- churn --------------------------------------------------------------------------------------

CUT = f"TIMESTAMP '{CUTOFF} 00:00:00'"
LABELS = [SALES, f"obs AS (SELECT * FROM sales WHERE invoice_date < {CUT})", f"pred AS (SELECT * FROM sales WHERE invoice_date >= {CUT})",
          f"""labels_ AS (SELECT customer_id, (SELECT MIN(invoice_date) FROM sales) AS s, (SELECT MAX(invoice_date) FROM sales) AS e,
 {big('CASE WHEN customer_id IN (SELECT customer_id FROM pred) THEN 1 ELSE 0 END')} AS purchased_in_prediction
 FROM (SELECT DISTINCT customer_id FROM obs))""",
          "churned AS (SELECT *, 1 - purchased_in_prediction AS churned FROM labels_)"]
sql("churn_labels", LABELS, f"""SELECT customer_id, {day('s')} AS observation_start_date, {day(f'{CUT} - INTERVAL 1 DAY')} AS observation_end_date,
 {day(CUT)} AS prediction_start_date, {day('e')} AS prediction_end_date, CAST(1 AS BIGINT) AS purchased_in_observation,
 purchased_in_prediction, {big('churned')} AS churned FROM churned""")
sql("churn_label_distribution", LABELS, f"""SELECT {big('churned')} AS churned, COUNT(*) AS customer_count,
 {rnd(pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 2)} AS customer_percent FROM churned GROUP BY 1""")
sql("class_balance", LABELS, f"""SELECT {rnd(pct('SUM(churned)', 'COUNT(*)'), 6)} AS churn_rate,
 {pct('SUM(churned)', 'COUNT(*)')} BETWEEN 20 AND 80 AS balanced FROM churned""")
IDS = {"observation": "SELECT customer_id FROM obs", "prediction": "SELECT customer_id FROM pred"}
IDS |= {
    "churned": f"{IDS['observation']} EXCEPT {IDS['prediction']}", "retained": f"{IDS['observation']} INTERSECT {IDS['prediction']}",
    "prediction_only": f"{IDS['prediction']} EXCEPT {IDS['observation']}", "both": f"{IDS['prediction']} INTERSECT {IDS['observation']}",
    "any": f"{IDS['observation']} UNION {IDS['prediction']}",
}
sql("key_set_ops", LABELS[:3], " UNION ALL ".join(
    f"SELECT '{k}' AS key_set, COUNT(DISTINCT customer_id) AS customers FROM ({v})" for k, v in IDS.items()))
OBS = [*LABELS, *feature_ctes("obs", "o_"), f"""o_feat AS (SELECT t.*, {big(f"datesub('day', last_purchase_date, {CUT})")} AS recency, {RATIOS}
 FROM (SELECT *, {big("datesub('day', first_purchase_date, last_purchase_date)")} AS tenure FROM o_base) t)""",
       f"""o_scored AS (SELECT *, {rank_score('recency', False)} AS r, {rank_score('total_invoices', True)} AS f,
 {rank_score('total_revenue', True)} AS m FROM o_feat)"""]
OBS_FROM = {
    "obs_tenure_days": "tenure", "obs_recency_days": "recency", "obs_r_score": "r", "obs_f_score": "f", "obs_m_score": "m",
    "obs_rfm_total_score": "r + f + m", "customer_id": "customer_id", "churned": big("churned"),
    "purchased_in_prediction": "purchased_in_prediction",
}
CHURN_BASE = [*OBS, "cbase AS (SELECT " + ", ".join(
    f"{OBS_FROM.get(c, c.removeprefix('obs_'))} AS {c}" for c in fv.CHURN_BASE_COLUMNS
) + " FROM churned LEFT JOIN o_scored USING (customer_id))"]
sql("churn_model_base", CHURN_BASE, "SELECT " + plain_feature_columns(fv.CHURN_BASE_COLUMNS) + " FROM cbase")


def bucket(x: str, edges: list[float], labels: list[str]) -> str:
    arms = " ".join(f"WHEN {x} <= {e} THEN '{v}'" for e, v in zip(edges[1:-1], labels))
    return f"CASE WHEN {x} <= {edges[0]} THEN NULL {arms} ELSE '{labels[-1]}' END"


def churn_rates(source: str, expression: str, name: str) -> str:
    return f"""SELECT {expression} AS {name}, COUNT(customer_id) AS customers, {big('SUM(churned)')} AS churned_customers,
 {rnd(pct('SUM(churned)', 'COUNT(customer_id)'), 2)} AS churn_rate FROM {source} GROUP BY 1 HAVING {name} IS NOT NULL"""


sql("churn_by_recency", CHURN_BASE, churn_rates("cbase", bucket("obs_recency_days", fv.RECENCY_EDGES, fv.RECENCY_LABELS), "bucket"))
sql("churn_by_frequency", CHURN_BASE, churn_rates("cbase", bucket("obs_total_invoices", fv.FREQUENCY_EDGES, fv.FREQUENCY_LABELS), "bucket"))
MONETARY = case_of("score", dict(enumerate(fv.MONETARY_LABELS, 1)))
sql("churn_by_monetary", [*CHURN_BASE, f"scored AS (SELECT *, {quantile_score('obs_total_revenue', 'cbase', True)} AS score FROM cbase)"],
    churn_rates("scored", MONETARY, "bucket"))
sql("churn_by_segment", [*RFM, *LABELS[1:]], f"""SELECT COALESCE(rfm_segment, '{fv.NO_SEGMENT}') AS rfm_segment, COUNT(*) AS customers,
 {big('SUM(churned)')} AS churned_customers, {rnd(pct('SUM(churned)', 'COUNT(*)'), 2)} AS churn_rate,
 {big('COUNT(*) - SUM(churned)')} AS retained_customers, {rnd(pct('COUNT(*) - SUM(churned)', 'COUNT(*)'), 2)} AS retention_rate
 FROM churned LEFT JOIN rfm USING (customer_id) GROUP BY 1""")
sql("leakage_guard", CHURN_BASE, f"""SELECT 'forbidden_columns' AS "check", CAST(0 AS BIGINT) AS violations, true AS passed UNION ALL
 SELECT 'unprefixed_columns', 0, true UNION ALL
 SELECT 'dates_after_cutoff', COUNT(*) FILTER (obs_last_purchase_date >= {CUT}), COUNT(*) FILTER (obs_last_purchase_date >= {CUT}) = 0 FROM cbase""")
SCORES = [*CHURN_BASE, f"""cpred AS (SELECT customer_id, churned AS actual_churned, {big(f'CASE WHEN p >= 0.5 THEN 1 ELSE 0 END')} AS predicted_churned,
 {rnd('p', 4)} AS churn_probability,
 CASE WHEN p < 0.30 THEN 'Low Risk' WHEN p < 0.60 THEN 'Medium Risk' WHEN p < 0.80 THEN 'High Risk' ELSE 'Critical Risk' END AS risk_tier
 FROM (SELECT *, CAST(LEAST(GREATEST(CAST(obs_recency_days AS DOUBLE) / 730.0, 0.0), 1.0) AS DOUBLE) AS p FROM cbase))"""]
sql("churn_scores", SCORES, "SELECT * FROM cpred")

# ---- customer 360 -------------------------------------------------------------------------------

HEALTH = """CASE WHEN customer_health_score >= 80 THEN 'Excellent' WHEN customer_health_score >= 60 THEN 'Healthy'
 WHEN customer_health_score >= 40 THEN 'Watchlist' WHEN customer_health_score >= 20 THEN 'At Risk' ELSE 'Critical' END"""
SCORE = """CAST(rfm_total_score AS DOUBLE) / 15.0 * 40.0 + CASE WHEN model_scored = 1 THEN (1.0 - churn_probability) * 30.0 ELSE 15.0 END
 + rev_share * 20.0 + (is_repeat_buyer * CAST(0.5 AS DOUBLE) + freq_share * 0.5) * 10.0"""
PRIORITY = """CASE WHEN health_tier IN ('Critical', 'At Risk') OR churn_risk_tier = 'Critical Risk' THEN 'Priority 1'
 WHEN rfm_segment IN ('Cannot Lose', 'At Risk') OR (top20 AND churn_risk_tier IN ('High Risk', 'Critical Risk')) THEN 'Priority 2'
 WHEN rfm_segment IN ('Potential Loyalists', 'New Customers') OR health_tier = 'Watchlist' THEN 'Priority 3'
 WHEN rfm_segment IN ('Champions', 'Loyal Customers', 'Big Spenders') AND health_tier IN ('Excellent', 'Healthy') THEN 'Priority 4'
 ELSE 'Priority 5' END"""
C360 = [*RFM, *SCORES[1:],
        f"""c1 AS (SELECT rfm.*, actual_churned, predicted_churned, churn_probability, COALESCE(risk_tier, 'Not Scored') AS churn_risk_tier,
 {big('CASE WHEN churn_probability IS NULL THEN 0 ELSE 1 END')} AS model_scored, {rank_share('total_revenue')} AS rev_share,
 {rank_share('purchase_frequency_per_month')} AS freq_share,
 total_revenue >= (SELECT quantile_cont(total_revenue, 0.8) FROM rfm) AS top20 FROM rfm LEFT JOIN cpred USING (customer_id))""",
        f"c2 AS (SELECT *, LEAST(GREATEST({rnd(SCORE, 2)}, 0.0), 100.0) AS customer_health_score FROM c1)",
        f"""c3 AS (SELECT *, {HEALTH} AS health_tier, CASE WHEN rev_share >= 0.90 THEN 'Top 10% Value' WHEN rev_share >= 0.70 THEN 'High Value'
 WHEN rev_share >= 0.30 THEN 'Mid Value' ELSE 'Low Value' END AS customer_value_tier FROM c2)""",
        f"c4 AS (SELECT *, {PRIORITY} AS action_priority FROM c3)",
        f"""c360 AS (SELECT *, {case_of('action_priority', fv.PRIORITY_ACTIONS)} AS final_recommended_action,
 {big("CASE WHEN churn_risk_tier IN ('High Risk', 'Critical Risk') OR health_tier IN ('At Risk', 'Critical') OR rfm_segment IN ('Cannot Lose', 'At Risk') THEN 1 ELSE 0 END")} AS retention_target_flag,
 {big("CASE WHEN rfm_segment IN ('Champions', 'Loyal Customers', 'Big Spenders') AND customer_value_tier IN ('Top 10% Value', 'High Value') THEN 1 ELSE 0 END")} AS vip_flag FROM c4)"""]
C360_COLUMNS = [c for c in fv.FEATURE_COLUMNS if c != "active_purchase_span_days"] + RFM_COLUMNS.split(", ") + [
    "actual_churned", "predicted_churned", "churn_probability", "churn_risk_tier", "model_scored", "customer_health_score", "health_tier",
    "customer_value_tier", "action_priority", "final_recommended_action", "retention_target_flag", "vip_flag",
]
sql("customer_360", C360, "SELECT " + plain_feature_columns(C360_COLUMNS) + " FROM c360")

P4 = "DECIMAL(12,4)"
MEASURES = {
    "avg_revenue_per_customer": rnd(mean("total_revenue"), 2), "avg_recency_days": rnd(mean("recency_days"), 1),
    "avg_total_invoices": rnd(mean("total_invoices"), 2), "avg_health_score": rnd(mean("customer_health_score", P4), 2),
    "avg_churn_probability": rnd(mean("churn_probability", P4), 4), "retention_target_count": big("SUM(retention_target_flag)"),
    "vip_count": big("SUM(vip_flag)"),
}


def summary_sql(dim: str, measures: list[str], share: bool = True, name: str | None = None) -> str:
    head = [f"{dim} AS {name or dim}", "COUNT(*) AS customer_count"]
    if share:
        head.append(f"{rnd(pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 2)} AS customer_pct")
    head += [f"{rnd(money('total_revenue'), 2)} AS total_revenue", f"{rnd(pct(money('total_revenue'), ALL_REVENUE), 2)} AS revenue_pct"]
    return f"SELECT {', '.join(head + [f'{MEASURES[m]} AS {m}' for m in measures])} FROM c360 GROUP BY 1"


FLAGS = ["retention_target_count", "vip_count"]
sql("health_tier_summary", C360, summary_sql("health_tier", ["avg_revenue_per_customer", "avg_health_score", "avg_churn_probability", *FLAGS]))
sql("rfm_segment_summary", C360, summary_sql(
    "rfm_segment", ["avg_revenue_per_customer", "avg_recency_days", "avg_total_invoices", "avg_churn_probability", *FLAGS]))
sql("churn_risk_summary", C360, summary_sql("churn_risk_tier", ["avg_churn_probability", "avg_health_score", *FLAGS]))
sql("country_revenue", C360, summary_sql("country_mode", ["avg_revenue_per_customer", *FLAGS, "avg_churn_probability"], False, "country"))
sql("action_priority_summary", C360, summary_sql("action_priority", ["avg_revenue_per_customer", "avg_churn_probability", *FLAGS]))
sql("customer_value_tiers", C360, summary_sql(
    "customer_value_tier", ["avg_revenue_per_customer", "avg_health_score", "avg_churn_probability", *FLAGS]))
GOOD, RISKY = "health_tier IN ('Excellent', 'Healthy')", "churn_risk_tier IN ('Critical Risk', 'High Risk')"


def money_if(condition: str) -> str:
    return f"COALESCE(CAST(SUM(CAST(total_revenue AS DECIMAL(20,4))) FILTER ({condition}) AS DOUBLE), 0.0)"


sql("executive_kpis", C360, f"""SELECT COUNT(*) AS total_customers, {rnd(money('total_revenue'), 2)} AS total_revenue,
 {rnd(mean('total_revenue'), 2)} AS avg_revenue_per_customer, {rnd('quantile_cont(total_revenue, 0.5)', 2)} AS median_revenue_per_customer,
 {big('SUM(total_invoices)')} AS total_invoices, {rnd(mean('total_invoices'), 2)} AS avg_invoices_per_customer,
 {big('SUM(retention_target_flag)')} AS retention_targets, {big('SUM(vip_flag)')} AS vip_customers,
 COUNT(*) FILTER (model_scored = 1) AS model_scored_customers, COUNT(*) FILTER (model_scored = 0) AS not_scored_customers,
 COUNT(*) FILTER ({GOOD}) AS excellent_healthy_customers, {rnd(money_if(GOOD), 2)} AS excellent_healthy_revenue,
 {rnd(pct(money_if(GOOD), money('total_revenue')), 2)} AS excellent_healthy_revenue_pct,
 COUNT(*) FILTER ({RISKY}) AS critical_high_risk_customers, {rnd(money_if(RISKY), 2)} AS critical_high_risk_revenue FROM c360""")
sql("top_customers", C360, f"""SELECT customer_id, country_mode AS country, {rnd('total_revenue', 2)} AS total_revenue, total_invoices, recency_days,
 rfm_segment, health_tier, {rnd('customer_health_score', 2)} AS customer_health_score, {rnd('churn_probability', 4)} AS churn_probability,
 churn_risk_tier, action_priority, customer_value_tier, retention_target_flag, vip_flag FROM c360
 ORDER BY {rnd('c360.total_revenue', 2)} DESC, customer_id LIMIT 50""")


def domain_cte(labels: list[str]) -> str:
    return "dom AS (SELECT * FROM (VALUES " + ", ".join(f"('{v}', CAST({i} AS BIGINT))" for i, v in enumerate(labels, 1)) + ") AS t(label, ord))"


sql("health_tier_counts", [*C360, domain_cte(fv.HEALTH_ORDER)], f"""SELECT label AS health_tier, COUNT(customer_id) AS customer_count,
 {rnd(pct('COUNT(customer_id)', '(SELECT COUNT(*) FROM c360)'), 2)} AS customer_percent, ord FROM dom LEFT JOIN c360 ON label = health_tier GROUP BY label, ord""")
sql("health_tier_revenue", [*C360, domain_cte(fv.HEALTH_ORDER)], f"""SELECT label AS health_tier, {rnd(money('total_revenue'), 2)} AS total_revenue,
 {rnd(pct(money('total_revenue'), f"(SELECT {money('total_revenue')} FROM c360)"), 2)} AS revenue_percent,
 {rnd(mean('total_revenue'), 2)} AS avg_revenue_per_customer, {rnd(mean('churn_probability', P4), 4)} AS avg_churn_probability,
 {big('SUM(retention_target_flag)')} AS retention_target_count, {big('SUM(vip_flag)')} AS vip_count, ord
 FROM dom LEFT JOIN c360 ON label = health_tier GROUP BY label, ord""")
sql("action_plan", [*C360, domain_cte(fv.PRIORITY_ORDER)], f"""SELECT label AS action_priority, NULLIF(COUNT(customer_id), 0) AS customer_count,
 {rnd(money('total_revenue'), 2)} AS total_revenue, {rnd(mean('churn_probability', P4), 4)} AS avg_churn_probability,
 {case_of('label', fv.PRIORITY_STRATEGIES)} AS recommended_strategy, arg_min(final_recommended_action, customer_id) AS first_action, ord
 FROM dom LEFT JOIN c360 ON label = action_priority GROUP BY label, ord""")
REPORT_ROWS = {
    "executive_kpis": "SELECT 1", "health_tier_summary": "SELECT DISTINCT health_tier FROM c360", "rfm_segment_summary": "SELECT DISTINCT rfm_segment FROM c360",
    "churn_risk_summary": "SELECT DISTINCT churn_risk_tier FROM c360", "country_revenue": "SELECT DISTINCT country_mode FROM c360",
    "top_customers": "SELECT customer_id FROM c360 LIMIT 50", "action_priority_summary": "SELECT DISTINCT action_priority FROM c360",
    "customer_value_tiers": "SELECT DISTINCT customer_value_tier FROM c360", "monthly_revenue": "SELECT DISTINCT ym FROM sales",
    "product_revenue": "SELECT DISTINCT stock_code, description FROM sales LIMIT 50",
}
sql("report_shapes", C360, " UNION ALL ".join(
    f"SELECT '{k}' AS report, COUNT(*) AS rows, COUNT(*) > 0 AS passed FROM ({v})" for k, v in REPORT_ROWS.items()))
sql("filtered_customers", C360, """SELECT customer_id, health_tier, churn_risk_tier, total_revenue, churn_probability FROM c360
 WHERE health_tier IN ('Excellent', 'Healthy', 'Watchlist') AND churn_risk_tier IN ('Low Risk', 'Medium Risk', 'Not Scored')
 AND total_revenue BETWEEN 500000 AND 3000000 AND (model_scored = 0 OR churn_probability BETWEEN 0.05 AND 0.5)""")
sql("customer_profiles", C360, f"""SELECT customer_id, CAST(r_score AS DOUBLE) AS recency, CAST(f_score AS DOUBLE) AS frequency,
 CAST(m_score AS DOUBLE) AS monetary, {rnd('customer_health_score / 20.0', 6)} AS health,
 {rnd('CASE WHEN model_scored = 1 THEN (1.0 - churn_probability) * 5.0 ELSE 2.5 END', 6)} AS churn_safety FROM c360""")
sql("segment_health_matrix", C360, "SELECT rfm_segment, health_tier, COUNT(*) AS customers FROM c360 GROUP BY 1, 2")
sql("value_tier_counts", C360, f"""SELECT customer_value_tier, COUNT(*) AS customer_count,
 {rnd(pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 6)} AS percentage FROM c360 GROUP BY 1""")
sql("vip_revenue", C360, f"SELECT rfm_segment, {rnd(money('total_revenue'), 2)} AS total_revenue FROM c360 WHERE vip_flag = 1 GROUP BY 1")
sql("retention_revenue", C360, f"SELECT health_tier, {rnd(money('total_revenue'), 2)} AS total_revenue FROM c360 WHERE retention_target_flag = 1 GROUP BY 1")
sql("top_segment", C360, f"SELECT rfm_segment, {money('total_revenue')} AS total_revenue FROM c360 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
sql("top_risk_customers", C360, """SELECT customer_id, country_mode, total_revenue, rfm_segment, health_tier, churn_probability, churn_risk_tier,
 action_priority, final_recommended_action FROM c360 WHERE model_scored = 1 ORDER BY churn_probability DESC, customer_id LIMIT 20""")
SUMMARISED = ["total_revenue", "total_invoices", "recency_days", "customer_tenure_days"]
sql("feature_summary", FEATURES, " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, COUNT(*) AS n, CAST(MIN({m}) AS DOUBLE) AS min, CAST(MAX({m}) AS DOUBLE) AS max,
 {rnd(f'quantile_cont(CAST({m} AS DOUBLE), 0.5)', 4)} AS median, {rnd(mean(m), 4)} AS mean FROM features""" for m in SUMMARISED))
sql("top_feature_customers", FEATURES, """SELECT customer_id, total_revenue, total_invoices, recency_days FROM features
 ORDER BY total_revenue DESC, customer_id LIMIT 10""")
sql("segment_recency_histogram", RFM, histogram_sql("rfm", "recency_days", 60, "MAX(recency_days)", "rfm_segment"))
sql("segment_frequency_histogram", RFM, histogram_sql("rfm", "total_invoices", 50, "floor(quantile_cont(total_invoices, 0.95))", "rfm_segment"))
sql("segment_monetary_histogram", RFM, histogram_sql("rfm", "total_revenue", 60, "quantile_cont(total_revenue, 0.95)", "rfm_segment"))
sql("churn_probability_histogram", [*C360, "sc AS (SELECT * FROM c360 WHERE model_scored = 1)"],
    histogram_sql("sc", "churn_probability", 40, "MAX(churn_probability)"))
sql("segment_mean_revenue", C360, f"SELECT rfm_segment, {rnd(mean('total_revenue'), 4)} AS avg_total_revenue FROM c360 GROUP BY 1")
sql("high_risk_export", C360, f"SELECT customer_id, churn_risk_tier, churn_probability, total_revenue FROM c360 WHERE {RISKY}")
sql("vip_export", C360, "SELECT customer_id, rfm_segment, customer_value_tier, total_revenue FROM c360 WHERE vip_flag = 1")
sql("action_export", C360, f"""SELECT action_priority, COUNT(*) AS customer_count, {money('total_revenue')} AS total_revenue,
 {rnd(mean('churn_probability', P4), 6)} AS avg_churn_probability FROM c360 GROUP BY 1""")
sql("domain_values", C360, " UNION ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM c360 WHERE {c} IS NOT NULL"
    for c in ["health_tier", "rfm_segment", "churn_risk_tier", "action_priority", "customer_value_tier", "country_mode"]))
SALES_TOTAL = f"(SELECT {money('revenue')} FROM sales)"
sql("reconcile_revenue", C360, f"""SELECT {money('total_revenue')} AS left_total, {SALES_TOTAL} AS right_total,
 ABS({money('total_revenue')} - {SALES_TOTAL}) AS difference, ABS({money('total_revenue')} - {SALES_TOTAL}) < 1 AS passed FROM c360""")
sql("join_contract", C360, """SELECT (SELECT COUNT(*) FROM features) AS rows_before, COUNT(*) AS rows_after, COUNT(DISTINCT customer_id) AS keys_after,
 (SELECT COUNT(*) FROM features) = COUNT(*) AND COUNT(*) = COUNT(DISTINCT customer_id) AS passed FROM c360""")

# ---- complaint text -----------------------------------------------------------------------------


def scrub(x: str, patterns: list[str]) -> str:
    out = f"lower({x})"
    for p in patterns:
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    return f"trim(regexp_replace({out}, '{fv.SPACE_PATTERN}', ' ', 'g'))"


CLEAN1 = scrub("text", [fv.URL_PATTERN, fv.EMAIL_PATTERN, fv.NON_LETTER_PATTERN])
CLEAN2 = scrub("text", [fv.URL_PATTERN, fv.EMAIL_PATTERN, fv.REDACTION_PATTERN, fv.NON_LETTER_PATTERN])


def split_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def hits(words: str, vocabulary: list[str]) -> str:
    return f"len(list_filter({words}, lambda w: w IN ({quoted(vocabulary)})))"


TOPIC = "CASE " + " ".join(f"WHEN n_chars < {200 * 2**i} THEN {i + 1}" for i in range(8)) + " END"
COMPLAINTS = f"""cc AS (SELECT d.doc_id AS complaint_id, lang AS product, source AS issue, text,
 CASE WHEN toxic = 1 THEN 'Phone' WHEN toxic = 0 THEN 'Web' END AS submitted_via,
 CASE WHEN quality = 1 THEN 'Yes' WHEN quality = 0 THEN 'No' END AS timely_response, {TOPIC} AS dominant_topic
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
CLEANED = f"cleaned AS (SELECT * FROM (SELECT *, {CLEAN1} AS clean_text FROM cc) WHERE clean_text <> '')"
POLARITY = "CASE WHEN sentiment_score > 0 THEN 'Positive' WHEN sentiment_score < 0 THEN 'Negative' ELSE 'Neutral' END"
SCORED = [COMPLAINTS, CLEANED, f"""scored AS (SELECT *, {POLARITY} AS sentiment FROM (SELECT *,
 {big(f"{hits('ws', POSITIVE)} - {hits('ws', NEGATIVE)}")} AS sentiment_score FROM (SELECT *, {split_words('clean_text')} AS ws FROM cleaned)))"""]
sql("text_clean", SCORED[:2], "SELECT complaint_id, clean_text FROM cleaned")
sql("text_clean_redacted", [COMPLAINTS], f"SELECT * FROM (SELECT complaint_id, {CLEAN2} AS clean_text FROM cc) WHERE length(clean_text) >= 20")
sql("token_lists", [COMPLAINTS, f"tk AS (SELECT complaint_id, list_filter(string_split({CLEAN2}, ' '), lambda w: length(w) >= 3) AS t FROM cc)"],
    f"SELECT complaint_id, {big('len(t)')} AS n_tokens, array_to_string(t, ' ') AS tokens FROM tk WHERE len(t) >= 5")
SENTENCES = [
    COMPLAINTS, f"tk AS (SELECT complaint_id, list_filter(string_split({CLEAN2}, ' '), lambda w: length(w) >= 3) AS t FROM cc)",
    "st AS (SELECT complaint_id, t FROM tk WHERE len(t) >= 5)",
    "wd AS (SELECT complaint_id, generate_subscripts(t, 1) AS i, unnest(t) AS word FROM st)",
    "voc AS (SELECT word FROM wd GROUP BY 1 HAVING COUNT(*) >= 5)",
    "kw AS (SELECT * FROM wd WHERE word IN (SELECT word FROM voc))",
    """pr AS (SELECT a.word, b.word AS context, SUM(6 - ABS(a.i - b.i)) AS weight FROM kw a JOIN kw b
 ON a.complaint_id = b.complaint_id AND b.i BETWEEN a.i - 5 AND a.i + 5 AND a.i <> b.i GROUP BY 1, 2)""",
]
sql("word_context_totals", SENTENCES, f"SELECT word, COUNT(*) AS contexts, {big('SUM(weight)')} AS weight FROM pr GROUP BY 1")
MEASURED = f"measured AS (SELECT complaint_id, {big('length(text)')} AS text_length, {big('len(' + split_words('clean_text') + ')')} AS word_count FROM cleaned)"
sql("text_measures", [*SCORED[:2], MEASURED], "SELECT * FROM measured")
sql("text_statistics", [*SCORED[:2], MEASURED], " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, COUNT(*) AS n, CAST(MIN({m}) AS DOUBLE) AS min, CAST(MAX({m}) AS DOUBLE) AS max,
 {rnd(ratio(f'SUM({m})', 'COUNT(*)'), 6)} AS mean, {rnd(f'quantile_cont(CAST({m} AS DOUBLE), 0.5)', 6)} AS median FROM measured"""
    for m in ["text_length", "word_count"]))
sql("usable_complaints", [COMPLAINTS], """SELECT complaint_id, product, issue, submitted_via, timely_response, text AS complaint_what_happened
 FROM cc WHERE TRIM(text) <> ''""")
sql("lexicon_sentiment", SCORED, "SELECT complaint_id, sentiment_score, sentiment FROM scored")
RAW_WORDS = f"list_filter(string_split_regex(lower(text), '{fv.SPACE_PATTERN}'), lambda w: w <> '')"
RAW_SCORED = [COMPLAINTS, f"""rs AS (SELECT *, {POLARITY} AS sentiment FROM (SELECT *, {hits('ws', POSITIVE)} AS p, {hits('ws', NEGATIVE)} AS n,
 {hits('ws', POSITIVE)} - {hits('ws', NEGATIVE)} AS sentiment_score FROM (SELECT *, {RAW_WORDS} AS ws FROM cc)))"""]
sql("lexicon_sentiment_raw", RAW_SCORED, "SELECT complaint_id, sentiment FROM rs")
sql("sentiment_distribution", SCORED, f"""SELECT sentiment, COUNT(*) AS complaints, {rnd(pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 6)} AS percentage
 FROM scored GROUP BY 1""")
NEG, POS = "COUNT(*) FILTER (sentiment = 'Negative')", "COUNT(*) FILTER (sentiment = 'Positive')"


def sentiment_sql(source: str, keys: str, positive: bool = False) -> str:
    extra = f"{POS} AS positive_complaints, " if positive else ""
    return f"""SELECT {keys}, COUNT(complaint_id) AS complaints, {NEG} AS negative_complaints, {extra}
 {rnd(pct(NEG, 'COUNT(complaint_id)'), 6)} AS negative_rate FROM {source} GROUP BY {keys}"""


sql("sentiment_by_product", SCORED, sentiment_sql("scored", "product", True))
sql("sentiment_by_channel", SCORED, sentiment_sql("scored", "submitted_via"))
sql("complaint_categories", SCORED, sentiment_sql("scored", "product, issue"))
sql("channel_sample", [COMPLAINTS], f"""SELECT complaint_id, issue, product FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY issue ORDER BY complaint_id) AS r
 FROM cc WHERE TRIM(text) <> '' AND issue IS NOT NULL) WHERE r <= {CHANNEL_ROWS}""")
sql("channel_sample_default", [COMPLAINTS], """SELECT complaint_id, issue, product FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY issue ORDER BY complaint_id) AS r
 FROM cc WHERE TRIM(text) <> '' AND issue IS NOT NULL) WHERE r <= 5000""")
sql("channel_counts", [COMPLAINTS], "SELECT COALESCE(submitted_via, 'Unknown') AS submitted_via, COUNT(*) AS complaints FROM cc WHERE TRIM(text) <> '' GROUP BY 1")


def tfidf_ctes(source: str, min_df: int, max_df: float, features: int, sublinear: bool = False) -> list[str]:
    tf = "(1.0 + ln(tf))" if sublinear else "CAST(tf AS DOUBLE)"
    return [
        f"w AS (SELECT complaint_id, list_filter(string_split(clean_text, ' '), lambda x: length(x) >= 2 AND x NOT IN ({quoted(STOP_WORDS)})) AS ws FROM {source})",
        """terms AS (SELECT complaint_id, unnest(ws) AS term FROM w UNION ALL
 SELECT complaint_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w)""",
        "tfs AS (SELECT complaint_id, term, COUNT(*) AS tf FROM terms GROUP BY 1, 2)",
        f"nd AS (SELECT COUNT(*) AS n FROM {source})",
        f"""vocab AS (SELECT term, COUNT(*) AS df FROM tfs GROUP BY 1 HAVING COUNT(*) >= {min_df} AND COUNT(*) <= {max_df} * (SELECT n FROM nd)
 ORDER BY SUM(tf) DESC, term LIMIT {features})""",
        f"weighted AS (SELECT complaint_id, term, {tf} * (ln((1.0 + (SELECT n FROM nd)) / (1.0 + df)) + 1.0) AS x FROM tfs JOIN vocab USING (term))",
        "unit AS (SELECT complaint_id, term, x / sqrt(SUM(x * x) OVER (PARTITION BY complaint_id)) AS weight FROM weighted)",
    ]


def top_terms_sql(where: str = "") -> str:
    score = rnd("SUM(weight) / (SELECT n FROM nd)", 9)
    return f"SELECT term, {score} AS tfidf_score FROM unit {where} GROUP BY 1 ORDER BY tfidf_score DESC, term LIMIT 100"


sql("tfidf_top_terms", [COMPLAINTS, CLEANED, *tfidf_ctes("cleaned", 10, 0.90, 5000)], top_terms_sql())
sql("tfidf_negative", [*SCORED, "neg AS (SELECT * FROM scored WHERE sentiment = 'Negative')", *tfidf_ctes("neg", 5, 0.95, 5000)],
    top_terms_sql("WHERE (SELECT n FROM nd) >= 10"))
REDACTED = f"red AS (SELECT * FROM (SELECT complaint_id, {CLEAN2} AS clean_text FROM cc) WHERE length(clean_text) >= 20)"
sql("tfidf_sublinear", [COMPLAINTS, REDACTED, *tfidf_ctes("red", 15, 0.90, 10_000, True)],
    f"SELECT complaint_id, term, {rnd('weight', 9)} AS weight FROM unit")
sql("json_hits", [], """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, json_extract_string(props, '$.k') AS k
 FROM events, (VALUES (1), (2)) AS twice(i)""")

# ---- themes -------------------------------------------------------------------------------------

THEME = f"{case_of('dominant_topic', fv.THEMES, repr(fv.OTHER_THEME))} AS theme, COALESCE(lower(trim(timely_response)) = 'yes', false) AS timely_yes"
THEMED = [*RAW_SCORED, f"th AS (SELECT *, {THEME} FROM rs)"]
PLAIN = [COMPLAINTS, f"th AS (SELECT *, {THEME} FROM cc)"]
TIMELY = "COUNT(*) FILTER (timely_yes)"
METRICS = f"""tm AS (SELECT theme, COUNT(*) AS complaints, {NEG} AS negative_complaints, {POS} AS positive_complaints, {TIMELY} AS timely_responses,
 {pct(NEG, 'COUNT(*)')} AS negative_rate, {pct(POS, 'COUNT(*)')} AS positive_rate, {pct(TIMELY, 'COUNT(*)')} AS timely_response_rate,
 {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS volume_share FROM th GROUP BY 1)"""
RATES = ", ".join(f"{rnd(c, 6)} AS {c}" for c in ["negative_rate", "positive_rate", "timely_response_rate", "volume_share"])
COUNTS = "theme, complaints, negative_complaints, positive_complaints, timely_responses"
sql("theme_metrics", [*THEMED, METRICS], f"SELECT {COUNTS}, {RATES} FROM tm")


def scaled(x: str) -> str:
    return f"CASE WHEN MAX({x}) OVER () = MIN({x}) OVER () THEN 0.5 ELSE ({x} - MIN({x}) OVER ()) / (MAX({x}) OVER () - MIN({x}) OVER ()) END"


PRIORITIES = [*THEMED, METRICS, f"""p1 AS (SELECT *, CAST({scaled('CAST(complaints AS DOUBLE)')} AS DOUBLE) AS volume_score,
 CAST({scaled('negative_rate')} AS DOUBLE) AS negative_score, CAST({scaled('(100.0 - timely_response_rate)')} AS DOUBLE) AS response_gap_score FROM tm)""",
              "p2 AS (SELECT *, (0.4 * volume_score + 0.4 * negative_score + 0.2 * response_gap_score) * 100.0 AS cx_priority_score FROM p1)",
              f"""p3 AS (SELECT *, RANK() OVER (ORDER BY cx_priority_score DESC) AS priority_rank,
 {bucket('cx_priority_score', [-1e308, 33, 66, 0], fv.PRIORITY_LABELS)} AS priority_tier FROM p2)"""]
PARTS = ", ".join(f"{rnd(c, 6)} AS {c}" for c in ["volume_score", "negative_score", "response_gap_score", "cx_priority_score"])
sql("cx_priority", PRIORITIES, f"SELECT {COUNTS}, {RATES}, {PARTS}, priority_rank, priority_tier FROM p3")
sql("cx_kpis", PRIORITIES, f"""SELECT {big('SUM(complaints)')} AS total_complaints, COUNT(*) FILTER (priority_tier = 'High Priority') AS high_priority_themes,
 (SELECT theme FROM p3 ORDER BY cx_priority_score DESC, theme LIMIT 1) AS top_theme, {rnd('MAX(cx_priority_score)', 6)} AS top_score FROM p3""")
sql("product_theme", THEMED, sentiment_sql("th", "product, theme"))
sql("issue_theme", THEMED, sentiment_sql("th", "issue, theme"))
sql("topic_distribution", [COMPLAINTS], f"""SELECT {big('dominant_topic')} AS topic_id, COUNT(*) AS complaints,
 {rnd(pct('COUNT(*)', '(SELECT COUNT(*) FROM cc)'), 6)} AS percentage FROM cc WHERE dominant_topic IS NOT NULL GROUP BY 1""")
sql("topic_share", [COMPLAINTS], f"""SELECT product, {big('dominant_topic')} AS dominant_topic, COUNT(*) AS complaints,
 {big('SUM(COUNT(*)) OVER (PARTITION BY product)')} AS product_total,
 {rnd(pct('COUNT(*)', 'SUM(COUNT(*)) OVER (PARTITION BY product)'), 6)} AS topic_share_pct FROM cc GROUP BY 1, 2""")
sql("topic_by_issue", [COMPLAINTS], f"SELECT issue, {big('dominant_topic')} AS dominant_topic, COUNT(*) AS complaints FROM cc GROUP BY 1, 2")
sql("topic_by_response", [COMPLAINTS], f"SELECT {big('dominant_topic')} AS dominant_topic, timely_response, COUNT(*) AS complaints FROM cc GROUP BY 1, 2")


def cell_ctes(source: str, a: str, b: str) -> list[str]:
    return [
        f"tab AS (SELECT {a} AS a, {b} AS b FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)",
        """cells AS (SELECT x.a, y.b, COUNT(t.a) AS o FROM (SELECT DISTINCT a FROM tab) x CROSS JOIN (SELECT DISTINCT b FROM tab) y
 LEFT JOIN tab t ON t.a = x.a AND t.b = y.b GROUP BY 1, 2)""",
        """ex AS (SELECT *, CAST(SUM(o) OVER (PARTITION BY a) AS DOUBLE) * SUM(o) OVER (PARTITION BY b) / SUM(o) OVER () AS e FROM cells)""",
    ]


STEPS = 4000


def t_tail(t: str, dof: str) -> str:
    """Two-sided tail of Student's t: Simpson's rule on the angle whose tangent is t / sqrt(dof)."""
    angle = f"atan(ABS({t}) / sqrt({dof}))"
    weights = f"CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(0, {STEPS + 1}), lambda i: ({weights}) * pow(cos({angle} * i / {STEPS}.0), {dof} - 1.0))) * {angle} / {3 * STEPS}.0"
    tail = f"GREATEST(0.0, 1.0 - 2.0 * exp(lgamma(({dof} + 1.0) / 2.0) - lgamma({dof} / 2.0)) / sqrt(pi()) * {area})"
    return f"CASE WHEN ({t}) IS NOT NULL AND ({dof}) IS NOT NULL THEN {tail} END"


def chi_tail(x: str, dof: str) -> str:
    """Upper tail of chi-square from the series of the lower one, its terms summed as exponentials of logarithms."""
    terms = f"list_transform(range(0, {STEPS}), lambda i: exp(({dof} / 2.0 + i) * ln(({x}) / 2.0) - ({x}) / 2.0 - lgamma({dof} / 2.0 + i + 1.0)))"
    return f"CASE WHEN ({x}) <= 0 OR {dof} = 0 THEN 1.0 WHEN ({x}) IS NOT NULL THEN GREATEST(0.0, 1.0 - list_sum({terms})) END"


def chi_test_sql(name: str, source: str, a: str, b: str, number: int) -> str:
    """The test row of one pair of columns, with its own copy of the cells."""
    ctes = ", ".join(x.replace("tab", f"tab{number}").replace("cells", f"cells{number}").replace("ex AS", f"ex{number} AS") for x in cell_ctes(source, a, b))
    n, r, c = "CAST(SUM(o) AS DOUBLE)", "COUNT(DISTINCT a)", "COUNT(DISTINCT b)"
    parts = f"""SELECT {n} AS n, {r} AS r, {c} AS c, SUM((o - e) * (o - e) / e) AS plain,
 SUM((ABS(o - e) - LEAST(0.5, ABS(o - e))) ** 2 / e) AS yates FROM ex{number}"""
    chosen = f"SELECT *, (r - 1) * (c - 1) AS dof, CASE WHEN (r - 1) * (c - 1) = 1 THEN yates ELSE plain END AS chi FROM ({parts})"
    v = "sqrt(GREATEST(0.0, plain / n - CAST(dof AS DOUBLE) / (n - 1)) / LEAST(r - 1, c - 1))"
    return f"""SELECT * FROM (WITH {ctes} SELECT '{name}' AS analysis, {rnd('chi', 6)} AS chi_square, dof AS degrees_of_freedom,
 {rnd('p', 6)} AS p_value, {rnd(v, 6)} AS cramers_v, p < 0.05 AS statistically_significant FROM (SELECT *, {chi_tail('chi', 'dof')} AS p FROM ({chosen})))"""


def chi_sql() -> str:
    n, r, c = "CAST(SUM(o) AS DOUBLE)", "COUNT(DISTINCT a)", "COUNT(DISTINCT b)"
    plain = "SUM((o - e) * (o - e) / e)"
    yates = "SUM((ABS(o - e) - LEAST(0.5, ABS(o - e))) ** 2 / e)"
    dof = f"({r} - 1) * ({c} - 1)"
    v = f"sqrt(GREATEST(0.0, {plain} / {n} - CAST({dof} AS DOUBLE) / ({n} - 1)) / LEAST({r} - 1, {c} - 1))"
    return f"""SELECT {big('SUM(o)')} AS n, {r} AS n_rows, {c} AS n_cols, {rnd(f'CASE WHEN {dof} = 1 THEN {yates} ELSE {plain} END', 6)} AS chi_square,
 {dof} AS degrees_of_freedom, {rnd(v, 6)} AS cramers_v FROM ex"""


PT = [*PLAIN, *cell_ctes("th", "product", "theme")]
sql("crosstab", PT, "SELECT a AS product, b AS theme, o AS observed FROM cells")
sql("chi_square_stat", PT, chi_sql())
sql("chi_square_tests", PLAIN, chi_test_sql("CX theme vs response timeliness", "th", "theme", "timely_yes", 1)
    + " UNION ALL " + chi_test_sql("Product vs CX theme", "th", "product", "theme", 2))
sql("timeliness_chi_square_stat", [*PLAIN, *cell_ctes("th", "theme", "timely_yes")], chi_sql())
sql("yates_chi_square_stat", [*PLAIN, "fl AS (SELECT *, submitted_via IS NOT NULL AS known FROM th)", *cell_ctes("fl", "known", "timely_yes")], chi_sql())
Z = f"{fv.WILSON_Z!r}::DOUBLE"
CENTER = f"((p + {Z} * {Z} / (2.0 * n)) / (1.0 + {Z} * {Z} / n))"
MARGIN = f"({Z} * sqrt((p * (1.0 - p) + {Z} * {Z} / (4.0 * n)) / n) / (1.0 + {Z} * {Z} / n))"
sql("wilson_ci", [*PLAIN, f"""lr AS (SELECT theme, COUNT(*) AS complaints, COUNT(*) FILTER (NOT timely_yes) AS not_timely, {TIMELY} AS timely,
 {ratio('COUNT(*) FILTER (NOT timely_yes)', 'COUNT(*)')} AS p, CAST(COUNT(*) AS DOUBLE) AS n FROM th GROUP BY 1)"""],
    f"""SELECT theme, complaints, not_timely, timely, {rnd('p * 100.0', 6)} AS not_timely_rate_pct,
 {rnd(f'GREATEST({CENTER} - {MARGIN}, 0.0) * 100.0', 6)} AS ci_95_lower_pct, {rnd(f'LEAST({CENTER} + {MARGIN}, 1.0) * 100.0', 6)} AS ci_95_upper_pct FROM lr""")
sql("response_performance", PLAIN, f"""SELECT product, COUNT(*) AS complaints, {TIMELY} AS timely_responses, {rnd(pct(TIMELY, 'COUNT(*)'), 6)} AS timely_rate_pct,
 {rnd(f"100.0 - {pct(TIMELY, 'COUNT(*)')}", 6)} AS not_timely_rate_pct FROM th GROUP BY 1""")


def residual_ctes(a: str) -> list[str]:
    return [*PLAIN, *cell_ctes("th", a, "theme"), f"""rc AS (SELECT a, b, o, {rnd('e', 2)} AS e2, {rnd('(o - e) / sqrt(e)', 4)} AS residual,
 {rnd('ABS((o - e) / sqrt(e))', 4)} AS size FROM ex)""",
            f"""res AS (SELECT a AS {a}, b AS theme, o AS observed, e2 AS expected, residual, size AS abs_residual,
 CASE WHEN size >= 3 THEN 'Strong' WHEN size >= 2 THEN 'Notable' ELSE 'Normal' END AS association_strength,
 CASE WHEN residual > 0 THEN 'Higher than expected' WHEN residual < 0 THEN 'Lower than expected' ELSE 'Expected' END AS direction FROM rc)"""]


sql("residuals", residual_ctes("product"), "SELECT * FROM res")
sql("friction_points", residual_ctes("issue"), "SELECT * FROM res WHERE residual >= 2 ORDER BY residual DESC, issue, theme LIMIT 20")
sql("friction_matrix", [*residual_ctes("issue"), "top AS (SELECT * FROM res WHERE residual >= 2 ORDER BY residual DESC, issue, theme LIMIT 15)"],
    """SELECT x.issue, y.theme, COALESCE(MAX(t.residual), 0.0) AS residual FROM (SELECT DISTINCT issue FROM top) x
 CROSS JOIN (SELECT DISTINCT theme FROM top) y LEFT JOIN top t ON t.issue = x.issue AND t.theme = y.theme GROUP BY 1, 2""")
sql("theme_concentration", PLAIN, f"""SELECT product, theme, COUNT(*) AS complaints,
 {rnd(pct('COUNT(*)', 'SUM(COUNT(*)) OVER (PARTITION BY product)'), 6)} AS theme_share_pct FROM th WHERE product IS NOT NULL GROUP BY 1, 2""")

# ---- statistics ---------------------------------------------------------------------------------


def long_cte(metrics: list[str], keep: str = "customer_id") -> str:
    return "lm AS (" + " UNION ALL ".join(
        f"SELECT {keep}, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM c360 WHERE {m} IS NOT NULL" for m in metrics) + ")"


sql("describe_metrics", [*C360, long_cte(fv.DESCRIBED_METRICS)], f"""SELECT metric, COUNT(*) AS n, {rnd('AVG(v)', 6)} AS mean,
 {rnd('quantile_cont(v, 0.5)', 6)} AS median, {rnd('stddev_samp(v)', 6)} AS std, {rnd('MIN(v)', 6)} AS min, {rnd('MAX(v)', 6)} AS max
 FROM lm GROUP BY 1 HAVING COUNT(*) >= 2""")
WELCH = """SELECT metric, n1, n2, {m1} AS mean1, {m2} AS mean2, {d} AS difference, {t} AS t_statistic, {f} AS degrees_of_freedom, {c} AS cohens_d,
 CASE WHEN cd IS NULL THEN NULL WHEN ABS(cd) < 0.2 THEN 'Negligible' WHEN ABS(cd) < 0.5 THEN 'Small' WHEN ABS(cd) < 0.8 THEN 'Medium' ELSE 'Large' END AS effect_interpretation
 FROM (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS cd FROM mo)"""
WELCH = WELCH.format(
    m1=rnd("m1", 6), m2=rnd("m2", 6), d=rnd("m1 - m2", 6), t=rnd("(m1 - m2) / sqrt(v1 / n1 + v2 / n2)", 6),
    f=rnd("(v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))", 6), c=rnd("cd", 6),
)


def tested(extra: str = "") -> str:
    """Welch's test with its p-value on the unrounded statistic."""
    full = "(m1 - m2) / sqrt(v1 / n1 + v2 / n2)"
    dof = "(v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))"
    return f"""SELECT w.*, {rnd('p', 6)} AS p_value, p < 0.05 AS statistically_significant{extra} FROM ({WELCH}) w
 JOIN (SELECT metric, {t_tail('t', 'f')} AS p FROM (SELECT metric, {full} AS t, {dof} AS f FROM mo)) USING (metric)"""


def moment_cte(group: str) -> str:
    return f"""mo AS (SELECT metric, COUNT(*) FILTER ({group}) AS n1, COUNT(*) FILTER (NOT {group}) AS n2, AVG(v) FILTER ({group}) AS m1,
 AVG(v) FILTER (NOT {group}) AS m2, var_samp(v) FILTER ({group}) AS v1, var_samp(v) FILTER (NOT {group}) AS v2 FROM lm GROUP BY 1)"""


sql("welch_moments", [*C360, long_cte(["customer_health_score"], "has_returned"), moment_cte("(has_returned = 1)")], WELCH)
GROUPED = long_cte(fv.RISK_GROUP_METRICS, "churn_risk_tier").replace("FROM c360 WHERE", "FROM c360 WHERE churn_risk_tier <> 'Not Scored' AND")
sql("risk_group_tests", [*C360, GROUPED, moment_cte("(churn_risk_tier IN ('High Risk', 'Critical Risk'))")], tested())
sql("returns_vs_health", [*C360, long_cte(["customer_health_score"], "has_returned"), moment_cte("(has_returned = 1)")],
    tested(f", CASE WHEN p < 0.05 THEN '{fv.HEALTH_DIFFERS}' ELSE '{fv.HEALTH_SAME}' END AS conclusion"))
sql("risk_group_moments", [*C360, GROUPED, moment_cte("(churn_risk_tier IN ('High Risk', 'Critical Risk'))")], WELCH)
sql("spearman_matrix", C360, " UNION ALL ".join(
    f"""SELECT '{a}' AS metric_a, '{b}' AS metric_b, {rnd('corr(ra, rb)', 9)} AS correlation FROM (SELECT {average_rank(a)} AS ra, {average_rank(b)} AS rb
 FROM c360 WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""" for a in fv.CORRELATED_METRICS for b in fv.CORRELATED_METRICS))

def solved(name: str, start: str, n: int, carried: str) -> list[str]:
    """CTEs ``name``0 to ``name``n: ``start`` selects rows m (a list of n rows) whose first n columns become the identity, one after another."""
    ctes = [f"{name}0 AS MATERIALIZED ({start})"]
    for k in range(1, n + 1):
        row = f"list_transform(range(1, len(m[{k}]) + 1), lambda j: m[{k}][j] / m[{k}][{k}])"
        other = f"list_transform(range(1, len(m[{k}]) + 1), lambda j: m[i][j] - m[i][{k}] * m[{k}][j] / m[{k}][{k}])"
        ctes.append(f"{name}{k} AS MATERIALIZED (SELECT list_transform(range(1, {n + 1}), lambda i: CASE WHEN i = {k} THEN {row} ELSE {other} END) AS m{carried} FROM {name}{k - 1})")
    return ctes


def complete(columns: list[str]) -> str:
    return " AND ".join(f"isfinite(CAST({c} AS DOUBLE))" for c in columns)


def matrix(rows: list[list[str]]) -> str:
    return "[" + ", ".join("[" + ", ".join(r) + "]" for r in rows) + "]"


def ols_sql(target: str, features: list[str]) -> tuple[list[str], str]:
    """Normal equations of the scaled columns, solved column by column beside the identity."""
    p = len(features)
    x = [f"CAST({f} AS DOUBLE)" for f in features]
    stats = ", ".join(f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in range(1, p + 1))
    ctes = [
        f"oraw AS (SELECT {', '.join(f'{c} AS x{i}' for i, c in enumerate(x, 1))}, CAST({target} AS DOUBLE) AS y FROM c360 WHERE {complete([*features, target])})",
        f"ost AS MATERIALIZED (SELECT {stats}, avg(y) AS my, COUNT(*) AS n FROM oraw)",
        f"oz AS (SELECT [{', '.join(f'(x{i} - m{i}) / s{i}' for i in range(1, p + 1))}] AS z, y - my AS y FROM oraw, ost)",
    ]
    grams = [[f"SUM(z[{i}] * z[{j}])" for j in range(1, p + 1)] + [f"{float(i == j)}" for j in range(1, p + 1)] + [f"SUM(z[{i}] * y)"] for i in range(1, p + 1)]
    xy = ", ".join(f"SUM(z[{i}] * y)" for i in range(1, p + 1))
    ctes += solved("og", f"SELECT {matrix(grams)} AS m, SUM(y * y) AS yy, [{xy}] AS xy FROM oz", p, ", yy, xy")
    slope = lambda i: f"m[{i}][{2 * p + 1}]"
    rss = f"(yy - ({' + '.join(f'{slope(i)} * xy[{i}]' for i in range(1, p + 1))}))"
    quad = " + ".join(f"(m{i} / s{i}) * (m{j} / s{j}) * m[{i}][{p + j}]" for i in range(1, p + 1) for j in range(1, p + 1))
    parts = [f"SELECT 'const' AS feature, my - ({' + '.join(f'{slope(i)} * m{i} / s{i}' for i in range(1, p + 1))}) AS b, sqrt({rss} / (n - {p + 1}) * (1.0 / n + {quad})) AS se, n, 1 - {rss} / yy AS r2 FROM og{p}, ost"]
    parts += [f"SELECT '{f}', {slope(i)} / s{i}, sqrt({rss} / (n - {p + 1}) * m[{i}][{p + i}]) / s{i}, n, 1 - {rss} / yy FROM og{p}, ost" for i, f in enumerate(features, 1)]
    ctes.append("orows AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")")
    tested = f"SELECT *, {t_tail('b / se', f'(n - {p + 1})')} AS p FROM orows"
    return ctes, f"""SELECT feature, {rnd('b', 9)} AS coefficient, {rnd('se', 9)} AS std_error, {rnd('p', 6)} AS p_value, p < 0.05 AS significant_at_5pct, {rnd('r2', 6)} AS r_squared FROM ({tested})"""


def logit_sql(target: str, features: list[str], rounds: int = 12) -> tuple[list[str], str]:
    """Newton rounds written out one after another, each with its own sums over the rows."""
    p, size = len(features), len(features) + 1
    ctes = [
        f"lraw AS (SELECT {', '.join(f'CAST({f} AS DOUBLE) AS x{i}' for i, f in enumerate(features, 1))}, CAST({target} AS DOUBLE) AS y FROM c360 WHERE {complete([*features, target])} AND {target} IN (0, 1))",
        f"lst AS MATERIALIZED (SELECT {', '.join(f'avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}' for i in range(1, p + 1))} FROM lraw)",
        f"lx AS MATERIALIZED (SELECT [1.0, {', '.join(f'(x{i} - m{i}) / s{i}' for i in range(1, p + 1))}]::DOUBLE[] AS x, y FROM lraw, lst)",
        f"b0 AS (SELECT [{', '.join(['0.0'] * size)}]::DOUBLE[] AS b, CAST(NULL AS DOUBLE[][]) AS inv)",
    ]
    for k in range(1, rounds + 1):
        sums = [
            [f"SUM(w * x[{i}] * x[{j}])" for j in range(1, size + 1)] + [f"{float(i == j)}" for j in range(1, size + 1)] + [f"SUM(x[{i}] * (y - q))"]
            for i in range(1, size + 1)
        ]
        rows = f"SELECT x, y, b, q, q * (1 - q) AS w FROM (SELECT x, y, b, 1.0 / (1.0 + exp(-list_dot_product(x, b))) AS q FROM lx, b{k - 1})"
        ctes += solved(f"h{k}_", f"SELECT {matrix(sums)} AS m, ANY_VALUE(b) AS b FROM ({rows})", size, ", b")
        ctes.append(
            f"b{k} AS MATERIALIZED (SELECT list_transform(range(1, {size + 1}), lambda i: b[i] + m[i][{2 * size + 1}]) AS b,"
            f" list_transform(range(1, {size + 1}), lambda i: m[i][{size + 1}:{2 * size}]) AS inv,"
            f" list_max(list_transform(range(1, {size + 1}), lambda i: abs(m[i][{2 * size + 1}]))) AS step FROM h{k}_{size})"
        )
    turn = ["1.0", *[f"(-m{i} / s{i})" for i in range(1, p + 1)]]
    quad = " + ".join(f"{turn[i]} * {turn[j]} * inv[{i + 1}][{j + 1}]" for i in range(size) for j in range(size))
    parts = [f"SELECT 'const' AS feature, b[1] - ({' + '.join(f'b[{i + 1}] * m{i} / s{i}' for i in range(1, p + 1))}) AS w, sqrt(abs({quad})) AS se, coalesce(step < 1e-9, FALSE) AS settled FROM b{rounds}, lst"]
    parts += [f"SELECT '{f}', b[{i + 1}] / s{i}, sqrt(abs(inv[{i + 1}][{i + 1}])) / s{i}, coalesce(step < 1e-9, FALSE) FROM b{rounds}, lst" for i, f in enumerate(features, 1)]
    ctes.append("lrows AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")")
    tested = f"SELECT *, {chi_tail('(w / se) * (w / se)', '1')} AS p FROM (SELECT feature, CASE WHEN settled THEN w END AS w, CASE WHEN settled THEN se END AS se, settled FROM lrows)"
    z = "1.959963984540054"
    return ctes, f"""SELECT feature, {rnd('w', 8)} AS coefficient, {rnd('se', 8)} AS std_error, {rnd('p', 6)} AS p_value, {rnd('exp(w)', 6)} AS odds_ratio,
 {rnd(f'exp(w - {z} * se)', 6)} AS ci_lower, {rnd(f'exp(w + {z} * se)', 6)} AS ci_upper, p < 0.05 AS significant_at_5pct, settled FROM ({tested})"""


_ols = ols_sql("customer_health_score", fv.HEALTH_REGRESSORS)
sql("ols_health", [*C360, *_ols[0]], _ols[1])
for _name, _features in (("logit_odds_ratios", fv.CHURN_REGRESSORS), ("logit_odds_of_habits", HABITS)):
    _logit = logit_sql("actual_churned", _features)
    sql(_name, [*C360, *_logit[0]], _logit[1])
sql("dq_checks", C360, "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT 'Missing values' AS \"check\", '{c}' AS \"column\", COUNT(*) FILTER ({c} IS NULL) AS count, 'Review' AS status FROM c360" for c in C360_COLUMNS
) + """) WHERE count > 0 UNION ALL SELECT 'Return rate above 100%', 'return_rate', COUNT(*) FILTER (return_rate > 1), 'Review metric definition' FROM c360
 UNION ALL SELECT 'Customers without churn score', 'churn_risk_tier', COUNT(*) FILTER (churn_risk_tier = 'Not Scored'), 'Expected / Excluded' FROM c360""")

# ---- splits, curves, contributions --------------------------------------------------------------

SEEDED = "md5(CAST(customer_id AS VARCHAR) || ':42')"
sql("stratified_split", CHURN_BASE, f"""SELECT customer_id, churned, {big(f'''CASE WHEN ROW_NUMBER() OVER (PARTITION BY churned ORDER BY {SEEDED}, customer_id)
 <= floor(COUNT(*) OVER (PARTITION BY churned) * 0.8 + 0.5) THEN 1 ELSE 0 END''')} AS is_train FROM cbase""")
sql("seeded_sample", CHURN_BASE, f"SELECT customer_id, obs_total_revenue FROM cbase ORDER BY {SEEDED}, customer_id LIMIT 1000")
CURVE = [*SCORES, """th0 AS (SELECT churn_probability AS threshold, SUM(actual_churned) AS tp, SUM(1 - actual_churned) AS fp FROM cpred GROUP BY 1)""",
         """curve AS (SELECT threshold, tp, fp, SUM(tp) OVER (ORDER BY threshold DESC) AS ctp, SUM(fp) OVER (ORDER BY threshold DESC) AS cfp,
 SUM(tp) OVER () AS pos, SUM(fp) OVER () AS neg FROM th0)"""]
sql("roc_curve", CURVE, f"SELECT threshold, {ratio('cfp', 'neg')} AS false_positive_rate, {ratio('ctp', 'pos')} AS true_positive_rate FROM curve")
sql("pr_curve", CURVE, f"SELECT threshold, {ratio('ctp', 'ctp + cfp')} AS precision, {ratio('ctp', 'pos')} AS recall FROM curve")
CONF = {k: f"COUNT(*) FILTER (actual_churned = {y} AND predicted_churned = {p})" for k, y, p in [
    ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)]}
sql("churn_metrics", [*CURVE, "conf AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in CONF.items()) + " FROM cpred)"], f"""SELECT tn AS true_negative,
 fp AS false_positive, fn AS false_negative, tp AS true_positive, {rnd(ratio('tp + tn', 'tp + tn + fp + fn'), 4)} AS accuracy,
 {rnd(f"COALESCE({ratio('tp', 'tp + fp')}, 0.0)", 4)} AS precision, {rnd(f"COALESCE({ratio('tp', 'tp + fn')}, 0.0)", 4)} AS recall,
 {rnd(f"COALESCE({ratio('2 * tp', '2 * tp + fp + fn')}, 0.0)", 4)} AS f1,
 (SELECT {rnd('SUM(CASE WHEN p.threshold > q.threshold THEN p.tp * q.fp WHEN p.threshold = q.threshold THEN p.tp * q.fp / 2.0 ELSE 0 END) / MAX(p.pos * p.neg)', 4)}
 FROM curve p CROSS JOIN curve q) AS roc_auc,
 (SELECT {rnd('SUM(tp * (CAST(ctp AS DOUBLE) / (ctp + cfp))) / MAX(pos)', 4)} FROM curve) AS average_precision FROM conf""")
sql("linear_contributions", CHURN_BASE, " UNION ALL ".join(
    f"SELECT customer_id, '{c}' AS feature, {rnd(f'CAST({b} AS DOUBLE) * (CAST({c} AS DOUBLE) - AVG(CAST({c} AS DOUBLE)) OVER ())', 6)} AS phi FROM cbase"
    for c, b in CONTRIBUTION_WEIGHTS.items()))
REASONS = """concat_ws(' | ', CASE WHEN obs_recency_days > 90 THEN printf('High inactivity (%dd since last purchase)', obs_recency_days) END,
 CASE WHEN obs_total_invoices <= 2 THEN printf('Low purchase frequency (%d orders)', obs_total_invoices) END,
 CASE WHEN obs_total_revenue < 500 THEN printf('Low spend (£%.0f)', obs_total_revenue) END)"""
sql("risk_explanations", SCORES, f"""SELECT customer_id, churn_probability, risk_tier,
 COALESCE(NULLIF({REASONS}, ''), 'High churn probability based on combined RFM signals') AS explanation
 FROM (SELECT * FROM cpred ORDER BY churn_probability DESC, customer_id LIMIT 20) JOIN cbase USING (customer_id)""")

# ---- vectors and classifier ---------------------------------------------------------------------

VECS = "vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def nearest_sql(name: str, k: int, condition: str) -> str:
    return f"""SELECT {name}, vec_id, {rnd('similarity', 6)} AS similarity, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {name}
 ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT q.name AS {name}, vec.vec_id, list_cosine_similarity(vec.v, q.v) AS similarity
 FROM vec CROSS JOIN q WHERE {condition})) WHERE rank <= {k}"""


sql("concept_vectors", [VECS, "pos AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM vec)",
                        "mv AS (SELECT label, i, AVG(x) AS x FROM pos GROUP BY 1, 2)",
                        "q AS (SELECT CAST(label AS BIGINT) AS name, list(x ORDER BY i) AS v FROM mv GROUP BY 1)"], nearest_sql("concept", 15, "true"))
sql("similar_vectors", [VECS, "q AS (SELECT vec_id AS name, v FROM vec WHERE vec_id IN (SELECT MIN(vec_id) FROM vec GROUP BY label))"],
    nearest_sql("target", 10, "vec.vec_id <> q.name"))
CLASSIFIED = [*RAW_SCORED, """cl AS (SELECT complaint_id, CASE WHEN p > n THEN 'POSITIVE' ELSE 'NEGATIVE' END AS predicted_label,
 CASE WHEN p + n > 0 THEN CAST(GREATEST(p, n) AS DOUBLE) / (p + n) ELSE 0.5 END AS confidence,
 CASE WHEN p > n THEN 'Positive' ELSE 'Negative' END AS sentiment FROM rs WHERE TRIM(text) <> '')"""]
sql("batch_classifier", CLASSIFIED, f"SELECT complaint_id, predicted_label, {rnd('confidence', 6)} AS confidence, sentiment FROM cl")
sql("classifier_summary", CLASSIFIED, f"""SELECT sentiment, COUNT(*) AS complaints, {rnd('AVG(confidence)', 6)} AS mean_confidence,
 {rnd(pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 6)} AS percentage FROM cl GROUP BY 1""")

# ---- sinks and what they read back --------------------------------------------------------------

sql("raw_parts", [RAW], f"""SELECT country, COUNT(*) AS lines, {big('SUM(quantity)')} AS quantity, COUNT(description) AS described,
 COUNT(customer_id) AS with_customer, {stamp('MIN(invoice_date)')} AS first_date FROM raw GROUP BY 1""")
sql("parquet_sink", C360, "SELECT customer_id, health_tier, total_revenue, action_priority FROM c360")
ORACLE["csv_report_sink"] = ORACLE["health_tier_summary"]
ORACLE["json_sink"] = ORACLE["executive_kpis"]
sql("format_parity", C360, f"""SELECT format, n AS rows, CAST({len(C360_COLUMNS)} AS BIGINT) AS columns
 FROM (SELECT COUNT(*) AS n FROM c360), (VALUES ('csv'), ('parquet')) f(format)""")
sql("model_round_trip", CHURN_BASE, "SELECT COUNT(*) AS customers, COUNT(*) AS same FROM cbase")
ORACLE["report_run"] = ORACLE["report_shapes"]
sql("customer_lookup", C360, f"""SELECT customer_id, CAST(r_score AS DOUBLE) AS recency, CAST(f_score AS DOUBLE) AS frequency,
 CAST(m_score AS DOUBLE) AS monetary, {rnd('customer_health_score / 20.0', 6)} AS health,
 {rnd('CASE WHEN model_scored = 1 THEN (1.0 - churn_probability) * 5.0 ELSE 2.5 END', 6)} AS churn_safety FROM c360
 WHERE customer_id = {LOOKED_UP}""")
