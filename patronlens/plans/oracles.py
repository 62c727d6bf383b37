"""Equivalent SQL for the catalog queries, for an independent engine to run."""

from __future__ import annotations

ORDERS_TX = """
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_datetime,
           o_totalprice AS total_amount
    FROM orders
    WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_orderdate IS NOT NULL
      AND o_totalprice IS NOT NULL"""

EVENTS_TX = """
    SELECT event_id AS order_id, user_id AS customer_id, ts AS order_datetime, value AS total_amount
    FROM events
    WHERE event_type = 'purchase' AND event_id IS NOT NULL AND user_id IS NOT NULL
      AND ts IS NOT NULL AND value IS NOT NULL"""

ORDERS_CUSTOMERS = """
    SELECT c_custkey AS customer_id, c_name AS name,
           c_mktsegment AS device_type, b.avg_session_time_min, b.wishlist_items_count,
           n_name AS location
    FROM customer
    LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (
      SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS avg_session_time_min,
             CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE)
               AS wishlist_items_count
      FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id
    ) b ON c_custkey = b.user_id"""

EVENTS_CUSTOMERS = """
    SELECT DISTINCT user_id AS customer_id, CAST(NULL AS VARCHAR) AS name
    FROM events"""

MAPPINGS = {"orders": (ORDERS_TX, ORDERS_CUSTOMERS), "events": (EVENTS_TX, EVENTS_CUSTOMERS)}


def feature_ctes(mapping: str, days: int = 30, back: int = 0, tag: str = "") -> str:
    """CTEs tx, a (window), g (features), base (with attributes), lim and feats."""
    tx, customers = MAPPINGS[mapping]
    return f"""
  tx{tag} AS ({tx}),
  a{tag} AS (
    SELECT date_trunc('day', max(order_datetime)) - INTERVAL {back} DAY AS e,
           date_trunc('day', max(order_datetime)) - INTERVAL {back + days} DAY AS s,
           date_trunc('day', max(order_datetime)) - INTERVAL {back + 90} DAY AS since
    FROM tx{tag}),
  g{tag} AS (
    SELECT customer_id, max(order_datetime) AS last_order,
           count(DISTINCT order_id) AS frequency, sum(total_amount) AS monetary,
           count(DISTINCT CASE WHEN order_datetime >= since THEN order_id END) AS frequency90d,
           coalesce(sum(CASE WHEN order_datetime >= since THEN total_amount END), 0)
             AS monetary90d,
           CAST(date_sub('day', max(order_datetime), any_value(e)) AS INTEGER)
             AS "recencyDays",
           bool_or(order_datetime >= s) AS "isActiveInWindow"
    FROM tx{tag}, a{tag} WHERE order_datetime <= e GROUP BY customer_id),
  base{tag} AS (
    SELECT g.*, c.* EXCLUDE (customer_id)
    FROM g{tag} g LEFT JOIN ({customers}) c ON g.customer_id = c.customer_id),
  lim{tag} AS (
    SELECT quantile_cont(monetary, 0.75) AS m75,
           quantile_cont(CAST(frequency AS DOUBLE), 0.75) AS f75,
           quantile_cont(CAST("recencyDays" AS DOUBLE), 0.5) AS r50,
           quantile_cont(CAST("recencyDays" AS DOUBLE), 0.75) AS r75,
           greatest(max("recencyDays"), 0) AS rmax
    FROM base{tag}),
  feats{tag} AS (
    SELECT b.*, m75,
           CASE WHEN "recencyDays" >= r75 THEN 'At-Risk'
                WHEN monetary >= m75 AND frequency >= f75 AND "recencyDays" <= r50
                  THEN 'Top Buyer'
                ELSE 'Moderate' END AS segment,
           least(greatest(greatest("recencyDays", 0)
             / CASE WHEN rmax > 0 THEN CAST(rmax AS DOUBLE) ELSE 1.0 END, 0), 1)
             AS "churnRisk"
    FROM base{tag} b, lim{tag})"""


MODEL_INPUTS = ['"recencyDays"', "frequency90d", "monetary90d", "avg_session_time_min", "wishlist_items_count"]


def newton_ctes(inputs: list[str], tag: str = "", rounds: int = 2500) -> str:
    """CTEs parted (base rows with inputs, label and split), fit (a point a round) and scored (with p).

    Newton steps for the summed log-loss plus half the squared coefficients. Inputs are divided by
    their largest size, with the penalty on the coefficients as they are; the system of each step
    is solved by elimination; a step that moves margins by up to m is shortened to ln(1 + m), which
    keeps the loss falling. The last unknown is the intercept.
    """
    k = len(inputs)
    x = [f"x{j}" for j in range(k)]
    terms = [*x, "1.0::DOUBLE"]
    w = [f"w{j}" for j in range(k + 1)]
    corners = [(r, c) for r in range(k + 1) for c in range(r, k + 1)]
    margin = " + ".join(f"{a} * {b}" for a, b in zip(w, terms))
    p = f"1 / (1 + exp(-least(greatest({margin}, -700), 700)))"
    penalty = [f"any_value(q{j})" for j in range(k)] + ["0"]
    sums = [f"sum((y - p) * {t}) - {q} * {a} AS g{r}" for r, (t, q, a) in enumerate(zip(terms, penalty, w))]
    sums += [f"sum(p * (1 - p) * {terms[r]} * {terms[c]})" + (f" + {penalty[r]}" if r == c else "") + f" AS h{r}_{c}" for r, c in corners]
    names = ", ".join(w)
    solved = f"""SELECT i, {names}, {", ".join(sums)}
      FROM (SELECT i, {names}, t.*, {p} AS p FROM fit{tag}, train{tag} t WHERE i < {rounds}) GROUP BY i, {names}"""
    for m in range(k):
        rest = [f"g{r} - h{m}_{r} * g{m} / h{m}_{m} AS g{r}" for r in range(m + 1, k + 1)]
        rest += [f"h{r}_{c} - h{m}_{r} * h{m}_{c} / h{m}_{m} AS h{r}_{c}" for r, c in corners if r > m]
        solved = f"SELECT * REPLACE ({', '.join(rest)}) FROM ({solved})"
    for m in range(k, -1, -1):
        known = "".join(f" - h{m}_{c} * d{c}" for c in range(m + 1, k + 1))
        solved = f"SELECT *, (g{m}{known}) / h{m}_{m} AS d{m} FROM ({solved})"
    moved = " + ".join(f"abs(d{j})" for j in range(k + 1))
    solved = f"SELECT *, {moved} AS m FROM ({solved})"
    solved = f"SELECT *, CASE WHEN m > 1e-9 THEN ln(1 + m) / m ELSE 1.0 END AS s FROM ({solved})"
    zeros = ", ".join(["0.0::DOUBLE"] * (k + 1))
    return f"""
  given{tag} AS (
    SELECT customer_id, {", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {n}" for c, n in zip(inputs, x))},
           ('0x' || substr(md5(CAST(customer_id AS VARCHAR)), 1, 13))::BIGINT AS draw,
           CASE WHEN "recencyDays" >= 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM base{tag}),
  parted{tag} AS (
    SELECT *, row_number() OVER (PARTITION BY y ORDER BY draw)
              <= ceil(count(*) OVER (PARTITION BY y) / 4.0) AS is_test FROM given{tag}),
  size{tag} AS (
    SELECT {", ".join(f"greatest(max(abs({n})), 1e-300) AS s{j}" for j, n in enumerate(x))}
    FROM parted{tag} WHERE NOT is_test),
  train{tag} AS (
    SELECT {", ".join(f"{n} / s{j} AS {n}, 1 / (s{j} * s{j}) AS q{j}" for j, n in enumerate(x))}, y
    FROM parted{tag}, size{tag} WHERE NOT is_test),
  fit{tag}(i, {names}) AS (
    SELECT 0, {zeros}
    UNION ALL SELECT i + 1, {", ".join(f"{a} + s * d{j}" for j, a in enumerate(w))} FROM ({solved})),
  scored{tag} AS (
    SELECT customer_id, y, is_test, {p} AS p
    FROM (SELECT customer_id, y, is_test, {", ".join(f"{n} / s{j} AS {n}" for j, n in enumerate(x))}
          FROM parted{tag}, size{tag}), fit{tag} WHERE i = {rounds})"""


def model_ctes(mapping: str, days: int = 30, back: int = 0, tag: str = "") -> str:
    """The features, and modeled: feats with the churn risk of a model fitted on them."""
    return f"""{feature_ctes(mapping, days, back, tag)}, {newton_ctes(MODEL_INPUTS, tag)},
  modeled{tag} AS (
    SELECT feats{tag}.* REPLACE (p AS "churnRisk") FROM feats{tag} JOIN scored{tag} USING (customer_id))"""


def kpi_cte(tag: str = "", source: str = "feats") -> str:
    return f"""
  kpi{tag} AS (
    SELECT count(*) FILTER (WHERE "isActiveInWindow") AS "activeCustomers",
           coalesce(avg(monetary), 0) AS "avgCustomerValue",
           count(*) FILTER (WHERE "churnRisk" >= 0.7) AS "churnRiskCustomers",
           coalesce(avg(CASE WHEN frequency >= 2 THEN 1.0 ELSE 0.0 END), 0) AS "retentionRate"
    FROM {source}{tag})"""


def on_features(select: str, mapping: str = "orders", **window: int) -> str:
    return f"WITH {feature_ctes(mapping, **window)} {select}"


def on_kpis(select: str, mapping: str = "orders", **window: int) -> str:
    return f"WITH {feature_ctes(mapping, **window)}, {kpi_cte()} {select}"


RFM = """SELECT customer_id, last_order, frequency, round(monetary, 2) AS monetary,
  frequency90d, round(monetary90d, 2) AS monetary90d, "recencyDays" FROM g"""

SEGMENTS = """SELECT customer_id, "recencyDays", frequency, round(monetary, 2) AS monetary,
  segment, "isActiveInWindow" FROM feats"""

SEGMENT_COUNTS = """SELECT segment AS name, count(customer_id) AS value FROM feats GROUP BY 1"""

TREND = """SELECT month, round(value, 4) AS value FROM (
    SELECT strftime(last_order, '%Y-%m') AS month, avg(monetary) AS value
    FROM base GROUP BY 1 ORDER BY 1 DESC LIMIT 6)"""

TOP = """SELECT CAST(customer_id AS VARCHAR) AS id,
        coalesce(name, CAST(customer_id AS VARCHAR)) AS name, segment,
  CAST("recencyDays" AS BIGINT) AS "recencyDays", frequency, round(monetary, 2) AS monetary,
  round("churnRisk", 6) AS "churnRisk" FROM feats ORDER BY feats.monetary DESC, customer_id LIMIT 12"""

KPIS = """SELECT "activeCustomers", round("avgCustomerValue", 4) AS "avgCustomerValue",
  "churnRiskCustomers", round("retentionRate", 6) AS "retentionRate" FROM kpi"""

RULE_SCORES = """SELECT customer_id, "recencyDays", round("churnRisk", 6) AS "churnRisk" FROM feats"""

ALERTS = """SELECT customer_id, segment, round(monetary, 2) AS monetary,
  round("churnRisk", 6) AS "churnRisk" FROM feats
  WHERE feats.monetary >= m75 AND feats."churnRisk" >= 0.75"""

AT_RISK_SHARE = (
    "(SELECT avg(CASE WHEN segment = 'At-Risk' THEN 1.0 ELSE 0.0 END) FROM feats)"
)
EVIDENCE = (
    f"format('At-risk customers are {{:.0f}}% of all customers in the model base.', "
    f"{AT_RISK_SHARE} * 100)"
)
ACTION = (
    "'Target customers inactive 45–90 days with a win-back offer or reminder campaign.'"
)
INSIGHTS = f"""SELECT 'At-risk segment is sizable' AS title, 'warning' AS severity,
  {EVIDENCE} AS evidence, {ACTION} AS "recommendedAction" WHERE {AT_RISK_SHARE} >= 0.15"""

FACTS = """SELECT CAST(position AS INTEGER) AS position, fact FROM (
  SELECT 0 AS position, 'Active customers: ' || "activeCustomers" AS fact FROM kpi
  UNION ALL SELECT 1, format('Retention rate: {:.1f}%', "retentionRate" * 100) FROM kpi
  UNION ALL SELECT 2, 'Churn-risk customers: ' || "churnRiskCustomers" FROM kpi)"""

# Order values per customer with their dimensions, then F and p. For an even number of
# numerator degrees of freedom the tail of the F distribution is a finite sum.
ORDER_VALUES = f"""
  aov AS (SELECT customer_id, avg(total_amount) AS aov FROM ({ORDERS_TX}) GROUP BY 1),
  joined AS (
    SELECT aov.customer_id, aov.aov, c.device_type, c.location
    FROM ({ORDERS_CUSTOMERS}) c JOIN aov ON c.customer_id = aov.customer_id)"""


def anova_ctes(tests: dict[str, str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS test, {dim} AS grp, aov AS x FROM joined WHERE {dim} IS NOT NULL"
        for name, dim in tests.items()
    )
    return f"""WITH {ORDER_VALUES},
  x AS ({rows}),
  m AS (SELECT test, grp, count(*) AS n, avg(x) AS mean, var_pop(x) AS v FROM x GROUP BY 1, 2),
  gm AS (SELECT test, sum(n * mean) / sum(n) AS grand FROM m GROUP BY 1),
  s AS (
    SELECT m.test, CAST(count(*) - 1 AS DOUBLE) AS df_between,
           CAST(sum(n) - count(*) AS DOUBLE) AS df_within,
           sum(n * (mean - grand) ** 2) AS ssb, sum(n * v) AS ssw
    FROM m JOIN gm ON m.test = gm.test GROUP BY m.test
    HAVING count(*) >= 2 AND min(n) >= 5),
  r AS (SELECT *, (ssb / df_between) / (ssw / df_within) AS f FROM s),
  t AS (
    SELECT test, df_between, df_within, f,
      (SELECT sum(exp(lgamma(df_within / 2 + j) - lgamma(df_within / 2) - lgamma(j + 1)
                      + (df_within / 2) * ln(df_within / (df_within + df_between * f))
                      + j * ln(df_between * f / (df_within + df_between * f))))
       FROM generate_series(0, CAST(df_between / 2 AS BIGINT) - 1) g(j)) AS p
    FROM r)"""


KPI_LABELS = {
    "activeCustomers": "vs previous period", "avgCustomerValue": "vs previous period",
    "churnRiskCustomers": "needs attention", "retentionRate": "vs previous period",
}


def document(mapping: str, days: int, model: str, features: list[str], rule: str, extra: str = "") -> str:
    """The response as rows (path, type, text, number); ``model`` is 'feats' or 'modeled'."""
    cards = ", ".join(
        f"""'{k}': {{'value': "{k}", 'deltaPct': NULL, 'deltaLabel': '{label}'}}""" for k, label in KPI_LABELS.items()
    )
    top = ", ".join(f"""'{c}': "{c}\"""" for c in ("id", "name", "segment", "recencyDays", "frequency", "monetary", "churnRisk"))
    insight = ", ".join(f"""'{c}': "{c}\"""" for c in ("title", "severity", "evidence", "recommendedAction"))
    fitted = model == "modeled"
    auc, accuracy = ("(SELECT auc FROM metrics)", "(SELECT accuracy FROM metrics)") if fitted else ("NULL", "NULL")
    fact = f" UNION ALL SELECT 3, format('Churn model AUC: {{:.2f}}', {auc})" if fitted else ""
    tests = f"""(SELECT list({{'name': test, 'method': 'ANOVA', 'pValue': p,
         'result': CASE WHEN p < 0.05 THEN 'significant' ELSE 'not_significant' END}} ORDER BY test)
         FROM ({anova_ctes(DEVICE_TEST)} SELECT * FROM t))""" if mapping == "orders" else "[]"
    given = ", ".join(f"'{c}'" for c in features)
    ctes = model_ctes(mapping, days) if fitted else feature_ctes(mapping, days)
    return f"""WITH RECURSIVE {ctes}, {kpi_cte('', model)}{extra},
      doc AS (SELECT to_json({{
        'range': {{'days': {days}, 'end': (SELECT strftime(e, '%Y-%m-%d') FROM a)}},
        'kpis': (SELECT {{{cards}}} FROM kpi),
        'segments': (SELECT list({{'name': name, 'value': value}} ORDER BY name) FROM ({SEGMENT_COUNTS})),
        'clvTrend': (SELECT list({{'month': month, 'value': value}} ORDER BY month) FROM ({TREND})),
        'topCustomers': (SELECT list({{{top}}} ORDER BY monetary DESC, id) FROM ({TOP.replace('feats', model)})),
        'model': {{'churnModel': {{'type': '{"logistic_regression" if fitted else "rule_only"}', 'labelRule': '{rule}',
          'features': [{given}], 'metrics': {{'auc': {auc}, 'accuracy': {accuracy}}}}}}},
        'tests': {tests},
        'insights': coalesce((SELECT list({{{insight}}}) FROM ({INSIGHTS})), []),
        'grounding': {{'facts': (SELECT list(fact ORDER BY position) FROM ({FACTS}{fact}))}}
      }}) AS j)
      SELECT fullkey AS path,
        CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array'
                  WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS type,
        CASE WHEN type IN ('VARCHAR', 'BOOLEAN') THEN atom ->> '$' END AS text,
        CASE WHEN type NOT IN ('VARCHAR', 'BOOLEAN', 'OBJECT', 'ARRAY', 'NULL') THEN round(CAST(atom AS DOUBLE), 4) END AS number
      FROM doc, json_tree(doc.j)"""


SPEND_BANDS = {
    f"Avg order value differs by band_{groups}_{limit}":
        f"CASE WHEN aov >= {limit} THEN CAST(customer_id % {groups - 1} AS VARCHAR) ELSE 'low' END"
    for limit in (160_000, 150_000, 140_000) for groups in (7, 5, 3)
}
DEVICE_TEST = {"Avg order value differs by device_type": "device_type"}

DIRTY = """
  raw AS (
    SELECT CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS order_id,
           CASE WHEN o_orderkey % 23 = 0 THEN 'NA' ELSE CAST(o_custkey AS VARCHAR) END
             AS customer_id,
           CASE WHEN o_orderkey % 11 = 0 THEN 'bad'
                ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 10:30:00' END AS order_datetime,
           CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 13 = 0 THEN '5d'
                WHEN o_orderkey % 17 = 0 THEN '1,000'
                ELSE ' ' || CAST(o_totalprice AS VARCHAR) || ' ' END AS total_amount,
           CASE WHEN o_orderkey % 5 = 0 THEN 'abc' ELSE CAST(o_orderkey % 9 AS VARCHAR) END
             AS quantity,
           CASE WHEN o_orderkey % 3 = 0 THEN 'TRUE' WHEN o_orderkey % 4 = 0 THEN 'True'
                WHEN o_orderkey % 19 = 0 THEN ' TRUE ' ELSE 'no' END AS coupon_applied,
           o_orderkey % 37 = 0 AS repeated
    FROM orders)"""

CLEAN_TRANSACTIONS = f"""WITH {DIRTY},
  typed AS (
    SELECT nullif(order_id, '') AS order_id, nullif(customer_id, 'NA') AS customer_id,
           try_cast(order_datetime AS TIMESTAMP) AS order_datetime,
           round(try_cast(trim(total_amount) AS DOUBLE), 2) AS total_amount,
           try_cast(quantity AS DOUBLE) AS quantity,
           upper(coupon_applied) = 'TRUE' AS coupon_applied
    FROM raw)
  SELECT * FROM typed WHERE order_id IS NOT NULL AND customer_id IS NOT NULL
    AND order_datetime IS NOT NULL AND total_amount IS NOT NULL"""

INVENTORY = """
  inv AS (
    SELECT l_partkey AS sku, (l_partkey * 7 + l_suppkey * 13) % 299 + 1 AS stock_level,
           (l_partkey * 3 + l_suppkey * 5) % 60 + 20 AS reorder_threshold
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)),
  sold AS (
    SELECT l_partkey AS sku, l_shipdate AS sold_at, l_quantity AS units,
           l_extendedprice * (1 - l_discount) AS revenue FROM lineitem),
  la AS (SELECT date_trunc('day', max(sold_at)) AS e FROM sold)"""

OUTLOOK = f"""WITH {INVENTORY},
  scarce AS (SELECT sku, stock_level * CASE WHEN sku % 2 = 0 THEN 0 WHEN sku % 3 = 0 THEN 1
                                            ELSE 100 END // 100 AS stock_level FROM inv),
  daily AS (
    SELECT sku, sum(units) / 28 AS daily_units FROM sold, la
    WHERE sold_at >= e - INTERVAL 27 DAY AND sold_at < e + INTERVAL 1 DAY GROUP BY sku),
  stk AS (SELECT sku, CAST(sum(stock_level) AS BIGINT) AS stock FROM scarce GROUP BY sku),
  o AS (
    SELECT d.sku, daily_units * 7 AS demand, coalesce(stock, 0) AS stock,
           coalesce(stock / nullif(daily_units, 0), 0) AS days
    FROM daily d LEFT JOIN stk ON d.sku = stk.sku),
  outlook AS (
    SELECT sku, round(demand, 4) AS predicted_demand, stock,
           round(days, 4) AS days_to_stock_out,
           CASE WHEN days <= 3 THEN 'High' WHEN days <= 10 THEN 'Medium' ELSE 'Low' END AS risk
    FROM o)"""

GROWTH = f"""WITH {INVENTORY},
  w AS (SELECT e + INTERVAL 1 DAY AS hi, e - INTERVAL 29 DAY AS mid, e - INTERVAL 59 DAY AS lo
        FROM la),
  gr AS (
    SELECT sku, sum(CASE WHEN sold_at >= mid THEN revenue ELSE 0 END) AS cur,
           sum(CASE WHEN sold_at < mid THEN revenue ELSE 0 END) AS prev
    FROM sold, w WHERE sold_at >= lo AND sold_at < hi GROUP BY sku),
  growth AS (
    SELECT sku, round(cur, 4) AS current, round(prev, 4) AS previous,
           round((cur - prev) / nullif(prev, 0), 6) AS growth,
           (cur - prev) / nullif(prev, 0) AS raw_growth FROM gr)"""


def changes(mapping: str, days: int, model: bool = False) -> str:
    def unpivoted(tag: str) -> str:
        return f"""
  long{tag} AS (
    SELECT 'activeCustomers' AS kpi, CAST("activeCustomers" AS DOUBLE) AS v FROM kpi{tag}
    UNION ALL SELECT 'avgCustomerValue', "avgCustomerValue" FROM kpi{tag}
    UNION ALL SELECT 'churnRiskCustomers', CAST("churnRiskCustomers" AS DOUBLE) FROM kpi{tag}
    UNION ALL SELECT 'retentionRate', "retentionRate" FROM kpi{tag})"""

    rows, source = (model_ctes, "modeled") if model else (feature_ctes, "feats")
    return f"""WITH RECURSIVE {rows(mapping, days)}, {kpi_cte('', source)}, {unpivoted('')},
  {rows(mapping, days, days, '2')}, {kpi_cte('2', source)}, {unpivoted('2')},
  ch AS (
    SELECT long.kpi, long.v AS value, long2.v AS previous,
           (long.v - long2.v) / nullif(long2.v, 0) AS delta
    FROM long JOIN long2 ON long.kpi = long2.kpi)"""


KPI_CARDS = """
  SELECT 'activeCustomers' AS kpi, format('{:,}', "activeCustomers") AS text,
         'vs previous period' AS label FROM kpi
  UNION ALL SELECT 'avgCustomerValue',
         '$' || format('{:,}', CAST(floor("avgCustomerValue" + 0.5) AS BIGINT)),
         'vs previous period' FROM kpi
  UNION ALL SELECT 'churnRiskCustomers', format('{:,}', "churnRiskCustomers"),
         'needs attention' FROM kpi
  UNION ALL SELECT 'retentionRate', format('{:.1f}%', "retentionRate" * 100),
         'vs previous period' FROM kpi"""

ANSWER_CTES = f"""
  texts AS (
    SELECT (SELECT format('Retention rate: {{:.1f}}%', "retentionRate" * 100) FROM kpi) AS ret,
           (SELECT 'Churn-risk customers: ' || "churnRiskCustomers" FROM kpi) AS churn,
           {AT_RISK_SHARE} >= 0.15 AS sizable, {EVIDENCE} AS evidence, {ACTION} AS action),
  p AS (SELECT min(p) AS p FROM ({anova_ctes(DEVICE_TEST)} SELECT p FROM t))"""


def answers(messages: str, extra: str = "") -> str:
    return f"""WITH {feature_ctes("orders")}, {kpi_cte()}, {ANSWER_CTES},
  msg AS ({messages}),
  cnt AS (
    SELECT d, (SELECT count(*) FROM g, a WHERE d >= 0
                 AND last_order >= e - to_days(CAST(d AS INTEGER))) AS active
    FROM (SELECT DISTINCT d FROM msg)),
  routed AS (
    SELECT msg.*, active, CASE
      WHEN contains(m, 'active') THEN 'active'
      WHEN contains(m, 'retention') THEN 'retention'
      WHEN contains(m, 'churn') OR contains(m, 'at risk') THEN 'churn'
      WHEN contains(m, 'test') OR contains(m, 'significant') THEN 'test'
      WHEN sizable OR p < 0.05 THEN 'summary' ELSE 'fallback' END AS intent
    FROM msg JOIN cnt ON msg.d = cnt.d, texts, p)
  SELECT conv_id, turn, role, {extra} intent, CASE intent
      WHEN 'active' THEN 'Active customers: ' || active
      WHEN 'retention' THEN ret
      WHEN 'churn' THEN churn || CASE WHEN sizable THEN ' ' || evidence || ' ' || action ELSE '' END
      WHEN 'test' THEN CASE WHEN p < 0.05
        THEN format('Avg order value differs by device_type was significant (p={{:.4f}}).', p)
        ELSE 'No statistically significant tests were detected for the current dataset and range.' END
      WHEN 'summary' THEN 'Here are the top insights for the last ' || d || ' days: '
        || concat_ws(' ',
          CASE WHEN sizable THEN '- At-risk segment is sizable: ' || evidence || ' Action: ' || action END,
          CASE WHEN p < 0.05 THEN '- Statistically significant pattern detected: '
            || format('Avg order value differs by device_type (p={{:.4f}}).', p)
            || ' Action: Use this segment dimension when designing offers or UX changes.' END)
      ELSE 'I can answer questions about active customers, retention, churn risk, and detected '
        || 'patterns, but I don''t have enough computed insights yet.' END AS answer
  FROM routed, texts, p"""


# Columns of the given tables: t text, n number, d time, o other; with the names that types have in reports.
COLUMNS = {
    "region": "r_regionkey n int, r_name t string",
    "nation": "n_nationkey n int, n_name t string, n_regionkey n int",
    "customer": "c_custkey n bigint, c_name t string, c_nationkey n int, c_acctbal n double, c_mktsegment t string",
    "supplier": "s_suppkey n bigint, s_name t string, s_nationkey n int, s_acctbal n double",
    "part": "p_partkey n bigint, p_name t string, p_brand t string, p_type t string, p_size n int, p_retailprice n double",
    "orders": "o_orderkey n bigint, o_custkey n bigint, o_orderstatus t string, o_totalprice n double,"
    " o_orderdate d timestamp_ntz, o_orderpriority t string",
    "lineitem": "l_orderkey n bigint, l_partkey n bigint, l_suppkey n bigint, l_linenumber n int, l_quantity n double,"
    " l_extendedprice n double, l_discount n double, l_tax n double, l_returnflag t string, l_linestatus t string,"
    " l_shipdate d timestamp_ntz",
    "events": "event_id n bigint, ts d timestamp_ntz, user_id n bigint, event_type t string, value n double, props t string",
    "documents": "doc_id n bigint, text t string, lang t string, source t string, n_chars n bigint",
    "embeddings": "vec_id n bigint, embedding o array<float>, label n int",
    "pages": "page_id n bigint, url t string, html t string",
    "benchmark": "item_id n bigint, text t string",
    "labels": "doc_id n bigint, quality n int, toxic n int",
    "conversations": "conv_id n bigint, turn n bigint, role t string, text t string",
}


def column_profile(table: str, columns: list[list[str]]) -> str:
    parts = []
    for i, (name, kind, dtype) in enumerate(columns):
        text = {"t": f"left({name}, 64)", "d": f"strftime({name}, '%Y-%m-%d %H:%M:%S')"}.get(kind, "CAST(NULL AS VARCHAR)")
        number = f"CAST({name} AS DOUBLE)" if kind == "n" else "CAST(NULL AS DOUBLE)"
        keys = f"count(DISTINCT {name})" if i == 0 else "CAST(NULL AS BIGINT)"
        parts.append(f"""SELECT '{table}' AS table_name, {i} AS position, '{name}' AS "column", '{dtype}' AS type,
          count(*) AS rows, count(*) - count({name}) AS nulls, min({text}) AS least_text, max({text}) AS greatest_text,
          round(min({number}), 4) AS least_number, round(max({number}), 4) AS greatest_number, {keys} AS distinct_keys FROM {table}""")
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    sql = {}

    sql["clean_transactions"] = sql["tab_file_transactions"] = CLEAN_TRANSACTIONS
    sql["clean_customers"] = """
      SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
             CASE WHEN c_custkey % 6 <> 0
                  THEN CAST('2020-01-1' || (c_custkey % 10) AS TIMESTAMP) END
               AS account_creation_date,
             CASE WHEN c_custkey % 8 <> 0 THEN c_name END AS name,
             CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS avg_session_time_min,
             CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey % 12 AS DOUBLE) END
               AS wishlist_items_count
      FROM customer WHERE c_custkey % 31 <> 0"""

    sql["anchor_window"] = f"""SELECT date_trunc('day', max(order_datetime)) - INTERVAL 30 DAY AS
      "start", date_trunc('day', max(order_datetime)) AS "end" FROM ({ORDERS_TX})"""
    sql["anchor_window_events"] = f"""SELECT date_trunc('day', max(order_datetime))
      - INTERVAL 7 DAY AS "start", date_trunc('day', max(order_datetime)) AS "end"
      FROM ({EVENTS_TX})"""
    sql["rfm_features"] = sql["streaming_refresh"] = on_features(RFM)
    sql["rfm_features_events"] = on_features(RFM, "events")
    sql["streaming_batches"] = f"""SELECT f.*, round(v.aov, 6) AS aov FROM ({on_features(RFM)}) f
      JOIN (SELECT customer_id, avg(total_amount) AS aov FROM ({ORDERS_TX}) GROUP BY 1) v
        ON f.customer_id = v.customer_id"""
    sql["rfm_90d"] = on_features(
        "SELECT customer_id, frequency90d, round(monetary90d, 2) AS monetary90d FROM g"
    )
    sql["recency_days_events"] = on_features(
        'SELECT customer_id, last_order, "recencyDays" FROM g', "events"
    )
    sql["customer_attributes"] = on_features("""SELECT customer_id, name, device_type,
      round(avg_session_time_min, 6) AS avg_session_time_min, wishlist_items_count, location
      FROM base""")
    sql["segment_thresholds"] = on_features("""SELECT round(m75, 4) AS monetary_q75,
      round(f75, 4) AS frequency_q75, round(r50, 4) AS recency_q50,
      round(r75, 4) AS recency_q75 FROM lim""")
    for suffix, mapping in (("", "orders"), ("_events", "events")):
        sql[f"segments{suffix}"] = on_features(SEGMENTS, mapping)
        sql[f"segment_counts{suffix}"] = on_features(SEGMENT_COUNTS, mapping)
        sql[f"rule_churn{suffix}"] = on_features(RULE_SCORES, mapping)
        sql[f"headline_kpis{suffix}"] = on_kpis(KPIS, mapping)
        sql[f"clv_trend{suffix}"] = on_features(TREND, mapping)
        sql[f"top_customers{suffix}"] = on_features(TOP, mapping)
        sql[f"facts{suffix}"] = on_kpis(FACTS, mapping)
        sql[f"churn_alerts{suffix}"] = on_features(ALERTS, mapping)
    sql["churn_alerts_early"] = on_features(ALERTS.replace("0.75", "0.1"))
    sql["question_answers_significant"] = f"""
      WITH risk AS (WITH {feature_ctes("orders")}, {kpi_cte()}
        SELECT format('Retention rate: {{:.1f}}%', "retentionRate" * 100) AS ret,
               {AT_RISK_SHARE} >= 0.15 AS sizable, {EVIDENCE} AS evidence, {ACTION} AS action FROM kpi),
      found AS ({anova_ctes(SPEND_BANDS)} SELECT test, p FROM t WHERE p < 0.05),
      ordered AS (SELECT test, p, row_number() OVER (ORDER BY place) AS k
                  FROM found JOIN (VALUES {", ".join(f"('{n}', {i})" for i, n in enumerate(SPEND_BANDS))}) v(test, place) USING (test)),
      bullets AS (
        SELECT CASE WHEN sizable THEN '- At-risk segment is sizable: ' || evidence || ' Action: ' || action || ' ' ELSE '' END
          || (SELECT string_agg('- Statistically significant pattern detected: ' || format('{{}} (p={{:.4f}}).', test, p)
                || ' Action: Use this segment dimension when designing offers or UX changes.', ' ' ORDER BY k)
              FROM ordered WHERE k <= CASE WHEN sizable THEN 2 ELSE 3 END) AS text FROM risk),
      msg AS (SELECT conv_id, turn, role,
                lower(trim(role || ['', ' any test?', ' SIGNIFICANT', ' retention'][conv_id % 4 + 1])) AS m FROM conversations),
      routed AS (SELECT *, CASE WHEN contains(m, 'retention') THEN 'retention'
                   WHEN contains(m, 'test') OR contains(m, 'significant') THEN 'test' ELSE 'summary' END AS intent FROM msg)
      SELECT conv_id, turn, role, intent, CASE intent WHEN 'retention' THEN ret
          WHEN 'test' THEN (SELECT format('{{}} was significant (p={{:.4f}}).', test, p) FROM ordered WHERE k = 1)
          ELSE 'Here are the top insights for the last 30 days: ' || bullets.text END AS answer
      FROM routed, risk, bullets"""
    # The order-value test is not significant for either mapping, so one rule can fire.
    sql["insights"] = f"""WITH {feature_ctes("orders")},
      p AS (SELECT min(p) AS p FROM ({anova_ctes(DEVICE_TEST)} SELECT p FROM t))
      {INSIGHTS}
      UNION ALL SELECT 'Statistically significant pattern detected', 'info',
        format('Avg order value differs by device_type (p={{:.4f}}).', p),
        'Use this segment dimension when designing offers or UX changes.'
      FROM p WHERE p < 0.05"""
    sql["csv_folder_kpis"] = sql["headline_kpis"]
    sql["streaming_segments"] = on_features(SEGMENTS)
    sql["response_fields"] = on_kpis(f"""SELECT 30 AS days, CAST((SELECT e FROM a) AS DATE) AS "end",
      "activeCustomers" AS active, round("avgCustomerValue", 4) AS average,
      "churnRiskCustomers" AS risky, round("retentionRate", 6) AS retention,
      (SELECT min(segment) FROM feats) AS segment,
      (SELECT count(*) FROM feats WHERE segment = (SELECT min(segment) FROM feats))
        AS segment_size,
      (SELECT max(month) FROM ({TREND})) AS trend_month,
      (SELECT arg_max(value, month) FROM ({TREND})) AS trend_value,
      (SELECT id FROM ({TOP}) LIMIT 1) AS top_id,
      (SELECT id FROM ({TOP}) LIMIT 1 OFFSET 11) AS last_id,
      'rule_only' AS model, 'ANOVA' AS method, 'warning' AS severity,
      'Active customers: ' || "activeCustomers" AS fact FROM kpi""")
    sql["insights_events"] = on_features(INSIGHTS, "events")
    sql["active_customers"] = on_features(
        "SELECT DISTINCT customer_id FROM tx, a WHERE order_datetime BETWEEN s AND e", days=90
    )
    sql["active_flag"] = on_features("""
      SELECT c_custkey AS customer_id, c_custkey IN (
        SELECT customer_id FROM tx, a WHERE order_datetime BETWEEN s AND e)
        AS "isActiveInWindow" FROM customer""")

    for suffix, tx in (("", ORDERS_TX), ("_events", EVENTS_TX)):
        sql[f"aov_by_customer{suffix}"] = (
            f"SELECT customer_id, round(avg(total_amount), 6) AS aov FROM ({tx}) GROUP BY 1"
        )
    sql["anova_groups"] = f"""{anova_ctes(DEVICE_TEST)}
      SELECT test, grp AS "group", n, round(mean, 4) AS mean, round(v, 0) AS variance FROM m"""
    f_and_p = "SELECT test, df_between, df_within, round(f, 6) AS f, round(p, 6) AS p FROM t"
    sql["anova_f"] = f"{anova_ctes(DEVICE_TEST)} {f_and_p}"
    two = {"order value by device": "device_type", "order value by location": "location"}
    sql["anova_many"] = f"{anova_ctes(two)} {f_and_p}"
    sql["test_result"] = sql["test_result_tables"] = f"""{anova_ctes(DEVICE_TEST)}
      SELECT test AS name, 'ANOVA' AS method, round(p, 6) AS "pValue",
        CASE WHEN p < 0.05 THEN 'significant' ELSE 'not_significant' END AS result FROM t"""

    banded = anova_ctes(SPEND_BANDS)
    sql["significant_tests"] = f"""{banded}
      SELECT test AS name, 'ANOVA' AS method, round(p, 6) AS "pValue",
        CASE WHEN p < 0.05 THEN 'significant' ELSE 'not_significant' END AS result FROM t"""
    places = ", ".join(f"('{name}', {i})" for i, name in enumerate(SPEND_BANDS))
    sql["significant_insights"] = f"""
      WITH risk AS (WITH {feature_ctes("orders")} SELECT * FROM ({INSIGHTS})),
      found AS ({banded} SELECT test, p FROM t WHERE p < 0.05),
      places(test, place) AS (VALUES {places})
      SELECT * FROM risk UNION ALL
      SELECT 'Statistically significant pattern detected', 'info', format('{{}} (p={{:.4f}}).', test, p),
        'Use this segment dimension when designing offers or UX changes.'
      FROM (SELECT test, p FROM found JOIN places USING (test) ORDER BY place
            LIMIT 6 - (SELECT count(*) FROM risk))"""

    sql["churn_labels"] = on_features("""SELECT customer_id, "recencyDays",
      CASE WHEN "recencyDays" >= 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label_churn
      FROM base""")
    sql["feature_matrix"] = on_features("""SELECT customer_id,
      CAST("recencyDays" AS DOUBLE) AS "recencyDays",
      CAST(frequency90d AS DOUBLE) AS frequency90d, round(monetary90d, 2) AS monetary90d,
      round(coalesce(avg_session_time_min, 0), 6) AS avg_session_time_min,
      coalesce(wishlist_items_count, 0) AS wishlist_items_count FROM base""")
    sql["split_assignment"] = on_features("""SELECT customer_id, label_churn,
      row_number() OVER (PARTITION BY label_churn ORDER BY draw)
        <= ceil(count(*) OVER (PARTITION BY label_churn) / 4.0) AS is_test
      FROM (SELECT customer_id, ('0x' || substr(md5(CAST(customer_id AS VARCHAR)), 1, 13))::BIGINT AS draw,
        CASE WHEN "recencyDays" >= 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label_churn
        FROM base)""")
    # Newton steps for an intercept and one coefficient, the penalty on the latter alone. Steps are
    # halved while they are long, so that the start does not overshoot.
    one_input = f"""WITH RECURSIVE {feature_ctes("orders")},
      drawn AS (SELECT customer_id, CAST(frequency90d AS DOUBLE) AS x,
          ('0x' || substr(md5(CAST(customer_id AS VARCHAR)), 1, 13))::BIGINT AS draw,
          CASE WHEN "recencyDays" >= 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM base),
      parted AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY draw)
          <= ceil(count(*) OVER (PARTITION BY y) / 4.0) AS is_test FROM drawn),
      train AS (SELECT x, y, count(*) AS n FROM parted WHERE NOT is_test GROUP BY x, y),
      fit(i, a, b) AS (
        SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
        UNION ALL
        SELECT i + 1, a + s * (g0 * h11 - g1 * h01), b + s * (g1 * h00 - g0 * h01) FROM (
          SELECT *, least(1.0, 1.0 / greatest(abs(g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01),
                                              abs(g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01), 1e-9))
                    / (h00 * h11 - h01 * h01) AS s FROM (
            SELECT i, a, b, sum(n * (y - p)) AS g0, sum(n * (y - p) * x) - b AS g1,
                   sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * x) AS h01,
                   sum(n * p * (1 - p) * x * x) + 1 AS h11
            FROM (SELECT i, a, b, x, y, n, 1 / (1 + exp(-(a + b * x))) AS p FROM fit, train WHERE i < 60)
            GROUP BY i, a, b))),
      last AS (SELECT a, b FROM fit WHERE i = 60),
      scored AS (SELECT customer_id, y, is_test, 1 / (1 + exp(-(a + b * x))) AS p FROM parted, last)"""
    sql["lr_one_input_score"] = f"""{one_input}
      SELECT customer_id, round(p, 3) AS "churnRisk" FROM scored"""
    sql["lr_one_input_metrics"] = f"""{one_input},
      ranked AS (SELECT y, p, (rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p)::DOUBLE / 2 - 0.5) AS r
                 FROM scored WHERE is_test)
      SELECT 'logistic_regression' AS type, 'frequency90d' AS features,
        round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2)
              / (sum(y) * (count(*) - sum(y))), 6) AS auc,
        round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM ranked"""
    modeled = f"WITH RECURSIVE {model_ctes('orders')}"
    metrics = """,
      metrics AS (
        SELECT (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc,
               avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
        FROM (SELECT y, p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p)::DOUBLE / 2 - 0.5 AS r
              FROM scored WHERE is_test))"""
    sql["response_document"] = document(
        "orders", 30, "modeled", [c.strip('"') for c in MODEL_INPUTS], "churned if no purchase in last 60 days", metrics
    )
    sql["response_document_events"] = document(
        "events", 7, "feats", ["recencyDays", "frequency90d", "monetary90d"], "churned if recencyDays >= 60"
    )
    sql["lr_score"] = f"""{modeled} SELECT customer_id, round(p, 4) AS "churnRisk" FROM scored"""
    sql["lr_metrics"] = f"""{modeled}{metrics}
      SELECT 'logistic_regression' AS type, 'churned if no purchase in last 60 days' AS "labelRule",
        'recencyDays,frequency90d,monetary90d,avg_session_time_min,wishlist_items_count' AS features,
        round(auc, 4) AS auc, round(accuracy, 4) AS accuracy FROM metrics"""
    sql["headline_kpis_model"] = f"{modeled}, {kpi_cte('', 'modeled')} {KPIS}"
    sql["top_customers_model"] = f"{modeled} {TOP.replace('feats', 'modeled')}"
    sql["model_record_events"] = """SELECT 'rule_only' AS type,
      'churned if recencyDays >= 60' AS "labelRule",
      'recencyDays,frequency90d,monetary90d' AS features, CAST(NULL AS DOUBLE) AS auc,
      CAST(NULL AS DOUBLE) AS accuracy"""

    sql["question_answers"] = answers(
        "SELECT conv_id, turn, role, lower(trim(text)) AS m, 30 AS d FROM conversations"
    )
    sql["question_answers_days"] = answers(
        """SELECT conv_id, turn, role,
             lower(text || ['', ' ACTIVE users', ' Retention?', ' churn', ' At Risk',
               ' at-risk', ' significant'][conv_id % 7 + 1]) AS m,
             CASE WHEN turn % 3 <> 2 THEN CAST((conv_id % 50) * 20 - 40 AS INTEGER) END AS days,
             coalesce(nullif(CASE WHEN turn % 3 <> 2
               THEN CAST((conv_id % 50) * 20 - 40 AS INTEGER) END, 0), 30) AS d
           FROM conversations""",
        "days,",
    )

    sql["kpi_display"] = on_kpis(f"""SELECT kpi, text, 'none' AS direction, '' AS delta_text,
      label FROM ({KPI_CARDS})""")
    sql["kpi_display_changes"] = f"""{changes("events", 7)}, cards AS ({KPI_CARDS})
      SELECT cards.kpi, text,
        CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'none' END AS direction,
        CASE WHEN delta IS NULL THEN '' WHEN delta > 0 THEN format('+{{:.1f}}%', delta * 100)
             WHEN delta < 0 THEN format('-{{:.1f}}%', abs(delta) * 100) ELSE '0.0%' END
          AS delta_text, label
      FROM cards LEFT JOIN ch ON cards.kpi = ch.kpi"""
    sql["top_customers_display"] = on_features("""
      SELECT CAST(customer_id AS VARCHAR) AS id,
        coalesce(name, CAST(customer_id AS VARCHAR)) AS name, segment,
        "recencyDays" || ' days' AS recency, frequency,
        '$' || format('{:,}', CAST(floor(monetary + 0.5) AS BIGINT)) AS monetary,
        round("churnRisk", 6) AS churn,
        CASE WHEN "churnRisk" > 0.7 THEN 'high' WHEN "churnRisk" > 0.3 THEN 'medium'
             ELSE 'low' END AS churn_band,
        format('{:.0f}%', "churnRisk" * 100) AS churn_text
      FROM feats ORDER BY feats.monetary DESC, customer_id LIMIT 12""")
    sql["segment_display"] = on_features("""
      SELECT CASE segment WHEN 'Top Buyer' THEN 'Top Buyers' ELSE segment END AS name,
        count(*) AS value FROM feats GROUP BY 1""")

    sql["stock_risk"] = f"""WITH {INVENTORY}
      SELECT count(*) AS rows_at_risk, count(DISTINCT sku) AS skus_at_risk FROM inv
      WHERE stock_level < reorder_threshold"""
    sql["stock_risk_by_category"] = f"""WITH {INVENTORY}
      SELECT p_type AS category, count(DISTINCT sku) AS skus_at_risk
      FROM inv JOIN part ON sku = p_partkey WHERE stock_level < reorder_threshold GROUP BY 1"""
    sql["sku_outlook"] = f"{OUTLOOK} SELECT * FROM outlook"
    sql["top_skus"] = f"""{OUTLOOK}
      SELECT t.*, p_name AS name, p_type AS category FROM (
        SELECT * FROM outlook ORDER BY predicted_demand DESC, sku LIMIT 8) t
      LEFT JOIN part ON t.sku = p_partkey"""
    sql["reorder_alerts"] = f"""{OUTLOOK}
      SELECT sku, stock, predicted_demand, days_to_stock_out FROM outlook WHERE risk = 'High'"""
    sql["reorder_message"] = f"""{OUTLOOK}
      SELECT sku, round(days, 4) AS days_to_stock_out,
        (SELECT count(*) FROM o WHERE days <= 3) AS sku_count FROM o WHERE days <= 3"""
    sql["inventory_turnover"] = f"""WITH {INVENTORY},
      sc AS (SELECT sum(units * p_retailprice) AS sold_cost FROM sold JOIN part ON
             sku = p_partkey, la
             WHERE sold_at >= e - INTERVAL 364 DAY AND sold_at < e + INTERVAL 1 DAY),
      hc AS (SELECT sum(stock_level * p_retailprice) AS stock_cost
             FROM inv JOIN part ON sku = p_partkey)
      SELECT round(sold_cost, 2) AS sold_cost, round(stock_cost, 2) AS stock_cost,
        round(sold_cost / stock_cost, 6) AS turnover FROM sc, hc"""
    sql["weekly_forecast"] = f"""WITH {INVENTORY},
      w AS (SELECT CAST(date_trunc('week', sold_at) AS DATE) AS week, sum(revenue) AS actual
            FROM sold GROUP BY 1),
      cal AS (SELECT CAST(date_trunc('week', e) AS DATE) + 7 * CAST(i AS INTEGER) AS week, i
              FROM la, generate_series(-7, 2) s(i)),
      fc AS (SELECT cal.week, i, actual, avg(actual) OVER (
               ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS forecast
             FROM cal LEFT JOIN w ON cal.week = w.week)
      SELECT week, round(actual, 2) AS actual, round(forecast, 2) AS forecast
      FROM fc WHERE i > -4"""
    sql["revenue_forecast"] = f"""WITH {INVENTORY},
      d AS (SELECT CAST(sold_at AS DATE) AS day, sum(revenue) AS revenue FROM sold GROUP BY 1),
      r AS (SELECT max(day) AS last_day,
              regr_slope(revenue, day - DATE '1970-01-01') AS slope,
              regr_intercept(revenue, day - DATE '1970-01-01') AS intercept FROM d)
      SELECT last_day, round(slope, 4) AS slope, round((
        SELECT sum(intercept + slope * ((last_day - DATE '1970-01-01') + i))
        FROM generate_series(1, 30) s(i)), 2) AS forecast FROM r"""
    sql["monthly_figures"] = f"""SELECT strftime(order_datetime, '%Y-%m') AS month,
      count(DISTINCT customer_id) AS users, round(sum(total_amount), 2) AS revenue
      FROM ({ORDERS_TX}) GROUP BY 1"""
    sql["visits_per_weekday"] = """SELECT CAST(isodow(ts) - 1 AS INTEGER) AS position,
      strftime(any_value(ts), '%a') AS weekday, count(*) AS visits FROM events GROUP BY 1"""
    sql["device_share"] = """SELECT c_mktsegment AS name, count(*) AS n,
      round(count(*) / (SELECT count(*) FROM customer), 6) AS share FROM customer GROUP BY 1"""
    sql["product_growth"] = f"{GROWTH} SELECT sku, current, previous, growth FROM growth"
    sql["trending_products"] = f"""{GROWTH} SELECT sku, current, previous, growth FROM growth
      WHERE raw_growth IS NOT NULL ORDER BY raw_growth DESC, sku LIMIT 3"""

    def profile(name: str, key: str, ts: str | None, columns: int) -> str:
        first, last = (f"min({ts})", f"max({ts})") if ts else ("NULL", "NULL")
        return f"""SELECT '{name}' AS table_name, count(*) AS row_count,
          {columns} AS column_count, CAST({first} AS DATE) AS first_date,
          CAST({last} AS DATE) AS last_date, count(DISTINCT {key}) AS distinct_keys FROM {name}"""

    sql["table_profiles"] = " UNION ALL ".join(
        [
            profile("orders", "o_custkey", "o_orderdate", 6),
            profile("lineitem", "l_partkey", "l_shipdate", 11),
            profile("events", "user_id", "ts", 6),
            profile("customer", "c_custkey", None, 5),
        ]
    )
    sql["column_profiles"] = " UNION ALL ".join(
        column_profile(name, [c.split() for c in columns.split(", ")]) for name, columns in COLUMNS.items()
    )
    sql["table_preview"] = "SELECT * FROM customer ORDER BY c_custkey LIMIT 5"
    sql["cleaning_report"] = f"""WITH {DIRTY},
      exported AS (SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE repeated),
      known AS (
        SELECT nullif(order_id, '') AS order_id, nullif(customer_id, 'NA') AS customer_id,
               order_datetime, nullif(total_amount, 'n/a') AS total_amount, quantity,
               coupon_applied FROM exported),
      kept AS (
        SELECT * FROM known WHERE order_id IS NOT NULL AND customer_id IS NOT NULL
          AND try_cast(order_datetime AS TIMESTAMP) IS NOT NULL
          AND try_cast(trim(total_amount) AS DOUBLE) IS NOT NULL)
      SELECT (SELECT count(*) FROM known) AS rows_total, count(*) AS rows_retained,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM kept)) AS duplicates,
        round(count(*) / (SELECT count(*) FROM known), 6) AS retained_share FROM kept"""
    policies = [("3 Months", 3), ("6 Months", 6), ("1 Year", 12), ("2 Years", 24)]
    sql["retention_summary"] = f"WITH {feature_ctes('orders')} " + " UNION ALL ".join(
        [
            f"""SELECT '{name}' AS policy, count(*) AS kept_rows,
            round(sum(total_amount), 2) AS kept_amount FROM tx, a
            WHERE order_datetime >= CAST(e AS DATE) - INTERVAL {months} MONTH"""
            for name, months in policies
        ]
        + ["SELECT 'Forever', count(*), round(sum(total_amount), 2) FROM tx"]
    )
    sql["retained_orders"] = on_features("""SELECT strftime(order_datetime, '%Y-%m') AS month,
      count(*) AS kept_rows FROM tx, a
      WHERE order_datetime >= CAST(e AS DATE) - INTERVAL 6 MONTH GROUP BY 1""")
    change_rows = """SELECT kpi, round(value, 4) AS value, round(previous, 4) AS previous,
      round(delta, 6) AS "deltaPct" FROM ch"""
    sql["kpi_changes"] = f"{changes('orders', 30)} {change_rows}"
    sql["kpi_changes_model"] = f"{changes('orders', 90, True)} {change_rows}"
    sql["kpi_changes_events"] = f"{changes('events', 7)} {change_rows}"
    sql["retention_by_segment"] = on_features("""SELECT segment, count(*) AS customers,
      round(avg(CASE WHEN frequency >= 2 THEN 1.0 ELSE 0.0 END), 6) AS "retentionRate"
      FROM feats GROUP BY 1""")
    sql["stored_result"] = f"""WITH {feature_ctes("orders")}
      SELECT *, 30 AS days, (SELECT CAST(e AS DATE) FROM a) AS anchor FROM ({SEGMENT_COUNTS})"""
    sql["csv_report"] = f"""WITH {feature_ctes("orders")}
      SELECT 'segments' AS section, name, CAST(value AS DOUBLE) AS value
      FROM ({SEGMENT_COUNTS}) UNION ALL SELECT 'clvTrend', month, value FROM ({TREND})"""
    return sql
