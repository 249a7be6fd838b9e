"""Independent SQL for the registered queries, for an engine other than Spark.

The customer view and the scorecard are written out again here, with DECIMAL
money and plain SQL, from their definition and not from the DataFrame code.
DOUBLE literals carry an exponent: a bare 0.45 would be DECIMAL.
"""

from __future__ import annotations

from itertools import combinations

from stayline.catalogue import (
    CATEGORICAL, CHURN_FEATURES, CLV_FEATURES, CUSTOMER_COLUMNS, ENCODED, FEATURE_NAMES,
    INPUT_NAMES, RFM_FEATURES, SEGMENTS,
)
from stayline.operators.explore import HISTOGRAM_COLUMNS
from stayline.operators.offers import FULL_TEXTS, SHORT_TEXTS, SINGLE_TEXTS, URGENCY
from stayline.operators.scenarios import ACTIONS
from stayline.sources.exports import BULK_COLUMNS, TOP_RISK_COLUMNS

CUSTOMERS = """
o AS (
  SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders),
o_facts AS (
  SELECT o_custkey,
         count(*) FILTER (WHERE d < DATE '2000-01-01') AS prior_orders,
         min(d) FILTER (WHERE d < DATE '2000-01-01') AS first_day,
         max(d) FILTER (WHERE d < DATE '2000-01-01') AS last_day,
         sum(amount) FILTER (WHERE d < DATE '2000-01-01') AS prior_amount,
         sum(amount) AS all_amount,
         count(*) FILTER (WHERE d >= DATE '2000-01-01' AND d < DATE '2000-06-29') AS label_orders
  FROM o GROUP BY o_custkey),
l AS (
  SELECT o_custkey, p_type, l_returnflag, CAST(l_discount AS DECIMAL(18,2)) AS discount,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue
  FROM lineitem JOIN o ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
  WHERE d < DATE '2000-01-01'),
l_facts AS (
  SELECT o_custkey, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returns,
         sum(discount) AS discount FROM l GROUP BY o_custkey),
l_best AS (
  SELECT o_custkey, p_type FROM (
    SELECT o_custkey, p_type,
           row_number() OVER (PARTITION BY o_custkey ORDER BY sum(revenue) DESC, p_type) AS pos
    FROM l WHERE p_type IS NOT NULL GROUP BY o_custkey, p_type) WHERE pos = 1),
e_facts AS (
  SELECT user_id, count(*) AS n,
         count(*) FILTER (WHERE event_type = 'view') AS views,
         count(*) FILTER (WHERE event_type = 'click') AS clicks,
         count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
         count(*) FILTER (WHERE event_type = 'error') AS errors,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM events GROUP BY user_id),
cust AS (
  SELECT c_custkey AS CustomerID,
    CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS Gender,
    CAST(18 + (c_custkey * 7) % 47 AS INTEGER) AS Age,
    n_name AS Location,
    CAST(greatest(1, (DATE '2000-01-01' - first_day) // 30) AS INTEGER) AS MembershipPeriod,
    l_best.p_type AS PreferredCategory,
    CAST(CASE WHEN n > 0 THEN least(29, views) ELSE 10 END AS INTEGER) AS VisitFrequency,
    CASE WHEN n > 0 THEN greatest(2e0, least(45e0, total / n)) ELSE 20e0 END AS AvgSessionTime,
    CAST(CASE WHEN n > 0 THEN least(19, clicks) ELSE 8 END AS INTEGER) AS PagesViewed,
    CAST(12 * prior_orders AS DOUBLE) / greatest(1, (DATE '2000-01-01' - first_day) // 30)
      AS PurchaseFrequency,
    CAST(prior_amount AS DOUBLE) / 50e0 / prior_orders AS AvgOrderValue,
    CAST(prior_amount AS DOUBLE) / 50e0 AS TotalSpent,
    CAST(DATE '2000-01-01' - last_day AS INTEGER) AS LastPurchaseDaysAgo,
    CAST(CASE WHEN l_facts.discount * 100 >= 5 * lines THEN 1 ELSE 0 END AS INTEGER)
      AS DiscountUsed,
    CAST(CASE WHEN lines > 0 THEN greatest(1, least(5, 6 - ceil(9e0 * returns / lines))) ELSE 3 END
      AS INTEGER) AS CustomerSatisfaction,
    CAST(CASE WHEN lines > 0 THEN returns ELSE 3 END AS INTEGER) AS ReturnCount,
    CAST(CASE WHEN n > 0 THEN least(4, errors // 5) ELSE 1 END AS INTEGER) AS ComplaintHistory,
    CASE WHEN n < 60 THEN 'Low' WHEN n < 74 THEN 'Medium' WHEN n > 0 THEN 'High' ELSE 'Medium' END
      AS AppUsage,
    CASE WHEN clicks + purchases > 0 THEN CAST(clicks AS DOUBLE) / (clicks + purchases)
      ELSE 0.4e0 END AS CartAbandonRate,
    CAST(CASE WHEN label_orders = 0 THEN 1 ELSE 0 END AS INTEGER) AS ChurnRisk,
    CAST(all_amount AS DOUBLE) / 50e0 AS CLV,
    c_acctbal, c_mktsegment
  FROM customer JOIN o_facts ON c_custkey = o_facts.o_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN l_facts ON c_custkey = l_facts.o_custkey
  LEFT JOIN l_best ON c_custkey = l_best.o_custkey
  LEFT JOIN e_facts ON c_custkey = user_id
  WHERE prior_orders > 0)
"""

PROBABILITY = (
    "greatest(least(0.10e0 + 0.45e0 * least({recency}, 540) / 540e0"
    " + 0.30e0 * (5 - {satisfaction}) / 4e0 + 0.15e0 * {cart} + 0.10e0 * {complaints} / 4e0"
    ", 1e0), 0e0)")
_NAMES = {"recency": "LastPurchaseDaysAgo", "satisfaction": "CustomerSatisfaction",
          "cart": "CartAbandonRate", "complaints": "ComplaintHistory"}
PLAIN_PROBABILITY = PROBABILITY.format(**_NAMES)
VALUE = "0.8e0 * TotalSpent + 4e0 * AvgOrderValue"

_CENTROIDS = (
    ("-0.5e0", "1e0", "1e0", "0.3e0", "1e0"), ("-0.4e0", "0e0", "0e0", "0.6e0", "0e0"),
    ("-0.2e0", "-0.3e0", "-0.3e0", "-0.8e0", "-0.3e0"), ("1.5e0", "-0.7e0", "-0.9e0", "0e0", "-0.8e0"),
)


def _scored(source: str, name: str, clv: str = "CLV", value: str = VALUE) -> str:
    """CTEs adding churn, CLV and nearest-centroid columns to `source`."""
    def distance(c) -> str:
        gaps = [f"(z{m} - ({v}))" for m, v in zip("rfmsc", c)]
        return " + ".join(f"{g} * {g}" for g in gaps)
    distances = ", ".join(f"{distance(c)} AS d{i}" for i, c in enumerate(_CENTROIDS))
    names = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SEGMENTS))
    return f"""
{name}_p AS (
  SELECT *, {PLAIN_PROBABILITY} AS ChurnProb, {value} AS PredCLV FROM {source}),
{name}_z AS (
  SELECT *, CAST(CASE WHEN ChurnProb > 0.5e0 THEN 1 ELSE 0 END AS INTEGER) AS ChurnPred,
    (LastPurchaseDaysAgo - 235e0) / 210e0 AS zr, (PurchaseFrequency - 1.75e0) / 0.6e0 AS zf,
    (TotalSpent - 38000e0) / 16000e0 AS zm, (CustomerSatisfaction - 2.55e0) / 0.86e0 AS zs,
    ({clv} - 50000e0) / 18000e0 AS zc FROM {name}_p),
{name}_d AS (SELECT *, {distances} FROM {name}_z),
{name}_c AS (
  SELECT *, CAST(CASE WHEN d0 <= least(d1, d2, d3) THEN 0 WHEN d1 <= least(d2, d3) THEN 1
    WHEN d2 <= d3 THEN 2 ELSE 3 END AS INTEGER) AS Cluster FROM {name}_d),
{name} AS (SELECT *, CASE Cluster {names} END AS Segment FROM {name}_c)
"""


SCORED = _scored("cust", "scored")

PARTNER = """
partner AS (
  SELECT CustomerID, CASE WHEN c_acctbal < 0 THEN 'U' ELSE Gender END AS Gender, Age,
    CASE WHEN c_acctbal >= 0 THEN Location END AS Location,
    CASE WHEN c_acctbal < 1000 THEN c_mktsegment ELSE PreferredCategory END AS PreferredCategory,
    PurchaseFrequency, AvgOrderValue, TotalSpent, LastPurchaseDaysAgo, CustomerSatisfaction,
    CASE WHEN c_acctbal >= 0 THEN AppUsage END AS AppUsage,
    c_acctbal AS AccountBalance, c_mktsegment AS MarketSegment FROM cust)
"""
PARTNER_NAMES = (
    "CustomerID", "Gender", "Age", "Location", "PreferredCategory", "PurchaseFrequency",
    "AvgOrderValue", "TotalSpent", "LastPurchaseDaysAgo", "CustomerSatisfaction", "AppUsage",
    "AccountBalance", "MarketSegment",
)
_SQL_TYPE = {"int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "long": "BIGINT"}


def _filled_column(spec) -> str:
    if spec.name in PARTNER_NAMES:
        return spec.name
    literal = f"'{spec.default}'" if spec.kind == "categorical" else spec.default
    return f"CAST({literal} AS {_SQL_TYPE[spec.spark_type]}) AS {spec.name}"


FILLED = ("filled AS (SELECT CustomerID, "
          + ", ".join(_filled_column(c) for c in CUSTOMER_COLUMNS) + " FROM partner)")


def _clean(unknown: str) -> str:
    """Sanitized categories of `filled`; only Gender and AppUsage defaults are known labels."""
    kept = {"first": {}, "default": {"Gender": "'Male'", "AppUsage": "'Medium'"}}[unknown]
    fixed = ", ".join(
        f"CASE WHEN {c} IN (SELECT {c} FROM cust WHERE {c} IS NOT NULL) THEN {c} ELSE "
        + kept.get(c, f"(SELECT min({c}) FROM cust)") + f" END AS {c}" for c in CATEGORICAL)
    others = ", ".join(c for c in ("CustomerID",) + INPUT_NAMES if c not in CATEGORICAL)
    return f"clean AS (SELECT {others}, {fixed} FROM filled)"


def _pct(value: str, digits: int = 2) -> str:
    scale = f"1e{digits}"
    return f"round_even(({value}) * 100e0 * {scale}, 0) / {scale}"


def _even(value: str, digits: int) -> str:
    return f"round_even(({value}) * 1e{digits}, 0) / 1e{digits}"


def _worded(text: str) -> str:
    quoted = text.replace("'", "''")
    if "{category}" not in text:
        return f"'{quoted}'"
    before, after = quoted.split("{category}")
    return f"concat('{before}', coalesce(PreferredCategory, 'General'), '{after}')"


RULE = """CASE WHEN Segment = 'Lost' AND PredCLV > 50000 THEN 'premium_win_back'
  WHEN Segment = 'Lost' THEN 'win_back'
  WHEN Segment = 'At-Risk' AND ChurnProb > 0.7e0 THEN 'urgent'
  WHEN Segment = 'At-Risk' THEN 'nudge' WHEN Segment = 'Loyal' THEN 'loyalty'
  ELSE 'champions' END"""


def _by_rule(values: dict[str, str]) -> str:
    return "CASE rule " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _offer_columns(texts: dict) -> dict[str, str]:
    columns = {
        "tag": _by_rule({k: f"'{t[0]}'" for k, t in texts.items()}),
        "urgency": _by_rule({k: f"'{u}'" for k, u in URGENCY.items()}),
        "offers": _by_rule({
            k: "concat_ws(' | ', " + ", ".join(_worded(x) for x in t[1]) + ")"
            for k, t in texts.items()}),
    }
    if all(len(t) == 3 for t in texts.values()):
        columns["message"] = _by_rule({k: f"'{t[2]}'" for k, t in texts.items()})
    return columns


def _short(prob: str) -> str:
    t = {k: _worded(v) for k, v in SHORT_TEXTS.items()}
    return (f"CASE WHEN Segment = 'Lost' AND {prob} > 0.7e0 THEN {t['lost_high']}"
            f" WHEN Segment = 'Lost' THEN {t['lost']}"
            f" WHEN Segment = 'At-Risk' AND {prob} > 0.7e0 THEN {t['at_risk_high']}"
            f" WHEN Segment = 'At-Risk' THEN {t['at_risk']}"
            f" WHEN Segment = 'Loyal' THEN {t['loyal']} ELSE {t['other']} END")


STATUS = ("CASE ChurnPred WHEN 0 THEN 'Will Return' WHEN 1 THEN 'Will Churn' ELSE 'Unknown' END")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


C = _with(CUSTOMERS)
S = _with(CUSTOMERS, SCORED)
P = _with(CUSTOMERS, PARTNER)
BULK_VALUE = f"round_even(({VALUE}) * 1e2, 0) / 1e2"


def _bulk(unknown: str = "default") -> str:
    return _with(
        CUSTOMERS, PARTNER, FILLED, _clean(unknown),
        _scored("clean", "bulk_scored", clv="PredCLV", value=BULK_VALUE),
        f"bulk AS (SELECT *, {_pct('ChurnProb')} AS ChurnProbability, {STATUS} AS ChurnStatus,"
        f" {_short('(' + _pct('ChurnProb') + ') / 100e0')} AS RetentionOffer FROM bulk_scored)")


RETENTION_WHERE = ("ChurnPred = 1 AND Segment IN ('Lost', 'At-Risk') AND ChurnProb >= 0.5e0"
                   " AND PredCLV >= 0")


def _retention(sort: str, n: int, columns: str) -> str:
    tags = _by_rule({k: f"'{t[0]}'" for k, t in FULL_TEXTS.items()})
    return S + f"""SELECT {columns}, {_pct('ChurnProb')} AS ChurnProbability, PredCLV,
  {tags} AS RetentionOffer FROM (SELECT *, {RULE} AS rule FROM scored WHERE {RETENTION_WHERE}
  ORDER BY {sort} DESC, CustomerID LIMIT {n})"""


def _list(values) -> str:
    return ", ".join(f"('{v}')" if not isinstance(v, tuple) else
                     "(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in v) + ")"
                     for v in values)


def _non_null(source: str, columns) -> str:
    """(column, nulls, non_null) of a CTE."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count({c}) AS non_null"
        f" FROM {source}" for c in columns)


VIEW_TYPES = (("CustomerID", "bigint"),) + tuple(
    (c.name, c.spark_type) for c in CUSTOMER_COLUMNS) + (("ChurnRisk", "int"), ("CLV", "double"))
NUMERIC_VIEW = [n for n, t in VIEW_TYPES if t != "string"]


def _kpi_dashboard(where: str, money_digits: int = 2) -> str:
    return S + f"""SELECT count(*) AS customers, count(*) FILTER (WHERE ChurnPred = 1) AS at_risk,
  round(coalesce(sum(PredCLV) FILTER (WHERE ChurnPred = 1), 0e0), {money_digits})
    AS revenue_at_risk,
  round(avg(PredCLV), 6) AS avg_clv, count(*) FILTER (WHERE Segment = 'Champions') AS champions,
  round(CASE WHEN count(*) = 0 THEN 0e0 ELSE
    count(*) FILTER (WHERE ChurnPred = 1) / count(*) * 100e0 END, 6) AS churn_pct
FROM scored WHERE {where}"""


def _crosstab(key: str) -> str:
    return C + f"""SELECT {key}, round(avg(1e0 - ChurnRisk), 6) AS will_return,
  round(avg(CAST(ChurnRisk AS DOUBLE)), 6) AS will_churn FROM cust GROUP BY {key}"""


def _describe() -> str:
    return C + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count,
  round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std,
  round(CAST(min({c}) AS DOUBLE), 6) AS min,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75,
  round(CAST(max({c}) AS DOUBLE), 6) AS max FROM cust""" for c in NUMERIC_VIEW)


def _correlation() -> str:
    pairs = list(combinations(sorted(c for c in NUMERIC_VIEW if c != "ChurnRisk"), 2))
    corrs = ", ".join(f"corr({a}, {b}) AS r_{i}" for i, (a, b) in enumerate(pairs))
    rows = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': r_{i}}}" for i, (a, b) in enumerate(pairs))
    return C + (f"SELECT u.a AS a, u.b AS b, round(u.r, 6) AS r FROM"
                f" (SELECT unnest([{rows}]) AS u FROM (SELECT {corrs} FROM cust))")


def _histogram() -> str:
    values = " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST(ChurnRisk AS VARCHAR) AS cls, CAST({c} AS DOUBLE) AS v FROM cust"
        for c in HISTOGRAM_COLUMNS)
    return _with(CUSTOMERS, f"vals AS ({values})", """
bounds AS (
  SELECT col, cls, CASE WHEN min(v) = max(v) THEN min(v) - 0.5e0 ELSE min(v) END AS lo,
    CASE WHEN min(v) = max(v) THEN max(v) + 0.5e0 ELSE max(v) END AS hi
  FROM vals GROUP BY col, cls),
slots AS (
  SELECT col, cls, b, lo + b * ((hi - lo) / 20e0) AS bin_low,
    lo + (b + 1) * ((hi - lo) / 20e0) AS bin_high
  FROM bounds, (SELECT unnest(range(20)) AS b))
""") + """SELECT s.col AS "column", s.cls AS class, CAST(s.b AS BIGINT) AS bin,
  round(s.bin_low, 6) AS bin_low, round(s.bin_high, 6) AS bin_high, count(v.v) AS n
FROM slots s LEFT JOIN vals v ON s.col = v.col AND s.cls = v.cls
  AND (v.v >= s.bin_low OR s.b = 0) AND (v.v < s.bin_high OR s.b = 19)
GROUP BY ALL"""


def _scale(columns, source: str = "cust") -> str:
    stats = ", ".join(f"avg({c}) AS m_{i}, stddev_pop({c}) AS s_{i}"
                      for i, c in enumerate(columns))
    scaled = ", ".join(
        f"round(CASE WHEN s_{i} = 0 THEN {c} - m_{i} ELSE ({c} - m_{i}) / s_{i} END, 6) AS {c}"
        for i, c in enumerate(columns))
    return f"SELECT CustomerID, {scaled} FROM {source}, (SELECT {stats} FROM {source})"


ENCODED_CTE = ("encoded AS (SELECT *, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS BIGINT) AS {e}"
    for c, e in ENCODED.items()) + " FROM cust)")

PROFILE = f"""profile AS (
  SELECT Cluster, count(*) AS Count, {_even('avg(LastPurchaseDaysAgo)', 2)} AS Avg_Recency,
    {_even('avg(PurchaseFrequency)', 2)} AS Avg_Frequency, {_even('avg(TotalSpent)', 2)} AS Avg_Spent,
    {_even('avg(CustomerSatisfaction)', 2)} AS Avg_Satisfaction, {_even('avg(CLV)', 2)} AS Avg_CLV,
    {_even('avg(ChurnRisk)', 2)} AS Churn_Rate FROM scored GROUP BY Cluster)"""
RANKED = """ranked AS (
  SELECT a.Cluster, a.Avg_CLV, a.Churn_Rate,
    (SELECT count(*) FILTER (WHERE b.Avg_CLV > a.Avg_CLV) + 1
      + (count(*) FILTER (WHERE b.Avg_CLV = a.Avg_CLV) - 1) / 2e0 FROM profile b) AS clv_rank,
    (SELECT count(*) FILTER (WHERE b.Churn_Rate < a.Churn_Rate) + 1
      + (count(*) FILTER (WHERE b.Churn_Rate = a.Churn_Rate) - 1) / 2e0 FROM profile b) AS churn_rank
  FROM profile a)"""

CONFUSION = """m AS (
  SELECT CAST(count(*) FILTER (WHERE ChurnRisk = 1 AND ChurnPred = 1) AS DOUBLE) AS tp,
    CAST(count(*) FILTER (WHERE ChurnRisk = 0 AND ChurnPred = 1) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (WHERE ChurnRisk = 1 AND ChurnPred = 0) AS DOUBLE) AS fn,
    CAST(count(*) FILTER (WHERE ChurnRisk = 0 AND ChurnPred = 0) AS DOUBLE) AS tn FROM scored)"""

_REPORT = """r AS (
  SELECT 'Will Return' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS rc, tn + fp AS s FROM m
  UNION ALL SELECT 'Will Churn', tp / (tp + fp), tp / (tp + fn), tp + fn FROM m),
f AS (SELECT class, p, rc, 2 * p * rc / (p + rc) AS f, s FROM r)"""

NEW_VALUES = {
    "disc": "DiscountUsed", "satisfaction": "CustomerSatisfaction",
    "cart_abandon": "CartAbandonRate", "visit_freq_add": "VisitFrequency",
    "last_purchase": "LastPurchaseDaysAgo", "complaint_hist": "ComplaintHistory",
}


def _scenarios() -> str:
    """One SELECT per action, inputs replaced."""
    parts = []
    for i, (label, over) in enumerate(ACTIONS):
        columns = []
        for key, column in NEW_VALUES.items():
            if key not in over:
                columns.append(column)
            elif key == "visit_freq_add":
                columns.append(f"least({column} + {over[key]}, 29) AS {column}")
            elif key == "cart_abandon":
                columns.append(f"{over[key]}e0 AS {column}")
            else:
                columns.append(f"{over[key]} AS {column}")
        parts.append(
            f"SELECT CustomerID, CAST({i} AS BIGINT) AS position, '{label}' AS action,"
            f" {', '.join(columns)}, TotalSpent, AvgOrderValue, {PLAIN_PROBABILITY} AS base FROM cust")
    return "acts AS (" + " UNION ALL ".join(parts) + ")"


SENSITIVITY = f"""sens AS (
  SELECT CustomerID, position, action, base_pct, churn_pct,
    {_even('base_pct - churn_pct', 2)} AS reduction
  FROM (SELECT *, {_pct('base')} AS base_pct, {_pct(PLAIN_PROBABILITY)} AS churn_pct FROM acts))"""
E_ = _with(CUSTOMERS, _scenarios(), SENSITIVITY)

INTERVENED = """iv AS (
  SELECT CustomerID, 1 AS DiscountUsed,
    CAST(least(CustomerSatisfaction + 1, 5) AS INTEGER) AS CustomerSatisfaction,
    greatest(CartAbandonRate - 0.2e0, 0e0) AS CartAbandonRate,
    CAST(least(VisitFrequency + 3, 29) AS INTEGER) AS VisitFrequency,
    CAST(greatest(LastPurchaseDaysAgo - 15, 1) AS INTEGER) AS LastPurchaseDaysAgo,
    CAST(greatest(ComplaintHistory - 1, 0) AS INTEGER) AS ComplaintHistory,
    LastPurchaseDaysAgo AS r0, CustomerSatisfaction AS s0, CartAbandonRate AS k0,
    ComplaintHistory AS h0, TotalSpent, AvgOrderValue FROM cust)"""
_BEFORE = PROBABILITY.format(recency="r0", satisfaction="s0", cart="k0", complaints="h0")


def _offered(texts: dict) -> str:
    columns = ", ".join(f"{v} AS {k}" for k, v in _offer_columns(texts).items())
    return S + (f"SELECT CustomerID, rule, {columns} FROM (SELECT *, {RULE} AS rule FROM scored)")


def _score_select(source: str) -> str:
    return f"SELECT CustomerID, ChurnProb, ChurnPred, PredCLV, Cluster, Segment FROM {source}"


_MONEY = "format('{{:,}}', CAST(round_even({v}, 0) AS BIGINT))"


def _money(value: str, symbol: str = "₹") -> str:
    return f"concat('{symbol}', {_MONEY.replace('{{:,}}', '{:,}').replace('{v}', value)})"


def _fixed(value: str, digits: int, sign: str = "") -> str:
    return f"printf('%{sign}.{digits}f', {_even(value, digits)})"


ROC = _with(CUSTOMERS, SCORED, """
g AS (SELECT ChurnProb AS threshold, count(*) FILTER (WHERE ChurnRisk = 1) AS p,
        count(*) FILTER (WHERE ChurnRisk = 0) AS n FROM scored GROUP BY ChurnProb),
pts AS (SELECT threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp
        FROM g WINDOW w AS (ORDER BY threshold DESC)
        UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0, 0),
tot AS (SELECT CAST(sum(p) AS DOUBLE) AS pp, CAST(sum(n) AS DOUBLE) AS nn FROM g)""")


def all_sql() -> dict[str, str]:
    cat_names = ", ".join(CATEGORICAL)
    sql = {}

    tags = _offer_columns(FULL_TEXTS)
    sql["retention_report"] = S + f"""SELECT CustomerID, Age, Gender, Location, PreferredCategory,
  TotalSpent, Segment, {_pct('ChurnProb')} AS ChurnProbability, PredCLV, {tags['tag']} AS RetentionOffer,
  {tags['urgency']} AS Urgency, {tags['offers']} AS Offers
FROM (SELECT *, {RULE} AS rule FROM scored WHERE {RETENTION_WHERE}
  ORDER BY PredCLV DESC, CustomerID LIMIT 50)"""
    sql["retention_filter"] = S + """SELECT CustomerID, Segment, ChurnProb, PredCLV FROM scored
WHERE ChurnPred = 1 AND Segment IN ('Lost', 'At-Risk') AND ChurnProb >= 0.6e0 AND PredCLV >= 20000"""
    sql["retention_filter_any_segment"] = S + """SELECT CustomerID, Segment, ChurnProb, PredCLV
FROM scored WHERE ChurnPred = 1 AND ChurnProb >= 0.5e0 AND PredCLV >= 0"""
    sql["retention_topn_revenue"] = _retention("PredCLV", 200, "CustomerID, Segment")
    sql["retention_topn_prob"] = _retention("ChurnProb", 50, "CustomerID, Segment")
    sql["at_risk"] = S + "SELECT CustomerID, ChurnProb, ChurnPred FROM scored WHERE ChurnPred = 1"

    present = [c for c in BULK_COLUMNS if c in PARTNER_NAMES]
    sql["select_present"] = P + f"SELECT {', '.join(present)} FROM partner"
    sql["fill_missing_columns"] = _with(CUSTOMERS, PARTNER, FILLED) + "SELECT * FROM filled"
    missing = sorted(c for c in INPUT_NAMES if c not in PARTNER_NAMES)
    statuses = [(c, "missing" if c in missing else "present") for c in INPUT_NAMES]
    statuses += [("AccountBalance", "extra"), ("MarketSegment", "extra")]
    nn = f"nn AS ({_non_null('partner', PARTNER_NAMES)})"
    sql["schema_report"] = _with(CUSTOMERS, PARTNER, nn) + f"""SELECT s.c AS "column", status,
  coalesce(non_null, 0) AS non_null FROM (VALUES {_list(statuses)}) s(c, status)
LEFT JOIN nn ON nn."column" = s.c"""
    provided = len(INPUT_NAMES) - len(missing)
    sql["completeness"] = P + f"""SELECT count(*) AS customers,
  CAST({len(PARTNER_NAMES)} AS BIGINT) AS columns_found, CAST({provided} AS BIGINT) AS provided,
  '{', '.join(missing)}' AS missing,
  CAST(round(100e0 * {provided} / {len(INPUT_NAMES)}) AS BIGINT) AS completeness,
  false AS is_full, 'medium' AS band FROM partner"""
    listing = [(c.name, c.kind.capitalize(), str(c.default),
                "Churn" + (", CLV" if c.name in CLV_FEATURES else "")
                + (", Segmentation" if c.name in RFM_FEATURES else "")) for c in CUSTOMER_COLUMNS]
    sql["column_catalogue"] = _with(CUSTOMERS, PARTNER, nn) + f"""SELECT s.c AS "column",
  s.t AS type, s.d AS default_value, s.r AS required_for,
  coalesce(non_null, 0) AS rows_provided
FROM (VALUES {_list(listing)}) s(c, t, d, r) LEFT JOIN nn ON nn."column" = s.c"""
    sql["null_counts"] = P + _non_null("partner", PARTNER_NAMES)
    types = [(i + 1, n, t) for i, (n, t) in enumerate(VIEW_TYPES)]
    sql["table_profile"] = _with(
        CUSTOMERS, f"nn AS ({_non_null('cust', [n for n, _ in VIEW_TYPES])})"
    ) + f"""SELECT CAST(s.i AS BIGINT) AS position, s.c AS "column", s.t AS dtype,
  nulls + non_null AS rows, non_null FROM (VALUES {_list(types)}) s(i, c, t)
JOIN nn ON nn."column" = s.c"""
    for mode in ("first", "default"):
        sql[f"sanitize_{mode}"] = _with(CUSTOMERS, PARTNER, FILLED, _clean(mode)) + \
            f"SELECT CustomerID, {cat_names} FROM clean"

    sql["describe_numeric"] = _describe()
    sql["correlation_pairs"] = _correlation()
    sql["crosstab_gender"] = _crosstab("Gender")
    sql["crosstab_category"] = _crosstab("PreferredCategory")
    sql["crosstab_app"] = _crosstab("AppUsage")
    sql["histogram_by_class"] = _histogram()
    sql["histogram_probability"] = S + f"""SELECT CAST(b AS BIGINT) AS bin, b * 5e0 AS bin_low,
  (b + 1) * 5e0 AS bin_high, count(v) AS n FROM (SELECT unnest(range(20)) AS b)
LEFT JOIN (SELECT {_pct('ChurnProb')} AS v FROM scored)
  ON v >= b * 5e0 AND (v < (b + 1) * 5e0 OR b = 19) GROUP BY b"""
    sql["distinct_options"] = C + " UNION ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value FROM cust WHERE {c} IS NOT NULL"
        for c in ("Location", "PreferredCategory", "Gender"))
    shown = [(f, FEATURE_NAMES.get(f, f)) for f in CHURN_FEATURES + ("ChurnRisk",)]
    sql["feature_display_names"] = _with(
        CUSTOMERS, ENCODED_CTE, f"nn AS ({_non_null('encoded', [f for f, _ in shown])})"
    ) + f"""SELECT s.f AS feature, nulls, non_null, s.d AS display_name
FROM (VALUES {_list(shown)}) s(f, d) JOIN nn ON nn."column" = s.f"""

    sql["count_by_status"] = S + f"SELECT {STATUS} AS status, count(*) AS n FROM scored GROUP BY 1"
    sql["count_by_label"] = C + "SELECT ChurnRisk, count(*) AS n FROM cust GROUP BY 1"
    sql["count_by_segment"] = S + "SELECT Segment, count(*) AS n FROM scored GROUP BY 1"
    for key, column in (("location", "Location"), ("satisfaction", "CustomerSatisfaction")):
        sql[f"churn_rate_by_{key}"] = S + f"""SELECT {column}, round(avg(ChurnPred), 6) AS churn_rate
FROM scored GROUP BY 1"""
    positions = f"(VALUES {_list([(i, s) for i, s in enumerate(SEGMENTS)])}) s(i, name)"
    sql["clv_by_segment"] = S + f"""SELECT CAST(i AS BIGINT) AS position, name AS Segment,
  round(avg(PredCLV), 6) AS avg_clv FROM {positions} JOIN scored ON Segment = name GROUP BY i, name"""
    sql["clv_by_segment_all"] = S + f"""SELECT CAST(i AS BIGINT) AS position, name AS Segment,
  round(avg(CLV), 6) AS avg_clv FROM {positions}
LEFT JOIN scored ON Segment = name GROUP BY i, name"""
    sql["revenue_at_risk_by_segment"] = S + """SELECT Segment, round(sum(PredCLV), 2) AS revenue
FROM scored WHERE ChurnPred = 1 GROUP BY 1"""
    sql["kpi_dashboard"] = _kpi_dashboard("true")
    sql["kpi_dashboard_filtered"] = _kpi_dashboard("Gender = 'Male' AND Segment = 'Loyal'")
    sql["kpi_dashboard_empty"] = _kpi_dashboard("Segment = 'Unknown'", 6)
    sql["kpi_bulk"] = _bulk() + """SELECT count(*) AS customers,
  count(*) FILTER (WHERE ChurnPred = 1) AS will_churn,
  count(*) FILTER (WHERE ChurnPred = 0) AS will_return,
  round(avg(ChurnPred) * 100e0, 6) AS churn_pct,
  round(coalesce(sum(PredCLV) FILTER (WHERE ChurnPred = 1), 0e0), 2) AS revenue_at_risk,
  round(avg(PredCLV), 6) AS avg_clv FROM bulk"""
    sql["kpi_retention"] = S + """SELECT count(*) AS at_risk,
  count(*) FILTER (WHERE ChurnProb >= 0.7e0) AS critical,
  count(*) FILTER (WHERE PredCLV >= q) AS high_value,
  round(sum(PredCLV), 2) AS revenue_at_risk, round(avg(ChurnProb) * 100e0, 6) AS avg_prob
FROM scored, (SELECT quantile_cont(PredCLV, 0.75) AS q FROM scored WHERE ChurnPred = 1)
WHERE ChurnPred = 1"""
    sql["availability_flags"] = _bulk() + """SELECT bool_or(ChurnStatus <> 'Unknown') AS has_churn,
  bool_or(Segment <> 'Unknown') AS has_segment, bool_or(PredCLV IS NOT NULL) AS has_clv FROM bulk"""
    sql["filter_dashboard"] = S + """SELECT CustomerID, Location, PreferredCategory, Gender, Segment,
  ChurnProb FROM scored
WHERE PreferredCategory = 'PROMO' AND Gender = 'Male' AND Segment = 'Loyal'"""

    sql["churn_status"] = S + f"SELECT CustomerID, ChurnPred, {STATUS} AS status FROM scored"
    sql["risk_band"] = S + f"""SELECT CustomerID, ChurnProb, CASE WHEN ChurnProb < 0.35e0 THEN 'Low'
  WHEN ChurnProb < 0.65e0 THEN 'Medium' ELSE 'High' END AS band,
  {_pct('ChurnProb')} AS percent FROM scored"""
    sql["format_display"] = S + f"""SELECT CustomerID,
  concat({_fixed('ChurnProb * 100e0', 1)}, '%') AS percent_1,
  concat({_fixed('ChurnProb * 100e0', 0)}, '%') AS percent_0,
  concat({_fixed('ChurnProb * 100e0 - 50e0', 1, '+')}, '%') AS signed,
  {_money('PredCLV')} AS rupees,
  concat('₹', {_fixed('TotalSpent / 100000e0', 1)}, 'L') AS lakh,
  concat('₹', {_fixed('PredCLV / 1000e0', 0)}, 'K') AS thousands,
  concat(repeat('★', CustomerSatisfaction), repeat('☆', 5 - CustomerSatisfaction)) AS stars,
  strftime(DATE '2000-01-01' - LastPurchaseDaysAgo, '%d %B %Y') AS last_purchase FROM scored"""

    sql["top10_risk"] = _bulk() + f"""SELECT {', '.join(TOP_RISK_COLUMNS)} FROM bulk
ORDER BY ChurnProbability DESC, CustomerID LIMIT 10"""
    sql["dashboard_records"] = S + """SELECT CustomerID, Gender, Age, Location, PreferredCategory,
  TotalSpent, CustomerSatisfaction, Segment, ChurnProb, PredCLV FROM scored
ORDER BY CustomerID LIMIT 100"""

    sql["segment_lookup"] = S + "SELECT CustomerID, Cluster, Segment FROM scored"
    sql["cluster_profile"] = _with(CUSTOMERS, SCORED, PROFILE) + "SELECT * FROM profile"
    sql["segment_rank"] = _with(CUSTOMERS, SCORED, PROFILE, RANKED) + \
        "SELECT *, clv_rank + churn_rank AS combined_rank FROM ranked"
    sql["segment_map"] = _with(CUSTOMERS, SCORED, PROFILE, RANKED) + f"""SELECT Cluster,
  name AS Segment FROM (SELECT Cluster,
    row_number() OVER (ORDER BY clv_rank + churn_rank, Cluster) - 1 AS pos FROM ranked)
JOIN {positions} ON i = pos"""

    sql["encode_categories"] = _with(CUSTOMERS, ENCODED_CTE) + \
        f"SELECT CustomerID, {', '.join(ENCODED.values())} FROM encoded"
    sql["encoder_classes"] = C + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY label) - 1 AS code, label"
        f" FROM (SELECT DISTINCT {c} AS label FROM cust)" for c in ENCODED)
    sql["scale_churn"] = _with(CUSTOMERS, ENCODED_CTE) + _scale(CHURN_FEATURES, "encoded")
    sql["scale_clv"] = C + _scale(CLV_FEATURES)
    sql["scale_rfm"] = C + _scale(RFM_FEATURES)

    sql["classification_metrics"] = _with(CUSTOMERS, SCORED, CONFUSION) + """SELECT
  CAST(tp + fp + fn + tn AS BIGINT) AS n, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m"""
    sql["confusion_matrix"] = S + """SELECT CAST(a AS BIGINT) AS actual, CAST(p AS BIGINT) AS predicted,
  count(CustomerID) AS n, a = p AS correct FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(a, p)
LEFT JOIN scored ON ChurnRisk = a AND ChurnPred = p GROUP BY a, p"""
    sql["classification_report"] = _with(CUSTOMERS, SCORED, CONFUSION, _REPORT) + """
SELECT class, round(p, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1,
  CAST(s AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round((tp + tn) / (tp + fp + fn + tn), 6),
  CAST(tp + fp + fn + tn AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(rc), 6), round(avg(f), 6),
  CAST(sum(s) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(rc * s) / sum(s), 6),
  round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM f"""
    sql["roc_curve"] = ROC + """SELECT threshold, tp, fp, round(tp / pp, 6) AS tpr,
  round(fp / nn, 6) AS fpr FROM pts, tot"""
    sql["roc_auc"] = S + """SELECT CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives,
  round((s - p * (p + 1) / 2e0) / (p * n), 6) AS auc
FROM (SELECT CAST(count(*) FILTER (WHERE ChurnRisk = 1) AS DOUBLE) AS p,
    CAST(count(*) FILTER (WHERE ChurnRisk = 0) AS DOUBLE) AS n,
    sum(mean_rank) FILTER (WHERE ChurnRisk = 1) AS s
  FROM (SELECT ChurnRisk, rank() OVER (ORDER BY ChurnProb)
          + (count(*) OVER (PARTITION BY ChurnProb) - 1) / 2e0 AS mean_rank FROM scored))"""
    sql["confusion_matrix_by_segment"] = S + """SELECT g.Segment, CAST(a AS BIGINT) AS actual,
  CAST(p AS BIGINT) AS predicted, count(CustomerID) AS n, a = p AS correct
FROM (SELECT DISTINCT Segment FROM scored) g CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(a, p)
LEFT JOIN scored s ON s.Segment = g.Segment AND ChurnRisk = a AND ChurnPred = p
GROUP BY g.Segment, a, p"""
    sql["classification_report_by_segment"] = _with(CUSTOMERS, SCORED, """
y AS (SELECT Segment, k, CASE WHEN k = 0 THEN 'Will Return' ELSE 'Will Churn' END AS class,
    CAST(count(*) FILTER (WHERE ChurnRisk = k AND ChurnPred = k) AS DOUBLE) AS hit,
    count(*) FILTER (WHERE ChurnPred = k) AS said, count(*) FILTER (WHERE ChurnRisk = k) AS s
  FROM scored, (VALUES (0), (1)) v(k) GROUP BY Segment, k),
f AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(s, 0), 0) AS rc,
    coalesce(2 * hit / nullif(said + s, 0), 0) AS f FROM y)""") + """
SELECT Segment, class, round(p, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1,
  CAST(s AS BIGINT) AS support FROM f
UNION ALL SELECT Segment, 'accuracy', NULL, NULL, round(sum(hit) / sum(s), 6), CAST(sum(s) AS BIGINT)
FROM f GROUP BY Segment
UNION ALL SELECT Segment, 'macro avg', round(avg(p), 6), round(avg(rc), 6), round(avg(f), 6),
  CAST(sum(s) AS BIGINT) FROM f GROUP BY Segment
UNION ALL SELECT Segment, 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(rc * s) / sum(s), 6),
  round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM f GROUP BY Segment"""
    sql["roc_curve_by_segment"] = S + """SELECT p.Segment, threshold, tp, fp,
  CASE WHEN pp > 0 THEN round(tp / pp, 6) END AS tpr, CASE WHEN nn > 0 THEN round(fp / nn, 6) END AS fpr
FROM (SELECT DISTINCT Segment, ChurnProb AS threshold,
    count(*) FILTER (WHERE ChurnRisk = 1) OVER w AS tp, count(*) FILTER (WHERE ChurnRisk = 0) OVER w AS fp
  FROM scored WINDOW w AS (PARTITION BY Segment ORDER BY ChurnProb DESC)
  UNION ALL SELECT DISTINCT Segment, CAST('Infinity' AS DOUBLE), 0, 0 FROM scored) p
JOIN (SELECT Segment, CAST(sum(ChurnRisk) AS DOUBLE) AS pp, CAST(sum(1 - ChurnRisk) AS DOUBLE) AS nn
  FROM scored GROUP BY Segment) t ON p.Segment = t.Segment"""

    hashed = "md5(concat(CustomerID, '|42'))"
    parts = _with(CUSTOMERS, f"""parts AS (SELECT CustomerID, ChurnRisk,
  row_number() OVER (PARTITION BY ChurnRisk ORDER BY {hashed})
    <= n - ceil(n * 0.2e0 - 1e-9) AS is_train
  FROM (SELECT *, count(*) OVER (PARTITION BY ChurnRisk) AS n FROM cust))""")
    sql["split_stratified"] = parts + "SELECT CustomerID, ChurnRisk, is_train FROM parts"
    sql["split_sizes"] = parts + "SELECT ChurnRisk, is_train, count(*) AS n FROM parts GROUP BY ALL"
    every = ", ".join(("CustomerID", *INPUT_NAMES, "ChurnRisk", "CLV"))
    sql["split_random"] = C + f"SELECT {every}, substr({hashed}, 1, 8) < 'cccccccc' AS is_train FROM cust"

    sql["clv_metrics"] = S + """SELECT count(*) AS n,
  round(1e0 - sum((CLV - PredCLV) * (CLV - PredCLV)) / sum((CLV - mean) * (CLV - mean)), 6) AS r2,
  round(avg(abs(CLV - PredCLV)), 6) AS mae FROM scored, (SELECT avg(CLV) AS mean FROM cust)"""
    sql["clv_actual_vs_pred"] = S + \
        "SELECT CustomerID, CLV AS actual, PredCLV AS predicted FROM scored"

    sql["score_dashboard"] = _with(
        CUSTOMERS, PARTNER, FILLED, _clean("first"), _scored("clean", "out_", clv="PredCLV")
    ) + _score_select("out_").replace("Segment FROM", f"Segment, {cat_names} FROM")
    sql["score_bulk"] = _bulk() + \
        f"SELECT {', '.join(BULK_COLUMNS)}, ChurnPred AS ChurnRisk, Cluster FROM bulk"
    sql["score_retention"] = S + _score_select("scored")
    requested = _with(CUSTOMERS, _scored("cust", "asked", clv="PredCLV"))
    sql["score_requests"] = requested + _score_select("asked")
    titles = _by_rule({k: f"'{t[0]}'" for k, t in SINGLE_TEXTS.items()})
    sql["customer_report"] = requested + f"""SELECT CustomerID, Gender, Age, Location,
  PreferredCategory, AppUsage, MembershipPeriod, TotalSpent, PurchaseFrequency, AvgOrderValue,
  LastPurchaseDaysAgo, CustomerSatisfaction, ComplaintHistory, CartAbandonRate,
  concat({_fixed('ChurnProb * 100e0', 2)}, '%') AS ChurnProbability, {STATUS} AS Prediction,
  {_money('PredCLV', 'Rs.')} AS PredictedCLV, Segment, {titles} AS RetentionOffer,
  '01 January 2000' AS ReportDate FROM (SELECT *, {RULE} AS rule FROM asked)"""

    sql["offers_full"] = _offered(FULL_TEXTS)
    sql["offers_single"] = _offered(SINGLE_TEXTS)
    sql["offers_short"] = S + f"""SELECT CustomerID, ChurnProbability,
  {_short('(ChurnProbability / 100e0)')} AS RetentionOffer
FROM (SELECT *, {_pct('ChurnProb')} AS ChurnProbability FROM scored)"""
    urgencies = _by_rule({k: f"'{u}'" for k, u in URGENCY.items()})
    sql["urgency_counts"] = S + f"""SELECT {urgencies} AS urgency, count(*) AS customers
FROM (SELECT *, {RULE} AS rule FROM scored) GROUP BY 1"""

    changed = ", ".join(NEW_VALUES.values())
    sql["scenario_expand"] = E_ + f"SELECT CustomerID, {changed}, position, action FROM acts"
    sql["scenario_scores"] = E_ + f"""SELECT CustomerID, position, action,
  {_pct(PLAIN_PROBABILITY)} AS churn_pct, {_even(VALUE, 2)} AS clv FROM acts"""
    sql["default_intervention"] = _with(CUSTOMERS, INTERVENED) + \
        f"SELECT CustomerID, {changed} FROM iv"
    sql["intervention_impact"] = _with(CUSTOMERS, INTERVENED) + f"""SELECT CustomerID, before_pct,
  after_pct, before_pct - after_pct AS risk_reduction, clv AS before_clv, clv AS after_clv,
  clv - clv AS clv_change FROM (SELECT CustomerID, {_pct(_BEFORE)} AS before_pct,
    {_pct(PLAIN_PROBABILITY)} AS after_pct, {_even(VALUE, 2)} AS clv FROM iv)"""
    sql["sensitivity"] = E_ + "SELECT * FROM sens"
    sql["best_action"] = E_ + """SELECT CustomerID, action, reduction, churn_pct
FROM (SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY reduction DESC, position) AS pos
  FROM sens) WHERE pos = 1"""
    sql["action_summary"] = E_ + """SELECT position, action, count(*) AS customers,
  count(*) FILTER (WHERE reduction > 0) AS helped, round(avg(reduction), 6) AS mean_reduction
FROM sens GROUP BY position, action"""
    return sql
