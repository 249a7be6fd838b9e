import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stayline.operators import reports
from stayline.operators.segments import clv_by_segment
from stayline.plans.retention import retention_report


def ids(df):
    return [r["CustomerID"] for r in df.collect()]


def test_filters(scored):
    assert sorted(ids(reports.filter_equals(scored, Segment="Lost", Nothing="x"))) == [1, 2, 8]
    assert len(ids(reports.filter_equals(scored, Segment="All"))) == 9
    assert sorted(ids(reports.retention_filter(scored))) == [1, 2, 3, 4, 9]
    assert sorted(ids(reports.retention_filter(scored, segments=()))) == [1, 2, 3, 4, 7, 9]
    assert sorted(ids(reports.retention_filter(scored, min_prob=0.7, min_clv=30000))) == [1, 3, 4]


def test_ranked_list(scored):
    assert ids(retention_report(scored, n=3)) == [2, 1, 3]
    assert ids(retention_report(scored, sort_by="probability", n=2)) == [1, 4]
    row = retention_report(scored, n=1, details=True).first()
    assert row["ChurnProbability"] == 60.0 and row["Urgency"] == "CRITICAL"


def test_counts_and_rates(scored):
    status = [tuple(r) for r in reports.count_by_status(scored).collect()]
    assert status == [("Will Churn", 6), ("Will Return", 3)]
    assert dict(map(tuple, reports.count_by(scored, "Segment").collect())) == {
        "Lost": 3, "At-Risk": 3, "Loyal": 1, "Champions": 1}
    rates = [tuple(r) for r in reports.churn_rate_by(scored, "Segment", by_rate=True).collect()]
    assert [r[0] for r in rates][-1] == "At-Risk" and rates[-1][1] == 1.0
    revenue = [tuple(r) for r in reports.revenue_at_risk_by_segment(scored).collect()]
    assert revenue[0][0] == "Lost" and revenue[1] == ("At-Risk", 65000.0)


def test_segment_order_with_and_without_absent_segments(scored):
    some = scored.filter("Segment <> 'Loyal'")
    assert [r["Segment"] for r in clv_by_segment(some).collect()] == ["Champions", "At-Risk", "Lost"]
    full = clv_by_segment(some, keep_absent=True).collect()
    assert [r["Segment"] for r in full] == ["Champions", "Loyal", "At-Risk", "Lost"]
    assert full[1]["avg_clv"] is None


def test_kpis_of_an_empty_table(scored):
    none = scored.filter("CustomerID < 0")
    row = reports.kpi_dashboard(none).first()
    assert (row["customers"], row["churn_pct"], row["revenue_at_risk"], row["avg_clv"]) == (
        0, 0.0, 0.0, None)
    row = reports.kpi_retention(none).first()
    assert (row["at_risk"], row["high_value"], row["avg_prob"]) == (0, 0, None)


@pytest.mark.parametrize("exact", [True, False])
def test_retention_kpis(scored, many_ranges, exact):
    row = reports.kpi_retention(scored, exact=exact).first()
    risky = scored.filter("ChurnPred = 1").toPandas()
    limit = (risky.PredCLV.quantile(0.75) if exact
             else np.sort(risky.PredCLV)[int(np.ceil(0.75 * len(risky))) - 1])
    assert row["at_risk"] == len(risky)
    assert row["critical"] == (risky.ChurnProb >= 0.7).sum()
    assert row["high_value"] == (risky.PredCLV >= limit).sum()
    assert row["revenue_at_risk"] == pytest.approx(risky.PredCLV.sum())
    assert row["avg_prob"] == pytest.approx(risky.ChurnProb.mean() * 100)


def test_bulk_kpis_count_known_status_only(spark):
    df = spark.createDataFrame(
        [(1, 1, "Will Churn", 10.0), (2, 0, "Will Return", 20.0), (3, None, "Unknown", None)],
        "CustomerID long, ChurnPred int, ChurnStatus string, PredCLV double")
    row = reports.kpi_bulk(df).first()
    assert tuple(row) == (3, 1, 1, 50.0, 10.0, 15.0)
    flags = reports.availability_flags(df.selectExpr("*", "'Unknown' AS Segment")).first()
    assert tuple(flags) == (True, False, True)


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(0, 5), min_size=1, max_size=40), n=st.integers(1, 20))
def test_top_n_is_the_sorted_head(spark, values, n):
    rows = [(i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "CustomerID long, v double").repartition(5)
    expected = [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:n]]
    assert ids(reports.top_n(df, "v", n)) == expected
