import pytest
from pyspark.sql import functions as F

from stayline.operators import scenarios
from stayline.operators import segments as seg
from stayline.plans.scorecard import Scorecard

INPUTS = ("CustomerID long, DiscountUsed int, CustomerSatisfaction int, CartAbandonRate double,"
          " VisitFrequency int, LastPurchaseDaysAgo int, ComplaintHistory int,"
          " PurchaseFrequency double, TotalSpent double, AvgOrderValue double")


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([
        (1, 0, 2, 0.6, 27, 200, 3, 1.0, 20000.0, 500.0),
        (2, 1, 5, 0.1, 5, 10, 0, 3.0, 90000.0, 900.0)], INPUTS)


def profile(spark, rows):
    return spark.createDataFrame(rows, "Cluster int, Avg_CLV double, Churn_Rate double")


def test_ranks_share_ties(spark):
    p = profile(spark, [(0, 10.0, 0.5), (1, 10.0, 0.5), (2, 30.0, 0.5), (3, 5.0, 0.1)])
    ranks = {r["Cluster"]: (r["clv_rank"], r["churn_rank"]) for r in seg.segment_rank(p).collect()}
    assert ranks == {0: (2.5, 3.0), 1: (2.5, 3.0), 2: (1.0, 3.0), 3: (4.0, 1.0)}
    names = dict(map(tuple, seg.segment_map(p).collect()))
    assert names == {2: "Champions", 3: "Loyal", 0: "At-Risk", 1: "Lost"}


def test_profile_rounds_before_ranking(spark):
    df = spark.createDataFrame(
        [(0, 1.001, 0), (0, 1.003, 1), (1, 1.0, 0)], "Cluster int, CLV double, ChurnRisk int")
    rows = {r["Cluster"]: r for r in seg.cluster_profile(df).collect()}
    assert rows[0]["Count"] == 2 and rows[0]["Avg_CLV"] == 1.0 and rows[0]["Churn_Rate"] == 0.5
    assert "Avg_Spent" not in rows[0].asDict()


def test_lookup_keeps_unmapped_clusters(spark):
    df = spark.createDataFrame([(1, 0), (2, 9)], "CustomerID long, Cluster int")
    got = {r["CustomerID"]: r["Segment"] for r in seg.with_segment(df, {0: "Loyal"}).collect()}
    assert got == {1: "Loyal", 2: None}


def test_every_action_for_every_customer(spark, base):
    rows = scenarios.expand_scenarios(base).collect()
    assert len(rows) == 2 * len(scenarios.ACTIONS)
    one = {r["action"]: r for r in rows if r["CustomerID"] == 1}
    assert one["Visit Frequency +5"]["VisitFrequency"] == 29
    assert one["Visit Frequency +5"]["CustomerSatisfaction"] == 2
    combined = one["All Actions Combined"]
    assert (combined["DiscountUsed"], combined["CustomerSatisfaction"], combined["CartAbandonRate"],
            combined["LastPurchaseDaysAgo"], combined["ComplaintHistory"]) == (1, 5, 0.1, 7, 0)


def test_custom_actions_and_unknown_overrides(spark, base):
    actions = [("Nothing", {}), ("Call", {"complaint_hist": 1})]
    rows = scenarios.sensitivity(base, Scorecard(), actions).collect()
    assert {(r["CustomerID"], r["action"]) for r in rows} == {
        (i, a) for i in (1, 2) for a in ("Nothing", "Call")}
    assert all(r["reduction"] == 0 for r in rows if r["action"] == "Nothing")
    with pytest.raises(ValueError):
        scenarios.expand_scenarios(base, [("Bad", {"price": 1})])


def test_sensitivity_matches_scoring_each_case(spark, base):
    rows = scenarios.sensitivity(base, Scorecard()).filter("CustomerID = 1").collect()
    for r in rows:
        changed = scenarios.expand_scenarios(base).filter(
            (F.col("CustomerID") == 1) & (F.col("position") == r["position"]))
        prob = Scorecard().churn(changed).first()["ChurnProb"]
        assert r["churn_pct"] == pytest.approx(round(prob * 100, 2), abs=0.011)
        assert r["reduction"] == pytest.approx(r["base_pct"] - r["churn_pct"], abs=1e-9)


def test_best_action_and_ties(spark, base):
    effects = scenarios.sensitivity(base, Scorecard())
    best = {r["CustomerID"]: r for r in scenarios.best_action(effects).collect()}
    assert best[1]["action"] == "All Actions Combined"
    # Nothing helps the second customer more than the discount, which comes first.
    top = effects.filter("CustomerID = 2").agg(F.max("reduction")).first()[0]
    first = effects.filter((F.col("CustomerID") == 2) & (F.col("reduction") == top)).orderBy(
        "position").first()
    assert best[2]["action"] == first["action"]
    summary = scenarios.action_summary(effects).collect()
    assert len(summary) == 8 and all(r["customers"] == 2 for r in summary)


def test_default_intervention_respects_limits(spark, base):
    got = {r["CustomerID"]: r for r in scenarios.default_intervention(base).collect()}
    assert (got[1]["DiscountUsed"], got[1]["CustomerSatisfaction"], got[1]["VisitFrequency"],
            got[1]["LastPurchaseDaysAgo"], got[1]["ComplaintHistory"]) == (1, 3, 29, 185, 2)
    assert got[1]["CartAbandonRate"] == pytest.approx(0.4)
    assert (got[2]["CustomerSatisfaction"], got[2]["CartAbandonRate"],
            got[2]["LastPurchaseDaysAgo"], got[2]["ComplaintHistory"]) == (5, 0.0, 1, 0)


class LiteralScorer:
    """CLV moves with satisfaction, so that an action changes it."""

    inputs = Scorecard().inputs

    def churn(self, df):
        return Scorecard().churn(df)

    def clv(self, df):
        return df.withColumn("PredCLV", F.col("TotalSpent") + F.col("CustomerSatisfaction") * 100.0)


def test_impact_reports_both_sides(spark, base):
    row = scenarios.intervention_impact(base, LiteralScorer()).filter("CustomerID = 1").first()
    assert row["clv_change"] == 100.0 and row["after_clv"] == 20300.0
    assert row["risk_reduction"] == pytest.approx(row["before_pct"] - row["after_pct"])
    assert row["risk_reduction"] > 0


def test_unknown_inputs_are_not_bounded(spark, base):
    unknown = base.withColumns({c: F.lit(None).cast(base.schema[c].dataType) for c in (
        "VisitFrequency", "LastPurchaseDaysAgo", "CustomerSatisfaction")})
    row = scenarios.default_intervention(unknown).first()
    assert row["VisitFrequency"] is None and row["LastPurchaseDaysAgo"] is None
    added = scenarios.expand_scenarios(unknown, [("Visits", {"visit_freq_add": 5})]).first()
    assert added["VisitFrequency"] is None
