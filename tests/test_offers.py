from pyspark.sql import functions as F

from stayline.operators import offers


def rules(df, **kw):
    return {r["CustomerID"]: r["rule"] for r in
            offers.with_offer(df, **kw).select("CustomerID", "Offer.rule").collect()}


def test_full_rules_at_their_boundaries(scored):
    assert rules(scored) == {
        1: "win_back", 2: "premium_win_back", 3: "nudge", 4: "urgent", 5: "loyalty",
        6: "champions", 7: "champions", 8: "win_back", 9: "nudge"}


def test_thresholds_are_parameters(scored):
    assert rules(scored, clv_threshold=10.0)[1] == "premium_win_back"
    assert rules(scored, prob_threshold=0.5)[3] == "urgent"


def test_texts_name_the_category(scored):
    rows = {r["CustomerID"]: r["Offer"] for r in offers.with_offer(scored).collect()}
    assert rows[2]["offers"][3] == "Curated SMALL deals"
    assert rows[1]["offers"] == ["20% discount (7 days)", "Free shipping next order",
                                 "New PROMO arrivals", "200 loyalty points"]
    assert rows[2]["urgency"] == "CRITICAL" and rows[2]["message"] is None
    single = {r["CustomerID"]: r["Offer"] for r in offers.with_offer(scored, "single").collect()}
    assert single[3]["tag"] == "🔔 Re-Engagement Nudge"
    assert single[3]["offers"][1] == "Top LARGE picks for you"
    assert single[6]["message"].startswith("Top-tier customer.")


def test_short_offers_split_lost_on_probability(scored):
    percent = scored.withColumn("ChurnProbability", F.col("ChurnProb") * 100)
    text = {r["CustomerID"]: r["RetentionOffer"] for r in offers.with_short_offer(percent).collect()}
    assert text[1] == "30% discount + Free shipping + VIP upgrade"
    assert text[2] == "20% coupon + Free shipping + SMALL picks"
    assert text[3] == "15% off + LARGE top picks + Flash sale"
    assert text[4] == "25% off + Double points + Express delivery"
    assert text[7] == "Champions Club invite + Gift voucher ₹2000"
    no_prob = percent.withColumn("ChurnProbability", F.lit(None).cast("double")).drop(
        "PreferredCategory")
    text = {r["CustomerID"]: r["RetentionOffer"] for r in offers.with_short_offer(no_prob).collect()}
    assert text[1] == "20% coupon + Free shipping + General picks"


def test_urgency_counts(scored):
    counts = {r["urgency"]: r["customers"] for r in offers.urgency_counts(scored).collect()}
    assert counts == {"CRITICAL": 1, "HIGH": 3, "MEDIUM": 2, "LOW": 3}
