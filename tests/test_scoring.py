import pytest
from pyspark.sql import functions as F

from stayline.plans import scoring
from stayline.plans.scorecard import Scorecard
from stayline.sources import customers, export_csv, keep_table, read_customers, requests
from stayline.sources.exports import BULK_COLUMNS, select_present
from stayline.sources import star
from stayline.sources.star import (
    VIEW_COLUMNS, customer_view, partner_base, partner_upload, star_tables,
)
from stayline.streaming import score_stream

WORDS = {"Gender": ["Female", "Male"], "Location": ["FRANCE", "PERU"],
         "PreferredCategory": ["PROMO", "SMALL"], "AppUsage": ["High", "Low", "Medium"]}
CARD = Scorecard(WORDS)


def test_view_branches_do_not_change_values(spark, folder):
    """Asking for some columns only must give what the full view holds."""
    tables = star_tables(spark, folder)
    full = customer_view(tables)
    assert tuple(full.columns) == VIEW_COLUMNS
    for some in (("CustomerID", "CustomerSatisfaction", "ReturnCount"),
                 ("CustomerID", "CLV", "ChurnRisk"), ("CustomerID", "AppUsage", "Location")):
        part = customer_view(tables, some)
        assert part.exceptAll(full.select(*some)).count() == 0
        assert part.count() == full.count()


def test_partial_upload_is_scored(spark, folder):
    upload = partner_upload(partner_base(star_tables(spark, folder)))
    scored, filled = scoring.score_bulk(upload, CARD)
    assert "CartAbandonRate" in filled and "Age" not in filled
    rows = scored.select("Gender", "Location", "AppUsage", "ChurnProbability", "ChurnStatus",
                         "Segment", "RetentionOffer").collect()
    assert len(rows) == upload.count()
    assert {r["Gender"] for r in rows} <= {"Male", "Female"}
    assert {r["Location"] for r in rows} <= {"FRANCE", "PERU"}
    assert all(r["Segment"] and r["RetentionOffer"] for r in rows)
    exported = scoring.bulk_export(scored)
    assert "ChurnRisk" in exported.columns and "ChurnPred" not in exported.columns


def test_single_request_equals_batch_row(spark):
    asked = {"CustomerID": 5, "Gender": "Male", "Age": 30, "Location": "PERU",
             "PreferredCategory": "PROMO", "AppUsage": "Low", "TotalSpent": 9000.0,
             "AvgOrderValue": 900.0, "PurchaseFrequency": 1.0, "LastPurchaseDaysAgo": 120,
             "CustomerSatisfaction": 2, "CartAbandonRate": 0.5, "ComplaintHistory": 2}
    one = scoring.score_requests(requests(spark, [asked]), CARD)
    batch = scoring.score_requests(requests(spark, [asked, {**asked, "CustomerID": 6}]), CARD)
    columns = ["ChurnProb", "PredCLV", "Segment"]
    assert one.select(columns).first() == batch.filter("CustomerID = 5").select(columns).first()
    report = scoring.customer_report(one, "2024-03-05").first()
    assert report["PredictedCLV"] == "Rs.10,800" and report["ReportDate"] == "05 March 2024"
    assert len(report.asDict()) == 20


def test_clv_source_options(spark):
    row = {"CustomerID": 1, "TotalSpent": 90000.0, "AvgOrderValue": 4000.0, "CLV": 0.0}
    df = requests(spark, [row])
    z = {}
    for source in ("auto", "actual", "predicted"):
        z[source] = scoring.score(df, CARD, clv_source=source).first()["Cluster"]
    assert z["auto"] == z["actual"]
    assert scoring.score(df.drop("CLV"), CARD).first()["Cluster"] == z["predicted"]


def test_unknown_inputs_stay_unknown(spark):
    row = {"CustomerID": 1, "LastPurchaseDaysAgo": None, "CustomerSatisfaction": 3}
    scored, _ = scoring.score_bulk(requests(spark, [row]), CARD, null_rows="keep")
    got = scored.first()
    assert got["ChurnProb"] is None and got["ChurnPred"] is None and got["Segment"] is None
    assert got["ChurnStatus"] == "Unknown" and got["PredCLV"] is not None
    assert got["RetentionOffer"] == "Champions Club invite + Gift voucher ₹2000"
    filled, _ = scoring.score_bulk(requests(spark, [row]), CARD, null_rows="default")
    assert filled.first()["ChurnStatus"] in ("Will Return", "Will Churn")
    with pytest.raises(Exception, match="null value"):
        scoring.score_bulk(requests(spark, [row]), CARD)[0].collect()


def test_scoring_does_not_depend_on_partitions(spark, folder):
    view = customer_view(star_tables(spark, folder))
    one = scoring.score_retention(view.coalesce(1), CARD)
    many = scoring.score_retention(view.repartition(13), CARD)
    assert one.exceptAll(many).count() == 0


def test_csv_round_trip_and_sources(spark, folder, tmp_path):
    view = customer_view(star_tables(spark, folder))
    path = str(tmp_path / "customers")
    export_csv(view, path)
    again = read_customers(spark, path)
    assert again.count() == view.count()
    assert again.select("CLV", "Age").exceptAll(view.select("CLV", "Age")).count() == 0
    part = str(tmp_path / "part")
    export_csv(view, part, ["CustomerID", "Age", "NotThere"])
    upload = customers(spark, default_path=path, upload_path=part)
    assert upload.columns == ["CustomerID", "Age"]
    assert customers(spark).columns == ["CustomerID", "Age"]
    assert customers(spark, default_path=path).columns == again.columns
    with pytest.raises(Exception):
        export_csv(view, part)
    assert select_present(view, BULK_COLUMNS).columns[:2] == ["CustomerID", "Gender"]


def test_stream_output_equals_batch_output(spark, folder, tmp_path):
    inputs = customer_view(star_tables(spark, folder)).drop("ChurnRisk", "CLV")
    arrived = str(tmp_path / "in")
    export_csv(inputs, arrived)
    args = (spark, arrived, str(tmp_path / "out"), str(tmp_path / "state"), CARD)
    score_stream(*args).awaitTermination()
    stream = spark.read.parquet(str(tmp_path / "out"))
    batch, _ = scoring.score_bulk(read_customers(spark, arrived), CARD)
    columns = ["CustomerID", "ChurnProbability", "PredCLV", "Segment", "RetentionOffer"]
    assert stream.count() == batch.count()
    assert stream.select(columns).exceptAll(batch.select(columns)).count() == 0
    # New files only: a second run adds the new file's rows and no old ones.
    export_csv(inputs.withColumn("CustomerID", F.col("CustomerID") + 10**9), arrived, mode="append")
    score_stream(*args).awaitTermination()
    both = spark.read.parquet(str(tmp_path / "out"))
    assert both.count() == 2 * batch.count()
    assert both.select("CustomerID").distinct().count() == 2 * batch.count()


def test_kept_table_is_pruned_by_its_folders(spark, folder, tmp_path):
    scored = scoring.score_retention(customer_view(star_tables(spark, folder)), CARD)
    kept = keep_table(scored, str(tmp_path / "scored"), ["Segment"])
    assert kept.select(scored.columns).exceptAll(scored).count() == 0
    assert kept.count() == scored.count()
    lost = kept.filter("Segment = 'Lost'")
    assert "PartitionFilters: [isnotnull(Segment" in lost._jdf.queryExecution().toString()


def _csv(folder, text):
    folder.mkdir(exist_ok=True)
    (folder / f"{len(list(folder.iterdir()))}.csv").write_text(text)
    return str(folder)


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    swapped = read_customers(spark, _csv(tmp_path / "a", "TotalSpent,CustomerID,Note,Age\n111.5,7,hi,30\n"))
    assert swapped.first().asDict() == {"TotalSpent": 111.5, "CustomerID": 7, "Note": "hi", "Age": 30}
    assert dict(swapped.dtypes)["Note"] == "string"
    broken = _csv(tmp_path / "b", "CustomerID,Age\n1,old\n2,40\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_customers(spark, broken).collect()
    rows = read_customers(spark, broken, mode="PERMISSIVE", broken=True).orderBy("CustomerID").collect()
    assert [(r.Age, r["_broken_row"]) for r in rows] == [(None, "1,old"), (40, None)]
    _csv(tmp_path / "b", "Age,CustomerID\n50,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_customers(spark, broken, mode="PERMISSIVE").collect()


def test_stream_reads_each_file_by_its_header_and_puts_bad_rows_aside(spark, tmp_path):
    folder = tmp_path / "in"
    _csv(folder, "CustomerID,Age,TotalSpent\n1,30,100.0\n2,,5.0\n")
    _csv(folder, "Extra,TotalSpent,CustomerID\nx,200.0,3\ny,much,4\n")
    score_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), CARD).awaitTermination()
    out = spark.read.option("mergeSchema", True).parquet(str(tmp_path / "out"))
    assert {(r.CustomerID, r.TotalSpent) for r in out.collect()} == {(1, 100.0), (3, 200.0)}
    assert spark.read.parquet(str(tmp_path / "out_rejected")).count() == 2


def test_a_stream_of_a_thousand_files_takes_a_few_jobs(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(1000):
        text = f"CustomerID,Age,TotalSpent\n{i},{30 if i % 10 else ''},{i}.5\n" if i % 2 else f"\nTotalSpent,CustomerID\n{i}.5,{i}\n"
        (folder / f"f{i:04}.csv").write_text(text if i else "")
    spark.sparkContext.setJobGroup("thousand", "")
    score_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), CARD, null_rows="reject").awaitTermination()
    out = spark.read.option("mergeSchema", True).parquet(str(tmp_path / "out"))
    assert {(r.CustomerID, r.TotalSpent) for r in out.select("CustomerID", "TotalSpent").collect()} == {
        (i, i + 0.5) for i in range(1, 1000)}
    assert len([d for d in (tmp_path / "out").rglob("header=*")]) == 2
    bad = tmp_path / "bad"
    _csv(bad, "CustomerID,Age\n1,x\n")
    _csv(bad, "CustomerID,Age\n2,30\n3,y\n")
    score_stream(spark, str(bad), str(tmp_path / "o2"), str(tmp_path / "s2"), CARD).awaitTermination()
    rejected = spark.read.parquet(str(tmp_path / "o2_rejected")).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in rejected) == ["0.csv", "1.csv"]


def test_late_columns_of_a_long_list(spark, folder, monkeypatch):
    """Beyond a measured size the listed keys are joined by shuffle; the rows are the same."""
    tables = star_tables(spark, folder)
    view = customer_view(tables)
    listed = view.select("CustomerID", "TotalSpent").unionByName(view.select("CustomerID", "TotalSpent").limit(3)).cache()
    want = ("Age", "Location", "PreferredCategory", "AppUsage")
    few = star.with_view_columns(listed, tables, want)
    monkeypatch.setattr(star, "BROADCAST_BYTES", 0)
    many = star.with_view_columns(listed, tables, want)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("strategy=merge" in line for line in semi)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert many.count() == view.count() + 3
    assert star.with_view_columns(listed.limit(0), tables, want).count() == 0


@pytest.mark.parametrize("columns", [["*"], ["ChurnProb"], ["CustomerID"]])
def test_null_policy_holds_for_every_selection(spark, columns):
    rows = requests(spark, [{"CustomerID": 1, "Age": None, "TotalSpent": 5.0}, {"CustomerID": 2, "Age": 30, "TotalSpent": 5.0}])
    for scored in (scoring.score_requests(rows, CARD), scoring.score_dashboard(rows, CARD), scoring.score_bulk(rows, CARD)[0]):
        with pytest.raises(Exception, match="null value in Age"):
            scored.select(*columns).collect()
