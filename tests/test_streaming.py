import pytest
from pyspark.sql import functions as F

from demandlens.operators import gap, market
from demandlens.sources import texts
from demandlens.streaming import intake


@pytest.fixture
def folders(spark, tmp_path, frontend_jobs):
    incoming = tmp_path / "in"
    incoming.mkdir()
    for i, text in enumerate(["html css javascript mid ", "react 6 years ", "docker terraform ", "short"]):
        (incoming / f"cv{i}.txt").write_text(text * (1 if text == "short" else 30))
    intake.publish_market(frontend_jobs, str(tmp_path / "market"), version=1)
    return tmp_path


def run(spark, base):
    stream = texts.stream_cv_texts(spark, str(base / "in"), files_per_batch=2)
    intake.run_intake(stream, str(base / "market"), str(base / "out"), str(base / "progress")).awaitTermination()
    return intake.read_intake(spark, str(base / "out"))


def test_stream_equals_batch(spark, folders):
    columns = ["cv_id", "cv_name", "status", "reject_reason", "result"]
    streamed = run(spark, folders)
    batch = gap.route(texts.read_cv_texts(spark, str(folders / "in")), intake.load_market(spark, str(folders / "market")))
    def key(df):
        return sorted(map(repr, df.select(columns).collect()))

    assert key(streamed) == key(batch)
    assert {(r.cv_name, r.status) for r in streamed.collect()} == {
        ("cv0", "accepted"),
        ("cv1", "accepted"),
        ("cv2", "rejected"),
        ("cv3", "rejected"),
    }
    assert streamed.select("batch").distinct().count() == 2


def test_later_files_use_the_newest_market(spark, folders, make_jobs):
    run(spark, folders)
    more = make_jobs(("DevOps Engineer", None, "Docker, Go", None, "D"))
    intake.publish_market(more, str(folders / "market"), version=2)
    (folders / "in" / "late.txt").write_text("docker terraform " * 30)
    rows = {r.cv_name: r for r in run(spark, folders).collect()}
    assert rows["cv2"].status == "rejected" and len(rows) == 5
    assert rows["late"].status == "accepted" and rows["late"].result.matched_skills == ["Docker"]


def test_a_repeated_batch_writes_nothing_twice(spark, folders):
    first = run(spark, folders).count()
    stream = texts.stream_cv_texts(spark, str(folders / "in"), files_per_batch=2)
    again = intake.run_intake(stream, str(folders / "market"), str(folders / "out"), str(folders / "progress-2"))
    again.awaitTermination()
    assert intake.read_intake(spark, str(folders / "out")).count() == first == 4


def test_scores_append_to_any_sink(spark, folders):
    slices = intake.load_market(spark, str(folders / "market"))
    scored = intake.score_stream(texts.stream_cv_texts(spark, str(folders / "in")), slices)
    query = (
        scored.writeStream.format("parquet")
        .option("path", str(folders / "scores"))
        .option("checkpointLocation", str(folders / "p"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(str(folders / "scores")).orderBy("cv_file").collect()
    batch = intake.score_stream(texts.read_cv_texts(spark, str(folders / "in")), slices)
    assert rows == batch.orderBy("cv_file").collect() and [r.cv_file for r in rows] == ["cv0", "cv1"]


def test_published_market_equals_the_computed_one(spark, folders, frontend_jobs):
    columns = market.market_slices(frontend_jobs).columns
    loaded = intake.load_market(spark, str(folders / "market")).select(columns)
    assert sorted(map(repr, loaded.collect())) == sorted(map(repr, market.market_slices(frontend_jobs).collect()))
    assert loaded.filter(F.col("used_fallback")).count() == 1
