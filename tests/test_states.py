import random

import pytest

from conftest import JOBS_SCHEMA
from demandlens.operators import gap, market, picks
from demandlens.streaming import intake, states

TITLES = ["Senior Backend Developer", "Backend Developer", "Junior Data Analyst", "DevOps Engineer", "Chef", None]


def postings(n, seed):
    rng = random.Random(seed)
    skills = ["SQL", "sql", "Java", "Go", " Git", "", "React"]

    def listed():
        return ", ".join(rng.choice(skills) for _ in range(rng.randrange(6))) if rng.random() < 0.9 else None

    return [(i, rng.choice(TITLES), rng.choice([None, "mid"]), listed(), None, rng.choice([None, "", "A", " B ", "C"])) for i in range(n)]


def in_files(spark, path, rows, schema, sizes):
    """The rows in files that a stream takes one a batch, in the order of their names."""
    at = 0
    for i, size in enumerate(sizes):
        spark.createDataFrame(rows[at : at + size], schema).coalesce(1).write.mode("append").parquet(f"{path}/part={i:03d}")
        at += size
    assert at == len(rows)


def arriving(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def slices(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: (r["role"], r["level"]))


def test_the_market_after_every_batch_is_that_of_all_postings(spark, tmp_path):
    rows = postings(90, 1)
    random.Random(2).shuffle(rows)
    src, out, progress = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "progress")
    at = 0
    for sizes in ([30], [20, 1], [39]):
        in_files(spark, f"{src}/{at}", rows[at : at + sum(sizes)], JOBS_SCHEMA, sizes)
        at += sum(sizes)
        states.run_market(arriving(spark, src, JOBS_SCHEMA), out, progress).awaitTermination()
        expected = market.market_slices(spark.createDataFrame(rows[:at], JOBS_SCHEMA))
        assert slices(states.read_market(spark, out)) == slices(expected)
    folded = str(tmp_path / "folded")
    states.fold_market(spark, out, folded)
    assert slices(states.read_market(spark, folded)) == slices(expected)
    # The stream goes on over the folded states.
    in_files(spark, f"{src}/more", more := [(1000 + i, *r[1:]) for i, r in enumerate(postings(10, 3))], JOBS_SCHEMA, [10])
    states.run_market(arriving(spark, src, JOBS_SCHEMA), folded, progress).awaitTermination()
    assert slices(states.read_market(spark, folded)) == slices(market.market_slices(spark.createDataFrame(rows + more, JOBS_SCHEMA)))


def test_a_batch_writes_what_it_changes_only(spark, tmp_path):
    rows = [(0, "Backend Developer", None, "a, b", None, "X"), (1, "Backend Developer", None, "b", None, "X"), (2, "Chef", None, "c", None, None)]
    in_files(spark, str(tmp_path / "src"), rows, JOBS_SCHEMA, [1, 1, 1])
    out = str(tmp_path / "out")
    states.run_market(arriving(spark, str(tmp_path / "src"), JOBS_SCHEMA), out, str(tmp_path / "progress")).awaitTermination()
    counts = [spark.read.parquet(f"{out}/batch={i}").count() for i in range(3)]
    assert counts == [4, 3, 2]


def test_the_streamed_market_serves_intake(spark, tmp_path):
    jobs = spark.createDataFrame(postings(60, 5), JOBS_SCHEMA)
    jobs.coalesce(1).write.parquet(str(tmp_path / "src"))
    out = str(tmp_path / "out")
    states.run_market(arriving(spark, str(tmp_path / "src"), JOBS_SCHEMA), out, str(tmp_path / "progress")).awaitTermination()
    intake.publish_slices(states.read_market(spark, out), str(tmp_path / "market"), version=1)
    cvs = spark.createDataFrame([(1, "x", "java and spring boot " * 20)], "cv_id long, cv_name string, cv_text string")
    routed = gap.route(cvs, intake.load_market(spark, str(tmp_path / "market"))).collect()
    assert routed == gap.route(cvs, market.market_slices(jobs)).collect() and routed[0].status == "accepted"


@pytest.mark.parametrize("seed", [0, 1])
def test_the_latest_upload_of_a_name_whatever_the_order_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    schema = "cv_name string, modified_at long, cv_id long, place string"
    rows = [(f"n{rng.randrange(7)}" if rng.random() < 0.9 else None, t, rng.randrange(99), f"p{t}") for t in range(50)]
    rng.shuffle(rows)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    in_files(spark, src, rows, schema, [20, 5, 25])
    keys, order = ["cv_name"], ["modified_at"]
    states.run_latest(arriving(spark, src, schema), keys, order, out, str(tmp_path / "progress")).awaitTermination()
    got = sorted(map(tuple, states.read_latest(spark, out, keys, order).collect()), key=repr)
    expected = picks.latest(spark.createDataFrame(rows, schema), keys, order)
    assert got == sorted(map(tuple, expected.collect()), key=repr)
    assert len(spark.read.parquet(f"{out}/batch=2").collect()) <= 8
