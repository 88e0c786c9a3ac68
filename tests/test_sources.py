import os

import pytest
from pyspark.sql import functions as F

from demandlens import schemas
from demandlens.operators import picks
from demandlens.sources import tables, texts


def test_conform_fills_optional_and_demands_required(spark):
    df = spark.createDataFrame([("Dev",)], "job_title string").withColumn("job_ord", F.lit(1))
    (r,) = tables.conform(df, schemas.JOBS, schemas.JOBS_REQUIRED).collect()
    assert (r.job_title, r.required_skills, r.company_name) == ("Dev", "", "")
    with pytest.raises(ValueError, match="job_title"):
        tables.conform(df.drop("job_title"), schemas.JOBS, schemas.JOBS_REQUIRED)


def test_union_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([("y", 2)], "b string, c int")
    assert sorted(map(tuple, tables.union_by_name([a, b]).collect()), key=repr) == [(1, "x", None), (None, "y", 2)]
    with pytest.raises(ValueError):
        tables.union_by_name([])


def test_renumber_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("f")).repartition(9)
    numbered = [(r.f, r.k, r.job_ord) for r in tables.renumber(df, ["f", "k"]).collect()]
    assert [n for *_, n in sorted(numbered)] == list(range(1000))


def postings(spark):
    return spark.createDataFrame(
        [(3, "Dev A", "SQL"), (1, "Dev B", "Go"), (2, "Dev C", "R")], "row_key int, job_title string, required_skills string"
    )


def test_parquet_postings_are_numbered_by_file_and_row(spark, tmp_path):
    for name, title in [("b", "late"), ("a", "early")]:
        rows = [(f"{title} {i}", "SQL") for i in range(3)]
        df = spark.createDataFrame(rows, "job_title string, required_skills string").coalesce(1)
        df.write.parquet(str(tmp_path / name))
        (part,) = (tmp_path / name).glob("*.parquet")
        os.rename(part, tmp_path / f"{name}.parquet")
    jobs = tables.read_postings(spark, str(tmp_path), pattern="*.parquet")
    rows = jobs.orderBy("job_ord").collect()
    assert [(r.job_ord, r.job_title) for r in rows] == list(
        enumerate(["early 0", "early 1", "early 2", "late 0", "late 1", "late 2"])
    )
    assert {r.source_file for r in rows} == {"a.parquet", "b.parquet"} and rows[0].seniority_level == ""


def test_files_of_one_name_in_two_folders_keep_apart(spark, tmp_path):
    """File after file, as listed, whatever the files are called and however a scan is split."""
    for name in ("b", "a"):
        rows = [(f"{name} {i}", "SQL") for i in range(50)]
        frame = spark.createDataFrame(rows, "job_title string, required_skills string").coalesce(1)
        frame.write.parquet(str(tmp_path / name))
        (part,) = (tmp_path / name).glob("*.parquet")
        os.rename(part, tmp_path / name / "same.parquet")
    jobs = tables.read_postings(spark, [str(tmp_path / "b"), str(tmp_path / "a")])
    wanted = [f"{name} {i}" for name in ("b", "a") for i in range(50)]
    for frame in (jobs, jobs.repartition(7)):
        assert [r.job_title for r in frame.orderBy("job_ord").collect()] == wanted


@pytest.mark.parametrize("fmt", ["csv", "json", "orc"])
def test_other_formats_need_a_row_key(spark, tmp_path, fmt):
    options = {"header": "true"} if fmt == "csv" else {}
    postings(spark).coalesce(1).write.format(fmt).options(**options).save(str(tmp_path / "in"))
    jobs = tables.read_postings(spark, str(tmp_path / "in"), fmt, row_key="row_key")
    assert [r.job_title for r in jobs.orderBy("job_ord").collect()] == ["Dev B", "Dev C", "Dev A"]
    with pytest.raises(ValueError, match="row_key"):
        tables.read_postings(spark, str(tmp_path / "in"), fmt)


def test_several_folders_with_different_columns(spark, tmp_path):
    postings(spark).write.parquet(str(tmp_path / "one"))
    postings(spark).drop("required_skills").withColumn("company_name", F.lit("A")).write.parquet(str(tmp_path / "two"))
    jobs = tables.read_postings(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    rows = jobs.collect()
    assert sorted(r.job_ord for r in rows) == list(range(6))
    assert sum(r.company_name == "A" for r in rows) == 3 and sum(r.required_skills is None for r in rows) == 3


def test_existing_numbers_are_kept(spark, tmp_path):
    postings(spark).withColumnRenamed("row_key", "job_ord").write.parquet(str(tmp_path / "in"))
    jobs = tables.read_postings(spark, str(tmp_path / "in"))
    assert {(r.job_ord, r.job_title) for r in jobs.collect()} == {(3, "Dev A"), (1, "Dev B"), (2, "Dev C")}


def test_folders_without_matching_files_raise(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.TXT").write_text("hello")
    with pytest.raises(ValueError):
        tables.read_folder(spark, str(tmp_path / "in"), schema=schemas.JOBS, pattern="*.parquet")
    with pytest.raises(FileNotFoundError):
        texts.read_cv_texts(spark, str(tmp_path / "in"))
    any_case = texts.read_cv_texts(spark, str(tmp_path / "in"), "*.[tT][xX][tT]")
    assert [r.cv_name for r in any_case.collect()] == ["x"]


def test_table_cvs(spark, tmp_path):
    spark.createDataFrame([(1, "A")], "cv_id long, full_name string").write.parquet(str(tmp_path / "in"))
    (r,) = tables.read_cvs(spark, str(tmp_path / "in")).collect()
    assert tuple(r) == (1, "A", "", "", "")


def test_text_files(spark, tmp_path):
    contents = {"a.b.txt": b"one\r\ntwo", "bad.txt": b"caf\xe9 \xf0\x9f ok", "good.txt": "naïve �".encode()}
    for i, (name, data) in enumerate(contents.items()):
        (tmp_path / name).write_bytes(data)
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    (tmp_path / "skip.md").write_text("x")
    cvs = texts.read_cv_texts(spark, str(tmp_path))
    got = {r.cv_name: r.cv_text for r in cvs.collect()}
    assert got == {"a.b": "one\ntwo", "bad": "caf  ok", "good": "naïve �"}
    assert [r.cv_name for r in picks.latest(cvs, [], ["modified_at", "cv_name"]).collect()] == ["good"]
    texts.write_cv_texts(cvs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_file_stems(evaluate):
    values = ["a.txt", "a.b.txt", "noext", ".txt", "name."]
    assert evaluate(texts.file_stem(F.col("v")), values, "v string") == ["a", "a.b", "noext", ".txt", "name."]


def test_picks(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 7 % 500).alias("t")).repartition(7)
    assert picks.first_row(df, ["t"]).first().t == 0
    newest = {r.k: r.t for r in picks.latest(df, ["k"], ["t", "id"]).collect()}
    rows = df.collect()
    assert newest == {k: max(r.t for r in rows if r.k == k) for k in range(3)}
    profile = picks.profile(df, "t").first()
    assert (profile.row_count, profile.t) == (500, 0)
    chosen = {picks.random_row(df, "id", seed).first().id for seed in range(8)}
    assert len(chosen) > 3
    assert len({picks.random_row(df.repartition(n), "id", 1).first().id for n in (1, 3, 8)}) == 1
