"""What the physical plans must look like."""

import re

import pytest

from conftest import SMALL
from pyspark.sql import functions as F
from demandlens.functions.classify import add_posting_class
from demandlens.operators import gap, market, picks, skills
from demandlens.plans import fixtures
from demandlens.plans.queries import QUERIES
from demandlens.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def jobs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "jobs")
    fixtures.jobs(spark, SMALL).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "texts")
    fixtures.cv_texts(spark, SMALL).repartition(16).write.parquet(path)
    return spark.read.option("maxPartitionBytes", 1).parquet(path)


def test_market_combines_before_it_shuffles(jobs):
    text = plan(market.market(jobs))
    assert "SortAggregate" not in text
    # The first thing above the exploded postings is a partial hash aggregate.
    nodes = [re.sub(r"^[\s:+*()\d-]*", "", line).split(" ")[0].split("(")[0] for line in text.splitlines()]
    scan = max(i for i, n in enumerate(nodes) if n in ("FileScan", "Scan"))
    first_exchange = max(i for i, n in enumerate(nodes[:scan]) if n == "Exchange")
    assert "HashAggregate" in nodes[first_exchange:scan]
    assert text.count("WindowGroupLimit") == 2
    assert text.count("FileScan") == 1


def test_market_reads_only_its_columns(jobs):
    schema = re.search(r"ReadSchema: (\S+)", plan(market.market(jobs))).group(1)
    assert schema == "struct<job_ord:bigint,job_title:string,seniority_level:string,required_skills:string>"
    sizes = re.search(r"ReadSchema: (\S+)", plan(market.slice_sizes(jobs))).group(1)
    assert "required_skills" not in sizes and "company_name" not in sizes


def test_texts_are_not_shuffled(jobs, many_files):
    slices = market.market_slices(jobs)
    for scored in (gap.skill_gap(gap.text_cvs(many_files), slices), gap.route(many_files, slices)):
        text = plan(gap.result_record(scored) if "flags" in scored.columns else scored)
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Cartesian" not in text
        texts_side = text[: text.index("BroadcastExchange")]
        assert not re.search(r"(?<!Broadcast)Exchange", texts_side)
        assert "NestedLoop" not in text and "Python" not in text and "Arrow" not in text


def test_extraction_moves_texts_at_most_once(jobs, many_files):
    text = plan(skills.extract_skills(many_files, skills.posting_skills(jobs)))
    assert "NestedLoop" not in text and "Cartesian" not in text
    # By the id alone: the one join with the texts.
    moved = [m for m in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text) if re.fullmatch(r"cv_id#\d+L, \d+", m)]
    assert len(moved) <= 1


def test_numbering_files_sorts_and_shuffles_no_posting(spark, tmp_path):
    frame = spark.createDataFrame([(f"t{i}",) for i in range(9)], "job_title string")
    for name in ("one", "two"):
        frame.coalesce(1).write.parquet(str(tmp_path / name))
    text = plan(tables.read_postings(spark, [str(tmp_path / "one"), str(tmp_path / "two")]))
    postings = text[: text.index("BroadcastExchange")]
    assert "Exchange" not in postings and "Sort" not in postings and "BroadcastHashJoin" in postings


def test_pairs_lower_each_list_once(spark):
    cvs, jobs = fixtures.cvs(spark, SMALL), fixtures.jobs(spark, SMALL)
    pairs = gap.compare_pairs(cvs, jobs, F.col("cv_id") == F.col("applicant_id"))
    text = pairs._jdf.queryExecution().optimizedPlan().toString()
    # One for each of the user's, the required and the preferred skills, each printed with its two spellings of white space.
    assert text.count("lower(") <= 4


def test_filters_on_stored_columns_reach_the_scan(jobs):
    text = plan(add_posting_class(jobs.filter("company_name = 'A'")))
    assert "EqualTo(company_name,A)" in text


def test_latest_keeps_one_row_per_task_before_it_shuffles(jobs):
    assert plan(picks.latest(jobs, ["company_name"], ["job_ord"])).count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan(picks.latest(jobs, [], ["job_ord"]))


def test_only_the_model_query_uses_python(spark):
    for name in ("market_top_skills", "skill_gap_report", "cv_feedback", "pair_compare", "feedback_clean"):
        assert "EvalPython" not in plan(QUERIES[name](spark, SMALL)), name
    assert "ArrowEvalPython" in plan(QUERIES["model_feedback"](spark, SMALL))


@pytest.mark.parametrize("name", ["durable_feedback", "kept_feedback"])
def test_gaps_that_are_read_often_compute_their_market_once(spark, monkeypatch, name):
    computed = []
    slices = market.market_slices
    monkeypatch.setattr(market, "market_slices", lambda jobs: computed.append(jobs) or slices(jobs))
    text = plan(QUERIES[name](spark, SMALL))
    assert len(computed) == 1 and "customer" in text and "lineitem" not in text and "orders" not in text
