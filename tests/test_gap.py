import time

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from demandlens import rules, schemas
from demandlens.operators import gap, market, report, skills
from demandlens.plans import fixtures


@pytest.fixture(scope="module")
def texts(spark):
    def make(*rows):
        return spark.createDataFrame([(i, f"cv{i}", t) for i, t in enumerate(rows)], "cv_id long, cv_name string, cv_text string")

    return make


def test_result_record_of_a_text_cv(frontend_jobs, texts):
    slices = market.market_slices(frontend_jobs)
    results = gap.result_record(gap.skill_gap(gap.text_cvs(texts("html css javascript, Middlesbrough")), slices))
    assert results.schema.names == schemas.RESULT.names
    assert [f.dataType.simpleString() for f in results.schema] == [f.dataType.simpleString() for f in schemas.RESULT]
    (r,) = results.collect()
    assert (r.detected_field, r.estimated_level, r.relevant_jobs) == ("frontend", "mid", 2)
    assert r.companies == ["Acme", "Beta"]
    assert r.high_demand == ["React (100.0%)", "HTML (100.0%)"]
    assert r.medium_demand == ["javascript (50.0%)", "JavaScript (50.0%)"] and r.low_demand == []
    assert r.matched_skills == ["HTML", "JavaScript"] and r.missing_skills == ["React"]
    assert r.fit_score == 50 and r.alignment_label == "Moderate Alignment"


def test_an_empty_level_falls_back(frontend_jobs, texts):
    two = frontend_jobs.filter("job_ord < 2")
    cvs = texts("html css javascript, Middlesbrough 5+ years")
    (r,) = gap.skill_gap(gap.text_cvs(cvs), market.market_slices(two)).collect()
    assert (r.level, r.relevant_jobs, r.used_fallback, r.fit_score) == ("senior", 2, True, 50)


def test_unknown_is_a_role_of_its_own(make_jobs, texts):
    slices = market.market_slices(make_jobs(("Cook", None, "Baking", None, None)))
    (r,) = gap.skill_gap(gap.text_cvs(texts("baking bread")), slices).collect()
    assert (r.role, r.matched_skills, r.fit_score) == ("unknown", ["Baking"], 100)


def test_accepted_and_rejected_are_all(frontend_jobs, texts):
    long = "html css javascript " * 20
    cvs = texts(long, "html", "docker kubernetes terraform " * 20, None)
    slices = market.market_slices(frontend_jobs)
    routed = {r.cv_id: r for r in gap.route(cvs, slices).collect()}
    assert [routed[i].status for i in range(4)] == ["accepted", "rejected", "rejected", "rejected"]
    assert [routed[i].reject_reason for i in range(4)] == [
        None,
        rules.REASON_UNREADABLE,
        rules.REASON_NO_JOBS,
        rules.REASON_UNREADABLE,
    ]
    assert routed[0].result.detected_field == "frontend" and routed[2].result is None
    turned_away = gap.rejects(gap.text_cvs(cvs), slices).collect()
    assert [r.cv_id for r in turned_away if r.cv_text] == [2]


def test_table_cv(frontend_jobs, spark):
    cvs = spark.createDataFrame(
        [(1, "A", "UI Developer", "JAVASCRIPT, sql , css", "3 years"), (2, "B", None, None, None)],
        schemas.CVS,
    )
    (r,) = gap.skill_gap(gap.table_cvs(cvs), market.market_slices(frontend_jobs)).collect()
    assert (r.cv_name, r.role, r.level, r.matched_skills, r.missing_skills, r.fit_score) == (
        "A",
        "frontend",
        "mid",
        ["JavaScript"],
        ["React", "HTML"],
        25,
    )


def test_searching_the_slice_equals_extracting_the_vocabulary(spark):
    """A text has a market skill exactly if extraction over the whole vocabulary finds it."""
    jobs = fixtures.jobs(spark, SMALL).cache()
    slices = market.market_slices(jobs)
    direct = gap.text_cvs(fixtures.cv_texts(spark, SMALL))
    extracted = skills.extract_skills(direct, skills.posting_skills(jobs)).withColumn(
        "cv_skill_names", F.transform("skills", F.lower)
    )
    by_list = gap.skill_gap(extracted.drop("cv_text_lower"), slices)
    columns = ["cv_id", "matched_skills", "missing_skills", "fit_score"]
    a = sorted(map(tuple, gap.skill_gap(direct, slices).select(columns).collect()))
    assert a == sorted(map(tuple, by_list.select(columns).collect())) and len(a) > 100


def test_membership_and_summary_agree_with_the_lists(spark):
    slices = market.market_slices(fixtures.jobs(spark, SMALL)).cache()
    cvs = gap.table_cvs(fixtures.cvs(spark, SMALL))
    gaps = gap.skill_gap(cvs, slices).cache()
    rows = gap.membership(cvs, slices)
    missing = rows.filter(~F.col("has")).groupBy("role", "level", "skill").count()
    assert sorted(map(tuple, gap.gap_summary(gaps).collect())) == sorted(map(tuple, missing.collect()))
    assert rows.filter("has").count() == gaps.agg(F.sum(F.size("matched_skills"))).first()[0]


def test_pairs(frontend_jobs, spark):
    cvs = spark.createDataFrame([(7, "A", "x", "html, React", None)], schemas.CVS)
    jobs = frontend_jobs.withColumn("cv_id", F.when(F.col("job_ord") < 2, 7))
    pairs = {r.job_ord: r for r in gap.compare_pairs(cvs, jobs, "cv_id").collect()}
    assert pairs[0].matched_skills == ["React", "HTML"] and pairs[0].missing_skills == ["javascript"]
    assert [pairs[i].fit_score for i in (0, 1)] == [67, 67] and len(pairs) == 2
    assert pairs[0].matched_preferred == [] and pairs[0].missing_preferred == []


def test_report_text(frontend_jobs, texts):
    slices = market.market_slices(frontend_jobs)
    results = gap.result_record(gap.skill_gap(gap.text_cvs(texts("html css javascript, Middlesbrough")), slices))
    (r,) = report.report(results).collect()
    lines = r.report.split("\n")
    assert lines[:4] == ["", "========== SKILL GAP SUMMARY ==========", "", "CV File: cv0"]
    assert "Relevant Jobs Analysed in This Field: 2" in lines
    at = lines.index("High-demand skills:")
    assert lines[at : at + 5] == ["High-demand skills:", "- React (100.0%)", "- HTML (100.0%)", "", "Medium-demand skills:"]
    at = lines.index("Low-demand / niche skills:")
    assert lines[at + 1] == "" and lines[at + 2] == "SKILLS YOU ALREADY HAVE:"
    assert "OVERALL FIT SCORE: 50%" in lines
    assert report.web_view(results).columns == rules.WEB_VIEW


def test_long_lists_compare_in_reasonable_time(spark):
    names = [f"Skill {i}" for i in range(2000)]
    frame = spark.createDataFrame([(names[::2], names + [n.upper() for n in names])], "a array<string>, b array<string>")
    started = time.monotonic()
    (r,) = frame.select(gap.strict_compare(F.col("a"), F.col("b")).alias("c")).collect()
    assert r.c.matched_skills == [n.upper() for n in names[::2]] and len(r.c.missing_skills) == 1000
    assert time.monotonic() - started < 60
