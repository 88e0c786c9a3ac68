from pyspark.sql import functions as F

from demandlens.operators import market


def slices_of(df):
    return {(r.role, r.level): r for r in df.collect()}


def test_profile_of_a_small_market(frontend_jobs):
    profile = slices_of(market.market_profile(frontend_jobs))
    mid = profile["frontend", "mid"]
    assert mid.total_jobs == 2
    assert [(d.skill, d.demand_count, d.demand_pct, d.bucket) for d in mid.demand] == [
        ("React", 2, 100.0, "high"),
        ("HTML", 2, 100.0, "high"),
        ("javascript", 1, 50.0, "medium"),
        ("JavaScript", 1, 50.0, "medium"),
    ]
    assert [(e.name, e.skill) for e in mid.entries] == [
        ("react", "React"),
        ("html", "HTML"),
        ("javascript", "JavaScript"),
    ]
    assert mid.companies == ["Acme", "Beta"]
    whole = profile["frontend", None]
    assert whole.total_jobs == 3 and whole.companies == ["Acme", "Beta", "Gamma"]
    assert [d.skill for d in whole.demand] == ["React", "HTML", "javascript", "JavaScript", "CSS"]


def test_repeats_within_a_posting_count(make_jobs):
    jobs = make_jobs(("Backend", None, "SQL, Go, SQL", None, ""), ("Backend", None, None, None, None))
    mid = slices_of(market.market_profile(jobs))["backend", "mid"]
    assert [(d.skill, d.demand_count, d.demand_pct) for d in mid.demand] == [("SQL", 2, 100.0), ("Go", 1, 50.0)]
    assert mid.total_jobs == 2 and mid.companies == []


def test_postings_without_skills_still_make_a_slice(make_jobs):
    jobs = make_jobs(("Backend", None, None, None, "A"))
    mid = slices_of(market.market_profile(jobs))["backend", "mid"]
    assert mid.total_jobs == 1 and mid.demand == [] and mid.entries == []


def test_companies_are_the_first_twenty_by_name(make_jobs):
    jobs = make_jobs(*[("Backend", None, None, None, f"c{i:02d}") for i in range(40, 0, -1)] * 2)
    rows = market.companies(jobs).filter("level = 'mid'").orderBy("rank").collect()
    assert [r.company for r in rows] == [f"c{i:02d}" for i in range(1, 21)]


def test_slice_sizes(frontend_jobs):
    sizes = {(r.role, r.level): r.total_jobs for r in market.slice_sizes(frontend_jobs).collect()}
    assert sizes == {("frontend", "mid"): 2, ("frontend", "senior"): 1, ("frontend", None): 3}


def test_empty_levels_fall_back_to_the_role(frontend_jobs):
    slices = slices_of(market.market_slices(frontend_jobs))
    assert {k: (r.relevant_jobs, r.used_fallback) for k, r in slices.items()} == {
        ("frontend", "junior"): (3, True),
        ("frontend", "mid"): (2, False),
        ("frontend", "senior"): (1, False),
    }


def test_a_hot_slice_gives_the_same_market_in_any_partitioning(spark):
    """One slice holds nearly all rows and one skill is in all of them."""
    rows = spark.range(20000).select(
        F.col("id").alias("job_ord"),
        F.when(F.col("id") % 50 == 0, "Data Engineer").otherwise("Backend Developer").alias("job_title"),
        F.lit(None).cast("string").alias("seniority_level"),
        F.concat(F.lit("SQL, s"), (F.col("id") % 3000).cast("string"), F.lit(", s"), (F.col("id") % 7).cast("string")).alias(
            "required_skills"
        ),
        F.lit(None).cast("string").alias("preferred_skills"),
        F.concat(F.lit("c"), (F.col("id") % 5000).cast("string")).alias("company_name"),
    )
    def top(df):
        return sorted(map(tuple, market.market(df).fillna("all").collect()))

    split = top(rows.repartition(13))
    assert split == top(rows.coalesce(1))
    first = next(r for r in split if r[:2] == ("backend", "mid") and r[3] == 1)
    assert first[4:6] == ("SQL", 19600) and first[2] == 19600
