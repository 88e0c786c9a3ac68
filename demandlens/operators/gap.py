"""Scoring CVs against the market.

A CV meets its market in one broadcast lookup by (role, level); everything after it is computed from
that row alone.  CVs are therefore never shuffled, and a slice that a third of all CVs belong to
costs no more than any other.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens import rules
from demandlens.functions.classify import add_cv_class, add_text_class
from demandlens.functions.labels import alignment_label, demand_item, fit_score, similarity_summary
from demandlens.functions.prompts import clean_feedback, default_feedback
from demandlens.functions.text import bind, is_valid_text, split_skills
from demandlens.operators.feedback import with_feedback
from demandlens.operators.market import collapse_variants

ACCEPTED, REJECTED = "accepted", "rejected"


def text_cvs(cvs: DataFrame, keyword_rules=None) -> DataFrame:
    """Text CVs (``cv_id, cv_name, cv_text``) with role and level from their text."""
    return add_text_class(cvs, keyword_rules).withColumn("source_field", F.lit(rules.TEXT_SOURCE_FIELD))


def table_cvs(cvs: DataFrame, title_rules=None) -> DataFrame:
    """Table CVs with role from their field, level from their experience, and their skills normalized."""
    return add_cv_class(cvs, title_rules).withColumns(
        {
            "cv_name": F.col("full_name"),
            "source_field": F.coalesce("primary_field", F.lit("")),
            "cv_skill_names": F.transform(split_skills("technical_skills"), F.lower),
        }
    )


def select_slice(cvs: DataFrame, slices: DataFrame, how="inner") -> DataFrame:
    """Classified CVs with the market slice of their role and level (see ``market_slices``).

    CVs whose role nobody hires for are left out, or with ``how="left"`` kept with null market columns.
    """
    return cvs.join(F.broadcast(slices), ["role", "level"], how)


def rejects(cvs: DataFrame, slices: DataFrame) -> DataFrame:
    """Classified CVs whose role has no posting at all, with the reason."""
    roles = slices.select("role", "level")
    return cvs.join(F.broadcast(roles), ["role", "level"], "left_anti").withColumn(
        "reject_reason", F.lit(rules.REASON_NO_JOBS)
    )


def reject_reason(named_files=False, with_errors=False) -> Column:
    """Why a text CV joined with ``how="left"`` is turned away; null if it is accepted.

    A file of the wrong type is turned away first, then what could not be processed (``processing_error``), also if its file
    has no name for that reason.
    """
    wrong_type = ~is_accepted_file(F.col("file_name"))
    if named_files and with_errors:
        wrong_type &= F.col("file_name").isNotNull() | F.col("processing_error").isNull()
    reason = F.when(wrong_type, rules.REASON_BAD_FILE) if named_files else F
    reason = reason.when(F.col("processing_error").isNotNull(), rules.REASON_FAILED) if with_errors else reason
    return reason.when(~is_valid_text("cv_text"), rules.REASON_UNREADABLE).when(
        F.col("relevant_jobs").isNull(), rules.REASON_NO_JOBS
    )


def is_accepted_file(name) -> Column:
    """Whether an upload's file name ends in .pdf, in any case."""
    return F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def _has_skill(cvs: DataFrame, name: Column) -> Column:
    # A market skill comes from the postings the vocabulary comes from, so a text has it exactly if
    # extraction would find it: looking for the slice's few names gives the same matches.
    if "cv_text_lower" in cvs.columns:
        return F.contains(F.col("cv_text_lower"), name)
    return F.array_contains("cv_skill_names", name)


def skill_flags(cvs: DataFrame, slices: DataFrame, how="inner") -> DataFrame:
    """Add ``flags``: the slice's skills in market order, each with whether the CV has it."""
    joined = select_slice(cvs, slices, how)
    return joined.withColumn(
        "flags",
        F.transform(
            "entries", lambda e: F.struct(e["skill"].alias("skill"), _has_skill(joined, e["name"]).alias("has"))
        ),
    )


def split_flags(flagged: DataFrame) -> DataFrame:
    """Turn ``flags`` into ``matched_skills`` and ``missing_skills``."""
    return flagged.withColumns(
        {
            "matched_skills": F.transform(F.filter("flags", lambda f: f["has"]), lambda f: f["skill"]),
            "missing_skills": F.transform(F.filter("flags", lambda f: ~f["has"]), lambda f: f["skill"]),
        }
    ).drop("flags")


def skill_gap(cvs: DataFrame, slices: DataFrame, how="inner") -> DataFrame:
    """Score classified CVs: matched and missing skills, fit score and alignment label."""
    scored = split_flags(skill_flags(cvs, slices, how)).withColumn(
        "fit_score", fit_score(F.size("matched_skills"), F.size("demand"))
    )
    return scored.withColumn("alignment_label", alignment_label("fit_score"))


def membership(cvs: DataFrame, slices: DataFrame) -> DataFrame:
    """The same comparison as rows: ``cv_id, role, level, pos, skill, has``."""
    return skill_flags(cvs, slices).select(
        "cv_id", "role", "level", F.posexplode("flags").alias("pos", "flag")
    ).select("cv_id", "role", "level", "pos", "flag.skill", "flag.has")


def compare_names(names: Column, listed: Column) -> Column:
    """Compare lowercase names with a skill array: a struct of matched, missing and fit score, in the order of ``listed``."""

    def compared(known):
        matched = F.filter(known["entries"], lambda e: F.array_contains(known["names"], e["name"]))
        missing = F.filter(known["entries"], lambda e: ~F.array_contains(known["names"], e["name"]))
        return F.struct(
            F.transform(matched, lambda e: e["skill"]).alias("matched_skills"),
            F.transform(missing, lambda e: e["skill"]).alias("missing_skills"),
            fit_score(F.size(matched), known["n"]).alias("fit_score"),
        )

    known = F.struct(names.alias("names"), collapse_variants(listed).alias("entries"), F.size(listed).alias("n"))
    return bind(known, compared)


def strict_compare(user_skills: Column, listed: Column) -> Column:
    """Compare two skill arrays, whatever the case of the user's skills (see ``compare_names``)."""
    return compare_names(F.transform(user_skills, F.lower), listed)


def demand_items(bucket: str) -> Column:
    return F.transform(
        F.filter("demand", lambda d: d["bucket"] == bucket), lambda d: demand_item(d["skill"], d["demand_pct"])
    )


def result_columns(gaps: DataFrame) -> list[Column]:
    """The result record of scored CVs (``schemas.RESULT``): with their ``feedback`` if they have any
    (see ``feedback.with_feedback``), else with a sentence made from the numbers."""
    feedback = clean_feedback(default_feedback("role", "matched_skills", "missing_skills", "fit_score"))
    feedback = F.col("feedback") if "feedback" in gaps.columns else feedback
    return [
        F.col("cv_name").alias("cv_file"),
        F.col("source_field"),
        F.col("role").alias("detected_field"),
        F.col("level").alias("estimated_level"),
        F.col("relevant_jobs"),
        F.col("companies"),
        demand_items("high").alias("high_demand"),
        demand_items("medium").alias("medium_demand"),
        demand_items("low").alias("low_demand"),
        F.col("matched_skills"),
        F.col("missing_skills"),
        F.col("fit_score"),
        F.col("alignment_label"),
        similarity_summary("fit_score", "role").alias("similarity_summary"),
        feedback.alias("feedback"),
    ]


def result_record(gaps: DataFrame) -> DataFrame:
    """The result records of scored CVs."""
    return gaps.select(*result_columns(gaps))


def route(cvs: DataFrame, slices: DataFrame, fn=None) -> DataFrame:
    """Every text CV once: ``cv_id, cv_name, status, reject_reason, result``.

    Accepted and rejected CVs come out of the same single pass over the texts.  With a ``file_name`` column, a
    file of the wrong type is rejected first, and with ``processing_error`` (see ``sources.uploads``) what has one is next.
    ``fn`` answers the feedback prompts of accepted CVs.
    """
    scored = skill_gap(text_cvs(cvs), slices, how="left")
    reason = reject_reason("file_name" in cvs.columns, "processing_error" in cvs.columns)
    scored = scored.withColumn("reject_reason", reason)
    accepted = F.col("reject_reason").isNull()
    if fn is not None:
        scored = with_feedback(scored, fn, accepted)
    return scored.select(
        "cv_id",
        "cv_name",
        F.when(accepted, ACCEPTED).otherwise(REJECTED).alias("status"),
        "reject_reason",
        F.when(accepted, F.struct(*result_columns(scored))).alias("result"),
    )


def gap_summary(gaps: DataFrame) -> DataFrame:
    """How many CVs of each role and level miss each skill."""
    return (
        gaps.select("role", "level", F.explode("missing_skills").alias("skill"))
        .groupBy("role", "level", "skill")
        .agg(F.count(F.lit(1)).alias("cvs_missing"))
    )


def compare_pairs(cvs: DataFrame, jobs: DataFrame, on) -> DataFrame:
    """Compare table CVs with the postings they are paired with.

    ``on`` joins them (a column name or condition such as "this CV applied to this posting"), so
    the result has as many rows as there are pairs.  Fit counts required skills; preferred ones are reported apart.
    """
    # A CV's names are lowered once, before its pairs are formed.
    named = cvs.withColumn("_names", F.transform(split_skills("technical_skills"), F.lower))
    compared = named.join(jobs, on).withColumns(
        {
            "_r": compare_names(F.col("_names"), split_skills("required_skills")),
            "_p": compare_names(F.col("_names"), split_skills("preferred_skills")),
        }
    )
    return compared.select(
        "cv_id",
        "job_ord",
        F.col("_r.matched_skills").alias("matched_skills"),
        F.col("_r.missing_skills").alias("missing_skills"),
        F.col("_r.fit_score").alias("fit_score"),
        F.col("_p.matched_skills").alias("matched_preferred"),
        F.col("_p.missing_skills").alias("missing_preferred"),
    )
