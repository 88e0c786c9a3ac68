"""Role and level rules as column expressions.

Each public function takes a raw column.  The ``add_*`` functions do the same on a DataFrame but
lower the text once, in a projection of its own that every rule then reads.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens import rules
from demandlens.functions.text import as_col, bind, max_years, normalize_skill


def _title_role(lowered: Column, title_rules) -> Column:
    chain = F
    for role, variants in title_rules.items():
        # A variant that contains another one of its role cannot add a hit.
        shortest = [v for v in variants if not any(other != v and other in v for other in variants)]
        hit = reduce(lambda a, b: a | b, [lowered.contains(v) for v in shortest])
        chain = chain.when(hit, F.lit(role))
    return chain.otherwise(F.lit(rules.UNKNOWN_ROLE))


def _job_level(lowered_title: Column, seniority: Column) -> Column:
    stated = normalize_skill(seniority)
    return (
        F.when(lowered_title.contains("senior"), "senior")
        .when(lowered_title.contains("junior"), "junior")
        .when(lowered_title.contains("mid"), "mid")
        .when(stated.isin(rules.LEVELS), stated)
        .otherwise("mid")
    )


def _score(lowered: Column, keywords) -> Column:
    # A filter over a literal array: with dozens of keywords it runs faster than as many added-up
    # tests, whose generated method grows too large for the JVM to compile.
    present = F.filter(F.array(*[F.lit(k) for k in dict.fromkeys(keywords)]), lambda k: F.contains(lowered, k))
    return F.size(present)


def _text_role(lowered: Column, keyword_rules) -> Column:
    # One struct per role, ordered by (score, earlier declaration).  The "unknown" entry wins only
    # when every score is zero.
    def entry(score, priority, role):
        return F.struct(score.alias("score"), F.lit(priority).alias("priority"), F.lit(role).alias("role"))

    entries = [entry(F.lit(0), 1, rules.UNKNOWN_ROLE)]
    entries += [entry(_score(lowered, words), -i, role) for i, (role, words) in enumerate(keyword_rules.items())]
    return F.greatest(*entries).getField("role")


def _years_level(years: Column) -> Column:
    return (
        F.when(years >= rules.SENIOR_YEARS, "senior")
        .when(years >= rules.MID_YEARS, "mid")
        .otherwise("junior")
    )


def _text_level(lowered: Column, years: Column) -> Column:
    return (
        F.when(lowered.contains("senior") | (years >= rules.SENIOR_YEARS), "senior")
        .when(lowered.contains("mid") | (years >= rules.MID_YEARS), "mid")
        .otherwise("junior")
    )


def role_from_title(c, title_rules=None) -> Column:
    """Role of a job title or CV field: the first declared role one of whose variants occurs in it."""
    return _title_role(F.lower(as_col(c)), title_rules or rules.TITLE_RULES)


def level_from_job(title, seniority) -> Column:
    """Level of a posting: stated in the title, else by the seniority column, else mid."""
    return _job_level(F.lower(as_col(title)), as_col(seniority))


def role_from_text(c, keyword_rules=None) -> Column:
    """Role of free text: the role with most of its keywords present; the first declared on a tie."""
    text = F.coalesce(F.lower(as_col(c)), F.lit(""))
    return bind(text, lambda t: _text_role(t, keyword_rules or rules.KEYWORD_RULES))


def keyword_score(c, keywords) -> Column:
    """How many distinct keywords occur in the text."""
    return bind(F.coalesce(F.lower(as_col(c)), F.lit("")), lambda t: _score(t, keywords))


def level_from_text(c) -> Column:
    """Level of free text: the words "senior" or "mid" anywhere in it, or its largest "N years"."""
    return bind(F.lower(as_col(c)), lambda t: _text_level(t, max_years(t)))


def level_from_experience(c) -> Column:
    """Level of a table CV: its largest "N years"."""
    return _years_level(max_years(F.lower(as_col(c))))


def add_posting_class(jobs: DataFrame, title_rules=None) -> DataFrame:
    """Add ``role`` and ``level`` to postings."""
    title = F.col("_title")
    return (
        jobs.withColumn("_title", F.lower("job_title"))
        .withColumns(
            {
                "role": _title_role(title, title_rules or rules.TITLE_RULES),
                "level": _job_level(title, F.col("seniority_level")),
            }
        )
        .drop("_title")
    )


def add_text_class(cvs: DataFrame, keyword_rules=None) -> DataFrame:
    """Add ``role``, ``level`` and the lowercase text ``cv_text_lower`` to text CVs."""
    text = F.col("cv_text_lower")
    return (
        cvs.withColumn("cv_text_lower", F.coalesce(F.lower("cv_text"), F.lit("")))
        .withColumn("_years", max_years(text))
        .withColumns(
            {
                "role": _text_role(text, keyword_rules or rules.KEYWORD_RULES),
                "level": _text_level(text, F.col("_years")),
            }
        )
        .drop("_years")
    )


def add_cv_class(cvs: DataFrame, title_rules=None) -> DataFrame:
    """Add ``role`` and ``level`` to table CVs."""
    return (
        cvs.withColumn("_years", max_years(F.lower("experience")))
        .withColumns(
            {
                "role": role_from_title("primary_field", title_rules),
                "level": _years_level(F.col("_years")),
            }
        )
        .drop("_years")
    )
