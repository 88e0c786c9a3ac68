"""Prompt and feedback columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandlens import rules
from demandlens.functions.text import as_col, bind, fill, replace_all
from demandlens.schemas import ANSWER


def listed(skills) -> Column:
    return F.array_join(as_col(skills), ", ")


def feedback_prompt(role, level, matched, missing, fit) -> Column:
    """The prompt that asks a model for a feedback paragraph."""
    return fill(
        rules.FEEDBACK_PROMPT,
        role_name=fill(rules.FEEDBACK_ROLE_FORMAT, role=role, level=level),
        matched=listed(matched),
        missing=listed(missing),
        fit_score=fit,
    )


def pair_prompt(cv_skills, job_skills) -> Column:
    """The prompt that asks a model to compare a skill list with one posting's list."""
    return fill(rules.SKILL_PAIR_PROMPT, cv_skills=cv_skills, job_skills=job_skills)


def text_pair_prompt(cv_text, role, required, preferred) -> Column:
    """The prompt that asks a model to compare a whole CV text with one posting (skill arrays)."""
    return fill(
        rules.TEXT_PAIR_PROMPT,
        cv_text=cv_text,
        role=role,
        required=listed(required),
        preferred=listed(preferred),
    )


def clean_feedback(c) -> Column:
    """Turn wording about "the candidate" into wording addressed to the reader."""
    return replace_all(c, rules.FEEDBACK_REPLACEMENTS)


def default_feedback(role, matched, missing, fit) -> Column:
    """A feedback sentence made from the numbers alone, for use without a model."""
    matched, missing = as_col(matched), as_col(missing)
    strengths = F.when(F.size(matched) > 0, F.concat(F.lit("You already show "), listed(matched), F.lit("."))).otherwise(
        F.lit("None of the most requested skills show in your CV yet.")
    )
    gaps = F.when(F.size(missing) > 0, F.concat(F.lit(" Work next on "), listed(missing), F.lit("."))).otherwise(
        F.lit(" You cover every one of the most requested skills.")
    )
    score = fill(" Your fit with the {role} market is {fit}%.", role=role, fit=fit)
    return F.concat(strengths, gaps, score)


def parse_answer(c) -> Column:
    """A model's JSON answer as a struct; null unless it parses and its score lies in 0 to 100."""
    answer = F.from_json(as_col(c), ANSWER, {"mode": "PERMISSIVE"})
    return bind(answer, lambda a: F.when(a["fit_score"].between(0, 100), a))
