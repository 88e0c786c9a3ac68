"""Schemas of the inputs and of the result record."""

from pyspark.sql import types as T


def _strings(*names):
    return [T.StructField(n, T.StringType(), True) for n in names]


JOBS = T.StructType(
    [T.StructField("job_ord", T.LongType(), False)]
    + _strings(
        "job_title",
        "seniority_level",
        "required_skills",
        "preferred_skills",
        "company_name",
        "source_file",
    )
)
# Columns whose absence is an error; every other column of JOBS reads as empty when absent.
JOBS_REQUIRED = ["job_title"]

CVS = T.StructType(
    [T.StructField("cv_id", T.LongType(), False)]
    + _strings("full_name", "primary_field", "technical_skills", "experience")
)
CVS_REQUIRED = []

CV_TEXTS = T.StructType(
    [T.StructField("cv_id", T.LongType(), False)]
    + _strings("cv_name", "cv_text")
    + [T.StructField("modified_at", T.TimestampType(), True)]
)

_STRING_LIST = T.ArrayType(T.StringType())

RESULT = T.StructType(
    _strings("cv_file", "source_field", "detected_field", "estimated_level")
    + [T.StructField("relevant_jobs", T.LongType())]
    + [
        T.StructField(n, _STRING_LIST)
        for n in (
            "companies",
            "high_demand",
            "medium_demand",
            "low_demand",
            "matched_skills",
            "missing_skills",
        )
    ]
    + [T.StructField("fit_score", T.IntegerType())]
    + _strings("alignment_label", "similarity_summary", "feedback")
)

ANSWER = T.StructType(
    [
        T.StructField("matched_skills", _STRING_LIST),
        T.StructField("missing_skills", _STRING_LIST),
        T.StructField("fit_score", T.IntegerType()),
        T.StructField("feedback", T.StringType()),
    ]
)
