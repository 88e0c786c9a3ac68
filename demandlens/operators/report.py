"""Views of the result record: the plain-text report and the web fields."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens import rules
from demandlens.functions.prompts import clean_feedback, listed


def _items(title: str, column: str) -> list[Column]:
    bullets = F.transform(column, lambda s: F.concat(F.lit("- "), s))
    return [F.lit(""), F.lit(title), F.when(F.size(column) > 0, F.array_join(bullets, "\n"))]


def report_text() -> Column:
    """The report of a result record; empty lists leave just their heading."""
    lines = [F.lit(""), F.lit(rules.REPORT_TITLE), F.lit("")]
    lines += [F.concat(F.lit(label), F.coalesce(F.col(c).cast("string"), F.lit(""))) for label, c in rules.REPORT_FACTS]
    lines += [F.lit(""), F.lit(rules.REPORT_COMPANIES), listed("companies"), F.lit(""), F.lit(rules.REPORT_DEMAND)]
    for title, column in rules.REPORT_LISTS_DEMAND + rules.REPORT_LISTS_SKILLS:
        lines += _items(title, column)
    lines += [
        F.lit(""),
        F.concat(F.lit(rules.REPORT_FIT), F.col("fit_score").cast("string"), F.lit("%")),
        F.concat(F.lit(rules.REPORT_LABEL), F.col("alignment_label")),
        F.lit(""),
        F.lit(rules.REPORT_SIMILARITY),
        F.col("similarity_summary"),
        F.lit(""),
        F.lit(rules.REPORT_FEEDBACK),
        clean_feedback("feedback"),
    ]
    return F.concat_ws("\n", *lines)


def report(results: DataFrame) -> DataFrame:
    """``cv_file, report`` for every result record."""
    return results.select("cv_file", report_text().alias("report"))


def web_view(results: DataFrame) -> DataFrame:
    """The fields a results page shows."""
    return results.select(*rules.WEB_VIEW)
