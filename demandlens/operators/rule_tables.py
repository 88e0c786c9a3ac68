"""Roles by a table of rules: rules are rows, so they may be many and may come from anywhere.

``functions.classify`` turns a few rules into one expression.  Here each rule is a row ``role, priority, keyword``: its keyword is
found in the texts by the index of `operators.skills`, what is found meets the rules in one join, and the best role of each
text comes from partial aggregates.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens import rules as fixed
from demandlens.operators.skills import extract_skills

MOST, FIRST = "most", "first"


def rule_rows(spark: SparkSession, rules: dict[str, list[str]]) -> DataFrame:
    """Rules declared as a dict, roles in order, as rows ``role, priority, keyword``."""
    rows = [(role, i, word) for i, (role, words) in enumerate(rules.items()) for word in words]
    return spark.createDataFrame(rows, "role string, priority int, keyword string")


def matched_rules(texts: DataFrame, rules: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rules whose keyword occurs in a text, whatever its case: ``_id, _mark, role, priority, keyword``, each once.

    ``_mark`` tells texts of one id apart.  Null and empty keywords match nothing; a rule that is there twice counts once.
    """
    known = rules.select("role", "priority", F.lower("keyword").alias("keyword")).filter("keyword != ''").distinct()
    own = texts.select(F.col(id_col).alias("cv_id"), F.col(text_col).alias("_text"))
    found = extract_skills(own, known.select(F.col("keyword").alias("skill")), "_text")
    found = found.select(F.col("cv_id").alias("_id"), F.xxhash64("_text").alias("_mark"), "skills").dropDuplicates(["_id", "_mark"])
    return found.select("_id", "_mark", F.explode("skills").alias("keyword")).join(known, "keyword")


def role_by_rules(texts: DataFrame, rules: DataFrame, id_col="cv_id", text_col="cv_text", pick=MOST, out="role") -> DataFrame:
    """``texts`` with their role by a table of rules (``role, priority, keyword``) in the column ``out``.

    With ``pick="most"`` the role with most distinct keywords in the text, on a tie that of the lowest priority number, then
    the first by name (as ``classify.role_from_text`` by a dict); with ``pick="first"`` the role of the lowest number
    any of whose keywords occurs (as ``classify.role_from_title``).  Without any the role is ``unknown``.  Rows that share an id
    are each judged by themselves; null texts are ``unknown``.
    """
    if pick not in (MOST, FIRST):
        raise ValueError(f"pick is {MOST} or {FIRST}, not {pick}")
    scores = matched_rules(texts, rules, id_col, text_col).groupBy("_id", "_mark", "role", "priority")
    scores = scores.agg((-F.count(F.lit(1)) if pick == MOST else F.lit(0)).alias("_score"))
    best = scores.groupBy("_id", "_mark").agg(F.min(F.struct("_score", "priority", "role")).alias("_best"))
    best = best.select(F.col("_id").alias("_best_id"), F.col("_mark").alias("_best_mark"), F.col("_best.role").alias("_best_role"))
    marked = texts.withColumn("_own_mark", F.xxhash64(text_col))
    both = marked.join(best, marked[id_col].eqNullSafe(F.col("_best_id")) & (F.col("_own_mark") == F.col("_best_mark")), "left")
    kept = [marked[c] for c in texts.columns if c != out]
    return both.select(*kept, F.coalesce("_best_role", F.lit(fixed.UNKNOWN_ROLE)).alias(out))
