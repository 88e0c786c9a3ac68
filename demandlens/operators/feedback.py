"""The feedback stage: a caller's model function over the prompt column, with or without a store of its answers."""

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens import rules
from demandlens.functions.prompts import clean_feedback, default_feedback, feedback_prompt
from demandlens.session import ship


def _answer_text(reply) -> str:
    """A reply's text: a server's decoded reply holds it under ``response``."""
    if isinstance(reply, dict):
        return reply["response"].strip() if "response" in reply else f"{rules.MODEL_ERROR_PREFIX}{reply}"
    return str(reply).strip()


def _replies(fn, prompts: pd.Series) -> list:
    """The batch's replies; if the batch fails, those of its halves, so that only those prompts fail that must.

    A prompt is asked again only as long as it shares a part with one that fails.
    """
    try:
        replies = list(fn(prompts))
        if len(replies) == len(prompts):
            return [_answer_text(r) for r in replies]
        error = f"{len(replies)} replies to {len(prompts)} prompts"
    except Exception as problem:  # whatever the caller's function raises
        error = str(problem)
    if len(prompts) == 1:
        return [f"{rules.MODEL_ERROR_PREFIX}{error}"]
    half = len(prompts) // 2
    return _replies(fn, prompts.iloc[:half]) + _replies(fn, prompts.iloc[half:])


def model_answers(prompt, fn: Callable[[pd.Series], list]):
    """Answers of ``fn`` to a prompt column.  ``fn`` maps a batch of prompts to as many replies.

    Only the prompt column travels to Python, in Arrow batches; null prompts are not asked.  A failed call is an
    answer too (``Model error: ...``), of its row only.  The answers count as not deterministic, so that no
    filter on them asks twice.
    """

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(prompts), dtype=object)
        asked = prompts[prompts.notna()]
        if len(asked):
            out[prompts.notna().to_numpy()] = _replies(fn, asked)
        return out

    return ask.asNondeterministic()(prompt)


def with_feedback(gaps: DataFrame, fn: Callable[[pd.Series], list] | None = None, where=None) -> DataFrame:
    """Add ``feedback`` to scored CVs: the cleaned answer of ``fn``, or a sentence made from the numbers.

    With ``where``, rows outside it are not asked about.
    """
    args = ("matched_skills", "missing_skills", "fit_score")
    if fn is None:
        raw = default_feedback("role", *args)
    else:
        ship(gaps.sparkSession)
        prompt = feedback_prompt("role", "level", *args)
        raw = model_answers(prompt if where is None else F.when(where, prompt), fn)
    return gaps.withColumn("feedback", clean_feedback(raw))


# ---- answers that are kept ----------------------------------------------------------------------

ANSWERS = "digest string, prompt string, answer string, failed boolean"
# Prompts that a task asks at most, about: what is asked again if it is lost.
PROMPTS_PER_TASK = 512


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """Answers kept so far, one for each prompt's digest: ``digest, answer``.  Failed calls are not answers."""
    try:
        kept = spark.read.schema(ANSWERS).option("recursiveFileLookup", True).parquet(store)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = spark.createDataFrame([], ANSWERS)
    return kept.filter("NOT failed").groupBy("digest").agg(F.min("answer").alias("answer"))


def ask_new(prompts: DataFrame, fn: Callable[[pd.Series], list], store: str, prompt_col="prompt") -> str:
    """Ask ``fn`` every distinct prompt that ``store`` has no answer to, and keep the answers; the folder they are in.

    Each call writes a folder of its own, which counts once its job is done.  The work is cut into tasks of about
    ``PROMPTS_PER_TASK`` prompts; whatever fails or is repeated after the job, nothing is asked again.  A task that is lost
    while it asks repeats its own prompts only.  Failed calls are kept apart: they answer this call and are asked again by the next.
    """
    spark = ship(prompts.sparkSession)
    digest = F.sha2(F.col(prompt_col), 256)
    asked = prompts.select(digest.alias("digest"), F.col(prompt_col).alias("prompt")).filter("prompt IS NOT NULL")
    new = asked.distinct().join(stored_answers(spark, store).select("digest"), "digest", "left_anti")
    path = f"{store}/run={uuid.uuid4().hex}"
    # The new prompts first, as a table: how many there are says into how many tasks they go.
    new.write.parquet(f"{path}/new")
    listed = spark.read.schema("digest string, prompt string").parquet(f"{path}/new")
    tasks = -(-listed.count() // PROMPTS_PER_TASK)
    if tasks:
        answered = listed.repartition(tasks, "digest").withColumn("answer", model_answers(F.col("prompt"), fn))
        failed = F.col("answer").startswith(rules.MODEL_ERROR_PREFIX)
        answered.withColumn("failed", failed).write.parquet(f"{path}/answers")
    return path


def durable_answers(df: DataFrame, fn: Callable[[pd.Series], list], store: str, prompt_col="prompt", out="answer") -> DataFrame:
    """``df`` with the answer to its prompt in ``out``, asked now (see `ask_new`) or kept from before; null prompts have none.

    ``store`` is a folder that all executors reach.  Rows with equal prompts share one call.  Reading the result, once or often, asks
    nothing.
    """
    path = ask_new(df, fn, store, prompt_col)
    kept, spark = stored_answers(df.sparkSession, store), df.sparkSession
    try:
        failed = spark.read.schema(ANSWERS).parquet(f"{path}/answers").filter("failed").select("digest", "answer")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        kept = kept.union(failed)
    answers = kept.select(F.col("digest").alias("_kept_digest"), F.col("answer").alias("_kept_answer"))
    both = df.join(answers, F.sha2(F.col(prompt_col), 256) == F.col("_kept_digest"), "left")
    return both.select(*[df[c] for c in df.columns if c != out], F.col("_kept_answer").alias(out))


def with_durable_feedback(gaps: DataFrame, fn: Callable[[pd.Series], list], store: str) -> DataFrame:
    """Add ``feedback`` to scored CVs as `with_feedback` does, by answers that are kept in ``store``."""
    prompt = feedback_prompt("role", "level", "matched_skills", "missing_skills", "fit_score")
    answered = durable_answers(gaps.withColumn("_prompt", prompt), fn, store, "_prompt", "_answer")
    return answered.withColumn("feedback", clean_feedback(F.col("_answer"))).drop("_prompt", "_answer")
