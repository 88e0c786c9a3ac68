"""Kept answers: how often the model is asked is counted in a file that every call appends to."""

import os
import subprocess
import sys
import textwrap
from collections import Counter
from pathlib import Path

import pytest

from demandlens.operators import feedback


def counting(log, fails=()):
    def model(batch):
        with open(log, "a") as out:
            out.writelines(f"{prompt}\n" for prompt in batch)
        if any(prompt in fails for prompt in batch):
            raise ValueError("busy")
        return [f"to {prompt}" for prompt in batch]

    return model


def asked(log):
    return Counter(Path(log).read_text().split("\n")[:-1]) if os.path.exists(log) else Counter()


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "log"), str(tmp_path / "store")


def frame(spark, prompts):
    return spark.createDataFrame([(i, p, "own") for i, p in enumerate(prompts)], "id long, prompt string, digest string")


def answers(df):
    return {r.id: r.answer for r in df.collect()}


def test_each_prompt_is_asked_once_over_runs_and_reads(spark, places):
    log, store = places
    prompts = [f"p{i % 40}" for i in range(100)] + [None]
    result = feedback.durable_answers(frame(spark, prompts), counting(log), store)
    assert result.columns == ["id", "prompt", "digest", "answer"]
    want = {i: p and f"to {p}" for i, p in enumerate(prompts)}
    assert answers(result) == want and answers(result) == want
    assert asked(log) == Counter({f"p{i}": 1 for i in range(40)})
    more = frame(spark, [*prompts, "new"])
    assert answers(feedback.durable_answers(more, counting(log), store)) == want | {101: "to new"}
    assert asked(log) == Counter({f"p{i}": 1 for i in range(40)} | {"new": 1})
    assert answers(feedback.durable_answers(frame(spark, []), counting(log), store)) == {}


def test_failed_calls_are_asked_again_by_the_next_run_only(spark, places, monkeypatch):
    log, store = places
    monkeypatch.setattr(feedback, "PROMPTS_PER_TASK", 1000)
    prompts = [f"p{i}" for i in range(64)]
    first = feedback.durable_answers(frame(spark, prompts), counting(log, {"p7"}), store)
    assert answers(first) == {i: "Model error: busy" if i == 7 else f"to p{i}" for i in range(64)}
    # The halves that hold the failing prompt: 64, 32, ..., 1.
    assert max(asked(log).values()) == 7 and sum(asked(log).values()) < 3 * 64
    before = asked(log)
    second = feedback.durable_answers(frame(spark, prompts), counting(log), store)
    assert answers(second)[7] == "to p7" and asked(log) - before == Counter({"p7": 1})


def test_a_job_that_fails_later_does_not_ask_again(spark, places):
    from pyspark.sql import functions as F

    log, store = places
    result = feedback.durable_answers(frame(spark, ["a", "b"]), counting(log), store)
    with pytest.raises(Exception, match="later"):
        result.select(F.raise_error(F.concat(F.lit("later "), "answer"))).collect()
    assert answers(result) == {0: "to a", 1: "to b"} and asked(log) == Counter({"a": 1, "b": 1})


RETRIED = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
sys.path.insert(0, {repo!r})
from demandlens.operators import feedback
spark = (SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())

def model(batch):
    with open({log!r}, "a") as out:
        out.writelines(p + "\\n" for p in batch)
    return ["to " + p for p in batch]

@F.pandas_udf("string")
def fragile(answers):
    if TaskContext.get().attemptNumber() == 0:
        raise ValueError("lost")
    return answers

prompts = spark.range(60).select(F.concat(F.lit("p"), F.col("id") % 20).alias("prompt"))
rows = feedback.durable_answers(prompts, model, {store!r}).select("prompt", fragile("answer").alias("answer")).collect()
assert len(rows) == 60 and all(r.answer == "to " + r.prompt for r in rows)
"""


def test_over_a_task_retry(tmp_path, places):
    log, store = places
    script = textwrap.dedent(RETRIED.format(repo=str(Path(__file__).parent.parent), log=log, store=store, shared=str(tmp_path / "shared")))
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert asked(log) == Counter({f"p{i}": 1 for i in range(20)})
