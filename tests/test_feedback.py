import pytest
from pyspark.sql import functions as F

from demandlens import rules
from demandlens.functions import prompts
from demandlens.operators import feedback, gap, market
from demandlens.streaming import intake


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(1, "backend", "mid", ["SQL", "Go"], ["R"], 67), (2, "devops", "senior", [], ["Git"], 0)]
    schema = "cv_id long, role string, level string, matched_skills array<string>, missing_skills array<string>, fit_score int"
    return spark.createDataFrame(rows, schema)


def test_feedback_prompt(gaps):
    prompt = prompts.feedback_prompt("role", "level", "matched_skills", "missing_skills", "fit_score")
    first = gaps.orderBy("cv_id").select(prompt.alias("p")).first().p
    assert first.startswith("\nYou are a skill gap analysis assistant.\n\nWrite a short")
    assert "\nRole:\nbackend (mid) market demand summary\n\nSkills already present:\nSQL, Go\n\n" in first
    assert "\nSkills missing or weaker:\nR\n\nFit score:\n67%\n\nStrict rules:\n" in first
    assert first.endswith("- no markdown\n")


def test_pair_prompts(evaluate):
    (p,) = evaluate(prompts.pair_prompt("a", "b"), [("x, y", "z")], "a string, b string")
    assert "\nUser Skills:\nx, y\n\nRole Market Skills:\nz\n\n" in p
    assert '{\n  "matched_skills": [],\n  "missing_skills": [],\n  "fit_score": 0,\n  "feedback": ""\n}' in p
    args = "t string, r string, q array<string>, p array<string>"
    (p,) = evaluate(prompts.text_pair_prompt("t", "r", "q", "p"), [("cv", "ML", ["a", "b"], [])], args)
    assert "CV TEXT:\ncv\n\nJOB ROLE:\nML\n\nREQUIRED SKILLS:\na, b\n\nPREFERRED SKILLS:\n\n\nReturn JSON only:" in p


def test_wording(evaluate):
    values = ["The candidate and users", "Candidate; The applicant, applicant. User", None]
    assert evaluate(prompts.clean_feedback("v"), values, "v string") == ["You and yous", "You; You, you. User", None]


def test_feedback_without_a_model(gaps):
    rows = feedback.with_feedback(gaps).orderBy("cv_id").collect()
    assert rows[0].feedback == "You already show SQL, Go. Work next on R. Your fit with the backend market is 67%."
    assert rows[1].feedback.startswith("None of the most requested skills")


def test_feedback_with_a_model(gaps):
    def model(batch):
        return [{"response": "  The candidate is fine \n"} if "backend" in p else {"error": "busy"} for p in batch]

    rows = feedback.with_feedback(gaps, model).orderBy("cv_id").collect()
    assert [r.feedback for r in rows] == ["You is fine", "Model error: {'error': 'busy'}"]
    plain = feedback.with_feedback(gaps, lambda batch: [" ok "] * len(batch))
    assert {r.feedback for r in plain.collect()} == {"ok"}


def test_a_failed_call_is_the_answer_of_its_row(gaps):
    def model(batch):
        if any("backend" in p for p in batch):
            raise TimeoutError("too slow")
        return ["fine"] * len(batch)

    rows = feedback.with_feedback(gaps.coalesce(1), model).orderBy("cv_id").collect()
    assert [r.feedback for r in rows] == ["Model error: too slow", "fine"]
    short = feedback.with_feedback(gaps.coalesce(1), lambda batch: ["one"]).orderBy("cv_id").collect()
    assert [r.feedback for r in short] == ["one", "one"]


def test_the_model_is_asked_once(gaps):
    answered = feedback.with_feedback(gaps, lambda batch: ["ok"] * len(batch))
    used = answered.filter("feedback = 'ok'").withColumn("again", F.upper("feedback"))
    text = used._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1
    assert used.count() == 2


def test_a_models_words_reach_the_record_and_the_route(spark, frontend_jobs):
    slices = market.market_slices(frontend_jobs)
    cvs = spark.createDataFrame(
        [
            (1, "a", "html css javascript react frontend " * 20, "a.PDF"),
            (2, "b", "html css javascript react frontend " * 20, "b.txt"),
            (3, "c", "short", "c.pdf"),
        ],
        "cv_id long, cv_name string, cv_text string, file_name string",
    )
    answer = lambda batch: ["The user is fine"] * len(batch)
    (r,) = gap.result_record(feedback.with_feedback(gap.skill_gap(gap.text_cvs(cvs.filter("cv_id = 1")), slices), answer)).collect()
    assert r.feedback == "You is fine"
    routed = {r.cv_id: r for r in gap.route(cvs, slices, answer).collect()}
    assert routed[1].result.feedback == "You is fine"
    assert [routed[i].reject_reason for i in (1, 2, 3)] == [None, rules.REASON_BAD_FILE, rules.REASON_UNREADABLE]
    assert {r.feedback for r in intake.score_stream(cvs.filter("cv_id < 3"), slices, answer).collect()} == {"You is fine"}


def test_answers(evaluate):
    good = '{"matched_skills": ["a"], "missing_skills": [], "fit_score": 50, "feedback": "x"}'
    values = [good, good[:-5], good.replace("50", "101"), "not json", "", None, good.replace("50", "0")]
    parsed = evaluate(prompts.parse_answer(F.col("v")), values, "v string")
    assert [p is not None for p in parsed] == [True, False, False, False, False, False, True]
    assert (parsed[0].matched_skills, parsed[0].missing_skills, parsed[0].feedback) == (["a"], [], "x")
