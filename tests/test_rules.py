"""Hand-traced values of the per-row rules."""

from pyspark.sql import functions as F

from demandlens.functions import classify, labels, text
from demandlens.operators.gap import is_accepted_file, strict_compare


def test_strip_removes_what_python_strips(evaluate):
    values = [" \tsql\n ", "  go　", "\x1cjava\x1f", "power bi", "", "   ", None]
    assert evaluate(text.strip("v"), values, "v string") == [v and v.strip() for v in values]


def test_split_keeps_order_and_repeats(evaluate):
    values = ["a, b ,,a, c ", "", None, ",,"]
    assert evaluate(text.split_skills("v"), values, "v string") == [["a", "b", "a", "c"], [], [], []]


def test_role_from_title(evaluate):
    titles = ["Data Analytics Backend Lead", "Analytics Engineer", "Fullstack Dev", None, "Site Reliability Lead"]
    roles = ["backend", "data analyst", "unknown", "unknown", "devops"]
    assert evaluate(classify.role_from_title("v"), titles, "v string") == roles


def test_level_from_job(evaluate):
    rows = [
        ("Senior Junior Dev", None),
        ("Dev", " Senior "),
        ("Dev", "Lead"),
        ("Midlands Dev", "junior"),
        (None, "JUNIOR"),
        (None, None),
    ]
    levels = ["senior", "senior", "mid", "mid", "junior", "mid"]
    assert evaluate(classify.level_from_job("t", "s"), rows, "t string, s string") == levels


def test_level_from_experience(evaluate):
    values = ["3.5 years", "2 Years", "1-4 years", "10+years, 2 year", "graduate", None, "99999999999 years"]
    levels = ["senior", "mid", "mid", "senior", "junior", "junior", "senior"]
    assert evaluate(classify.level_from_experience("v"), values, "v string") == levels


def test_role_from_text(evaluate):
    values = ["html css javascript sql", "java react", "cooking", None, "EXCELLENT"]
    roles = ["frontend", "backend", "unknown", "unknown", "data analyst"]
    assert evaluate(classify.role_from_text("v"), values, "v string") == roles


def test_keyword_score_counts_each_keyword_once(evaluate):
    assert evaluate(classify.keyword_score("v", ["java", "sql", "java"]), ["java java sql", None], "v string") == [2, 0]


def test_level_from_text(evaluate):
    values = ["lives in Middlesbrough", "1 year", "5+ years", "senior", "2 years", None, "years ago"]
    levels = ["mid", "junior", "senior", "senior", "mid", "junior", "junior"]
    assert evaluate(classify.level_from_text("v"), values, "v string") == levels


def test_text_gate(evaluate):
    values = ["a" * 199, "a" * 200, "a" * 100 + "1" * 100, "a" * 101 + "1" * 99, " " * 50 + "é" * 199, None, ""]
    assert evaluate(text.is_valid_text("v"), values, "v string") == [False, True, False, True, False, False, False]


def test_accepted_files(evaluate):
    assert evaluate(is_accepted_file(F.col("v")), ["a.pdf", "a.PDF", "a.txt", None], "v string") == [
        True,
        True,
        False,
        False,
    ]


def test_fit_score_rounds_half_to_even(evaluate):
    rows = [(1, 8), (3, 8), (0, 0), (2, 4), (1, 3), (20, 20)]
    assert evaluate(labels.fit_score("m", "n"), rows, "m int, n int") == [12, 38, 0, 50, 33, 100]


def test_percentages_round_as_python_does(evaluate):
    totals = [1, 7, 16, 80, 400, 2000, 2308, 4000, 6000, 16000]
    rows = [(k, n) for n in totals for k in range(0, n + 1, max(1, n // 2000))]
    rows += [(3 * n, n) for n in totals] + [(0, 0)]
    expected = [round(k / n * 100, 1) if n else 0.0 for k, n in rows]
    assert evaluate(labels.percent_1dp("k", "n"), rows, "k long, n long") == expected


def test_demand_items_and_buckets(evaluate):
    rows = [("SQL", 100.0), ("C#", 6.2), ("Go", 70.0), ("R", 69.9), ("Git", 30.0)]
    schema = "s string, p double"
    assert evaluate(labels.demand_item("s", "p"), rows, schema)[:2] == ["SQL (100.0%)", "C# (6.2%)"]
    assert evaluate(labels.demand_bucket("p"), rows, schema) == ["high", "low", "high", "medium", "medium"]


def test_alignment_labels_and_summaries(evaluate):
    scores = [70, 69, 40, 39, 20, 19]
    words = ["Strong", "Moderate", "Moderate", "Weak", "Weak", "Very Low"]
    assert evaluate(labels.alignment_label("v"), scores, "v int") == [f"{w} Alignment" for w in words]
    summaries = evaluate(labels.similarity_summary("v", F.lit("devops")), scores, "v int")
    assert summaries[0] == "Your CV is strongly aligned with the current devops market profile."
    assert summaries[3] == "Your CV has limited alignment with the current devops market profile."
    assert summaries[5].endswith("employers are expecting in the devops market.")


def test_strict_compare_collapses_case_variants(evaluate):
    rows = [(["sql", "HTML"], ["SQL", "React", "sql"]), ([], ["a"]), (["a"], [])]
    compared = evaluate(strict_compare(F.col("u"), F.col("m")), rows, "u array<string>, m array<string>")
    assert [tuple(c) for c in compared] == [(["sql"], ["React"], 33), ([], ["a"], 0), ([], [], 0)]
