"""Rules against short statements of them in Python, over generated inputs."""

import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from demandlens import rules
from demandlens.functions import classify, prompts, text
from demandlens.operators import market
from demandlens.operators.gap import strict_compare
from pyspark.sql import functions as F

FEW = settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow, HealthCheck.data_too_large],
)
WORDS = [w for group in (*rules.TITLE_RULES.values(), *rules.KEYWORD_RULES.values()) for w in group]
WORDS += ["Senior", "junior", "MID", "3 years", "5+years", "1 year", "12 Years", "lead", "Été", "\n"]
prose = st.lists(st.sampled_from(WORDS), max_size=8).map(" ".join) | st.text(max_size=40)
texts = st.lists(prose | st.none(), min_size=20, max_size=60)
names = st.lists(st.sampled_from(["SQL", "sql", "Sql", "Java", "java", "R", "C#", "go", "Go"]), max_size=8)


def years(t):
    return max((int(n) for n in re.findall(r"([0-9]+)\+?\s*years?", t.lower())), default=0)


@FEW
@given(texts)
def test_title_roles(evaluate, values):
    def role(t):
        return next((r for r, ws in rules.TITLE_RULES.items() if any(w in (t or "").lower() for w in ws)), "unknown")

    assert evaluate(classify.role_from_title("v"), values, "v string") == [role(v) for v in values]


@FEW
@given(texts)
def test_text_roles(evaluate, values):
    def role(t):
        ranked = Counter({r: sum(w in (t or "").lower() for w in ws) for r, ws in rules.KEYWORD_RULES.items()})
        (best, score), *_ = ranked.most_common()
        return best if score else "unknown"

    assert evaluate(classify.role_from_text("v"), values, "v string") == [role(v) for v in values]


@FEW
@given(texts)
def test_text_levels(evaluate, values):
    def level(t):
        t = (t or "").lower()
        signals = [2 * ("senior" in t), 1 * ("mid" in t), (years(t) >= 2) + (years(t) >= 5)]
        return rules.LEVELS[max(signals)]

    assert evaluate(classify.level_from_text("v"), values, "v string") == [level(v) for v in values]


@FEW
@given(texts)
def test_experience_levels(evaluate, values):
    expected = [rules.LEVELS[(years(v or "") >= 2) + (years(v or "") >= 5)] for v in values]
    assert evaluate(classify.level_from_experience("v"), values, "v string") == expected


@FEW
@given(st.lists(st.text(max_size=30) | st.none(), min_size=20, max_size=60))
def test_strip_and_split(evaluate, values):
    split = [[p.strip() for p in (v or "").split(",") if p.strip()] for v in values]
    assert evaluate(text.split_skills("v"), values, "v string") == split


@FEW
@given(st.lists(st.tuples(names, names), min_size=20, max_size=40))
def test_strict_compare(evaluate, pairs):
    expected = []
    for user, listed in pairs:
        have = {u.lower() for u in user}
        order = sorted({s.lower() for s in listed}, key=[s.lower() for s in listed].index)
        spelling = {s.lower(): s for s in listed}
        matched = [spelling[n] for n in order if n in have]
        missing = [spelling[n] for n in order if n not in have]
        expected.append((matched, missing, round(len(matched) / len(listed) * 100) if listed else 0))
    compared = evaluate(strict_compare(F.col("u"), F.col("m")), pairs, "u array<string>, m array<string>")
    assert [tuple(c) for c in compared] == expected


@FEW
@given(st.lists(names, min_size=1, max_size=30))
def test_top_skills_break_ties_by_first_seen(make_jobs, lists):
    jobs = make_jobs(*[("Backend", None, ", ".join(skills), None, None) for skills in lists])
    top = market.market(jobs.repartition(5), k=4).filter("level = 'mid'").orderBy("rank").collect()
    counted = Counter(s for skills in lists for s in skills).most_common(4)
    assert [(r.skill, r.demand_count) for r in top] == counted
    assert all(r.total_jobs == len(lists) for r in top)


@FEW
@given(st.lists(st.lists(st.sampled_from(["The candidate", "candidate", "The user", "users", "Applicant", "x"])).map(" ".join)))
def test_feedback_wording(evaluate, values):
    def cleaned(t):
        for old, new in rules.FEEDBACK_REPLACEMENTS:
            t = new.join(t.split(old))
        return t

    assert evaluate(prompts.clean_feedback("v"), values, "v string") == [cleaned(v) for v in values]
