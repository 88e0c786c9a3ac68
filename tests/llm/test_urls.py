import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from demandlens.llm import urls
from demandlens.llm.queries import QUERIES, URL_RULES
from demandlens.llm.urls import ALLOW, BLOCK, Rule, calibrate, cells_of, host_and_path, judge_urls, log_probabilities

ODD = [
    None, "", "net", "http://net", "http://net/", "HTTP://WWW.Example.NET/en/x", "http://example.net/en", "http://xexample.net/en/",
    "http://a.example.net/EN/", "http://bnet/", "x://org/fr/?q", "http://é.org/fr/É", "http://É.NET/#a?b", "http://h?x://org/fr/",
    "://", ":///en/", "http://example.com/de/#", "http://example.com/de", "http://a.example.com/de/x?y#z", "http://net:80/", "http://u@net/a",
    "http://net#/", "http://example.net/en/ ://org/fr/", "http://org/fr/\nx", "http://m.net?/a",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#", 1)[0].split("?", 1)[0]
    host, slash, tail = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + tail


def rule_of(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def test_host_path_and_rule(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "page_id long, url string")
    for r in judge_urls(df, URL_RULES).collect():
        host, path = parts(ODD[r.page_id])
        rule = rule_of(host, path, URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name), ODD[r.page_id]
        assert r.verdict == (rule.verdict if rule else ALLOW if r.score >= 0.5 else BLOCK)


def symbols(url):
    def one(byte):
        c = chr(byte).lower() if byte < 128 else "\xff"
        return "0" if c.isdigit() else c if c in urls.LOWER + urls.MARKS else "other"

    return ["^"] * urls.ORDER + [one(b) for b in (url or "").encode()] + ["^"]


def brute_model(texts):
    """The same model from dictionaries: the probability of a symbol after a context of any length."""
    counts = Counter()
    for t in texts:
        s = symbols(t)
        for i in range(urls.ORDER, len(s)):
            for back in range(urls.ORDER + 1):
                counts[tuple(s[i - back : i]), s[i]] += 1
    totals, kinds = Counter(), Counter()
    for (context, _), n in counts.items():
        totals[context] += n
        kinds[context] += 1

    def p(context, symbol):
        lower = p(context[1:], symbol) if context else 1 / urls.SYMBOLS
        n, k = totals[context], kinds[context]
        return (counts[context, symbol] + k * lower) / (n + k) if n else lower

    return p


def brute_score(url, good, bad):
    s = symbols(url)
    steps = [(tuple(s[i - urls.ORDER : i]), s[i]) for i in range(urls.ORDER, len(s))]
    return sum(math.log(good(*x) / bad(*x)) for x in steps) / len(steps)


def test_models_are_those_of_dictionaries():
    texts = ["http://ab.net/en/1", "x", "", "http://ab.net/de/22?q=1", "É"]
    cells, sizes = cells_of(texts)
    assert sizes.tolist() == [len(t.encode()) + 1 for t in texts]
    table = log_probabilities(np.bincount(cells, minlength=urls.CELLS))
    assert abs(np.exp(table.reshape(-1, urls.SYMBOLS)).sum(1) - 1).max() < 1e-9
    p = brute_model(texts)
    for t in [*texts, "never seen", "http://ab.net/fr/"]:
        s = symbols(t)
        own = cells_of([t])[0]
        want = [math.log(p(tuple(s[i - urls.ORDER : i]), s[i])) for i in range(urls.ORDER, len(s))]
        assert np.allclose(table[own], want)


def test_calibration_finds_the_middle():
    x = np.arange(-100, 101) / 10
    allowed, blocked = np.exp(-((x - 3) ** 2)), 50 * np.exp(-((x + 1) ** 2))
    slope, offset = calibrate(x, allowed, blocked)
    assert slope > 1 and abs(-offset / slope - 1) < 0.05
    assert calibrate(x, blocked, allowed) == (1.0, 0.0)


def test_scores_are_those_of_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op11_url_filters"](spark, SMALL).collect()}
    assert len(got) == len(pages)
    found = [(p.page_id, p.url, rule_of(*parts(p.url), URL_RULES)) for p in pages]
    good = brute_model([u for _, u, r in found if r and r.verdict == ALLOW])
    bad = brute_model([u for _, u, r in found if r and r.verdict == BLOCK])
    raw = np.array([brute_score(u, good, bad) for _, u, _ in found])
    score = np.array([got[i].score for i, _, _ in found])
    # One rising logistic curve takes the differences to the scores.
    logit = np.log(score / (1 - score))
    slope, offset = np.polyfit(raw, logit, 1)
    assert slope > 0 and np.abs(slope * raw + offset - logit).max() < 1e-3 * np.abs(logit).max()
    for i, _, rule in found:
        assert (got[i].host, got[i].path) == parts(next(u for k, u, _ in found if k == i))
        assert got[i].rule == (rule and rule.name) and got[i].verdict == (rule.verdict if rule else ALLOW if got[i].score >= 0.5 else BLOCK)


def test_models_tell_unseen_hosts_apart(spark):
    rng = random.Random(0)
    words = {True: ["garden", "school", "library", "museum", "science"], False: ["casino", "bets", "poker", "jackpot", "win"]}
    rows = []
    for i in range(3000):
        kind = i % 5 < 2
        host = "-".join(rng.sample(words[kind], 2)) + str(i % 37)
        rows.append((i, f"https://{host}.{'test' if i % 2 else ('ok' if kind else 'bad')}/p{i}", kind))
    df = spark.createDataFrame(rows, "page_id long, url string, score boolean")
    judged = judge_urls(df, [Rule(ALLOW, "ok", "/"), Rule(BLOCK, "bad", "/")]).collect()
    unruled = [r for r in judged if r.rule is None]
    right = sum((r.verdict == ALLOW) == rows[r.page_id][2] for r in unruled)
    assert len(unruled) == 1500 and right >= 0.97 * len(unruled)


def test_nothing_to_learn_from(spark):
    rows = [(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://b.org/"), (2, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(3)).withColumn("_first", F.lit(1))
    told = lambda rules: sorted((r.page_id or 0, r.rule, r.verdict) for r in judge_urls(df, rules).collect())
    assert told([]) == [(0, None, ALLOW), (1, None, ALLOW), (1, None, ALLOW), (2, None, ALLOW)]
    assert told([Rule(BLOCK, "net", "/")]) == [(0, None, BLOCK), (1, "net/", BLOCK), (1, "net/", BLOCK), (2, None, BLOCK)]
    assert judge_urls(df.limit(0), URL_RULES).collect() == []


@pytest.mark.parametrize("url", ["http://x.net/" + "a" * 200_000])
def test_long_urls(spark, url):
    df = spark.createDataFrame([(1, url), (2, "http://a.org/fr/"), (3, "http://b.com/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge_urls(df, URL_RULES).collect()}[1] == BLOCK


def test_host_and_path_are_columns(spark):
    df = spark.createDataFrame([(u,) for u in ODD], "url string")
    host, path = host_and_path(F.col("url"))
    assert [tuple(r) for r in df.select(host, path).collect()] == [parts(u) for u in ODD]
