from conftest import SMALL
from demandlens.operators import skills
from demandlens.plans import fixtures


def brute_force(rows, terms):
    out = {}
    for cv_id, text in rows:
        low = (text or "").lower()
        out[cv_id] = sorted((t for t in terms if t.lower() in low), key=lambda t: (t.lower(), t))
    return out


def found(df):
    return {r.cv_id: r.skills for r in df.select("cv_id", "skills").collect()}


def test_vocabulary_is_distinct_and_sorted(make_jobs):
    jobs = make_jobs(
        ("a", None, "sql, Java, SQL", "Git,,", None), ("b", None, None, "Java", None), ("c", None, "C#", None, None)
    )
    assert [r.skill for r in skills.vocabulary(jobs).collect()] == ["C#", "Git", "Java", "SQL", "sql"]


def test_substrings_match_anywhere(spark):
    cvs = spark.createDataFrame([(1, "Finance, JavaScript"), (2, None), (3, "")], "cv_id long, cv_text string")
    terms = ["Java", "SQL", "R", "JavaScript", "c", None, "", "c"]
    vocab = spark.createDataFrame([(t,) for t in terms], "skill string")
    assert found(skills.extract_skills(cvs, vocab)) == {1: ["c", "Java", "JavaScript", "R"], 2: [], 3: []}
    assert found(skills.extract_skills(cvs, vocab.limit(0))) == {1: [], 2: [], 3: []}


def test_rows_that_share_an_id_are_searched_by_themselves(spark):
    cvs = spark.createDataFrame([(1, "java"), (1, "sql"), (None, "sql")], "cv_id long, cv_text string")
    vocab = spark.createDataFrame([("SQL",), ("Java",)], "skill string")
    rows = skills.extract_skills(cvs, vocab).collect()
    assert sorted((r.cv_text, r.skills) for r in rows) == [("java", ["Java"]), ("sql", ["SQL"]), ("sql", ["SQL"])]


def test_terms_across_the_edges_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(skills, "CHUNK", 5)
    text = "abcdefghijklmnopqrstuvwxyz0123456789"
    terms = sorted({text[i : i + n] for i in range(len(text)) for n in (1, 2, 3, 5, 8, 13) if i + n <= len(text)} | {"zz", "ba"})
    cvs = spark.createDataFrame([(1, text)], "cv_id long, cv_text string")
    vocab = spark.createDataFrame([(t,) for t in terms], "skill string")
    assert found(skills.extract_skills(cvs, vocab)) == brute_force([(1, text)], terms)


def test_extraction_finds_what_brute_force_finds(spark):
    cvs = fixtures.cv_texts(spark, SMALL)
    rows = [(r.cv_id, r.cv_text) for r in cvs.collect()]
    # Pieces of the texts of every length from 1 to 70, with case changed, and terms that are absent.
    joined = "".join(text for _, text in rows)
    terms = {joined[i * 997 : i * 997 + 1 + i % 70] for i in range(280)} | {f"absent {i}" for i in range(30)}
    terms = {t.swapcase() for t in terms if t.strip()} | set(fixtures.SKILLS)
    vocab = spark.createDataFrame([(t,) for t in sorted(terms)], "skill string")
    assert found(skills.extract_skills(cvs, vocab)) == brute_force(rows, terms)


def test_a_large_vocabulary(spark):
    cvs = fixtures.cv_texts(spark, SMALL)
    rows = [(r.cv_id, r.cv_text) for r in cvs.collect()]
    words = sorted({w for _, text in rows for w in text.split()})[:3000]
    vocab = spark.createDataFrame([(w,) for w in words], "skill string")
    assert found(skills.extract_skills(cvs, vocab)) == brute_force(rows, words)
