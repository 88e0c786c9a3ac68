"""Extraction by the distinct words of the texts, and of a few terms one by one."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from conftest import SMALL
from demandlens.operators import skills, vocabulary
from demandlens.plans import fixtures
from demandlens.session import shared_dir
from pyspark.sql import functions as F

LONG = "x" * 30 + "middle" + "y" * 40
TEXTS = [
    (1, f"Alpha beta\nGAMMA {LONG} tail"), (1, "beta"), (None, "a b\tc"), (2, None), (3, ""), (3, f"z{LONG[:-1]} gamma"),
    (4, "deep learning of alphabets"), (4, "deep learning of alphabets"), (5, "\n  \n"), (6, "naïve ÉTÉ"),
]
TERMS = ["alpha", "ALPHA", "Alphabet", "beta", "ta\ngam", "a", "b\tc", "amm", LONG, LONG.upper(), "deep learning", "g of al", "été", "none", "", None]


def expected(text):
    low = (text or "").lower()
    return sorted({t for t in TERMS if t and t.lower() in low}, key=lambda t: (t.lower().encode(), t))


@pytest.mark.parametrize("few", [0, 64])
def test_words_blanks_and_short_terms(spark, monkeypatch, few):
    monkeypatch.setattr(skills, "FEW", few)
    cvs = spark.createDataFrame(TEXTS, "cv_id long, cv_text string")
    for terms in (TERMS, ["beta"], ["deep learning"], ["a"]):
        vocab = spark.createDataFrame([(t,) for t in terms], "skill string")
        got = sorted(map(tuple, skills.extract_skills(cvs, vocab).collect()), key=repr)
        assert got == sorted(((i, t, [s for s in expected(t) if s in terms]) for i, t in TEXTS), key=repr)


def test_grams_are_formed_of_distinct_words_alone(spark, monkeypatch):
    monkeypatch.setattr(skills, "FEW", 0)
    indexed, real = [], skills.anchors
    monkeypatch.setattr(skills, "anchors", lambda cvs, *rest: indexed.append(cvs.count()) or real(cvs, *rest))
    cvs = spark.range(500).select(F.col("id").alias("cv_id"), F.lit("some words that all texts have").alias("cv_text"))
    vocab = spark.createDataFrame([("words",), ("texts",), ("absent",)], "skill string")
    assert {tuple(r.skills) for r in skills.extract_skills(cvs, vocab).collect()} == {("texts", "words")}
    # Words shorter than the shortest term are left out.
    assert indexed == [2]


def test_a_table_of_many_files_is_not_moved(spark, tmp_path):
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    plans = [fixtures.spread(many, n)._jdf.queryExecution().executedPlan().toString() for n in (8, 9)]
    assert ["Exchange" in p for p in plans] == [False, True]


@pytest.mark.parametrize("small", [False, True])
def test_a_large_vocabulary_is_read_where_the_texts_are(spark, monkeypatch, small):
    monkeypatch.setattr(skills, "FEW", 0)
    monkeypatch.setattr(skills, "LARGE", 1)
    terms = [t for t in TERMS if t is None or not {" ", "\n"} & set(t)] + ["É", "ïv", "x" * 30, "\t"]
    texts = [*TEXTS, (7, LONG * 3), (8, "ÉTÉÉTÉ ïïvİx"), (9, "x" * 70 + "\n\n" + LONG[3:])]
    if small:
        # In this process, as tasks load the module with its own values.
        for name in ("TEXT_BYTES", "PIECE_BYTES", "PAIRS", "TERMS"):
            monkeypatch.setattr(vocabulary, name, 5)
        names = skills.names_of(spark.createDataFrame([(t,) for t in terms], "skill string"))
        rows = [(r["_name"], r["skills"]) for r in names.collect()]
        pq.write_table(pa.table({"_name": pa.array([bytes(n) for n, _ in rows]), "skills": [s for _, s in rows]}), path := f"{shared_dir(spark)}/some-names".removeprefix("file:"))
        low = pa.array([None if t is None else t.lower().encode() for _, t in texts if "İ" not in (t or "")], pa.binary())
        got = [s for n, part in vocabulary._found(low, [path]) for s in part.to_pylist()]
        kept = [t for _, t in texts if "İ" not in (t or "")]
    else:
        cvs = spark.createDataFrame([(i, t, "old", [i]) for i, t in texts], "cv_id long, cv_text string, skills string, own array<long>").repartition(3)
        found = skills.extract_skills(cvs, spark.createDataFrame([(t,) for t in terms], "skill string"))
        assert found.columns == ["cv_id", "cv_text", "own", "skills"] and all(r.own == [r.cv_id] for r in found.collect())
        kept, got = zip(*[(r.cv_text, r.skills) for r in found.collect()])
        # Nothing is dealt out by words, texts or terms.
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
    for text, have in zip(kept, got, strict=True):
        low = (text or "").lower()
        assert have == sorted({t for t in terms if t and t.lower() in low}, key=lambda t: (t.lower().encode(), t)), text


def test_a_large_vocabulary_of_pieces_of_texts(spark, monkeypatch):
    monkeypatch.setattr(skills, "LARGE", 1)
    cvs = fixtures.cv_texts(spark, SMALL)
    words = {w for r in cvs.collect() for w in r.cv_text.replace("\n", " ").split(" ")}
    terms = sorted({w[i : i + n].swapcase() for k, w in enumerate(sorted(words)) for i, n in ((k % 5, 1 + k % 17),)} - {""})
    found = skills.extract_skills(cvs, spark.createDataFrame([(t,) for t in terms], "skill string"))
    monkeypatch.setattr(skills, "LARGE", 1 << 40)
    indexed = skills.extract_skills(cvs, spark.createDataFrame([(t,) for t in terms], "skill string"))
    assert found.schema.simpleString() == indexed.schema.simpleString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, indexed.collect()))


def test_a_vocabulary_with_blanks_is_indexed(spark, monkeypatch):
    monkeypatch.setattr(skills, "FEW", 0)
    monkeypatch.setattr(skills, "LARGE", 1)
    monkeypatch.setattr(skills, "vocabulary_in_words", None)
    cvs = spark.createDataFrame([(1, "deep learning")], "cv_id long, cv_text string")
    vocab = spark.createDataFrame([("p lea",), ("deep",)], "skill string")
    assert [r.skills for r in skills.extract_skills(cvs, vocab).collect()] == [["deep", "p lea"]]


def test_texts_are_held_a_few_bytes_at_a_time():
    texts = ["a" * n for n in (300, 10, 10, 900, 0, 50)] + [None] * 40
    batch = pa.RecordBatch.from_pydict({"n": list(range(46)), "_low": pa.array([t and t.encode() for t in texts], pa.binary())})
    runs = [[n for part in held for n in part["n"].to_pylist()] for held in vocabulary._runs(iter([batch, batch.slice(0, 0), batch]), 1, 500)]
    assert sum(runs, []) == [*range(46)] * 2
    assert all(sum(len(texts[n] or "") + 64 for n in run) <= 500 or len(run) == 1 for run in runs)
