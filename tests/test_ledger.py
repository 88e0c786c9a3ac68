import pytest

from demandlens.operators import market
from demandlens.sources import ledger, tables


def add(spark, path, name, rows):
    """One file, named ``name``, of postings (title, skills)."""
    spark.createDataFrame(rows, "job_title string, required_skills string").coalesce(1).write.parquet(f"{path}/{name}")


def titles(df):
    return {r.job_ord: r.job_title for r in df.collect()}


def read(spark, path, book):
    return tables.read_postings(spark, f"{path}/*", ledger=book)


def test_numbers_last_when_files_are_added_in_front(spark, tmp_path):
    src, book = str(tmp_path / "src"), str(tmp_path / "book")
    add(spark, src, "m", [("m0", "b, a"), ("m1", "a"), ("m2", "b")])
    first = titles(read(spark, src, book))
    assert first == {0: "m0", 1: "m1", 2: "m2"} == titles(read(spark, src, book))
    add(spark, src, "a", [("a0", "a"), ("a1", "b")])
    add(spark, src, "z", [("z0", "a")])
    second = titles(read(spark, src, book))
    assert {i: second[i] for i in first} == first and second == first | {3: "a0", 4: "a1", 5: "z0"}
    add(spark, src, "b", [])
    add(spark, src, "c", [("c0", None)])
    assert titles(read(spark, src, book)) == second | {6: "c0"}
    # Without the ledger the added files push the others back, and first sights, which settle ties, change.
    by_ledger = market.market(read(spark, src, book).filter("job_ord < 5")).filter("level IS NULL")
    assert [r.skill for r in by_ledger.orderBy("rank").collect()] == ["b", "a"]
    again = tables.read_postings(spark, f"{src}/*")
    assert titles(again)[0] == "a0" and again.count() == 7


def test_a_file_that_has_changed_raises(spark, tmp_path):
    src, book = str(tmp_path / "src"), str(tmp_path / "book")
    spark.createDataFrame([("f", 2)], ledger.LEDGER.replace("_start long, ", "")).selectExpr("_path", "0L AS _start", "_size").write.parquet(book)
    sizes = spark.createDataFrame([(0, "f", 3)], "_folder int, _path string, _size long")
    with pytest.raises(ValueError, match="f has changed"):
        ledger.enter_files(sizes, book)
    with pytest.raises(ValueError, match="row_key"):
        tables.read_postings(spark, src, row_key="k", ledger=book)


def test_running_starts(spark, monkeypatch, tmp_path):
    rows = [(f"p{i:03d}", i % 7) for i in range(200)]
    starts, at = {}, 0
    for path, size in rows:
        starts[path], at = at, at + size
    df = spark.createDataFrame(rows[::-1], "_path string, _size long").repartition(5)
    got = {r._path: r._start for r in ledger.running_starts(df, ["_path"], "_size", "_start").collect()}
    assert got == starts
    # The way for more files than are broadcast.
    monkeypatch.setattr(tables, "BROADCAST_FILES", 0)
    for name in "cab":
        add(spark, str(tmp_path / "src"), name, [(f"{name}{i}", "x") for i in range(3)])
    read = tables.read_postings(spark, [str(tmp_path / "src" / n) for n in "cab"])
    assert titles(read) == dict(enumerate(["c0", "c1", "c2", "a0", "a1", "a2", "b0", "b1", "b2"]))
