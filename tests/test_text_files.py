"""Texts written one to a file."""

import os

import pytest
from demandlens.plans import fixtures
from demandlens.sources import texts
from pyspark.sql import functions as F


def test_every_task_writes_its_texts(spark, tmp_path):
    values = [(t,) for t in ("one", "two\r\nlines", "naïve", "", "one")]
    folders = fixtures.write_text_files(spark.createDataFrame(values, "text string").repartition(3), str(tmp_path / "files"))
    assert 1 < len(folders) <= 3 and sum(len(os.listdir(f)) for f in folders) == 5
    read = texts.read_cv_texts(spark, folders)
    assert sorted(r.cv_text for r in read.collect()) == sorted(f"{t.replace(chr(13), '')}\n" for (t,) in values)
    assert read.select(F.count_distinct("cv_id")).first()[0] == 5


def told(df):
    return sorted(map(tuple, df.collect()))


def by_spark(spark, path, pattern="*.txt"):
    return told(texts._as_cvs(spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)))


NAMES = [
    "plain.txt", "a b.txt", "50%.txt", "100%41.txt", "naïve é.txt", "[x]{y}^`|.txt", "q?#&=+$,;@!~'().txt", "nb\xa0sp\u2003x.txt",
    "\u0085ctl.txt", "tab\t.txt", "line\n.txt", "back\\slash.txt", "日本😀.txt", "_x=1.txt", "_hidden.txt", ".hidden.txt", "x._COPYING_", "_metadata.txt",
    'quo"te<>.txt', "other.md", "x.TXT",
]


@pytest.mark.parametrize("pattern", ["*.txt", "*.[tT][xX][tT]", "{a,n}*", "?????.*"])
def test_tasks_list_and_read_what_spark_does(spark, tmp_path, pattern):
    folders = [tmp_path / "in one", tmp_path / "b%20é"]
    for i, folder in enumerate(folders):
        folder.mkdir()
        for n, name in enumerate(NAMES):
            (folder / name).write_bytes(f"{name} {i}\r\ncaf".encode("utf-8") + b"\xe9 \xf0\x9f ok\r")
            os.utime(folder / name, ns=(1_700_000_000_123_456_789 + n, 1_700_000_000_123_456_789 + n * 10**9))
        (folder / "empty.txt").write_text("")
    paths = [str(folders[0]), f"file://{folders[1]}/"]
    found = texts.read_cv_texts(spark, paths, pattern)
    # The driver has no list of files.
    assert not found.inputFiles() and "FileScan" not in found._jdf.queryExecution().toString()
    assert told(found) == by_spark(spark, paths, pattern)
    assert found.dtypes == texts._as_cvs(spark.read.text(paths, wholetext=True)).dtypes


def test_odd_folders_are_left_to_spark(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    for name in ("a.txt", "sub/b.txt"):
        (folder / name).write_text(name)
    for path in (str(folder), str(tmp_path / "*"), str(folder / "a.txt")):
        assert told(texts.read_cv_texts(spark, path)) == by_spark(spark, path)
    spark.range(3).selectExpr("string(id)").write.option("compression", "gzip").text(str(tmp_path / "packed"))
    path = str(tmp_path / "packed")
    assert told(texts.read_cv_texts(spark, path, "*.gz")) == by_spark(spark, path, "*.gz")


def test_files_are_read_by_enough_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(texts, "FILES", 5)
    monkeypatch.setattr(texts, "BATCH_ROWS", 7)
    for n in range(100):
        (tmp_path / f"{n}.txt").write_text(f"{n}")
    found = texts.read_cv_texts(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 20
    assert told(found) == by_spark(spark, str(tmp_path))
