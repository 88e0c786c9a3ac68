"""Tables that are folders of part files, as larger ones are."""

import pytest

from conftest import SMALL
from demandlens.plans.queries import QUERIES
from demandlens.sources import tables

NAMES = ("documents", "lineitem", "orders")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables") / "odd name%20")
    for name in NAMES:
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(3).write.parquet(f"{base}/{name}.parquet")
    return base


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", ["read_folder", "stream_scoring"])
def test_folders_give_what_files_give(spark, folders, name):
    assert rows(QUERIES[name](spark, folders)) == rows(QUERIES[name](spark, SMALL))


def test_files_and_folders_side_by_side(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "in" / "b.parquet"))
    spark.range(5, 7).write.parquet(str(tmp_path / "in" / "other"))
    (part,) = (tmp_path / "in" / "b.parquet").glob("part-*.parquet")
    (tmp_path / "in" / "a.parquet").write_bytes(part.read_bytes())
    found = tables.read_folder(spark, str(tmp_path / "in"), pattern="*.parquet")
    assert rows(found) == [(i, name) for i in range(3) for name in ("a.parquet", "b.parquet")]
