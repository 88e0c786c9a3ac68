from pyspark.sql import functions as F

from conftest import SMALL
from demandlens.plans import fixtures


def test_posting_lists_are_those_of_listagg(spark, tmp_path):
    """With numbers that are missing and lines that tie, too; lines are gathered once for both lists."""
    lines = fixtures.table(spark, SMALL, "lineitem")
    key = F.col("l_partkey")
    number = F.when(key % 5 != 0, F.col("l_linenumber") % 3)
    lines = lines.filter("l_orderkey % 11 != 0").withColumn("l_linenumber", number)
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    fixtures.table(spark, SMALL, "orders").write.parquet(f"{tmp_path}/orders.parquet")
    named = spark.read.parquet(f"{tmp_path}/lineitem.parquet").withColumns(
        {"r": fixtures._nth(fixtures.SKILLS, key % 40), "p": fixtures._nth(fixtures.SKILLS, (F.col("l_suppkey") * 3) % 40)}
    )
    listed = named.groupBy("l_orderkey").agg(
        F.expr("listagg(r, ', ') WITHIN GROUP (ORDER BY l_linenumber, l_partkey, l_suppkey)").alias("r"),
        F.expr("listagg(p, ',') WITHIN GROUP (ORDER BY l_linenumber, l_suppkey, l_partkey)").alias("p"),
    )
    want = {r.l_orderkey: (r.r, r.p) for r in listed.collect()}
    jobs = fixtures.jobs(spark, str(tmp_path))
    got = {r.job_ord: (r.required_skills, r.preferred_skills) for r in jobs.collect()}
    assert got == {k: want.get(k, (None, None)) for k in got} and any(r is None for r, _ in got.values())
    assert "listagg" not in jobs._jdf.queryExecution().optimizedPlan().toString()
