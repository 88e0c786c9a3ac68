from collections import defaultdict

from demandlens.llm.lines import LineRuns, line_dedup

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UP)
    found = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if key(line):
                found[key(line)].add(i)
    gone = {k for k, ids in found.items() if len(ids) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_documents(odd_docs, no_docs):
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for least in (1, 2, 100):
        assert rows(line_dedup(odd_docs, least)) == expected(texts, least)
    assert rows(line_dedup(no_docs, 1)) == []


def test_runs_are_compacted_and_settled(spark, tmp_path):
    """Small batches and levels of two runs: counts add up over runs of any level, settled or not."""
    texts = [(i, f"Common\nhalf {i % 2}\nrare {i % 20}\n own {i}\n\nCOMMON ") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(12)
    assert rows(line_dedup(docs, 4, batch_bytes=1, fanout=2)) == expected(texts, 4)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_repeated_and_null_ids_count_once_over_all_batches(spark):
    """Rows that share an id, or have none, lie in many batches: their lines are still of one document."""
    texts = [(1, f"of one\nown {i}") for i in range(30)] + [(None, f"of none\nsome {i}") for i in range(30)]
    texts += [(i, f"of four\nthing {i}") for i in range(2, 6)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(12)
    for coalesced in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        try:
            assert rows(line_dedup(docs, 4, batch_bytes=1, fanout=2)) == expected(texts, 4)
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs_stay_in_a_folder(spark, tmp_path):
    """Two calls know what one call of all documents knows, and a batch that comes again changes nothing."""
    texts = [(i, f"Common\nhalf {i % 2}\nrare {i % 20}\n own {i}") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    folder, want = str(tmp_path / "runs"), expected(texts, 4)
    assert rows(line_dedup(docs.filter("doc_id < 3"), 4, folder=folder)) == expected(texts[:3], 4)
    later = rows(line_dedup(docs.filter("doc_id >= 3"), 4, batch_bytes=1, fanout=2, folder=folder))
    assert later == [w for w in want if w[0] >= 3]
    assert rows(line_dedup(docs, 4, folder=folder)) == want
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    again = LineRuns(spark, 4, folder=folder)
    kept = sum(spark.table(name).count() for level in again.levels for name in level)
    again.add(spark.createDataFrame([], "hash binary, who string"))
    assert kept == sum(spark.table(name).count() for level in again.levels for name in level)
    again.close()
