"""One query for each operator, on the whole table, and the SQL that some are checked with."""

import public_tokenizers
from pyspark.sql import functions as F

from demandlens.llm.bpe import encode_digests
from demandlens.llm.common import read_table
from demandlens.llm.exact import exact_dedup
from demandlens.llm.lines import line_dedup
from demandlens.llm.lm import score
from demandlens.llm.ngrams import near_sets
from demandlens.llm.packing import pack
from demandlens.llm.quality import classify_quality
from demandlens.llm.runs import collapse_runs, longest_run, runs_text, with_planted_runs
from demandlens.llm.sharding import shard
from demandlens.llm.urls import ALLOW, BLOCK, Rule, judge_urls
from demandlens.llm.vectors import near_duplicates
from demandlens.llm.warc import archive_round_trip
from demandlens.llm.whitening import whiten

QUERIES, STATEMENTS = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_exact_dedup(spark, sf_dir):
    """Which document stays of each group of equal texts."""
    return exact_dedup(read_table(spark, sf_dir, "documents"))


STATEMENTS["op2_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


@query
def op5_jump_sharding(spark, sf_dir):
    """Shard and place of every document among 40 shards, and its shard among 41."""
    return shard(read_table(spark, sf_dir, "documents"), 40)


@query
def op7_line_dedup(spark, sf_dir):
    """Documents without the lines that ten documents share."""
    return line_dedup(read_table(spark, sf_dir, "documents"), min_docs=10).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


STATEMENTS["op7_line_dedup"] = r"""
WITH listed AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM listed),
frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY doc_id
"""


@query
def op9_warc(spark, sf_dir):
    """What the archives of all pages say about each page."""
    pages = read_table(spark, sf_dir, "pages")
    return archive_round_trip(pages, min_bytes=100).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


STATEMENTS["op9_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""


@query
def op8_byte_bpe(spark, sf_dir):
    """Ids of every whole text, and what they decode to, as digests."""
    docs = read_table(spark, sf_dir, "documents")
    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, spaced=True)


@query
def op4_packing(spark, sf_dir):
    """Where every piece of every document goes in sequences of 1024 tokens."""
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end=2)


@query
def op3_quality(spark, sf_dir):
    """Quality of every document, learned from labels outside the held-out fold."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return classify_quality(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query
def op1_embedding_near_dedup(spark, sf_dir):
    """Links and component of every vector at a cosine of 0.9."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


STATEMENTS["op1_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
          ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT x AS vec_id, (SELECT count(*) FROM links l WHERE l.x = r.x) AS n_links, min(y) AS component_id, x = min(y) AS kept
FROM reach r GROUP BY x
"""


@query
def op6_ngram_jaccard(spark, sf_dir):
    """Component and links of every document among sets of four-word shingles at a Jaccard similarity of 0.85."""
    return near_sets(read_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


STATEMENTS["op6_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT x AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id,
       (SELECT count(*) FROM links l WHERE l.x = r.x) AS n_links
FROM reach r LEFT JOIN n ON doc_id = r.x GROUP BY r.x
"""


@query
def op10_lm_scoring(spark, sf_dir):
    """Unigram and network scores of every document."""
    return score(read_table(spark, sf_dir, "documents"), folds=7, held=2)


#: The rules that the query judges by.
URL_RULES = [
    Rule(BLOCK, "net", "/"),
    Rule(ALLOW, "example.net", "/en/"),
    Rule(BLOCK, "example.com", "/de/"),
    Rule(ALLOW, "org", "/fr/"),
]


@query
def op11_url_filters(spark, sf_dir):
    """Verdict on the URL of every page."""
    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


@query
def op12_periodic_runs(spark, sf_dir):
    """Periodic runs of every text, every tenth of which repeats a stretch of itself, and the text without the repetition."""
    found = collapse_runs(with_planted_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    run = longest_run(F.col("runs"))
    return found.withColumn("_run", run).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "_run.start",
        "_run.length",
        "_run.period",
        F.floor(1000 * F.col("_run.length") / F.col("_run.period")).alias("exponent_milli"),
        F.sha2(runs_text(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_whitening(spark, sf_dir):
    """Every vector projected on the leading 32 components and scaled to unit variance."""
    return whiten(read_table(spark, sf_dir, "embeddings"), components=32)
