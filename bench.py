"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the cores.  Every query runs twice on the same tables to warm
the JVM up, all queries one after the other, then its best of two runs is taken; every result row is computed and
discarded.  Queries of CVs build their market each time; ``score_published_market`` scores texts against a market
written beforehand, so the two costs can be told apart.
"""

import json
import os
import re
import sys
import time
import uuid

from demandlens.operators import gap
from demandlens.plans import fixtures
from demandlens.plans.queries import QUERIES
from demandlens.session import local_session, shared_dir
from demandlens.streaming import intake

HEADLINE = [
    "market_top_skills",
    "jobs_per_role_level",
    "hiring_companies",
    "skill_vocabulary",
    "job_role_level",
    "cv_role_from_text",
    "cv_level_from_text",
    "text_validity",
    "cv_skills",
    "skill_gap",
    "skill_gap_table_cv",
    "skill_gap_report",
    "gap_by_role",
    "pair_compare",
    "feedback_prompt",
    "union_by_name",
    "read_postings",
    "model_report",
    "stream_scoring",
]
# Too long to repeat: once warmed up on smaller tables, timed once.
ONCE = ["cv_skills_large_vocabulary"]
WARM_UP = "/root/testdata/sf0.001"


def published(spark, sf_dir):
    """A query that scores the texts against a market published before it is timed."""
    path = f"{shared_dir(spark)}/bench-market-{uuid.uuid4().hex}"
    intake.publish_market(fixtures.jobs(spark, sf_dir), path, version=1)

    def score_published_market(spark, sf_dir):
        return gap.result_record(gap.skill_gap(gap.text_cvs(fixtures.cv_texts(spark, sf_dir)), intake.load_market(spark, path)))

    return score_published_market


def timed(query, spark, sf_dir):
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS") or os.cpu_count()
    spark = local_session(cores, shuffle_partitions=cores, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: QUERIES[name] for name in HEADLINE} | {"score_published_market": published(spark, sf_dir)}
    for _ in range(2):
        for query in queries.values():
            timed(query, spark, sf_dir)
    times = {name: round(min(timed(query, spark, sf_dir) for _ in range(2)), 3) for name, query in queries.items()}
    for name in ONCE:
        timed(QUERIES[name], spark, WARM_UP)
        times[name] = round(timed(QUERIES[name], spark, sf_dir), 3)
    for name, seconds in times.items():
        print(f"{name}: {seconds} s", file=sys.stderr)
    spark.stop()
    sf = re.search(r"sf([\d.]+)", sf_dir)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline query seconds, total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
