"""The best postings of each CV: a top-k join of skill sets that never forms all pairs of a role.

Equal sets are handled once: postings of a role that list the same skills are one profile, CVs of a role with the same
skills one person.  A profile's skills are ordered from the rarest, and it is listed under each of them with the most skills it
can still share if that is the first one it shares, ``rest``; so ``rest / n`` bounds the fit of what is found there.  Lists
are stored in blocks of one bound each.  A first look at the shortest profiles of each list gives a person a fit
that k postings reach; after it only blocks whose bound reaches that fit are opened.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandlens.functions.classify import add_posting_class
from demandlens.functions.labels import fit_score
from demandlens.functions.text import split_skills
from demandlens.session import cut_lineage

# Profiles of a block, about; and profiles of each list that are looked at first, for each posting wanted.
BLOCK, FIRST = 256, 4


def profiles(jobs: DataFrame, k: int, title_rules=None) -> DataFrame:
    """The distinct skill sets that postings of a role ask for: ``role, wants, n, ords``.

    ``wants`` are the lowercase names from the rarest of the role, ``n`` is how many entries the list has, and ``ords`` are the
    first ``k`` postings with that list.
    """
    # A column of its own and no filter on it, so that each list is split once; lists without a name meet no name below.
    listed = add_posting_class(jobs, title_rules).select("role", "job_ord", split_skills("required_skills").alias("_listed"))
    names = F.array_sort(F.array_distinct(F.transform("_listed", F.lower)))
    postings = listed.select("role", "job_ord", names.alias("_names"), F.size("_listed").alias("n"))
    # Sorted by a hash first: one number tells nearly all lists apart, where lists are slow to compare and begin alike.
    same = Window.partitionBy(F.xxhash64("role", "_names", "n"), "role", "_names", "n").orderBy("job_ord")
    first = postings.withColumn("_nth", F.row_number().over(same)).filter(F.col("_nth") <= k)
    sets = first.groupBy("role", "_names", "n").agg(F.sort_array(F.collect_list("job_ord")).alias("ords"))
    entries = sets.select("*", F.explode_outer("_names").alias("name"))
    seen = sets.select("role", F.explode_outer("_names").alias("name")).groupBy("role", "name").agg(F.count(F.lit(1)).alias("_seen"))
    by_rarity = F.sort_array(F.collect_list(F.struct("_seen", "name")))
    ordered = entries.join(seen, ["role", "name"]).groupBy("role", "_names", "n").agg(by_rarity.alias("_by"), F.any_value("ords").alias("ords"))
    return ordered.select("role", F.transform("_by", lambda s: s["name"]).alias("wants"), "n", "ords")


def index(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles under each of their skills, and the blocks of these lists.

    Entries have ``role, name, rest, n, block, wants, ords``; blocks ``role, name, rest, n, blocks``.
    """
    at = F.posexplode("wants").alias("_i", "name")
    entries = sets.select("role", "wants", "n", "ords", at).withColumn("rest", F.size("wants") - F.col("_i"))
    key = ["role", "name", "rest", "n"]
    blocks = entries.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = entries.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("wants"), F.col("blocks")).cast("int"))
    return dealt.select(*key, "block", "wants", "ords"), blocks


def _fit(matched):
    # Of two whole numbers, so equal fractions are equal and larger ones are not smaller.
    return matched / F.col("n")


def _floors(people: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """A fit that at least ``k`` postings reach, for each person: ``role, has, floor``; without so many postings, 0."""
    short = Window.partitionBy("role", "name").orderBy("n", "wants")
    listed = sets.select("role", "wants", "n", F.size("ords").alias("_many"), F.explode("wants").alias("name"))
    first = listed.withColumn("_nth", F.row_number().over(short)).filter(F.col("_nth") <= FIRST * k)
    pairs = people.select("role", "has", F.explode("has").alias("name")).join(first, ["role", "name"])
    pairs = pairs.groupBy("role", "has", "wants", "n").agg(F.any_value("_many").alias("_many"))
    fits = pairs.withColumn("_fit", _fit(F.size(F.array_intersect("wants", "has"))))
    best = Window.partitionBy("role", "has").orderBy(F.desc("_fit"))
    reached = fits.withColumn("_sum", F.sum("_many").over(best))
    floors = reached.groupBy("role", "has").agg(F.max(F.when(F.col("_sum") >= k, F.col("_fit"))).alias("floor"))
    return floors.select("role", "has", F.coalesce("floor", F.lit(0.0)).alias("floor"))


def best_postings(cvs: DataFrame, jobs: DataFrame, k: int = 5, title_rules=None) -> DataFrame:
    """The ``k`` postings of its role that each CV fits best: ``cv_id, rank, job_ord, n_matched, n_listed, fit_score``.

    ``cvs`` are classified and have ``cv_skill_names`` (see ``gap.table_cvs``).  The fit is the share of a posting's
    required skills that the CV has, compared by lowercase name; ties go to the posting with more of them, then to the first.
    Postings that share no skill are no match, so a CV may have fewer than ``k``, or none.  Rows that share
    a ``cv_id`` are each matched by themselves.

    No list of postings is gathered anywhere: a block holds about ``BLOCK`` profiles however many postings name
    a skill, and a person opens those blocks alone that can still hold one of the best.
    """
    has = F.array_sort(F.array_distinct(F.filter(F.coalesce("cv_skill_names", F.array()), lambda s: s.isNotNull() & (s != ""))))
    own = cvs.select("cv_id", "role", has.alias("has"))
    sets = cut_lineage(profiles(jobs, k, title_rules))
    people = cut_lineage(own.select("role", "has").filter(F.size("has") > 0).distinct())
    entries, blocks = index(sets)
    seekers = people.join(_floors(people, sets, k), ["role", "has"]).withColumn("name", F.explode("has"))
    opened = (
        seekers.join(blocks, ["role", "name"])
        .filter(_fit(F.col("rest")) >= F.col("floor"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("role", "has", "floor", "name", "rest", "n", "block")
    )
    met = opened.join(entries, ["role", "name", "rest", "n", "block"])
    shared = F.filter("wants", lambda s: F.array_contains("has", s))
    # Under the first skill they share, so a pair is found once.
    met = met.withColumn("_shared", shared).filter(F.get("_shared", F.lit(0)) == F.col("name"))
    met = met.withColumn("n_matched", F.size("_shared")).filter(_fit(F.col("n_matched")) >= F.col("floor"))
    offers = met.select("role", "has", "n", "n_matched", F.explode("ords").alias("job_ord"))
    order = Window.partitionBy("role", "has").orderBy(F.desc(_fit(F.col("n_matched"))), F.desc("n_matched"), "job_ord")
    best = offers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return own.join(best, ["role", "has"]).select(
        "cv_id",
        "rank",
        "job_ord",
        "n_matched",
        F.col("n").alias("n_listed"),
        fit_score(F.col("n_matched"), F.col("n")).alias("fit_score"),
    )
