"""The job market: what every (role, level) slice asks for and who hires in it.

One pass over the postings computes every slice at once.  Each posting becomes a few entries (itself,
its company, its skills); a partial aggregate combines them inside each task, so the shuffle
carries one row per task and distinct (role, level, entry) however many postings a slice holds.
Whole-role slices are summed from that result, not from the postings.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandlens import rules
from demandlens.functions.classify import add_posting_class
from demandlens.functions.labels import demand_bucket, percent_1dp
from demandlens.functions.text import bind, has_odd_space, strip

POSTING, SKILL, COMPANY = "posting", "skill", "company"
# More than any array can hold, so (posting, position) fits one exact number.
POSITIONS = 2147483648


def _entries(jobs: DataFrame, kinds, title_rules) -> DataFrame:
    """One row per posting and entry: the posting itself, its company, each of its listed skills.

    ``seen`` orders the entries of a slice: by posting, then by place in its list.  One number, so
    that its minimum is found by a hash aggregate (a struct would force a sort).
    """
    nothing = F.lit(None).cast("string")
    company = F.col("company_name") if COMPANY in kinds else nothing
    head = F.array(nothing, company)
    items = F.concat(head, F.split(F.coalesce("required_skills", F.lit("")), ",")) if SKILL in kinds else head
    sources = [F.col(c) for c, k in (("company_name", COMPANY), ("required_skills", SKILL)) if k in kinds]
    odd = has_odd_space(F.concat_ws(",", *sources)) if sources else F.lit(False)
    stripped = F.when(F.col("_odd"), strip("_item")).otherwise(F.trim("_item"))
    kind = F.when(F.col("_pos") == 0, POSTING).when(F.col("_pos") == 1, COMPANY).otherwise(SKILL)
    return (
        add_posting_class(jobs, title_rules)
        .withColumn("_odd", odd)
        .select("role", "level", "job_ord", "_odd", F.posexplode(items).alias("_pos", "_item"))
        .withColumn("value", stripped)
        .filter((F.col("_pos") == 0) | (F.col("value") != ""))
        .select(
            "role",
            "level",
            kind.alias("kind"),
            "value",
            (F.col("job_ord").cast("decimal(20,0)") * F.lit(POSITIONS) + F.col("_pos")).cast("decimal(38,0)").alias("seen"),
        )
    )


def demand(jobs: DataFrame, kinds=(SKILL, COMPANY), title_rules=None) -> DataFrame:
    """Counts of every entry of every slice: ``role, level, kind, value, n, seen``.

    ``level`` is null for the slice of a whole role.  ``seen`` tells where the entry was first seen.
    """
    return with_whole_roles(partial_demand(jobs, kinds, title_rules))


def partial_demand(jobs: DataFrame, kinds=(SKILL, COMPANY), title_rules=None) -> DataFrame:
    """Counts of every entry of every role and level.  ``jobs`` may be a stream; states of parts of it can be merged."""
    entries = _entries(jobs, kinds, title_rules)
    return entries.groupBy("role", "level", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen"))


def with_whole_roles(by_level: DataFrame) -> DataFrame:
    """Counts of every role and level, and of every role (``level`` null), from those of roles and levels."""
    return (
        by_level.withColumn("level", F.explode(F.array("level", F.lit(None).cast("string"))))
        .groupBy("role", "level", "kind", "value")
        .agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    )


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    """The first ``k`` entries of each kind and slice: skills by demand, then first seen; companies by name.

    Spark keeps ``k`` rows per group in each task before it shuffles (a window group limit), so a
    slice with any number of distinct entries brings at most ``k`` per task to one place.
    """
    is_skill = F.col("kind") == SKILL
    order = [
        F.when(is_skill, -F.col("n")),
        F.when(is_skill, F.col("seen")),
        F.col("value"),
    ]
    window = Window.partitionBy("role", "level", "kind").orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def collapse_variants(skills: Column) -> Column:
    """Skills equal up to case as one entry: at the first one's position, in the last one's spelling."""

    def entries(b):
        back, last = F.reverse(b["names"]), F.reverse(b["skills"])
        turned = F.struct(F.array_distinct(b["names"]).alias("names"), back.alias("back"), last.alias("last"))
        return bind(turned, lambda t: F.transform(t["names"], lambda name: _entry(t, name)))

    def _entry(t, name):
        at = (F.array_position(t["back"], name) - 1).cast("int")
        return F.struct(name.alias("name"), F.get(t["last"], at).alias("skill"))

    return bind(skills, lambda s: bind(F.struct(F.transform(s, F.lower).alias("names"), s.alias("skills")), entries))


def market_profile(
    jobs: DataFrame, k: int = rules.TOP_K, title_rules=None, kinds=(SKILL, COMPANY)
) -> DataFrame:
    """One row per slice: ``role, level, total_jobs, demand, entries, companies``.

    ``demand`` is the top-``k`` list with counts, percentages and buckets, ``entries`` the same list
    with case variants collapsed.  There are at most 4 rows per role of the rules (three levels and
    the whole role) plus 4 for ``unknown``, each with at most ``2 k`` items.
    """
    return profile_of(demand(jobs, kinds, title_rules), k)


def profile_of(counts: DataFrame, k: int = rules.TOP_K) -> DataFrame:
    """The profile (see `market_profile`) of counted entries (see `demand`)."""
    slices = (
        _ranked(counts, k)
        .groupBy("role", "level")
        .agg(
            F.max(F.when(F.col("kind") == POSTING, F.col("n"))).alias("total_jobs"),
            F.sort_array(F.collect_list(F.when(F.col("kind") == SKILL, F.struct("rank", "value", "n")))).alias("_skills"),
            F.sort_array(F.collect_list(F.when(F.col("kind") == COMPANY, F.col("value")))).alias("companies"),
        )
    )
    with_pct = slices.withColumn(
        "_skills",
        F.transform(
            "_skills",
            lambda s: F.struct(
                s["rank"].alias("rank"),
                s["value"].alias("skill"),
                s["n"].alias("demand_count"),
                percent_1dp(s["n"], F.col("total_jobs")).alias("demand_pct"),
            ),
        ),
    )
    return with_pct.select(
        "role",
        "level",
        "total_jobs",
        F.transform("_skills", lambda s: s.withField("bucket", demand_bucket(s["demand_pct"]))).alias("demand"),
        collapse_variants(F.transform("_skills", lambda s: s["skill"])).alias("entries"),
        "companies",
    )


def market(jobs: DataFrame, k: int = rules.TOP_K, title_rules=None) -> DataFrame:
    """The top-``k`` skills of every slice, one row per slice and rank (``level`` null: whole role)."""
    slices = market_profile(jobs, k, title_rules, kinds=(SKILL,))
    return slices.select("role", "level", "total_jobs", F.inline("demand"))


def companies(jobs: DataFrame, k: int = rules.TOP_K, title_rules=None) -> DataFrame:
    """The first ``k`` hiring companies by name of every slice: ``role, level, rank, company``."""
    counts = demand(jobs, kinds=(COMPANY,), title_rules=title_rules).filter(F.col("kind") == COMPANY)
    return _ranked(counts, k).select("role", "level", "rank", F.col("value").alias("company"))


def slice_sizes(jobs: DataFrame, title_rules=None) -> DataFrame:
    """Postings per (role, level) and per role (``level`` null)."""
    return (
        demand(jobs, kinds=(), title_rules=title_rules)
        .filter(F.col("kind") == POSTING)
        .select("role", "level", F.col("n").alias("total_jobs"))
    )


def market_slices(jobs: DataFrame, k: int = rules.TOP_K, title_rules=None) -> DataFrame:
    """The slice each CV of a (role, level) is compared with: its own, or its whole role if that is empty.

    At most 3 rows per role, so it is always small enough to broadcast.  A role without postings
    has no row.  ``used_fallback`` tells that the whole role stands in.
    """
    return slices_of(market_profile(jobs, k, title_rules))


def slices_of(profile: DataFrame) -> DataFrame:
    """The slices (see `market_slices`) of a profile."""
    fields = ["level", "total_jobs", "demand", "entries", "companies"]
    per_role = profile.groupBy("role").agg(F.collect_list(F.struct(*fields)).alias("_slices"))
    wanted = per_role.withColumn("level", F.explode(F.array(*[F.lit(level) for level in rules.LEVELS])))
    own = F.filter("_slices", lambda s: s["level"] == F.col("level"))
    whole = F.filter("_slices", lambda s: s["level"].isNull())
    return wanted.withColumn("_slice", F.concat(own, whole)[0]).select(
        "role",
        "level",
        F.col("_slice.total_jobs").alias("relevant_jobs"),
        F.col("_slice.demand").alias("demand"),
        F.col("_slice.entries").alias("entries"),
        F.col("_slice.companies").alias("companies"),
        F.col("_slice.level").isNull().alias("used_fallback"),
    )
