"""The named queries: each takes a session and a folder of the given tables and returns a DataFrame.

Lists are returned as joined strings and whole-role slices as level ``all``, so that results can be compared by value.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens import rules
from demandlens.functions import classify, labels, prompts, text
from demandlens.operators import feedback, gap, market, matching, picks, report, rule_tables, skills
from demandlens.plans import fixtures
from demandlens.session import cut_lineage, shared_dir
from demandlens.sources import tables, texts, uploads
from demandlens.streaming import intake, states

SEPARATOR = " | "
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _level() -> F.Column:
    return F.coalesce("level", F.lit("all")).alias("level")


def _list(c) -> F.Column:
    name = c if isinstance(c, str) else None
    joined = F.array_join(c, SEPARATOR)
    return joined.alias(name) if name else joined


def _classified_jobs(spark, sf_dir):
    return classify.add_posting_class(fixtures.jobs(spark, sf_dir))


def _slices(spark, sf_dir):
    return market.market_slices(fixtures.jobs(spark, sf_dir))


def _text_cvs(spark, sf_dir):
    return gap.text_cvs(fixtures.cv_texts(spark, sf_dir))


def _table_cvs(spark, sf_dir):
    return gap.table_cvs(fixtures.cvs(spark, sf_dir))


def _text_gaps(spark, sf_dir):
    return gap.skill_gap(_text_cvs(spark, sf_dir), _slices(spark, sf_dir))


def _table_gaps(spark, sf_dir):
    return gap.skill_gap(_table_cvs(spark, sf_dir), _slices(spark, sf_dir))


def _table_gaps_read_often(spark, sf_dir):
    """As above, for queries that read the gaps more than once: the market, a few rows, is computed once and kept."""
    return gap.skill_gap(_table_cvs(spark, sf_dir), cut_lineage(_slices(spark, sf_dir)))


# ---- postings and their market ------------------------------------------------------------------


@query
def market_top_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top skills of every role and level, and of every role, with demand."""
    top = market.market(fixtures.jobs(spark, sf_dir))
    return top.select(
        "role",
        _level(),
        F.col("rank").cast("bigint").alias("rank"),
        "skill",
        "demand_count",
        "total_jobs",
        "demand_pct",
        "bucket",
    )


@query
def job_scan(spark, sf_dir):
    """The postings in the shape every reader gives them."""
    jobs = fixtures.jobs(spark, sf_dir)
    return tables.conform(jobs, tables.schemas.JOBS, tables.schemas.JOBS_REQUIRED)


@query
def job_role_level(spark, sf_dir):
    return _classified_jobs(spark, sf_dir).select("job_ord", "role", "level")


@query
def job_slice_filter(spark, sf_dir):
    """The postings of one role and level."""
    wanted = (F.col("role") == "data engineer") & (F.col("level") == "senior")
    return _classified_jobs(spark, sf_dir).filter(wanted).select("job_ord", "job_title", "seniority_level")


@query
def jobs_per_role_level(spark, sf_dir):
    return market.slice_sizes(fixtures.jobs(spark, sf_dir)).select("role", _level(), "total_jobs")


@query
def posting_skill_lists(spark, sf_dir):
    """Skill lists as written and normalized."""
    required = text.split_skills("required_skills")
    return fixtures.jobs(spark, sf_dir).select(
        "job_ord",
        F.size(required).cast("bigint").alias("n_required"),
        _list(required).alias("required"),
        _list(F.transform(required, text.normalize_skill)).alias("required_normalized"),
        _list(text.split_skills("preferred_skills")).alias("preferred"),
    )


@query
def skill_vocabulary(spark, sf_dir):
    return skills.vocabulary(fixtures.jobs(spark, sf_dir)).select("skill", F.lower("skill").alias("sort_key"))


@query
def hiring_companies(spark, sf_dir):
    top = market.companies(fixtures.jobs(spark, sf_dir))
    return top.select("role", _level(), F.col("rank").cast("bigint").alias("rank"), "company")


@query
def demand_buckets(spark, sf_dir):
    """Demand items of every slice, by bucket."""
    profile = market.market_profile(fixtures.jobs(spark, sf_dir))
    return profile.select(
        "role", _level(), *[_list(gap.demand_items(b)).alias(f"{b}_demand") for b in ("high", "medium", "low")]
    )


@query
def union_by_name(spark, sf_dir):
    """Two sets of postings with different columns as one, numbered afresh."""
    jobs = fixtures.jobs(spark, sf_dir)
    early = F.col("source_file") < "jobs_1995.xlsx"
    both = tables.union_by_name(
        [jobs.filter(early).drop("preferred_skills"), jobs.filter(~early).drop("company_name", "seniority_level")]
    )
    numbered = tables.renumber(both.withColumnRenamed("job_ord", "row_key"), ["source_file", "row_key"])
    return numbered.select(
        "job_ord", "row_key", "source_file", "job_title", "seniority_level", "preferred_skills", "company_name"
    )


@query
def first_row_profile(spark, sf_dir):
    jobs = fixtures.jobs(spark, sf_dir).drop("applicant_id")
    return picks.profile(jobs, "job_ord")


@query
def first_row(spark, sf_dir):
    return picks.first_row(fixtures.cvs(spark, sf_dir), ["cv_id"])


@query
def random_row(spark, sf_dir):
    return picks.random_row(fixtures.cvs(spark, sf_dir), "cv_id", seed=7)


@query
def latest_document(spark, sf_dir):
    """The newest order of every customer, orders standing for versions of a document."""
    orders = fixtures.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    newest = picks.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return newest.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


@query
def latest_text(spark, sf_dir):
    """The newest text of all."""
    return picks.latest(fixtures.cv_texts(spark, sf_dir), [], ["cv_id"])


# ---- classification of CVs ----------------------------------------------------------------------


@query
def text_validity(spark, sf_dir):
    documents = fixtures.spread(fixtures.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return documents.select(
        "doc_id", text.letters("text").cast("bigint").alias("n_letters"), text.is_valid_text("text").alias("is_valid")
    )


@query
def cv_role_from_text(spark, sf_dir):
    """Role of every text CV, with the keyword score of each role."""
    lowered = _text_cvs(spark, sf_dir)
    scores = [
        classify.keyword_score("cv_text_lower", keywords).cast("bigint").alias(f"score_{role.replace(' ', '_')}")
        for role, keywords in rules.KEYWORD_RULES.items()
    ]
    return lowered.select("cv_id", "role", *scores)


@query
def cv_role_by_rule_table(spark, sf_dir):
    """Role of every text CV by rules that are rows."""
    table = rule_tables.rule_rows(spark, rules.KEYWORD_RULES)
    return rule_tables.role_by_rules(fixtures.cv_texts(spark, sf_dir), table).select("cv_id", "role")


@query
def title_role_by_rule_table(spark, sf_dir):
    """Role of every posting by rules that are rows."""
    table = rule_tables.rule_rows(spark, rules.TITLE_RULES)
    titles = fixtures.jobs(spark, sf_dir).select("job_ord", "job_title")
    return rule_tables.role_by_rules(titles, table, "job_ord", "job_title", pick=rule_tables.FIRST).select("job_ord", "role")


@query
def cv_role_by_many_rules(spark, sf_dir):
    """Every text CV's group by a rule for each long word of the documents: groups by the first byte of the word's digest."""
    words = fixtures.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]")).alias("keyword"))
    group = F.substring(F.md5("keyword"), 1, 2)
    table = words.filter(F.length("keyword") >= 10).distinct().select(
        F.concat(F.lit("group "), group).alias("role"), F.conv(group, 16, 10).cast("int").alias("priority"), "keyword"
    )
    return rule_tables.role_by_rules(fixtures.cv_texts(spark, sf_dir), table).select("cv_id", "role")


@query
def cv_level_from_text(spark, sf_dir):
    return _text_cvs(spark, sf_dir).select(
        "cv_id", text.max_years("cv_text_lower").cast("bigint").alias("max_years"), "level"
    )


@query
def cv_level_from_experience(spark, sf_dir):
    return fixtures.cvs(spark, sf_dir).select(
        "cv_id",
        text.max_years(F.lower("experience")).cast("bigint").alias("max_years"),
        classify.level_from_experience("experience").alias("level"),
    )


@query
def cv_role_from_field(spark, sf_dir):
    cvs = fixtures.cvs(spark, sf_dir)
    return cvs.select("cv_id", "primary_field", classify.role_from_title("primary_field").alias("role"))


@query
def cv_scan(spark, sf_dir):
    """Table CVs from a source that has no ``experience`` column."""
    cvs = fixtures.cvs(spark, sf_dir).drop("experience")
    return tables.conform(cvs, tables.schemas.CVS, tables.schemas.CVS_REQUIRED)


@query
def cv_skills(spark, sf_dir):
    """Vocabulary entries found in every text CV."""
    vocab = skills.posting_skills(fixtures.jobs(spark, sf_dir))
    found = skills.extract_skills(fixtures.cv_texts(spark, sf_dir), vocab)
    return found.select("cv_id", F.size("skills").cast("bigint").alias("n_skills"), _list("skills"))


@query
def cv_skills_large_vocabulary(spark, sf_dir):
    """Every distinct word of the documents, looked for in every text CV."""
    words = fixtures.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]")).alias("skill"))
    found = skills.extract_skills(fixtures.cv_texts(spark, sf_dir), words.distinct())
    return found.select("cv_id", F.size("skills").cast("bigint").alias("n_skills"), F.md5(F.array_join("skills", SEPARATOR)).alias("md5"))


# ---- readers, on tables written to the shared folder first ---------------------------------------


def _folder():
    import uuid

    return f"readers-{uuid.uuid4().hex}"


@query
def read_folder(spark, sf_dir):
    """The files of the given folder that a name pattern picks, with their names."""
    documents = tables.read_folder(spark, sf_dir, pattern="documents.parquet")
    return documents.select("doc_id", "source_file")


@query
def read_postings(spark, sf_dir):
    """Postings from two folders of files, numbered folder after folder and file after file."""
    base = f"{shared_dir(spark)}/{_folder()}"
    jobs = fixtures.jobs(spark, sf_dir).drop("source_file").withColumnRenamed("job_ord", "key")
    parts = {"one": jobs.filter("key % 3 = 0").drop("preferred_skills"), "two": jobs.filter("key % 3 != 0")}
    for name, part in parts.items():
        part.repartitionByRange(4, "key").sortWithinPartitions("key").write.parquet(f"{base}/{name}")
    read = tables.read_postings(spark, [f"{base}/{name}" for name in parts])
    return read.select("job_ord", "job_title", "seniority_level", "required_skills", "preferred_skills", "company_name")


@query
def posting_ledger(spark, sf_dir):
    """Postings numbered by a ledger, after a folder was added that sorts before the one numbered first."""
    base = f"{shared_dir(spark)}/{_folder()}"
    jobs = fixtures.jobs(spark, sf_dir).drop("source_file").withColumnRenamed("job_ord", "key")
    for at in (0, 1):
        part = jobs.filter(F.col("key") % 3 == at).repartitionByRange(3, "key").sortWithinPartitions("key")
        part.write.parquet(f"{base}/{at}")
    tables.read_postings(spark, f"{base}/0", ledger=f"{base}/ledger")
    read = tables.read_postings(spark, [f"{base}/1", f"{base}/0"], ledger=f"{base}/ledger")
    return read.select("job_ord", "job_title", "seniority_level", "required_skills", "company_name")


@query
def read_cvs(spark, sf_dir):
    """Table CVs from a folder of files that have no ``experience``."""
    path = f"{shared_dir(spark)}/{_folder()}"
    fixtures.cvs(spark, sf_dir).drop("experience").write.parquet(path)
    return tables.read_cvs(spark, path)


@query
def text_files(spark, sf_dir):
    """Texts written one to a file, read back as whole files, kept as a table and read again."""
    base = f"{shared_dir(spark)}/{_folder()}"
    documents = fixtures.spread(fixtures.table(spark, sf_dir, "documents").select("text"))
    folders = fixtures.write_text_files(documents, f"{base}/files")
    texts.write_cv_texts(texts.read_cv_texts(spark, folders), f"{base}/table")
    kept = spark.read.parquet(f"{base}/table")
    return kept.select(F.md5("cv_text").alias("md5"), F.length("cv_text").cast("bigint").alias("n_chars"))


@query
def file_intake(spark, sf_dir):
    """Uploads by file name: stem, and why they are turned away."""
    ending = F.element_at(F.array(*map(F.lit, (".pdf", ".PDF", ".docx"))), (F.col("cv_id") % 3 + 1).cast("int"))
    cvs = fixtures.cv_texts(spark, sf_dir).withColumn("file_name", F.concat("cv_name", F.lit(".v1"), ending))
    routed = gap.route(cvs.withColumn("cv_name", texts.file_stem(F.col("file_name"))), _slices(spark, sf_dir))
    return routed.select("cv_id", "cv_name", "status", "reject_reason")


def _upload_lines(cvs):
    """CVs as lines of JSON, some with a file of the wrong type, and some cut short, undecodable or without a proper time."""
    ending = F.element_at(F.array(*map(F.lit, (".pdf", ".PDF", ".pdf", ".docx"))), (F.col("cv_id") % 4 + 1).cast("int"))
    content = F.base64(F.col("cv_text").cast("binary"))
    upload = F.struct(
        "cv_id",
        "cv_name",
        F.concat("cv_name", ending).alias("file_name"),
        F.when(F.col("cv_id") % 17 == 5, "next week").otherwise("2024-05-01T12:00:00Z").alias("modified_at"),
        F.when(F.col("cv_id") % 13 == 2, F.concat(content, F.lit("!"))).otherwise(content).alias("content"),
    )
    line = F.to_json(upload)
    cut = F.col("cv_id") % 11 == 3
    return cvs.select(F.when(cut, F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line).alias("value"))


@query
def upload_rejects(spark, sf_dir):
    """Uploads that are turned away, with the reason, among which are broken ones: of these some are not even known by id."""
    path = f"{shared_dir(spark)}/{_folder()}"
    _upload_lines(fixtures.cv_texts(spark, sf_dir)).write.text(path)
    routed = gap.route(uploads.read_uploads(spark, path), _slices(spark, sf_dir))
    return routed.filter(F.col("status") == gap.REJECTED).select("cv_id", "cv_name", "reject_reason")


@query
def upload_stream(spark, sf_dir):
    """The same uploads as they arrive, accepted and rejected."""
    base = f"{shared_dir(spark)}/{_folder()}"
    _upload_lines(fixtures.cv_texts(spark, sf_dir)).write.text(f"{base}/uploads")
    intake.publish_market(fixtures.jobs(spark, sf_dir), f"{base}/market", version=1)
    arriving = uploads.stream_uploads(spark, f"{base}/uploads", maxFilesPerTrigger=4)
    intake.run_intake(arriving, f"{base}/market", f"{base}/out", f"{base}/progress").awaitTermination()
    routed = intake.read_intake(spark, f"{base}/out")
    return routed.select("cv_id", "status", "reject_reason", F.col("result.fit_score").cast("bigint").alias("fit_score"))


@query
def market_refresh(spark, sf_dir):
    """The newest of two published markets."""
    path = f"{shared_dir(spark)}/{_folder()}"
    jobs = fixtures.jobs(spark, sf_dir)
    intake.publish_market(jobs.filter("job_ord % 2 = 0"), path, version=1)
    intake.publish_market(jobs, path, version=2)
    return intake.load_market(spark, path).select("role", "level", "relevant_jobs", "used_fallback")


# ---- CVs against the market ---------------------------------------------------------------------


@query
def cv_rejects(spark, sf_dir):
    """Text CVs that are turned away, with the reason."""
    judged = gap.select_slice(_text_cvs(spark, sf_dir), _slices(spark, sf_dir), how="left")
    judged = judged.withColumn("reject_reason", gap.reject_reason())
    return judged.filter("reject_reason IS NOT NULL").select("cv_id", "role", "level", "reject_reason")


@query
def cv_without_market(spark, sf_dir):
    """Table CVs whose role has no posting."""
    turned_away = gap.rejects(_table_cvs(spark, sf_dir), _slices(spark, sf_dir))
    return turned_away.select("cv_id", "role", "level", "reject_reason")


@query
def cv_market_slice(spark, sf_dir):
    """The slice every text CV is compared with: its level's, or its whole role's."""
    chosen = gap.select_slice(_text_cvs(spark, sf_dir), _slices(spark, sf_dir))
    return chosen.select("cv_id", "role", "level", "relevant_jobs", "used_fallback")


def _gap_columns(gaps):
    return gaps.select(
        "cv_id",
        "role",
        "level",
        "relevant_jobs",
        _list("matched_skills"),
        _list("missing_skills"),
        F.col("fit_score").cast("bigint").alias("fit_score"),
        "alignment_label",
    )


@query
def skill_gap(spark, sf_dir):
    return _gap_columns(_text_gaps(spark, sf_dir))


@query
def skill_gap_table_cv(spark, sf_dir):
    return _gap_columns(_table_gaps(spark, sf_dir))


@query
def skill_membership(spark, sf_dir):
    """The market skills of every table CV, one per row, and whether the CV has them."""
    rows = gap.membership(_table_cvs(spark, sf_dir), _slices(spark, sf_dir))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query
def fit_labels(spark, sf_dir):
    """Fit score of every table CV in words."""
    return _table_gaps(spark, sf_dir).select(
        "cv_id",
        F.col("fit_score").cast("bigint").alias("fit_score"),
        labels.alignment_label("fit_score").alias("alignment_label"),
        labels.similarity_summary("fit_score", "role").alias("similarity_summary"),
    )


_LISTS = ["companies", "high_demand", "medium_demand", "low_demand", "matched_skills", "missing_skills"]


def _flat(results):
    present = [c for c in _LISTS if c in results.columns]
    return results.withColumns({c: F.array_join(c, SEPARATOR) for c in present}).withColumn(
        "fit_score", F.col("fit_score").cast("bigint")
    )


@query
def skill_gap_report(spark, sf_dir):
    """The full result record of every text CV."""
    return _flat(gap.result_record(_text_gaps(spark, sf_dir)))


@query
def web_view(spark, sf_dir):
    return _flat(report.web_view(gap.result_record(_text_gaps(spark, sf_dir))))


@query
def text_report(spark, sf_dir):
    """The plain-text report of every table CV."""
    return report.report(gap.result_record(_table_gaps(spark, sf_dir)))


@query
def gap_by_role(spark, sf_dir):
    return gap.gap_summary(_text_gaps(spark, sf_dir))


@query
def pair_compare(spark, sf_dir):
    """Every posting against the CV of its applicant."""
    on = F.col("cv_id") == F.col("applicant_id")
    pairs = gap.compare_pairs(fixtures.cvs(spark, sf_dir), fixtures.jobs(spark, sf_dir), on)
    return pairs.select(
        "cv_id",
        "job_ord",
        _list("matched_skills"),
        _list("missing_skills"),
        F.col("fit_score").cast("bigint").alias("fit_score"),
        _list("matched_preferred"),
        _list("missing_preferred"),
    )


@query
def best_postings(spark, sf_dir):
    """The five postings of its role that every table CV fits best, whoever applied to them."""
    best = matching.best_postings(_table_cvs(spark, sf_dir), fixtures.jobs(spark, sf_dir), k=5)
    return best.select("cv_id", "job_ord", *[F.col(c).cast("bigint").alias(c) for c in ("rank", "n_matched", "n_listed", "fit_score")])


# ---- feedback -----------------------------------------------------------------------------------


def _prompts(gaps):
    return prompts.feedback_prompt("role", "level", "matched_skills", "missing_skills", "fit_score")


@query
def feedback_prompt(spark, sf_dir):
    gaps = _text_gaps(spark, sf_dir)
    return gaps.select("cv_id", _prompts(gaps).alias("prompt"))


@query
def pair_prompt(spark, sf_dir):
    """Prompt for every posting and the CV of its applicant."""
    cvs, jobs = fixtures.cvs(spark, sf_dir), fixtures.jobs(spark, sf_dir)
    pairs = cvs.join(jobs, cvs.cv_id == jobs.applicant_id)
    return pairs.select("cv_id", "job_ord", prompts.pair_prompt("technical_skills", "required_skills").alias("prompt"))


@query
def text_pair_prompt(spark, sf_dir):
    """Prompt for every text CV and the latest posting that a customer, standing for its reader, applied to."""
    customers = fixtures.table(spark, sf_dir, "customer").count()
    cvs = fixtures.cv_texts(spark, sf_dir).withColumn("reader", F.col("cv_id") % customers)
    jobs = picks.latest(fixtures.jobs(spark, sf_dir), ["applicant_id"], ["job_ord"])
    required, preferred = text.split_skills("required_skills"), text.split_skills("preferred_skills")
    prompt = prompts.text_pair_prompt("cv_text", "job_title", required, preferred)
    return cvs.join(jobs, cvs.reader == jobs.applicant_id, "left").select("cv_id", "job_ord", prompt.alias("prompt"))


@query
def feedback_clean(spark, sf_dir):
    """Wording clean-up of conversation turns."""
    turns = fixtures.table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("The "), "role", F.lit(", a candidate among users, wrote: "), "text")
    return turns.select("conv_id", "turn", prompts.clean_feedback(said).alias("cleaned"))


@query
def cv_feedback(spark, sf_dir):
    """Feedback made from the numbers."""
    return feedback.with_feedback(_table_gaps(spark, sf_dir)).select("cv_id", "feedback")


def _measuring_model(batch):
    """A stand-in for a model: says how long its prompt is, and fails on every seventh length."""
    replies = []
    for prompt in batch:
        n = len(prompt)
        replies.append({"error": "busy"} if n % 7 == 0 else {"response": f" The candidate sent {n} characters. "})
    return replies


@query
def model_feedback(spark, sf_dir):
    """The feedback stage with a caller's function."""
    gaps = feedback.with_feedback(_table_gaps(spark, sf_dir), _measuring_model)
    return gaps.select("cv_id", "feedback")


def _failing_model(batch):
    """As above, but a prompt of every eleventh length ends the call with an error."""
    if any(len(prompt) % 11 == 0 for prompt in batch):
        raise ValueError("no answer")
    return _measuring_model(batch)


@query
def model_report(spark, sf_dir):
    """The result record with a model's feedback, where some calls fail."""
    answered = feedback.with_feedback(_table_gaps(spark, sf_dir), _failing_model)
    return _flat(gap.result_record(answered)).select("cv_file", "fit_score", "feedback")


@query
def durable_feedback(spark, sf_dir):
    """Model feedback whose answers are kept: half of the CVs are asked about first, and then all."""
    store = f"{shared_dir(spark)}/{_folder()}"
    gaps = _table_gaps_read_often(spark, sf_dir)
    feedback.with_durable_feedback(gaps.filter("cv_id % 2 = 0"), _measuring_model, store)
    return feedback.with_durable_feedback(gaps, _measuring_model, store).select("cv_id", "feedback")


@query
def kept_feedback(spark, sf_dir):
    """Feedback from kept answers alone: the second time a model is there that fails whenever it is asked."""
    store = f"{shared_dir(spark)}/{_folder()}"
    gaps = _table_gaps_read_often(spark, sf_dir)
    feedback.with_durable_feedback(gaps, _plain_model, store)
    return feedback.with_durable_feedback(gaps, _absent_model, store).select("cv_id", "feedback")


def _plain_model(batch):
    return [f"The candidate sent {len(prompt)} characters." for prompt in batch]


def _absent_model(batch):
    raise ConnectionError("no model")


@query
def model_answer_parse(spark, sf_dir):
    """JSON answers parsed; every fifth is cut short and every fifth has a score out of range."""
    gaps = _table_gaps(spark, sf_dir)
    case = F.col("cv_id") % 5
    answer = F.to_json(
        F.struct(
            "matched_skills",
            "missing_skills",
            F.when(case == 1, F.col("fit_score") + 101).otherwise(F.col("fit_score")).alias("fit_score"),
            F.col("alignment_label").alias("feedback"),
        )
    )
    received = F.when(case == 0, F.expr("left(answer, length(answer) - 9)")).otherwise(F.col("answer"))
    parsed = gaps.withColumn("answer", answer).select("cv_id", prompts.parse_answer(received).alias("a"))
    return parsed.select(
        "cv_id",
        F.col("a").isNotNull().alias("is_valid"),
        _list(F.col("a.matched_skills")).alias("matched_skills"),
        _list(F.col("a.missing_skills")).alias("missing_skills"),
        F.col("a.fit_score").cast("bigint").alias("fit_score"),
        F.col("a.feedback").alias("feedback"),
    )


# ---- streaming ----------------------------------------------------------------------------------


@query
def stream_scoring(spark, sf_dir):
    """Text CVs scored as a stream against a published market; accepted and rejected in one table."""
    import uuid

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    intake.publish_market(fixtures.jobs(spark, sf_dir), f"{base}/market", version=1)
    schema = fixtures.table(spark, sf_dir, "documents").select("doc_id", "text").schema
    # A pattern, as a stream takes no path of one file; the table may be a file or a folder of files.
    documents = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    arriving = fixtures.cv_texts_of(documents)
    intake.run_intake(arriving, f"{base}/market", f"{base}/out", f"{base}/progress").awaitTermination()
    routed = intake.read_intake(spark, f"{base}/out")
    return routed.select(
        "cv_id",
        "status",
        "reject_reason",
        "result.detected_field",
        "result.estimated_level",
        F.col("result.fit_score").cast("bigint").alias("fit_score"),
        F.array_join("result.matched_skills", SEPARATOR).alias("matched_skills"),
        F.array_join("result.missing_skills", SEPARATOR).alias("missing_skills"),
    )


def _in_batches(spark, df, path, key, batches=3):
    """The rows written to files, dealt out by a hash, and read again as a stream that takes them in about so many batches.

    Tasks write about as many rows each as Spark puts into a part of a shuffle, so the files are more for more rows.
    """
    df.withColumn("_deal", F.xxhash64(key)).repartition("_deal").drop("_deal").write.parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path)._jdf.inputFiles())
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(-(-files // batches), 1))
    return reader.parquet(path)


@query
def market_stream(spark, sf_dir):
    """The market slices that a stream of postings has kept up to date over several batches."""
    base = f"{shared_dir(spark)}/{_folder()}"
    jobs = fixtures.jobs(spark, sf_dir).select("job_ord", "job_title", "seniority_level", "required_skills", "company_name")
    arriving = _in_batches(spark, jobs, f"{base}/jobs", "job_ord")
    states.run_market(arriving, f"{base}/states", f"{base}/progress").awaitTermination()
    listed = F.transform("demand", lambda d: labels.demand_item(d["skill"], d["demand_pct"]))
    return states.read_market(spark, f"{base}/states").select(
        "role", "level", "relevant_jobs", "used_fallback", _list(listed).alias("demand"), _list("companies")
    )


@query
def latest_stream(spark, sf_dir):
    """The newest order of every customer, kept by a stream to which the orders come in no order."""
    base = f"{shared_dir(spark)}/{_folder()}"
    orders = fixtures.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    keys, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    arriving = _in_batches(spark, orders, f"{base}/orders", "o_orderkey")
    states.run_latest(arriving, keys, order, f"{base}/states", f"{base}/progress").awaitTermination()
    newest = states.read_latest(spark, f"{base}/states", keys, order)
    return newest.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
