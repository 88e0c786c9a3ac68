"""Skill vocabulary and skill extraction from text."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.functions.text import bind, split_skills
from demandlens.session import cut_lineage

try:
    from demandlens.operators.vocabulary import in_words as vocabulary_in_words
    from demandlens.operators.vocabulary import readable
except ModuleNotFoundError as missing:  # then every vocabulary is indexed by Spark alone
    if missing.name not in ("numpy", "pyarrow"):
        raise
    HAS_ARROW = False
else:
    HAS_ARROW = True

# Bytes of the grams by which terms and texts are joined; a shorter term is a gram itself.
GRAMS = [4, 6]
SHORT = [1, 2, 3]
# Bytes of a text that are cut into grams at a time.
CHUNK = 256
# Bytes before and after a gram that travel with it.
REACH = 24
# Bits of the filter for grams of no term (64 to a row: 65,536 rows at most), whatever the vocabulary.
FILTER_BITS = 1 << 22
# What words stand between; any such set gives the same results.
BLANK = "[ \n]"
# So many spellings of so many bytes in all are looked for in a text one by one.
FEW, FEW_BYTES = 64, 1 << 14
# From so many terms without blanks on, tasks read the vocabulary and no text or word moves.
LARGE = 100_000
# Terms of up to three bytes that are broadcast; more are joined as Spark sees fit.
BROADCAST_SHORT = 50_000
# A gram is dealt out to a task for every so many places, if it is one of so many that occur most.
PLACES, HOT = 1 << 20, 4096


def posting_skills(jobs: DataFrame) -> DataFrame:
    """Every distinct skill of the postings, required or preferred; case variants stay apart."""
    both = F.concat(split_skills("required_skills"), split_skills("preferred_skills"))
    return jobs.select(F.explode(both).alias("skill")).distinct()


def vocabulary(jobs: DataFrame) -> DataFrame:
    """The distinct skills sorted by lowercase form, then by spelling."""
    return posting_skills(jobs).orderBy(F.lower("skill"), "skill")


def _key(gram: Column, length) -> Column:
    # Checksums of up to four bytes are all different, so with the length they stand for the gram itself.
    return F.crc32(gram) + F.shiftleft(F.lit(length).cast("long") if isinstance(length, int) else length.cast("long"), 32)


def _chunks(cvs: DataFrame, text_col, size: int, before: int, after: int) -> DataFrame:
    """Lowercase texts as pieces of ``size`` bytes and what surrounds them: ``cv_id, _mark, _lead, _left, _piece``.

    ``_mark`` tells texts of one ``cv_id`` apart; ``_lead`` bytes stand before a piece, and ``_left`` is how long the text goes
    on from its start.
    """
    text = cvs.select("cv_id", F.xxhash64(text_col).alias("_mark"), F.lower(text_col).cast("binary").alias("_bytes"))
    length = F.octet_length("_bytes")

    def cut(at):
        begin = F.greatest(at - before, F.lit(1))
        piece = F.substring("_bytes", begin, at - begin + size + after)
        return F.struct((at - begin).alias("_lead"), (length - at + 1).alias("_left"), piece.alias("_piece"))

    pieces = text.select("cv_id", "_mark", F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1)), F.lit(size)), cut).alias("_cut"))
    # Outer, as for an inner one Spark adds a filter that cuts every text a second time, where the texts are read.
    return pieces.select("cv_id", "_mark", F.inline_outer("_cut")).filter("_piece IS NOT NULL")


def _places(cvs: DataFrame, text_col, lengths) -> DataFrame:
    """Every place of every gram of these lengths: its key, and where it starts in its piece.

    Row by row in generated code; an array of keys for each piece, made by a lambda, takes many times as long.
    """
    pieces = _chunks(cvs, text_col, CHUNK, REACH, REACH + max(lengths))
    starts = F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.greatest("_left", F.lit(1))))
    placed = pieces.select("*", F.explode_outer(starts).alias("_at"))
    there = F.col("_left") - F.col("_at") + 1
    grams = [F.when(there >= n, _key(F.substring("_piece", F.col("_lead") + F.col("_at"), F.lit(n)), n)) for n in lengths]
    keyed = placed.select("cv_id", "_mark", "_lead", "_piece", "_at", F.explode(F.array(*grams)).alias("_key"))
    return keyed.filter("_key IS NOT NULL")


def _known(places: DataFrame, terms: DataFrame) -> DataFrame:
    """Without most of the rows whose ``_key`` is none of ``terms``: a bit for each key's hash, in a table of fixed size."""
    bit = F.xxhash64("_key").bitwiseAND(F.lit(FILTER_BITS - 1))
    place = "cast(_bit & 63 as int)"
    words = terms.select(bit.alias("_bit")).groupBy(F.expr("shiftright(_bit, 6)").alias("_word"))
    words = words.agg(F.bit_or(F.expr(f"shiftleft(1L, {place})")).alias("_bits"))
    marked = places.withColumn("_bit", bit).withColumn("_word", F.expr("shiftright(_bit, 6)"))
    there = marked.join(F.broadcast(words), "_word").filter(f"(shiftright(_bits, {place}) & 1) = 1")
    return there.select(*places.columns)


def names_of(vocab: DataFrame) -> DataFrame:
    """The distinct lowercase terms, as ``_name`` in bytes, and the spellings that share one."""
    terms = vocab.filter(F.col("skill") != "").select("skill", F.lower("skill").cast("binary").alias("_name"))
    return terms.groupBy("_name").agg(F.sort_array(F.collect_set("skill")).alias("skills"))


def anchors(cvs: DataFrame, names: DataFrame, text_col="cv_text") -> DataFrame:
    """Terms (see `names_of`) of more than three bytes, each with the one of its grams that is rarest in the texts.

    Every gram of a term is counted at every place of every text, so a term with a gram that no text has is
    left out: it occurs nowhere.  Columns ``_name, skills, _key, _offset, _seen``: the gram, its place in the
    term, and how many places it has in the texts.
    """
    length = F.octet_length("_name")
    size = F.lit(GRAMS[0])
    for n in GRAMS[1:]:
        size = F.when(length >= n, n).otherwise(size)
    names = names.filter(length >= GRAMS[0]).withColumn("_size", size)
    at = F.explode(F.sequence(F.lit(1), length - F.col("_size") + 1)).alias("_offset")
    grams = names.select("_name", "skills", "_size", at)
    grams = grams.withColumn("_key", _key(F.substring("_name", F.col("_offset"), F.col("_size")), F.col("_size")))
    seen = _known(_places(cvs, text_col, GRAMS).select("_key"), grams).groupBy("_key").agg(F.count(F.lit(1)).alias("_seen"))
    counted = grams.join(seen, "_key").groupBy("_name", "_size")
    best = counted.agg(
        F.any_value("skills").alias("skills"),
        F.count(F.lit(1)).alias("_found"),
        F.min(F.struct("_seen", "_key", "_offset")).alias("_best"),
    )
    return best.filter(F.col("_found") == length - F.col("_size") + 1).select("_name", "skills", "_best.*")


def _anchored(cvs: DataFrame, terms: DataFrame, text_col) -> DataFrame:
    """Terms (see `anchors`) found at their anchors' places: ``cv_id, _mark, _name, skills, _sure``."""
    size = F.shiftright("_key", 32).cast("int")
    before, after = F.least(F.col("_offset") - 1, F.lit(REACH)), F.octet_length("_name") - F.col("_offset") + 1 - size
    terms = terms.withColumns(
        {
            "_before": before,
            "_part": F.substring("_name", F.col("_offset") - before, before + size + F.least(after, F.lit(REACH))),
            "_sure": (F.col("_offset") - 1 <= REACH) & (after <= REACH),
        }
    )
    often = terms.groupBy("_key").agg(F.max("_seen").alias("_seen")).filter(F.col("_seen") >= PLACES)
    often = often.orderBy(F.desc("_seen"), "_key").limit(HOT)
    often = often.select("_key", (F.floor(F.col("_seen") / PLACES) + 1).cast("int").alias("_salts"))
    places = _known(_places(cvs, text_col, GRAMS), terms).join(F.broadcast(often), "_key", "left")
    # A row carries the bytes around its place and no more of the text.
    begin = F.greatest(F.col("_lead") + F.col("_at") - REACH, F.lit(1))
    window = F.substring("_piece", begin, F.col("_lead") + F.col("_at") - begin + REACH + F.shiftright("_key", 32).cast("int"))
    places = places.select(
        "cv_id",
        "_mark",
        "_key",
        F.pmod(F.hash("cv_id", "_mark", "_at"), F.coalesce("_salts", F.lit(1))).alias("_salt"),
        (F.col("_lead") + F.col("_at") - begin).alias("_lead"),
        window.alias("_window"),
    )
    dealt = terms.join(F.broadcast(often), "_key", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    dealt = dealt.select("_key", "_salt", "_name", "skills", "_before", "_part", "_sure")
    there = F.substring("_window", F.col("_lead") + 1 - F.col("_before"), F.octet_length("_part")) == F.col("_part")
    met = places.join(dealt, ["_key", "_salt"]).filter((F.col("_lead") >= F.col("_before")) & there)
    return met.select("cv_id", "_mark", "_name", "skills", "_sure")


def _short(cvs: DataFrame, names: DataFrame, text_col) -> DataFrame:
    """Terms of up to three bytes, by the sets of grams of each text: ``cv_id, _mark, skills``.

    Texts are dealt out once by what their grams and terms are grouped by.
    """
    few = names.count() <= BROADCAST_SHORT
    names = names.select(_key(F.col("_name"), F.octet_length("_name")).alias("_key"), "skills")
    dealt = cvs.select("cv_id", F.xxhash64(text_col).alias("_mark"), F.col(text_col).alias("_text")).repartition("cv_id", "_mark")
    grams = _known(_places(dealt, "_text", SHORT).select("cv_id", "_mark", "_key"), names).distinct()
    return grams.join(F.broadcast(names) if few else names, "_key").select("cv_id", "_mark", "skills")


def _words(cvs: DataFrame, text_col, shortest: int) -> DataFrame:
    """The distinct lowercase words, of so many bytes at least, of each text: ``cv_id, _mark, _word``."""
    words = F.array_distinct(F.split(F.lower(text_col), BLANK))
    split = cvs.select("cv_id", F.xxhash64(text_col).alias("_mark"), F.explode_outer(words).alias("_word"))
    return split.filter(F.octet_length("_word") >= shortest)


def _in_texts(cvs: DataFrame, names: DataFrame, text_col) -> DataFrame:
    """Terms of more than three bytes, by the index over all texts, as ``skills`` beside ``_mark`` and the columns of ``cvs``.

    No ``cv_id`` is null.  Texts without any such term are left out.
    """
    found = _anchored(cvs, cut_lineage(anchors(cvs, names, text_col)), text_col)
    terms = F.collect_set(F.struct("skills", F.when(~F.col("_sure"), F.col("_name")).alias("_rest")))
    found = found.groupBy("cv_id", "_mark").agg(terms.alias("_terms"))
    own = cvs.withColumns({"_mark": F.xxhash64(text_col), "_bytes": F.lower(text_col).cast("binary")})
    there = F.filter("_terms", lambda e: e["_rest"].isNull() | F.contains(F.col("_bytes"), e["_rest"]))
    return own.join(found, ["cv_id", "_mark"]).select(
        *cvs.columns, "_mark", F.flatten(F.transform(there, lambda e: e["skills"])).alias("skills")
    )


def _in_words(cvs: DataFrame, names: DataFrame, text_col, shortest: int) -> DataFrame:
    """Terms of more than three bytes and without blanks, by the index over the distinct words: ``cv_id, _mark, skills``.

    Such a term occurs in a text if it does in one of its words.  Grams of a word are formed once, however many texts have it.
    """
    words = _words(cvs, text_col, shortest)
    # Numbered as they are written, so that places carry a number and no word.
    known = cut_lineage(words.select("_word").distinct().select(F.monotonically_increasing_id().alias("cv_id"), "_word"))
    held = _in_texts(known, names, "_word").select("_word", "skills")
    return words.join(held, "_word").select("cv_id", "_mark", "skills")


def _one_by_one(cvs: DataFrame, names: DataFrame, text_col) -> Column:
    """The skills of a few names, each looked for in the text."""
    nothing = F.array().cast("array<string>")
    terms = [(bytes(r["_name"]).decode(), F.array(*map(F.lit, r["skills"]))) for r in names.orderBy("_name").collect()]
    found = [lambda low, n=n, s=s: F.when(F.contains(low, F.lit(n)), s).otherwise(nothing) for n, s in terms]
    return bind(F.lower(F.col(text_col)), lambda low: F.flatten(F.array(*[f(low) for f in found]))) if found else nothing


def _all_large(cvs: DataFrame, total: dict) -> bool:
    """Whether the vocabulary is large, without blanks, and can be read by tasks."""
    return HAS_ARROW and "blank" not in total and sum(r.names for r in total.values()) >= LARGE and readable(cvs.sparkSession)


def extract_skills(cvs: DataFrame, vocab: DataFrame, text_col="cv_text") -> DataFrame:
    """Add ``skills``: the vocabulary entries whose lowercase form occurs anywhere in the lowercase text.

    ``vocab`` has a ``skill`` column; nulls and empty entries are ignored.  Up to ``FEW`` entries are looked for one by one.  More are
    found by an inverted index of grams: a term waits at its rarest gram, by exact counts, and each place of that
    gram brings the bytes around it, against which the term is compared at once.  Only a term that reaches further than these
    bytes and agrees with them all is looked for in the text itself.  Terms without blanks are indexed over the distinct words
    of all texts, and a text has the terms of its words; other terms are indexed over the texts.  Terms of up to three bytes are members of the text's set
    of grams.  A vocabulary of ``LARGE`` terms or more, all without blanks, is read by the tasks that hold the texts instead
    (see `vocabulary`), as an index would take many times the room of the texts.  The vocabulary, the distinct words and the anchors are checkpointed here, in the shared folder.  Rows that share a ``cv_id`` are each searched by themselves.  Not for streams.
    """
    names = cut_lineage(names_of(vocab))
    length, blank = F.octet_length("_name"), F.col("_name").cast("string").rlike(BLANK)
    kind = F.when(length < GRAMS[0], "short").when(blank, "blank").otherwise("plain").alias("kind")
    spellings = F.sum(F.size("skills")).alias("n")
    total = {r.kind: r for r in names.groupBy(kind).agg(F.count(F.lit(1)).alias("names"), spellings, F.sum(length * F.size("skills")).alias("bytes"), F.min(length).alias("shortest")).collect()}
    if sum(r.n for r in total.values()) <= FEW and sum(r.bytes for r in total.values()) <= FEW_BYTES:
        return cvs.select(*[c for c in cvs.columns if c != "skills"], _one_by_one(cvs, names, text_col).alias("skills"))
    if _all_large(cvs, total):
        return vocabulary_in_words(cvs, names, text_col, sum(r.names for r in total.values()))
    # Inside, an id is its hash: never null, and of one size.
    own = cvs.select(F.xxhash64("cv_id").alias("cv_id"), text_col)
    parts = []
    if "short" in total:
        parts.append(_short(own, names.filter(length < GRAMS[0]), text_col))
    if "blank" in total:
        found = _in_texts(own, names.filter((length >= GRAMS[0]) & blank), text_col)
        parts.append(found.select("cv_id", "_mark", "skills"))
    if "plain" in total:
        plain = names.filter((length >= GRAMS[0]) & ~blank)
        parts.append(_in_words(own, plain, text_col, total["plain"].shortest))
    # Named so that no column of the caller's is likely to be named the same.
    both = cvs.withColumns({"_own_cv": F.xxhash64("cv_id"), "_own_mark": F.xxhash64(text_col)})
    for i, there in enumerate(parts):
        keys = {"cv_id": f"_found_cv{i}", "_mark": f"_found_mark{i}"}
        found = there.withColumnsRenamed(keys).groupBy(*keys.values()).agg(F.flatten(F.collect_list("skills")).alias(f"_found{i}"))
        same = (F.col("_own_cv") == F.col(f"_found_cv{i}")) & (F.col("_own_mark") == F.col(f"_found_mark{i}"))
        both = both.join(found, same, "left")
    all_found = F.array_distinct(F.concat(*[F.coalesce(f"_found{i}", F.array().cast("array<string>")) for i in range(len(parts))]))
    by_name = F.sort_array(F.transform(all_found, lambda s: F.struct(F.lower(s).cast("binary").alias("name"), s.alias("skill"))))
    kept = [both[c] for c in cvs.columns if c != "skills"]
    return both.select(*kept, F.transform(by_name, lambda e: e["skill"]).alias("skills"))
