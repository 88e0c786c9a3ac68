"""DuckDB SQL with the same results as the queries, written relationally.

Used only to check results on small tables.  Common table expressions are given by name in ``PARTS``;
``_sql`` puts together those a statement asks for, and ``order`` says in which order they build on each other.
"""

from demandlens import rules
from demandlens.plans.fixtures import SKILLS, TITLES


def _values(items):
    return ", ".join(f"({i}, '{s}')" for i, s in enumerate(items))


def _any_in(column, words):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _title_role(column):
    cases = " ".join(f"WHEN {_any_in(column, words)} THEN '{role}'" for role, words in rules.TITLE_RULES.items())
    return f"CASE {cases} ELSE 'unknown' END"


def _score(column, words):
    return "(" + " + ".join(f"contains({column}, '{w}')::INT" for w in words) + ")"


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _fill(template, **columns):
    """A template as a SQL concatenation."""
    import string

    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(_quoted(literal))
        if field is not None:
            parts.append(f"coalesce(CAST({columns[field]} AS VARCHAR), '')")
    return "(" + " || ".join(parts) + ")"


def _by_cutoff(column, choices):
    cases = " ".join(f"WHEN {column} >= {cut} THEN {value}" for cut, value in choices if cut is not None)
    return f"CASE {cases} ELSE {choices[-1][1]} END"


LABEL = _by_cutoff("fit_score", [(cut, _quoted(label)) for cut, label in rules.ALIGNMENT_LABELS])
SUMMARY = _by_cutoff("fit_score", [(cut, _fill(t, role="role")) for cut, t in rules.SIMILARITY_SUMMARIES])
YEARS = r"list_max(list_transform(regexp_extract_all({}, '([0-9]+)\+?\s*years?', 1), lambda y: coalesce(TRY_CAST(y AS INT), 99)))"
REASON_ROLE = _quoted(rules.REASON_NO_JOBS)
REASON_TEXT = _quoted(rules.REASON_UNREADABLE)
# Uploads cut short have no id and no name.
UPLOADED = f"""SELECT cv_id, CASE WHEN cv_id % 11 <> 3 THEN cv_id END AS known_id, CASE WHEN cv_id % 11 <> 3 THEN cv_name END AS name,
    CASE WHEN cv_id % 11 = 3 THEN {_quoted(rules.REASON_FAILED)} WHEN cv_id % 4 = 3 THEN {_quoted(rules.REASON_BAD_FILE)}
         WHEN cv_id % 17 = 5 OR cv_id % 13 = 2 THEN {_quoted(rules.REASON_FAILED)} WHEN NOT is_valid THEN {REASON_TEXT}
         WHEN role NOT IN (SELECT role FROM totals) THEN {REASON_ROLE} END AS reason FROM text_c"""


def _clean(column):
    for old, new in rules.FEEDBACK_REPLACEMENTS:
        column = f"replace({column}, {_quoted(old)}, {_quoted(new)})"
    return column


DEFAULT_FEEDBACK = _clean(
    "(CASE WHEN n_matched > 0 THEN 'You already show ' || matched_comma || '.'"
    " ELSE 'None of the most requested skills show in your CV yet.' END"
    " || CASE WHEN n_missing > 0 THEN ' Work next on ' || missing_comma || '.'"
    " ELSE ' You cover every one of the most requested skills.' END"
    " || ' Your fit with the ' || role || ' market is ' || fit_score || '%.')"
)
FEEDBACK_PROMPT = _fill(
    rules.FEEDBACK_PROMPT,
    role_name=_fill(rules.FEEDBACK_ROLE_FORMAT, role="role", level="level"),
    matched="matched_comma",
    missing="missing_comma",
    fit_score="fit_score",
)


def _gaps(kind):
    """Lists and fit score of each CV, from its rows of (cv_id, pos, skill, has)."""
    lists = ", ".join(
        f"coalesce(string_agg(skill, '{sep}' ORDER BY pos) FILTER (WHERE {cond}), '') AS {name}"
        for cond, sep, name in [
            ("has", " | ", "matched_skills"),
            ("NOT has", " | ", "missing_skills"),
            ("has", ", ", "matched_comma"),
            ("NOT has", ", ", "missing_comma"),
            ("has", "\n- ", "matched_lines"),
            ("NOT has", "\n- ", "missing_lines"),
        ]
    )
    return f"""SELECT g.*, CAST(CASE WHEN n_listed > 0
            THEN round_even(n_matched::DOUBLE / n_listed::DOUBLE * 100, 0) ELSE 0 END AS BIGINT) AS fit_score
        FROM (SELECT c.cv_id, c.cv_name, c.source_field, c.role, c.level, c.relevant_jobs, c.slice_level,
                     listed.n_listed, count(*) FILTER (WHERE has) AS n_matched,
                     count(*) FILTER (WHERE NOT has) AS n_missing, {lists}
              FROM {kind}_flags JOIN {kind}_sliced c USING (cv_id)
              LEFT JOIN listed ON listed.role = c.role AND listed.level = c.slice_level
              GROUP BY ALL) g"""


PARTS = {
    "skill_dim": f"SELECT * FROM (VALUES {_values(SKILLS)}) AS t(i, s)",
    "title_dim": f"SELECT * FROM (VALUES {_values(TITLES)}) AS t(i, s)",
    "nums": "SELECT * FROM (VALUES (0),(1),(2),(3),(4),(5)) AS t(j)",
    "req": "SELECT l_orderkey AS k, string_agg(d.s, ', ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS v"
    " FROM lineitem JOIN skill_dim d ON d.i = l_partkey % 40 GROUP BY l_orderkey",
    "pref": "SELECT l_orderkey AS k, string_agg(d.s, ',' ORDER BY l_linenumber, l_suppkey, l_partkey) AS v"
    " FROM lineitem JOIN skill_dim d ON d.i = (l_suppkey * 3) % 40 GROUP BY l_orderkey",
    "jobs": """SELECT o_orderkey AS job_ord,
        concat(CASE o_orderpriority WHEN '1-URGENT' THEN 'Senior ' WHEN '2-HIGH' THEN 'Junior '
               WHEN '3-MEDIUM' THEN 'Mid-level ' ELSE '' END, t.s) AS job_title,
        CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN ' Senior ' WHEN '5-LOW' THEN 'Lead' ELSE NULL END AS seniority_level,
        req.v AS required_skills, pref.v AS preferred_skills,
        CASE WHEN o_custkey % 17 = 0 THEN NULL
             ELSE concat(' Company ', CAST(o_custkey % 400 AS VARCHAR), ' ') END AS company_name,
        concat('jobs_', CAST(year(o_orderdate) AS VARCHAR), '.xlsx') AS source_file, o_custkey AS applicant_id
        FROM orders JOIN title_dim t ON t.i = CASE WHEN o_orderkey % 13 IN (8, 9)
            OR (o_orderkey % 13 IN (10, 11) AND o_orderpriority = '2-HIGH') THEN 12 ELSE o_orderkey % 13 END
        LEFT JOIN req ON req.k = o_orderkey LEFT JOIN pref ON pref.k = o_orderkey""",
    "cv_skill": "SELECT doc_id AS k, string_agg(d.s, ', ' ORDER BY j) AS v FROM documents CROSS JOIN nums"
    " JOIN skill_dim d ON d.i = (doc_id * 7 + j * j * 3) % 40 WHERE j <= doc_id % 7 GROUP BY doc_id",
    "cv_texts": """SELECT doc_id AS cv_id, concat('cv_', CAST(doc_id AS VARCHAR)) AS cv_name,
        concat(text, ' Skills: ', v, CASE doc_id % 5 WHEN 0 THEN '. Senior staff' WHEN 1 THEN '. 3+ years'
               WHEN 2 THEN '. 6 years' WHEN 3 THEN '. 1 year' ELSE '' END) AS cv_text
        FROM documents JOIN cv_skill ON k = doc_id""",
    "cust_skill": "SELECT c_custkey AS k, string_agg(d.s, ', ' ORDER BY j) AS v FROM customer CROSS JOIN nums"
    " JOIN skill_dim d ON d.i = (c_custkey * 11 + j * j * 3) % 40 WHERE j <= c_custkey % 7 GROUP BY c_custkey",
    "cvs": """SELECT c_custkey AS cv_id, c_name AS full_name, t.s AS primary_field, v AS technical_skills,
        CASE c_custkey % 6 WHEN 0 THEN '2 years support, 10+years dev' WHEN 1 THEN '3.5 years' WHEN 2 THEN '2 Years'
             WHEN 3 THEN 'graduate' WHEN 4 THEN '1-4 years' ELSE NULL END AS experience
        FROM customer JOIN title_dim t ON t.i = c_custkey % 13 JOIN cust_skill ON k = c_custkey""",
    # -- postings classified, their skills as rows, the market
    "jobs_c": f"""SELECT *, {_title_role("lower(coalesce(job_title, ''))")} AS role,
        CASE WHEN contains(lower(job_title), 'senior') THEN 'senior' WHEN contains(lower(job_title), 'junior') THEN 'junior'
             WHEN contains(lower(job_title), 'mid') THEN 'mid'
             WHEN lower(trim(seniority_level)) IN ('junior', 'mid', 'senior') THEN lower(trim(seniority_level))
             ELSE 'mid' END AS level FROM jobs""",
    "job_skills": """SELECT job_ord, applicant_id, role, level, pos, trim(item) AS skill FROM (
        SELECT job_ord, applicant_id, role, level, unnest(string_split(required_skills, ',')) AS item,
               generate_subscripts(string_split(required_skills, ','), 1) AS pos FROM jobs_c) WHERE trim(item) <> ''""",
    "pref_skills": """SELECT job_ord, applicant_id, pos, trim(item) AS skill FROM (
        SELECT job_ord, applicant_id, unnest(string_split(preferred_skills, ',')) AS item,
               generate_subscripts(string_split(preferred_skills, ','), 1) AS pos FROM jobs_c) WHERE trim(item) <> ''""",
    "totals": """SELECT role, level, count(*) AS total_jobs FROM jobs_c GROUP BY role, level
        UNION ALL SELECT role, 'all', count(*) FROM jobs_c GROUP BY role""",
    "counts": """SELECT role, level, skill, count(*) AS demand_count, min(job_ord * 10000 + pos) AS seen
        FROM (SELECT role, level, skill, job_ord, pos FROM job_skills
              UNION ALL SELECT role, 'all', skill, job_ord, pos FROM job_skills) GROUP BY role, level, skill""",
    "top": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role, level ORDER BY demand_count DESC, seen) AS rank
        FROM counts) WHERE rank <= 20""",
    "market": """SELECT *, CASE WHEN demand_pct >= 70 THEN 'high' WHEN demand_pct >= 30 THEN 'medium' ELSE 'low' END AS bucket
        FROM (SELECT role, level, rank, skill, demand_count, total_jobs,
                     round_even(demand_count::DOUBLE / total_jobs::DOUBLE * 100, 1) AS demand_pct
              FROM top JOIN totals USING (role, level))""",
    "firms": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role, level ORDER BY company) AS rank FROM (
        SELECT DISTINCT role, level, trim(company_name) AS company FROM
          (SELECT role, level, company_name FROM jobs_c UNION ALL SELECT role, 'all', company_name FROM jobs_c)
        WHERE trim(company_name) <> '')) WHERE rank <= 20""",
    "buckets": """SELECT role, level, """
    + ", ".join(
        f"coalesce(string_agg(skill || ' (' || demand_pct || '%)', '{sep}' ORDER BY rank)"
        f" FILTER (WHERE bucket = '{b}'), '') AS {b}_{name}"
        for b in ("high", "medium", "low")
        for sep, name in ((" | ", "demand"), ("\n- ", "lines"))
    )
    + " FROM market GROUP BY role, level",
    "firm_lists": "SELECT role, level, string_agg(company, ' | ' ORDER BY company) AS companies,"
    " string_agg(company, ', ' ORDER BY company) AS companies_comma FROM firms GROUP BY role, level",
    "entries": """SELECT role, level, lower(skill) AS name, min(rank) AS pos, arg_max(skill, rank) AS skill
        FROM top GROUP BY role, level, lower(skill)""",
    "listed": "SELECT role, level, count(*) AS n_listed FROM top GROUP BY role, level",
    # -- CVs classified and given their slice
    "text_low": "SELECT cv_id, cv_name, cv_text, lower(cv_text) AS t FROM cv_texts",
    "text_scores": "SELECT cv_id, cv_name, cv_text, t, "
    + ", ".join(f"{_score('t', words)} AS s{i}" for i, words in enumerate(rules.KEYWORD_RULES.values()))
    + f", coalesce({YEARS.format('t')}, 0) AS years FROM text_low",
    "text_c": "SELECT *, 'Extracted from uploaded CV text' AS source_field,"
    " CASE WHEN greatest(s0, s1, s2, s3, s4, s5) = 0 THEN 'unknown' "
    + " ".join(
        f"WHEN s{i} = greatest(s0, s1, s2, s3, s4, s5) THEN '{role}'" for i, role in enumerate(rules.KEYWORD_RULES)
    )
    + """ END AS role, CASE WHEN contains(t, 'senior') OR years >= 5 THEN 'senior'
        WHEN contains(t, 'mid') OR years >= 2 THEN 'mid' ELSE 'junior' END AS level,
        coalesce(length(regexp_replace(cv_text, '^\\s+|\\s+$', '', 'g')) >= 200
                 AND length(regexp_replace(cv_text, '[^\\p{L}]', '', 'g')) > 100, false) AS is_valid FROM text_scores""",
    "table_c": f"""SELECT cv_id, full_name AS cv_name, coalesce(primary_field, '') AS source_field, technical_skills, years,
        {_title_role("lower(coalesce(primary_field, ''))")} AS role,
        CASE WHEN years >= 5 THEN 'senior' WHEN years >= 2 THEN 'mid' ELSE 'junior' END AS level
        FROM (SELECT *, coalesce({YEARS.format("lower(experience)")}, 0) AS years FROM cvs)""",
    "text_sliced": """SELECT c.*, CASE WHEN own.total_jobs IS NULL THEN 'all' ELSE c.level END AS slice_level,
        coalesce(own.total_jobs, whole.total_jobs) AS relevant_jobs
        FROM text_c c JOIN totals whole ON whole.role = c.role AND whole.level = 'all'
        LEFT JOIN totals own ON own.role = c.role AND own.level = c.level""",
    "table_sliced": """SELECT c.*, CASE WHEN own.total_jobs IS NULL THEN 'all' ELSE c.level END AS slice_level,
        coalesce(own.total_jobs, whole.total_jobs) AS relevant_jobs
        FROM table_c c JOIN totals whole ON whole.role = c.role AND whole.level = 'all'
        LEFT JOIN totals own ON own.role = c.role AND own.level = c.level""",
    "text_flags": """SELECT c.cv_id, e.pos, e.skill, contains(c.t, e.name) AS has
        FROM text_sliced c JOIN entries e ON e.role = c.role AND e.level = c.slice_level""",
    "user_skills": """SELECT DISTINCT cv_id, lower(trim(item)) AS name
        FROM (SELECT cv_id, unnest(string_split(technical_skills, ',')) AS item FROM cvs) WHERE trim(item) <> ''""",
    "table_flags": """SELECT c.cv_id, e.pos, e.skill, u.name IS NOT NULL AS has
        FROM table_sliced c JOIN entries e ON e.role = c.role AND e.level = c.slice_level
        LEFT JOIN user_skills u ON u.cv_id = c.cv_id AND u.name = e.name""",
    "text_gaps": f"SELECT *, {LABEL} AS alignment_label, {SUMMARY} AS similarity_summary FROM ({_gaps('text')})",
    "table_gaps": f"SELECT *, {LABEL} AS alignment_label, {SUMMARY} AS similarity_summary FROM ({_gaps('table')})",
}
_FEEDBACK_OF_G = DEFAULT_FEEDBACK.replace("|| role ||", "|| g.role ||")
# The record of a CV joins its gap with its slice's companies and demand items.
for _kind in ("text", "table"):
    PARTS[f"{_kind}_results"] = f"""SELECT g.cv_id, g.cv_name AS cv_file, g.source_field, g.role AS detected_field,
        g.level AS estimated_level, g.relevant_jobs, f.companies, f.companies_comma, b.high_demand, b.medium_demand,
        b.low_demand, b.high_lines, b.medium_lines, b.low_lines, g.matched_skills, g.missing_skills, g.matched_lines,
        g.missing_lines, g.fit_score, g.alignment_label, g.similarity_summary, {_FEEDBACK_OF_G} AS feedback
        FROM {_kind}_gaps g JOIN firm_lists f ON f.role = g.role AND f.level = g.slice_level
        JOIN buckets b ON b.role = g.role AND b.level = g.slice_level"""


def _needed(sql, seen):
    """Names of the parts a statement uses, directly or through others, in the order of ``PARTS``."""
    import re

    for name in PARTS:
        if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            seen.add(name)
            _needed(PARTS[name], seen)
    return [name for name in PARTS if name in seen]


def _sql(select):
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name]})" for name in _needed(select, set()))
    return f"WITH {ctes}\n{select}" if ctes else select


def _lines(title, column):
    return f"{_quoted(chr(10) + title)} || CASE WHEN {column} <> '' THEN '\n- ' || {column} ELSE '' END"


REPORT = " || '\n' || ".join(
    [_quoted("\n" + rules.REPORT_TITLE + "\n")]
    + [f"{_quoted(label)} || {column}" for label, column in rules.REPORT_FACTS]
    + [f"{_quoted(chr(10) + rules.REPORT_COMPANIES)}", "companies_comma", _quoted("\n" + rules.REPORT_DEMAND)]
    + [
        _lines(title, column)
        for (title, _), column in zip(
            rules.REPORT_LISTS_DEMAND + rules.REPORT_LISTS_SKILLS,
            ["high_lines", "medium_lines", "low_lines", "matched_lines", "missing_lines"],
        )
    ]
    + [f"{_quoted(chr(10) + rules.REPORT_FIT)} || fit_score || '%'", f"{_quoted(rules.REPORT_LABEL)} || alignment_label"]
    + [_quoted("\n" + rules.REPORT_SIMILARITY), "similarity_summary"]
    + [_quoted("\n" + rules.REPORT_FEEDBACK), "feedback"]
)
GAP = (
    "SELECT cv_id, role, level, relevant_jobs, matched_skills, missing_skills, fit_score, alignment_label FROM {}_gaps"
)
RECORD = (
    "SELECT cv_file, source_field, detected_field, estimated_level, relevant_jobs, companies, high_demand,"
    " medium_demand, low_demand, matched_skills, missing_skills, fit_score, alignment_label, similarity_summary,"
    " feedback FROM text_results"
)


def _pair_side(skills, name):
    """Matched and missing lists of one list of each posting against its applicant's skills."""
    return f"""{name} AS MATERIALIZED (SELECT job_ord, count(*) AS n, sum(listed) AS n_listed,
        coalesce(string_agg(skill, ' | ' ORDER BY pos) FILTER (WHERE has), '') AS yes,
        coalesce(string_agg(skill, ' | ' ORDER BY pos) FILTER (WHERE NOT has), '') AS no,
        count(*) FILTER (WHERE has) AS n_yes FROM (
          SELECT e.*, u.name IS NOT NULL AS has FROM (
            SELECT job_ord, applicant_id, lower(skill) AS name, min(pos) AS pos, arg_max(skill, pos) AS skill,
                   count(*) AS listed FROM {skills} GROUP BY ALL) e
          LEFT JOIN user_skills u ON u.cv_id = e.applicant_id AND u.name = e.name) GROUP BY job_ord)"""


def _pairs():
    parts = _needed("FROM job_skills JOIN pref_skills JOIN user_skills", set())
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name]})" for name in parts)
    return f"""WITH {ctes}, {_pair_side("job_skills", "r")}, {_pair_side("pref_skills", "p")}
        SELECT cvs.cv_id, j.job_ord, coalesce(r.yes, '') AS matched_skills, coalesce(r.no, '') AS missing_skills,
        CAST(coalesce(round_even(r.n_yes::DOUBLE / r.n_listed::DOUBLE * 100, 0), 0) AS BIGINT) AS fit_score,
        coalesce(p.yes, '') AS matched_preferred, coalesce(p.no, '') AS missing_preferred
        FROM jobs_c j JOIN cvs ON cvs.cv_id = j.applicant_id
        LEFT JOIN r ON r.job_ord = j.job_ord LEFT JOIN p ON p.job_ord = j.job_ord"""


def _split(column):
    return f"list_filter(list_transform(string_split(coalesce({column}, ''), ','), lambda x: trim(x)), lambda x: x <> '')"


def _statements():
    out = {
        "market_top_skills": "SELECT role, level, rank, skill, demand_count, total_jobs, demand_pct, bucket FROM market",
        "job_scan": "SELECT job_ord, job_title, seniority_level, required_skills, preferred_skills, company_name,"
        " source_file FROM jobs",
        "job_role_level": "SELECT job_ord, role, level FROM jobs_c",
        "job_slice_filter": "SELECT job_ord, job_title, seniority_level FROM jobs_c"
        " WHERE role = 'data engineer' AND level = 'senior'",
        "jobs_per_role_level": "SELECT role, level, total_jobs FROM totals",
        "posting_skill_lists": f"""SELECT job_ord, CAST(len({_split("required_skills")}) AS BIGINT) AS n_required,
            array_to_string({_split("required_skills")}, ' | ') AS required,
            lower(array_to_string({_split("required_skills")}, ' | ')) AS required_normalized,
            array_to_string({_split("preferred_skills")}, ' | ') AS preferred FROM jobs""",
        "skill_vocabulary": "SELECT DISTINCT skill, lower(skill) AS sort_key FROM"
        " (SELECT skill FROM job_skills UNION ALL SELECT skill FROM pref_skills)",
        "hiring_companies": "SELECT role, level, rank, company FROM firms",
        "demand_buckets": "SELECT role, level, high_demand, medium_demand, low_demand FROM buckets",
        "union_by_name": """SELECT row_number() OVER (ORDER BY source_file, job_ord) - 1 AS job_ord, job_ord AS row_key,
            source_file, job_title, CASE WHEN early THEN seniority_level END AS seniority_level,
            CASE WHEN NOT early THEN preferred_skills END AS preferred_skills,
            CASE WHEN early THEN company_name END AS company_name
            FROM (SELECT *, source_file < 'jobs_1995.xlsx' AS early FROM jobs)""",
        "first_row_profile": "SELECT count(*) OVER () AS row_count, job_ord, job_title, seniority_level, required_skills,"
        " preferred_skills, company_name, source_file FROM jobs ORDER BY job_ord LIMIT 1",
        "first_row": "SELECT * FROM cvs ORDER BY cv_id LIMIT 1",
        "random_row": "SELECT * FROM cvs ORDER BY md5('7|' || CAST(cv_id AS VARCHAR)), cv_id LIMIT 1",
        "latest_document": """SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders
            QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY orders.o_orderdate DESC, o_orderkey DESC) = 1""",
        "latest_text": "SELECT cv_id, cv_name, cv_text FROM cv_texts ORDER BY cv_id DESC LIMIT 1",
        "text_validity": r"""SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters,
            length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 200
            AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 100 AS is_valid FROM documents""",
        "cv_role_from_text": "SELECT cv_id, role, "
        + ", ".join(
            f"CAST(s{i} AS BIGINT) AS score_{role.replace(' ', '_')}" for i, role in enumerate(rules.KEYWORD_RULES)
        )
        + " FROM text_c",
        "cv_role_by_rule_table": "SELECT cv_id, role FROM text_c",
        "title_role_by_rule_table": "SELECT job_ord, role FROM jobs_c",
        "cv_role_by_many_rules": """SELECT c.cv_id, coalesce(role, 'unknown') AS role FROM cv_texts c LEFT JOIN (
            SELECT cv_id, role, count(DISTINCT k) AS n FROM (SELECT cv_id, lower(cv_text) AS t FROM cv_texts) JOIN (
                SELECT lower(s) AS k, 'group ' || left(md5(s), 2) AS role FROM (
                    SELECT DISTINCT unnest(string_split_regex(text, '[ \n]')) AS s FROM documents) WHERE length(s) >= 10)
            ON contains(t, k) GROUP BY cv_id, role QUALIFY row_number() OVER (PARTITION BY cv_id ORDER BY n DESC, role) = 1
            ) b ON b.cv_id = c.cv_id""",
        "cv_level_from_text": "SELECT cv_id, CAST(years AS BIGINT) AS max_years, level FROM text_c",
        "cv_level_from_experience": "SELECT cv_id, CAST(years AS BIGINT) AS max_years, level FROM table_c",
        "cv_role_from_field": "SELECT cv_id, source_field AS primary_field, role FROM table_c",
        "cv_scan": "SELECT cv_id, full_name, primary_field, technical_skills, '' AS experience FROM cvs",
        "cv_skills": """SELECT cv_id, count(skill) AS n_skills,
            coalesce(string_agg(skill, ' | ' ORDER BY lower(skill), skill), '') AS skills FROM text_low LEFT JOIN
            (SELECT skill FROM job_skills UNION SELECT skill FROM pref_skills) v ON contains(t, lower(skill)) GROUP BY cv_id""",
        "cv_rejects": f"""SELECT cv_id, role, level, CASE WHEN NOT is_valid THEN {REASON_TEXT} ELSE {REASON_ROLE} END
            AS reject_reason FROM text_c WHERE NOT is_valid OR role NOT IN (SELECT role FROM totals)""",
        "cv_without_market": f"SELECT cv_id, role, level, {REASON_ROLE} AS reject_reason FROM table_c"
        " WHERE role NOT IN (SELECT role FROM totals)",
        "cv_market_slice": "SELECT cv_id, role, level, relevant_jobs, slice_level = 'all' AS used_fallback FROM text_sliced",
        "skill_gap": GAP.format("text"),
        "skill_gap_table_cv": GAP.format("table"),
        "skill_membership": """SELECT cv_id, role, level,
            row_number() OVER (PARTITION BY cv_id ORDER BY pos) - 1 AS pos, skill, has
            FROM table_flags JOIN (SELECT cv_id, role, level FROM table_c) USING (cv_id)""",
        "fit_labels": "SELECT cv_id, fit_score, alignment_label, similarity_summary FROM table_gaps",
        "skill_gap_report": RECORD,
        "web_view": f"SELECT {', '.join(rules.WEB_VIEW)} FROM text_results",
        "text_report": f"SELECT cv_file, {REPORT} AS report FROM table_results",
        "gap_by_role": "SELECT role, level, skill, count(*) AS cvs_missing FROM text_flags"
        " JOIN (SELECT cv_id, role, level FROM text_c) USING (cv_id) WHERE NOT has GROUP BY role, level, skill",
        "feedback_prompt": f"SELECT cv_id, {FEEDBACK_PROMPT} AS prompt FROM text_gaps",
        "pair_prompt": "SELECT cv_id, job_ord, "
        + _fill(rules.SKILL_PAIR_PROMPT, cv_skills="technical_skills", job_skills="required_skills")
        + " AS prompt FROM cvs JOIN jobs ON applicant_id = cv_id",
        "text_pair_prompt": "SELECT cv_id, job_ord, "
        + _fill(
            rules.TEXT_PAIR_PROMPT,
            cv_text="cv_text",
            role="job_title",
            required=f"array_to_string({_split('required_skills')}, ', ')",
            preferred=f"array_to_string({_split('preferred_skills')}, ', ')",
        )
        + " AS prompt FROM cv_texts LEFT JOIN (SELECT * FROM jobs QUALIFY row_number() OVER"
        " (PARTITION BY applicant_id ORDER BY job_ord DESC) = 1) ON applicant_id = cv_id % (SELECT count(*) FROM customer)",
        "cv_skills_large_vocabulary": """SELECT c.cv_id, count(w.s) AS n_skills,
            md5(coalesce(string_agg(w.s, ' | ' ORDER BY lower(w.s), w.s), '')) AS md5
            FROM (SELECT cv_id, lower(cv_text) AS t FROM cv_texts) c LEFT JOIN (SELECT s, lower(s) AS l
                FROM (SELECT DISTINCT unnest(string_split_regex(text, '[ \\n]')) AS s FROM documents) WHERE s <> '') w
            ON contains(c.t, w.l) GROUP BY c.cv_id""",
        "read_folder": "SELECT doc_id, 'documents.parquet' AS source_file FROM documents",
        "read_postings": """SELECT row_number() OVER (ORDER BY job_ord % 3 <> 0, job_ord) - 1 AS job_ord, job_title,
            seniority_level, required_skills, CASE WHEN job_ord % 3 <> 0 THEN preferred_skills END AS preferred_skills,
            company_name FROM jobs""",
        "posting_ledger": """SELECT row_number() OVER (ORDER BY job_ord % 3, job_ord) - 1 AS job_ord, job_title,
            seniority_level, required_skills, company_name FROM jobs WHERE job_ord % 3 <> 2""",
        "read_cvs": "SELECT cv_id, full_name, primary_field, technical_skills, '' AS experience FROM cvs",
        "text_files": "SELECT md5(t) AS md5, length(t) AS n_chars"
        " FROM (SELECT replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10) AS t FROM documents)",
        "file_intake": f"""SELECT cv_id, cv_name || '.v1' AS cv_name,
            CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason AS reject_reason
            FROM (SELECT cv_id, cv_name, CASE WHEN cv_id % 3 = 2 THEN {_quoted(rules.REASON_BAD_FILE)}
                  WHEN NOT is_valid THEN {REASON_TEXT}
                  WHEN role NOT IN (SELECT role FROM totals) THEN {REASON_ROLE} END AS reason FROM text_c)""",
        "upload_rejects": f"SELECT known_id AS cv_id, name AS cv_name, reason AS reject_reason FROM ({UPLOADED}) WHERE reason IS NOT NULL",
        "upload_stream": f"""SELECT known_id AS cv_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status,
            reason AS reject_reason, CASE WHEN reason IS NULL THEN fit_score END AS fit_score
            FROM ({UPLOADED}) c LEFT JOIN text_gaps g ON g.cv_id = c.cv_id""",
        "market_refresh": """SELECT w.role, l.level, coalesce(own.total_jobs, w.total_jobs) AS relevant_jobs,
            own.total_jobs IS NULL AS used_fallback FROM totals w
            CROSS JOIN (VALUES ('junior'), ('mid'), ('senior')) l(level)
            LEFT JOIN totals own ON own.role = w.role AND own.level = l.level WHERE w.level = 'all'""",
        "best_postings": """SELECT cv_id, job_ord, rank, n_matched, n_listed,
            CAST(round_even(n_matched::DOUBLE / n_listed::DOUBLE * 100, 0) AS BIGINT) AS fit_score
            FROM (SELECT c.cv_id, n.job_ord, n_matched, n_listed, row_number() OVER (PARTITION BY c.cv_id
                         ORDER BY n_matched::DOUBLE / n_listed::DOUBLE DESC, n_matched DESC, n.job_ord) AS rank
                  FROM table_c c JOIN (SELECT u.cv_id, s.role, s.job_ord, count(DISTINCT u.name) AS n_matched
                                       FROM user_skills u JOIN job_skills s ON lower(s.skill) = u.name GROUP BY ALL) m
                    ON m.cv_id = c.cv_id AND m.role = c.role
                  JOIN (SELECT job_ord, count(*) AS n_listed FROM job_skills GROUP BY job_ord) n ON n.job_ord = m.job_ord)
            WHERE rank <= 5""",
        "market_stream": """SELECT s.role, s.level, s.relevant_jobs, s.slice_level = 'all' AS used_fallback,
            d.demand, coalesce(f.companies, '') AS companies
            FROM (SELECT w.role, l.level, coalesce(own.total_jobs, w.total_jobs) AS relevant_jobs,
                         CASE WHEN own.total_jobs IS NULL THEN 'all' ELSE l.level END AS slice_level FROM totals w
                  CROSS JOIN (VALUES ('junior'), ('mid'), ('senior')) l(level)
                  LEFT JOIN totals own ON own.role = w.role AND own.level = l.level WHERE w.level = 'all') s
            JOIN (SELECT role, level, string_agg(skill || ' (' || demand_pct || '%)', ' | ' ORDER BY rank) AS demand
                  FROM market GROUP BY role, level) d ON d.role = s.role AND d.level = s.slice_level
            LEFT JOIN firm_lists f ON f.role = s.role AND f.level = s.slice_level""",
        "feedback_clean": "SELECT conv_id, turn, "
        + _clean("('The ' || role || ', a candidate among users, wrote: ' || text)")
        + " AS cleaned FROM conversations",
        "cv_feedback": f"SELECT cv_id, {DEFAULT_FEEDBACK} AS feedback FROM table_gaps",
        "model_feedback": f"""SELECT cv_id, CASE WHEN n % 7 = 0 THEN 'Model error: {{''error'': ''busy''}}'
            ELSE 'You sent ' || n || ' characters.' END AS feedback
            FROM (SELECT cv_id, length({FEEDBACK_PROMPT}) AS n FROM table_gaps)""",
        "kept_feedback": f"""SELECT cv_id, 'You sent ' || length({FEEDBACK_PROMPT}) || ' characters.' AS feedback
            FROM table_gaps""",
        "model_report": f"""SELECT cv_name AS cv_file, fit_score, CASE WHEN n % 11 = 0 THEN 'Model error: no answer'
            WHEN n % 7 = 0 THEN 'Model error: {{''error'': ''busy''}}'
            ELSE 'You sent ' || n || ' characters.' END AS feedback
            FROM (SELECT cv_name, fit_score, length({FEEDBACK_PROMPT}) AS n FROM table_gaps)""",
        "model_answer_parse": """SELECT cv_id, ok AS is_valid, CASE WHEN ok THEN matched_skills END AS matched_skills,
            CASE WHEN ok THEN missing_skills END AS missing_skills, CASE WHEN ok THEN fit_score END AS fit_score,
            CASE WHEN ok THEN alignment_label END AS feedback
            FROM (SELECT *, cv_id % 5 NOT IN (0, 1) AS ok FROM table_gaps)""",
        "stream_scoring": f"""SELECT c.cv_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status,
            reason AS reject_reason, CASE WHEN reason IS NULL THEN c.role END AS detected_field,
            CASE WHEN reason IS NULL THEN c.level END AS estimated_level,
            CASE WHEN reason IS NULL THEN fit_score END AS fit_score,
            CASE WHEN reason IS NULL THEN matched_skills END AS matched_skills,
            CASE WHEN reason IS NULL THEN missing_skills END AS missing_skills
            FROM (SELECT cv_id, role, level, CASE WHEN NOT is_valid THEN {REASON_TEXT}
                  WHEN role NOT IN (SELECT role FROM totals) THEN {REASON_ROLE} END AS reason FROM text_c) c
            LEFT JOIN text_gaps g ON g.cv_id = c.cv_id""",
    }
    statements = {name: _sql(select) for name, select in out.items()}
    statements["pair_compare"] = _pairs()
    statements["durable_feedback"] = statements["model_feedback"]
    statements["latest_stream"] = statements["latest_document"]
    return statements


STATEMENTS = _statements()
