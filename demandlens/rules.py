"""Fixed values of the domain: rules, cut-offs and text formats, kept as plain data.

Nothing here computes anything.  Every table is small by nature (six roles, three levels), so
rule-driven column expressions and the market lookup built from them have a known size bound.
"""

# ---- Fixed values: roles, recognised in a title or field; first role listed wins ----------------
TITLE_RULES = {
    "backend": ["backend", "software engineer (backend)", "backend developer"],
    "frontend": ["frontend", "frontend developer", "ui developer"],
    "data analyst": ["data analyst", "analytics", "bi analyst"],
    "data engineer": ["data engineer", "etl engineer"],
    "devops": ["devops", "platform engineer", "site reliability"],
    "ml engineer": ["ml engineer", "machine learning engineer", "ai engineer"],
}

# ---- Fixed values: keywords scored in free text; ties go to the role listed first ---------------
KEYWORD_RULES = {
    "backend": ["spring boot", "java", "rest api", "microservices", "backend"],
    "frontend": ["react", "javascript", "html", "css", "next.js", "frontend"],
    "data analyst": ["power bi", "tableau", "data analysis", "excel", "sql", "analytics"],
    "data engineer": ["etl", "airflow", "data pipeline", "spark", "snowflake", "redshift"],
    "devops": ["kubernetes", "docker", "terraform", "jenkins", "devops", "ci/cd"],
    "ml engineer": ["machine learning", "scikit-learn", "pytorch", "tensorflow", "model evaluation"],
}

UNKNOWN_ROLE = "unknown"

# ---- Fixed values: levels and the years of experience they start at -----------------------------
LEVELS = ["junior", "mid", "senior"]
MID_YEARS = 2
SENIOR_YEARS = 5
# A number of years; (?U) plus the four separators makes white space mean what it does in Python.
YEARS_PATTERN = r"(?U)([0-9]+)\+?[\s\x1c-\x1f]*years?"
# Stands for a digit run too long for an int: senior by any reading.
OVERFLOW_YEARS = 99

# ---- Fixed values: text gate --------------------------------------------------------------------
MIN_TEXT_CHARS = 200
MIN_LETTERS_EXCLUSIVE = 100
# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Any of them but the plain space.
ODD_SPACE_PATTERN = r"[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# ---- Fixed values: report sizes, demand buckets, alignment cut-offs -----------------------------
TOP_K = 20
HIGH_DEMAND_PCT = 70
MEDIUM_DEMAND_PCT = 30
ALIGNMENT_LABELS = [
    (70, "Strong Alignment"),
    (40, "Moderate Alignment"),
    (20, "Weak Alignment"),
    (None, "Very Low Alignment"),
]
SIMILARITY_SUMMARIES = [
    (70, "Your CV is strongly aligned with the current {role} market profile."),
    (40, "Your CV is moderately aligned with the current {role} market profile."),
    (20, "Your CV has limited alignment with the current {role} market profile."),
    (
        None,
        "Your CV is currently not very similar to the skills employers are expecting in the {role} market.",
    ),
]
TEXT_SOURCE_FIELD = "Extracted from uploaded CV text"

# ---- Fixed values: reasons for turning an input away --------------------------------------------
REASON_BAD_FILE = "Please upload a valid PDF file."
REASON_UNREADABLE = "The uploaded PDF could not be processed properly. Please upload a clearer PDF."
REASON_FAILED = "Processing failed. Please upload a clearer or different PDF."
REASON_NO_JOBS = "No matching jobs found for detected role."

# ---- Fixed values: wording clean-up of feedback, applied in this order --------------------------
FEEDBACK_REPLACEMENTS = [
    ("The candidate", "You"),
    ("candidate", "you"),
    ("Candidate", "You"),
    ("The applicant", "You"),
    ("applicant", "you"),
    ("The user", "You"),
    ("user", "you"),
]
MODEL_ERROR_PREFIX = "Model error: "

# ---- Fixed values: prompt formats; {name} marks a column ----------------------------------------
FEEDBACK_ROLE_FORMAT = "{role} ({level}) market demand summary"
FEEDBACK_PROMPT = """
You are a skill gap analysis assistant.

Write a short, clear summary for the user.

Role:
{role_name}

Skills already present:
{matched}

Skills missing or weaker:
{missing}

Fit score:
{fit_score}%

Strict rules:
- speak directly to the user using only "you" and "your"
- never use the words "candidate", "applicant", or "person"
- do not rename, reword, correct, shorten, or invent any skill names
- only mention skills exactly as written above
- mention strengths first, then the main missing areas
- keep it short, practical, and professional
- return plain text only
- no markdown
"""
SKILL_PAIR_PROMPT = """
You are a skill gap analysis system.

Compare the user's skills against current market demand for this role.

User Skills:
{cv_skills}

Role Market Skills:
{job_skills}

Return valid JSON only:
{{
  "matched_skills": [],
  "missing_skills": [],
  "fit_score": 0,
  "feedback": ""
}}

Rules:
- fit_score must be from 0 to 100
- feedback must speak directly to the user using "you" and "your"
- do not use words like "candidate"
- keep feedback clear, short, and practical
- only return valid JSON
"""
TEXT_PAIR_PROMPT = """
You are a skill comparison system.

CV TEXT:
{cv_text}

JOB ROLE:
{role}

REQUIRED SKILLS:
{required}

PREFERRED SKILLS:
{preferred}

Return JSON only:

{{
"matched_skills": [],
"missing_skills": [],
"fit_score": 0,
"feedback": ""
}}
"""

# ---- Fixed values: headings of the plain-text report --------------------------------------------
REPORT_TITLE = "========== SKILL GAP SUMMARY =========="
REPORT_FACTS = [
    ("CV File: ", "cv_file"),
    ("Current / Source Field from CV: ", "source_field"),
    ("Detected Comparison Field: ", "detected_field"),
    ("Estimated Level: ", "estimated_level"),
    ("Relevant Jobs Analysed in This Field: ", "relevant_jobs"),
]
REPORT_COMPANIES = "Companies actively hiring for this profile:"
REPORT_DEMAND = "MARKET DEMAND OVERVIEW:"
REPORT_LISTS_DEMAND = [
    ("High-demand skills:", "high_demand"),
    ("Medium-demand skills:", "medium_demand"),
    ("Low-demand / niche skills:", "low_demand"),
]
REPORT_LISTS_SKILLS = [
    ("SKILLS YOU ALREADY HAVE:", "matched_skills"),
    ("SKILLS YOU MAY NEED TO IMPROVE OR ADD:", "missing_skills"),
]
REPORT_FIT = "OVERALL FIT SCORE: "
REPORT_LABEL = "ROLE ALIGNMENT: "
REPORT_SIMILARITY = "SIMILARITY SUMMARY:"
REPORT_FEEDBACK = "WHAT THIS MEANS FOR YOU:"

# ---- Fixed values: the fields a web page shows of the result record -----------------------------
WEB_VIEW = [
    "detected_field",
    "estimated_level",
    "relevant_jobs",
    "fit_score",
    "alignment_label",
    "similarity_summary",
    "companies",
    "matched_skills",
    "missing_skills",
    "feedback",
    "cv_file",
]
