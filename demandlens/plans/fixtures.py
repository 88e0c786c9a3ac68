"""Postings and CVs made from the given tables, in the shapes of ``schemas``.

The given tables hold orders, line items, customers and documents.  An order becomes a posting (its line
items its skills), a customer a table CV and a document a text CV.  Everything but the
posting's skill lists is computed row by row; those need one shuffle of the line items, which the
join with the orders reuses.
"""

import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.session import ship

# ---- Fixed values: what the numbers in the tables stand for -------------------------------------
SKILLS = [
    "Python", "SQL", "Java", "JavaScript", "React", "HTML", "CSS", "Docker",
    "Kubernetes", "Terraform", "Jenkins", "AWS", "Azure", "Spark", "Airflow",
    "ETL", "Snowflake", "Redshift", "Power BI", "Tableau", "Excel", "PyTorch",
    "TensorFlow", "scikit-learn", "Git", "Linux", "REST API", "Spring Boot",
    "Microservices", "Next.js", "TypeScript", "MongoDB", "PostgreSQL", "C#",
    "R", "Go", "sql", "python", "CI/CD", "Machine Learning",
]
TITLES = [
    "Software Engineer (Backend)", "Backend Developer", "Frontend Developer", "UI Developer",
    "Data Analyst", "BI Analyst", "Data Engineer", "ETL Engineer", "DevOps Engineer",
    "Platform Engineer", "ML Engineer", "AI Engineer", "Product Owner",
]
OTHER_TITLE = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread a table of fewer files than ``partitions`` (by default the cores) over so many.  Not for streams."""
    partitions = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= partitions else df.repartition(partitions)


def _nth(values, index: Column) -> Column:
    # Splitting a literal is folded into one array literal when the query is optimized.
    return F.split(F.lit("|".join(values)), "[|]")[index.cast("int")]


def _skill_run(key: Column, step: int) -> Column:
    """One to six skills, picked by a rule from a key."""
    last = F.least(key % 7, F.lit(5)).cast("int")
    picks = F.transform(F.sequence(F.lit(0), last), lambda j: _nth(SKILLS, (key * step + j * j * 3) % 40))
    return F.array_join(picks, ", ")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings, plus ``applicant_id``: the CV that applied to the posting."""
    # Lists cannot be combined before the shuffle, so the line items move as four numbers each.
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, sf_dir, "lineitem").select(*keys).repartition("l_orderkey")
    # The numbers are gathered once for both lists; names come after.
    gathered = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(*keys[1:])).alias("lines"))

    def listed(number, then, skill, separator):
        by = F.transform("lines", lambda x: F.struct(x["l_linenumber"], x[number].alias("number"), x[then].alias("then")))
        names = F.transform(F.sort_array(by), lambda x: _nth(SKILLS, skill(x["number"])))
        # Without any name there is no list.
        return F.nullif(F.array_join(names, separator), F.lit(""))

    lists = gathered.select(
        "l_orderkey",
        listed("l_partkey", "l_suppkey", lambda n: n % 40, ", ").alias("required_skills"),
        listed("l_suppkey", "l_partkey", lambda n: (n * 3) % 40, ",").alias("preferred_skills"),
    )
    priority, title = F.col("o_orderpriority"), F.col("o_orderkey") % 13
    prefix = (
        F.when(priority == "1-URGENT", "Senior ")
        .when(priority == "2-HIGH", "Junior ")
        .when(priority == "3-MEDIUM", "Mid-level ")
        .otherwise("")
    )
    company = F.concat(F.lit(" Company "), (F.col("o_custkey") % 400).cast("string"), F.lit(" "))
    columns = ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"]
    # Nobody hires for devops, nor for junior ML engineers: their orders stand for postings of an unknown role.
    title = F.when(title.isin(8, 9) | (title.isin(10, 11) & (priority == "2-HIGH")), OTHER_TITLE).otherwise(title)
    orders = spread(table(spark, sf_dir, "orders").select(*columns))
    return orders.join(lists, orders.o_orderkey == lists.l_orderkey, "left").select(
        F.col("o_orderkey").alias("job_ord"),
        F.concat(prefix, _nth(TITLES, title)).alias("job_title"),
        F.when(priority == "4-NOT SPECIFIED", " Senior ").when(priority == "5-LOW", "Lead").alias("seniority_level"),
        "required_skills",
        "preferred_skills",
        F.when(F.col("o_custkey") % 17 != 0, company).alias("company_name"),
        F.concat(F.lit("jobs_"), F.year("o_orderdate").cast("string"), F.lit(".xlsx")).alias("source_file"),
        F.col("o_custkey").alias("applicant_id"),
    )


def cv_texts_of(documents: DataFrame) -> DataFrame:
    """Text CVs from documents, a table or a stream."""
    doc_id = F.col("doc_id")
    ending = (
        F.when(doc_id % 5 == 0, ". Senior staff")
        .when(doc_id % 5 == 1, ". 3+ years")
        .when(doc_id % 5 == 2, ". 6 years")
        .when(doc_id % 5 == 3, ". 1 year")
        .otherwise("")
    )
    return documents.select(
        doc_id.alias("cv_id"),
        F.concat(F.lit("cv_"), doc_id.cast("string")).alias("cv_name"),
        F.concat("text", F.lit(" Skills: "), _skill_run(doc_id, 7), ending).alias("cv_text"),
    )


def cv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv_texts_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table CVs."""
    key = F.col("c_custkey")
    experience = (
        F.when(key % 6 == 0, "2 years support, 10+years dev")
        .when(key % 6 == 1, "3.5 years")
        .when(key % 6 == 2, "2 Years")
        .when(key % 6 == 3, "graduate")
        .when(key % 6 == 4, "1-4 years")
    )
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(
        key.alias("cv_id"),
        F.col("c_name").alias("full_name"),
        _nth(TITLES, key % 13).alias("primary_field"),
        _skill_run(key, 11).alias("technical_skills"),
        experience.alias("experience"),
    )


def write_text_files(values: DataFrame, path: str) -> list[str]:
    """The one column's values each as a text file of its own, ended by a line end; the folders that hold them, one for each task.

    An attempt writes to a folder of its own and only those of finished tasks are returned, so one that is repeated
    leaves nothing twice.  A file takes one call to the file system.
    """

    def write(batches):
        local = "://" not in path and not path.startswith("file:")
        where = (fs.LocalFileSystem(), path) if local else fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", path))
        own, n = uuid.uuid4().hex, 0
        where[0].create_dir(f"{where[1]}/{own}", recursive=True)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                with where[0].open_output_stream(f"{where[1]}/{own}/{n}.txt") as out:
                    out.write(f"{value or ''}\n".encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"folder": [own] if n else []}, pa.schema([("folder", pa.string())]))

    ship(values.sparkSession)
    return [f"{path}/{r.folder}" for r in values.mapInArrow(write, "folder string").collect()]
