"""Readers of recruiter CSV, ATS JSON, resume text and fetched REST payloads; all schemas are explicit."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_COLUMNS = ("name", "email", "phone", "current_company", "title", "github_url", "location")
ATS_SCHEMA = """candidates array<struct<ats_record_id:string, personal:struct<displayName:string, contact:struct<primaryEmail:string, mobile:string>>,
 employment:struct<employer:string, jobTitle:string, startDate:string>, tags:array<string>, geo:string>>"""
PROFILE_SCHEMA = "status int, username string, profile struct<name:string, bio:string, location:string, html_url:string, blog:string, company:string>, repos array<struct<language:string>>"


def _or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """A missing path gives no rows."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_recruiter_csv(spark: SparkSession, path: str) -> DataFrame:
    """Known columns by header name, unknown ones dropped, missing ones null; wholly blank rows dropped."""
    raw = _or_empty(spark, lambda: spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8"), ", ".join(f"{c} string" for c in CSV_COLUMNS))
    rows = raw.select(*[F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS])
    return rows.filter(F.exists(F.array(*CSV_COLUMNS), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))


def read_ats_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the top-level array `candidates`; without it, or with broken JSON, none."""
    raw = _or_empty(spark, lambda: spark.read.schema(ATS_SCHEMA).json(path, multiLine=True), ATS_SCHEMA)
    r = F.col("r")
    return raw.select(F.explode("candidates").alias("r")).filter(r.isNotNull()).select(
        r["ats_record_id"].alias("ats_record_id"), r["personal"]["displayName"].alias("display_name"), r["personal"]["contact"]["primaryEmail"].alias("primary_email"), r["personal"]["contact"]["mobile"].alias("mobile"),
        r["employment"]["employer"].alias("employer"), r["employment"]["jobTitle"].alias("job_title"), r["employment"]["startDate"].alias("start_date"), r["tags"].alias("tags"), r["geo"].alias("geo"))


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """path and text of every text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Fetched profiles from the landing zone; only successful fetches."""
    return _or_empty(spark, lambda: spark.read.schema(PROFILE_SCHEMA).json(path), PROFILE_SCHEMA).filter("status = 200")
