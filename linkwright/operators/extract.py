"""From source rows to one record each, and on to the long form of one row a value.

A record has ext_seq (its place in the run), ext_id, source, name, email,
email_confidence, phone, github, location, company, title and skills; resumes and
profiles also set more_emails, more_phones, skill_base (the confidence of their
skills) and education.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions import columns as C
from linkwright.functions.constants import BAD_EMAIL_FACTOR, RESUME_EMAIL, RESUME_PHONE, SECTION_HEADERS, SOURCE_CONFIDENCE

ATS_OFFSET = 1_000_000_000_000
RESUME_OFFSET, PROFILE_OFFSET = 2 * ATS_OFFSET, 3 * ATS_OFFSET
#: What only some sources set.
OPTIONAL = {"more_emails": "array<string>", "more_phones": "array<string>", "skill_base": "double", "education": "array<string>"}


def csv_records(rows: DataFrame, source: str = "recruiter.csv") -> DataFrame:
    """Recruiter rows; an address without @ keeps a fraction of its confidence; of a location only city and country stay."""
    get = {c: C.blank_to_null(F.col(c)) for c in ("name", "email", "phone", "current_company", "title", "github_url", "location")}
    parts = F.transform(F.split(get["location"], ","), lambda x: F.trim(x))
    base = SOURCE_CONFIDENCE[source]
    out = rows.select(
        F.col("ext_seq").cast("long").alias("ext_seq"), F.md5(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in sorted(get)])).alias("ext_id"), F.lit(source).alias("source"), F.lit(base).alias("base"),
        get["name"].alias("name"), get["email"].alias("email"), F.when(get["email"].contains("@"), F.lit(base)).otherwise(base * BAD_EMAIL_FACTOR).alias("email_confidence"), get["phone"].alias("phone"), get["github_url"].alias("github"),
        F.when(F.size(parts) >= 2, F.concat_ws(", ", F.get(parts, F.lit(0)), F.element_at(parts, -1))).otherwise(get["location"]).alias("location"),
        get["current_company"].alias("company"), get["title"].alias("title"), F.array().cast("array<string>").alias("skills"))
    return out.filter(F.coalesce("name", "email", "phone", "github", "location", "company", "title").isNotNull())


def ats_records(rows: DataFrame, source: str = "ats.json") -> DataFrame:
    """ATS rows; records that say nothing are dropped, and one without an id has a hash of its content as its id."""
    base = SOURCE_CONFIDENCE[source]
    tags = F.col("tags") if "tags" in rows.columns else F.array("tag1", "tag2")
    get = lambda c: C.blank_to_null(F.col(c)) if c in rows.columns else F.lit(None).cast("string")
    out = rows.select(
        (F.col("ext_seq") + ATS_OFFSET).cast("long").alias("ext_seq"), F.coalesce(get("ats_record_id"), F.md5(F.to_json(F.struct(*sorted(c for c in rows.columns if c != "ext_seq"))))).alias("ext_id"), F.lit(source).alias("source"), F.lit(base).alias("base"),
        get("display_name").alias("name"), get("primary_email").alias("email"), F.when(get("primary_email").isNotNull(), F.lit(base)).alias("email_confidence"), get("mobile").alias("phone"), F.lit(None).cast("string").alias("github"),
        get("geo").alias("location"), get("employer").alias("company"), get("job_title").alias("title"), F.filter(tags, lambda t: F.trim(t) != "").alias("skills"))
    return out.filter(F.coalesce("name", "email", "phone", "location", "company", "title").isNotNull() | (F.size("skills") > 0))


def normalized(records: DataFrame) -> DataFrame:
    """Names, addresses, phones and skills in canonical form; phones that aren't valid and blank skills go."""
    records = records.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in records.columns})
    return records.withColumns({
        "more_emails": F.transform("more_emails", C.email), "more_phones": F.filter(F.transform("more_phones", lambda p: C.phone(p)), lambda p: p.isNotNull()),
        "name": F.when(F.col("name").isNotNull(), C.name(F.col("name"))), "email": C.email(F.col("email")), "phone": C.phone(F.col("phone")), "github": F.col("github"),
        "skills": F.filter(F.transform("skills", C.skill), lambda s: s.isNotNull())})


def top_languages(repos: DataFrame, keep: int = 10) -> DataFrame:
    """username, language, n and rank: each user's most used languages, ties by first encounter; repos has a unique `place` in each user."""
    clean = repos.filter("trim(language) <> ''").select("username", F.lower("language").alias("language"), "place")
    counted = clean.groupBy("username", "language").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    order = Window.partitionBy("username").orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep).select("username", "language", "n", "rank")


def usernames(records: DataFrame) -> DataFrame:
    """Each linked profile once, by its last path segment."""
    return records.filter("github IS NOT NULL").select(C.username(F.trim("github")).alias("username")).filter("username <> ''").distinct()


def resume_emails(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(RESUME_EMAIL), F.lit(0)))


def resume_phones(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(RESUME_PHONE), F.lit(0)))


def resume_name(text: Column) -> Column:
    """The first line of at most four words without a digit, an address or a phone."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (F.size(F.split(x, r"\s+")) <= 4) & ~x.rlike(r"\d") & ~x.rlike(RESUME_EMAIL) & ~x.rlike(RESUME_PHONE))
    return F.get(lines, F.lit(0))


def resume_lines(resumes: DataFrame) -> DataFrame:
    """ext_seq, pos, line, header and section: every line with the section that it stands in."""
    lines = resumes.select("ext_seq", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bare = F.rtrim(F.lower(F.trim(F.regexp_replace("line", "^[^a-zA-Z0-9]+", ""))), F.lit(":"))
    header = F.when(bare.isin(*SECTION_HEADERS), bare)
    carry = Window.partitionBy("ext_seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("header", header).withColumn("section", F.last("header", ignorenulls=True).over(carry))


def resume_skills(resumes: DataFrame) -> DataFrame:
    """ext_seq, pos, item and token: the items of skill sections; labels go, and so do long or digit-heavy items."""
    lines = resume_lines(resumes).filter("header IS NULL AND section IN ('skills', 'technical skills')")
    items = lines.select("ext_seq", "pos", F.posexplode(F.split(F.regexp_replace("line", "^[^:]*:", ""), r"[,•|;]")).alias("item", "raw")).withColumn("token", F.trim("raw"))
    return items.filter((F.col("token") != "") & (F.size(F.split("token", r"\s+")) <= 4) & ~F.col("token").rlike(r"\d{3,}")).select("ext_seq", "pos", "item", "token")


def resume_education(resumes: DataFrame) -> DataFrame:
    """ext_seq and institution: the lines of education sections of under 15 words, once each."""
    lines = resume_lines(resumes).filter("header IS NULL AND section = 'education'").withColumn("institution", F.trim("line"))
    return lines.filter((F.col("institution") != "") & (F.size(F.split("institution", r"\s+")) < 15)).select("ext_seq", "institution").distinct()


def _empty() -> Column:
    return F.array().cast("array<string>")


def resume_records(resumes: DataFrame) -> DataFrame:
    """One record for each of resumes (ext_seq, path, text), for one without text too; it has all of its addresses and valid phones."""
    file = F.element_at(F.split("path", "/"), -1)
    stem, kind = F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""), F.lower(F.regexp_extract(file, r"(?<=.)\.([^.]*)$", 1))
    source = F.concat(F.lower(F.regexp_replace(F.regexp_replace(stem, "(?i)resume", ""), "[^a-zA-Z0-9]", "")), F.lit("_resume_"), kind)
    item = F.struct("pos", "item", "token")
    skills = resume_skills(resumes).groupBy("ext_seq").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["token"])).alias("skills"))
    schools = resume_education(resumes).groupBy("ext_seq").agg(F.array_sort(F.collect_list("institution")).alias("education"))
    emails = resume_emails(F.col("text"))
    phones = F.array_distinct(F.filter(F.transform(resume_phones(F.col("text")), lambda p: C.phone(p)), lambda p: p.isNotNull()))
    base, none = SOURCE_CONFIDENCE["resume_pdf"], F.lit(None).cast("string")
    read = resumes.withColumns({"emails": F.coalesce(emails, _empty()), "phones": F.coalesce(phones, _empty())})
    return read.join(skills, "ext_seq", "left").join(schools, "ext_seq", "left").select(
        (F.col("ext_seq") + RESUME_OFFSET).cast("long").alias("ext_seq"), F.concat(F.lit("RESUME-"), F.replace(file, F.lit(" "), F.lit("_"))).alias("ext_id"), source.alias("source"), F.lit(base).alias("base"),
        resume_name(F.col("text")).alias("name"), F.get("emails", F.lit(0)).alias("email"), F.lit(base).alias("email_confidence"), F.get("phones", F.lit(0)).alias("phone"), none.alias("github"),
        none.alias("location"), none.alias("company"), none.alias("title"), F.coalesce("skills", _empty()).alias("skills"),
        F.expr("slice(emails, 2, greatest(size(emails) - 1, 0))").alias("more_emails"), F.expr("slice(phones, 2, greatest(size(phones) - 1, 0))").alias("more_phones"),
        F.lit(SOURCE_CONFIDENCE["resume_skill_section"]).alias("skill_base"), F.coalesce("education", _empty()).alias("education"))


def profile_records(profiles: DataFrame, records: DataFrame) -> DataFrame:
    """One record for each profile (username, profile, repos) that a link of records names, once, in the order of the first links."""
    wanted = records.filter("github IS NOT NULL").select(C.username(F.trim("github")).alias("username"), "ext_seq").filter("username <> ''").groupBy("username").agg(F.min("ext_seq").alias("first"))
    once = profiles.groupBy("username").agg(F.max(F.struct("profile", "repos")).alias("r")).join(wanted, "username")
    repos = once.select("username", F.posexplode("r.repos").alias("place", "repo")).select("username", F.trim("repo.language").alias("language"), "place")
    skills = top_languages(repos).groupBy("username").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "language"))), lambda x: x["language"]).alias("skills"))
    get = lambda c: C.blank_to_null(F.col(f"r.profile.{c}"))
    none = F.lit(None).cast("string")
    return once.join(skills, "username", "left").select(
        (F.col("first") + PROFILE_OFFSET).cast("long").alias("ext_seq"), F.concat(F.lit("github:"), F.col("username")).alias("ext_id"), F.lit("github_api").alias("source"), F.lit(SOURCE_CONFIDENCE["github_api"]).alias("base"),
        get("name").alias("name"), none.alias("email"), F.lit(None).cast("double").alias("email_confidence"), none.alias("phone"), F.coalesce(get("html_url"), F.concat(F.lit("https://github.com/"), F.col("username"))).alias("github"),
        get("location").alias("location"), get("company").alias("company"), none.alias("title"), F.coalesce("skills", _empty()).alias("skills"), F.lit(SOURCE_CONFIDENCE["github_api_repo_language_skill"]).alias("skill_base"))
