"""The catalogue: one query an operator over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.functions import columns as C
from linkwright.functions.constants import RESUME_EMAIL, RESUME_PHONE, SKILLS, STOPLIST
from linkwright.operators import extract, linkage, project, report, resolve, search, suggest, validate
from linkwright.operators.checkpoint import saved
from linkwright.operators.store import from_text, to_text
from linkwright.plans.pipeline import records_of
from linkwright.sources.derived import ATS, CSV, RESUME, REST, _sql, derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def joined(array, sep="|"):
    return F.array_join(array, sep)


# ---- oracle text ----
def title_sql(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({c}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')"


SKILL_CASE = "CASE k " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SKILLS.items()) + f" ELSE {title_sql('k')} END"


def phone_sql(c: str) -> str:
    plain = f"regexp_replace({c}, '[\\s().-]', '', 'g')"
    bare = f"regexp_replace({plain}, '^0', '')"
    return f"CASE WHEN {plain} LIKE '+%' THEN CASE WHEN regexp_matches({plain}, '^\\+91[6-9][0-9]{{9}}$') OR (regexp_matches({plain}, '^\\+[1-9][0-9]{{7,14}}$') AND {plain} NOT LIKE '+91%' AND {plain} NOT LIKE '+1%') OR (regexp_matches({plain}, '^\\+1[2-9][0-9]{{2}}[2-9][0-9]{{6}}$') AND {plain} NOT LIKE '+1555%') THEN {plain} END WHEN regexp_matches({bare}, '^[6-9][0-9]{{9}}$') THEN '+91' || {bare} END"


def scrub(c: str) -> str:
    return f"nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')"


RECORDS = f"""csv AS ({CSV}), ats AS ({ATS}), raw AS (
 SELECT ext_seq, md5(concat_ws('|', coalesce(current_company, ''), coalesce(email, ''), coalesce(github_url, ''), coalesce(location, ''), coalesce(name, ''), coalesce(phone, ''), coalesce(title, ''))) AS ext_id, 'recruiter.csv' AS source, 1.0::DOUBLE AS base, 2.0::DOUBLE AS priority,
  {scrub('name')} AS name, {scrub('email')} AS email, CASE WHEN contains({scrub('email')}, '@') THEN 1.0 ELSE 0.4 END::DOUBLE AS email_confidence, {scrub('phone')} AS phone, {scrub('github_url')} AS github,
  trim(split_part({scrub('location')}, ',', 1)) || ', ' || trim(split_part({scrub('location')}, ',', -1)) AS location, {scrub('current_company')} AS company, {scrub('title')} AS title, []::VARCHAR[] AS tags FROM csv
 UNION ALL
 SELECT ext_seq + 1000000000000, ats_record_id, 'ats.json', 0.95::DOUBLE, 1.5::DOUBLE, {scrub('display_name')}, {scrub('primary_email')}, CASE WHEN {scrub('primary_email')} IS NOT NULL THEN 0.95::DOUBLE END, {scrub('mobile')}, NULL, {scrub('geo')}, {scrub('employer')}, NULL, [tag1, tag2] FROM ats),
rec AS (SELECT ext_seq, ext_id, source, base, priority, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, lower(trim(email)) AS email, email_confidence, {phone_sql('phone')} AS phone, github, location, company, title, tags FROM raw),
ids AS (SELECT DISTINCT kind, value, ext_seq FROM (SELECT 'github' AS kind, lower(trim(github)) AS value, ext_seq FROM rec UNION ALL SELECT 'email', email, ext_seq FROM rec UNION ALL SELECT 'phone', phone, ext_seq FROM rec) WHERE value <> '')"""
CLUSTERS = f"""WITH RECURSIVE {RECORDS},
edges AS (SELECT DISTINCT a.ext_seq AS src, b.ext_seq AS dst FROM ids a JOIN ids b USING (kind, value)),
reach AS (SELECT ext_seq AS src, ext_seq AS dst FROM rec UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
clu AS (SELECT src AS ext_seq, min(dst) AS cluster FROM reach GROUP BY src),
skill AS (SELECT ext_seq, source, base, pos, {SKILL_CASE} AS value FROM (SELECT ext_seq, source, base, i - 1 AS pos, lower(trim(tags[i])) AS k FROM rec, range(1, 3) t(i) WHERE i <= len(tags))),
vals AS (SELECT cluster, field, value, source, priority, confidence, ext_seq * 1000 + pos AS ord FROM (
  SELECT ext_seq, source, priority, 'full_name' AS field, name AS value, base AS confidence, 0 AS pos FROM rec UNION ALL SELECT ext_seq, source, priority, 'emails', email, email_confidence, 0 FROM rec
  UNION ALL SELECT ext_seq, source, priority, 'phones', phone, base, 0 FROM rec UNION ALL SELECT ext_seq, source, priority, 'location', location, base, 0 FROM rec
  UNION ALL SELECT ext_seq, source, 1.5, 'skills', value, base, pos FROM skill) JOIN clu USING (ext_seq) WHERE value IS NOT NULL),
bysrc AS (SELECT cluster, field, lower(trim(value)) AS k, source, priority, max(confidence) AS c, min(ord) AS first, max(ord) AS last, max_by(value, ord) AS value FROM vals GROUP BY ALL),
groups AS (SELECT cluster, field, k, max_by(value, last) AS value, min(first) AS first, max(priority) AS priority, list(source ORDER BY source) AS sources,
  CASE WHEN count(*) = 1 THEN max(c) ELSE 1.0::DOUBLE - list_reduce(list_prepend(1.0::DOUBLE, list(c ORDER BY source)), lambda a, x: a * (1.0::DOUBLE - x)) END AS confidence FROM bysrc GROUP BY cluster, field, k),
lists AS (SELECT cluster, field, value, confidence, first, sources FROM groups WHERE field IN ('emails', 'phones', 'skills')),
scal AS (SELECT cluster, field, k, value, CASE WHEN count(*) OVER w > 1 THEN confidence * 0.9::DOUBLE ELSE confidence END AS confidence, sources, row_number() OVER (PARTITION BY cluster, field ORDER BY priority DESC, first) = 1 AS won FROM groups WHERE field IN ('full_name', 'location') WINDOW w AS (PARTITION BY cluster, field)),
keys AS (SELECT cluster, min_by(lower(trim(github)), ext_seq) FILTER (github IS NOT NULL) AS g, min_by(email, ext_seq) FILTER (email IS NOT NULL AND email <> '') AS e, min_by(phone, ext_seq) FILTER (phone IS NOT NULL) AS p, min_by(ext_id, ext_seq) AS x FROM rec JOIN clu USING (ext_seq) GROUP BY cluster),
joinkeys AS (SELECT cluster, coalesce('github:' || g, 'email:' || e, 'phone:' || p, 'ext:' || x) AS join_key FROM keys),
hashed AS (SELECT cluster, join_key, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(join_key)) AS h FROM joinkeys),
idents AS (SELECT cluster, join_key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((position(substr(h, 17, 1) IN '0123456789abcdef') - 1) % 4 + 1)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS candidate_id FROM hashed),
ent AS (SELECT i.cluster, i.candidate_id, i.join_key, n.value AS full_name, n.confidence AS name_conf, n.sources AS name_sources, l.value AS location, l.sources AS location_sources,
  (SELECT list(value ORDER BY first) FROM lists x WHERE x.cluster = i.cluster AND field = 'emails') AS emails, (SELECT list(value ORDER BY first) FROM lists x WHERE x.cluster = i.cluster AND field = 'phones') AS phones,
  (SELECT list(value ORDER BY first) FROM lists x WHERE x.cluster = i.cluster AND field = 'skills') AS skills,
  coalesce((SELECT max(confidence) FROM lists x WHERE x.cluster = i.cluster AND field = 'emails'), 0) AS ec, coalesce((SELECT max(confidence) FROM lists x WHERE x.cluster = i.cluster AND field = 'phones'), 0) AS pc,
  coalesce((SELECT list_reduce(list_prepend(0.0::DOUBLE, list(confidence ORDER BY first)), lambda a, x: a + x) / nullif(count(*), 0) FROM lists x WHERE x.cluster = i.cluster AND field = 'skills'), 0) AS sc, g.github
  FROM idents i LEFT JOIN scal n ON n.cluster = i.cluster AND n.field = 'full_name' AND n.won LEFT JOIN scal l ON l.cluster = i.cluster AND l.field = 'location' AND l.won
  LEFT JOIN (SELECT cluster, max_by(github, (priority, ext_seq)) AS github FROM rec JOIN clu USING (ext_seq) WHERE github IS NOT NULL GROUP BY cluster) g ON g.cluster = i.cluster),
entity AS (SELECT *, round_even(greatest(0, least(1, (coalesce(name_conf, 0) + ec + pc + sc) / 4.0)), 3) AS overall_confidence FROM ent),
flagged AS (SELECT *, overall_confidence < 0.5 OR coalesce(full_name, '') = '' OR emails IS NULL AS needs_human_review FROM entity)
"""


def entity_table(spark, sf_dir) -> DataFrame:
    records = records_of(spark, sf_dir)
    clusters = saved(linkage.component_clusters(records), "clusters")
    return resolve.entities(records, clusters, linkage.cluster_ids(records, clusters))


def grouped(spark, sf_dir):
    records = records_of(spark, sf_dir)
    vals = resolve.values(records, saved(linkage.component_clusters(records), "clusters"))
    return vals, resolve.supported(vals)


# ---- extraction ----
@query(f"WITH {RECORDS} SELECT ext_seq, ext_id, name, email, email_confidence, phone, github, location, company, title FROM raw WHERE source = 'recruiter.csv'")
def csv_extract(spark, sf_dir):
    return extract.csv_records(derived(spark, sf_dir, "csv")).select("ext_seq", "ext_id", "name", "email", "email_confidence", "phone", "github", "location", "company", "title")


@query(f"WITH {RECORDS} SELECT ext_seq, ext_id, name, email, phone, location, company, array_to_string(tags, '|') AS skills FROM raw WHERE source = 'ats.json'")
def ats_extract(spark, sf_dir):
    return extract.ats_records(derived(spark, sf_dir, "ats")).select("ext_seq", "ext_id", "name", "email", "phone", "location", "company", joined("skills").alias("skills"))


@query(f"WITH {RECORDS} SELECT ext_seq, source, name, email, phone FROM rec")
def normalized_records(spark, sf_dir):
    return records_of(spark, sf_dir).select("ext_seq", "source", "name", "email", "phone")


@query(f"""WITH src AS ({REST}), c AS (SELECT username, lower(language) AS language, count(*) AS n, min(o_orderkey * 100000000000 + l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey) AS first FROM src GROUP BY ALL)
SELECT username, language, n, row_number() OVER (PARTITION BY username ORDER BY n DESC, first) AS rank FROM c QUALIFY rank <= 10""")
def rest_top10_languages(spark, sf_dir):
    place = F.expr("cast(o_orderkey as decimal(38, 0)) * 100000000000 + l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey")
    return extract.top_languages(derived(spark, sf_dir, "rest").withColumn("place", place))


@query(f"WITH {RECORDS} SELECT DISTINCT regexp_extract(rtrim(trim(github), '/'), '[^/]+$') AS username FROM raw WHERE github IS NOT NULL")
def rest_fanout_usernames(spark, sf_dir):
    return extract.usernames(records_of(spark, sf_dir))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{RESUME_EMAIL}', 0))), '|') AS emails FROM documents")
def text_email_extract(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", joined(F.array_sort(extract.resume_emails(F.col("text")))).alias("emails"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{RESUME_PHONE}', 0))), '|') AS phones FROM documents")
def text_phone_extract(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", joined(F.array_sort(extract.resume_phones(F.col("text")))).alias("phones"))


@query(f"""WITH src AS ({RESUME}) SELECT ext_seq, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND len(regexp_split_to_array(x, '\\s+')) <= 4 AND NOT regexp_matches(x, '\\d') AND NOT regexp_matches(x, '{RESUME_EMAIL}'))[1] AS name FROM src""")
def text_name_heuristic(spark, sf_dir):
    return derived(spark, sf_dir, "resume").select("ext_seq", extract.resume_name(F.col("text")).alias("name"))


LINES = f"""src AS ({RESUME}), lines AS (SELECT ext_seq, (i - 1)::INT AS pos, string_split(text, chr(10))[i] AS line FROM src, range(1, 100) t(i) WHERE i <= len(string_split(text, chr(10)))),
head AS (SELECT *, CASE WHEN rtrim(lower(trim(regexp_replace(line, '^[^a-zA-Z0-9]+', ''))), ':') IN ('skills', 'technical skills', 'experience', 'work experience', 'projects', 'education', 'achievements', 'certifications', 'publications', 'summary', 'objective', 'contact') THEN rtrim(lower(trim(regexp_replace(line, '^[^a-zA-Z0-9]+', ''))), ':') END AS header FROM lines),
carried AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY ext_seq ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM head)"""


@query(f"WITH {LINES} SELECT ext_seq, pos, line, header, section FROM carried")
def text_section_carry(spark, sf_dir):
    return extract.resume_lines(derived(spark, sf_dir, "resume"))


@query(f"""WITH {LINES}, items AS (SELECT ext_seq, pos, (j - 1)::INT AS item, trim(string_split(regexp_replace(regexp_replace(line, '^[^:]*:', ''), '[,•|;]', ',', 'g'), ',')[j]) AS token FROM carried, range(1, 20) t(j)
 WHERE header IS NULL AND section IN ('skills', 'technical skills') AND j <= len(string_split(regexp_replace(regexp_replace(line, '^[^:]*:', ''), '[,•|;]', ',', 'g'), ',')))
SELECT ext_seq, pos, item, token FROM items WHERE token <> '' AND len(regexp_split_to_array(token, '\\s+')) <= 4 AND NOT regexp_matches(token, '\\d{{3,}}')""")
def text_skill_tokens(spark, sf_dir):
    return extract.resume_skills(derived(spark, sf_dir, "resume"))


@query(f"WITH {LINES} SELECT DISTINCT ext_seq, trim(line) AS institution FROM carried WHERE header IS NULL AND section = 'education' AND trim(line) <> ''")
def text_education(spark, sf_dir):
    return extract.resume_education(derived(spark, sf_dir, "resume"))


# ---- functions ----
@query(f"SELECT DISTINCT p_name, {title_sql('p_name')} AS title FROM part")
def title_case(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name", C.title_case(F.col("p_name")).alias("title")).distinct()


@query(f"WITH ats AS ({ATS}), t AS (SELECT tag1 AS raw FROM ats UNION SELECT tag2 FROM ats) SELECT raw, {SKILL_CASE} AS skill FROM (SELECT raw, lower(trim(raw)) AS k FROM t)")
def norm_skill_alias(spark, sf_dir):
    ats = derived(spark, sf_dir, "ats")
    return ats.select(F.col("tag1").alias("raw")).union(ats.select("tag2")).distinct().select("raw", C.skill(F.col("raw")).alias("skill"))


@query(f"""WITH csv AS ({CSV}), ats AS ({ATS}), l AS (SELECT location AS raw FROM csv UNION SELECT geo FROM ats UNION SELECT 'Springfield' UNION SELECT 'Paris, USA' UNION SELECT 'a, b, c, UK' UNION SELECT 'a, b, c, Nowhere'), p AS (SELECT raw, list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> '') AS q FROM l),
c AS (SELECT *, CASE WHEN len(q) > 1 THEN CASE lower(q[-1]) WHEN 'usa' THEN 'US' WHEN 'uk' THEN 'GB' END END AS country FROM p)
SELECT raw, q[1] AS city, CASE WHEN len(q) = 2 AND country IS NULL THEN q[2] WHEN len(q) > 2 THEN array_to_string(CASE WHEN country IS NULL THEN q[2:] ELSE q[2:-2] END, ', ') END AS region, country FROM c""")
def norm_location(spark, sf_dir):
    more = spark.sql("SELECT explode(array('Springfield', 'Paris, USA', 'a, b, c, UK', 'a, b, c, Nowhere')) AS raw")
    rows = derived(spark, sf_dir, "csv").select(F.col("location").alias("raw")).union(derived(spark, sf_dir, "ats").select("geo")).union(more).distinct()
    return rows.select("raw", C.location(F.col("raw"), C.iso_countries(spark)).alias("l")).select("raw", "l.*")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS a, strftime(o_orderdate, '%Y-%m') AS b, strftime(o_orderdate, '%Y-%m') AS c FROM orders""")
def norm_date(spark, sf_dir):
    d = F.col("o_orderdate")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", *[C.year_month(F.date_format(d, f)).alias(n) for n, f in (("a", "MMM yyyy"), ("b", "MM/yyyy"), ("c", "yyyy-MM"))])


@query(f"WITH {RECORDS} SELECT ext_seq, {phone_sql('phone')} AS e164 FROM raw")
def norm_phone(spark, sf_dir):
    return records_of(spark, sf_dir).select("ext_seq", F.col("phone").alias("e164"))


# ---- identity ----
@query(f"WITH {RECORDS} SELECT kind, value, ext_seq FROM ids")
def identifier_table(spark, sf_dir):
    return linkage.identifiers(records_of(spark, sf_dir))


@query(CLUSTERS + "SELECT ext_seq, cluster FROM clu")
def cluster_components(spark, sf_dir):
    return linkage.component_clusters(records_of(spark, sf_dir))


@query()
def cluster_greedy(spark, sf_dir):
    return linkage.greedy_clusters(records_of(spark, sf_dir))


@query(CLUSTERS + "SELECT cluster, join_key, candidate_id FROM idents")
def uuid5_ids(spark, sf_dir):
    records = records_of(spark, sf_dir)
    return linkage.cluster_ids(records, linkage.component_clusters(records))


INDEX = "idx AS (SELECT kind, value, 'old-' || CAST(min(ext_seq) % 97 AS VARCHAR) AS candidate_id FROM ids WHERE ext_seq % 2 = 0 GROUP BY kind, value)"


def old_index(records):
    return linkage.identifiers(records).filter("ext_seq % 2 = 0").groupBy("kind", "value").agg(F.concat(F.lit("old-"), (F.min("ext_seq") % 97).cast("string")).alias("candidate_id"))


@query(CLUSTERS + f", {INDEX} SELECT cluster, candidate_id AS owner FROM ids JOIN clu USING (ext_seq) JOIN idx USING (kind, value) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY CASE kind WHEN 'github' THEN 0 WHEN 'email' THEN 1 ELSE 2 END, ext_seq, value) = 1")
def identity_lookup_priority(spark, sf_dir):
    records = records_of(spark, sf_dir)
    return linkage.prioritized_owner(linkage.identifiers(records).join(linkage.component_clusters(records), "ext_seq"), old_index(records))


@query(CLUSTERS + f", {INDEX} SELECT cluster, array_to_string(list_sort(list(DISTINCT candidate_id)), '|') AS owners FROM ids JOIN clu USING (ext_seq) JOIN idx USING (kind, value) GROUP BY cluster HAVING count(DISTINCT candidate_id) > 1")
def bridge_conflicts(spark, sf_dir):
    records = records_of(spark, sf_dir)
    found = linkage.bridging_conflicts(linkage.identifiers(records).join(linkage.component_clusters(records), "ext_seq"), old_index(records))
    return found.select("cluster", joined("owners").alias("owners"))


@query(f"WITH {RECORDS}, {INDEX}, new AS (SELECT kind, value, 'new' AS candidate_id FROM ids WHERE ext_seq % 3 = 0 GROUP BY ALL) SELECT * FROM new UNION ALL SELECT * FROM idx WHERE (kind, value) NOT IN (SELECT (kind, value) FROM new)")
def identifier_upsert(spark, sf_dir):
    records = records_of(spark, sf_dir)
    new = linkage.identifiers(records).filter("ext_seq % 3 = 0").withColumn("candidate_id", F.lit("new"))
    return linkage.upsert(old_index(records), new, ["kind", "value"], "ext_seq")


# ---- resolution ----
@query(CLUSTERS + "SELECT cluster, field, value, round(confidence, 9) AS confidence, array_to_string(sources, '|') AS sources FROM lists")
def list_field_group(spark, sf_dir):
    return resolve.list_fields(grouped(spark, sf_dir)[1]).select("cluster", "field", "value", F.round("confidence", 9).alias("confidence"), joined("sources").alias("sources"))


@query(CLUSTERS + "SELECT cluster, field, value, round(confidence, 9) AS confidence, won FROM scal")
def scalar_resolve(spark, sf_dir):
    return resolve.scalar_fields(grouped(spark, sf_dir)[1]).select("cluster", "field", "value", F.round("confidence", 9).alias("confidence"), "won")


@query(CLUSTERS + "SELECT v.cluster, v.field, s.value, v.source, v.confidence FROM vals v JOIN scal s ON v.cluster = s.cluster AND v.field = s.field AND lower(trim(v.value)) = s.k WHERE NOT s.won")
def conflict_rows(spark, sf_dir):
    vals, groups = grouped(spark, sf_dir)
    return resolve.conflicts(vals, resolve.scalar_fields(groups))


@query(CLUSTERS + "SELECT cluster, max_by(github, (priority, ext_seq)) AS github FROM rec JOIN clu USING (ext_seq) WHERE github IS NOT NULL GROUP BY cluster")
def links_merge(spark, sf_dir):
    records = records_of(spark, sf_dir)
    return resolve.links(records, linkage.component_clusters(records))


@query(CLUSTERS + "SELECT cluster, string_agg(coalesce(company, '') || '/' || coalesce(title, ''), '|' ORDER BY first, company) AS experience FROM (SELECT cluster, company, title, min(ext_seq) AS first FROM rec JOIN clu USING (ext_seq) WHERE company IS NOT NULL OR title IS NOT NULL GROUP BY ALL) GROUP BY cluster")
def experience_distinct(spark, sf_dir):
    records = records_of(spark, sf_dir)
    found = resolve.experience(records, linkage.component_clusters(records))
    return found.select("cluster", joined(F.transform("experience", lambda x: F.concat(F.coalesce(x["company"], F.lit("")), F.lit("/"), F.coalesce(x["title"], F.lit(""))))).alias("experience"))


@query(CLUSTERS + "SELECT candidate_id, overall_confidence, needs_human_review FROM flagged")
def review_flag(spark, sf_dir):
    return entity_table(spark, sf_dir).select("candidate_id", "overall_confidence", "needs_human_review")


@query(CLUSTERS + "SELECT candidate_id, full_name, array_to_string(emails, '|') AS emails, array_to_string(phones, '|') AS phones, location, github, array_to_string(skills, '|') AS skills, overall_confidence FROM flagged")
def default_projection(spark, sf_dir):
    p = project.default_projection(entity_table(spark, sf_dir))
    blank = lambda c: F.nullif(joined(c), F.lit(""))
    return p.select("candidate_id", "full_name", blank("emails").alias("emails"), blank("phones").alias("phones"), "location", "github", blank(F.transform("skills", lambda s: s["name"])).alias("skills"), "overall_confidence")


CONFIG = {"fields": [{"path": "full_name", "from": "full_name.value"}, {"path": "primary_email", "from": "emails[0].value", "required": True}, {"path": "skills", "from": "skills[].value", "normalize": "canonical"}, {"path": "nothing", "from": "emails.x"}], "include_confidence": True, "on_missing": "null"}


@query(CLUSTERS + "SELECT full_name, round(name_conf, 9) AS name_confidence, emails[1] AS primary_email, array_to_string(list_transform(skills, lambda s: CASE lower(s) WHEN 'aws' THEN 'AWS' WHEN 'javascript' THEN 'JavaScript' ELSE " + title_sql("lower(s)") + " END), '|') AS skills FROM flagged")
def config_projection(spark, sf_dir):
    p = project.project(entity_table(spark, sf_dir), CONFIG)
    return p.select("full_name", F.round("full_name_confidence", 9).alias("name_confidence"), "primary_email", joined("skills").alias("skills"))


@query(CLUSTERS + "SELECT count(*) AS total, count_if(emails IS NOT NULL)::BIGINT AS with_email, count_if(github IS NOT NULL)::BIGINT AS with_github, round_even(avg(overall_confidence), 6) AS avg_confidence, count_if(needs_human_review)::BIGINT AS flagged, 0::BIGINT AS three_way FROM flagged")
def health_summary(spark, sf_dir):
    return report.summary(entity_table(spark, sf_dir))


@query(CLUSTERS + "SELECT candidate_id, true AS valid FROM flagged")
def validate_schema(spark, sf_dir):
    return validate.validated(project.default_projection(entity_table(spark, sf_dir))).select("candidate_id", "valid")


@query("SELECT true AS valid, 0::BIGINT AS invalid")
def validate_global(spark, sf_dir):
    return validate.run_verdict(validate.validated(project.default_projection(entity_table(spark, sf_dir))))


BROKEN = """SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('id-', CAST(c_custkey AS STRING)) END AS candidate_id,
 concat(CASE WHEN c_custkey % 5 = 0 THEN '0' ELSE '+91' END, CAST(c_custkey AS STRING)) AS phone, CASE c_custkey % 3 WHEN 0 THEN 'IN' WHEN 1 THEN 'India' END AS country, CAST(c_custkey % 13 AS DOUBLE) / 10 AS overall_confidence FROM customer"""
BROKEN_ERRORS = f"""SELECT id, concat_ws('|', CASE WHEN candidate_id IS NULL THEN '$: candidate_id is required' END, CASE WHEN phone LIKE '0%' THEN '$.phones[]: does not match the pattern' END,
 CASE WHEN length(country) <> 2 THEN '$.location.country: does not match the pattern' END, CASE WHEN overall_confidence > 1 THEN '$.overall_confidence: above the maximum' END) AS errors FROM ({BROKEN})"""


def broken(spark, sf_dir):
    rows = _sql(spark, sf_dir, BROKEN, ("customer",))
    return validate.validated(rows.select("id", "candidate_id", F.array("phone").alias("phones"), F.struct("country").alias("location"), "overall_confidence"))


@query(BROKEN_ERRORS)
def validate_errors(spark, sf_dir):
    return broken(spark, sf_dir).select("id", joined("errors").alias("errors"))


@query(f"SELECT bool_and(errors = '') AS valid, count_if(errors <> '')::BIGINT AS invalid FROM ({BROKEN_ERRORS})")
def validate_run(spark, sf_dir):
    return validate.run_verdict(broken(spark, sf_dir))


OMIT = {"fields": [{"path": "id", "from": "candidate_id", "required": True}, {"path": "name", "from": "full_name.value"}, {"path": "email", "from": "emails[0].value", "required": True}, {"path": "phone", "from": "phones[0].value"}], "on_missing": "omit"}


@query(CLUSTERS + """SELECT '{"id":"' || candidate_id || '","name":' || coalesce('"' || full_name || '"', 'null') || coalesce(',"email":"' || emails[1] || '"', '') || ',"phone":' || coalesce('"' || phones[1] || '"', 'null') || '}' AS json FROM flagged""")
def config_projection_omit(spark, sf_dir):
    return project.project(entity_table(spark, sf_dir), OMIT)


@query(CLUSTERS + "SELECT candidate_id, full_name, array_to_string(skills, '|') AS skills, overall_confidence FROM flagged")
def entity_roundtrip(spark, sf_dir):
    """Entities to JSON texts and back."""
    table = entity_table(spark, sf_dir)
    back = from_text(to_text(table), table.schema)
    return back.select("candidate_id", F.col("full_name.value").alias("full_name"), F.nullif(joined(F.transform("skills", lambda s: s["value"])), F.lit("")).alias("skills"), "overall_confidence")


@query(CLUSTERS + "SELECT candidate_id FROM flagged WHERE needs_human_review")
def flagged_only(spark, sf_dir):
    return report.flagged(entity_table(spark, sf_dir)).select("candidate_id")


@query(CLUSTERS + "SELECT candidate_id, (SELECT array_to_string(list(value ORDER BY confidence DESC, first)[:2], '|') FROM lists x WHERE x.cluster = f.cluster AND field = 'skills') AS skills FROM flagged f")
def top_two_skills(spark, sf_dir):
    found = report.top_skills(entity_table(spark, sf_dir), 2)
    return found.select("candidate_id", F.nullif(joined("skills"), F.lit("")).alias("skills"))


def two_digits_sql(c: str) -> str:
    return f"printf('%.2f', {c})"


def told_sql(title: str, value: str, confidence: str, field: str, quote: str = '"') -> str:
    detail = f"coalesce((SELECT lost FROM lost x WHERE x.cluster = f.cluster AND x.field = '{field}'), (SELECT said FROM said x WHERE x.cluster = f.cluster AND x.field = '{field}' AND x.k = lower(trim({value}))))"
    return f"CASE WHEN coalesce({value}, '') <> '' THEN '{title}: {quote}' || {value} || '{quote}' || chr(10) || '  - confidence ' || {two_digits_sql(confidence)} || ' - ' || {detail} || chr(10) END"


EXPLAINED = CLUSTERS + f""", supp AS (SELECT cluster, field, k, count(*) AS n, list(source || ' (' || {two_digits_sql('c')} || ')' ORDER BY first) AS l FROM bysrc GROUP BY cluster, field, k),
said AS (SELECT cluster, field, k, CASE WHEN n = 1 THEN 'from ' || l[1] || ' only' WHEN n = 2 THEN 'agreed by ' || l[1] || ' and ' || l[2] ELSE 'agreed by ' || array_to_string(l[:-2], ', ') || ', and ' || l[-1] END AS said FROM supp),
lost AS (SELECT cluster, field, '(penalized: ' || string_agg('conflicting value "' || value || '" also seen from ' || source, '; ' ORDER BY value, source) || ')' AS lost
 FROM (SELECT DISTINCT v.cluster, v.field, s.value, v.source FROM vals v JOIN scal s ON v.cluster = s.cluster AND v.field = s.field AND lower(trim(v.value)) = s.k WHERE NOT s.won) GROUP BY cluster, field),
mail AS (SELECT cluster, min_by(confidence, first) AS mail_conf FROM lists WHERE field = 'emails' GROUP BY cluster),
place AS (SELECT cluster, confidence AS place_conf FROM scal WHERE field = 'location' AND won),
able AS (SELECT cluster, count(*) AS n_skills, string_agg(value || ' (' || {two_digits_sql('confidence')} || ')', ', ' ORDER BY first) AS able, len(list_distinct(flatten(list(sources)))) AS n_sources FROM lists WHERE field = 'skills' GROUP BY cluster)
SELECT candidate_id, concat_ws(chr(10), 'Candidate: ' || coalesce(full_name, 'Unknown') || ' (confidence: ' || {two_digits_sql('overall_confidence')} || ')', repeat('-', 47),
 {told_sql('full_name', 'full_name', 'name_conf', 'full_name')}, {told_sql('primary email', 'emails[1]', 'mail_conf', 'emails')}, {told_sql('location', 'location', 'place_conf', 'location', '')},
 'skills (' || n_skills || '): ' || able || chr(10) || '  - derived from ' || n_sources || ' sources' || chr(10),
 '! overall_confidence ' || {two_digits_sql('overall_confidence')} || CASE WHEN NOT needs_human_review THEN ' - no flags' ELSE ' - FLAGGED FOR REVIEW (' || concat_ws('; ', CASE WHEN coalesce(full_name, '') = '' THEN 'missing: full_name' END,
  CASE WHEN emails IS NULL THEN 'missing: emails' END, CASE WHEN phones IS NULL THEN 'missing: phone' END, CASE WHEN cluster IN (SELECT cluster FROM lost WHERE field = 'location') THEN 'low-agreement: location' END,
  CASE WHEN cluster IN (SELECT cluster FROM lost WHERE field = 'full_name') THEN 'low-agreement: full_name' END) || ')' END) AS explanation
FROM flagged f LEFT JOIN mail USING (cluster) LEFT JOIN place USING (cluster) LEFT JOIN able USING (cluster)"""


@query(EXPLAINED)
def explain_text(spark, sf_dir):
    vals, groups = grouped(spark, sf_dir)
    return report.explanations(entity_table(spark, sf_dir), resolve.conflicts(vals, resolve.scalar_fields(groups)))


# ---- suggestions ----
ATTRS = "attrs AS (SELECT DISTINCT cluster, 'company' AS kind, lower(trim(company)) AS value FROM rec JOIN clu USING (ext_seq) WHERE company <> '' UNION SELECT DISTINCT cluster, 'skill', lower(trim(value)) FROM lists WHERE field = 'skills' UNION SELECT cluster, 'country', lower(trim(split_part(location, ',', -1))) FROM ent WHERE location IS NOT NULL)"


@query(CLUSTERS + f", {ATTRS} SELECT kind, value, n, CASE WHEN value IN {STOPLIST} THEN 0.0::DOUBLE ELSE greatest(0.05::DOUBLE, 1.0::DOUBLE / n) END AS informativeness FROM (SELECT kind, value, count(*) AS n FROM attrs GROUP BY kind, value)")
def doc_frequency(spark, sf_dir):
    return suggest.document_frequency(suggest.attributes(entity_table(spark, sf_dir)))


@query(CLUSTERS + f""", {ATTRS}, df AS (SELECT kind, value, count(*) AS n, greatest(0.05::DOUBLE, 1.0::DOUBLE / count(*)) AS inf FROM attrs GROUP BY ALL), held AS (SELECT * FROM attrs JOIN df USING (kind, value)),
pairs AS (SELECT DISTINCT x.cluster AS a, y.cluster AS b FROM held x JOIN held y ON x.kind = 'company' AND y.kind = 'company' AND x.value = y.value AND x.cluster < y.cluster WHERE x.n BETWEEN 2 AND 6)
SELECT a, b, x.kind, max(x.inf) AS informativeness FROM pairs JOIN held x ON x.cluster = a JOIN held y ON y.cluster = b AND x.kind = y.kind AND x.value = y.value GROUP BY a, b, x.kind""")
def shared_attribute_pairs(spark, sf_dir):
    return suggest.shared_attributes(suggest.attributes(entity_table(spark, sf_dir))).select("a", "b", "kind", "informativeness")


SORTED_NAME = "array_to_string(list_sort(string_split(trim(lower(regexp_replace(full_name, '[^\\p{L}\\p{N}]+', ' ', 'g'))), ' ')), ' ')"


def suggested_sql(pairs: str, threshold: float) -> str:
    """Scores of pairs (a, b): a row of the table of longest common subsequences a step, one step a letter of x."""
    low = "CASE WHEN {0} < 0.34 THEN 'common — low signal, ' ELSE '' END || 'contributed ' || printf('%.2f', coalesce({0}, 0) * {1}::DOUBLE) || ')'"
    note = lambda k, shown, weight: f"CASE WHEN {k} IS NOT NULL THEN 'shared {k}: ' || {shown} || ' (' || {low.format(k, weight)} END"
    return CLUSTERS + f""", {ATTRS}, df AS (SELECT kind, value, CASE WHEN value IN {STOPLIST} THEN 0.0::DOUBLE ELSE greatest(0.05::DOUBLE, 1.0::DOUBLE / count(*)) END AS inf FROM attrs GROUP BY kind, value),
held AS (SELECT * FROM attrs JOIN df USING (kind, value) WHERE inf > 0),
best AS (SELECT x.cluster AS a, y.cluster AS b, x.kind, max(x.inf) AS inf, min_by(x.value, (-x.inf, x.value)) AS value FROM held x JOIN held y ON x.kind = y.kind AND x.value = y.value AND x.cluster < y.cluster WHERE {pairs} GROUP BY x.cluster, y.cluster, x.kind),
wide AS (SELECT a, b, max(inf) FILTER (kind = 'company') AS company, max(inf) FILTER (kind = 'country') AS country, max(inf) FILTER (kind = 'skill') AS skill,
 max(value) FILTER (kind = 'company') AS company_value, max(value) FILTER (kind = 'skill') AS skill_value FROM best GROUP BY a, b),
names AS (SELECT cluster, {SORTED_NAME} AS name, trim(split_part(location, ',', -1)) AS place FROM ent),
texts AS (SELECT DISTINCT x.name AS x, y.name AS y FROM wide JOIN names x ON x.cluster = a JOIN names y ON y.cluster = b WHERE x.name <> '' AND y.name <> ''),
steps AS (SELECT x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda j: 0::BIGINT) AS line FROM texts
 UNION ALL SELECT x, y, i + 1, list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length(y) + 1), lambda j: [j])), lambda done, j: list_append(done, CASE WHEN x[i + 1] = y[j[1]] THEN line[j[1]] + 1 ELSE greatest(line[j[1] + 1], done[-1]) END)) FROM steps WHERE i < length(x)),
alike AS (SELECT x, y, 100.0::DOUBLE * 2 * line[-1] / (length(x) + length(y)) / 100 AS sim FROM steps WHERE i = length(x)),
told AS (SELECT a, b, company, country, skill, company_value, skill_value, xn.place, coalesce(sim, 0) AS sim FROM wide JOIN names xn ON xn.cluster = a JOIN names yn ON yn.cluster = b LEFT JOIN alike ON x = xn.name AND y = yn.name),
sums AS (SELECT *, sim * 0.4::DOUBLE + coalesce(company, 0) * 0.3::DOUBLE + coalesce(country, 0) * 0.15::DOUBLE + coalesce(skill, 0) * 0.15::DOUBLE AS raw FROM told)
SELECT a, b, printf('%.2f', raw)::DOUBLE AS score, concat_ws('|', CASE WHEN sim > 0 THEN 'name similarity (' || printf('%.2f', sim) || ')' END,
 {note('company', 'company_value', 0.3)}, {note('country', 'place', 0.15)}, {note('skill', title_sql('skill_value'), 0.15)}) AS signals FROM sums WHERE raw > {threshold}"""


@query(suggested_sql("EXISTS (SELECT 1 FROM held p JOIN held q USING (kind, value) WHERE kind = 'company' AND p.inf >= 1.0 / 6 AND p.cluster = x.cluster AND q.cluster = y.cluster)", 0.6))
def dup_suggestions(spark, sf_dir):
    found = suggest.ordered(suggest.suggestions(entity_table(spark, sf_dir)))
    return found.select("a", "b", "score", joined("signals").alias("signals"))


@query(suggested_sql("x.cluster % 100 = 0 OR y.cluster % 100 = 0", 0.4))
def explain_duplicates(spark, sf_dir):
    """Probable duplicates of the stated entities (cluster divisible by 100) among all."""
    table = saved(entity_table(spark, sf_dir).select("cluster", "full_name", "location", "experience", "skills"), "entities")
    found = suggest.suggestions_for(table, table.filter("cluster % 100 = 0"))
    return found.select("a", "b", "score", joined("signals").alias("signals"))


# ---- search ----
ENTITY_TEXT = CLUSTERS + """, jobs AS (SELECT cluster, string_agg(concat_ws(' ', company, title), ' ' ORDER BY first) AS jobs FROM (SELECT cluster, company, title, min(ext_seq) AS first FROM rec JOIN clu USING (ext_seq) WHERE company IS NOT NULL OR title IS NOT NULL GROUP BY ALL) GROUP BY cluster),
texts AS (SELECT candidate_id AS id, concat_ws(' ', full_name, nullif(array_to_string(skills, ' '), ''), jobs) AS text FROM flagged LEFT JOIN jobs USING (cluster))
"""


@query(ENTITY_TEXT + "SELECT id, text FROM texts")
def entity_text(spark, sf_dir):
    return search.searchable(entity_table(spark, sf_dir))


@query(ENTITY_TEXT + """, t AS (SELECT id, unnest(string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) AS term FROM texts), i AS (SELECT id, term, count(*) AS tf FROM t WHERE term <> '' GROUP BY ALL), s AS (SELECT id, sum(tf) AS size FROM i GROUP BY id),
st AS (SELECT count(*) AS n, avg(size) AS mean FROM s), h AS (SELECT * FROM i WHERE term = 'kubernetes'), d AS (SELECT count(*) AS df FROM h)
SELECT id, round(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS score FROM h JOIN s USING (id), st, d""")
def entity_search(spark, sf_dir):
    found = search.bm25_of_texts(search.searchable(entity_table(spark, sf_dir)), ["Kubernetes"])
    return search.ranked(found.select("id", F.round("score", 6).alias("score")))


@query(CLUSTERS + "SELECT candidate_id FROM flagged WHERE list_contains(skills, 'JavaScript')")
def skill_search(spark, sf_dir):
    return search.with_skill(entity_table(spark, sf_dir), "javascript").select("candidate_id")


@query("""WITH t AS (SELECT doc_id AS id, unnest(string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) AS term FROM documents), i AS (SELECT id, term, count(*) AS tf FROM t WHERE term <> '' GROUP BY ALL), s AS (SELECT id, sum(tf) AS size FROM i GROUP BY id),
st AS (SELECT count(*) AS n, avg(size) AS mean FROM s), h AS (SELECT * FROM i WHERE term IN ('and', 'of')), d AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT id AS doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM h JOIN d USING (term) JOIN s USING (id), st GROUP BY id HAVING count(*) = 2""")
def fts_bm25(spark, sf_dir):
    found = search.bm25_of_texts(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), ["and", "of"])
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(CLUSTERS + "SELECT candidate_id, overall_confidence FROM flagged WHERE overall_confidence >= 0.7")
def min_confidence_scan(spark, sf_dir):
    return entity_table(spark, sf_dir).filter("overall_confidence >= 0.7").select("candidate_id", "overall_confidence")


@query(f"""WITH {RECORDS} SELECT count(*) FILTER (WHERE ext_seq % 11 <> 0) AS found, count(*) FILTER (WHERE ext_seq % 17 = 0) AS missing, count(*) FILTER (WHERE ext_seq % 11 = 0) AS extra,
 avg(CASE WHEN ext_seq % 13 = 0 THEN 0 ELSE 1 END) FILTER (WHERE ext_seq % 11 <> 0) AS name_accuracy FROM rec""")
def gold_accuracy(spark, sf_dir):
    """Records against an expected table that lacks some of them, has others and gives other names to some."""
    rows = records_of(spark, sf_dir)
    name = F.when(F.col("ext_seq") % 13 == 0, F.concat(F.coalesce("name", F.lit("")), F.lit(" x"))).otherwise(F.col("name"))
    expected = rows.filter("ext_seq % 11 <> 0").select("ext_seq", name.alias("name"))
    expected = expected.unionByName(rows.filter("ext_seq % 17 = 0").select((-1 - F.col("ext_seq")).alias("ext_seq"), "name"))
    return report.accuracy(expected, rows, "ext_seq", ["name"])


MERGE_FIRST = """SELECT c_custkey AS ext_seq, concat('Person ', CAST(c_custkey AS STRING)) AS name, concat('m', CAST(c_custkey AS STRING), '@example.com') AS email,
 concat('+91 9', lpad(CAST(c_custkey AS STRING), 9, '0')) AS phone, 'Old Co' AS current_company, 'Engineer' AS title, CAST(NULL AS STRING) AS github_url, concat('City ', CAST(c_custkey % 7 AS STRING)) AS location FROM customer"""
MERGE_SECOND = """SELECT c_custkey AS ext_seq, CAST(NULL AS STRING) AS name, concat('M', CAST(c_custkey AS STRING), '@Example.com ') AS email,
 CAST(NULL AS STRING) AS phone, 'New Co' AS current_company, 'Lead' AS title, concat('https://github.com/m', CAST(c_custkey AS STRING)) AS github_url, CAST(NULL AS STRING) AS location FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey + 10000000, 'Another Name', CAST(NULL AS STRING), concat('+91 9', lpad(CAST(c_custkey AS STRING), 9, '0')), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM customer WHERE c_custkey % 4 = 0"""


@query(oracle="""SELECT concat('m', CAST(c_custkey AS VARCHAR), '@example.com') AS email, concat('Person ', CAST(c_custkey AS VARCHAR)) AS full_name,
 concat('+919', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS phone, concat('City ', CAST(c_custkey % 7 AS VARCHAR)) AS location,
 CASE WHEN c_custkey % 2 = 0 THEN concat('https://github.com/m', CAST(c_custkey AS VARCHAR)) END AS github,
 CASE WHEN c_custkey % 2 = 0 THEN 'Old Co/Engineer|New Co/Lead' ELSE 'Old Co/Engineer' END AS experience,
 CASE WHEN c_custkey % 4 = 0 THEN 0.725 ELSE 0.75 END::DOUBLE AS overall_confidence FROM customer""")
def incremental_merge(spark, sf_dir):
    """Two runs against one store: what the second brings joins what the first stored, also where it falls into two clusters of one entity."""
    import uuid

    from linkwright.operators.checkpoint import shared_folder
    from linkwright.operators.store import Store
    from linkwright.plans.pipeline import all_records, run
    from linkwright.sources.derived import _sql

    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    for text in (MERGE_FIRST, MERGE_SECOND):
        run(all_records(csv=_sql(spark, sf_dir, text, ("customer",))), store)
    return store.read("entities").select(
        F.get("emails", F.lit(0))["value"].alias("email"), F.col("full_name.value").alias("full_name"), F.get("phones", F.lit(0))["value"].alias("phone"), F.col("location.value").alias("location"), "github",
        joined(F.transform("experience", lambda x: F.concat_ws("/", x["company"], x["title"]))).alias("experience"), "overall_confidence")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
