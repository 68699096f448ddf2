"""Source records derived from the driver's tables; the SQL runs in Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CSV = """SELECT c_custkey AS ext_seq, concat('  ', replace(c_name, '#', '   '), ' ') AS name,
 CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN c_custkey % 10 = 7 THEN concat('bad', CAST(c_custkey AS STRING), '.example.com')
  ELSE concat(' User', CAST(c_custkey - CASE WHEN c_custkey % 5 = 4 THEN 1 ELSE 0 END AS STRING), '@Example.com') END AS email,
 CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('+91 9', lpad(CAST(c_custkey - CASE WHEN c_custkey % 7 = 6 THEN 2 ELSE 0 END AS STRING), 9, '0')) END AS phone,
 concat('Co ', CAST(c_custkey - c_custkey % 3 AS STRING)) AS current_company, concat('Title ', CAST(c_custkey % 4 AS STRING)) AS title,
 CASE WHEN c_custkey % 3 = 0 THEN concat('https://github.com/u', CAST(c_custkey AS STRING)) END AS github_url, concat(n_name, ', ', r_name) AS location
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

ATS = """SELECT s_suppkey AS ext_seq, concat('ATS-', CAST(s_suppkey AS STRING)) AS ats_record_id,
 concat(CASE WHEN s_suppkey % 2 = 0 THEN 'Customer ' ELSE 'Cust. ' END, lpad(CAST(s_suppkey * 3 AS STRING), 9, '0')) AS display_name,
 CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat('user', CAST(s_suppkey * 3 AS STRING), '@example.com') END AS primary_email,
 CASE WHEN s_suppkey % 2 = 0 THEN concat('9', lpad(CAST(s_suppkey * 2 + 1 AS STRING), 9, '0')) END AS mobile, concat('Co ', CAST(s_suppkey * 3 AS STRING)) AS employer,
 CASE s_suppkey % 4 WHEN 0 THEN 'js' WHEN 1 THEN 'K8s' WHEN 2 THEN 'unknown_skill' ELSE 'GOLANG' END AS tag1,
 CASE s_suppkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'c-programming' ELSE 'AWS' END AS tag2, concat('City ', CAST(s_suppkey % 10 AS STRING), ', ', n_name) AS geo
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

REST = """SELECT concat('u', CAST(o_custkey AS STRING)) AS username, p_brand AS language, o_orderkey, l_linenumber, l_partkey, l_suppkey
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""

RESUME = """SELECT c_custkey AS ext_seq, concat_ws(chr(10), CASE WHEN c_custkey % 2 = 0 THEN concat('Person ', chr(CAST(65 + c_custkey % 26 AS INT))) ELSE replace(c_name, '#000', ' ') END,
 concat('user', CAST(c_custkey AS STRING), '@example.com'), concat('+91 9', lpad(CAST(c_custkey AS STRING), 9, '0')), '', 'Technical Skills', 'Languages: Python, Java',
 concat('Tools: ', CASE c_custkey % 3 WHEN 0 THEN 'k8s | AWS' WHEN 1 THEN 'golang; node' ELSE 'reactjs, Kafka 2024' END), '- Achievements:', 'Solved 600+ Problems', 'Education', concat('University of ', n_name)) AS text
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 = 0"""

TABLES = {"csv": (CSV, ("customer", "nation", "region")), "ats": (ATS, ("supplier", "nation")), "rest": (REST, ("orders", "lineitem", "part")), "resume": (RESUME, ("customer", "nation"))}


def derived(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    text, tables = TABLES[which]
    return _sql(spark, sf_dir, text, tables)


def _sql(spark: SparkSession, sf_dir: str, text: str, tables: tuple[str, ...]) -> DataFrame:
    for name in tables:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)
