"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions.session import shared_dir
from postlens.functions.text import big
from postlens.plans import sql as S
from postlens.plans.postings import SQL_PLACE, _sql_text, place_name
from postlens.rules import postings as R
from postlens.sources import landing as L
from postlens.sources.tables import events, read_pages, table


def s01(spark, folder):
    return read_pages(spark, folder).select("page_id", "url", big(F.length("html")).alias("html_chars"))


def s02(spark, folder):
    """Orders as CSV lines with foreign headers and a quoted note, parsed and renamed."""
    orders = table(spark, folder, "orders")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"),
                       F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit(" https://example.com/jobs/"), "o_orderkey")),
                       F.concat(F.lit("Customer "), "o_custkey"), F.lit("a@example.com"), F.lit(""),
                       F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")),
                       F.concat(F.lit('"late, or '), "o_orderstatus", F.lit('"')))
    schema = "seq long, `Job URL` string, `Candidate` string, `E_email` string, `Phone no` string, `Priority` string, `My Notes` string"
    parsed = orders.select(F.from_csv(line, schema).alias("r")).select("r.*")
    return L.as_queue(parsed, "seq").withColumn("selected", F.col("selected").cast("string"))


def s03(spark, folder):
    pages = table(spark, folder, "pages")
    lines = pages.select(F.explode(F.array(F.concat(F.lit("  "), "url", F.lit(" ")), F.concat(F.lit("ftp "), "url"))).alias("value"))
    return L.url_list(lines)


def _cities(spark, folder):
    """City rows derived from customers: accented names, one name in several countries."""
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.concat(place_name("n_name"), F.lit("é")).alias("name"), F.substring("c_mktsegment", 1, 2).alias("country"))


def s04(spark, folder):
    return L.load_cities(_cities(spark, folder))


def country_rows(spark, folder):
    """Nations as a country table: a two-letter code, a capital and two aliases each."""
    nation = table(spark, folder, "nation")
    code = F.concat(F.lit("Q"), F.chr(F.col("n_nationkey") + 65))
    return nation.select(code.alias("iso2"), place_name("n_name").alias("name"), F.concat(place_name("n_name"), F.lit(" City")).alias("capital"),
                         F.array(F.concat(F.lit("Republic of "), place_name("n_name")), F.concat(F.lit("É"), place_name("n_name"))).alias("aliases"))


SQL_CODE = "'Q' || chr(CAST(n_nationkey + 65 AS INTEGER))"


def s05(spark, folder):
    return L.load_countries(country_rows(spark, folder))


def s06(spark, folder):
    docs = table(spark, folder, "documents")
    green = F.to_json(F.struct(F.concat(F.lit(" "), "lang", F.lit(" role")).alias("title"), F.col("text").alias("content"),
                               F.struct(F.col("source").alias("name")).alias("location"), F.lit("Acme").alias("company_name"),
                               F.col("doc_id").cast("string").alias("requisition_id")))
    work = F.to_json(F.struct(F.struct(F.col("lang").alias("title"), F.col("text").alias("jobDescription"), F.col("source").alias("location"),
                                       F.concat(F.lit("R-"), "doc_id").alias("jobReqId")).alias("jobPostingInfo"),
                              F.struct(F.lit("Beta").alias("name")).alias("hiringOrganization")))
    rows = docs.select("doc_id", F.inline(F.array(F.struct(F.lit("greenhouse").alias("platform"), green.alias("payload")),
                                                  F.struct(F.lit("workday").alias("platform"), work.alias("payload")))))
    return L.posting_from_api(rows).drop("payload").withColumn("found", F.col("found").cast("string"))


def s07(spark, folder):
    path = shared_dir(spark, "history")
    L.append_history(events(spark, folder), path)
    return spark.read.parquet(path).groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dt")).agg(big(F.count("*")).alias("n"))


def s08(spark, folder):
    path = shared_dir(spark, "report")
    L.export_report(events(spark, folder), path)
    rows = spark.read.json(f"{path}/rows").groupBy("event_type").agg(big(F.count("*")).alias("row_count"))
    return spark.read.json(f"{path}/summary").join(rows, "event_type")


QUERIES = {"s1_read_pages": s01, "s2_read_queue": s02, "s3_url_list": s03, "s4_load_cities": s04, "s5_load_countries": s05,
           "s6_posting_from_api": s06, "s7_append_history": s07, "s8_export_report": s08}

ORACLES = {
    "s1_read_pages": "SELECT page_id, url, CAST(len(html) AS BIGINT) AS html_chars FROM pages WHERE trim(url) <> '' AND trim(html) <> ''",
    "s2_read_queue": """
        SELECT o_orderkey AS id, 'https://example.com/jobs/' || o_orderkey AS job_url, 'Customer ' || o_custkey AS candidate_name,
          'a@example.com' AS email, '' AS phone, CASE WHEN o_orderstatus = 'F' THEN 'medium' ELSE lower(o_orderpriority) END AS priority,
          'late, or ' || o_orderstatus AS notes, 'pending' AS status, 'true' AS selected FROM orders WHERE o_orderstatus <> 'P'""",
    "s3_url_list": "SELECT url AS job_url FROM pages WHERE regexp_matches(url, '(?i)^https?://')",
    "s4_load_cities": f"""
        WITH p(code, rank) AS {S.values([(code, i) for i, code in enumerate(R.COUNTRY_PRIORITY)])},
        k AS (SELECT lower({SQL_PLACE}) AS n, substr(c_mktsegment, 1, 2) AS cc FROM customer JOIN nation ON c_nationkey = n_nationkey),
        e AS (SELECT n || 'é' AS city_key, cc FROM k UNION ALL SELECT n || 'e', cc FROM k)
        SELECT city_key, arg_min(cc, lpad(CAST(coalesce(rank, 999) AS VARCHAR), 4, '0') || cc) AS country_iso2
        FROM e LEFT JOIN p ON cc = code GROUP BY city_key""",
    "s5_load_countries": f"""
        WITH c AS (SELECT {SQL_CODE} AS iso2, {SQL_PLACE} AS name FROM nation),
        k AS (SELECT unnest([lower(iso2), lower(name), 'republic of ' || lower(name), 'e' || lower(name)]) AS key, iso2, name FROM c)
        SELECT key, min(iso2) AS iso2, arg_min(name, iso2) AS name, arg_min(name || ' City', iso2) AS capital FROM k GROUP BY key""",
    "s6_posting_from_api": f"""
        WITH d AS (SELECT doc_id, lang, source, {_sql_text('text')} AS t FROM documents),
        f AS (SELECT *, len(t) >= 80 AS ok FROM d)
        SELECT doc_id, 'greenhouse' AS platform, CASE WHEN ok THEN t ELSE '' END AS description, CAST(ok AS VARCHAR) AS found,
          CASE WHEN ok THEN lang || ' role' ELSE '' END AS title, CASE WHEN ok THEN 'Acme' ELSE '' END AS company,
          CASE WHEN ok THEN source ELSE '' END AS location, CASE WHEN ok THEN CAST(doc_id AS VARCHAR) ELSE '' END AS job_id FROM f
        UNION ALL SELECT doc_id, 'workday', CASE WHEN ok THEN t ELSE '' END, CAST(ok AS VARCHAR), CASE WHEN ok THEN lang ELSE '' END,
          CASE WHEN ok THEN 'Beta' ELSE '' END, CASE WHEN ok THEN source ELSE '' END, CASE WHEN ok THEN 'R-' || doc_id ELSE '' END FROM f""",
    "s7_append_history": "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n FROM events GROUP BY 1",
    "s8_export_report": "SELECT event_type, count(*) AS n, count(*) AS row_count FROM events GROUP BY 1",
}
