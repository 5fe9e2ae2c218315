"""Queries over record-shaped data: roles, date ranges, skills, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions.text import big
from postlens.operators import people as I
from postlens.operators import records as G
from postlens.plans import sql as S
from postlens.plans.quality import BUL, HEAD, SQL_BUL
from postlens.rules import records as R
from postlens.sources.tables import table

TAXONOMY = [("Programming Languages", "^the|^der"), ("Frameworks & Libraries", "^of|^de "), ("Cloud & DevOps", "^an|^la"), ("Data & AI", "^er|^en"), ("Databases", "^on|^que"),
            ("Security", "^in|^el"), ("Support & Platforms", "^re|^die"), ("Core Competencies", "ation|ment")]


def docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


def doc_roles(spark, folder):
    return G.roles(docs(spark, folder), header=HEAD, separator=" ", bullet=BUL)


def g01(spark, folder):
    return doc_roles(spark, folder).select("doc_id", "role_no", "company", "title", F.md5(F.array_join("bullets", "\n")).alias("bullets_md5"), big(F.size("bullets")).alias("n"))


def _ranges(spark, folder):
    orders = table(spark, folder, "orders")
    end = F.add_months("o_orderdate", (F.col("o_custkey") % 40).cast("int"))
    fmt = lambda d, p: F.date_format(d, p)
    raw = (F.when(F.col("o_orderstatus") == "O", F.concat(fmt("o_orderdate", "yyyy-MM"), F.lit(" – "), fmt(end, "yyyy-MM")))
           .when(F.col("o_orderstatus") == "F", F.concat(fmt("o_orderdate", "MMM yyyy"), F.lit(" - Present"))).otherwise(
               F.concat(fmt("o_orderdate", "MM/yyyy"), F.lit(" to "), fmt(end, "yyyy"))))
    return orders.select("o_orderkey", "o_custkey", raw.alias("raw"))


def g02(spark, folder):
    out = G.parse_ranges(_ranges(spark, folder), F.to_date(F.lit("2010-06-15")))
    return out.select("o_orderkey", F.date_format("start", "yyyy-MM-dd").alias("start"), F.date_format("end", "yyyy-MM-dd").alias("end"), F.col("is_current").cast("string").alias("is_current"), F.coalesce("months", F.lit(-1).cast("bigint")).alias("months"), "canonical")


def g03(spark, folder):
    line = table(spark, folder, "lineitem")
    day = F.unix_date(F.to_date("l_shipdate")).cast("bigint")
    spans = line.select("l_orderkey", "l_linenumber", day.alias("start"), (day + F.col("l_quantity").cast("bigint")).alias("end"))
    return G.tenure(spans, "l_orderkey", "start", "end", "l_linenumber", F.floor(F.col("start") / 30))


def g04(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("role_no"), F.col("o_orderdate").alias("start"))
    return G.role_order(orders).withColumn("was_sorted", F.col("was_sorted").cast("string"))


def g05(spark, folder):
    return G.contact_fields(docs(spark, folder))


def doc_skills(spark, folder):
    return G.skills(docs(spark, folder))


def g06(spark, folder):
    return doc_skills(spark, folder)


def g07(spark, folder):
    return G.group_skills(doc_skills(spark, folder), TAXONOMY, asked=["and", "the"]).withColumn("skills", F.array_join("skills", "|"))


def _profiles(spark, folder):
    c = table(spark, folder, "customer")
    role = lambda co, ti, st, bu, val: F.struct(F.col("c_name").alias(co), F.col("c_mktsegment").alias(ti), F.lit("2015").alias(st), val.alias(bu))
    lines = F.array(F.lit("Sold goods"), F.concat(F.lit("Served nation "), "c_nationkey"))
    wrap = lambda name, r: F.to_json(F.struct(F.array(r).alias(name)))
    payload = (F.when(F.col("c_mktsegment") == "HOUSEHOLD", wrap("professional_experience", role("company", "title", "startDate", "bullets", lines)))
               .when(F.col("c_mktsegment") == "MACHINERY", wrap("professionalExperience", role("companyName", "jobTitle", "start_date", "description", F.array_join(lines, "\n"))))
               .when(F.col("c_mktsegment") == "FURNITURE", wrap("work_experience", F.struct(F.col("c_name").alias("company_name"), F.lit("").alias("title"))))
               .otherwise(F.lit('{"name": "nobody"}')))
    return c.select(F.col("c_custkey").alias("profile_id"), payload.alias("payload"))


def g08(spark, folder):
    out = G.unify_profiles(_profiles(spark, folder))
    first = F.element_at("roles", 1)
    return out.select("profile_id", "source", first["company"].alias("company"), first["title"].alias("title"), first["start"].alias("start"), F.array_join(first["bullets"], "|").alias("bullets"),
                      F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


def g09(spark, folder):
    before = table(spark, folder, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("role_no"), F.col("o_orderstatus").alias("company"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM").alias("dates"))
    after = before.withColumn("title", F.when(F.col("company") == "P", "5-LOW").otherwise(F.col("title"))).withColumn("dates", F.when(F.col("title") == "1-URGENT", F.lit(None)).otherwise(F.col("dates")))
    return G.immutable_violations(before, after, ["doc_id", "role_no"])


def g10(spark, folder):
    """Customers' orders as roles: dates and months are those of the order and its shipments; open orders have no end."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    shipped = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("_last"), F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != "N", F.col("l_linenumber").cast("string")))).alias("bullets"))
    rows = orders.join(shipped, orders.o_orderkey == shipped.l_orderkey, "left").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("role_no"), F.concat(F.lit("Works "), F.col("o_orderkey") % 97).alias("company"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.substring("o_orderpriority", 3, 20)).alias("title"),
        F.when(F.col("o_totalprice") > 20000, F.date_format("o_orderdate", "yyyy-MM")).alias("start"), F.when(F.col("o_orderstatus") != "O", F.date_format("_last", "yyyy-MM")).alias("end"),
        F.floor(F.months_between("_last", "o_orderdate")).alias("months"), F.coalesce("bullets", F.array().cast("array<string>")).alias("bullets"))
    return G.extraction_quality(rows).select("doc_id", "confidence", F.array_join("warnings", "|").alias("warnings"), F.col("valid").cast("string").alias("valid"))


def _education(spark, folder):
    part = table(spark, folder, "part")
    text = F.concat_ws("\n", F.concat(F.initcap("p_name"), F.lit(" University | Master of "), F.initcap("p_type"), F.lit(" | "), (F.col("p_size") + 1970).cast("string")),
                       F.lit("GPA: 3.5"), F.concat(F.lit("Bachelor of "), F.initcap("p_type")), F.when(F.col("p_size") > 25, "2001 - 2004").otherwise("honours"))
    return part.select("p_partkey", text.alias("text"))


def g11(spark, folder):
    return G.education(_education(spark, folder), key="p_partkey")


def g11b(spark, folder):
    return G.certificates(docs(spark, folder))


def g11c(spark, folder):
    out = G.projects(docs(spark, folder), bullet="^(?:The|La|De|Der|Of) ")
    return out.select("doc_id", "entry", F.md5("name").alias("name_md5"), big(F.size("bullets")).alias("n"))


def g12(spark, folder):
    s, n = table(spark, folder, "supplier"), table(spark, folder, "nation")
    from postlens.plans.postings import place_name

    rows = s.join(n, s.s_nationkey == n.n_nationkey)
    header = (F.when(F.col("s_acctbal") < 2500, F.concat(F.lit("Acme Ltd, "), place_name("n_name"), F.lit(", Ireland")))
              .when(F.col("s_acctbal") < 5000, F.concat(F.lit("Acme, Inc., "), place_name("n_name")))
              .when(F.col("s_acctbal") < 7500, F.concat(place_name("n_name"), F.lit(" Works, Senior Engineer (Contract)"))).otherwise(F.concat(F.lit("Acme\t"), place_name("n_name"))))
    return G.split_headers(rows.select("s_suppkey", header.alias("header"))).drop("header")


def g13(spark, folder):
    o, cst = table(spark, folder, "orders"), table(spark, folder, "customer")
    rows = o.select(F.col("o_orderkey").alias("role_id"), F.concat(F.lit("Customer#"), F.lpad("o_custkey", 9, "0"), F.when(F.col("o_orderstatus") == "O", " Ltd").otherwise("")).alias("company"),
                    F.when(F.col("o_orderpriority") == "1-URGENT", "here").alias("location"))
    profiles = cst.select(F.col("c_custkey").alias("profile_id"), F.col("c_name").alias("company"), F.concat(F.lit("nation "), "c_nationkey").alias("location"))
    pairs = I.company_match(rows.select("role_id", "company"), profiles.select("profile_id", "company"), "role_id", "profile_id").where("agrees").select("role_id", "profile_id", F.lit(0).alias("rank"))
    out = G.enrich_roles(rows, profiles, pairs, "role_id", "profile_id", ["location"])
    return out.select("role_id", "company", "location", F.array_join("provenance", ",").alias("provenance"))


def g14(spark, folder):
    return G.flatten(doc_roles(spark, folder)).select("doc_id", F.md5("text").alias("text_md5"))


QUERIES = {"g1_roles": g01, "g2_parse_ranges": g02, "g3_tenure": g03, "g4_role_order": g04, "g5_contact_fields": g05, "g6_skills": g06, "g7_group_skills": g07, "g8_unify_profiles": g08,
           "g9_immutable_violations": g09, "g10_extraction_quality": g10, "g11_education": g11, "g11_certificates": g11b, "g11_projects": g11c, "g12_split_headers": g12, "g13_enrich_roles": g13, "g14_flatten": g14}

from postlens.plans.postings import SQL_PLACE  # noqa: E402

_ROLES = f"""sp AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
    ln AS (SELECT *, regexp_matches(l, {S.q(HEAD)}) AND NOT regexp_matches(l, {S.q(SQL_BUL)}) AS h, regexp_matches(l, {S.q(SQL_BUL)}) AS b FROM sp WHERE trim(l) <> ''),
    rl AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS role_no FROM ln),
    roles AS (SELECT doc_id, CAST(role_no AS BIGINT) AS role_no, max(CASE WHEN h THEN string_split(trim(l), ' ')[1] END) AS company, max(CASE WHEN h THEN coalesce(string_split(trim(l), ' ')[2], '') END) AS title,
      coalesce(list(trim(l) ORDER BY line_no) FILTER (WHERE b AND NOT h), []) AS bullets FROM rl WHERE role_no > 0 GROUP BY ALL)"""
ORACLES = {
    "g1_roles": f"WITH {_ROLES} SELECT doc_id, role_no, company, title, md5(array_to_string(bullets, chr(10))) AS bullets_md5, CAST(len(bullets) AS BIGINT) AS n FROM roles",
    "g2_parse_ranges": """WITH o AS (SELECT o_orderkey, o_orderstatus AS st, CAST(date_trunc('month', o_orderdate) AS DATE) AS s, CAST(date_trunc('month', o_orderdate) AS DATE) + to_months(CAST(o_custkey % 40 AS INTEGER)) AS e FROM orders),
        r AS (SELECT o_orderkey, st, s, CAST(CASE st WHEN 'O' THEN e WHEN 'F' THEN DATE '2010-06-01' ELSE date_trunc('year', e) END AS DATE) AS e FROM o), m AS (SELECT *, (year(e) - year(s)) * 12 + month(e) - month(s) AS mo FROM r)
        SELECT o_orderkey, strftime(s, '%Y-%m-%d') AS start, strftime(e, '%Y-%m-%d') AS end, CAST(st = 'F' AS VARCHAR) AS is_current, CASE WHEN mo >= 0 THEN mo ELSE -1 END AS months,
          strftime(s, '%m-%Y') || ' – ' || CASE WHEN st = 'F' THEN 'Present' ELSE strftime(e, '%m-%Y') END AS canonical FROM m""",
    "g3_tenure": """WITH d AS (SELECT l_orderkey, unnest(range(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)), date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT))) AS day FROM lineitem)
        SELECT l_orderkey, count(DISTINCT day) AS covered FROM d GROUP BY 1""",
    "g4_role_order": """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS role_no, o_orderdate AS s, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
        SELECT doc_id, role_no, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, role_no) AS new_no, CAST(count(*) FILTER (WHERE p < s) OVER (PARTITION BY doc_id) = 0 AS VARCHAR) AS was_sorted FROM o WHERE n >= 2""",
    "g5_contact_fields": r"""WITH t AS (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:15], chr(10)) AS top, trim(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')[1]) AS f FROM documents),
        e AS (SELECT *, nullif(regexp_extract(top, '([A-Za-z0-9_.+\-]+@[A-Za-z0-9_.\-]+\.[a-zA-Z]{2,})', 1), '') AS email, trim(nullif(regexp_extract(top, '((?:\+[0-9]{1,3}[ -]?)?(?:\(?[0-9]{2,4}\)?[ .\-]?)?[0-9]{3,4}[ .\-]?[0-9]{3,4})', 1), '')) AS phone FROM t)
        SELECT doc_id, CASE WHEN regexp_matches(f, '^[A-Za-z ''\-]+$') AND len(string_split_regex(f, ' +')) <= 5 THEN array_to_string(list_transform(string_split(f, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS name,
          email[1] || '***@' || regexp_extract(email, '@(.*)$', 1) AS email, '***' || right(phone, 2) AS phone, nullif(regexp_extract(top, '(?:^|[^A-Za-z0-9_])([A-Z][a-zA-Z ]+,[ ]*(?:[A-Z]{2}|[A-Za-z ]+))', 1), '') AS location,
          nullif(regexp_extract(top, '(?i)(linkedin\.com/in/[A-Za-z0-9_\-]+)', 1), '') AS profile, nullif(regexp_extract(top, '(?i)(github\.com/[A-Za-z0-9_\-]+)', 1), '') AS repo FROM e""",
    "g8_unify_profiles": """SELECT c_custkey AS profile_id, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'professional_experience' WHEN 'MACHINERY' THEN 'professionalExperience' WHEN 'FURNITURE' THEN 'work_experience' END AS source,
        CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY', 'FURNITURE') THEN c_name END AS company, CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN c_mktsegment WHEN c_mktsegment = 'FURNITURE' THEN '' END AS title,
        CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN '2015' WHEN c_mktsegment = 'FURNITURE' THEN '' END AS start,
        CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN 'Sold goods|Served nation ' || c_nationkey WHEN c_mktsegment = 'FURNITURE' THEN '' END AS bullets,
        CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN '' WHEN c_mktsegment = 'FURNITURE' THEN 'role 1: no title' ELSE 'no experience' END AS errors,
        CASE WHEN c_mktsegment = 'FURNITURE' THEN 'role 1: no start|role 1: no bullets' ELSE '' END AS warnings FROM customer""",
    "g9_immutable_violations": """SELECT o_custkey AS doc_id, o_orderkey AS role_no, 'title' AS field, o_orderpriority AS was, '5-LOW' AS now FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW'
        UNION ALL SELECT o_custkey, o_orderkey, 'dates', strftime(o_orderdate, '%Y-%m'), NULL FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'""",
    "g10_extraction_quality": """WITH l AS (SELECT l_orderkey, max(l_shipdate) AS last, count(*) FILTER (WHERE l_returnflag <> 'N') AS nb FROM lineitem GROUP BY 1),
        x AS (SELECT o_custkey AS doc_id, o_orderkey AS role_no, o_orderpriority <> '4-NOT SPECIFIED' AS ti, o_totalprice > 20000 AS st, o_orderstatus <> 'O' AND last IS NOT NULL AS en, coalesce(nb, 0) AS nb FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
        w AS (SELECT doc_id, unnest(list_filter([CASE WHEN NOT ti THEN 'no title in role ' || role_no END, CASE WHEN NOT st THEN 'no start in role ' || role_no END, CASE WHEN nb = 0 THEN 'no bullets in role ' || role_no END], lambda z: z IS NOT NULL)) AS m FROM x),
        wa AS (SELECT doc_id, string_agg(m, '|' ORDER BY m) AS warnings FROM w GROUP BY 1)
        SELECT doc_id, round(avg((1 + CAST(ti AS INT) + CAST(st AS INT) + CAST(en AS INT)) / 4), 4) AS confidence, coalesce(any_value(warnings), '') AS warnings, CAST(bool_or(ti) AS VARCHAR) AS valid FROM x LEFT JOIN wa USING (doc_id) GROUP BY doc_id""",
    "g11_education": """WITH p AS (SELECT p_partkey, p_size, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS n, upper(p_type[1]) || lower(p_type[2:]) AS t FROM part)
        SELECT p_partkey, CAST(1 AS BIGINT) AS entry, n || ' University' AS institution, 'Master of ' || t AS degree, CAST(1970 + p_size AS VARCHAR) AS date, '3.5' AS grade FROM p
        UNION ALL SELECT p_partkey, 2, NULL, 'Bachelor of ' || t, CASE WHEN p_size > 25 THEN '2001 - 2004' END, NULL FROM p""",
    "g11_certificates": """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '[•*▪\\-]', ',', 'g'), '[,\\n]'), lambda s: trim(s)), lambda s: len(s) > 5 AND len(s) < 100) AS l FROM documents)
        SELECT doc_id, unnest(l) AS certificate, generate_subscripts(l, 1) - 1 AS ord FROM s""",
    "g12_split_headers": f"""WITH r AS (SELECT s_suppkey, s_acctbal AS b, {SQL_PLACE} AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT s_suppkey, CASE WHEN b < 2500 THEN 'Acme Ltd' WHEN b < 5000 THEN 'Acme, Inc.' WHEN b < 7500 THEN n || ' Works' ELSE 'Acme' END AS company,
          CASE WHEN b < 2500 THEN n || ', Ireland' WHEN b < 5000 THEN n WHEN b < 7500 THEN NULL ELSE n END AS place, CASE WHEN b >= 5000 AND b < 7500 THEN 'Senior Engineer' END AS title, CASE WHEN b >= 5000 AND b < 7500 THEN 'contract' END AS employment_type FROM r""",
    "g13_enrich_roles": """WITH r AS (SELECT o_orderkey AS role_id, o_custkey, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || CASE WHEN o_orderstatus = 'O' THEN ' Ltd' ELSE '' END AS company, CASE WHEN o_orderpriority = '1-URGENT' THEN 'here' END AS location,
          row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
        SELECT role_id, company, CASE WHEN location IS NOT NULL THEN location WHEN rn = 1 THEN 'nation ' || c_nationkey END AS location, CASE WHEN location IS NULL AND rn = 1 AND c_nationkey IS NOT NULL THEN 'location' ELSE '' END AS provenance
        FROM r LEFT JOIN customer ON c_custkey = o_custkey""",
    "g14_flatten": f"""WITH {_ROLES}, b AS (SELECT doc_id, role_no, array_to_string(list_concat([company || CASE WHEN title <> '' THEN ' | ' || title ELSE '' END], list_transform(bullets, lambda x: '- ' || x)), chr(10)) AS t FROM roles)
        SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY role_no)) AS text_md5 FROM b GROUP BY 1""",
}

ORACLES.update({
    "g6_skills": f"""WITH i AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '[•*▪]|(?:^|\\n)[ ]*-', ',', 'g'), '[,\\n]'), lambda s: trim(s)), lambda s: len(s) BETWEEN 2 AND 40 AND lower(s) NOT IN {S.in_list(R.SOFT_ITEMS)}) AS l FROM documents),
        e AS (SELECT doc_id, unnest(l) AS skill, generate_subscripts(l, 1) - 1 AS i FROM i),
        o AS (SELECT doc_id, lower(skill) AS k, min(i) AS ord, arg_min(skill, (CASE WHEN skill = lower(skill) OR skill = upper(skill) THEN 1 ELSE 0 END) * 1000000 + i) AS skill FROM e GROUP BY ALL),
        g AS (SELECT doc_id, k, ord, skill, string_split_regex(k, '[ ]+') AS w FROM o),
        h AS (SELECT DISTINCT doc_id, unnest(list_filter(flatten(list_transform(range(1, 5), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))), lambda x: x <> k)) AS k FROM g)
        SELECT doc_id, ord, skill FROM g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = g.doc_id AND h.k = g.k)""",
    "g11_projects": """WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), t AS (SELECT doc_id, n, trim(l) AS l, regexp_matches(trim(l), '^(?:The|La|De|Der|Of) ') AS b FROM s WHERE trim(l) <> ''),
        e AS (SELECT *, NOT b AND len(l) > 5 AS o, sum(CASE WHEN NOT b AND len(l) > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS entry FROM t)
        SELECT doc_id, CAST(entry AS BIGINT) AS entry, md5(max(CASE WHEN o THEN string_split_regex(l, '[ ]*\\|[ ]*')[1] END)) AS name_md5, count(*) FILTER (WHERE b) AS n FROM e WHERE entry > 0 GROUP BY doc_id, entry""",
})
