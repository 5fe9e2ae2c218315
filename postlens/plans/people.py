"""Queries over published addresses, titles, companies and people."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions.text import big
from postlens.operators import people as I
from postlens.plans import sql as S
from postlens.plans.history import SQL_K, k_of
from postlens.plans.postings import CORPUS_PLATFORMS
from postlens.rules import records as R
from postlens.sources.tables import events, table

BOXES = ["careers", "jane.doe", "talent.team", "noreply", "accommodations", "hello", "x9"]


def contact_pages(spark, folder):
    """Pages that publish an address per customer: as a link, as structured data, in a meta tag or in prose."""
    c = table(spark, folder, "customer")
    box = F.element_at(F.array(*[F.lit(b) for b in BOXES]), (F.col("c_nationkey") % 7 + 1).cast("int"))
    addr = F.concat(box, F.lit("@corp"), "c_custkey", F.lit(".io"))
    ld = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.struct(addr.alias("email"), F.lit("Jo").alias("name")).alias("applicationContact"))), F.lit("</script>"))
    body = (F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit('<p>Ask <a href="mailto:'), addr, F.lit('?subject=x">us</a> or '), addr, F.lit("</p>")))
            .when(F.col("c_mktsegment") == "MACHINERY", ld).when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit('<meta name="reply-to" content="'), addr, F.lit('">')))
            .when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("<p>Write to "), addr, F.lit(".</p><p>Thanks</p>"))).otherwise(F.concat(F.lit("<nav>"), addr, F.lit("</nav>Write to "), addr, F.lit(".For more"))))
    return c.select(F.col("c_custkey").alias("page_id"), F.lit("https://x.example.com/").alias("url"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))


def i01(spark, folder):
    return I.published_addresses(contact_pages(spark, folder)).drop("context")


def i01b(spark, folder):
    return I.published_addresses(table(spark, folder, "pages"), mask=True).drop("context")


def i02(spark, folder):
    own = table(spark, folder, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("careers@corp"), "c_custkey", F.lit(".io")).alias("address"))
    return I.rank_addresses(I.published_addresses(contact_pages(spark, folder)), own=own)


def i03(spark, folder):
    c = table(spark, folder, "customer")
    text = (F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Questions? Contact Jane Okafor today. Department: Risk Team\nLocation: Cork, Ireland\n")
            .when(F.col("c_mktsegment") == "MACHINERY", "Ann Lee, Technical Recruiter helps. You join the Data Platform team now").when(F.col("c_mktsegment") == "FURNITURE", "Hiring Manager: Bo Li\nyou are based in Graz")
            .otherwise("nothing here"))
    out = I.posting_reference(c.select("c_custkey", text.alias("text"), F.concat(F.lit("R-"), "c_custkey").alias("job")), key="c_custkey", job_id="job")
    return out.withColumn("ref_lines", F.array_join("ref_lines", "|"))


def _titles(spark, folder):
    """Titles made of part types and order priorities' counterparts: role words per brand."""
    part = table(spark, folder, "part")
    words = ["Software Engineer", "Technical Recruiter", "Finance Recruiter", "Nurse", "Sales Lead", "Data Scientist", "Head of Product", "Gardener", "Scrum Master", "HR Partner"]
    return part.select("p_partkey", F.concat("p_type", F.lit(" "), F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_size") % 10 + 1).cast("int"))).alias("title"))


def i04(spark, folder):
    return I.discipline(_titles(spark, folder))


def i05(spark, folder):
    s = table(spark, folder, "supplier")
    left = s.select(F.col("s_suppkey").alias("l"), F.concat("s_name", F.lit(" Ltd")).alias("company"))
    right = s.select((F.col("s_suppkey") + 1000000).alias("r"), F.concat(F.lit("The "), F.regexp_replace("s_name", "#", " "), F.lit(" Group")).alias("company")).unionByName(
        s.select((F.col("s_suppkey") + 2000000).alias("r"), F.lit("Holdings Inc").alias("company")))
    return I.company_match(left, right, "l", "r").withColumn("agrees", F.col("agrees").cast("string"))


def i06(spark, folder):
    """Suppliers' postings against the customers whose orders they shipped."""
    line, orders, c, s = (table(spark, folder, t) for t in ("lineitem", "orders", "customer", "supplier"))
    title = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Technical Recruiter").when(F.col("c_mktsegment") == "MACHINERY", "Sales Recruiter").when(F.col("c_mktsegment") == "FURNITURE", "Head of Engineering").otherwise("Office Assistant")
    # Titles and names are read on the customers' and suppliers' own rows, before they meet.
    c = c.withColumn("title", title).withColumn("title_known", I.title_features("title")).withColumn("else_name", I.norm_company(F.lit("Elsewhere")))
    s = s.withColumn("firm", F.concat(F.lit("Firm "), "s_suppkey")).withColumn("p_company", F.concat("firm", F.lit(" Ltd"))).withColumn("p_title", F.lit("Software Engineer"))
    s = s.withColumn("firm_name", I.norm_company("firm")).withColumn("p_company_name", I.norm_company("p_company")).withColumn("p_role", I.discipline_of("p_title"))
    links = line.join(orders, line.l_orderkey == orders.o_orderkey).select("l_suppkey", "o_custkey").distinct()
    rows = links.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = rows.select(F.col("s_suppkey").alias("posting_id"), "title", "title_known", F.when(F.col("c_acctbal") > 5000, F.col("firm")).otherwise("Elsewhere").alias("company"), F.when(F.col("c_acctbal") > 5000, F.col("firm_name")).otherwise(F.col("else_name")).alias("company_name"),
                        F.col("c_nationkey").cast("string").alias("country"), F.concat(F.lit("city"), "c_nationkey").alias("city_text"), (F.col("c_custkey") % 100).cast("double").alias("confidence"), (F.col("c_acctbal") > 2000).alias("verified"),
                        F.concat(F.lit("p"), "c_custkey", F.when(F.col("c_acctbal") < 1000, "@gmail.com").otherwise(F.concat(F.lit("@firm"), "s_suppkey", F.lit(".io")))).alias("address"), "p_title", "p_role", "p_company_name",
                        "p_company", F.col("s_nationkey").cast("string").alias("p_country"), F.concat(F.lit("city"), "s_nationkey", F.lit("!")).alias("p_city"), F.concat(F.lit("firm"), "s_suppkey", F.lit(".io")).alias("p_domain"))
    return I.rank_candidates(pairs)


def i07(spark, folder):
    return I.first_tier(table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("tier")), "o_custkey")


def _people_payloads(spark, folder):
    c = table(spark, folder, "customer")
    addr = F.concat(F.lit("p"), "c_custkey", F.lit("@corp.io"))
    person = F.struct(F.col("c_name").alias("full_name"), F.struct(F.col("c_mktsegment").alias("name")).alias("company"), F.struct(F.array(F.struct(addr.alias("value"))).alias("list")).alias("emails"))
    deep = F.to_json(F.struct(F.struct(F.lit("Cork").alias("city"), F.array(person).alias("people")).alias("data")))
    flat = F.to_json(F.struct(F.lit("Jo").alias("first_name"), F.col("c_name").alias("last_name"), addr.alias("email"), F.lit("see x").alias("note")))
    return c.select(F.col("c_custkey").alias("payload_id"), F.when(F.col("c_acctbal") > 5000, deep).when(F.col("c_acctbal") > 1000, flat).otherwise('{"a": [1, {"b": "none"}]}').alias("payload"))


def i08(spark, folder):
    return I.scan_payloads(_people_payloads(spark, folder))


def i09(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("role"), F.when(F.col("c_acctbal") > 2000, F.lit("R-7")).alias("ref"))
    lines = ["Dear {{name}},", "about {{role}} , ref {{ref}} .", "Details:", "{{ref}}", "", "", "", "({{role}}) bye {{sender}}"]
    out = I.render(c, lines, {"name": "c_name", "role": "role", "ref": "ref"}, ["c_custkey"])
    return out.withColumn("unfilled", F.array_join("unfilled", "|"))


def send_tables(spark, folder):
    ev = events(spark, folder).withColumn("job_key", F.concat_ws("-", "user_id", k_of()))
    pick = lambda t: ev.where(F.col("event_type") == t).select(F.col("user_id").alias("company"), "job_key", F.col("ts").alias("at"), F.col("event_id").alias("request_id"))
    return pick("purchase").drop("request_id"), pick("signup")


def i10(spark, folder):
    out = I.send_policy(*send_tables(spark, folder))
    return out.withColumn("allowed", F.col("allowed").cast("string")).withColumn("next_eligible", F.date_format("next_eligible", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def i11(spark, folder):
    pages = table(spark, folder, "pages").withColumn("company", F.concat(F.lit("Acme "), F.regexp_extract("url", "/([a-z]{2})/", 1), F.lit(" Ltd")))
    return I.domain_candidates(pages, company="company", platforms=CORPUS_PLATFORMS[:1])


def i12(spark, folder):
    return I.payload_shapes(events(spark, folder), source="event_type", payload="props")


def i13(spark, folder):
    return I.target_titles(_titles(spark, folder), "p_partkey")


QUERIES = {"i1_published_addresses": i01, "i1_published_addresses_pages": i01b, "i2_rank_addresses": i02, "i3_posting_reference": i03, "i4_discipline": i04, "i5_company_match": i05, "i6_rank_candidates": i06,
           "i7_first_tier": i07, "i8_scan_payloads": i08, "i9_render": i09, "i10_send_policy": i10, "i11_domain_candidates": i11, "i12_payload_shapes": i12, "i13_target_titles": i13}

_BOX = "CASE c_nationkey % 7 " + " ".join(f"WHEN {i} THEN {S.q(b)}" for i, b in enumerate(BOXES)) + " END"
_SCORE = "CASE c_nationkey % 7 WHEN 0 THEN 88 WHEN 1 THEN 95 WHEN 2 THEN 100 WHEN 4 THEN 20 WHEN 5 THEN 50 WHEN 6 THEN 30 END"
_SRC = "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'mailto' WHEN 'MACHINERY' THEN 'json-ld' WHEN 'FURNITURE' THEN 'meta' ELSE 'page-text' END"
_DISC = "CASE " + " ".join(f"WHEN regexp_matches(t, {S.q(p)}) THEN {S.q(n)}" for n, p in R.DISCIPLINES) + " ELSE '' END"
_FIELD = "CASE " + " ".join(f"WHEN regexp_matches(t, {S.q(p)}) THEN {S.q(n)}" for n, p in [*R.ROLE_SHAPES, *R.FIELDS]) + " ELSE '' END"
_DISC2 = "CASE " + " ".join(f"WHEN regexp_matches(u, {S.q(p)}) THEN {S.q(n)}" for n, p in R.DISCIPLINES) + " ELSE '' END"
_TITLES = """tt AS (SELECT p_partkey, p_type || ' ' || ['Software Engineer', 'Technical Recruiter', 'Finance Recruiter', 'Nurse', 'Sales Lead', 'Data Scientist', 'Head of Product', 'Gardener', 'Scrum Master', 'HR Partner'][p_size % 10 + 1] AS title FROM part),
    td AS (SELECT p_partkey, title, lower(title) AS t, regexp_replace(lower(title), '""" + R.RECRUITING_WORDS + """', ' ', 'g') AS u FROM tt)"""
ORACLES = {
    "i1_published_addresses": f"SELECT c_custkey AS page_id, {_BOX} || '@corp' || c_custkey || '.io' AS address, {_SRC} AS source FROM customer",
    "i2_rank_addresses": f"""SELECT c_custkey AS page_id, ({_BOX})[1] || '***@corp' || c_custkey || '.io' AS address, CAST({_SCORE} + CASE {_SRC} WHEN 'mailto' THEN 3 WHEN 'json-ld' THEN 2 WHEN 'meta' THEN 1 ELSE 0 END AS BIGINT) AS score, CAST(1 AS BIGINT) AS rank
        FROM customer WHERE c_nationkey % 7 <> 3 AND NOT (c_acctbal > 9000 AND c_nationkey % 7 = 0)""",
    "i3_posting_reference": """SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Jane Okafor' WHEN 'MACHINERY' THEN 'Ann Lee' WHEN 'FURNITURE' THEN 'Bo Li' END AS name, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Data Platform' END AS department,
        CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Cork, Ireland' WHEN 'FURNITURE' THEN 'Graz' END AS location, 'Job ID: R-' || c_custkey || CASE c_mktsegment WHEN 'MACHINERY' THEN '|Department: Data Platform' WHEN 'HOUSEHOLD' THEN '|Location: Cork, Ireland' WHEN 'FURNITURE' THEN '|Location: Graz' ELSE '' END AS ref_lines FROM customer""",
    "i4_discipline": f"""WITH {_TITLES}, x AS (SELECT DISTINCT title, t, u FROM td)
        SELECT title, {_FIELD} AS field, {_DISC} AS discipline, CASE WHEN NOT regexp_matches(t, 'talent|recruit|sourc|hiring') THEN '' WHEN {_DISC2} = '' AND regexp_matches(t, '(?:^|[^a-z0-9_])(?:tech(?:nical)?|eng)(?:$|[^a-z0-9_])') THEN 'engineering' WHEN {_DISC2} = 'hr' THEN '' ELSE {_DISC2} END AS covers FROM x""",
    "i5_company_match": "SELECT s_suppkey AS l, s_suppkey + 1000000 AS r, 'true' AS agrees FROM supplier",
    "i6_rank_candidates": """WITH p AS (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        r AS (SELECT s_suppkey AS posting_id, 'p' || c_custkey || CASE WHEN c_acctbal < 1000 THEN '@gmail.com' ELSE '@firm' || s_suppkey || '.io' END AS address,
          CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 30 + 10 + 16 WHEN 'MACHINERY' THEN 30 + 10 - 18 - 25 WHEN 'FURNITURE' THEN 4 + 14 ELSE -6 END + CASE WHEN c_acctbal > 5000 THEN 18 ELSE -60 END + CASE WHEN c_nationkey = s_nationkey THEN 14 ELSE -30 END
          + round(CAST(c_custkey % 100 AS DOUBLE) / 10) + CASE WHEN c_acctbal > 2000 THEN 5 ELSE 0 END + CASE WHEN c_acctbal < 1000 THEN -20 ELSE 14 END AS score FROM p JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
        SELECT posting_id, address, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY posting_id ORDER BY score DESC, address) AS rank FROM r QUALIFY rank <= 5""",
    "i7_first_tier": "SELECT o_custkey, o_orderkey, substr(o_orderpriority, 1, 1) AS tier FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY substr(o_orderpriority, 1, 1)) = 1",
    "i8_scan_payloads": """SELECT c_custkey AS payload_id, CASE WHEN c_acctbal > 5000 THEN c_name ELSE 'Jo ' || c_name END AS name, '' AS title, CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE '' END AS company, CASE WHEN c_acctbal > 5000 THEN 'Cork' ELSE '' END AS location,
        'p' || c_custkey || '@corp.io' AS address FROM customer WHERE c_acctbal > 1000""",
    "i9_render": """SELECT c_custkey, 'Dear ' || c_name || ',' || chr(10) || 'about' || CASE WHEN c_acctbal > 5000 THEN ' ' || c_mktsegment ELSE '' END || ', ref' || CASE WHEN c_acctbal > 2000 THEN ' R-7' ELSE '' END || '.' || chr(10)
        || CASE WHEN c_acctbal > 2000 THEN 'Details:' || chr(10) || 'R-7' || chr(10) ELSE '' END || chr(10) || CASE WHEN c_acctbal > 5000 THEN '(' || c_mktsegment || ') ' ELSE ' ' END || 'bye {{sender}}' AS body, '{{sender}}' AS unfilled FROM customer""",
    "i10_send_policy": f"""WITH l AS (SELECT user_id AS company, user_id || '-' || {SQL_K} AS job_key, ts AS lt FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS request_id, user_id AS company, user_id || '-' || {SQL_K} AS job_key, ts AS rt FROM events WHERE event_type = 'signup'),
        f AS (SELECT request_id, any_value(rt) AS rt, count(lt) AS total, count(lt) FILTER (WHERE lt > rt - INTERVAL 30 DAY) AS inw, min(lt) FILTER (WHERE lt > rt - INTERVAL 30 DAY) AS oldest, max(lt) AS last, bool_or(l.job_key = r.job_key) AS same
          FROM r LEFT JOIN l ON l.company = r.company AND lt <= rt GROUP BY request_id),
        d AS (SELECT *, CASE WHEN coalesce(same, false) THEN 'same_posting' WHEN inw >= 6 THEN 'window' WHEN total >= 3 AND floor((epoch_us(rt) - epoch_us(last)) / 86400000000) < 5 THEN 'gap' ELSE 'ok' END AS reason FROM f)
        SELECT request_id, CAST(reason = 'ok' AS VARCHAR) AS allowed, reason, strftime(CASE reason WHEN 'window' THEN oldest + INTERVAL 30 DAY WHEN 'gap' THEN last + INTERVAL 5 DAY END, '%Y-%m-%d %H:%M:%S.%f') AS next_eligible, total AS sent, greatest(0, 3 - total) AS burst_left FROM d""",
    "i11_domain_candidates": """WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#:]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, regexp_extract(url, '://[^/]+/+([^/?#]+)', 1) AS slug FROM pages),
        d AS (SELECT page_id, list_distinct([CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN CASE WHEN regexp_matches(slug, '^[a-z0-9][a-z0-9\\-]{1,40}$') AND slug <> 'embed' THEN slug || '.com' END ELSE regexp_replace(host, '^(?:www|jobs|careers|apply|boards|job-boards)\\.', '') END]) AS a, lang FROM h),
        l AS (SELECT page_id, list_concat(list_filter(a, lambda x: x IS NOT NULL), ['acme' || lang || '.com', 'acme' || lang || '.io']) AS l FROM d)
        SELECT page_id, unnest(l) AS domain, generate_subscripts(l, 1) AS ord FROM l""",
    "i12_payload_shapes": "SELECT event_type AS source, 'OBJECT<k: BIGINT>' AS shape, count(*) AS n FROM events GROUP BY 1",
    "i13_target_titles": f"""WITH {_TITLES}, x AS (SELECT p_partkey, {_DISC} AS d FROM td),
        f(tier, title, ord) AS {S.values([(f'recruiter_{i}', t, n + 1) for n, (i, t) in enumerate([(i, t) for i, g in enumerate(R.TITLE_TIERS) for t in g])])}, m(d, title, ord) AS {S.values([(d, t, i + 1) for d, ts in R.FUNCTION_TITLES.items() for i, t in enumerate(ts)])}
        SELECT p_partkey, tier, title, CAST(ord AS BIGINT) AS ord FROM x, f UNION ALL SELECT p_partkey, 'manager', title, CAST(m.ord + {sum(len(g) for g in R.TITLE_TIERS)} AS BIGINT) FROM x JOIN m USING (d)""",
}

from postlens.plans.postings import _sql_clean, _sql_text  # noqa: E402

ORACLES["i1_published_addresses_pages"] = f"""WITH t AS (SELECT page_id, {_sql_text(_sql_clean('html'))} AS t FROM pages WHERE contains(html, '@')),
    a AS (SELECT page_id, unnest(regexp_extract_all(t, {S.q('(' + R.ADDRESS + ')')}, 1)) AS a FROM t), b AS (SELECT page_id, regexp_replace(regexp_replace(a, '[.,;:!?)\\]}}>''"«»]+$', ''), {S.q(I._RUN_ON)}, '\\1') AS a FROM a),
    m AS (SELECT page_id, min(a) AS a FROM b GROUP BY page_id, lower(a)) SELECT page_id, a[1] || '***@' || regexp_extract(a, '@(.*)$', 1) AS address, 'page-text' AS source FROM m"""
