"""Queries over raw pages and documents: the page-to-posting family."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions.text import big
from postlens.operators import postings as P
from postlens.plans import sql as S
from postlens.rules import postings as R
from postlens.sources.tables import read_pages, table

# Platforms for the corpus at hand: its hosts play the part of hiring platforms.
CORPUS_PLATFORMS = [("alpha", ["example.com"]), ("beta", ["example.net"]), ("gamma", ["m.example.org", "example.org"])]
CORPUS_IDS = [r"(?i)/(?:en|fr|de|es)/([0-9]+)"]
CORPUS_HEADINGS = [("requirements", "the|les?"), ("skills", "is|and|la"), ("about", "of|de|der"), ("duties", "in|en|el")]
CORPUS_BOILERPLATE = [*R.BOILERPLATE, r"(?i)(?:licensed under|released under)[^\n]*(\n|\z)", r"(?i)nicht aulich[^\n]*(\n|\z)"]
CORPUS_PARTS = [
    ("alpha", 1, r"(?is)<h1[^>]*>(.*?)</h1>", 2), ("alpha", 2, r"(?is)<li[^>]*>(.*?)</li>", 1),
    ("beta", 1, r"(?is)<title[^>]*>(.*?)</title>", 1), ("", 1, r"(?is)<article[^>]*>(.*?)</article>", 1),
]
CORPUS_SECTION_CUES = "the of|of the|and the|de la|der"
CORPUS_NARRATIVE = "que la|die |was the|on the"


def place_name(col):
    """The synthetic nation names as one capitalised word without digits."""
    return F.initcap(F.translate(col, "_0123456789", "abcdefghijk"))


SQL_PLACE = "'N' || lower(substr(translate(n_name, '_0123456789', 'abcdefghijk'), 2))"


def _titles(spark, folder):
    """Page titles in the shapes sites print them: bare, with site furniture, with a number."""
    pages = table(spark, folder, "pages")
    h1 = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    host = F.regexp_extract("url", r"://([^/?#]+)", 1)
    kinds = F.array(
        F.struct(F.lit("plain").alias("kind"), h1.alias("title")),
        F.struct(F.lit("tab").alias("kind"), F.concat(h1, F.lit(" | "), host, F.lit(" Careers")).alias("title")),
        F.struct(F.lit("id").alias("kind"), F.concat(F.lit("REQ-10"), F.col("page_id").cast("string"), F.lit(" "),
                                                      h1, F.lit(" (Remote)")).alias("title")),
        F.struct(F.lit("label").alias("kind"), F.lit("Careers at ").alias("title")),
    )
    return pages.select("page_id", F.inline(kinds))


def b01(spark, folder):
    return P.pages_to_text(read_pages(spark, folder))


def b02(spark, folder):
    out = P.normalise_text(table(spark, folder, "documents").select("doc_id", "text"), max_len=10000)
    return out.select("doc_id", F.md5("text").alias("text_md5"), big(F.length("text")).alias("n_chars"),
                      F.col("was_cut").cast("string").alias("was_cut"))


def b03(spark, folder):
    out = P.strip_boilerplate(table(spark, folder, "documents").select("doc_id", "text"), patterns=CORPUS_BOILERPLATE)
    return out.select("doc_id", F.md5("text").alias("text_md5"), "removed_chars")


def b04(spark, folder):
    return P.classify_structure(table(spark, folder, "documents").select("doc_id", "text"),
                                section_cues=CORPUS_SECTION_CUES, narrative_cues=CORPUS_NARRATIVE).drop("text")


def b05(spark, folder):
    return P.split_sections(table(spark, folder, "documents"), "doc_id", headings=CORPUS_HEADINGS).select(
        "doc_id", "section", "ord", F.md5("body").alias("body_md5"), big(F.length("body")).alias("n_chars"))


def _ld_pages(spark, folder):
    """Pages with embedded structured data made of the part table, in the nestings sites use."""
    part = table(spark, folder, "part").repartition("p_partkey")  # small rows in one split, but each becomes a page to parse
    job = F.struct(
        F.lit("JobPosting").alias("@type"), F.concat(F.lit("<b>"), "p_name", F.lit("</b>")).alias("title"),
        F.struct(F.col("p_brand").alias("name"), F.concat(F.lit("https://"), F.lower(F.translate("p_brand", "#", "")),
                                                         F.lit(".example.com")).alias("url")).alias("hiringOrganization"),
        F.struct(F.struct(F.col("p_type").alias("addressLocality"), F.lit("IE").alias("addressCountry")).alias("address")).alias("jobLocation"),
        F.concat(F.lit("A "), "p_type", F.lit(" &amp; "), "p_name").alias("description"),
        F.struct(F.col("p_partkey").cast("string").alias("value")).alias("identifier"),
    )
    root = F.to_json(job)
    listed = F.to_json(F.array(job))
    graph = F.to_json(F.struct(F.array(F.struct(F.struct(job.alias("mainEntity")).alias("page"))).alias("@graph")))
    body = F.when(F.col("p_size") < 15, root).when(F.col("p_size") < 30, listed).when(F.col("p_size") < 48, graph).otherwise("{broken")
    return part.select(F.col("p_partkey").alias("page_id"), F.lit("").alias("url"), F.concat(
        F.lit('<html><head><script type="application/ld+json">'), body, F.lit("</script></head></html>")).alias("html"))


def b06(spark, folder):
    return P.jsonld_postings(_ld_pages(spark, folder))


def b07(spark, folder):
    return P.detect_platform(table(spark, folder, "pages").select("page_id", "url"), [*R.PLATFORM_HOSTS, *CORPUS_PLATFORMS])


def b08(spark, folder):
    pages = P.pages_to_text(read_pages(spark, folder))
    return P.extract_job_id(pages, platform_ids=[*R.PLATFORM_JOB_IDS, *CORPUS_IDS]).select("page_id", "job_id", "via")


def b09(spark, folder):
    return P.posting_key(table(spark, folder, "pages").select("page_id", "url"), platform_ids=[
        *R.PLATFORM_JOB_IDS, r"(?i)/(?:en|fr)/([0-9]+)"]).drop("url")


def b10(spark, folder):
    return P.classify_page(table(spark, folder, "pages"), thank_you_texts=[*R.THANK_YOU_TEXTS, "erreth was", "of the"],
                           apply_words=[*R.APPLY_URL_WORDS, "page"], listing_urls=[*R.LISTING_URLS, "/de/", "/es/"]
                           ).select("page_id", "page_class")


def b11(spark, folder):
    return P.normalise_titles(_titles(spark, folder))


def b12(spark, folder):
    pages = P.posting_key(read_pages(spark, folder))
    h1 = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    lang = F.regexp_extract("html", r'(?is)<html[^>]*lang="([^"]*)"', 1)
    li = F.regexp_extract("html", r"(?is)<li[^>]*>(.*?)</li>", 1)

    def one(title, company, location, description):
        rows = pages.select("posting_key", title.alias("title"), company.alias("company"), location.alias("location"),
                            F.lit("").alias("job_id"), description.alias("description"))
        return rows.groupBy("posting_key").agg(*[F.min(x).alias(x) for x in ("title", "company", "location", "job_id", "description")])

    api = one(F.when(F.col("url").contains("?"), h1).otherwise("Apply"), F.lit(""), lang, F.lit("short"))
    ld = one(F.lit("Sign in"), F.col("host"), F.lit(""), P.tags_to_text(h1))
    page = one(h1, F.lit("Careers"), F.lit("xx"), P.tags_to_text(li))
    return P.merge_postings([api, ld, page])


def b13(spark, folder):
    return P.collapse_copies(table(spark, folder, "documents")).drop("fp")


def _platform_pages(spark, folder):
    return P.detect_platform(read_pages(spark, folder), CORPUS_PLATFORMS)


def b14(spark, folder):
    return P.assemble_parts(_platform_pages(spark, folder), CORPUS_PARTS)


def b15(spark, folder):
    return P.page_links(read_pages(spark, folder), r"^/(.*)$", drop_chrome=False).withColumn(
        "is_external", F.col("is_external").cast("string"))


def _posting_lines(spark, folder):
    supplier, nation = table(spark, folder, "supplier"), table(spark, folder, "nation")
    joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    name = place_name("n_name")
    text = (
        F.when(F.col("s_acctbal") < 2000, F.concat(F.lit("We hire.\nLocation: "), name, F.lit(" | now")))
        .when(F.col("s_acctbal") < 4000, F.concat(F.lit("Fully remote, "), name, F.lit(". Ask "), "s_name"))
        .when(F.col("s_acctbal") < 6000, F.concat(F.lit("Our site in "), name, F.lit(", IE stays.")))
        .when(F.col("s_acctbal") < 8000, F.concat(F.lit("Our site in "), name, F.lit(", Ireland stays.")))
        .otherwise(F.concat(F.lit("Ask "), "s_name"))
    )
    return joined.select("s_suppkey", text.alias("text"))


def b16(spark, folder):
    return P.location_candidates(_posting_lines(spark, folder)).drop("text").withColumn(
        "place_shaped", F.col("place_shaped").cast("string"))


QUERIES = {
    "b1_pages_to_text": b01, "b2_normalise_text": b02, "b3_strip_boilerplate": b03, "b4_classify_structure": b04,
    "b5_split_sections": b05, "b6_jsonld_postings": b06, "b7_detect_platform": b07, "b8_extract_job_id": b08,
    "b9_posting_key": b09, "b10_classify_page": b10, "b11_normalise_titles": b11, "b12_merge_postings": b12,
    "b13_fingerprint": b13, "b14_assemble_parts": b14, "b15_page_links": b15, "b16_location_candidates": b16,
}

# ---------------------------------------------------------------- SQL twins

_BLOCKS = [(r"(?i)</(p|div|li|h[1-6]|tr|section|br)[^>]*>", " "), (r"(?i)<br[ \t\r\n]*/?>", " "), (r"<[^>]+>", ""),
           (r"(?i)&nbsp;", " "), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (r"(?i)&#39;|&apos;", "'"),
           (r"(?i)&quot;", '"'), (r"(?i)&amp;", "&")]


def _sql_text(expr: str) -> str:
    return S.squeeze(S.replace_all(expr, _BLOCKS))


def _sql_clean(expr: str) -> str:
    steps = [(r"(?s)<!--.*?-->", " ")] + [(rf"(?is)<{t}[ \t\r\n>].*?</{t}[ \t\r\n]*>", " ") for t in R.DROPPED_TAGS]
    for tag in ("div", "section", "aside", "ul"):
        steps.append((rf'(?is)<{tag}[^>]*[ ]class="(?:[^"]*[ ])?(?:{"|".join(R.DROPPED_CLASSES)})(?:[ ][^"]*)?"[^>]*>.*?</{tag}>', " "))
    return S.replace_all(expr, steps)


def _sql_normal(expr: str) -> str:
    return "trim(" + S.replace_all(expr, [(r"[\r\n]+", r"\n"), ("[ \\t ]+", " "), (r"\n ", r"\n"), (r" \n", r"\n"),
                                           (r"\A\n+|\n+\z", "")]).replace("'\\n'", "chr(10)") + ")"


def _nl(text: str) -> str:
    return text


_HOST = "regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://([^/?#:]+)', 1), '^www\\.|\\.$', '', 'g')"
_PATH = "coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+(/[^?#]*)', 1), ''), '/')"


def _sql_boilerplate() -> str:
    out = "text"
    for p in CORPUS_BOILERPLATE:
        out = f"regexp_replace({out}, {S.q(p)}, chr(10) || '\\1', 'g')"
    return out


def _sql_sections() -> str:
    unions = " UNION ALL ".join(
        f"SELECT doc_id, text, {S.q(n)} AS section, len(regexp_extract(text, {S.q('(?is)^(.*?)(?:^|' + chr(92) + 'n)(?:' + w + ')')}, 1)) AS a, "
        f"regexp_extract(text, {S.q('(?i)(?:^|' + chr(92) + 'n)(?:' + w + ')[: ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n]*')}) AS m FROM documents"
        for n, w in CORPUS_HEADINGS)
    return unions


ORACLES = {
    "b1_pages_to_text": f"SELECT page_id, url, {_sql_text(_sql_clean('html'))} AS text FROM pages",
    "b2_normalise_text": f"""
        WITH t AS (SELECT doc_id, {_sql_normal('text')} AS x FROM documents),
        p AS (SELECT doc_id, x, len(x) > 10000 AS cut, len(regexp_extract(substr(x, 1, 10002), '(?s)^(.*)\\. ', 1)) AS s FROM t),
        r AS (SELECT doc_id, cut, CASE WHEN NOT cut THEN x WHEN s > 8000 THEN substr(x, 1, s + 1) ELSE substr(x, 1, 10000) END AS y FROM p)
        SELECT doc_id, md5(y) AS text_md5, CAST(len(y) AS BIGINT) AS n_chars, CAST(cut AS VARCHAR) AS was_cut FROM r""",
    "b3_strip_boilerplate": f"""
        WITH t AS (SELECT doc_id, {_sql_normal('text')} AS b, {_sql_normal(_sql_boilerplate())} AS x FROM documents)
        SELECT doc_id, md5(x) AS text_md5, CAST(len(b) - len(x) AS BIGINT) AS removed_chars FROM t""",
    "b4_classify_structure": f"""
        WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: len(w) >= 3) AS w FROM documents)
        SELECT doc_id, CASE WHEN {S.hits('text', R.BULLET_MARK)} >= 5 THEN 'bullets'
          WHEN {S.hits('text', '(?i)(?:' + CORPUS_SECTION_CUES + ')[: \\t\\r\\n]')} >= 2 THEN 'sections'
          WHEN {S.hits('text', '(?i)' + CORPUS_NARRATIVE)} >= 2 THEN 'narrative'
          WHEN len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z0-9+#.\\-]+$'))) > 0.3 * len(w) THEN 'phrases'
          ELSE 'raw_text' END AS structure FROM t""",
    "b5_split_sections": f"""
        WITH h AS (SELECT * FROM ({_sql_sections()}) WHERE m <> ''),
        s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, len(m), section) AS ord,
                     lead(a) OVER (PARTITION BY doc_id ORDER BY a, len(m), section) AS nxt FROM h),
        r AS (SELECT doc_id, section, ord, trim(substr(text, a + len(m) + 1, greatest(coalesce(nxt, len(text)) - a - len(m), 0))) AS body FROM s
              UNION ALL SELECT doc_id, 'other', 0, trim(substr(any_value(text), 1, min(a))) FROM h GROUP BY doc_id HAVING min(a) > 0)
        SELECT doc_id, section, CAST(ord AS BIGINT) AS ord, md5(body) AS body_md5, CAST(len(body) AS BIGINT) AS n_chars FROM r""",
    "b6_jsonld_postings": """
        SELECT p_partkey AS page_id, p_name AS title, p_brand AS company,
          'https://' || lower(replace(p_brand, '#', '')) || '.example.com' AS org_url, p_type || ', IE' AS location,
          'A ' || p_type || ' & ' || p_name AS description, CAST(p_partkey AS VARCHAR) AS job_id
        FROM part WHERE p_size < 48""",
    "b7_detect_platform": f"""
        WITH r(platform, fragment, ord) AS {S.values([(n, f, i) for i, (n, fs) in enumerate([*R.PLATFORM_HOSTS, *CORPUS_PLATFORMS]) for f in fs])},
        h AS (SELECT page_id, url, {_HOST} AS host FROM pages)
        SELECT page_id, any_value(url) AS url, coalesce(arg_min(platform, ord), '') AS platform
        FROM h LEFT JOIN r ON host = fragment OR ends_with(host, '.' || fragment) GROUP BY page_id""",
    "b8_extract_job_id": f"""
        WITH t AS (SELECT page_id, url, {_sql_text(_sql_clean('html'))} AS text FROM pages),
        x AS (SELECT page_id, {S.coalesce_picks('text', R.TEXT_JOB_IDS)} AS l, {S.coalesce_picks('url', [*R.PLATFORM_JOB_IDS, *CORPUS_IDS])} AS o,
              {S.coalesce_picks('url', R.GENERIC_JOB_IDS)} AS g FROM t)
        SELECT page_id, coalesce(l, o, g, '') AS job_id, CASE WHEN l IS NOT NULL THEN 'label' WHEN o IS NOT NULL THEN 'platform'
          WHEN g IS NOT NULL THEN 'generic' ELSE 'none' END AS via FROM x""",
    "b9_posting_key": f"""
        WITH h AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path, string_split({_HOST}, '.') AS p FROM pages),
        d AS (SELECT page_id, host, CASE WHEN len(p) <= 2 THEN host
                WHEN regexp_matches(p[-2] || '.' || p[-1], '^(co|com|org|net|ac|gov)\\.[a-z]{{2}}$') THEN p[-3] || '.' || p[-2] || '.' || p[-1]
                ELSE p[-2] || '.' || p[-1] END AS domain,
              lower(coalesce(nullif(regexp_replace(regexp_replace(path, '/+$', ''), {S.q('(?i)(?:/(?:' + '|'.join(R.APPLY_TAILS) + '|step[0-9]*|c)){1,4}$')}, ''), ''), '/')) AS base_path,
              lower({S.coalesce_picks('url', [*R.PLATFORM_JOB_IDS, '(?i)/(?:en|fr)/([0-9]+)', *R.GENERIC_JOB_IDS])}) AS id FROM h)
        SELECT page_id, host, domain, base_path, CASE WHEN id IS NOT NULL THEN 'id:' || domain || ':' || id
          ELSE 'path:' || domain || ':' || base_path END AS posting_key FROM d""",
    "b11_normalise_titles": f"""
        WITH h AS (SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages),
        k AS (SELECT page_id, 'plain' AS kind, h1 AS t FROM h UNION ALL SELECT page_id, 'tab', h1 || ' | ' || host || ' Careers' FROM h
              UNION ALL SELECT page_id, 'id', 'REQ-10' || page_id || ' ' || h1 || ' (Remote)' FROM h UNION ALL SELECT page_id, 'label', 'Careers at ' FROM h),
        a AS (SELECT page_id, kind, {S.squeeze('t')} AS t FROM k),
        b AS (SELECT *, list_filter(list_transform(string_split_regex(t, '[ \t]*[|·•‧–—][ \t]*|[ \t]+-[ \t]+'), lambda s: trim(s)), lambda s: s <> '') AS g FROM a),
        e AS (SELECT page_id, kind, CASE WHEN len(g) > 1 AND len(g[1]) >= 3 AND (len(g) > 2
                OR regexp_matches(array_to_string(g[2:], ' '), {S.q(P._FURNITURE)})
                OR regexp_matches(array_to_string(g[2:], ' '), '(?i)(?:^|[^A-Za-z0-9_])(?:careers?|jobs?|hiring|apply|openings?)(?:[^A-Za-z0-9_]|$)')) THEN g[1] ELSE t END AS t FROM b),
        f AS (SELECT page_id, kind, {S.replace_all('t', P.TITLE_STEPS)} AS t FROM e)
        SELECT page_id, kind, CASE WHEN regexp_matches(trim(t), {S.q(P._FURNITURE)}) THEN '' ELSE {S.squeeze(S.replace_all('t', P.TITLE_NUMBERS))} END AS title FROM f""",
    "b12_merge_postings": f"""
        WITH h AS (SELECT *, {_HOST} AS host, {_PATH} AS path FROM pages),
        d AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS domain,
              lower(coalesce(nullif(regexp_replace(path, '/+$', ''), ''), '/')) AS bp, {S.coalesce_picks('url', [*R.PLATFORM_JOB_IDS, *R.GENERIC_JOB_IDS])} AS id FROM h),
        k AS (SELECT CASE WHEN id IS NOT NULL THEN 'id:' || domain || ':' || lower(id) ELSE 'path:' || domain || ':' || bp END AS posting_key, url, host,
              regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1, regexp_extract(html, '(?is)<html[^>]*lang="([^"]*)"', 1) AS lang,
              regexp_extract(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS li FROM d),
        g AS (SELECT posting_key, min(CASE WHEN contains(url, '?') THEN h1 ELSE 'Apply' END) AS t1, min(lang) AS l1, min(host) AS c2,
              min({_sql_text('h1')}) AS d2, min(h1) AS t3, min({_sql_text('li')}) AS d3 FROM k GROUP BY 1),
        v AS (SELECT posting_key, CASE WHEN trim(t1) = '' OR lower(trim(t1)) IN {S.in_list(R.PAGE_LABELS)} THEN NULL ELSE trim(t1) END AS t1,
              nullif(trim(l1), '') AS l1, nullif(trim(c2), '') AS c2, d2, CASE WHEN trim(t3) = '' OR lower(trim(t3)) IN {S.in_list(R.PAGE_LABELS)} THEN NULL ELSE trim(t3) END AS t3, d3 FROM g)
        SELECT posting_key, coalesce(t1, t3) AS title, c2 AS company, coalesce(l1, 'xx') AS location, CAST(NULL AS VARCHAR) AS job_id,
          CASE WHEN 5 >= len(d2) AND 5 >= len(d3) THEN 'short' WHEN len(d2) >= len(d3) THEN d2 ELSE d3 END AS description, CAST(3 AS BIGINT) AS sources FROM v""",
    "b13_fingerprint": """
        SELECT min(doc_id) AS doc_id, count(*) AS copies, CAST(len(text) AS BIGINT) AS n_chars
        FROM documents WHERE len(text) >= 50 GROUP BY text""",
    "b15_page_links": f"""
        WITH a AS (SELECT page_id, {_HOST} AS own, unnest(regexp_extract_all(html, '(?is)(<a[ \\t\\r\\n][^>]*href=[^>]*>.*?</a>)', 1)) AS a FROM pages),
        l AS (SELECT page_id, own, trim(regexp_extract(a, '(?is)href=["'']?([^"''> ]+)', 1)) AS href, {_sql_text('a')} AS text FROM a),
        u AS (SELECT page_id, own, href, min(text) AS text FROM l WHERE href <> '' GROUP BY ALL)
        SELECT page_id, href, text, coalesce(nullif({_HOST.replace('lower(url)', 'lower(href)')}, ''), own) AS host,
          CAST(coalesce(nullif({_HOST.replace('lower(url)', 'lower(href)')}, ''), own) <> own AS VARCHAR) AS is_external,
          regexp_extract(href, '^/(.*)$', 1) AS handle FROM u""",
    "b14_assemble_parts": f"""
        WITH h AS (SELECT page_id, html, {_HOST} AS host FROM pages),
        p AS (SELECT page_id, html, CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'alpha'
               WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'beta'
               WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'gamma' ELSE '' END AS platform FROM h),
        x AS ({' UNION ALL '.join(
            f"SELECT page_id, {o} AS ord, {w} AS weight, array_to_string(list_filter(list_transform(regexp_extract_all(html, {S.q(pat)}, 1), lambda z: {_sql_text('z')}), lambda z: z <> ''), ' ') AS text FROM p WHERE {'platform = ' + S.q(n) if n else 'platform NOT IN ' + S.in_list(['alpha', 'beta'])}"
            for n, o, pat, w in CORPUS_PARTS)})
        SELECT page_id, CAST(ord AS BIGINT) AS ord, CAST(weight AS BIGINT) AS weight, text FROM x WHERE text <> ''""",
    "b10_classify_page": f"""
        WITH t AS (SELECT page_id, lower(url) AS u, html,
            lower({_sql_text(S.replace_all('html', [(r"(?is)<script[ \t\r\n>].*?</script[ \t\r\n]*>", " "), (r"(?is)<style[ \t\r\n>].*?</style[ \t\r\n]*>", " ")]))}) AS b,
            lower(array_to_string(regexp_extract_all(html, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1), ' ')) AS h FROM pages),
        f AS (SELECT *, {S.hits('html', r'(?i)<(?:input|select|textarea)[ \t\r\n>/]')} - {S.hits('html', r'(?i)<input[^>]*type="?(?:hidden|submit)"?')} AS n,
            {S.hits('html', r'(?i)<input[^>]*type="?file"?')} AS files FROM t)
        SELECT page_id, CASE
          WHEN {' OR '.join(f"contains(u, {S.q(x)})" for x in R.THANK_YOU_URLS)}
            OR {' OR '.join(f"(contains(b, {S.q(x)}) AND (contains(h, {S.q(x)}) OR strpos(b, {S.q(x)}) <= 500))" for x in [*R.THANK_YOU_TEXTS, 'erreth was', 'of the'])} THEN 'thank_you'
          WHEN regexp_matches(u, '(?:/|[?&#])(?:{'|'.join([*R.APPLY_URL_WORDS, 'page'])})(?:[^a-z0-9]|$)') OR ((n >= 6 OR files >= 1) AND len(b) < 400) THEN 'application'
          WHEN {' OR '.join(f"contains(u, {S.q(x)})" for x in [*R.LISTING_URLS, '/de/', '/es/'])}
            OR (regexp_matches(html, '(?i)<a[^>]*href="[^"]*apply|<button[^>]*class="[^"]*apply|data-automation-id="[^"]*apply')
                AND ({' OR '.join(f"contains(b, {S.q(x)})" for x in R.LISTING_WORDS)})) THEN 'listing'
          ELSE 'other' END AS page_class FROM f""",
    "b16_location_candidates": f"""
        WITH t AS (SELECT s_suppkey, {SQL_PLACE} AS n, s_acctbal, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT s_suppkey, CASE WHEN s_acctbal < 2000 THEN n WHEN s_acctbal < 4000 THEN 'remote, ' || n
            WHEN s_acctbal < 6000 THEN n || ', IE' WHEN s_acctbal < 8000 THEN 'Our site in ' || n || ', Ireland' ELSE 'Remote' END AS raw_location,
          CASE WHEN s_acctbal < 2000 THEN 'label' WHEN s_acctbal < 4000 THEN 'remote' WHEN s_acctbal < 6000 THEN 'city_code'
            WHEN s_acctbal < 8000 THEN 'city_country' ELSE 'default' END AS pattern,
          CASE WHEN s_acctbal < 2000 THEN 'false' ELSE 'true' END AS place_shaped FROM t""",
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
