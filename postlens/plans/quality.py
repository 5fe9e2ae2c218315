"""Queries over documents: quality flags and corpus rollups.

The corpus has no bullet marks, so lines of three and more words play bullets and shorter lines
play headings. Cue words are words of the corpus.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions.text import big
from postlens.operators import quality as Q
from postlens.plans import sql as S
from postlens.rules import quality as R
from postlens.sources.tables import table

BUL, HEAD = r"^(?=[^ ]+ [^ ]+ )", r"^[^ ]+(?: [^ ]+)?$"
SQL_BUL = r"^[^ ]+ [^ ]+ "
DATED = r"^(?:Of|Licensed)[ .]"
WEAK, STRONG = ["the ", "and "], ["of", "in", "la", "und", "el", "de"]
VERBS = ["the", "and", "of", "la", "die", "in"]
LEXICON = ["thon", "of the", "erst", "que la", "ention", "die"]
TYPES = [("leadership", "thon|que"), ("achievement", "erst|ention"), ("technical", "die|la"), ("collaboration", "of the"), ("quantified", "[0-9]")]
TAILS, STOCK, PASSIVE = r", (?:the|of|and|la|de) ", ["of the", "que la", "die der", "ción de"], r" (?:is|was|are) [a-z]+(?:ed|en|er|on)"
SPELLING = {"the": "tha", "la": "lo", "die": "dee", "of": "af"}


def docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


def lines(spark, folder):
    return Q.line_table(docs(spark, folder), bullet=BUL, heading=HEAD)


def text_flags(df, *names):
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def f01(spark, folder):
    return text_flags(lines(spark, folder), "is_bullet", "is_heading").drop("role")


def f02(spark, folder):
    return Q.opener_flags(lines(spark, folder), weak=WEAK, strong=STRONG)


def f03(spark, folder):
    return Q.repetition(lines(spark, folder))


def f04(spark, folder):
    return text_flags(Q.metrics(lines(spark, folder)), "overclaiming")


def f05(spark, folder):
    return Q.language_flags(lines(spark, folder), base_verbs=VERBS, dated=DATED)


def f06(spark, folder):
    out = Q.format_flags(docs(spark, folder))
    return out.select("doc_id", "date_formats", "headings_missing", *[F.col(c).cast("string").alias(c) for c in out.columns if c.startswith("has_") or c.endswith("_complete")])


def _cv_like(spark, folder):
    """CV-shaped texts made of parts and suppliers: degrees, certificates, projects and employers."""
    part, supplier = table(spark, folder, "part"), table(spark, folder, "supplier")
    joined = part.withColumn("s_name", supplier.agg(F.min("s_name")).scalar())
    size = F.col("p_size")
    text = F.concat_ws("\n", F.lit("EXPERIENCE"), F.concat(F.lit("Acme "), "p_type"), F.concat(F.lit("- Shipped "), "p_name", F.lit(" with "), F.when(size > 40, F.col("s_name")).otherwise("others")),
                       F.lit("EDUCATION"), F.when(size < 20, "BSc First Class Honours 3.9/4.0").when(size < 30, "BSc Upper Second\nGPA: 3.5").otherwise("BSc 2012"),
                       F.lit("CERTIFICATIONS"), F.when(size % 2 == 0, "AWS Certified, CISSP, PMP").otherwise("CFA"), F.lit("SKILLS"), F.lit("SQL"), F.lit("PROJECTS"),
                       F.concat(F.when(size < 10, "Weather app").otherwise(F.initcap("p_name")), F.when(size < 25, "\nopen source at github.com/me-1").otherwise("\nhttps://x.example.com")))
    return joined.select("p_partkey", "s_name", text.alias("text"))


def f07(spark, folder):
    return Q.consistency_flags(_cv_like(spark, folder), key="p_partkey", company="s_name").select("p_partkey", "rule", "detail")


def f08(spark, folder):
    part = table(spark, folder, "part")
    text = F.concat(F.lit("Jo Doe\nSUMMARY\nSeasoned "), F.initcap("p_name"), F.lit(" engineer with skill and taste.\n"), F.when(F.col("p_size") > 25, "Saved 40% for all").otherwise("Calm"))
    rows = part.select("p_partkey", text.alias("text"), F.when(F.col("p_size") > 10, F.lit("plain words")).otherwise(F.concat(F.lit("the "), "p_name")).alias("original"), F.initcap("p_name").alias("title"), F.lit("Jo Doe").alias("name"))
    out = Q.summary_flags(rows, "p_partkey", original="original", title="title", name="name")
    return text_flags(out, "drift", "other_profession").withColumn("missing", F.array_join("missing", ","))


def f09(spark, folder):
    return Q.prose_score(docs(spark, folder), tails=TAILS, stock=STOCK, passive=PASSIVE).withColumn("tells", F.array_join("tells", ","))


def f10(spark, folder):
    return Q.vocabulary_issues(docs(spark, folder), LEXICON)


def f10b(spark, folder):
    d = docs(spark, folder)
    after = d.withColumn("text", F.regexp_replace("text", "thon|erst", "x"))
    return Q.vocabulary_report(Q.vocabulary_issues(d, LEXICON), Q.vocabulary_issues(after, LEXICON))


def _drafts(spark, folder):
    conv = table(spark, folder, "conversations")
    slot = F.when(F.col("role") == "user", " [insert name] ").when(F.length("text") > 300, " {{company}} TBD ").otherwise(" ")
    return conv.select("conv_id", "turn", F.concat(F.lit("Dear reader of this note. I like"), slot, F.lit("much. "), "text").alias("text"))


def f11(spark, folder):
    d = _drafts(spark, folder).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return Q.placeholders(d, key="id")


def f11b(spark, folder):
    return Q.drop_placeholders(_drafts(spark, folder)).select("conv_id", "turn", F.md5("text").alias("text_md5"))


def f12(spark, folder):
    return text_flags(Q.letter_health(table(spark, folder, "conversations"), ["conv_id", "turn"], mine="la|the", yours="de|of"), "too_long", "self_heavy")


def f13(spark, folder):
    out = Q.normalise_corpus(docs(spark, folder), SPELLING, phrases=[("que la", "qua lo")], drop=["to", "en"])
    return out.select("doc_id", "changes", F.md5("text").alias("text_md5"))


def f13b(spark, folder):
    return Q.rewrite_counts(docs(spark, folder), SPELLING, phrases=[("que la", "qua lo")], drop=["to", "en"])


def all_flags(spark, folder):
    """Flags of several families under one (doc_id, kind) shape."""
    ls = lines(spark, folder)
    parts = [Q.language_flags(ls, base_verbs=VERBS, dated=DATED).select("doc_id", F.col("rule").alias("kind")), Q.repetition(ls).select("doc_id", "kind"),
             Q.vocabulary_issues(docs(spark, folder), LEXICON).select("doc_id", F.lit("vocabulary").alias("kind"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def f14(spark, folder):
    return Q.audit_summary(all_flags(spark, folder), table(spark, folder, "documents"))


def f14c(spark, folder):
    return Q.audit_summary(all_flags(spark, folder), table(spark, folder, "documents"), by="source")


SEVERITY = {"vocabulary": "high", "weak": "medium"}


def f14d(spark, folder):
    return Q.flag_quality(all_flags(spark, folder), table(spark, folder, "labels"), SEVERITY)


def f14b(spark, folder):
    return Q.worst_documents(all_flags(spark, folder))


def f15(spark, folder):
    out = Q.clamp_sections(docs(spark, folder), looking="(?i)thon|que la")
    return text_flags(out, "clamped").withColumn("removed", big("removed"))


def f16(spark, folder):
    return Q.line_types(lines(spark, folder), types=TYPES)


def f16b(spark, folder):
    sources = table(spark, folder, "documents").select("doc_id", "source")
    return Q.line_types(lines(spark, folder).join(sources, "doc_id"), key="source", types=TYPES)


def f17(spark, folder):
    out = Q.denoise(docs(spark, folder), bullet=BUL, filler="^(?:The|And|La) ")
    return out.withColumn("text", F.md5("text"))


def f18(spark, folder):
    return Q.repair_case(docs(spark, folder), casing={**R.CASING, "thon": "ThOn", "la": "LA", "ci": "cI"}).select("doc_id", "fixed", F.md5("text").alias("text_md5"))


def f19(spark, folder):
    return Q.dedupe_sections(lines(spark, folder)).select("doc_id", "line_no", "body")


QUERIES = {
    "f1_line_table": f01, "f2_opener_flags": f02, "f3_repetition": f03, "f4_metrics": f04, "f5_language_flags": f05, "f6_format_flags": f06, "f7_consistency_flags": f07,
    "f8_summary_flags": f08, "f9_prose_score": f09, "f10_vocabulary_issues": f10, "f10_vocabulary_report": f10b, "f11_placeholders": f11, "f11_drop_placeholders": f11b,
    "f12_letter_health": f12, "f13_normalise_corpus": f13, "f13_rewrite_counts": f13b, "f14_audit_summary": f14, "f14_worst_documents": f14b, "f14_by_source": f14c, "f14_flag_quality": f14d, "f15_clamp_sections": f15, "f16_line_types": f16, "f16_types_by_source": f16b,
    "f17_denoise": f17, "f18_repair_case": f18, "f19_dedupe_sections": f19,
}

# ---------------------------------------------------------------- SQL twins

_LINES = f"""sp AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    ln AS (SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, regexp_matches(l, {S.q(SQL_BUL)}) AS b, regexp_matches(l, {S.q(HEAD)}) AS h, trim(l) AS body FROM sp WHERE trim(l) <> ''),
    lt AS (SELECT doc_id, line_no, b AND NOT h AS is_bullet, h AS is_heading, body,
      last_value(CASE WHEN h THEN trim(regexp_replace(body, ':[ \\t]*$', '')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM ln)"""
_FW = "regexp_replace(lower(regexp_extract(body, '^[ \\t]*([^ \\t]+)', 1)), '[.,;:]$', '')"
_SHAPE = "CASE " + " ".join(f"WHEN regexp_matches(body, {S.q(p)}) THEN {S.q(n)}" for n, p in R.LINE_SHAPES) + " WHEN len(string_split_regex(body, '[ \\t]+')) <= 10 THEN 'short-punchy' ELSE 'standard' END"
_REP = f"""{_LINES}, bl AS (SELECT *, lower(regexp_extract(body, '^([A-Za-z]+)', 1)) AS w1, len(string_split_regex(body, '[ \\t]+')) AS nw,
      list_filter(regexp_extract_all(lower(body), '([a-z][a-z\\-]{{3,}})', 1), lambda x: x NOT IN {S.in_list(R.REPEAT_STOP_WORDS)}) AS ws FROM lt WHERE is_bullet),
    rw AS (SELECT doc_id, list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN list_position(ws, ws[i]) < i THEN ws[i] END), lambda x: x IS NOT NULL)[1] AS value FROM bl),
    rep AS (SELECT doc_id, 'opener' AS kind, w1 AS value, count(*) AS n FROM bl WHERE w1 <> '' GROUP BY ALL HAVING count(*) >= 2
      UNION ALL SELECT doc_id, 'shape', s, count(*) FROM (SELECT doc_id, {_SHAPE} AS s FROM bl WHERE w1 <> '') GROUP BY ALL HAVING count(*) >= 3
      UNION ALL SELECT doc_id, 'length', 'uniform', count(*) FROM bl GROUP BY doc_id HAVING count(*) >= 4 AND greatest(max(nw) - avg(nw), avg(nw) - min(nw)) / avg(nw) < 0.2
      UNION ALL SELECT doc_id, 'repeated', value, count(*) FROM rw WHERE value IS NOT NULL GROUP BY ALL)"""
_DUTY = "CASE " + " ".join(f"WHEN regexp_matches(body, {S.q(p)}) THEN {S.q(n)}" for n, p in R.DUTY_RULES) + " END"
_LANG = f"""cu AS (SELECT *, last_value(CASE WHEN is_heading THEN '?' WHEN NOT is_bullet AND regexp_matches(body, {S.q(DATED)}) THEN CASE WHEN regexp_matches(body, {S.q(R.CURRENT)}) THEN 'y' ELSE 'n' END END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur, regexp_replace({_FW}, '[^a-z]', '', 'g') AS verb FROM lt),
    lang AS (SELECT doc_id, 'tense' AS rule, line_no, verb AS detail FROM cu WHERE is_bullet AND cur = 'n' AND verb IN {S.in_list(VERBS)}
      UNION ALL SELECT doc_id, 'pronoun', line_no, 'first person' FROM cu WHERE is_bullet AND regexp_matches(body, {S.q(R.PRONOUNS)})
      UNION ALL SELECT doc_id, 'duty', line_no, {_DUTY} FROM cu WHERE is_bullet AND {_DUTY} IS NOT NULL
      UNION ALL SELECT doc_id, 'long', line_no, CAST(len(body) AS VARCHAR) FROM cu WHERE is_bullet AND len(body) > 280)"""


def _issues(name: str, source: str) -> str:
    return f"""{name}_r AS (SELECT doc_id, text, regexp_extract_all(lower({S.squeeze('text')}), '[a-z0-9_]+|[^a-z0-9_]+') AS r FROM {source}),
    {name}_g AS (SELECT doc_id, unnest(r) AS issue FROM {name}_r UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(r) - 1), lambda i: r[i] || r[i + 1] || r[i + 2])) FROM {name}_r),
    {name} AS (SELECT doc_id, issue, count(*) AS n FROM {name}_g WHERE issue IN {S.in_list(LEXICON)} GROUP BY ALL
      UNION ALL SELECT doc_id, 'em dash', {S.hits('text', '—')} FROM {source} WHERE contains(text, '—')
      UNION ALL SELECT doc_id, '-ize spelling', {S.hits('text', '(?i)[a-z]+ize[ds]?(?:$|[^A-Za-z0-9_])')} AS n FROM {source} WHERE {S.hits('text', '(?i)[a-z]+ize[ds]?(?:$|[^A-Za-z0-9_])')} > 0
      UNION ALL SELECT doc_id, 'pronoun', {S.hits('text', '(?:^|[^A-Za-z0-9_])(?:I|[Mm][Yy])[ \\t\\r\\n]')} AS n FROM {source} WHERE {S.hits('text', '(?:^|[^A-Za-z0-9_])(?:I|[Mm][Yy])[ \\t\\r\\n]')} > 0)"""


_FLAGS = f"""{_REP}, {_LANG}, {_issues('iss', 'documents')}, fl AS (SELECT doc_id, rule AS kind FROM lang UNION ALL SELECT doc_id, kind FROM rep UNION ALL SELECT doc_id, 'vocabulary' FROM iss)"""
_DRAFT = """dr AS (SELECT conv_id, turn, 'Dear reader of this note. I like' || CASE WHEN role = 'user' THEN ' [insert name] ' WHEN len(text) > 300 THEN ' {{company}} TBD ' ELSE ' ' END || 'much. ' || text AS text FROM conversations)"""
_SENT = "list_filter(list_transform(regexp_extract_all(text, '([^.!?\\n]+[.!?])', 1), lambda s: trim(s)), lambda s: len(string_split_regex(s, '[ \\t\\r\\n]+')) > 2)"

ORACLES = {
    "f1_line_table": f"WITH {_LINES} SELECT doc_id, line_no, CAST(is_bullet AS VARCHAR) AS is_bullet, CAST(is_heading AS VARCHAR) AS is_heading, body, section FROM lt",
    "f2_opener_flags": f"""WITH {_LINES}, o AS (SELECT doc_id, is_bullet, starts_with(lower(body), 'the ') OR starts_with(lower(body), 'and ') AS wk, {_FW} IN {S.in_list(STRONG)} AS st, regexp_matches({_FW}, '^[$0-9]') AS nu FROM lt)
        SELECT doc_id, count(*) FILTER (WHERE is_bullet) AS bullets, count(*) FILTER (WHERE is_bullet AND wk) AS weak, count(*) FILTER (WHERE is_bullet AND st) AS strong, count(*) FILTER (WHERE is_bullet AND nu) AS "numeric",
          count(*) FILTER (WHERE is_bullet AND NOT st AND NOT nu) AS flagged, CAST(coalesce(round(100.0 * count(*) FILTER (WHERE is_bullet AND st) / nullif(count(*) FILTER (WHERE is_bullet), 0)), 0) AS BIGINT) AS verb_coverage FROM o GROUP BY doc_id""",
    "f3_repetition": f"WITH {_REP} SELECT * FROM rep",
    "f4_metrics": f"""WITH {_LINES}, x AS (SELECT doc_id, is_bullet AS b, len(body) >= 25 AS lg, regexp_matches(body, {S.q(R.SCALE)}) AS sc, regexp_matches(body, {S.q(R.BIG_STAT)}) AS bs, regexp_matches(body, {S.q(R.SCOPE)}) AS sp,
          {' + '.join(S.hits('body', p) for p in R.METRICS)} AS f FROM lt),
        g AS (SELECT doc_id, count(*) FILTER (WHERE b) AS lines, count(*) FILTER (WHERE b AND (NOT lg OR sc)) AS quantified, CAST(sum(CASE WHEN b THEN f ELSE 0 END) AS BIGINT) AS found,
          count(*) FILTER (WHERE b AND lg AND bs) AS st, count(*) FILTER (WHERE b AND lg) AS ju, count(*) FILTER (WHERE b AND sp) AS scope FROM x GROUP BY doc_id)
        SELECT doc_id, lines, quantified, found, coalesce(round(st / nullif(ju, 0), 4), 0) AS density, scope, CAST(ju >= 4 AND st >= 0.7 * ju AS VARCHAR) AS overclaiming, CASE WHEN lines > 0 THEN round(quantified / lines, 4) ELSE 1.0 END AS ratio FROM g""",
    "f5_language_flags": f"WITH {_LINES}, {_LANG} SELECT * FROM lang",
    "f6_format_flags": f"""WITH x AS (SELECT doc_id, {' + '.join(f"CAST(regexp_matches(text, {S.q(p)}) AS BIGINT)" for _, p in R.DATE_FORMATS)} AS date_formats, {' + '.join(f"CAST(NOT regexp_matches(text, {S.q(p)}) AS BIGINT)" for _, p in R.STANDARD_HEADINGS)} AS headings_missing,
          {', '.join(f"regexp_matches(text, {S.q(p)}) AS has_{n}" for n, p in R.SECTION_WORDS)}, regexp_matches(text, {S.q(R.EMAIL)}) AS has_email, regexp_matches(text, {S.q(R.PHONE)}) AS has_phone,
          regexp_matches(text, {S.q(R.PROFILE)}) AS has_profile, regexp_matches(text, {S.q(R.PLACES)}) AS has_place FROM documents)
        SELECT doc_id, date_formats, headings_missing, {', '.join(f'CAST(has_{n} AS VARCHAR) AS has_{n}' for n in ('summary', 'experience', 'education', 'skills', 'email', 'phone', 'profile', 'place'))},
          CAST(has_experience AND has_education AND has_skills AS VARCHAR) AS sections_complete, CAST(has_email AND has_phone AND (has_profile OR has_place) AS VARCHAR) AS contact_complete FROM x""",
    "f7_consistency_flags": """WITH p AS (SELECT p_partkey, p_size AS z, p_name, p_type, (SELECT min(s_name) FROM supplier) AS co FROM part),
        n AS (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS t FROM p)
        SELECT p_partkey, 'uk_class_with_gpa' AS rule, CASE WHEN z < 20 THEN 'BSc First Class Honours 3.9/4.0' ELSE 'BSc Upper Second' END AS detail FROM n WHERE z < 30
        UNION ALL SELECT p_partkey, 'scattered_certificates', 'security,cloud,project' FROM n WHERE z % 2 = 0
        UNION ALL SELECT p_partkey, 'hiring_company', '- Shipped ' || p_name || ' with ' || co FROM n WHERE z > 40
        UNION ALL SELECT p_partkey, 'generic_project', 'Weather app' FROM n WHERE z < 10
        UNION ALL SELECT p_partkey, 'own_repo_open_source', CASE WHEN z < 10 THEN 'Weather app' ELSE t END FROM n WHERE z < 25
        UNION ALL SELECT p_partkey, 'dominant_handle', 'me-1' FROM n WHERE z < 25""",
    "f9_prose_score": f"""WITH d AS (SELECT doc_id, text, len(list_filter(string_split_regex(trim(text), '[ \\t\\r\\n]+'), lambda x: x <> '')) AS n, {_SENT} AS s, regexp_extract_all(lower(text), '([a-z][a-z''\\-]+)', 1) AS w FROM documents),
        m AS (SELECT *, list_transform(s, lambda x: CAST(len(string_split_regex(x, '[ \\t\\r\\n]+')) AS DOUBLE)) AS ln, {S.hits('text', TAILS)} AS tl, {S.hits('text', R.TRICOLON)} AS tri,
          {' + '.join(f"CAST(regexp_matches(text, {S.q('(?i)' + p)}) AS INT)" for p in STOCK)} AS stk, len(list_filter(s, lambda x: regexp_matches(x, {S.q(PASSIVE)}))) AS ps FROM d),
        c AS (SELECT *, n >= 40 AS j, len(s) >= 4 AND round(sqrt(list_sum(list_transform(ln, lambda x: (x - list_avg(ln)) * (x - list_avg(ln)))) / len(s)) / list_avg(ln), 9) < 0.35 AS c1,
          len(w) >= 80 AND len(list_distinct(w)) < 0.45 * len(w) AS c2, tl >= 2 AS c3, tri >= 3 AS c4, stk > 0 AS c5, len(s) >= 4 AND ps > 0.3 * len(s) AS c6 FROM m)
        SELECT doc_id, CAST(CASE WHEN j THEN least(100, CASE WHEN c1 THEN 25 ELSE 0 END + CASE WHEN c2 THEN 15 ELSE 0 END + CASE WHEN c3 THEN least(25, tl * 8) ELSE 0 END + CASE WHEN c4 THEN 10 ELSE 0 END
          + CASE WHEN c5 THEN least(20, stk * 7) ELSE 0 END + CASE WHEN c6 THEN 10 ELSE 0 END) ELSE 0 END AS BIGINT) AS score,
          array_to_string(list_filter([CASE WHEN j AND c1 THEN 'uniform-sentence-length' END, CASE WHEN j AND c2 THEN 'low-vocabulary-diversity' END, CASE WHEN j AND c3 THEN 'participial-tails' END,
            CASE WHEN j AND c4 THEN 'tricolon-rhythm' END, CASE WHEN j AND c5 THEN 'stock-phrasing' END, CASE WHEN j AND c6 THEN 'passive-voice' END], lambda x: x IS NOT NULL), ',') AS tells FROM c""",
    "f10_vocabulary_issues": f"WITH {_issues('iss', 'documents')} SELECT * FROM iss",
    "f10_vocabulary_report": f"""WITH ad AS (SELECT doc_id, regexp_replace(text, 'thon|erst', 'x', 'g') AS text FROM documents), {_issues('i1', 'documents')}, {_issues('i2', 'ad')},
        a AS (SELECT doc_id, count(*) AS n FROM i1 GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM i2 GROUP BY 1)
        SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, greatest(0, 100 - 5 * coalesce(a.n, 0)) AS score_before, greatest(0, 100 - 5 * coalesce(b.n, 0)) AS score_after FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
    "f11_placeholders": f"""WITH {_DRAFT} SELECT conv_id || '-' || turn AS id, unnest(CASE WHEN contains(text, '[insert name]') THEN ['[insert name]'] WHEN contains(text, '{{{{company}}}}') THEN ['TBD', '{{{{company}}}}'] ELSE [] END) AS token FROM dr""",
    "f12_letter_health": f"""WITH x AS (SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS BIGINT) AS words, {S.hits('text', R.word('la|the'))} AS i, {S.hits('text', '(?i)' + R.word('de|of'))} AS you FROM conversations)
        SELECT *, CAST(words > 350 AS VARCHAR) AS too_long, CAST(i > 0 AND you > 0 AND i > 0.65 * (i + you) AS VARCHAR) AS self_heavy FROM x""",
    "f14_audit_summary": f"""WITH {_FLAGS}, k AS (SELECT DISTINCT doc_id, kind, lang FROM fl JOIN documents USING (doc_id))
        SELECT kind, lang, count(DISTINCT doc_id) AS docs, CAST(round(100.0 * count(DISTINCT doc_id) / (SELECT count(*) FROM documents)) AS BIGINT) AS pct FROM k GROUP BY ROLLUP (kind, lang)""",
    "f14_by_source": f"""WITH {_FLAGS}, k AS (SELECT DISTINCT doc_id, kind, source FROM fl JOIN documents USING (doc_id))
        SELECT kind, source, count(DISTINCT doc_id) AS docs, CAST(round(100.0 * count(DISTINCT doc_id) / (SELECT count(*) FROM documents)) AS BIGINT) AS pct FROM k GROUP BY ROLLUP (kind, source)""",
    "f14_flag_quality": f"""WITH {_FLAGS}, m AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1), k AS (SELECT DISTINCT doc_id, kind FROM fl)
        SELECT kind, CASE kind {' '.join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in SEVERITY.items())} ELSE 'info' END AS severity, count(*) AS docs, count(quality) AS labelled, count(*) FILTER (WHERE quality = 0) AS low, count(*) FILTER (WHERE toxic = 1) AS toxic
        FROM k LEFT JOIN m USING (doc_id) GROUP BY kind""",
    "f14_worst_documents": f"WITH {_FLAGS} SELECT doc_id, count(*) AS flags FROM fl GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "f16_line_types": f"""WITH {_LINES}, t AS (SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(body, {S.q(p)}) THEN {S.q(n)}" for n, p in TYPES)} ELSE 'general' END AS type FROM lt), g AS (SELECT doc_id, type, count(*) AS n FROM t GROUP BY ALL)
        SELECT doc_id, type, n, CAST(round(100.0 * n / sum(n) OVER (PARTITION BY doc_id)) AS BIGINT) AS pct FROM g""",
    "f16_types_by_source": f"""WITH {_LINES}, t AS (SELECT source, CASE {' '.join(f"WHEN regexp_matches(body, {S.q(p)}) THEN {S.q(n)}" for n, p in TYPES)} ELSE 'general' END AS type FROM lt JOIN (SELECT doc_id, source FROM documents) USING (doc_id)), g AS (SELECT source, type, count(*) AS n FROM t GROUP BY ALL)
        SELECT source, type, n, CAST(round(100.0 * n / sum(n) OVER (PARTITION BY source)) AS BIGINT) AS pct FROM g""",
    "f19_dedupe_sections": f"""WITH {_LINES}, h AS (SELECT *, CASE WHEN is_heading THEN upper(trim(regexp_replace(body, ':[ \\t]*$', ''))) END AS hd FROM lt),
        b AS (SELECT *, count(hd) OVER (PARTITION BY doc_id ORDER BY line_no) AS blk, CASE WHEN hd IS NOT NULL THEN row_number() OVER (PARTITION BY doc_id, hd ORDER BY line_no) END AS nth FROM h),
        f AS (SELECT *, max(nth) OVER (PARTITION BY doc_id, blk) AS fst FROM b) SELECT doc_id, line_no, body FROM f WHERE coalesce(fst, 1) = 1""",
}

# ---------------------------------------------------------------- twins of the rewriting operators

_BAD = "|".join(f"(?:{p})" for p in R.PLACEHOLDERS)
_SWAPS = "CASE lower(t) " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in {**SPELLING, "to": "", "en": ""}.items()) + " END"
_TOKEN = f"CASE WHEN {_SWAPS} IS NULL THEN t WHEN len(t) > 1 AND t = upper(t) THEN upper({_SWAPS}) WHEN len(t) > 1 AND regexp_matches(t, '^[A-Z]') THEN upper(substr({_SWAPS}, 1, 1)) || substr({_SWAPS}, 2) ELSE {_SWAPS} END"
ORACLES.update({
    "f8_summary_flags": """WITH p AS (SELECT p_partkey, p_size, p_name, string_split(p_name, ' ') AS w, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS t FROM part)
        SELECT p_partkey, CASE WHEN p_size > 25 THEN '' ELSE 'quantified-proof' END AS missing, t || ' engineer' AS claimed_title, CAST(p_size > 10 AS VARCHAR) AS drift, CAST(len(list_filter(w, lambda x: len(x) > 3)) = 0 AS VARCHAR) AS other_profession FROM p""",
    "f11_drop_placeholders": f"""WITH {_DRAFT}, k AS (SELECT conv_id, turn, list_transform(string_split(text, chr(10)), lambda p: CASE WHEN NOT regexp_matches(p, {S.q(_BAD)}) THEN p ELSE
          {S.squeeze("array_to_string(list_filter(regexp_extract_all(p, '([^.!?]+[.!?]*)', 1), lambda s: NOT regexp_matches(s, " + S.q(_BAD) + ")), ' ')")} END) AS l, list_transform(string_split(text, chr(10)), lambda p: regexp_matches(p, {S.q(_BAD)})) AS b FROM dr),
        j AS (SELECT conv_id, turn, array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN b[i] AND len(list_filter(string_split_regex(l[i], ' +'), lambda x: x <> '')) < 4 THEN '' ELSE l[i] END), chr(10)) AS t FROM k)
        SELECT conv_id, turn, md5(regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\A[ \\n]+|[ \\n]+\\z', '', 'g')) AS text_md5 FROM j""",
    "f13_normalise_corpus": f"""WITH b AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, 'que la', 'qua lo', 'g'), '([0-9])[ ]*[—–][ ]*([0-9])', '\\1-\\2', 'g'), '[ ]*—[ ]*', ', ', 'g'), '[A-Za-z][A-Za-z''\\-]*|[^A-Za-z]+') AS k FROM documents),
        j AS (SELECT doc_id, CAST(len(list_filter(k, lambda t: {_SWAPS} IS NOT NULL)) AS BIGINT) AS changes, array_to_string(list_transform(k, lambda t: {_TOKEN}), '') AS t FROM b)
        SELECT doc_id, changes, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]{{2,}}', ' ', 'g'), '[ \\t]+([.,;:])', '\\1', 'g'), ' \\n', chr(10), 'g'))) AS text_md5 FROM j""",
    "f13_rewrite_counts": f"""WITH a AS (SELECT doc_id, text AS t0, regexp_replace(text, 'que la', 'qua lo', 'g') AS t1 FROM documents),
        b AS (SELECT *, regexp_replace(t1, '([0-9])[ ]*[—–][ ]*([0-9])', '\\1-\\2', 'g') AS t2 FROM a), k AS (SELECT *, unnest(regexp_extract_all(regexp_replace(t2, '[ ]*—[ ]*', ', ', 'g'), '[A-Za-z][A-Za-z''\\-]*')) AS w FROM b),
        r AS (SELECT doc_id, 'phrase:que la' AS rule, {S.hits('t0', 'que la')} AS n FROM b UNION ALL SELECT doc_id, 'range dash', {S.hits('t1', '[0-9][ ]*[—–][ ]*[0-9]')} FROM b UNION ALL SELECT doc_id, 'clause dash', {S.hits('t2', '[ ]*—[ ]*')} FROM b
          UNION ALL SELECT doc_id, CASE WHEN lower(w) IN ('to', 'en') THEN 'filler:' ELSE 'word:' END || lower(w), count(*) FROM k WHERE lower(w) IN {S.in_list([*SPELLING, 'to', 'en'])} GROUP BY ALL)
        SELECT doc_id, rule, n FROM r WHERE n > 0""",
    "f15_clamp_sections": """WITH f AS (SELECT doc_id, text AS t FROM documents), s AS (SELECT doc_id, t, len(string_split(t, chr(10))) > 6 OR regexp_matches(t, '(?:^|\\n)[ \\t]*[-•*][ \\t]*[^ \\t\\n]') AS odd, list_filter(list_transform(regexp_extract_all(replace(t, chr(10), ' '), '([^.!?]+[.!?]*)', 1), lambda x: trim(x)), lambda x: x <> '') AS a FROM f),
        k AS (SELECT *, list_filter(a, lambda x: NOT regexp_matches(x, '(?i)thon|que la')) AS s FROM s), u AS (SELECT *, array_to_string(s, ' ') AS fu, coalesce(list_max(list_filter(range(1, len(s) + 1), lambda i: len(array_to_string(s[1:i], ' ')) <= 220)), 0) AS n FROM k)
        SELECT doc_id, CAST(CASE WHEN odd THEN 0 ELSE len(a) - len(s) END AS BIGINT) AS removed, CAST(NOT odd AND len(fu) > 220 AS VARCHAR) AS clamped,
          CASE WHEN odd THEN t WHEN len(fu) <= 220 THEN fu WHEN n > 0 THEN array_to_string(s[1:n], ' ') ELSE regexp_replace(substr(fu, 1, 220), '[ ]+[^ ]*$', '') || '.' END AS text FROM u""",
})

_CASES = {**R.CASING, "thon": "ThOn", "la": "LA", "ci": "cI"}
_NEW = "CASE lower(t) " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in _CASES.items()) + " END"
_HEADED = "regexp_replace({x}, '^([A-Z][A-Z &/]{{3,}}):[ \\t]+([^ \\t].*)$', '\\1' || chr(10) || '\\2')"
_IS_B = f"regexp_matches(l, {S.q(SQL_BUL)})"
ORACLES.update({
    "f17_denoise": f"""WITH sp AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
        x AS (SELECT *, {_IS_B} AND regexp_matches(l, '^(?:The|And|La) ') AND NOT regexp_matches(l, '[0-9]') AS fil, {_IS_B} AND regexp_extract(l, {S.q(R.TAIL)}, 1) <> '' AND NOT regexp_matches(regexp_extract(l, {S.q(R.TAIL)}, 1), {S.q(R.CONCRETE)}) AS vag,
          {_IS_B} AND regexp_matches(l, {S.q(R.STANDARD_TAIL)}) AS bol, {_IS_B} AND regexp_matches(l, {S.q(R.PERCENTAGE)}) AS pct FROM sp),
        y AS (SELECT *, CASE WHEN vag THEN regexp_replace(l, {S.q(R.TAIL)}, '.') WHEN bol THEN regexp_replace(l, {S.q(R.STANDARD_TAIL)}, '.') ELSE l END AS o FROM x),
        z AS (SELECT *, CASE WHEN pct THEN regexp_replace(regexp_replace(o, {S.q(R.PERCENTAGE)}, '', 'g'), '[ ]{{2,}}', ' ', 'g') ELSE o END AS q FROM y)
        SELECT doc_id, md5(coalesce(string_agg(q, chr(10) ORDER BY n) FILTER (WHERE NOT fil), '')) AS text, count(*) FILTER (WHERE fil) AS removed_filler, count(*) FILTER (WHERE vag) AS removed_vague, count(*) FILTER (WHERE bol AND NOT vag) AS removed_standard,
          count(*) FILTER (WHERE pct) AS removed_percentage FROM z GROUP BY doc_id""",
    "f18_repair_case": f"""WITH sp AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
        c AS (SELECT doc_id, n, l, CASE WHEN regexp_matches(l, '(?i)://|@|www\\.|\\.(?:com|io|dev|net|org)(?:$|[^A-Za-z0-9_])') THEN l ELSE array_to_string(list_transform(regexp_extract_all(l, '[A-Za-z0-9_/]+|[^A-Za-z0-9_/]+'),
          lambda t: CASE WHEN {_NEW} IS NULL OR t = {_NEW} OR (len(t) > 1 AND t = upper(t)) THEN t ELSE {_NEW} END), '') END AS o FROM sp), h AS (SELECT doc_id, n, l, {_HEADED.format(x='o')} AS o FROM c)
        SELECT doc_id, count(*) FILTER (WHERE l <> o) AS fixed, md5(string_agg(o, chr(10) ORDER BY n)) AS text_md5 FROM h GROUP BY doc_id""",
})
