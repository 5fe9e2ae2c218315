"""Queries that match: ``benchmark`` items play postings, ``documents`` play CVs."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions.text import big
from postlens.operators import matching as E
from postlens.operators import quality as Q
from postlens.operators import terms as T
from postlens.operators.history import keep_last
from postlens.operators.postings import split_sections
from postlens.plans import sql as S
from postlens.plans.postings import CORPUS_HEADINGS
from postlens.plans.terms import docs, sql_top, vocabulary
from postlens.rules import matching as M
from postlens.sources.tables import table

KEYS = ["item_id", "doc_id"]
REQ, PREF = "that|with", "for|from"
TYPES = [("experience_years", "ention"), ("education", "anon|oner"), ("certification", "thes"), ("soft_skill", "ouha|heha")]
KNOWN = ["hean", "ation", "reon"]
SIGNALS = [("north", "of the", 3), ("north", "thon", 1), ("north", "erst", 3), ("south", "was the", 3), ("south", "ention", 3), ("south", "rely", 1),
           ("west", "and the", 3), ("west", "que", 1), ("west", "die", 1)]
ADJ = {"the": ["queau", "lich"], "ha": ["ción", "ention"], "on": ["eaux", "keit"]}
REQ_PATTERNS = [r"(?:that|with)[ \t]+([^\n.,;]{4,80})", r"(?:and the)[ \t]+([^\n.,;]{4,80})"]
HOOKS = [("team", r"(?:^|[^A-Za-z0-9_])the[ \t\n]+([a-z]{4,20} [a-z]{4,20})[ \t\n]+the"), ("product", r"(?:on|in)[ \t]+([a-z ]{8,60})\.")]
GROUPS = [["of the", "of", "the of"], ["and", "and the"], ["was", "is"]]
CARRIED = {"technical": ["thon", "ation"], "soft": ["erst", "ention"], "domain": ["rely"]}
TITLE, REWORDED = r"^((?:[^ \n]+ ?){1,4})", "(?:th|ci|le)[a-zé]+"
BLOCK_START, CLAIM = r"(?:^|\n)(?:The|La|Der|Le)", r"(?:^|[^0-9])([1-9][0-9]?) "
ASKED, NAMED = r"(?i)(?:^|[^A-Za-z0-9_])(?:ention|the|der)(?:$|[^A-Za-z0-9_])", r"(?i)(?:^|[^A-Za-z0-9_])(?:erst|of|ch)(?:$|[^A-Za-z0-9_])"
CARRIERS = {"technical": "the|de", "domain": "of|la"}


def postings(spark, folder):
    return table(spark, folder, "benchmark").select("item_id", "text")


def terms(spark, folder):
    return T.top_terms(postings(spark, folder), key="item_id")


def pairs(spark, folder):
    """All pairs whose CV holds at least 30 percent of the posting's terms."""
    return E.covered_pairs(terms(spark, folder), docs(spark, folder))


def packed(spark, folder):
    return E.posting_terms(terms(spark, folder))


def frame(spark, folder):
    return E.with_terms(pairs(spark, folder), packed(spark, folder))


def e01(spark, folder):
    out = E.coverage(frame(spark, folder), KEYS)
    return out.select(*KEYS, "n", F.array_join("matched", " ").alias("matched"), F.array_join("missing", " ").alias("missing"), "score")


def best_matches(spark, folder, k: int = 3):
    """Flagship: the postings' best covered CVs and what they lack."""
    out = e01(spark, folder)
    return keep_last(out, ["item_id"], k, [F.desc("score"), F.col("doc_id")], "rank")


def e02(spark, folder):
    return E.coverage_substring(pairs(spark, folder), packed(spark, folder), docs(spark, folder))


def e03(spark, folder):
    return E.coverage_loose(pairs(spark, folder), packed(spark, folder), docs(spark, folder))


def e04(spark, folder):
    return E.weighted_match(frame(spark, folder), KEYS)


def hits(spark, folder, what=None):
    h = T.dictionary_hits(what if what is not None else docs(spark, folder), vocabulary(spark, folder))
    return h.select("doc_id", "term", "n").distinct()


def e05(spark, folder):
    return E.term_density(hits(spark, folder), docs(spark, folder))


def e06(spark, folder):
    sections = split_sections(docs(spark, folder), "doc_id", headings=CORPUS_HEADINGS)
    return E.term_distribution(sections, vocabulary(spark, folder)).withColumn("well_distributed", F.col("well_distributed").cast("string"))


def e07(spark, folder):
    before = docs(spark, folder)
    after = before.withColumn("text", F.regexp_replace("text", r" th[a-z]+ ", " the "))
    bands = T.top_terms(before).select("doc_id", "term", F.col("band").alias("priority"))
    out = E.coverage_diff(hits(spark, folder, before), hits(spark, folder, after), bands)
    return out.withColumn("meets_target", F.col("meets_target").cast("string")).withColumn("over_target", F.col("over_target").cast("string"))


def e08(spark, folder):
    titles = table(spark, folder, "pages").select("page_id", F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("title"))
    return E.title_signal(titles, docs(spark, folder))


def quals(spark, folder):
    return E.qualifications(postings(spark, folder), required=REQ, preferred=PREF, known=KNOWN, types=TYPES)


def e09(spark, folder):
    return quals(spark, folder).withColumn("keywords", F.array_join("keywords", "|"))


def matched(spark, folder):
    return E.match_quals(quals(spark, folder), pairs(spark, folder), docs(spark, folder), evidence=False)


def e10(spark, folder):
    return matched(spark, folder).select(*KEYS, "ord", "type", "priority", F.col("met").cast("string").alias("met"), "confidence")


def e10b(spark, folder):
    return E.match_summary(matched(spark, folder), KEYS).withColumn("meets", F.col("meets").cast("string"))


def e11(spark, folder):
    return E.recommend(matched(spark, folder), KEYS)


def e11b(spark, folder):
    return E.count_by_type(quals(spark, folder))


def d18(spark, folder):
    out = E.gap_terms(matched(spark, folder), KEYS)
    return out.select(*KEYS, "term", "ord", *[F.col(c).cast("string").alias(c) for c in ("for_summary", "for_experience", "for_skills")])


def _years_pairs(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    posting = F.concat(F.lit("Needs 3 years of experience, better "), F.col("l_quantity").cast("int"), F.lit("+ years of professional experience."))
    cv = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("Over "), F.col("l_linenumber"), F.lit(" years of experience"))).otherwise(
        F.concat(F.lit("Acme "), F.year("o_orderdate"), F.lit(" - "), F.year("l_shipdate")))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("l_orderkey", "l_linenumber", posting.alias("posting_text"), cv.alias("cv_text"))


def e12(spark, folder):
    return E.years_gap(_years_pairs(spark, folder), 2010).select("l_orderkey", "l_linenumber", "required", "evidenced", F.col("gap").cast("string").alias("gap"))


def e13(spark, folder):
    rows = _years_pairs(spark, folder).select("l_orderkey", "l_linenumber", F.col("posting_text").alias("tailored"), F.col("cv_text").alias("original"))
    return E.years_inflated(rows, 2010).select("l_orderkey", "l_linenumber", "claimed", "evidenced", F.col("inflated").cast("string").alias("inflated"), "capped")


def e14(spark, folder):
    return E.archetypes(docs(spark, folder), SIGNALS)


def e15(spark, folder):
    return E.fit_gate(pairs(spark, folder), E.archetypes(postings(spark, folder), SIGNALS, key="item_id"), E.archetypes(docs(spark, folder), SIGNALS), floor=0.05)


def texts(spark, folder):
    return pairs(spark, folder).drop("found").join(postings(spark, folder).withColumnRenamed("text", "posting_text"), "item_id").join(docs(spark, folder).withColumnRenamed("text", "cv_text"), "doc_id")


def e16(spark, folder):
    return E.gaps(pairs(spark, folder), postings(spark, folder), docs(spark, folder), adjacency=ADJ, patterns=REQ_PATTERNS).withColumn("covered", F.col("covered").cast("string"))


def e17(spark, folder):
    return E.hooks(docs(spark, folder), key="doc_id", patterns=[*M.HOOK_PATTERNS, *HOOKS])


def features(spark, folder):
    """One row of features per pair: coverage, weights and the CV's own quality flags."""
    base = frame(spark, folder)
    cover = E.coverage(base, KEYS).select(*KEYS, "score", big(F.size("matched")).alias("matched"), big(F.size("missing")).alias("missing"))
    weights = E.weighted_match(base, KEYS).select(*KEYS, "high")
    own = Q.document_features(docs(spark, folder))
    density = E.term_density(hits(spark, folder), docs(spark, folder)).select("doc_id", "density", "stuffed")
    return cover.join(weights, KEYS).join(read_features(spark, folder), KEYS).join(own, "doc_id").join(density, "doc_id")


def read_features(spark, folder):
    """What gates read from the texts: a posting's first four words play its title, the text before rewording the original."""
    titled = postings(spark, folder).withColumn("title", F.regexp_extract("text", TITLE, 1))
    versions = docs(spark, folder).withColumn("original", F.regexp_replace("text", REWORDED, "x"))
    return E.pair_features(pairs(spark, folder), packed(spark, folder), titled, versions, 2026, original="original", start=BLOCK_START, claim=CLAIM, degree_asked=ASKED, degree_named=NAMED)


def e18(spark, folder):
    out = E.scorecard(features(spark, folder), KEYS)
    return out.select(*KEYS, "score", "adjusted", F.array_join("deductions", ",").alias("deductions"), "confidence", F.col("reliable").cast("string").alias("reliable"), F.array_join("warnings", ",").alias("warnings"))


def e19(spark, folder):
    out = E.verdicts(matched(spark, folder), KEYS)
    return out.select(*KEYS, "focus", "score", "priorities", "gaps", F.array_join("top_gaps", "|").alias("top_gaps"))


def e20(spark, folder):
    rows = docs(spark, folder).join(T.top_terms(docs(spark, folder)).groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("terms")), "doc_id")
    rows = rows.withColumn("old", F.regexp_replace("text", r"(?:th|ci|le)[a-zé]+", "x"))
    return E.unsupported_terms(rows, "text", "old", "terms", ["doc_id"])


def _lines(spark, folder, text="text"):
    d = table(spark, folder, "documents")
    return d.select("doc_id", "source", F.posexplode(F.split(text, "\n")).alias("line_no", "body")).withColumn(
        "line_id", F.col("doc_id") * 100000 + F.col("line_no")).withColumn("line_no", big("line_no"))


def e21(spark, folder):
    src = _lines(spark, folder)
    tgt = src.where(F.col("body").contains("on")).withColumn("body", F.regexp_replace("body", " [a-z]+,", ","))
    return E.dropped_lines(src, tgt, "source").select("line_id", "source")


def e22(spark, folder):
    rows = _lines(spark, folder).withColumn("run", F.col("source"))
    return E.rank_lines(rows, ["thon", "erst", "ention", "que", "ción"])


def e23(spark, folder):
    canon = E.canonical_terms(postings(spark, folder), groups=GROUPS)
    out = E.mirror(texts(spark, folder), canon, groups=GROUPS)
    return out.select(*KEYS, "swaps", F.md5("cv_text").alias("text_md5"))


def e23b(spark, folder):
    return E.canonical_terms(postings(spark, folder), groups=GROUPS)


def gate_rows(spark, folder):
    return E.gates(features(spark, folder), KEYS)


def e24(spark, folder):
    return E.gate_counts(gate_rows(spark, folder))


def e25(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source")
    report = T.term_df(T.top_terms(docs(spark, folder)).join(d, "doc_id"), key="source")
    return E.skill_gaps(report, docs(spark, folder))


def e26(spark, folder):
    return E.opportunities(_lines(spark, folder), CARRIED, ["line_id"], carriers=CARRIERS)


QUERIES = {
    "e1_coverage": e01, "e2_coverage_substring": e02, "e3_coverage_loose": e03, "e4_weighted_match": e04, "e5_term_density": e05, "e6_term_distribution": e06,
    "e7_coverage_diff": e07, "e8_title_signal": e08, "e9_qualifications": e09, "e10_match_quals": e10, "e10_match_summary": e10b, "e11_recommend": e11,
    "e11_count_by_type": e11b, "d18_gap_terms": d18, "e12_years_gap": e12, "e13_years_inflated": e13, "e14_archetypes": e14, "e15_fit_gate": e15, "e16_gaps": e16,
    "e17_hooks": e17, "e18_scorecard": e18, "e19_verdicts": e19, "e20_unsupported_terms": e20, "e21_dropped_lines": e21, "e22_rank_lines": e22,
    "e23_mirror": e23, "e23_canonical_terms": e23b, "e24_gates": e24, "e25_skill_gaps": e25, "e26_opportunities": e26, "e_flagship_best_matches": best_matches,
}

# ---------------------------------------------------------------- SQL twins

_TOPB = sql_top(35).replace("documents", "benchmark").replace("doc_id", "item_id").replace("tok", "btok").replace("cnt", "bcnt").replace("rk ", "brk ").replace("FROM rk", "FROM brk").replace("top AS", "btop AS")
_B = "CASE WHEN rank <= ceil(n * 0.4) THEN 'high' WHEN rank <= ceil(n * 0.4) + ceil(n * 0.35) THEN 'medium' ELSE 'low' END"
_PAIRS = f"""{_TOPB},
    bt AS (SELECT item_id, term, rank, {_B} AS band FROM btop),
    dw AS (SELECT doc_id, text, lower(text) AS t, list_distinct({S.words('text')}) AS w FROM documents),
    dt AS (SELECT doc_id, unnest(w) AS term FROM dw),
    nn AS (SELECT item_id, count(*) AS n FROM bt GROUP BY 1),
    pairs AS (SELECT item_id, doc_id FROM (SELECT item_id, doc_id, count(*) AS m FROM bt JOIN dt USING (term) GROUP BY ALL) JOIN nn USING (item_id) WHERE round(100.0 * m / n) >= 30),
    pl AS (SELECT item_id, list(term ORDER BY rank) AS terms FROM bt GROUP BY item_id),
    fr AS (SELECT * FROM pairs JOIN pl USING (item_id) JOIN dw USING (doc_id))"""
_E1 = f"""{_PAIRS}, cov AS (SELECT item_id, doc_id, len(terms) AS n, list_filter(terms, lambda x: list_contains(w, x)) AS m, list_filter(terms, lambda x: NOT list_contains(w, x)) AS miss FROM fr),
    e1 AS (SELECT item_id, doc_id, CAST(n AS BIGINT) AS n, array_to_string(m, ' ') AS matched, array_to_string(miss, ' ') AS missing, CAST(round(100.0 * len(m) / n) AS BIGINT) AS score FROM cov)"""


def _vocab_hits(name: str, source: str) -> str:
    """Distinct (doc_id, term, n) hits of the vocabulary in ``source`` (doc_id, text)."""
    return f"""
    {name}_r AS (SELECT doc_id, regexp_extract_all(lower({S.squeeze('text')}), '[a-z0-9_]+|[^a-z0-9_]+') AS r FROM {source}),
    {name}_g AS (SELECT doc_id, unnest(r) AS term FROM {name}_r UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(r) - 1), lambda i: r[i] || r[i + 1] || r[i + 2])) FROM {name}_r),
    {name} AS (SELECT doc_id, term, count(*) AS n FROM {name}_g WHERE term IN (SELECT term FROM vocab) GROUP BY ALL)"""


from postlens.plans.terms import SQL_VOCAB  # noqa: E402

_QUALS = f"""
    qb AS (SELECT item_id, text, len(regexp_extract(text, '(?is)^(.*?)(?:{REQ})', 1)) AS ra, regexp_matches(text, '(?i){REQ}') AS rm,
           len(regexp_extract(text, '(?is)^(.*?)(?:{PREF})', 1)) AS pa, regexp_matches(text, '(?i){PREF}') AS pm FROM benchmark WHERE len(text) >= 100),
    qp AS (SELECT item_id, text, CASE WHEN rm THEN substr(text, ra + 1, CASE WHEN pm AND pa > ra THEN pa - ra ELSE len(text) END) END AS rt, CASE WHEN pm THEN substr(text, pa + 1) END AS pt FROM qb),
    ql AS (SELECT item_id, text, {{r}} AS r, {{p}} AS p FROM qp),
    qr AS (SELECT item_id, CASE WHEN r IS NULL OR len(r) = 0 THEN {{t}} ELSE r END AS r, coalesce(p, []) AS p FROM ql),
    qa AS (SELECT item_id, unnest(list_concat(r, p)) AS text, generate_subscripts(list_concat(r, p), 1) - 1 AS ord, len(r) AS nr FROM qr),
    qk AS (SELECT item_id, ord, text, lower(text) AS l, CASE WHEN ord < nr THEN 'required' ELSE 'preferred' END AS priority FROM qa),
    qt AS (SELECT *, CASE WHEN regexp_matches(l, 'ouha|heha') THEN 'soft_skill' WHEN regexp_matches(l, 'thes') THEN 'certification' WHEN regexp_matches(l, 'anon|oner') THEN 'education'
           WHEN regexp_matches(l, 'ention') THEN 'experience_years' ELSE 'technical_skill' END AS type, list_filter(['hean', 'ation', 'reon'], lambda k: contains(l, k)) AS k,
           list_filter(string_split_regex(l, '[ \\t]+'), lambda x: len(x) > 4 AND x NOT IN {S.in_list(M.LONG_WORD_EXCLUDED)})[1:5] AS fb FROM qk),
    fbd AS (SELECT item_id, ord, list(x ORDER BY i) AS fb FROM (SELECT item_id, ord, x, min(i) AS i FROM (SELECT item_id, ord, unnest(fb) AS x, generate_subscripts(fb, 1) AS i FROM qt) GROUP BY ALL) GROUP BY ALL),
    quals AS (SELECT qt.item_id, CAST(qt.ord AS BIGINT) AS ord, text, type, priority, CAST(CASE type WHEN 'soft_skill' THEN 0.8 WHEN 'certification' THEN 1.1 WHEN 'education' THEN 1.2 WHEN 'experience_years' THEN 1.5 ELSE 1.3 END AS DOUBLE) AS weight,
           CASE WHEN len(k) > 0 THEN k ELSE coalesce(fbd.fb, []) END AS keywords FROM qt LEFT JOIN fbd ON qt.item_id = fbd.item_id AND qt.ord = fbd.ord)"""


def _split(col: str) -> str:
    return f"list_filter(list_transform(string_split_regex({col}, '(?:\\n|•|\\*|^[ ]*-|\\n[ ]*-|\\n[ ]*[0-9]+[.)])+'), lambda s: trim(s)), lambda s: len(s) BETWEEN 10 AND 500)"


_QUALS = _QUALS.replace("{r}", _split("rt")).replace("{p}", _split("pt")).replace("{t}", _split("text"))
_MATCH = f"""{_PAIRS}, {_QUALS},
    mq AS (SELECT p.item_id, p.doc_id, q.ord, q.text AS qtext, q.type, q.priority, q.weight, q.keywords, dw.t,
           CAST(len(list_filter(q.keywords, lambda k: contains(dw.t, lower(k)))) AS DOUBLE) / greatest(len(q.keywords), 1) AS kr,
           list_filter(string_split_regex(lower(q.text), '[ \\t\\r\\n]+'), lambda x: len(x) > 4)[1:8] AS lw FROM pairs p JOIN quals q USING (item_id) JOIN dw USING (doc_id)),
    mr AS (SELECT *, greatest(kr, 0.8::DOUBLE * coalesce(CAST(len(list_filter(lw, lambda x: contains(t, x))) AS DOUBLE) / nullif(len(lw), 0), 0)) AS raw FROM mq),
    m AS (SELECT item_id, doc_id, ord, qtext, type, priority, weight, keywords, raw >= 0.5 AS met, round(raw * 100) / 100 AS confidence FROM mr),
    ms AS (SELECT item_id, doc_id, CAST(round(100.0 * count(*) FILTER (WHERE priority = 'required' AND met) / nullif(count(*) FILTER (WHERE priority = 'required'), 0)) AS BIGINT) AS required,
           CAST(coalesce(round(100.0 * count(*) FILTER (WHERE priority = 'preferred' AND met) / nullif(count(*) FILTER (WHERE priority = 'preferred'), 0)), 0) AS BIGINT) AS preferred,
           count(*) FILTER (WHERE priority = 'required') AS n_required FROM m GROUP BY ALL)"""
_YEARS = """y AS (SELECT l_orderkey, l_linenumber, greatest(3, CASE WHEN CAST(l_quantity AS INT) BETWEEN 1 AND 40 THEN CAST(l_quantity AS INT) ELSE 0 END) AS req,
    CASE WHEN o_orderstatus = 'O' THEN l_linenumber ELSE 2010 - least(year(o_orderdate), year(l_shipdate)) END AS ev FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_ARCH = lambda src, key: f"""(SELECT {key}, {', '.join('(' + ' + '.join(f"CASE WHEN contains(lower(text), {S.q(p)}) THEN {w} ELSE 0 END" for a, p, w in SIGNALS if a == n) + f') AS {n}' for n in ('north', 'south', 'west'))} FROM {src} WHERE len(text) >= 40)"""


def _arch(name: str, src: str, key: str) -> str:
    return f"""{name}_s AS {_ARCH(src, key)},
    {name}_u AS (SELECT {key}, a, s, i FROM (SELECT {key}, unnest(['north', 'south', 'west']) AS a, unnest([north, south, west]) AS s, unnest([0, 1, 2]) AS i FROM {name}_s)),
    {name}_r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s DESC, i) AS rn FROM {name}_u WHERE s > 0),
    {name} AS (SELECT d.{key}, f.a AS "primary", CASE WHEN f.s - g.s <= greatest(2, f.s * 0.25) THEN g.a END AS secondary, CAST(coalesce(f.s, 0) AS BIGINT) AS top,
      round(CAST(least(1, coalesce(f.s, 0) / 12) AS DOUBLE), 4) AS confidence FROM {name}_s d LEFT JOIN {name}_r f ON d.{key} = f.{key} AND f.rn = 1 LEFT JOIN {name}_r g ON d.{key} = g.{key} AND g.rn = 2)"""


_ORDL = "SELECT doc_id, source, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents"

ORACLES = {
    "e1_coverage": f"WITH {_E1} SELECT * FROM e1",
    "e_flagship_best_matches": f"WITH {_E1} SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM e1 QUALIFY rank <= 3",
    "e2_coverage_substring": f"""WITH {_PAIRS}, s AS (SELECT item_id, doc_id, CAST(len(terms) AS BIGINT) AS n, CAST(len(list_filter(terms, lambda k: contains(t, k))) AS BIGINT) AS hits FROM fr),
        p AS (SELECT *, CAST(round(100.0 * hits / n) AS BIGINT) AS percent FROM s) SELECT *, CASE WHEN percent >= 85 THEN 'strong' WHEN percent >= 70 THEN 'good' WHEN percent >= 50 THEN 'moderate' ELSE 'weak' END AS band FROM p""",
    "e3_coverage_loose": f"""WITH {_PAIRS}, lw AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 \\t\\r\\n+#.\\-]', ' ', 'g'), '[ \\t\\r\\n]+'), lambda x: len(x) >= 2)) AS lw FROM documents),
        ut AS (SELECT DISTINCT doc_id, term FROM pairs JOIN bt USING (item_id)),
        h AS (SELECT doc_id, term, len(list_filter(lw, lambda x: contains(x, term) OR contains(term, x))) > 0 AS hit FROM ut JOIN lw USING (doc_id))
        SELECT item_id, doc_id, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, CAST(round(100.0 * count(*) FILTER (WHERE hit) / count(*)) AS BIGINT) AS score FROM pairs JOIN bt USING (item_id) JOIN h USING (doc_id, term) GROUP BY ALL""",
    "e4_weighted_match": f"""WITH {_PAIRS}, h AS (SELECT item_id, doc_id, band, CASE band WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS w, list_contains(dw.w, term) AS hit FROM pairs JOIN bt USING (item_id) JOIN dw USING (doc_id)),
        g AS (SELECT item_id, doc_id, CAST(round(100.0 * sum(CASE WHEN hit THEN w ELSE 0 END) / sum(w)) AS BIGINT) AS score,
          {', '.join(f"CAST(coalesce(round(100.0 * count(*) FILTER (WHERE hit AND band = '{b}') / nullif(count(*) FILTER (WHERE band = '{b}'), 0)), 100) AS BIGINT) AS {b}" for b in ('high', 'medium', 'low'))} FROM h GROUP BY ALL)
        SELECT *, CAST(round((high * 3 + medium * 2 + low) / 6) AS BIGINT) AS overall FROM g""",
    "e5_term_density": f"""WITH {SQL_VOCAB}, {_vocab_hits('h', 'documents')}, s AS (SELECT doc_id, count(*) AS terms, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (WHERE n > 6) AS stuffed FROM h GROUP BY 1),
        w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: len(x) >= 2)) AS w FROM documents)
        SELECT doc_id, coalesce(terms, 0) AS terms, coalesce(hits, 0) AS hits, CASE WHEN w > 0 THEN round(1000 * coalesce(hits, 0) / w) / 10 ELSE 0 END AS density, coalesce(stuffed, 0) AS stuffed FROM w LEFT JOIN s USING (doc_id)""",
    "e7_coverage_diff": f"""WITH {SQL_VOCAB}, {sql_top(35)}, ad AS (SELECT doc_id, regexp_replace(text, ' th[a-z]+ ', ' the ', 'g') AS text FROM documents), {_vocab_hits('h1', 'documents')}, {_vocab_hits('h2', 'ad')},
        bd AS (SELECT doc_id, term, {_B} AS priority FROM top),
        j AS (SELECT coalesce(h1.doc_id, h2.doc_id) AS doc_id, coalesce(h1.term, h2.term) AS term, coalesce(h1.n, 0) AS original, coalesce(h2.n, 0) AS final FROM h1 FULL JOIN h2 ON h1.doc_id = h2.doc_id AND h1.term = h2.term),
        k AS (SELECT j.*, coalesce(priority, 'low') AS priority FROM j LEFT JOIN bd USING (doc_id, term))
        SELECT doc_id, term, priority, original, final, final - original AS added, CAST(final BETWEEN CASE priority WHEN 'low' THEN 1 ELSE 3 END AND CASE priority WHEN 'low' THEN 2 ELSE 5 END AS VARCHAR) AS meets_target,
          CAST(final > CASE priority WHEN 'low' THEN 2 ELSE 5 END AS VARCHAR) AS over_target FROM k""",
    "e8_title_signal": f"""WITH t AS (SELECT page_id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '[^a-z0-9+#. ]', ' ', 'g'), ' +'),
          lambda x: len(x) > 2 AND x NOT IN {S.in_list(M.TITLE_STOP_WORDS)})) AS w FROM pages), d AS (SELECT doc_id, list_distinct({S.words('text')}) AS c FROM documents),
        e AS (SELECT page_id, unnest(w) AS term, len(w) AS n FROM t WHERE len(w) > 0), f AS (SELECT doc_id, unnest(c) AS term FROM d),
        g AS (SELECT page_id, doc_id, count(*) AS hits, any_value(n) AS n FROM e JOIN f USING (term) GROUP BY ALL)
        SELECT page_id, doc_id, hits, CAST(round(100.0 * hits / n) AS BIGINT) AS coverage FROM g WHERE round(100.0 * hits / n) >= 60""",
    "e9_qualifications": f"WITH {_QUALS} SELECT item_id, ord, text, type, priority, weight, array_to_string(keywords, '|') AS keywords FROM quals",
    "e10_match_quals": f"WITH {_MATCH} SELECT item_id, doc_id, ord, type, priority, CAST(met AS VARCHAR) AS met, confidence FROM m",
    "e10_match_summary": f"""WITH {_MATCH} SELECT *, CAST(round(required * 0.7 + preferred * 0.3) AS BIGINT) AS overall, CASE WHEN required >= 85 THEN 'excellent' WHEN required >= 75 THEN 'good' WHEN required >= 60 THEN 'close' ELSE 'low' END AS status,
        CAST(required >= 75 AS VARCHAR) AS meets FROM ms""",
    "e11_count_by_type": f"WITH {_QUALS} SELECT item_id, type, count(*) AS n FROM quals GROUP BY ALL",
    "e11_recommend": f"""WITH {_MATCH}, l AS (SELECT m.*, required, n_required, CASE WHEN priority = 'required' AND NOT met THEN 'CRITICAL' WHEN met AND confidence < 0.75 THEN 'HIGH' WHEN priority = 'preferred' AND NOT met AND required >= 75 THEN 'MEDIUM' END AS lv
          FROM m JOIN ms USING (item_id, doc_id)),
        r AS (SELECT item_id, doc_id, lv AS priority, row_number() OVER (PARTITION BY item_id, doc_id, lv ORDER BY CASE WHEN lv = 'CRITICAL' THEN -confidence ELSE 0 END, l.ord) AS ord, qtext AS text,
          CAST(CASE WHEN n_required > 0 THEN round(100.0::DOUBLE / n_required * weight) ELSE 0 END AS BIGINT) AS impact FROM l WHERE lv IS NOT NULL)
        SELECT * FROM r WHERE priority <> 'MEDIUM' OR ord <= 3""",
    "d18_gap_terms": f"""WITH {_MATCH}, u AS (SELECT item_id, doc_id, CASE priority WHEN 'required' THEN 0 ELSE 1 END AS p, -confidence AS c, ord, unnest(keywords) AS term, generate_subscripts(keywords, 1) AS i FROM m WHERE NOT met),
        f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY item_id, doc_id, lower(term) ORDER BY p, c, ord, i) = 1),
        o AS (SELECT item_id, doc_id, term, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY p, c, f.ord, i) AS ord, regexp_matches(term, {S.q('(?i)' + M.SOFT_TERM)}) AS soft FROM f)
        SELECT item_id, doc_id, term, ord, CAST(NOT soft AND sum(CASE WHEN soft THEN 0 ELSE 1 END) OVER (PARTITION BY item_id, doc_id ORDER BY ord) <= 3 AS VARCHAR) AS for_summary, 'true' AS for_experience, CAST(NOT soft AS VARCHAR) AS for_skills FROM o""",
    "e12_years_gap": f"WITH {_YEARS} SELECT l_orderkey, l_linenumber, CAST(req AS BIGINT) AS required, CAST(ev AS BIGINT) AS evidenced, CAST(ev + 1 < req AS VARCHAR) AS gap FROM y",
    "e13_years_inflated": f"WITH {_YEARS} SELECT l_orderkey, l_linenumber, CAST(req AS BIGINT) AS claimed, CAST(ev AS BIGINT) AS evidenced, CAST(req > ev + 2 AS VARCHAR) AS inflated, CAST(CASE WHEN req > ev + 2 THEN ev ELSE req END AS BIGINT) AS capped FROM y",
    "e14_archetypes": f"WITH {_arch('a', 'documents', 'doc_id')} SELECT * FROM a",
    "e15_fit_gate": f"""WITH {_PAIRS}, {_arch('b', 'benchmark', 'item_id')}, {_arch('a', 'documents', 'doc_id')}
        SELECT item_id, doc_id, b."primary" AS posting_type, b.confidence, a."primary" AS cv_type FROM pairs JOIN b USING (item_id) JOIN a USING (doc_id) WHERE a."primary" <> b."primary" AND b.confidence >= 0.05""",
    "e17_hooks": "WITH h AS (SELECT doc_id, text, " + ", ".join(f"trim(regexp_extract(text, {S.q(p)}, 1)) AS c{i}" for i, (_, p) in enumerate([*M.HOOK_PATTERNS, *HOOKS, ('stack', M.STACK_PATTERN)])) + " FROM documents) SELECT doc_id, CASE "
        + " ".join(f"WHEN len(text) >= 50 AND {'len(c' + str(i) + ') BETWEEN 8 AND 180' if n != 'stack' else 'c' + str(i) + chr(32) + '<> ' + chr(39) * 2} THEN {S.q(n)}" for i, (n, _) in enumerate([*M.HOOK_PATTERNS, *HOOKS, ('stack', '')])) + " ELSE 'fallback' END AS kind, CASE "
        + " ".join(f"WHEN len(text) >= 50 AND {'len(c' + str(i) + ') BETWEEN 8 AND 180' if n != 'stack' else 'c' + str(i) + chr(32) + '<> ' + chr(39) * 2} THEN c{i}" for i, (n, _) in enumerate([*M.HOOK_PATTERNS, *HOOKS, ('stack', '')])) + " ELSE '' END AS capture FROM h",
    "e19_verdicts": f"""WITH {_MATCH}, g AS (SELECT *, priority = 'required' AND NOT met AND trim(qtext) <> '' AS missed, type <> 'soft_skill' AND confidence < 0.25 AS heavy FROM m),
        a AS (SELECT item_id, doc_id, count(*) FILTER (WHERE missed AND heavy) AS priorities, count(*) FILTER (WHERE missed AND NOT heavy) AS gaps,
          coalesce(array_to_string((list(substr({S.squeeze('qtext')}, 1, 110) ORDER BY ord) FILTER (WHERE missed AND NOT heavy))[1:4], '|'), '') AS top_gaps FROM g GROUP BY ALL)
        SELECT item_id, doc_id, CASE WHEN priorities >= 2 OR required < 55 THEN 'heavy' WHEN priorities = 1 OR required < 75 THEN 'targeted' ELSE 'light' END AS focus, required AS score, priorities, gaps, top_gaps FROM a JOIN ms USING (item_id, doc_id)""",
    "e22_rank_lines": f"""WITH l AS ({_ORDL}), s AS (SELECT doc_id, source AS run, line_no, CAST(CASE WHEN regexp_matches(body, '[0-9]') THEN 0.5 ELSE 0 END - CASE WHEN regexp_matches(body, {S.q(M.BACK_REFERENCE)}) THEN 100 ELSE 0 END
          + len(list_filter(['thon', 'erst', 'ention', 'que', 'ción'], lambda k: contains(lower(body), k))) AS DOUBLE) AS score, count(*) OVER (PARTITION BY doc_id) AS n FROM l)
        SELECT doc_id, run, line_no, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS new_ord FROM s WHERE n >= 3""",
    "e23_canonical_terms": "WITH u AS (" + " UNION ALL ".join(f"SELECT item_id, {i} AS group_id, {j} AS j, regexp_extract(text, {S.q('(?i)(?:^|[^A-Za-z0-9_])(' + v + ')(?:$|[^A-Za-z0-9_])')}, 1) AS m FROM benchmark" for i, g in enumerate(GROUPS) for j, v in enumerate(g))
        + """) SELECT item_id, CAST(group_id AS BIGINT) AS group_id, CASE WHEN contains(m, ' ') AND m = upper(m) THEN array_to_string(list_transform(string_split(m, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE m END AS canonical
        FROM u WHERE m <> '' QUALIFY row_number() OVER (PARTITION BY item_id, group_id ORDER BY len(m) DESC, j) = 1""",
    "e25_skill_gaps": f"""WITH {sql_top(35)}, pr AS (SELECT DISTINCT source, term FROM top JOIN documents USING (doc_id)), nn AS (SELECT count(DISTINCT source) AS n FROM pr),
        c AS (SELECT term, count(*) AS docs, any_value(n) AS n FROM pr, nn GROUP BY term), b AS (SELECT term, docs FROM c WHERE docs / n >= 0.7 ORDER BY docs DESC, term LIMIT 20),
        t AS (SELECT doc_id, string_split_regex(lower(text), '[^A-Za-z0-9_]+') AS w FROM documents)
        SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY docs DESC, term) AS rank FROM t, b WHERE NOT list_contains(w, term) QUALIFY rank <= 15""",
    "e26_opportunities": f"""WITH l AS ({_ORDL}), x AS (SELECT doc_id * 100000 + line_no AS line_id, lower(body) AS b FROM l),
        u AS (SELECT line_id, b, unnest(['thon', 'ation', 'erst', 'ention', 'rely']) AS term, unnest([1, 1, 2, 2, 3]) AS cat, unnest([1, 2, 3, 4, 5]) AS i FROM x)
        SELECT line_id, term, row_number() OVER (PARTITION BY line_id ORDER BY i) AS ord FROM u WHERE NOT contains(b, term) AND CASE cat WHEN 1 THEN regexp_matches(b, 'the|de') WHEN 2 THEN len(b) > 50 ELSE regexp_matches(b, 'of|la') END QUALIFY ord <= 4""",
}

# ---------------------------------------------------------------- further twins

from postlens.plans.postings import ORACLES as _POSTINGS  # noqa: E402

_SECTIONS = _POSTINGS["b5_split_sections"].split("SELECT doc_id, section, CAST(ord")[0]
_FOLD = lambda e: S.replace_all(f"regexp_replace(regexp_replace(lower({e}), '[‐-―]', '-', 'g'), '[ \\t\\r\\n\\-_/]+', ' ', 'g')", [(t + "([^a-z0-9_]|$)", "\\1") for t in ("s", "ing", "ed")])
_STEMS = lambda e: f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({e}), '([a-z][a-z0-9.+#\\-]{{2,}})', 1), lambda w: w NOT IN {S.in_list(M.STEM_STOP_WORDS)}), lambda w: substr(w, 1, 5)))"
ORACLES.update({
    "e6_term_distribution": f"""{_SECTIONS.rstrip()}, {SQL_VOCAB}, rr AS (SELECT doc_id, section, regexp_extract_all(lower({S.squeeze('body')}), '[a-z0-9_]+|[^a-z0-9_]+') AS q FROM r),
        g AS (SELECT doc_id, section, unnest(q) AS term FROM rr UNION ALL SELECT doc_id, section, unnest(list_transform(range(1, len(q) - 1), lambda i: q[i] || q[i + 1] || q[i + 2])) FROM rr),
        c AS (SELECT doc_id, section, count(*) AS n FROM g WHERE term IN (SELECT term FROM vocab) GROUP BY ALL)
        SELECT doc_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS sections, CAST(count(*) FILTER (WHERE section <> 'skills') >= 2 AS VARCHAR) AS well_distributed, CAST(round((1 - max(n) / sum(n)) * 100) AS BIGINT) AS score FROM c GROUP BY doc_id""",
    "e20_unsupported_terms": f"""WITH {sql_top(35)}, f AS (SELECT doc_id, {_FOLD('text')} AS a, {_FOLD("regexp_replace(text, '(?:th|ci|le)[a-zé]+', 'x', 'g')")} AS b FROM documents), p AS (SELECT DISTINCT doc_id, term, {_FOLD('term')} AS p FROM top WHERE len(term) >= 3)
        SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY term) AS ord FROM p JOIN f USING (doc_id) WHERE p <> '' AND contains(a, p) AND NOT contains(b, p) QUALIFY ord <= 12""",
    "e21_dropped_lines": f"""WITH l AS ({_ORDL}), s AS (SELECT doc_id * 100000 + line_no AS line_id, source, body, {_STEMS('body')} AS st FROM l),
        t AS (SELECT DISTINCT source, {_STEMS("regexp_replace(body, ' [a-z]+,', ',', 'g')")} AS st FROM s WHERE contains(body, 'on')), u AS (SELECT source, list_sort(st) AS k, any_value(st) AS st, list(line_id) AS ids FROM s WHERE len(st) >= 4 GROUP BY 1, 2),
        m AS (SELECT u.source, u.k FROM u JOIN t ON u.source = t.source AND len(t.st) > 0 AND greatest(len(list_intersect(u.st, t.st)) / len(u.st), len(list_intersect(u.st, t.st)) / len(t.st)) >= 0.45 GROUP BY ALL)
        SELECT unnest(ids) AS line_id, source FROM u WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.source = u.source AND m.k = u.k)""",
})

from postlens.rules import quality as RQ  # noqa: E402

# The corpus has no bullet lines, so the bullet-based features of these twins are zero.
_FEATURES = f"""{_E1}, {SQL_VOCAB.replace('bt AS', 'vbt AS').replace('FROM bt', 'FROM vbt')}, {_vocab_hits('vh', 'documents')},
    dn0 AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (WHERE n > 6) AS stuffed FROM vh GROUP BY 1),
    dn AS (SELECT doc_id, CASE WHEN w > 0 THEN round(1000 * coalesce(hits, 0) / w) / 10 ELSE 0 END AS density, coalesce(stuffed, 0) AS stuffed
      FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: len(x) >= 2)) AS w FROM documents) LEFT JOIN dn0 USING (doc_id)),
    hi AS (SELECT item_id, doc_id, CAST(coalesce(round(100.0 * count(*) FILTER (WHERE list_contains(dw.w, term)) / nullif(count(*), 0)), 100) AS BIGINT) AS high FROM pairs JOIN bt USING (item_id) JOIN dw USING (doc_id) WHERE band = 'high' GROUP BY ALL),
    tl AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS l FROM documents),
    of AS (SELECT doc_id, {' + '.join(f"CAST(regexp_matches(text, {S.q(p)}) AS BIGINT)" for _, p in RQ.DATE_FORMATS)} AS date_formats, {' + '.join(f"CAST(NOT regexp_matches(text, {S.q(p)}) AS BIGINT)" for _, p in RQ.STANDARD_HEADINGS)} AS headings_missing,
      {', '.join(f"regexp_matches(text, {S.q(p)}) AS has_{n}" for n, p in RQ.SECTION_WORDS)}, regexp_matches(text, {S.q(RQ.EMAIL)}) AS has_email, regexp_matches(text, {S.q(RQ.PHONE)}) AS has_phone, regexp_matches(text, {S.q(RQ.PROFILE)}) AS has_profile,
      regexp_matches(text, {S.q(RQ.PLACES)}) AS has_place, {' + '.join(S.hits('text', p) for p in RQ.METRICS)} AS quantified, regexp_matches(text, '\\t.*\\t') AS tabs, regexp_matches(array_to_string(l[1:4], ' '), {S.q(RQ.EMAIL)}) AS header_email,
      regexp_matches(array_to_string(l[1:4], ' '), '[0-9]{{6,}}|[0-9][0-9 ().\\-]{{7,}}') AS header_phone, NOT regexp_matches(array_to_string(l[1:14], chr(10)), {S.q(RQ.SCALE)}) AS top_weak FROM tl),
    pt AS (SELECT item_id, terms, list_transform(list_filter(terms, lambda k: len(k) >= 3), lambda k: {_FOLD('k')}) AS ff, lower(trim(regexp_extract(text, {S.q(TITLE)}, 1))) AS title, regexp_matches(text, {S.q(ASKED)}) AS posting_degree FROM pl JOIN benchmark USING (item_id)),
    pw AS (SELECT *, list_distinct(list_filter(string_split_regex(regexp_replace(title, '[^a-z0-9+#. ]', ' ', 'g'), ' +'), lambda x: len(x) > 2 AND x NOT IN {S.in_list(M.TITLE_STOP_WORDS)})) AS tw FROM pt),
    cr AS (SELECT doc_id, t, w, lower(regexp_extract(regexp_extract(text, {S.q('(?s)' + BLOCK_START + '(.*)')}, 1), {S.q('(?s)^(.*?)(?:' + chr(92) + 'n[A-Z][A-Z &/]{3,}[ ' + chr(92) + 't]*(?:' + chr(92) + 'n|$)|$)')}, 1)) AS ex, {_FOLD('text')} AS fn,
      {_FOLD(f"regexp_replace(text, {S.q(REWORDED)}, 'x', 'g')")} AS fo, regexp_matches(text, {S.q(NAMED)}) AS cv_degree, list_max(list_filter(list_transform(regexp_extract_all(text, {S.q(CLAIM)}, 1), lambda x: CAST(x AS INT)), lambda y: y BETWEEN 1 AND 60)) AS claimed,
      2026 - CAST(list_min(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_full_match(x, {S.q(M.CALENDAR_YEARS)}))) AS INT) AS span FROM dw),
    rf AS (SELECT item_id, doc_id, list_filter(terms, lambda k: contains(t, k)) AS hit, ex, CAST(len(list_filter(ff, lambda k: k <> '' AND contains(fn, k) AND NOT contains(fo, k))) AS BIGINT) AS unsupported,
      len(tw) = 0 OR round(100.0 * len(list_intersect(tw, w)) / len(tw)) >= 60 AS title_matched, title, coalesce(claimed > CASE WHEN span BETWEEN 1 AND 60 THEN span END + 2, false) AS inflated, posting_degree, cv_degree
      FROM pairs JOIN pw USING (item_id) JOIN cr USING (doc_id)),
    rg AS (SELECT * EXCLUDE (hit, ex, title), contains(lower(array_to_string(l[1:4], ' ')), title) AS title_in_header, CASE WHEN len(hit) > 0 THEN round(100.0 * len(list_filter(hit, lambda k: contains(ex, k))) / len(hit)) END AS proven FROM rf JOIN tl USING (doc_id)),
    ft AS (SELECT c.item_id, c.doc_id, CAST(round(100.0 * len(m) / c.n) AS BIGINT) AS score, CAST(len(m) AS BIGINT) AS matched, CAST(len(miss) AS BIGINT) AS missing, high, density, stuffed, of.* EXCLUDE (doc_id), rg.* EXCLUDE (item_id, doc_id, text, l), has_experience AND has_education AND has_skills AS sections_complete,
      has_email AND has_phone AND (has_profile OR has_place) AS contact_complete FROM cov c JOIN hi ON c.item_id = hi.item_id AND c.doc_id = hi.doc_id JOIN dn ON c.doc_id = dn.doc_id JOIN of ON c.doc_id = of.doc_id JOIN rg ON c.item_id = rg.item_id AND c.doc_id = rg.doc_id)"""
_LOSS = [("NOT contact_complete", "8", "contact"), ("NOT sections_complete", "6", "sections"), ("quantified < 3", "5", "quantified"), ("NOT title_matched", "4", "title"), ("high < 70", "CAST(least(10, round((70 - high) / 5)) AS BIGINT)", "priority"), ("stuffed > 0", "3 * stuffed", "stuffing")]
_WARN = [("stuffed > 0", "stuffing"), ("density > 5.0", "density_high"), ("density < 1.0 AND matched > 0", "density_low"), ("matched < 5", "few_matches"), ("missing > matched", "more_missing"), ("NOT has_email", "no_email"), ("NOT has_phone", "no_phone"),
         ("NOT (has_profile OR has_place)", "no_profile_or_place"), ("NOT has_experience", "no_experience"), ("NOT has_education", "no_education"), ("NOT has_skills", "no_skills"), ("quantified < 3", "few_metrics"), ("NOT title_matched", "title_weak"), ("high < 70", "priority_low")]
_GATES = [("parsing", "NOT has_experience", "headings_missing > 0 OR date_formats > 1 OR tabs"), ("hard_qualifications", "inflated OR (posting_degree AND NOT cv_degree)", "NOT has_education"), ("keyword_match", "score < 60 OR unsupported > 0", "score BETWEEN 60 AND 79"),
          ("semantic_evidence", "proven < 40", "proven BETWEEN 40 AND 64"), ("discoverability", "NOT title_in_header", "NOT header_email OR NOT header_phone OR NOT has_profile"), ("skim", "top_weak", "false"), ("evidence", "false", "false")]
ORACLES.update({
    "e18_scorecard": f"""WITH {_FEATURES}, s AS (SELECT *, greatest(0, least(100, score - ({' + '.join(f'CASE WHEN {c} THEN {p} ELSE 0 END' for c, p, _ in _LOSS)}))) AS adjusted FROM ft)
        SELECT item_id, doc_id, score, CAST(adjusted AS BIGINT) AS adjusted, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '-' || {p} || ' {n}' END" for c, p, n in _LOSS)}], lambda x: x IS NOT NULL), ',') AS deductions,
          CASE {' '.join(f"WHEN score >= {a} AND matched >= {b} AND density >= {d} THEN '{n}'" for n, a, b, d in M.CONFIDENCE_FLOORS)} ELSE 'UNRELIABLE' END AS confidence,
          CAST(adjusted >= 85 AND matched >= 10 AND density >= 1.0 AND stuffed = 0 AND contact_complete AND sections_complete AS VARCHAR) AS reliable,
          array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _WARN)}], lambda x: x IS NOT NULL), ',') AS warnings FROM s""",
    "e24_gates": f"""WITH {_FEATURES}, g AS ({' UNION ALL '.join(f"SELECT '{n}' AS gate, CASE WHEN {f} THEN 'fail' WHEN {w} THEN 'weak' ELSE 'pass' END AS status FROM ft" for n, f, w in _GATES)})
        SELECT gate, status, count(*) AS n FROM g GROUP BY GROUPING SETS ((gate, status), (gate), ())""",
})

_ADJ_HIT = {t: f"list_filter([{', '.join(S.q(x) for x in near)}], lambda x: contains(cv, x))[1]" for t, near in ADJ.items()}
ORACLES["e16_gaps"] = f"""WITH {_PAIRS}, p AS (SELECT item_id, doc_id, dw.t AS cv, list_filter(list_transform(list_concat({', '.join(f"regexp_extract_all(b.text, {S.q(x)}, 1)" for x in REQ_PATTERNS)}), lambda s: regexp_replace(trim(s), '[.;:,]+$', '')), lambda s: len(s) BETWEEN 6 AND 200) AS l
      FROM pairs JOIN benchmark b USING (item_id) JOIN dw USING (doc_id)),
    d AS (SELECT item_id, doc_id, cv, list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END), lambda x: x IS NOT NULL) AS l FROM p),
    u AS (SELECT item_id, doc_id, cv, unnest(l) AS requirement, generate_subscripts(l, 1) AS ord FROM d),
    c AS (SELECT *, regexp_replace(lower(requirement), '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g') AS clean FROM u),
    w AS (SELECT *, list_filter(string_split_regex(clean, '[ \\t\\n]+'), lambda x: len(x) > 2) AS w FROM c),
    h AS (SELECT *, coalesce(list_filter([{', '.join(S.q(t) for t in ADJ)}], lambda t: contains(clean, t))[1], array_to_string(w[greatest(len(w) - 2, 1):], ' ')) AS probe, array_to_string(w[1:3], ' ') AS head FROM w WHERE len(w) > 0),
    g AS (SELECT *, contains(cv, probe) OR contains(cv, head) AS cov FROM h),
    b AS (SELECT *, CASE WHEN cov THEN NULL {' '.join(f"WHEN contains({s}, {S.q(t)}) AND {x} IS NOT NULL THEN {x}" for s in ('probe', 'head') for t, x in _ADJ_HIT.items())} END AS bridge, sum(CASE WHEN cov THEN 0 ELSE 1 END) OVER (PARTITION BY item_id, doc_id ORDER BY ord) AS nth FROM g)
    SELECT item_id, doc_id, ord, requirement, CAST(cov AS VARCHAR) AS covered, bridge FROM b WHERE cov OR nth <= 6"""
