"""Queries over documents: terms. Vocabularies are mined from ``benchmark``, so they grow with the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions.text import big, plain_words
from postlens.operators import terms as T
from postlens.plans import sql as S
from postlens.rules import terms as R
from postlens.sources.tables import table

CORPUS_SECTIONS = [("of the", 1.4), ("que la", 0.9), ("der die", 1.3)]
CORPUS_TECH = ["the", "ci", "de", "ation", "die", "la"]
CORPUS_PHRASES = ["of the", "de la", "was the", "die die"]
CORPUS_TIERS = [("high", ["of the", "ci", "la", "thon", "erst"]), ("medium", ["que", "and the", "die"]), ("low", ["to", "en", "der"])]
CORPUS_SOFT = ["thon", "erst", "ention", "anre", "rely", "ouer", "lyer-on"]
CORPUS_HEADS = ["on", "er", "ha", "an", "st", "ch", "ción"]
CORPUS_BOUNDARY = ["the", "of", "de", "and", "la", "to"]


def docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


def vocabulary(spark, folder):
    """(term, category) out of the benchmark: words of 6 letters and more and pairs of words of 4 and more."""
    w = plain_words("text")
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("a"), F.element_at("w", i + 1).alias("b")))
    base = table(spark, folder, "benchmark").select(w.alias("w"))
    single = base.select(F.explode("w").alias("term")).where(F.length("term") >= 6)
    double = base.where(F.size("w") > 1).select(F.inline(pairs)).where("length(a) >= 4 and length(b) >= 4").select(F.concat_ws(" ", "a", "b").alias("term"))
    names = F.array(F.when(F.length("term") <= 8, "programming_language").when(F.length("term") <= 11, "cloud_devops").otherwise("hard_skill"),
                    F.when(F.col("term").startswith("th"), "data_tool"))
    return single.unionByName(double).distinct().select("term", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("category"))


SQL_VOCAB = """
    bw AS (SELECT list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark),
    bt AS (SELECT DISTINCT term FROM (SELECT unnest(w) AS term FROM bw UNION ALL
           SELECT unnest(list_transform(list_filter(range(1, len(w)), lambda i: len(w[i]) >= 4 AND len(w[i + 1]) >= 4), lambda i: w[i] || ' ' || w[i + 1])) FROM bw)
           WHERE len(term) >= 6),
    vocab AS (SELECT term, CASE WHEN len(term) <= 8 THEN 'programming_language' WHEN len(term) <= 11 THEN 'cloud_devops' ELSE 'hard_skill' END AS category FROM bt
              UNION ALL SELECT term, 'data_tool' FROM bt WHERE starts_with(term, 'th'))"""
SQL_GRAMS = f"""
    runs AS (SELECT doc_id, regexp_extract_all(lower({S.squeeze('text')}), '[a-z0-9_]+|[^a-z0-9_]+') AS r FROM documents),
    grams AS (SELECT doc_id, unnest(r) AS term FROM runs
              UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(r) - 1), lambda i: r[i] || r[i + 1] || r[i + 2])) FROM runs)"""


def sql_top(n: int) -> str:
    return f"""
    tok AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {S.words('text')} AS w FROM documents)),
    cnt AS (SELECT doc_id, term, count(*) AS freq, min(pos) AS pos FROM tok WHERE len(term) > 2 AND term NOT IN {S.in_list(R.STOP_WORDS)} GROUP BY ALL),
    rk AS (SELECT doc_id, term, freq, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, pos) AS rank FROM cnt QUALIFY rank <= {n}),
    top AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM rk)"""


def d01(spark, folder):
    return T.top_terms(docs(spark, folder))


def d02(spark, folder):
    return T.dictionary_hits(docs(spark, folder), vocabulary(spark, folder))


def d03(spark, folder):
    w = plain_words("text")
    phrases = table(spark, folder, "benchmark").select(w.alias("w")).where(F.size("w") > 2).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, F.lit(3)), " "))).alias("phrase"))
    return T.phrase_hits(docs(spark, folder), phrases)


def d04(spark, folder):
    return T.decluster(docs(spark, folder), ["tion", "ention", "ther", "queau", "lich", "tung", "ción", "ation"])


def scored(spark, folder):
    return T.score_terms(docs(spark, folder), vocabulary(spark, folder), sections=CORPUS_SECTIONS,
                         learned=T.top_terms(docs(spark, folder), n=5).groupBy("term").agg(F.count("*").alias("frequency")))


def d05(spark, folder):
    return scored(spark, folder)


def banded(spark, folder):
    return T.band_terms(scored(spark, folder))


def d06(spark, folder):
    return banded(spark, folder)


def d07(spark, folder):
    out = T.tech_terms(docs(spark, folder), CORPUS_TECH, CORPUS_PHRASES)
    return out.withColumn("weight", F.round(F.log10(1 + F.col("weight")), 6))


def mandatory_terms(spark, folder):
    hits = T.dictionary_hits(docs(spark, folder), vocabulary(spark, folder)).select("doc_id", "term", "n").distinct()
    return T.ranked(hits, "doc_id", [F.desc("n"), F.col("term")], 30).select("doc_id", "term", F.col("rank").alias("ord"))


def extracted_terms(spark, folder):
    return T.top_terms(docs(spark, folder)).select("doc_id", "term", "rank", F.col("band").alias("priority"))


def d08(spark, folder):
    return T.merge_terms(mandatory_terms(spark, folder), extracted_terms(spark, folder))


def roi(spark, folder):
    return T.classify_roi(docs(spark, folder), CORPUS_TIERS)


def d09(spark, folder):
    return roi(spark, folder)


def d10(spark, folder):
    return T.allocate(roi(spark, folder))


def d11(spark, folder):
    """All skills of each document, soft ones removed; a word that plays a head noun here is no edge word."""
    return T.hard_skills(docs(spark, folder), heads=[*R.SKILL_HEADS, *CORPUS_HEADS], boundary=[*R.BOUNDARY_WORDS, *CORPUS_BOUNDARY], edge=[w for w in R.EDGE_WORDS if w not in CORPUS_HEADS],
                         standalone=[*R.STANDALONE_HEADS, "ch"], soft=T.soft_skills(docs(spark, folder), CORPUS_SOFT), limit=None)


def d12(spark, folder):
    return T.soft_skills(docs(spark, folder), CORPUS_SOFT)


def d13(spark, folder):
    out = T.categorise(T.top_terms(docs(spark, folder)), vocabulary(spark, folder))
    return out.select("term", F.array_join("categories", ",").alias("categories"))


def d14(spark, folder):
    rows = banded(spark, folder).withColumn("seen", F.col("doc_id"))
    out = T.learn(rows, vocabulary(spark, folder), F.col("seen"))
    return out.select("term", "frequency", "last_seen", F.array_join("categories", ",").alias("categories"), F.round("boost", 4).alias("boost"))


def d15(spark, folder):
    rows = T.top_terms(docs(spark, folder))
    dressed = rows.withColumn("term", F.when(F.col("band") == "low", F.initcap("term")).when(F.col("rank") == 3, F.concat(F.lit("strong "), "term")).otherwise(F.col("term")))
    return T.clean_terms(dressed)


def d16(spark, folder):
    part = table(spark, folder, "part")
    long = F.initcap("p_name")
    short = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.upper(F.substring(w, 1, 1))), "")
    text = F.concat(F.lit("We run The "), long, F.lit(" ("), short, F.lit("), modern tools (SQL) and "), F.initcap("p_type"), F.lit("-Grade "), long,
                    F.lit(" ( "), F.upper(F.substring("p_type", 1, 1)), F.lit("G"), short, F.lit(" ).\nData (AI)"))
    return T.acronym_pairs(part.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


def d17(spark, folder):
    return T.term_df(T.top_terms(table(spark, folder, "documents").select("doc_id", "text")).join(
        table(spark, folder, "documents").select("doc_id", "source"), "doc_id"), key="source")


QUERIES = {"d1_top_terms": d01, "d2_dictionary_hits": d02, "d3_phrase_hits": d03, "d4_decluster": d04, "d5_score_terms": d05, "d6_band_terms": d06,
           "d7_tech_terms": d07, "d8_merge_terms": d08, "d9_classify_roi": d09, "d10_allocate": d10, "d11_hard_skills": d11, "d12_soft_skills": d12,
           "d13_categorise": d13, "d14_learn": d14, "d15_clean_terms": d15, "d16_acronym_pairs": d16, "d17_term_df": d17}

# ---------------------------------------------------------------- SQL twins

_D1 = f"WITH {sql_top(35)}"
_BAND = "CASE WHEN rank <= ceil(n * 0.4) THEN 'high' WHEN rank <= ceil(n * 0.4) + ceil(n * 0.35) THEN 'medium' ELSE 'low' END"
_SECTION = "CASE " + " ".join(f"WHEN contains(lower(text), {S.q(n)}) THEN CAST({w} AS DOUBLE)" for n, w in CORPUS_SECTIONS) + " END"
_BOOSTS = S.values(list(R.CATEGORY_BOOST.items()))
_SCORED = f"""{SQL_VOCAB},
    {sql_top(5).replace('tok', 'ltok').replace('cnt', 'lcnt').replace('rk AS', 'lrk AS').replace('FROM rk', 'FROM lrk').replace('top AS', 'ltop AS')},
    learned AS (SELECT term, count(*) AS f FROM ltop GROUP BY term),
    sw AS (SELECT doc_id, list_transform(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: lower(regexp_replace(x, '[^a-zA-Z0-9\\-+#.]', '', 'g'))) AS w, {_SECTION} AS s FROM documents),
    st AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos, len(w) AS n, s FROM sw),
    sc AS (SELECT doc_id, term, count(*) AS freq, min(pos) AS pos, any_value(n) AS n, any_value(s) AS s FROM st
           WHERE len(term) BETWEEN 3 AND 35 AND regexp_matches(term, '^[a-z][a-z0-9\\-+#]*$') AND term NOT IN {S.in_list(sorted(set(R.NOISE_WORDS)))} GROUP BY doc_id, term),
    bo AS (SELECT term, product(b) AS boost FROM vocab JOIN {_BOOSTS} AS x(c, b) ON category = c GROUP BY term),
    scored AS (SELECT sc.doc_id, sc.term, freq, CAST(sc.pos AS BIGINT) AS pos, round(log10(1 + freq)
        * coalesce(s, CASE WHEN CAST(sc.pos AS DOUBLE) / n > 0.2 AND CAST(sc.pos AS DOUBLE) / n < 0.7 THEN 1.2 ELSE 1.0 END)
        * coalesce(boost, 1.0) * CASE WHEN f IS NULL THEN 1.0 ELSE least(2.0, 1 + 0.1 * f) END, 6) AS score
        FROM sc LEFT JOIN bo USING (term) LEFT JOIN learned USING (term)),
    sr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, term) AS rank FROM scored QUALIFY rank <= 35),
    sn AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM sr),
    banded AS (SELECT doc_id, term, score, rank, CASE WHEN rank <= least(15, ceil(n * 0.45)) THEN 'high'
        WHEN rank <= least(15, ceil(n * 0.45)) + least(10, ceil(n * 0.35)) THEN 'medium' ELSE 'low' END AS priority FROM sn)"""
_ROI = f"""{SQL_GRAMS.replace('runs AS', 'runs AS').replace('[a-z0-9_]+|[^a-z0-9_]+', '[a-z0-9]+|[^a-z0-9]+')},
    tier(term, tier, ord) AS {S.values([(t, n, i) for n, ts in CORPUS_TIERS for i, t in enumerate(ts)])},
    long_docs AS (SELECT doc_id, text FROM documents WHERE len(text) >= 50),
    fnd AS (SELECT DISTINCT doc_id, term, tier, ord FROM grams JOIN tier USING (term) WHERE doc_id IN (SELECT doc_id FROM long_docs)),
    pw AS (SELECT doc_id, {S.words("regexp_replace(lower(text), '[^a-z0-9\\-/]+', ' ', 'g')")} AS w FROM long_docs),
    pt AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM pw),
    pc AS (SELECT doc_id, term, count(*) AS n, min(pos) AS pos FROM pt WHERE len(term) >= 3 AND term NOT IN {S.in_list(R.ROI_STOP_WORDS)}
           AND NOT EXISTS (SELECT 1 FROM fnd WHERE fnd.doc_id = pt.doc_id AND fnd.term = pt.term) GROUP BY ALL),
    un AS (SELECT doc_id, term, 'unclassified' AS tier, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS ord FROM pc QUALIFY ord <= 15),
    al AS (SELECT doc_id, term, tier, ord, regexp_replace(term, '[^a-z0-9/+#]+', ' ', 'g') AS k FROM (SELECT * FROM fnd UNION ALL SELECT * FROM un)),
    ok AS (SELECT * FROM al WHERE trim(k) <> '' AND (tier <> 'unclassified' OR NOT EXISTS (SELECT 1 FROM al b WHERE b.doc_id = al.doc_id AND trim(b.k) = trim(al.k) AND b.tier IN ('high', 'low')))),
    dd AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY doc_id, trim(k), tier ORDER BY ord) = 1),
    roi AS (SELECT doc_id, term, tier, row_number() OVER (PARTITION BY doc_id ORDER BY CASE tier WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'unclassified' THEN 2 ELSE 3 END, dd.ord, term) AS ord FROM dd QUALIFY ord <= 50)"""
_MAND = f"""{SQL_VOCAB}, {SQL_GRAMS},
    hits AS (SELECT doc_id, term, count(*) AS n FROM grams WHERE term IN (SELECT term FROM vocab) GROUP BY ALL),
    mand AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS ord FROM hits QUALIFY ord <= 30)"""
_SOFT_NORM = S.squeeze("replace(regexp_replace(regexp_replace(lower(text), '[‐-―]', '-', 'g'), '[^a-z0-9/+#.\\- ]+', ' ', 'g'), '-', ' ')")

ORACLES = {
    "d1_top_terms": f"{_D1} SELECT doc_id, term, freq, rank, {_BAND} AS band FROM top",
    "d2_dictionary_hits": f"WITH {SQL_VOCAB}, {SQL_GRAMS} SELECT doc_id, term, category, count(*) AS n FROM grams JOIN vocab USING (term) GROUP BY ALL",
    "d3_phrase_hits": f"""
        WITH bw AS (SELECT {S.words('text', '[^a-z0-9]+')} AS w FROM benchmark),
        ph AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM bw),
        dt AS (SELECT doc_id, lower(text) AS t, list_filter(list_transform(string_split_regex(lower(text), '[ \\t\\r\\n]+'),
               lambda x: regexp_replace(x, '[^a-z0-9\\-+#]', '', 'g')), lambda x: len(x) >= 2) AS w FROM documents),
        ds AS (SELECT doc_id, t, list_concat(w, list_transform(list_filter(w, lambda x: ends_with(x, 's') AND len(x) > 3), lambda x: substr(x, 1, len(x) - 1)),
               list_transform(list_filter(w, lambda x: NOT ends_with(x, 's') AND len(x) > 2), lambda x: x || 's')) AS w FROM dt),
        cand AS MATERIALIZED (SELECT doc_id, w, phrase FROM ds JOIN ph ON contains(t, phrase))
        SELECT doc_id, phrase FROM cand WHERE list_has_all(w, string_split(phrase, ' '))""",
    "d5_score_terms": f"WITH {_SCORED} SELECT doc_id, term, freq, pos, score FROM scored",
    "d6_band_terms": f"WITH {_SCORED} SELECT * FROM banded",
    "d7_tech_terms": f"""
        WITH tk AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {S.words('text', '[^a-z0-9\\-/.#+]+')} AS w FROM documents)),
        kt AS (SELECT doc_id, term, 1 AS n, 0 AS p, pos FROM tk WHERE len(term) >= 2 AND term NOT IN {S.in_list(R.STOP_WORDS)} AND (term IN {S.in_list(CORPUS_TECH)} OR len(term) > 4)
               UNION ALL SELECT doc_id, phrase, 0, 1, 1000000000 + i FROM documents, {S.values(list(enumerate(CORPUS_PHRASES)))} AS v(i, phrase) WHERE contains(lower(text), phrase)),
        ct AS (SELECT doc_id, term, sum(n) AS n, sum(p) AS p, min(pos) AS pos FROM kt GROUP BY ALL),
        wt AS (SELECT *, CAST(CASE WHEN term IN {S.in_list(CORPUS_TECH)} AND n > 0 THEN 5 * (pow(5.0, least(n, 300)) - 1) / 4 ELSE n END + 10 * p AS DOUBLE) AS weight FROM ct),
        rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, n DESC, pos) AS rank FROM wt QUALIFY rank <= 50),
        t AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS m FROM rk)
        SELECT doc_id, term, round(log10(1 + weight), 6) AS weight, rank, CASE WHEN rank <= least(20, ceil(m * 0.40)) THEN 'high' WHEN rank <= least(20, ceil(m * 0.40)) + least(15, ceil(m * 0.35)) THEN 'medium' ELSE 'low' END AS priority FROM t""",
    "d8_merge_terms": f"""
        WITH {_MAND}, {sql_top(35)},
        ext AS (SELECT doc_id, term, rank, {_BAND} AS band FROM top),
        b AS (SELECT doc_id, term, 0 AS src, ord, NULL AS band FROM mand UNION ALL SELECT doc_id, term, 1, rank, band FROM ext),
        o AS (SELECT doc_id, term, min(src) AS src, max(band) AS band, arg_min(ord, src) AS o FROM b GROUP BY doc_id, term),
        m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY src, o, term) AS ord FROM o QUALIFY ord <= 50),
        f AS (SELECT *, src = 0 AND band IS NULL AS fresh, sum(CASE WHEN src = 0 AND band IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS nth FROM m),
        h AS (SELECT *, CASE WHEN fresh THEN nth <= 20 ELSE band = 'high' END AS hi FROM f),
        g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hi ORDER BY fresh DESC, ord) AS nh FROM h)
        SELECT doc_id, term, ord, CASE WHEN hi AND nh <= 25 THEN 'high' WHEN band IS NOT NULL AND band <> 'high' THEN band ELSE 'medium' END AS priority FROM g""",
    "d9_classify_roi": f"WITH {_ROI} SELECT * FROM roi",
    "d10_allocate": f"""
        WITH {_ROI}, r AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, sum(CASE WHEN tier = 'high' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS h FROM roi)
        SELECT doc_id, 'summary' AS section, term, ord FROM r WHERE tier = 'high' AND h <= 3
        UNION ALL SELECT doc_id, 'experience', term, ord FROM r WHERE ord <= ceil(n * 0.85)
        UNION ALL SELECT doc_id, 'skills', term, ord FROM r WHERE tier = 'high' AND h <= 20""",
    "d12_soft_skills": f"""
        WITH v(term, form, ord) AS {S.values(T.soft_variants(CORPUS_SOFT))}, d AS (SELECT doc_id, ' ' || {_SOFT_NORM} || ' ' AS hay FROM documents)
        SELECT doc_id, CASE WHEN any_value(contains(hay, ' ' || base || ' skills ')) THEN term || ' skills' ELSE term END AS skill, arg_min(form, ord) AS matched_form
        FROM (SELECT doc_id, hay, term, form, ord, replace(term, '-', ' ') AS base FROM d JOIN v ON contains(hay, ' ' || form || ' ')) GROUP BY doc_id, term""",
    "d13_categorise": f"""
        WITH {SQL_VOCAB}, {sql_top(35)}, t AS (SELECT DISTINCT term FROM top)
        SELECT t.term, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories
        FROM t LEFT JOIN vocab ON vocab.term = replace(t.term, '-', ' ') GROUP BY t.term""",
    "d14_learn": f"""
        WITH {_SCORED}, c AS (SELECT term, count(*) AS frequency, max(doc_id) AS last_seen FROM banded WHERE rank <= 20 GROUP BY term ORDER BY frequency DESC, term LIMIT 500)
        SELECT c.term, frequency, last_seen, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories,
          round(least(2.0, 1 + frequency * CAST(0.1 AS DOUBLE)), 4) AS boost FROM c LEFT JOIN vocab ON vocab.term = c.term GROUP BY ALL""",
    "d15_clean_terms": f"""
        WITH {sql_top(35)}, b AS (SELECT doc_id, rank, CASE WHEN {_BAND} = 'low' THEN upper(substr(term, 1, 1)) || substr(term, 2) WHEN rank = 3 THEN 'strong ' || term ELSE term END AS term FROM top)
        SELECT doc_id, term, rank AS ord FROM b WHERE NOT (lower(term) NOT LIKE '% %' AND (lower(term) IN {S.in_list(R.JUNK_WORDS)} OR len(term) < 3))
          AND NOT ({' OR '.join(f"regexp_matches(lower(term), {S.q(p)})" for p in R.JUNK_PATTERNS)})""",
    "d16_acronym_pairs": """
        WITH p AS (SELECT p_partkey AS doc_id, list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]) AS w, upper(p_type[1]) || lower(p_type[2:]) AS t FROM part),
        s AS (SELECT doc_id, array_to_string(w, ' ') AS long, array_to_string(list_transform(w, lambda x: x[1]), '') AS short, t FROM p)
        SELECT doc_id, short, long FROM s UNION ALL SELECT doc_id, t[1] || 'G' || short, t || '-Grade ' || long FROM s""",
    "d17_term_df": f"""
        WITH {sql_top(35)}, pr AS (SELECT DISTINCT source, term FROM top JOIN documents USING (doc_id)), n AS (SELECT count(DISTINCT source) AS n FROM pr),
        c AS (SELECT term, count(*) AS docs, any_value(n) AS n FROM pr, n GROUP BY term),
        b AS (SELECT term, docs, CAST(round(100.0 * docs / n) AS BIGINT) AS pct, CASE WHEN docs / n >= 0.7 THEN 'common' WHEN docs / n >= 0.4 THEN 'frequent' ELSE 'rare' END AS band FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY docs DESC, term) AS rank FROM b)
        SELECT * FROM r WHERE rank <= CASE band WHEN 'common' THEN 20 WHEN 'frequent' THEN 15 ELSE 10 END""",
}
