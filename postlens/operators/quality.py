"""Documents to quality flags and corpus rollups.

Flags per document are array expressions over its lines, so most operators are one narrow
stage. Where rows per line are the result, the text is spread by document once and windows stay
inside a document.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.text import big, c, found, found_near, hits, keep_present, let, literal_map, outside, percent, picks, pieces, placed_terms, squeeze, sub, sub_all, term_runs
from postlens.operators.terms import by_document, dictionary_hits
from postlens.rules import quality as R


def bare(line: str | Column, bullet: str = R.BULLET) -> Column:
    return F.trim(sub(F.trim(c(line)), bullet))


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text", bullet: str = R.BULLET, heading: str = R.HEADING, date_line: str = R.DATE_LINE) -> DataFrame:
    """(key, line_no, is_bullet, body, section, role): every non-empty line with the heading and the role line above it."""
    rows = by_document(docs, key, text).select(key, F.posexplode(F.split(c(text), "\n")).alias("line_no", "_l")).where(F.trim("_l") != "")
    is_bullet, is_head = F.col("_l").rlike(bullet), F.col("_l").rlike(heading)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    role = F.when(~is_bullet & ~is_head & ~F.col("_l").rlike(date_line), F.trim("_l"))
    return rows.withColumn("is_bullet", is_bullet & ~is_head).withColumn("is_heading", is_head).withColumn(
        "section", F.last(F.when(is_head, F.trim(sub("_l", ":[ \t]*$"))), ignorenulls=True).over(w)).withColumn(
        "role", F.last(role, ignorenulls=True).over(w)).select(key, big("line_no").alias("line_no"), "is_bullet", "is_heading", bare("_l", bullet).alias("body"), "section", "role")


def first_word(body: str | Column) -> Column:
    return sub(F.lower(F.regexp_extract(c(body), r"^[ \t]*([^ \t]+)", 1)), r"[.,;:]$")


def opener_flags(lines: DataFrame, key: str = "doc_id", weak: Sequence[str] = tuple(R.WEAK_OPENERS), strong: Sequence[str] = tuple(R.STRONG_VERBS)) -> DataFrame:
    """(key, bullets, weak, strong, numeric, flagged, verb_coverage)."""
    low, first = F.lower("body"), first_word("body")
    is_weak = F.lit(False)
    for opener in weak:
        is_weak = is_weak | low.startswith(opener)
    is_strong, numeric = first.isin(list(strong)), first.rlike(r"^[$0-9]")
    agg = lambda cond: big(F.count_if(F.col("is_bullet") & cond))
    return lines.groupBy(key).agg(agg(F.lit(True)).alias("bullets"), agg(is_weak).alias("weak"), agg(is_strong).alias("strong"), agg(numeric).alias("numeric"),
                                  agg(~is_strong & ~numeric).alias("flagged"), percent(F.count_if(F.col("is_bullet") & is_strong), F.count_if("is_bullet")).alias("verb_coverage"))


def line_shape(body: str | Column) -> Column:
    out = F.when(F.size(F.split(c(body), r"[ \t]+")) <= 10, "short-punchy").otherwise("standard")
    for name, pattern in reversed(R.LINE_SHAPES):
        out = F.when(found(body, pattern), name).otherwise(out)
    return out


def repetition(lines: DataFrame, key: str = "doc_id", stop: Sequence[str] = tuple(R.REPEAT_STOP_WORDS)) -> DataFrame:
    """(key, kind, value, n): openers used twice, shapes used three times, uniform length, words repeated inside a line."""
    bullets = lines.where("is_bullet")
    word = F.lower(F.regexp_extract("body", r"^([A-Za-z]+)", 1))
    openers = bullets.where(word != "").groupBy(key, word.alias("value")).agg(big(F.count("*")).alias("n")).where("n >= 2").withColumn("kind", F.lit("opener"))
    shapes = bullets.where(word != "").groupBy(key, line_shape("body").alias("value")).agg(big(F.count("*")).alias("n")).where("n >= 3").withColumn("kind", F.lit("shape"))
    n = F.size(F.split("body", r"[ \t]+"))
    lengths = bullets.select(key, n.alias("w")).groupBy(key).agg(big(F.count("*")).alias("n"), F.avg("w").alias("a"), F.max("w").alias("hi"), F.min("w").alias("lo"))
    uniform = lengths.where((F.col("n") >= 4) & (F.greatest(F.col("hi") - F.col("a"), F.col("a") - F.col("lo")) / F.col("a") < 0.2)).select(
        key, F.lit("uniform").alias("value"), "n", F.lit("length").alias("kind"))
    ws = F.filter(picks(F.lower("body"), r"([a-z][a-z\-]{3,})"), lambda w: outside(w, stop))
    twice = let(ws, lambda a: F.try_element_at(F.filter(a, lambda w, i: F.array_position(a, w) <= i), F.lit(1)))
    again = bullets.select(key, twice.alias("value")).where("value is not null").groupBy(key, "value").agg(big(F.count("*")).alias("n")).withColumn("kind", F.lit("repeated"))
    cols = [key, "kind", "value", "n"]
    return openers.select(*cols).unionByName(shapes.select(*cols)).unionByName(uniform.select(*cols)).unionByName(again.select(*cols))


def metrics(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lines, quantified, ratio, found, density, scope, overclaiming) over bullet lines; short lines need no number."""
    b = F.col("is_bullet")
    long = F.length("body") >= 25
    n_found = sum((hits("body", p) for p in R.METRICS), F.lit(0))
    n, stat = F.count_if(b), F.count_if(b & long & found("body", R.BIG_STAT))
    judged = F.count_if(b & long)
    return lines.groupBy(key).agg(
        big(n).alias("lines"), big(F.count_if(b & (~long | found("body", R.SCALE)))).alias("quantified"), big(F.sum(F.when(b, n_found).otherwise(0))).alias("found"),
        F.round(F.coalesce(stat / F.nullif(judged, F.lit(0)), F.lit(0.0)), 4).alias("density"), big(F.count_if(b & found("body", R.SCOPE))).alias("scope"),
        ((judged >= 4) & (stat >= 0.7 * judged)).alias("overclaiming")).withColumn(
        "ratio", F.when(F.col("lines") > 0, F.round(F.col("quantified") / F.nullif(F.col("lines"), F.lit(0)), 4)).otherwise(1.0))


def duty_rule(body: str | Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(R.DUTY_RULES):
        out = F.when(found(body, pattern), name).otherwise(out)
    return out


def language_flags(lines: DataFrame, key: str = "doc_id", base_verbs: Sequence[str] = tuple(R.BASE_VERBS), max_chars: int = 280, dated: str = R.DATE_LINE) -> DataFrame:
    """(key, rule, line_no, detail): tense under an ended role, pronouns, duty language, long lines."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    current = F.when(F.col("is_heading"), F.lit("?")).when(~F.col("is_bullet") & found("body", dated), F.when(found("body", R.CURRENT), "y").otherwise("n"))
    verb = F.regexp_replace(first_word("body"), "[^a-z]", "")
    ended = F.last(current, ignorenulls=True).over(w) == "n"
    stale = ended & verb.isin(list(base_verbs)) & outside(verb, R.IRREGULAR_PAST) & ~verb.endswith("ed")
    flags = F.filter(F.array(
        F.struct(F.lit("tense").alias("rule"), F.when(F.col("_stale"), verb).alias("detail")),
        F.struct(F.lit("pronoun").alias("rule"), F.when(found("body", R.PRONOUNS), F.lit("first person")).alias("detail")),
        F.struct(F.lit("duty").alias("rule"), duty_rule("body").alias("detail")),
        F.struct(F.lit("long").alias("rule"), F.when(F.length("body") > max_chars, F.length("body").cast("string")).alias("detail"))), lambda s: s["detail"].isNotNull())
    return lines.withColumn("_stale", stale).where("is_bullet").select(key, "line_no", F.inline(flags))


def contact_flags(text: str | Column) -> dict[str, Column]:
    email = c(text).contains("@") & found(text, R.EMAIL)
    phone = found(text, "[0-9]{3}") & found(text, R.PHONE)
    profile, place = found_near(text, R.PROFILE, ["linkedin.com/in/"]), reduce(lambda a, b: a | b, [found_near(text, p, n) for p, n in R.PLACE_PARTS])
    return {"has_email": email, "has_phone": phone, "has_profile": profile, "has_place": place}


def format_flags(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Date formats in use, standard headings missing, required sections and contact details present.

    A pattern is tried only on texts that hold a string all its matches have, and once per text: the flags are one
    expression, and those made of others are made behind it.
    """
    dated = let(found(text, "[0-9]{4}"), lambda years: sum(((years & found_near(text, p, R.DATE_NEEDLES[n])).cast("int") for n, p in R.DATE_FORMATS), F.lit(0)))
    missing = sum((~found_near(text, p, R.HEADING_NEEDLES[n])).cast("int") for n, p in R.STANDARD_HEADINGS)
    sections = {f"has_{n}": found_near(text, p, R.SECTION_NEEDLES[n]) for n, p in R.SECTION_WORDS}
    flags = F.struct(big(dated).alias("date_formats"), big(missing).alias("headings_missing"), *[v.alias(k) for k, v in {**sections, **contact_flags(text)}.items()])
    out = docs.select(key, F.inline(F.array(flags)))
    out = out.withColumn("contact_complete", F.col("has_email") & F.col("has_phone") & (F.col("has_profile") | F.col("has_place")))
    return out.withColumn("sections_complete", F.col("has_experience") & F.col("has_education") & F.col("has_skills"))


def document_features(docs: DataFrame, key: str = "doc_id", text: str = "text", bullet: str = R.BULLET) -> DataFrame:
    """The per-document columns that scorecards and gates read, computed inside the row."""
    body = c(text)
    base = format_flags(docs.select(key, text), key, text)
    rows = docs.select(key, F.filter(F.transform(F.split(body, "\n"), lambda l: F.trim(l)), lambda l: l != "").alias("_l"), sum((hits(body, p) for p in R.METRICS), F.lit(0)).alias("quantified"),
                       found(body, r"\t.*\t").alias("tab_columns"))
    rows = rows.withColumn("_b", F.transform(F.filter("_l", lambda l: l.rlike(bullet)), lambda l: F.trim(F.regexp_replace(l, bullet, "")))).withColumn(
        "_top", F.array_join(F.slice("_l", 1, 4), " "))

    def count(test):
        return big(F.size(F.filter("_b", test)))

    strong = count(lambda l: F.regexp_replace(F.lower(F.regexp_extract(l, r"^([^ \t]+)", 1)), r"[.,;:]$", "").isin(R.STRONG_VERBS))
    weak = lambda l: F.exists(F.array(*[F.lit(o) for o in R.WEAK_OPENERS]), lambda o: F.lower(l).startswith(o))
    duty = lambda l: l.rlike("|".join(f"(?:{p})" for _, p in R.DUTY_RULES))
    rows = rows.select(
        key, big("quantified").alias("quantified"), "tab_columns", big(F.size("_b")).alias("bullets"), percent(strong, F.size("_b")).alias("verb_coverage"),
        found("_top", R.EMAIL).alias("header_email"), found("_top", r"[0-9]{6,}|[0-9][0-9 ().\-]{7,}").alias("header_phone"),
        (~found(F.array_join(F.slice("_l", 1, 14), "\n"), R.SCALE)).alias("top_weak"), count(lambda l: F.length(l) > 280).alias("long_lines"), count(weak).alias("weak_openers"),
        count(duty).alias("duty_lines"), count(lambda l: l.rlike(R.SCALE)).alias("quantified_lines"), count(lambda l: l.rlike(R.SCOPE)).alias("scope_lines"),
        count(lambda l: l.rlike(R.PRONOUNS)).alias("pronoun_lines"))
    return base.withColumn("has_profile_or_place", F.col("has_profile") | F.col("has_place")).join(rows, key)


def consistency_flags(docs: DataFrame, key: str = "doc_id", text: str = "text", company: str | None = None) -> DataFrame:
    """(key, rule, detail): UK honours with a GPA, certificates over three domains, the hiring company under another employer,
    projects without links, generic ones, own-repo open source, and the dominant repo handle."""
    ls = F.filter(F.transform(F.split(c(text), "\n"), lambda l: F.trim(l)), lambda l: l != "")
    rows = docs.select(key, c(text).alias("_t"), ls.alias("_l"), (F.lower(company) if company else F.lit(None).cast("string")).alias("_co"))
    gpa = F.transform(F.filter(F.arrays_zip(F.col("_l").alias("a"), F.slice("_l", 2, 1 << 30).alias("b")), lambda z: z["a"].rlike(R.UK_CLASS) & (
        z["a"].rlike(R.GPA) | (F.coalesce(z["b"].rlike(R.GPA), F.lit(False)) & ~F.coalesce(z["b"].rlike(R.UK_CLASS), F.lit(False))))), lambda z: F.substring(z["a"], 1, 120))
    certs = F.regexp_extract("_t", r"(?is)CERTIFICATIONS[ \t]*:?[ \t]*\n(.*?)(?:\n[A-Z][A-Z ]{3,}[ \t]*:?[ \t]*\n|\z)", 1)
    domains = let(certs, lambda b: keep_present(*[F.when(b.rlike(p), F.lit(n)) for n, p in R.CERT_DOMAINS]))
    handles = F.filter(F.transform(picks("_t", R.REPO_HANDLE), lambda h: F.lower(h)), lambda h: outside(h, R.NOT_HANDLES))
    rows = rows.withColumn("_h", let(handles, lambda hs: F.try_element_at(F.array_sort(F.transform(F.array_distinct(hs), lambda h: F.struct(
        (-F.size(F.filter(hs, lambda x: x == h))).alias("n"), F.array_position(hs, h).alias("i"), h.alias("h")))), F.lit(1))["h"]))
    projects = F.regexp_extract("_t", r"(?is)(?:^|\n)(?:SELECTED |TECHNICAL |KEY |PERSONAL |SIDE |NOTABLE )?PROJECTS[ \t]*:?[ \t]*\n(.*?)(?:\n(?:WORK EXPERIENCE|PROFESSIONAL EXPERIENCE|EXPERIENCE|EDUCATION|SKILLS|CERTIFICATIONS|SUMMARY)[ \t]*:?[ \t]*\n|\z)", 1)
    blocks = F.filter(F.transform(F.split(projects, r"\n[ \t]*\n"), lambda b: F.trim(b)), lambda b: b != "")
    rows = rows.withColumn("_p", blocks)
    title = lambda b: F.substring(F.regexp_extract(b, r"^([^\n]*)", 1), 1, 90)
    outside_repo = lambda b: F.exists(picks(b, R.REPO_HANDLE), lambda h: F.col("_h").isNull() | (F.lower(h) != F.col("_h")))
    mentions = F.filter(F.arrays_zip(F.col("_l").alias("l"), F.transform("_l", lambda l, i: F.slice("_l", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))).alias("before")),
                        lambda z: z["l"].rlike(R.BULLET) & F.lower(z["l"]).contains(F.col("_co")) & ~F.exists(z["before"], lambda b: ~b.rlike(R.BULLET) & F.lower(b).contains(F.col("_co"))))

    def tag(rule, arr):
        return F.transform(F.coalesce(arr, F.array().cast("array<string>")), lambda d: F.struct(F.lit(rule).alias("rule"), d.alias("detail")))

    flags = F.concat(
        tag("uk_class_with_gpa", gpa), tag("scattered_certificates", let(domains, lambda d: F.when(F.size(d) >= 3, F.array(F.array_join(d, ","))))),
        tag("hiring_company", F.transform(mentions, lambda z: F.substring(z["l"], 1, 140))), tag("project_without_link", F.transform(F.filter("_p", lambda b: ~b.rlike(R.PROJECT_LINK)), title)),
        tag("generic_project", F.transform(F.filter("_p", lambda b: title(b).rlike(R.GENERIC_PROJECT)), title)),
        tag("own_repo_open_source", F.transform(F.filter("_p", lambda b: b.rlike(r"(?i)open[ \-]?source") & ~outside_repo(b)), title)), tag("dominant_handle", keep_present(F.col("_h"))))
    return rows.select(key, F.inline(flags))


def summary_flags(docs: DataFrame, key: str = "doc_id", text: str = "text", original: str | None = None, title: str | None = None, name: str | None = None) -> DataFrame:
    """(key, missing, claimed_title, drift, other_profession): what the first 14 lines lack, and a summary that tells of another job."""
    body = c(text)
    ls = F.filter(F.transform(F.split(body, "\n"), lambda l: F.trim(l)), lambda l: l != "")
    lead = F.regexp_extract(body, r"(?is)(?:^|\n)(?:PROFESSIONAL SUMMARY|SUMMARY|PROFILE)[ \t]*\n+([^\n]{10,200})", 1)
    lead = sub(lead, r"(?i)^(?:experienced|accomplished|seasoned|results[- ]driven|strategic|innovative|senior)[ ]+")
    guess = F.trim(F.regexp_extract(lead, r"(?i)^(.*?)(?:[ ]+with[ ]+|,|\.|[ ]who[ ]|$)", 1))
    stop = "senior sr junior jr lead staff principal the and of for a an experienced accomplished seasoned with over".split()
    ws = lambda x: F.filter(F.transform(F.split(F.lower(x), "[ ]+"), lambda w: F.regexp_replace(w, "[^a-z]", "")), lambda w: (F.length(w) > 2) & outside(w, stop))
    rows = docs.withColumn("_top", F.lower(F.array_join(F.slice(ls, 1, 14), "\n"))).withColumn("_g", guess)
    fits = (F.col("_g") != "") & (F.size(F.split("_g", " +")) <= 6)
    old = F.lower(c(original)) if original else F.lit(None).cast("string")
    drift = fits & (F.size(ws(F.col("_g"))) > 0) & ~let(old, lambda o: F.exists(ws(F.col("_g")), lambda w: o.contains(w)))
    target = F.split(F.lower(c(title)), "[^a-z]+") if title else F.array().cast("array<string>")
    held = F.filter(F.split(F.lower("_g"), "[^a-z]+"), lambda w: F.length(w) > 3)
    other = fits & (F.size(held) > 0) & ~F.arrays_overlap(held, target) if title else F.lit(False)
    missing = keep_present(
        F.when(~F.col("_top").contains(F.split(F.lower(c(name)), " ")[0]), "name") if name else F.lit(None).cast("string"),
        F.when(~F.col("_top").contains(F.lower(c(title))), "target-title") if title else F.lit(None).cast("string"), F.when(~found("_top", R.SCALE), "quantified-proof"))
    return rows.select(key, missing.alias("missing"), F.substring("_g", 1, 60).alias("claimed_title"), F.coalesce(drift, F.lit(False)).alias("drift"), F.coalesce(other, F.lit(False)).alias("other_profession"))


def prose_score(docs: DataFrame, key: str = "doc_id", text: str = "text", tails: str = R.PARTICIPIAL_TAILS, stock: Sequence[str] = tuple(R.STOCK_PHRASES), passive: str = R.PASSIVE, window: int | None = None) -> DataFrame:
    """(key, score, tells): steady sentence length +25, few distinct words +15, participial tails ≤ 25, tricolons +10, stock phrases ≤ 20, passive +10; under 40 words 0.

    Distinct words are counted over the whole text, or over its first ``window`` words.
    """
    body = c(text)
    n_words = F.size(pieces(F.trim(body), r"[ \t\r\n]+"))
    # Cut after each mark: matching whole sentences instead would retry every start of a long unpunctuated line.
    cut = F.filter(F.split(body, r"(?<=[.!?])\n?|\n"), lambda s: s.rlike(r"[^.!?][.!?]$"))
    sentences = F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: F.size(F.split(s, r"[ \t\r\n]+")) > 2)
    lower_words = picks(F.lower(body), r"([a-z][a-z'\-]+)")
    rows = docs.select(key, body.alias("_t"), n_words.alias("_n"), sentences.alias("_s"), (F.slice(lower_words, 1, window) if window else lower_words).alias("_w"))
    rows = rows.withColumn("_len", F.transform("_s", lambda s: F.size(F.split(s, r"[ \t\r\n]+")).cast("double"))).withColumn("_k", F.size("_s")).withColumn(
        "_mean", F.aggregate("_len", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.col("_k"), F.lit(0)))
    sd = F.sqrt(F.aggregate("_len", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / F.nullif(F.col("_k"), F.lit(0)))
    rows = rows.withColumn("_cv", F.round(sd / F.col("_mean"), 9)).withColumn("_tails", hits("_t", tails)).withColumn("_tri", hits("_t", R.TRICOLON)).withColumn(
        "_stock", sum((found("_t", "(?i)" + p).cast("int") for p in stock), F.lit(0))).withColumn("_pass", F.size(F.filter("_s", lambda s: s.rlike(passive))))
    enough = F.col("_k") >= 4
    parts = [("uniform-sentence-length", enough & (F.col("_cv") < 0.35), F.lit(25)),
             ("low-vocabulary-diversity", (F.size("_w") >= 80) & (F.size(F.array_distinct("_w")) < 0.45 * F.size("_w")), F.lit(15)),
             ("participial-tails", F.col("_tails") >= 2, F.least(F.lit(25), F.col("_tails") * 8)), ("tricolon-rhythm", F.col("_tri") >= 3, F.lit(10)),
             ("stock-phrasing", F.col("_stock") > 0, F.least(F.lit(20), F.col("_stock") * 7)), ("passive-voice", enough & (F.col("_pass") > 0.3 * F.col("_k")), F.lit(10))]
    judged = F.col("_n") >= 40
    score = sum((F.when(judged & F.coalesce(cond, F.lit(False)), points).otherwise(0) for _, cond, points in parts), F.lit(0))
    return rows.select(key, big(F.least(F.lit(100), score)).alias("score"), keep_present(*[F.when(judged & F.coalesce(cond, F.lit(False)), F.lit(n)) for n, cond, _ in parts]).alias("tells"))


def vocabulary_issues(docs: DataFrame, lexicon: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, issue, n): words and phrases of the caller's ``lexicon``, American -ize spellings, em dashes and first-person pronouns in a text."""
    rules = docs.sparkSession.createDataFrame([(w.lower(), "word") for w in lexicon], "term string, category string")
    words = dictionary_hits(docs, rules, key, text).select(key, F.col("term").alias("issue"), "n")
    body = c(text)
    shapes = F.filter(F.array(
        F.struct(F.lit("em dash").alias("issue"), hits(body, "—").alias("n")),
        F.struct(F.lit("-ize spelling").alias("issue"), hits(body, r"(?i)[a-z]+ize[ds]?(?:$|[^A-Za-z0-9_])").alias("n")),
        F.struct(F.lit("pronoun").alias("issue"), (hits(body, r"(?:^|[^A-Za-z0-9_])(?:I|[Mm][Yy])[ \t\r\n]")).alias("n"))), lambda s: s["n"] > 0)
    return words.unionByName(docs.select(key, F.inline(shapes)))


def vocabulary_report(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, before, after, score_before, score_after) from two issue tables; score is 100 − 5 per issue."""
    one = lambda df, name: df.groupBy(key).agg(big(F.count("*")).alias(name))
    out = one(before, "before").join(one(after, "after"), key, "full_outer").na.fill(0, ["before", "after"])
    return out.withColumns({f"score_{n}": F.greatest(F.lit(0).cast("bigint"), 100 - 5 * F.col(n)) for n in ("before", "after")})


def placeholders(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns: Sequence[str] = tuple(R.PLACEHOLDERS)) -> DataFrame:
    """(key, token): distinct unfilled tokens."""
    tokens = F.flatten(F.array(*[picks(text, p, 0) for p in patterns]))
    return docs.select(key, F.explode(F.array_distinct(F.transform(tokens, lambda t: F.trim(t)))).alias("token"))


def drop_placeholders(docs: DataFrame, text: str = "text", patterns: Sequence[str] = tuple(R.PLACEHOLDERS)) -> DataFrame:
    """Removes the sentences that hold a placeholder; a paragraph left with fewer than four words goes too."""
    bad = "|".join(f"(?:{p})" for p in patterns)

    def clean(para):
        kept = F.array_join(F.filter(picks(para, r"([^.!?]+[.!?]*)"), lambda s: ~s.rlike(bad)), " ")
        kept = squeeze(kept)
        return F.when(~para.rlike(bad), para).otherwise(F.when(F.size(pieces(kept, " +")) >= 4, kept).otherwise(F.lit("")))

    out = F.array_join(F.transform(F.split(c(text), "\n"), clean), "\n")
    return docs.withColumn(text, sub_all(out, [(r"\n{3,}", "\n\n"), (r"\A[ \n]+|[ \n]+\z", "")]))


def letter_health(texts: DataFrame, keys: Sequence[str], text: str = "text", mine: str = "I", yours: str = "you|your|we|our") -> DataFrame:
    """(keys, words, i, you, too_long, self_heavy)."""
    n = big(F.size(pieces(text, r"[ \t\r\n]+")))
    out = texts.select(*keys, n.alias("words"), hits(text, R.word(mine)).alias("i"), hits(text, "(?i)" + R.word(yours)).alias("you"))
    return out.withColumn("too_long", F.col("words") > 350).withColumn(
        "self_heavy", (F.col("i") > 0) & (F.col("you") > 0) & (F.col("i") > 0.65 * (F.col("i") + F.col("you"))))


def normalise_corpus(docs: DataFrame, substitutions: Mapping[str, str], phrases: Sequence[tuple[str, str]] = (), drop: Sequence[str] = tuple(R.FILLER_WORDS), text: str = "text") -> DataFrame:
    """Word substitutions with case kept, fillers dropped, phrase rules, dashes tidied; ``changes`` counts them.

    Words are looked up in one literal map per token instead of running one regex per rule.
    """
    body = c(text)
    for pattern, replacement in phrases:
        body = sub(body, pattern, replacement)
    body = sub_all(body, [(r"([0-9])[ ]*[—–][ ]*([0-9])", "$1-$2"), (r"[ ]*—[ ]*", ", ")])
    table = literal_map({**{k.lower(): v for k, v in substitutions.items()}, **{w: "" for w in drop}})

    def swap(token):
        new = F.try_element_at(table, F.lower(token))
        shaped = F.when(token == F.upper(token), F.upper(new)).when(F.substring(token, 1, 1).rlike("[A-Z]"), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)
        return F.coalesce(F.when(F.length(token) > 1, shaped).otherwise(new), token)

    tokens = picks(body, r"[A-Za-z][A-Za-z'\-]*|[^A-Za-z]+", 0)
    work = docs.withColumn("_k", tokens).withColumn("changes", big(F.size(F.filter("_k", lambda t: F.try_element_at(table, F.lower(t)).isNotNull()))))
    joined = F.array_join(F.transform("_k", swap), "")
    return work.withColumn(text, F.trim(sub_all(joined, [(r"[ \t]{2,}", " "), (r"[ \t]+([.,;:])", "$1"), (r" \n", "\n")]))).drop("_k")


def rewrite_counts(docs: DataFrame, substitutions: Mapping[str, str], phrases: Sequence[tuple[str, str]] = (), drop: Sequence[str] = tuple(R.FILLER_WORDS), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rule, n): how often each rule of ``normalise_corpus`` applies; rules that never apply give no row.

    Rules: ``phrase:`` and its pattern, ``range dash``, ``clause dash``, ``word:`` and the word replaced, ``filler:`` and the word dropped.
    """
    body, steps = c(text), []
    for pattern, replacement in phrases:
        steps.append(F.struct(F.lit("phrase:" + pattern).alias("rule"), hits(body, pattern).alias("n")))
        body = sub(body, pattern, replacement)
    ranges = r"([0-9])[ ]*[—–][ ]*([0-9])"
    steps.append(F.struct(F.lit("range dash").alias("rule"), hits(body, ranges).alias("n")))
    body = sub(body, ranges, "$1-$2")
    steps.append(F.struct(F.lit("clause dash").alias("rule"), hits(body, r"[ ]*—[ ]*").alias("n")))
    body = sub(body, r"[ ]*—[ ]*", ", ")
    table = literal_map({**{k.lower(): "word:" + k.lower() for k in substitutions}, **{w: "filler:" + w for w in drop}})
    named = F.filter(F.transform(picks(body, r"[A-Za-z][A-Za-z'\-]*", 0), lambda t: F.try_element_at(table, F.lower(t))), lambda r: r.isNotNull())
    counted = F.transform(term_runs(placed_terms(named, lambda r: F.lit(True))), lambda r: F.struct(r["term"].alias("rule"), r["freq"].alias("n")))
    rows = docs.select(key, F.concat(F.array(*steps), counted).alias("_r"))
    return rows.select(key, F.inline_outer("_r")).where("n > 0")


def audit_summary(flags: DataFrame, docs: DataFrame, key: str = "doc_id", by: str = "lang") -> DataFrame:
    """(kind, by, docs, pct): share of documents with each kind of flag, with subtotals, by rollup."""
    kinds = flags.select(key, "kind").distinct().join(docs.select(key, by), key)
    total = docs.agg(F.count("*")).scalar()
    return kinds.rollup("kind", by).agg(big(F.countDistinct(key)).alias("docs")).withColumn("_n", total).withColumn(
        "pct", percent(F.col("docs"), F.col("_n"))).drop("_n")


def flag_quality(flags: DataFrame, labels: DataFrame, severity: Mapping[str, str], key: str = "doc_id") -> DataFrame:
    """(kind, severity, docs, labelled, low, toxic): documents with each kind of flag, and how many of them labels mark.

    Kinds that ``severity`` does not name are ``info``. Labels meet flags by document; both are one row per document and kind.
    """
    marks = labels.groupBy(key).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    kinds = flags.select(key, "kind").distinct().join(marks, key, "left")
    level = F.coalesce(F.try_element_at(literal_map(dict(severity)), F.col("kind")), F.lit("info"))
    return kinds.groupBy("kind", level.alias("severity")).agg(
        big(F.count("*")).alias("docs"), big(F.count("quality")).alias("labelled"), big(F.count_if(F.col("quality") == 0)).alias("low"), big(F.count_if(F.col("toxic") == 1)).alias("toxic"))


def worst_documents(flags: DataFrame, key: str = "doc_id", top: int = 20) -> DataFrame:
    return flags.groupBy(key).agg(big(F.count("*")).alias("flags")).orderBy(F.desc("flags"), key).limit(top)


def clamp_sections(sections: DataFrame, text: str = "text", max_chars: int = 220, looking: str = R.LOOKING) -> DataFrame:
    """Drops "looking to …" sentences and cuts at a sentence end within ``max_chars``; long or bulleted blocks are left alone. Adds removed, clamped."""
    body = c(text)
    odd = (F.size(F.split(body, "\n")) > 6) | found(body, r"(?:^|\n)[ \t]*[-•*][ \t]*[^ \t\n]")
    sentences = F.filter(F.transform(picks(sub(body, "\n", " "), r"([^.!?]+[.!?]*)"), lambda s: F.trim(s)), lambda s: s != "")
    work = sections.withColumn("_s", F.filter(sentences, lambda s: ~s.rlike(looking))).withColumn("removed", big(F.size(sentences) - F.size("_s")))
    full = F.array_join("_s", " ")
    take = F.aggregate("_s", F.struct(F.lit("").alias("t"), F.lit(True).alias("open")), lambda a, s: let(
        F.when(a["t"] == "", s).otherwise(F.concat(a["t"], F.lit(" "), s)), lambda grown: F.struct(
            F.when(a["open"] & (F.length(grown) <= max_chars), grown).otherwise(a["t"]).alias("t"), (a["open"] & (F.length(grown) <= max_chars)).alias("open"))))
    cut = let(take["t"], lambda t: F.when(t != "", t).otherwise(F.concat(sub(F.substring(full, 1, max_chars), r"[ ]+[^ ]*$"), F.lit("."))))
    return work.withColumn("_odd", odd).withColumn("clamped", ~F.col("_odd") & (F.length(full) > max_chars)).withColumn("removed", F.when(F.col("_odd"), 0).otherwise(F.col("removed"))).withColumn(
        text, F.when(F.col("_odd"), body).when(F.col("clamped"), cut).otherwise(full)).drop("_s", "_odd")


def line_type(body: str | Column, types: Sequence[tuple[str, str]] = tuple(R.LINE_TYPES)) -> Column:
    out = F.lit("general")
    for name, pattern in reversed(list(types)):
        out = F.when(found(body, pattern), name).otherwise(out)
    return out


def line_types(lines: DataFrame, key: str = "doc_id", types: Sequence[tuple[str, str]] = tuple(R.LINE_TYPES)) -> DataFrame:
    """(key, type, n, pct): mix of line types, first match wins."""
    counts = lines.groupBy(key, line_type("body", types).alias("type")).agg(big(F.count("*")).alias("n"))
    return counts.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy(key))))


def denoise(docs: DataFrame, key: str = "doc_id", text: str = "text", bullet: str = R.BULLET, filler: str = R.FILLER_LINE) -> DataFrame:
    """Cleaned text and how often each rule fired: filler lines out, vague comma tails and bolted-on standards cut, percentages stripped from bullet lines."""
    def one(line):
        is_b = line.rlike(bullet)
        is_filler = is_b & F.regexp_replace(line, bullet, "").rlike(filler) & ~line.rlike("[0-9]")
        tail = F.regexp_extract(line, R.TAIL, 1)
        vague = is_b & (tail != "") & ~tail.rlike(R.CONCRETE)
        bolted, pct = is_b & line.rlike(R.STANDARD_TAIL), is_b & line.rlike(R.PERCENTAGE)
        out = F.when(vague, F.regexp_replace(line, R.TAIL, ".")).when(bolted, F.regexp_replace(line, R.STANDARD_TAIL, ".")).otherwise(line)
        out = F.when(pct, F.regexp_replace(F.regexp_replace(out, R.PERCENTAGE, ""), r"[ ]{2,}", " ")).otherwise(out)
        return F.struct(is_filler.alias("filler"), vague.alias("vague"), (bolted & ~vague).alias("standard"), pct.alias("percentage"), out.alias("line"))

    work = docs.withColumn("_r", F.transform(F.split(c(text), "\n"), one))
    count = lambda f: big(F.size(F.filter("_r", lambda s: s[f])))
    return work.withColumns({f"removed_{n}": count(n) for n in ("filler", "vague", "standard", "percentage")}).withColumn(
        text, F.array_join(F.transform(F.filter("_r", lambda s: ~s["filler"]), lambda s: s["line"]), "\n")).drop("_r")


def repair_case(docs: DataFrame, text: str = "text", casing: Mapping[str, str] = R.CASING, gerunds: Mapping[str, str] = R.GERUND_PAST) -> DataFrame:
    """Display casing of known tokens outside urls and addresses, weak openers replaced, inline ``HEADER: text`` split. Adds ``fixed``."""
    table, past = literal_map(dict(casing)), literal_map(dict(gerunds))

    def token(t):
        new = F.try_element_at(table, F.lower(t))
        keep = new.isNull() | (t == new) | ((F.length(t) > 1) & (t == F.upper(t)))
        return F.when(keep, t).otherwise(new)

    def one(line):
        skip = line.rlike(r"(?i)://|@|www\.|\.(?:com|io|dev|net|org)(?:$|[^A-Za-z0-9_])")
        cased = F.when(skip, line).otherwise(F.array_join(F.transform(picks(line, r"[A-Za-z0-9_/]+|[^A-Za-z0-9_/]+", 0), token), ""))
        verb = F.try_element_at(past, F.lower(F.regexp_extract(cased, R.WEAK_PREFIX, 2)))
        opened = F.when(verb.isNotNull(), F.concat(F.regexp_extract(cased, R.WEAK_PREFIX, 1), verb, F.regexp_replace(cased, R.WEAK_PREFIX, ""))).otherwise(cased)
        return F.regexp_replace(opened, r"^([A-Z][A-Z &/]{3,}):[ \t]+([^ \t].*)$", "$1\n$2")

    ls = F.split(c(text), "\n")
    work = docs.withColumn("_old", ls).withColumn("_new", F.transform(ls, one))
    changed = F.size(F.filter(F.zip_with("_old", "_new", lambda a, b: a != b), lambda x: x))
    return work.withColumn("fixed", big(changed)).withColumn(text, F.array_join("_new", "\n")).drop("_old", "_new")


def dedupe_sections(lines: DataFrame, key: str = "doc_id", heading: str = "is_heading", body: str = "body", line: str = "line_no") -> DataFrame:
    """Lines without second copies of a section: a heading seen before takes its whole block with it."""
    w = Window.partitionBy(key).orderBy(line)
    name = F.when(F.col(heading), F.upper(F.trim(sub(body, r":[ \t]*$"))))
    work = lines.withColumn("_h", name).withColumn("_block", F.count("_h").over(w))
    nth = F.row_number().over(Window.partitionBy(key, "_h").orderBy(line))
    work = work.withColumn("_nth", F.when(F.col("_h").isNotNull(), nth))
    first = F.max("_nth").over(Window.partitionBy(key, "_block"))
    return work.withColumn("_first", first).where(F.coalesce("_first", F.lit(1)) == 1).drop("_h", "_block", "_nth", "_first")
