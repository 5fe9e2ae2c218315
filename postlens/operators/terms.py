"""Documents to term rows: counting, dictionary scans, scoring, banding, merging.

Terms are counted, and where nothing is joined ranked, inside the document's row; what leaves a
row are narrow (document, term) rows, never its text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.joins import lengths, sieve
from postlens.functions.session import spread
from postlens.functions.text import big, c, first_terms, half_up, let, literal_map, outside, picks, pieces, placed_terms, squeeze, sub, sub_all, term_runs, word_array, words
from postlens.rules import terms as R


def by_document(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key and text, hash-partitioned by document. Expressions on the text belong after this, so only the text moves."""
    return docs.select(key, text).repartition(key)


def lookup_join(rows: DataFrame, rules: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join to a derived rules table without a hint.

    Rows that no rule can match are sifted out in place first (inner and semi joins), so what a
    shuffle join moves is about its result. The planner broadcasts the rules when its statistics are
    below the session's threshold; hot keys of a shuffle join are split by adaptive execution.
    """
    if how in ("inner", "left_semi"):
        rows = rows.where(sieve(rules.select(*on), on))
    return rows.join(rules, list(on), how)


def band(rank: Column, n: Column, high: float, medium: float, high_cap: int | None = None, medium_cap: int | None = None) -> Column:
    """high, medium or low by share of ``n``, each share rounded up and optionally capped."""
    top, mid = F.ceil(n * F.lit(high)), F.ceil(n * F.lit(medium))
    if high_cap:
        top = F.least(top, F.lit(high_cap))
    if medium_cap:
        mid = F.least(mid, F.lit(medium_cap))
    return F.when(rank <= top, "high").when(rank <= top + mid, "medium").otherwise("low")


def ranked(rows: DataFrame, key: str, order: Sequence[Column], n: int | None) -> DataFrame:
    """``rank`` within a document, first ``n`` kept (all, if None): the operator's own cut, limited before any shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(w))
    return (rows if n is None else rows.where(F.col("rank") <= n)).withColumn("rank", big("rank"))


def top_terms(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 35,
              stop: Sequence[str] = tuple(R.STOP_WORDS)) -> DataFrame:
    """(key, term, freq, rank, band): most frequent terms, ties by first appearance. Counted and ranked inside the row: no shuffle."""
    counted = term_runs(placed_terms(words(text), lambda t: (F.length(t) > 2) & outside(t, stop)))
    # The outer form: the planner would filter on the size of a plain one, and so count everything twice.
    rows = spread(docs, key, text).select(key, first_terms(counted, n).alias("_t")).select(key, F.size("_t").alias("_n"), F.posexplode_outer("_t").alias("_i", "_one")).where("_i is not null")
    rank = big(F.col("_i") + 1)
    return rows.select(key, "_one.term", "_one.freq", rank.alias("rank"), band(F.col("_i") + 1, F.col("_n"), 0.4, 0.35).alias("band"))


# ---------------------------------------------------------------- dictionary scans

def grams(text: str | Column, spans: Column | Sequence[int], word: str = "a-z0-9_") -> Column:
    """Every span of as many words as ``spans`` lists, as written, lower-cased, one blank per white-space run.

    A term is in this array exactly when it occurs in the text between non-word characters. Spans
    keep their inner punctuation (``ci/cd``, ``node.js``); a dot before and ``+``, ``++`` or ``#``
    after a span also give the longer form (``.net``, ``c++``, ``c#``). Only the listed lengths
    are built, so one long rule costs one more span per place, not one per length below it.
    """
    none, nowhere = F.array().cast("array<string>"), F.array().cast("array<int>")
    wanted = spans if isinstance(spans, Column) else F.array(*[F.lit(n) for n in spans]).cast("array<int>")

    def build(runs: Column) -> Column:
        # Runs of word and other characters alternate, so words stand at every second place.
        first = F.when(F.try_element_at(runs, F.lit(1)).rlike(rf"^[{word}]"), 1).otherwise(2)
        places = F.when(F.size(runs) >= first, F.sequence(first, F.greatest(F.size(runs), first), F.lit(2))).otherwise(nowhere)
        after = lambda i: F.coalesce(F.get(runs, i), F.lit(""))
        # Few words stand behind a dot or before + and #: their longer forms are made apart, so each span is one join of runs.
        dotted = F.filter(places, lambda i: (i > 1) & F.element_at(runs, F.greatest(i - 1, F.lit(1))).endswith("."))
        closed = F.filter(places, lambda i: after(i).startswith("+") | after(i).startswith("#"))
        return let(F.struct(places.alias("all"), dotted.alias("dotted"), closed.alias("closed")), lambda at: spread_out(runs, first, at))

    def spread_out(runs: Column, first: Column, at: Column) -> Column:
        def of_length(n):
            core = lambda i: F.when(n == 1, F.element_at(runs, i)).otherwise(F.array_join(F.slice(runs, i, 2 * n - 1), ""))
            begin = lambda e: F.greatest(e - (2 * n - 2), F.lit(1))
            starts = lambda listed: F.filter(listed, lambda i: i <= F.size(runs) - (2 * n - 2))
            ends = F.filter(at["closed"], lambda e: e - (2 * n - 2) >= first)

            def tails(e):
                after = F.get(runs, e)
                return F.transform(F.filter(F.array(F.lit("+"), F.lit("++"), F.lit("#")), lambda s: after.startswith(s)), lambda s: F.concat(core(begin(e)), s))

            every = F.slice(at["all"], 1, F.greatest(F.size(at["all"]) - (n - 1), F.lit(0)))
            return F.concat(F.transform(every, core), F.transform(starts(at["dotted"]), lambda i: F.concat(F.lit("."), core(i))), F.flatten(F.transform(ends, tails)))

        return F.coalesce(F.flatten(F.transform(wanted, of_length)), none)

    return let(picks(F.lower(squeeze(text)), rf"[{word}]+|[^{word}]+", 0), build)


def dictionary_hits(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, category, n): dictionary terms that occur as whole words, with counts.

    Work is linear in the text whatever the size of the dictionary: only spans of lengths that terms
    have are built, and only those that may be terms leave the scan. The dictionary is joined without
    a hint, and hot spans of a shuffle join are split at run time.
    """
    rules = terms.select(F.lower(squeeze("term")).alias("term"), "category").distinct()
    scan = spread(docs, key, text).select(key, c(text).alias("_text"), lengths(rules, "term", "[^a-z0-9_]+").alias("_lengths"))
    hits = scan.select(key, F.explode_outer(grams("_text", F.col("_lengths"))).alias("term")).where("term is not null")
    return lookup_join(hits, rules, ["term"]).groupBy(key, "term", "category").agg(big(F.count("*")).alias("n"))


def token_set(text: str | Column) -> Column:
    """Distinct tokens of a text with singular, plural and hyphen variants."""
    cleaned = F.transform(F.split(F.lower(c(text)), r"[ \t\r\n]+"), lambda w: sub(w, r"[^a-z0-9\-+#]"))
    return let(F.array_distinct(F.filter(cleaned, lambda w: F.length(w) >= 2)), _with_variants)


def _with_variants(tokens: Column) -> Column:
    singular = F.transform(F.filter(tokens, lambda t: t.endswith("s") & (F.length(t) > 3)), lambda t: t.substr(F.lit(1), F.length(t) - 1))
    plural = F.transform(F.filter(tokens, lambda t: ~t.endswith("s") & (F.length(t) > 2)), lambda t: F.concat(t, F.lit("s")))
    spaced = F.transform(F.filter(tokens, lambda t: t.contains("-")), lambda t: F.replace(t, F.lit("-"), F.lit(" ")))
    return F.array_distinct(F.concat(tokens, singular, plural, spaced))


def phrase_hits(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, phrase): phrases contained in the text whose every word is in the document's token set.

    A phrase of three words and more holds its second word between two blanks, behind a word that ends with its first
    and before one that begins with its third: documents meet such phrases by an equi-join on that word and its
    neighbours' nearest letters, and few candidates are no hits. Shorter phrases meet documents by their longest word.
    A document's candidates are packed first, so its text comes to them once and its tokens are found once; the text
    is searched before the tokens are.
    """
    rules = phrases.select(F.lower("phrase").alias("phrase")).distinct().withColumn("_w", pieces("phrase", r"[ \t]+")).withColumn("_s", F.split("phrase", " "))
    first, third = F.coalesce(F.get("_s", F.lit(0)), F.lit("")), F.coalesce(F.get("_s", F.lit(2)), F.lit(""))
    inner = (first != "") & (third != "")
    placed = rules.where(inner).select("phrase", "_w", first.alias("_first"), third.alias("_third"), F.get("_s", F.lit(1)).alias("_b"), F.right(first, F.lit(1)).alias("_l"), F.left(third, F.lit(1)).alias("_r"))
    scan = spread(docs, key, text)
    threes = let(F.split(F.lower(c(text)), " "), lambda t: F.transform(F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0))), lambda b, i: F.struct(F.get(t, i).alias("_a"), b.alias("_b"), F.get(t, i + 2).alias("_c"))))
    spots = scan.select(key, F.inline_outer(threes)).where("_b is not null").withColumn("_l", F.right("_a", F.lit(1))).withColumn("_r", F.left("_c", F.lit(1)))
    near = lookup_join(spots, placed, ["_b", "_l", "_r"]).where(F.col("_a").endswith(F.col("_first")) & F.col("_c").startswith(F.col("_third"))).select(key, "phrase", "_w")
    short = rules.where(~inner).select("phrase", "_w", F.expr("array_max(transform(_w, w -> struct(length(w) as n, w as w))).w").alias("_anchor"))
    # Without a short phrase no token set is built here.
    tokens = scan.where(short.agg(F.count("*") > 0).scalar()).select(key, F.explode_outer(token_set(text)).alias("_anchor")).where("_anchor is not null")
    found = near.unionByName(lookup_join(tokens, short, ["_anchor"]).select(key, "phrase", "_w"))
    packed = found.groupBy(key).agg(F.collect_set(F.struct("phrase", "_w")).alias("_p"))
    held = packed.join(docs.select(key, c(text).alias("_text")), key)
    named = held.select(key, "_text", let(F.lower("_text"), lambda t: F.filter("_p", lambda p: t.contains(p["phrase"]))).alias("_p")).where(F.size("_p") > 0)
    kept = let(token_set("_text"), lambda ts: F.filter("_p", lambda p: F.size(F.array_except(p["_w"], ts)) == 0))
    return named.select(key, F.explode(kept).alias("_one")).select(key, "_one.phrase").distinct()


# ---------------------------------------------------------------- glued tokens

def known_spans(low: str, by_length: dict[int, frozenset[str]]) -> list[tuple[int, int]]:
    """Places of known words in a lower-cased token, no two overlapping, the longer ones first."""
    taken, found = [False] * len(low), []
    for n in sorted(by_length, reverse=True):
        for start in range(len(low) - n + 1):
            if low[start : start + n] in by_length[n] and not any(taken[start : start + n]):
                taken[start : start + n] = [True] * n
                found.append((start, start + n))
    return found


def words_by_length(vocabulary: Sequence[str]) -> dict[int, frozenset[str]]:
    """Lower-cased words of at least three characters, by their length."""
    words = {v.lower() for v in vocabulary if len(v) >= 3}
    return {n: frozenset(w for w in words if len(w) == n) for n in {len(w) for w in words}}


def split_glued(token: str, vocabulary: Sequence[str] | dict[int, frozenset[str]], noise: frozenset[str]) -> list[str]:
    """One glued token into known words, longest first, then what stands between them; itself when nothing is left."""
    low = token.lower()
    spans = known_spans(low, vocabulary if isinstance(vocabulary, dict) else words_by_length(vocabulary))
    edges = [0, *(x for span in sorted(spans) for x in span), len(low)]
    between = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in re.split(r"[., \t\r\n]+", low[a:b])]
    parts = [low[a:b] for a, b in spans] + [w for w in between if len(w) >= 3 and w not in noise]
    return list(dict.fromkeys(parts)) or [token]


def decluster(docs: DataFrame, vocabulary: Sequence[str], key: str = "doc_id", text: str = "text",
              noise: Sequence[str] = tuple(R.NOISE_WORDS)) -> DataFrame:
    """(key, pos, token, part, ord): glued tokens of at least 15 characters and the words they hold.

    Tokens that are not glued do not appear; callers keep them as they are. The splitter runs in
    Arrow batches over *distinct* long tokens only. ``vocabulary`` is a bounded word list.
    """
    by_length, quiet = words_by_length(vocabulary), frozenset(noise)
    lengths = sorted(n for n in by_length if n >= 4)
    long_tokens = docs.select(key, F.posexplode(F.split(c(text), r"[ \t\r\n]+")).alias("pos", "token")).where(F.length("token") >= 15)
    distinct = long_tokens.select("token").distinct()

    def split_batches(batches):
        dotted, camel = re.compile(r"[a-z]{4,}\.[a-z]{4,}", re.I), re.compile(r"[a-z]{3,}[A-Z][a-z]{3,}")
        for batch in batches:
            rows = []
            for token in batch["token"]:
                low = token.lower()
                held = {low[i : i + n] for n in lengths for i in range(len(low) - n + 1) if low[i : i + n] in by_length[n]}
                if len(held) >= 2 or dotted.search(token) or camel.search(token):
                    rows += [(token, part, i + 1) for i, part in enumerate(split_glued(token, by_length, quiet))]
            yield pd.DataFrame(rows, columns=["token", "part", "ord"])

    parts = distinct.mapInPandas(split_batches, "token string, part string, ord long")
    return long_tokens.join(parts, "token").select(key, big("pos").alias("pos"), "token", "part", "ord")


# ---------------------------------------------------------------- scoring

def _section_weight(text: Column, sections) -> Column:
    out = F.lit(None).cast("double")
    for name, weight in reversed(list(sections)):
        out = F.when(text.contains(name), F.lit(float(weight))).otherwise(out)
    return out


def score_terms(docs: DataFrame, categories: DataFrame, key: str = "doc_id", text: str = "text", learned: DataFrame | None = None,
                noise: Sequence[str] = tuple(R.NOISE_WORDS), sections=tuple(R.SECTION_WEIGHTS),
                boosts=tuple(R.CATEGORY_BOOST.items())) -> DataFrame:
    """(key, term, freq, pos, score): log10(1+freq) × section × product of category boosts × learned boost.

    Section: the first listed heading the document names, else 1.2 for terms that first appear
    between 20 % and 70 % of the text, else 1. ``categories`` has (term, category), ``learned``
    (term, frequency).
    """
    raw = F.split(c(text), r"[ \t\r\n]+")
    clean = F.transform(raw, lambda w: F.lower(sub(w, r"[^a-zA-Z0-9\-+#.]")))
    good = lambda t: (F.length(t).between(3, 35) & t.rlike(r"^[a-z][a-z0-9\-+#.]*$") & ~t.contains(".") & outside(t, noise))
    # Counted inside the row; what is joined to the boosts holds no text.
    rows = spread(docs, key, text).select(key, F.size(raw).alias("_n"), _section_weight(F.lower(c(text)), sections).alias("_s"), term_runs(placed_terms(clean, good)).alias("_t"))
    counts = rows.select(key, "_n", "_s", F.inline_outer("_t")).where("term is not null")
    factor = F.coalesce(F.try_element_at(literal_map(dict(boosts)), F.col("category")), F.lit(1.0))
    boost = categories.select(F.lower("term").alias("term"), "category").distinct().groupBy("term").agg(
        F.exp(F.sum(F.ln(factor))).alias("_boost"))
    out = lookup_join(counts, boost, ["term"], "left")
    if learned is not None:
        lift = learned.select(F.lower("term").alias("term"), F.least(F.lit(2.0), 1 + 0.1 * F.col("frequency")).alias("_lift"))
        out = lookup_join(out, lift, ["term"], "left")
    else:
        out = out.withColumn("_lift", F.lit(1.0))
    share = F.col("pos") / F.col("_n")
    section = F.coalesce("_s", F.when((share > 0.2) & (share < 0.7), 1.2).otherwise(1.0))
    score = F.log10(1 + F.col("freq")) * section * F.coalesce("_boost", F.lit(1.0)) * F.coalesce("_lift", F.lit(1.0))
    return out.select(key, "term", "freq", "pos", F.round(score, 6).alias("score"))


def band_terms(scored: DataFrame, key: str = "doc_id", k: int = 35, high: float = 0.45, medium: float = 0.35,
               high_cap: int = 15, medium_cap: int = 10) -> DataFrame:
    """(key, term, score, rank, priority): best ``k`` per document, ties by first appearance."""
    top = ranked(scored, key, [F.desc("score"), F.col("pos"), F.col("term")], k)
    total = F.count("*").over(Window.partitionBy(key))
    return top.select(key, "term", "score", "rank", band(F.col("rank"), total, high, medium, high_cap, medium_cap).alias("priority"))


#: 5 to this power is still a finite double with room for the factor.
MOST_HITS = 300


def tech_weight(n: Column) -> Column:
    """Weight after n hits when every hit adds one and multiplies the total by 5: 5(5^n − 1)/4.

    A double holds it for up to ``MOST_HITS`` hits; more weigh as much, and ties go by count.
    """
    return 5 * (F.pow(F.lit(5.0), F.least(n, F.lit(MOST_HITS))) - 1) / 4


def tech_terms(docs: DataFrame, tech: Sequence[str], phrases: Sequence[str], key: str = "doc_id", text: str = "text", k: int = 50,
               stop: Sequence[str] = tuple(R.STOP_WORDS)) -> DataFrame:
    """(key, term, weight, rank, priority): technical words dominate, known phrases count 10, words of 4 letters or fewer drop out unless technical."""
    is_tech = lambda t: t.isin(list(tech))
    tokens = pieces(F.lower(c(text)), r"[^a-z0-9\-/.#+]+")
    keep = lambda t: (F.length(t) >= 2) & outside(t, stop) & (is_tech(t) | (F.length(t) > 4))
    counted = term_runs(placed_terms(tokens, keep))
    listed = F.transform(word_array(phrases), lambda p, i: F.struct(p.alias("term"), i.alias("i")))
    named = let(F.lower(c(text)), lambda body: F.filter(listed, lambda s: body.contains(s["term"])))

    def weighed(both):
        """Counted tokens and named phrases as one list; a phrase that is a token too is one entry."""
        runs, found = both["runs"], both["named"]
        is_named = lambda t: F.exists(found, lambda s: s["term"] == t)
        alone = F.filter(found, lambda s: ~F.exists(runs, lambda r: r["term"] == s["term"]))
        return F.concat(
            F.transform(runs, lambda r: F.struct(r["term"].alias("term"), r["freq"].alias("_n"), is_named(r["term"]).cast("int").alias("_p"), r["pos"].alias("pos"))),
            F.transform(alone, lambda s: F.struct(s["term"].alias("term"), F.lit(0).cast("bigint").alias("_n"), F.lit(1).alias("_p"), big(F.lit(1 << 40) + s["i"]).alias("pos"))))

    counts = spread(docs, key, text).select(key, F.inline_outer(let(F.struct(counted.alias("runs"), named.alias("named")), weighed))).where("term is not null")
    weight = F.when(is_tech(F.col("term")) & (F.col("_n") > 0), tech_weight(F.col("_n"))).otherwise(F.col("_n").cast("double")) + 10 * F.col("_p")
    top = ranked(counts.withColumn("weight", weight), key, [F.desc("weight"), F.desc("_n"), F.col("pos")], k)
    total = F.count("*").over(Window.partitionBy(key))
    return top.select(key, "term", "weight", "rank", band(F.col("rank"), total, 0.40, 0.35, 20, 15).alias("priority"))


# ---------------------------------------------------------------- merging and classes

def merge_terms(mandatory: DataFrame, extracted: DataFrame, key: str = "doc_id", cap: int = 50, new_cap: int = 20, high_cap: int = 25) -> DataFrame:
    """(key, term, ord, priority): mandatory terms first, then the extracted ones, one row per spelling.

    ``mandatory``: key, term, ord. ``extracted``: key, term, rank, priority. High are up to
    ``new_cap`` mandatory terms the extraction missed and then its own high terms, ``high_cap``
    in all; mandatory terms found by both keep the extraction's band.
    """
    both = mandatory.select(key, "term", F.lit(0).alias("_src"), F.col("ord").alias("_ord"), F.lit(None).cast("string").alias("_band")).unionByName(
        extracted.select(key, "term", F.lit(1).alias("_src"), F.col("rank").alias("_ord"), F.col("priority").alias("_band")))
    one = both.groupBy(key, F.lower("term").alias("_k")).agg(
        F.min(F.struct("_src", "_ord", "term")).alias("_f"), F.max("_band").alias("_band")).select(key, "_f.*", "_band")
    merged = ranked(one, key, [F.col("_src"), F.col("_ord"), F.col("term")], cap).withColumnRenamed("rank", "ord")
    w = Window.partitionBy(key).orderBy("ord")
    fresh = (F.col("_src") == 0) & F.col("_band").isNull()
    nth_new = F.sum(fresh.cast("int")).over(w)
    lifted = F.when(fresh, nth_new <= new_cap).otherwise(F.col("_band") == "high")
    work = merged.withColumn("_high", lifted).withColumn("_fresh", fresh)
    nth_high = F.row_number().over(Window.partitionBy(key, "_high").orderBy(F.desc("_fresh"), "ord"))
    return work.withColumn("priority", F.when(F.col("_high") & (nth_high <= high_cap), "high").otherwise(
        F.coalesce(F.when(F.col("_band") != "high", F.col("_band")), F.lit("medium")))).select(key, "term", "ord", "priority")


def classify_roi(docs: DataFrame, tiers=tuple((t, tuple(w)) for t, w in R.ROI_TIERS), key: str = "doc_id", text: str = "text",
                 open_hard: DataFrame | None = None, open_soft: DataFrame | None = None, loose: int = 15, cap: int = 50,
                 stop: Sequence[str] = tuple(R.ROI_STOP_WORDS)) -> DataFrame:
    """(key, term, tier, ord): tier terms in list order, openly found skills behind them, then loose words; high, medium, unclassified, low.

    ``open_hard`` and ``open_soft`` (key, term, rank) join high and low unless already there.
    """
    body = spread(docs, key, text).where(F.length(c(text)) >= 50)
    listed = [(term, tier, i) for tier, terms in tiers for i, term in enumerate(terms)]
    one = lambda term, tier, ord_: F.struct(term.alias("term"), tier.alias("tier"), big(ord_).alias("ord"), F.lit(0).alias("_src"))
    named = F.array(*[one(F.lit(term), F.lit(tier), F.lit(i)) for term, tier, i in listed])
    sizes = sorted({len(re.split("[^a-z0-9]+", term.lower())) for term, _, _ in listed})
    tier_rank = literal_map({"high": 0, "medium": 1, "unclassified": 2, "low": 3})
    found = F.array_distinct(F.filter(grams(text, sizes, "a-z0-9"), lambda g: g.isin([term for term, _, _ in listed])))
    loose_words = words(sub(F.lower(c(text)), r"[^a-z0-9\-/]+", " "))
    runs = term_runs(placed_terms(loose_words, lambda t: (F.length(t) >= 3) & outside(t, stop)))

    def both(held):
        rest = first_terms(F.filter(runs, lambda r: ~F.array_contains(held, r["term"])), loose)
        return F.concat(F.filter(named, lambda s: F.array_contains(held, s["term"])), F.transform(rest, lambda r, i: one(r["term"], F.lit("unclassified"), i + 1)))

    # Found and counted in one reading, inside the row; the outer form, as a plain one would be read once more for its size.
    rows = body.select(key, F.inline_outer(let(found, both))).where("term is not null")
    for extra, tier in ((open_hard, "high"), (open_soft, "low")):
        if extra is not None:
            rows = rows.unionByName(extra.select(key, "term", F.lit(tier).alias("tier"), F.col("rank").alias("ord"), F.lit(1).alias("_src")))
    norm = squeeze(sub(F.lower("term"), r"[^a-z0-9/+#]+", " "))
    rows = rows.withColumn("_k", norm).where("_k <> ''")
    firsts = rows.groupBy(key, "_k", "tier").agg(F.min(F.struct("_src", "ord", "term")).alias("_f")).select(key, "_k", "tier", "_f.*")
    claimed = F.max(F.col("tier").isin("high", "low").cast("int")).over(Window.partitionBy(key, "_k"))
    firsts = firsts.withColumn("_claimed", claimed).where((F.col("tier") != "unclassified") | (F.col("_claimed") == 0))
    order = [F.element_at(tier_rank, F.col("tier")), F.col("_src"), F.col("ord"), F.col("term")]
    return ranked(firsts, key, order, cap).select(
        key, "term", "tier", F.col("rank").alias("ord"))


def allocate(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section, term, ord): summary gets 3 high terms, experience 85 % of all, skills 20 high terms."""
    w = Window.partitionBy(key)
    nth_high = F.sum((F.col("tier") == "high").cast("int")).over(w.orderBy("ord"))
    work = terms.withColumn("_n", F.count("*").over(w)).withColumn("_h", nth_high)
    is_high = F.col("tier") == "high"
    homes = F.filter(F.array(
        F.when(is_high & (F.col("_h") <= 3), F.lit("summary")),
        F.when(F.col("ord") <= F.ceil(F.col("_n") * F.lit(0.85)), F.lit("experience")),
        F.when(is_high & (F.col("_h") <= 20), F.lit("skills"))), lambda s: s.isNotNull())
    return work.select(key, F.explode(homes).alias("section"), "term", "ord")


# ---------------------------------------------------------------- open extraction

def skill_norm(col: str | Column) -> Column:
    return squeeze(sub_all(F.lower(c(col)), [("[‐-―]", "-"), (r"[^a-z0-9/+#.\- ]+", " "), ("-", " ")]))


def _phrase_ok(ws: Column, edge: Sequence[str]) -> Column:
    return (F.size(ws).between(1, 4) & outside(F.try_element_at(ws, F.lit(1)), edge) & outside(F.try_element_at(ws, F.lit(-1)), edge)
            & ~F.exists(ws, lambda w: (F.length(w) < 2) & ~w.rlike("^[0-9]$")))


def hard_skills(docs: DataFrame, key: str = "doc_id", text: str = "text", heads: Sequence[str] = tuple(R.SKILL_HEADS),
                boundary: Sequence[str] = tuple(R.BOUNDARY_WORDS), edge: Sequence[str] = tuple(R.EDGE_WORDS),
                standalone: Sequence[str] = tuple(R.STANDALONE_HEADS), soft: DataFrame | None = None, limit: int | None = 40) -> DataFrame:
    """(key, skill, display, score, rank): skills named by a cue (6), by shape (5) or ending in a head noun (3 + words).

    Each mention of a skill adds up; up to three repeats add half a point. Soft skills (key,
    skill) are removed, and a phrase that extends a shorter candidate of two or more words to the
    right is dropped. The ``limit`` best stay, or all if it is None. Candidates are built and counted inside the row; only
    narrow rows are shuffled.
    """
    none = F.array().cast("array<struct<raw:string,weight:int>>")

    def tagged(arr, weight):
        return F.transform(arr, lambda x: F.struct(x.alias("raw"), F.lit(weight).alias("weight")))

    body = c(text)
    spans = F.flatten(F.transform(picks(body, R.SKILL_CUE), lambda s: pieces(
        F.regexp_replace(s, r"(?i)(?<![A-Za-z0-9_])(?:such as|including|e\.?g\.?|i\.?e\.?)(?![A-Za-z0-9_])", ","),
        r"(?i)[ \t]*(?:,|;|/(?=[ \t])| and | or )[ \t]*")))
    cands = tagged(F.filter(F.transform(spans, lambda s: F.trim(s)), lambda s: s != ""), 6)
    for shape in R.SKILL_SHAPES:
        cands = F.concat(cands, tagged(picks(body, shape), 5))
    segments = F.split(body, r"(?i)[.;:\n()]|,| and | or ")
    stop = sorted(set(boundary) | set(edge))

    def from_segment(seg):
        return let(pieces(skill_norm(seg), " "), from_words)

    def from_words(ws):
        def at(i):  # i is 1-based
            def free(back):
                prev = F.when(i > back, F.try_element_at(ws, i - back))
                return F.coalesce(outside(prev, stop), F.lit(False))
            reach = F.when(~free(1), 0).when(~free(2), 1).when(~free(3), 2).otherwise(3)
            part = F.slice(ws, i - reach, reach + 1)
            return F.struct(F.array_join(part, " ").alias("raw"), F.when(reach == 0, 3).otherwise(4 + reach).alias("weight"), reach.alias("reach"))

        at_heads = F.filter(F.when(F.size(ws) > 0, F.sequence(F.lit(1), F.size(ws))).otherwise(F.array().cast("array<int>")),
                            lambda i: F.element_at(ws, i).isin(list(heads)))
        made = F.filter(F.transform(at_heads, at), lambda s: (s["reach"] > 0) | s["raw"].isin(list(standalone)))
        return F.transform(made, lambda s: F.struct(s["raw"].alias("raw"), s["weight"].alias("weight")))

    cands = F.concat(cands, F.coalesce(F.flatten(F.transform(segments, from_segment)), none))
    # Doubled blanks let neighbouring mentions share an edge while counting by replacement.
    hay = F.concat(F.lit(" "), F.replace(skill_norm(body), F.lit(" "), F.lit("  ")), F.lit(" "))
    def padded(k):
        return F.concat(F.lit(" "), F.replace(k, F.lit(" "), F.lit("  ")), F.lit(" "))

    def mentions(h, k):
        return let(padded(k), lambda n: (F.length(h) - F.length(F.replace(h, n))) / F.length(n))

    def named(x):
        return let(skill_norm(x["raw"]), lambda k: F.struct(k.alias("skill"), F.trim(x["raw"]).alias("display"), x["weight"].alias("weight")))

    def good(x):
        return _phrase_ok(pieces(x["skill"], " "), edge) & outside(x["skill"], R.NOT_A_SKILL) & (x["skill"] != "")

    def counted(h, kept):
        # A skill is sought in the text once, for its first candidate, and refused candidates are not sought at all.
        def one(x, i, skills):
            return F.struct(x["skill"].alias("skill"), x["display"].alias("display"), x["weight"].alias("weight"), F.when(F.array_position(skills, x["skill"]) == i + 1, mentions(h, x["skill"])).alias("_count"))
        return let(F.transform(kept, lambda x: x["skill"]), lambda skills: F.transform(kept, lambda x, i: one(x, i, skills)))

    # Counted inside the row: what is exploded, and shuffled later, holds no text.
    made = let(F.filter(F.transform(cands, named), good), lambda kept: let(hay, lambda h: counted(h, kept)))
    rows = spread(docs, key, text).select(key, F.inline_outer(made)).where("skill is not null")
    grouped = rows.groupBy(key, "skill").agg(
        F.sum("weight").alias("_w"), F.min(F.struct(F.length("display"), "display"))["display"].alias("display"), F.max("_count").alias("_count"))
    grouped = grouped.withColumn("score", F.col("_w") + F.least(F.col("_count"), F.lit(3.0)) * 0.5)
    keys = F.collect_set("skill").over(Window.partitionBy(key))
    ws = F.split("skill", " ")
    prefixes = F.when(F.size(ws) > 2, F.transform(F.sequence(F.lit(2), F.size(ws) - 1), lambda n: F.array_join(F.slice(ws, F.lit(1), n), " "))).otherwise(
        F.array().cast("array<string>"))
    kept = grouped.withColumn("_keys", keys).where(~F.arrays_overlap(prefixes, "_keys"))
    if soft is not None:
        kept = kept.join(soft.select(key, skill_norm("skill").alias("skill")), [key, "skill"], "left_anti")
    return ranked(kept, key, [F.desc("score"), F.length("skill"), F.col("skill")], limit).select(key, "skill", "display", "score", "rank")


def soft_variants(terms: Sequence[str]) -> list[tuple[str, str, int]]:
    """(term, form, ord): spellings a text may use for each soft skill."""
    rows = []
    for term in terms:
        t = " ".join("".join(ch if ch.isalnum() or ch in "/+#." else " " for ch in term.lower()).split())
        forms = [t, f"{t} skills", f"{t}s"]
        for tail in ("ion", "e", "y"):
            if t.endswith(tail):
                forms.append(t[: -len(tail)] + "ing")
                break
        if t.endswith("ion"):
            forms.append(t + "al")
        rows += [(term, form, i) for i, form in enumerate(dict.fromkeys(forms))]
    return rows


def soft_skills(docs: DataFrame, terms: Sequence[str] = tuple(R.SOFT_SKILLS), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, skill, matched_form): soft skills by any of their forms; "X skills" is reported when the text says so."""
    forms = soft_variants(terms)
    rules = docs.sparkSession.createDataFrame(forms, "term string, form string, ord long")
    known = [form for _, form, _ in forms]
    sizes, firsts = sorted({len(form.split()) for form in known}), sorted({form.split()[0] for form in known if form.split()})

    def held_forms(ws):  # spans are built where a form's first word stands only, and only forms leave the row
        places = F.filter(F.when(F.size(ws) > 0, F.sequence(F.lit(1), F.size(ws))).otherwise(F.array().cast("array<int>")), lambda i: F.element_at(ws, i).isin(firsts))
        spans = F.transform(places, lambda i: F.array(*[F.array_join(F.slice(ws, i, F.lit(n)), " ") for n in sizes]))
        return F.array_distinct(F.filter(F.flatten(spans), lambda g: g.isin(known)))

    spans = let(pieces(skill_norm(text), " "), held_forms)
    hit = spread(docs, key, text).select(key, F.explode_outer(spans).alias("form")).where("form is not null").join(rules, "form")
    named = F.max((F.col("form") == F.concat("_base", F.lit(" skills"))).cast("int"))
    return hit.withColumn("_base", skill_norm("term")).groupBy(key, "term").agg(
        F.min_by("form", "ord").alias("matched_form"), named.alias("_s")).select(
        key, F.when(F.col("_s") == 1, F.concat("term", F.lit(" skills"))).otherwise(F.col("term")).alias("skill"), "matched_form")


# ---------------------------------------------------------------- categories, learning, cleaning

def categorise(terms: DataFrame, categories: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """Distinct terms with the sorted array of all their categories."""
    rules = categories.select(F.lower("term").alias("_k"), "category")
    if learned is not None:
        rules = rules.unionByName(learned.select(F.lower("term").alias("_k"), F.explode("categories").alias("category")))
    one = terms.select("term").distinct().withColumn("_k", F.replace(F.lower("term"), F.lit("-"), F.lit(" ")))
    return lookup_join(one, rules.distinct(), ["_k"], "left").groupBy("term").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def category_counts(terms: DataFrame, categories: DataFrame, names: Sequence[str], key: str = "doc_id") -> DataFrame:
    """One column per category with the number of the document's terms in it."""
    rows = lookup_join(terms.withColumn("_k", F.lower("term")), categories.select(F.lower("term").alias("_k"), "category").distinct(), ["_k"])
    return rows.groupBy(key).pivot("category", list(names)).agg(big(F.count("*"))).na.fill(0)


def learn(banded: DataFrame, categories: DataFrame, seen_at: Column, top: int = 20, keep: int = 500, noise: Sequence[str] = tuple(R.NOISE_WORDS)) -> DataFrame:
    """(term, frequency, last_seen, categories, boost): what the best terms of each document teach; ``keep`` most frequent stay."""
    best = banded.where((F.col("rank") <= top) & F.length("term").between(3, 35) & outside(F.col("term"), noise))
    counts = best.groupBy("term").agg(big(F.count("*")).alias("frequency"), F.max(seen_at).alias("last_seen"))
    kept = counts.orderBy(F.desc("frequency"), "term").limit(keep)
    rules = categories.select(F.lower("term").alias("term"), "category").distinct()
    return kept.join(rules, "term", "left").groupBy("term", "frequency", "last_seen").agg(
        F.array_sort(F.collect_set("category")).alias("categories")).withColumn("boost", F.least(F.lit(2.0), 1 + F.col("frequency") * 0.1))


def clean_terms(terms: DataFrame, key: str = "doc_id", ord: str = "rank", junk: Sequence[str] = tuple(R.JUNK_WORDS),
                patterns: Sequence[str] = tuple(R.JUNK_PATTERNS)) -> DataFrame:
    """(key, term, ord): terms that are skills rather than grammar, first spelling kept, order kept."""
    low = F.lower(F.trim("term"))
    single = ~low.contains(" ")
    bad = single & (low.isin(list(junk)) | ((F.length(low) < 3) & outside(low, R.SHORT_SKILLS)))
    for pattern in patterns:
        bad = bad | low.rlike(pattern)
    kept = terms.where(~bad).groupBy(key, low.alias("_k")).agg(F.min(F.struct(F.col(ord).alias("o"), F.trim("term").alias("t"))).alias("_f"))
    return kept.select(key, F.col("_f.t").alias("term"), F.col("_f.o").alias("ord"))


def acronym_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, short, long): ``Long Form (LF)`` where the letters of LF are a subsequence of the phrase's initials; the shortest such tail."""
    pattern = r"((?:^|[^A-Za-z0-9_])[A-Z][A-Za-z&-]*(?:[ -][A-Za-z&-]+){0,5}[ \t]*\([ \t]*[A-Z]{2,7}[ \t]*\))"
    raw = docs.where(F.col(text).contains("(")).select(key, F.explode(picks(text, pattern)).alias("_m"))
    work = raw.select(key, F.regexp_extract("_m", r"([A-Z]{2,7})[ \t]*\)$", 1).alias("short"),
                      F.trim(F.regexp_extract("_m", r"^[^A-Za-z]?([^(]*)\(", 1)).alias("_raw"))
    tokens = pieces("_raw", "[ -]+")
    work = work.withColumn("_w", tokens).where(F.size("_w") >= 2)
    lengths = F.sequence(F.lit(2), F.size("_w"))
    tails = F.transform(lengths, lambda n: F.slice("_w", -n, n))
    initials = F.expr("regexp_replace(short, '([A-Z])', '$1.*')")
    made = F.transform(tails, lambda t: F.struct(F.size(t).alias("n"), F.array_join(F.transform(t, lambda w: F.upper(F.substring(w, 1, 1))), "").alias("init")))
    work = work.withColumn("_p", F.concat(F.lit("^"), initials)).withColumn("_t", made)
    work = work.withColumn("_n", F.expr("try_element_at(filter(_t, t -> t.init rlike _p), 1).n")).where("_n is not null")
    long = F.expr("regexp_extract(_raw, concat('((?:[^ -]+[ -]+){', _n - 1, '}[^ -]+)$'), 1)")
    return work.select(key, "short", long.alias("long")).distinct()


def acronym_dictionary(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(short, long, docs): the most frequent long form of each acronym."""
    counts = pairs.groupBy("short", "long").agg(big(F.countDistinct(key)).alias("docs"))
    return counts.groupBy("short").agg(F.max_by("long", F.struct("docs", "long")).alias("long"), F.max("docs").alias("docs"))


def term_df(terms: DataFrame, key: str = "doc_id", top: tuple[int, int, int] = (20, 15, 10)) -> DataFrame:
    """(term, docs, pct, band, rank): share of postings holding each term; common from 70 %, frequent from 40 %, else rare.

    Each band keeps its ``top`` terms, which is the report's definition. Fewer than two postings give no rows.
    """
    pairs = terms.select(key, F.lower("term").alias("term")).distinct()
    counts = pairs.groupBy("term").agg(big(F.count("*")).alias("docs"))
    total = terms.agg(F.countDistinct(key)).scalar()
    ratio = F.col("docs") / F.col("_n")
    rows = counts.withColumn("_n", total).where("_n >= 2").withColumn("pct", half_up(ratio * 100)).withColumn(
        "band", F.when(ratio >= 0.7, "common").when(ratio >= 0.4, "frequent").otherwise("rare"))
    w = Window.partitionBy("band").orderBy(F.desc("docs"), "term")
    rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(top))
    cap = F.when(F.col("band") == "common", top[0]).when(F.col("band") == "frequent", top[1]).otherwise(top[2])
    return rows.where(F.col("rank") <= cap).select("term", "docs", "pct", "band", big("rank").alias("rank"))


def term_jobs(report: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, key): the postings behind each reported term, as rows rather than one growing array."""
    pairs = terms.select(key, F.lower("term").alias("term")).distinct()
    return lookup_join(pairs, report.select("term"), ["term"]).select("term", key)
