"""Compositions of operators that answer one larger question each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from postlens.operators import matching, people, postings, quality, records, terms


def processed_postings(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, structure): page text, boilerplate out, white space normal, structure named."""
    text = postings.pages_to_text(pages)
    text = postings.normalise_text(postings.strip_boilerplate(text)).drop("was_cut", "removed_chars")
    return postings.classify_structure(text)


def merged_terms(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """Dictionary terms first, scored terms behind, with priorities."""
    hits = terms.dictionary_hits(docs, dictionary, key).groupBy(key, "term").agg({"n": "sum"}).withColumnRenamed("sum(n)", "ord")
    banded = terms.band_terms(terms.score_terms(docs, dictionary, key), key)
    return terms.merge_terms(hits, banded.select(key, "term", "rank", "priority"), key)


def tailoring_plan(postings_df: DataFrame, pairs: DataFrame, cvs: DataFrame, keys: Sequence[str] = ("item_id", "doc_id")) -> dict[str, DataFrame]:
    """Qualification rows, pair summaries, recommendations, gap terms and focus for given pairs."""
    quals = matching.qualifications(postings_df, posting=keys[0])
    rows = matching.match_quals(quals, pairs, cvs, keys[0], keys[1])
    return {"rows": rows, "summary": matching.match_summary(rows, keys), "recommendations": matching.recommend(rows, keys),
            "gap_terms": matching.gap_terms(rows, keys), "verdicts": matching.verdicts(rows, keys)}


def structured_cvs(docs: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Contact, roles, education, skills of CV texts."""
    return {"contact": records.contact_fields(docs, key), "roles": records.roles(docs, key), "education": records.education(docs, key), "skills": records.skills(docs, key)}


def audited(docs: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """The line-based audits over one line table."""
    lines = quality.line_table(docs, key)
    return {"openers": quality.opener_flags(lines, key), "repetition": quality.repetition(lines, key), "metrics": quality.metrics(lines, key),
            "language": quality.language_flags(lines, key), "format": quality.format_flags(docs, key), "prose": quality.prose_score(docs, key)}


def posting_contacts(pages: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Best published addresses of each page, masked."""
    return people.rank_addresses(people.published_addresses(pages), own=own)
