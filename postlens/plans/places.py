"""Queries over location strings derived from customers, suppliers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import places as H
from postlens.plans import sql as S
from postlens.plans.postings import SQL_PLACE, place_name
from postlens.plans.sources import SQL_CODE, country_rows
from postlens.rules import records as R
from postlens.sources import landing as L
from postlens.sources.tables import table


def cities(spark, folder):
    """One city per customer key over a few letters: "Xcity" names spread over the nations."""
    c = table(spark, folder, "customer")
    name = F.concat(F.lit("Burg"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    return L.load_cities(c.select(name.alias("name"), F.concat(F.lit("Q"), F.chr(F.col("c_nationkey") + 65)).alias("country")))


def countries(spark, folder):
    return L.load_countries(country_rows(spark, folder))


CITY = "'burg' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij')"


def raws(spark, folder):
    """Location strings in the shapes postings use, one per customer."""
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    city = F.concat(F.lit("Burg"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    nation, code = place_name("n_name"), F.concat(F.lit("Q"), F.chr(F.col("n_nationkey") + 65))
    kind = F.floor(F.col("c_acctbal") / 700)
    raw = (F.when(kind <= 0, F.concat(F.lit("Location: "), city, F.lit(" (Hybrid)"))).when(kind == 1, F.concat(F.lit("Remote - "), city)).when(kind == 2, F.concat(city, F.lit(", "), nation))
           .when(kind == 3, F.concat(nation, F.lit(", "), city)).when(kind == 4, nation).when(kind == 5, F.lit("N/A")).when(kind == 6, F.lit("Latin America")).when(kind == 7, F.concat(city, F.lit(", TX")))
           .when(kind == 8, F.concat(city, F.lit("; Paris"))).when(kind == 9, F.concat(city, F.lit(" am Main, "), code)).when(kind == 10, F.lit("Remote")).when(kind == 11, F.lit("USA"))
           .when(kind == 12, F.concat(city, F.lit(", IL"))).otherwise(F.concat(F.lit("Zz"), city)))
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", raw.alias("raw"))


RAW = f"""g AS (SELECT c_custkey, upper(substr({CITY}, 1, 1)) || substr({CITY}, 2) AS city, {SQL_PLACE} AS nation, {SQL_CODE} AS code, CAST(floor(c_acctbal / 700) AS INT) AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey),
    raws AS (SELECT *, CASE WHEN kind <= 0 THEN 'Location: ' || city || ' (Hybrid)' WHEN kind = 1 THEN 'Remote - ' || city WHEN kind = 2 THEN city || ', ' || nation WHEN kind = 3 THEN nation || ', ' || city WHEN kind = 4 THEN nation
      WHEN kind = 5 THEN 'N/A' WHEN kind = 6 THEN 'Latin America' WHEN kind = 7 THEN city || ', TX' WHEN kind = 8 THEN city || '; Paris' WHEN kind = 9 THEN city || ' am Main, ' || code WHEN kind = 10 THEN 'Remote'
      WHEN kind = 11 THEN 'USA' WHEN kind = 12 THEN city || ', IL' ELSE 'Zz' || city END AS raw FROM g)"""


def h01(spark, folder):
    return H.clean_locations(raws(spark, folder))


def h02(spark, folder):
    return H.place_class(raws(spark, folder))


def h03(spark, folder):
    first = raws(spark, folder).select(F.element_at(F.split("raw", ","), 1).alias("raw"))
    return H.match_city(first, cities(spark, folder))


def _typos(spark, folder):
    n = place_name("n_name")
    c = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    at = (F.col("c_custkey") % 7 + 2).cast("int")
    low = F.lower(n)
    word = F.concat(F.substring(low, F.lit(1), at - 1), F.lit("x"), F.substring(low, at + 1, F.lit(99)))
    return c.select(F.when(F.col("c_acctbal") > 5000, word).otherwise(F.concat(word, F.lit("q"))).alias("token"))


def h04(spark, folder):
    keys = table(spark, folder, "nation").select(F.lower(place_name("n_name")).alias("key"))
    return H.fuzzy_match(_typos(spark, folder), keys, H.city_cutoff())


def h05(spark, folder):
    return H.resolve_country(raws(spark, folder), countries(spark, folder), cities(spark, folder))


def h06(spark, folder):
    return H.canonical_location(raws(spark, folder), countries(spark, folder), cities(spark, folder))


def h07(spark, folder):
    out = H.recognised(raws(spark, folder), countries(spark, folder), cities(spark, folder))
    return out.withColumns({n: F.col(n).cast("string") for n in ("is_us", "is_remote", "is_hybrid")})


def h08(spark, folder):
    c = table(spark, folder, "customer")
    rows = c.select("c_custkey", F.when(F.col("c_mktsegment") == "HOUSEHOLD", "US").when(F.col("c_mktsegment") == "MACHINERY", "BR").alias("posting_iso2"), F.when(F.col("c_acctbal") > 3000, "CA").alias("candidate_iso2"))
    return H.region_profile(rows)


def h09(spark, folder):
    return H.places_dim(country_rows(spark, folder))


QUERIES = {"h1_clean_locations": h01, "h2_place_class": h02, "h3_match_city": h03, "h4_fuzzy_match": h04, "h5_resolve_country": h05, "h6_canonical_location": h06, "h7_recognised": h07, "h8_region_profile": h08, "h9_places_dim": h09}

ORACLES = {
    "h1_clean_locations": f"""WITH {RAW} SELECT DISTINCT raw, CASE WHEN kind <= 1 THEN city WHEN kind = 8 THEN city WHEN kind = 10 THEN '' ELSE raw END AS cleaned FROM raws""",
    "h2_place_class": f"""WITH {RAW} SELECT c_custkey, raw, CASE WHEN kind IN (5, 10) THEN 'not_a_place' WHEN kind = 6 THEN 'region' ELSE 'place' END AS class FROM raws""",
    "h3_match_city": f"""WITH {RAW}, f AS (SELECT DISTINCT string_split(raw, ',')[1] AS raw, city, code, kind FROM raws)
        SELECT raw, lower(city) AS city, code AS iso2, CASE WHEN kind = 9 THEN 'shortened' ELSE 'exact' END AS via FROM f WHERE kind IN (2, 7, 9, 12)""",
    "h4_fuzzy_match": f"""WITH k AS (SELECT lower({SQL_PLACE}) AS key FROM nation), t AS (SELECT DISTINCT substr(l, 1, pp - 1) || 'x' || substr(l, pp + 1) || CASE WHEN b > 5000 THEN '' ELSE 'q' END AS token
          FROM (SELECT lower({SQL_PLACE}) AS l, c_custkey % 7 + 2 AS pp, c_acctbal AS b FROM customer JOIN nation ON c_nationkey = n_nationkey)),
        d AS (SELECT token, key, levenshtein(token, key) AS dist FROM t, k WHERE levenshtein(token, key) <= CASE WHEN len(token) <= 6 THEN 1 WHEN len(token) <= 12 THEN 2 ELSE 3 END)
        SELECT token, key, dist FROM d QUALIFY row_number() OVER (PARTITION BY token ORDER BY dist, key) = 1""",
    "h5_resolve_country": f"""WITH {RAW} SELECT DISTINCT raw, CASE WHEN kind = 7 THEN 'US' WHEN kind = 12 THEN code ELSE code END AS iso2, CASE WHEN kind = 7 THEN 'state' WHEN kind = 12 THEN 'ambiguous' ELSE 'country' END AS via FROM raws WHERE kind IN (2, 3, 4, 7, 9, 12)""",
    "h6_canonical_location": f"""WITH {RAW} SELECT DISTINCT raw, CASE WHEN kind <= 1 OR kind IN (2, 3, 8) THEN city || ', ' || code WHEN kind = 4 THEN nation || ' City, ' || code WHEN kind IN (5, 6, 10) THEN 'Dublin, IE' WHEN kind = 7 THEN city || ', TX, US'
          WHEN kind = 9 THEN city || ' Am Main, ' || code WHEN kind = 11 THEN 'New York, US' WHEN kind = 12 THEN city || ', ' || code ELSE 'Zzburg' || substr(city, 5) || ', IE' END AS canonical,
        CASE WHEN kind <= 1 OR kind = 8 THEN 'city_only' WHEN kind IN (2, 9) THEN 'city_country' WHEN kind = 3 THEN 'swapped' WHEN kind = 4 THEN 'country_only' WHEN kind IN (5, 6, 10) THEN 'fallback' WHEN kind = 7 THEN 'us_state' WHEN kind = 11 THEN 'us_only'
          WHEN kind = 12 THEN 'code_is_country' ELSE 'unknown_city' END AS rule FROM raws""",
    "h7_recognised": f"""WITH {RAW} SELECT c_custkey, raw, 'false' AS is_us, 'false' AS is_remote, 'false' AS is_hybrid FROM raws WHERE kind IN (2, 3, 4, 7, 12)""",
    "h8_region_profile": f"""WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'US' WHEN 'MACHINERY' THEN 'BR' END AS posting_iso2, CASE WHEN c_acctbal > 3000 THEN 'CA' END AS candidate_iso2 FROM customer), i AS (SELECT *, coalesce(posting_iso2, candidate_iso2) AS iso2 FROM c)
        SELECT *, CASE WHEN posting_iso2 IS NOT NULL THEN 'posting' WHEN candidate_iso2 IS NOT NULL THEN 'candidate' ELSE 'default' END AS source, CASE WHEN iso2 IN ('US', 'CA') THEN 'LETTER' ELSE 'A4' END AS page,
          CASE WHEN iso2 IS NULL THEN 'UK' ELSE 'US' END AS spelling, CASE WHEN iso2 IN ('US', 'CA') THEN 'Resume' ELSE 'CV' END AS document_word FROM i""",
    "h9_places_dim": f"""SELECT 'country' AS kind, {SQL_CODE} AS code, {SQL_PLACE} AS name, {SQL_CODE} AS iso2, {SQL_PLACE} || ' City, ' || {SQL_CODE} AS default_place FROM nation
        UNION ALL SELECT 'state', k, v, 'US', v || ', ' || k || ', US' FROM {S.values(list(R.US_STATES.items()))} AS s(k, v) UNION ALL SELECT 'province', k, v, 'CA', v || ', CA' FROM {S.values(list(R.CA_PROVINCES.items()))} AS p(k, v)""",
}
