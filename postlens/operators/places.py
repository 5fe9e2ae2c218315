"""Location strings to places. Work runs on distinct strings; gazetteers are tables."""

from __future__ import annotations

from collections.abc import Mapping
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import big, c, found, let, literal_map, squeeze, sub, sub_all
from postlens.rules import records as R
from postlens.sources.landing import country_key, fold_accents


def strip_work_mode(col: str | Column) -> Column:
    """The place without its working arrangement."""
    return squeeze(sub_all(c(col), [(R.WORK_MODE_BRACKET, " "), (R.WORK_MODE, "$1 "), (r" *[-–—|,/] *[-–—|,/] *", ", "), (r"^ *[-–—|,/]+ *| *[-–—|,/]+ *$", "")]))


def clean_location(col: str | Column) -> Column:
    """Label prefixes, relocation notes, work modes and all but the first of several places removed."""
    t = sub_all(F.trim(c(col)), [(R.LOCATION_PREFIX, ""), (r"^[:\-–—|, ]+", ""), (R.RELOCATION, "")])
    t = strip_work_mode(F.trim(F.regexp_extract(F.trim(t), r"^ *([^;|]*)", 1)))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))


def clean_locations(df: DataFrame, raw: str = "raw") -> DataFrame:
    """(raw, cleaned) per distinct string."""
    return df.select(raw).distinct().withColumn("cleaned", clean_location(raw))


def place_class(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds class: blank, not_a_place, region or place."""
    t = F.trim(sub(F.coalesce(c(raw), F.lit("")), r"[.,;:\-]+$"))
    junk = found(t, R.NOT_PLACES) | found(t, r"^[{\[<].*[}\]>]$") | ~found(fold_accents(F.lower(t)), "[a-z]") | (F.length(t) > 80) | (~found(t, "[ ,]") & (F.length(t) > 40))
    region = F.lower(t).isin(R.REGIONS) | F.lower(F.trim(F.element_at(F.split(t, ","), 1))).isin(R.REGIONS)
    return df.withColumn("class", F.when(t == "", "blank").when(junk, "not_a_place").when(region, "region").otherwise("place"))


def match_city(df: DataFrame, cities: DataFrame, raw: str = "raw", aliases: Mapping[str, str] = MappingProxyType({**R.CITY_SHORT_NAMES, **R.CITY_LOCAL_NAMES})) -> DataFrame:
    """(raw, city, iso2, via): the longest leading words that are a city key; one-word heads of longer names only when nothing longer fits.

    A string that is a whole key of ``aliases`` (lower-cased short, misspelt or local names) is looked up by its listed
    name, via ``alias``, unless the gazetteer knows it as it is written.
    """
    written = F.lower(squeeze(c(raw)))
    known = F.try_element_at(literal_map(dict(aliases)), written) if aliases else F.lit(None).cast("string")
    words = F.split(written, " ")
    heads = let(words, lambda ws: F.transform(F.sequence(F.size(ws), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(ws, F.lit(1), n), " ")))
    keys = df.select(raw).distinct().where(F.trim(c(raw)) != "").select(raw, F.posexplode(heads).alias("_drop", "_h"))
    forms = F.array_distinct(F.array(F.struct(F.lit(0).alias("f"), F.col("_h").alias("city_key")), F.struct(F.lit(1).alias("f"), fold_accents(F.col("_h")).alias("city_key"))))
    # Behind the whole string as written, before its shorter heads: its listed name.
    listed = df.select(raw, F.lower(known).alias("city_key")).where("city_key is not null").distinct().select(raw, F.lit(0).alias("_drop"), F.lit(2).alias("f"), "city_key")
    hit = keys.select(raw, "_drop", F.inline(forms)).unionByName(listed).join(cities, "city_key")
    best = hit.groupBy(raw).agg(F.min(F.struct("_drop", "f", F.col("city_key").alias("city"), F.col("country_iso2").alias("iso2"))).alias("_b"))
    return best.select(raw, "_b.city", "_b.iso2", F.when(F.col("_b._drop") > 0, "shortened").when(F.col("_b.f") == 2, "alias").when(F.col("_b.f") == 1, "folded").otherwise("exact").alias("via"))


def _segments(length: Column, k: Column) -> Column:
    """Even split of a string of ``length`` into k+1 pieces: array of (i, start from 1, len)."""
    base, longer = F.floor(length / (k + 1)).cast("int"), (length % (k + 1)).cast("int")
    short = k + 1 - longer
    return F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(
        i.alias("i"), (1 + i * base + F.greatest(i - short, F.lit(0))).cast("int").alias("start"), (base + F.when(i >= short, 1).otherwise(0)).cast("int").alias("len")))


def fuzzy_match(tokens: DataFrame, keys: DataFrame, cutoff: Column, token: str = "token", key: str = "key") -> DataFrame:
    """(token, key, dist): the closest key within ``cutoff`` edits (a column over the token), first by key on ties.

    Two strings within k edits share one of the k+1 even pieces of either, shifted by at most k.
    Keys are indexed by those pieces and tokens by the substrings that can meet them, so
    candidates come from an equi-join and none is missed. Keys no longer than the cutoff have no
    such pieces; being few, they meet all tokens of that cutoff that are short enough. How many edits keys are
    indexed for follows from the cutoffs that the tokens have.
    """
    distinct = tokens.select(token).distinct().where(F.length(token) > 0).withColumn("k", cutoff.cast("int"))
    max_edits = distinct.agg(F.max("k")).first()[0] or 0
    if max_edits < 1:
        same = distinct.join(keys.select(F.col(key).alias(token)).distinct(), token)
        return same.select(token, F.col(token).alias("key"), F.lit(0).cast("bigint").alias("dist"))
    exact = distinct.where("k < 1").join(keys.select(F.col(key).alias(token)).distinct(), token).select(token, F.col(token).alias(key), "k")
    tiny = keys.select(key).distinct().withColumn("n", F.length(key)).where(F.col("n") <= max_edits).withColumn("k", F.explode(F.sequence(F.greatest(F.col("n"), F.lit(1)), F.lit(max_edits))))
    tiny = distinct.join(tiny, "k").where(F.length(token) <= F.col("n") + F.col("k")).select(token, key, "k")
    indexed = keys.select(key).distinct().withColumn("n", F.length(key)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max_edits)))).where("n > k")
    indexed = indexed.select(key, "k", "n", F.explode(_segments(F.col("n"), F.col("k"))).alias("s")).select(key, "k", "n", F.col("s.i").alias("i"), F.substring(key, F.col("s.start"), F.col("s.len")).alias("piece"))
    probes = distinct.where("k > 0").select(token, "k", F.explode(F.sequence(F.greatest(F.length(token) - F.col("k"), F.col("k") + 1), F.length(token) + F.col("k"))).alias("n"))
    probes = probes.select(token, "k", "n", F.explode(_segments(F.col("n"), F.col("k"))).alias("s"))
    shifts = F.sequence(F.greatest(F.col("s.start") - F.col("k"), F.lit(1)), F.greatest(F.col("s.start") + F.col("k"), F.lit(1)))
    probes = probes.select(token, "k", "n", F.col("s.i").alias("i"), "s.len", F.explode(shifts).alias("at")).select(token, "k", "n", "i", F.substring(token, F.col("at"), F.col("len")).alias("piece"), "len").where(
        F.length("piece") == F.col("len")).drop("len").distinct()
    cands = probes.join(indexed, ["k", "n", "i", "piece"]).select(token, key, "k").distinct()
    cands = cands.unionByName(tiny).unionByName(exact)
    near = cands.withColumn("dist", big(F.levenshtein(token, key))).where(F.col("dist") <= F.col("k"))
    return near.groupBy(token).agg(F.min(F.struct("dist", F.col(key).alias("key"))).alias("_b")).select(token, "_b.key", "_b.dist")


def city_cutoff(token: str = "token") -> Column:
    n = F.length(token)
    return F.when(n <= 6, 1).when(n <= 12, 2).otherwise(3)


def country_cutoff(token: str = "token") -> Column:
    return F.when(F.length(token) <= 8, 1).otherwise(2)


def fuzzy_country(tokens: DataFrame, countries: DataFrame, cities: DataFrame, token: str = "token") -> DataFrame:
    """Fuzzy country match for tokens that are not themselves a known city."""
    open_tokens = tokens.join(cities.select(F.col("city_key").alias(token)), token, "left_anti")
    return fuzzy_match(open_tokens, countries, country_cutoff(token), token)


def _state_of(part: Column) -> Column:
    return F.try_element_at(literal_map({**{k.lower(): "US" for k in R.US_STATES}, **{v.lower(): "US" for v in R.US_STATES.values()},
                                         **{k.lower(): "CA" for k in R.CA_PROVINCES}, **{v.lower(): "CA" for v in R.CA_PROVINCES.values()}}), part)


def resolve_country(df: DataFrame, countries: DataFrame, cities: DataFrame, raw: str = "raw", ambiguous: str = "city") -> DataFrame:
    """(raw, iso2, via) per distinct string, read from the last part to the first.

    A two-letter code that is both a state and a country follows the country of the city before
    it (``ambiguous="city"``, unknown cities keep the country reading) or is the state whenever a
    part precedes it (``ambiguous="state"``).
    """
    cleaned = sub_all(c(raw), [(r"[()\[\]]", ","), (R.WORK_MODE, "$1,"), (r"[ \t]+", " ")])
    parts = F.filter(F.transform(F.split(cleaned, r" *[,;/|] *| +- +"), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    rows = df.select(raw).distinct().withColumn("_p", parts).select(raw, F.element_at(F.when(F.size("_p") > 0, F.col("_p")), 1).alias("_first"), F.posexplode(F.reverse("_p")).alias("_pos", "part"), F.size("_p").alias("_n"))
    rows = rows.join(countries.select(F.col("key").alias("part"), F.col("iso2").alias("_iso")), "part", "left").join(
        cities.select(F.col("city_key").alias("_first"), F.col("country_iso2").alias("_city")), "_first", "left")
    code = F.length("part") == 2
    state = F.when(~code | (F.col("_pos") < F.col("_n") - 1), _state_of(F.col("part")))
    both = code & F.upper("part").isin(R.STATE_ALSO_COUNTRY) & (F.col("_pos") < F.col("_n") - 1)
    as_country = F.coalesce("_iso", F.upper("part"))
    by_city = F.when(F.col("_city").isin("US", "CA"), F.coalesce(state, F.col("_city"))).otherwise(F.coalesce("_city", as_country)) if ambiguous == "city" else F.coalesce(state, as_country)
    iso2 = F.when(both, by_city).otherwise(F.coalesce("_iso", state))
    via = F.when(both, "ambiguous").when(F.col("_iso").isNotNull(), "country").otherwise("state")
    best = rows.withColumn("iso2", iso2).withColumn("via", via).where("iso2 is not null").groupBy(raw).agg(F.min(F.struct("_pos", "iso2", "via")).alias("_b"))
    return best.select(raw, "_b.iso2", "_b.via")


def title_case(col: str | Column) -> Column:
    return F.array_join(F.transform(F.split(F.lower(c(col)), " "), lambda w: F.array_join(F.transform(F.split(w, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "-")), " ")


def canonical_location(df: DataFrame, countries: DataFrame, cities: DataFrame, fallback: str = "Dublin, IE", us_default: str = "New York, US", raw: str = "raw") -> DataFrame:
    """(raw, canonical, rule) per distinct string: "City, ISO2" or "City, ST, US"; strings without a place give ``fallback``."""
    base = place_class(df.select(raw).distinct().withColumn("_c", F.coalesce(clean_location(raw), F.lit(""))), raw)
    base = place_class(base.withColumnRenamed("class", "_raw_class"), "_c").withColumn("_p", F.filter(F.transform(F.split("_c", ","), lambda p: F.trim(p)), lambda p: p != ""))
    base = base.withColumn("_p", F.filter("_p", lambda p, i: F.size(F.filter(F.slice("_p", F.lit(1), i), lambda q: F.lower(q) == F.lower(p))) == 0))
    base = base.withColumn("_a", F.try_element_at("_p", F.lit(1))).withColumn("_z", F.try_element_at("_p", F.lit(-1))).withColumn("_n", F.size("_p"))

    def look(frame, part, name):
        frame = frame.withColumn("_k", fold_accents(F.lower(part))).join(cities.select(F.col("city_key").alias("_k"), F.col("country_iso2").alias(f"_{name}_city")), "_k", "left").drop("_k")
        return frame.withColumn("_k", country_key(part)).join(countries.select(F.col("key").alias("_k"), F.col("iso2").alias(f"_{name}_iso"), F.col("capital").alias(f"_{name}_cap")), "_k", "left").drop("_k")

    t = look(look(base, F.col("_a"), "a"), F.col("_z"), "z")
    two = F.upper("_z")
    is_state = two.isin(list(R.US_STATES)) & (F.length("_z") == 2) & (F.col("_n") > 1)
    shared = is_state & two.isin(R.STATE_ALSO_COUNTRY)
    place = lambda a, *rest: F.concat_ws(", ", title_case(a), *rest)
    home = fallback.split(",")[-1].strip()
    none = (F.col("_raw_class") != "place") | (F.col("class") != "place") | (F.col("_n") == 0)
    rules = [
        (none, "fallback", F.lit(fallback)),
        ((F.col("_n") == 1) & F.lower("_a").isin("us", "usa", "united states"), "us_only", F.lit(us_default)),
        ((F.col("_n") == 2) & F.col("_a_iso").isNotNull() & F.col("_z_iso").isNull() & F.col("_z_city").isNotNull(), "swapped", place(F.col("_z"), F.col("_a_iso"))),
        (shared & F.col("_a_city").isNotNull() & (F.col("_a_city") != "US"), "code_is_country", place(F.col("_a"), F.col("_a_city"))),
        (shared & (F.col("_a_city") == "US"), "code_is_state", place(F.col("_a"), two, F.lit("US"))),
        (shared, "code_unknown_city", place(F.col("_a"), two)),
        (is_state, "us_state", place(F.col("_a"), two, F.lit("US"))),
        ((F.col("_n") > 1) & F.col("_z_iso").isNotNull(), "city_country", place(F.col("_a"), F.col("_z_iso"))),
        ((F.col("_n") == 1) & F.col("_a_city").isNotNull(), "city_only", place(F.col("_a"), F.col("_a_city"))),
        ((F.col("_n") == 1) & F.col("_a_iso").isNotNull(), "country_only", F.concat_ws(", ", F.col("_a_cap"), F.col("_a_iso"))),
        (F.col("_a_city").isNotNull(), "city_known", place(F.col("_a"), F.col("_a_city"))),
    ]
    canonical, rule = place(F.col("_a"), F.lit(home)), F.lit("unknown_city")
    for cond, name, value in reversed(rules):
        canonical, rule = F.when(cond, value).otherwise(canonical), F.when(cond, name).otherwise(rule)
    return t.select(raw, canonical.alias("canonical"), rule.alias("rule"))


def recognised(df: DataFrame, countries: DataFrame, cities: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows whose first part is a known city or country, with is_us, is_remote, is_hybrid."""
    first = F.trim(F.element_at(F.split(c(raw), ","), 1))
    known = cities.select(F.col("city_key").alias("_k")).unionByName(countries.select(F.col("key").alias("_k"))).distinct()
    kept = df.withColumn("_k", fold_accents(F.lower(first))).join(known, "_k", "left_semi").drop("_k")
    low = F.lower(c(raw))
    return kept.withColumn("is_us", found(raw, "(?:^|[^A-Za-z])US(?:$|[^A-Za-z])|United States")).withColumn("is_remote", low.contains("remote")).withColumn("is_hybrid", low.contains("hybrid"))


def region_profile(df: DataFrame, posting_iso: str = "posting_iso2", candidate_iso: str = "candidate_iso2") -> DataFrame:
    """Adds iso2, source, page, spelling, document_word; the posting's country first, the candidate's next, defaults last."""
    iso = F.coalesce(F.col(posting_iso), F.col(candidate_iso))
    return df.withColumn("iso2", iso).withColumn("source", F.when(F.col(posting_iso).isNotNull(), "posting").when(F.col(candidate_iso).isNotNull(), "candidate").otherwise("default")).withColumn(
        "page", F.when(iso.isin(R.LETTER_COUNTRIES), "LETTER").otherwise("A4")).withColumn("spelling", F.when(iso.isin(R.US_ENGLISH_COUNTRIES), "US").otherwise("UK")).withColumn(
        "document_word", F.when(iso.isin("US", "CA"), "Resume").otherwise("CV"))


def places_dim(countries: DataFrame) -> DataFrame:
    """(kind, code, name, iso2, default_place): countries with their default place, states and provinces in one dimension."""
    spark = countries.sparkSession
    states = spark.createDataFrame([("state", k, v, "US", f"{v}, {k}, US") for k, v in R.US_STATES.items()] + [("province", k, v, "CA", f"{v}, CA") for k, v in R.CA_PROVINCES.items()],
                                   "kind string, code string, name string, iso2 string, default_place string")
    rows = countries.select("iso2", "name", "capital").distinct().select(F.lit("country").alias("kind"), F.col("iso2").alias("code"), title_case("name").alias("name"), "iso2",
                                                                         F.concat_ws(", ", "capital", "iso2").alias("default_place"))
    return rows.unionByName(states)
