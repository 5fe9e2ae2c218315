"""CV text and profile JSON to nested records, and checks on such records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.segments import neighbour, running
from postlens.functions.text import big, c, first_of, found, keep_present, outside, pick, sub
from postlens.operators.history import word_ngrams
from postlens.operators.quality import bare
from postlens.operators.terms import by_document
from postlens.rules import quality as Q
from postlens.rules import records as R

ROLE_HEADER = r"^[^|]+\|[^|]+(?:\|.*)?$"


def roles(docs: DataFrame, key: str = "doc_id", text: str = "text", header: str = ROLE_HEADER, separator: str = r"[ ]*\|[ ]*", bullet: str = Q.BULLET) -> DataFrame:
    """(key, role_no, company, title, dates, location, bullets): a header line and the bullet lines below it, in order."""
    rows = by_document(docs, key, text).select(key, F.posexplode(F.split(c(text), "\n")).alias("line_no", "_l")).where(F.trim("_l") != "")
    is_head, is_bullet = F.col("_l").rlike(header), F.col("_l").rlike(bullet)
    w = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("_head", is_head & ~is_bullet).withColumn("role_no", big(F.sum(F.col("_head").cast("int")).over(w))).where("role_no > 0")
    parts = F.split(F.trim("_l"), separator)
    head = F.max(F.when(F.col("_head"), F.struct(*[F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(("company", "title", "dates", "location"))])))
    lines = F.array_sort(F.collect_list(F.when(~F.col("_head") & is_bullet, F.struct("line_no", bare("_l", bullet).alias("body")))))
    return rows.groupBy(key, "role_no").agg(head.alias("_h"), F.transform(lines, lambda s: s["body"]).alias("bullets")).select(key, "role_no", "_h.*", "bullets")


def _month_start(text: Column) -> Column:
    """First of the month named by 2019-03, 03/2019, Mar 2019 or 2019; NULL if none."""
    y1, m1 = F.regexp_extract(text, r"((?:19|20)[0-9]{2})[-/][0-9]{1,2}", 1), F.regexp_extract(text, r"(?:19|20)[0-9]{2}[-/]([0-9]{1,2})", 1)
    y2, m2 = F.regexp_extract(text, r"[0-9]{1,2}[-/]((?:19|20)[0-9]{2})", 1), F.regexp_extract(text, r"([0-9]{1,2})[-/](?:19|20)[0-9]{2}", 1)
    y3, m3 = F.regexp_extract(text, rf"(?i)(?:{R.MONTHS})[a-z]*\.?[ ]+((?:19|20)[0-9]{{2}})", 1), F.regexp_extract(text, rf"(?i)({R.MONTHS})[a-z]*\.?[ ]+(?:19|20)[0-9]{{2}}", 1)
    y4 = F.regexp_extract(text, r"((?:19|20)[0-9]{2})", 1)
    number = F.floor((F.position(F.lower(m3), F.lit(R.MONTHS.lower().replace("|", ""))) + 2) / 3)
    made = lambda y, m: F.when((y != "") & m.between(1, 12), F.make_date(y.cast("int"), m.cast("int"), F.lit(1)))
    safe = lambda s: F.when(s != "", s.cast("int")).otherwise(0)
    return first_of(made(y1, safe(m1)), made(y2, safe(m2)), F.when(m3 != "", made(y3, number)), made(y4, F.lit(1)))


def parse_ranges(rows: DataFrame, as_of: Column, raw: str = "raw") -> DataFrame:
    """Adds start, end, is_current, months and canonical ("MM-YYYY – MM-YYYY" or "… – Present"); ``as_of`` closes open ranges."""
    text = F.trim(c(raw))
    current = found(text, r"(?i)(?:^|[^a-z])(?:present|current|now|to date|ongoing)(?:$|[^a-z])")
    parts = F.split(sub(text, r"[ ]+(?:-|–|—|to|until)[ ]+|[ ]*[–—][ ]*", "\u0001"), "\u0001")
    work = rows.withColumn("is_current", F.coalesce(current, F.lit(False))).withColumn("start", _month_start(F.element_at(parts, 1)))
    work = work.withColumn("end", F.when(F.col("is_current"), F.trunc(as_of, "month")).when(F.size(parts) > 1, _month_start(F.element_at(parts, -1))))
    months = (F.year("end") - F.year("start")) * 12 + F.month("end") - F.month("start")
    return work.withColumn("months", big(F.when(months >= 0, months))).withColumn("canonical", F.when(F.col("start").isNotNull(), F.concat_ws(
        " – ", F.date_format("start", "MM-yyyy"), F.when(F.col("is_current"), F.lit("Present")).otherwise(F.date_format("end", "MM-yyyy")))))


def tenure(spans: DataFrame, key: str, start: str, end: str, span_id: str, seg: Column, out: str = "covered") -> DataFrame:
    """(key, covered): length of the union of [start, end] spans of a key, overlaps counted once.

    In start order every span adds what reaches past the furthest end so far. The running maximum
    is taken by segments, so a key with very many spans does not sit in one task.
    """
    clean = spans.where((F.col(start).isNotNull()) & (F.col(end) >= F.col(start))).withColumn("_seg", seg)
    work = running(clean, [key], "_seg", [start, end, span_id], F.col(end), "_reach", how="max", inclusive=False)
    gain = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(F.col("_reach"), F.col(start))))
    return work.groupBy(key).agg(F.sum(gain).alias(out))


def role_order(rows: DataFrame, key: str = "doc_id", role: str = "role_no", start: str = "start", bucket: int = 100_000) -> DataFrame:
    """(key, role, new_no, was_sorted): newest first; keys with fewer than two dated roles stay out."""
    dated = rows.where(F.col(start).isNotNull()).select(key, role, F.unix_seconds(F.col(start).cast("timestamp")).alias("_s"))
    work = dated.withColumn("_ns", -F.col("_s")).withColumn("_seg", F.floor(-F.col("_s") / (365 * 86400)))
    work = running(work, [key], "_seg", ["_ns", role], F.lit(1), "new_no")
    work = work.withColumn("_seg", F.floor(F.col(role) / bucket))
    work = neighbour(work, [key], "_seg", [role], F.col("_s"), "_prev")
    sorted_keys = work.groupBy(key).agg((F.count_if(F.col("_prev") < F.col("_s")) == 0).alias("was_sorted"), F.count("*").alias("_n")).where("_n >= 2").drop("_n")
    return work.join(sorted_keys, key).select(key, role, big("new_no").alias("new_no"), "was_sorted")


def masked(address: Column) -> Column:
    """First letter and domain only."""
    return F.when(address.isNotNull(), F.concat(F.substring(address, 1, 1), F.lit("***@"), F.regexp_extract(address, "@(.*)$", 1)))


def contact_fields(docs: DataFrame, key: str = "doc_id", text: str = "text", mask: bool = True, head: int = 15) -> DataFrame:
    """(key, name, email, phone, location, profile, repo) from the first lines of a document."""
    ls = F.split(c(text), "\n")
    top = F.array_join(F.slice(ls, 1, head), "\n")
    first = F.trim(F.try_element_at(F.filter(ls, lambda l: F.trim(l) != ""), F.lit(1)))
    email, phone = pick(top, r"([A-Za-z0-9_.+\-]+@[A-Za-z0-9_.\-]+\.[a-zA-Z]{2,})"), F.trim(pick(top, r"((?:\+[0-9]{1,3}[ -]?)?(?:\(?[0-9]{2,4}\)?[ .\-]?)?[0-9]{3,4}[ .\-]?[0-9]{3,4})"))
    if mask:
        email, phone = masked(email), F.when(phone.isNotNull(), F.concat(F.lit("***"), F.right(phone, F.lit(2))))
    named = found(first, r"^[A-Za-z '\-]+$") & (F.size(F.split(first, " +")) <= 5)
    return docs.select(key, F.when(named, F.initcap(first)).alias("name"), email.alias("email"), phone.alias("phone"),
                       pick(top, r"(?:^|[^A-Za-z0-9_])([A-Z][a-zA-Z ]+,[ ]*(?:[A-Z]{2}|[A-Za-z ]+))").alias("location"),
                       pick(top, r"(?i)(linkedin\.com/in/[A-Za-z0-9_\-]+)").alias("profile"), pick(top, r"(?i)(github\.com/[A-Za-z0-9_\-]+)").alias("repo"))


def skills(docs: DataFrame, key: str = "doc_id", text: str = "text", soft: Sequence[str] = tuple(R.SOFT_ITEMS), longest: int = 20) -> DataFrame:
    """(key, ord, skill): list items of 2 to 40 characters, one spelling each (mixed case wins), items inside a longer one dropped.

    An item of 40 characters has at most ``longest`` words.
    """
    items = F.filter(F.transform(F.split(sub(c(text), r"[•*▪]|(?:^|\n)[ ]*-", ","), r"[,\n]"), lambda s: F.trim(s)),
                     lambda s: F.length(s).between(2, 40) & outside(F.lower(s), soft))
    rows = by_document(docs, key, text).select(key, F.posexplode(items).alias("_i", "skill"))
    mixed = F.when((F.col("skill") == F.lower("skill")) | (F.col("skill") == F.upper("skill")), 1).otherwise(0)
    one = rows.groupBy(key, F.lower("skill").alias("_k")).agg(F.min("_i").alias("ord"), F.min(F.struct(mixed.alias("m"), F.col("_i"), F.col("skill").alias("s")))["s"].alias("skill"))
    ws = F.split("_k", "[ ]+")
    inner = F.array_except(word_ngrams(ws, range(1, longest + 1)), F.array("_k"))
    held = F.array_distinct(F.flatten(F.collect_list(inner).over(Window.partitionBy(key))))
    return one.withColumn("_held", held).where(~F.array_contains("_held", F.col("_k"))).select(key, big("ord").alias("ord"), "skill")


def group_skills(items: DataFrame, taxonomy: Sequence[tuple[str, str]], asked: Sequence[str] = (), key: str = "doc_id", core: str = "Core Competencies",
                 merges=tuple(R.GROUP_MERGES), budget: int = R.MAX_GROUPS) -> DataFrame:
    """(key, group, group_ord, skills): skills by first matching group, pairs merged and the least relevant groups folded into Additional until ``budget`` is met."""
    label = F.lit("Additional")
    for name, pattern in reversed(list(taxonomy)):
        label = F.when(F.col("skill").rlike("(?i)" + pattern), name).otherwise(label)
    names = [n for n, _ in taxonomy]
    wanted = F.lower("skill").isin([a.lower() for a in asked]) if asked else F.lit(False)
    doc = Window.partitionBy(key)
    work = items.withColumn("group", label).withColumn("_asked", wanted.cast("int")).withColumn("_set", F.collect_set("group").over(doc))
    rank = {n: i for i, n in enumerate(names)}
    for source, into, combined in merges:
        if source not in rank or into not in rank:
            continue
        rank[combined] = min(rank[source], rank[into])
        both = F.array(F.lit(source), F.lit(into))
        fold = (F.size("_set") > budget) & (F.size(F.array_intersect("_set", both)) == 2)
        work = work.withColumn("_fold", fold).withColumn("group", F.when(F.col("_fold") & F.col("group").isin(source, into), combined).otherwise(F.col("group"))).withColumn(
            "_set", F.when(F.col("_fold"), F.array_union(F.array_except("_set", both), F.array(F.lit(combined)))).otherwise(F.col("_set")))
    order = F.coalesce(*[F.when(F.col("group") == n, i) for n, i in rank.items()], F.lit(len(names) + 1))
    pairs = Window.partitionBy(key, "group")
    work = work.withColumn("_rel", F.sum("_asked").over(pairs)).withColumn("_size", F.count("*").over(pairs)).withColumn("_tax", order)
    surplus = F.when(F.size("_set") > budget, F.size("_set") - budget + F.when(F.array_contains("_set", "Additional"), 0).otherwise(1)).otherwise(0)
    fixed = F.col("group").isin("Additional", core)
    turn = F.dense_rank().over(Window.partitionBy(key).orderBy(fixed.cast("int"), "_rel", "_size", "_tax", "group"))
    work = work.withColumn("_surplus", surplus).withColumn("_turn", turn).withColumn("group", F.when(~fixed & (F.col("_turn") <= F.col("_surplus")), "Additional").otherwise(F.col("group")))
    out = work.groupBy(key, "group").agg(F.sum("_asked").alias("_rel"), F.min("_tax").alias("_tax"), F.array_sort(F.collect_list(F.struct((-F.col("_asked")).alias("a"), "ord", "skill"))).alias("_s"))
    place = F.when(F.col("group") == core, 0).when(F.col("group") == "Additional", 2).otherwise(1)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(place, F.desc("_rel"), "_tax", "group"))
    return out.select(key, "group", big(nth).alias("group_ord"), F.transform("_s", lambda s: s["skill"]).alias("skills"))


def _field(node: Column, names: Sequence[str]) -> Column:
    return first_of(*[F.nullif(F.trim(F.try_variant_get(node, "$." + n, "string")), F.lit("")) for n in names])


def unify_profiles(rows: DataFrame, key: str = "profile_id", payload: str = "payload") -> DataFrame:
    """(key, source, roles, errors, warnings): profiles that name the same things differently, in one shape.

    Experience sits under one of four names; company, title and dates under several; bullets under
    the first of thirteen fields that is filled, as text or as an array.
    """
    node = F.try_parse_json(c(payload))
    lists = [F.try_variant_get("_v", f"$.{n}", "array<variant>") for n in R.EXPERIENCE_FIELDS]
    filled = [F.when(F.size(x) > 0, x) for x in lists]
    source = first_of(*[F.when(F.size(x) > 0, F.lit(n)) for x, n in zip(lists, R.EXPERIENCE_FIELDS)])

    def bullets(v):
        options = []
        for name in R.BULLET_FIELDS:
            listed = F.filter(F.transform(F.try_variant_get(v, f"$.{name}", "array<variant>"), lambda x: F.coalesce(
                F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$.bullet", "string"), F.try_variant_get(x, "$.value", "string"), x.try_cast("string"))), lambda s: F.trim(s) != "")
            text = F.filter(F.split(F.try_variant_get(v, f"$.{name}", "string"), r"\r?\n"), lambda s: F.trim(s) != "")
            options += [F.when(F.size(listed) > 0, listed), F.when(F.size(text) > 0, text)]
        return F.coalesce(*options, F.array().cast("array<string>"))

    def role(v):
        return F.struct(*[F.coalesce(_field(v, names), F.lit("")).alias(n) for n, names in R.ROLE_FIELDS.items()], bullets(v).alias("bullets"))

    work = rows.select(key, node.alias("_v")).select(key, source.alias("source"), F.coalesce(F.transform(F.coalesce(*filled), role)).alias("roles"))

    def missing(field, label):
        return F.filter(F.transform("roles", lambda r, i: F.when(r[field] == "", F.concat(F.lit("role "), (i + 1).cast("string"), F.lit(f": no {label}")))), lambda s: s.isNotNull())

    errors = F.when(F.col("roles").isNull(), F.array(F.lit("no experience"))).otherwise(F.concat(missing("company", "company"), missing("title", "title")))
    warnings = F.coalesce(F.concat(missing("start", "start"), F.filter(F.transform("roles", lambda r, i: F.when(
        F.size(r["bullets"]) == 0, F.concat(F.lit("role "), (i + 1).cast("string"), F.lit(": no bullets")))), lambda s: s.isNotNull())), F.array().cast("array<string>"))
    return work.withColumn("errors", errors).withColumn("warnings", warnings)


def immutable_violations(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str] = ("company", "title", "dates")) -> DataFrame:
    """(keys, field, was, now): protected fields that changed, by position. ``was`` is the value to restore."""
    old = before.select(*keys, *[F.col(f).alias(f"_o_{f}") for f in fields])
    rows = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_o_{f}").cast("string").alias("was"), F.col(f).cast("string").alias("now"),
                                       F.col(f"_o_{f}").eqNullSafe(F.col(f)).alias("same")) for f in fields]), lambda s: ~s["same"])
    return after.join(old, list(keys)).select(*keys, F.inline(rows)).drop("same")


def restore_immutable(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str] = ("company", "title", "dates")) -> DataFrame:
    old = before.select(*keys, *[F.col(f).alias(f"_o_{f}") for f in fields])
    return after.join(old, list(keys), "left").withColumns({f: F.coalesce(f"_o_{f}", f) for f in fields}).drop(*[f"_o_{f}" for f in fields])


def extraction_quality(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, confidence, warnings, valid): mean of four field confidences over all roles, and what is missing. Needs start, end, months."""
    score = lambda f: F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", 1.0).otherwise(0.0)
    mean = (score("company") + score("title") + score("start") + score("end")) / 4
    warn = keep_present(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.concat(F.lit(f"no {f} in role "), F.col("role_no").cast("string"))) for f in ("company", "title", "start")],
                        F.when(F.size("bullets") == 0, F.concat(F.lit("no bullets in role "), F.col("role_no").cast("string"))), F.when(F.col("months") > 480, F.concat(F.lit("over 40 years in role "), F.col("role_no").cast("string"))))
    return rows.groupBy(key).agg(F.round(F.avg(mean), 4).alias("confidence"), F.array_sort(F.flatten(F.collect_list(warn))).alias("warnings"),
                                 (F.count_if((F.coalesce("company", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")) > 0).alias("valid"))


def _islands(docs: DataFrame, key: str, text: str, opens) -> DataFrame:
    rows = by_document(docs, key, text).select(key, F.posexplode(F.split(c(text), "\n")).alias("line_no", "_raw")).withColumn("_l", F.trim("_raw")).where("_l <> ''")
    w = Window.partitionBy(key).orderBy("line_no")
    return rows.withColumn("_open", opens).withColumn("entry", big(F.sum(F.col("_open").cast("int")).over(w))).where("entry > 0")


def education(docs: DataFrame, key: str = "doc_id", text: str = "text", institution: str = R.INSTITUTION, degree: str = R.DEGREE) -> DataFrame:
    """(key, entry, institution, degree, date, grade): a cue line opens an entry, later lines fill date and grade."""
    l = F.col("_l")
    rows = _islands(docs, key, text, l.rlike(institution) | l.rlike(degree))
    parts = F.split(l, r"[ ]*\|[ ]*")
    piped = l.contains("|")
    inst = F.when(piped, F.element_at(parts, 1)).when(l.rlike(institution), l)
    deg = F.when(piped, F.element_at(parts, 2)).when(l.rlike(degree), l)
    head = lambda x: F.max(F.when(F.col("_open"), x))
    early = lambda x: F.min_by(x, F.when(x.isNotNull(), F.col("line_no")))
    return rows.groupBy(key, "entry").agg(head(inst).alias("institution"), head(deg).alias("degree"), early(pick(l, r"((?:19|20)[0-9]{2}(?:[ ]*[-–—][ ]*(?:(?:19|20)[0-9]{2}|[Pp]resent))?)")).alias("date"),
                                          early(pick(l, r"(?i)(?:GPA[: ]+)?([0-9]\.[0-9]{1,2}(?:[ ]*/[ ]*[0-9.]+)?)")).alias("grade"))


def certificates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    items = F.filter(F.transform(F.split(sub(c(text), r"[•*▪\-]", ","), r"[,\n]"), lambda s: F.trim(s)), lambda s: (F.length(s) > 5) & (F.length(s) < 100))
    return docs.select(key, F.posexplode(items).alias("ord", "certificate")).withColumn("ord", big("ord"))


def projects(docs: DataFrame, key: str = "doc_id", text: str = "text", bullet: str = Q.BULLET) -> DataFrame:
    """(key, entry, name, role, bullets)."""
    rows = _islands(docs, key, text, ~F.col("_l").rlike(bullet) & (F.length("_l") > 5))
    parts = F.split("_l", r"[ ]*\|[ ]*")
    lines = F.array_sort(F.collect_list(F.when(F.col("_l").rlike(bullet), F.struct("line_no", bare("_l", bullet).alias("body")))))
    head = lambda x: F.max(F.when(F.col("_open"), x))
    return rows.groupBy(key, "entry").agg(head(F.element_at(parts, 1)).alias("name"), head(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("role"), F.transform(lines, lambda s: s["body"]).alias("bullets"))


def split_headers(rows: DataFrame, header: str = "header") -> DataFrame:
    """Adds company, place, title, employment_type out of "Company, City, Country", "Company, Title (Contract)" or tab-joined lines."""
    raw = F.trim(c(header))
    kind = pick(raw, R.EMPLOYMENT_TYPE)
    line = F.trim(sub(raw, R.EMPLOYMENT_TYPE))
    work = rows.withColumn("_line", line).withColumn("_b", F.transform(F.split("_line", ","), lambda s: F.trim(s)))
    tabbed = F.col("_line").contains("\t")

    def cut(i):
        head, tail = F.array_join(F.slice("_b", F.lit(1), i), ", "), F.array_join(F.slice("_b", i + 1, F.size("_b")), ", ")
        ok = (head != "") & (tail != "") & ~tail.rlike("[0-9]") & ~(head.rlike(R.COMPANY_SUFFIX) & (i == 1) & tail.rlike(R.COMPANY_SUFFIX)) & ~F.element_at(F.slice("_b", i + 1, F.lit(1)), 1).rlike(
            R.COMPANY_SUFFIX) & tail.rlike(R.PLACE_TAIL) & ~tail.rlike(R.TITLE_WORD)
        return F.struct(ok.alias("ok"), head.alias("company"), tail.alias("place"))

    cuts = F.filter(F.transform(F.when(F.size("_b") > 1, F.sequence(F.lit(1), F.size("_b") - 1)).otherwise(F.array().cast("array<int>")), cut), lambda s: s["ok"])
    work = work.withColumn("_cut", F.try_element_at(cuts, F.lit(1)))
    left, right = F.element_at("_b", 1), F.try_element_at("_b", F.lit(2))
    titled = (F.size("_b") == 2) & right.rlike(R.TITLE_WORD) & ~left.rlike(R.TITLE_WORD)
    tabs = F.split("_line", "\t")
    return work.withColumn("company", F.when(tabbed, F.trim(F.element_at(tabs, 1))).when(titled, left).otherwise(F.coalesce("_cut.company", "_line"))).withColumn(
        "place", F.when(tabbed, F.trim(F.try_element_at(tabs, F.lit(2)))).when(~titled, F.col("_cut.place"))).withColumn("title", F.when(~tabbed & titled, right)).withColumn(
        "employment_type", F.lower(kind)).drop("_line", "_b", "_cut")


def enrich_roles(rows: DataFrame, profiles: DataFrame, matches: DataFrame, role: str, profile: str, fields: Sequence[str]) -> DataFrame:
    """Roles with missing fields filled from profile rows, each profile row used once; ``provenance`` lists what was filled.

    ``matches`` has (role, profile, rank): lower rank is better. A pair is used when each is the
    other's best: two aggregations that combine on the map side, so a profile that matches a third
    of all roles is never gathered.
    """
    best = lambda k, o: matches.groupBy(k).agg(F.min(F.struct("rank", o))[o].alias(o))
    mutual = best(role, profile).join(best(profile, role), [role, profile])
    give = profiles.select(profile, *[F.col(f).alias(f"_p_{f}") for f in fields])
    out = rows.join(mutual, role, "left").join(give, profile, "left")
    empty = lambda f: F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == ""
    filled = keep_present(*[F.when(empty(f) & F.col(f"_p_{f}").isNotNull(), F.lit(f)) for f in fields])
    return out.withColumn("provenance", filled).withColumns({f: F.when(empty(f), F.col(f"_p_{f}")).otherwise(F.col(f)) for f in fields}).drop(*[f"_p_{f}" for f in fields], profile)


def flatten(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): roles back to text in order, header then bullets; the inverse of ``roles``."""
    head = F.array_join(F.filter(F.array("company", "title", "dates", "location"), lambda s: F.coalesce(s, F.lit("")) != ""), " | ")
    block = F.array_join(F.concat(F.array(head), F.transform("bullets", lambda b: F.concat(F.lit("- "), b))), "\n")
    ordered = F.array_sort(F.collect_list(F.struct("role_no", block.alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "\n").alias("text"))
