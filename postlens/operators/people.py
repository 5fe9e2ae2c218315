"""Published addresses, titles and people: harvest, score, rank, render, limit. Reads landed tables only; contacts no one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.joins import lengths
from postlens.functions.segments import neighbour, running
from postlens.functions.text import big, c, first_of, keep_present, let, literal_map, pick, picks, squeeze, sub, sub_all, word_array
from postlens.operators.history import keep_last, word_ngrams
from postlens.operators.postings import LD_BODY, detect_platform, host_of, path_of, tags_to_text, variant_children, variant_levels, without_chrome
from postlens.operators.records import masked
from postlens.rules import postings as P
from postlens.rules import records as R

_RUN_ON = r"^(.+@[A-Za-z0-9.\-]+\.(?:com|org|net|io|ai|co|us|uk|ie|eu|de|fr|es|it|nl|gov|edu|info|biz|jobs|careers|tech|dev|app|[a-z]{2,3}))\.?[A-Z][A-Za-z]*$"


def tidy_address(col: Column) -> Column:
    """Trailing punctuation and a sentence run onto the domain removed."""
    return sub(sub(col, r"[.,;:!?)\]}>'\"«»]+$"), _RUN_ON, "$1")


def published_addresses(pages: DataFrame, context: int = 120, mask: bool = False) -> DataFrame:
    """(page_id, address, source, context): addresses a page publishes, the most deliberate source per address."""
    html = F.col("html")
    text = tags_to_text(without_chrome(html))

    def tag(arr, source):
        return F.transform(arr, lambda a: F.struct(F.lit(source).alias("r"), a["a"].alias("a"), a["c"].alias("c")))

    pair = lambda a, ctx: F.struct(a.alias("a"), ctx.alias("c"))
    mailto = F.transform(picks(html, r"(?is)(<a[^>]*href=[\"']mailto:[^>]*>.*?</a>)"), lambda m: pair(F.regexp_extract(m, r"(?i)mailto:([^\"'?>]+)", 1), tags_to_text(m)))
    ld = F.transform(F.filter(F.transform(F.filter(variant_levels(picks(html, LD_BODY)),
                                                   lambda n: F.coalesce(F.try_variant_get(n, "$.email", "string"), F.lit("")).contains("@")), lambda n: F.struct(
        F.try_variant_get(n, "$.email", "string").alias("a"), F.coalesce(F.try_variant_get(n, "$.name", "string"), F.lit("")).alias("c"))), lambda s: s["a"].isNotNull()), lambda s: s)
    meta = F.transform(picks(html, r"(?i)<meta[^>]*name=[\"'](?:reply-to|email)[\"'][^>]*content=[\"']([^\"']*@[^\"']*)[\"']"), lambda m: pair(m, F.lit("meta")))
    prose = F.transform(picks("_t", f"({R.ADDRESS})"), lambda a: pair(a, let(
        F.position(a, F.col("_t")), lambda at: F.substring("_t", F.greatest(at - context, F.lit(1)), F.length(a) + 2 * context))))
    found_all = F.concat(tag(mailto, 0), tag(ld, 1), tag(meta, 2), tag(prose, 3))
    clean = F.filter(F.transform(found_all, lambda s: F.struct(s["r"].alias("r"), tidy_address(F.trim(s["a"])).alias("a"), s["c"].alias("c"))), lambda s: s["a"].contains("@"))
    rows = pages.select("page_id", "html", text.alias("_t")).where(F.col("html").contains("@")).select("page_id", F.inline(clean))
    best = rows.groupBy("page_id", F.lower("a").alias("_k")).agg(F.min(F.struct("r", "a", "c")).alias("_b"))
    names = word_array([s for s, _ in R.ADDRESS_SOURCES])
    address = F.col("_b.a")
    return best.select("page_id", (masked(address) if mask else address).alias("address"), F.element_at(names, F.col("_b.r") + 1).alias("source"), F.col("_b.c").alias("context"))


def address_score(address: Column) -> Column:
    """−1 for blocked boxes; otherwise 20 to 100 by what the local part says."""
    local, domain = F.lower(F.regexp_extract(address, "^([^@]*)@", 1)), F.lower(F.regexp_extract(address, "@(.*)$", 1))
    return (F.when((local == "") | (domain == "") | local.rlike(R.BLOCKED_LOCAL) | domain.rlike(R.BLOCKED_DOMAIN), -1).when(local.rlike(R.PURPOSE_LOCAL), 20)
            .when(local.rlike("recruit|talent|hiring") & local.rlike("[._]"), 100).when(local.rlike(r"^[a-z]+\.[a-z]+$") & ~local.rlike(R.ROLE_LOCAL), 95)
            .when(local.rlike("recruit|talent|hiring|hr|people"), 90).when(local.rlike(R.RECRUITING_LOCAL), 88).when(local.rlike("^[a-z]{3,20}$"), 50).otherwise(30))


def rank_addresses(addresses: DataFrame, own: DataFrame | None = None, key: str = "page_id", top: int = 5, mask: bool = True) -> DataFrame:
    """(page_id, address, score, rank): usable addresses by score plus a small source bonus; the reader's own are left out."""
    rows = addresses.withColumn("_k", F.lower("address"))
    if own is not None:
        rows = rows.join(own.select(F.lower("address").alias("_k")), "_k", "left_anti")
    bonus = F.try_element_at(literal_map(dict(R.ADDRESS_SOURCES)), F.col("source"))
    rows = rows.withColumn("_s", address_score(F.col("address"))).where("_s > 0").withColumn("score", big(F.col("_s") + F.coalesce(bonus, F.lit(0))))
    out = keep_last(rows.select(key, "address", "score"), [key], top, [F.desc("score"), F.lower("address")], "rank")
    return out.withColumn("address", masked(F.col("address"))) if mask else out


def posting_reference(postings: DataFrame, key: str = "posting_id", text: str = "text", job_id: str | None = None) -> DataFrame:
    """(key, name, department, location, ref_lines)."""
    take = lambda patterns: squeeze(first_of(*[pick(c(text), p) for p in patterns]))
    name = sub(take(R.CONTACT_NAMES), r"(?i)^(?:contact|email|reach out to|reach|send|questions?|apply|attention|attn)[ ]+")
    work = postings.select(key, name.alias("name"), take(R.DEPARTMENTS).alias("department"), take(R.OFFICES).alias("location"), (c(job_id) if job_id else F.lit(None).cast("string")).alias("_id"))
    line = lambda label, col: F.when(F.coalesce(F.col(col), F.lit("")) != "", F.concat(F.lit(label + ": "), F.col(col)))
    return work.withColumn("ref_lines", keep_present(line("Job ID", "_id"), line("Department", "department"), line("Location", "location"))).drop("_id")


def discipline_of(col: str | Column, rules=tuple(R.DISCIPLINES)) -> Column:
    def first(t):
        out = F.lit("")
        for name, pattern in reversed(list(rules)):
            out = F.when(t.rlike(pattern), name).otherwise(out)
        return out

    return let(F.lower(c(col)), first)


def field_of(col: str | Column, shapes=tuple(R.ROLE_SHAPES), fields=tuple(R.FIELDS)) -> Column:
    """The field of work a title names: by the shape of the role, else by the first matching field; '' for none."""
    return discipline_of(col, (*shapes, *fields))


def recruiter_covers(col: str | Column) -> Column:
    """The discipline a recruiter's title names besides recruiting; '' for others."""
    t = F.lower(c(col))
    tech = t.rlike(r"(?:^|[^a-z0-9_])(?:tech(?:nical)?|eng)(?:$|[^a-z0-9_])")
    named = let(discipline_of(sub(t, R.RECRUITING_WORDS, " ")), lambda d: F.when((d == "") & tech, "engineering").when(d == "hr", "").otherwise(d))
    return F.when(~t.rlike(R.RECRUITING), "").otherwise(named)


def discipline(titles: DataFrame, title: str = "title") -> DataFrame:
    """(title, field, discipline, covers) per distinct title."""
    return titles.select(title).distinct().withColumn("field", field_of(title)).withColumn("discipline", discipline_of(title)).withColumn("covers", recruiter_covers(title))


def norm_company(col: str | Column) -> Column:
    t = sub(sub(F.lower(c(col)), "&", " and "), r"[^a-z0-9 ]+", " ")
    return F.array_join(F.filter(F.split(t, " +"), lambda w: (w != "") & ~w.isin(R.COMPANY_WORDS)), " ")


def company_agrees(a: str | Column, b: str | Column) -> Column:
    """Equal or one containing the other after normalising; NULL when either is unknown."""
    both = F.struct(norm_company(a).alias("x"), norm_company(b).alias("y"))
    return let(both, lambda n: F.when((n["x"] != "") & (n["y"] != ""), n["x"].contains(n["y"]) | n["y"].contains(n["x"])))


def company_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, company: str = "company") -> DataFrame:
    """(left_id, right_id, agrees): pairs whose normalised names are equal or one is a run of whole words inside the other.

    Distinct names are matched first: equal ones by equality, whatever their length, and shorter ones as
    word n-grams of longer ones, so both directions are equi-joins. N-grams have the
    lengths of the other side's names. Rows meet by the name pairs at the end. Rows without a usable name give no pair.
    """
    l = left.select(left_id, norm_company(company).alias("_n")).where("_n <> ''")
    r = right.select(right_id, norm_company(company).alias("_m")).where("_m <> ''")
    names, others = l.select("_n").distinct(), r.select("_m").distinct()

    def inside(df, name, found_in, gram):
        sized = df.withColumn("_sizes", lengths(found_in, gram, " "))
        return sized.select(name, F.explode(word_ngrams(F.split(name, " "), F.col("_sizes"))).alias(gram))

    agree = inside(names, "_n", others, "_m").join(others, "_m").select("_n", "_m").unionByName(names.join(inside(others, "_m", names, "_n"), "_n").select("_n", "_m")).distinct()
    return l.join(agree, "_n").join(r, "_m").select(left_id, right_id).distinct().withColumn("agrees", F.lit(True))


def _points(cond: Column, n: int) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)


def title_features(title: str | Column) -> Column:
    """What a person's title says, whatever the posting: points, the disciplines it covers and is of, recruiter, sales."""
    t, tier = F.lower(c(title)), F.lit(0)
    for i, titles in reversed(list(enumerate(R.TITLE_TIERS))):
        hit = F.lit(False)
        for name in titles:
            hit = hit | t.contains(name)
        tier = F.when(hit, 30 - i * 8).otherwise(tier)
    points = (tier + _points(t.rlike("talent|recruit"), 10) + _points(t.rlike("head|lead|manager|director|principal|senior"), 4) - _points(t.rlike(r"intern(?:$|[^a-z0-9_])|assistant"), 6))
    return F.struct(points.alias("points"), recruiter_covers(title).alias("covers"), discipline_of(title).alias("own"),
                    t.rlike(r"talent|recruit|sourc|hiring manager|people partner|(?:^|[^a-z0-9_])hr(?:$|[^a-z0-9_])|human resources").alias("recruiter"),
                    t.rlike("sales|business development|account executive|partnerships").alias("sales"))


def candidate_score(pairs: DataFrame) -> Column:
    """Score of a person for a posting. Columns: title, company, country, city_text, confidence, verified, address; p_title, p_company, p_country, p_city, p_domain.

    What one side alone says takes most of the patterns. Rows may bring it, made before persons and postings were paired:
    title_known (``title_features``), company_name and p_company_name (``norm_company``), p_role (``discipline_of`` p_title).
    """
    def given(name, made):
        return (F.col(name) if name in pairs.columns else made).alias(name)

    both = F.struct(given("title_known", title_features("title")), given("p_role", discipline_of("p_title")), given("company_name", norm_company("company")), given("p_company_name", norm_company("p_company")))

    def fit(n):
        t, role, x, y = n["title_known"], n["p_role"], n["company_name"], n["p_company_name"]
        disc = F.when((role != "") & (t["covers"] != ""), F.when(t["covers"] == role, 16).otherwise(-18)).when(
            (role != "") & ~t["recruiter"] & (t["own"] != ""), F.when(t["own"] == role, 14).otherwise(-12)).otherwise(0)
        agrees = F.when((x != "") & (y != ""), F.when(x.contains(y) | y.contains(x), 18).otherwise(-60)).otherwise(0)
        return t["points"] + disc - _points((role != "sales") & t["sales"], 25) + agrees

    country = F.when(F.col("country").isNotNull() & F.col("p_country").isNotNull(), F.when(F.col("country") == F.col("p_country"), 14).otherwise(-30)).otherwise(0)
    personal = F.lower("address").rlike(R.PERSONAL_DOMAIN)
    mail = F.when(F.col("address").isNull(), 0).when(personal, -20).otherwise(6 + _points(F.lower("address").endswith(F.concat(F.lit("@"), F.col("p_domain"))), 8))
    return big(let(both, fit) + country + _points(F.lower("city_text").contains(F.lower("p_city")), 12) + F.coalesce(F.round(F.col("confidence") / 10), F.lit(0)) + _points(F.col("verified"), 5) + mail)


def rank_candidates(pairs: DataFrame, posting: str = "posting_id", top: int = 5) -> DataFrame:
    """(posting, address, score, rank): best score per address, best ``top`` addresses per posting."""
    scored = pairs.where("address is not null").withColumn("score", candidate_score(pairs)).groupBy(posting, F.lower("address").alias("address")).agg(F.max("score").alias("score"))
    return keep_last(scored, [posting], top, [F.desc("score"), F.col("address")], "rank")


def first_tier(rows: DataFrame, key: str, tier: str = "tier") -> DataFrame:
    """Rows of each key's lowest tier. A tiny aggregate is joined back, so a hot key is never gathered."""
    best = rows.groupBy(key).agg(F.min(tier).alias(tier))
    return rows.join(best, [key, tier])


_EXACT_ADDRESS = r"(?i)^[^ @,;<>()\[\]]+@[^ @,;<>()\[\]]+\.[a-z]{2,}$"


def scan_payloads(payloads: DataFrame, key: str = "payload_id", payload: str = "payload", depth: int = 8) -> DataFrame:
    """(key, name, title, company, location, address): any address at any depth up to ``depth``, with the nearest enclosing fields.

    Levels are arrays inside the row: each object passes its name, title, company and place down
    to its children, and no level is exploded or shuffled.
    """
    fields = ["name", "title", "company", "location"]
    names = {"name": ["full_name", "name", "fullName"], "title": ["title", "job_title", "jobTitle", "headline", "position"],
             "company": ["company.name", "company", "company_name", "organization"], "location": ["location", "city", "country"]}

    def text(v, path):
        s = F.try_variant_get(v, f"$.{path}", "string")
        return F.when(~s.startswith("{") & ~s.startswith("["), F.nullif(F.trim(s), F.lit("")))

    def own(v, field):
        options = [text(v, p) for p in names[field]]
        if field == "name":
            options.append(F.nullif(F.concat_ws(" ", F.coalesce(text(v, "first_name"), text(v, "firstName")), F.coalesce(text(v, "last_name"), text(v, "lastName"))), F.lit("")))
        return F.coalesce(*options)

    def with_context(s):
        return F.struct(s["v"].alias("v"), *[F.coalesce(own(s["v"], f), s[f]).alias(f) for f in fields])

    def children(s):
        return F.transform(variant_children(s["v"]), lambda k: F.struct(k.alias("v"), *[s[f].alias(f) for f in fields]))

    def addresses(s):
        strings = F.filter(F.transform(variant_children(s["v"]), lambda k: F.trim(k.try_cast("string"))), lambda x: x.rlike(_EXACT_ADDRESS))
        return F.transform(strings, lambda a: F.struct(*[F.coalesce(s[f], F.lit("")).alias(f) for f in fields], a.alias("address")))

    root = F.struct(F.col("_v").alias("v"), *[F.lit(None).cast("string").alias(f) for f in fields])
    work = payloads.select(key, F.try_parse_json(c(payload)).alias("_v")).where("_v is not null").select(key, F.array(with_context(root)).alias("_l0"))
    for i in range(depth):
        work = work.withColumn(f"_l{i + 1}", F.transform(F.flatten(F.transform(f"_l{i}", children)), with_context))
    hits = F.concat(*[F.flatten(F.transform(f"_l{i}", addresses)) for i in range(depth + 1)])
    return work.select(key, F.inline(hits)).groupBy(key, F.lower("address").alias("_k")).agg(F.min_by(F.struct(*fields, "address"), F.struct(*fields)).alias("_b")).select(key, "_b.*")


def render(rows: DataFrame, template: Sequence[str], tokens: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """(keys, body, unfilled): ``{{token}}`` lines filled from columns; lines of empty tokens go, and so do the labels that introduce them."""
    def fill(line):
        out = F.lit(line)
        for name, column in tokens.items():
            out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(F.col(column).cast("string"), F.lit("")))
        return out

    def only_tokens(line):
        import re

        return "{{" in line and not re.sub(r"\{\{[^}]*\}\}", "", line).strip(" ,;:.-|()[]")

    made = []
    for i, line in enumerate(template):
        text = fill(line)
        drop = F.trim(text).rlike(r"^[ ,;:.\-|()\[\]]*$") if only_tokens(line) else F.lit(False)
        if line.rstrip().endswith(":") and i + 1 < len(template) and only_tokens(template[i + 1]):
            drop = drop | (F.trim(fill(template[i + 1])) == "")
        made.append(F.when(~drop, text))
    body = F.array_join(keep_present(*made), "\n")
    body = F.trim(sub_all(body, [(r"\( *\)|\[ *\]", ""), (r"[ \t]+([,.;:])", "$1"), (r", *([.,])", "$1"), (r"([,;:])\1+", "$1"), (r"\. *\.", "."), (r"[ \t]+(\n|\z)", "$1"), (r"\n{3,}", "\n\n")]))
    return rows.select(*keys, body.alias("body")).withColumn("unfilled", F.array_distinct(picks("body", r"(\{\{[ ]*[A-Za-z_]+[ ]*\}\})")))


def send_policy(log: DataFrame, requests: DataFrame, bucket: str = "day", burst: int = R.SEND_BURST, gap_days: int = R.SEND_GAP_DAYS,
                window_max: int = R.SEND_WINDOW_MAX, window_days: int = R.SEND_WINDOW_DAYS) -> DataFrame:
    """(request_id, allowed, reason, next_eligible, sent, burst_left) for requests against an earlier send log.

    ``log``: company, job_key, at. ``requests``: request_id, company, job_key, at. One posting is
    never written to twice; ``window_max`` notes per rolling window; after ``burst`` notes a gap.
    Each request brings a probe row at the window's start. Running counts over log rows, taken by
    time segments, give window counts by subtraction, so a company with a third of all rows is
    spread over its segments.
    """
    seconds = window_days * 86400
    base = log.select("company", F.col("at").cast("timestamp").alias("at"), F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("request_id"))
    asks = requests.select("company", F.col("at").cast("timestamp").alias("at"), F.lit(2).alias("kind"), big("request_id").alias("request_id"))
    probes = asks.withColumn("at", F.timestamp_micros(F.unix_micros("at") - seconds * 1_000_000)).withColumn("kind", F.lit(1))
    rows = base.unionByName(asks).unionByName(probes).withColumn("_seg", F.date_trunc(bucket, "at"))
    order = ["at", "kind", "request_id"]
    is_log = F.col("kind") == 0
    rows = running(rows, ["company"], "_seg", order, F.when(is_log, 1).otherwise(0), "_n")
    rows = neighbour(rows, ["company"], "_seg", order, F.col("at"), "_last", only=is_log)
    rows = neighbour(rows, ["company"], "_seg", order, F.col("at"), "_next", ahead=True, only=is_log)
    facts = rows.where("kind > 0").groupBy("request_id").agg(
        F.max(F.when(F.col("kind") == 2, F.col("_n"))).alias("_total"), F.max(F.when(F.col("kind") == 1, F.col("_n"))).alias("_before"),
        F.max(F.when(F.col("kind") == 2, F.col("_last"))).alias("_last"), F.max(F.when(F.col("kind") == 1, F.col("_next"))).alias("_oldest"))
    # The same posting, sent at or before the request.
    sent = log.groupBy("job_key").agg(F.min("at").alias("_sent_at"))
    out = requests.join(facts, "request_id").join(sent, "job_key", "left")
    same = F.coalesce(F.col("_sent_at") <= F.col("at"), F.lit(False))
    days = F.floor((F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros("_last")) / 86_400_000_000)
    full = F.col("_total") - F.col("_before") >= window_max
    early = (F.col("_total") >= burst) & (days < gap_days)
    later = lambda col, d: F.timestamp_micros(F.unix_micros(col) + d * 86_400_000_000)
    reason = F.when(same, "same_posting").when(full, "window").when(early, "gap").otherwise("ok")
    out = out.withColumn("reason", reason)
    return out.select("request_id", (F.col("reason") == "ok").alias("allowed"), "reason", F.when(F.col("reason") == "window", later("_oldest", window_days)).when(
        F.col("reason") == "gap", later("_last", gap_days)).alias("next_eligible"), big("_total").alias("sent"), big(F.greatest(F.lit(0), burst - F.col("_total"))).alias("burst_left"))


def domain_candidates(pages: DataFrame, company: str | None = None, platforms=tuple(P.PLATFORM_HOSTS), key: str = "page_id") -> DataFrame:
    """(page_id, domain, ord): up to three mail domains: the page's own host, or a platform's tenant slug, then the company's name."""
    work = detect_platform(pages, platforms)
    own = sub(host_of("url"), r"^(?:www|jobs|careers|apply|boards|job-boards)\.")
    slug = F.lower(F.regexp_extract(path_of("url"), r"^/+([^/]+)", 1))
    first = F.when(F.col("platform") == "", F.nullif(own, F.lit(""))).when(slug.rlike(r"^[a-z0-9][a-z0-9\-]{1,40}$") & (slug != "embed"), F.concat(slug, F.lit(".com")))
    name = sub(sub(F.lower(c(company)) if company else F.lit(""), r"(^|[^a-z0-9_])(?:inc|llc|ltd|limited|gmbh|plc|corp|corporation|co|company|group|holdings|technologies|technology|labs|ai)(?=$|[^a-z0-9_])", "$1"), r"[^a-z0-9]")
    named = F.length(name) >= 3
    all_ = F.slice(F.array_distinct(keep_present(first, F.when(named, F.concat(name, F.lit(".com"))), F.when(named, F.concat(name, F.lit(".io"))))), 1, 3)
    return work.select(key, F.posexplode(all_).alias("ord", "domain")).withColumn("ord", big(F.col("ord") + 1))


def payload_shapes(rows: DataFrame, source: str = "source", payload: str = "payload") -> DataFrame:
    """(source, shape, n): key and type shapes of JSON payloads; values never appear."""
    return rows.select(c(source).alias("source"), F.schema_of_variant(F.try_parse_json(c(payload))).alias("shape")).groupBy("source", "shape").agg(big(F.count("*")).alias("n"))


def target_titles(postings: DataFrame, key: str, title: str = "title", functions: Mapping[str, Sequence[str]] = R.FUNCTION_TITLES, tiers=tuple(tuple(t) for t in R.TITLE_TIERS)) -> DataFrame:
    """(key, tier, title, ord): titles worth looking up for a posting, de-duplicated in order: recruiters by tier, then its function's managers. A lookup table; no search is run."""
    fixed = [(f"recruiter_{i}", t) for i, group in enumerate(tiers) for t in group]
    base = F.array(*[F.struct(F.lit(tier).alias("tier"), F.lit(t).alias("title")) for tier, t in fixed])
    managers = F.lit(None).cast("array<struct<tier:string,title:string>>")
    for name, titles in functions.items():
        managers = F.when(F.col("_d") == name, F.array(*[F.struct(F.lit("manager").alias("tier"), F.lit(t).alias("title")) for t in titles])).otherwise(managers)
    listed = F.concat(base, F.coalesce(managers, F.array().cast("array<struct<tier:string,title:string>>")))
    rows = postings.select(key, discipline_of(title).alias("_d")).select(key, F.posexplode(listed).alias("ord", "_t"))
    return rows.select(key, "_t.tier", "_t.title", big(F.col("ord") + 1).alias("ord"))
