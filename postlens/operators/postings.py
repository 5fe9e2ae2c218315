"""Pages to postings: text, sections, identity, classification, structured data.

Every operator here works inside one row. None shuffles, so a page table of any size runs as
one narrow stage and a hot host or source costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import (
    big, c, first_of, found, hits, keep_present, let, literal_map, pick, picks, pieces, squeeze, sub, sub_all, word_array,
)
from postlens.rules import postings as R


def _alternatives(options: Sequence[str]) -> str:
    return "|".join(options)


# ---------------------------------------------------------------- text of a page

def without_chrome(html: str | Column, tags: Sequence[str] = tuple(R.DROPPED_TAGS),
                   classes: Sequence[str] = tuple(R.DROPPED_CLASSES),
                   roles: Sequence[str] = tuple(R.DROPPED_ROLES)) -> Column:
    """HTML without comments and without navigation, script, style and banner elements."""
    out = sub(html, r"(?s)<!--.*?-->", " ")
    if tags:
        out = sub(out, rf"(?is)<({_alternatives(tags)})[ \t\r\n>].*?</\1[ \t\r\n]*>", " ")
    if classes:
        out = sub(out, rf'(?is)<(div|section|aside|ul)[^>]*[ ]class="(?:[^"]*[ ])?(?:{_alternatives(classes)})(?:[ ][^"]*)?"[^>]*>.*?</\1>', " ")
    if roles:
        out = sub(out, rf'(?is)<(div|section|aside|ul)[^>]*[ ]role="(?:{_alternatives(roles)})"[^>]*>.*?</\1>', " ")
    return out


def tags_to_text(html: str | Column) -> Column:
    """Tag soup to text: a blank at block boundaries, entities decoded, white space squeezed."""
    return squeeze(sub_all(html, [
        (r"(?i)</(p|div|li|h[1-6]|tr|section|br)[^>]*>", " "),
        (r"(?i)<br[ \t\r\n]*/?>", " "),
        (r"<[^>]+>", ""),
        (r"(?i)&nbsp;", " "),
        (r"(?i)&lt;", "<"),
        (r"(?i)&gt;", ">"),
        (r"(?i)&#39;|&apos;", "'"),
        (r"(?i)&quot;", '"'),
        (r"(?i)&amp;", "&"),
    ]))


def pages_to_text(pages: DataFrame, **drop) -> DataFrame:
    """(page_id, url, text) of every page."""
    return pages.select("page_id", "url", tags_to_text(without_chrome("html", **drop)).alias("text"))


def normal_space(col: str | Column) -> Column:
    """One line break per break run, one blank per blank run, no blanks at line edges."""
    return F.trim(sub_all(col, [
        (r"[\r\n]+", "\n"), (r"[ \t ]+", " "), (r"\n ", "\n"), (r" \n", "\n"),
        (r"\A\n+|\n+\z", ""),
    ]))


def _last_start(text: Column, mark: str, limit: int) -> Column:
    """0-based start of the last ``mark`` that begins at or before ``limit``; -1 if none."""
    head = F.substring(text, 1, limit + len(mark))
    back = F.locate(mark[::-1], F.reverse(head))
    return F.when(back > 0, F.length(head) - back + 1 - len(mark)).otherwise(F.lit(-1))


def normalise_text(docs: DataFrame, text: str = "text", max_len: int | None = None) -> DataFrame:
    """Normalised white space; with ``max_len`` the text is also cut at a safe boundary."""
    clean = docs.withColumn(text, normal_space(text))
    if max_len is None:
        return clean.withColumn("was_cut", F.lit(False))
    col = F.col(text)
    para, sentence = _last_start(col, "\n\n", max_len), _last_start(col, ". ", max_len)
    cut = (
        F.when(para > max_len * 0.7, F.substring(col, F.lit(1), para))
        .when(sentence > max_len * 0.8, F.substring(col, F.lit(1), sentence + 1))
        .otherwise(F.substring(col, 1, max_len))
    )
    return clean.withColumn("was_cut", F.length(text) > max_len).withColumn(
        text, F.when(F.col("was_cut"), cut).otherwise(col))


def strip_boilerplate(docs: DataFrame, text: str = "text",
                      patterns: Sequence[str] = tuple(R.BOILERPLATE)) -> DataFrame:
    """Boilerplate sections become one line break; ``removed_chars`` counts what went."""
    before = F.length(normal_space(text))
    out = c(text)
    for pattern in patterns:
        out = sub(out, pattern, "\n$1")
    return (
        docs.withColumn("_before", before)
        .withColumn(text, normal_space(out))
        .withColumn("removed_chars", big(F.col("_before") - F.length(text)))
        .drop("_before")
    )


def classify_structure(docs: DataFrame, text: str = "text", section_cues: str = R.SECTION_CUES,
                       narrative_cues: str = R.NARRATIVE_CUES) -> DataFrame:
    """bullets, sections, narrative, phrases or raw_text."""
    body = c(text)
    long_words = F.filter(F.split(body, r"[ \t\r\n]+"), lambda w: F.length(w) >= 3)
    shaped = F.filter(long_words, lambda w: w.rlike(r"^[A-Za-z][A-Za-z0-9+#.\-]+$"))
    return docs.withColumn("structure", (
        F.when(hits(body, R.BULLET_MARK) >= 5, "bullets")
        .when(hits(body, rf"(?i)(?:{section_cues})[: \t\r\n]") >= 2, "sections")
        .when(hits(body, rf"(?i){narrative_cues}") >= 2, "narrative")
        .when(F.size(shaped) > 0.3 * F.size(long_words), "phrases")
        .otherwise("raw_text")))


def split_sections(docs: DataFrame, key: str, text: str = "text",
                   headings: Sequence[tuple[str, str]] = tuple(R.POSTING_HEADINGS)) -> DataFrame:
    """(key, section, ord, body): text between the first match of each heading; before it ``other``."""
    body = c(text)
    marks = []
    for name, words in headings:
        pattern = rf"(?i)(?:^|\n)(?:{words})[: \t\r\n]*"
        at = F.regexp_instr(body, F.lit(pattern))
        marks.append(F.struct(at.alias("at"), F.length(F.regexp_extract(body, pattern, 0)).alias("len"),
                              F.lit(name).alias("section")))
    work = docs.select(key, body.alias("_t"), F.array_sort(F.filter(F.array(*marks), lambda m: m["at"] > 0)).alias("_m"))
    starts = F.col("_m")

    def cut(m, i):
        begin = m["at"] + m["len"]
        end = F.when(i + 1 < F.size(starts), F.try_element_at(starts, i + 2)["at"]).otherwise(F.length("_t") + 1)
        # A heading inside the one before it leaves an empty body, as a slice would.
        return F.struct(m["section"].alias("section"), (i + 1).cast("bigint").alias("ord"),
                        F.trim(F.substring("_t", begin, F.greatest(end - begin, F.lit(0)))).alias("body"))

    first = F.try_element_at(starts, F.lit(1))["at"]
    other = F.when(first > 1, F.array(F.struct(
        F.lit("other").alias("section"), F.lit(0).cast("bigint").alias("ord"),
        F.trim(F.substring("_t", F.lit(1), first - 1)).alias("body")))).otherwise(F.array())
    return work.select(key, F.inline(F.concat(other, F.transform(starts, cut))))


# ---------------------------------------------------------------- structured data

LD_BODY = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'


def variant_children(node: Column) -> Column:
    """Direct children of a variant: array elements or object values."""
    return F.coalesce(
        node.try_cast("array<variant>"),
        F.map_values(node.try_cast("map<string,variant>")),
        F.array().cast("array<variant>"),
    )


def json_depth(body: Column) -> Column:
    """How deep the brackets of a JSON text nest, strings left out: one fold over its brackets."""
    brackets = sub_all(body, [(r"(?s)\\.", ""), (r'"[^"]*"', ""), (r"[^\[\]{}]+", "")])

    def step(seen, mark):
        depth = seen["at"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return let(depth, lambda d: F.struct(d.alias("at"), F.greatest(seen["most"], d).alias("most")))

    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step)["most"]


def variant_levels(bodies: Column) -> Column:
    """All nodes of the JSON texts in ``bodies``, breadth first, in one array; texts that are no JSON have none.

    A fold of as many steps as the texts nest reaches every level, so a wide text costs what it holds.
    """
    steps = F.coalesce(F.array_max(F.transform(bodies, json_depth)), F.lit(0))
    roots = F.filter(F.transform(bodies, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())
    start = let(roots, lambda r: F.struct(r.alias("level"), r.alias("all")))

    def deeper(seen, _):
        below = F.flatten(F.transform(seen["level"], variant_children))
        return let(below, lambda n: F.struct(n.alias("level"), F.concat(seen["all"], n).alias("all")))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, deeper)["all"]


def _var(node: Column, path: str) -> Column:
    """The text at a path, NULL when empty. Markup is taken out only where there is some; each step is bound, so none runs twice."""
    plain = let(F.try_variant_get(node, path, "string"), lambda v: F.when(v.contains("<") | v.contains("&"), tags_to_text(v)).otherwise(squeeze(v)))
    return let(plain, lambda t: F.when(t != "", t))


def _var_or_child(node: Column, path: str, child: str) -> Column:
    """The value when it is text, else the named child of the object."""
    return F.coalesce(_var(node, f"{path}.{child}"),
                      F.when(~F.coalesce(F.try_variant_get(node, path, "string"), F.lit("")).startswith("{"), _var(node, path)))


def jsonld_postings(pages: DataFrame) -> DataFrame:
    """First non-empty value per field over all JobPosting objects of a page, at any depth."""
    def is_posting(n):
        return F.lower(F.coalesce(F.try_variant_get(n, "$['@type']", "string"), F.lit(""))).contains("jobposting")

    def first(found_, build):
        return F.try_element_at(F.filter(F.transform(found_, build), lambda v: v.isNotNull()), F.lit(1))

    def place(p):
        def part(name):
            return F.coalesce(*[_var_or_child(p, f"$.jobLocation{at}{inner}.{name}", "name")
                                for at in ("[0]", "") for inner in (".address", "")])
        joined = F.array_join(keep_present(part("addressLocality"), part("addressRegion"), part("addressCountry")), ", ")
        return let(joined, lambda j: F.when(j != "", j).when(_var(p, "$.jobLocationType").isNotNull(), F.lit("Remote")))

    def fields(found_):
        return F.when(F.size(found_) > 0, F.struct(
            first(found_, lambda p: _var(p, "$.title")).alias("title"),
            first(found_, lambda p: _var_or_child(p, "$.hiringOrganization", "name")).alias("company"),
            first(found_, lambda p: F.coalesce(_var(p, "$.hiringOrganization.url"),
                                               _var(p, "$.hiringOrganization.sameAs[0]"),
                                               _var(p, "$.hiringOrganization.sameAs"))).alias("org_url"),
            first(found_, place).alias("location"),
            first(found_, lambda p: _var(p, "$.description")).alias("description"),
            first(found_, lambda p: _var_or_child(p, "$.identifier", "value")).alias("job_id"),
        ))

    # One expression from the page to its row: a filter on the objects found would read the page a second time.
    row = let(F.filter(let(picks("html", LD_BODY), variant_levels), is_posting), fields)
    return pages.where(F.col("html").contains("application/ld+json")).select(
        "page_id", F.inline(F.filter(F.array(row), lambda r: r.isNotNull())))


# ---------------------------------------------------------------- identity

def host_of(url: str | Column) -> Column:
    return sub(F.regexp_extract(F.lower(c(url)), r"^[a-z][a-z0-9+.\-]*://([^/?#:]+)", 1), r"^www\.|\.$", "")


def path_of(url: str | Column) -> Column:
    return F.coalesce(pick(c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+(/[^?#]*)"), F.lit("/"))


def domain_of(host: Column) -> Column:
    """Last two labels, three under suffixes such as co.uk."""
    parts = F.split(host, r"\.")
    last2 = F.array_join(F.slice(parts, -2, 2), ".")
    return (
        F.when(F.size(parts) <= 2, host)
        .when(last2.rlike(r"^(co|com|org|net|ac|gov)\.[a-z]{2}$"), F.array_join(F.slice(parts, -3, 3), "."))
        .otherwise(last2)
    )


def detect_platform(pages: DataFrame, platforms: Sequence[tuple[str, Sequence[str]]] = tuple(R.PLATFORM_HOSTS),
                    url: str = "url") -> DataFrame:
    """Platform whose fragment equals the host or a parent domain; first in table order; '' if none.

    The few host suffixes of a url are looked up in a literal map: label boundaries hold by
    construction, and there is neither a join nor a shuffle. Fragments with a path are tested
    as a url prefix.
    """
    order: dict[str, int] = {}
    names = [name for name, _ in platforms]
    path_tests: list[Column] = []
    for i, (_, fragments) in enumerate(platforms):
        for fragment in fragments:
            if "/" in fragment:
                path_tests.append(F.when(F.lower(url).contains("//" + fragment), F.lit(i)))
            else:
                order.setdefault(fragment, i)
    suffixes = let(F.split(host_of(url), r"\."), lambda parts: F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    ranks = F.transform(suffixes, lambda s: F.try_element_at(literal_map(order), s))
    best = F.array_min(F.concat(ranks, F.array(*path_tests)) if path_tests else ranks)
    return pages.withColumn("platform", F.coalesce(F.try_element_at(word_array(names), best + 1), F.lit("")))


def url_job_id(url: str | Column, platform_ids: Sequence[str] = tuple(R.PLATFORM_JOB_IDS),
               generic: Sequence[str] = tuple(R.GENERIC_JOB_IDS)) -> Column:
    return first_of(*[pick(url, p) for p in [*platform_ids, *generic]])


def extract_job_id(postings: DataFrame, text: str = "text", url: str = "url",
                   platform_ids: Sequence[str] = tuple(R.PLATFORM_JOB_IDS)) -> DataFrame:
    """Requisition id and the rung of the ladder that gave it: label, platform, generic or none."""
    label = first_of(*[pick(text, p) for p in R.TEXT_JOB_IDS])
    own = first_of(*[pick(url, p) for p in platform_ids])
    common = first_of(*[pick(url, p) for p in R.GENERIC_JOB_IDS])
    return postings.withColumn("_l", label).withColumn("_o", own).withColumn("_g", common).withColumn(
        "job_id", F.coalesce("_l", "_o", "_g", F.lit(""))).withColumn(
        "via", F.when(F.col("_l").isNotNull(), "label").when(F.col("_o").isNotNull(), "platform")
        .when(F.col("_g").isNotNull(), "generic").otherwise("none")).drop("_l", "_o", "_g")


def base_path(path: Column) -> Column:
    tails = _alternatives(R.APPLY_TAILS)
    cut = sub(sub(path, r"/+$", ""), rf"(?i)(?:/(?:{tails}|step[0-9]*|c)){{1,4}}$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("/"))


def posting_key(pages: DataFrame, url: str = "url",
                platform_ids: Sequence[str] = tuple(R.PLATFORM_JOB_IDS)) -> DataFrame:
    """``id:<domain>:<job id>`` when the url carries an id, else ``path:<domain>:<de-applied path>``."""
    return (
        pages.withColumn("host", host_of(url))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("base_path", F.lower(base_path(path_of(url))))
        .withColumn("_id", F.lower(url_job_id(url, platform_ids)))
        .withColumn("posting_key", F.when(F.col("_id").isNotNull(), F.concat_ws(":", F.lit("id"), "domain", "_id"))
                    .otherwise(F.concat_ws(":", F.lit("path"), "domain", "base_path")))
        .drop("_id")
    )


def classify_page(pages: DataFrame, thank_you_urls: Sequence[str] = tuple(R.THANK_YOU_URLS),
                  thank_you_texts: Sequence[str] = tuple(R.THANK_YOU_TEXTS),
                  apply_words: Sequence[str] = tuple(R.APPLY_URL_WORDS),
                  listing_urls: Sequence[str] = tuple(R.LISTING_URLS),
                  listing_words: Sequence[str] = tuple(R.LISTING_WORDS)) -> DataFrame:
    """thank_you, application, listing or other."""
    url, html = F.lower("url"), F.col("html")
    body = F.lower(tags_to_text(sub(html, r"(?is)<(script|style)[ \t\r\n>].*?</\1[ \t\r\n]*>", " ")))
    heads = F.lower(F.array_join(picks(html, r"(?is)<h[12][^>]*>(.*?)</h[12]>"), " "))
    work = pages.withColumn("_b", body).withColumn("_h", heads)

    def any_in(col, options):
        out = F.lit(False)
        for option in options:
            out = out | col.contains(option)
        return out

    thanks = any_in(url, thank_you_urls)
    for cue in thank_you_texts:
        at = F.instr(F.col("_b"), cue)
        thanks = thanks | ((at > 0) & (F.col("_h").contains(cue) | (at <= 500)))
    fields = hits(html, r"(?i)<(?:input|select|textarea)[ \t\r\n>/]") - hits(
        html, r'(?i)<input[^>]*type="?(?:hidden|submit)"?')
    files = hits(html, r'(?i)<input[^>]*type="?file"?')
    form = ((fields >= 6) | (files >= 1)) & (F.length("_b") < 400)
    apply_url = url.rlike(rf"(?:/|[?&#])(?:{_alternatives(apply_words)})(?:[^a-z0-9]|$)")
    button = html.rlike(r'(?i)<a[^>]*href="[^"]*apply|<button[^>]*class="[^"]*apply|data-automation-id="[^"]*apply')
    listing = (button & any_in(F.col("_b"), listing_words)) | any_in(url, listing_urls)
    return work.withColumn("page_class", F.when(thanks, "thank_you").when(apply_url | form, "application")
                           .when(listing, "listing").otherwise("other")).drop("_b", "_h")


# ---------------------------------------------------------------- titles, merging, parts

_W0 = "[ \t]*"
_FURNITURE = rf"(?i)^(?:{R.TITLE_FURNITURE})(?:[^A-Za-z0-9_]|$)"
TITLE_STEPS = [
    (r"(?i)[ \t]+(?:at|@|with)[ \t]+[A-Z][A-Za-z0-9_&.,' \-]{1,40}$", ""),
    (r"(?i)[ \t,\-]+(?:careers?|jobs?|job board|openings?)[ \t]*$", ""),
]
TITLE_NUMBERS = [
    (r"(?i)^[ \t\-|,]*\(?[ \t]*(?:req(?:uisition)?\.?[ \t]*(?:id|no\.?|#)?[ \t]*)?#?[0-9]{3,10}[ \t]*\)?[ \t\-|,:]*", ""),
    (r"(?i)^[ \t\-|,]*(?:JR|R|REQ|JOB)[-_]?[0-9]{3,10}(?:[ \t\-|,:]+|$)", ""),
    (r"(?i)[ \t\-|,(]*(?:req(?:uisition)?\.?[ \t]*(?:id|no\.?|#)?[ \t]*|[ \t\-|,(])#?[0-9]{4,10}\)?[ \t]*$", ""),
    (r"(?i)[ \t]*[-|(][ \t]*(?:remote|hybrid|on-?site|full[- ]?time|part[- ]?time|contract|permanent|temporary|fte)(?:[^A-Za-z0-9_)][^)]*)?\)?[ \t]*$", ""),
    (r"[ \t]*[-|][ \t]*[A-Z][a-z]+(?:,[ \t]*[A-Z]{2,})?[ \t]*$", ""),
    (r"[ \t\-|,:]+$", ""),
    (r"^[ \t\-|,:]+", ""),
]


def normalise_title(raw: str | Column) -> Column:
    """A scraped page title reduced to the role; '' when only furniture is left."""
    t = squeeze(raw)
    segs = pieces(t, r"[ \t]*[|·•‧–—][ \t]*|[ \t]+-[ \t]+")
    segs = F.filter(F.transform(segs, lambda s: F.trim(s)), lambda s: s != "")
    tail = F.array_join(F.slice(segs, 2, 1000), " ")
    lead = F.try_element_at(segs, F.lit(1))
    furniture = tail.rlike(_FURNITURE) | tail.rlike(
        r"(?i)(?:^|[^A-Za-z0-9_])(?:careers?|jobs?|hiring|apply|openings?)(?:[^A-Za-z0-9_]|$)") | (F.size(segs) > 2)
    t = F.when((F.size(segs) > 1) & furniture & (F.length(lead) >= 3), lead).otherwise(t)
    t = sub_all(t, TITLE_STEPS)
    done = squeeze(sub_all(t, TITLE_NUMBERS))
    return F.when(F.trim(t).rlike(_FURNITURE), F.lit("")).otherwise(done)


def normalise_titles(postings: DataFrame, title: str = "title") -> DataFrame:
    return postings.withColumn(title, normalise_title(title))


def usable(col: str | Column) -> Column:
    """NULL for blanks and for page labels such as "Apply" or "Sign in"."""
    t = F.trim(c(col))
    return F.when((t != "") & ~F.lower(t).isin(R.PAGE_LABELS), t)


def merge_postings(sources: Sequence[DataFrame], key: str = "posting_key") -> DataFrame:
    """One posting per key from sources in falling trust (one row per key each): first usable field, longest description.

    Keys of every source are kept. The sources are stacked and folded in one aggregation over
    narrow rows. The winning descriptions are fetched by key and source, so texts are shuffled once, for
    that join, and never sorted in windows.
    """
    fields = ["title", "company", "location", "job_id"]
    stacked = None
    for rank, df in enumerate(sources):
        row = df.select(key, F.lit(rank).alias("_r"), *[usable(f).alias(f) for f in fields], F.coalesce("description", F.lit("")).alias("description"))
        stacked = row if stacked is None else stacked.unionByName(row)
    # Longest text first, the more trusted source on ties, as one number.
    worth = F.length("description").cast("bigint") * len(sources) - F.col("_r")
    best = stacked.groupBy(key).agg(
        *[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_r"))).alias(f) for f in fields],
        F.max_by("_r", worth).alias("_r"), big(F.count("*")).alias("sources"),
    )
    return best.join(stacked.select(key, "_r", "description"), [key, "_r"]).drop("_r")


def fingerprint(docs: DataFrame, text: str = "text", sample: int | None = None) -> DataFrame:
    """``fp`` equal for equal texts; NULL below 50 characters.

    By default the whole text is digested. ``sample`` hashes only the first and last that many
    characters and the length, which is cheaper and merges texts that differ in the middle.
    """
    body = c(text)
    if sample is None:
        value = F.md5(body)
    else:
        value = F.md5(F.concat_ws("\u0001", F.substring(body, 1, sample), F.right(body, F.lit(sample)), F.length(body)))
    return docs.withColumn("fp", F.when(F.length(body) >= 50, value))


def collapse_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int | None = None) -> DataFrame:
    """One row per distinct text: lowest key, number of copies, length. Partial aggregation absorbs hot texts."""
    return (
        fingerprint(docs, text, sample).where(F.col("fp").isNotNull())
        .groupBy("fp").agg(F.min(key).alias(key), big(F.count("*")).alias("copies"), big(F.max(F.length(text))).alias("n_chars"))
    )


def assemble_parts(pages: DataFrame, parts: Sequence[tuple[str, int, str, int]], platform: str = "platform") -> DataFrame:
    """(page_id, ord, weight, text) of the description parts of the page's platform; '' rules are the fallback."""
    own = {p for p, *_ in parts if p}
    rules = []
    for name, ord_, pattern, weight in parts:
        applies = F.col(platform) == name if name else ~F.coalesce(F.col(platform), F.lit("")).isin(sorted(own))
        texts = F.when(applies, F.transform(picks("html", pattern), tags_to_text)).otherwise(F.array().cast("array<string>"))
        rules.append(F.struct(F.lit(ord_).cast("bigint").alias("ord"), F.lit(weight).cast("bigint").alias("weight"),
                              F.array_join(F.filter(texts, lambda t: t != ""), " ").alias("text")))
    return pages.select("page_id", F.inline(F.filter(F.array(*rules), lambda r: r["text"] != "")))


def assembled_description(pages: DataFrame, parts: Sequence[tuple[str, int, str, int]], platform: str = "platform") -> DataFrame:
    """(page_id, description): the parts of a page in rule order, joined."""
    rows = assemble_parts(pages, parts, platform)
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), " ").alias("description"))


def page_links(pages: DataFrame, handle_pattern: str | None = None, drop_chrome: bool = True) -> DataFrame:
    """(page_id, href, text, host, is_external, handle), one row per distinct target of a page."""
    html = without_chrome("html") if drop_chrome else F.col("html")
    anchors = picks(html, r"(?is)(<a[ \t\r\n][^>]*href=[^>]*>.*?</a>)")
    made = F.filter(F.transform(anchors, lambda a: F.struct(
        F.trim(F.regexp_extract(a, r"""(?is)href=["']?([^"'> ]+)""", 1)).alias("href"),
        tags_to_text(a).alias("text"))), lambda s: s["href"] != "")
    work = pages.select("page_id", host_of("url").alias("_own"), made.alias("_a"))
    once = let(F.transform("_a", lambda s: s["href"]), lambda targets: F.filter(
        "_a", lambda s, i: F.array_position(targets, s["href"]) == i + 1))
    out = work.select("page_id", "_own", F.inline(once)).withColumn("host", F.coalesce(
        F.nullif(host_of("href"), F.lit("")), F.col("_own")))
    handle = F.regexp_extract("href", handle_pattern, 1) if handle_pattern else F.lit("")
    return out.select("page_id", "href", "text", "host", (F.col("host") != F.col("_own")).alias("is_external"),
                      handle.alias("handle"))


_SHAPES = [
    r"(?i)(?:^|[^A-Za-z0-9_])(?:remote|hybrid|on-?site)(?:$|[^A-Za-z0-9_])",
    r"[A-Z][a-z]+,[ \t]*[A-Z]",
    r"(?i)(?:^|[^A-Za-z0-9_])(?:US|USA|United States|UK|Canada|Australia|Germany|France|Ireland)(?:$|[^A-Za-z0-9_])",
]


def location_candidates(postings: DataFrame, text: str = "text", limit: int | None = None,
                        patterns: Sequence[tuple[str, str]] = tuple(R.LOCATION_PATTERNS)) -> DataFrame:
    """First place-shaped span by pattern order; "Remote" when there is none. ``limit`` reads only a head of the text."""
    body = F.substring(c(text), 1, limit) if limit else c(text)
    name, raw = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, pattern in reversed(patterns):
        value = F.trim(F.regexp_extract(body, pattern, 1))
        ok = F.length(value) > 2
        name, raw = F.when(ok, F.lit(label)).otherwise(name), F.when(ok, value).otherwise(raw)
    work = postings.withColumn("raw_location", F.coalesce(raw, F.lit("Remote"))).withColumn(
        "pattern", F.coalesce(name, F.lit("default")))
    shaped = F.lit(False)
    for shape in _SHAPES:
        shaped = shaped | found("raw_location", shape)
    return work.withColumn("place_shaped", shaped & F.length("raw_location").between(2, 200))
