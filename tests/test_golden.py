"""Golden cases: small inputs whose results follow from the rules."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from postlens.functions.joins import sieve
from postlens.operators import history as H
from postlens.operators import matching as E
from postlens.operators import people as I
from postlens.operators import places as L
from postlens.operators import postings as P
from postlens.operators import quality as Q
from postlens.operators import records as G
from postlens.operators import terms as T
from postlens.rules import quality as QR
from postlens.sources import landing
from postlens.streaming import activity as J
from tests.conftest import rows


def text_df(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_platform_needs_a_label_boundary(spark):
    df = spark.createDataFrame([(1, "https://x.greenhouse.io/a"), (2, "https://greenhouse.io.evil.example/a"), (3, "https://notgreenhouse.io/"), (4, "https://app.dover.io/x")], "page_id long, url string")
    assert [r.platform for r in P.detect_platform(df).orderBy("page_id").collect()] == ["greenhouse", "", "", "dover"]


def test_posting_key_drops_apply_tails(spark):
    df = spark.createDataFrame([(1, "https://jobs.acme.co.uk/roles/dev/apply/step2/"), (2, "https://boards.greenhouse.io/acme/jobs/1234567?x=1"), (3, "https://acme.com/roles/dev")], "page_id long, url string")
    got = [r.posting_key for r in P.posting_key(df).orderBy("page_id").collect()]
    assert got == ["path:acme.co.uk:/roles/dev", "id:greenhouse.io:1234567", "path:acme.com:/roles/dev"]


def test_jsonld_nesting_and_broken_bodies(spark):
    tag = '<script type="application/ld+json">%s</script>'
    pages = [(1, tag % '{"@type":"JobPosting","title":"Dev","hiringOrganization":"Acme","jobLocationType":"TELECOMMUTE"}'),
             (2, tag % '{"@graph":[{"@type":"WebPage"},{"@type":["JobPosting"],"title":"Ops","identifier":{"value":"R1"},"jobLocation":[{"address":{"addressLocality":"Cork","addressCountry":{"name":"IE"}}}]}]}'),
             (3, tag % "{broken"), (4, "<p>none</p>")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = {r.page_id: r for r in P.jsonld_postings(df).collect()}
    assert set(got) == {1, 2}
    assert (got[1].company, got[1].location) == ("Acme", "Remote")
    assert (got[2].title, got[2].location, got[2].job_id) == ("Ops", "Cork, IE", "R1")


def test_page_classes(spark):
    html = "<h1>Thank you for applying</h1>"
    form = "<form>" + "<input type=text>" * 6 + "</form>"
    df = spark.createDataFrame([(1, "https://a.b/x", html), (2, "https://a.b/x/apply", ""), (3, "https://a.b/x", form), (4, "https://a.b/jobs/dev", "<p>hi</p>"), (5, "https://a.b/x", "<p>hi</p>")], "page_id long, url string, html string")
    assert [r.page_class for r in P.classify_page(df).orderBy("page_id").collect()] == ["thank_you", "application", "application", "listing", "other"]


def test_safe_truncation(spark):
    text = "a" * 85 + ". " + "b" * 50
    got = P.normalise_text(text_df(spark, text, "short"), max_len=100).orderBy("doc_id").collect()
    assert got[0].text == "a" * 85 + "." and got[0].was_cut and not got[1].was_cut


def test_whole_word_terms_only(spark):
    df = text_df(spark, "going for C++ and .NET, CI/CD with node.js. C# too", "go r")
    terms = spark.createDataFrame([(t, "x") for t in ["go", "r", "c++", ".net", "ci/cd", "node.js", "c#"]], "term string, category string")
    got = T.dictionary_hits(df, terms)
    assert sorted((r.doc_id, r.term) for r in got.collect()) == sorted([(0, t) for t in ["c++", ".net", "ci/cd", "node.js", "c#"]] + [(1, "go"), (1, "r")])


def test_tech_weight_closed_form(spark):
    def loop(n):
        w = 0
        for _ in range(n):
            w = (w + 1) * 5
        return w
    got = spark.range(1, 12).select("id", T.tech_weight(F.col("id")).alias("w")).collect()
    assert all(abs(r.w - loop(r.id)) < 1e-6 * loop(r.id) for r in got)


def test_split_glued():
    vocab = ["javascript", "kubernetes", "python"]
    assert T.split_glued("pythonkubernetesops", vocab, frozenset()) == ["kubernetes", "python", "ops"]
    assert T.split_glued("zzzz", vocab, frozenset()) == ["zzzz"]


def test_hard_skills(spark):
    df = text_df(spark, "Mechanical engineering, industrial engineering. Lead root cause analysis. Experience with SolidWorks and AutoCAD. ISO 9001. Quality assurance audits; quality assurance. Own CAD/CAM software.")
    got = {r.skill for r in T.hard_skills(df).collect()}
    assert {"mechanical engineering", "industrial engineering", "root cause analysis", "solidworks", "autocad", "iso 9001", "quality assurance"} <= got
    assert "cause analysis" not in got and "quality assurance audits" not in got and "cad/cam software" in got


def test_soft_skill_forms(spark):
    df = text_df(spark, "strong communication skills and negotiating; organisational talent, detail-oriented")
    got = {r.skill: r.matched_form for r in T.soft_skills(df).collect()}
    assert got["communication skills"] == "communication" and got["negotiation"] == "negotiating" and "detail-oriented" in got


def test_acronyms(spark):
    df = text_df(spark, "We need Anti-Money Laundering (AML), Continuous Integration and Delivery (CID), modern tools (SQL) and Data (AI)")
    assert sorted((r.short, r.long) for r in T.acronym_pairs(df).collect()) == [("AML", "Anti-Money Laundering"), ("CID", "Continuous Integration and Delivery")]


def test_absent_band_scores_100(spark):
    frame = spark.createDataFrame([(1, 1, ["sql", "java"], ["high", "low"], ["sql"])], "item_id int, doc_id int, terms array<string>, bands array<string>, matched array<string>")
    r = E.weighted_match(frame, ["item_id", "doc_id"]).collect()[0]
    assert (r.high, r.medium, r.low, r.overall, r.score) == (100, 100, 0, 83, 75)


def test_title_signal_equals_brute_force(spark):
    titles = spark.createDataFrame([(1, "Data Platform Engineer"), (2, "Senior Nurse"), (3, "Head of Risk Control Audit")], "page_id long, title string")
    cvs = text_df(spark, "data engineer here", "platform data risk", "nurse", "risk audit things", "control audit risk")
    got = {(r.page_id, r.doc_id, r.coverage) for r in E.title_signal(titles, cvs).collect()}
    want = set()
    words = {1: {"data", "platform", "engineer"}, 2: {"nurse"}, 3: {"risk", "control", "audit"}}
    for r in cvs.collect():
        for p, w in words.items():
            pct = int(100 * len(w & set(r.text.split())) / len(w) + 0.5)
            if pct >= 60:
                want.add((p, r.doc_id, pct))
    assert got == want


def test_dropped_lines_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    lines = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "body")).withColumn("line_id", F.col("doc_id") * 1000 + F.col("n")).where("length(body) < 200")
    target = lines.where(F.col("line_id") % 3 != 0).withColumn("body", F.regexp_replace("body", " [a-z]+,", ","))
    got = {r.line_id for r in E.dropped_lines(lines, target, "source").collect()}
    s = [(r.source, r.line_id, set(r.st)) for r in lines.select("source", "line_id", E.stems("body").alias("st")).collect()]
    t = [(r.source, set(r.st)) for r in target.select("source", E.stems("body").alias("st")).collect()]
    want = {i for g, i, a in s if len(a) >= 4 and not any(h == g and b and max(len(a & b) / len(a), len(a & b) / len(b)) >= 0.45 for h, b in t)}
    assert got == want


@pytest.mark.parametrize("block", [40, 400, 1_000_000])
def test_dropped_lines_meet_block_by_block(spark, block):
    words = ["alpha", "bravo", "carol", "delta", "eagle", "fancy", "gamma", "hotel", "index", "jolly", "karma", "lemon", "mango", "noble", "ocean", "panda"]
    rows = [("g" if i % 5 else None, i, " ".join(words[(i * k * k + k) % 16] + str(i % 3) for k in range(1, 4 + i % 9))) for i in range(300)]
    lines = spark.createDataFrame(rows, "grp string, line_id long, body string")
    target = lines.where("line_id % 4 = 1").withColumn("body", F.regexp_replace("body", "a[a-z]+0 ", "zulu "))
    stems = lambda df: [(r.grp, r.line_id, set(r.st)) for r in df.select("grp", "line_id", E.stems("body").alias("st")).collect()]
    t = [(g, b) for g, _, b in stems(target) if b and g]
    want = {i for g, i, a in stems(lines) if len(a) >= 4 and not any(h == g and max(len(a & b) / len(a), len(a & b) / len(b)) >= 0.45 for h, b in t)}
    got = E.dropped_lines(lines, target, "grp", source_block=block, target_block=block)
    assert sorted(r.line_id for r in got.collect()) == sorted(want) and got.columns == lines.columns


@pytest.mark.parametrize("block", [100, 3000])
def test_dropped_lines_find_the_only_match_in_any_block(spark, block):
    letter = lambda n: "".join(chr(97 + n // 26 ** k % 26) for k in range(3))
    lines = spark.createDataFrame([("g", i, " ".join(letter(i) + x for x in "abcdefgh")) for i in range(600)], "grp string, line_id long, body string")
    target = lines.where("line_id % 3 > 0").withColumn("body", F.regexp_replace("body", "a (...)b (...)c ", "zulu xray "))
    got = E.dropped_lines(lines, target, "grp", source_block=block, target_block=block)
    assert sorted(r.line_id for r in got.collect()) == list(range(0, 600, 3))


def test_dropped_lines_make_no_rows_of_pairs(spark):
    body = " ".join(f"w{chr(97 + i)}rd" for i in range(20))
    lines = spark.range(4000).select(F.lit("g").alias("grp"), F.col("id").alias("line_id"), F.concat(F.lit(body + " x"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("body"))
    target = lines.where("line_id % 2 = 0")
    out = E.dropped_lines(lines, target, "grp")
    assert out.count() == 0 and "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_vocabulary_mirror_takes_the_longest(spark):
    postings = spark.createDataFrame([(1, "We use Machine Learning and PostgreSQL, MLOps")], "item_id long, text string")
    pairs = spark.createDataFrame([(1, 5, "ml and postgres fan")], "item_id long, doc_id long, cv_text string")
    r = E.mirror(pairs, E.canonical_terms(postings)).collect()[0]
    assert r.cv_text == "Machine Learning and PostgreSQL fan" and r.swaps == 2


def test_gaps_and_bridges(spark):
    postings = spark.createDataFrame([(1, "Must have: kubernetes in production for years\nexperience with python scripting")], "item_id int, text string")
    cvs = spark.createDataFrame([(1, "docker and python scripting")], "doc_id int, text string")
    got = {r.requirement: (r.covered, r.bridge) for r in E.gaps(spark.createDataFrame([(1, 1)], "item_id int, doc_id int"), postings, cvs).collect()}
    assert got["kubernetes in production for years"] == (False, "docker") and got["python scripting"] == (True, None)


@pytest.mark.parametrize("floor", [1, 30, 60, 100])
def test_covered_equals_brute_force(spark, floor):
    rng = random.Random(floor)
    wanted = {k: {f"t{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.choice([1, 2, 5, 20, 70]))} for k in range(40)}
    seen = {m: {f"t{int(rng.paretovariate(0.5)) % 80}" for _ in range(rng.randrange(40))} for m in range(150)}
    frame = lambda sets, name: spark.createDataFrame([(k, t) for k, ts in sets.items() for t in ts], f"{name} int, term string")
    got = {(r.k, r.m): (r.n, sorted(r.found)) for r in E.covered(frame(wanted, "k"), frame(seen, "m"), "k", "m", floor).collect()}
    assert got == {(k, m): (len(a), sorted(a & b)) for k, a in wanted.items() for m, b in seen.items() if int(100 * len(a & b) / len(a) + 0.5) >= floor}


def test_texts_meet_postings_in_blocks(spark):
    pairs = spark.range(700).selectExpr("id as item_id", "cast(id % 2 as int) as doc_id")
    payload = spark.range(700).selectExpr("id as item_id", "cast(id as string) as word")
    cvs = spark.createDataFrame([(0, "HAS 12 and 4"), (1, "has 13"), (2, "unused")], "doc_id int, text string")
    made = E.per_cv(pairs, payload, cvs, lambda t, p: F.struct(t.contains(F.concat(F.lit(" "), p["word"])).alias("hit")), block=100)
    assert {(r.item_id, r.doc_id) for r in made.where("hit").collect()} == {(12, 0), (4, 0), (1, 1), (13, 1)} and made.count() == 700


def test_pair_features_read_the_texts(spark):
    postings = spark.createDataFrame([(1, "Data Engineer", "A degree in data. SQL Java Go")], "item_id int, title string, text string")
    packed = spark.createDataFrame([(1, ["sql", "java", "cobol"])], "item_id int, terms array<string>")
    cv = "Ann\nData Engineer\n\nSummary: 30+ years of experience with sql and java\nWORK EXPERIENCE\nbuilt sql, 2019\nSKILLS\njava"
    cvs = spark.createDataFrame([(1, cv, cv.replace("java", "")), (2, "nothing here, BSc", "nothing")], "doc_id int, text string, original string")
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "item_id int, doc_id int")
    a, b = E.pair_features(pairs, packed, postings, cvs, 2024, original="original").orderBy("doc_id").collect()
    assert (a.proven, a.unsupported, a.title_matched, a.title_in_header, a.years_inflated, a.posting_degree, a.cv_degree) == (50, 1, True, True, True, True, False)
    assert (b.proven, b.unsupported, b.title_matched, b.title_in_header, b.years_inflated, b.posting_degree, b.cv_degree) == (None, 0, False, False, False, True, True)


def test_scorecard_and_gates(spark):
    base = dict(item_id=1, doc_id=1, score=90, matched=12, missing=1, density=2.0, stuffed=0, contact_complete=True, has_email=True, has_phone=True, has_profile_or_place=True, sections_complete=True, has_experience=True,
                has_education=True, has_skills=True, quantified=5, bullets=6, verb_coverage=80, title_matched=True, high=90, headings_missing=0, date_formats=2, tab_columns=False, years_inflated=False, posting_degree=True, cv_degree=False,
                unsupported=0, proven=50, title_in_header=True, header_email=True, header_phone=True, has_profile=True, top_weak=False, long_lines=0, weak_openers=0, duty_lines=0, quantified_lines=6, scope_lines=1, pronoun_lines=0)
    weak = dict(base, doc_id=2, contact_complete=False, quantified=1, high=50, stuffed=1)
    df = spark.createDataFrame([base, weak])
    a, b = E.scorecard(df, ["item_id", "doc_id"]).orderBy("doc_id").collect()
    assert (a.adjusted, a.confidence, a.reliable, a.deductions) == (90, "MEDIUM", True, [])
    assert b.adjusted == 90 - 8 - 5 - 4 - 3 and not b.reliable
    g = {r.gate: r.status for r in E.gates(df.where("doc_id = 1"), ["item_id", "doc_id"]).collect()}
    assert g == {"parsing": "weak", "hard_qualifications": "fail", "keyword_match": "pass", "semantic_evidence": "weak", "discoverability": "pass", "skim": "pass", "evidence": "pass"}


def test_unsupported_terms_fold_forms(spark):
    df = spark.createDataFrame([(1, "Deploying kubernetes clusters", "deployed clusters", ["deploy", "kubernetes", "cluster"])], "doc_id int, new string, old string, terms array<string>")
    assert [r.term for r in E.unsupported_terms(df, "new", "old", "terms", ["doc_id"]).collect()] == ["kubernetes"]


def test_qualification_lines(spark):
    text = "x" * 60 + "\nRequirements:\n- 5+ years of experience with python\n- Bachelor degree in science\n- strong communication skills\nNice to have\n- AWS certified person"
    df = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = [(r.type, r.priority) for r in E.qualifications(df).orderBy("ord").collect() if len(r.text) > 15]
    assert got == [("experience_years", "required"), ("education", "required"), ("soft_skill", "required"), ("certification", "preferred")]


def test_clamp_denoise_repair(spark):
    summary = text_df(spark, "First sentence stays here. I am looking to grow. " + "Word " * 60 + "end.")
    r = Q.clamp_sections(summary).collect()[0]
    assert r.text == "First sentence stays here." and r.removed == 1 and r.clamped
    lines = text_df(spark, "- Built a tool, with teamwork spirit.\n- Demonstrated skill across multiple projects\n- Cut cost by 30% fast\nplain 30%")
    d = Q.denoise(lines).collect()[0]
    assert d.text == "- Built a tool.\n- Cut cost fast\nplain 30%" and (d.removed_filler, d.removed_vague, d.removed_percentage) == (1, 1, 1)
    c = Q.repair_case(text_df(spark, "- responsible for building sql apis\nSKILLS: aws\nsee aws.com")).collect()[0]
    assert c.text == "- Built SQL apis\nSKILLS\nAWS\nsee aws.com" and c.fixed == 2


def test_placeholders_and_rewrite(spark):
    d = text_df(spark, "I like your firm very much. I bring [insert skill] to it.\nJust TBD here.")
    assert {r.token for r in Q.placeholders(d).collect()} == {"[insert skill]", "TBD"} or {r.token.strip() for r in Q.placeholders(d).collect()} == {"[insert skill]", "TBD"}
    assert Q.drop_placeholders(d).collect()[0].text == "I like your firm very much."
    n = Q.normalise_corpus(text_df(spark, "Color is really 5 — 6 GREAT"), {"color": "colour", "great": "grand"}).collect()[0]
    assert n.text == "Colour is 5-6 GRAND" and n.changes == 3


def test_roles_round_trip(spark):
    text = "Acme | Dev | 2019 - 2021\n- Built a\n- Ran b\nBeta | Lead | 2021 - Present\n- Led c"
    roles = G.roles(text_df(spark, text))
    assert [(r.company, r.title, r.bullets) for r in roles.orderBy("role_no").collect()] == [("Acme", "Dev", ["Built a", "Ran b"]), ("Beta", "Lead", ["Led c"])]
    assert G.flatten(roles).collect()[0].text == text


def test_date_ranges_and_tenure(spark):
    raw = ["Mar 2019 - Present", "2018-02 – 2019-07", "03/2015 to 05/2016", "2010 - 2012", "nothing"]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, raw string")
    got = {r.id: (str(r.start), str(r.end), r.is_current, r.months) for r in G.parse_ranges(df, F.to_date(F.lit("2020-03-15"))).collect()}
    assert got[0] == ("2019-03-01", "2020-03-01", True, 12) and got[1][3] == 17 and got[2][3] == 14 and got[3][3] == 24 and got[4][0] == "None"
    spans = spark.createDataFrame([(1, 1, 2010, 2015), (1, 2, 2012, 2014), (1, 3, 2016, 2018)], "k int, id int, s int, e int")
    assert G.tenure(spans, "k", "s", "e", "id", F.floor(F.col("s") / 3)).collect()[0].covered == 7


def test_skills_and_groups(spark):
    d = text_df(spark, "python, SQL, Rest API, sql server, Python, teamwork, sql, docker, mystery")
    got = [r.skill for r in G.skills(d).orderBy("ord").collect()]
    assert "Python" in got and "python" not in got and "teamwork" not in got and "sql server" in got and "SQL" not in got
    items = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a1", "b1", "c1", "d1", "e1", "f1", "g1", "zz"])], "doc_id int, ord int, skill string")
    out = G.group_skills(items, [(n.upper(), n) for n in "abcdefg"], asked=["g1"])
    names = [r.group for r in out.orderBy("group_ord").collect()]
    assert len(names) == 6 and names[0] == "G" and names[-1] == "Additional"


def test_places(spark):
    countries = landing.load_countries(spark.createDataFrame([("IE", "Ireland", "Dublin", []), ("DE", "Germany", "Berlin", ["Deutschland"]), ("IL", "Israel", "Jerusalem", []), ("US", "United States", "Washington", ["USA"]), ("BR", "Brasil", "Brasilia", []), ("AT", "Austria", "Vienna", [])],
                                                             "iso2 string, name string, capital string, aliases array<string>"))
    cities = landing.load_cities(spark.createDataFrame([("Munich", "DE"), ("Chicago", "US"), ("Tel Aviv", "IL"), ("São Paulo", "BR"), ("Cork", "IE"), ("Austin", "US"), ("Paris", "FR"), ("Paris", "US")], "name string, country string"))
    raw = ["Munich, DE", "Chicago, IL", "Tel Aviv, IL", "Springfield, IL", "BRASIL, SÃO PAULO", "Cork, Ireland", "Remote", "N/A", "EMEA", "Hybrid - Cork", "Germany", "USA", "Austin, TX", "Asdf", None]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    got = {r.raw: r.canonical for r in L.canonical_location(df, countries, cities).collect()}
    want = {"Munich, DE": "Munich, DE", "Chicago, IL": "Chicago, IL, US", "Tel Aviv, IL": "Tel Aviv, IL", "Springfield, IL": "Springfield, IL", "BRASIL, SÃO PAULO": "São Paulo, BR", "Cork, Ireland": "Cork, IE", "Remote": "Dublin, IE", "N/A": "Dublin, IE",
            "EMEA": "Dublin, IE", "Hybrid - Cork": "Cork, IE", "Germany": "Berlin, DE", "USA": "New York, US", "Austin, TX": "Austin, TX, US", "Asdf": "Asdf, IE", None: "Dublin, IE"}
    assert got == want
    iso = {r.raw: r.iso2 for r in L.resolve_country(df.where("raw is not null"), countries, cities).collect()}
    assert iso["Munich, DE"] == "DE" and iso["Chicago, IL"] == "US" and iso["Tel Aviv, IL"] == "IL"
    tokens = spark.createDataFrame([("austin",), ("irland",), ("germny",)], "token string")
    assert {r.token: r.key for r in L.fuzzy_country(tokens, countries, cities).collect()} == {"irland": "ireland", "germny": "germany"}


def test_fuzzy_match_misses_nothing(spark):
    import itertools

    keys = ["".join(p) for p in itertools.product("ab", repeat=5)][::3] + ["abcdefghijkl", "abcdefghijklmnop"]
    tokens = ["abab", "aabbb", "ababab", "bbbbb", "abcdefgijkl", "abcdxxghijklmnop", "zzzzzzzzzzzzz"]

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    cut = lambda t: 1 if len(t) <= 6 else 2 if len(t) <= 12 else 3
    want = {}
    for t in tokens:
        near = [(lev(t, k), k) for k in keys if lev(t, k) <= cut(t)]
        if near:
            want[t] = min(near)
    got = L.fuzzy_match(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(k,) for k in keys], "key string"), L.city_cutoff())
    assert {r.token: (r.dist, r.key) for r in got.collect()} == want


def test_send_policy_refusals(spark):
    day = lambda n, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=h)
    log = spark.createDataFrame([("c", f"j{i}", day(i * 4)) for i in range(6)] + [("d", f"d{i}", day(i)) for i in range(3)], "company string, job_key string, at timestamp")
    asks = spark.createDataFrame([(1, "c", "new", day(21)), (2, "d", "new", day(4)), (3, "d", "d1", day(30)), (4, "d", "new", day(9)), (5, "x", "new", day(1))], "request_id long, company string, job_key string, at timestamp")
    got = {r.request_id: (r.reason, r.next_eligible) for r in I.send_policy(log, asks).collect()}
    assert got[1] == ("window", day(30)) and got[2] == ("gap", day(7)) and got[3][0] == "same_posting" and got[4][0] == "ok" and got[5][0] == "ok"


def test_address_harvest(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Mail jane.doe@corp.com.For questions</p><a href='mailto:jobs@corp.com?x=1'>x</a>")], "page_id long, url string, html string")
    got = I.rank_addresses(I.published_addresses(pages), mask=False)
    assert rows(got, "rank") == [(1, "jane.doe@corp.com", 95, 1), (1, "jobs@corp.com", 91, 2)]


def test_consistency_and_summary(spark):
    d = text_df(spark, "EDUCATION\nBSc First Class Honours\nGPA: 3.9\nPROJECTS\nTo-do list\nbuilt it\n\nTracker open source github.com/me\nEXPERIENCE\n")
    kinds = {r.rule for r in Q.consistency_flags(d).collect()}
    assert {"uk_class_with_gpa", "project_without_link", "generic_project", "own_repo_open_source", "dominant_handle"} <= kinds
    s = spark.createDataFrame([(1, "Jo\nSUMMARY\nSenior Florist with taste and more\n", "data engineer", "Data Engineer", "Jo Doe")], "doc_id int, text string, old string, title string, name string")
    r = Q.summary_flags(s, original="old", title="title", name="name").collect()[0]
    assert r.drift and r.other_profession and "target-title" in r.missing and "name" not in r.missing


def test_unprocessed_and_history(spark):
    q = spark.createDataFrame([(1,), (2,)], "k int")
    assert rows(H.unprocessed(q, spark.createDataFrame([(2,), (2,)], "k int"), ["k"])) == [(1,)]


def test_fields_of_titles(spark):
    want = {"AI Product Manager": "product", "Senior Product Designer": "design", "Security Guard": "operations", "Machine Learning Lead": "ml", "Systems Engineer": "devops", "Aviation Systems Engineer": "devops",
            "Design Systems Engineer": "engineering", "React Developer": "frontend", "Tax Advisor": "finance", "Gardener": "", "Sales Engineer": "solutions"}
    titles = spark.createDataFrame([(t,) for t in want], "title string")
    assert {r.title: r.field for r in I.discipline(titles).collect()} == want


def test_session_stages_follow_their_beginnings(spark):
    rows = [(1, 1, "view", 0), (2, 1, "click", 10), (3, 1, "view", 20), (4, 1, "buy", 50), (5, 1, "view", 5000), (6, 2, "buy", 0)]
    log = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r.user_id, r.session_start.timestamp(), r.ord, r.stage, r.seconds, r.n) for r in J.session_stages(log, 600).collect())
    assert got == [(1, 0.0, 1, "view", 10.0, 2), (1, 0.0, 2, "click", 40.0, 1), (1, 0.0, 3, "buy", 0.0, 1), (1, 5000.0, 1, "view", 0.0, 1), (2, 0.0, 1, "buy", 0.0, 1)]


def test_rewrites_are_counted_by_rule(spark):
    df = text_df(spark, "Colour of the colour, 2010 – 2012 — really in order to go", "nothing")
    got = {(r.doc_id, r.rule): r.n for r in Q.rewrite_counts(df, {"colour": "color"}, phrases=[("in order to", "to")], drop=["really"]).collect()}
    assert got == {(0, "word:colour"): 2, (0, "range dash"): 1, (0, "clause dash"): 1, (0, "filler:really"): 1, (0, "phrase:in order to"): 1}


def test_structured_data_wide_and_deep(spark):
    wide = {"@graph": [{"a": [i, {"s": "[[{{ \\\" ]"}]} for i in range(2000)] + [{"x": {"y": [{"@type": "JobPosting", "title": "Far"}]}}]}
    deep = {"@type": "Thing", "d": {"@type": "JobPosting", "title": "Deep"}}
    for _ in range(200):
        deep = {"d": [deep]}
    page = lambda x: '<script type="application/ld+json">' + json.dumps(x) + "</script>"
    df = spark.createDataFrame([(1, page(wide)), (2, page(deep)), (3, page(1) + '<script type="application/ld+json">{[</script>')], "page_id long, html string")
    assert sorted((r.page_id, r.title) for r in P.jsonld_postings(df).collect()) == [(1, "Far"), (2, "Deep")]


def test_a_sieve_refuses_no_rule_and_most_others(spark):
    rules = spark.range(1000).selectExpr("concat('r', id) as term")
    rows = spark.range(100_000).selectExpr("concat(if(id < 1000, 'r', 'x'), id) as term")
    kept = rows.where(sieve(rules, ["term"])).collect()
    assert sum(r.term.startswith("r") for r in kept) == 1000 and len(kept) < 1400
    assert rows.where(sieve(rules.where("false"), ["term"])).count() == 0


def test_cities_by_short_and_local_names(spark):
    cities = spark.createDataFrame([("new york", "US"), ("munich", "DE"), ("la", "IT"), ("los angeles", "US"), ("frankfurt", "DE"), ("san", "XX"), ("san francisco", "US")], "city_key string, country_iso2 string")
    raws = spark.createDataFrame([("San Fran",), ("NYC",), ("München",), ("LA",), ("Frankfurt am Main",), ("Nowhere",)], "raw string")
    got = {r.raw: (r.city, r.iso2, r.via) for r in L.match_city(raws, cities).collect()}
    assert got == {"San Fran": ("san francisco", "US", "alias"), "NYC": ("new york", "US", "alias"), "München": ("munich", "DE", "alias"), "LA": ("la", "IT", "exact"), "Frankfurt am Main": ("frankfurt", "DE", "shortened")}


def written(df, part):
    """How often a part of an expression stands in the optimized plan."""
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return df._jdf.queryExecution().optimizedPlan().toString().count(part)


def test_hooks_try_each_pattern_once(spark):
    pad = " lorem ipsum dolor sit amet consectetur adipiscing elit."
    texts = ["We are growing Alpha Platform" + pad, "OUR MISSION is to make maps for everyone alive" + pad, "You\nYOULL own the whole billing system here" + pad, "YouWill run the data team every day" + pad, None, "short", "uses python, java, scala and rust" + pad]
    out = E.hooks(spark.createDataFrame(list(enumerate(texts)), "item_id int, text string"))
    assert [r.kind for r in out.orderBy("item_id").collect()] == ["product", "mission", "challenge", "challenge", "fallback", "fallback", "stack"]
    assert written(out, "our mission|") == 1


def test_format_flags_try_each_pattern_once(spark):
    import re

    texts = ["", "Lives in LEEDS, a@b.co", "due 03/2020 or 2020-03 or 03-2020, MAR 2020, Mar. 2020", "Work Experience:\nSKILLS", "core competencies\nabout me", "US", "bus", "(eu)", "+44 20 7946 0958 LinkedIn.com/in/x-y", "remote\tTech Stack", "2020", "a-b/c"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id int, text string")
    out = Q.format_flags(docs)
    for r in out.where("doc_id < 99").collect():
        has = lambda p: bool(re.search(p, texts[r.doc_id]))
        assert r.date_formats == sum(has(p) for _, p in QR.DATE_FORMATS) and r.headings_missing == sum(not has(p) for _, p in QR.STANDARD_HEADINGS), texts[r.doc_id]
        assert [r[f"has_{n}"] for n, _ in QR.SECTION_WORDS] == [has(p) for _, p in QR.SECTION_WORDS], texts[r.doc_id]
        assert (r.has_email, r.has_phone, r.has_profile, r.has_place) == tuple(has(p) for p in (QR.EMAIL, QR.PHONE, QR.PROFILE, QR.PLACES)), texts[r.doc_id]
    assert written(out, r"linkedin\.com/in/") == 1 and written(out, "|career objective)") == 1


def test_jsonld_postings_read_a_page_once(spark):
    body = '{"@type": "JobPosting", "title": "<b>R&amp;D</b> lead", "hiringOrganization": "Acme", "jobLocationType": "TELECOMMUTE", "description": " plain  text ", "identifier": {"value": 7}}'
    page = lambda b: f'<script type="application/ld+json">{b}</script>'
    out = P.jsonld_postings(spark.createDataFrame([(1, page(body)), (2, page('{"@type": "Person"}')), (3, "none"), (4, page("[{}, " + body.replace("Acme", "") + "]"))], "page_id int, html string"))
    got = {r.page_id: tuple(r)[1:] for r in out.collect()}
    assert got == {1: ("R&D lead", "Acme", None, "Remote", "plain text", "7"), 4: ("R&D lead", None, None, "Remote", "plain text", "7")}
    assert written(out, "regexp_extract_all") == 1


def test_candidate_score_reads_each_name_once_and_takes_known_sides(spark):
    row = ("Tech Recruiter", "Acme & Co", "ie", "Cork", 50.0, True, "a@acme.io", "Software Engineer", "ACME and co ltd", "ie", "cork", "acme.io")
    names = "title company country city_text confidence verified address p_title p_company p_country p_city p_domain".split()
    pairs = spark.createDataFrame([(1, *row), (2, "Sales Manager", "Other", *row[2:]), (3, None, None, *row[2:]), (4, "Head of Engineering", "acme labs", *row[2:7], "Account Executive", "Acme", *row[9:])], ["posting_id", *names])
    score = lambda df: [(r.posting_id, r.score) for r in I.rank_candidates(df).orderBy("posting_id").collect()]
    known = pairs.withColumn("title_known", I.title_features("title")).withColumn("company_name", I.norm_company("company")).withColumn("p_company_name", I.norm_company("p_company")).withColumn("p_role", I.discipline_of("p_title"))
    assert score(pairs)[:2] == [(1, 124), (2, -43)] and score(known) == score(pairs)
    assert written(I.rank_candidates(pairs), "lower(company") == 1
