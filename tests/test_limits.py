"""Inputs beyond limits that once lost data, and results that once depended on chance."""

import json

from pyspark.sql import functions as F

from postlens.functions.text import spelled, words
from postlens.operators import history, matching, people, places, postings, quality, terms
from postlens.plans import matching as plans
from postlens.plans import streams as plan_streams
from postlens.plans import terms as plan_terms
from postlens.streaming import activity as J
from postlens.streaming.replay import run_append, stream_table


def test_dictionary_terms_of_any_length(spark):
    docs = spark.createDataFrame([(1, "We need natural language processing pipelines and a b c d e f today")], "doc_id long, text string")
    rules = spark.createDataFrame([("Natural Language Processing Pipelines", "x"), ("a b c d e f", "y"), ("today", "z")], "term string, category string")
    assert {r.term for r in terms.dictionary_hits(docs, rules).collect()} == {"natural language processing pipelines", "a b c d e f", "today"}
    found = terms.soft_skills(docs, ["natural language processing pipelines"])
    assert [r.skill for r in found.collect()] == ["natural language processing pipelines"]
    issues = quality.vocabulary_issues(docs, ["natural language processing pipelines and a"])
    assert "natural language processing pipelines and a" in {r.issue for r in issues.collect()}


def test_roi_terms_of_any_length(spark):
    docs = spark.createDataFrame([(1, "We need natural language processing pipelines to be run here and now, and more")], "doc_id long, text string")
    got = terms.classify_roi(docs, (("high", ("natural language processing pipelines to be run",)),), loose=0)
    assert [(r.term, r.tier) for r in got.collect()] == [("natural language processing pipelines to be run", "high")]


def test_long_company_names(spark):
    name = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta"
    left, right = spark.createDataFrame([(1, name), (2, None), (3, "Gamma Delta")], "a long, company string"), spark.createDataFrame([(7, name.upper()), (8, "Other")], "b long, company string")
    assert {(r.a, r.b) for r in people.company_match(left, right, "a", "b").collect()} == {(1, 7), (3, 7)}
    profiles = spark.createDataFrame([("p", f"Recruiter at {name}")], "handle string, headline string").withColumn("seen_at", F.timestamp_seconds(F.lit(0)))
    ranked = history.rank_profiles(profiles, left.select("company"), F.timestamp_seconds(F.lit(10)))
    assert {r.company for r in ranked.collect()} == {name, "Gamma Delta"}


def test_missing_fingerprints_are_not_equal(spark):
    rows = [(1, "u1", None, 0), (2, "u2", None, 60), (3, "u3", "f", 120), (4, "u4", "f", 180), (5, None, "g", 200), (6, None, "h", 220)]
    log = spark.createDataFrame(rows, "id long, url string, fp string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.id: r.layer for r in history.label_hits(log, "url", "fp", "id").collect()} == {1: "miss", 2: "miss", 3: "miss", 4: "hash", 5: "miss", 6: "miss"}


def test_short_keys_within_the_cutoff(spark):
    tokens, keys = spark.createDataFrame([("ab",), ("berlim",), ("x",)], "token string"), spark.createDataFrame([("b",), ("berlin",)], "key string")
    got = {(r.token, r.key, r.dist) for r in places.fuzzy_match(tokens, keys, F.lit(1)).collect()}
    assert got == {("ab", "b", 1), ("berlim", "berlin", 1), ("x", "b", 1)}
    more = {(r.token, r.key, r.dist) for r in places.fuzzy_match(spark.createDataFrame([("berlinxyz1",)], "token string"), keys, F.lit(4)).collect()}
    assert more == {("berlinxyz1", "berlin", 4)}
    assert {(r.token, r.dist) for r in places.fuzzy_match(tokens.unionByName(keys.select(F.col("key").alias("token"))), keys, F.lit(0)).collect()} == {("b", 0), ("berlin", 0)}


def test_trace_keys_are_escaped_and_cuts_are_marked(spark):
    data = {'a"b\\c': 1, **{f"k{i:02d}": i for i in range(30)}}
    got = J.ingest_trace(spark.createDataFrame([(json.dumps(data),)], "props string")).first().props
    made = json.loads(got)
    assert made['a"b\\c'] == 1 and made["…"] == "+10" and len(made) == 22
    assert len(json.loads(J.ingest_trace(spark.createDataFrame([(json.dumps(data),)], "props string"), keys=40).first().props)) == 31


def test_merged_logs_keep_the_first_row(spark):
    one = spark.createDataFrame([(1, "x", 5, 10)], "id long, event string, s long, user_id long")
    two = spark.createDataFrame([(1, "x", 3, 20), (2, "y", 1, 30)], "id long, event string, s long, user_id long")
    logs = [("b", one.withColumn("ts", F.timestamp_seconds("s"))), ("a", two.withColumn("ts", F.timestamp_seconds("s")))]
    assert {(r.dedupe_key, r.source, r.user_id) for r in J.merged_logs(logs).collect()} == {("1", "a", 20), ("2", "a", 30)}


def test_postings_nested_deeper_than_four_levels(spark):
    body = {"@type": "JobPosting", "title": "Deep"}
    for _ in range(9):
        body = {"@graph": [body]}
    html = f'<script type="application/ld+json">{json.dumps(body)}</script>'
    assert postings.jsonld_postings(spark.createDataFrame([(1, html)], "page_id long, html string")).first().title == "Deep"


def test_stream_over_a_folder_of_files(spark, tmp_path):
    rows = spark.range(100).withColumn("ts", F.timestamp_seconds(F.col("id")))
    rows.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    assert run_append(stream_table(spark, str(tmp_path), "events"), "t").count() == 100


def test_trace_reads_variants_and_binds_each_node_once(spark):
    data = {"token": "x", "deep": {"list": list(range(10)), "note": "é" * 400, "jwt": "eyJ" + "a" * 300, "n": 1.5, "none": None}}
    rows = spark.createDataFrame([(json.dumps(data),)], "props string")
    text = J.ingest_trace(rows)
    asked = J.ingest_trace(rows.select(F.parse_json("props").alias("props")))
    assert text.first().props == asked.first().props
    got = json.loads(text.first().props)
    assert got["deep"]["note"] == "é" * 300 + "…(400)" and got["deep"]["jwt"] == "[redacted]" and got["deep"]["list"][-1] == "…+2" and got["deep"]["none"] is None


def test_phrases_meet_documents_by_place_not_by_word(spark):
    docs = spark.createDataFrame([(1, "big data lake here"), (2, "xbig data lakes big lake"), (3, "lake data big"), (4, "big  data a\tb c"), (5, None), (6, "Big Data"), (7, "big\ndata lake big data lake data")], "doc_id long, text string")
    phrases = spark.createDataFrame([("big data lake",), ("Big data",), ("lake",), ("big  data",), (" data lake",), ("data a\tb c",), ("",), ("data lake big data",)], "phrase string")
    out = terms.phrase_hits(docs, phrases)
    texts = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    tokens = {r.doc_id: set(r.ts or []) for r in docs.select("doc_id", terms.token_set("text").alias("ts")).collect()}
    want = {(d, p.phrase.lower()) for d in texts for p in phrases.collect() if p.phrase.lower() in texts[d] and p.phrase and all(w in tokens[d] for w in p.phrase.lower().replace("\t", " ").split())}
    assert {(r.doc_id, r.phrase) for r in out.collect()} == want and len(want) >= 8
    # The longest word of the phrase is in every document; its place is in one. Rows that leave the scan's join are about the hits.
    many = spark.range(300).selectExpr("id as doc_id", "if(id = 7, 'the alphabet of it', 'of the it alphabet') as text")
    got = terms.phrase_hits(many, spark.createDataFrame([("the alphabet of",)], "phrase string"))
    assert [r.doc_id for r in got.collect()] == [7]

    def widest(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return widest(plan.executedPlan())
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            return widest(plan.plan())
        mine = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.getClass().getSimpleName() and plan.metrics().contains("numOutputRows") else 0
        kids = plan.children()
        return max([mine, *[widest(kids.apply(i)) for i in range(kids.size())]])

    assert widest(got._jdf.queryExecution().executedPlan()) < 300


def test_title_pairs_are_counted_on_narrow_rows(spark):
    titles = spark.createDataFrame([(3, "Senior Data Lake Engineer"), (1, "engineer, data lake senior"), (2, "Welder"), (4, "the")], "page_id long, title string")
    cvs = spark.createDataFrame([(1, "data lake engineer"), (2, "data"), (3, "welder of lake data senior engineer"), (4, None)], "doc_id long, text string")
    out = matching.title_signal(titles, cvs)
    words = {r.page_id: set(r.w) for r in titles.select("page_id", matching.title_words("title").alias("w")).collect()}
    seen = {1: {"data", "lake", "engineer"}, 2: {"data"}, 3: {"welder", "of", "lake", "data", "senior", "engineer"}, 4: set()}
    want = {(p, d, len(w & s)) for p, w in words.items() for d, s in seen.items() if w and int(100 * len(w & s) / len(w) + 0.5) >= 60}
    assert {(r.page_id, r.doc_id, r.hits) for r in out.collect()} == want and len(want) == 5
    assert "_found" not in out._jdf.queryExecution().optimizedPlan().toString()  # no pair row carries its terms


def test_negated_ranges_are_spelled_out(spark):
    assert spelled(r"(?:^|[^0-9_])x[a-z]\[^0-9][^\]0-9]") == r"(?:^|[^0123456789_])x[a-z]\[^0-9][^\]0123456789]"
    df = spark.createDataFrame([("Ünder c++ node.js, AB-9|x",)], "t string")
    made = df.select(words("t").alias("w"), F.split(F.lower("t"), r"[^a-z0-9+#./-]+").alias("raw"))
    assert "[^a-z" not in df.select(words("t"))._jdf.queryExecution().optimizedPlan().toString()
    row = made.first()
    assert row.w == [w for w in row.raw if w] == ["nder", "c++", "node.js", "ab-9", "x"]


def test_spans_are_joined_without_looking_at_every_neighbour(spark):
    df = spark.createDataFrame([(".net c++ c# a.b ci/cd x+",)], "t string")
    got = df.select(F.array_sort(terms.grams("t", [1, 2])).alias("g"))
    plain = ["net", "c", "c", "a", "b", "ci", "cd", "x", "net c", "c++ c", "c# a", "a.b", "b ci", "ci/cd", "cd x"]
    marked = [".net", "c+", "c++", "c#", ".b", "x+", ".net c", "net c+", "net c++", "c++ c#", ".b ci", "cd x+"]
    assert got.first().g == sorted(plain + marked)
    # Once per word, not per span: no span of the plan asks for the letters around it.
    plan = df.select(terms.grams("t", [1, 2]))._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(" not in plan


def test_pairs_read_cvs_once(spark, tmp_path):
    cvs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha"), (3, None)], "doc_id long, text string")
    cvs.write.parquet(str(tmp_path / "cvs"))
    listed = spark.createDataFrame([(7, t) for t in ("alpha", "beta", "gamma", "delta")] + [(8, f"w{i:03}") for i in range(150)] + [(8, "alpha")], "item_id long, term string")
    pairs = matching.covered_pairs(listed, spark.read.parquet(str(tmp_path / "cvs")))
    assert [(r.item_id, r.doc_id, sorted(r.found)) for r in pairs.collect()] == [(7, 1, ["alpha", "beta", "gamma"])]
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    many = spark.createDataFrame([(1, " ".join(f"w{i:03}" for i in range(0, 150, 2)))], "doc_id long, text string")
    assert [sorted(r.found) for r in matching.covered_pairs(listed, many).collect()] == [[f"w{i:03}" for i in range(0, 150, 2)]]


def test_qualifications_are_sought_in_batches(spark):
    quals = spark.createDataFrame([(7, 0, "Spark pipelines daily", "x", "required", 1.0, ["Spark", "Kafka"]), (7, 1, "none of these", "x", "preferred", 1.0, ["cobol"])],
                                  "item_id long, ord long, text string, type string, priority string, weight double, keywords array<string>")
    cvs = spark.createDataFrame([(1, "I ran SPARK pipelines"), (2, "")], "doc_id long, text string")
    pairs = spark.createDataFrame([(7, 1), (7, 2)], "item_id long, doc_id long")
    rows = matching.match_quals(quals, pairs, cvs)
    assert [(r.doc_id, r.ord, r.met, r.confidence, r.evidence) for r in rows.orderBy("doc_id", "ord").collect()] == [
        (1, 0, True, 0.53, ["...i ran spark pipelines..."]), (1, 1, False, 0.0, []), (2, 0, False, 0.0, []), (2, 1, False, 0.0, [])]
    short = matching.match_quals(quals, pairs, cvs, evidence=False)
    assert "evidence" not in short.columns
    assert "contains(" not in short._jdf.queryExecution().optimizedPlan().toString().lower()


def test_tier_classes_read_documents_once(spark, tmp_path):
    text = "of the apple banana apple cherry of the pear and more words so that it is long enough"
    spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    made = terms.classify_roi(spark.read.parquet(str(tmp_path / "docs")), (("high", ("of the", "pear")), ("low", ("pear",))), loose=2, stop=("the", "and"))
    assert [tuple(r) for r in made.orderBy("ord").collect()] == [(1, "of the", "high", 1), (1, "pear", "high", 2), (1, "apple", "unclassified", 3), (1, "banana", "unclassified", 4), (1, "pear", "low", 5)]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_pair_features_search_in_batches(spark):
    postings_ = spark.createDataFrame([(7, "alpha role", "alpha")], "item_id long, text string, title string")
    packed = spark.createDataFrame([(7, ["alpha", "betas", "x"])], "item_id long, terms array<string>")
    cvs = spark.createDataFrame([(1, "alpha\nEXPERIENCE\nbeta alphabet", "alpha")], "doc_id long, text string, original string")
    pairs = spark.createDataFrame([(7, 1)], "item_id long, doc_id long")
    made = matching.pair_features(pairs, packed, postings_, cvs, 2026, original="original")
    assert "_stand_in" in made._jdf.queryExecution().optimizedPlan().toString()
    row = made.first()
    assert (row.proven, row.unsupported, row.title_in_header) == (100, 1, True)


def test_dropped_paragraphs_of_any_length_are_reported(spark, tmp_path):
    made = lambda start: " ".join(f"{start}{chr(97 + i // 26)}{chr(97 + i % 26)}zebra" for i in range(60))
    spark.createDataFrame([(1, "s", "\n".join([made("q"), made("w") + " onward"]))], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in plans.QUERIES["e21_dropped_lines"](spark, str(tmp_path)).collect()] == [(100000, "s")]


def test_dropped_lines_are_not_shuffled_to_learn_their_blocks(spark):
    rows = spark.createDataFrame([("g", i, f"alpha bravo carol delta {chr(97 + i)}word") for i in range(20)], "grp string, line_id long, body string")
    out = matching.dropped_lines(rows, rows.where("line_id > 9"), "grp")
    assert out.count() == 0 and "salt" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_open_skills_of_a_document_are_all_reported(spark, tmp_path):
    named = ", ".join(f"q{chr(97 + i // 26)}{chr(97 + i % 26)}w ha" for i in range(60))
    spark.createDataFrame([(1, f"{named}. zebra on, quartz analysis, thon. THON")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.skill for r in plan_terms.QUERIES["d11_hard_skills"](spark, str(tmp_path)).collect()}
    assert got == {*named.split(", "), "zebra on", "quartz analysis"}


def test_open_skills_are_sought_once_each(spark):
    docs = spark.createDataFrame([(1, "Root cause analysis. Root cause analysis, root cause analysis; experience with SQL and SQL"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.skill: (r.score, r["rank"]) for r in terms.hard_skills(docs, limit=None).collect()}
    assert got == {"root cause analysis": (19.0, 2), "sql": (23.0, 1)}
    limited = terms.hard_skills(docs, limit=1).collect()
    assert [r.skill for r in limited] == ["sql"]


def test_title_pairs_are_never_shuffled(spark):
    titles = spark.createDataFrame([(i, f"w{chr(97 + i % 5)}ord x{chr(97 + i % 7)}ord y{chr(97 + i % 3)}ord") for i in range(60)] + [(None, "lonely zebra"), (None, "waord xaord yaord")], "page_id long, title string")
    cvs = spark.createDataFrame([(d, " ".join(f"{a}{chr(97 + (d + k) % 7)}ord" for k, a in enumerate("wxyxw"))) for d in range(40)] + [(99, "waord"), (99, "xaord"), (98, "lonely zebra"), (97, None)], "doc_id long, text string")
    held = {}
    for d, t in cvs.collect():
        held.setdefault(d, set()).update((t or "").split())
    want = sorted((p if p is not None else -1, d, len(set(t.split()) & w)) for p, t in titles.collect() if "zebra" not in t for d, w in held.items() if len(set(t.split()) & w) >= 2)
    for block in (1, 7, 250_000):
        out = matching.title_signal(titles, cvs, block=block)
        assert sorted((-1 if r.page_id is None else r.page_id, r.doc_id, r.hits) for r in out.collect()) == want
        assert {r.coverage for r in out.collect()} == {67, 100}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") < plan.index("Join")  # the pairs come last, out of one shuffle of texts and titles


def test_events_of_one_file_are_traced_on_all_cores(spark, sf):
    out = plan_streams.QUERIES["j1_ingest_trace"](spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("to_variant_object") < plan.index("Exchange") < plan.index("FileScan")  # payloads are made behind the exchange
    assert spark.read.parquet(f"{sf}/events.parquet").rdd.getNumPartitions() < 8 <= out.rdd.getNumPartitions()


def test_words_are_sought_in_distinct_runs():
    text = "alpha beta  alphabet\tgamma\n" * 50 + "end of it all"
    asked = ["alpha", "habet", "beta  al", "it all", "a b", "of", "gammaend", "", " ", "xyz", "\n", "ta", "tall"] + [f"w{i}" for i in range(20)]
    assert matching._standing(text, asked) == [word in text for word in asked] and matching._standing(text, asked[:5]) == [True] * 5
    assert matching._standing(None, asked) == [False] * len(asked) and matching._standing("", ["", "a"] * 20) == [True, False] * 20
    class Counted(str):
        seen = 0
        def __contains__(self, word):
            Counted.seen += 1
            return str.__contains__(self, word)
    matching._standing(Counted(text), [f"w{i}" for i in range(100)])
    assert Counted.seen == 0  # the repeated text itself is not searched for plain words
