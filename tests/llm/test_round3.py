"""Filter audit, document fingerprints and token alignment against brute force, with odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlens.llm import alignment, digests
from postlens.llm.filter_audit import filter_audit, text_filters

COLUMNS = "doc_id long, text string, source string, _id int, _k1 string, place int, _block string, fingerprint string"
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, rows):
    """Rows (id, text, source) with extra columns named as columns that the operators use inside."""
    return spark.createDataFrame([(i, t, s, k, "x", k, "y", "z") for k, (i, t, s) in enumerate(rows)], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)

    def words(n, pool):
        return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))

    texts = [None, "", " ", "\n\n", "é日本 a", "A", "$", words(250, 10), words(250, 900), words(20_000, 50_000), "Big CAPS " * 150, "tail  \t x y "]
    texts += [words(rng.randrange(5, 300), rng.choice([20, 2000])) for _ in range(30)]
    texts += [t for t in texts[7:16]] + [f"{t} & more" for t in texts[12:16]]
    found = [(i, t, [None, "", "web", "books"][i % 4]) for i, t in enumerate(texts)]
    return found + [(3, texts[7], "web"), (8, texts[8], None), (8, texts[8], None), (None, texts[8], "web"), (None, "no id", "web")]


def brute_audit(rows, good, toxic):
    fails = []
    for i, t, s in rows:
        t, s = t or "", s or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        f = {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any((t2 or "") == t and j is not None and j < i for j, t2, _ in rows) else set()
        fails.append((s, f, i in good, i in toxic))
    told, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step in range(1, 6):
                x, before = order[step - 1], set(order[: step - 1])
                gone = [f for f in mine if x in f[1] and not f[1] & before]
                told[part, order, step] = (
                    sum(not f[1] & (before | {x}) for f in mine), len(gone), sum(x in f[1] and bool(f[1] & before) for f in mine),
                    sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone),
                )
                shapley[part, x] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in told.items()}


def test_filter_audit(spark, rows):
    docs = frame(spark, rows)
    good, toxic = {1, 7, 8, 9, 20, 33}, {8, 12, 41}
    ids = lambda some: spark.createDataFrame([(i,) for i in [*some, *some, None]], "_id long")
    keys, failing = text_filters(docs)
    made = filter_audit(keys, failing, {"good_lost": ids(good), "toxic_lost": ids(toxic)}).collect()
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in made}
    assert len(made) == len(got) == 3 * 600
    assert got == brute_audit(rows, good, toxic)


def test_filter_audit_takes_any_filters_and_orders(spark):
    docs = frame(spark, [(1, "a b", "s"), (2, "A $ C", "s"), (3, "a b", "t")])
    keys, failing = text_filters(docs, min_words=3, capital_percent=0)
    made = filter_audit(keys, {k: failing[k] for k in "CA"}, {}, ["CA"]).orderBy("part", "step").collect()
    assert [(r["part"], r["step"], r["kept"], r["removed"], r["unique_fails"], r["shapley"]) for r in made] == [("s", 1, 1, 1, 1, 1), ("s", 2, 0, 1, 1, 1), ("t", 1, 1, 0, 0, 0), ("t", 2, 0, 1, 1, 1)]


def test_filter_audit_of_nothing(spark):
    keys, failing = text_filters(frame(spark, []))
    assert filter_audit(keys, failing, {}).collect() == []


def test_stored_relations_meet_without_a_shuffle(spark, rows):
    from postlens.llm.filter_audit import _without, placed

    keys, failing = text_filters(frame(spark, rows))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _without(placed(keys), failing["A"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def brute_digest(data):
    """The digest by its definition, triplet by triplet."""
    counts, m = [0] * 1024, 0xFFFFFFFF
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        h = (a * 0x9E3779B1 & m) ^ (b * 0x85EBCA77 & m) ^ (c * 0xC2B2AE3D & m)
        h = (h ^ h >> 15) * 0x2C1B3C6D & m
        counts[(h ^ h >> 13) % 1024] += 1
    q = [sorted(counts)[k] for k in (255, 511, 767)]
    return [sum(n > x for x in q) for n in counts]


def test_digest_by_its_definition(rows, monkeypatch):
    texts = [(t or "").encode() for _, t, _ in rows][:20]
    made = digests.digests(texts)
    assert made[:, 1:].tolist() == [brute_digest(t) for t in texts]
    monkeypatch.setattr(digests, "BYTES", 64)  # long texts in pieces
    assert (digests.digests(texts) == made).all()
    assert (digests.read(digests.written(made)) == made).all()
    assert (digests.alike(made, made) == 1).all()


def test_successor_edits(spark, rows):
    docs = [(i, t or "") for i, t, _ in rows]
    plain = [d for d in docs if d[0] is not None]
    sig = {t: s for t, s in frame(spark, rows).select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, sig[d[1]]))
    want = []
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        h = len(t) // 2
        edit = t[: len(t) - h] + after[:h]
        a, e, b = digests.digests([x.encode() for x in (t, edit, after)])
        want.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), *digests.written(digests.digests([t.encode(), edit.encode()])), digests.alike(a[None], e[None])[0], digests.alike(a[None], b[None])[0]))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    for samples in (32, 1):
        made = digests.successor_edits(frame(spark, rows), samples=samples)
        assert made.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        assert sorted(map(tuple, made.collect()), key=key) == sorted(want, key=key)
    assert len(plain) < len(docs)


def test_successor_edits_of_one_and_none(spark):
    one = digests.successor_edits(frame(spark, [(5, "abcd", "s")])).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1
    assert digests.successor_edits(frame(spark, [])).collect() == []


def test_fingerprint_columns(spark, rows):
    docs = frame(spark, rows).withColumn("f", digests.fingerprint(F.col("text")))
    got = docs.select("text", "f", digests.likeness(F.col("f"), F.col("f")).alias("same"), digests.likeness(F.col("f"), F.lit(None).cast("string")).alias("none")).collect()
    by_text = defaultdict(set)
    for r in got:
        by_text[r["text"] or ""].add(r["f"])
        assert r["same"] == 1 and r["none"] is None
    assert all(len(f) == 1 for f in by_text.values()) and len(set.union(*by_text.values())) > 30


def brute_alignment(rows):
    a_side, b_side = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_side.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    links, told = {}, {}
    for k, (_, t, _) in enumerate(rows):
        t = t or ""
        a, b = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)
        ta = [bytes(alphabet[c] for c in a_side.id_to_token(i)) for i in a]
        tb = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(ta) != (" " + t).encode() or b"".join(tb) != (" " + t).encode():
            a, b, ta, tb = [], [], [], []
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (ta, tb))
        cuts = sorted({*ends_a} & {*ends_b})
        links[k] = [(a[ends_a.index(c)], b[ends_b.index(c)]) for c in cuts]
        groups = [",".join(str(i) for i, e in zip(a, ends_a, strict=True) if lo < e <= c) + "|" + ",".join(str(i) for i, e in zip(b, ends_b, strict=True) if lo < e <= c) for lo, c in zip([0, *cuts], cuts, strict=False)]
        told[k] = (len(a), len(b), len(cuts), len(cuts), ";".join(groups))
    count = Counter(p for found in links.values() for p in found)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(rows[k][0], *told[k][:4], sum(count[p] == most[p[1]] for p in found), sum(count[p] for p in found), told[k][4]) for k, found in links.items()]


def test_alignment(spark, rows, monkeypatch):
    odd = ["<|endoftext|> x", "x▁y", "<0x41> a", " lead", "two  gaps ", "a\n b\x0b c\x1cd", "don't we'll", "emoji 👩‍👩‍👧  é", "a\x00b", "Zahlen 12345 und 6.7"]
    some = [r for r in rows if len(r[1] or "") < 5000] + [(100 + k, t, "odd") for k, t in enumerate(odd)]
    got = alignment.aligned(frame(spark, some), BYTE_LEVEL, public_tokenizers.PATTERN, PIECES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_alignment(some), key=key)
    digest = alignment.aligned(frame(spark, some[:5]), BYTE_LEVEL, public_tokenizers.PATTERN, PIECES, digest=True).collect()
    assert {r["doc_id"]: r["groups"] for r in digest} == {r[0]: hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "" for r in brute_alignment(some[:5])}


def test_alignment_in_small_blocks_and_of_nothing(spark, rows):
    with open(BYTE_LEVEL, "rb") as a, open(PIECES, "rb") as b:
        one = alignment.Aligner(alignment.ByteLevel(a.read(), public_tokenizers.PATTERN), alignment.Pieces(b.read()))
    assert one(pa.array(["", ""]))["groups"] == [b"", b""]
    long = next(t for _, t, _ in rows if len(t or "") > 50_000)
    both, alone = one(pa.array([long, "x y", long])), one(pa.array([long]))
    assert both["groups"][0] == both["groups"][2] == alone["groups"][0] and both["n_a"][1] == 2
    assert alignment.aligned(frame(spark, []), BYTE_LEVEL, public_tokenizers.PATTERN, PIECES).collect() == []


def test_overlaps_are_all_overlapping_pairs():
    with open(BYTE_LEVEL, "rb") as a, open(PIECES, "rb") as b:
        one = alignment.Aligner(alignment.ByteLevel(a.read(), public_tokenizers.PATTERN), alignment.Pieces(b.read()))
    counts, ids = one.encode(pa.array(["Donaudampfschifffahrt résumé 42", "", "other text"]))
    pairs, ends = one.overlaps(counts, ids)
    starts = [e - one.lengths[k][ids[k]] for k, e in enumerate(ends)]
    want = {(i, j) for i in range(len(ids[0])) for j in range(len(ids[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]}
    assert sorted(map(tuple, pairs.to_numpy().tolist())) == sorted(want) and len(pairs) == len(want)


def test_columns_may_be_called_anything(spark):
    from postlens.llm import langid, mixing

    names = ["_spans", "_sig_", "_i", "_s", "_c", "_made_", "_row", "_new", "_copy", "size", "a.b"]
    rows = [(k, f"word{k} and some more words {k % 7}", "en", f"s{k % 3}", *[f"{name}{k}" for name in names]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{name}` string" for name in names))
    mixed, told = mixing.mixed_documents(docs), langid.identify(docs, langid.train(docs))
    assert mixed.columns == docs.columns and told.columns == [*docs.columns, "lang_pred", "score", "ambiguous"]
    for made in (mixed.collect(), told.collect()):
        assert made and all(r[name] == f"{name}{r['doc_id']}" for r in made for name in names)
    plain = {(r["doc_id"], r["text"]) for r in mixing.mixed_documents(docs.drop(*[f"{n}" for n in names])).collect()}
    assert plain == {(r["doc_id"], r["text"]) for r in mixed.collect()}


def test_codewords_are_decoded_as_written(spark):
    """Predictions of the decoder, document by document, against plain loops over the model's tables."""
    import math

    import numpy as np

    from postlens.llm import langid

    rng = random.Random(2)
    alphabets = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr", "dd": "stuvwx", "ee": "yzabgh", "ff": "éèàùçô"}
    text = lambda lang, n: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(n))
    rows = [(k, text(lang, 30), lang) for k, lang in enumerate(list(alphabets) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    for k, t, _ in rows[:30]:
        data, out, n = t.encode().lower(), [0.0] * model.code.shape[1], 0
        for order in langid.ORDERS:
            for i in range(len(data) - order + 1):
                code = order
                for byte in data[i : i + order]:
                    code = (code * 257 + byte) % 2**32
                bucket = (code * 2654435761 % 2**32) >> (32 - langid.BUCKETS.bit_length() + 1)
                out = [a + float(w) for a, w in zip(out, model.weights[bucket], strict=True)]
                n += 1
        out = [a / n for a in out]
        loss = [sum(trust * math.log1p(math.exp(-langid.SLOPE * c * o)) for trust, c, o in zip(model.trust, word, out, strict=True)) / sum(model.trust) for word in model.code]
        best = min(range(len(loss)), key=loss.__getitem__)
        chance = [math.exp(-langid.SLOPE * (x - loss[best])) for x in loss]
        assert got[k][0] == model.languages[best] and abs(got[k][1] - chance[best] / sum(chance)) < 1e-4
    assert np.mean([got[k][0] == lang for k, _, lang in rows]) > 0.95
