"""Each training-data operator against a brute-force version, and on the odd cases of its docstring."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from postlens.llm import bpe, forest, langid, mixing, simhash, suffix, toxicity, warc
from postlens.llm.components import connected_components
from postlens.llm.exact import exact_dedup
from postlens.llm.lines import line_dedup

DOCS = "doc_id long, text string, lang string, source string, _id int, n_lines string"
BLANK = re.compile(r"[\x20\x09-\x0D]")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with names used inside the operators."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, f"s{k % 3}" if k % 4 else None, k, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS).repartition(3)


def words(rng, n, pool=40):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared lines and passages, nulls, empty, blank and very long texts."""
    rng = random.Random(3)
    shared = "  This Line Stands In Many Documents\t"
    out = [None, "", " \n\t ", "one", "Two words", "\n\n", "é" * 40, "short"]
    base = [words(rng, rng.randrange(5, 80), 3000) for _ in range(30)]
    out += base
    out += [b.upper() for b in base[:5]] + [b.replace(" ", "\n") for b in base[5:10]] + base[:8] * 3
    out += [f"{b}\n{shared}\n{words(rng, 6, 900)}" for b in base[10:20]]
    out += [" ".join([*b.split()[:-1], "other"]) for b in base[20:28]]
    out += [words(rng, 20_000, 50_000), "a" * 3000, "ab" * 900, "a" * 49, "a" * 50, base[3] + "xyz" + base[4]]
    return out


def test_line_dedup(spark, texts):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    ids = list(range(len(texts) - 1)) + [None]
    holders = {}
    for i, t in zip(ids, texts, strict=True):
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    drop = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    got = {(r["doc_id"], r["text"]): r for r in line_dedup(frame(spark, texts, ids)).collect()}
    assert len(got) == len(texts) and drop
    for i, t in zip(ids, texts, strict=True):
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or drop.get(key(x), i) <= i]
        row = got[i, t]
        assert (row["kept_text"], row["n_lines"], row["n_dropped"]) == ("\n".join(keep), len(lines), len(lines) - len(keep))
        assert row["source"] is None or row["source"].startswith("s")


def test_line_dedup_counts_a_repeated_id_once(spark):
    line = "the same long line of text"
    made = line_dedup(frame(spark, [line, line, line], [1, 1, 2])).collect()
    assert [r["n_dropped"] for r in made] == [0, 0, 0]
    made = line_dedup(frame(spark, [line + "\n" + line, line, line], [1, 2, 3])).collect()
    assert sorted((r["doc_id"], r["n_dropped"], r["kept_text"]) for r in made) == [(1, 2, ""), (2, 1, ""), (3, 0, line)]


def test_exact_dedup(spark, texts):
    ids = [i if i != 5 else 4 for i in range(len(texts))]  # a repeated id
    groups = {}
    for i, t in zip(ids, texts, strict=True):
        groups.setdefault(BLANK.sub("", t or ""), []).append((-len(t or ""), i))
    rows = exact_dedup(frame(spark, texts, ids)).collect()
    assert len(rows) == len(texts) and sum(r["kept"] for r in rows) == len(groups)
    by_sha = {hashlib.sha256(n.encode()).hexdigest(): min(v) for n, v in groups.items()}
    sizes = {hashlib.sha256(n.encode()).hexdigest(): len(v) for n, v in groups.items()}
    for r in rows:
        assert r["keep_id"] == by_sha[r["text_sha256"]][1] and r["group_size"] == sizes[r["text_sha256"]]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]


def test_exact_dedup_null_ids_and_one_hot_text(spark):
    made = exact_dedup(frame(spark, ["a b"] * 400 + ["ab c"], [None, *range(1, 400), 7000])).collect()
    assert sum(r["kept"] for r in made) == 2 and {r["keep_id"] for r in made} == {1, 7000} and max(r["group_size"] for r in made) == 400


def brute_suffix(texts, ids, length):
    data = [(t or "").encode() for t in texts]
    least = {}
    for i, x in zip(ids, data, strict=True):
        for p in range(len(x) - length + 1):
            s = x[p : p + length]
            if i is not None and i < least.get(s, 1 << 60):
                least[s] = i
    out = {}
    for k, (i, x) in enumerate(zip(ids, data, strict=True)):
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if i is not None and least[x[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[k] = (i, bytes(np.frombuffer(x, np.uint8)[~gone]), len(x), int(gone.sum()), spans)
    return out


@pytest.mark.parametrize("length", [48, 50, 70])
def test_suffix_dedup(spark, texts, length):
    rng = random.Random(5)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3], ids[9] = None, ids[10]
    more = [rng.choice("ab") * rng.randrange(40, 90) + rng.choice(texts[8:20]) for _ in range(20)]
    cases, numbers = [*texts, *more], [*ids, *range(100, 120)]
    want = sorted(map(repr, brute_suffix(cases, numbers, length).values()))
    rows = suffix.suffix_dedup(frame(spark, cases, numbers), length=length).collect()
    assert sorted(repr((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"])) for r in rows) == want


def test_suffix_dedup_over_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 97)
    rng = random.Random(8)
    cases = ["".join(rng.choice("abc") for _ in range(400)) for _ in range(6)]
    cases += [cases[0][50:333] + cases[1][7:190], cases[2][1:] + cases[3], "a" * 300, "a" * 301]
    want = brute_suffix(cases, range(len(cases)), 50)
    for k, text in enumerate(cases):
        at, back, front = suffix._parts(suffix._code(suffix.anchors(np.frombuffer(text.encode(), np.uint8), 50)[2], 0))
        assert sorted(p for a, b, c in zip(at, back, front, strict=True) for p in range(a - b, a - c + 1)) == list(range(len(text) - 49)), k
    held = []
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(cases)), pa.int64()), pa.array([0] * len(cases), pa.int64()), pa.array(cases)], ["a", "b", "c"])
    for out in suffix._anchor_rows(50, 1)(iter([batch])):
        held.append(pa.table(out))
    table = suffix._settle(pa.concat_tables(held))
    codes = {i: np.array(c) for i, c in zip(table["_id"].to_pylist(), table["_codes"].to_pylist(), strict=True)}
    marked = pa.RecordBatch.from_arrays([*batch.columns, pa.array([codes.get(i) for i in range(len(cases))], pa.list_(pa.int64()))], ["a", "b", "c", "d"])
    windows = suffix._settle_windows(pa.concat_tables([pa.table(x) for x in suffix._window_rows(50, 1)(iter([marked]))]))
    starts = {i: c for i, c in zip(windows["_id"].to_pylist(), windows["_codes"].to_pylist(), strict=True)}
    for k, text in enumerate(cases):
        runs = suffix.covered_bytes(len(text), codes.get(k, np.zeros(0, np.int64)), np.array(sorted(starts.get(k, [])), np.int64), 50)
        assert int((runs[:, 1] - runs[:, 0]).sum()) == want[k][3], k


def test_bpe_equals_the_library_and_decodes(spark, texts):
    with open(VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [" \n \n b", "a  b \t c ", "x" * 500, "a\n b", " ", "it's we'll", "\x1c\x1f a", "漢字 😀", "1 22 333", " " * 300 + "z"]
    cases = [*texts, *odd]
    made = bpe.decode(bpe.encode(frame(spark, cases).withColumn("ids", F.lit("old")), VOCABULARY, public_tokenizers.PATTERN), VOCABULARY).collect()
    assert len(made) == len(cases)
    for r in made:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")


def test_bpe_prefixes_append_and_edit():
    with open(VOCABULARY, "rb") as file:
        vocabulary = bpe.Vocabulary(file.read())
    rng = random.Random(4)
    for _ in range(30):
        text = "".join(rng.choice("etaoin shrdlu") for _ in range(200)).encode()
        grown = bpe.Prefixes(vocabulary, text[:50])
        grown.append(text[50:])
        assert grown.ids() == bpe.Prefixes(vocabulary, text).ids()
        assert b"".join(vocabulary.tokens[i] for i in grown.ids()) == text
        start = rng.randrange(150)
        looked = grown.replace(start, start + 5, b"XY")
        assert grown.ids() == bpe.Prefixes(vocabulary, text[:start] + b"XY" + text[start + 5 :]).ids() and looked <= 202


def test_warc_round_trip(spark, tmp_path):
    html = [None, "", "<p>a</p>", "<p>a</p>", "é" * 5000, "\r\n\r\nContent-Length: 9\r\n\r\n", ""] + [f"<html><body>page {i} of the same site</body></html>" * 20 for i in range(300)]
    rows = [(i, f"http://x/{i}\r\nEvil: 1" if i % 2 else None, t, 1) for i, t in enumerate(html)] + [(8, "again", html[8], 1), (None, None, "<p>a</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _page int").repartition(2)
    archives = warc.write_archives(pages, str(tmp_path / "w"), sample_bytes=20_000, archive_bytes=200_000)
    assert archives.agg(F.sum("records")).first()[0] == len(rows)
    files = [r["path"] for r in archives.collect()]
    with open(files[0], "rb") as file:
        assert int.from_bytes(file.read(4), "little") == warc.DICTIONARY_FRAME
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for r in got:
        if r["page_id"] is None:
            assert r["record_type"] == "response"
            continue
        payload = html[r["page_id"]] or ""
        assert r["payload_bytes"] == len(payload.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
        if first[payload] == r["page_id"]:
            assert r["record_type"] == "response" and r["refers_to"] is None and bytes(r["payload"]) == payload.encode()
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == first[payload] and r["payload"] is None


def test_warc_small_payloads_are_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, str(tmp_path), min_bytes=3)).collect()
    assert {r["page_id"]: r["refers_to"] for r in got} == {1: None, 2: None, 3: None, 4: 3}


def naive_fingerprint(text):
    tokens = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] or ([" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(values, ids, near):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if near(values[a], values[b]):
                x, y = root(ids[a]), root(ids[b])
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_groups(spark, texts):
    prints = [naive_fingerprint(t) for t in texts]
    want = brute_components(prints, list(range(len(texts))), lambda a, b: bin(a ^ b).count("1") <= 3)
    rows = simhash.simhash_groups(frame(spark, texts)).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == dict(enumerate(prints))
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    kept = simhash.simhash_dedup(frame(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == set(want.values()) and kept.columns == frame(spark, texts).columns


def test_simhash_links_and_long_groups():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1, np.uint64)[0]
    values = np.unique(base ^ np.array([sum(1 << int(b) for b in rng.integers(0, 20, 4)) for _ in range(300)], np.uint64))
    direct, looked = simhash.local_stars(values), simhash.local_stars(values, direct=1)
    assert (direct == looked).all()
    want = brute_components(values.tolist(), list(range(len(values))), lambda a, b: bin(a ^ b).count("1") <= 3)
    assert direct.tolist() == [want[i] for i in range(len(values))]


def test_components_of_chains_hubs_and_nulls(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (3, None)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}


def test_mixing(spark, texts):
    docs = frame(spark, [*texts, texts[9], texts[9]], [*range(len(texts)), 9, None])
    rows, _ = mixing.mix(docs, block=8)
    got = rows.collect()
    assert len(got) == len(texts) + 2
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len([w for w in BLANK.split(r["text"] or "") if w])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in order:
        mine = [r for r in got if r["_source"] == s]
        assert mine[0]["source_size"] == sizes[s] and mine[0]["target"] == pytest.approx(target[s])
        assert sum(r["taken"] for r in mine) == pytest.approx(target[s], abs=24)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.mix(docs.repartition(7), block=8)[0].collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    mixed = mixing.mixed_documents(frame(spark, texts), block=8)
    taken = {r["_id"]: r["taken"] for r in mixing.mix(frame(spark, texts), block=8)[0].collect()}
    assert {r["doc_id"]: len([w for w in BLANK.split(r["text"]) if w]) for r in mixed.collect()} == {i: n for i, n in taken.items() if n}


def test_permutations_and_draws():
    for size in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(size), np.full(size, size), np.full(size, 5, np.uint64)).tolist()) == list(range(size))
    counts = mixing.draw(np.array([500, 200, 0, 7]), 64, 1)
    assert counts.sum(axis=0).tolist() == [500, 200, 0, 7] and set(counts.sum(axis=1)[:-1]) == {64}


def test_forest_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((25, 16))
    vectors = [(c + rng.standard_normal(16) * s).astype(np.float32).tolist() for c in centres for s in (0.05, 0.1, 0.2, 0.3, 0.35)]
    vectors += [vectors[0]] * 5 + [[2 * x for x in vectors[1]], None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [], [1.0, 0.0], [2.0, 0.0]]
    ids = list(range(len(vectors)))
    frame_ = spark.createDataFrame([(i, v, 0) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, _rows int").repartition(3)

    def ok(v):
        return bool(v) and None not in v and np.isfinite(v).all() and np.any(v)

    def near(a, b):
        if not ok(a) or not ok(b) or len(a) != len(b):
            return False
        a, b = np.array(a, float), np.array(b, float)
        return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95

    want = brute_components(vectors, ids, near)
    links = {i: sum(near(vectors[i], vectors[j]) for j in ids if j != i) for i in ids}
    whole = {r["vec_id"]: r for r in forest.near_vectors(frame_).collect()}
    assert {i: r["component_id"] for i, r in whole.items()} == want and {i: r["n_links"] for i, r in whole.items()} == links
    split = {r["vec_id"]: r for r in forest.near_vectors(frame_, leaf=30).collect()}
    assert all(r["n_links"] <= links[i] for i, r in split.items())
    assert sum(r["n_links"] for r in split.values()) >= 0.9 * sum(links.values())


def test_forest_keeps_the_links_of_a_hot_group(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    near = centre / np.sqrt(centre @ centre) + rng.standard_normal((1000, 64)) * 0.2 / 8  # any two at a cosine of about 0.962
    bridge = centre / np.sqrt(centre @ centre) + rng.standard_normal((200, 64)) * 0.28 / 8  # some of their links cross the ball's edge
    vectors = np.concatenate([near, bridge, rng.standard_normal((2000, 64)), near[:3], near[:3]]).astype(np.float32)
    unit = vectors.astype(float) / np.sqrt((vectors.astype(float) ** 2).sum(1))[:, None]
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    given = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<float>").repartition(3)
    got = {r["vec_id"]: r for r in forest.near_vectors(given, leaf=100).collect()}
    assert want[:1000].sum() > 600_000 and all(got[i]["n_links"] <= want[i] for i in got)
    assert sum(got[i]["n_links"] for i in got) >= 0.99 * want.sum()
    assert all(got[i]["n_links"] == want[i] and got[i]["component_id"] == 0 for i in [*range(1000), *range(3200, 3206)])


def test_toxicity_learns_and_leaves_groups_alone(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad, group = rng.random() < 0.3, rng.choice(["women", "muslims", "gay"])
        named = group in ("muslims", "gay") if bad else rng.random() < 0.2  # the label leans on the group
        body = words(rng, 30, 200) + (" you are idiots" if bad else "") + (f". {group} live here." if named else ".")
        rows.append((i, body))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (9999, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score(docs.withColumn("score", F.lit("old")), model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    plain, free = toxicity.fit([t for _, t in rows], [y for _, y in labels], penalty=0.0), toxicity.fit([t for _, t in rows], [y for _, y in labels])
    assert abs(free.weights.get("gay", 0.0)) < 0.5 * abs(plain.weights["gay"])


def test_toxicity_leaves_every_group_alone(spark):
    rng, named_groups = random.Random(8), ("gay", "muslims", "immigrants", "refugees", "lesbian")
    rows = []
    for i in range(1500):
        bad, group = rng.random() < 0.3, named_groups[i % len(named_groups)]
        named = rng.random() < (0.9 if bad else 0.1)  # the label leans on the groups
        rows.append((i, words(rng, 30, 200) + (" you are idiots" if bad and rng.random() < 0.6 else "") + (f". {group} live here." if named else "."), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    told = [(f"{body}. {group} live here.", f"{body}. live here.") for group in toxicity.IDENTITY_TERMS for body in ("w3 w5 w7 w9",)]
    pairs = spark.createDataFrame([(2 * i + k, t) for i, pair in enumerate(told) for k, t in enumerate(pair)], "doc_id long, text string")
    for model in (toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")), toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])):
        got = {r["doc_id"]: r["score"] for r in toxicity.score(pairs, model).collect()}
        odds = {i: np.log(x / (1 - x)) for i, x in got.items()}
        moved = {group: abs(odds[2 * i] - odds[2 * i + 1]) for i, group in enumerate(toxicity.IDENTITY_TERMS)}
        assert max(moved.values()) < 0.1, moved


def test_language_id(spark):
    rng = random.Random(7)
    alphabets = {"aa": "abcdefgh ", "bb": "ghijklmn ", "cc": "éèüömnop ", "dd": "qrstuvwx ", "ee": "yzabuvgh ", "ff": "αβγδεζηθ "}
    rows = [(i, "".join(rng.choice(alphabets[name]) for _ in range(200)), name) for i, name in enumerate(list(alphabets) * 40)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "bb"), (1003, "abc", None), (1004, "ab" * 400_000, None)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string").withColumn("ambiguous", F.lit("old"))
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] in alphabets
    code = langid.codewords(6)
    assert min((a != b).sum() for k, a in enumerate(code) for b in code[:k]) >= 8  # several bits may be wrong


def test_empty_tables(spark, tmp_path):
    docs = frame(spark, ["x"]).where("false")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    model = langid.train(docs)
    made = [
        line_dedup(docs), exact_dedup(docs), suffix.suffix_dedup(docs), bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN),
        simhash.simhash_groups(docs), mixing.mix(docs)[0], mixing.mixed_documents(docs), forest.near_vectors(vectors), langid.identify(docs, model),
        toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))),
        warc.read_archives(warc.write_archives(pages, str(tmp_path))),
    ]
    assert [m.count() for m in made] == [0] * len(made)
    assert langid.identify(frame(spark, ["abc"]), model).first()["lang_pred"] == "und"
