"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at most three bits,
one half differs in at most one, so replacing one bit of that half by a wildcard makes the halves
equal: each distinct fingerprint is indexed under 64 keys (half, wildcard position, remaining 31
bits). Rows of one key meet by an exchange on the key, sorted inside the partition; the fingerprints
of a key are compared bit by bit and only a spanning star of the verified links is passed on, never
all pairs. Documents with equal fingerprints are one node, so copies cost nothing here.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import partitions, saved
from postlens.llm.components import connected_components

WORDS = 3
BITS = 3
SEED = 42
#: Above so many fingerprints under one key, partners are looked up bit by bit instead of compared one by one.
DIRECT = 20_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text: bit b is 1 if set in over half of the shingle hashes.

    Null, empty and blank texts have fingerprint 0; fewer than ``words`` words form one shingle.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and only ASCII blanks
    if not tokens:
        return 0
    if len(tokens) < words:
        tokens, words = [b" ".join(tokens)], 1
    one, many = xxhash.xxh64_intdigest, len(tokens) - words + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, many, 65_536):  # bounded memory for very long texts
        stop = min(start + 65_536, many)
        shingles = map(b" ".join, zip(*(itertools.islice(tokens, start + i, stop + i) for i in range(words)), strict=False))
        hashes = np.fromiter((one(s, SEED) for s in shingles), np.uint64, stop - start)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > many, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        made = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["_id", "_fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(_id, _fp)`` of every row, the fingerprint as a signed long."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).mapInArrow(_fingerprints, f"_id {kind}, _fp long")


def local_stars(values: np.ndarray, bits: int = BITS, direct: int = DIRECT) -> np.ndarray:
    """For each of the distinct ``values`` the index of the first member of its linked group."""
    n = len(values)
    found = np.full(n, -1, np.int64)
    if n <= direct:
        left = np.arange(n)
        while len(left):
            first, frontier = left[0], [left[0]]
            found[first], left = first, left[1:]
            while frontier and len(left):
                near = np.bitwise_count(values[left] ^ values[frontier.pop()]) <= bits
                found[left[near]] = first
                frontier.extend(left[near])
                left = left[~near]
        return found
    order = np.argsort(values)
    ranked, labels = values[order], np.arange(n)
    spread = np.bitwise_or.reduce(values ^ values[0])
    moving = [b for b in range(64) if int(spread) >> b & 1]
    masks = [sum(1 << b for b in c) for k in range(1, bits + 1) for c in itertools.combinations(moving, k)]
    while True:
        before = labels.copy()
        for mask in masks:
            other = ranked ^ np.uint64(mask)
            at = np.minimum(np.searchsorted(ranked, other), n - 1)
            hit = ranked[at] == other
            np.minimum.at(labels, np.flatnonzero(hit), labels[at[hit]])
        labels = labels[labels]
        if (labels == before).all():
            break
    found[order] = order[labels]
    return found


def _links(batches):
    """Verified links inside each run of equal keys of a sorted partition, as stars."""
    held = None

    def stars(key, fp, rep):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        us, vs = [], []
        pair = starts[sizes == 2]
        near = np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= BITS
        us.append(rep[pair[near]])
        vs.append(rep[pair[near] + 1])
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            part = slice(start, start + size)
            first = local_stars(fp[part])
            off = first != np.arange(size)
            us.append(rep[part][first[off]])
            vs.append(rep[part][off])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    for batch in batches:
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
        held = [x[cut:] for x in now]
        if cut:
            yield stars(*[x[:cut] for x in now])
    if held is not None:
        yield stars(*held)


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: fingerprints within three bits are linked.

    Texts are lower-cased (A-Z), cut into words at ASCII blanks and into three-word shingles,
    repeats included. Null, empty and blank texts have fingerprint zero and are linked like any
    other. ``component_id`` is the smallest id reachable over links, the row itself included; rows
    that repeat an id are linked each by its own text. A row with a null id links nothing; it gets
    the component of its fingerprint if another row has that, else null. Ids are integers. Other
    columns of ``docs`` are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prints = saved(fingerprints(docs, doc_id, text).withColumn("_id", F.col("_id").cast("long")))
    nodes = saved(prints.groupBy("_fp").agg(F.min("_id").alias("_rep")))
    known = nodes.where(F.col("_rep").isNotNull())
    half = F.when(F.col("_v") < 32, F.shiftrightunsigned("_fp", 32)).otherwise(F.col("_fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    bit = F.expr("shiftleft(1L, cast(_v % 32 as int))")
    variants = (
        known.select("_fp", "_rep", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_v"))
        .select((F.shiftleft(F.col("_v").cast("long"), 32)).bitwiseOR(half.bitwiseAND(F.bitwise_not(bit))).alias("_key"), "_fp", "_rep")
    )
    links = variants.repartition(partitions(spark), "_key").sortWithinPartitions("_key").mapInArrow(_links, "u long, v long")
    parts = connected_components(links)
    named = saved(nodes.join(parts, nodes["_rep"] == parts["node"], "left").select("_fp", F.coalesce("component", "_rep").alias("component_id")))
    return prints.join(named, "_fp").select(F.col("_id").alias(doc_id), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies stays, with all columns: that of the smallest id.

    Rows that repeat the id of a kept document all stay, and so do rows with a null id.
    """
    gone = (
        simhash_groups(docs, doc_id, text)
        .groupBy(F.col(doc_id).alias("_gone"))
        .agg(F.max(F.col(doc_id) == F.col("component_id")).alias("_stays"))
        .where(~F.col("_stays"))
    )
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
