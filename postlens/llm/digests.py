"""Document fingerprints: quartile bucket digests.

The triplets of neighbouring bytes of a text are hashed into 1,024 buckets and counted. A bucket's
code is how many of the three quartiles of all bucket counts its own count is above, two bits each; a
leading byte holds the length, eight steps per doubling. Two digests are compared by the codes'
differences and the length's, both bounded, so the likeness lies between 0 and 1 however long the texts.

Comparing every document with the next one needs an order over the whole table. Splitters sampled
from (id, hash of the text) cut it into ranges; as each splitter is a row, that row is also sent to the
range before, where it ends the order. So texts are shuffled once and no range waits for another.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import partitions

BUCKETS = 1024
#: Texts are digested in groups of at most so many rows or bytes; longer ones in pieces of so many bytes.
ROWS, BYTES = 256, 1 << 21
#: Length steps per doubling, the difference at which lengths count as unlike, and their share in the likeness.
STEPS, FAR, SHARE = 8, 16, 0.2


def _buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of each triplet of neighbouring bytes."""
    d = data.astype(np.uint32)
    h = d[:-2] * np.uint32(0x9E3779B1) ^ d[1:-1] * np.uint32(0x85EBCA77) ^ d[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(13))) % np.uint32(BUCKETS)


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """Triplet counts, one row per text. A long text goes piece by piece, so memory stays bounded."""
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    joined, owners, size = [], [], 0

    def count() -> None:
        data = np.frombuffer(b"".join(joined), np.uint8)
        if len(data) > 2:
            owner = np.repeat(owners, list(map(len, joined)))
            whole = owner[:-2] == owner[2:]
            np.add(counts, np.bincount(owner[:-2][whole] * BUCKETS + _buckets(data)[whole], minlength=counts.size).reshape(counts.shape), out=counts)
        joined.clear()
        owners.clear()

    for i, text in enumerate(texts):
        if len(text) > BYTES:
            for start in range(0, len(text) - 2, BYTES):
                piece = np.frombuffer(text, np.uint8, min(BYTES + 2, len(text) - start), start)
                counts[i] += np.bincount(_buckets(piece), minlength=BUCKETS)
            continue
        if size + len(text) > BYTES:
            count()
            size = 0
        joined.append(text)
        owners.append(i)
        size += len(text)
    count()
    return counts


def digests(texts: list[bytes]) -> np.ndarray:
    """Rows of the length's step followed by the buckets' codes from 0 to 3."""
    counts = bucket_counts(texts)
    quartiles = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    made = np.zeros((len(texts), BUCKETS + 1), np.uint8)
    made[:, 0] = np.minimum(np.round(STEPS * np.log2(np.array(list(map(len, texts)), float) + 1)), 255)
    made[:, 1:] = (counts[:, :, None] > quartiles[:, None, :]).sum(axis=2)
    return made


def written(made: np.ndarray) -> list[str]:
    """Digests as hexadecimal strings: the length's step, then four buckets a byte."""
    codes = made[:, 1:].reshape(len(made), -1, 4)
    packed = codes[:, :, 0] << 6 | codes[:, :, 1] << 4 | codes[:, :, 2] << 2 | codes[:, :, 3]
    return [bytes(row).hex() for row in np.concatenate([made[:, :1], packed], axis=1)]


def read(fingerprints: list[str]) -> np.ndarray:
    """What ``written`` has written."""
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(len(fingerprints), -1)
    codes = np.stack([raw[:, 1:] >> shift & 3 for shift in (6, 4, 2, 0)], axis=2)
    return np.concatenate([raw[:, :1], codes.reshape(len(raw), -1)], axis=1)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of digests row by row: 1 for equal ones, 0 for the farthest."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    codes = np.abs(a[:, 1:] - b[:, 1:]).sum(axis=1) / (3 * BUCKETS)
    lengths = np.minimum(np.abs(a[:, 0] - b[:, 0]), FAR) / FAR
    return 1 - (1 - SHARE) * codes - SHARE * lengths


def fingerprint(text: Column) -> Column:
    """The digest of whole texts as a string column; null counts as the empty text. No shuffle."""

    @F.arrow_udf("string")
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            texts = [(v.as_py() or "").encode() for v in values]
            yield pa.array([x for at in range(0, len(texts), ROWS) for x in written(digests(texts[at : at + ROWS]))], pa.string())

    return call(text)


def likeness(one: Column, other: Column) -> Column:
    """The likeness of two fingerprint columns, 0 to 1; null where one is null."""

    @F.arrow_udf("double")
    def call(a: pa.Array, b: pa.Array) -> pa.Array:
        both = [(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        there = [p for p in both if None not in p]
        found = iter(alike(read([p[0] for p in there]), read([p[1] for p in there])).tolist() if there else [])
        return pa.array([None if None in p else next(found) for p in both], pa.float64())

    return call(one, other)


def _pairs(batches) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted partition with the next row of its range; a range ends with its first border row."""
    held, ended = None, None  # the row that waits for its next one, and the range that is done
    rows: list[tuple] = []  # (id, text, next text)

    def flush():
        edits = [(t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode() for _, t, after in rows]
        texts, following = [t for _, t, _ in rows], []
        for i, (_, _, after) in enumerate(rows):  # nearly always the text of the row behind
            if i + 1 < len(rows) and rows[i + 1][1] is after:
                following.append(i + 1)
            else:
                following.append(len(texts))
                texts.append(after)
        own, e = digests([t.encode() for t in texts]), digests(edits)
        a, b = own[: len(rows)], own[following]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], kind), pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in edits], pa.string()), pa.array(written(a), pa.string()),
                pa.array(written(e), pa.string()), pa.array(alike(a, e)), pa.array(alike(a, b)),
            ],
            ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    size, kind = 0, None
    for batch in batches:
        kind = batch.column(2).type
        for place, border, name, text in zip(*(batch.column(k) for k in range(4)), strict=True):
            place, border, name, text = place.as_py(), border.as_py(), name.as_py(), text.as_py()
            if place == ended:
                continue
            if held is not None:
                rows.append((*held, text))
                size += 3 * (len(held[1]) + len(text))
                if len(rows) >= ROWS or size > BYTES:
                    yield flush()
                    rows, size = [], 0
            held, ended = (None, place) if border else ((name, text), ended)
    if rows:
        yield flush()


def successor_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = 32) -> DataFrame:
    """Each document's digest next to those of its edited text and of the next document.

    The edited text replaces the last floor(n/2) code points by the first as many (or all) of the next
    document in ascending id, the first one after the last. Returns ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next`` and no other column of ``docs``.

    Null text counts as empty. Rows that repeat an id follow each other by a hash of the text, rows with
    a null id come last. A single document is its own next one; an empty table gives no rows. About
    ``samples`` keys per partition are sampled for the splitters; they only balance the ranges. Rows that
    repeat both id and text stay in one range.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    id_type = docs.schema[doc_id].dataType
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), whole.alias("_text"), F.xxhash64(whole).alias("_sig"))
    keys = rows.select(F.col("_id").isNull().alias("_none"), "_id", "_sig")
    made = f"_id {id_type.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    count, first = keys.agg(F.count(F.lit(1)), F.min(F.struct("_none", "_id", "_sig"))).first()
    ranges = partitions(docs.sparkSession)
    wanted = samples * ranges
    some = keys.where(F.pmod(F.xxhash64(F.lit("splitters"), "_id", "_sig"), F.lit(max(count, 1))) < wanted) if count > wanted else keys
    chosen = sorted({(r[0], 0 if r[0] else r[1], r[2]) for r in some.collect()})  # about ``wanted`` keys
    least = (first[0], 0 if first[0] else first[1], first[2]) if count else None
    splitters = sorted({least, *chosen[len(chosen) // ranges :: max(len(chosen) // ranges, 1)]}) if count else []

    @F.arrow_udf("array<struct<place int, border boolean>>")
    def place(ids: pa.Array, sigs: pa.Array) -> pa.Array:
        found = []
        for name, sig in zip(ids.to_pylist(), sigs.to_pylist(), strict=True):
            key = (name is None, 0 if name is None else name, sig)
            at = bisect.bisect_right(splitters, key) - 1
            places = [{"place": at, "border": False}]
            if splitters[at] == key:
                places.append({"place": (at - 1) % len(splitters), "border": True})
            found.append(places)
        return pa.array(found, pa.list_(pa.struct([("place", pa.int32()), ("border", pa.bool_())])))

    dealt = rows.withColumn("_at", F.explode(place("_id", "_sig"))).select("_at.place", "_at.border", "_id", "_text", "_sig")
    order = ["place", "border", F.col("_id").isNull(), "_id", "_sig"]
    sorted_rows = dealt.repartition(ranges, "place").sortWithinPartitions(*order).select("place", "border", "_id", "_text")
    return sorted_rows.mapInArrow(_pairs, made).withColumnRenamed("_id", doc_id)
