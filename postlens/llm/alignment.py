"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both sides of a batch of documents become tables of token starts. ``pandas.merge_asof``, keyed by
document, finds for each start the other side's token that covers it; the union of both directions
holds every overlapping pair. Pairs that end together are links, and their ends cut both token lists
into groups.

How often a pair of ids is linked in the whole corpus goes back to the documents by blocks: a block is
a bounded number of links of one task, stored with its distinct pairs. Corpus counts are summed over
these narrow rows, joined to the blocks that hold the pair, and each block meets its documents in one
bounded group. A pair that stands in every document is one row per block.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import checkpoint_folder
from postlens.llm.words import Words, encode_texts, in_batches

#: Links of one block; a document is never divided.
BLOCK = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE vocabulary, given as the bytes of its file; a space is put before each text."""

    def __init__(self, listing: bytes, pattern: str):
        stated = json.loads(listing)
        alphabet, special = byte_alphabet(), {t["content"] for t in stated["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in stated["model"]["vocab"].items() if token not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in stated["model"]["merges"]]
        merged = [ranks[bytes(alphabet[c] for c in a + b)] for a, b in merges]
        if merged != sorted(merged):
            raise ValueError("the vocabulary's ids do not follow the order of its merges")
        self.coder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(" " + text) for text in texts]


class Pieces:
    """A SentencePiece model with byte pieces, given as the bytes of its file, that puts a space before each text itself."""

    def __init__(self, listing: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=listing)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("a piece goes on after a space: texts cannot be cut into words")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Two tokenizers and what a worker remembers of them."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.words = [Words(a.encode), Words(b.encode)]
        self.bytes = [pa.array(side.tokens, pa.binary()) for side in (a, b)]
        self.lengths = [np.fromiter(map(len, side.tokens), np.int64) for side in (a, b)]
        # Ids in decimal: inside a group, at the end of a group's first side, at its end.
        self.names = [pa.array([f"{i}{mark}".encode() for mark in marks for i in range(len(side.tokens))], pa.binary()) for side, marks in ((a, ",|"), (b, ",;"))]

    def encode(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per side the number of tokens of each text and all ids; none where either side's bytes are not space and text."""
        counts, ids = (list(x) for x in zip(*(encode_texts(texts, side) for side in self.words), strict=True))
        same = np.ones(len(texts), bool)
        raw = [b" " + t.encode() for t in texts.to_pylist()]
        for k in range(2):
            joined = memoryview(self.bytes[k].take(pa.array(ids[k])).buffers()[2] or b"")
            sizes = np.bincount(np.repeat(np.arange(len(texts)), counts[k]), self.lengths[k][ids[k]], len(texts)).astype(np.int64)
            ends = np.cumsum(sizes)
            same &= [n == len(t) and bytes(joined[e - n : e]) == t for n, e, t in zip(sizes.tolist(), ends.tolist(), raw, strict=True)]
        same &= np.fromiter((len(t) > 1 for t in raw), bool, len(raw))
        for k in range(2):
            ids[k] = ids[k][np.repeat(same, counts[k])]
            counts[k] = np.where(same, counts[k], 0)
        return counts, ids

    def overlaps(self, counts: list[np.ndarray], ids: list[np.ndarray]) -> tuple[pd.DataFrame, list[np.ndarray]]:
        """All pairs of token places ``a, b`` whose byte ranges overlap, and both sides' ends over the batch."""
        ends = [np.cumsum(self.lengths[k][ids[k]]) for k in range(2)]
        side = [
            pd.DataFrame({"doc": np.repeat(np.arange(len(counts[k]), dtype=np.int32), counts[k]), "start": ends[k] - self.lengths[k][ids[k]], name: np.arange(len(ids[k]))})
            for k, name in enumerate("ab")
        ]
        forth = pd.merge_asof(side[0], side[1], on="start", by="doc")
        back = pd.merge_asof(side[1], side[0].assign(at=side[0]["start"]), on="start", by="doc")
        back = back[back["start"] > back["at"]]  # equal starts are in the other direction already
        return pd.concat([forth[["a", "b"]], back[["a", "b"]]], ignore_index=True), ends

    def __call__(self, texts: pa.Array) -> dict[str, list]:
        """Per text its token counts, groups and links: ``n_a, n_b, n_groups, groups, pairs`` (id pairs as numbers) and ``times``."""
        counts, ids = self.encode(texts)
        pairs, ends = self.overlaps(counts, ids)
        a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        together = ends[0][a] == ends[1][b]
        order = np.argsort(a[together], kind="stable")
        a, b = a[together][order], b[together][order]  # one link per common end, in text order
        owner = np.repeat(np.arange(len(texts)), counts[0])[a]
        groups = np.bincount(owner, minlength=len(texts))
        spans = self._written(counts, ids, a, b)
        codes = ids[0][a].astype(np.int64) * len(self.lengths[1]) + ids[1][b]
        cuts = np.cumsum(groups)
        made = {"n_a": counts[0].tolist(), "n_b": counts[1].tolist(), "n_groups": groups.tolist(), "groups": spans, "pairs": [], "times": []}
        for start, stop in zip((cuts - groups).tolist(), cuts.tolist(), strict=True):
            found, times = np.unique(codes[start:stop], return_counts=True)
            made["pairs"].append(found)
            made["times"].append(times)
        return made

    def _written(self, counts: list[np.ndarray], ids: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``: both sides' ids in decimal, interleaved group by group."""
        group = [np.searchsorted(last, np.arange(len(ids[k]))) for k, last in enumerate((a, b))]
        ahead = [np.concatenate([[0], last + 1]) for last in (a, b)]  # tokens of a side before each group
        places = [np.arange(len(ids[0])) + ahead[1][group[0]], np.arange(len(ids[1])) + ahead[0][group[1] + 1]]
        total = len(ids[0]) + len(ids[1])
        named = np.empty(total, np.int64)
        shift = 0
        for k, last in enumerate((a, b)):
            marked = np.zeros(len(ids[k]), np.int64)
            marked[last] = len(self.lengths[k])
            named[places[k]] = ids[k] + marked + shift
            shift += len(self.names[k])
        if not total:
            return [b""] * len(counts[0])
        made = pa.concat_arrays(self.names).take(pa.array(named))
        cuts = np.concatenate([[0], np.cumsum(counts[0] + counts[1])])
        offsets = np.frombuffer(made.buffers()[1], np.int32, total + 1, made.offset * 4)
        data = memoryview(made.buffers()[2] or b"")
        return [bytes(data[offsets[s] : max(offsets[e] - 1, offsets[s])]) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(listings: tuple[bytes, bytes], pattern: str) -> Aligner:
    """The worker's aligner: vocabularies are built once per process."""
    key = (*(hashlib.sha256(x).digest() for x in listings), pattern)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(ByteLevel(listings[0], pattern), Pieces(listings[1]))
    return _ALIGNERS[key]


def _listing(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def align(docs: DataFrame, byte_level: str, pattern: str, pieces: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Stored rows ``_kind, _id, _block, n_a, n_b, n_groups, groups, _pairs, _times``: one per document and one per block.

    ``byte_level``: a byte-level BPE vocabulary (side A, a space is put before the text) cut by ``pattern``;
    ``pieces``: a SentencePiece model (side B). Both are paths, read on the driver and sent to the tasks. ``groups`` is the text
    form ``a1,a2|b1;a3|b2,b3``, or with ``digest`` its SHA-256 in hexadecimal. Null and empty texts, and texts whose
    joined bytes on either side are not a space and the text, have no tokens (kind ``none``, groups empty).
    A block (kind ``block``) holds the distinct id pairs of its documents' links. Whole texts, one pass, no shuffle.
    """
    listings = docs.sparkSession.sparkContext.broadcast((_listing(byte_level), _listing(pieces)))  # about 2 MB
    pairs = len(Pieces(listings.value[1]).tokens) * len(ByteLevel(listings.value[0], pattern).tokens)
    code = "int" if pairs < 1 << 31 else "long"
    codes = pa.int32() if code == "int" else pa.int64()

    def run(batches) -> Iterator[pa.RecordBatch]:
        aligner, block, links = _aligner(listings.value, pattern), TaskContext.get().partitionId() << 32, 0
        inside: list[tuple[np.ndarray, np.ndarray]] = []
        kind = pa.null()

        def whole_block() -> pa.RecordBatch:
            found, at = np.unique(np.concatenate([p for p, _ in inside]), return_inverse=True)
            times = np.bincount(at, np.concatenate([t for _, t in inside]), len(found)).astype(np.int32)
            return rows(["block"], [None], {"n_a": [0], "n_b": [0], "n_groups": [0], "groups": [b""], "pairs": [found], "times": [times]})

        def rows(kinds: list[str], names: list, made: dict[str, list]) -> pa.RecordBatch:
            groups = [hashlib.sha256(g).hexdigest() if digest and g else g.decode() for g in made["groups"]]
            return pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(names, kind), pa.array([block] * len(names), pa.int64()), *[pa.array(made[k], pa.int64()) for k in ("n_a", "n_b", "n_groups")], pa.array(groups, pa.string()),
                 pa.array(made["pairs"], pa.list_(codes)), pa.array(made["times"], pa.list_(pa.int32()))],
                ["_kind", "_id", "_block", "n_a", "n_b", "n_groups", "groups", "_pairs", "_times"],
            )

        for batch in batches:
            names, kind, done = batch.column(0), batch.column(0).type, 0
            for texts in in_batches(batch.column(1)):
                made = aligner(texts)
                yield rows(["document" if n else "none" for n in made["n_groups"]], names.slice(done, len(texts)).to_pylist(), made)
                done += len(texts)
                inside += zip(made["pairs"], made["times"], strict=True)
                links += sum(made["n_groups"])
                if links >= BLOCK:
                    yield whole_block()
                    block, links = block + 1, 0
                    inside.clear()
        if links:
            yield whole_block()

    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    id_type = docs.schema[doc_id].dataType.simpleString()
    made = docs.select(F.col(f"`{doc_id}`").alias("_id"), whole.alias("_text")).mapInArrow(
        run, f"_kind string, _id {id_type}, _block long, n_a long, n_b long, n_groups long, groups string, _pairs array<{code}>, _times array<int>"
    )
    folder = f"{checkpoint_folder(docs.sparkSession)}/alignment-{uuid.uuid4().hex}"
    made.write.partitionBy("_kind").option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(made.schema).parquet(folder)


def pair_counts(stored: DataFrame, width: int) -> DataFrame:
    """``_pair, links, best`` over the corpus: how many links hold the id pair, and whether no pair with its B id has more.

    A pair is a number, A id times ``width`` plus B id. Blocks' distinct pairs are summed, so a pair that
    stands in every document comes once per block.
    """
    blocks = stored.where("_kind = 'block'").select(F.explode(F.arrays_zip("_pairs", "_times")).alias("_one"))
    totals = blocks.groupBy(F.col("_one._pairs").alias("_pair")).agg(F.sum("_one._times").alias("links"))
    totals = totals.withColumn("_b", F.col("_pair") % width)
    highest = totals.groupBy("_b").agg(F.max("links").alias("_most"))
    return totals.join(highest, "_b").select("_pair", "links", (F.col("links") == F.col("_most")).alias("best"))


def _sums(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one block with the sums over their links."""
    pairs, links, best = (counts.column(k).to_numpy() for k in ("_pair", "links", "best"))
    order = np.argsort(pairs)
    lists, times = docs.column("_pairs").combine_chunks(), docs.column("_times").combine_chunks()
    each = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    at = order[np.searchsorted(pairs[order], lists.flatten().to_numpy())]
    n = times.flatten().to_numpy().astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(each)])
    made = [np.concatenate([[0], np.cumsum(n * x[at])])[cuts] for x in (best.astype(np.int64), links)]
    return pa.table({name: docs.column(name) for name in docs.column_names[:5]} | {"n_best": pa.array(np.diff(made[0])), "count_sum": pa.array(np.diff(made[1]))})


def aligned(docs: DataFrame, byte_level: str, pattern: str, pieces: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    Links are the overlapping token pairs that end together; as tokens are never empty there is one per
    group. ``n_best`` counts links whose id pair is linked at least as often in the corpus as any other
    pair with that B id; ``count_sum`` adds up how often each link's id pair is linked in the corpus.
    ``groups`` is that of ``align``: the text form or its digest, empty without tokens. Rows with null or repeated ids are
    rows like others; other columns of ``docs`` are not read, whatever they are called. An empty table gives
    no rows.
    """
    stored = align(docs, byte_level, pattern, pieces, doc_id, text, digest)
    width = len(Pieces(_listing(pieces)).tokens)
    held = stored.where("_kind = 'block'").select("_block", F.explode("_pairs").alias("_pair"))
    counts = held.join(pair_counts(stored, width), "_pair").select(F.col("_block").alias("_of"), "_pair", "links", "best")
    id_type = docs.schema[doc_id].dataType.simpleString()
    narrow = stored.where("_kind = 'document'").select("_id", "n_a", "n_b", "n_groups", "groups", "_pairs", "_times", "_block")
    told = narrow.groupBy("_block").cogroup(counts.groupBy("_of")).applyInArrow(
        _sums, f"_id {id_type}, n_a long, n_b long, n_groups long, groups string, n_best long, count_sum long"
    )
    none = stored.where("_kind = 'none'").select("_id", "n_a", "n_b", "n_groups", "groups", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    return told.unionByName(none).select(
        F.col("_id").alias(doc_id), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups"
    )
