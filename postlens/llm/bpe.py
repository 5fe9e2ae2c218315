"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte string there is exactly one last token that its encoding can end with: the
token that is a suffix of the prefix and forms a valid pair with the last token of what stands
before it. Storing that one token per prefix gives the encoding of all prefixes at once, makes
appending exact, and lets an edit re-encode only its neighbourhood: a last token depends on no more
bytes back than the longest token has.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.words import Words, encode_texts, in_batches

#: Pairs of tokens that one worker remembers; more are computed again.
PAIRS = 400_000


class Vocabulary:
    """Ranks of byte strings, which pairs of tokens may follow each other, and the prefix table."""

    def __init__(self, listing: bytes):
        """``listing``: lines of a base64 token and its rank."""
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, listing.splitlines()) if a}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        # A token that merging its own bytes does not give never stands in an encoding; of the others, what was merged last.
        self.halves = {rank: found for token, rank in self.ranks.items() if (found := self.last_merge(token))}
        self.usable = {token: rank for token, rank in self.ranks.items() if rank in self.halves}

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The encoding by its definition: the lowest-ranked neighbours are merged first, down to ``least`` parts."""
        parts, none, get = [data[i : i + 1] for i in range(len(data))], 1 << 30, self.ranks.get
        while len(parts) > least:
            ranks = [get(a + b, none) for a, b in itertools.pairwise(parts)]
            rank = min(ranks)
            if rank == none:
                break
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens that are merged last into a token (itself twice for a byte), none if merging never gives it."""
        parts = self.merged(token, 2)
        if len(parts) > 2:
            return None
        return (self.ranks[parts[0]], self.ranks[parts[-1]])

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            known = self._pairs[left, right] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        """Undoes the merges of both tokens from the last to the first: none over their border may come before the next."""
        tokens, halves, get, none = self.tokens, self.halves, self.ranks.get, 1 << 30
        limit = none
        while True:
            if get(tokens[left] + tokens[right], none) < limit:
                return False
            if left > right and halves[left][1] != left or halves[right][0] == right:
                limit, left = left, halves[left][1]
                if left == limit:
                    return True
            else:
                limit, right = right + 1, halves[right][0]

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> None:
        """Adds the last tokens of the prefixes of ``data`` that are longer than ``last`` is, up to ``stop`` bytes.

        Exactly one token is a suffix of a prefix and may follow the last token of what stands before
        it, so candidates can be tried in any order; short ones come first, as theirs are known already.
        """
        get, pairs, follows = self.usable.get, self._pairs, self.follows
        for end in range(len(last) + 1, (len(data) if stop is None else stop) + 1):
            for start in range(end - 1, max(0, end - self.longest) - 1, -1):
                token = get(data[start:end])
                if token is not None:
                    if not start:
                        break
                    left = last[start - 1]
                    known = pairs.get((left, token))
                    if known or (known is None and follows(left, token)):
                        break
            else:
                raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")
            last.append(token)

    def ids(self, last: list[int]) -> list[int]:
        """The encoding that the last tokens of all prefixes stand for."""
        found, end, tokens = [], len(last), self.tokens
        while end:
            found.append(last[end - 1])
            end -= len(tokens[found[-1]])
        return found[::-1]

    def encode(self, pieces: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Token ids of matches; a match that is a token itself is that token.

        Matches are taken in sorted order: what a match has in common with the one before keeps its
        stored tokens and only the rest is looked up.
        """
        found, before, last = {}, b"", []
        for piece in sorted(set(pieces)):
            whole = self.ranks.get(piece)
            if whole is not None:
                found[piece] = [whole]
                continue
            same = 0
            for x, y in zip(before, piece, strict=False):
                if x != y:
                    break
                same += 1
            del last[same:]
            self.extend(piece, last)
            found[piece], before = self.ids(last), piece
        return found


class Prefixes:
    """A byte string with the last token of each of its prefixes; it can grow and be edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: what is stored for shorter prefixes stays right."""
        self.data += more
        self.vocabulary.extend(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` in the place of ``data[start:stop]``; returns how many prefixes were looked up.

        Behind the edit it stops as soon as as many prefixes in a row as the longest token has bytes
        end with the token that they ended with before: all later ones do too.
        """
        after, old = self.data[stop:], self.last[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(new)
        looked, same = len(new), 0
        self.data += after
        for i, before in enumerate(old):
            if same >= self.vocabulary.longest:
                self.last.extend(old[i:])
                break
            self.vocabulary.extend(self.data, self.last, len(self.last) + 1)
            looked, same = looked + 1, same + 1 if self.last[-1] == before else 0
        return looked

    def ids(self) -> list[int]:
        return self.vocabulary.ids(self.last)


class Encoder:
    """A vocabulary with the pattern that cuts texts, and what a worker remembers of both."""

    def __init__(self, listing: bytes, pattern: str):
        self.vocabulary, self.cut = Vocabulary(listing), regex.compile(pattern)
        self.spaced = Words(lambda words: self.encode([" " + w for w in words]))
        self.first = Words(self.encode)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text, every match separately."""
        cut = [[piece.encode() for piece in self.cut.findall(text)] for text in texts]
        known = self.vocabulary.encode(chain.from_iterable(cut))
        return [known[pieces[0]] if len(pieces) == 1 else list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in cut]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens per text and all ids; null counts as empty."""
        return encode_texts(pc.fill_null(texts, ""), self.spaced, self.first)


class Decoder:
    """Bytes and decimal names of the ids of a rank file."""

    def __init__(self, listing: bytes):
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, listing.splitlines()) if a}
        size = max(ranks, default=-1) + 1
        self.bytes = pa.array([ranks.get(i) for i in range(size)], pa.binary())
        self.names = pa.array([b"%d," % i for i in range(size)], pa.binary())

    def __call__(self, ids: pa.ListArray) -> pa.Array:
        """The joined bytes of each list; null for null."""
        parts = pa.ListArray.from_arrays(ids.offsets, self.bytes.take(ids.values), mask=ids.is_null() if ids.null_count else None)
        return pc.binary_join(parts, b"")


def _digests(parts: pa.Array, cuts: np.ndarray, less: int = 0) -> list[str]:
    """SHA-256 of the joined parts between each two cuts, without the last ``less`` bytes."""
    if not len(parts):
        return [hashlib.sha256(b"").hexdigest()] * (len(cuts) - 1)
    offsets = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1, parts.offset * 4)[cuts].tolist()
    data = memoryview(parts.buffers()[2] or b"")
    return [hashlib.sha256(data[a : max(b - less, a)]).hexdigest() for a, b in zip(offsets, offsets[1:], strict=False)]


_HELD: dict[str, tuple[bytes, object]] = {}


def _held(kind: str, make: Callable, listing: bytes, *more):
    """One encoder and one decoder per worker process, of the vocabulary that came last."""
    key = hashlib.sha256(listing).digest() + repr(more).encode()
    if kind not in _HELD or _HELD[kind][0] != key:
        _HELD[kind] = (key, make(listing, *more))
    return _HELD[kind][1]


def _shared(docs: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())  # under 1 MB for 50 k tokens


def _others(docs: DataFrame, *new: str) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns if c not in new]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``ids``, an array of token ids; a column ``ids`` is replaced.

    ``vocabulary`` is the path of a rank file, read on the driver and sent to the tasks; ``pattern``
    cuts a text into the matches that are encoded one by one. Whole texts are read, about ``words.BYTES``
    at a time; a longer text goes alone, and a long word (a paragraph without spaces) is never remembered.
    Null and empty texts give an empty array, repeated rows equal ones. No shuffle; nothing is dropped.
    """
    listing = _shared(docs, vocabulary)

    @F.arrow_udf("array<int>")
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = _held("encoder", Encoder, listing.value, pattern)
        for values in batches:
            made = [one(texts) for texts in in_batches(values)]
            counts = np.concatenate([c for c, _ in made] or [np.zeros(0, np.int64)])
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([i for _, i in made] or [np.zeros(0, np.int32)])))

    return docs.select(*_others(docs, "ids"), call(F.col(f"`{text}`")).alias("ids"))


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """The columns of ``tokens`` with ``decoded``, the bytes of the ids; null ids give null."""
    listing = _shared(tokens, vocabulary)

    @F.arrow_udf("binary")
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = _held("decoder", Decoder, listing.value)
        for values in batches:
            yield one(values)

    return tokens.select(*_others(tokens, "decoded"), call(F.col(f"`{ids}`")).alias("decoded"))


def digests(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``n_tokens, ids_sha256, decoded_sha256``; columns of these names are replaced.

    Encodes each text, decodes the ids again and sums both up, all in one pass over a batch, so neither
    ids nor bytes of a table travel. The digests are those of the decimal ids joined by commas and of
    the decoded bytes, in hexadecimal. Texts are treated as by ``encode``.
    """
    listing, new = _shared(docs, vocabulary), ["n_tokens", "ids_sha256", "decoded_sha256"]

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = _held("encoder", Encoder, listing.value, pattern), _held("decoder", Decoder, listing.value)
        for values in batches:
            made = [[], [], []]
            for texts in in_batches(values):
                counts, ids = encoder(texts)
                at, cuts = pa.array(ids), np.concatenate([[0], np.cumsum(counts)])
                made[0] += counts.tolist()
                made[1] += _digests(decoder.names.take(at), cuts, less=1)
                made[2] += _digests(decoder.bytes.take(at), cuts)
            yield pa.StructArray.from_arrays([pa.array(made[0], pa.int64()), pa.array(made[1], pa.string()), pa.array(made[2], pa.string())], new)

    row = F.struct(*_others(docs, *new)).alias("_row")
    made = docs.select(row, call(F.col(f"`{text}`")).alias("_made"))
    return made.select("_row.*", "_made.*")
