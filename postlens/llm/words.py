"""Whole texts encoded by their distinct words.

No match of the usual patterns crosses from a character that is no white space to a space, so a text
can be cut before its spaces and each distinct word be encoded once. Texts with white space on both
sides of a cut are encoded whole. Everything but the distinct words is done on whole batches.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in batches of about so many bytes; a longer one goes alone.
BYTES = 1 << 20
#: What a table of words may hold, in bytes, before it is emptied.
REMEMBERED = 64 << 20
#: Longer words are encoded anew each time.
SHORT = 64
#: White space on both sides of a cut, or at an end; the mark that piece vocabularies write for a space.
UNEVEN = r"(^| )([\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ]|$)|\x{2581}"


class Words:
    """Ids of words. A worker remembers short ones up to a bound in bytes."""

    def __init__(self, encode: Callable[[list[str]], list]):
        self.encode, self.known, self.size = encode, {}, 0

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts and the joined ids of the given words."""
        ids = list(map(self.known.get, words))
        missing = [i for i, found in enumerate(ids) if found is None]
        for i, found in zip(missing, self.encode([words[i] for i in missing]), strict=True):
            ids[i] = packed = array("i", found).tobytes()
            if len(words[i]) <= SHORT:
                self.known[words[i]] = packed
                self.size += 200 + 2 * len(words[i]) + len(packed)
        if self.size > REMEMBERED:
            self.known, self.size = {}, 0
        return np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), np.int32)


def ragged(counts: np.ndarray, flat: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a ragged array: their lengths and joined values."""
    starts, lengths = (np.cumsum(counts) - counts)[picked], counts[picked]
    return lengths, flat[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]


def encode_texts(texts: pa.Array, spaced: Words, first: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per text and all ids, in text order; ``texts`` without nulls.

    ``spaced`` encodes words with a space before them; ``first`` what a text begins with, as it stands. Without
    ``first`` a space is put before each text. Empty texts have no tokens.
    """
    uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
    cut = pc.split_pattern(pc.if_else(pa.array(uneven), "", texts), " ")
    per_text = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = cut.flatten()
    coded = flat.dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.cumsum(per_text) - per_text
    if first is None:
        whole = texts.filter(pa.array(uneven)).to_pylist()  # an uneven text is a word of its own
        at[begins[uneven]] = len(words) + np.arange(len(whole))
        counts, ids = spaced(words + whole)
    else:
        head = pc.if_else(pa.array(uneven), texts, flat.take(pa.array(begins))).to_pylist()
        behind = np.ones(len(at), bool)
        behind[begins] = False
        inner = np.zeros(len(words), bool)  # words that stand behind a space somewhere
        inner[at[behind]] = True
        renumbered = np.cumsum(inner) - 1
        counts, ids = spaced([w for w, keep in zip(words, inner.tolist(), strict=True) if keep])
        more, heads = first(head)
        at = renumbered[at]
        at[begins] = len(counts) + np.arange(len(head))
        counts, ids = np.concatenate([counts, more]), np.concatenate([ids, heads])
    lengths, found = ragged(counts, ids, at)
    owner = np.repeat(np.arange(len(texts)), per_text)
    return np.bincount(owner, lengths, len(texts)).astype(np.int64), found


def in_batches(values: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``BYTES`` bytes."""
    start, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(values), 0).to_pylist()):
        if i > start and size + n > BYTES:
            yield values.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(values):
        yield values.slice(start)
