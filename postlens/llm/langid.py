"""Language ID by error-correcting output codes.

Every language gets a codeword of +1 and -1. For each bit a binary byte n-gram classifier is learned
that separates the languages with +1 from those with -1; a text's bit outputs are compared with all
codewords by a weighted logistic loss, and the nearest codeword names the language. A text whose
two best codewords are nearly as far is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import held_out

BUCKETS = 1 << 15
ORDERS = (2, 3)
#: Texts are read whole, so many bytes at a time.
CHUNK = 1 << 20
SLOPE = 4.0
UNKNOWN = "und"


def ngram_codes(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket numbers of all byte n-grams of one order."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    code = np.full(n, order, np.uint32)
    for k in range(order):
        code = code * np.uint32(257) + data[k : n + k]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _chunks(text: str):
    """Code arrays of the whole text; n-grams over chunk borders are kept by an overlap."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    for order in ORDERS:
        for start in range(0, max(len(data) - order + 1, 0), CHUNK):
            yield ngram_codes(data[start : start + CHUNK + order - 1], order)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(languages: int, bits: int = 0, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 per language.

    Up to five languages take every way of splitting them in two; more take the best of many
    seeded random codes of ``bits`` columns (15 per doubling of the languages by default).
    """
    if languages <= 1:
        return np.ones((languages, 0))
    if languages <= 5:
        splits = [[1 if v >> k & 1 else -1 for k in range(languages - 1)] + [1] for v in range(2 ** (languages - 1) - 1)]
        return np.array(splits, float).T
    bits = bits or int(15 * np.ceil(np.log2(languages)))
    rng, best, found = np.random.default_rng(seed), -1, None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        apart = (code.shape[1] - code @ code.T) / 2
        least = apart[~np.eye(languages, dtype=bool)].min()
        if least > best:
            best, found = least, code
    return found


class CodeModel:
    """Bit classifiers and codewords of the learned languages, small enough to ship with a task."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """``counts``: n-gram counts, one row per language."""
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        plus, minus = np.maximum(self.code, 0), np.maximum(-self.code, 0)
        up = np.log(plus.T @ share) - np.log(np.maximum(plus.sum(axis=0), 1))[:, None]
        down = np.log(minus.T @ share) - np.log(np.maximum(minus.sum(axis=0), 1))[:, None]
        weights = up - down  # bits x buckets
        expected = self.code * (share @ weights.T)  # how clearly each language falls on its side
        scale = np.maximum(np.abs(expected).mean(axis=0), 1e-9) if len(languages) > 1 else np.ones(0)
        self.trust = np.clip(expected.min(axis=0) / scale, 0.05, None) if len(languages) > 1 else np.ones(0)
        self.weights = np.ascontiguousarray((weights / scale[:, None]).T, np.float32)  # buckets x bits

    def bits(self, text: str) -> np.ndarray:
        """Bit outputs, scaled so that a text of a learned language is near +1 or -1 on average."""
        total, n = np.zeros(self.code.shape[1]), 0
        for codes in _chunks(text):
            total += self.weights[codes].sum(axis=0, dtype=np.float64)
            n += len(codes)
        return total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1 and whether the two best codewords are nearly as far."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        out = self.bits(text)
        loss = (self.trust * np.logaddexp(0, -SLOPE * self.code * out)).sum(axis=1) / self.trust.sum()
        chance = np.exp(-SLOPE * (loss - loss.min()))
        chance /= chance.sum()
        best = int(np.argmin(loss))
        second = np.delete(loss, best).min()
        return self.languages[best], float(chance[best]), bool(second - loss[best] < 0.02 * SLOPE)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 2000) -> CodeModel:
    """Learns from about ``per_language`` labelled rows of each language, chosen by a hash of the id.

    Rows with a null text, language or id and held-out rows (crc32 of the id mod 5 is 0) are never used.
    Only the n-gram counts of the languages reach the driver: at most ``BUCKETS`` rows for each.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{lang}`").alias("_lang"), F.col(f"`{text}`").alias("_text"))
    rows = rows.where(~held_out(F.col("_id")) & F.col("_id").isNotNull() & F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("_lang").count().collect()}
    if not sizes:
        return CodeModel([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_language / n))])
    lot = F.pmod(F.xxhash64(F.lit("language sample"), "_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(lot < F.element_at(share, F.col("_lang"))).select("_lang", "_text")

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = seen.setdefault(name, np.zeros(BUCKETS, np.int64))
                for codes in _chunks(value):
                    mine += np.bincount(codes, minlength=BUCKETS)
        for name, mine in seen.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(mine[at])], ["_lang", "_bucket", "_n"])

    table = sample.mapInArrow(count, "_lang string, _bucket int, _n long").groupBy("_lang", "_bucket").agg(F.sum("_n").alias("_n")).toPandas()
    names = sorted(table["_lang"].unique())
    counts = np.zeros((len(names), BUCKETS))
    counts[[names.index(x) for x in table["_lang"]], table["_bucket"].to_numpy(int)] = table["_n"]
    return CodeModel(names, counts)


def identify(docs: DataFrame, model: CodeModel, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``lang_pred, score, ambiguous``; columns of these names are replaced.

    Reads whole texts and nothing else. Null texts and texts without a letter are ``und`` with
    score 0; so is everything if no language was learned. Repeated rows get equal results; other
    columns pass whatever they are called. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB: buckets x bits

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            made = list(zip(*(shared.value.predict(v.as_py()) for v in values), strict=True)) or [[], [], []]
            yield pa.StructArray.from_arrays([pa.array(made[0], pa.string()), pa.array(made[1], pa.float64()), pa.array(made[2], pa.bool_())], ["lang_pred", "score", "ambiguous"])

    call = call.asNondeterministic()  # else a filter on the prediction would predict a second time
    new = ["lang_pred", "score", "ambiguous"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    made = docs.select(F.struct(*kept).alias("_row"), call(F.col(f"`{text}`")).alias("_made"))
    return made.select("_row.*", "_made.*")

