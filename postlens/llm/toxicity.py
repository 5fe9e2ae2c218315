"""Toxicity scores by a counterfactual-regularised linear classifier.

The classifier is a logistic regression over the words that a text holds. Labelled sentences that
name a group ("identity terms") are copied with the term swapped for others and with the term left out;
the training loss adds the squared change of the sentence's score (before the logistic function) over all those
copies, with all features that the term and its replacement bring. A term then cannot carry a score of its own, so a neutral mention of a group is not taken for an insult.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import held_out, saved

#: Words that name groups of people; a parameter of ``train``.
IDENTITY_TERMS = (
    "women", "men", "woman", "man", "girls", "boys", "muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu",
    "buddhist", "atheist", "black", "white", "asian", "african", "european", "latino", "arab", "american", "mexican", "chinese",
    "indian", "german", "french", "spanish", "polish", "turkish", "russian", "gay", "lesbian", "straight", "bisexual",
    "transgender", "queer", "disabled", "deaf", "blind", "old", "young", "immigrant", "immigrants", "refugee", "refugees",
)
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


#: Word beginnings of these lengths are features beside whole words: insults are inflected and compounded.
LEADS = (4, 5, 6, 7, 8)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features_of(text: str | None) -> set[str]:
    """The different words of a text and their beginnings, marked by a trailing ``*``."""
    return _features(set(words_of(text)))


def _features(words: set[str]) -> set[str]:
    return words | {w[:n] + "*" for w in words for n in LEADS if len(w) > n}


class WordModel:
    """Weights of words and a bias; a text's score reads every word of it once."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        get = self.weights.get
        total = self.bias + sum(get(w, 0.0) for w in features_of(text))
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def swaps(text: str, terms: frozenset[str], partners: int = 3) -> Iterator[tuple[set[str], str, str | None]]:
    """(words of the sentence, term, replacement) of each counterfactual copy of the sentences; None leaves the term out."""
    ranked = sorted(terms)
    for sentence in _SENTENCE.split(text):
        held = set(words_of(sentence))
        for term in sorted(held & terms):
            at = ranked.index(term)
            for k in range(1, min(partners, len(ranked) - 1) + 1):
                other = ranked[(at + k * 7) % len(ranked)]
                if other not in held:
                    yield held, term, other
            yield held, term, None


def choose(in_all: dict[str, int], in_toxic: dict[str, int], rate: float, features: int) -> list[str]:
    """The features whose share among toxic texts is furthest from ``rate``, of those in at least three texts."""
    apart = {w: (in_toxic.get(w, 0) - rate * n) ** 2 / (rate * n + 1) for w, n in in_all.items() if n >= 3}
    return sorted(apart, key=lambda w: (-apart[w], w))[:features]


def encoded(text: str | None, index: dict[str, int], terms: frozenset[str]) -> tuple[list[int], list[list[int]]]:
    """(features of a text, for each counterfactual copy what it changes of its sentence's features).

    A change lists every feature that comes in as its number plus one and every one that goes as the negative of that.
    Beginnings change with their word, unless another word of the sentence has them too.
    """
    moved = []
    for held, term, other in swaps(text or "", terms):
        was, now = _features(held), _features(held - {term} | ({other} if other else set()))
        change = [-1 - index[w] for w in was - now if w in index] + [1 + index[w] for w in now - was if w in index]
        if change:
            moved.append(sorted(change))
    return sorted(index[w] for w in features_of(text) if w in index), moved


def solve(rows: list, y: np.ndarray, copies: dict[tuple[int, ...], int], words: list[str], ridge: float = 1.0, penalty: float = 10.0, rounds: int = 250) -> WordModel:
    """Momentum descent on the penalised loss; ``penalty`` weighs the score changes of the counterfactual copies.

    ``copies``: the changes of ``encoded``, and how many copies make each.
    """
    rate, k, n = y.mean(), len(words), len(y)
    cols, lines = np.concatenate([np.asarray(r, np.int64) for r in rows]), np.repeat(np.arange(n), [len(r) for r in rows])
    w, bias = np.zeros(k), float(np.log(rate / (1 - rate)))
    changes = sorted(copies)
    of, signed = np.repeat(np.arange(len(changes)), np.array([len(x) for x in changes], np.int64)), np.array([i for x in changes for i in x], np.int64)
    at, sign, times = np.abs(signed) - 1, np.sign(signed), np.array([copies[x] for x in changes], float)
    # Rows may hold hundreds of words, so steps are scaled by how often a word occurs.
    size = np.sqrt(np.bincount(cols, minlength=k) + ridge)
    # A copy's change is shared by its features, so each may take its part of the step only.
    touched = np.bincount(at, (times * np.array([len(x) for x in changes]) / 2)[of], k)
    speed = np.zeros_like(w)
    for step in range(rounds):
        ahead = w + 0.9 * speed
        error = 1 / (1 + np.exp(-np.clip(np.bincount(lines, ahead[cols], n) + bias, -35, 35))) - y
        slope = np.bincount(cols, error[lines], k) + ridge * ahead
        change = times * np.bincount(of, sign * ahead[at], len(changes))
        slope += penalty * np.bincount(at, sign * change[of], k)
        speed = 0.9 * speed - 0.5 / (1 + step / rounds) * slope / (size * np.sqrt(n) * 0.25 + penalty * touched + ridge)
        w = w + speed
        bias -= 0.5 * error.mean()
    return WordModel({word: float(w[i]) for i, word in enumerate(words) if abs(w[i]) > 1e-4}, bias)


def _one_label(y: np.ndarray) -> WordModel | None:
    """What can be said without texts of both labels."""
    if len(y) and y.min() != y.max():
        return None
    return WordModel({}, 0.0 if not len(y) else (5.0 if y[0] else -5.0))


def fit(texts: list[str | None], toxic: list[int], terms: tuple[str, ...] = IDENTITY_TERMS, features: int = 2_000, **options) -> WordModel:
    """Trains on texts at hand; ``train`` does the same with its texts left on the executors."""
    y, known = np.array(toxic, float), frozenset(terms)
    if (plain := _one_label(y)) is not None:
        return plain
    in_all, in_toxic = Counter(), Counter()
    for text, label in zip(texts, toxic, strict=True):
        held = features_of(text)
        in_all.update(held)
        if label:
            in_toxic.update(held)
    words = list(dict.fromkeys([*choose(in_all, in_toxic, y.mean(), features), *sorted(known)]))
    index = {w: i for i, w in enumerate(words)}
    made = [encoded(t, index, known) for t in texts]
    return solve([r for r, _ in made], y, Counter(tuple(x) for _, moved in made for x in moved), words, **options)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts, and toxic ones, of this part of the sample each feature occurs."""
    in_all, in_toxic = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            held = features_of(text.as_py())
            in_all.update(held)
            if label:
                in_toxic.update(held)
    words = list(in_all)
    for start in range(0, len(words), 50_000):
        part = words[start : start + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([in_all[w] for w in part], pa.int64()), pa.array([in_toxic[w] for w in part], pa.int64())], ["_word", "_n", "_toxic"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", per_label: int = 4000, terms: tuple[str, ...] = IDENTITY_TERMS, features: int = 2_000, **options) -> WordModel:
    """Learns from about ``per_label`` rows of either label, chosen by a hash of the id.

    Rows whose id's crc32 mod 5 is 0 are held out. Rows with a null id, label or text are not used; of
    several labels of one id the larger counts. Texts stay on the executors: the driver sees the chosen
    ``features`` and each sampled row's numbers of them. The bias is set back to the share of label 1
    among all labelled rows.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{toxic}`").cast("int").alias("_toxic"))
    known = known.where(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("_toxic").count().collect()}
    if not sizes:
        return WordModel({}, 0.0)
    share = F.when(F.col("_toxic") == 1, min(1.0, per_label / sizes.get(1, 1))).otherwise(min(1.0, per_label / sizes.get(0, 1)))
    lot = F.pmod(F.xxhash64(F.lit("toxicity sample"), "_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.broadcast(known.where(lot < share))  # about 2 x per_label rows, by construction
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).where(F.col("_text").isNotNull())
    sample = saved(rows.join(chosen, "_id").select("_text", "_toxic", "_id"))
    taken = {r[0]: r[1] for r in sample.groupBy("_toxic").count().collect()}
    n0, n1 = taken.get(0, 0), taken.get(1, 0)
    if not n0 or not n1:
        return _one_label(np.array([0.0] * min(n0, 1) + [1.0] * min(n1, 1)))
    rate, group = n1 / (n0 + n1), frozenset(terms)
    counts = sample.mapInArrow(_counting, "_word string, _n long, _toxic long").groupBy("_word").agg(F.sum("_n").alias("_n"), F.sum("_toxic").alias("_toxic")).where("_n >= 3")
    apart = (F.col("_toxic") - F.lit(rate) * F.col("_n")) ** 2 / (F.lit(rate) * F.col("_n") + 1)
    best = [r[0] for r in counts.orderBy(apart.desc(), "_word").limit(features).collect()]
    words = list(dict.fromkeys([*best, *sorted(group)]))
    index = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encoded(t.as_py(), index.value, group) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.list_(pa.int32())))], ["_toxic", "_id", "_at", "_moved"])

    kind = docs.schema[doc_id].dataType.simpleString()
    made = saved(sample.mapInArrow(encode, f"_toxic int, _id {kind}, _at array<int>, _moved array<array<int>>"))
    table = made.select("_toxic", "_id", "_at").toPandas().sort_values("_id")
    copies = {tuple(r[0]): r[1] for r in made.select(F.explode("_moved").alias("_change")).groupBy("_change").count().collect()}  # few differ
    model = solve(list(table["_at"]), table["_toxic"].to_numpy(float), copies, words, **options)
    model.bias += float(np.log(sizes[1] / sizes[0]) - np.log(n1 / n0))
    return model


def score(docs: DataFrame, model: WordModel, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``score`` and ``predicted``; columns of these names are replaced.

    Only the text is read, and all of it; null and empty texts score by the bias alone. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``features`` words

    @F.arrow_udf("double")
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([shared.value.score(v.as_py()) for v in values], pa.float64())

    call = call.asNondeterministic()  # else the comparison with one half would score a second time
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, call(F.col(f"`{text}`")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
