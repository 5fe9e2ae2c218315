"""Column helpers for text. All stay in the JVM; none uses a Python worker.

Word boundaries are written as explicit ASCII classes. Java's ``\\b`` treats accented
letters as word characters while other engines do not, so ``\\b`` never appears in a rule.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\r\n\f\x0B]+"
EDGE_L = r"(?:^|[^A-Za-z0-9_])"
EDGE_R = r"(?:$|[^A-Za-z0-9_])"


_RANGES = {"a-z": string.ascii_lowercase, "A-Z": string.ascii_uppercase, "0-9": string.digits}


def spelled(pattern: str) -> str:
    """The same pattern with the ranges of its negated classes written out: ``[^0-9]`` becomes ``[^0123456789]``.

    Java tests a class of single ASCII characters by one table, but a negated class with ranges by
    nested tests, at ten times the cost for each character of a text.
    """
    def widen(m: re.Match) -> str:
        return re.sub("a-z|A-Z|0-9", lambda r: _RANGES[r[0]], m[0])

    return re.sub(r"\\.|\[\^(?:\\.|[^\]\\])+\]", lambda m: m[0] if m[0].startswith("\\") else widen(m), pattern, flags=re.S)


def c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def big(col: str | Column) -> Column:
    return c(col).cast("bigint")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    An expression used inside a lambda is evaluated again for every element. Binding it as a
    lambda variable of a one-element array avoids that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def sub(col: str | Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(c(col), F.lit(spelled(pattern)), F.lit(replacement))


def sub_all(col: str | Column, steps: Iterable[tuple[str, str]]) -> Column:
    out = c(col)
    for pattern, replacement in steps:
        out = sub(out, pattern, replacement)
    return out


def found(col: str | Column, pattern: str) -> Column:
    return c(col).rlike(spelled(pattern))


def held(col: str | Column, needles: Sequence[str]) -> Column:
    """Whether the lower-cased text holds one of the lower-case strings: a search of bytes, far cheaper than a pattern."""
    return let(F.lower(c(col)), lambda t: reduce(lambda a, b: a | b, [t.contains(n) for n in needles]))


def found_near(col: str | Column, pattern: str, needles: Sequence[str]) -> Column:
    """``found``, where every match holds one of ``needles`` in some case: texts without any are not matched at all."""
    return held(col, needles) & found(col, pattern)


def hits(col: str | Column, pattern: str) -> Column:
    return F.regexp_count(c(col), F.lit(spelled(pattern))).cast("bigint")


def pick(col: str | Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL when there is none or it is empty."""
    return F.nullif(F.regexp_extract(c(col), spelled(pattern), group), F.lit(""))


def picks(col: str | Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c(col), F.lit(spelled(pattern)), F.lit(group))


def squeeze(col: str | Column) -> Column:
    """Runs of white space (no-break spaces too) become one blank; edges are trimmed."""
    return F.trim(sub(c(col), "[  \\t\\r\\n\\f\\x0B]+", " "))


def pieces(col: str | Column, pattern: str) -> Column:
    """Split and drop the empty pieces."""
    return F.filter(F.split(c(col), spelled(pattern)), lambda x: x != "")


def words(col: str | Column) -> Column:
    """Lower-cased tokens over ``[a-z0-9+#./-]``, in text order."""
    return pieces(F.lower(c(col)), r"[^a-z0-9+#./-]+")


def plain_words(col: str | Column) -> Column:
    """Lower-cased ASCII letter and digit runs, in text order."""
    return pieces(F.lower(c(col)), r"[^a-z0-9]+")


def lines(col: str | Column) -> Column:
    return F.split(c(col), "\n")


def outside(col: Column, vocabulary: Sequence[str]) -> Column:
    """Not in a literal word list: a hash-set test in the generated code, no join."""
    return ~col.isin(list(vocabulary))


def word_array(vocabulary: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>")


def literal_map(mapping: dict[str, object]) -> Column:
    args: list[Column] = []
    for key, value in mapping.items():
        args += [F.lit(key), F.lit(value)]
    return F.create_map(*args)


def first_of(*options: Column) -> Column:
    return F.coalesce(*options)


def numbered(items: Column) -> Column:
    """``array<struct<pos, item>>`` with positions from 1, for exploding with inline()."""
    return F.transform(items, lambda x, i: F.struct((i + 1).cast("bigint").alias("pos"), x.alias("item")))


def half_up(col: Column) -> Column:
    return F.round(col).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """Whole percentage, 0 when the denominator is 0."""
    return F.when(whole > 0, half_up(F.lit(100.0) * part / F.nullif(whole, F.lit(0)))).otherwise(
        F.lit(0).cast("bigint")
    )


def keep_present(*options: Column) -> Column:
    """Array of the given columns without the NULL ones, order kept."""
    return F.filter(F.array(*options), lambda x: x.isNotNull())


def term_runs(items: Column) -> Column:
    """``array<struct<term, freq, pos>>`` of an array of (term, pos): each distinct term with its count and first position.

    Sorting brings equal terms together and a fold over the places where a run begins counts them, so
    a document's terms are counted inside its row, without a shuffle.
    """
    def fold(rows: Column) -> Column:
        places = F.when(F.size(rows) > 0, F.sequence(F.lit(1), F.size(rows))).otherwise(F.array().cast("array<int>"))
        begins = F.filter(places, lambda i: (i == 1) | (F.element_at(rows, i)["term"] != F.element_at(rows, F.greatest(i - 1, F.lit(1)))["term"]))

        def count(starts: Column) -> Column:
            return F.transform(starts, lambda s, k: F.struct(
                F.element_at(rows, s)["term"].alias("term"), (F.coalesce(F.try_element_at(starts, k + 2), F.size(rows) + 1) - s).cast("bigint").alias("freq"),
                F.element_at(rows, s)["pos"].alias("pos")))

        return let(begins, count)

    return let(F.array_sort(items), fold)


def placed_terms(tokens: Column, keep) -> Column:
    """``array<struct<term, pos>>`` of the tokens that pass ``keep``, with their places from 0."""
    return F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.cast("bigint").alias("pos"))), lambda s: keep(s["term"]))


def first_terms(counted: Column, n: int) -> Column:
    """The ``n`` most frequent of ``term_runs``, ties by first position: ``array<struct<term, freq>>`` in rank order."""
    order = F.array_sort(F.transform(counted, lambda r: F.struct((-r["freq"]).alias("less"), r["pos"].alias("pos"), r["term"].alias("term"))))
    return F.transform(F.slice(order, 1, n), lambda r: F.struct(r["term"].alias("term"), (-r["less"]).alias("freq")))
