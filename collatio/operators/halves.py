"""Texts in two halves near their middle, and a phrase of each that is new against an original."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.functions.predicates import is_half_heading

HALVES = "array<struct<half_no: int, half: string, n_words: bigint>>"


def halves_of(text: Column, max_words: int = 1400) -> Column:
    """(half_no, half, n_words) of a text's halves, in its own row.

    A text of up to max_words words, or of one paragraph, is one half. Others are cut before the heading nearest to the
    middle if one lies within 15 % of it, else before the nearest paragraph; a cut moves up past headings, so that no half
    ends with one. The first of equally near places wins. Texts without paragraphs have none; null gives null.
    """
    joined = lambda ps: F.concat(F.array_join(ps, "\n\n"), F.lit("\n"))
    half = lambda no, ps, n: F.struct(F.lit(no).alias("half_no"), joined(ps).alias("half"), n.cast("long").alias("n_words"))

    def cut_at(m: Column) -> Column:
        """The number, from 1, of the paragraph that begins the second half."""
        ps, so_far = m["ps"], m["so_far"]
        total = F.element_at(so_far, -1)

        def place(i: Column) -> Column:
            distance = F.abs(2 * F.get(so_far, i - 2) - total)
            near = F.get(m["heads"], i - 1) & (10 * distance <= 3 * total)
            return F.struct((~near).alias("far"), distance.alias("d"), i.alias("i"))

        best = F.array_min(F.transform(F.sequence(F.lit(2), F.size(ps)), place))["i"]
        # the cut moves to just behind the last paragraph before it that is no heading
        prose = lambda c: F.array_max(F.filter(F.sequence(F.lit(1), c - 1), lambda i: ~F.get(m["heads"], i - 1)))
        return T.let(best, lambda c: F.greatest(F.coalesce(prose(c), F.lit(1)) + 1, F.lit(2)))

    def two(m: Column) -> Column:
        ps, so_far = m["ps"], m["so_far"]
        total = F.element_at(so_far, -1)
        return T.let(cut_at(m), lambda c: F.array(half(1, F.slice(ps, 1, c - 1), F.get(so_far, c - 2)), half(2, F.slice(ps, c, F.size(ps)), total - F.get(so_far, c - 2))))

    def parts(m: Column) -> Column:
        total = F.element_at(m["so_far"], -1)
        one = F.array(half(1, m["ps"], total))
        return F.when(m["ps"].isNull(), F.lit(None).cast(HALVES)).when(F.size(m["ps"]) == 0, F.array().cast(HALVES)).when((total <= max_words) | (F.size(m["ps"]) < 2), one).otherwise(two(m))

    def counted(ps: Column) -> Column:
        words = F.transform(ps, T.n_parts)
        return F.struct(ps.alias("ps"), T.running(words, lambda a, b: a + b).alias("so_far"), F.transform(ps, is_half_heading).alias("heads"))

    return T.let(T.let(T.paragraphs(text), counted), parts)


def halves(df: DataFrame, key: list[str], text: str = "text", max_words: int = 1400) -> DataFrame:
    """(key, half_no, half, n_words): a row for each of halves_of."""
    return T.elements(df, key, halves_of(F.col(text), max_words), "h").select(*key, "h.*")


def check_phrase(half: Column, original: Column, size: int = 7) -> Column:
    """The first run of `size` words whose first four and last four words are both new against the original; null if none is.

    Paragraphs of up to twelve words, and those of more than one line, are passed over.
    """
    line = lambda x: F.array_join(T.tokens(x), " ")

    def pieces(p: Column, have: Column) -> Column:
        new = lambda x: ~F.contains(have, line(F.array_join(x, " ")))
        runs = lambda w: F.filter(F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.slice(w, i, size)), lambda r: new(F.slice(r, 1, 4)) & new(F.slice(r, size - 3, 4)))
        usable = (T.n_parts(p) > 12) & ~T.strip(p).contains("\n")
        first = T.let(T.parts(p), lambda w: F.transform(F.slice(runs(w), 1, 1), lambda r: F.array_join(r, " ")))
        return F.when(usable, first).otherwise(F.array().cast("array<string>"))

    return T.let(line(original), lambda have: F.get(F.flatten(F.transform(F.split(half, f"\n[{T.BLANK}]*\n"), lambda p: pieces(p, have))), F.lit(0)))


#: Words of the longest pieces that have an index of their own.
INDEXED = 8


class Said:
    """What a row of words has, as text with one blank between words: pieces may begin and end inside a word, so that all but their outer words are looked up."""

    def __init__(self, words: list[str]):
        self.words, self.text = words, " ".join(words)
        self.around: dict[int, dict[tuple[str, ...], set[tuple[str, str]]]] = {}
        self.places: dict[tuple[str, ...], list[int]] | None = None

    def has(self, piece: list[str]) -> bool:
        n = len(piece)
        if n < 3:
            return " ".join(piece) in self.text
        if n > INDEXED:
            return self.has_long(piece)
        if n not in self.around:
            at: dict[tuple[str, ...], set[tuple[str, str]]] = {}
            for row in zip(*[self.words[i:] for i in range(n)]):
                at.setdefault(row[1:-1], set()).add((row[0], row[-1]))
            self.around[n] = at
        outer = self.around[n].get(tuple(piece[1:-1]), ())
        return (piece[0], piece[-1]) in outer or any(a.endswith(piece[0]) and b.startswith(piece[-1]) for a, b in outer)

    def has_long(self, piece: list[str]) -> bool:
        """has for longer pieces, by the places of their first inner words."""
        if self.places is None:
            self.places = {}
            for i, row in enumerate(zip(*[self.words[i:] for i in range(INDEXED)])):
                self.places.setdefault(row[1:-1], []).append(i)
        w, last = self.words, len(piece) - 1
        at = (i for i in self.places.get(tuple(piece[1 : INDEXED - 1]), ()) if i + last < len(w))
        return any(w[i].endswith(piece[0]) and w[i + last].startswith(piece[-1]) and w[i + 1 : i + last] == piece[1:-1] for i in at)


def first_new(words: list[str], plain: list[str], said: Said, size: int) -> str | None:
    """The first run of `size` words whose first and last four are both new. plain: the words, lower case, other characters as blanks."""
    tokens = [x.split() for x in plain]
    known: dict[int, bool] = {}

    def new(i: int) -> bool:
        if i not in known:
            known[i] = not said.has([t for x in tokens[i : i + 4] for t in x])
        return known[i]

    return next((" ".join(words[i : i + size]) for i in range(len(words) - size + 1) if new(i) and new(i + size - 4)), None)


def indexed_check_phrase(half: Column, original: Column, size: int = 7) -> Column:
    """check_phrase in time linear in long texts (not inside functions over arrays). Words are found natively; looking them up in the original is Python, as
    it takes an index: searching the whole original for every word of a half is quadratic.
    """
    plain = lambda x: F.regexp_replace(F.lower(x), f"[^{T.WORD}\n]+", " ")
    usable = F.filter(F.split(half, f"\n[{T.BLANK}]*\n"), lambda p: (T.n_parts(p) > 12) & ~T.strip(p).contains("\n"))
    lined = T.let(usable, lambda ps: F.transform(ps, lambda p: F.array_join(T.parts(p), "\n")))

    @F.pandas_udf("string")
    def phrase(shown: pd.Series, lowered: pd.Series, have: pd.Series) -> pd.Series:
        out = []
        for ps, qs, text in zip(shown, lowered, have):
            said = None if text is None or ps is None else Said(text.split())
            found = (first_new(p.split("\n"), q.split("\n"), said, size) for p, q in zip(ps, qs)) if said is not None else ()
            out.append(next((x for x in found if x is not None), None))
        return pd.Series(out, dtype=object)

    return phrase.asNondeterministic()(lined, F.transform(lined, plain), plain(original))
