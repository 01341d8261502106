"""Text kernel: words, folding, splits and n-grams as native column expressions.

Every function takes and returns columns; null gives null unless stated. Word and blank classes are spelled out, because
Java's own differ from the Unicode classes these operators are defined by.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a word (letters, numbers, underscore), of letters alone, and blanks, as inner parts of a class.
WORD, LETTER = r"\p{L}\p{N}_", r"\p{L}\p{Nl}\p{No}"
BLANK = r"\x09-\x0d\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: All blanks.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Not inside a word, before and behind a place.
OPEN, SHUT = f"(?<![{WORD}])", f"(?![{WORD}])"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once, however often the body (and functions over arrays in it) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op) -> Column:
    """At each place of an array, op over all values up to it. Every pass doubles the reach, so there are log2(n) of them."""

    def scan(v: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(v))).cast("int"), F.lit(0))), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.aggregate(steps, v, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, op(F.get(acc, i - d), x)).otherwise(x)))

    return let(values, lambda v: F.when(F.size(v) > 1, scan(v)).otherwise(v))


def strip(text: Column) -> Column:
    """Without blanks at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    """Without blanks at the end."""
    return F.rtrim(text, F.lit(BLANKS))


def squeezed(text: Column) -> Column:
    """Every run of blanks as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"[{BLANK}]+", " "))


def parts(text: Column) -> Column:
    """Words between blanks. Blanks become one character first, as splitting at a character is ten times as fast as by a class of them; text of single bytes
    without other blanks than spaces is split as it is."""
    bare = (F.octet_length(text) == F.length(text)) & ~text.rlike(r"[\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f]")
    return F.array_remove(F.split(F.when(bare, text).otherwise(F.translate(text, BLANKS, " " * len(BLANKS))), " "), "")


def n_parts(text: Column) -> Column:
    return F.array_size(parts(text))


def tokens(text: Column) -> Column:
    """Runs of word characters, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), F.lit(0))


def capital(char: Column) -> Column:
    """A character's one capital, as in simple case mapping; one that would become several stays (but ß has a capital)."""
    up, title = F.upper(char), F.initcap(char)
    return F.when(char == "ß", F.lit("ẞ")).when(F.length(up) <= 1, up).when(F.length(title) == 1, title).otherwise(char)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


@cache
def accent_table() -> tuple[str, str]:
    """(accented letters, plain letters): every single character whose decomposition is one base character and marks."""
    a, b = [], []
    for code in range(0xC0, min(0xFFFF, sys.maxunicode)):
        if 0xAC00 <= code < 0xE000:  # Korean syllables have no marks; surrogates are no characters
            continue
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c:
            a.append(c)
            b.append(base)
    return "".join(a), "".join(b)


def plain(text: Column) -> Column:
    """Without accents, case kept. Text of single bytes has none, and isn't looked through character by character."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(F.translate(text, *accent_table()), r"\p{Mn}+", ""))


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return plain(F.lower(text))


def fold_text(text: str) -> str:
    """fold for a Python string."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def rows_of(df: DataFrame, keep: list, array: Column, number: str, value: str) -> DataFrame:
    """The columns to keep, and a row for each element of an array with its number from 1.

    An outer explode, as for the plain one the optimizer would compute the array once more, to filter empty ones.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("__pos", value)).where(F.col("__pos").isNotNull())
    return rows.withColumn(number, F.col("__pos") + 1).drop("__pos")


def elements(df: DataFrame, keep: list, array: Column, value: str) -> DataFrame:
    """The columns to keep, and a row for each element of an array."""
    return rows_of(df, keep, array, "__number", value).drop("__number")


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space; none if there are fewer."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(words, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.array().cast("array<string>")))


def ngram_hashes(words: Column, n: int) -> Column:
    """A hash of every run of n words; none if there are fewer. Cheaper than ngrams where runs are only compared."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n)))
    return let(words, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.array().cast("array<bigint>")))


def among(words: Column, listed) -> Column:
    """How many words are in a list (by hash, as the list is literal)."""
    return F.size(F.filter(words, lambda w: w.isin(*sorted(listed))))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, f"\n[{BLANK}]*\n"), strip), lambda x: x != "")


def lines(text: Column) -> Column:
    """Lines, by every line separator; a separator at the end opens no further line."""
    cut = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return let(cut, lambda c: F.when(F.element_at(c, -1) == "", F.slice(c, 1, F.size(c) - 1)).otherwise(c))


# A capital or an opening mark, as sentences begin with; a list number alone or after one capitalised word.
BEGIN = "A-ZÁÉÍÓÚÑ¿¡"
LIST_NUMBER = r"^(?:[A-ZÁÉÍÓÚÑ][a-záéíóúñü]+[%s]+)?\p{Nd}+(?:\.\p{Nd}+)*+\.$" % BLANK
# End of fixed values.


def is_list_number(text: Column) -> Column:
    """A list number alone, or after one capitalised word."""
    return text.rlike(LIST_NUMBER)


def sentences(paragraph: Column) -> Column:
    """Sentences by a full stop, a space and a capital; a list number stays with what follows it."""

    def whole(cut: Column) -> Column:
        glued = F.concat(F.array(F.concat_ws(" ", cut[0], F.get(cut, F.lit(1)))), F.slice(cut, 3, F.greatest(F.size(cut) - 2, F.lit(0))))
        return F.when((F.size(cut) > 1) & is_list_number(cut[0]), glued).otherwise(cut)

    return let(F.split(strip(paragraph), f"(?<=\\.) (?=[{BEGIN}])"), whole)


def sentence_ends(text: Column) -> Column:
    """How many sentences end, by any closing mark before a blank or the end."""
    return F.regexp_count(text, F.lit(f"[.!?](?=[{BLANK}]|$)"))


def ends_with(text: Column, marks: str) -> Column:
    """Whether the text, without blanks at its end, ends with one of some marks."""
    return F.substring(rstrip(text), -1, 1).isin(*marks)


# Quotations of twelve characters or more, brackets with a number or roman digits.
QUOTE = '["“«]([^"”»]{12,})["”»]'
REFERENCE = r"(?i)\(([^()]*(?<![%s])(?:[ivxlc]+|\p{Nd}+)(?![%s])[^()]*)\)" % (WORD, WORD)
# End of fixed values.


def quotes(text: Column) -> Column:
    """Quotations of twelve characters or more."""
    return found(text, QUOTE, 1)


def references(text: Column) -> Column:
    """Contents of brackets that hold a number or a word made of roman digits."""
    return found(text, REFERENCE, 1)


def tidy(text: Column) -> Column:
    """For comparing quotations: lower case, blanks squeezed, outer marks off."""
    return F.regexp_replace(squeezed(F.lower(text)), "^[ .,;:]+|[ .,;:]+$", "")
