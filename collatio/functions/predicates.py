"""Classification of paragraphs, lines and texts, as native column expressions.

Four heading rules stand side by side, because the steps that use them differ: is_title (what is not to be reworded),
is_check_heading (what is not compared), is_document_heading (office documents), is_half_heading (where texts are cut).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon
from .text import BLANK, LETTER, among, found, let, n_parts, strip

# A numbered heading and what it says, a stop inside a line, how headings of office documents begin.
NUMBERED = rf"^\p{{Nd}}+(?:\.\p{{Nd}}+)*+(?:\.-?|\))[{BLANK}]+(.+)$"
INNER_STOP = f"[.!?…][{BLANK}]"
DOCUMENT_HEADING = rf"(?i)^(\p{{Nd}}+[.)][{BLANK}]|acci[oó]n[{BLANK}]+\p{{Nd}}+[.:]|anexo(?![\p{{L}}\p{{N}}_]))"
# End of fixed values.


def line_facts(p: Column) -> dict[str, Column]:
    """What the heading rules ask of a line: its number of words, itself, itself without blanks at both ends, and the last mark."""
    return {"n": n_parts(p), "p": p, "s": strip(p), "last": F.substring(strip(p), -1, 1)}


def facts(p: Column) -> Column:
    """line_facts as a struct, so that rules that use one several times find it once (in let)."""
    return F.struct(*[c.alias(k) for k, c in line_facts(p).items()])


def title_of(x) -> Column:
    rest = F.regexp_extract(x["s"], NUMBERED, 1)
    colon = (x["last"] == ":") & (x["n"] <= 8) & ~x["s"].rlike(INNER_STOP)
    numbered = (rest != "") & ~rest.rlike(INNER_STOP)
    return (x["n"] <= 12) & ((x["n"] <= 4) | colon | ~x["last"].isin(*".!?…:") | numbered)


def check_heading_of(x) -> Column:
    return (x["n"] <= 4) | ~x["last"].isin(*".!?…")


def document_heading_of(x) -> Column:
    return (x["n"] <= 12) & ((x["n"] < 5) | (x["last"] == ":") | x["s"].rlike(DOCUMENT_HEADING))


def half_heading_of(x) -> Column:
    return (x["n"] <= 12) & ~x["p"].rlike(r"[.!?]$")


def prose_of(x) -> Column:
    return (x["n"] >= 5) & ~document_heading_of(x)


RULES = {"title": title_of, "check_heading": check_heading_of, "document_heading": document_heading_of, "half_heading": half_heading_of, "prose": prose_of}


def line_kinds(p: Column) -> Column:
    """All rules' answers for a line, as a struct of RULES; what they ask is found once."""
    return let(facts(p), lambda x: F.struct(*[rule(x).alias(name) for name, rule in RULES.items()]))


def is_title(p: Column) -> Column:
    """Up to twelve words, and four at most, or a colon at the end of up to eight, or no closing mark, or a numbered heading of one sentence."""
    return let(facts(p), title_of)


def is_check_heading(p: Column) -> Column:
    return check_heading_of(line_facts(p))


def is_document_heading(text: Column) -> Column:
    return let(facts(text), document_heading_of)


def is_half_heading(p: Column) -> Column:
    return half_heading_of(line_facts(p))


def is_prose(text: Column) -> Column:
    return let(facts(text), prose_of)


def opener(sentence: Column, lang: str) -> Column:
    """The first listed connector that the sentence begins with, or null."""
    return F.coalesce(*[F.when(sentence.startswith(o), F.lit(o)) for o in lexicon.JOINING[lang]["openers"]])


def ends_abbreviated(text: Column) -> Column:
    """Whether the last full stop belongs to an abbreviation. Only the end is searched; it is longer than any abbreviation with a line end."""
    return F.substring(text, -16, 16).rlike("(?i)" + lexicon.ABBREVIATION.replace(r"\s", f"[{BLANK}]"))


def letters(text: Column) -> Column:
    """Words of letters alone, lower case."""
    return found(F.lower(text), f"[{LETTER}]+")


def language(text: Column) -> Column:
    """es or en, by common words; es on a tie."""
    n = lambda w, lang: among(w, lexicon.JOINING[lang]["hints"])
    words = found(F.lower(text), "[a-záéíóúñü]+")
    return let(words, lambda w: F.when(n(w, "en") > n(w, "es"), F.lit("en")).otherwise(F.lit("es")))


def function_words(text: Column) -> tuple[Column, Column]:
    """(Spanish, English) function words of a text."""
    words = letters(text)
    return among(words, lexicon.SPANISH), among(words, lexicon.ENGLISH)


def looks_spanish(text: Column) -> Column:
    es, en = function_words(text)
    return es > en


def is_infinitive(word: Column) -> Column:
    """A capitalised Spanish infinitive, with or without a pronoun, that is not one of the listed nouns and adjectives."""
    form = word.rlike("^[A-ZÁÉÍÓÚ][a-záéíóúñü]*(?:ar|er|ir)(?:se|nos|los|las|lo|la|le|les)?$")
    return form & ~F.lower(word).isin(*sorted(lexicon.NOT_INFINITIVES))
