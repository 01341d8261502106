"""Fidelity guards: what makes a version of a paragraph unusable, as native columns.

Every guard gives null if the version passes, else a message. Each begins with what is cheap to see and rules most paragraphs
out (an accent, a quotation mark, a negation); folded texts and counts of function words, which several guards need, are made
once a row. `verdict` puts the guards in order and takes the exact copied share last, so that Python sees only rows that
passed everything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.functions import lexicon
from collatio.functions import text as T
from collatio.functions.predicates import letters, looks_spanish

from .concepts import has_concept, n_negations
from .overlap import LIMIT, RUN, SHORT_LIMIT, SHORT_RUN, SHORT_WORDS, with_copied_share

L = T.LETTER
# Bytes of an accent read as two characters, HTML entities, digits inside words, accented letters, words of
# which lost accents count, and the patterns of vosotros forms and of «not only … but» and what may be left of it.
MOJIBAKE = "[ÃÂ][\x80-\xbf¡-¿]"
ENTITY = r"&(?:[a-zA-Z]{2,8}|#\p{Nd}{2,5});"
DIGIT_INSIDE = rf"{T.OPEN}[{L}]+\p{{Nd}}[{L}]+{T.SHUT}"
ACCENT = f"[{lexicon.ACCENTED}]"
LONG_WORD, LONG_NAME = 6, 4
CAPITAL_ACCENTED = rf"{T.OPEN}[A-ZÁÉÍÓÚÑ][{L}]*{ACCENT}[{L}]*"
PENINSULAR = f"(?i){T.OPEN}(?:{lexicon.PENINSULAR.replace('LETTERS', L)}){T.SHUT}"
NOT_ONLY = rf"{T.OPEN}no ([{T.WORD}]+ ){{0,3}}(?<!un )(solo|solamente|unicamente){T.SHUT}.*{T.OPEN}sino{T.SHUT}"
ONLY_KEPT = rf"{T.OPEN}(solo|solamente|unicamente|simplemente|meramente|limit[{T.WORD}]*|tambien|ademas){T.SHUT}"
# End of fixed values.


def when(condition: Column, message: str | Column) -> Column:
    return F.when(condition, F.lit(message) if isinstance(message, str) else message)


def length_problem(original: Column, version: Column) -> Column:
    """Words between 0.6 times the original's and 1.6 times and ten more."""
    o, v = T.n_parts(original), T.n_parts(version)
    return when((v < 0.6 * o) | (v > 1.6 * o + 10), "(truncated or too long)")


def lost_concept(original: Column, version: Column, concepts: list[tuple[str, list[str]]], folded: tuple[Column, Column] | None = None) -> Column:
    """The first name, alphabetically, of a concept that the original has and the version has not. folded: both texts folded, if they are at hand."""
    if not concepts:
        return F.lit(None).cast("string")
    a, b = folded or (T.fold(original), T.fold(version))
    lost = [when(has_concept(a, v := F.array(*map(F.lit, variants))) & ~has_concept(b, v), name) for name, variants in sorted(concepts)]
    return F.coalesce(*lost)


def quoted(found: Column) -> Column:
    """A match in quotation marks, with characters that don't print written by their numbers."""
    hidden = lambda c: c.rlike("[\\x80-\\xa0\\xad]")
    written = F.transform(F.split(found, ""), lambda c: F.when(hidden(c), F.concat(F.lit("\\x"), F.lower(F.hex(F.ascii(c))))).otherwise(c))
    return F.concat(F.lit("'"), F.when(hidden(found), F.array_join(written, "")).otherwise(found), F.lit("'"))


def encoding_problem(original: Column, version: Column) -> Column:
    """Mojibake, HTML entities or digits inside words that the original has not."""
    out = []
    for pattern, what in ((MOJIBAKE, "mojibake"), (ENTITY, "HTML entity"), (DIGIT_INSIDE, "digit inside a word")):
        new = F.array_min(F.array_except(T.found(version, pattern), T.found(original, pattern)))
        out.append(F.when(version.rlike(pattern), T.let(new, lambda x: F.concat(F.lit(f"(broken characters: {what} "), quoted(x), F.lit(")")))))
    return F.coalesce(*out)


def citation_problem(original: Column, version: Column) -> Column:
    """A quotation that changed, one that the original has not, or a reference in brackets that it has not."""
    foreign = lambda found, text: F.when(F.size(found) > 0, T.let(text, lambda t: F.exists(found, lambda q: ~F.contains(t, T.tidy(q)))))
    changed = foreign(T.quotes(original), T.tidy(version))
    invented = foreign(T.quotes(version), T.tidy(F.regexp_replace(original, '["“”«»]', "")))
    known = F.transform(T.references(original), T.tidy)
    reference = F.size(F.array_except(F.transform(T.references(version), T.tidy), known)) > 0
    problem = F.coalesce(when(changed, "(quote changed)"), when(invented, "(invented quote)"), when(reference, "(invented reference)"))
    return F.when(original.rlike(T.QUOTE) | version.rlike(f"{T.QUOTE}|\\("), problem)


def misspelled(word: Column) -> Column:
    """Forms of an accented word that lost accents: all of them, one of them, or an accented letter that isn't the last."""

    def at(i: Column) -> Column:
        before, c, after = F.substring(word, F.lit(1), i - 1), F.substring(word, i, F.lit(1)), F.substring(word, i + 1, F.length(word))
        forms = F.array(F.concat(before, T.plain(c), after), F.when(i < F.length(word), F.concat(before, after)))
        return F.when(c.rlike(ACCENT), forms).otherwise(F.array().cast("array<string>"))

    forms = F.flatten(F.transform(F.sequence(F.lit(1), F.length(word)), at))
    return F.array_except(F.array_compact(F.concat(F.array(T.plain(word)), forms)), F.array(word))


def spelling_problem(original: Column, version: Column, tokens: tuple[Column, Column] | None = None) -> Column:
    """Accents of longer words lost or broken, or far fewer of them than the original has. tokens: distinct words of both texts, if they are at hand."""
    ours, theirs = tokens or (F.array_distinct(T.tokens(original)), F.array_distinct(T.tokens(version)))
    broken = version.rlike(f"[{L}]'[{L}]") & ~original.rlike(f"[{T.WORD}]'[{T.WORD}]")
    long = F.filter(F.array_sort(ours), lambda w: (F.length(w) >= LONG_WORD) & w.rlike(ACCENT))
    forms = F.transform(long, lambda w: F.struct(w.alias("word"), misspelled(w).alias("forms")))

    def first(known: Column) -> Column:
        """The first word's first form that the version has; most versions have none, and then no word is looked at."""
        hits = F.array_intersect(F.flatten(F.transform(known, lambda x: x["forms"])), theirs)
        least = lambda h: F.get(F.filter(F.transform(known, lambda x: F.array_min(F.array_intersect(x["forms"], h))), lambda x: x.isNotNull()), F.lit(0))
        return T.let(hits, lambda h: F.when(F.size(h) > 0, least(h)))

    n = F.regexp_count(F.lower(original), F.lit(ACCENT))
    thin = (n >= 4) & (accent_density(original) >= 0.05) & (accent_density(version) < 0.4 * accent_density(original))
    message = F.coalesce(when(broken, "(broken accents)"), F.concat(F.lit("(accents lost: "), T.let(forms, first), F.lit(")")), when(thin, "(accents lost)"))
    return F.when(F.lower(original).rlike(ACCENT), message)


def accent_density(text: Column) -> Column:
    """Accented letters for each word."""
    return F.regexp_count(F.lower(text), F.lit(ACCENT)) / F.greatest(F.lit(1), T.n_parts(text))


def name_accent_problem(original: Column, version: Column, tokens: tuple[Column, Column] | None = None) -> Column:
    """A capitalised word with an accent that the version has only without it. tokens: as for spelling_problem."""
    low = tokens[1] if tokens else F.array_distinct(T.tokens(version))

    names = F.array_sort(F.filter(F.array_distinct(T.found(original, CAPITAL_ACCENTED)), lambda w: F.length(w) >= LONG_NAME))

    def first(known: Column) -> Column:
        gone = T.let(F.array_except(F.transform(known, F.lower), low), lambda g: F.filter(known, lambda w: F.array_contains(g, F.lower(w))))
        bare = lambda g: F.array_intersect(F.transform(g, lambda w: T.plain(F.lower(w))), F.transform(low, T.plain))
        named = lambda g: T.let(bare(g), lambda x: F.get(F.filter(g, lambda w: F.array_contains(x, T.plain(F.lower(w)))), F.lit(0)))
        return T.let(gone, lambda g: F.when(F.size(g) > 0, named(g)))

    return F.when(original.rlike(CAPITAL_ACCENTED), F.concat(F.lit("(accent lost in a name: "), T.let(names, first), F.lit(")")))


def word_counts(text: Column) -> Column:
    """(es, en): Spanish and English function words of a text."""
    return T.let(letters(text), lambda w: F.struct(T.among(w, lexicon.SPANISH).alias("es"), T.among(w, lexicon.ENGLISH).alias("en"), F.size(w).alias("n")))


def language_problem(original: Column, version: Column, counts: tuple[Column, Column] | None = None) -> Column:
    """A switch between Spanish and English, by function words. counts: word_counts of both texts, if they are at hand."""
    o, v = counts or (word_counts(original), word_counts(version))

    def problem(m: Column) -> Column:
        oes, oen, ves, ven = m["o"]["es"], m["o"]["en"], m["v"]["es"], m["v"]["en"]
        english = (oes > oen) & (((ven >= 2) & (ven > 0.5 * ves)) | ((ves == 0) & (m["v"]["n"] >= 5)))
        spanish = (oen > oes) & (ves >= 2) & (ves > 0.5 * ven)
        return F.coalesce(when(english, "(switched to English)"), when(spanish, "(switched to Spanish)"))

    return T.let(F.struct(o.alias("o"), v.alias("v")), problem)


def peninsular_problem(original: Column, version: Column, counts: tuple[Column, Column] | None = None) -> Column:
    """Forms of vosotros in a version of a Spanish text that has none."""
    spanish = looks_spanish(original) if counts is None else counts[0]["es"] > counts[0]["en"]
    form = F.get(T.found(version, PENINSULAR), F.lit(0))
    return F.when(version.rlike(PENINSULAR) & ~original.rlike(PENINSULAR) & spanish, F.concat(F.lit("(vosotros form: "), form, F.lit(")")))


def negation_problem(original: Column, version: Column, folded: tuple[Column, Column] | None = None) -> Column:
    """Clearly fewer negations, or a «not only … but» of which nothing is left. folded: both texts folded, if they are at hand."""
    t, u = folded or (T.fold(original), T.fold(version))

    def problem(m: Column) -> Column:
        o, r = m["o"], m["r"]
        fewer = (o >= 2) & (r < o - F.greatest(F.lit(1), F.floor(o / 3)))
        count = F.concat(F.lit("(negations lost: "), o.cast("string"), F.lit(" -> "), r.cast("string"), F.lit(")"))
        return F.coalesce(F.when(fewer, count), when(t.rlike(NOT_ONLY) & ((r == 0) | ~u.rlike(ONLY_KEPT)), "(«no solo» lost)"))

    o = n_negations(t)
    return T.let(o, lambda o: F.when(o > 0, T.let(F.struct(o.alias("o"), n_negations(u).alias("r")), problem)))


def repetition_problem(original: Column, version: Column, n: int = RUN, folded: tuple[Column, Column] | None = None) -> Column:
    """The first run of n words that is said twice or more, and more often than in the original. folded: both texts folded, if they are at hand."""
    t, u = folded or (T.fold(original), T.fold(version))

    def numbered(grams: Column) -> Column:
        """Each repeated run behind the number of the time it is said, from the second on, so that multisets are compared as sets; as strings, since sets of
        structs are compared one by one."""
        order = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        starts = lambda s: F.transform(s, lambda x, k: F.when((k == 0) | (F.get(s, k - 1)["g"] != x["g"]), k).otherwise(0))
        times = lambda s: T.let(T.running(starts(s), F.greatest), lambda r: F.transform(s, lambda x, k: F.when(k > F.get(r, k), F.concat((k - F.get(r, k) + 1).cast("string"), F.lit(" "), x["g"]))))
        return T.let(order, lambda s: F.array_compact(times(s)))

    def counted(b: Column) -> Column:
        more = lambda d: F.transform(F.array_except(d, numbered(b["had"])), lambda x: F.substring(x, F.locate(" ", x) + 1, F.length(x)))
        first = lambda d: F.get(F.filter(b["have"], lambda g: F.array_contains(d, g)), F.lit(0))
        return T.let(T.let(numbered(b["have"]), more), lambda d: F.when(F.size(d) > 0, F.concat(F.lit("(repeated: "), first(F.array_distinct(d)), F.lit(")"))))

    both = F.struct(T.ngrams(T.tokens(u), n).alias("have"), T.ngrams(T.tokens(t), n).alias("had"))
    # most versions repeat nothing, and then no run is counted
    repeats = T.let(T.ngram_hashes(T.tokens(u), n), lambda h: F.size(h) > F.size(F.array_distinct(h)))
    return F.when(repeats, T.let(both, counted))


GUARDS = {
    "encoding": encoding_problem,
    "citation": citation_problem,
    "spelling": spelling_problem,
    "name_accent": name_accent_problem,
    "language": language_problem,
    "peninsular": peninsular_problem,
    "negation": negation_problem,
    "repetition": repetition_problem,
}


def sides(df: DataFrame, original: str, version: str) -> DataFrame:
    """df and what several guards need of both texts, made once."""
    a, b = F.col(original), F.col(version)
    accented = F.lower(a).rlike(ACCENT)
    words = lambda c: F.when(accented, F.array_distinct(T.tokens(c)))  # noqa: E731  only what has accents is asked for words
    return df.withColumns({"__of": T.fold(a), "__vf": T.fold(b), "__oc": word_counts(a), "__vc": word_counts(b), "__ow": words(a), "__vw": words(b)})


SHARED = ("__of", "__vf", "__oc", "__vc", "__ow", "__vw")


def messages(original: str, version: str) -> dict[str, Column]:
    """Every guard's message, over sides."""
    folded, counts, tokens = (F.col("__of"), F.col("__vf")), (F.col("__oc"), F.col("__vc")), (F.col("__ow"), F.col("__vw"))
    more = {"spelling": {"tokens": tokens}, "name_accent": {"tokens": tokens}, "language": {"counts": counts}, "peninsular": {"counts": counts}, "negation": {"folded": folded}, "repetition": {"folded": folded}}
    return {name: guard(F.col(original), F.col(version), **more.get(name, {})) for name, guard in GUARDS.items()}


def with_guards(df: DataFrame, original: str, version: str) -> DataFrame:
    """df and a column for each guard."""
    return sides(df, original, version).withColumns(messages(original, version)).drop(*SHARED)


def verdict(df: DataFrame, original: str, version: str, concepts: list[tuple[str, list[str]]] = (), max_copied: float = LIMIT, strict_short: bool = False) -> DataFrame:
    """df, problem (null: usable) and share: the exact copied share, 0 where an earlier guard decided."""
    a, b = F.col(original), F.col(version)
    rows = sides(df, original, version)
    first = F.coalesce(length_problem(a, b), lost_concept(a, b, list(concepts), (F.col("__of"), F.col("__vf"))), *messages(original, version).values())
    short = (T.n_parts(a) <= SHORT_WORDS) if strict_short else F.lit(False)
    least = F.when(short, F.lit(min(max_copied, SHORT_LIMIT))).otherwise(F.lit(max_copied))
    rows = rows.withColumns({"problem": first, "__run": F.when(short, SHORT_RUN).otherwise(RUN), "__least": least})
    rows = with_copied_share(rows, original, version, F.col("__run"), "share", F.col("problem").isNull())
    copied = F.coalesce(F.col("share") > F.col("__least"), F.lit(False))
    return rows.withColumns({"problem": F.when(copied, F.lit("(copied)")).otherwise(F.col("problem")), "share": F.coalesce("share", F.lit(0.0))}).drop("__run", "__least", *SHARED)
