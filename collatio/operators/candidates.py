"""Versions of paragraphs: requests, a generator interface, selection of the first usable one, and adoption by number.

Generation is an interface: any function from (prompt, lead, options) to text. The package brings a deterministic stand-in
for tests and no model. Rounds run one after another, each over the paragraphs that are not settled yet, and every round's
output is stored before it is used, because a generator need not repeat itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatio.functions import lexicon
from collatio.functions import text as T
from collatio.functions.predicates import is_infinitive, is_title
from collatio.session import ship

from .guards import verdict

# The frame of a request, words of a lead, words of a bullet at most, sampler options.
PROMPT = "<source_text>\n%s\n</source_text>\n\n<target_text>\n%s"
END_TAG = "</target_text>"
LEAD_WORDS, BULLET_WORDS = 2, 40
PLAIN_OPTIONS = {"top_p": 0.95}
ANTI_COPY_OPTIONS = {"min_p": 0.08, "dry_multiplier": 0.8, "dry_base": 1.75, "dry_allowed_length": 2}
# End of fixed values.


def temperature(start: float, round_no: Column) -> Column:
    """Each round is a tenth warmer, up to 1.4."""
    return F.least(F.lit(1.4), F.lit(start) + 0.1 * round_no)


def token_limit(paragraph: Column) -> Column:
    """How many tokens a generator may use for a paragraph."""
    return 3 * T.n_parts(paragraph) + 100


def first_words(paragraph: Column, n: int = LEAD_WORDS) -> Column:
    return F.array_join(F.slice(T.parts(paragraph), 1, n), " ") if n else F.lit("")


def prompt(paragraph: Column, lead: Column) -> Column:
    before, after = PROMPT.split("%s")[0], PROMPT.split("%s")[1]
    return F.concat(F.lit(before), T.strip(paragraph), F.lit(after), lead)


def cleaned(lead: Column, generated: Column) -> Column:
    """Lead and generated text up to the end tag, blanks squeezed."""
    return T.squeezed(F.substring_index(F.concat(lead, generated), END_TAG, 1))


def first_person_plural(infinitive: Column, form: str) -> Column:
    """The Spanish present or future of a plain infinitive."""
    pick = lambda table: F.coalesce(*[F.when(infinitive == k, F.lit(v)) for k, v in table.items()])
    stem = F.substring(infinitive, F.lit(1), F.length(infinitive) - 2)
    if form == "present":
        end = F.coalesce(*[F.when(infinitive.endswith(k), F.lit(v)) for k, v in lexicon.PRESENT_ENDINGS.items()])
        return F.coalesce(pick(lexicon.PRESENT), F.concat(stem, end))
    ends = F.coalesce(*[F.when(infinitive.endswith(k), F.concat(F.substring(infinitive, F.lit(1), F.length(infinitive) - len(k)), F.lit(v))) for k, v in lexicon.FUTURE_ENDINGS.items()])
    return F.concat(F.coalesce(pick(lexicon.FUTURE_STEMS), ends, infinitive), F.lit("emos"))


def bullet_lead(paragraph: Column, k: Column) -> Column:
    """The opening of a bullet that begins with a bare infinitive: its verb conjugated, by a form that rotates with k; else null."""
    word = F.regexp_replace(F.get(T.parts(paragraph), F.lit(0)), '^[,;:«¿¡"]+|[,;:«¿¡"]+$', "")
    inf, form = F.lower(word), k % len(lexicon.LEAD_FORMS)
    bare = inf.rlike("^[a-zñü]+(?:ar|er|ir)$")
    capital = lambda v: F.concat(F.upper(F.substring(v, 1, 1)), F.substring(v, 2, F.length(v)))
    open_form = F.when(inf.rlike("[aei]rse$"), F.regexp_replace(inf, "se$", "nos")).otherwise(inf)
    spoken = F.when(bare & (form == 0), capital(first_person_plural(inf, "present"))).when(bare & (form == 1), capital(first_person_plural(inf, "future")))
    spoken = spoken.when(form == 3, F.concat(F.lit("Queremos "), open_form)).otherwise(F.concat(F.lit("Vamos a "), open_form))
    return F.when((T.n_parts(paragraph) <= BULLET_WORDS) & is_infinitive(word), spoken)


def restored_percent(original: Column, version: Column) -> Column:
    """The version with % behind the first place of each number that has it in the original and nowhere in the version."""
    numbers = F.array_sort(F.array_distinct(T.found(original, rf"(\p{{Nd}}+(?:[.,]\p{{Nd}}+)?)[{T.BLANK}]?%", 1)))

    def give(text: Column, n: Column) -> Column:
        whole = F.concat(F.lit(r"(?<![\p{Nd}.,])\Q"), n, F.lit(r"\E"))
        has = F.regexp_like(text, F.concat(whole, F.lit(f"[{T.BLANK}]?%")))
        place = F.concat(F.lit("(?s)^(.*?)("), whole, F.lit(rf")(?![\p{{Nd}}.,]*\p{{Nd}})(?![{T.BLANK}]?%)"))
        return F.when(has, text).otherwise(F.regexp_replace(text, place, F.lit("$1$2%")))

    return F.aggregate(numbers, version, give)


Generator = Callable[[str, str, dict], str]


def echo(request: str, lead: str, options: dict) -> str:
    """A stand-in generator that repeats the source behind its lead, and ends."""
    source = request.split("<source_text>\n", 1)[1].split("\n</source_text>", 1)[0]
    return " " + " ".join(source.split()[len(lead.split()) :]) + END_TAG


def generated(requests: DataFrame, generator: Generator = echo, options: dict | None = None) -> DataFrame:
    """requests (…, para, lead, temperature) and `text`, what the generator gave for them, cleaned."""
    ship(requests.sparkSession)
    chosen = dict(PLAIN_OPTIONS, **(options or {}))
    rows = requests.withColumns({"prompt": prompt(F.col("para"), F.col("lead")), "limit": token_limit(F.col("para"))})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", raw string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(raw=[generator(p, lead, chosen | {"temperature": t, "limit": n}) for p, lead, t, n in zip(b["prompt"], b["lead"], b["temperature"], b["limit"])])

    out = rows.mapInPandas(run, schema)
    return out.withColumn("text", restored_percent(F.col("para"), cleaned(F.col("lead"), F.col("raw")))).drop("prompt", "limit", "raw")


def requests(paras: DataFrame, round_no: int, tries: int, start: float = 1.0, bullets: bool = False, lead_words: int = LEAD_WORDS, given: str | None = None) -> DataFrame:
    """A row for every try of a round: (…, para, round, try, lead, temperature). Titles are not reworded.

    bullets: bullets that begin with an infinitive get a lead that rotates from bullet to bullet and try to try; the column
    `bullet` then holds a bullet's number in its text, from 0. lead_words: how many of a paragraph's words open its versions, 0 for none.
    given: a column with the opening of those paragraphs that have one of their own, which goes before all others.
    """
    rows = paras.where(~is_title(F.col("para"))).withColumns({"round": F.lit(round_no), "try": F.explode(F.sequence(F.lit(1), F.lit(tries)))})
    lead = first_words(F.col("para"), lead_words)
    if bullets:
        lead = F.coalesce(bullet_lead(F.col("para"), F.col("bullet") + F.col("try") - 1 + round_no * tries), lead)
    if given:
        lead = F.coalesce(F.col(given), lead)
    return rows.withColumns({"lead": lead, "temperature": temperature(start, F.lit(round_no))})


def first_accepted(tries: DataFrame, key: list[str]) -> DataFrame:
    """The earliest (round, try) of each paragraph whose problem is null."""
    return tries.where("problem IS NULL").groupBy(*key).agg(F.min(F.struct("round", "try", "text", "share")).alias("best")).select(*key, "best.*")


def least_copied(tries: DataFrame, key: list[str]) -> DataFrame:
    """Of each paragraph's copied tries, that of the smallest share, the earliest first."""
    return tries.where("problem = '(copied)'").groupBy(*key).agg(F.min(F.struct("share", "round", "try", "text")).alias("best")).select(*key, "best.*")


def common_failures(tries: DataFrame, key: list[str], n: int = 2) -> DataFrame:
    """(key, problem, n_tries): the n most common reasons of rejected tries, the earliest first on a tie."""
    first = F.min(F.struct("round", "try"))
    counts = tries.where("problem IS NOT NULL AND problem <> '(copied)'").groupBy(*key, "problem").agg(F.count("*").alias("n_tries"), first.alias("first"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n_tries"), "first")))
    return ranked.where(F.col("rank") <= n).select(*key, "problem", "n_tries")


def chosen(paras: DataFrame, tries: DataFrame, key: list[str]) -> DataFrame:
    """(key, text, status): the first accepted try, else the least copied, else the paragraph itself.

    status: accepted, copied, untouched, or title for paragraphs that are never tried.
    """
    good, fallback = first_accepted(tries, key).select(*key, F.col("text").alias("good")), least_copied(tries, key).select(*key, F.col("text").alias("copied"))
    rows = paras.join(good, key, "left").join(fallback, key, "left")
    status = F.when(is_title(F.col("para")), "title").when(F.col("good").isNotNull(), "accepted").when(F.col("copied").isNotNull(), "copied").otherwise("untouched")
    return rows.select(*key, F.coalesce("good", "copied", "para").alias("text"), status.alias("status"))


def first_candidates(tries: DataFrame, key: list[str], n: int) -> DataFrame:
    """(key, cand_no, text, share): up to n accepted tries of each paragraph, the earliest first."""
    order = Window.partitionBy(*key).orderBy("round", "try")
    return tries.where("problem IS NULL").withColumn("cand_no", F.row_number().over(order)).where(F.col("cand_no") <= n).select(*key, "cand_no", "text", "share")


def rescued(paras: DataFrame, key: list[str], folder: str, generator: Generator = echo, rounds: int = 3, tries: int = 6, start: float = 1.0, **options) -> DataFrame:
    """All tries of all rounds; a round asks only for paragraphs that earlier ones left without an accepted try."""
    spark, left, done = paras.sparkSession, paras, None
    for k in range(rounds):
        made = generated(requests(left, k, tries, start), generator)
        verdict(made, "para", "text", **options).write.mode("overwrite").parquet(f"{folder}/round={k}_")
        made = spark.read.parquet(f"{folder}/round={k}_")
        done = made if done is None else done.unionByName(made)
        left = left.join(made.where("problem IS NULL").select(*key).distinct(), key, "left_anti")
        if left.isEmpty():
            break
    return done


def adopted(paras: DataFrame, specs: DataFrame, key: list[str], para: str = "para", new: str = "text") -> DataFrame:
    """paras with the paragraphs that specs (key, text) name replaced by their texts, blanks squeezed.

    Before anything is returned, a paragraph that is named twice or does not exist raises ValueError.
    """
    twice = specs.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"a paragraph is given twice: {twice[0]}")
    unknown = specs.join(paras.select(*key), key, "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"no such paragraph: {unknown[0]}")
    s = specs.select(*key, T.squeezed(F.col(new)).alias("__new"))
    return paras.join(s, key, "left").withColumn(para, F.coalesce("__new", para)).drop("__new")


def only(paras: DataFrame, kept: DataFrame, numbers: list[int], key: list[str], para: str = "para") -> DataFrame:
    """(key, para_no, para, redo): listed paragraphs of paras to be done again, all others from an earlier result `kept`.

    Texts whose numbers of paragraphs differ raise an error when the rows are computed.
    """
    joined = paras.join(kept.select(*key, "para_no", F.col(para).alias("__kept")), [*key, "para_no"], "full")
    redo = F.col("para_no").isin(*numbers)
    same = F.col(para).isNotNull() & F.col("__kept").isNotNull()
    value = F.when(~same, F.raise_error(F.lit("the earlier result has another number of paragraphs")).cast("string")).when(redo, F.col(para)).otherwise(F.col("__kept"))
    return joined.select(*key, "para_no", value.alias(para), redo.alias("redo"))
