"""Guards, one case a row: what passes and what is rejected with which message."""

import re

import pytest
from pyspark.sql import functions as F

from collatio.operators import guards
from collatio.operators.overlap import share_of, still_original

LONG = "one two three four five six seven eight nine ten"
CASES = [
    ("citation", 'He wrote "a promise made to all people" then.', 'Then he wrote "a promise made to all people" there.', None),
    ("citation", 'He wrote "a promise made to all people" then.', 'He wrote "a promise given to everybody" then.', "(quote changed)"),
    ("citation", "See the book (Letters, 4).", "See the book (Letters, 4) again.", None),
    ("citation", "See the book (Letters, 4).", "See the book (Treatise, 9).", "(invented reference)"),
    ("citation", "The people walk far away from home.", 'It says: "the people walk far away".', None),
    ("citation", "The people walk far away from home.", 'It says: "how many lands are there still?"', "(invented quote)"),
    ("citation", "It is plain.", "It is plain (I like it).", "(invented reference)"),
    ("spelling", "La comunión y la oración", "La oración y la comunión", None),
    ("spelling", "La comunión es grande", "La comunion es grande", "(accents lost: comunion)"),
    ("spelling", "La composición es larga", "La composicin es larga", "(accents lost: composicin)"),
    ("spelling", "La comunión es grande", "La comunio'n es grande", "(broken accents)"),
    ("spelling", "The party's over", "The party's end", None),
    ("spelling", "él habló aquí así más según allá", "el hablo aqui asi mas segun alla", "(accents lost)"),
    ("name_accent", "Vino Pérez ayer", "Ayer vino Pérez", None),
    ("name_accent", "Vino Pérez ayer", "Ayer vino Perez", "(accent lost in a name: Pérez)"),
    ("language", "El perro está en la casa de mi padre", "El perro de mi padre está en la casa", None),
    ("language", "El perro está en la casa de mi padre", "The dog is in the house of my father", "(switched to English)"),
    ("language", "The dog is in the house", "El perro está en la casa", "(switched to Spanish)"),
    ("language", "Ofrecer la identidad y el control de uno", "Offering identity, self esteem, emotion management", "(switched to English)"),
    ("negation", "No es así, no lo es, nunca lo fue ni será", "No es así y nunca lo fue, ni lo será", None),
    ("negation", "No es así, no lo es, nunca lo fue ni será", "Es así y lo será", "(negations lost: 4 -> 0)"),
    ("negation", "no se mide solo por eso, sino por más", "no se mide en eso, sino en más", "(«no solo» lost)"),
    ("negation", "no se mide solo por eso, sino por más", "no se mide solamente por eso sino por más", None),
    ("repetition", f"{LONG}. {LONG}.", f"{LONG}. {LONG}.", None),
    ("repetition", LONG, f"{LONG}. {LONG}.", "(repeated: one two three four five six seven eight)"),
    ("encoding", "oraci6n vieja", "oraci6n vieja", None),
    ("encoding", "oración", "oraciÃ³n", "(broken characters: mojibake 'Ã³')"),
    ("encoding", "presión", "presi&oacute;n", "(broken characters: HTML entity '&oacute;')"),
    ("encoding", "oración", "oraci6n", "(broken characters: digit inside a word 'oraci6n')"),
    ("peninsular", "La casa de los padres es grande", "La casa de vuestros padres es grande", "(vosotros form: vuestros)"),
    ("peninsular", "La casa de vuestros padres es de todos", "Vuestra es la casa de los padres", None),
    ("peninsular", "La casa de los padres es grande", "Hay dieciséis casas", "(vosotros form: dieciséis)"),
]


@pytest.fixture(scope="module")
def messages(spark):
    df = spark.createDataFrame([(i, a, b) for i, (_, a, b, _) in enumerate(CASES)], "i int, a string, b string")
    return {r["i"]: r for r in guards.with_guards(df, "a", "b").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_message(messages, i):
    name, _, _, expected = CASES[i]
    assert messages[i][name] == expected


def test_nulls_and_empty_texts_pass(spark):
    df = spark.createDataFrame([(None, None), ("", ""), (None, "a"), ("a", None)], "a string, b string")
    for r in guards.with_guards(df, "a", "b").collect():
        assert all(r[k] is None for k in guards.GUARDS)


def test_verdict_takes_the_first_problem_and_the_copied_share_last(spark):
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"x{i}" for i in range(60))
    rows = [(1, words, words), (2, words, other), (3, words, "w1 w2"), (4, words + " Kant", other + " y"), (5, words, " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"x{i}" for i in range(30)))]
    got = {r["i"]: r for r in guards.verdict(spark.createDataFrame(rows, "i int, a string, b string"), "a", "b", [("Kant", ["Kant"])]).collect()}
    assert got[1]["problem"] == "(copied)" and got[1]["share"] == 1.0
    assert got[2]["problem"] is None and got[2]["share"] == 0.0
    assert got[3]["problem"] == "(truncated or too long)"
    assert got[4]["problem"] == "Kant"
    assert got[5]["problem"] is None and got[5]["share"] == 0.5


def test_strict_short_blocks_count_shorter_runs(spark):
    a = "alfa beta gama delta eco foxtrot golf hotel india julia kilo lima"
    b = "alfa beta gama delta eco foxtrot hotel india julia kilo lima"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert guards.verdict(df, "a", "b").first()["problem"] is None
    assert guards.verdict(df, "a", "b", strict_short=True).first()["problem"] == "(copied)"


def test_bound_is_never_below_the_share(spark):
    import random

    from collatio.operators.overlap import copied_bound

    r = random.Random(5)
    rows = [(" ".join(r.choice("abcdef") for _ in range(r.randint(0, 30))), " ".join(r.choice("abcdef") for _ in range(r.randint(0, 30)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("bound", copied_bound(F.col("a"), F.col("b"), 4))
    for x in df.collect():
        assert x["bound"] >= share_of(x["a"], x["b"], 4) - 1e-12
        assert x["bound"] <= 1


def test_still_original_pairs_paragraphs_by_position(spark):
    body = " ".join(f"word{i}" for i in range(50)) + "."
    rows = [(1, f"Title\n\n{body}", f"Title\n\n{body}"), (2, f"{body}\n\nmore text", body), (3, f"{body}", " ".join(f"new{i}" for i in range(50)) + ".")]
    got = still_original(spark.createDataFrame(rows, "k int, original string, version string"), ["k"]).collect()
    assert [(r["k"], r["para_no"], r["share"]) for r in got] == [(1, 2, 1.0)]


def test_steps_of_every_line_are_computed_once(spark):
    """A title's facts stand once in a plan; words are the same with and without the short way for single bytes; runs said again are told apart by how often."""
    from collatio.functions import predicates
    from collatio.functions import text as T

    rows = [a + f"{b}".join(("one", "two", "", "tres")) + c for b in T.BLANKS for a, c in (("", ""), (" ", "\t"), ("é", " "), ("", " ñ"))]
    df = spark.createDataFrame([(t,) for t in [*rows, "", " ", None]], "t string")
    plan = lambda c: df.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert [plan(f(F.col("t"))).count("split(") for f in (predicates.is_title, predicates.is_document_heading, predicates.is_prose)] == [1, 1, 1]
    got = df.select("t", T.parts(F.col("t")).alias("w")).collect()
    assert [r for r in got if r["w"] != (None if r["t"] is None else [w for w in re.split("[" + re.escape(T.BLANKS) + "]+", r["t"]) if w])] == []
    run = " ".join(f"w{i}" for i in range(8))
    said = lambda n: ". ".join([run] * n)
    pairs = spark.createDataFrame([(said(a), said(b)) for a, b in ((1, 1), (1, 2), (2, 2), (2, 3), (3, 2))], "a string, b string")
    problem = guards.repetition_problem(F.col("a"), F.col("b"))
    assert [r["p"] is not None for r in pairs.select(problem.alias("p")).collect()] == [False, True, False, True, False]
    assert pairs.select(problem.alias("p")).collect()[1]["p"] == f"(repeated: {run})"
