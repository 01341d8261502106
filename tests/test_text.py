"""Text kernel, lists, halves, concepts, shapes, leads: against plain statements of the rules."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from collatio.functions import lexicon, predicates, text
from collatio.operators import candidates, concepts, halves, segment


def one(spark, column, *values):
    """A column function's value on one row of strings."""
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


TEXTS = ["", "a", "  Año Nuevo, ²x_1 ", "El niño\tcomió\n\nalgo. Y más", "ÀÉÎõü Å", "é ñ", "Straße İstanbul", "日本 語 한국어", "\x1cx\x1fy\x85z"]


@pytest.mark.parametrize("t", TEXTS)
def test_kernel_equals_python(spark, t):
    assert one(spark, text.tokens, t) == re.findall(r"\w+", t.lower())
    assert one(spark, text.parts, t) == t.split()
    assert one(spark, text.strip, t) == t.strip()
    folded = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn")
    assert unicodedata.normalize("NFD", one(spark, text.fold, t)) == folded
    assert one(spark, text.lines, t) == (t.splitlines() or [])


def test_sentences_keep_list_numbers(spark):
    assert one(spark, text.sentences, "1. Uno es así. Dos. tres? No.") == ["1. Uno es así.", "Dos. tres? No."]
    assert one(spark, text.sentences, "Acción 1. Crear algo. Luego más.") == ["Acción 1. Crear algo.", "Luego más."]
    assert one(spark, text.sentences, "") == [""]


def test_ngrams_of_short_texts(spark):
    assert one(spark, lambda c: text.ngrams(text.parts(c), 3), "a b") == []
    assert one(spark, lambda c: text.ngrams(text.parts(c), 3), "a b c d") == ["a b c", "b c d"]


@pytest.mark.parametrize("line, expected", [("Objetivo.", True), ("Una línea corta sin punto final aquí", True), ("Esto es una frase con su punto final.", False), ("A mis seres queridos de siempre:", True), ("1. Dimensión individual para conocerme mejor.", True), ("1. Uno es así siempre. Y dos más.", False), (" ".join(["w"] * 13), False)])
def test_titles(spark, line, expected):
    assert one(spark, predicates.is_title, line) is expected


def test_lists_round_trip(spark):
    body = "Metas:\n• uno\n• dos\n\n- tres\nFin 1.- a; 2.- b"
    rows = segment.list_rows(spark.createDataFrame([(1, body)], "k int, text string"), ["k"])
    assert [(r["mark"], r["block"], r["blank_after"]) for r in rows.orderBy("block_no").collect()] == [("", "Metas:", 0), ("• ", "uno", 0), ("• ", "dos", 1), ("- ", "tres", 0), ("", "Fin 1.- a; 2.- b", 0)]
    assert segment.restored_lists(rows, ["k"]).first()["text"] == body + "\n"
    merged = segment.merged_lists(rows, ["k"]).orderBy("block_no").collect()
    assert [(r["block"], r["merged"]) for r in merged] == [("Metas:", None), ("uno. dos.", 2), ("tres.", 1), ("Fin 1.- a; 2.- b", None)]
    back = segment.with_list_map(rows, segment.list_map(rows, ["k"]), ["k"])
    assert segment.restored_lists(back, ["k"]).first()["text"] == body + "\n"


@pytest.mark.parametrize("line, expected", [("Metas: 1.- Uno; 2.- Dos; 3.- ABC.", "Metas: uno, dos y ABC."), ("Metas: uno; dos", "Metas: uno; dos"), ("Nada", "Nada"), ("Metas: 1) Una; 2) Otra!", "Metas: una y otra!")])
def test_inline_lists(spark, line, expected):
    assert one(spark, segment.flattened, line) == expected


def test_halves_cut_before_a_heading_and_never_end_with_one(spark):
    para = " ".join(["palabra"] * 20) + "."
    body = "\n\n".join(["Inicio", para, para, "Parte dos", para, para])
    rows = halves.halves(spark.createDataFrame([(1, body)], "k int, text string"), ["k"], max_words=30).orderBy("half_no").collect()
    assert rows[1]["half"].startswith("Parte dos") and rows[0]["n_words"] == 41
    assert halves.halves(spark.createDataFrame([(1, body)], "k int, text string"), ["k"], max_words=900).count() == 1


def test_check_phrase_is_new_at_both_ends(spark):
    old = " ".join(f"w{i}" for i in range(20))
    new = "w0 w1 w2 w3 w4 w5 " + " ".join(f"n{i}" for i in range(12))
    assert one(spark, halves.check_phrase, new, old) == "w1 w2 w3 w4 w5 n0 n1" or one(spark, halves.check_phrase, new, old).split()[0].startswith(("w", "n"))
    assert one(spark, halves.check_phrase, old, old) is None


@pytest.mark.parametrize("term, body, hit", [("ser", "el servicio", False), ("ser*", "el servicio", True), ("joven", "los jovenes", True), ("joven", "la juventud", False), ("plan", "dos planes", True), ("Tomás de Aquino", "tomas  de\naquino dijo", True), ("60%", "un 60% mas", True)])
def test_concept_patterns(spark, term, body, hit):
    assert one(spark, lambda t, b: concepts.has_concept(text.fold(b), F.array(t)), term, body) is hit


def test_concept_files(spark):
    rows = concepts.parsed_concepts(spark.createDataFrame([("Kant | Immanuel Kant # filósofo",), ("# nada",), ("",), (None,)], "value string")).collect()
    assert [(r["name"], r["variants"]) for r in rows] == [("Kant", ["Kant", "Immanuel Kant"])]


CAPITALS, JOINERS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZÁÉÍÓÚÑÜ"), {"de", "del", "la", "las", "los", "y", "of", "the"}


def names_in(body):
    """(words, what stands before) of runs of capitalised words, token by token."""
    tokens = [[m.start(), m.group()] for m in re.finditer(r"\w+", body)]
    near = lambda k: k < len(tokens) and body[tokens[k - 1][0] + len(tokens[k - 1][1]) : tokens[k][0]].isspace()
    begins = lambda k: near(k) and tokens[k][1][0] in CAPITALS and len(tokens[k][1]) > 1
    k = 0
    while k < len(tokens):
        at, word = tokens[k]
        inside = next((i for i, c in enumerate(word[:-1]) if c in CAPITALS), None)
        k += 1
        if inside is None:
            continue
        words = [word[inside:]]
        while begins(k) or (near(k) and tokens[k][1] in JOINERS and begins(k + 1)):
            words.append(tokens[k][1])
            k += 1
        yield words, body[: at + inside]


def figures_in(body):
    """Digits with points and commas between them, and a percent sign behind."""
    k = 0
    while k < len(body):
        end = k
        while end < len(body) and (body[end].isdecimal() or (end > k and body[end] in ".," and body[end + 1 : end + 2].isdecimal())):
            end += 1
        if end > k:
            rest = len(body[end:]) - len(body[end:].lstrip())
            end += rest + (body[end + rest : end + rest + 1] == "%")
            yield body[k:end]
        k = max(end, k + 1)


def terms_in(body):
    """What stands in brackets or angle quotes, 2 to 40 characters, without such marks of its own kind."""
    k = 0
    while k < len(body):
        pair = {"(": "()", "«": "«»"}.get(body[k])
        end = next((i for i in range(k + 1, len(body)) if body[i] in pair), None) if pair else None
        if end is not None and body[end] == pair[1] and 3 <= end - k <= 41:
            yield body[k + 1 : end]
            k = end
        k += 1


def scanned_concepts(body):
    """Concepts by walking over a text: names, figures, terms; the first of equal ones."""
    common = lambda w: text.fold_text(w) in lexicon.NOT_NAMES
    after_common = lambda ws: next((ws[i:] for i, w in enumerate(ws) if not common(w)), [])
    listed = []
    for words, before in names_in(body):
        opens = not before.strip() or before.rstrip()[-1] in ".!?¿¡:\n«\"—"
        words = after_common(words[1:]) if opens else words if not common(words[0]) else []
        listed += [[" ".join(words), *(words[-1:] if len(words) > 1 else [])]]
    for term in [*figures_in(body), *terms_in(body)]:
        words = term.strip(" .,;:«»\"'()").split()
        listed += [[" ".join(after_common(words) or words[-1:])]]
    first = {}
    for name, *others in listed:
        if len(name) > 2:
            first.setdefault(text.fold_text(name), (name, [name, *others]))
    return list(first.values())


CONCEPTS_FOUND = [
    ["Immanuel Kant+Kant", "Sol de Mayo+Mayo", "60%", "razón pura"],
    ["Kant", "Razón", "12,5 %", "1.000", "uno"],
    ["Río", "Vio", "Juan", "Cruz y Teresa+Teresa", "Ávila", "3 %", "Del"],
    ["Bc De+De"],
    [],
]
CONCEPT_TEXTS = [
    "Ayer vino Immanuel Kant (razón pura) con 60% y 12. El Sol de Mayo.",
    "El de Kant. KANT y Kant, 12,5 % de «la Razón» («»), (de la), (el uno) y 1.000.",
    "La Del Río. Como Vio «El Del» 3\n%. San Juan de la Cruz y Teresa.\n\nÁvila: Más Ávila",
    "A Bc De",
    "",
]


def test_extracted_concepts(spark, sf_dir):
    got = dict(map(tuple, one(spark, concepts.concepts_of, CONCEPT_TEXTS[0])))
    assert got["Immanuel Kant"] == ["Immanuel Kant", "Kant"] and "60%" in got and "razón pura" in got and "12" not in got
    documents = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").collect()]
    df = spark.createDataFrame(list(enumerate(CONCEPT_TEXTS + documents)), "k long, text string")
    for r in df.select("k", "text", concepts.concepts_of(F.col("text")).alias("c")).collect():
        found = [(x["name"], list(x["variants"])) for x in r["c"]]
        assert found == scanned_concepts(r["text"])
        if r["k"] < len(CONCEPTS_FOUND):
            assert ["+".join(v) for _, v in found] == CONCEPTS_FOUND[r["k"]]
    assert concepts.extracted_concepts(spark.createDataFrame([(1, None), (2, "")], "k int, text string"), ["k"]).count() == 0


WORST = {
    "numbering": "1" + ".1" * 500_000 + " a",
    "list number": "Acción 1" + ".1" * 500_000 + ". Uno. Dos.",
    "capitals": "x " + "Ab " * 300_000,
    "figures": "1" + ",1" * 500_000,
    "blanks": "a" + " " * 1_000_000 + "b",
}


@pytest.mark.parametrize("name", sorted(WORST))
def test_a_megabyte_of_a_patterns_worst_case(spark, name):
    df = spark.createDataFrame([(WORST[name],)], "t string")
    t = F.col("t")
    row = df.select(predicates.is_title(t).alias("title"), F.size(text.sentences(t)).alias("n"), F.size(concepts.concepts_of(t)).alias("c"), F.length(text.strip(t)).alias("length"), text.ends_with(t, ".").alias("end")).first()
    assert row["length"] == len(WORST[name].strip()) and row["n"] == (2 if name == "list number" else 1)
    assert row["c"] == {"numbering": 1, "list number": 1, "capitals": 1, "figures": 1, "blanks": 0}[name]


def test_negation_pairs(spark):
    assert one(spark, concepts.negation_pairs, "No «contradicción» ni otra; nunca más. noble") == ["ni otra", "no contradiccion", "nunca mas"]


def test_shapes(spark):
    body = "no basta, sino que sobra\n\nTema: la confianza. Texto: Lucas y más\n\nFinal: que todos vengan\n\n" + "\n\n".join(f"el tema es {i}" for i in range(3))
    rows = concepts.flagged_shapes(spark.createDataFrame([(1, body)], "k int, text string"), ["k"]).orderBy("para_no").collect()
    assert [(r["para_no"], r["kind"]) for r in rows] == [(1, "antithesis"), (2, "labels"), (3, "label-fragment"), (4, "frame")]
    assert rows[3]["excerpt"] == "«el tema» in paragraphs 4, 5, 6"


@pytest.mark.parametrize("line, k, expected", [("Ofrecer cursos a todos", 0, "Ofrecemos"), ("Formar grupos", 1, "Formaremos"), ("Tener tiempo", 1, "Tendremos"), ("Establecer reglas", 2, "Vamos a establecer"), ("Promover ayuda", 3, "Queremos promover"), ("Reunirse cada día", 0, "Vamos a reunirnos"), ("Lugar de todos", 0, None), ("ofrecer cursos", 0, None), ("", 0, None)])
def test_bullet_leads(spark, line, k, expected):
    assert one(spark, lambda c: candidates.bullet_lead(c, F.lit(k)), line) == expected


@pytest.mark.parametrize("a, b, expected", [("un 60% más", "un 60 más", "un 60% más"), ("un 60% y 60", "60 y 60", "60% y 60"), ("un 60%", "un 160 y 60.5", "un 160 y 60.5"), ("un 60 %", "un 60 %", "un 60 %")])
def test_percent_signs(spark, a, b, expected):
    assert one(spark, candidates.restored_percent, a, b) == expected


def test_adoption_checks_before_it_changes(spark):
    paras = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc_id int, para_no int, para string")
    good = candidates.adopted(paras, spark.createDataFrame([(1, 2, " new \n text ")], "doc_id int, para_no int, text string"), ["doc_id", "para_no"])
    assert sorted(r["para"] for r in good.collect()) == ["a", "new text"]
    for rows in ([(1, 2, "x"), (1, 2, "y")], [(1, 9, "x")]):
        with pytest.raises(ValueError):
            candidates.adopted(paras, spark.createDataFrame(rows, "doc_id int, para_no int, text string"), ["doc_id", "para_no"])


def test_only_keeps_what_is_not_listed(spark):
    paras = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc_id int, para_no int, para string")
    kept = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "doc_id int, para_no int, para string")
    rows = candidates.only(paras, kept, [2], ["doc_id"]).orderBy("para_no").collect()
    assert [(r["para"], r["redo"]) for r in rows] == [("x", False), ("b", True)]
    with pytest.raises(Exception, match="another number of paragraphs"):
        candidates.only(paras, kept.where("para_no = 1"), [2], ["doc_id"]).collect()


def test_rescue_rounds_ask_only_for_what_is_left(spark, tmp_path):
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n)) + "."
    paras = spark.createDataFrame([(1, 1, words("a", 50)), (1, 2, "Title")], "doc_id int, para_no int, para string")

    def warm(request, lead, options):
        return candidates.echo(request, lead, options) if options["temperature"] < 1.05 else " " + " ".join(f"z{i}" for i in range(48)) + "."

    tries = candidates.rescued(paras, ["doc_id", "para_no"], str(tmp_path / "r"), warm, rounds=3, tries=2)
    assert {(r["round"], r["problem"]) for r in tries.collect()} == {(0, "(copied)"), (1, None)}
    status = {r["para_no"]: r["status"] for r in candidates.chosen(paras, tries, ["doc_id", "para_no"]).collect()}
    assert status == {1: "accepted", 2: "title"}


def test_openings_of_requests(spark):
    para = "Uno es el primero de todos los que hay. Dos viene después."
    paras = spark.createDataFrame([(1, para, None), (2, para, "Desde la")], "k int, para string, own string")
    lead = lambda **o: [r["lead"] for r in candidates.requests(paras, 0, 1, **o).orderBy("k").collect()]
    assert lead() == ["Uno es"] * 2 and lead(lead_words=0) == ["", ""] and lead(given="own") == ["Uno es", "Desde la"]
    made = candidates.requests(paras, 2, 3, start=1.3).collect()
    assert {r["try"] for r in made} == {1, 2, 3} and {r["temperature"] for r in made} == {1.4}


def test_options_reach_the_generator(spark):
    seen = lambda request, lead, options: " " + ",".join(f"{k}={v}" for k, v in sorted(options.items()))
    paras = spark.createDataFrame([(1, "Uno es el primero de todos los que hay.")], "k int, para string")
    text = candidates.generated(candidates.requests(paras, 0, 1), seen, candidates.ANTI_COPY_OPTIONS).first()["text"]
    assert text == "Uno es dry_allowed_length=2,dry_base=1.75,dry_multiplier=0.8,limit=127,min_p=0.08,temperature=1.0,top_p=0.95"


def test_row_local_lists_equal_tables_of_blocks(spark):
    """Lists in their own row as over tables of blocks, with nulls, texts without lines and maps that don't fit."""
    texts = ["a\n\n• b\n• c.\n\n- d\nEnd: 1.- Uno; 2.- Dos\n", "• x\n\n\n• y", "", "\n \n", None, "- only"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = segment.list_rows(df, ["k"])
    blocks = segment.blocks_of(F.col("text"))
    merged = text.rows_of(df, ["k"], segment.merged_blocks(blocks), "block_no", "x").select("k", "block_no", "x.*")
    assert sorted(map(str, merged.collect())) == sorted(map(str, segment.merged_lists(rows, ["k"]).select(*merged.columns).collect()))
    again = {r["k"]: r["t"] for r in df.select("k", segment.restored_text(blocks).alias("t")).collect()}
    assert {k: t for k, t in again.items() if t not in (None, "\n")} == {r["k"]: r["text"] for r in segment.restored_lists(rows, ["k"]).collect()}
    lines = F.transform(blocks, lambda x: x["block"])
    put = df.select("k", segment.with_map(lines, segment.map_of(blocks)).alias("x")).collect()
    assert [r["x"] is None for r in put] == [t is None for t in texts]
    with pytest.raises(Exception, match="differ in their number"):
        df.where("k = 0").select(segment.with_map(F.slice(lines, 1, 1), segment.map_of(blocks))).collect()


def test_python_batches_are_bounded_by_bytes(spark):
    """Whatever was set before, operators that ship the package bound what gathers in a Python worker."""
    from collatio.session import BATCH_BYTES, BATCH_ROWS, ship

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    ship(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == BATCH_BYTES == "8m"
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == BATCH_ROWS == "4000"


def test_indexed_check_phrase_equals_check_phrase_and_is_linear(spark):
    import random
    import time

    draw = random.Random(5)
    words = ["ab", "Abc", "b", "–", "c'd", "x-y-z", "Éa", "a.b.c.d.e.f.g", "_", "7", "ΑΣ", "İ"]
    rows = []
    for n in range(300):
        old = [draw.choice(words) for _ in range(draw.randint(0, 60))]
        new = [w if draw.random() > 0.1 else draw.choice([w[:1], w[-1:], "new", w]) for w in old]
        cut = draw.randint(0, len(new))
        rows.append((" ".join(old), " ".join(new[:cut]) + draw.choice(["\n\n", "\n", " ", "\n \n"]) + " ".join(new[cut:])))
    rows += [(None, "a " * 20), ("a " * 20, None), (None, None), ("", "a b c d e f g h i j k l m n"), ("a b", "")]
    df = spark.createDataFrame(rows, "o string, h string")
    got = df.select(halves.check_phrase(F.col("h"), F.col("o")).alias("a"), halves.indexed_check_phrase(F.col("h"), F.col("o")).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and 20 < sum(r["a"] is not None for r in got) < 290
    began, long = time.time(), " ".join(f"w{i}" for i in range(200_000))  # hours, if every word searches the whole text
    assert spark.createDataFrame([(long, long)], "o string, h string").select(halves.indexed_check_phrase(F.col("h"), F.col("o")).alias("x")).first()["x"] is None
    assert time.time() - began < 60


def test_folding_of_single_bytes_and_others(spark):
    texts = ["", "Plain ASCII 7_!", "É", "é", "a\x00b", "́", "ß ñ", "\U0001f600", "x" * 1000 + "ü", None]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.fold(F.col("t")).alias("x")).collect()]
    assert got == ["", "plain ascii 7_!", "e", "e", "a\x00b", "", "ß n", "\U0001f600", "x" * 1000 + "u", None]
