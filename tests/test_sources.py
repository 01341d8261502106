"""Files, office documents and streams."""

import datetime
import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from collatio.sources import docx, texts
from collatio.streaming import watch


def document(*paragraphs: str) -> bytes:
    body = "".join(paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(*runs: str, numbered: bool = False) -> str:
    head = "<w:pPr><w:numPr><w:ilvl/></w:numPr></w:pPr>" if numbered else ""
    return "<w:p>" + head + "".join(f"<w:r><w:rPr><w:b/></w:rPr><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


PARAS = [p("Portada"), p("1. Marco"), p("   El primer ", "párrafo tiene &amp; varias palabras."), p(""), p("uno de la lista larga", numbered=True), p("dos de la lista larga", numbered=True), p("Bibliografía"), p("Autor (2020).")]
DOC = document(*PARAS)


def units(spark, content, **options):
    return [tuple(map(list, u)) for u in docx.with_units(spark.createDataFrame([(bytearray(content),)], "content binary"), **options).first()["units"]]


def test_document_round_trip(spark):
    df = spark.createDataFrame([("a.docx", bytearray(DOC)), ("none", None)], "name string, content binary")
    found = docx.with_units(df, start="1. marco", stop="Bibliografia", merge_lists=True)
    text = {r["name"]: r["t"] for r in found.select("name", docx.unit_text(F.col("units")).alias("t")).collect()}
    assert text == {"a.docx": "1. Marco\n\nEl primer párrafo tiene & varias palabras.\n\nuno de la lista larga. dos de la lista larga.\n", "none": None}
    assert found.where("content IS NOT NULL").select(docx.prose_count(F.col("units")).alias("n")).first()["n"] == 2
    edited = text["a.docx"].replace("varias palabras", "otras <pocas> palabras")
    rebuilt = {r["name"]: r["rebuilt"] for r in docx.with_rebuilt(found.withColumn("text", F.lit(edited))).collect()}
    assert rebuilt["none"] is None
    xml = docx.body_xml(bytes(rebuilt["a.docx"]))
    prose = '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">   El primer párrafo tiene &amp; otras &lt;pocas&gt; palabras.</w:t></w:r></w:p>'
    listed = PARAS[4].replace("<w:t>uno de la lista larga", '<w:t xml:space="preserve">uno de la lista larga. dos de la lista larga.')
    assert xml == docx.body_xml(DOC).replace(PARAS[2], prose).replace(PARAS[4] + PARAS[5], listed)
    again = units(spark, rebuilt["a.docx"], start="1. Marco", stop="Bibliografía")
    assert again[1][1] == ["El primer párrafo tiene & otras <pocas> palabras."]
    with pytest.raises(ValueError, match="is not the one"):
        docx.rebuilt(DOC, [{"paragraphs": [2], "texts": ["x"]}], ["y"], [True])
    with pytest.raises(ValueError, match="2 blocks"):
        docx.rebuilt(DOC, [{"paragraphs": [2], "texts": ["x"]}], ["y", "z"], [True])
    with pytest.raises(Exception, match="no paragraph begins"):
        units(spark, DOC, start="no such")


def test_equal_paragraphs_are_told_apart(spark):
    """Of two paragraphs with the same XML the second one is edited."""
    same = p("una frase que sale dos veces.")
    content = document(p("Título"), same, same)
    df = spark.createDataFrame([(bytearray(content),)], "content binary")
    back = docx.with_rebuilt(docx.with_units(df, start="Título").withColumn("text", F.lit("Título\n\nuna frase que sale dos veces.\n\notra cosa muy distinta de todo."))).first()["rebuilt"]
    assert [u[1] for u in units(spark, back)] == [["Título"], ["una frase que sale dos veces."], ["otra cosa muy distinta de todo."]]


def test_rebuilt_documents_are_read_back_in_the_same_worker(spark, sf_dir):
    """What is read along equals what a second function reads, over several parts of a batch; the query has two Python functions in a row, not four."""
    from collatio.plans import catalog

    rows = [(i, bytearray(document(p("Título"), p(f"la frase número {i} del texto."), p("x", numbered=True))) if i % 7 else None) for i in range(250)]
    df = docx.with_units(spark.createDataFrame(rows, "k int, content binary").coalesce(1)).withColumn("text", F.lit("a\n\notra cosa muy distinta de todo.\n\nb"))
    both = docx.with_rebuilt(df, read="read").withColumn("again", docx.document_paragraphs(F.col("rebuilt"))).select("k", "read", "again").collect()
    assert len(both) == 250 and all(r["read"] == r["again"] and (r["read"] is None) == (r["k"] % 7 == 0) for r in both)
    assert [(x["text"], x["listed"]) for x in both[1]["read"]] == [("Título", False), ("otra cosa muy distinta de todo.", False), ("x", True)]
    assert catalog.office_rebuilt(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
    series = pd.Series(range(250))
    assert [len(a) for a, _ in docx.slices((series, series))] == [100, 100, 50]


def test_scan_of_tables_tabs_and_properties():
    table = "<w:tbl><w:tr><w:tc>" + p("en la tabla", numbered=True) + "</w:tc></w:tr></w:tbl>"
    tabbed = '<w:p w:rsidR="1"><w:pPr><w:rPr><w:i/></w:rPr></w:pPr><w:r><w:tab/></w:r><w:r><w:t xml:space="preserve"> a </w:t><w:tab/><w:t>b&lt;c</w:t></w:r></w:p>'
    found = docx.scanned(f"<w:body><w:pgSz/>{table}{tabbed}{p('fuera', numbered=True)}</w:body>")
    assert [(x.text, x.listed) for x in found] == [("en la tabla", False), ("a b<c", False), ("fuera", True)]
    assert (found[1].indent, len(found[1].runs), [r.shown for r in found[1].runs]) == (1, 2, [True, True])
    assert docx.scanned("") == []


def test_short_prose_takes_the_next_along(spark):
    content = document(p("una frase corta de prosa."), p("otra frase corta de prosa."), p("tercera frase corta de prosa."), p("Nota:"), p("una frase corta de prosa."), p("Fin"))
    assert [u[0] for u in units(spark, content, merge_short=10)] == [[0, 1], [2], [3], [4], [5]]
    assert [u[0] for u in units(spark, content)] == [[0], [1], [2], [3], [4], [5]]


def test_plain_documents_read_back(spark):
    content = docx.plain_document(["uno & dos", "tres de la lista"], [False, True])
    assert [(x.text, x.listed) for x in docx.scanned(docx.body_xml(content))] == [("uno & dos", False), ("tres de la lista", True)]


def test_texts_and_progress(spark, tmp_path):
    (tmp_path / "a.txt").write_text("uno\n\ndos\n", encoding="utf-8")
    got = texts.read_texts(spark, str(tmp_path / "a.txt")).first()
    assert got["text"] == "uno\n\ndos\n" and got["path"].endswith("a.txt")
    paras = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "doc_id int, para_no int, para string")
    assert texts.joined_text(paras, ["doc_id"]).first()["text"] == "x\n\ny\n"
    texts.save_progress(paras.where("para_no = 1").withColumn("para", F.lit("done")), str(tmp_path / "progress"))
    rows = texts.with_progress(paras, str(tmp_path / "progress"), ["doc_id", "para_no"]).orderBy("para_no").collect()
    assert [(r["para"], r["done"]) for r in rows] == [("done", True), ("y", False)]
    texts.write_texts(texts.joined_text(paras, ["doc_id"]), str(tmp_path / "out"))
    assert "".join(f.read_text() for f in (tmp_path / "out").glob("part-*")) == "x\n\ny\n"
    assert texts.file_digests(spark, str(tmp_path / "a.txt")).first()["length"] == 9


def test_saved_twice_the_last_counts(spark, tmp_path):
    paras = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "z")], "doc_id int, para_no int, para string")
    for text in ("first", "second"):
        texts.save_progress(paras.where("para_no < 3").withColumn("para", F.when(F.col("para_no") == 1, text)), str(tmp_path / "p"))
    rows = texts.with_progress(paras, str(tmp_path / "p"), ["doc_id", "para_no"]).orderBy("para_no").collect()
    assert [(r["para"], r["done"]) for r in rows] == [("second", True), (None, True), ("z", False)]


def test_candidates_lie_in_few_folders(spark, tmp_path):
    rows = spark.range(300).selectExpr("id div 10 AS doc_id", "cast(id % 10 AS int) AS para_no", "concat('t', id) AS text")
    texts.write_candidates(rows, str(tmp_path / "c"), ["doc_id"], buckets=4)
    assert len(list((tmp_path / "c").glob("bucket=*"))) <= 4
    got = texts.read_candidates(spark, str(tmp_path / "c"), {"doc_id": 7}, buckets=4)
    assert sorted(r["text"] for r in got.collect()) == [f"t{i}" for i in range(70, 80)]


def test_a_file_for_each_text(spark, tmp_path):
    texts.write_files(spark.createDataFrame([("a.txt", "uno é\n"), ("b.txt", ""), ("c.txt", None)], "name string, text string"), str(tmp_path / "f"))
    assert {p.name: p.read_text(encoding="utf-8") for p in (tmp_path / "f").glob("*.txt")} == {"a.txt": "uno é\n", "b.txt": ""}


def test_functions_in_sql(spark):
    from collatio.functions import registry

    assert set(registry.register(spark)) == {"copied_share", "copied_bound", "fold", "similarity", "paragraphs", "word_runs"}
    words = " ".join(f"w{i}" for i in range(10))
    row = spark.sql(f"SELECT copied_share('{words}', '{words}') AS s, copied_bound('{words}', 'x') AS b, fold('ÁRBOL') AS f, similarity('abcd', 'abxd') AS r, fold(NULL) AS n").first()
    assert (row["s"], row["b"], row["f"], row["r"], row["n"]) == (1.0, 0.0, "arbol", 0.75, None)
    assert [tuple(r) for r in spark.sql("SELECT * FROM paragraphs('a\\n\\n b \\n\\n')").collect()] == [(1, "a"), (2, "b")]
    assert [r["run"] for r in spark.sql("SELECT * FROM word_runs('A b, c', 2)").collect()] == ["a b", "b c"]


def test_documents_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a.docx", bytearray(DOC))], "name string, rebuilt binary")
    docx.write_documents(df, str(tmp_path / "docs"))
    assert (tmp_path / "docs" / "a.docx").read_bytes() == DOC
    assert docx.read_documents(spark, str(tmp_path / "docs")).count() == 1


def test_streams(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10, 0)
    rows = [("p1", at, "La casa de los padres", "The house of the parents"), ("p2", at, "a", "a")]
    spark.createDataFrame(rows, "pair_id string, at timestamp, original string, version string").write.parquet(str(tmp_path / "in"))
    stream = watch.guarded(watch.read_pairs(spark, str(tmp_path / "in")))
    watch.save(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r["pair_id"]: r["language"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"p1": "(switched to English)", "p2": None}
    counts = watch.counts_by_window(spark.createDataFrame([(at, "el uno de la"), (at, "the one of")], "at timestamp, text string"))
    assert {(r["lang"], r["n_words"]) for r in counts.collect()} == {("es", 4), ("en", 3)}


def test_halves_with_phrases_are_stored_as_lines(spark, tmp_path):
    """The halves of texts and their check phrases, written as one table of JSON lines and read again."""
    from collatio.operators import halves

    body = "\n\n".join(" ".join(f"w{i}x{k}" for k in range(30)) for i in range(6))
    rows = spark.createDataFrame([(1, body, "other words"), (2, "short", "short"), (3, None, None)], "doc_id int, text string, original string")
    phrase = lambda h: F.struct(h["half_no"].alias("half_no"), h["half"].alias("half"), halves.check_phrase(h["half"], F.col("original")).alias("phrase"))
    found = rows.select("doc_id", F.explode(F.transform(halves.halves_of(F.col("text"), 100), phrase)).alias("h")).select("doc_id", "h.*")
    texts.write_halves(found, str(tmp_path / "halves"))
    got = {(r["doc_id"], r["half_no"]): r for r in spark.read.schema("doc_id int, half_no int, half string, phrase string").json(str(tmp_path / "halves")).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)} and got[1, 1]["half"].split() + got[1, 2]["half"].split() == body.split()
    assert got[1, 2]["phrase"] == " ".join(f"w3x{k}" for k in range(7)) and got[2, 1]["phrase"] is None


def test_measured_files(spark, tmp_path):
    """Digests and lengths of files as they are, of texts in any encoding too."""
    import hashlib

    data = {"a.txt": "é\n".encode(), "b.bin": bytes(range(256)), "empty": b""}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[-1]: (r["length"], r["sha256"]) for r in texts.file_digests(spark, str(tmp_path)).collect()}
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in data.items() if v}
