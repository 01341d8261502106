"""Line frequency and quality rules against a plain statement, on awkward rows and hot lines."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from collatio.llm import line_frequency as lf
from collatio.llm import shared

BODY = [" ".join(f"w{d}x{k}" for k in range(60)) for d in range(30)]
SCHEMA = "doc_id long, text string, source string, row string, h string, quality string"


def documents() -> list[tuple]:
    """Headers of 25 documents, spelled in different ways; two documents that consist of frequent lines; copies; odd rows."""
    rows = [(i, f"  Page {i % 10} of  THE site\n{BODY[i]}\n\nfoot", "a" if i < 25 else "b") for i in range(30)]
    thick = "\n".join(f"common line number ten and {'more ' * 9}{c}" for c in "xyz")
    rows += [(100 + i, f"{thick}\n{BODY[i]}", "c") for i in range(25)] + [(130, f"{thick}\n{thick.upper()}\nrest", "c")]
    rows += [(200 + i, "the same text " + BODY[3], "d") for i in range(40)] + [(300, "another " + BODY[4], "d")]
    rows += [(400, None, "a"), (401, "", None), (402, "\n \n\t", "a"), (403, "x" * 100_000, "b"), (404, "a b c a b c " * 20, None), (None, "ünï 日本 #*$%&|<> word", "a"), (405, BODY[7] * 500, "zz")]
    return [*rows, rows[0], rows[0]]


def plain(rows: list[tuple], least: int, share: float, left: float) -> list[tuple]:
    normal = lambda line: re.sub(r"[0-9]", "0", " ".join(re.findall(r"[^ \t-\r]+", line))).translate({c: c + 32 for c in range(65, 91)})
    having, docs = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        docs[host].add(text or "")
        for line in (text or "").split("\n"):
            if normal(line):
                having[host, normal(line)].add(text)
    out = []
    for key, text, host in rows:
        words = re.findall(r"[^ \t-\r]+", text or "")
        lines = [x for x in (text or "").split("\n") if normal(x)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = defaultdict(int)
        for g in grams:
            times[g] += 1
        hit = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        often = lambda x: (n := len(having[host, normal(x)])) > least and n > share * len(docs[host])
        rest = sum(len(x.split()) for x in lines if not often(x))
        base = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))
        clean = "\n".join(x for x in (text or "").split("\n") if not normal(x) or not often(x)) if text is not None else None
        out.append((key, *base, failed, rest, rest < left * len(words), not failed and rest >= left * len(words), clean))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, t, h, "r", "h", "q") for k, t, h in documents()], SCHEMA)


@pytest.mark.parametrize("least, share", [(20, 0.01), (3, 0.5), (0, 0.0)])
def test_verdicts_and_texts_equal_a_plain_statement(rows, least, share):
    want = plain(documents(), least, share, 0.5)
    q = F.col("quality")
    got = lf.line_quality(rows, least=least, share=share)
    assert set(got.columns) == set(rows.columns) - {"text"}
    names = [*lf.BASE, "base_failed", "words_left", "depleted", "kept"]
    assert sorted(map(repr, got.select("doc_id", *[q[c] for c in names]).collect())) == sorted(map(repr, got.sparkSession.createDataFrame([w[:-1] for w in want], got.select("doc_id", *[q[c].alias(f"quality.{c}") for c in names]).schema).collect()))
    kept = lf.kept_documents(rows, least=least, share=share)
    assert kept.columns == rows.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted((str(w[0]), w[-1]) for w in want if w[-2])


def test_some_lines_and_documents_go():
    found = {w[0]: w for w in plain(documents(), lf.LEAST, lf.SHARE, lf.LEFT)}
    assert found[0][-1].startswith("w0x0") and found[0][-2] and found[130][-3] and not found[130][-2] and found[200][-2]


def test_hot_lines_are_split(rows, monkeypatch):
    whole = sorted(map(str, lf.line_quality(rows).collect()))
    monkeypatch.setattr(lf, "SENT", -1)
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    assert sorted(map(str, lf.line_quality(rows).collect())) == whole


def test_empty_table_and_missing_host(spark, rows):
    assert lf.line_quality(rows.limit(0)).count() == lf.kept_documents(rows.limit(0)).count() == 0
    assert lf.line_quality(rows.drop("source")).count() == rows.count()
