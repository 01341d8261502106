"""Exact near copies against brute force over all pairs."""

from __future__ import annotations

import random

import pytest

from collatio.llm import near_copies, shared, simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def brute(texts, share=0.8):
    """Each text's smallest number in its group."""
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if group[i] != group[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j])):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def found(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["near"]["component"] for r in simhash.with_groups(df, width=5, distance=12, share=0.8, **how).collect()}
    return [got[i] for i in range(len(texts))]


def edited(r, words, n):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"z{r.randrange(10**9)}"
    return " ".join(out)


def test_copies_of_a_hub_that_are_unlike_each_other(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(10**9)}" for _ in range(200)]
    texts = [*(edited(r, words, 4) for _ in range(300)), " ".join(words)]
    sets = [shingles(t) for t in texts]
    assert sum(jaccard(sets[0], s) < 0.8 for s in sets[1:-1]) > 250  # copies are linked by the hub alone
    want = brute(texts)
    assert want.count(0) > 250 and found(spark, texts) == want


def test_texts_of_one_fingerprint_are_told_apart(spark):
    r = random.Random(5)
    line = "one common line of eleven words that all of them have"
    texts = [" ".join(f"w{r.randrange(10**9)}" for _ in range(100)) + f"\n{line}" * 60 for _ in range(40)]
    assert len({simhash.fingerprint(t, 5) for t in texts}) < 40
    texts += [t.replace(" one", " uno", 1).replace("w", "v", 1) for t in texts[5:8]] + texts[3:5]
    want = brute(texts)
    assert want[:40] == list(range(40)) and want[40:] == [5, 6, 7, 3, 4]
    assert found(spark, texts) == want


def test_pairs_near_the_threshold_are_all_found(spark):
    r = random.Random(6)
    texts = []
    for _ in range(150):
        words = [f"w{r.randrange(10**9)}" for _ in range(200)]
        texts += [" ".join(words), edited(r, words, 4)]
    same = [a == b for a, b in zip(brute(texts)[::2], brute(texts)[1::2])]
    far = [bin(simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).count("1") > 12 for a, b in zip(texts[::2], texts[1::2])]
    assert sum(s and f for s, f in zip(same, far)) > 5  # links that 12 bits would miss
    assert found(spark, texts) == brute(texts)


def test_sizes_at_the_edge_and_common_shingles(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    texts = [" ".join(words), " ".join(words[:84]), " ".join(words[:83]), None, "", " \n", "a b", "A  b", "a b c"]
    assert brute(texts[:2]) == [0, 0] and jaccard(shingles(texts[0]), shingles(texts[2])) < 0.8
    assert found(spark, texts) == [0, 0, 0, 3, 3, 3, 6, 6, 8]
    r = random.Random(7)
    lines = ["\n".join(" ".join(r.choice("abcdefgh") * 3 for _ in range(9)) for _ in range(2)) for _ in range(30)]
    mix = ["\n".join(r.choice(lines) for _ in range(r.randint(3, 9))) for _ in range(400)]
    assert found(spark, mix) == brute(mix)


@pytest.mark.parametrize("cut", [1, 3, 7])
def test_keys_go_on_over_batches(cut):
    import pandas as pd

    rows = pd.DataFrame({"h": [1, 1, 2, 3, 3, 3, 3, 4], "node": range(8), "size": 10})
    parts = list(near_copies.whole_keys(iter([rows[i : i + cut] for i in range(0, 8, cut)])))
    assert pd.concat(parts)["node"].tolist() == list(range(8))
    assert sum(p["h"].nunique() for p in parts) == 4


def test_first_rows_of_groups(spark):
    rows = [(5, "a b c"), (None, "a b c"), (4, "a  B c"), (4, "a b c"), (None, "d"), (None, "d"), (7, None), (6, ""), (9, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = near_copies.first_of_groups(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0 for r in out.collect())) == [0, 4, 6, 9]
    assert near_copies.first_of_groups(df.limit(0)).count() == 0


def unlike(n, shared_words=9, own=40):
    """n texts that have one line of five shingles in common, and two near copies of every 50th."""
    line = " ".join(f"s{i}" for i in range(shared_words))
    r = random.Random(n)
    words = [[f"w{i}x{k}" for k in range(own)] for i in range(n)]
    return [f"{line} {' '.join(w)}" for w in words] + [f"{line} {edited(r, w, 1)}" for w in words[::50] for _ in range(2)]


@pytest.mark.parametrize("large, block, deep", [(200, 100_000, 6), (3, 100_000, 6), (3, 100_000, 1), (3, 10, 2), (0, 7, 6)])
def test_large_buckets_are_divided(spark, monkeypatch, large, block, deep):
    """Whatever the order of shingles (here common ones aren't known), divided and blocked buckets give the same groups."""
    for name, value in (("CROWDED", large), ("LARGE", large), ("BLOCK", block), ("DEEP", deep), ("COMMON", 0), ("HUBS", 1 + deep % 3)):
        monkeypatch.setattr(near_copies, name, value)
    texts = unlike(120)
    words = [f"c{i}" for i in range(150)]
    r = random.Random(1)
    texts += [edited(r, words, 3) for _ in range(60)]
    assert found(spark, texts) == brute(texts)


def test_hot_shingles_known_from_the_sample(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 5)
    r = random.Random(2)
    texts = unlike(40) + [edited(r, [f"c{i}" for i in range(150)], 3) for _ in range(60)]
    assert found(spark, texts) == brute(texts)


def test_many_unlike_texts_with_a_line_in_common(spark, monkeypatch):
    """One bucket of all texts is divided; all pairs would be two hundred million comparisons."""
    monkeypatch.setattr(near_copies, "COMMON", 0)
    texts = unlike(20_000, 6, 80)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = near_copies.with_groups(df).select("doc_id", "near.component").collect()
    assert {r["doc_id"]: r["component"] for r in rows if r["doc_id"] != r["component"]} == {20_000 + i: i // 2 * 50 for i in range(800)}


def test_buckets_stream_over_batches():
    import pandas as pd

    r = random.Random(3)
    rows = sorted({(r.randrange(6), r.randrange(1, 40), r.randrange(20)) for _ in range(150)} | {(9, 10, 1)})
    df = pd.DataFrame([(h, 100 * h + 40 * k + s, s) for h, s, k in rows], columns=["h", "node", "size"])
    df = pd.concat([df, df.iloc[::5]]).sort_values(["h", "size", "node"])
    want = {(h, n) for h, n, s in df.itertuples(index=False) if any(h == g and n != m and min(s, t) >= 0.8 * max(s, t) for g, m, t in df.itertuples(index=False))}
    for cut in (1, 2, 7, 500):
        got = pd.concat(list(near_copies.buckets(0.8)(iter([df[i : i + cut] for i in range(0, len(df), cut)]))))
        assert sorted(zip(got["h"], got["node"])) == sorted(want)


def test_texts_that_lie_in_files_are_not_stored_again(spark, tmp_path):
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    rows = [(i, texts[i % 30] + (" more" if i >= 60 else "")) for i in range(90)] + [(None, None), (90, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(5).write.parquet(str(tmp_path / "docs"))
    with shared.folders_made() as made:
        lying = {r["doc_id"] for r in near_copies.first_of_groups(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    tables = [f for f in made if "/table-" in f]
    left = [f for f in tables if shared.filesystem(f)[0].get_file_info(shared.filesystem(f)[1]).type.name == "Directory"]
    assert left and not any("text" in spark.read.parquet(f).columns for f in left)
    assert lying == {r["doc_id"] for r in near_copies.first_of_groups(df).collect()} == {*range(30), None}


def test_rows_of_a_table_are_told_by_place(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert shared.standing(t) is t
    read = lambda: {r["id"]: r["at"] for r in t.select("id", shared.place(t).alias("at")).collect()}
    first = read()
    assert len(set(first.values())) == 1000 and first == read()
    assert shared.standing(t.where("id < 5")) is not t
    shared.filesystem(str(tmp_path))[0].move(str(next((tmp_path / "t").glob("part-*"))), str(tmp_path / "t" / "other.parquet"))
    assert hasattr(shared.standing(spark.read.parquet(str(tmp_path / "t"))), "stored_at")
