"""Queries of joins and frames by order, stretches, levels, sketches, samples and multisets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from collatio.functions import lexicon
from collatio.functions import text as T
from collatio.operators import concepts, levels, order, spans
from collatio.session import ship

from .catalog import PAIRS, W, in_list, negation_sql, pairs, query, table

HOUR = 3_600_000_000


@query("""WITH c AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
SELECT p.event_id, c.event_id AS click_id, epoch_us(p.ts) - epoch_us(c.ts) AS since FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def last_click(spark, sf_dir):
    """Every purchase with its user's last click at or before it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    out = order.as_of(events.where("event_type = 'purchase'"), clicks, ["user_id"], "ts", ["click_id"], "last")
    return out.select("event_id", "last.click_id", F.timestamp_diff("MICROSECOND", F.col("last.ts"), F.col("ts")).alias("since"))


@query("""SELECT event_id, count(*) OVER w AS n_events, count(*) FILTER (event_type = 'error') OVER w AS n_errors, max(value) OVER w AS most FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""")
def trailing_hour(spark, sf_dir):
    """Of every event, the events of its user in the hour up to it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    measures = {"n_events": F.count("*"), "n_errors": F.count(F.when(F.col("event_type") == "error", 1)), "most": F.max("value")}
    return order.near_rows(events, ["user_id"], "ts", HOUR, 0, measures).select("event_id", *measures)


def places(key: str, text: str, source: str) -> str:
    """Words of a text, with where each ends, in characters."""
    cut = f"SELECT {key}, regexp_extract_all({text}, '{W}+') AS words, regexp_split_to_array({text}, '{W}+') AS gaps FROM {source}"
    each = f"SELECT {key}, unnest(generate_series(1, len(words))) AS i, unnest(words) AS word, unnest(gaps[1 : len(words)]) AS gap FROM ({cut})"
    return f"(SELECT {key}, i, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY {key} ORDER BY i) AS BIGINT) AS stop FROM ({each}))"


@query(f"""WITH w AS {places('doc_id', 'text', 'documents')}, f AS (SELECT doc_id, stop - length(word) AS start FROM w WHERE regexp_matches(word, '^\\d') OR lower(strip_accents(word)) IN ({in_list(lexicon.NEGATIONS.split('|'))}))
SELECT doc_id, CAST(start AS INTEGER) AS start, count(*) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS n_near FROM f""")
def flag_density(spark, sf_dir):
    """Of every negation and figure, how many lie within 500 characters of it."""
    ship(spark)
    rows = spans.span_rows(table(spark, sf_dir).select("doc_id", "text"), ["doc_id"], spans.flagged_spans(F.col("text")), "flag")
    return order.near_rows(rows, ["doc_id"], "start", 500, 500, {"n_near": F.count("*")}, bucket=4096).select("doc_id", "start", "n_near")


QUOTED_PAIRS = f"{PAIRS}, q AS (SELECT doc_id, '“' || replace(original, '. ', '.” “') || '”' AS original, '“' || replace(version, '. ', '.” “') || '”' AS version FROM p WHERE original IS NOT NULL)"
COPIED = rf"""w AS {places('doc_id', 'version', 'q')},
a AS (SELECT DISTINCT doc_id, o[i : i + 7] AS g FROM (SELECT doc_id, o, unnest(generate_series(1, len(o) - 7)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(original), '{W}+') AS o FROM q))),
b AS (SELECT doc_id, i, v[i : i + 7] AS g FROM (SELECT doc_id, v, unnest(generate_series(1, len(v) - 7)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(version), '{W}+') AS v FROM q))),
k AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 7)) AS i FROM b SEMI JOIN a USING (doc_id, g)),
r AS (SELECT doc_id, min(stop - length(word)) AS start, max(stop) AS stop FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM k) JOIN w USING (doc_id, i) GROUP BY doc_id, island),
m AS (SELECT doc_id, j, CAST(sum(length(gap) + length(quote)) OVER (PARTITION BY doc_id ORDER BY j) AS BIGINT) AS stop, quote FROM (SELECT doc_id, unnest(generate_series(1, len(qs))) AS j, unnest(qs) AS quote, unnest(gs[1 : len(qs)]) AS gap FROM (SELECT doc_id, regexp_extract_all(version, '["“«][^"”»]{{12,}}["”»]') AS qs, regexp_split_to_array(version, '["“«][^"”»]{{12,}}["”»]') AS gs FROM q))),
s AS (SELECT m.doc_id, j, min(w.stop - length(word)) AS start, max(w.stop) AS stop FROM m JOIN w ON w.doc_id = m.doc_id AND w.stop <= m.stop AND w.stop - length(word) >= m.stop - length(quote) GROUP BY m.doc_id, j)"""


@query(f"""WITH {QUOTED_PAIRS}, {COPIED} SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_quotations, CAST(coalesce(c, 0) AS BIGINT) AS n_copied FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT s.doc_id, count(*) AS c FROM s JOIN r ON s.doc_id = r.doc_id AND r.start <= s.start AND s.stop <= r.stop GROUP BY s.doc_id) USING (doc_id)""")
def copied_quotations(spark, sf_dir):
    """Every document's sentences as quotations, and how many of its version's lie in a run that is copied."""
    ship(spark)
    quoted = lambda c: F.concat(F.lit("“"), F.replace(c, F.lit(". "), F.lit(".” “")), F.lit("”")).alias(c)
    rows = pairs(spark, sf_dir).select("doc_id", quoted("original"), quoted("version"))
    said = spans.span_rows(rows, ["doc_id"], spans.quotation_spans(F.col("version")), "quotation")
    runs = spans.span_rows(rows, ["doc_id"], spans.copied_spans(F.col("original"), F.col("version")), "copied")
    copied = spans.within(said, runs, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("c"))
    counts = said.groupBy("doc_id").agg(F.count("*").alias("n")).join(copied, "doc_id", "left")
    out = rows.select("doc_id").join(counts, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_quotations"), F.coalesce("c", F.lit(0)).alias("n_copied"))


LEVELS = [["lang", "source", "quality"], ["lang", "source"], ["lang", "quality"], ["quality"], []]


@query(f"""WITH {PAIRS}, a AS ({negation_sql('original')}), b AS ({negation_sql('version')}), l AS (SELECT doc_id, len(list_filter(a.pairs, lambda x: NOT list_contains(b.pairs, x))) AS n FROM a JOIN b USING (doc_id))
SELECT lang, source, quality, CAST(GROUPING_ID(lang, source, quality) AS BIGINT) AS level, count(*) AS n_docs, count(*) FILTER (n > 0) AS n_failed, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_lost FROM documents JOIN l USING (doc_id) LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, source, quality), (lang, source), (lang, quality), (quality), ())""")
def failures_by_level(spark, sf_dir):
    """Documents that lost negations, by language, source and quality, and over them, in one pass."""
    rows = pairs(spark, sf_dir).select("doc_id", F.size(concepts.lost_negations(F.col("original"), F.col("version"))).alias("n"))
    rows = rows.join(table(spark, sf_dir).select("doc_id", "lang", "source"), "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return levels.by_levels(rows, LEVELS, [F.count("*").alias("n_docs"), F.count_if(F.col("n") > 0).alias("n_failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_lost")])


#: Relative error of a merged sketch that its size makes all but certain.
CLOSE = 0.05


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, true AS close FROM events GROUP BY event_type")
def merged_users(spark, sf_dir):
    """Distinct users by kind of event, counted exactly, and whether sketches that were stored by day and merged come close."""
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "user_id")
    merged = levels.estimates(levels.merged_sketches(levels.stored_sketches(events, ["event_type", "day"], "user_id"), ["event_type"]), ["event_type"])
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"))
    return exact.join(merged, "event_type").select("event_type", "n_users", (F.abs(F.col("n_distinct") - F.col("n_users")) <= CLOSE * F.col("n_users")).alias("close"))


GRAMS = f"g AS (SELECT DISTINCT source, w[i : i + 7] AS g FROM (SELECT source, w, unnest(generate_series(1, len(w) - 7)) AS i FROM (SELECT source, regexp_extract_all(lower(text), '{W}+') AS w FROM documents)))"


@query(f"WITH {GRAMS} SELECT x.source AS a, y.source AS b, count(*) AS n_shared, true AS close FROM g x JOIN g y USING (g) WHERE x.source < y.source GROUP BY x.source, y.source")
def shared_sources(spark, sf_dir):
    """8-grams that two sources have in common, counted exactly, and whether stored sketches come close (within 5 % of what both have)."""
    grams = T.elements(table(spark, sf_dir), ["source", "doc_id"], T.ngram_hashes(T.tokens(F.col("text")), 8), "g")
    stored = levels.stored_sketches(grams.withColumn("part", F.col("doc_id") % 7), ["source", "part"], "g")
    merged = levels.merged_sketches(stored, ["source"])
    sizes = levels.estimates(merged, ["source"])
    both = levels.values_in_common(grams, "source", "g")
    near = levels.shared_estimates(merged, "source", both.select("a", "b"))
    out = both.join(near.withColumnRenamed("n_shared", "guess"), ["a", "b"])
    out = out.join(sizes.select(F.col("source").alias("a"), F.col("n_distinct").alias("na")), "a").join(sizes.select(F.col("source").alias("b"), F.col("n_distinct").alias("nb")), "b")
    return out.select("a", "b", "n_shared", (F.abs(F.col("guess") - F.col("n_shared")) <= CLOSE * (F.col("na") + F.col("nb"))).alias("close"))


def draw_sql(seed: str) -> str:
    """chance, in SQL."""
    return f"(CAST(('0x' || left(md5('{seed}:' || doc_id), 12)) AS BIGINT) + 1) / 281474976710656.0::DOUBLE"


@query(f"SELECT source, doc_id, CAST(place AS INTEGER) AS place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {draw_sql('sample')}, doc_id) AS place FROM documents) WHERE place <= 5")
def sampled_by_source(spark, sf_dir):
    """Five documents of every source."""
    return levels.sampled(table(spark, sf_dir).select("source", "doc_id"), ["source"], "doc_id", 5).select("source", "doc_id", "place")


@query(f"SELECT lang, doc_id, CAST(place AS INTEGER) AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY -ln({draw_sql('weighted')}) / n_chars, doc_id) AS place FROM documents WHERE n_chars > 0) WHERE place <= 20")
def sampled_by_length(spark, sf_dir):
    """Twenty documents of every language, longer ones more likely."""
    return levels.sampled(table(spark, sf_dir).select("lang", "doc_id", "n_chars"), ["lang"], "doc_id", 20, "weighted", F.col("n_chars")).select("lang", "doc_id", "place")


def fours(text: str) -> str:
    return f"SELECT doc_id, array_to_string(w[i : i + 3], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 3)) AS i FROM (SELECT doc_id, regexp_extract_all(lower({text}), '{W}+') AS w FROM p))"


@query(f"WITH {PAIRS} SELECT doc_id, gram, count(*) AS n_more FROM ({fours('version')} EXCEPT ALL {fours('original')}) GROUP BY doc_id, gram")
def said_more_often(spark, sf_dir):
    """4-grams that a version says more often than its original."""
    return levels.said_more_often(pairs(spark, sf_dir), ["doc_id"])


@query(f"WITH {PAIRS} SELECT doc_id, count(*) AS n_both FROM ({fours('version')} INTERSECT ALL {fours('original')}) GROUP BY doc_id")
def said_in_both(spark, sf_dir):
    """How many 4-grams a version has in common with its original."""
    return levels.said_in_both(pairs(spark, sf_dir), ["doc_id"])
