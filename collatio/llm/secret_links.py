"""Secret scan by multipart credential linking, in DataFrame operations only.

Strong findings stand alone: assign (a key word, a separator and a value of ASSIGN characters), access (AKIA
identifiers) and hex (long runs of hexadecimal digits). Weak candidates are parts that prove nothing alone:

* ident: an account, client or user identifier that is assigned a value, or a shorter AKIA identifier;
* blob: a token of 32 or more characters of the base64 alphabet with a capital, a small letter and a digit;
* endpoint: a URL, or a host of three labels or more that is assigned to a host key.

A part's scope reaches SCOPE code points to both sides. An interval join on the scopes links parts of a text, and a weak
candidate is reported only when complementary parts meet in it: an identifier (access or ident) and a secret (assign,
hex or blob) that see each other, or an endpoint that sees both of them. Strong spans are never changed.

The join's key is the text's digest and a cell of SCOPE code points, so that a part meets at most the few
parts that fit into three cells, however long a text or however often it repeats; texts are joined once for all
their copies. Semi-joins keep a part at most once and never make pairs.

Positions are code points of the text, ends exclusive. Per kind, matches are the leftmost ones that do not overlap.
Very long texts and texts of very many matches take the same way: patterns have no group that Java would match by
recursion (the one repeated group is possessive), running sums over a text's matches take log2(matches) passes, and a text is
marked out by pieces of CHUNK code points. Equal spans of two kinds are both reported, in the order of kinds.
Nulls are empty texts without spans; repeated rows and null keys keep their rows; empty tables give empty results. Other
columns stay; the result is one struct column that the caller names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.functions.text import let
from collatio.session import spread

from .shared import join_hot, running, settle

#: Code points that a part's scope reaches to both sides; code points of a piece that is cut from a text at once.
SCOPE, CHUNK = 400, 4096
#: Kinds in the order of reports: pattern, the group that is tested, its least length, what must match in it.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, []),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, []),
    "hex": (r"[0-9a-f]{24,}", 0, 24, []),
    "ident": (r"""(?i:account|client|user|access)[_-]?(?i:id|name|key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}|AKIA[A-Z0-9]+""", 0, 8, ["^(?:AKIA[A-Z0-9]{4,15}$|[AaCcUu][^K])"]),
    "blob": (r"[A-Za-z0-9+/]{32,}", 0, 32, ["[A-Z]", "[a-z]", "[0-9]"]),
    "endpoint": (r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){2,}+""", 0, 1, []),
}
BASE, WEAK = ("assign", "access", "hex"), ("ident", "blob", "endpoint")
#: What makes up a credential: identifiers and secrets, strong or weak.
IDS, SECRETS = ("access", "ident"), ("assign", "hex", "blob")
SPANS = "array<struct<start: int, stop: int>>"


def spans(text: Column, kind: str) -> Column:
    """The places of a kind's matches. What lies between matches comes from a split by the same pattern."""
    pattern, group, least, tests = KINDS[kind]
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.split(text, pattern, -1).alias("between")]
    if group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("tested"))

    def placed(m: Column) -> Column:
        stops = running(F.transform(m["whole"], lambda x, i: F.length(x) + F.length(F.get(m["between"], i))), lambda a, b: a + b)

        def one(stop: Column, i: Column) -> Column:
            tested = F.get(m["tested" if group else "whole"], i)
            ok = F.length(tested) >= least
            for t in tests:
                ok = ok & tested.rlike(t)
            return F.struct((stop - F.length(F.get(m["whole"], i))).cast("int").alias("start"), stop.cast("int").alias("stop"), ok.alias("ok"))

        kept = F.filter(F.transform(stops, one), lambda x: x["ok"])
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))

    return F.when(text.rlike(pattern), let(F.struct(*parts), placed)).otherwise(F.array().cast(SPANS))


def near(weak: DataFrame, parts: DataFrame, kinds: tuple[str, ...], scope: int) -> DataFrame:
    """The weak parts in whose scope a part of one of the kinds lies: a semi-join on text, cell and interval."""
    w = weak.withColumn("cell", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("stop") + scope) / scope)))).alias("w")
    c = parts.where(F.col("kind").isin(*kinds)).withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("stop") - 1) / scope)))).alias("c")
    apart = (F.col("c.start") >= F.col("w.stop")) | (F.col("c.stop") <= F.col("w.start"))
    seen = (F.col("c.start") - F.col("w.stop") <= scope) & (F.col("w.start") - F.col("c.stop") <= scope)
    return w.join(c, (F.col("w.text_key") == F.col("c.text_key")) & (F.col("w.cell") == F.col("c.cell")) & apart & seen, "left_semi").drop("cell").distinct()


def links(scanned: DataFrame, scope: int) -> DataFrame:
    """(text_key, ident, blob, endpoint) with the weak spans that complementary parts support, of texts that have any."""
    one = scanned.where(" OR ".join(f"size(scan.{k}) > 0" for k in WEAK)).select("text_key", "scan").dropDuplicates(["text_key"])
    label = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))
    labelled = [F.transform(F.col(f"scan.{k}"), label(k)) for k in KINDS]
    parts = one.select("text_key", F.explode(F.concat(*labelled)).alias("p")).select("text_key", "p.*")
    kept = near(parts.where("kind = 'ident'"), parts, SECRETS, scope)
    kept = kept.unionAll(near(parts.where("kind = 'blob'"), parts, IDS, scope))
    kept = kept.unionAll(near(near(parts.where("kind = 'endpoint'"), parts, SECRETS, scope), parts, IDS, scope))
    place = F.struct("start", "stop")
    return kept.groupBy("text_key").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, place))).alias(k) for k in WEAK])


def listed(found: dict[str, Column]) -> Column:
    """kind:start:end of all spans by start, then kind."""
    label = lambda i, k: lambda x: F.struct(x["start"].alias("a"), F.lit(i).alias("k"), x["stop"].alias("b"), F.lit(k).alias("n"))
    rows = F.concat(*[F.transform(c, label(i, k)) for i, (k, c) in enumerate(found.items())])
    return F.array_join(F.transform(F.array_sort(rows), lambda x: F.concat_ws(":", x["n"], x["a"], x["b"])), ",")


def with_secrets(df: DataFrame, text: str = "text", into: str = "secrets", scope: int = SCOPE, keep_text: bool = True) -> DataFrame:
    """df and a struct column: an array of spans for each kind (of weak ones, those that are linked), base and spans as lists in text form.

    keep_text: whether the result has the text column, which is then stored once more on the way.
    """
    own = [F.col(f"`{c}`") for c in df.columns if c != into and (keep_text or c != text)]
    whole = F.coalesce(F.col(text), F.lit(""))
    scan = F.struct(*[spans(whole, k).alias(k) for k in KINDS])
    scanned = df.select(F.struct(*own).alias("row"), scan.alias("scan"), whole.alias("whole"))
    weak = F.expr(" OR ".join(f"size(scan.{k}) > 0" for k in WEAK))
    # the regular expressions run once; texts without weak parts have no key and never meet the join
    scanned = settle(scanned.select("row", "scan", F.when(weak, F.sha2(F.col("whole").cast("binary"), 256)).alias("text_key")))
    linked = links(scanned, scope).select("text_key", F.struct(*WEAK).alias("linked"))
    plain = scanned.where("text_key IS NULL").withColumn("linked", F.lit(None).cast(linked.schema["linked"].dataType))
    keyed = scanned.where("text_key IS NOT NULL")
    each = keyed.groupBy("text_key").agg(F.count("*").alias("rows")).join(linked, "text_key", "left")
    joined = join_hot(keyed, each, "text_key", "rows").select("row", "scan", "text_key", "linked").unionAll(plain)
    found = {k: F.col(f"scan.{k}") for k in BASE} | {k: F.coalesce(F.col(f"linked.{k}"), F.array().cast(SPANS)) for k in WEAK}
    out = F.struct(*[c.alias(k) for k, c in found.items()], listed({k: found[k] for k in BASE}).alias("base"), listed(found).alias("spans"))
    return joined.select("row.*", out.alias(into))


def redacted(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with `mark` in place of every stretch that spans of a with_secrets column cover."""
    places = F.array_sort(F.concat(*[secrets[k] for k in KINDS]))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def cut(chunks: Column, start: Column, stop: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        n = F.floor((stop - 1) / CHUNK).cast("int") - first + 1
        return F.when(stop > start, F.substring(F.array_join(F.slice(chunks, first + 1, F.greatest(n, F.lit(0))), ""), start - first * CHUNK + 1, stop - start)).otherwise("")

    def marked(m: Column) -> Column:
        reach = F.element_at(m["reach"], -1)
        before = lambda i: F.when(i > 0, F.get(m["reach"], i - 1)).otherwise(0)
        opened = F.filter(F.transform(m["places"], lambda x, i: F.struct(before(i).alias("at"), x["start"].alias("start"))), lambda x: x["start"] >= x["at"])
        body = F.transform(opened, lambda x: F.concat(cut(m["chunks"], x["at"], x["start"]), F.lit(mark)))
        return F.concat(F.array_join(body, ""), cut(m["chunks"], reach, m["size"]))

    whole = let(places, lambda p: F.struct(p.alias("places"), running(F.transform(p, lambda x: x["stop"]), F.greatest).alias("reach"), pieces.alias("chunks"), F.length(text).alias("size")))
    return F.when(F.size(places) > 0, let(whole, marked)).otherwise(text)


def op6_secret_links(spark, sf_dir: str) -> DataFrame:
    """Strong and linked weak secrets of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text")
    out = with_secrets(docs, keep_text=False)
    s = F.col("secrets")
    return out.select("doc_id", *[F.size(s[k]).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(s["base"].cast("binary"), 256).alias("base_sha256"), s["spans"].alias("spans"), *[F.size(s[k]).cast("long").alias(f"n_{k}") for k in WEAK])


def op6_sql() -> str:
    """The same by a plain join of all parts of a text, with patterns of its own."""
    kinds = {
        "assign": (r"""(?i:password|passwd|secret|token|apikey|api_key)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 1, "length(v) >= 6"),
        "access": ("AKIA[A-Z0-9]+", 0, "length(v) >= 20"),
        "hex": ("[0-9a-f]+", 0, "length(v) >= 24"),
        "ident": (r"""(?:(?i:account|client|user|access)(?:_|-)?(?i:id|name|key_id)["']?[ ]*[:=][ ]*["']?[A-Za-z0-9._@-]{3,}|AKIA[A-Z0-9]+)""", 0, "(v[1:4] <> 'AKIA' OR length(v) BETWEEN 8 AND 19)"),
        "blob": ("[A-Za-z0-9+/]+", 0, "length(v) >= 32 AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')"),
        "endpoint": (r"""(?:https?://[A-Za-z0-9.-]+(?::[0-9]+)?|(?i:host|endpoint|server)["']?[ ]*[:=][ ]*["']?[A-Za-z0-9-]+[.][A-Za-z0-9-]+[.][A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*)""", 0, "true"),
    }
    quote = lambda x: x.replace("'", "''")
    parts = []
    for i, (k, (p, g, ok)) in enumerate(kinds.items()):
        parts.append(f"""SELECT r, {i} AS k, '{k}' AS n, a, b FROM (SELECT r, unnest(f) AS f, unnest(v) AS v, unnest(e) AS b, unnest(e) - length(unnest(f)) AS a FROM (
            SELECT r, f, v, list_transform(generate_series(1, len(f)), lambda i: CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + list_sum(list_transform(f[1:i], lambda x: length(x))) AS INTEGER)) AS e FROM (
            SELECT r, regexp_extract_all(t, '{quote(p)}', 0) AS f, regexp_extract_all(t, '{quote(p)}', {g}) AS v, string_split_regex(t, '{quote(p)}') AS s FROM d WHERE regexp_matches(t, '{quote(p)}')))) WHERE {ok}""")
    near = lambda kinds: f"EXISTS (SELECT 1 FROM p c WHERE c.r = w.r AND c.n IN ({', '.join(repr(x) for x in kinds)}) AND (c.a >= w.b OR c.b <= w.a) AND c.a - w.b <= {SCOPE} AND w.a - c.b <= {SCOPE})"
    count = lambda k: f"CAST(count(*) FILTER (n = '{k}') AS BIGINT) AS n_{k}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({" UNION ALL ".join(parts)}),
q AS (SELECT r, k, n, a, b FROM p w WHERE n IN ('assign', 'access', 'hex') OR (n = 'ident' AND {near(SECRETS)}) OR (n = 'blob' AND {near(IDS)}) OR (n = 'endpoint' AND {near(IDS)} AND {near(SECRETS)})),
g AS (SELECT r, {", ".join(count(k) for k in kinds)}, string_agg(n || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < {len(BASE)}) AS base, string_agg(n || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM q GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""
