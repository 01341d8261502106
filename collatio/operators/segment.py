"""Segmentation: paragraphs, lines, sentences and list lines as rows, restored without loss.

Positions count from 1 and are part of every key, as rows of a DataFrame have no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatio.functions import text as T

# A bullet in front of a line, an item of a list inside a line.
MARK = f"^([{T.BLANK}]*(?:[•●◦▪▫·‣⁃∙*]|[-–—](?=[{T.BLANK}]))[{T.BLANK}]*)"
INLINE_ITEM = rf"(?:(?<=[:;])|^)[{T.BLANK}]*\p{{Nd}}+(?:\.-|\.|\)|-)[{T.BLANK}]+"
# End of fixed values.


def rows_of(df: DataFrame, array, number: str, value: str) -> DataFrame:
    """A row for each element of an array column, with its number."""
    return T.rows_of(df, ["*"], array, number, value)


def paragraph_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """(…, para_no, para) without the text."""
    return rows_of(df, T.paragraphs(F.col(text)), "para_no", "para").drop(text)


def sentence_rows(df: DataFrame, para: str = "para") -> DataFrame:
    """(…, sent_no, sentence) without the paragraph."""
    return rows_of(df, T.sentences(F.col(para)), "sent_no", "sentence").drop(para)


BLOCKS = "array<struct<mark: string, block: string, blank_after: int>>"


def blocks_of(text: Column) -> Column:
    """(mark, block, blank_after) of every line that isn't blank, in the text's own row.

    mark: the bullet in front, with its blanks; blank_after: how many blank lines follow.
    """

    def full(lines: Column) -> Column:
        """Lines that aren't blank, with how many lines there are until the next one."""
        numbered = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("i"))), lambda x: T.strip(x["line"]) != "")
        return T.let(numbered, lambda n: F.transform(n, lambda x, k: cut(x["line"], F.coalesce(F.get(n, k + 1)["i"], F.size(lines)) - x["i"] - 1)))

    def cut(line: Column, after: Column) -> Column:
        return T.let(F.regexp_extract(line, MARK, 1), lambda m: F.struct(m.alias("mark"), T.strip(F.substring(line, F.length(m) + 1, F.length(line))).alias("block"), after.alias("blank_after")))

    return T.let(T.lines(text), full)


def list_rows(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, block_no, mark, block, blank_after): a row for each of blocks_of."""
    return T.rows_of(df, key, blocks_of(F.col(text)), "block_no", "x").select(*key, "block_no", "x.*")


def merged_blocks(blocks: Column) -> Column:
    """(mark, block, blank_after, merged) of an array of blocks: runs of consecutive bullets as one block of sentences, in their own row.

    A blank line ends a run. Blocks without a bullet are kept, inline lists in them flattened; merged is null there.
    """
    bullet = lambda x: T.strip(x["mark"]) != ""
    closed = lambda x: F.when(T.ends_with(x, ".!?…"), x).otherwise(F.concat(F.regexp_replace(x, "[ ;,]+$", ""), F.lit(".")))

    def merged(b: Column) -> Column:
        goes_on = lambda i: bullet(F.get(b, i)) & bullet(F.get(b, i - 1)) & (F.get(b, i - 1)["blank_after"] == 0)
        starts = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: (i == 0) | ~goes_on(i))

        def run(at: Column, end: Column) -> Column:
            first, own = F.get(b, at), F.slice(b, at + 1, end - at)
            listed = bullet(first)
            text = F.when(listed, F.array_join(F.transform(own, lambda x: closed(x["block"])), " ")).otherwise(flattened(first["block"]))
            mark = F.when(listed, F.lit("")).otherwise(first["mark"])
            return F.struct(mark.alias("mark"), text.alias("block"), F.get(b, end - 1)["blank_after"].alias("blank_after"), F.when(listed, end - at).alias("merged"))

        return T.let(starts, lambda s: F.transform(s, lambda at, k: run(at, F.coalesce(F.get(s, k + 1), F.size(b)))))

    none_kind = "array<struct<mark: string, block: string, blank_after: int, merged: int>>"
    none = F.array().cast(none_kind)
    return T.let(blocks, lambda b: F.when(b.isNull(), F.lit(None).cast(none_kind)).when(F.size(b) > 0, merged(b)).otherwise(none))


def restored_text(blocks: Column) -> Column:
    """The text of an array of blocks with their marks again, at most one blank line between, none at the end."""
    line = lambda x: F.concat(x["mark"], T.strip(x["block"]), F.when(x["blank_after"] > 0, F.lit("\n")).otherwise(F.lit("")))
    return F.concat(F.regexp_replace(F.array_join(F.transform(blocks, line), "\n"), "\n+$", ""), F.lit("\n"))


def map_of(blocks: Column) -> Column:
    """Marks and blank lines (and merged) of an array of blocks as JSON."""
    return F.to_json(F.transform(blocks, lambda x: x.dropFields("block")))


def with_map(blocks: Column, stored: Column) -> Column:
    """(block, mark, blank_after) of edited blocks (texts, in order) and a stored map of theirs, in their own row; an error where their numbers differ, null where one is null."""
    kind = "array<struct<block: string, mark: string, blank_after: int>>"
    parsed = F.from_json(stored, "array<struct<mark: string, blank_after: int, merged: int>>")
    both = lambda m: F.zip_with(blocks, m, lambda x, y: F.struct(x.alias("block"), y["mark"].alias("mark"), y["blank_after"].alias("blank_after")))
    wrong = F.raise_error(F.lit("the text and its map differ in their number of blocks")).cast(kind)
    null = F.lit(None).cast(kind)
    return T.let(parsed, lambda m: F.when(blocks.isNull() | m.isNull(), null).when(F.size(blocks) == F.size(m), both(m)).otherwise(wrong))


def flattened(line):
    """A line `head: 1.- A; 2.- B` as `head: A y B`; other lines as they are. Items' first capitals go, acronyms' stay."""
    head, tail = F.substring_index(line, ":", 1), F.substring(line, F.instr(line, ":") + 1, F.length(line))
    bare = T.rstrip(tail)
    end = F.when(bare.rlike("[.!?]$"), F.substring(bare, -1, 1)).otherwise(F.lit("."))
    cut = F.split(F.regexp_replace(tail, "[.!? ]+$", ""), ";")
    items = F.transform(cut, lambda x: F.regexp_replace(T.strip(F.regexp_replace(x, INLINE_ITEM, "")), r"\.+$", ""))
    items = F.filter(items, lambda x: x != "")
    small = lambda x: F.when(x.rlike(r"^\p{Lu}(?!\p{Lu})"), F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, 2, F.length(x)))).otherwise(x)
    items = F.transform(items, small)
    body = F.when(F.size(items) > 1, F.concat(F.array_join(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(1))), ", "), F.lit(" y "), F.element_at(items, -1))).otherwise(F.get(items, F.lit(0)))
    listed = (F.regexp_count(line, F.lit(INLINE_ITEM)) >= 2) & line.contains(":")
    return F.when(listed & (F.size(items) > 0), F.concat(head, F.lit(": "), body, end)).otherwise(line)


def merged_lists(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, block_no, mark, block, blank_after, merged): runs of consecutive bullets as one block of sentences.

    A blank line ends a run. Blocks without a bullet are kept, inline lists in them flattened; merged is null there.
    """
    inside = Window.partitionBy(*key).orderBy("block_no")
    bullet = T.strip(F.col("mark")) != ""
    follows = bullet & F.lag(bullet, 1, False).over(inside) & (F.lag("blank_after", 1, 1).over(inside) == 0)
    rows = rows.withColumn("bullet", bullet).withColumn("run", F.sum(F.when(follows, 0).otherwise(1)).over(inside))
    closed = F.when(T.ends_with(F.col("block"), ".!?…"), F.col("block")).otherwise(F.concat(F.regexp_replace("block", "[ ;,]+$", ""), F.lit(".")))
    one = F.when(F.col("bullet"), closed).otherwise(flattened(F.col("block")))
    last = F.max_by("blank_after", "block_no")
    out = rows.groupBy(*key, "run").agg(F.array_sort(F.collect_list(F.struct("block_no", one.alias("b")))).alias("parts"), last.alias("blank_after"), F.first("bullet").alias("bullet"), F.first("mark").alias("mark"), F.count("*").cast("int").alias("n"))
    return out.select(*key, F.col("run").cast("int").alias("block_no"), F.when(F.col("bullet"), F.lit("")).otherwise(F.col("mark")).alias("mark"), F.array_join(F.transform("parts", lambda p: p["b"]), " ").alias("block"), "blank_after", F.when(F.col("bullet"), F.col("n")).alias("merged"))


def restored_lists(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, text): blocks with their marks again, at most one blank line between, none at the end."""
    line = F.concat("mark", T.strip(F.col("block")), F.when(F.col("blank_after") > 0, F.lit("\n")).otherwise(F.lit("")))
    out = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("block_no", line.alias("line")))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["line"]), "\n")
    return out.select(*key, F.concat(F.regexp_replace(joined, "\n+$", ""), F.lit("\n")).alias("text"))


def list_map(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, map): marks and blank lines of all blocks as JSON."""
    fields = ["mark", "blank_after"] + (["merged"] if "merged" in rows.columns else [])
    out = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("block_no", F.struct(*fields).alias("m")))).alias("parts"))
    return out.select(*key, F.to_json(F.transform("parts", lambda p: p["m"])).alias("map"))


def with_list_map(blocks: DataFrame, maps: DataFrame, key: list[str]) -> DataFrame:
    """(key, block_no, block, mark, blank_after) of edited blocks and a stored map; fails where their numbers differ."""
    parsed = maps.select(*key, F.from_json("map", "array<struct<mark: string, blank_after: int, merged: int>>").alias("m"))
    rows = parsed.select(*key, F.posexplode("m").alias("p", "x")).select(*key, (F.col("p") + 1).alias("block_no"), "x.mark", "x.blank_after")
    joined = blocks.select(*key, "block_no", "block").join(rows, [*key, "block_no"], "full")
    whole = F.col("block").isNotNull() & F.col("mark").isNotNull()
    return joined.withColumn("block", F.when(whole, F.col("block")).otherwise(F.raise_error(F.lit("the text and its map differ in their number of blocks")).cast("string")))


def bullet_numbers(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, bullets): numbers of the blocks that carry a bullet."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(T.strip(F.col("mark")) != "", F.col("block_no")))).alias("bullets"))
