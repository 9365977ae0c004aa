"""Deterministic layout on a fixed-advance metric, in whole micrometres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions.scalar import layout_text, muldiv


def advance_width(text: Column, advance: int) -> Column:
    """Sum of advances; control characters have none."""
    return F.char_length(F.regexp_replace(text, "[\\x00-\\x1F\\x7F]", "")) * advance


def break_lines(text: Column, width: int, advance: int = 1) -> Column:
    """Greedy first-fit lines of a paragraph; a word wider than a line stands alone."""
    words = F.filter(F.split(layout_text(text), " "), lambda w: w != "")
    most = width // advance
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("line"))

    def step(s, w):
        fits = F.char_length(s["line"]) + 1 + F.char_length(w) <= most
        done = F.when(s["line"].isNull() | fits, s["lines"]).otherwise(F.array_append(s["lines"], s["line"]))
        line = F.when(s["line"].isNull(), w).when(fits, F.concat(s["line"], F.lit(" "), w)).otherwise(w)
        return F.struct(done.alias("lines"), line.alias("line"))

    return F.aggregate(words, start, step, lambda s: F.when(s["line"].isNull(), s["lines"]).otherwise(F.array_append(s["lines"], s["line"])))


def column_widths(columns: DataFrame, total: int) -> DataFrame:
    """``columns(table_id, col, weight)`` -> widths that add up to ``total``; the last takes the remainder."""
    w = Window.partitionBy("table_id")
    share = columns.withColumn("all", F.sum(F.col("weight") * 1000).over(w)).withColumn("last", F.col("col") == F.max("col").over(w))
    share = share.withColumn("own", muldiv(F.lit(total), F.col("weight") * 1000, F.col("all")))
    before = F.coalesce(F.sum("own").over(w.orderBy("col").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return share.select("table_id", "col", F.when(F.col("last"), F.lit(total) - before).otherwise(F.col("own")).cast("bigint").alias("width"))


def paginate(blocks: Column, page: int) -> Column:
    """Page numbers of ``array<struct<h, gap, force>>``: blocks stack with their gap (none at a page's top);
    one that does not fit, or forces a break, starts a page; one taller than a page stands alone."""
    start = F.struct(F.array().cast("array<int>").alias("pages"), F.lit(1).alias("no"), F.lit(0).cast("bigint").alias("y"))

    def step(s, b):
        need = F.when(s["y"] == 0, b["h"]).otherwise(b["gap"] + b["h"])
        new = (s["y"] > 0) & (b["force"] | (s["y"] + need > page))
        no = F.when(new, s["no"] + 1).otherwise(s["no"])
        y = F.when(new, b["h"]).otherwise(s["y"] + need).cast("bigint")
        return F.struct(F.array_append(s["pages"], no).alias("pages"), no.alias("no"), y.alias("y"))

    return F.aggregate(blocks, start, step, lambda s: s["pages"])


def place_blocks(blocks: Column, page: int, line: int) -> Column:
    """Page numbers of ``array<struct<h, before, after, force, keep>>``; null for forced breaks, which take no room.

    Between two blocks stands the larger of the space after the one and before the other, none at a page's top.
    A forced break starts a page unless one has just begun; a block that keeps with the next needs room for one
    more line; one taller than a page starts at the top of one.
    """
    start = F.struct(F.array().cast("array<int>").alias("pages"), F.lit(1).alias("no"), F.lit(0).cast("bigint").alias("y"), F.lit(True).alias("top"), F.lit(0).cast("bigint").alias("after"))

    def step(s, b):
        gap = F.when(s["top"], F.lit(0)).otherwise(F.greatest(s["after"], b["before"]))
        new = ~s["top"] & (b["force"] | (s["y"] + gap + b["h"] + F.when(b["keep"], line).otherwise(0) > page))
        no = F.when(new, s["no"] + 1).otherwise(s["no"])
        y = F.when(b["force"], F.when(new, 0).otherwise(s["y"])).when(new, b["h"]).otherwise(s["y"] + gap + b["h"]).cast("bigint")
        return F.struct(
            F.array_append(s["pages"], F.when(~b["force"], no)).alias("pages"), no.alias("no"), y.alias("y"),
            F.when(b["force"], new | s["top"]).otherwise(F.lit(False)).alias("top"), F.when(b["force"], s["after"]).otherwise(b["after"]).cast("bigint").alias("after"),
        )

    return F.aggregate(blocks, start, step, lambda s: s["pages"])


#: Marks that may not start, or end, a line. Fixed values.
NO_START, NO_END = "、。，．・：；？！）」』】〕〉》ー々", "（「『【〔〈《"


def cjk_breaks(text: Column) -> Column:
    """Character positions before which a line may break between CJK characters."""
    cjk = "[\\u3040-\\u30FF\\u3400-\\u9FFF\\uAC00-\\uD7AF\\u3000-\\u303F\\uFF00-\\uFFEF]"
    def ok(a, b):
        return a.rlike(cjk) & b.rlike(cjk) & ~F.contains(F.lit(NO_START), b) & ~F.contains(F.lit(NO_END), a)

    none = F.array().cast("array<int>")
    chars = F.transform(F.array(F.split(text, "")), lambda c: F.filter(F.sequence(F.lit(1), F.size(c) - 1), lambda i: ok(F.get(c, i - 1), F.get(c, i))))[0]
    return F.when(text.rlike(cjk) & (F.char_length(text) > 1), chars).otherwise(none)


def image_size(width_px: Column, height_px: Column, most: int) -> Column:
    """Pixels at 96 dpi as micrometres, scaled down to a width; 40 by 30 mm where unknown."""
    w = F.coalesce(muldiv(width_px, F.lit(25400), F.lit(96)), F.lit(40000))
    h = F.coalesce(muldiv(height_px, F.lit(25400), F.lit(96)), F.lit(30000))
    return F.struct(F.least(w, F.lit(most)).cast("bigint").alias("w"), F.when(w > most, muldiv(h, F.lit(most), w)).otherwise(h).cast("bigint").alias("h"))


def png_dimensions(data: Column) -> Column:
    """Width and height from a PNG header, null for other data."""
    ok = F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A"
    n = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("bigint")
    return F.when(ok & (F.octet_length(data) >= 24), F.struct(n(17).alias("w"), n(21).alias("h")))


def page_index(uses: DataFrame) -> DataFrame:
    """``(doc_id, page_no, ids)``: the distinct objects of each page, sorted."""
    return uses.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_set("object_id")).alias("ids"))


def recompute_verdict(stored: DataFrame, recomputed: DataFrame, engines: list[str]) -> DataFrame:
    """``stored(doc_id, engine, pages)``, ``recomputed(doc_id, again)`` -> Match, Mismatch, NoCache or UnknownEngine."""
    j = recomputed.join(stored, "doc_id", "left")
    v = F.when(F.col("pages").isNull(), "NoCache").when(~F.col("engine").isin(engines), "UnknownEngine").when(F.col("pages") == F.col("again"), "Match").otherwise("Mismatch")
    return j.select("doc_id", v.alias("verdict"))


#: Engine minor versions and the capability each adds. Fixed values.
CAPABILITIES = {1: "justify", 2: "hyphenation", 3: "columns", 4: "bidi", 5: "cjk", 6: "shaping", 7: "dictionary", 8: "vertical", 9: "math", 10: "widow-control", 11: "tibetan"}


def capabilities(versions: DataFrame) -> DataFrame:
    """``versions(engine)`` like ``1.4`` -> ``(engine, capability, supported)``; malformed versions support nothing."""
    known = versions.sparkSession.createDataFrame(sorted(CAPABILITIES.items()), "minor int, capability string")
    parts = F.regexp_extract("engine", "^1\\.([0-9]{1,2})(?:\\.[0-9]+)?$", 1)
    v = versions.select("engine", F.when(parts != "", parts).cast("int").alias("m"))
    return v.join(F.broadcast(known)).select("engine", "capability", F.coalesce(F.col("m") >= F.col("minor"), F.lit(False)).alias("supported"))


def code_lines(text: Column, tab: int = 4) -> Column:
    """Code as laid out: CR dropped, tabs filled to the next multiple of ``tab`` columns."""
    start = F.struct(F.lit("").alias("out"), F.lit(True).alias("first"))

    def fill(s, part):
        pad = F.repeat(F.lit(" "), tab - F.pmod(F.char_length(s["out"]), F.lit(tab)))
        return F.struct(F.when(s["first"], part).otherwise(F.concat(s["out"], pad, part)).alias("out"), F.lit(False).alias("first"))

    lines = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    return F.transform(lines, lambda line: F.aggregate(F.split(line, "\t"), start, fill, lambda s: s["out"]))


def split_paragraph(lines: Column, room: Column, least: int = 2) -> Column:
    """How many of a paragraph's lines stay on a page with ``room`` lines left.

    At least ``least`` lines stand on either side of a break; a paragraph that cannot be
    split so moves as a whole (0), one that fits stays as a whole.
    """
    stay = F.least(room, lines - least)
    return F.when(room >= lines, lines).when((stay < least) | (lines < 2 * least), 0).otherwise(stay).cast("int")


def flow_columns(blocks: Column, height: int, columns: int) -> Column:
    """``array<struct<page, column>>`` of blocks flowed down columns, then over pages; see ``paginate``."""
    return F.transform(paginate(blocks, height), lambda n: F.struct((F.floor((n - 1) / columns) + 1).cast("int").alias("page"), F.pmod(n - 1, F.lit(columns)).alias("column")))


#: Elements of mathematical markup that can be laid out. Fixed values.
MATH = ("math", "mrow", "mstyle", "mpadded", "mi", "mn", "mo", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "munder", "mover", "munderover", "mfenced")


def unsupported_math(markup: Column) -> Column:
    """Names of the elements outside the supported subset, sorted; empty where all can be laid out."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(markup, F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))), F.array(*map(F.lit, MATH))))


def justify(line: Column, width: int) -> Column:
    """A line of words spread to ``width`` characters; what does not divide goes to the leftmost gaps."""
    words = F.split(layout_text(line), " ")

    def spread(w):
        gaps, slack = F.size(w) - 1, F.lit(width) - F.aggregate(w, F.lit(0), lambda a, x: a + F.char_length(x))
        parts = F.transform(w, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.repeat(F.lit(" "), F.floor(slack / gaps).cast("int") + (i <= slack % gaps).cast("int")), x)))
        return F.when((gaps < 1) | (slack < gaps), F.array_join(w, " ")).otherwise(F.array_join(parts, ""))

    return F.transform(F.array(words), spread)[0]
