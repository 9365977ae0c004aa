"""Node tables: content trees as rows, and traversal, extraction and search over them.

A node is ``(doc_id, path, ord, depth, kind, text, ...)``: ``path`` is the array of child
indices from the root, ``ord`` the place in reading order. Ancestry is a prefix test on paths, so
no traversal recurses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.plans.storage import materialize


def nodes_of_lines(docs: DataFrame) -> DataFrame:
    """Each document's lines as its blocks: paragraphs, or table rows where a line has `` | `` cells."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    kind = F.when(F.col("text").contains(" | "), "row").otherwise("p")
    return parts.select("doc_id", F.array("i").alias("path"), F.col("i").cast("bigint").alias("ord"), F.lit(1).alias("depth"), kind.alias("kind"), "text")


def nodes_of_conversations(turns: DataFrame) -> DataFrame:
    """A conversation as a document: a section for each turn (its role), holding one paragraph."""
    t = F.col("turn").cast("int")
    sec = turns.select(F.col("conv_id").alias("doc_id"), F.array(t).alias("path"), (2 * F.col("turn")).alias("ord"), F.lit(1).alias("depth"), F.lit("sec").alias("kind"), "role", F.lit(None).cast("string").alias("text"))
    par = turns.select(F.col("conv_id").alias("doc_id"), F.array(t, F.lit(0)).alias("path"), (2 * F.col("turn") + 1).alias("ord"), F.lit(2).alias("depth"), F.lit("p").alias("kind"), F.lit(None).cast("string").alias("role"), "text")
    return sec.union(par)


def nodes_of_dialogues(turns: DataFrame) -> DataFrame:
    """A conversation as a document: a section for each turn, holding a paragraph for each sentence."""
    t, path = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("t"), "text"), F.array("t")
    sec = t.select("doc_id", path.alias("path"), F.lit(1).alias("depth"), F.lit("sec").alias("kind"), F.lit(None).cast("string").alias("text"))
    par = t.select("doc_id", "t", F.posexplode(F.split("text", "\\. ")).alias("k", "text"))
    return sec.unionByName(par.select("doc_id", F.array("t", "k").alias("path"), F.lit(2).alias("depth"), F.lit("p").alias("kind"), "text"))


def listagg(value: Column, order: str, sep: str) -> Column:
    """Texts of a group joined in order."""
    got = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return F.array_join(F.transform(got, lambda x: x["v"]), sep)


def block_text(kind: Column, text: Column) -> Column:
    """A block as plain text: cells of a row by tabs, marks for lists, figures, fields and redactions."""
    cells = F.array_join(F.transform(F.split(text, " \\| "), lambda c: F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))), "\t")
    return F.when(kind == "row", cells).when(kind == "li", F.concat(F.lit("- "), text)).when(kind == "fig", F.concat(F.lit("["), text, F.lit("]"))).when(kind == "redacted", F.concat(F.lit("[REDACTED: "), text, F.lit("]"))).otherwise(text)


def extract(nodes: DataFrame) -> DataFrame:
    """``(doc_id, text)``: the blocks' text in reading order, blank lines between, one newline at the end."""
    blocks = nodes.where("text is not null").select("doc_id", "ord", block_text(F.col("kind"), F.col("text")).alias("b"))
    out = blocks.groupBy("doc_id").agg(listagg(F.col("b"), "ord", "\n\n").alias("text"))
    return out.select("doc_id", F.concat(F.rtrim(F.regexp_replace("text", "\\s+$", "")), F.lit("\n")).alias("text"))


def _rendered(rows: list[dict]) -> str:
    """A document's node rows, in reading order, as plain text."""
    kids: dict[tuple, list] = {}
    for r in rows:
        if r["path"]:
            kids.setdefault(tuple(r["path"]), []).append(r)
    below: dict[tuple, list[tuple]] = {}
    for path in sorted(kids):
        for k in range(len(path)):
            below.setdefault(path[:k], []).append(path)

    def children(path: tuple) -> list[tuple]:
        return [p for p in below.get(path, ()) if len(p) == len(path) + 1]

    def walk(path: tuple) -> str:
        return "".join(block(r, path) for r in kids[path])

    def block(r: dict, path: tuple) -> str:
        kind, text = r["kind"], r["text"] or ""
        if kind in ("doc", "sec", "salted"):
            return "".join(walk(p) for p in children(path))
        if kind == "list":
            items = sorted({p[: len(path) + 1] for p in below.get(path, ())})
            told = ("".join(walk(p) for p in children(i)).strip() for i in items)
            return "".join(f"{f'{n}. ' if r['ordered'] else '- '}{t}\n" for n, t in enumerate(told, 1)) + "\n"
        if kind == "table":
            out, last = [], None
            for p in children(path):
                for c in kids[p]:
                    row = c["row"]
                    inner = (c["text"] or "") + "".join(walk(q) for q in children(p))
                    out.append(("" if last is None else "\t" if row == last else "\n") + inner.strip().replace("\n", " "))
                    last = row
            return "".join(out) + ("\n\n" if out else "\n")
        if kind == "fig":
            return f"[{r['alt'] or ''}]{' ' + text if text else ''}\n\n"
        if kind == "field":
            return f"[{text}: ____]\n\n"
        if kind == "redacted":
            return f"[REDACTED{': ' + text if text else ''}]\n\n"
        return "" if kind == "pagebreak" else text + "\n\n"

    out = "".join(walk(p) for p in children(())).rstrip()
    return out + "\n" if out else ""


def extract_trees(nodes: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of nested documents: numbered and marked items, rows of cells, captions, fields, redactions.

    ``nodes`` are rows of an importer (``doc_id, path, ord, kind, ordered, text, alt, row``; ``row`` numbers a cell's table
    row). A document's nodes meet in one row, which is bounded by the document.
    """
    import pyarrow as pa

    fields = F.struct("ord", F.col("path").cast("array<int>").alias("path"), "kind", "ordered", "text", "alt", "row")
    per = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(fields)).alias("rows"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_rendered(x) for x in part.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return per.mapInArrow(run, "doc_id bigint, text string")


def preview(kind: Column, level: Column, text: Column) -> Column:
    """One line that names a node's kind: ``[h1] ...``, ``[code] ...``, bullets, cells by bars."""
    return F.when(kind == "h", F.concat(F.lit("[h"), level.cast("string"), F.lit("] "), text)).when(kind == "code", F.concat(F.lit("[code] "), text)).when(kind == "li", F.concat(F.lit("• "), text)).when(kind == "sec", F.lit("[section]")).otherwise(text)


def fields_in_order(nodes: DataFrame) -> DataFrame:
    """Field nodes with their rank in document order."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    return nodes.where("kind = 'field'").select("doc_id", (F.row_number().over(w) - 1).cast("bigint").alias("rank"), "text")


def resolve(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes at the given ``(doc_id, path)``; unknown paths give null kind and text."""
    return wanted.join(nodes.select("doc_id", "path", "kind", "text"), ["doc_id", "path"], "left")


def last_by(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The last value of each key in order."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def page_text(ops: DataFrame) -> DataFrame:
    """``(doc_id, page_no, text)`` in paint order: a lower line starts a new one, else a space."""
    w = Window.partitionBy("doc_id", "page_no").orderBy("op_no")
    sep = F.when(F.lag("y").over(w).isNull(), "").when(F.col("y") > F.lag("y").over(w), "\n").otherwise(" ")
    joined = ops.where("text is not null").select("doc_id", "page_no", "op_no", F.concat(sep, F.col("text")).alias("t"))
    return joined.groupBy("doc_id", "page_no").agg(listagg(F.col("t"), "op_no", "").alias("text"))


def matches(pages: DataFrame, needle: str, text: str = "text") -> DataFrame:
    """Rows with ``hits``: non-overlapping occurrences, ignoring case; rows without any are left out."""
    from docledger.functions.scalar import count_in

    return pages.withColumn("hits", count_in(text, needle)).where("hits > 0")


def next_match(pages: DataFrame, current: DataFrame) -> DataFrame:
    """``pages(doc_id, page)`` with a match, ``current(doc_id, cur)`` -> the next page, wrapping round."""
    j = current.join(pages, "doc_id", "left").groupBy("doc_id", "cur")
    return j.agg(F.coalesce(F.min(F.when(F.col("page") > F.col("cur"), F.col("page"))), F.min("page")).alias("page"))


def text_layer(ops: DataFrame) -> DataFrame:
    """``(doc_id, page_no, json)``: the selectable runs of each page, blank ones skipped."""
    runs = ops.where("trim(text) <> ''").groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("op_no", "text"))).alias("runs"))
    return runs.select("doc_id", "page_no", F.to_json(F.transform("runs", lambda r: F.struct(r["op_no"].alias("op"), r["text"].alias("text")))).alias("json"))


def banner(verdicts: DataFrame) -> DataFrame:
    """``(doc_id, errors, warnings, signatures, bad_signatures)`` -> the state shown to a reader."""
    state = F.when(F.col("errors") > 0, "INVALID").when(F.col("bad_signatures") > 0, "BAD SIGNATURE").when(F.col("signatures") > 0, "VERIFIED").when(F.col("warnings") > 0, "UNSIGNED, WITH WARNINGS").otherwise("UNSIGNED")
    return verdicts.select("doc_id", state.alias("state"))


def struct_tag(kind: Column, level: Column) -> Column:
    """The accessibility tag of a node's kind."""
    return F.when(kind == "h", F.concat(F.lit("H"), level.cast("string"))).when(kind == "code", "Code").when(kind == "math", "Formula").when(kind == "fig", "Caption").when(kind == "li", "Lbl").otherwise("P")


def paragraphs(docs: DataFrame) -> DataFrame:
    """Naive recovery: groups of lines between blank lines become paragraphs (gaps and islands)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    blank = F.trim("line") == ""
    w = Window.partitionBy("doc_id").orderBy("i")
    grouped = lines.withColumn("g", F.sum(blank.cast("int")).over(w)).where(~blank)
    return grouped.groupBy("doc_id", "g").agg(listagg(F.trim("line"), "i", " ").alias("text"), F.min("i").cast("bigint").alias("first_line"))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at n // 2 of the sorted values (not interpolated)."""
    s = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("v"))
    return s.select(*keys, F.element_at("v", (F.size("v") / 2).cast("int") + 1).alias("median"))


def heading_level(size: Column, median: Column, text: Column) -> Column:
    """1 to 3 for short text well above the median size, else null."""
    ratio = size / median
    return F.when((ratio >= 1.25) & (F.char_length(text) <= 120), F.when(ratio >= 2.0, 1).when(ratio >= 1.6, 2).otherwise(3))


# -- structural diff -------------------------------------------------------------------------


#: Nodes whose children are compared one by one; all others are compared whole.
CONTAINERS = ("doc", "sec", "salted")


def with_roots(nodes: DataFrame) -> DataFrame:
    """``(doc_id, path, kind, text)`` of the nodes, and a root of kind doc for each document."""
    own = nodes.where("size(path) > 0").select("doc_id", F.col("path").cast("array<int>").alias("path"), "kind", "text")
    root = nodes.select("doc_id").distinct().select("doc_id", F.array().cast("array<int>").alias("path"), F.lit("doc").alias("kind"), F.lit(None).cast("string").alias("text"))
    return own.unionByName(root)


def subtrees(nodes: DataFrame) -> DataFrame:
    """The nodes with ``tree``, the hash of their subtree's kinds and texts in order, and ``kids``, their children.

    Every node reports to each of its ancestors (as many rows as its depth), so one shuffle serves all levels.
    """
    n = with_roots(nodes)
    h = F.sha2(F.concat_ws("\x1f", "kind", F.coalesce("text", F.lit(""))), 256)
    up = n.select("doc_id", F.col("path").alias("own"), h.alias("h"), F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("path"))
    told = F.transform(F.array_sort(F.collect_list(F.struct(F.col("own").alias("o"), F.concat(F.size("own").cast("string"), F.lit(":"), "h").alias("v")))), lambda x: x["v"])
    by = up.groupBy("doc_id", "path").agg(F.sha2(F.array_join(told, ""), 256).alias("tree"), F.count_if(F.size("own") == F.size("path") + 1).alias("kids"))
    return n.join(by, ["doc_id", "path"])


def topmost(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose path has no proper prefix among the rows of the same keys."""
    above = rows.select(*keys, F.col("path").alias("of"), F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("path"))
    covered = above.where("size(path) < size(of)").join(rows.select(*keys, "path"), [*keys, "path"], "left_semi").select(*keys, F.col("of").alias("path")).distinct()
    return rows.join(covered, [*keys, "path"], "left_anti")


def _first(rows: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("doc_id", "predecessor").orderBy("path")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def structural_diff(left: DataFrame, right: DataFrame, pairs: DataFrame, most: int = 200) -> DataFrame:
    """``(doc_id, predecessor, path)``: where documents paired by ``pairs(doc_id, predecessor)`` differ.

    Equal subtrees are passed over. A node of another kind, a container with another number of children and
    anything else that differs is reported and not descended into; at most ``most`` places of a pair, in reading order.
    """
    a, b = (subtrees(n).select("doc_id", "path", *(F.col(c).alias(f"{c}_{x}") for c in ("kind", "tree", "kids"))) for n, x in ((left, "a"), (right, "b")))
    j = pairs.join(b, "doc_id").join(a.withColumnRenamed("doc_id", "predecessor"), ["predecessor", "path"]).where("tree_a <> tree_b")
    stop = (F.col("kind_a") != F.col("kind_b")) | ~F.col("kind_b").isin(*CONTAINERS) | (F.col("kids_a") != F.col("kids_b"))
    from docledger.functions.scalar import path_text

    found = topmost(j.where(stop).select("doc_id", "predecessor", "path"), ["doc_id", "predecessor"])
    return _first(found, most).select("doc_id", "predecessor", path_text("path").alias("path"))


def redline(left: DataFrame, right: DataFrame, pairs: DataFrame, most: int = 500) -> DataFrame:
    """``(doc_id, predecessor, path, ord, change)``: insert, delete or change, child by child to the longer length.

    ``ord`` is the last step of the path. Containers of one kind are descended into whatever their numbers of children.
    """
    a = pairs.join(subtrees(left).select(F.col("doc_id").alias("predecessor"), "path", F.col("kind").alias("kind_a"), F.col("tree").alias("tree_a")), "predecessor")
    b = pairs.join(subtrees(right).select("doc_id", "path", F.col("kind").alias("kind_b"), F.col("tree").alias("tree_b")), "doc_id")
    j = a.join(b, ["doc_id", "predecessor", "path"], "full_outer")
    same_kind = F.col("kind_a") == F.col("kind_b")
    change = F.when(F.col("kind_a").isNull(), "insert").when(F.col("kind_b").isNull(), "delete").when(~same_kind | (~F.col("kind_b").isin(*CONTAINERS) & (F.col("tree_a") != F.col("tree_b"))), "change")
    found = topmost(j.select("doc_id", "predecessor", "path", change.alias("change")).where("change is not null"), ["doc_id", "predecessor"])
    return _first(found, most).select("doc_id", "predecessor", "path", F.try_element_at("path", F.lit(-1)).cast("bigint").alias("ord"), "change")


def amendments(docs: DataFrame, series: str) -> DataFrame:
    """``(doc_id, predecessor)``: each document of a series with the one before it.

    Sorted by range over (series, doc_id), so a long series spreads over many tasks; the first
    row of a task takes its predecessor from the last row of the series in an earlier task.
    """
    cut = docs.select(F.col(series).alias("s"), "doc_id").repartitionByRange("s", "doc_id").withColumn("part", F.spark_partition_id())
    cut = materialize(cut, "series")
    inner = cut.withColumn("p", F.lag("doc_id").over(Window.partitionBy("part", "s").orderBy("doc_id")))
    ends = cut.groupBy("s", "part").agg(F.max("doc_id").alias("end"))
    ends = ends.select(F.col("s").alias("es"), F.lead("part").over(Window.partitionBy("s").orderBy("part")).alias("next"), "end")
    j = inner.join(ends, F.col("p").isNull() & F.col("s").eqNullSafe(F.col("es")) & (F.col("part") == F.col("next")), "left")
    return j.select("doc_id", F.coalesce("p", "end").alias("predecessor")).where("predecessor is not null")
