"""Validation: every rule is a frame of findings ``(doc_id, severity, code, path, message)``.

A report is the union of the rules' frames; one bad document never fails a job. ``nodes`` has
``doc_id, path, ord, depth, kind, text`` and whatever further columns a rule names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.scalar import path_text

FINDING = ["doc_id", "severity", "code", "path", "message"]


def finding(rows: DataFrame, severity: str, code: str, message: str | Column, path: Column | None = None) -> DataFrame:
    where = F.lit("(root)") if path is None else path
    return rows.select("doc_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), where.alias("path"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def report(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def roll_up(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """``(doc_id, valid, errors, warnings)``: valid where there is no error."""
    n = findings.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", (zero("e") == 0).alias("valid"), zero("e").alias("errors"), zero("w").alias("warnings"))


def at() -> Column:
    """A finding's path as text."""
    return path_text("path")


def version(docs: DataFrame, major: int) -> DataFrame:
    return finding(docs.where(F.col("major") != major), "error", "E_VERSION", "unsupported major version")


def gated(findings: DataFrame, stop: DataFrame) -> DataFrame:
    """Findings of documents that no earlier rule stopped."""
    return findings.join(stop.select("doc_id").distinct(), "doc_id", "left_anti").select(*FINDING)


def undecodable(parts: DataFrame) -> DataFrame:
    """``parts(doc_id, part, problem)``: a part that does not decode, by its name."""
    bad = parts.where("problem is not null")
    return bad.select("doc_id", F.lit("error").alias("severity"), F.concat(F.lit("E_"), F.upper("part")).alias("code"), F.lit("(root)").alias("path"), F.col("problem").alias("message"))


def root_kind(nodes: DataFrame) -> DataFrame:
    wrong = finding(nodes.where("depth = 0 and kind <> 'doc'"), "error", "E_ROOT_KIND", "the root is not a doc")
    return wrong.unionByName(finding(nodes.where("depth > 0 and kind = 'doc'"), "error", "E_NESTED_DOC", "a doc inside a doc", at()))


def language(docs: DataFrame) -> DataFrame:
    return finding(docs.where("coalesce(trim(lang), '') = ''"), "error", "E_LANG", "no language")


def pages(cache: DataFrame, found: DataFrame) -> DataFrame:
    """``cache(doc_id, page_no, page_id, layout_hash)`` against the pages there are ``(page_id, width, height, problem)``."""
    j = cache.join(found, "page_id", "left")
    where = F.concat(F.lit("page "), F.col("page_no").cast("string"))
    missing = finding(j.where("width is null and problem is null"), "error", "E_PAGE_MISSING", "page object missing", where)
    broken = finding(j.where("problem is not null"), "error", "E_PAGE_DECODE", F.col("problem"), where)
    return report(missing, broken, finding(j.where("width <= 0 or height <= 0"), "error", "E_GEOMETRY", "page without an area", where))


def layout_hash(cache: DataFrame, claimed: DataFrame) -> DataFrame:
    """The hash over a document's page ids against the claimed one."""
    got = cache.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "page_id"))), lambda x: x["page_id"]), ""), 256).alias("h"))
    return finding(got.join(claimed, "doc_id").where("h <> layout_hash"), "error", "E_LAYOUT_HASH", "layout hash differs")


def unknown_fields(values: DataFrame, fields: DataFrame) -> DataFrame:
    """Filled values ``(doc_id, field_id)`` of fields the document lacks."""
    return finding(values.join(fields, ["doc_id", "field_id"], "left_anti"), "error", "E_FIELD_LAYER_ID", F.concat(F.lit("unknown field "), F.col("field_id").cast("string")))


def has_cycle(edges: list[tuple]) -> bool:
    """Whether leaves taken off again and again leave anything of ``(field, ref)`` edges."""
    refs: dict = {}
    for field, ref in edges:
        refs.setdefault(field, set()).add(ref)
    users: dict = {}
    for field, own in refs.items():
        own.intersection_update(refs)
        for ref in own:
            users.setdefault(ref, []).append(field)
    ready = [f for f, own in refs.items() if not own]
    left = len(refs)
    while ready:
        left -= 1
        for user in users.get(x := ready.pop(), ()):
            refs[user].discard(x)
            if not refs[user]:
                ready.append(user)
    return left > 0


def field_cycles(reads: DataFrame) -> DataFrame:
    """``reads(doc_id, field_id, ref)`` between computed fields: documents whose fields depend on each other in a circle.

    One shuffle by document, whose own fields bound the group; no rounds, so chains may be of any length.
    """
    import pyarrow as pa

    per = reads.where("doc_id is not null").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("field_id", "ref")).alias("e"))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([has_cycle([(x["field_id"], x["ref"]) for x in e]) for e in b.column(1).to_pylist()], pa.bool_()))

    return finding(per.mapInArrow(run, per.schema).select("doc_id"), "error", "E_FIELD_CYCLE", "computed fields depend on each other")


def constraints(violations: DataFrame) -> DataFrame:
    """Violations ``(doc_id, field, message)`` are warnings here."""
    return finding(violations, "warning", "W_CONSTRAINT", F.concat_ws(": ", "field", "message"))


def profiles(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, profile, has_cache, has_provenance, has_fields, has_index)``."""
    archive, stream = docs.where("profile = 'archive'"), docs.where("profile = 'stream'")
    return report(
        finding(archive.where("not has_cache"), "error", "E_ARCHIVE_CACHE", "an archive needs a render cache"),
        finding(archive.where("not has_provenance"), "error", "E_ARCHIVE_PROV", "an archive needs provenance"),
        finding(archive.where("has_fields"), "error", "E_ARCHIVE_FIELDS", "an archive has no open fields"),
        finding(stream.where("not has_index"), "error", "E_STREAM_INDEX", "a stream needs a page index"),
    )


def objects(verdicts: DataFrame) -> DataFrame:
    """``(doc_id, id, verdict)`` of orphan and missing objects."""
    lost = finding(verdicts.where("verdict = 'missing'"), "error", "E_MISSING_OBJECT", F.col("id").cast("string"))
    return lost.unionByName(finding(verdicts.where("verdict = 'orphan'").select("doc_id").distinct(), "warning", "W_ORPHANS", "unreachable objects"))


def figures(nodes: DataFrame, resources: DataFrame) -> DataFrame:
    figs = nodes.where("kind = 'fig'")
    blank = finding(figs.where("coalesce(trim(alt), '') = '' and not coalesce(decorative, false)"), "error", "E_ALT_TEXT", "figure without alternative text", at())
    return blank.unionByName(finding(figs.join(resources, ["doc_id", "res_id"], "left_anti"), "error", "E_FIG_RES", "figure resource missing", at()))


def tables(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``nodes`` of kind table with ``columns``; ``rows(doc_id, path, part, row_no, spans)``: the sum of column spans."""
    t = nodes.where("kind = 'table'")
    bare = finding(t.join(rows.where("part = 'body'"), ["doc_id", "path"], "left_anti"), "error", "E_TABLE_EMPTY", "table without body rows", at())
    bad = t.select("doc_id", "path", "columns").where("columns > 0").join(rows, ["doc_id", "path"]).where("spans <> columns")
    return bare.unionByName(finding(bad, "error", "E_TABLE_SHAPE", F.concat(F.lit("row "), F.col("row_no").cast("string")), at()))


def emptiness(nodes: DataFrame) -> DataFrame:
    lists = finding(nodes.where("kind = 'list' and coalesce(items, 0) = 0"), "warning", "W_LIST_EMPTY", "empty list", at())
    return lists.unionByName(finding(nodes.where("kind = 'math' and coalesce(trim(text), '') = ''"), "error", "E_MATH_EMPTY", "empty formula", at()))


def field_ids(fields: DataFrame) -> DataFrame:
    """``fields(doc_id, field_id, refs array)``: duplicate ids and references to none."""
    twice = fields.groupBy("doc_id", "field_id").agg(F.count("*").alias("n")).where("n > 1")
    refs = fields.select("doc_id", F.explode("refs").alias("field_id")).distinct().join(fields.select("doc_id", "field_id"), ["doc_id", "field_id"], "left_anti")
    name = F.col("field_id").cast("string")
    return finding(twice, "error", "E_FIELD_DUP", name).unionByName(finding(refs, "error", "E_FIELD_REF", name))


def inlines(spans: DataFrame, styles: DataFrame) -> DataFrame:
    """``spans(doc_id, path, kind, style_id, href)`` against ``styles(doc_id, n_styles)``."""
    j = spans.join(styles, "doc_id", "left")
    bad = finding(j.where("style_id >= coalesce(n_styles, 0)"), "error", "E_STYLE_REF", "unknown style", at())
    return bad.unionByName(finding(j.where("kind = 'link' and coalesce(trim(href), '') = ''"), "error", "E_LINK_EMPTY", "empty link", at()))
