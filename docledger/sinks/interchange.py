"""Content trees as Pandoc JSON, Typst markup, and a redline report."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.functions.scalar import html_escape
from docledger.operators.tree import listagg
from docledger.sources.content import inline_text


def _words(text: str) -> list[dict]:
    out: list[dict] = []
    for part in re.split(r"( )", text):
        if part:
            out.append({"t": "Space"} if part == " " else {"t": "Str", "c": part})
    return out


NO_ATTR = ["", [], []]
WRAPS = {"bold": "Strong", "italic": "Emph", "underline": "Underline"}


def pandoc_inlines(inlines: list) -> list[dict]:
    out: list[dict] = []
    for x in inlines:
        if isinstance(x, str):
            out += _words(x)
        elif x["kind"] == "link":
            out.append({"t": "Link", "c": [NO_ATTR, pandoc_inlines(x["children"]), [x["href"], ""]]})
        elif x["kind"] == "math":
            out.append({"t": "Math", "c": [{"t": "InlineMath"}, x["text"]]})
        elif x["kind"] == "fnref":
            out.append({"t": "Superscript", "c": _words(x["id"])})
        else:
            got: list = pandoc_inlines(x["children"])
            for s in x["style"].split("+") if x["style"] else []:
                got = [{"t": "Code", "c": [NO_ATTR, inline_text(x["children"])]}] if s == "mono" else [{"t": WRAPS[s], "c": got}]
            out += got
    return out


def pandoc_blocks(blocks: list) -> list[dict]:
    out: list[dict] = []
    for b in blocks:
        k = b["kind"]
        if k == "h":
            out.append({"t": "Header", "c": [b["level"], NO_ATTR, pandoc_inlines(b["inlines"])]})
        elif k == "p":
            out.append({"t": "Para", "c": pandoc_inlines(b["inlines"])})
        elif k == "sec":
            inner = pandoc_blocks(b["children"])
            out.append({"t": "BlockQuote", "c": inner} if b["role"] == "quote" else {"t": "Div", "c": [["", [b["role"]], []], inner]})
        elif k == "list":
            items = [pandoc_blocks(i) for i in b["items"]]
            out.append({"t": "OrderedList", "c": [[1, {"t": "Decimal"}, {"t": "Period"}], items]} if b["ordered"] else {"t": "BulletList", "c": items})
        elif k == "code":
            out.append({"t": "CodeBlock", "c": [NO_ATTR, b["text"]]})
        elif k == "math":
            out.append({"t": "Para", "c": [{"t": "Math", "c": [{"t": "DisplayMath"}, b["text"]]}]})
        elif k == "fig":
            out.append({"t": "Para", "c": [{"t": "Image", "c": [NO_ATTR, _words(b["alt"]), [b["res"], ""]]}]})
        elif k == "table":
            out.append(_pandoc_table(b["rows"]))
        elif k == "field":
            out.append({"t": "Para", "c": _words(f"{b['text']}: ____")})
        elif k == "redacted":
            out.append({"t": "Para", "c": _words(f"[REDACTED: {b.get('text') or ''}]")})
        elif k == "pagebreak":
            out.append({"t": "HorizontalRule"})
    return out


def _pandoc_table(rows: list) -> dict:
    cell = lambda c: [NO_ATTR, {"t": "AlignDefault"}, 1, 1, [{"t": "Plain", "c": pandoc_inlines(c)}]]
    part = lambda p: [[NO_ATTR, [cell(c) for c in r]] for q, r in rows if q == p]
    width = max((len(r) for _, r in rows), default=0)
    cols = [[{"t": "AlignDefault"}, {"t": "ColWidthDefault"}]] * width
    return {"t": "Table", "c": [NO_ATTR, [None, []], cols, [NO_ATTR, part("head")], [[NO_ATTR, 0, [], part("body")]], [NO_ATTR, part("foot")]]}


def to_pandoc(blocks: list, title: str | None = None) -> str:
    meta = {"title": {"t": "MetaInlines", "c": _words(title)}} if title else {}
    return json.dumps({"pandoc-api-version": [1, 23], "meta": meta, "blocks": pandoc_blocks(blocks)}, ensure_ascii=False)


# -- Typst ----------------------------------------------------------------------------------------

SPECIAL = re.compile(r"([\\#*_`<>@$\[\]~])")


def typst_escape(text: str) -> str:
    return SPECIAL.sub(r"\\\1", text)


def longest_run(text: str, mark: str = "`") -> int:
    return max((len(m) for m in re.findall(f"{re.escape(mark)}+", text)), default=0)


def typst_inlines(inlines: list) -> str:
    out = []
    for x in inlines:
        if isinstance(x, str):
            out.append(typst_escape(x))
        elif x["kind"] == "link":
            to = x["href"].replace("\\", "\\\\").replace('"', '\\"')
            out.append(f'#link("{to}")[{typst_inlines(x["children"])}]')
        elif x["kind"] == "math":
            out.append(typst_escape(x["text"]))
        elif x["kind"] == "fnref":
            out.append(f"#super[{typst_escape(x['id'])}]")
        else:
            body = typst_inlines(x["children"])
            for s in x["style"].split("+") if x["style"] else []:
                body = {"bold": f"#strong[{body}]", "italic": f"#emph[{body}]", "underline": f"#underline[{body}]"}.get(s) or f"#raw({json.dumps(inline_text(x['children']), ensure_ascii=False)})"
            out.append(body)
    return "".join(out)


def typst_block(b: dict, indent: str = "") -> str:
    k = b["kind"]
    if k == "h":
        return "=" * b["level"] + " " + typst_inlines(b["inlines"])
    if k == "p":
        return typst_inlines(b["inlines"])
    if k == "sec":
        inner = to_typst(b["children"])
        return f"#quote(block: true)[\n{inner}\n]" if b["role"] == "quote" else inner
    if k == "list":
        mark = "+ " if b["ordered"] else "- "
        return "\n".join(indent + mark + "\n".join(typst_block(x, indent + "  ") for x in i) for i in b["items"])
    if k == "code":
        fence = "`" * max(3, longest_run(b["text"]) + 1)
        return f"{fence}\n{b['text']}\n{fence}"
    if k == "table":
        width = max((len(r) for _, r in b["rows"]), default=1)
        cells = ", ".join(f"[{typst_inlines(c)}]" for _, r in b["rows"] for c in r)
        return f"#table(columns: {width}, {cells})"
    if k == "fig":
        return f"#figure(image({json.dumps(b['res'])}, alt: {json.dumps(b['alt'], ensure_ascii=False)}))"
    if k == "pagebreak":
        return "#pagebreak()"
    if k == "redacted":
        return typst_escape(f"[REDACTED: {b.get('text') or ''}]")
    return typst_escape(b.get("text") or "")


def to_typst(blocks: list) -> str:
    return "\n\n".join(typst_block(b) for b in blocks)


# -- redline report -------------------------------------------------------------------------------


def redline_html(changes: DataFrame) -> DataFrame:
    """``(doc_id, predecessor, ord, change, old, new)`` -> one HTML report per pair."""
    old, new = (html_escape(F.coalesce(F.col(c), F.lit(""))) for c in ("old", "new"))
    row = F.concat(F.lit("<tr class='"), F.col("change"), F.lit("'><td>"), F.col("ord").cast("string"), F.lit("</td><td><del>"), old, F.lit("</del></td><td><ins>"), new, F.lit("</ins></td></tr>"))
    body = changes.groupBy("doc_id", "predecessor").agg(listagg(row, "ord", "\n").alias("body"), F.count("*").alias("changes"))
    return body.select("doc_id", "predecessor", "changes", F.concat(F.lit("<table>\n"), F.col("body"), F.lit("\n</table>")).alias("html"))
