"""Scalar functions of the document model as Column builders; all stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_all(c, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements one after another."""
    out = _col(c)
    for a, b in pairs:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def id_hex(c) -> Column:
    return F.lower(F.hex(_col(c)))


def parse_id(c) -> Column:
    """32 bytes from 64 hex digits of either case, else null."""
    return F.when(_col(c).rlike("^[0-9a-fA-F]{64}$"), F.unhex(_col(c)))


def head_bytes(major: int, n) -> Column:
    """The CBOR head of a length or integer in its shortest form, as lowercase hex."""
    n, base = _col(n), major << 5
    wide = lambda k, m: F.concat(F.lit(f"{base + m:02x}"), F.lower(F.lpad(F.hex(n), k, "0")))
    return F.when(n < 24, F.lower(F.lpad(F.hex(n + base), 2, "0"))).when(n < 1 << 8, wide(2, 24)).when(n < 1 << 16, wide(4, 25)).when(n < 1 << 32, wide(8, 26)).otherwise(wide(16, 27))


def html_escape(c) -> Column:
    return replace_all(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def xml_escape(c) -> Column:
    """Escapes for XML text and attributes; control characters XML forbids become spaces."""
    clean = F.regexp_replace(_col(c), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " ")
    return replace_all(clean, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])


#: Characters that mean something in Typst markup.
TYPST_MARKS = "\\\\#*_`<>@$\\[\\]~"


def typst_escape(c) -> Column:
    return F.regexp_replace(_col(c), f"([{TYPST_MARKS}])", "\\\\$1")


#: Named entities the importers know besides numeric ones. Fixed values.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™",
    "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•",
    "middot": "·", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "sect": "§", "para": "¶", "deg": "°", "times": "×", "divide": "÷",
    "laquo": "«", "raquo": "»",
}


def decode_named(c) -> Column:
    """Named entities decoded, ``&amp;`` last so that nothing is decoded twice."""
    pairs = [(f"&{k};", v) for k, v in ENTITIES.items() if k != "amp"]
    return replace_all(c, [*pairs, ("&amp;", "&")])


REFERENCE = re.compile(r"&(?:#[xX]([0-9A-Fa-f]+)|#([0-9]+)|([A-Za-z0-9]+));")


def decode_text(text: str) -> str:
    """Named and numeric character references of at most 31 characters, each decoded once; others stay as they are."""

    def one(m) -> str:
        code = int(m[1], 16) if m[1] else int(m[2]) if m[2] else None
        if len(m[0]) > 33 or (code is not None and (code > 0x10FFFF or 0xD800 <= code <= 0xDFFF)):
            return m[0]
        return ENTITIES.get(m[3], m[0]) if code is None else chr(code)

    return REFERENCE.sub(one, text)


def decode_entities(c) -> Column:
    """``decode_text`` of a column, by Arrow batch."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda t: t if t is None or "&" not in t else decode_text(t))

    return run(_col(c))


def collapse_keep(c) -> Column:
    """Runs of white space become one space; an edge space stays."""
    return F.regexp_replace(_col(c), "(?U)\\s+", " ")


def collapse_trim(c) -> Column:
    return F.trim(collapse_keep(c))


def layout_text(c) -> Column:
    """Text as laid out: spaces, tabs and line ends collapse, edges go."""
    return F.trim(F.regexp_replace(_col(c), "[ \\t\\n\\r]+", " "))


def path_text(c) -> Column:
    return F.coalesce(F.nullif(F.array_join(_col(c), "."), F.lit("")), F.lit("(root)"))


def numeric_cell(c) -> Column:
    return _col(c).rlike("[0-9]") & _col(c).rlike("^[0-9\\s.,+%$€£()-]+$")


def est_width(text, size) -> Column:
    return F.char_length(_col(text)) * _col(size) * 0.5


def split_point(n) -> Column:
    """The largest power of two below n, for n of at least 2."""
    return F.pow(F.lit(2.0), F.length(F.bin(_col(n) - 1)) - 1).cast("bigint")


def muldiv(a, b, d) -> Column:
    """a * b / d rounded half up, without overflow."""
    w = lambda x: _col(x).cast("decimal(19,0)")
    return F.floor((w(a) * w(b) + F.floor(_col(d) / 2)) / w(d)).cast("bigint")


MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}


def guess_mime(path) -> Column:
    ext, out = F.lower(F.element_at(F.split(_col(path), "\\."), -1)), F.lit("application/octet-stream")
    for k, v in MIME.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


#: Script ranges by name. Fixed values.
SCRIPTS = {
    "arabic": "\\u0600-\\u06FF\\u0750-\\u077F", "hebrew": "\\u0590-\\u05FF", "devanagari": "\\u0900-\\u097F", "thai": "\\u0E00-\\u0E7F",
    "cjk": "\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7AF", "greek": "\\u0370-\\u03FF", "cyrillic": "\\u0400-\\u04FF", "latin-extended": "\\u00C0-\\u024F",
}


def scripts_of(c) -> Column:
    """Names of the scripts a text uses, sorted."""
    hits = [F.when(_col(c).rlike(f"[{r}]"), F.lit(k)) for k, r in sorted(SCRIPTS.items())]
    return F.array_compact(F.array(*hits))


def count_in(text, needle: str) -> Column:
    """Non-overlapping occurrences, ignoring case."""
    low, n = F.lower(_col(text)), needle.lower()
    return ((F.char_length(low) - F.char_length(F.replace(low, F.lit(n), F.lit("")))) / len(n)).cast("bigint")
