"""The few things read from a page outside JSON-LD: script blocks, the title, meta tags, entities."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesieve.functions.text import let, string_array, string_map, strip, text_or_empty

# Comments, scripts and styles are consumed as whole tokens, so tags inside them are never seen. An
# unclosed one reaches to the end of the page, which also keeps the scan linear.
_COMMENT = r"!--.*?(?:-->|\z)"
# A quoted attribute value may hold ">". The plain form reads tags whose quotes are not closed.
_TAG_REST = r"""(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>)"""
# Up to the next closing tag or the end, in steps from "<" to "<".
_SCRIPT_BODY = r"(?:[^<]++|<(?!/script\s*+>))*+"
_SCRIPT = rf"script\b{_TAG_REST}{_SCRIPT_BODY}(?:</script\s*+>|\z)"
_STYLE = r"style\b[^>]*>.*?(?:</style\s*>|\z)"
_TITLE = r"title\b[^>]*>.*?</title\s*>"
_META = rf"meta\b{_TAG_REST}"

# One "<" in front of all alternatives lets the scan skip everything else by a single comparison.
_BLOCK_TOKENS = rf"(?is)<(?:{_COMMENT}|{_SCRIPT})"
_HEAD_TOKENS = rf"(?is)<(?:{_COMMENT}|{_SCRIPT}|{_STYLE}|{_TITLE}|{_META})"

_PLUS = r"(?:\+|&#43;|&#[xX]2[bB];|&plus;)"
_LD_JSON = rf"application/ld{_PLUS}json"
_LD_JSON_TAG = (
    r"""^<(?i:script)\b(?:(?:[^>"'\s]++|"[^"]*+"|'[^']*+'|\s)*?|[^>]*?)(?<=\s)(?i:type)\s*=\s*"""
    rf"""(?:"{_LD_JSON}"|'{_LD_JSON}'|{_LD_JSON}(?=[\s>]))"""
)
_SCRIPT_CONTENT = rf"(?is)^<script\b{_TAG_REST}({_SCRIPT_BODY})"

_ATTRIBUTE = r"""(?s)([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']*)"""
_QUOTES = r"""^["']|["']$"""


def jsonld_scripts(html: Column) -> Column:
    """Bodies of the ``application/ld+json`` scripts of a page, in order, as ``array<string>``."""
    tokens = F.regexp_extract_all(html, F.lit(_BLOCK_TOKENS), F.lit(0))
    blocks = F.filter(tokens, lambda t: F.rlike(t, F.lit(_LD_JSON_TAG)))
    bodies = F.transform(blocks, lambda t: F.regexp_extract(t, _SCRIPT_CONTENT, 1))
    # Most pages carry no such block: a byte scan settles that before the tokenizer runs.
    return F.when(F.contains(html, F.lit("application/ld")), bodies).otherwise(string_array([]))


def _entity_table() -> dict[str, str]:
    """The common references: names of HTML 4, those of HTML 5 for ASCII, and #128 to #159.

    Names keep their semicolon; those that HTML also knows without one are listed twice. The numbers are
    read as Windows-1252, as browsers do.
    """
    names = {f"{name};": html5[f"{name};"] for name in name2codepoint}
    names |= {n: c for n, c in html5.items() if len(c) == 1 and (not n.endswith(";") or ord(c) < 128)}
    remapped = {f"#{b}": bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)}
    return names | remapped


def unescape_html(text: Column) -> Column:
    """Decode numeric and named character references; what is none stays as it is."""
    common = _entity_table()
    table, rare = string_map(common), string_map({n: c for n, c in html5.items() if n not in common})
    # without a semicolon the longest known name counts, whatever follows it
    bare = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)

    def code_point(code: Column) -> Column:
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        encoded = F.unhex(F.lpad(F.hex(code), 8, "0"))
        none = (
            code.between(1, 8) | (code == 11) | code.between(14, 31) | code.between(127, 159)
            | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
        )
        char = F.when(none, F.lit("")).otherwise(F.decode(encoded, "UTF-32"))
        return F.when(valid, char).otherwise(F.lit("\ufffd"))

    def character(ref: Column) -> Column:
        # leading zeros say nothing; what is longer than the largest code point is out of range
        hexadecimal, decimal = F.regexp_extract(ref, "^#.0*([0-9a-fA-F]*)", 1), F.regexp_extract(ref, "^#0*([0-9]*)", 1)
        beyond = F.lit(0x110000)
        number = F.when(
            F.rlike(ref, F.lit("^#[xX]")),
            F.when(F.length(hexadecimal) > 6, beyond).otherwise(F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10).cast("int")),
        ).when(
            ref.startswith("#"),
            F.when(F.length(decimal) > 7, beyond).otherwise(F.concat(F.lit("0"), decimal).cast("int")),
        )
        name = F.when(number.isNull(), ref).otherwise(F.concat(F.lit("#"), number))
        known = F.coalesce(F.try_element_at(table, name), F.when(number.isNotNull(), code_point(number)))
        return F.coalesce(known, F.when(ref != "", F.try_element_at(rare, ref)))

    def piece(part: Column) -> Column:
        ref = F.regexp_extract(part, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <#;]{1,32};?)", 1)
        start = F.regexp_extract(part, f"^({'|'.join(bare)})", 1)
        whole = F.concat(character(ref), F.substr(part, F.length(ref) + 1))
        begun = F.concat(F.try_element_at(table, start), F.substr(part, F.length(start) + 1))
        return F.coalesce(whole, begun, F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    decoded = F.concat(
        F.get(parts, F.lit(0)),
        F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece), ""),
    )
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def head_tokens(html: Column) -> Column:
    """Title and meta tags of a page, in order, skipping comments, scripts and styles."""
    tokens = F.regexp_extract_all(html, F.lit(_HEAD_TOKENS), F.lit(0))
    return F.filter(tokens, lambda t: F.rlike(t, F.lit(r"(?i)^<(?:title|meta)\b")))


def title_source(tokens: Column) -> Column:
    """Inside of the first title element, entities not decoded; NULL if there is none."""
    titles = F.filter(tokens, lambda t: F.rlike(t, F.lit(r"(?i)^<title\b")))
    return F.regexp_replace(F.get(titles, F.lit(0)), r"(?is)^<title\b[^>]*>|</title\s*>$", "")


def meta_attributes(tokens: Column) -> Column:
    """``array<struct<property, name, content>>`` of the meta tags, values raw (entities not decoded)."""

    def attributes(tag: Column) -> Column:
        pattern, body = F.lit(_ATTRIBUTE), F.regexp_replace(tag, r"(?i)^<meta", "")
        pairs = F.zip_with(
            F.regexp_extract_all(body, pattern, F.lit(1)),
            F.regexp_extract_all(body, pattern, F.lit(2)),
            lambda key, val: F.struct(F.lower(key).alias("key"), val.alias("val")),
        )

        def value(pairs: Column, name: str) -> Column:
            same = F.filter(pairs, lambda p: p["key"] == name)
            return F.regexp_replace(F.try_element_at(same, F.lit(-1))["val"], _QUOTES, "")

        return let(pairs, lambda ps: F.struct(*[value(ps, n).alias(n) for n in ("property", "name", "content")]))

    metas = F.filter(tokens, lambda t: F.rlike(t, F.lit(r"(?i)^<meta\b")))
    return F.transform(metas, attributes)


def meta_source(metas: Column, attribute: str, value: str) -> Column:
    """Raw content of the first meta tag whose ``attribute`` is exactly ``value``; NULL if there is none."""
    return F.get(F.filter(metas, lambda m: m[attribute] == value), F.lit(0))["content"]


def readable_texts(sources: list[Column]) -> Column:
    """``array<string>`` of the sources with entities decoded and ends stripped; empty text for NULL."""
    return F.transform(F.array(*sources), lambda t: text_or_empty(strip(unescape_html(t))))
