"""JSON-LD: parsing blocks, finding the job posting in them, reading its fields.

Everything here is a row-local expression over VARIANT values. A page is searched where it lies; no step
explodes it into rows or shuffles it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesieve.functions.dates import parse_iso_date
from rolesieve.functions.text import let, strip, text_or_empty
from rolesieve.registry import (
    HOME_COUNTRY_NAMES,
    JOB_POSTING_TYPE,
    REMOTE_LOCATION_TYPE,
    TYPE_PREFIXES,
)

# Appended as a second array item when parsing, so that text after the first value is noticed.
_GUARD = "end-of-block-5d1c"
_NO_NODES = "cast(array() as array<struct<v: variant, hit: boolean>>)"


def _at(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _items(value: Column) -> Column:
    """Elements of a JSON list; NULL for any other value."""
    return _at(value, "$", "array<variant>")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_string(value: Column) -> Column:
    """Cheap for scalars; ask ``_is_object`` first where an object is likely, its schema takes long to print."""
    return F.coalesce(_kind(value) == "STRING", F.lit(False))


def _is_object(value: Column) -> Column:
    """Only objects become a struct, whatever their fields; of this one no value is copied."""
    return _at(value, "$", "struct<`@`: boolean>").isNotNull()


# What the numbers that JSON does not have read as; the scan for them writes strings.
_NOT_JSON = {"-Infinity": "-inf", "Infinity": "inf", "NaN": "nan"}
# Stand for an escaped backslash and an escaped quote while a text is cut at its quotes.
_BACKSLASH, _QUOTE = "\ue002", "\ue003"


def _plain_numbers(raw: Column) -> Column:
    """``raw`` with bare NaN, Infinity and -Infinity as strings. Cut at its quotes, every second piece is a string."""
    masked = F.replace(F.replace(raw, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))

    def outside(piece: Column) -> Column:
        for name, text in _NOT_JSON.items():
            piece = F.regexp_replace(piece, rf"(?<![\w.+-]){name}(?![\w.])", f'"{text}"')
        return piece

    pieces = F.transform(F.split(masked, '"'), lambda piece, i: F.when(i % 2 == 0, outside(piece)).otherwise(piece))
    joined = F.array_join(pieces, '"')
    return F.replace(F.replace(joined, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def jsonld_parse(raw: Column) -> Column:
    """VARIANT of ``raw``; NULL unless the whole text is exactly one JSON value. NaN and infinities are accepted and read
    as the texts ``nan``, ``inf`` and ``-inf``.

    Spark's parser stops after the first value and lets anything follow it. Parsing the text as the first
    of two list items makes such a rest an error or changes the number of items.
    """
    odd = F.contains(raw, F.lit("NaN")) | F.contains(raw, F.lit("Infinity"))
    text = F.when(odd, _plain_numbers(raw)).otherwise(raw)
    pair = _items(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_GUARD}"]'))))
    return let(
        pair,
        lambda p: F.when(
            (F.size(p) == 2) & (_at(F.get(p, F.lit(1)), "$", "string") == _GUARD), F.get(p, F.lit(0))
        ),
    )


def is_job_posting_type(type_value: Column) -> Column:
    """``@type`` names a job posting: a string or a list with one at any depth, with at most one schema.org prefix."""
    accepted = [prefix + JOB_POSTING_TYPE for prefix in ["", *TYPE_PREFIXES]]

    def named(names: Column) -> Column:
        return F.exists(names, lambda name: name.isin(accepted))

    listed = _items(type_value)

    def opened(items: Column, _: Column) -> Column:
        return F.flatten(F.transform(items, lambda item: F.coalesce(_items(item), F.array(item))))

    # each bracket but the first opens one list at most
    spare = F.array_repeat(F.lit(0), _open_brackets(F.to_json(type_value)) - 1)
    flat = F.aggregate(spare, listed, opened)
    deep = F.exists(flat, lambda item: _is_string(item) & _at(item, "$", "string").isin(accepted))
    names = F.coalesce(_at(type_value, "$", "array<string>"), F.array(_at(type_value, "$", "string")))
    inner = F.exists(listed, lambda item: _items(item).isNotNull())
    # nearly all types are strings; the text of a list or object is none of the accepted ones
    plain = _at(type_value, "$", "string").isin(accepted)
    return F.coalesce(F.when(plain, F.lit(True)).when(inner, deep).otherwise(named(names)), F.lit(False))


def _children(value: Column) -> Column:
    """What the search looks at below ``value``: list items, or the ``@graph`` list of an object."""
    return F.coalesce(_items(value), _at(value, "$['@graph']", "array<variant>"))


def _node(value: Column) -> Column:
    hit = let(_at(value, "$['@type']", "variant"), is_job_posting_type)
    return F.struct(value.alias("v"), hit.alias("hit"))


def _relevant(values: Column) -> Column:
    """Job postings and values with something below them; the rest cannot lead to a result."""
    return F.filter(F.transform(values, _node), lambda n: n["hit"] | _children(n["v"]).isNotNull())


def _expand(nodes: Column) -> Column:
    """Replace every container by its relevant children, keeping the depth-first order."""
    return F.flatten(
        F.transform(
            nodes,
            lambda n: F.when(n["hit"], F.array(n)).otherwise(
                F.coalesce(_relevant(_children(n["v"])), F.expr(_NO_NODES))
            ),
        )
    )


def _search(roots: Column, steps: Column, settled) -> Column:
    """Expand ``roots`` level by level until ``settled``.

    Each level enters at least one list, so the number of opening brackets in the text bounds the levels
    whatever the nesting: no depth limit is needed, and settled rows pass through the spare steps untouched.
    """
    return F.aggregate(
        F.array_repeat(F.lit(0), steps),
        F.coalesce(_relevant(roots), F.expr(_NO_NODES)),
        lambda nodes, _: F.when(settled(nodes), nodes).otherwise(_expand(nodes)),
    )


def _open_brackets(raw: Column) -> Column:
    # a bracket is one byte, and bytes need no counting
    return F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit("["), F.lit("")))


def job_postings_in(raw: Column) -> Column:
    """All job postings in one block in depth-first order, as ``array<struct<v, hit>>``."""
    return _search(
        F.array(jsonld_parse(raw)),
        _open_brackets(raw),
        lambda nodes: ~F.exists(nodes, lambda n: ~n["hit"]),
    )


def first_job_posting_in(blocks: Column) -> Column:
    """First job posting (VARIANT) over the ``array<string>`` blocks of a page; NULL if there is none."""
    total = F.aggregate(blocks, F.lit(0), lambda n, raw: n + _open_brackets(raw))

    def found(nodes: Column) -> Column:
        return (F.size(nodes) == 0) | F.coalesce(F.get(nodes, F.lit(0))["hit"], F.lit(True))

    return F.get(_search(F.transform(blocks, jsonld_parse), total, found), F.lit(0))["v"]


# -- fields --------------------------------------------------------------------------------------------


def _shown(text: Column, value: Column, path: str) -> Column:
    """The text of the value at ``path``, stripped. Its kind is asked only where the text is that of a boolean."""
    # a null in front of "and" would have the kind asked too
    boolean = F.coalesce(text.isin("true", "false"), F.lit(False)) & (_kind(_at(value, path, "variant")) == "BOOLEAN")
    return text_or_empty(strip(F.when(boolean, F.initcap(text)).otherwise(text)))


def field_text(value: Column, path: str = "$") -> Column:
    """Stripped text of the value at ``path``; empty when absent or null. Booleans read True / False."""
    return let(_at(value, path, "string"), lambda text: _shown(text, value, path))


def _field_texts(value: Column, names: list[str], body: Callable[[dict[str, Column]], Column]) -> Column:
    """``body`` of the ``field_text`` of each name; the object is read once for all of them."""
    parts = _at(value, "$", f"struct<{', '.join(f'{n}: string' for n in names)}>")
    texts = let(parts, lambda p: F.struct(*[_shown(p[n], value, f"$.{n}").alias(n) for n in names]))
    return let(texts, lambda t: body({n: t[n] for n in names}))


def parse_company(posting: Column) -> Column:
    return let(_at(posting, "$.hiringOrganization", "variant"), _company)


def _company(org: Column) -> Column:
    return (
        F.when(_is_object(org), field_text(org, "$.name")).when(_is_string(org), field_text(org)).otherwise("")
    )


def parse_location(posting: Column) -> Column:
    """``Remote``, or the place as free text or as "locality, region, country"."""
    return _location(field_text(posting, "$.jobLocationType"), _at(posting, "$.jobLocation", "variant"))


def _location(location_type: Column, location: Column) -> Column:
    def place(value: Column) -> Column:
        return let(_items(value), lambda items: F.when(items.isNotNull(), F.get(items, F.lit(0))).otherwise(value))

    def address_text(t: dict[str, Column]) -> Column:
        locality = F.nullif(t["addressLocality"], F.lit(""))
        region = F.nullif(t["addressRegion"], F.lit(""))
        country = F.nullif(t["addressCountry"], F.lit(""))
        alone = locality.isNull() & region.isNull()
        shown = F.when(alone | ~country.isin(HOME_COUNTRY_NAMES), country)
        return F.concat_ws(", ", locality, region, shown)

    def place_text(value: Column) -> Column:
        names = ["addressLocality", "addressRegion", "addressCountry"]
        return let(
            _at(value, "$.address", "variant"),
            lambda address: F.when(_is_object(address), _field_texts(address, names, address_text))
            .when(address.isNotNull(), F.when(_is_string(address), field_text(address)))
            .when(_is_string(value), field_text(value)),
        )

    remote = F.upper(location_type) == REMOTE_LOCATION_TYPE
    found = let(location, lambda value: let(place(value), place_text))
    return F.when(remote, F.lit("Remote")).otherwise(text_or_empty(found))


def parse_date(value: Column) -> Column:
    """``struct(date, confidence)`` of a ``datePosted`` value; only strings are read."""
    day = F.when(_is_string(value), parse_iso_date(_at(value, "$", "string")))
    return let(
        day,
        lambda d: F.struct(
            d.alias("date"), F.when(d.isNull(), F.lit("unknown")).otherwise(F.lit("exact")).alias("confidence")
        ),
    )


def parse_apply_url(posting: Column, source_url: Column) -> Column:
    """The posting's own URL when it is not just the page it was found on."""
    return let(field_text(posting, "$.url"), lambda url: _apply_url(url, source_url))


def _apply_url(url: Column, source_url: Column) -> Column:
    def bare(url: Column) -> Column:
        return F.rtrim(url, F.lit("/"))

    return F.when((url != "") & (bare(url) != bare(text_or_empty(source_url))), url)


def parse_employment_type(posting: Column) -> Column:
    return field_text(posting, "$.employmentType")


def posting_fields(posting: Column, source_url: Column) -> Column:
    """Struct of all fields of a posting, NULL where there is none.

    Each has the value of its own function above, but the posting is read once: taking a field out of a VARIANT
    copies it, and a VARIANT column is copied as a whole by each expression that reads it.
    """
    texts = ["title", "description", "employmentType", "url", "jobLocationType"]
    parts = [f"{n}: string" for n in texts] + [f"{n}: variant" for n in ("hiringOrganization", "jobLocation", "datePosted")]

    def fields(value: Column, part: Column) -> Column:
        text = {n: _shown(part[n], value, f"$.{n}") for n in texts}
        return F.struct(
            text["title"].alias("title"),
            let(part["hiringOrganization"], _company).alias("company"),
            _location(text["jobLocationType"], part["jobLocation"]).alias("location"),
            text["description"].alias("description"),
            let(part["datePosted"], parse_date).alias("_date"),
            let(text["url"], lambda url: _apply_url(url, source_url)).alias("apply_url"),
            text["employmentType"].alias("employment_type"),
        )

    def of(value: Column) -> Column:
        return F.when(value.isNotNull(), let(_at(value, "$", f"struct<{', '.join(parts)}>"), lambda p: fields(value, p)))

    return let(posting, of)
