"""Text predicates shared by every operator: strip, word boundaries, keyword matching."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# A "word" character is a letter, a number or the underscore. Spelled out instead of \w, whose meaning
# depends on the JDK and, in its Unicode form, also takes in combining marks and joiners.
WORD_CLASS = r"[\p{L}\p{N}_]"
NON_WORDS = r"[^\p{L}\p{N}_]+"

# Every character Unicode counts as white space, plus the four ASCII separators.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


# Separators inside constants; no keyword, signal or entity contains them.
_GAP, _ASSIGN = "\ue000", "\ue001"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (linear in the text, no regex)."""
    return F.btrim(text, F.lit(WHITESPACE))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def first_non_empty(*texts: Column) -> Column:
    """First argument that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The maximal runs of word characters of ``text``."""
    return F.split(text, NON_WORDS)


def string_array(values: Sequence[str]) -> Column:
    """Constant array. Built from one literal, which the optimizer folds, not from one literal per value."""
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit(_GAP.join(values)), _GAP)


def string_map(table: Mapping[str, str]) -> Column:
    """Constant map, built from one literal in the same way."""
    pairs = _GAP.join(key + _ASSIGN + value for key, value in table.items())
    return F.str_to_map(F.lit(pairs), F.lit(_GAP), F.lit(_ASSIGN))


def is_phrase(keyword: str) -> bool:
    return " " in keyword


def is_plain_word(keyword: str) -> bool:
    """True when the keyword consists of word characters only, so that it equals one whole word."""
    return re.fullmatch(r"\w+", keyword) is not None


def boundary_pattern(keyword: str) -> str:
    """Java pattern for ``keyword`` with a word boundary at both ends.

    A boundary lies between a word and a non-word character, so an end of the keyword that is itself
    punctuation asks for a word character next to it.
    """

    def side(char: str, negative: str, positive: str) -> str:
        return (negative if re.match(r"\w", char) else positive).format(WORD_CLASS)

    literal = re.sub(r"([^\w\s])", r"\\\1", keyword)
    return side(keyword[0], "(?<!{})", "(?<={})") + literal + side(keyword[-1], "(?!{})", "(?={})")


def kw_match(keyword: str, text: Column) -> Column:
    """``keyword`` occurs in ``text`` (already lower case): phrases anywhere, single words as whole words.

    The substring test comes first: it is a plain byte scan, and the regex then runs on hits only.
    """
    if is_phrase(keyword) or not keyword:
        return F.contains(text, F.lit(keyword))
    return F.contains(text, F.lit(keyword)) & F.rlike(text, F.lit(boundary_pattern(keyword)))


def split_keywords(keywords: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """(whole words, phrases, anything else such as hyphenated words), without repeats."""
    unique = list(dict.fromkeys(keywords))
    plain = [k for k in unique if is_plain_word(k)]
    phrases = [k for k in unique if is_phrase(k)]
    return plain, phrases, [k for k in unique if k not in plain and k not in phrases]


def listed_words(keywords: Sequence[str], text: Column) -> Column:
    """The distinct words of ``text`` that are single-word ``keywords``: one set lookup per word."""
    plain = split_keywords(keywords)[0]
    return F.array_distinct(F.filter(words_of(text), lambda w: w.isin(plain))) if plain else string_array([])


#: Up to so many phrases are searched for one by one, which is quicker for few.
FEW_PHRASES = 256


def phrases_in(phrases: Sequence[str], text: Column) -> Column:
    """Array of the distinct ``phrases`` (keywords with a blank) found anywhere in ``text``, however many they are.

    The text is cut at its blanks once. Where a phrase with k blanks lies, it begins with the end of one piece, goes on
    with whole pieces and ends with the beginning of the k-th piece behind it: few ends and beginnings are in the sets of
    first and last pieces of the phrases, and what they make up together is looked up in the set of phrases.
    """
    by_blanks: dict[int, list[str]] = {}
    for phrase in dict.fromkeys(phrases):
        by_blanks.setdefault(phrase.count(" "), []).append(phrase)

    def lengths(parts: set[str]) -> Column:
        return F.array(*[F.lit(n) for n in sorted({len(p) for p in parts})])

    def found(pieces: Column, k: int, listed: list[str]) -> Column:
        firsts, lasts = {p.split(" ")[0] for p in listed}, {p.split(" ")[-1] for p in listed}

        def ends_of(piece: Column, parts: set[str], cut: Callable[[Column, Column], Column]) -> Column:
            fitting = F.filter(lengths(parts), lambda n: n <= F.length(piece))
            return F.filter(F.transform(fitting, lambda n: cut(piece, n)), lambda e: e.isin(list(parts)))

        def at(i: Column) -> Column:
            middle = F.concat(F.lit(" "), F.array_join(F.slice(pieces, i + 2, k - 1), " ")) if k > 1 else F.lit("")
            starts = ends_of(F.get(pieces, i), firsts, F.right)

            def whole(starts: Column) -> Column:
                stops = ends_of(F.get(pieces, i + k), lasts, F.left)
                made = F.transform(
                    starts,
                    lambda a: F.transform(stops, lambda b: F.concat(a, middle, F.lit(" "), b)),
                )
                return F.filter(F.flatten(made), lambda p: p.isin(listed))

            return let(starts, lambda s: F.when(F.size(s) > 0, whole(s)).otherwise(string_array([])))

        places = F.when(F.size(pieces) > k, F.sequence(F.lit(0), F.size(pieces) - 1 - k))
        return F.coalesce(F.flatten(F.transform(places, at)), string_array([]))

    def searched(pieces: Column) -> Column:
        return F.array_distinct(F.concat(*[found(pieces, k, listed) for k, listed in sorted(by_blanks.items())]))

    return let(F.split(text, " "), searched) if by_blanks else string_array([])


def matched_keywords(keywords: Sequence[str], text: Column, words: Column) -> Column:
    """Array of the distinct ``keywords`` found in ``text`` (lower case), whose listed words are ``words``.

    Words are looked up in the list instead of the list being searched for in the text; only phrases and
    hyphenated words scan it. The expression stays small however long the registry is, so it never
    outgrows one JIT method. ``text`` must be a column or a variable: it may be used once per phrase.
    """
    plain, phrases, mixed = split_keywords(keywords)
    parts = []
    if plain:
        parts.append(F.array_distinct(F.filter(words, lambda w: w.isin(plain))))
    if len(phrases) > FEW_PHRASES:
        parts.append(phrases_in(phrases, text))
    elif phrases:
        parts.append(F.filter(string_array(phrases), lambda k: F.contains(text, k)))
    if mixed:
        parts.append(F.array_compact(F.array(*[F.when(kw_match(k, text), F.lit(k)) for k in mixed])))
    return F.concat(*parts) if parts else string_array([])


def any_keyword(keywords: Sequence[str], text: Column, words: Column) -> Column:
    """At least one of ``keywords`` is found in ``text``, whose listed words are ``words``; cheapest test first."""
    plain, phrases, mixed = split_keywords(keywords)
    tests = []
    if plain:
        tests.append(F.exists(words, lambda w: w.isin(plain)))
    if len(phrases) > FEW_PHRASES:
        tests.append(F.size(phrases_in(phrases, text)) > 0)
    elif phrases:
        tests.append(F.exists(string_array(phrases), lambda k: F.contains(text, k)))
    tests += [kw_match(k, text) for k in mixed]
    return F.coalesce(reduce(or_, tests), F.lit(False)) if tests else F.lit(False)
