"""Is a posting still open? Verdicts from a status code and a page body."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesieve.functions.text import let, string_array, text_or_empty
from rolesieve.registry import APPLY_SIGNALS, CLOSED_SIGNALS, GONE_CODES, REFUSED_CODES


def first_contained(signals: Sequence[str], text: Column) -> Column:
    """First of ``signals``, in list order, that is a substring of ``text``; NULL if none is."""
    result = F.when(F.contains(text, F.lit(signals[0])), F.lit(signals[0]))
    for signal in signals[1:]:
        result = result.when(F.contains(text, F.lit(signal)), F.lit(signal))
    return result


def closed_signal(html: Column, signals: Sequence[str] = tuple(CLOSED_SIGNALS)) -> Column:
    """The closed signal that decides, or NULL."""
    return let(F.lower(html), lambda text: first_contained(signals, text))


def apply_signal(html: Column, signals: Sequence[str] = tuple(APPLY_SIGNALS)) -> Column:
    """TRUE if the page offers a way to apply."""
    return let(F.lower(html), lambda text: F.exists(string_array(signals), lambda s: F.contains(text, s)))


def _result(status: str, reason: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), reason.alias("reason"))


def active_verdict(
    status_code: Column,
    html: Column,
    closed: Sequence[str] = tuple(CLOSED_SIGNALS),
    apply: Sequence[str] = tuple(APPLY_SIGNALS),
) -> Column:
    """``struct(status, reason)``; the body is lower-cased once and only for status 200."""
    status_code = F.coalesce(status_code, F.lit(0))
    code = F.concat(F.lit("HTTP "), status_code.cast("string"))

    def from_body(text: Column) -> Column:
        signal = first_contained(closed, text)
        offers = F.exists(string_array(apply), lambda s: F.contains(text, s))
        return let(
            signal,
            lambda s: F.when(
                s.isNotNull(), _result("inactive", F.concat(F.lit("closed signal: '"), s, F.lit("'")))
            )
            .when(offers, _result("active", F.lit("apply button detected")))
            .otherwise(_result("active", F.lit("no closed signals found"))),
        )

    return (
        F.when(status_code.isin(GONE_CODES), _result("inactive", code))
        .when(status_code.isin(REFUSED_CODES), _result("unknown", F.concat(code, F.lit(" — page blocked"))))
        .when(status_code >= 500, _result("unknown", F.concat(code, F.lit(" server error"))))
        .when(status_code == 200, let(F.lower(text_or_empty(html)), from_body))
        .otherwise(_result("unknown", code))
    )


def fetch_error_verdict(error: Column) -> Column:
    """``struct(status, reason)`` for a fetch that gave no response; NULL when there was no error."""
    return F.when(error == "timeout", _result("unknown", F.lit("request timed out"))).when(
        error != "", _result("unknown", F.concat(F.lit("request failed: "), error))
    )


def page_verdict(status_code: Column, html: Column, error: Column) -> Column:
    """Verdict on a crawl row: the fetch error if there was one, else the response."""
    return F.coalesce(fetch_error_verdict(error), active_verdict(status_code, html))
