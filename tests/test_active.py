import pytest
from pyspark.sql import functions as F

from rolesieve.functions.verdict import active_verdict, apply_signal, closed_signal, page_verdict
from rolesieve.operators.active import check_first_n, with_verdict
from rolesieve.registry import APPLY_SIGNALS, CLOSED_SIGNALS
from tests.helpers import apply, tree


def verdicts(spark, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s int, h string")
    got = frame.select("i", active_verdict(F.col("s"), F.col("h")).alias("v")).orderBy("i").collect()
    return [(r.v.status, r.v.reason) for r in got]


def test_status_codes(spark):
    table = {
        404: ("inactive", "HTTP 404"), 410: ("inactive", "HTTP 410"),
        401: ("unknown", "HTTP 401 — page blocked"), 403: ("unknown", "HTTP 403 — page blocked"),
        429: ("unknown", "HTTP 429 — page blocked"), 500: ("unknown", "HTTP 500 server error"),
        503: ("unknown", "HTTP 503 server error"), 200: ("active", "no closed signals found"),
        0: ("unknown", "HTTP 0"), 201: ("unknown", "HTTP 201"), 302: ("unknown", "HTTP 302"),
        400: ("unknown", "HTTP 400"),
    }
    assert verdicts(spark, [(code, "fine") for code in table]) == list(table.values())
    assert verdicts(spark, [(404, "apply now"), (403, CLOSED_SIGNALS[0])]) == [table[404], table[403]]


def test_every_signal(spark):
    got = verdicts(spark, [(200, f"<p>{s.upper()}</p> apply now") for s in CLOSED_SIGNALS])
    # the ninth contains the first, which comes earlier
    reported = [CLOSED_SIGNALS[0] if CLOSED_SIGNALS[0] in s else s for s in CLOSED_SIGNALS]
    assert got == [("inactive", f"closed signal: '{s}'") for s in reported]
    assert verdicts(spark, [(200, s.title()) for s in APPLY_SIGNALS]) == [("active", "apply button detected")] * 5


def test_list_order_decides(spark):
    text = f"{CLOSED_SIGNALS[5]} {CLOSED_SIGNALS[2]}"
    assert apply(spark, closed_signal, [text, "open", ""]) == [CLOSED_SIGNALS[2], None, None]
    assert apply(spark, apply_signal, ["Apply Online", "no"]) == [True, False]


def test_fetch_errors_come_first(spark):
    frame = spark.createDataFrame([(200, "x", "timeout"), (0, "", "refused"), (200, "x", "")], "s int, h string, e string")
    got = frame.select(page_verdict(F.col("s"), F.col("h"), F.col("e")).alias("v")).collect()
    assert [(r.v.status, r.v.reason) for r in got] == [
        ("unknown", "request timed out"), ("unknown", "request failed: refused"), ("active", "no closed signals found"),
    ]


@pytest.mark.parametrize("n", [0, 2, 9])
def test_only_the_first_n_are_checked(spark, n):
    rows = [(30, 404, "", ""), (10, 200, "", ""), (20, 500, "", "")]
    frame = with_verdict(spark.createDataFrame(rows, "seq bigint, status_code int, html string, error string"))
    got = {r.seq: (r.checked, r.active_status, r.active_reason) for r in check_first_n(frame, n).collect()}
    full = {
        10: (True, "active", "no closed signals found"), 20: (True, "unknown", "HTTP 500 server error"),
        30: (True, "inactive", "HTTP 404"),
    }
    assert got == {s: full[s] if i < n else (False, "unknown", "") for i, s in enumerate(sorted(full))}


def test_check_needs_no_window_or_join(spark):
    frame = spark.createDataFrame([(1, 200, "", "")], "seq bigint, status_code int, html string, error string")
    plan = tree(check_first_n(with_verdict(frame), 10))
    assert "TakeOrderedAndProject" in plan and "Window" not in plan and "Join" not in plan
