import datetime as dt

from rolesieve.functions.dates import freshness_bucket, parse_iso_date
from tests.helpers import apply


def test_calendar_forms(spark):
    texts = [
        "2024-06-01", "20240601", "2024-06-01T09:00:00", "2024-06-01T09:00:00Z", " 2024-06-01 09:30 ",
        "2024-06-01T23:30:00-11:00", "2024-06-01T093015,5", "2024-06-01T09",
    ]
    assert apply(spark, parse_iso_date, texts) == [dt.date(2024, 6, 1)] * len(texts)


def test_week_forms_equal_python(spark):
    texts = [f"{y}-W{w:02d}-{d}" for y in (2015, 2020, 2021, 2024) for w in (1, 9, 52, 53) for d in (1, 7)]
    texts += ["2024W01", "2024-W10"]

    def expected(text):
        try:
            return dt.datetime.fromisoformat(text).date()
        except ValueError:
            return None

    assert apply(spark, parse_iso_date, texts) == [expected(t) for t in texts]


def test_every_day_of_two_years(spark):
    days = [dt.date(2023, 12, 25) + dt.timedelta(days=i) for i in range(750)]
    assert apply(spark, parse_iso_date, [d.isoformat() for d in days]) == days


def test_rejected(spark):
    texts = [
        None, "", "two weeks ago", "2024", "2024-06", "2024-6-1", "2024-02-30", "2024-13-01", "0000-01-01",
        "2024-06-01Tgarbage", "2024-06-01T24:00", "2024-W54-1", "2021-W53", "2024-06-01T09:00:00+25:00", "1/2/2024",
    ]
    assert apply(spark, parse_iso_date, texts) == [None] * len(texts)


def test_freshness(spark):
    days = [None, -3, 0, 1, 2, 7, 8, 30, 31, 365, 366]
    expected = [None, "pd", "pd", "pd", "pw", "pw", "pm", "pm", "py", "py", None]
    assert apply(spark, freshness_bucket, days, "int") == expected
