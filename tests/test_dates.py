"""The date reader on forms that sites use, in sessions of several zones."""

import pytest
from pyspark.sql import functions as F

from pageloom.functions.scalars import iso_date

DATES = [
    ("2024-03-05", "2024-03-05"), ("2024-03-05T10:20:30Z", "2024-03-05T10:20:30.000Z"), ("2024-03-05 10:20:30 UTC", "2024-03-05T10:20:30.000Z"), ("2024-03-05T10:20:30-05:00", "2024-03-05T15:20:30.000Z"), ("2024-03-05T10:20:30.5+0530", "2024-03-05T04:50:30.500Z"),
    ("2024-03-05T10:20", "2024-03-05T10:20:00.000Z"), ("2024-03", "2024-03-01T00:00:00.000Z"), ("2024", "2024-01-01T00:00:00.000Z"), ("2024-03-05T10:20:30.123456789Z", "2024-03-05T10:20:30.123Z"), ("2024-12-31T23:59:59-0100", "2025-01-01T00:59:59.000Z"),
    ("Tue, 05 Mar 2024 10:20:30 +0100", "2024-03-05T09:20:30.000Z"), ("Tue, 05 Mar 2024 10:20:30 GMT", "2024-03-05T10:20:30.000Z"), ("Tue, 5 Mar 2024 10:20:30 EST", "2024-03-05T15:20:30.000Z"), ("05 Mar 24 10:20 PDT", "2024-03-05T17:20:00.000Z"), ("Tuesday, 05-Mar-24 10:20:30 UTC", "2024-03-05T10:20:30.000Z"),
    ("March 5, 2024", "2024-03-05T00:00:00.000Z"), ("Mar 5 2024", "2024-03-05T00:00:00.000Z"), ("5 March 2024", "2024-03-05T00:00:00.000Z"), ("2024 Mar 5", "2024-03-05T00:00:00.000Z"), ("March 5, 2024 1:05 PM", "2024-03-05T13:05:00.000Z"), ("March 5, 2024 12:05 am", "2024-03-05T00:05:00.000Z"),
    ("Mar. 5, 2024", "2024-03-05T00:00:00.000Z"), ("3/5/2024", "2024-03-05T00:00:00.000Z"), ("03/05/24", "2024-03-05T00:00:00.000Z"), ("3/5/99", "1999-03-05T00:00:00.000Z"), ("2024/03/05", "2024-03-05T00:00:00.000Z"), ("3-5-2024", "2024-03-05T00:00:00.000Z"), ("3/5/2024, 4:06:07 PM", "2024-03-05T16:06:07.000Z"),
    ("Tue Mar 05 2024 10:20:30 GMT+0100 (Central European Time)", "2024-03-05T09:20:30.000Z"), ("Tue Mar 5 10:20:30 2024", "2024-03-05T10:20:30.000Z"), ("Tue Mar 5 10:20:30 PST 2024", "2024-03-05T18:20:30.000Z"), ("10:20 March 5 2024", "2024-03-05T10:20:00.000Z"), ("Feb 30 2024", "2024-03-01T00:00:00.000Z"), ("29 Feb 2024", "2024-02-29T00:00:00.000Z"),
    (" 2024-03-05T10:20:30Z ", "2024-03-05T10:20:30.000Z"), ("December 25, 1995 13:30 GMT-02:30", "1995-12-25T16:00:00.000Z"), ("Posted Mar 5, 2024", "2024-03-05T00:00:00.000Z"),
    ("soon", None), ("", None), (None, None), ("13/13/2024", None), ("2024-13-05", "2024-13-05"), ("Mar 45 2024", None), ("5 apples 2024", None), ("March 5, 2024 25:00", None), ("March 5, 2024 13:00 pm", None), ("2024-03-05T99:20:30Z", None), ("1 2 3 4", None), ("9" * 30, None), ("Mar 5", None), ("x" * 10_000, None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_dates(spark, zone):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(DATES)], "i int, d string").coalesce(1)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = {r.i: r.d for r in df.select("i", iso_date(F.col("d")).alias("d")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {DATES[i][0]: d for i, d in got.items() if d != DATES[i][1]} == {}


def test_numbers_are_milliseconds(spark):
    row = spark.sql("SELECT 1709634030123D AS n, 'x' AS d").select(iso_date(F.col("d"), F.col("n"))).first()
    assert row[0] == "2024-03-05T10:20:30.123Z"
