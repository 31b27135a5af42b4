from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logloom.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(
    "size, text",
    [
        (0, "0 B"), (1, "1.00 B"), (1023, "1023.00 B"), (1024, "1.00 KB"), (1536, "1.50 KB"),
        (1024**2, "1.00 MB"), (1024**3 * 5, "5.00 GB"), (1024**5, "1024.00 TB"),
    ],
)
def test_format_bytes(spark, size, text):
    assert one(spark, S.format_bytes(F.lit(size))) == text


def test_parse_timestamp(spark):
    def millis(text):
        return one(spark, F.unix_millis(S.parse_timestamp(F.lit(text))))

    assert millis("1704067200123") == 1704067200123
    assert millis("2024-01-01") == 1704067200000
    assert millis("2024-01-01T00:00:00.123Z") == 1704067200123
    assert millis("2024-01-01T01:30:00+01:30") == 1704067200000
    assert millis("2024-01-01T05") == 1704067200000 + 5 * 3600_000
    assert millis("yesterday") is None
    assert millis("") is None


def test_date_bounds():
    utc = timezone.utc
    assert S.date_bounds("2024-01-05") == (
        datetime(2024, 1, 5, tzinfo=utc), datetime(2024, 1, 6, tzinfo=utc)
    )
    assert S.date_bounds("2024-01-05T10:30")[1] == datetime(2024, 1, 5, 10, 31, tzinfo=utc)
    low, after = S.date_bounds("2024-01-05T10:30:00.5+02:00")
    assert low == datetime(2024, 1, 5, 8, 30, 0, 500_000, utc)
    assert (after - low).total_seconds() == 0.001
    assert S.date_bounds(1704067200000)[0] == datetime(2024, 1, 1, tzinfo=utc)
    with pytest.raises(ValueError):
        S.date_bounds("soon")


def test_interval_millis():
    assert [S.interval_millis(x) for x in ("250ms", "2s", "3m", "1h", "1d", "1w")] == [
        250, 2000, 180_000, 3_600_000, 86_400_000, 604_800_000
    ]
    for bad in ("1y", "h", "0h", "1.5h"):
        with pytest.raises(ValueError):
            S.interval_millis(bad)


def test_table_name(spark):
    name = S.table_name("logs", F.lit("a b/ü"), F.lit("2024-01-01"))
    assert one(spark, name) == "logs-a-b---2024-01-01"


@pytest.mark.parametrize(
    "ip, good",
    [
        ("10.0.0.1", True), ("255.255.255.255", True), ("256.1.1.1", False), ("1.2.3", False),
        ("1.2.3.4.", False), ("::1", True), ("2001:db8::ff00:42:8329", True), ("1::2::3", False),
        ("x", False),
    ],
)
def test_valid_ip(spark, ip, good):
    assert one(spark, S.valid_ip(F.lit(ip))) is good


def test_keyword(spark):
    assert one(spark, S.keyword(F.lit("x" * 256))) == "x" * 256
    assert one(spark, S.keyword(F.lit("x" * 257))) is None
