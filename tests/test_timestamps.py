import datetime as dt
import random
import zoneinfo

import pytest

from quireflow.operators.timestamps import normalize_timestamps

S = "v string, p string, z string"


def moments(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], S + ", i int")
    return [(r["epoch_us"], r["moment_status"]) for r in sorted(normalize_timestamps(df, "v", "p", "z").collect(), key=lambda r: r["i"])]


def us(*a):
    return int(dt.datetime(*a, tzinfo=dt.UTC).timestamp()) * 10**6


CASES = [
    ("03/30/2025 02:28", "date_mdy", "Asia/Tokyo", us(2025, 3, 29, 17, 28), "exact"),
    ("4/3/23 15:10:29", "date_dmy", "UTC", us(2023, 3, 4, 15, 10, 29), "exact"),
    ("20220820T173739", "date_ymd", "UTC", us(2022, 8, 20, 17, 37, 39), "exact"),
    ("2022-11-02 06:19:15.783 EDT", "date_ymd", "America/New_York", us(2022, 11, 2, 10, 19, 15) + 783000, "exact"),
    ("Tue, 12 Nov 2024 23:31:15 +0530", "date_text", "UTC", us(2024, 11, 12, 18, 1, 15), "exact"),
    ("10. November 2022 um 09:18:01 Uhr", "date_text", "UTC", us(2022, 11, 10, 9, 18, 1), "exact"),
    ("le 7 août 2025 à 00h42", "date_text", "UTC", us(2025, 8, 7, 0, 42), "exact"),
    ("2022-12-11 01:15:53[UTC]", "date_ymd", "Asia/Tokyo", us(2022, 12, 11, 1, 15, 53), "exact"),
    ("12:30 AM", "date_mdy", "UTC", None, "invalid"),
    ("12/31/2020 12:30 AM", "date_mdy", "UTC", us(2020, 12, 31, 0, 30), "exact"),
    ("2025-11-02 01:27", "date_ymd", "America/Chicago", None, "ambiguous"),
    ("2025-11-02 01:27 CST", "date_ymd", "America/Chicago", us(2025, 11, 2, 7, 27), "exact"),
    ("2025-03-09 02:30", "date_ymd", "America/Chicago", None, "nonexistent"),
    ("1586045953732", "date_serial", None, 1586045953732000, "exact"),
    ("February 30, 2020", "date_text", "UTC", None, "invalid"),
    ("Q3 2021", "date_text", "UTC", None, "invalid"),
    (None, "date_ymd", "UTC", None, "invalid"),
    ("", "date_ymd", "UTC", None, "invalid"),
    ("2020-01-01", None, "UTC", None, "invalid"),
    ("2020-01-01", "date_ymd", None, None, "unknown_zone"),
    ("2020-01-01", "date_ymd", "No/Where", None, "unknown_zone"),
    ("x" * 100_000, "date_text", "UTC", None, "invalid"),
]


def test_cases(spark):
    assert moments(spark, [c[:3] for c in CASES]) == [c[3:] for c in CASES]


def test_empty_repeated_and_clashing(spark):
    assert moments(spark, []) == []
    df = spark.createDataFrame([("2020-01-01", "date_ymd", "UTC", 1)] * 2, S + ", epoch_us int")
    got = normalize_timestamps(df, "v", "p", "z")
    assert got.columns == ["v", "p", "z", "epoch_us", "moment_status"]
    assert [r["epoch_us"] for r in got.collect()] == [us(2020, 1, 1)] * 2


def test_against_brute_force(spark):
    rng = random.Random(7)
    zones = ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata"]
    cases = [(dt.datetime(1975, 1, 1) + dt.timedelta(seconds=rng.randrange(124 * 365 * 86400)), rng.choice(zones)) for _ in range(3000)]
    cases += [(dt.datetime(1830, 1, 1) + dt.timedelta(seconds=rng.randrange(420 * 365 * 86400)), rng.choice(zones)) for _ in range(1500)]
    for y in (*range(1916, 1946), *range(1975, 2150, 3)):  # all hours around the changes
        cases += [(dt.datetime(y, m, 1) + dt.timedelta(hours=h), z) for m in (3, 4, 10, 11) for h in range(0, 31 * 24, 5) for z in zones[:1]]
    rows = [(d.strftime("%Y-%m-%d %H:%M:%S"), "date_ymd", z) for d, z in cases]
    for (d, z), got in zip(cases, moments(spark, rows)):
        zone = zoneinfo.ZoneInfo(z)
        found = {u for f in (0, 1) if (u := d.replace(tzinfo=zone, fold=f).astimezone(dt.UTC)).astimezone(zone).replace(tzinfo=None) == d}
        assert got == ((int(found.pop().timestamp()) * 10**6, "exact") if len(found) == 1 else (None, "ambiguous" if found else "nonexistent"))
