"""Normalising mixed timestamp texts to one UTC moment.

Texts are parsed by Catalyst expressions into a local civil time and an optional stated zone. Local times are then
looked up in exploded zone-offset intervals: the intervals of a zone, one row per local year they touch, in local
time. Two matching intervals mean that the local time is ambiguous, none that it does not exist, one gives the offset.
The intervals are made for the zones and years that occur in the data, in the workers.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions.let import let
from quireflow.session import written

#: Month names and abbreviations by language (en, de, fr, es, pt), in order of the months.
MONTH_NAMES = {
    1: "january jan januar jänner janvier janv enero ene janeiro",
    2: "february feb februar février févr fevrier febrero fevereiro fev",
    3: "march mar märz mär mars marzo março",
    4: "april apr avril avr abril abr",
    5: "may mai mayo maio",
    6: "june jun juni juin junio junho",
    7: "july jul juli juillet juil julio julho",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setembro set",
    10: "october oct oktober okt octobre octubre outubro out",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember dez décembre décembre dic diciembre dezembro",
}
_MONTH = {w: m for m, names in MONTH_NAMES.items() for w in names.split()}
_WORD = "([A-Za-zÀ-ÿ]+)"
_TAIL = (
    r"(?:(?:[T ,]| um | à |, )\s*(\d{1,2})[:h]?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?"
    r"\s*(AM|PM|am|pm|[aApP]\.[mM]\.)?(?:\s*Uhr)?)?"
    r"\s*(Z|[A-Z]{2,5}|[+-]\d{2}(?::?\d{2})?|\[[A-Za-z][A-Za-z0-9_/+\-]*\]|[A-Za-z]+/[A-Za-z0-9_/+\-]+)?$"
)
_GROUPS = 9  # y m d H M S fraction half zone
_SEP = "\u0001"


def _fields(text: Column, head: str, order: tuple[int, int, int]) -> Column:
    """The nine fields of one layout as an array, null where the layout doesn't fit; one regular expression pass."""
    at = [*order, 4, 5, 6, 7, 8, 9]
    parts = F.split(F.regexp_replace(text, head + _TAIL, _SEP.join(f"${i}" for i in at)), _SEP, -1)
    return F.when(F.size(parts) == _GROUPS, parts)


def _int(c: Column) -> Column:
    return c.try_cast("long")


def _civil_days(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 to a proleptic Gregorian date."""
    y2 = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y2 / 400)
    of_era = y2 - era * 400
    day = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + day - 719468


def _month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def parsed(value: Column, layout: Column) -> Column:
    """struct<local_us, offset_us, zone, abbr> of a date text; local_us is null where the text names no moment.

    layout is one of date_mdy, date_dmy, date_ymd, date_text, date_serial (other or null layouts give null).
    offset_us is set for a stated offset (and for serial numbers, UTC and GMT), zone for a stated IANA name,
    abbr for a zone abbreviation.
    """
    trimmed = F.trim(F.regexp_replace(value, r"[\s\u00a0]+", " "))
    return let(trimmed, lambda text: F.when(layout == "date_serial", _serial(text)).otherwise(let(_found(text, layout), _moment)))


def _found(text: Column, layout: Column) -> Column:
    numeric = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})"
    lead = r"^(?:[A-Za-zÀ-ÿ]{2,10}\.?, ?|le )?"
    day_first = _fields(text, lead + r"(\d{1,2})(?:\.|st|nd|rd|th|er|º)?[ \-](?:de |do )?" + _WORD + r"\.?,?[ \-](?:de |del )?(\d{4})", (3, 2, 1))
    month_first = _fields(text, lead + _WORD + r"\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})", (3, 1, 2))
    dashed, packed = _fields(text, r"^(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})", (1, 2, 3)), _fields(text, r"^(\d{4})(\d{2})(\d{2})", (1, 2, 3))
    return (
        F.when(layout == "date_mdy", _fields(text, numeric, (3, 1, 2)))
        .when(layout == "date_dmy", _fields(text, numeric, (3, 2, 1)))
        .when(layout == "date_ymd", F.coalesce(dashed, packed))
        .when(layout == "date_text", F.coalesce(day_first, month_first))
    )


def _result(local_us: Column, offset_us: Column, zone: Column, abbr: Column) -> Column:
    return F.struct(local_us.alias("local_us"), offset_us.cast("long").alias("offset_us"), zone.alias("zone"), abbr.alias("abbr"))


def _serial(text: Column) -> Column:
    n, size, no = F.when(text.rlike(r"^\d{1,19}$"), _int(text)), F.length(text), F.lit(None).cast("string")
    us = F.when(size <= 11, n * 1_000_000).when(size <= 14, n * 1000).when(size <= 17, n).otherwise(F.floor(n / 1000))
    return _result(us, F.lit(0), no, no)


def _moment(f: Column) -> Column:
    month = F.create_map(*[F.lit(x) for kv in _MONTH.items() for x in kv])
    year = F.when(F.length(f[0]) == 2, _int(f[0]) + 2000).otherwise(_int(f[0]))
    numbers = F.struct(
        year.alias("y"), F.coalesce(_int(f[1]), F.try_element_at(month, F.lower(f[1])).cast("long")).alias("m"), _int(f[2]).alias("d"),
        F.coalesce(_int(f[3]), F.lit(0)).alias("h"), F.coalesce(_int(f[4]), F.lit(0)).alias("mi"), F.coalesce(_int(f[5]), F.lit(0)).alias("s"),
        F.coalesce(_int(F.substring(F.rpad(f[6], 6, "0"), 1, 6)), F.lit(0)).alias("us"), F.lower(F.substring(f[7], 1, 1)).alias("half"),
    )
    return let(numbers, lambda n: _with_zone(n, f[8]))


def _with_zone(n: Column, zone: Column) -> Column:
    y, m, d, h, half = n["y"], n["m"], n["d"], n["h"], n["half"]
    hour = F.when(half == "p", F.when(h == 12, 12).otherwise(h + 12)).when((half == "a") & (h == 12), 0).otherwise(h)
    good = (
        m.between(1, 12) & (d >= 1) & (d <= _month_length(y, m)) & (y >= 1) & (hour <= 23) & (n["mi"] <= 59) & (n["s"] <= 59)
        & F.when(half.isin("a", "p"), h.between(1, 12)).otherwise(True)
    )
    us = (((_civil_days(y, m, d) * 24 + hour) * 60 + n["mi"]) * 60 + n["s"]) * 1_000_000 + n["us"]
    digits = F.rpad(F.regexp_replace(zone, "[^0-9]", ""), 4, "0")
    minutes = _int(F.substring(digits, 1, 2)) * 60 + _int(F.substring(digits, 3, 2))
    bare = F.regexp_replace(zone, r"[\[\]]", "")
    signed, utc = zone.rlike(r"^[+-]"), bare.isin("Z", "UTC", "GMT")
    named = ~utc & zone.rlike(r"[\[/]")
    offset = F.when(signed, F.when(zone.startswith("-"), -minutes).otherwise(minutes) * 60_000_000).when(utc, F.lit(0).cast("long"))
    abbr = F.when((zone != "") & ~signed & ~named & ~utc, zone)
    return _result(F.when(good, us), offset, F.when(named, bare), abbr)


#: Seconds between the probes for changes of the offset; two changes closer than this are not told apart.
_STEP = 5 * 86400
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


def offset_intervals(name: str, year: int) -> list[dict] | None:
    """The offset intervals of a zone, in local time, that touch a local year of 1 to 9999; None for an unknown zone."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None

    def at(t: int) -> tuple[int, str]:
        x = (_EPOCH + dt.timedelta(seconds=t)).astimezone(zone)
        return int(x.utcoffset().total_seconds()), x.tzname()

    whole = lambda *a: int((dt.datetime(*a, tzinfo=dt.UTC) - _EPOCH).total_seconds())
    first = whole(year, 1, 1) - 2 * 86400 if year > 1 else whole(1, 1, 3)
    last = whole(year, 12, 31) + 3 * 86400 if year < 9999 else whole(9999, 12, 29)
    cuts, t, now = [], first, at(first)
    while t < last:
        step = min(t + _STEP, last)
        then = at(step)
        if then != now:
            lo, hi = t, step
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if at(mid) == now else (lo, mid)
            cuts.append(hi)
            step, then = hi, at(hi)
        t, now = step, then
    edges = [first - 366 * 86400, *cuts, last + 366 * 86400]
    out = []
    for a, b in zip(edges, edges[1:]):
        offset, abbr = at(max(a, first))
        out.append({"lo_us": (a + offset) * 10**6, "hi_us": (b + offset) * 10**6, "offset_us": offset * 10**6, "abbr": abbr})
    return out


def zone_intervals(zone_years: DataFrame) -> DataFrame:
    """One row per zone and local year of (zone, year), with the array of its intervals; unknown zones are left out."""

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(z, y, s) for z, y in zip(b["zone"], b["year"]) if (s := offset_intervals(z, int(y))) is not None]
            yield pd.DataFrame(rows, columns=["zone", "year", "spans"])

    return zone_years.mapInPandas(spans, "zone string, year bigint, spans array<struct<lo_us:bigint,hi_us:bigint,offset_us:bigint,abbr:string>>")


def normalize_timestamps(df: DataFrame, value: str, layout: str, zone: str) -> DataFrame:
    """Adds epoch_us (bigint) and moment_status to every row of df.

    moment_status: exact (epoch_us is set), ambiguous (the local time occurs twice), nonexistent (it is skipped),
    unknown_zone (no usable zone) or invalid (the value is null, empty or names no day). Rows are never dropped or
    repeated; repeated rows give repeated results. Columns of df named epoch_us or moment_status are replaced, all
    others are kept. Years from 1 to 9999 are known; before a zone's standard time its local mean time holds. As many
    intervals are made as zones and years occur, a number that does not grow with the rows.
    """
    keep = [c for c in df.columns if c.lower() not in ("epoch_us", "moment_status")]
    p = "__qf_p"
    q = df.select(*[df[c] for c in keep], parsed(df[value], df[layout]).alias(p))
    year = F.year(F.timestamp_micros(F.col(f"{p}.local_us"))).cast("long")
    q = q.withColumn("__qf_z", F.when(F.col(f"{p}.offset_us").isNull() & F.col(f"{p}.local_us").isNotNull(), F.coalesce(F.col(f"{p}.zone"), F.col(zone))))
    q = written(q.withColumn("__qf_y", F.when(F.col("__qf_z").isNotNull(), year)), "parsed-times")
    occur = q.filter("__qf_y between 1 and 9999").select(F.col("__qf_z").alias("zone"), F.col("__qf_y").alias("year")).distinct()
    spans = written(zone_intervals(occur), "zone-intervals").select(F.col("zone").alias("__qf_zone"), F.col("year").alias("__qf_year"), F.col("spans").alias("__qf_spans"))
    q = q.join(spans, (F.col("__qf_z") == F.col("__qf_zone")) & (F.col("__qf_y") == F.col("__qf_year")), "left")
    local, abbr = F.col(f"{p}.local_us"), F.col(f"{p}.abbr")

    def offsets(spans: Column) -> Column:
        hits = F.filter(spans, lambda s: (s["lo_us"] <= local) & (local < s["hi_us"]) & (abbr.isNull() | (s["abbr"] == abbr)))
        stated = F.filter(spans, lambda s: s["abbr"] == abbr)
        return F.array_distinct(F.transform(F.when((F.size(hits) == 0) & abbr.isNotNull(), stated).otherwise(hits), lambda s: s["offset_us"]))

    none = F.array().cast("array<bigint>")
    known = F.col(f"{p}.offset_us").isNotNull()
    found = F.when(known, F.array(f"{p}.offset_us")).otherwise(F.coalesce(let(F.col("__qf_spans"), offsets), none))
    no_zone = ~known & (F.col("__qf_z").isNull() | F.col("__qf_spans").isNull())

    def outcome(offs: Column) -> Column:
        status = (
            F.when(local.isNull(), "invalid").when(no_zone, "unknown_zone")
            .when(F.size(offs) == 1, "exact").when(F.size(offs) > 1, "ambiguous").otherwise("nonexistent")
        )
        return F.struct(status.alias("status"), F.when(local.isNotNull() & (F.size(offs) == 1), local - F.try_element_at(offs, F.lit(1))).alias("us"))

    q = q.withColumn("__qf_o", let(found, outcome))
    epoch, status = F.col("__qf_o.us"), F.col("__qf_o.status")
    return q.select(*keep, epoch.cast("long").alias("epoch_us"), status.alias("moment_status"))
