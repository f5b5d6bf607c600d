"""Timestamps in many spellings to one instant.

All accepted spellings are branches of ONE regular expression with named groups. It is applied once per value
(`regexp_replace` writes every group into one delimited string); calendar ranges are checked on the parts, the
local instant is assembled with integer day arithmetic, and only then is a zone applied. Everything stays in JVM
expressions, so the plan is one projection.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: zone abbreviations and their offsets in minutes
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "TRT": 180, "IST": 330, "NPT": 345, "JST": 540, "KST": 540,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_TIME = r"(?<h{n}>\d{{1,2}}):(?<mi{n}>\d{{2}})(?::(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d{{1,12}}))?)?"
_ZONE = r"\s*(?:(?<off{n}>[+-]\d{{2}}:?\d{{2}}|[+-]\d{{2}})|\[?(?<reg{n}>[a-z]+(?:/[a-z0-9_+-]+)+)\]?|(?<abb{n}>[a-z]{{1,5}}))?"
_HALF = r"(?:\s*(?<ap{n}>[ap])\.?m(?![a-z])\.?)?"


def _branch(n: str, date: str) -> str:
    return date + _TIME.format(n=n) + _HALF.format(n=n) + _ZONE.format(n=n)


#: Group names that each branch fills; the branch letter is the suffix.
_BRANCHES = {
    "a": _branch("a", r"(?<ya>\d{4})-(?<moa>\d{1,2})-(?<da>\d{1,2})(?:\s*t\s*|\s+)"),
    "b": _branch("b", r"(?<p1b>\d{1,2})/(?<p2b>\d{1,2})/(?<yb>\d{4})(?:,?\s+|t)"),
    "c": _branch("c", r"(?<dc>\d{1,2})\.(?<moc>\d{1,2})\.(?<yc>\d{4})(?:,?\s+|t)"),
    "d": _branch("d", r"(?:[a-z]{3,9},?\s+)?(?<dd>\d{1,2})[ -](?<mnd>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ -](?<yd>\d{4}),?\s+"),
    "e": r"(?<ye>\d{4})(?<moe>\d{2})(?<de>\d{2})t(?<he>\d{2})(?<mie>\d{2})(?<se>\d{2})(?:[.,](?<fe>\d{1,12}))?" + _ZONE.format(n="e"),
    "g": r"(?<num>[+-]?\d{1,20})(?:\.(?<frac>\d*))?",
}
PATTERN = "(?i)^(?:" + "|".join(_BRANCHES.values()) + ")$"
_SEP = "\u0001"
#: Part -> the groups that hold it, at most one of which is filled.
_PARTS = {
    "y": ["ya", "yb", "yc", "yd", "ye"], "mo": ["moa", "moc", "moe"], "mon": ["mnd"], "d": ["da", "dc", "dd", "de"], "p1": ["p1b"], "p2": ["p2b"],
    "h": ["ha", "hb", "hc", "hd", "he"], "mi": ["mia", "mib", "mic", "mid", "mie"], "s": ["sa", "sb", "sc", "sd", "se"], "f": ["fa", "fb", "fc", "fd", "fe"],
    "ap": ["apa", "apb", "apc", "apd"], "off": ["offa", "offb", "offc", "offd", "offe"], "reg": ["rega", "regb", "regc", "regd", "rege"],
    "abb": ["abba", "abbb", "abbc", "abbd", "abbe"], "num": ["num"], "frac": ["frac"],
}
_REPLACEMENT = _SEP.join("".join("${%s}" % g for g in groups) for groups in _PARTS.values())


def trimmed(text: Column) -> Column:
    """Without white space, control and zero-width characters at either end."""
    return F.regexp_replace(text, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", "")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in whole numbers (years from 0 on)."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.lit(153) * F.when(m > 2, m - 3).otherwise(m + 9) + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def _month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def _zone_ids() -> list[str]:
    return sorted(z for z in zoneinfo.available_timezones() if not z.startswith(("posix/", "right/")) and z not in ("localtime", "Factory"))


def _floor_div(value: Column, by: int) -> Column:
    """Exact integer division towards minus infinity (a double would lose the last digits of nanoseconds)."""
    return F.call_function("div", value - F.pmod(value, F.lit(by).cast("long")), F.lit(by).cast("long"))


def micros_of_number(num: Column, frac: Column) -> Column:
    """A bare epoch number; its size tells the unit (seconds, milliseconds, microseconds, nanoseconds). Zero is none."""
    digits = F.length(F.regexp_replace(num, r"^[+-]?0*", ""))
    value = num.try_cast("long")
    fraction = F.rpad(F.coalesce(frac, F.lit("")), 6, "0").substr(1, 6).cast("long")
    sign = F.when(num.startswith("-"), -1).otherwise(1)
    return (
        F.when((digits == 0) & (fraction == 0), None)
        .when(digits <= 11, value * 1000000 + sign * fraction)
        .when(digits <= 14, value * 1000 + sign * _floor_div(fraction, 1000))
        .when(digits <= 17, value)
        .otherwise(_floor_div(value, 1000))
    )


def instant_micros(text: Column, zone: Column | None = None, date_order: Column | None = None) -> Column:
    """Microseconds since 1970-01-01 UTC that `text` denotes, else null.

    A zone, offset or abbreviation in the text holds; else wall time is that of `zone` (an IANA name; null: no instant).
    Slashed dates follow `date_order` ('dmy' or 'mdy'; null: no instant), dotted ones are day first. Wall time that occurs
    twice means the earlier instant, skipped wall time moves forward by the gap (java.time's rule, which
    `to_utc_timestamp` follows). Zero, impossible dates and times and any other text give null; so do null and blank.
    """
    zone = F.lit(None).cast("string") if zone is None else zone
    order = F.lit(None).cast("string") if date_order is None else F.lower(date_order)
    clean = trimmed(text)
    # matched once: a text that does not match comes out unchanged, as a single part
    parts = F.split(F.regexp_replace(F.replace(clean, F.lit(_SEP), F.lit(" ")), PATTERN, _REPLACEMENT), _SEP)
    return F.transform(F.array(parts), lambda p: F.when(F.size(p) == len(_PARTS), _assembled(p, zone, order)))[0]


def _assembled(parts: Column, zone: Column, order: Column) -> Column:
    at = {k: F.nullif(parts[i], F.lit("")) for i, k in enumerate(_PARTS)}
    p1, p2 = at["p1"].cast("long"), at["p2"].cast("long")
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(at["mon"]))
    y = at["y"].cast("long")
    m = F.coalesce(at["mo"].cast("long"), named.cast("long"), F.when(order == "mdy", p1).when(order == "dmy", p2))
    d = F.coalesce(at["d"].cast("long"), F.when(order == "mdy", p2).when(order == "dmy", p1))
    raw_h, mi, s = at["h"].cast("long"), at["mi"].cast("long"), F.coalesce(at["s"].cast("long"), F.lit(0))
    half = F.lower(at["ap"])
    h = F.when(half.isNull(), raw_h).when((raw_h < 1) | (raw_h > 12), None).otherwise(raw_h % 12 + F.when(half == "p", 12).otherwise(0))
    ok = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= _month_days(y, m)) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)
    micro = F.rpad(F.coalesce(at["f"], F.lit("")), 6, "0").substr(1, 6).cast("long")
    local = (((_days(y, m, d) * 24 + h) * 60 + mi) * 60 + s) * 1000000 + micro
    digits = F.regexp_replace(at["off"], r"[^0-9]", "")
    oh, om = digits.substr(1, 2).cast("long"), F.coalesce(F.nullif(digits.substr(3, 2), F.lit("")).cast("long"), F.lit(0))
    minutes = F.when((oh <= 18) & (om <= 59), (oh * 60 + om) * F.when(at["off"].startswith("-"), -1).otherwise(1))
    abbreviations = F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv])
    minutes = F.when(at["off"].isNotNull(), minutes).when(at["abb"].isNotNull(), F.try_element_at(abbreviations, F.upper(at["abb"])).cast("long"))
    ids = _zone_ids()
    own = F.coalesce(*[F.when(x.isin(*ids), x) for x in (at["reg"], _cased(F.lower(at["reg"])))])
    wall = F.when(at["reg"].isNotNull(), own).when(at["off"].isNull() & at["abb"].isNull(), F.when(zone.isin(*ids), zone))
    by_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), wall))
    written = F.when(ok, F.coalesce(local - minutes * 60000000, by_zone))
    return F.when(at["num"].isNotNull(), micros_of_number(at["num"], at["frac"])).otherwise(written)


def _cased(region: Column) -> Column:
    """Zone ids in the spelling java.time knows, for the plain Area/City shape."""
    return F.array_join(F.transform(F.split(region, "/"), lambda a: F.array_join(F.transform(F.split(a, "_"), F.initcap), "_")), "/")


def instant_millis(text: Column, zone: Column | None = None, date_order: Column | None = None) -> Column:
    """`instant_micros` cut (not rounded) to milliseconds."""
    return _floor_div(instant_micros(text, zone, date_order), 1000)
