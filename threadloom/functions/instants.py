"""Timestamps of many written forms to UTC instants.

Each value is tokenised into a *shape mask* (digits become ``9``, Latin letters ``a``, the rest
stays). A mask fixes where every field stands, so it is resolved to a parser once and all values of
that mask are converted together: fields are cut from a matrix of code points and turned into
numbers by a dot product, dates by day arithmetic, zones through sorted transition tables.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from threadloom.functions.zones import pinned, zone_data_version, zone_table

CACHED_LENGTH = 200

#: English month names; three letters suffice to tell them apart.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Abbreviations that mean UTC in every zone, in hours.
UTC_NAMES = ("UTC", "GMT", "Z", "UT")
#: Offsets in hours of abbreviations that the account's own zone doesn't use.
FOREIGN_NAMES = {
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "BRT": -3, "WET": 0, "WEST": 1,
    "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3, "IST": 5.5, "JST": 9, "AEST": 10, "AEDT": 11,
}

_DATES = (
    r"(?P<year>9{4})(?P<sep>[-/.])(?P<month>9{1,2})(?P=sep)(?P<day>9{1,2})",
    r"(?P<one>9{1,2})(?P<sep>[/.-])(?P<two>9{1,2})(?P=sep)(?P<year>9{4})",
    r"(?:a{2,9},? )?(?P<day>9{1,2})[- ](?P<monthname>a{3,9})\.?[- ](?P<year>9{4}),?",
    r"(?:a{2,9},? )?(?P<monthname>a{3,9})\.? (?P<day>9{1,2}),? (?P<year>9{4}),?",
    r"(?P<year>9{4})年(?P<month>9{1,2})月(?P<day>9{1,2})日",
    r"(?P<year>9{4})(?P<month>99)(?P<day>99)(?=a)",
)
_TIMES = (
    r"(?P<glue>a| ?)(?P<hour>9{1,2}):(?P<minute>99)(?::(?P<second>99)(?:[.,](?P<fraction>9+))?)?(?: ?(?P<half>aa|a\.a\.)(?![a/]))?",
    r" ?(?P<cjkhalf>上午|下午|午前|午後)(?P<hour>9{1,2}):(?P<minute>99)(?::(?P<second>99))?",
    r" ?(?P<hour>9{1,2})[時时点](?P<minute>99)分(?:(?P<second>99)秒)?",
    r"(?P<glue>a)(?P<hour>99)(?P<minute>99)(?P<second>99)(?:[.,](?P<fraction>9+))?",
)
_ZONES = r" ?(?:(?P<sign>[+-])(?P<zonehour>99)(?::?(?P<zoneminute>99))?|(?P<zonename>[a_]+(?:/[a_+\-9]+)*))?(?:\[[^\]]*\])?"
_NUMBER = re.compile(r"(?P<minus>-?)(?P<whole>9{1,20})(?:\.(?P<fraction>9+))?")
_FULL = tuple(re.compile(d + "(?:" + t + _ZONES + ")") for d in _DATES for t in _TIMES) + tuple(re.compile(d) for d in _DATES)


def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """Field positions for a mask, or None where no time has that shape. Very long masks aren't kept in memory."""
    return _parser_of(mask) if len(mask) <= CACHED_LENGTH else _parser_of.__wrapped__(mask)


@functools.lru_cache(maxsize=65536)
def _parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    for form in (_NUMBER, *_FULL):
        if m := form.fullmatch(mask):
            return {k: m.span(k) for k, v in m.groupdict().items() if v}
    return None


def _number(points: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    digits = points[:, span[0] : span[1]].astype(np.int64) - 48
    return digits @ (10 ** np.arange(digits.shape[1] - 1, -1, -1, dtype=np.int64))


def _words(values: np.ndarray, span: tuple[int, int]) -> pd.Series:
    return pd.Series([v[span[0] : span[1]] for v in values], dtype=object)


def _days(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the date exists."""
    ok = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1)
    months = ((np.where(ok, year, 1970) - 1970) * 12 + np.where(ok, month, 1) - 1).astype("datetime64[M]")
    start = months.astype("datetime64[D]").astype(np.int64)
    ok &= day <= (months + 1).astype("datetime64[D]").astype(np.int64) - start
    return start + day - 1, ok


def _micros(points: np.ndarray, span: tuple[int, int] | None) -> np.ndarray | int:
    if span is None:
        return 0
    span = (span[0], min(span[1], span[0] + 6))
    return _number(points, span) * 10 ** (6 - (span[1] - span[0]))


def _convert(mask: str, values: np.ndarray, zones: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Micros since 1970 in UTC and validity of values that share ``mask``."""
    n, f = len(values), parser_of(mask)
    if f is None:
        return np.zeros(n, np.int64), np.zeros(n, bool)
    points = np.array(values, dtype=f"U{len(mask)}").view(np.uint32).reshape(n, len(mask))
    if "whole" in f:
        length = f["whole"][1] - f["whole"][0]
        if length > 19:
            return np.zeros(n, np.int64), np.zeros(n, bool)
        whole = _number(points, f["whole"])
        if length <= 11:
            micros = whole * 1_000_000 + _micros(points, f.get("fraction"))
        else:  # milliseconds, microseconds, nanoseconds by their length
            micros = whole * 1000 if length <= 14 else whole if length <= 17 else whole // 1000
        return (-micros if "minus" in f else micros), np.ones(n, bool)
    ok = np.ones(n, bool)
    if "one" in f:
        one, two, year = (_number(points, f[k]) for k in ("one", "two", "year"))
        monthfirst = np.where((one > 12) | (two > 12), two > 12, orders == "mdy")
        month, day = np.where(monthfirst, one, two), np.where(monthfirst, two, one)
    else:
        year, day = _number(points, f["year"]), _number(points, f["day"])
        if "monthname" in f:
            names = _words(values, f["monthname"]).str.lower().str[:3].map({m: i + 1 for i, m in enumerate(MONTHS)})
            month = names.fillna(0).to_numpy(dtype=np.int64)
        else:
            month = _number(points, f["month"])
    days, exists = _days(year, month, day)
    ok &= exists
    hour = minute = second = np.zeros(n, np.int64)
    if "hour" in f:
        hour, minute = _number(points, f["hour"]), _number(points, f["minute"])
        second = _number(points, f["second"]) if "second" in f else second
        if "glue" in f and mask[f["glue"][0]] == "a":
            ok &= np.isin(points[:, f["glue"][0]], (ord("T"), ord("t")))
        if "half" in f or "cjkhalf" in f:
            said = _words(values, f.get("half") or f.get("cjkhalf")).str.lower().str.replace(".", "", regex=False)
            late, early = said.isin(("pm", "下午", "午後")).to_numpy(), said.isin(("am", "上午", "午前")).to_numpy()
            if "half" in f and not (late | early).all():  # two letters that are a zone, such as UT
                ok &= late | early
            ok &= (hour >= ("half" in f)) & (hour <= 12)
            hour = hour % 12 + 12 * late
        ok &= (hour < 24) & (minute < 60) & (second < 60)
    wall = days * 86400 + hour * 3600 + minute * 60 + second
    utc = wall.copy()
    if "sign" in f:
        offset = _number(points, f["zonehour"]) * 3600
        if "zoneminute" in f:
            minutes = _number(points, f["zoneminute"])
            ok &= minutes < 60
            offset = offset + minutes * 60
        ok &= offset <= 18 * 3600
        utc = wall - offset * np.where(points[:, f["sign"][0]] == ord("-"), -1, 1)
    else:
        said = _words(values, f["zonename"]).to_numpy() if "zonename" in f else np.full(n, None, object)
        frame = pd.DataFrame({"said": said, "zone": zones})
        for (name, zone), rows in frame.groupby(["said", "zone"], dropna=False, sort=False).indices.items():
            utc[rows], good = _zoned(wall[rows], name if isinstance(name, str) else None, zone if isinstance(zone, str) else None)
            ok[rows] &= good
    return utc * 1_000_000 + _micros(points, f.get("fraction")), ok


def _zoned(wall: np.ndarray, name: str | None, zone: str | None) -> tuple[np.ndarray, bool]:
    own = zone_table(zone) if zone else None
    if name is None:
        return (own.to_utc(wall) if own else wall), True
    if "/" in name:
        other = zone_table(name)
        return (other.to_utc(wall), True) if other else (wall, False)
    name = name.upper()
    offset = own.offset_named(name, wall) if own else None
    if offset is not None:
        return wall - offset, True
    if name in UTC_NAMES:
        return wall, True
    if name in FOREIGN_NAMES:
        return wall - int(FOREIGN_NAMES[name] * 3600), True
    return wall, False


def micros_of(values: pd.Series, masks: pd.Series, zones: pd.Series, orders: pd.Series) -> pd.Series:
    """Micros since 1970 in UTC of each value, null where it states no valid time."""
    out = np.zeros(len(values), np.int64)
    ok = np.zeros(len(values), bool)
    v, z, o = (s.to_numpy(dtype=object) for s in (values, zones, orders))
    for mask, rows in masks.groupby(masks, sort=False).indices.items():
        out[rows], ok[rows] = _convert(mask, v[rows], z[rows], o[rows])
    return pd.Series(out).astype("Int64").where(pd.Series(ok))


def _micros_udf(version: str):
    """The conversion with the zone tables of one version, which every worker must have."""

    @F.pandas_udf(LongType())
    def run(values: pd.Series, masks: pd.Series, zones: pd.Series, orders: pd.Series) -> pd.Series:
        pinned(version)
        return micros_of(values, masks, zones, orders)

    return run


@F.pandas_udf(StringType())
def utc_text(micros: pd.Series) -> pd.Series:
    """``2024-05-06T07:08:09.012345Z`` of micros, null for null."""
    known = micros.notna().to_numpy()
    out = np.full(len(micros), None, dtype=object)
    stamps = micros[known].to_numpy(dtype=np.int64).astype("datetime64[us]")
    out[known] = np.char.add(np.datetime_as_string(stamps, unit="us"), "Z")
    return pd.Series(out, dtype=object)


def shape_mask(value: Column) -> Column:
    """Character-class mask: digits to ``9``, Latin letters to ``a``; the rest stands for itself."""
    return F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Za-z]", "a")


def instant_micros(value: Column, zone: Column, date_order: Column) -> Column:
    """UTC micros of a written time.

    Null and blank: null. No zone in the value: ``zone`` (UTC where that is
    null or unknown). Day and month exchangeable: ``date_order`` (``dmy`` unless it says ``mdy``). Dates that don't exist,
    hours past 23, unknown zones and words: null. More than six decimals: cut. Zone tables are those of the driver's version; a worker
    with another one fails.
    """
    text = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    fit = F.when(F.length(text) > 0, text)
    return _micros_udf(zone_data_version())(F.coalesce(fit, F.lit("-")), shape_mask(F.coalesce(fit, F.lit("-"))), zone, date_order)
