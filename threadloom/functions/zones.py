"""Zone transition tables: sorted arrays per IANA zone, for vectorised local-time conversion.

A table is derived from the time-zone database of the Python installation (``zone_data_version``
names it) by probing every zone once per worker and refining each change to the second. Beyond ``LAST_YEAR`` a second table holds
the 400 years after which the calendar, and with it every rule of a zone, repeats.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import os
import re
import zoneinfo
from dataclasses import dataclass

import numpy as np

FIRST_YEAR, LAST_YEAR = 1900, 2101
OLD_DAYS, PROBE_DAYS = 28, 14  # between probes before and after 1970; no zone changed there and back in less
_UTC = dt.timezone.utc
_FIRST, _LAST = (int(dt.datetime(y, 1, 1, tzinfo=_UTC).timestamp()) for y in (FIRST_YEAR, LAST_YEAR))
_ERA = 146_097 * 86_400  # seconds in 400 years, whole weeks


@dataclass(frozen=True)
class ZoneTable:
    """``offsets[i]`` (seconds) and ``names[i]`` hold before ``changes[i]``; the last entry holds for ever."""

    changes: np.ndarray
    offsets: np.ndarray
    names: tuple[str, ...]
    walls: np.ndarray
    zone: str

    def to_utc(self, wall: np.ndarray) -> np.ndarray:
        """Wall seconds to UTC seconds. A repeated wall time is its earlier instant; a skipped one moves on by the gap.

        Both follow from one rule: the offset before a change stays in force until the wall clock has
        passed the later of the two readings at the change.
        """
        out = wall - self.offsets[np.searchsorted(self.walls, wall, side="right")]
        late = wall >= _LAST
        if late.any() and len(self.changes):
            far = _probed(self.zone, _LAST, _LAST + _ERA)
            eras = (wall[late] - _LAST) // _ERA * _ERA
            own = wall[late] - eras
            out[late] = eras + own - far.offsets[np.searchsorted(far.walls, own, side="right")]
        return out

    def offset_named(self, name: str, wall: np.ndarray) -> np.ndarray | None:
        """Offsets (seconds) for wall times said to be in abbreviation ``name``; None where the zone never used it."""
        own = np.array([n == name for n in self.names])
        if not own.any():
            return None
        at = np.searchsorted(self.walls, wall, side="right")
        known = np.flatnonzero(own)
        near = known[np.clip(np.searchsorted(known, at), 0, len(known) - 1)]
        before = known[np.clip(np.searchsorted(known, at, side="right") - 1, 0, len(known) - 1)]
        pick = np.where(np.abs(near - at) <= np.abs(before - at), near, before)
        return self.offsets[pick]


@functools.lru_cache(maxsize=1)
def zone_data_version() -> str:
    """Version of the time-zone database in use; where it states none, a digest of what it says of some zones with much history."""
    for folder in zoneinfo.TZPATH:
        for name, pattern in (("tzdata.zi", r"# version (\S+)"), ("+VERSION", r"(\S+)")):
            try:
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    if found := re.match(pattern, file.readline()):
                        return found.group(1)
            except OSError:
                continue
        if os.path.isdir(folder) and os.listdir(folder):
            break
    else:
        try:
            import tzdata

            return tzdata.IANA_VERSION
        except ImportError:
            pass
    seen = [zone_table(z) for z in ("Africa/Casablanca", "America/Sao_Paulo", "Asia/Gaza", "Europe/Moscow", "Pacific/Apia")]
    return "digest-" + hashlib.sha1(b"".join(t.changes.tobytes() + t.offsets.tobytes() for t in seen if t)).hexdigest()[:12]


def pinned(version: str) -> None:
    """Fails where this process has another version of the database than ``version``."""
    if zone_data_version() != version:
        raise RuntimeError(f"zone tables of version {version} are needed, this worker has {zone_data_version()}")


def zone_table(name: str) -> ZoneTable | None:
    """The table of one zone, or None where the database has no such zone."""
    return _probed(name, _FIRST, _LAST)


@functools.lru_cache(maxsize=1024)
def _probed(name: str, first: int, last: int) -> ZoneTable | None:
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None

    def at(second: int) -> tuple[int, str]:
        moment = dt.datetime.fromtimestamp(second, _UTC).astimezone(zone)
        return int(moment.utcoffset().total_seconds()), moment.tzname()

    changes, states = [], [at(first)]
    low = first
    probes = [*range(first + OLD_DAYS * 86400, 0, OLD_DAYS * 86400), *range(max(0, first), last, PROBE_DAYS * 86400)]
    for high in probes:
        state = at(high)
        if state != states[-1]:
            a, b = low, high
            while b - a > 1:
                mid = (a + b) // 2
                if at(mid) == states[-1]:
                    a = mid
                else:
                    b = mid
            changes.append(b)
            states.append(state)
        low = high
    moments = np.array(changes, dtype=np.int64)
    offsets = np.array([s[0] for s in states], dtype=np.int64)
    walls = moments + np.maximum(offsets[:-1], offsets[1:])
    return ZoneTable(moments, offsets, tuple(s[1] for s in states), walls, name)
