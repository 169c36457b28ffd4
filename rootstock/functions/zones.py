"""Zone transition tables, read from the compiled zone files: the instants where a zone's offset changes, with the version of the data.

After the last instant of a file its closing rule goes on; it is laid out to the year 9999.
"""

from __future__ import annotations

import importlib.resources
import re
import struct
import zoneinfo
from functools import cache
from pathlib import Path

import numpy as np

LAST = 9999


def tz_version() -> str:
    """Version of the zone data that this process reads, such as 2024a."""
    for place in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            if (p := Path(place, name)).exists():
                return p.read_text(errors="replace").split("\n")[0].replace("# version ", "").strip()
    try:
        return importlib.resources.files("tzdata").joinpath("zones").parent.joinpath("__init__.py").read_text().split('IANA_VERSION = "')[1].split('"')[0]
    except (ModuleNotFoundError, IndexError, OSError):
        return "unknown"


@cache
def zone_names() -> dict[str, str]:
    """Zone names by their lower-case form."""
    return {z.lower(): z for z in zoneinfo.available_timezones()}


def _file(name: str) -> bytes | None:
    for place in zoneinfo.TZPATH:
        if (p := Path(place, name)).is_file():
            return p.read_bytes()
    try:
        return importlib.resources.files("tzdata.zoneinfo").joinpath(*name.split("/")).read_bytes()
    except (ModuleNotFoundError, OSError):
        return None


def _block(data: bytes, at: int, wide: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(instants, offsets with the one before them in front, end) of a data block; its numbers of 4 or 8 bytes are big-endian."""
    isut, isstd, leap, times, types, chars = struct.unpack_from(">6l", data, at + 20)
    at, size = at + 44, 8 if wide else 4
    instants = np.frombuffer(data, f">i{size}", times, at).astype(np.int64)
    kinds = np.frombuffer(data, np.uint8, times, at + size * times)
    at += (size + 1) * times
    kept = [struct.unpack_from(">lBB", data, at + 6 * i) for i in range(types)]
    # Before the first instant the first kind that isn't summer time holds.
    first = next((offset for offset, summer, _ in kept if not summer), kept[0][0])
    offsets = np.array([first, *(kept[k][0] for k in kinds)], np.int64)
    return instants, offsets, at + 6 * types + chars + (size + 4) * leap + isstd + isut


_NAME = r"(?:[A-Za-z]{3,}|<[A-Za-z0-9+\-]+>)"
_CLOCK = r"[+-]?\d{1,3}(?::\d{2}){0,2}"
_RULE = re.compile(rf"{_NAME}(?P<std>{_CLOCK})(?:{_NAME}(?P<dst>{_CLOCK})?,(?P<start>[^,/]+)(?:/(?P<at>{_CLOCK}))?,(?P<end>[^,/]+)(?:/(?P<until>{_CLOCK}))?)?\Z")


def _seconds(clock: str) -> int:
    parts = [int(x) for x in clock.lstrip("+-").split(":")]
    return (-1 if clock[0] == "-" else 1) * sum(p * s for p, s in zip(parts, (3600, 60, 1), strict=False))


def _day(years: np.ndarray, rule: str) -> np.ndarray:
    """Days since 1970-01-01 of a yearly date: Mm.w.d, Jn (February 29 isn't counted) or n."""
    new_year = (years - 1970).astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64)
    leap = (years % 4 == 0) & ((years % 100 != 0) | (years % 400 == 0))
    if rule[0] == "J":
        n = int(rule[1:])
        return new_year + n - 1 + (leap & (n >= 60))
    if rule[0] != "M":
        return new_year + int(rule)
    month, week, day = (int(x) for x in rule[1:].split("."))
    begin = ((years - 1970) * 12 + month - 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    end = ((years - 1970) * 12 + month).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    # 1970-01-01 was a Thursday, the fifth day counted from Sunday as 0.
    found = begin + (day - (begin + 4)) % 7 + 7 * (week - 1)
    return np.where(found >= end, found - 7, found)


def _closing(rule: str, years: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Instants and the offsets after them that a closing rule gives in these years."""
    m = _RULE.match(rule)
    if m is None or m["start"] is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    std = -_seconds(m["std"])
    dst = -_seconds(m["dst"]) if m["dst"] else std + 3600
    to_dst = _day(years, m["start"]) * 86400 + _seconds(m["at"] or "2") - std
    to_std = _day(years, m["end"]) * 86400 + _seconds(m["until"] or "2") - dst
    instants, offsets = np.r_[to_dst, to_std], np.r_[np.full(len(years), dst), np.full(len(years), std)]
    order = np.argsort(instants, kind="stable")
    return instants[order], offsets[order]


@cache
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(instants, offsets), both in seconds: offsets[i] holds before instants[i], the last one after all. None for an unknown zone."""
    name = zone_names().get(zone.lower())
    data = _file(name) if name else None
    if data is None or data[:4] != b"TZif":
        return None
    instants, offsets, end = _block(data, 0, False)
    if data[4:5] >= b"2":
        instants, offsets, end = _block(data, end, True)
        rule = data[end:].decode("ascii").strip("\n")
        if rule:
            last = int(instants[-1]) if len(instants) else -(2**62)
            first_year = 1970 + last // 31_556_952 - 1 if len(instants) else 1
            more, after = _closing(rule, np.arange(max(1, first_year), LAST + 2))
            new = more > last
            instants, offsets = np.r_[instants, more[new]], np.r_[offsets, after[new]]
    change = np.flatnonzero(offsets[1:] != offsets[:-1])
    return instants[change], offsets[np.r_[0, change + 1]]


def local_to_utc(zone: str, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of local seconds and whether each names exactly one instant: not skipped, not shown twice."""
    known = transitions(zone)
    if known is None:
        return local, np.zeros(len(local), bool)
    instants, offsets = known
    # A local time belongs to regime i if its instant under offset i falls between transitions i - 1 and i.
    begins = np.concatenate([[np.iinfo(np.int64).min // 2], instants])
    ends = np.concatenate([instants, [np.iinfo(np.int64).max // 2]])
    near = np.searchsorted(instants, local - offsets[0])
    count, utc = np.zeros(len(local), np.int8), np.zeros(len(local), np.int64)
    for shift in range(-3, 4):
        i = np.clip(near + shift, 0, len(offsets) - 1)
        inside = (near + shift == i) & (local - offsets[i] >= begins[i]) & (local - offsets[i] < ends[i])
        utc = np.where(inside, local - offsets[i], utc)
        count += inside
    return utc, count == 1
