"""Mixed timestamp notations and zones to one UTC instant in microseconds.

Each text is reduced to its shape mask: digits become 9, letters become a, everything else stays.
A mask fixes where every field lies, so a parser is made once per distinct mask and turns all texts
of that mask to numbers together, as slices of one character matrix.  Local times go through zone
transition tables (`rootstock.functions.zones`), whose version is checked on every worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootstock.functions.keys import fresh
from rootstock.functions.zones import local_to_utc, tz_version, zone_names

# Usual meaning of zone abbreviations, in minutes east of UTC.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "BRST": -120, "ART": -180,
    "IST": 330, "NPT": 345, "PKT": 300, "SGT": 480, "HKT": 480, "AWST": 480, "KST": 540, "JST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
# English month names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

_TIME = r"(?P<hour>9{1,2}):(?P<minute>99)(?::(?P<second>99)(?:[.,](?P<fraction>9+))?)?(?: ?(?P<half>aa|a\.a\.)(?!a))?"
_ZONE = r"(?P<zone> ?a{1,5}| ?\[[a/_+\-9]+\]| a+(?:/[a_\-]+)+| ?(?:aaa)?[+-]99:?99(?:\[[a/_+\-9]+\])?| ?[+-]99|a\[[a/_+\-9]+\])?"
#: Layouts over masks; the first that matches wins.
LAYOUTS = [
    rf"(?P<year>9999)-(?P<month>99)-(?P<day>99)(?:(?: |a|a )?{_TIME}{_ZONE})?",
    rf"(?P<year>9999)(?P<sep>[/.])(?P<month>9{{1,2}})(?P=sep)(?P<day>9{{1,2}})(?:(?: |a){_TIME}{_ZONE})?",
    r"(?P<year>9999)(?P<month>99)(?P<day>99)(?:a| )(?P<hour>99)(?P<minute>99)(?:(?P<second>99)(?:[.,](?P<fraction>9+))?)?" + _ZONE,
    rf"(?P<first>9{{1,2}})(?P<sep>[/.\-])(?P<other>9{{1,2}})(?P=sep)(?P<year>9999)(?:,? {_TIME}{_ZONE})?",
    rf"(?:(?P<weekday>a{{3,9}}),? )?(?P<day>9{{1,2}})[ \-](?P<name>a{{3,9}})\.?[ \-](?P<year>9999)(?:,? {_TIME}{_ZONE})?",
    rf"(?:(?P<weekday>a{{3,9}}),? )?(?P<name>a{{3,9}})\.? (?P<day>9{{1,2}}),? (?P<year>9999)(?:,? {_TIME}{_ZONE})?",
    r"(?P<epoch>9+)(?:\.(?P<part>9*))?",
]
#: All that layouts are made of, as a class of characters.
CHARACTERS = r"0-9A-Za-z \-/.,:+_\[\]"
_LAYOUTS = [re.compile(x + r"\Z") for x in LAYOUTS]


@dataclass(frozen=True)
class Parser:
    """Where the fields of a mask lie."""

    spans: dict[str, tuple[int, int]]

    def has(self, name: str) -> bool:
        return name in self.spans


@lru_cache(maxsize=100_000)
def parser(mask: str) -> Parser | None:
    """The parser of a mask, made once per worker; None where the mask is no notation of a time."""
    for layout in _LAYOUTS:
        if m := layout.match(mask):
            return Parser({k: m.span(k) for k, v in m.groupdict().items() if v is not None})
    return None


_MASK = [(re.compile(r"[0-9]"), "9"), (re.compile(r"[A-Za-z]"), "a")]


def masks(texts: pd.Series) -> pd.Series:
    """Shape masks of trimmed texts."""
    for pattern, by in _MASK:
        texts = texts.str.replace(pattern, by, regex=True)
    return texts


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 and whether the date exists."""
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    fits = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    mm = np.where(fits, m, 1)
    fits &= d <= length[mm] + (leap & (mm == 2))
    months = (np.where(fits, y, 1970) - 1970) * 12 + mm - 1
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + np.where(fits, d, 1) - 1, fits


class _Texts:
    """All texts of one mask as a matrix of characters."""

    def __init__(self, texts: np.ndarray, length: int):
        self.text = texts
        self.codes = np.ascontiguousarray(texts.astype(f"U{length}")).view(np.uint32).reshape(len(texts), length)

    def number(self, span: tuple[int, int], width: int | None = None) -> np.ndarray:
        digits = self.codes[:, span[0] : span[1]].astype(np.int64) - 48
        if width is not None:  # a fraction: cut or filled to width digits
            digits = digits[:, :width]
            digits = np.pad(digits, ((0, 0), (0, width - digits.shape[1])))
        out = np.zeros(len(self.text), np.int64)
        for k in range(digits.shape[1]):
            out = out * 10 + digits[:, k]
        return out

    def words(self, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words of a field in lower case and the index of each text's word."""
        part = np.ascontiguousarray(self.codes[:, span[0] : span[1]]).view(f"U{span[1] - span[0]}").ravel()
        kinds, index = np.unique(part, return_inverse=True)
        return np.char.lower(kinds), index

    def looked_up(self, span: tuple[int, int], find) -> np.ndarray:
        kinds, index = self.words(span)
        return np.array([find(str(k)) for k in kinds], dtype=np.int64)[index]


def _month(word: str) -> int:
    """Month of a name or of its first three or more letters; 0 for other words."""
    return next((k + 1 for k, n in enumerate(MONTHS) if len(word) >= 3 and n.startswith(word)), 0)


def _zone(text: str) -> tuple[str, int | str]:
    """('offset', seconds), ('zone', name) or ('bad', 0)."""
    text = text.strip()
    m = re.match(r"^(?:gmt|utc)?([+-])(\d\d):?(\d\d)?(?:\[.*\])?$", text)
    if m:
        hours, minutes = int(m[2]), int(m[3] or 0)
        return ("offset", (1 if m[1] == "+" else -1) * (hours * 3600 + minutes * 60)) if hours <= 18 and minutes < 60 else ("bad", 0)
    bare = re.sub(r"^z?\[(.*)\]$", r"\1", text)
    if text.startswith("z["):
        return "offset", 0
    if bare.upper() in ABBREVIATIONS:
        return "offset", ABBREVIATIONS[bare.upper()] * 60
    return ("zone", bare) if bare in zone_names() else ("bad", 0)


def _epoch(t: _Texts, p: Parser) -> tuple[np.ndarray, np.ndarray]:
    """Digits alone: the unit is the one that gives a year from 2020 to 2030."""
    low, high = 1577836800, 1924992000  # 2020-01-01, 2031-01-01
    a, b = p.spans["epoch"]
    ok, us = np.zeros(len(t.text), bool), np.zeros(len(t.text), np.int64)
    if b - a > 18:  # leading zeros at most; beyond 19 digits no unit fits
        short = np.array([x[a:b].lstrip("0") for x in t.text])
        whole = np.where(np.char.str_len(short) <= 18, np.where(short == "", "0", short), "0").astype("U18").astype(np.int64)
        nineteen = np.char.str_len(short) == 19
        if nineteen.any():
            whole[nineteen] = [min(int(x), 2**63 - 1) for x in short[nineteen]]
    else:
        whole = t.number((a, b))
    part = t.number(p.spans["part"], 12) if p.has("part") and p.spans["part"][1] > p.spans["part"][0] else np.zeros(len(t.text), np.int64)
    for per_second in (1, 10**3, 10**6, 10**9):
        fits = (whole // per_second >= low) & (whole // per_second < high)
        scaled = np.where(fits, whole, 0)
        micro = scaled * (10**6 // per_second) + part // (10**6 * per_second) if per_second <= 10**6 else scaled // 1000
        us, ok = np.where(fits, micro, us), ok | fits
    return us, ok


def _local(t: _Texts, p: Parser, feed_zone: np.ndarray, day_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(t.text)
    get = lambda k, default=0: t.number(p.spans[k]) if p.has(k) else np.full(n, default, np.int64)
    year, ok = get("year"), np.ones(n, bool)
    if p.has("first"):
        first, other = get("first"), get("other")
        ok &= day_first >= 0
        day, month = np.where(day_first == 1, first, other), np.where(day_first == 1, other, first)
    else:
        day = get("day")
        month = t.looked_up(p.spans["name"], _month) if p.has("name") else get("month")
    days, real = _days(year, month, day)
    ok &= real
    if p.has("weekday"):
        ok &= t.looked_up(p.spans["weekday"], lambda w: DAYS.index(w[:3]) if w[:3] in DAYS else -1) == (days + 3) % 7
    hour, minute, second = get("hour"), get("minute"), get("second")
    if p.has("half"):
        half = t.looked_up(p.spans["half"], lambda w: {"am": 0, "pm": 1}.get(w.replace(".", ""), -1))
        ok &= (half >= 0) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * (half == 1)
    ok &= (hour < 24) & (minute < 60) & (second < 60)
    micro = t.number(p.spans["fraction"], 6) if p.has("fraction") else np.zeros(n, np.int64)
    if p.has("hour"):  # the one letter between date and time, where there is one, is a T
        before = p.spans["hour"][0] - 1
        between = t.codes[:, before] if before >= 0 else np.zeros(n, np.uint32)
        letter = ((between >= 65) & (between <= 90)) | ((between >= 97) & (between <= 122))
        ok &= ~letter | (between == ord("T")) | (between == ord("t"))
    seconds = days * 86400 + hour * 3600 + minute * 60 + second
    utc, known = np.zeros(n, np.int64), np.zeros(n, bool)
    zone = feed_zone.copy()
    if p.has("zone"):
        kinds, index = t.words(p.spans["zone"])
        zone = np.full(n, "", object)
        for k, word in enumerate(kinds):
            kind, what = _zone(str(word))
            mine = index == k
            if kind == "offset":
                utc[mine], known[mine] = seconds[mine] - what, True
            elif kind == "zone":
                zone[mine] = what
    for name in {z for z in zone[ok & ~known] if z}:
        mine = ok & ~known & (zone == name)
        utc[mine], known[mine] = local_to_utc(name, seconds[mine])
    return utc * 10**6 + micro, ok & known


def to_utc_us(texts: pd.Series, zones: pd.Series, day_first: pd.Series) -> pd.Series:
    """Vectorised conversion; NULL where a text names no single instant."""
    out = pd.array([None] * len(texts), dtype="Int64")
    if not len(texts):
        return pd.Series(out)
    text = texts.reset_index(drop=True).astype(object)
    held = text[text.notna()].str.strip()
    feed_zone = zones.reset_index(drop=True).astype(object).where(zones.reset_index(drop=True).notna(), "").to_numpy(object)
    flag = day_first.reset_index(drop=True)
    flag = np.array([-1 if x is None or x is pd.NA or x != x else int(x) for x in flag], np.int64)
    mask = masks(held)
    values, good = np.zeros(len(text), np.int64), np.zeros(len(text), bool)
    for shape, rows in mask.groupby(mask).groups.items():
        p = parser(shape)
        if p is None or not shape:
            continue
        i = rows.to_numpy()
        t = _Texts(held.loc[rows].to_numpy(str), len(shape))
        values[i], good[i] = _epoch(t, p) if p.has("epoch") else _local(t, p, feed_zone[i], flag[i])
    out[good] = values[good]
    return pd.Series(out)


def utc_us(text: Column, zone: Column, day_first: Column) -> Column:
    """Microseconds since 1970-01-01 UTC of a text in mixed notations; NULL where it names no single instant.

    `zone` and `day_first` describe the row's feed; both NULL for an unknown one.  Empty and NULL texts give NULL;
    no length is too long.  The zone data must have one version on driver and workers.
    """
    version = tz_version()

    @F.pandas_udf("bigint")
    def convert(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if (own := tz_version()) != version:
            raise RuntimeError(f"zone data differ: {version} on the driver, {own} here")
        for t, z, d in batches:
            yield to_utc_us(t, z, d)

    # What holds any other character is no notation, whatever its length, and isn't sent to Python.
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return convert(F.when(trimmed.rlike(f"^[{CHARACTERS}]+$"), trimmed), zone, day_first)


def with_instants(df: DataFrame, feeds: DataFrame, columns: dict[str, str], feed: str = "feed") -> DataFrame:
    """df plus, for each text column, a bigint of UTC microseconds under the given name.

    `feeds` (feed, time_zone, day_first) is broadcast; it is refused beyond 100,000 rows.  A feed that
    isn't in it counts as none.  Repeated feeds with different settings are an error.
    """
    if clash := set(columns.values()) & {c for c in df.columns if c not in columns}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    at, zone, day = (fresh(n, df) for n in ("__feed", "__zone", "__day"))
    f = feeds.select(F.col("feed").alias(at), F.col("time_zone").alias(zone), F.col("day_first").alias(day)).where(F.col(at).isNotNull()).distinct()
    n, m = f.agg(F.count(F.lit(1)), F.count_distinct(at)).first()
    if n > 100_000:
        raise ValueError(f"{n} feeds: too many to broadcast")
    if n != m:
        raise ValueError("a feed has more than one setting")
    joined = df.join(F.broadcast(f), F.col(f"`{feed}`") == F.col(at), "left")
    return joined.withColumns({new: utc_us(F.col(f"`{c}`"), F.col(zone), F.col(day)) for c, new in columns.items()}).drop(at, zone, day)
