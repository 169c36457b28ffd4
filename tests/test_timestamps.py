"""Mixed notations against values worked out one by one with the standard library."""

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest

from rootstock.functions.zones import local_to_utc, transitions, zone_names
from rootstock.operators.timestamps import CHARACTERS, LAYOUTS, to_utc_us, with_instants

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def us(*parts, zone="UTC", micro=0):
    return (datetime(*parts, tzinfo=ZoneInfo(zone)).astimezone(UTC) - EPOCH) // timedelta(microseconds=1) + micro


NY, BERLIN = "America/New_York", "Europe/Berlin"
CASES = [
    ("2023-01-02T09:58:01.962614Z", None, None, us(2023, 1, 2, 9, 58, 1, micro=962614)),
    ("  2023-01-02T09:58:01.9626149Z\t", None, None, us(2023, 1, 2, 9, 58, 1, micro=962614)),
    ("2023-01-02t09:58:01", NY, False, us(2023, 1, 2, 9, 58, 1, zone=NY)),
    ("2023-01-02", BERLIN, True, us(2023, 1, 2, zone=BERLIN)),
    ("2023/01/02 10:00:00", BERLIN, True, us(2023, 1, 2, 10, zone=BERLIN)),
    ("20230102T095801Z", None, None, us(2023, 1, 2, 9, 58, 1)),
    ("01/02/2023 10:30", NY, False, us(2023, 1, 2, 10, 30, zone=NY)),
    ("01/02/2023 10:30", BERLIN, True, us(2023, 2, 1, 10, 30, zone=BERLIN)),
    ("01/02/2023 10:30", None, None, None),
    ("31.12.2023 23:59:59", BERLIN, True, us(2023, 12, 31, 23, 59, 59, zone=BERLIN)),
    ("31.12.2023 23:59:59", NY, False, None),
    ("1/3/2023 12:00:05 AM", NY, False, us(2023, 1, 3, 0, 0, 5, zone=NY)),
    ("1/3/2023 12:00:05 PM", NY, False, us(2023, 1, 3, 12, 0, 5, zone=NY)),
    ("1/3/2023 13:00:05 PM", NY, False, None),
    ("Apr 10, 2023 4:09 pm", NY, False, us(2023, 4, 10, 16, 9, zone=NY)),
    ("10 Apr 2023, 16:09", NY, False, us(2023, 4, 10, 16, 9, zone=NY)),
    ("Fri, 10 Feb 2023 00:18:16 +0100", None, None, us(2023, 2, 9, 23, 18, 16)),
    ("Fri, 10 Feb 2023 00:18:16 GMT", NY, False, us(2023, 2, 10, 0, 18, 16)),
    ("Mon, 10 Feb 2023 00:18:16 GMT", NY, False, None),
    ("2023-01-01 00:25:16 EST", BERLIN, True, us(2023, 1, 1, 5, 25, 16)),
    ("2023-01-01 00:25:16 XYZ", BERLIN, True, None),
    ("2023-01-01T00:25+05:30", BERLIN, True, us(2022, 12, 31, 18, 55)),
    ("2023-07-01T12:00:00[Asia/Kathmandu]", None, None, us(2023, 7, 1, 6, 15)),
    ("2023-07-01T12:00:00+02:00[Asia/Kathmandu]", None, None, us(2023, 7, 1, 10)),
    ("2023-07-01 12:00:00.250 Nowhere/Land", BERLIN, True, None),
    ("2023-03-12 02:30:00", NY, False, None),
    ("2023-11-05 01:30:00", NY, False, None),
    ("2023-11-05 01:30:00.000 America/New_York", None, None, None),
    ("2023-11-05 01:30:00 EDT", None, None, us(2023, 11, 5, 5, 30)),
    ("2023-11-05 01:30:00-05:00", None, None, us(2023, 11, 5, 6, 30)),
    ("1672531200", None, None, us(2023, 1, 1)),
    ("1672531200.5", None, None, us(2023, 1, 1, micro=500000)),
    ("1672531200123", None, None, us(2023, 1, 1, micro=123000)),
    ("1672531200123456", None, None, us(2023, 1, 1, micro=123456)),
    ("1672531200123456789", None, None, us(2023, 1, 1, micro=123456)),
    ("1277836800", None, None, None),
    ("2024-01-02T03:04:05.1234567890123Z", None, None, us(2024, 1, 2, 3, 4, 5, micro=123456)),
    ("2024-01-02T03:04:05." + "9876543210" * 2 + "Z", None, None, us(2024, 1, 2, 3, 4, 5, micro=987654)),
    ("2024-01-02T03:04:05." + "1" * 6000 + "Z", None, None, us(2024, 1, 2, 3, 4, 5, micro=111111)),
    ("1672531200." + "5" * 20, None, None, us(2023, 1, 1, micro=555555)),
    ("0" * 5000 + "1672531200", None, None, us(2023, 1, 1)),
    ("1672531200123456789" + "0" * 5000, None, None, None),
    ("2150-07-01 12:00", BERLIN, True, us(2150, 7, 1, 10)),
    ("2000-10-14 12:00", "America/Fortaleza", True, us(2000, 10, 14, 12, zone="America/Fortaleza")),
    ("99999999999999999999", None, None, None),
    ("2023-02-29", NY, False, None),
    ("2024-02-29", NY, False, us(2024, 2, 29, zone=NY)),
    ("2023-13-01", NY, False, None),
    ("0000-00-00 00:00:00", NY, False, None),
    ("2023-06-01T25:10:00Z", NY, False, None),
    ("2023-06-01x12:10:00", NY, False, None),
    ("last tuesday", NY, False, None),
    ("N/A", NY, False, None),
    ("", NY, False, None),
    (None, NY, False, None),
    ("2023-06-01T12:00:00", None, None, None),
]


def test_each_notation():
    got = to_utc_us(*[pd.Series(list(x), dtype=object) for x in list(zip(*CASES, strict=True))[:3]])
    wrong = [(c, None if pd.isna(g) else int(g)) for c, g in zip(CASES, got, strict=True) if (None if pd.isna(g) else int(g)) != c[3]]
    assert not wrong


@pytest.mark.parametrize("zone", [NY, BERLIN, "Australia/Sydney", "Asia/Kathmandu", "America/Sao_Paulo", "Africa/Casablanca"])
def test_local_times_against_zoneinfo(zone):
    z, r = ZoneInfo(zone), random.Random(zone)
    naive = [datetime(1995, 1, 1) + timedelta(minutes=r.randrange(40 * 365 * 1440)) for _ in range(4000)]
    naive += [datetime(2023, 3, 12, 1) + timedelta(minutes=10 * k) for k in range(24)] + [datetime(2023, 10, 29) + timedelta(minutes=10 * k) for k in range(24)]
    utc, ok = local_to_utc(zone, np.array([(n - datetime(1970, 1, 1)) // timedelta(seconds=1) for n in naive]))
    for n, u, good in zip(naive, utc, ok, strict=True):
        both = {(n.replace(tzinfo=z, fold=f).astimezone(UTC) - EPOCH) // timedelta(seconds=1) for f in (0, 1)}
        real = {b for b in both if (EPOCH + timedelta(seconds=b)).astimezone(z).replace(tzinfo=None) == n}
        assert good == (len(real) == 1)
        assert not good or u in real


def test_frames_with_nulls_long_texts_and_bad_feeds(spark):
    feeds = spark.createDataFrame([("a", "Europe/Berlin", True), ("a", "Europe/Berlin", True), (None, "UTC", False)], "feed string, time_zone string, day_first boolean")
    df = spark.createDataFrame([(1, "2023-01-01", "a"), (2, "2023-01-01", None), (3, "2" * 5000, "a"), (4, None, "b")], "id bigint, t string, feed string")
    got = {r.id: r.u for r in with_instants(df.selectExpr("*", "1 as __feed", "2 as __zone"), feeds, {"t": "u"}).collect()}
    assert got == {1: us(2023, 1, 1, zone=BERLIN), 2: None, 3: None, 4: None}
    assert with_instants(df.limit(0), feeds, {"t": "u"}).count() == 0
    with pytest.raises(ValueError, match="setting"):
        with_instants(df, feeds.unionByName(spark.createDataFrame([("a", "UTC", True)], feeds.schema)), {"t": "u"})


def test_zones_are_those_of_the_standard_library():
    """All zones, every 11 days from 1900 to 2200 and on both sides of each change; some zones every day."""
    daily = {NY, BERLIN, "America/Fortaleza", "Africa/Casablanca", "Australia/Lord_Howe", "America/Nuuk", "Asia/Tehran", "Antarctica/Troll"}
    for name in zone_names().values():
        instants, offsets = transitions(name)
        s = np.arange(-2_208_988_800, 7_258_118_400, 86400 * (1 if name in daily else 11))
        s = np.r_[s, instants[(instants > s[0]) & (instants < s[-1])], instants[(instants > s[0]) & (instants < s[-1])] - 1]
        zone = ZoneInfo(name)
        want = [(EPOCH + timedelta(seconds=x)).astimezone(zone).utcoffset().total_seconds() for x in s.tolist()]
        assert (offsets[np.searchsorted(instants, s, side="right")] == np.array(want)).all(), name


def test_layouts_hold_no_other_characters():
    import re
    from re import _constants, _parser

    found = set()

    def walk(pattern):
        for op, arg in pattern:
            if op is _constants.LITERAL:
                found.add(chr(arg))
            elif op is _constants.IN:
                assert all(o in (_constants.LITERAL, _constants.RANGE) for o, _ in arg)
                found.update(chr(x) for o, v in arg for x in ([v] if o is _constants.LITERAL else range(v[0], v[1] + 1)))
            elif op is _constants.SUBPATTERN:
                walk(arg[3])
            elif op is _constants.BRANCH:
                for x in arg[1]:
                    walk(x)
            elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT):
                walk(arg[2])
            else:
                assert op in (_constants.GROUPREF, _constants.ASSERT_NOT, _constants.AT), op

    for layout in LAYOUTS:
        walk(_parser.parse(layout))
    assert found and all(re.fullmatch(f"[{CHARACTERS}]", c) for c in found)
