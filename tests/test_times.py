import datetime as dt
import zoneinfo

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.functions import instants
from threadloom.functions.zones import zone_table


def micros(value, zone="UTC", order="dmy"):
    v = pd.Series([value])
    mask = v.str.replace("[0-9]", "9", regex=True).str.replace("[A-Za-z]", "a", regex=True)
    out = instants.micros_of(v, mask, pd.Series([zone], dtype=object), pd.Series([order], dtype=object))[0]
    return None if pd.isna(out) else np.datetime_as_string(np.datetime64(int(out), "us"), unit="us") + "Z"


@pytest.mark.parametrize(
    "value, zone, order, expected",
    [
        ("2024-05-06T07:08:09.012345678Z", "UTC", "dmy", "2024-05-06T07:08:09.012345Z"),
        ("2024-05-06t07:08:09z", "UTC", "dmy", "2024-05-06T07:08:09.000000Z"),
        ("2024-05-06 07:08:09,5+05:30", "UTC", "dmy", "2024-05-06T01:38:09.500000Z"),
        ("20240506T070809Z", "UTC", "dmy", "2024-05-06T07:08:09.000000Z"),
        ("1714979289", "Asia/Tokyo", "dmy", "2024-05-06T07:08:09.000000Z"),
        ("1714979289012", "UTC", "dmy", "2024-05-06T07:08:09.012000Z"),
        ("1714979289.5", "UTC", "dmy", "2024-05-06T07:08:09.500000Z"),
        ("03/04/2024 10:00", "UTC", "mdy", "2024-03-04T10:00:00.000000Z"),
        ("03/04/2024 10:00", "UTC", "dmy", "2024-04-03T10:00:00.000000Z"),
        ("13/04/2024 10:00", "UTC", "mdy", "2024-04-13T10:00:00.000000Z"),
        ("4/3/2024 12:05:01 AM", "UTC", "mdy", "2024-04-03T00:05:01.000000Z"),
        ("Jan 12, 2023, 5:39:32 PM", "America/New_York", "mdy", "2023-01-12T22:39:32.000000Z"),
        ("Sat, 07 Jan 2023 15:12:37 +0530", "UTC", "dmy", "2023-01-07T09:42:37.000000Z"),
        ("2023年2月27日 下午12:18:38", "Asia/Taipei", "dmy", "2023-02-27T04:18:38.000000Z"),
        ("2023年02月27日 07時29分05秒", "Asia/Tokyo", "dmy", "2023-02-26T22:29:05.000000Z"),
        ("2024-03-31 02:30:00", "Europe/Berlin", "dmy", "2024-03-31T01:30:00.000000Z"),  # skipped: on by the gap
        ("2024-10-27 02:30:00", "Europe/Berlin", "dmy", "2024-10-27T00:30:00.000000Z"),  # twice: the earlier
        ("2024-10-27 02:30:00 CET", "Europe/Berlin", "dmy", "2024-10-27T01:30:00.000000Z"),
        ("2024-01-10 02:30:00 CST", "Asia/Taipei", "dmy", "2024-01-09T18:30:00.000000Z"),
        ("2024-01-10 02:30:00 CST", "America/Chicago", "mdy", "2024-01-10T08:30:00.000000Z"),
        ("2024-07-10 02:30:00 Europe/Madrid", "UTC", "dmy", "2024-07-10T00:30:00.000000Z"),
        ("2024-07-10T02:30:00+02:00[Europe/Madrid]", "UTC", "dmy", "2024-07-10T00:30:00.000000Z"),
        ("2024-07-10", "Australia/Sydney", "dmy", "2024-07-09T14:00:00.000000Z"),
        ("2024-02-30", "UTC", "dmy", None),
        ("2024-13-45T99:00:00Z", "UTC", "dmy", None),
        ("0000-00-00 00:00:00", "UTC", "dmy", None),
        ("13:00:00 PM", "UTC", "dmy", None),
        ("2024-01-10 02:30:00 Nowhere/Land", "UTC", "dmy", None),
        ("pending", "UTC", "dmy", None),
        ("-", "UTC", "dmy", None),
        ("9" * 20, "UTC", "dmy", None),
        ("2024-07-10 10:00:00", None, None, "2024-07-10T10:00:00.000000Z"),
    ],
)
def test_forms(value, zone, order, expected):
    assert micros(value, zone, order) == expected


@settings(max_examples=60, deadline=None)
@given(st.datetimes(dt.datetime(1975, 1, 1), dt.datetime(2700, 1, 1)), st.sampled_from(["America/New_York", "Europe/Lisbon", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo"]))
def test_zone_table_agrees_with_the_library(moment, name):
    moment = moment.replace(microsecond=0)
    zone = zoneinfo.ZoneInfo(name)
    local = moment.replace(tzinfo=zone, fold=0)  # fold 0: the earlier instant, and on by the gap
    expected = int((moment - dt.datetime(1970, 1, 1)).total_seconds()) - int(local.utcoffset().total_seconds())
    wall = int((moment - dt.datetime(1970, 1, 1)).total_seconds())
    assert zone_table(name).to_utc(np.array([wall]))[0] == expected


def test_unknown_zone():
    assert zone_table("No/Where") is None


def test_version_is_pinned():
    from threadloom.functions import zones

    zones.pinned(zones.zone_data_version())
    with pytest.raises(RuntimeError):
        zones.pinned("1970a")


def test_transition_table(spark):
    from threadloom.operators.times import zone_transitions

    rows = zone_transitions(spark.createDataFrame([("Europe/Berlin",), ("No/Where",), (None,), ("Europe/Berlin",)], "zone string")).where("utc_from >= '2024-01-01' and utc_from < '2025-01-01'").collect()
    assert [(r["zone"], r["offset_seconds"], r["abbreviation"]) for r in rows] == [("Europe/Berlin", 7200, "CEST"), ("Europe/Berlin", 3600, "CET")] and len({r["version"] for r in rows}) == 1


def test_operator_on_tables(spark):
    from pyspark.sql import functions as F

    from threadloom.operators.times import stated_times

    accounts = spark.createDataFrame([("a", "Europe/Berlin", "dmy")], "account_key string, zone string, date_order string")
    rows = spark.createDataFrame(
        [(1, "a", "2024-01-10 02:30:00", 5), (2, None, " 2024-01-10 02:30:00 ", 5), (3, "x", None, 5), (4, "a", "", 5), (5, "a", "n/a" * 100, 5), (1, "a", "2024-01-10 02:30:00", 5), (6, "a", "2024-01-10T02:30:00." + "1" * 90 + "+01:00[" + "x" * 300 + "]", 5)],
        "row_id long, account_key string, stamp string, zone int",
    )
    found = stated_times(rows, accounts, {"p": (F.col("row_id"), F.col("stamp"))}).collect()
    assert sorted(map(tuple, found)) == [("p", "1", "2024-01-10T01:30:00.000000Z")] * 2 + [("p", "2", "2024-01-10T02:30:00.000000Z"), ("p", "6", "2024-01-10T01:30:00.111111Z")]
    assert stated_times(rows.limit(0), accounts, {"p": (F.col("row_id"), F.col("stamp"))}).count() == 0
