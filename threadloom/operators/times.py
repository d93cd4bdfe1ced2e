"""Operator: every written time of a table as one UTC instant in the account's zone rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.instants import instant_micros, utc_text
from threadloom.functions.zones import pinned, zone_data_version, zone_table


def with_account_rules(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """``rows`` with ``_zone`` and ``_date_order`` of their account; null where there is no such account.

    ``accounts`` has one row per account; the optimizer broadcasts it while it is under the broadcast
    threshold and joins by shuffle (with skew handling) beyond.
    """
    rules = accounts.select(
        F.col("account_key").alias("_account"), F.col("zone").alias("_zone"), F.col("date_order").alias("_date_order")
    )
    return rows.join(rules, rows["account_key"] == rules["_account"], "left").drop("_account")


def stated_times(rows: DataFrame, accounts: DataFrame, places: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(place, record_key, utc_text) of every value that states a valid time.

    ``places`` maps a place to its key and value columns. Null, blank and invalid values give
    no row; repeated rows give a row for each key; an empty table gives none. One pass over ``rows``.
    """
    structs = [
        F.struct(F.lit(place).alias("place"), key.cast("string").alias("record_key"), value.alias("value"))
        for place, (key, value) in places.items()
    ]
    slim = rows.select("account_key", F.explode(F.array(*structs)).alias("_spot"))
    slim = with_account_rules(slim, accounts).where(F.col("_spot.value").isNotNull())
    micros = slim.select(
        "_spot.place", "_spot.record_key", instant_micros(F.col("_spot.value"), F.col("_zone"), F.col("_date_order")).alias("_micros")
    )
    return micros.where(F.col("_micros").isNotNull()).select("place", "record_key", utc_text("_micros").alias("utc_text"))


def zone_transitions(accounts: DataFrame) -> DataFrame:
    """(zone, version, utc_from, offset_seconds, abbreviation): the versioned transition tables of the zones of ``accounts``, as ``stated_times`` uses them.

    Each zone once; null and unknown zones have no rows. What held before a zone's first change has a null ``utc_from``.
    """
    version = zone_data_version()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pinned(version)
        for frame in frames:
            for zone in frame["zone"]:
                if own := zone_table(zone):
                    since = [None, *own.changes.astype("datetime64[s]").astype("datetime64[us]").tolist()]
                    yield pd.DataFrame({"zone": zone, "version": version, "utc_from": pd.Series(since, dtype="datetime64[us]"), "offset_seconds": own.offsets, "abbreviation": own.names})

    zones = accounts.where("zone is not null").select("zone").distinct()
    return zones.mapInPandas(run, "zone string, version string, utc_from timestamp, offset_seconds bigint, abbreviation string")
