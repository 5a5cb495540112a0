"""Canonical ride schema and the fixed values the conforming rules use."""

from __future__ import annotations

import re

from pyspark.sql import types as T

RIDE_SCHEMA = T.StructType(
    [
        T.StructField("Ride ID", T.StringType()),
        T.StructField("Start Time", T.TimestampNTZType()),
        T.StructField("Stop Time", T.TimestampNTZType()),
        T.StructField("Start Station ID", T.StringType()),
        T.StructField("Start Station Name", T.StringType()),
        T.StructField("Start Station Latitude", T.DoubleType()),
        T.StructField("Start Station Longitude", T.DoubleType()),
        T.StructField("Start Region", T.StringType()),
        T.StructField("End Station ID", T.StringType()),
        T.StructField("End Station Name", T.StringType()),
        T.StructField("End Station Latitude", T.DoubleType()),
        T.StructField("End Station Longitude", T.DoubleType()),
        T.StructField("End Region", T.StringType()),
        T.StructField("Rideable Type", T.StringType()),
        T.StructField("User Type", T.StringType()),
        T.StructField("Gender", T.ByteType()),
        T.StructField("Birth Year", T.IntegerType()),
        T.StructField("Bike ID", T.IntegerType()),
    ]
)
RIDE_COLUMNS = RIDE_SCHEMA.fieldNames()
TIME_COLUMNS = ["Start Time", "Stop Time"]
BACKFILL_COLUMNS = ["Birth Year", "Gender", "Bike ID"]


# Fixed rule: how header spellings are compared.
def squash_header(header: str) -> str:
    """Lower-case a header and drop blanks and slashes."""
    return re.sub(r"[\s/]", "", header.lower())


# Header spellings of the newer files.
NEW_HEADERS = {
    "ride_id": "Ride ID",
    "rideable_type": "Rideable Type",
    "started_at": "Start Time",
    "ended_at": "Stop Time",
    "start_station_id": "Start Station ID",
    "start_station_name": "Start Station Name",
    "start_lat": "Start Station Latitude",
    "start_lng": "Start Station Longitude",
    "end_station_id": "End Station ID",
    "end_station_name": "End Station Name",
    "end_lat": "End Station Latitude",
    "end_lng": "End Station Longitude",
    "member_casual": "Member/Casual",
}
# Columns whose older headers differ from the canonical name in case, blanks and slashes only.
_OLD_HEADER_COLUMNS = [
    c
    for c in RIDE_COLUMNS
    if c not in ("Ride ID", "Rideable Type", "Start Region", "End Region")
]
HEADER_ALIASES = {squash_header(c): c for c in _OLD_HEADER_COLUMNS} | NEW_HEADERS

# Source columns that are junk or derived.
DROPPED_COLUMNS = [
    "Unnamed: 0",
    "rideable_type_duplicate_column_name_1",
    "Trip Duration",
    "tripduration",
]

# Ordered enum domains and value maps.
RIDEABLE_TYPES = ["unknown", "classic_bike", "electric_bike"]
USER_TYPES = ["Subscriber", "Customer"]
GENDER_CODES = {"U": 0, "M": 1, "F": 2}
MEMBER_TO_USER = {"member": "Subscriber", "casual": "Customer"}

# Station id prefixes by region (regular expressions matched at the start of the id).
# The "no station" marker matches by its single letters unless strict matching is asked for.
NO_REGION = "None"
SYSTEM_REGION = "SYS"
REGION_PATTERNS = {
    "NYC": [
        r"(?:\d{1,3}|\d{4}\.\d\d)",
        r"S 5th St & Kent Ave",
        r"MTL-ECO51-1",
        r"MTL-ECO5-LAB",
        r"Shop Morgan",
    ],
    "JC": [r"JC\d{3}", r"Liberty State Park"],
    "HB": [r"HB\d{3}"],
    "SYS": [r"(?:SYSY?\d{3}|Lab - NYC)", r"JCSYS", r"X-MTL-AOS-5\.1"],
}

# Null spellings in the CSV files.
NULL_TOKENS = [
    r"\N", "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# First months of service.
FIRST_MONTH = {"NYC": 201306, "JC": 201509}
# Months whose rides are backfilled from the older snapshot.
BACKFILL_MONTHS = (202001, 202101)
# Fixed values: (source, start, stop) month of a part holding one near-copy of another row.
KNOWN_BAD_PARTS = [(201306, 201307, 201307)]

# Dashboard labels and stacking orders.
DASHBOARD_REGION = {"HB": "HOB"}
DASHBOARD_USER = {"Customer": "Daily", "Subscriber": "Annual"}
GENDER_LABELS = {0: "Unknown", 1: "Men", 2: "Women"}
RIDEABLE_LABELS = {
    "docked_bike": "Classic",
    "classic_bike": "Classic",
    "electric_bike": "Electric",
    "unknown": "Unknown",
    "motivate_dockless_bike": "Unknown",
}
STACK_ORDER = {
    "User Type": ["Daily", "Annual"],
    "Gender": ["Unknown", "Women", "Men"],
    "Rideable Type": ["Electric", "Classic", "Unknown"],
    "Region": ["JC", "HOB", "NYC"],
}
GENDER_AVERAGE_END = "2021-02"
UNKNOWN_RIDEABLE_AVERAGE_END = "2021-02"
SERIES_START = "2013-06"
# Ordinals of the compact record form.
COMPACT_CODES = {
    "r": ["NYC", "JC", "HOB"],
    "t": ["Annual", "Daily"],
    "b": ["classic_bike", "docked_bike", "electric_bike", "unknown"],
}

# Months (half-open, None for no bound) in which a consolidated table has no value in a column.
UNFILLED_MONTHS = {
    "Ride ID": (None, 202001),
    "Bike ID": (202102, None),
    "Birth Year": (202102, None),
}
