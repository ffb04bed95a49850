"""Record layouts of the feeds, as DDL text."""

from __future__ import annotations

# One JSON object per event; the location is text, "<lat> <lon> <accuracy>".
JSON_EVENT = (
    "DeviceID INT, Timestamp TIMESTAMP, EventID SMALLINT, EventData STRING, IsTemporal BOOLEAN"
)

CONFIG = (
    "device_ids ARRAY<STRING>, event_types ARRAY<STRING>, "
    "geofence STRUCT<latitude: STRING, longitude: STRING, radius: STRING>, "
    "detection STRUCT<latitude: STRING, longitude: STRING, radius: STRING>, "
    "temporal STRUCT<time: INT, frequency: INT>, "
    "sequence ARRAY<STRING>, "
    "evaluation ARRAY<STRUCT<event: STRING, sign: STRING, count: INT, threshold: INT>>"
)
