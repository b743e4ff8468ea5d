"""Event types of the change log in all their spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The event types of the log format and their numbers.
EVENT_TYPES = {
    "Created": 1,
    "Modified": 2,
    "Deleted": 3,
    "Renamed": 4,
    "PermissionChanged": 5,
    "MetadataChanged": 6,
    "Checkpoint": 255,
}


def event_code(c: Column) -> Column:
    """Number of the event type; null where it is null or unreadable.

    Letter case, blanks, hyphens, underscores and a leading ``EventType::`` do not matter; the number itself is also accepted.
    """
    plain = F.regexp_replace(F.lower(c), r"^\s*eventtype::|[\s_\-]", "")
    code = F.when(c == "Modified", 2)
    for name, number in EVENT_TYPES.items():
        code = code.when(c == name, number)
    for name, number in EVENT_TYPES.items():
        code = code.when(plain.isin(name.lower(), str(number)), number)
    return code.cast("int")


def event_name(code: Column) -> Column:
    out = None
    for name, number in EVENT_TYPES.items():
        out = F.when(code == number, name) if out is None else out.when(code == number, name)
    return out
