"""Final states of a row, and the messages made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State codes and the texts that reports and skip reasons use.
STATE_LABELS = {
    0: "copied",
    1: "skipped (extension)",
    2: "skipped (incremental)",
    3: "skipped (no date)",
    4: "skipped (destination exists)",
    5: "duplicate (hash exists)",
    6: "error (stat)",
    7: "error (date extraction)",
    8: "error (hash computation)",
    9: "error (copy failed)",
    10: "error (walk failed)",
}
COPIED = STATE_LABELS[0]
SKIPPED_EXTENSION = STATE_LABELS[1]
SKIPPED_INCREMENTAL = STATE_LABELS[2]
SKIPPED_NO_DATE = STATE_LABELS[3]
SKIPPED_DEST_EXISTS = STATE_LABELS[4]
DUPLICATE = STATE_LABELS[5]
ERROR_HASH = STATE_LABELS[8]
ERROR_COPY = STATE_LABELS[9]

# Not decided by earlier runs; settled against the other rows of this run.
CANDIDATE = "candidate"

# Report statuses.
STATUSES = ("copied", "duplicate", "skipped", "error")


def state_label(code: Column) -> Column:
    label = None
    for value, text in STATE_LABELS.items():
        label = F.when(code == value, text) if label is None else label.when(code == value, text)
    return label.otherwise("unknown")


def status_of(state: Column) -> Column:
    """Report status: the first word of the state."""
    return F.substring_index(state, " ", 1)


def error_message(path: Column, error: Column, state: Column) -> Column:
    return F.concat(path, F.lit(": "), F.coalesce(error, state))


def walk_error_message(path: Column, message: Column) -> Column:
    return F.concat(F.lit("walk error: "), path, F.lit(": "), message)


def message_path(message: Column) -> Column:
    """The part of a message before its first ``": "``."""
    return F.substring_index(message, ": ", 1)


def message_detail(message: Column) -> Column:
    """The part after the first ``": "``, or the whole message without one."""
    at = F.instr(message, ": ")
    return F.when(at > 0, F.substr(message, at + 2)).otherwise(message)
