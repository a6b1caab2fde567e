"""Entry IDs and page tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX_LENGTH = 8
SEPARATOR = "::"


def padded_id(number: Column, length: int = INDEX_LENGTH) -> Column:
    """Zero-padded ID; wider numbers widen it (lpad would cut them)."""
    return F.format_string(f"%0{length}d", number.cast("bigint"))


def strip_zeros(entry_id: Column) -> Column:
    return F.regexp_replace(entry_id, "^0+", "")


def parse_index(entry_id: Column) -> Column:
    """The ID as a number: all zeros give 0, anything that isn't only digits gives null."""
    digits = F.when(entry_id.rlike("^[0-9]+$"), entry_id)
    return digits.try_cast("bigint")


def join_token(rel_id: str, entry_id: str) -> str:
    return f"{rel_id}{SEPARATOR}{entry_id}"


def split_token(token: str) -> tuple[str, str]:
    """Relationship ID and entry ID, split at the first separator; a bare ID has an empty relationship ID."""
    rel, found, entry = token.partition(SEPARATOR)
    return (rel, entry) if found else ("", token)
