"""Input checks. Each gives (valid, reason, value) as a struct column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_BLOCK_HEIGHT = 100_000_000
MAX_PATTERN_LENGTH = 512
MAX_TX_BYTES = 1_000_000
COIN = 100_000_000
MAX_MONEY = 21_000_000 * COIN
HASH_PATTERN = r"^[0-9a-fA-F]{64}\z"
NAME_PATTERN = r"^[a-zA-Z0-9_-]{1,64}\z"
HEX_PATTERN = r"^[0-9a-fA-F]+\z"


def _verdict(reason: Column, value: Column) -> Column:
    """A null reason means the value passed; a null value never passes."""
    found = F.when(value.isNull(), "missing").otherwise(reason)
    return F.struct(found.isNull().alias("valid"), found.alias("reason"), F.when(found.isNull(), value).alias("value"))


def is_hash(value: Column) -> Column:
    return F.coalesce(value.rlike(HASH_PATTERN), F.lit(False))


def check_hash(value: Column) -> Column:
    return _verdict(F.when(~value.rlike(HASH_PATTERN), "not 64 hex digits"), F.lower(value))


def check_height(value: Column) -> Column:
    reason = F.when(value < 0, "negative").when(value > MAX_BLOCK_HEIGHT, "too high")
    return _verdict(reason, value.cast("long"))


def check_monitor_name(value: Column) -> Column:
    return _verdict(F.when(~value.rlike(NAME_PATTERN), "bad name"), value)


def _hex_reason(value: Column) -> Column:
    return F.when((F.length(value) == 0) | (F.length(value) % 2 != 0), "empty or odd length").when(
        ~value.rlike(HEX_PATTERN), "not hex"
    )


def check_hex(value: Column) -> Column:
    return _verdict(_hex_reason(value), F.lower(value))


def check_tx_hex(value: Column, max_bytes: int = MAX_TX_BYTES) -> Column:
    too_large = F.when(F.length(value) / 2 > max_bytes, "too large")
    return _verdict(F.coalesce(_hex_reason(value), too_large), F.lower(value))


def check_pattern(value: Column) -> Column:
    return _verdict(F.when(~F.length(value).between(1, MAX_PATTERN_LENGTH), "bad length"), value)


def value_in_range(satoshis: Column) -> Column:
    return satoshis.between(0, MAX_MONEY)
