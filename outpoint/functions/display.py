"""Display forms: times, flags, codes and outpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SERVICE_FLAGS = [
    (1 << 0, "NODE_NETWORK"),
    (1 << 1, "NODE_GETUTXO"),
    (1 << 2, "NODE_BLOOM"),
    (1 << 3, "NODE_WITNESS"),
    (1 << 4, "NODE_XTHIN"),
    (1 << 5, "NODE_BITCOIN_CASH"),
    (1 << 6, "NODE_COMPACT_FILTERS"),
    (1 << 10, "NODE_NETWORK_LIMITED"),
]
NO_SERVICES = "NODE_NONE"
INVENTORY_TYPES = {1: "TX", 2: "BLOCK", 3: "FILTERED_BLOCK", 4: "CMPCT_BLOCK"}


def epoch_to_utc(seconds: Column) -> Column:
    """UTC wall-clock time of epoch seconds, whatever the session time zone."""
    return F.timestamp_add("SECOND", seconds, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def utc_to_micros(wall_clock: Column) -> Column:
    """Microseconds since the epoch of a UTC wall-clock time.

    The difference of two times without zone is exact; functions that take a
    timestamp would go through the session time zone and its clock changes.
    """
    since = wall_clock.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    day, hour, minute, second = [F.extract(F.lit(part), since) for part in ("DAY", "HOUR", "MINUTE", "SECOND")]
    minutes = (day.cast("long") * 24 + hour) * 60 + minute
    return minutes * 60_000_000 + (second * 1_000_000).cast("long")


def utc_to_epoch(wall_clock: Column) -> Column:
    """Whole seconds since the epoch of a UTC wall-clock time."""
    return F.floor(utc_to_micros(wall_clock) / 1_000_000)


def timestamp_as_string(seconds: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in UTC."""
    return epoch_to_utc(seconds).cast("string")


def ctime(seconds: Column) -> Column:
    """C-style time, such as ``Tue Nov 14 22:13:20 2023``, in UTC."""
    wall = epoch_to_utc(seconds)
    day = wall.cast("date")
    return F.concat_ws(
        " ",
        F.date_format(day, "EEE MMM"),
        F.lpad(F.dayofmonth(day).cast("string"), 2, " "),
        F.substring(wall.cast("string"), 12, 8),
        F.year(day).cast("string"),
    )


def delay_as_string(seconds: Column) -> Column:
    """``H:MM:SS`` with any number of hours."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def timestamp_age_sec(seconds: Column, now: Column) -> Column:
    age = now.cast("long") - seconds.cast("long")
    return F.when(age.isNotNull(), F.greatest(F.lit(0).cast("long"), age))


def hex8(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value.cast("long"))), 8, "0")


def decode_services(bits: Column) -> Column:
    """Sorted names of the service flags that are set."""
    known = F.array(*[F.when(bits.bitwiseAND(F.lit(mask)) != 0, F.lit(name)) for mask, name in SERVICE_FLAGS])
    return F.when(bits == 0, F.array(F.lit(NO_SERVICES))).otherwise(F.array_sort(F.array_compact(known)))


def inv_type_name(code: Column) -> Column:
    chain = F.when(code == 1, INVENTORY_TYPES[1])
    for number, name in list(INVENTORY_TYPES.items())[1:]:
        chain = chain.when(code == number, name)
    return chain.otherwise(F.concat(F.lit("unknown obj_type "), code.cast("string")))


def outpoint_to_str(tx_hash: Column, n: Column) -> Column:
    return F.concat_ws(":", tx_hash, n.cast("string"))


def block_record() -> list[Column]:
    """Display columns of a block row."""
    return [
        F.col("height"),
        F.col("hash"),
        hex8(F.col("version")).alias("version"),
        F.col("prev_hash"),
        F.col("merkle_root"),
        ctime(F.col("timestamp")).alias("time"),
        hex8(F.col("bits")).alias("bits"),
        hex8(F.col("nonce")).alias("nonce"),
        F.col("blocksize"),
        F.col("numtxs"),
    ]


def mempool_record() -> list[Column]:
    """Display columns of a mempool row."""
    return [F.col("hash"), F.col("locktime"), F.col("fee"), timestamp_as_string(F.col("time")).alias("time")]
