"""Hashes, byte order, wire integers and block headers as column expressions.

Hashes are shown as lower-case hex in reversed byte order; hashing works on
the bytes in their own ("internal") order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_HEX_DIGITS = 64


def hash256(data: Column) -> Column:
    """SHA-256 applied twice, as 32 bytes."""
    return F.unhex(F.sha2(F.unhex(F.sha2(data, 256)), 256))


def reverse_hex(digits: Column) -> Column:
    """Flip the byte order of a hex string."""
    return F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), 1)), "")


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(digits: Column) -> Column:
    """Bytes of a hex string; null when the length is odd or a digit is bad."""
    legal = (F.length(digits) % 2 == 0) & digits.rlike(r"^[0-9a-fA-F]*\z")
    return F.when(legal, F.unhex(digits))


def packed(text: Column) -> Column:
    """A text as bytes, lower-case hex as half as many; equal texts only have equal bytes, null stays null."""
    data = text.cast("binary")
    digits = (F.length(data) % 2 == 0) & text.rlike(r"^[0-9a-f]*\z")
    return F.when(digits, F.concat(F.unhex(text), F.lit(b"\1"))).otherwise(F.concat(data, F.lit(b"\0")))


def unpacked(data: Column) -> Column:
    """The text that was ``packed``."""
    body = F.substring(data, F.lit(1), F.octet_length(data) - 1)
    return F.when(F.substring(data, -1, 1) == F.lit(b"\1"), to_hex(body)).otherwise(body.cast("string"))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]


def short(df: DataFrame) -> DataFrame:
    """``df`` with its texts ``packed``, to be shuffled or joined with such frames."""
    return df.withColumns({c: packed(F.col(c)) for c in text_columns(df)})


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """The frame ``df`` of which ``short`` was taken; ``like`` has its texts."""
    return df.withColumns({c: unpacked(F.col(c)) for c in text_columns(like) if c in df.columns})


def txid(raw: Column) -> Column:
    """Displayed hash of a serialized transaction."""
    return reverse_hex(to_hex(hash256(raw)))


def le_hex(value: Column, width: int) -> Column:
    """Little-endian hex of an integer in ``width`` bytes (two's complement)."""
    digits = F.lpad(F.lower(F.hex(value.cast("long"))), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(width)])


def compact_size_hex(n: Column) -> Column:
    """Variable-length count prefix."""
    return (
        F.when(n < 0xFD, le_hex(n, 1))
        .when(n <= 0xFFFF, F.concat(F.lit("fd"), le_hex(n, 2)))
        .when(n <= 0xFFFFFFFF, F.concat(F.lit("fe"), le_hex(n, 4)))
        .otherwise(F.concat(F.lit("ff"), le_hex(n, 8)))
    )


def header_hex() -> Column:
    """The 80 header bytes, as hex, from the columns of a block row."""
    return F.concat(
        le_hex(F.col("version"), 4),
        reverse_hex(F.col("prev_hash")),
        reverse_hex(F.col("merkle_root")),
        le_hex(F.col("timestamp"), 4),
        le_hex(F.col("bits"), 4),
        le_hex(F.col("nonce"), 4),
    )


def block_hash() -> Column:
    """Displayed hash of the header of a block row."""
    return txid(F.unhex(header_hex()))


def compact_to_target(bits: Column) -> Column:
    """Proof-of-work target as hex of at least 64 digits.

    Null for exponents under 3. Targets over 256 bits keep all their digits.
    """
    exponent = F.shiftright(bits.cast("long"), 24).bitwiseAND(F.lit(0xFF)).cast("int")
    mantissa = F.lpad(F.lower(F.hex(bits.cast("long").bitwiseAND(F.lit(0xFFFFFF)))), 6, "0")
    zeros = F.repeat(F.lit("00"), exponent - 3)
    digits = F.regexp_replace(F.concat(mantissa, zeros), "^0+", "")
    padded = F.when(F.length(digits) < HASH_HEX_DIGITS, F.lpad(digits, HASH_HEX_DIGITS, "0")).otherwise(digits)
    return F.when(exponent >= 3, padded)


def meets_target(shown_hash: Column, target: Column) -> Column:
    """Whether a displayed hash, read as a number, is at most the target."""
    return (F.length(target) > HASH_HEX_DIGITS) | (shown_hash <= target)
