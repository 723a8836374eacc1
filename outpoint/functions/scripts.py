"""Locking scripts and addresses."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
UNKNOWN = "unknown"
UNSPENDABLE_PREFIX = "006a"
BASE58_DIGITS = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
ADDRESS_BYTES = 25
CHECKSUM_BYTES = 4
P2PKH_VERSION_BYTES = {"mainnet": 0x00, "testnet": 0x6F}


def script_to_pubkeyhash(script_hex: Column) -> Column:
    """Key hash of a pay-to-pubkey-hash script, else ``unknown``."""
    pays_key = script_hex.rlike(r"^76a914[0-9a-f]{40}88ac\z")
    return F.when(pays_key, F.substring(script_hex, 7, 40)).otherwise(UNKNOWN)


def is_spendable(script_hex: Column) -> Column:
    """False for scripts that begin with the bytes 00 6a."""
    return ~script_hex.startswith(UNSPENDABLE_PREFIX)


def lock_script(pubkeyhash: Column) -> Column:
    return F.concat(F.lit("76a914"), pubkeyhash, F.lit("88ac"))


def _payload(address: str) -> bytes | None:
    """Version byte and key hash, or None when the text is no valid address."""
    number = 0
    for char in address:
        digit = BASE58_DIGITS.find(char)
        if digit < 0:
            return None
        number = number * 58 + digit
        if number.bit_length() > 8 * ADDRESS_BYTES:
            return None
    body = number.to_bytes(ADDRESS_BYTES, "big")
    payload, checksum = body[:-CHECKSUM_BYTES], body[-CHECKSUM_BYTES:]
    digest = hashlib.sha256(hashlib.sha256(payload).digest()).digest()
    return payload if digest[:CHECKSUM_BYTES] == checksum else None


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        addresses = batch.column(0).to_pylist()
        payloads = [None if a is None else _payload(a) for a in addresses]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([p and p[1:].hex() for p in payloads], pa.string()),
                pa.array([p and p[0] for p in payloads], pa.int32()),
            ],
            names=["address", "pubkeyhash", "version_byte"],
        )


def resolve_addresses(addresses: DataFrame) -> DataFrame:
    """Distinct addresses with their key hash and version byte; null when bad.

    The network byte is not checked. The number has 200 bits, more than any
    Spark type holds, so the base conversion runs on Arrow batches.
    """
    distinct = addresses.select("address").distinct()
    return distinct.mapInArrow(_decode_batches, "address string, pubkeyhash string, version_byte int")


def address_to_pubkeyhash(df: DataFrame) -> DataFrame:
    """Rows of ``df`` (column ``address``) with pubkeyhash, valid and reason."""
    resolved = resolve_addresses(df).drop("version_byte")
    joined = df.join(resolved, "address", "left")
    valid = F.col("pubkeyhash").isNotNull()
    return joined.withColumn("valid", valid).withColumn("reason", F.when(~valid, "bad address"))


def address_to_lock_script(df: DataFrame, network: str) -> DataFrame:
    """Rows of ``df`` (column ``address``) with the script that pays them.

    Only pay-to-pubkey-hash addresses of the given network have one.
    """
    version = P2PKH_VERSION_BYTES[network]
    joined = df.join(resolve_addresses(df), "address", "left")
    usable = F.coalesce(F.col("version_byte") == version, F.lit(False))
    reason = F.when(F.col("pubkeyhash").isNull(), "bad address").when(~usable, "unsupported address type")
    return joined.select(
        *df.columns,
        F.when(usable, lock_script(F.col("pubkeyhash"))).alias("lock_script"),
        reason.alias("reason"),
    )
