import hashlib
import time

import pytest
from pyspark.sql import functions as F

from outpoint.functions import display, hashing, scripts, validate
from outpoint.functions.hashing import to_hex


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_hash256_and_byte_order(spark):
    twice = hashlib.sha256(hashlib.sha256(b"\x00\xff").digest()).hexdigest()
    assert one(spark, to_hex(hashing.hash256(F.unhex(F.lit("00ff"))))) == twice
    assert one(spark, hashing.reverse_hex(F.lit("0102ff"))) == "ff0201"
    assert one(spark, hashing.reverse_hex(F.lit(""))) == ""


@pytest.mark.parametrize("digits,ok", [("00fF", True), ("abc", False), ("zz", False), ("", True), ("00\n0", False)])
def test_from_hex(spark, digits, ok):
    assert (one(spark, hashing.from_hex(F.lit(digits))) is not None) == ok


def test_wire_integers(spark):
    assert one(spark, hashing.le_hex(F.lit(1), 4)) == "01000000"
    assert one(spark, hashing.le_hex(F.lit(-1), 4)) == "ffffffff"
    assert one(spark, hashing.le_hex(F.lit(-2), 8)) == "feffffffffffffff"
    for n, expected in [(0, "00"), (252, "fc"), (253, "fdfd00"), (65535, "fdffff"), (65536, "fe00000100"), (1 << 32, "ff0000000001000000")]:
        assert one(spark, hashing.compact_size_hex(F.lit(n))) == expected


def test_first_block_header(spark):
    """The first block of the public chain."""
    row = spark.range(1).select(
        F.lit(1).alias("version"),
        F.lit("0" * 64).alias("prev_hash"),
        F.lit("4a5e1e4baab89f3a32518a88c31bc87f618f76673e2cc77ab2127b7afdeda33b").alias("merkle_root"),
        F.lit(1231006505).alias("timestamp"),
        F.lit(0x1D00FFFF).alias("bits"),
        F.lit(2083236893).alias("nonce"),
    )
    found = row.select(
        hashing.block_hash().alias("hash"),
        hashing.meets_target(hashing.block_hash(), hashing.compact_to_target(F.col("bits"))).alias("valid"),
    ).first()
    assert found["hash"] == "000000000019d6689c085ae165831e934ff763ae46a2a6c172b3f1b60a8ce26f"
    assert found["valid"]


@pytest.mark.parametrize("bits", [0x1D00FFFF, 0x03123456, 0x04000001, 0x207FFFFF, 0x02FFFFFF, 0x22FFFFFF, 0x03000000])
def test_compact_target(spark, bits):
    exponent, mantissa = bits >> 24, bits & 0xFFFFFF
    found = one(spark, hashing.compact_to_target(F.lit(bits)))
    if exponent < 3:
        assert found is None
    else:
        assert int(found, 16) == mantissa << (8 * (exponent - 3))
        assert len(found) >= 64


def test_scripts(spark):
    script = F.lit("76a9147c78584493557fac782023a4ad591b64545929d988ac")
    assert one(spark, scripts.script_to_pubkeyhash(script)) == "7c78584493557fac782023a4ad591b64545929d9"
    assert one(spark, scripts.script_to_pubkeyhash(F.concat(F.lit("75"), script))) == "unknown"
    for digits, expected in [("006a01", False), ("00", True), ("", True), ("6a00", True), ("0061", True)]:
        assert one(spark, scripts.is_spendable(F.lit(digits))) is expected


def test_addresses(spark):
    good = "mgzhRq55hEYFgyCrtNxEsP1MdusZZ31hH5"
    # A wrong check sum, an illegal character, one that is too long, an empty one, and the main network.
    asked = [good, good[:-1] + "6", "0" + good[1:], good * 3, "", None, "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", good]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, address string")
    key_hash = "10375cfe32b917cd24ca1038f824cd00f7391859"
    rows = {r["i"]: r for r in scripts.address_to_pubkeyhash(df).collect()}
    assert len(rows) == len(asked)
    assert rows[0]["pubkeyhash"] == rows[7]["pubkeyhash"] == key_hash
    assert [rows[i]["valid"] for i in range(8)] == [True, False, False, False, False, False, True, True]
    locks = {r["i"]: r for r in scripts.address_to_lock_script(df, "testnet").collect()}
    assert locks[0]["lock_script"] == f"76a914{key_hash}88ac" and locks[0]["reason"] is None
    assert locks[1]["reason"] == "bad address"
    assert locks[6]["reason"] == "unsupported address type"


def test_times(spark):
    assert one(spark, display.timestamp_as_string(F.lit(1700000000))) == "2023-11-14 22:13:20"
    for t in (0, 1700000000, 1709251199, 4102444800):
        assert one(spark, display.ctime(F.lit(t))) == time.asctime(time.gmtime(t))
    assert one(spark, display.delay_as_string(F.lit(108309))) == "30:05:09"
    assert one(spark, display.timestamp_age_sec(F.lit(10), F.lit(4))) == 0


def test_times_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, display.timestamp_as_string(F.lit(1700000000))) == "2023-11-14 22:13:20"
        assert one(spark, display.ctime(F.lit(1678604400))) == "Sun Mar 12 07:00:00 2023"
        wall = F.expr("timestamp_ntz'2023-03-12 02:30:00'")
        assert one(spark, display.utc_to_epoch(wall)) == 1678588200
        assert one(spark, display.timestamp_as_string(F.lit(1678588200))) == "2023-03-12 02:30:00"
        assert one(spark, display.ctime(F.lit(1678588200))) == "Sun Mar 12 02:30:00 2023"
        wall = F.expr("timestamp_ntz'1969-12-31 23:59:58.5'")
        assert one(spark, display.utc_to_micros(wall)) == -1_500_000
        assert one(spark, display.utc_to_epoch(wall)) == -2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "bits,names",
    [
        (0, ["NODE_NONE"]),
        (24, ["NODE_WITNESS", "NODE_XTHIN"]),
        (25, ["NODE_NETWORK", "NODE_WITNESS", "NODE_XTHIN"]),
        (37, ["NODE_BITCOIN_CASH", "NODE_BLOOM", "NODE_NETWORK"]),
        (1061, ["NODE_BITCOIN_CASH", "NODE_BLOOM", "NODE_NETWORK", "NODE_NETWORK_LIMITED"]),
        (1069, ["NODE_BITCOIN_CASH", "NODE_BLOOM", "NODE_NETWORK", "NODE_NETWORK_LIMITED", "NODE_WITNESS"]),
        (1 << 20, []),
    ],
)
def test_services(spark, bits, names):
    assert one(spark, display.decode_services(F.lit(bits).cast("long"))) == names


def test_codes(spark):
    shown = [one(spark, display.inv_type_name(F.lit(n))) for n in (1, 2, 3, 4, 9)]
    assert shown == ["TX", "BLOCK", "FILTERED_BLOCK", "CMPCT_BLOCK", "unknown obj_type 9"]
    assert one(spark, display.hex8(F.lit(0x1D00FFFF))) == "1d00ffff"
    assert one(spark, display.outpoint_to_str(F.lit("ab"), F.lit(3))) == "ab:3"


def verdict(spark, check):
    return one(spark, check)["valid"]


def test_validation(spark):
    long_hash = "Aa" * 32
    checked = one(spark, validate.check_hash(F.lit(long_hash)))
    assert checked["valid"] and checked["value"] == long_hash.lower()
    for bad in ("a" * 63, "a" * 65, "g" * 64, "a" * 64 + "\n", "", None):
        assert not verdict(spark, validate.check_hash(F.lit(bad).cast("string")))
    for height, ok in [(0, True), (100_000_000, True), (-1, False), (100_000_001, False)]:
        assert verdict(spark, validate.check_height(F.lit(height))) is ok
    for name, ok in [("my-mon_1", True), ("a" * 64, True), ("a" * 65, False), ("", False), ("a b", False), ("a\n", False)]:
        assert verdict(spark, validate.check_monitor_name(F.lit(name))) is ok
    for digits, ok in [("00Ff", True), ("", False), ("abc", False), ("zz", False), ("00\n0", False)]:
        assert verdict(spark, validate.check_hex(F.lit(digits))) is ok
    for n, ok in [(1, True), (512, True), (0, False), (513, False)]:
        assert verdict(spark, validate.check_pattern(F.lit("x" * n))) is ok
    for n, ok in [(2_000_000, True), (2_000_002, False)]:
        assert verdict(spark, validate.check_tx_hex(F.repeat(F.lit("0"), n))) is ok
    for value, ok in [(0, True), (2_100_000_000_000_000, True), (2_100_000_000_000_001, False), (-1, False)]:
        assert one(spark, validate.value_in_range(F.lit(value))) is ok
