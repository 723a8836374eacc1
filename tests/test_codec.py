import hashlib
import struct

from pyspark.sql import functions as F

from outpoint.functions import codec
from outpoint.functions.hashing import to_hex


def tables(spark, h):
    """A plain transaction, one without inputs, and one with many outputs."""
    script = "76a914" + "cd" * 20 + "88ac"
    ins = [("t1", 0, h("p"), 3, "abcd", 0xFFFFFFFE), ("t1", 1, h("q"), 0, "", 0), ("t3", 0, h("r"), 1, "", 1)]
    outs = [("t1", 0, 5_000_000_000, script), ("t2", 0, 1, ""), ("t2", 1, 2, "00" * 300)]
    outs += [("t3", i, i, "51") for i in range(300)]
    txs = [("t1", 2, 99, 2, 1), ("t2", -1, 0, 0, 2), ("t3", 1, 0xFFFFFFFF, 1, 300)]
    return (
        spark.createDataFrame(txs, "hash string, version int, locktime bigint, nin bigint, nout bigint"),
        spark.createDataFrame(
            ins, "hash string, vin bigint, prev_hash string, prev_index bigint, script_sig_hex string, sequence bigint"
        ),
        spark.createDataFrame(outs, "hash string, pos bigint, satoshis bigint, script_hex string"),
    )


def expected_bytes(h):
    script = bytes.fromhex("76a914" + "cd" * 20 + "88ac")
    one = struct.pack("<i", 2) + b"\x02"
    one += bytes.fromhex(h("p"))[::-1] + struct.pack("<I", 3) + b"\x02\xab\xcd" + struct.pack("<I", 0xFFFFFFFE)
    one += bytes.fromhex(h("q"))[::-1] + struct.pack("<I", 0) + b"\x00" + struct.pack("<I", 0)
    one += b"\x01" + struct.pack("<q", 5_000_000_000) + bytes([len(script)]) + script + struct.pack("<I", 99)
    return one


def test_round_trip(spark, h):
    raw = codec.encode_tx_table(*tables(spark, h))
    rows = {r["hash"]: bytes(r["raw"]) for r in raw.collect()}
    assert rows["t1"] == expected_bytes(h)
    decoded = {r["hash"]: r for r in codec.decode_tx_table(raw.drop("chunk")).collect()}
    assert decoded["t2"]["version"] == -1 and decoded["t2"]["vin"] == []
    assert [len(o["script"]) for o in decoded["t2"]["vout"]] == [0, 300]
    assert decoded["t3"]["locktime"] == 0xFFFFFFFF and len(decoded["t3"]["vout"]) == 300
    first = decoded["t1"]["vin"][0]
    assert (first["prev_hash"], first["prev_index"], first["sequence"]) == (h("p"), 3, 0xFFFFFFFE)
    assert all(decoded[k]["size"] == len(rows[k]) for k in rows)


def test_large_transactions_come_in_chunks(spark, h, monkeypatch):
    whole = {r["hash"]: bytes(r["raw"]) for r in codec.encode_tx_table(*tables(spark, h)).collect()}
    monkeypatch.setattr(codec, "PARTS_PER_CHUNK", 16)
    raw = codec.encode_tx_table(*tables(spark, h)).cache()
    chunks = sorted((r["hash"], r["chunk"], bytes(r["raw"])) for r in raw.collect())
    assert len(chunks) == 2 + 19
    assert {k: b"".join(c[2] for c in chunks if c[0] == k) for k in whole} == whole
    ids = {r["hash"]: r["txid"] for r in codec.txids(raw).collect()}
    twice = lambda b: hashlib.sha256(hashlib.sha256(b).digest()).digest()[::-1].hex()
    assert ids == {k: twice(b) for k, b in whole.items()}
    assert {r["hash"]: bytes(r["raw"]) for r in codec.whole_transactions(raw).collect()} == whole


def test_undecodable_bytes(spark, h):
    good = expected_bytes(h)
    rows = [("good", good), ("short", good[:-1]), ("empty", b""), ("null", None), ("cut", good[:20])]
    df = spark.createDataFrame(rows, "name string, raw binary")
    found = {r["name"]: r["version"] for r in codec.decode_tx_table(df).collect()}
    assert found == {"good": 2, "short": None, "empty": None, "null": None, "cut": None}


def test_display_record(spark, h):
    df = spark.createDataFrame([("t1", expected_bytes(h))], "hash string, raw binary")
    decoded = codec.decode_tx_table(df)
    text = decoded.select(codec.tx_record(decoded).alias("x")).first()["x"]
    assert f'{{"prevout":{{"hash":"{h("p")}","n":3}},"scriptSig":"abcd","sequence":"fffffffe"}}' in text
    assert '"sequence":"0000"' in text and text.startswith('{"version":2,') and text.endswith('"locktime":99}')


def test_hex_text_is_lower_case(spark):
    assert spark.range(1).select(to_hex(F.unhex(F.lit("AB"))).alias("x")).first()["x"] == "ab"


def test_crafted_lengths_give_null(spark, h):
    head = struct.pack("<i", 1)
    outpoint = b"\x01" + b"\0" * 36
    rows = []
    for n in (2**31, 2**32, 2**63, 2**64 - 1):
        nine = b"\xff" + n.to_bytes(8, "little")
        rows += [(f"in{n}", head + nine), (f"sig{n}", head + outpoint + nine), (f"out{n}", head + b"\0" + nine)]
        rows += [(f"lock{n}", head + b"\0\x01" + b"\0" * 8 + nine)]
    df = spark.createDataFrame([(name, raw + b"\0" * 50) for name, raw in rows], "name string, raw binary")
    assert all(r["version"] is None for r in codec.decode_tx_table(df).collect())
