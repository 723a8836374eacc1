from pyspark.sql import functions as F

from outpoint.operators import lookups, maintenance, utxo

KEY = "76a914" + "ab" * 20 + "88ac"


def outputs(spark, rows):
    """Rows (hash, pos, satoshis, script, height, blockindex, seq)."""
    return spark.createDataFrame(
        rows, "hash string, pos bigint, satoshis bigint, script_hex string, height bigint, blockindex bigint, seq bigint"
    )


def inputs(spark, rows):
    """Rows (hash, prev_hash, prev_index, blockindex, seq)."""
    return spark.createDataFrame(
        rows, "hash string, prev_hash string, prev_index bigint, blockindex bigint, seq bigint"
    )


def test_spending_and_unspendable(spark):
    outs = outputs(
        spark,
        [
            ("c", 0, 50, KEY, 1, 0, 1),
            ("c", 1, 60, "51", 1, 0, 1),
            ("t", 0, 40, KEY, -1, None, 2),
            ("t", 1, 0, "006a01", -1, None, 2),
            ("t", 2, 5, "00", -1, None, 2),
        ],
    )
    ins = inputs(spark, [("c", "t", 0, 0, 1), ("t", "c", 0, None, 2), ("u", "c", 0, 3, 3)])
    left = {(r["hash"], r["pos"]): r for r in utxo.utxo_set(outs, ins).collect()}
    # The coinbase input spends nothing, and one outpoint may be named twice.
    assert set(left) == {("c", 1), ("t", 0), ("t", 2)}
    assert left[("t", 0)]["pubkeyhash"] == "ab" * 20 and left[("c", 1)]["pubkeyhash"] == "unknown"
    flags = {(r["hash"], r["pos"]): (r["spent"], r["spendable"]) for r in utxo.spent_flags(outs, utxo.utxo_set(outs, ins)).collect()}
    assert flags[("t", 1)] == (True, False) and flags[("c", 0)] == (True, True) and flags[("t", 0)] == (False, True)


def test_fees(spark):
    outs = outputs(
        spark,
        [
            ("a", 0, 100, KEY, 1, 0, 1),
            ("a", 1, 30, KEY, 1, 0, 1),
            ("a", 2, 30, "006a", 1, 0, 1),
            ("b", 0, 90, KEY, -1, None, 2),
            ("c", 0, 500, KEY, -1, None, 3),
            ("e", 0, 1, KEY, -1, None, 5),
            ("late", 0, 70, KEY, -1, None, 9),
        ],
    )
    ins = inputs(
        spark,
        [
            ("b", "a", 0, None, 2),  # 100 - 90
            ("c", "a", 1, None, 3),  # 30 - 500, floor 0
            ("d", "a", 0, None, 4),  # already spent
            ("e", "b", 0, None, 5),  # 90 of a transaction that is loose too
            ("f", "a", 2, None, 6),  # not spendable
            ("g", "late", 0, None, 8),  # the parent comes later
            ("i", "late", 0, None, 10),  # spent by g before
        ],
    )
    txs = ins.select("hash").unionByName(spark.createDataFrame([("nothing",)], "hash string"))
    fees = {r["hash"]: r["fee"] for r in utxo.fees(txs, ins, outs).collect()}
    assert fees == {"b": 10, "c": 0, "d": 0, "e": 89, "f": 0, "g": 0, "i": 0}


def test_a_coinbase_spends_nothing(spark):
    outs = outputs(spark, [("a", 0, 100, KEY, 1, 0, 1), ("b", 0, 70, KEY, 1, 0, 1), ("d", 0, 60, KEY, -1, None, 4)])
    ins = inputs(spark, [("coin", "a", 0, 0, 2), ("d", "a", 0, 5, 4), ("d2", "a", 0, 5, 5), ("e", "b", 0, 1, 6), ("late", "b", 0, 0, 7)])
    fees = {r["hash"]: r["fee"] for r in utxo.fees(ins.select("hash").distinct(), ins, outs).collect()}
    assert fees == {"coin": 100, "d": 40, "d2": 0, "e": 70, "late": 0}


def rows_of(spark, pairs, pkh="p"):
    return spark.createDataFrame(
        [(f"h{i}", i, s, n, pkh) for i, (n, s) in enumerate(pairs)],
        "hash string, pos bigint, satoshis bigint, height int, pubkeyhash string",
    )


def tip(spark, n):
    return spark.createDataFrame([(n,)], "height bigint")


def test_golden_balances(spark):
    keys = spark.createDataFrame([("p",), ("q",), ("p",)], "pubkeyhash string")
    for top, pairs, expected in [
        (100, [(90, 100), (99, 50)], (100, 50)),
        (10, [(1, 100), (-1, 25)], (100, 25)),
        (3, [(1, 100), (0, 1)], (0, 101)),
    ]:
        found = utxo.balance_by_pubkeyhash(keys, rows_of(spark, pairs), tip(spark, top)).collect()
        sums = {r["pubkeyhash"]: (r["confirmed"], r["unconfirmed"]) for r in found}
        assert sums == {"p": expected, "q": (0, 0)}
    none = utxo.balance_by_pubkeyhash(keys, rows_of(spark, [(1, 5)]), tip(spark, 1).limit(0)).collect()
    assert {r["pubkeyhash"]: r["unconfirmed"] for r in none} == {"p": 5, "q": 0}


def test_unknown_owner_never_matches(spark):
    keys = spark.createDataFrame([("unknown",)], "pubkeyhash string")
    assert utxo.utxo_by_pubkeyhash(keys, rows_of(spark, [(1, 5)], "unknown")).count() == 0


def test_utxo_lookup(spark):
    keys = spark.createDataFrame([("p",)], "pubkeyhash string")
    row = utxo.utxo_by_pubkeyhash(keys, rows_of(spark, [(10, 250)])).collect()
    assert [(r["height"], r["tx_pos"], r["tx_hash"], r["value"]) for r in row] == [(10, 0, "h0", 250)]


def test_upsert_last_writer_wins(spark):
    current = rows_of(spark, [(-1, 5), (-1, 6)])
    delta = spark.createDataFrame(
        [("h0", 0, 5, 7, "p", 2), ("h0", 0, 5, 6, "p", 1), ("new", 0, 9, 8, "p", 1)],
        "hash string, pos bigint, satoshis bigint, height int, pubkeyhash string, seq bigint",
    )
    out = {r["hash"]: r["height"] for r in utxo.upsert(current, delta, ["hash", "pos"], "seq").collect()}
    assert out == {"h0": 7, "h1": -1, "new": 8}


def test_insert_once(spark):
    schema = "hash string, height bigint"
    current = spark.createDataFrame([("a", 1)], schema)
    delta = spark.createDataFrame([("a", 2), ("b", 3), ("b", 2)], schema)
    assert [tuple(r) for r in maintenance.insert_once(current, delta, ["hash"], ["height"]).collect()] == [("b", 2)]


def test_mempool_duplicates_keep_ties(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("a", 6), ("b", 1)], "hash string, time bigint")
    kept = sorted(tuple(r) for r in maintenance.drop_later_duplicates(df).collect())
    assert kept == [("a", 5), ("a", 5), ("b", 1)]


def test_listings(spark):
    blocks = spark.createDataFrame(
        [(1, "b1", 1, "b0", "m", 1700000000, 0x1D00FFFF, 0, 0, 1000, 1), (2, "b2", 1, "b1", "m", 1700000600, 1, 0, 0, 80, 0)],
        "height bigint, hash string, version bigint, prev_hash string, merkle_root string, timestamp bigint, "
        "bits bigint, nonce bigint, offset bigint, blocksize bigint, numtxs bigint",
    )
    tx = spark.createDataFrame([("t", 1, 0)], "hash string, height bigint, blockindex bigint")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "height bigint")
    found = {r["key"]: r for r in lookups.block_listing(keys, blocks, tx, "height").collect()}
    assert found[1]["txid"] == "t" and found[1]["bits"] == "1d00ffff"
    assert found[2]["hash"] == "b2" and found[2]["txid"] is None and found[2]["not_found"] is None
    assert found[3]["not_found"] == "block height 3 not found"
    empty = lookups.status(blocks.limit(0), None, None, None).first()
    assert tuple(empty) == ("unknown", 0, 0, 0, 0)
    full = lookups.status(blocks, tx, None, tx).first()
    assert tuple(full) == ("2023-11-14 22:23:20", 2, 1, 0, 1)


def test_existence_without_the_tx_table(spark):
    one = lambda x: spark.createDataFrame([(x,)], "hash string")
    keys = one("m").unionByName(one("c")).unionByName(one("t"))
    found = {r["hash"]: r["known"] for r in lookups.tx_exists(keys, None, one("m"), one("c")).collect()}
    assert found == {"m": True, "c": True, "t": False}


def test_admission(spark):
    import hashlib

    good = "01000000" + "00" + "01" + "0500000000000000" + "0151" + "00000000"
    other = "02" + good[2:]
    ids = [hashlib.sha256(hashlib.sha256(bytes.fromhex(x)).digest()).digest()[::-1].hex() for x in (good, other)]
    rows = [(1, good), (2, other), (3, good + "ffff"), (4, good[:-2]), (5, "00f"), (6, "zz"), (7, "00" * 90), (8, None)]
    submitted = spark.createDataFrame(rows, "i int, tx string")
    known = spark.createDataFrame([(ids[1],), (ids[1],)], "hash string")
    out = {r["i"]: (r["txid"], r["reason"]) for r in lookups.admit_broadcasts(submitted, known, 80, "i").collect()}
    assert out == {
        1: (ids[0], None),
        2: (ids[1], f"already exists: {ids[1]}"),
        3: (ids[0], f"already exists: {ids[0]}"),
        4: (None, "not a transaction"),
        5: (None, "empty or odd length"),
        6: (None, "not hex"),
        7: (None, "too large"),
        8: (None, "missing"),
    }


def test_offset_repair(spark):
    blocks = spark.createDataFrame([("a", 0), ("b", 7), ("c", 0)], "hash string, offset bigint")
    index = spark.createDataFrame([("a", 90), ("b", 91)], "hash string, offset bigint")
    fixed = {r["hash"]: r["offset"] for r in maintenance.repair_offsets(blocks, index).collect()}
    assert fixed == {"a": 90, "b": 7, "c": 0}


def test_orphan_rows_are_stamped(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, "p", "m", 5, 1, 1, 3)],
        "height bigint, hash string, version bigint, prev_hash string, merkle_root string, timestamp bigint, "
        "bits bigint, nonce bigint, numtxs bigint",
    )
    row = maintenance.orphan_rows(df, F.current_timestamp()).first()
    assert row["created_at"] is not None and "numtxs" not in row


def test_one_transaction_submitted_twice(spark):
    raw = (1).to_bytes(4, "little") + bytes(6)
    other = (2).to_bytes(4, "little") + bytes(6)
    rows = [(1, raw.hex()), (0, raw.hex().upper()), (2, other.hex()), (3, "ff" * 20), (4, "ff" * 20)]
    submitted = spark.createDataFrame(rows, "i int, tx string")
    known = spark.createDataFrame([], "hash string")
    out = {r["i"]: (r["accepted"], r["reason"]) for r in lookups.admit_broadcasts(submitted, known, arrival="i").collect()}
    assert out[0] == out[2] == (True, None)
    assert not out[1][0] and out[1][1].startswith("already exists")
    assert out[3] == out[4] == (False, "not a transaction")


def test_an_owner_with_most_outputs_is_split(spark):
    rows = spark.range(60_000).selectExpr(
        "concat('t', id) hash", "id pos", "1L satoshis", "1 height", "if(id % 10 = 0, concat('p', id % 97), 'hot') pubkeyhash"
    )
    keys = spark.range(97).selectExpr("concat('p', id) pubkeyhash", "id").union(spark.createDataFrame([("hot", 1000)], "p string, id long"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = utxo.utxo_by_pubkeyhash(keys, rows)
        assert len(found.collect()) == 60_000
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_equal_bytes_under_two_names_are_one_transaction(spark):
    empty = "01000000000000000000"
    rows = [("b", 0, empty), ("a", 0, empty), ("a", 1, empty), ("c", 0, "01000000000000000001")]
    sent = spark.createDataFrame(rows, "hash string, again int, tx string").withColumn("turn", F.struct("again", "hash"))
    none = spark.createDataFrame([], "hash string")
    out = {(r["hash"], r["again"]): r["accepted"] for r in lookups.admit_broadcasts(sent, none, 80, "turn").collect()}
    assert out == {("a", 0): True, ("b", 0): False, ("a", 1): False, ("c", 0): True}
