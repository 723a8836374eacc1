import random

from pyspark.sql import functions as F

from outpoint.operators import chain


def sequential_chain(arrivals, start):
    """Blocks in the order they join, one waiting block per parent."""
    done, waiting, last, known = [], {}, start, set()
    for block, parent in arrivals:
        if block in known:
            continue
        if parent == last:
            todo = block
            while todo is not None:
                done.append(todo)
                known.add(todo)
                last = todo
                todo = waiting.pop(last, None)
        else:
            waiting.setdefault(parent, block)
    return done


def frame(spark, pairs):
    rows = [(b, p, float(i)) for i, (b, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "hash string, prev_hash string, arrival double")


def test_linkage_equals_the_sequential_queue(spark):
    rng = random.Random(3)
    pairs = [(f"b{i}", f"b{i - 1}") for i in range(1, 120)]
    pairs += [(f"f{i}", f"b{i - 1}") for i in range(5, 120, 9)]
    pairs += [(f"f{i}x", f"f{i}") for i in range(5, 120, 18)]
    pairs = [p for p in pairs if p[0] != "b97"]
    rng.shuffle(pairs)
    # Make sure that the first of two siblings is on the long chain.
    pairs.sort(key=lambda p: p[0].startswith("f"))
    rng.shuffle(half := pairs[: len(pairs) // 2])
    pairs = half + pairs[len(pairs) // 2 :] + pairs[:10]
    expected = sequential_chain(pairs, "b0")
    out = chain.order_blocks(frame(spark, pairs), "b0", 500).collect()
    linked = sorted((r["height"], r["hash"]) for r in out if r["state"] == "linked")
    assert linked == [(501 + i, b) for i, b in enumerate(expected)]
    assert len(out) == len({p[0] for p in pairs})
    states = {r["hash"]: r["state"] for r in out}
    assert states["b98"] == "pending" and states["f5"] == "rejected" and states["f5x"] == "pending"


def test_first_sibling_wins(spark):
    pairs = [("f2", "b1"), ("b2", "b1"), ("b1", "b0"), ("b3", "b2")]
    out = {r["hash"]: (r["state"], r["height"]) for r in chain.order_blocks(frame(spark, pairs), "b0", 0).collect()}
    assert out == {"b1": ("linked", 1), "f2": ("linked", 2), "b2": ("rejected", None), "b3": ("pending", None)}


def test_nothing_to_link(spark):
    assert chain.order_blocks(frame(spark, []), "b0", 0).count() == 0


def blocks(spark, rows):
    schema = (
        "height bigint, hash string, version bigint, prev_hash string, merkle_root string, timestamp bigint, "
        "bits bigint, nonce bigint"
    )
    return spark.createDataFrame([(n, b, 1, p, "m", t, 1, 1) for n, b, p, t in rows], schema)


def test_gaps_truncation_and_summaries(spark):
    df = blocks(spark, [(1, "a", "x", 10), (2, "b", "a", 20), (3, "c", "q", 30), (4, "d", "c", 40)])
    assert [r["hash"] for r in chain.gaps(df).collect()] == ["c"]
    target = spark.createDataFrame([("c",)], "hash string")
    assert {r["hash"] for r in chain.truncate_at(df, target).collect()} == {"a", "b"}
    assert chain.truncate_at(df, target.limit(0)).count() == 4
    assert chain.max_height(df).first()[0] == 4 and chain.max_height(df.limit(0)).first()[0] == 0
    assert chain.last_block(df).first()["hash"] == "d" and chain.last_block(df.limit(0)).count() == 0
    assert chain.start_timestamp(df, 3).first()[0] == 10
    assert chain.start_timestamp(df, 4).first()[0] is None
    assert chain.chain_tip_reached(df, F.lit(639)).first()[0] is True
    assert chain.chain_tip_reached(df, F.lit(640)).first()[0] is False
    assert chain.chain_tip_reached(df.limit(0), F.lit(1)).first()[0] is False
    shifted = chain.renumber_heights(df, 100, 3)
    assert [r["height"] for r in shifted.orderBy("hash").collect()] == [1, 2, 104, 105]


def test_orphans_and_roll_back(spark):
    df = blocks(spark, [(1, "a", "x", 10), (2, "b", "a", 20), (3, "c", "b", 30)])
    late = blocks(spark, [(0, "z", "y", 5), (0, "w", "y", 10)])
    assert [r["hash"] for r in chain.orphan_signals(late, df, 2).collect()] == ["z"]
    assert chain.orphan_signals(late, df, 3).count() == 0
    tx = spark.createDataFrame([("t1", 2), ("t2", 3)], "hash string, height bigint")
    utxo = spark.createDataFrame([("t1", 2), ("t2", 3), ("t3", -1)], "hash string, height int")
    kept, kept_tx, kept_utxo, orphan = chain.roll_back_tip(df, tx, utxo)
    assert {r["hash"] for r in kept.collect()} == {"a", "b"}
    assert {r["hash"] for r in kept_tx.collect()} == {"t1"}
    assert {r["hash"] for r in kept_utxo.collect()} == {"t1", "t3"}
    assert orphan.first()["hash"] == "c"
