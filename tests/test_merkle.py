import hashlib
import json

import pytest
from pyspark.sql import functions as F

from outpoint.operators import merkle
from outpoint.sources.keyed import KeyedTable

# Transaction ids and branches that must come out exactly so.
LEAVES_2 = [
    "931475bee79c76509ccb01916998009c93afd54f4bcce431299848b473d53aef",
    "d3dc8224dc896986cebb8bf78cb658c8ca7b85c1b99077d835dee5f81424e7b9",
]
LEAVES_3 = [
    "779d313658cd99d9adb8446521552301e5bb29eb74eff84d562c9954885d6747",
    "791161487f7411a3a937f287cab52b22ff4ca223c2409af4b99587c8b694560d",
    "f3ff50949f82b6eaa0fc8dc0d4764687117128c3cee73025b13ed1bd88f4e1d7",
]
LEAVES_5 = [
    "eafcf1a1e2c8694433fdec50fdb0020c89decd2049d5bfad2cb0d5f61f00a049",
    "48a1542f7f2b8385a049a28635ab4276ebcaf424dd4b37506e9af816de20f234",
    "507a38f1f380107f4e5039f0204b49cf23f676f80ef9a97cf5fdaa275099db45",
    "bead66e14d905be19b64c4b26dd19d5db6127ffb7a5f019ce1856f97278e8eae",
    "c16407dc758f6d35d1502cecf0546d17e17679c12e9500217986e5c32f56e694",
]
EXPECTED = {
    LEAVES_2[0]: [(LEAVES_2[1], "R")],
    LEAVES_2[1]: [(LEAVES_2[0], "L")],
    LEAVES_3[0]: [(LEAVES_3[1], "R"), ("553e149e13bf81daa893e2517d5f438f1ccb166c405e214ca7a1d2fc31c284dd", "R")],
    LEAVES_3[1]: [(LEAVES_3[0], "L"), ("553e149e13bf81daa893e2517d5f438f1ccb166c405e214ca7a1d2fc31c284dd", "R")],
    LEAVES_3[2]: [(LEAVES_3[2], "L"), ("7109e178183e6198b293ed261e370ba3f353038e557baac317f017b5420ff2c5", "L")],
    LEAVES_5[0]: [
        (LEAVES_5[1], "R"),
        ("4fe7355a0a96b6f1a415bc8d91f5f6a586701692f4e4e8c96f712d70324aa275", "R"),
        ("074e67ffa1feb37c979aac90f43174a7bac0399c833da0d9bf257072b9186bc0", "R"),
    ],
    LEAVES_5[4]: [
        (LEAVES_5[4], "L"),
        ("76bcb15456f4efbcae13a5c3e0205358d92f50d4c98f4a7c574bcb11bbcd24b1", "L"),
        ("40a129b27ab77c3dff72dc3e459c3f30293dafd54b5a0ae93779433265368422", "L"),
    ],
}
PROOF = json.loads(
    '{"merkle_root":"847e947a615689a7b4c0bf09ad85c20c6206d1eab25d11d78cde0a298525674f",'
    '"tx_hash":"ff4d80f428d244bbd313d14f6b3502e740f3e1dc4768b3115b8cf3734e586856","branches":['
    '{"hash":"0bd3573b03203754d77f7d6c47a35e81d53bf149f015ad43ceae1e7a14b2a1d2","pos":"L"},'
    '{"hash":"e32b529f9573bd30443ee499c96756fa605a3041845e4628e0aab49833598e9e","pos":"L"},'
    '{"hash":"1efc9dc86232dc76ab61cd6bda4e9507db5da9ef1aaba760e15b108b66a0f093","pos":"R"},'
    '{"hash":"a9ed5525642b47cbe3abe4242da3f0fdbc60b86e2ead1be4b22002f4207f9a62","pos":"R"},'
    '{"hash":"487859b95cccaddc17172c0c02ebdb234ff25e9e3c6ba2f7dd8036d0eb9dcdad","pos":"R"},'
    '{"hash":"c86e37aaa832608ec063e740edea0c6d9507057d00ec904be4a34c2f1fe932dc","pos":"R"},'
    '{"hash":"3d40e87a98db919283965773b132105cc33ca3123ed2cc562c2de98c6f3385a7","pos":"R"},'
    '{"hash":"c0d43f577fde226685f3a208889e7039d1cf786320218f3d565cb468ccdde511","pos":"R"}]}'
)


def brute_root(leaves):
    row = [bytes.fromhex(x)[::-1] for x in leaves]
    while len(row) > 1:
        row = row + row[-1:] if len(row) % 2 else row
        pairs = zip(row[::2], row[1::2])
        row = [hashlib.sha256(hashlib.sha256(a + b).digest()).digest() for a, b in pairs]
    return row[0][::-1].hex()


def blocks_of(spark, groups):
    txs = [(x, height, i) for height, leaves in groups.items() for i, x in enumerate(leaves)]
    heads = [(height, f"block{height}", brute_root(leaves), len(leaves)) for height, leaves in groups.items()]
    return (
        spark.createDataFrame(txs, "hash string, height bigint, blockindex bigint"),
        spark.createDataFrame(heads, "height bigint, hash string, merkle_root string, numtxs bigint"),
    )


def test_golden_branches(spark, h):
    txs, blocks = blocks_of(spark, {1: LEAVES_2, 2: LEAVES_3, 3: LEAVES_5, 4: [h("alone")]})
    keys = spark.createDataFrame([(x,) for x in [*EXPECTED, h("alone"), h("nowhere")]], "hash string")
    found = {r["tx_hash"]: r for r in merkle.merkle_proofs(keys, txs, blocks).collect()}
    for tx, branches in EXPECTED.items():
        assert [tuple(b) for b in found[tx]["branches"]] == branches
    assert found[h("alone")]["branches"] == []
    assert not found[h("nowhere")]["found"] and found[h("nowhere")]["branches"] is None


def test_eight_level_proof(spark):
    df = spark.createDataFrame(
        [(PROOF["tx_hash"], PROOF["merkle_root"], [(b["hash"], b["pos"]) for b in PROOF["branches"]])],
        "tx_hash string, merkle_root string, branches array<struct<hash:string,pos:string>>",
    )
    assert merkle.verify_merkle_proofs(df).first()["verified"]
    assert not merkle.verify_merkle_proofs(df.withColumn("tx_hash", F.lit("0" * 64))).first()["verified"]


@pytest.mark.parametrize("span", [1, 2, 10])
def test_any_size_in_any_chunks(spark, h, monkeypatch, span):
    monkeypatch.setattr(merkle, "SPAN_LEVELS", span)
    groups = {n: [h(f"{n}/{i}") for i in range(n)] for n in (1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33)}
    txs, blocks = blocks_of(spark, groups)
    roots = {r["height"]: r["merkle_root"] for r in merkle.merkle_roots(txs).collect()}
    assert roots == {n: brute_root(leaves) for n, leaves in groups.items()}
    proofs = merkle.verify_merkle_proofs(merkle.merkle_proofs(txs.select("hash"), txs, blocks)).collect()
    assert len(proofs) == txs.count() and all(p["verified"] for p in proofs)
    depth = {h(f"{n}/0"): (n - 1).bit_length() for n in groups}
    assert all(len(p["branches"]) == depth[p["tx_hash"]] for p in proofs if p["tx_hash"] in depth)


def test_whole_block_check(spark):
    txs, blocks = blocks_of(spark, {1: LEAVES_2, 2: LEAVES_3, 3: LEAVES_5})
    blocks = blocks.withColumn("merkle_root", F.when(F.col("height") == 2, "00").otherwise(F.col("merkle_root")))
    bad = spark.createDataFrame([(3,), (3,)], "height bigint")
    checked = merkle.check_blocks(blocks, merkle.merkle_roots(txs), bad, F.lit(True))
    assert {r["height"]: r["valid"] for r in checked.collect()} == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("span", [1, 2, 10])
def test_kept_trees_give_the_same_proofs(spark, tmp_path, monkeypatch, h, span):
    monkeypatch.setattr(merkle, "SPAN_LEVELS", span)
    rows = [(h(f"{height}-{i}"), height, i) for height, n in ((1, 1), (2, 5), (3, 16), (7, 9)) for i in range(n)]
    txs = spark.createDataFrame(rows, "hash string, height bigint, blockindex bigint")
    roots = merkle.merkle_roots(txs)
    blocks = roots.select("height", F.concat(F.lit("b"), F.col("height").cast("string")).alias("hash"), "merkle_root")
    trees = KeyedTable(spark, str(tmp_path / "trees"), merkle.TREES, merkle.TREE_KEYS)
    trees.upsert(merkle.tree_rows(txs.filter("height < 7")))
    trees.upsert(merkle.tree_rows(txs.filter("height = 7")))
    keys = txs.filter("blockindex % 3 = 0").select("hash").unionByName(spark.createDataFrame([(h("no"),)], "hash string"))
    asked = txs.join(keys, "hash", "left_semi")
    kept = merkle.merkle_proofs(keys, asked, blocks, trees)
    folded = merkle.merkle_proofs(keys, txs, blocks)
    in_order = lambda df: sorted(map(str, df.select(*folded.columns).collect()))
    assert in_order(kept) == in_order(folded)
    assert merkle.verify_merkle_proofs(kept.filter("found")).filter("not verified").count() == 0
