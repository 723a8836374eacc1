"""Merkle manifest against a plain tree, at several block sizes, with odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from outpoint.llm import merkle_manifest as M

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The last node, and the siblings of each node on the way up."""
    ways = [[] for _ in nodes]
    at, below = list(range(len(nodes))), nodes
    while len(below) > 1:
        runs = [below[i : i + 2] for i in range(0, len(below), 2)]
        for k, i in enumerate(at):
            other = i ^ 1
            ways[k].append(below[other] if other < len(below) else "")
            at[k] = i // 2
        below = [h(*r) for r in runs]
    return below[0], ways


def plain(rows):
    """(doc_id, leaf, subroot, root, hash of the proof) per row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, found = [], []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, ways = climb([leaf(r) for r in groups[g]])
        tops.append(top)
        found.append(ways)
    root, over = climb(tops)
    out = []
    for g, top, ways, rest in zip(names, tops, found, over, strict=True):
        out += [(r[0], leaf(r), top, root, h(*way, *rest)) for r, way in zip(groups[g], ways, strict=True)]
    return out


def proven(df):
    siblings = F.array_join(F.transform("proof", lambda s: s["node"]), "")
    out = df.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("way"), (M.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"))
    rows = out.collect()
    assert all(r.ok for r in rows)
    return sorted([tuple(r)[:5] for r in rows], key=str)


def many(sizes):
    langs = [None, "", "de", "en", "Ä", "zz"]
    rows, i = [], 0
    for lang, size in zip(langs, sizes, strict=False):
        for _ in range(size):
            rows.append((i * 7919 % 100_003, f"src{i % 3}" if i % 5 else None, lang, None if i % 11 == 0 else i, None if i % 13 == 0 else f"té xt {i}"))
            i += 1
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("levels", [1, 2, 8])
@pytest.mark.parametrize("sizes", [(1,), (5, 1, 17, 64, 2, 33), (0, 0, 300, 3)])
def test_against_a_plain_tree(spark, monkeypatch, levels, sizes):
    monkeypatch.setattr(M, "LEVELS", levels)
    monkeypatch.setattr(M, "BLOCK", 1 << levels)
    rows = many(sizes)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert proven(M.manifest(df)) == sorted(plain(rows), key=str)


def test_repeats_nulls_extra_columns_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 2)
    monkeypatch.setattr(M, "BLOCK", 4)
    rows = [(None, None, None, None, None)] * 3 + [(5, "a", "en", 1, "x")] * 6 + [(5, "b", "en", 1, "é" * 70_000), (4, "b", "en", 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.withColumns({c: F.lit(1) for c in ("node", "at", "kept", "block", "g", "proof", "root")})
    assert proven(M.manifest(clashing)) == sorted(plain(rows), key=str)
    assert M.manifest(df.limit(0)).count() == 0


def test_every_change_is_noticed(spark):
    rows = many((3, 2, 40))
    root = {r[3] for r in plain(rows)}
    for column, value in ((1, "other"), (2, "de2"), (3, 12345), (4, "")):
        changed = [tuple(value if i == column else v for i, v in enumerate(r)) if k == 20 else r for k, r in enumerate(rows)]
        found = {r[3] for r in proven(M.manifest(spark.createDataFrame(changed, SCHEMA)))}
        assert len(found) == 1 and found != root


def test_tampered_rows_fail_their_proof(spark):
    rows = M.op13_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        touched = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and docs[r.doc_id].n_chars is not None
        assert r.verified is not touched and (r.folded_root == r.root) is r.verified
    assert {r.verified for r in rows} == {True, False}
