"""Schemas of the tables at rest, as DDL. Hashes are 64 hex digits."""

TABLES = {
    "blocks": (
        "height bigint, hash string, version bigint, prev_hash string, merkle_root string, timestamp bigint, "
        "bits bigint, nonce bigint, offset bigint, blocksize bigint, numtxs bigint"
    ),
    "orphans": (
        "height bigint, hash string, version bigint, prev_hash string, merkle_root string, timestamp bigint, "
        "bits bigint, nonce bigint, created_at timestamp"
    ),
    "tx": "hash string, height bigint, blockindex bigint, txsize bigint, satoshis bigint",
    "mempool": "hash string, locktime bigint, fee bigint, time bigint, tx string",
    "utxo": "hash string, pos bigint, satoshis bigint, height int, pubkeyhash string",
    "collection": "hash string, name string, tx string",
    "connect": "date string, ip string, event string",
    "addr": "ip string, services bigint, port int",
}
