"""The same answers as DuckDB SQL over the star-schema tables.

``CTES`` holds the ledger view and tables derived from it; ``sql`` puts those
a query names, and those they need, in front of it.
"""

from __future__ import annotations

import re

CUT = 883612800  # 1998-01-01, the moment between "stored" and "new" rows
NOW = 1009843200  # 2002-01-01
START_HASH = "sha256('b:1000')"


def rev(h: str) -> str:
    return f"array_to_string(list_reverse(regexp_extract_all({h}, '..')), '')"


def h256(h: str) -> str:
    """Double SHA-256 of hex, as hex in the same byte order."""
    return f"sha256(unhex(sha256(unhex({h}))))"


def le(x: str, width: int) -> str:
    digits = f"lpad(lower(to_hex(({x})::BIGINT)), 16, '0')"
    return "(" + " || ".join(f"substr({digits}, {15 - 2 * i}, 2)" for i in range(width)) + ")"


def csize(n: str) -> str:
    return (
        f"(CASE WHEN {n} < 253 THEN {le(n, 1)} WHEN {n} <= 65535 THEN 'fd' || {le(n, 2)} "
        f"WHEN {n} <= 4294967295 THEN 'fe' || {le(n, 4)} ELSE 'ff' || {le(n, 8)} END)"
    )


def utc(x: str) -> str:
    return f"strftime(TIMESTAMP '1970-01-01' + to_seconds({x}), '%Y-%m-%d %H:%M:%S')"


def hex8(x: str) -> str:
    return f"lpad(lower(to_hex(({x})::BIGINT)), 8, '0')"


def ctime(x: str) -> str:
    t = f"(TIMESTAMP '1970-01-01' + to_seconds({x}))"
    return f"strftime({t}, '%a %b ') || lpad(day({t})::VARCHAR, 2, ' ') || strftime({t}, ' %H:%M:%S %Y')"


def pkh_of(script: str) -> str:
    return (
        f"(CASE WHEN regexp_full_match({script}, '76a914[0-9a-f]{{40}}88ac') "
        f"THEN substr({script}, 7, 40) ELSE 'unknown' END)"
    )


HEADER = "(" + " || ".join(
    [le("version", 4), rev("prev_hash"), rev("merkle_root"), le("timestamp", 4), le("bits", 4), le("nonce", 4)]
) + ")"

BLOCK_RECORD = (
    f"height, hash, {hex8('version')} AS version, prev_hash, merkle_root, {ctime('timestamp')} AS time, "
    f"{hex8('bits')} AS bits, {hex8('nonce')} AS nonce, blocksize, numtxs"
)

SERVICES = [
    ("NODE_BITCOIN_CASH", 32),
    ("NODE_BLOOM", 4),
    ("NODE_COMPACT_FILTERS", 64),
    ("NODE_GETUTXO", 2),
    ("NODE_NETWORK", 1),
    ("NODE_NETWORK_LIMITED", 1024),
    ("NODE_WITNESS", 8),
    ("NODE_XTHIN", 16),
]


def services(x: str) -> str:
    """Names in sorted order, joined by commas."""
    named = ", ".join(f"CASE WHEN ({x} & {mask}) <> 0 THEN '{name}' END" for name, mask in SERVICES)
    return f"CASE WHEN {x} = 0 THEN 'NODE_NONE' ELSE concat_ws(',', {named}) END"


def inv_type(x: str) -> str:
    return (
        f"CASE {x} WHEN 1 THEN 'TX' WHEN 2 THEN 'BLOCK' WHEN 3 THEN 'FILTERED_BLOCK' WHEN 4 THEN 'CMPCT_BLOCK' "
        f"ELSE 'unknown obj_type ' || {x} END"
    )


CTES = {
    "o": "SELECT o_orderkey okey, o_custkey ckey, o_orderdate odate, o_orderstatus = 'P' is_mem, "
    "o_orderpriority = '1-URGENT' submitted FROM orders",
    "hts": "SELECT odate, 1000 + row_number() OVER (ORDER BY odate) height "
    "FROM (SELECT DISTINCT odate FROM o WHERE NOT is_mem)",
    "txs": """SELECT sha256('tx:' || o.okey) hash, CASE WHEN is_mem THEN -1 ELSE hts.height END height,
      CASE WHEN NOT is_mem THEN row_number() OVER (PARTITION BY is_mem, o.odate ORDER BY o.okey) - 1 END blockindex,
      is_mem, epoch(o.odate)::BIGINT AS time, submitted, o.okey, o.ckey,
      (CASE WHEN is_mem THEN 4611686018427387904 ELSE 0 END
        + (epoch(o.odate)::BIGINT // 86400) * 1099511627776 + o.okey)::BIGINT seq,
      lag(o.okey) OVER (PARTITION BY o.ckey ORDER BY is_mem, o.odate, o.okey) prev_okey
      FROM o LEFT JOIN hts ON o.odate = hts.odate""",
    "items": """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_quantity, l_extendedprice, l_shipdate, l_returnflag, l_linestatus) - 1 pos FROM lineitem""",
    "outs": """SELECT t.hash, i.pos, floor(l_extendedprice * 100 + 0.5)::BIGINT satoshis,
      CASE WHEN l_returnflag = 'A' THEN '76a914' || substr(sha256('c:' || t.ckey), 1, 40) || '88ac'
        WHEN l_returnflag = 'R' THEN '7576a914' || substr(sha256('c:' || t.ckey), 1, 40) || '88ac'
        WHEN l_returnflag = 'N' AND l_linestatus = 'O'
          THEN '76a914' || substr(sha256('s:' || l_suppkey), 1, 40) || '88ac'
        ELSE '006a0a436f437631' || substr(sha256('d:' || l_partkey), 1, 10) END script_hex,
      t.height, t.blockindex, t.seq, t.okey FROM items i JOIN txs t ON i.l_orderkey = t.okey""",
    "ins": """SELECT t.hash, p.pos // 2 vin, p.hash prev_hash, p.pos prev_index, t.height, t.blockindex, t.seq
      FROM txs t JOIN outs p ON t.prev_okey = p.okey WHERE p.pos % 2 = 0
      UNION ALL SELECT hash, 0, sha256('ext:' || okey), 0, height, blockindex, seq FROM txs WHERE prev_okey IS NULL""",
    "sizes": """SELECT t.*, coalesce(nin, 0) nin, coalesce(nout, 0) nout, coalesce(s.satoshis, 0)::BIGINT satoshis,
      (10 + 148 * coalesce(nin, 0) + 34 * coalesce(nout, 0))::BIGINT txsize FROM txs t
      LEFT JOIN (SELECT hash, count(*) nout, sum(satoshis)::BIGINT satoshis FROM outs GROUP BY hash) s ON t.hash = s.hash
      LEFT JOIN (SELECT hash, count(*) nin FROM ins GROUP BY hash) n ON t.hash = n.hash""",
    "tx": "SELECT hash, height, blockindex, txsize, satoshis FROM sizes WHERE NOT is_mem",
    "lv": f"""SELECT height, 0 AS lvl, blockindex pos, {rev('hash')} node FROM txs WHERE NOT is_mem
      UNION ALL SELECT height, lvl + 1, pos // 2, {h256('min_by(node, pos) || max_by(node, pos)')}
      FROM (SELECT *, count(*) OVER (PARTITION BY height) n FROM lv) WHERE n > 1 GROUP BY height, lvl, pos // 2""",
    "roots": f"SELECT height, {rev('arg_max(node, lvl)')} merkle_root FROM lv GROUP BY height",
    "blocks": """SELECT s.height, sha256('b:' || s.height) hash, 1::BIGINT AS version,
      sha256('b:' || (s.height - 1)) prev_hash, merkle_root, timestamp, 486604799::BIGINT bits, s.height nonce,
      (sum(blocksize) OVER (ORDER BY s.height) - blocksize)::BIGINT AS "offset", blocksize, numtxs
      FROM (SELECT height, max(time) AS timestamp, (sum(txsize) + 80)::BIGINT blocksize, count(*) numtxs
        FROM sizes WHERE NOT is_mem GROUP BY height) s JOIN roots r ON s.height = r.height""",
    "arrivals": """SELECT hash, prev_hash, height, timestamp, ((height * 7919) % 10007)::DOUBLE arrival FROM blocks
      UNION ALL SELECT sha256('fork:' || height), prev_hash, height, timestamp, (height * 7919) % 10007 + 0.5
      FROM blocks WHERE height % 100 = 0""",
    "created": f"""SELECT hash, pos, satoshis, height::INTEGER height, {pkh_of('script_hex')} pubkeyhash
      FROM outs WHERE NOT starts_with(script_hex, '006a')""",
    "spent": "SELECT DISTINCT prev_hash hash, prev_index pos FROM ins WHERE blockindex IS DISTINCT FROM 0",
    "utxo": "SELECT * FROM created c WHERE NOT EXISTS "
    "(SELECT 1 FROM spent s WHERE s.hash = c.hash AND s.pos = c.pos)",
    "fees": """SELECT f.hash, CASE WHEN missing > 0 THEN 0 ELSE greatest(0, paid - coalesce(made, 0)) END::BIGINT fee
      FROM (SELECT i.hash, sum(c.satoshis) paid, count(*) FILTER (c.hash IS NULL) missing FROM ins i
        LEFT JOIN created c ON c.hash = i.prev_hash AND c.pos = i.prev_index GROUP BY i.hash) f
      LEFT JOIN (SELECT hash, sum(satoshis) made FROM outs GROUP BY hash) m ON f.hash = m.hash""",
    "mempool": "SELECT t.hash, 0::BIGINT locktime, coalesce(fee, 0) fee, t.time FROM txs t "
    "LEFT JOIN fees f ON t.hash = f.hash WHERE is_mem",
    "own": """SELECT hash, min(CASE WHEN regexp_matches(script_hex, '7576a914[0-9a-f]{40}88ac$') THEN 0
        WHEN regexp_matches(script_hex, '006a[0-9a-f]{2}436f437631[0-9a-f]*') THEN 1
        WHEN regexp_matches(script_hex, '76a9140[0-9a-f]{39}88ac') THEN 2 END) own FROM outs GROUP BY hash""",
    "parents": "SELECT DISTINCT i.hash, t.okey prev_okey FROM ins i JOIN txs t ON i.prev_hash = t.hash",
    # A customer's transactions form a chain, so one walk along it settles all.
    "walk": """SELECT t.hash, t.okey, own.own AS pri FROM txs t LEFT JOIN own ON t.hash = own.hash
        LEFT JOIN parents p ON t.hash = p.hash WHERE p.hash IS NULL
      UNION ALL SELECT t.hash, t.okey,
        CASE WHEN w.pri = 1 THEN least(coalesce(own.own, 1), 1) ELSE own.own END
      FROM walk w JOIN parents p ON p.prev_okey = w.okey JOIN txs t ON t.hash = p.hash
      LEFT JOIN own ON t.hash = own.hash""",
    "collection": """SELECT w.hash, CASE w.pri WHEN 0 THEN 'johns' WHEN 1 THEN 'CoCv1' WHEN 2 THEN 'zero'
        ELSE 'broadcast' END AS name FROM walk w JOIN txs t ON w.hash = t.hash WHERE w.pri IS NOT NULL OR t.submitted""",
    "parts": f"""SELECT hash, 0 part, {le('1', 4)} || {csize('nin')} digits FROM sizes
      UNION ALL SELECT hash, vin + 1, {rev('prev_hash')} || {le('prev_index', 4)} || '00' || 'ffffffff' FROM ins
      UNION ALL SELECT hash, nin + 1, {csize('nout')} FROM sizes
      UNION ALL SELECT o.hash, nin + 2 + pos, {le('o.satoshis', 8)} || {csize('(length(script_hex) // 2)')} || script_hex
        FROM outs o JOIN sizes s ON o.hash = s.hash
      UNION ALL SELECT hash, nin + nout + 2, '00000000' FROM sizes""",
    "raw": "SELECT hash, string_agg(digits, '' ORDER BY part) tx FROM parts GROUP BY hash",
    "wire": f"""SELECT b.height, b.hash, {HEADER} || {csize('numtxs')} || body digits, {HEADER} header
      FROM blocks b JOIN (SELECT t.height, string_agg(r.tx, '' ORDER BY t.blockindex) body
        FROM tx t JOIN raw r ON t.hash = r.hash GROUP BY t.height) x ON b.height = x.height""",
    "wire_index": """SELECT *, length(digits) // 2 size,
      (sum(length(digits) // 2) OVER (ORDER BY height) - length(digits) // 2)::BIGINT AS "offset" FROM wire""",
    "keys": "SELECT hash FROM txs UNION ALL SELECT sha256('no tx:' || okey) FROM txs",
    "peers": """SELECT event_id, ts, epoch_us(ts) // 1000000 AS seconds, user_id, event_type,
      '10.0.' || (user_id // 256) || '.' || (user_id % 256) ip, event_id % 2048 services, 8333 port,
      CASE event_type WHEN 'signup' THEN 'Connected' WHEN 'error' THEN 'Disconnected' ELSE 'Inv' END kind,
      CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 END code FROM events""",
    "addr": """SELECT ip, arg_min(services, (ts, event_id)) services, 8333 port FROM peers GROUP BY ip""",
    "dirty": """SELECT o_orderkey okey, CASE o_orderpriority WHEN '1-URGENT' THEN upper(sha256('tx:' || o_orderkey))
      WHEN '2-HIGH' THEN substr(sha256('tx:' || o_orderkey), 2) WHEN '3-MEDIUM' THEN sha256('tx:' || o_orderkey) || chr(10)
      WHEN '4-NOT SPECIFIED' THEN 'g' || substr(sha256('tx:' || o_orderkey), 2)
      ELSE sha256('tx:' || o_orderkey) END value FROM orders""",
    "static_monitors": """SELECT n_nationkey::BIGINT AS position, n_name AS name, n_regionkey = 1 track_descendants,
      NULL::VARCHAR address, CASE WHEN n_regionkey <> 2 THEN '76a914' || substr(sha256('n:' || n_nationkey), 1, 2) END
      locking_script_pattern FROM nation""",
    "dynamic_monitors": """SELECT s_suppkey::BIGINT AS position, 'supplier-' || s_suppkey AS name, s_nationkey = 1
      track_descendants, NULL::VARCHAR address, '76a914' || substr(sha256('s:' || s_suppkey), 1, 40) || '88ac'
      locking_script_pattern FROM supplier""",
    "monitor_list": """SELECT 0 stage, * FROM static_monitors WHERE locking_script_pattern IS NOT NULL
      UNION ALL SELECT 1, * FROM dynamic_monitors
      UNION ALL SELECT 2, 0, 'broadcast', false, NULL, NULL""",
    "linked": f"""SELECT hash, 1 AS distance FROM arrivals WHERE prev_hash = {START_HASH}
      UNION ALL SELECT e.hash, l.distance + 1 FROM linked l JOIN eldest e ON e.prev_hash = l.hash""",
    "eldest": "SELECT prev_hash, arg_min(hash, arrival) hash FROM arrivals GROUP BY prev_hash",
}


def sql(body: str) -> str:
    needed: list[str] = []

    def visit(text: str, me: str | None = None) -> None:
        for name in CTES:
            if name != me and name not in needed and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name], name)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + body


def _queries() -> dict[str, str]:
    q: dict[str, str] = {}
    branches = """SELECT k.hash, string_agg(coalesce(s.show, own.show) || ':' ||
        CASE WHEN s.node IS NOT NULL AND own.pos % 2 = 0 THEN 'R' ELSE 'L' END, ',' ORDER BY own.lvl) branches
      FROM (SELECT t.hash, t.height, t.blockindex FROM tx t) k
      JOIN shown own ON own.height = k.height AND own.pos = k.blockindex // power(2, own.lvl)::BIGINT AND own.lvl < own.depth
      LEFT JOIN shown s ON s.height = k.height AND s.lvl = own.lvl AND s.pos = xor(own.pos, 1::BIGINT)
      GROUP BY k.hash"""
    shown = f"""(SELECT *, {rev('node')} AS show, max(lvl) OVER (PARTITION BY height) depth FROM lv)"""
    proofs = branches.replace("shown own", shown + " own").replace("shown s ", shown + " s ")

    # Sources
    file_rows = 'SELECT "offset", size, sha256(unhex(digits)) digest FROM wire_index'
    q["s1_read_blocks"] = file_rows
    q["s2_index_blocks"] = f'SELECT {rev(h256("header"))} hash, "offset", size FROM wire_index'
    q["s2_frame_blocks"] = q["s2_index_blocks"]
    q["s3_fetch_blocks"] = file_rows
    q["s4_scan_blocks"] = "SELECT * FROM blocks"
    q["s5_scan_tx"] = "SELECT hash, height FROM tx"
    q["s6_scan_mempool"] = "SELECT hash, time FROM mempool"
    q["s7_scan_utxo"] = "SELECT * FROM utxo"
    q["s8_scan_collection"] = "SELECT hash FROM collection WHERE name = 'CoCv1'"
    q["s9_scan_addr"] = "SELECT ip FROM addr"
    q["s10_event_routes"] = "SELECT kind AS event_type, event_id FROM peers"
    q["s11_monitor_source"] = "SELECT * FROM monitor_list"

    # Table maintenance
    q["k1_append_blocks"] = f"SELECT hash, height FROM blocks WHERE timestamp >= {CUT}"
    q["k2_append_txs"] = (
        f"SELECT t.* FROM tx t JOIN blocks b ON t.height = b.height WHERE b.timestamp >= {CUT}"
    )
    q["k3_utxo_upsert"] = "SELECT * FROM created"
    q["k4_utxo_delete"] = "SELECT * FROM utxo"
    q["k5_mempool_insert"] = (
        f"SELECT m.*, r.tx FROM mempool m JOIN raw r ON m.hash = r.hash WHERE m.time >= {CUT}"
    )
    q["k6_mempool_delete"] = "SELECT hash, time FROM txs WHERE is_mem"
    q["k7_orphan_insert"] = (
        "SELECT height, hash, version, prev_hash, merkle_root, timestamp, bits, nonce FROM blocks "
        f"WHERE timestamp >= {CUT}"
    )
    q["k8_delete_blocks"] = f"SELECT height, hash FROM blocks WHERE timestamp < {CUT}"
    q["k9_delete_txs"] = (
        f"SELECT t.* FROM tx t JOIN blocks b ON t.height = b.height WHERE b.timestamp < {CUT}"
    )
    q["k10_delete_utxo"] = (
        f"SELECT u.* FROM utxo u LEFT JOIN blocks b ON u.height = b.height "
        f"WHERE b.height IS NULL OR b.timestamp < {CUT}"
    )
    q["k11_collection_insert"] = (
        "SELECT c.hash, c.name, r.tx FROM collection c JOIN txs t ON c.hash = t.hash JOIN raw r ON c.hash = r.hash "
        f"WHERE t.time >= {CUT}"
    )
    q["k12_connection_log"] = (
        f"SELECT {utc('seconds')} AS date, ip, CASE kind WHEN 'Connected' THEN 'Connect' ELSE 'Disconnect' END AS event "
        "FROM peers WHERE kind <> 'Inv'"
    )
    q["k13_peer_append"] = (
        "SELECT * FROM addr WHERE ip NOT IN (SELECT ip FROM peers WHERE ts < TIMESTAMP '2024-01-01 04:00:00')"
    )
    q["k14_write_blocks"] = 'SELECT height, "offset", size FROM wire_index'

    # Scalar functions
    q["p1_decode_tx"] = """SELECT hash, 'in' AS kind, vin AS n, prev_hash AS ref, prev_index AS amount FROM ins
      UNION ALL SELECT hash, 'out', pos, script_hex, satoshis FROM outs
      UNION ALL SELECT hash, 'tx', 1, NULL, 0 FROM txs"""
    q["p2_encode_tx"] = (
        "SELECT hash, (part // 4096)::BIGINT chunk, string_agg(digits, '' ORDER BY part) tx FROM parts GROUP BY ALL"
    )
    q["p3_decode_block"] = f"""SELECT t.height, t.blockindex, (80 + length({csize('numtxs')}) // 2 + sum(length(r.tx) // 2)
        OVER (PARTITION BY t.height ORDER BY t.blockindex) - length(r.tx) // 2)::BIGINT tx_offset,
      length(r.tx) // 2 tx_size, {rev(h256('r.tx'))} txid, b.prev_hash, b.merkle_root, b.timestamp, b.numtxs
      FROM tx t JOIN raw r ON t.hash = r.hash JOIN blocks b ON t.height = b.height"""
    q["p4_hash256"] = "SELECT doc_id, sha256(unhex(sha256(text))) digest FROM documents"
    q["p5_txid"] = f"SELECT hash, {rev(h256('tx'))} txid FROM raw"
    q["p6_header_hex"] = f"SELECT height, {HEADER} header FROM blocks"
    q["p7_reverse_hex"] = f"SELECT hash, {rev('hash')} reversed FROM txs"
    q["p8_block_hash"] = f"SELECT height, {rev(h256(HEADER))} header_hash FROM blocks"
    q["p9_hex"] = (
        "SELECT event_id, lower(hex(props)) encoded, props AS decoded, true AS rejected FROM events"
    )
    q["p10_script_to_pubkeyhash"] = f"SELECT hash, pos, {pkh_of('script_hex')} pubkeyhash FROM outs"
    q["p11_address_to_pubkeyhash"] = """SELECT c_custkey, c_acctbal >= 0 AS valid,
      CASE WHEN c_acctbal >= 0 THEN substr(sha256('c:' || c_custkey), 1, 40) END pubkeyhash,
      CASE WHEN c_acctbal < 0 THEN 'bad address' END reason FROM customer"""
    q["p12_address_to_lock_script"] = """SELECT c_custkey,
      CASE WHEN c_acctbal >= 0 AND c_mktsegment <> 'BUILDING'
        THEN '76a914' || substr(sha256('c:' || c_custkey), 1, 40) || '88ac' END lock_script,
      CASE WHEN c_acctbal < 0 THEN 'bad address' WHEN c_mktsegment = 'BUILDING' THEN 'unsupported address type' END reason
      FROM customer"""
    q["p13_is_spendable"] = "SELECT hash, pos, substr(script_hex, 1, 4) <> '006a' spendable FROM outs"
    q["p14_tx_summary"] = (
        "SELECT r.hash, length(r.tx) // 2 txsize, s.satoshis FROM raw r JOIN sizes s ON r.hash = s.hash"
    )
    q["p15_block_summary"] = (
        "SELECT w.height, w.size blocksize, b.numtxs FROM wire_index w JOIN blocks b ON w.height = b.height"
    )
    q["p16_block_record"] = f"SELECT {BLOCK_RECORD} FROM blocks"
    q["p17_mempool_record"] = f"SELECT hash, locktime, fee, {utc('time')} AS time FROM mempool"
    q["p18_tx_record"] = """SELECT t.hash, '{"version":1,"vin":[' || coalesce(i.j, '') || '],"vout":[' || coalesce(v.j, '')
        || '],"locktime":0}' record FROM txs t
      LEFT JOIN (SELECT hash, string_agg('{"prevout":{"hash":"' || prev_hash || '","n":' || prev_index
        || '},"scriptSig":"","sequence":"ffffffff"}', ',' ORDER BY vin) j FROM ins GROUP BY hash) i ON t.hash = i.hash
      LEFT JOIN (SELECT hash, string_agg('{"value":' || satoshis || ',"scriptPubKey":"' || script_hex || '"}', ','
        ORDER BY pos) j FROM outs GROUP BY hash) v ON t.hash = v.hash"""
    q["p19_block_summary_record"] = (
        f"SELECT r.* EXCLUDE (blocksize, numtxs), t.blockindex, t.hash txid FROM (SELECT {BLOCK_RECORD} FROM blocks) r "
        "JOIN tx t ON r.height = t.height"
    )
    q["p20_timestamp_as_string"] = f"SELECT event_id, {utc('seconds')} shown FROM peers"
    q["p21_delay_as_string"] = (
        f"SELECT hash, (({NOW} - time) // 3600) || ':' || lpad((({NOW} - time) // 60 % 60)::VARCHAR, 2, '0') || ':' || "
        f"lpad((({NOW} - time) % 60)::VARCHAR, 2, '0') AS delay FROM txs"
    )
    q["p22_timestamp_age"] = f"SELECT hash, greatest(0, {CUT} - time)::BIGINT age FROM txs"
    q["p23_decode_services"] = f"SELECT event_id, {services('services')} services FROM peers"
    q["p24_inv_type_name"] = f"SELECT event_id, {inv_type('(event_id % 6)')} AS type FROM events"
    q["p25_compact_to_target"] = """SELECT DISTINCT l_linenumber * 16777216 + l_partkey % 16777216 bits,
      CASE WHEN l_linenumber >= 3 THEN lpad(lower(to_hex(l_partkey % 16777216)) || repeat('00', l_linenumber - 3), 64, '0')
      END target FROM lineitem"""
    q["p26_outpoint"] = "SELECT hash, vin, prev_hash || ':' || prev_index AS prevout FROM ins"

    # Validation
    verdict = "SELECT {id}, reason IS NULL AS valid, reason, CASE WHEN reason IS NULL THEN {value} END AS value FROM ({source})"
    q["v1_check_hash"] = verdict.format(
        id="okey",
        value="lower(value)",
        source="SELECT *, CASE WHEN NOT regexp_full_match(value, '[0-9a-fA-F]{64}') THEN 'not 64 hex digits' END reason "
        "FROM dirty",
    )
    q["v2_check_height"] = verdict.format(
        id="o_orderkey",
        value="value",
        source="SELECT *, CASE WHEN value < 0 THEN 'negative' WHEN value > 100000000 THEN 'too high' END reason "
        "FROM (SELECT o_orderkey, o_orderkey * 7919 - 100000 AS value FROM orders)",
    )
    q["v3_check_monitor_name"] = verdict.format(
        id="c_custkey",
        value="value",
        source="SELECT *, CASE WHEN NOT regexp_full_match(value, '[a-zA-Z0-9_-]{1,64}') THEN 'bad name' END reason "
        "FROM (SELECT c_custkey, c_name AS value FROM customer "
        "UNION ALL SELECT c_custkey, replace(c_name, '#', '-') FROM customer)",
    )
    hex_reason = (
        "CASE WHEN length(value) = 0 OR length(value) % 2 <> 0 THEN 'empty or odd length' "
        "WHEN NOT regexp_full_match(value, '[0-9a-fA-F]+') THEN 'not hex' END"
    )
    q["v4_check_hex"] = verdict.format(
        id="event_id",
        value="lower(value)",
        source=f"SELECT *, {hex_reason} reason FROM (SELECT event_id, CASE event_type WHEN 'view' THEN upper(hex(props)) "
        "WHEN 'click' THEN substr(hex(props), 2) WHEN 'error' THEN '' ELSE props END AS value FROM events)",
    )
    q["v5_check_tx_size"] = verdict.format(
        id="hash",
        value="value",
        source="SELECT hash, tx AS value, CASE WHEN length(tx) / 2 > 300 THEN 'too large' END reason FROM raw",
    )
    q["v6_check_pattern"] = (
        "SELECT doc_id, length(text) BETWEEN 1 AND 512 AS valid, "
        "CASE WHEN NOT length(text) BETWEEN 1 AND 512 THEN 'bad length' END reason FROM documents"
    )
    scaled = "(satoshis - 1000000) * 300000000"
    q["v7_tx_values"] = f"SELECT hash, bool_and({scaled} BETWEEN 0 AND 2100000000000000) AS valid FROM outs GROUP BY hash"
    target = "'00000000ffff0000000000000000000000000000000000000000000000000000'"
    q["v8_proof_of_work"] = f"SELECT height, {rev(h256(HEADER))} <= {target} AS valid FROM blocks"
    q["v9_block_valid"] = (
        f"SELECT hash, height, {rev(h256(HEADER))} <= {target} AS pow_ok, true AS values_ok, true AS merkle_ok, "
        f"{rev(h256(HEADER))} <= {target} AS valid FROM blocks"
    )
    q["v10_quarantine"] = "SELECT okey, value AS hash, regexp_full_match(value, '[0-9a-fA-F]{64}') AS good FROM dirty"
    q["v11_duplicate_tx"] = "SELECT hash, 2::BIGINT AS times FROM tx WHERE height % 100 = 0"
    q["v12_monitor_checks"] = """SELECT 'add' AS action, position, name, reason IS NULL AS valid, reason FROM (
        SELECT *, CASE WHEN NOT regexp_full_match(name, '[a-zA-Z0-9_-]{1,64}') THEN 'bad name'
          WHEN locking_script_pattern IS NULL THEN 'neither address nor pattern'
          WHEN name IN (SELECT name FROM dynamic_monitors) THEN 'name in use' END reason
        FROM (SELECT position, name, locking_script_pattern FROM static_monitors
          UNION ALL SELECT position + 1000000, name, locking_script_pattern FROM dynamic_monitors))
      UNION ALL SELECT 'delete', position, name, reason IS NULL, reason FROM (
        SELECT position, name, CASE WHEN NOT regexp_full_match(name, '[a-zA-Z0-9_-]{1,64}') THEN 'bad name'
          ELSE 'not dynamic' END reason FROM static_monitors
        UNION ALL SELECT position + 1000000, name, NULL FROM dynamic_monitors
        UNION ALL SELECT c_custkey + 2000000, 'customer-' || c_custkey, 'unknown name' FROM customer)"""

    # Joins
    q["j1_utxo_set"] = "SELECT * FROM utxo"
    q["j2_tx_fee"] = "SELECT * FROM fees"
    q["j3_tx_block_offset"] = 'SELECT t.hash, b."offset" FROM tx t JOIN blocks b ON t.height = b.height'
    q["j4_tx_block"] = (
        "SELECT t.hash, t.height, b.hash block_hash, b.merkle_root FROM tx t JOIN blocks b ON t.height = b.height"
    )
    q["j5_spent_flags"] = """SELECT o.hash, o.pos, u.hash IS NULL AS spent, substr(script_hex, 1, 4) <> '006a' spendable
      FROM outs o LEFT JOIN utxo u ON o.hash = u.hash AND o.pos = u.pos"""
    q["j6_tx_position"] = "SELECT k.hash, t.height, t.blockindex FROM keys k LEFT JOIN tx t ON k.hash = t.hash"
    q["j7_mempool_confirmation"] = "SELECT hash, NOT is_mem AS confirmed FROM txs"
    q["j8_tx_exists"] = "SELECT k.hash, t.hash IS NOT NULL AS known FROM keys k LEFT JOIN txs t ON k.hash = t.hash"
    q["j9_monitor_match"] = """SELECT DISTINCT hash, name FROM outs JOIN (VALUES ('johns', '7576a914[0-9a-f]{40}88ac$'),
      ('CoCv1', '006a[0-9a-f]{2}436f437631[0-9a-f]*'), ('zero', '76a9140[0-9a-f]{39}88ac')) m(name, pattern)
      ON regexp_matches(script_hex, pattern)"""
    q["j10_direct_descendants"] = "SELECT DISTINCT hash FROM ins WHERE prev_hash IN (SELECT hash FROM own WHERE own = 1)"
    q["j11_first_match"] = "SELECT hash, own AS priority FROM own WHERE own IS NOT NULL"
    q["j12_descendant_closure"] = "SELECT hash, pri AS priority FROM walk WHERE pri IS NOT NULL"
    q["j13_mempool_dedup"] = "SELECT hash, time FROM mempool UNION ALL SELECT hash, time FROM mempool"
    q["j14_offset_repair"] = 'SELECT hash, "offset" FROM blocks'
    states = """SELECT a.hash, a.prev_hash, CASE WHEN e.hash = a.hash THEN 1000 + l.distance END::BIGINT height,
      CASE WHEN e.hash <> a.hash THEN 'rejected' WHEN l.hash IS NULL THEN 'pending' ELSE 'linked' END AS state
      FROM arrivals a JOIN eldest e ON a.prev_hash = e.prev_hash LEFT JOIN linked l ON a.hash = l.hash"""
    q["j15_chain_linkage"] = states

    # Aggregations
    tip = "(SELECT max(height) FROM blocks)"
    settled = f"height >= 0 AND height <= {tip} - 6"
    sums = (
        f"coalesce(sum(satoshis) FILTER ({settled}), 0)::BIGINT confirmed, "
        f"coalesce(sum(satoshis) FILTER (NOT ({settled})), 0)::BIGINT unconfirmed"
    )
    q["a1_balance"] = f"SELECT pubkeyhash, {sums} FROM utxo GROUP BY pubkeyhash"
    # The tip is off, so the chain is one block shorter.
    shorter = sums.replace(f"{tip} - 6", f"{tip} - 1 - 6")
    q["a1_stream_balance"] = f"SELECT pubkeyhash, {shorter} FROM utxo WHERE height < {tip} GROUP BY pubkeyhash"
    q["a2_status"] = f"""SELECT {utc('b.t')} last_block_time, b.h block_height, (SELECT count(*) FROM tx) number_of_txs,
      (SELECT count(*) FROM utxo) number_of_utxo, (SELECT count(*) FROM mempool) number_of_mempool
      FROM (SELECT arg_max(timestamp, height) t, max(height) h FROM blocks) b"""
    q["a3_max_height"] = "SELECT max(height) AS height FROM blocks"
    q["a4_last_block_time"] = f"SELECT {utc('arg_max(timestamp, height)')} last_block_time FROM blocks"
    q["a5_start_timestamp"] = (
        "SELECT threshold::INTEGER threshold, (SELECT CASE WHEN count(*) > threshold THEN min(timestamp) END FROM blocks) "
        "start_timestamp FROM (VALUES (100), (1000000000)) v(threshold)"
    )
    q["a6_merkle_root"] = "SELECT * FROM roots"
    q["a7_chain_tip_reached"] = (
        "SELECT lag_sec::INTEGER lag_sec, lag_sec < 600 AS caught_up FROM (VALUES (599), (600)) v(lag_sec)"
    )
    q["a8_inventory_counts"] = (
        f"SELECT user_id, {inv_type('code')} AS type, count(*) n FROM peers WHERE kind = 'Inv' GROUP BY user_id, code"
    )

    # Order
    q["w1_positions"] = "SELECT hash, height, blockindex FROM tx"
    q["w2_latest_blocks"] = f"SELECT * FROM (SELECT {BLOCK_RECORD} FROM blocks) ORDER BY height DESC LIMIT 20"
    q["w3_txids_in_order"] = "SELECT height, blockindex, hash txid FROM tx"
    q["w4_gaps"] = """SELECT hash, prev_hash, before FROM (SELECT *, lag(hash) OVER (ORDER BY timestamp, hash) before
      FROM arrivals) WHERE before <> prev_hash"""
    q["w5_time_order"] = (
        "SELECT hash, row_number() OVER (ORDER BY timestamp, hash) - 1 AS position FROM arrivals"
    )
    q["w6_truncate"] = "SELECT height, hash FROM blocks WHERE height < 1500"
    q["w7_heights"] = f"SELECT hash, height FROM ({states}) WHERE state = 'linked'"
    bump = "CASE WHEN height >= 1200 THEN height + 5001 ELSE height END::BIGINT AS height"
    q["w8_renumber"] = (
        f"SELECT 'blocks' AS source, hash, {bump} FROM blocks UNION ALL SELECT 'tx', hash, {bump} FROM tx "
        f"UNION ALL SELECT 'utxo', hash, {bump} FROM utxo"
    )
    q["w9_last_block"] = f"SELECT *, {HEADER} block FROM blocks ORDER BY height DESC LIMIT 1"

    # Lookups
    owner = "customer c {join} utxo u ON u.pubkeyhash = substr(sha256('c:' || c.c_custkey), 1, 40) WHERE c_acctbal >= 0"
    failed = "'bad address' failed FROM customer WHERE c_acctbal < 0"
    q["q1_utxo_by_address"] = f"""SELECT c.c_custkey, u.height, u.pos tx_pos, u.hash tx_hash, u.satoshis AS value, NULL failed
      FROM {owner.format(join="JOIN")} UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, {failed}"""
    q["q2_balance_by_address"] = f"""SELECT c_custkey, {sums}, NULL failed FROM {owner.format(join="LEFT JOIN")}
      GROUP BY c_custkey UNION ALL SELECT c_custkey, NULL, NULL, {failed}"""
    q["q3_utxo_by_tx"] = "SELECT hash, pos, satoshis satoshi, height FROM utxo"
    q["q4_outpoint_unspent"] = """SELECT k.hash, k.pos, u.hash IS NOT NULL unspent FROM (SELECT hash, pos FROM outs
        UNION SELECT prev_hash, prev_index FROM ins) k LEFT JOIN utxo u ON k.hash = u.hash AND k.pos = u.pos"""
    listing = (
        "SELECT {key} AS key, r.*, t.blockindex, t.hash txid, NULL::VARCHAR not_found "
        f"FROM (SELECT {BLOCK_RECORD} FROM blocks) r JOIN tx t ON r.height = t.height "
        "UNION ALL SELECT {bad} AS key, {nulls}, {message} FROM blocks"
    )
    nulls = ", ".join(
        f"NULL::{t}"
        for t in ["BIGINT", *["VARCHAR"] * 7, "BIGINT", "BIGINT", "BIGINT", "VARCHAR"]
    )
    q["q5_block_at_height"] = listing.format(
        key="r.height", bad="-height", nulls=nulls, message="'block height ' || (-height) || ' not found'"
    )
    q["q6_block_at_hash"] = listing.format(
        key="r.hash",
        bad="sha256('no:' || height)",
        nulls=nulls,
        message="'block hash ' || sha256('no:' || height) || ' not found'",
    )
    elements = """SELECT hash, 'in' side, vin n, '' script_hex, prev_hash, prev_index, 4294967295::BIGINT "sequence",
        NULL::BIGINT satoshis, NULL::BOOLEAN spent FROM ins
      UNION ALL SELECT o.hash, 'out', o.pos, o.script_hex, NULL, NULL, NULL, o.satoshis, u.hash IS NULL
      FROM outs o LEFT JOIN utxo u ON o.hash = u.hash AND o.pos = u.pos"""
    q["q7_tx_entry"] = f"""SELECT k.hash, t.height, t.blockindex, CASE WHEN t.hash IS NOT NULL THEN 1::INTEGER END "version",
        CASE WHEN t.hash IS NOT NULL THEN 0::BIGINT END locktime, e.* EXCLUDE (hash),
        CASE WHEN t.hash IS NULL THEN 'Transaction ' || k.hash || ' not found in block' END not_found
      FROM keys k LEFT JOIN tx t ON k.hash = t.hash LEFT JOIN ({elements}) e ON t.hash = e.hash"""
    q["q8_tx_hex"] = """SELECT k.hash, r.tx,
        CASE WHEN t.hash IS NULL THEN 'Transaction ' || k.hash || ' not found in block' END not_found
      FROM keys k LEFT JOIN tx t ON k.hash = t.hash LEFT JOIN raw r ON t.hash = r.hash"""
    q["q9_tx_from_collection"] = f"""SELECT k.hash, CASE WHEN c.hash IS NOT NULL THEN 1::INTEGER END "version",
        CASE WHEN c.hash IS NOT NULL THEN 0::BIGINT END locktime, e.* EXCLUDE (hash),
        CASE WHEN c.hash IS NULL THEN 'Unknown txid ' || k.hash END failed
      FROM keys k LEFT JOIN collection c ON k.hash = c.hash LEFT JOIN ({elements}) e ON c.hash = e.hash"""
    q["q10_hex_from_collection"] = """SELECT k.hash, r.tx, CASE WHEN r.tx IS NULL THEN 'Unknown txid ' || k.hash END failed
      FROM keys k LEFT JOIN collection c ON k.hash = c.hash LEFT JOIN raw r ON c.hash = r.hash"""
    q["q11_merkle_proof"] = f"""SELECT k.hash tx_hash, t.hash IS NOT NULL AS found, b.hash block_hash, b.merkle_root,
        CASE WHEN t.hash IS NOT NULL THEN coalesce(p.branches, '') END branches
      FROM keys k LEFT JOIN tx t ON k.hash = t.hash LEFT JOIN blocks b ON t.height = b.height
      LEFT JOIN ({proofs}) p ON k.hash = p.hash"""
    q["q12_verify_proof"] = "SELECT hash tx_hash, true AS verified FROM tx"
    q["q13_collections_list"] = "SELECT stage, position, name FROM monitor_list WHERE stage < 2"
    q["q14_collection_contents"] = "SELECT name, hash FROM collection"
    q["q15_mempool_list"] = q["p17_mempool_record"]
    q["q16_peers_list"] = f"SELECT ip, services, port, {services('services')} service_names FROM addr"
    q["q17_zero_offset_blocks"] = 'SELECT hash FROM blocks WHERE "offset" = 0'
    q["u1_known_txs"] = (
        "SELECT hash FROM tx UNION ALL SELECT hash FROM mempool UNION ALL SELECT hash FROM collection"
    )
    q["u2_monitor_union"] = "SELECT stage, position, name FROM monitor_list"

    # Streams
    q["t1_loose_ingest"] = "SELECT * FROM mempool"
    q["t2_block_ingest"] = "SELECT * FROM utxo"
    q["t3_block_buffer"] = (
        f"SELECT hash, height, state FROM ({states}) WHERE state = 'linked' "
        f"UNION ALL SELECT hash, NULL, state FROM ({states}) WHERE state <> 'linked'"
    )
    q["t4_duplicate_blocks"] = f"SELECT hash, 1::BIGINT AS times FROM ({states}) WHERE state = 'linked'"
    q["t5_orphan_signals"] = f"""SELECT hash, height, timestamp FROM arrivals
      WHERE timestamp < (SELECT min(timestamp) FROM blocks WHERE timestamp >= {CUT})"""
    q["t6_roll_back"] = f"""SELECT 'blocks' AS source, hash, height FROM blocks WHERE height < {tip}
      UNION ALL SELECT 'tx', hash, height FROM tx WHERE height < {tip}
      UNION ALL SELECT 'utxo', hash, height::BIGINT FROM utxo WHERE height < {tip}
      UNION ALL SELECT 'orphan', hash, height FROM blocks WHERE height = {tip}"""
    q["t7_monitor_intervals"] = f"""SELECT hash, min(CASE
        WHEN regexp_matches(script_hex, '7576a914[0-9a-f]{{40}}88ac$') AND seq >= ({CUT} // 86400) * 1099511627776 THEN 0
        WHEN regexp_matches(script_hex, '76a9140[0-9a-f]{{39}}88ac') AND seq < ({CUT} // 86400) * 1099511627776 THEN 1
        END) AS priority FROM outs GROUP BY hash HAVING priority IS NOT NULL"""
    q["t6_stream_roll_back"] = q["t6_roll_back"]
    q["t7_stream_monitors"] = f"""SELECT hash, CASE priority WHEN 0 THEN 'johns' ELSE 'zero' END AS name
      FROM ({q["t7_monitor_intervals"]})"""
    q["t8_broadcast_capture"] = "SELECT hash FROM collection WHERE name = 'broadcast'"
    q["t8_stream_collections"] = "SELECT hash, name FROM collection"
    # Equal bytes under two names are one transaction: known and first are asked of the id that the bytes have.
    q["t9_broadcast_admission"] = f"""SELECT * FROM (WITH ids AS (SELECT hash, tx, {rev(h256('tx'))} txid FROM raw),
      known AS (SELECT DISTINCT txid FROM ids WHERE hash IN (SELECT hash FROM tx
        UNION SELECT hash FROM mempool WHERE time < {CUT} UNION SELECT hash FROM collection)),
      sent AS (SELECT x.hash, again, x.txid, CASE
        WHEN length(x.tx) / 2 - (CASE WHEN y.submitted THEN 1 ELSE 0 END) > 300 THEN 'too large'
        WHEN y.submitted THEN 'not a transaction' END fault
        FROM ids x JOIN txs y ON x.hash = y.hash CROSS JOIN (VALUES (0), (1)) s(again)),
      judged AS (SELECT *, txid IN (SELECT txid FROM known)
        OR row_number() OVER (PARTITION BY txid, fault IS NULL ORDER BY again, hash) > 1 late FROM sent)
      SELECT hash, again, CASE WHEN fault IS NULL THEN txid END txid, fault IS NULL AND NOT late AS accepted,
        CASE WHEN fault IS NOT NULL THEN fault WHEN late THEN 'already exists: ' || txid END reason FROM judged)"""
    q["t10_rebuild"] = """SELECT hash, pos, satoshis, height, pubkeyhash FROM created c WHERE height >= 0 AND NOT EXISTS
      (SELECT 1 FROM ins i WHERE i.prev_hash = c.hash AND i.prev_index = c.pos AND i.blockindex > 0)"""
    q["t10_rebuild_collections"] = (
        "SELECT c.hash, c.name FROM collection c JOIN tx t ON c.hash = t.hash WHERE c.name <> 'broadcast'"
    )
    q["t11_throttle"] = """WITH RECURSIVE r AS (SELECT event_id id, user_id, epoch_us(ts) t FROM events),
      anchors AS (SELECT user_id, min(t) a FROM r GROUP BY user_id
        UNION ALL SELECT a.user_id, min(r.t) FROM anchors a JOIN r ON r.user_id = a.user_id AND r.t >= a.a + 86400000000
        GROUP BY a.user_id, a.a),
      placed AS (SELECT r.*, (SELECT max(a) FROM anchors x WHERE x.user_id = r.user_id AND x.a <= r.t) a FROM r)
      SELECT id, '' || user_id AS client, row_number() OVER (PARTITION BY user_id, a ORDER BY t, id) <= 2 AS admitted
      FROM placed"""
    q["t12_peer_log"] = q["k12_connection_log"]
    q["t13_inventory_split"] = (
        "SELECT event_id, CASE code WHEN 1 THEN 'tx' ELSE 'block' END AS wants FROM peers WHERE code IN (1, 2)"
    )
    return q


def oracle_sql() -> dict[str, str]:
    return {name: sql(body) for name, body in _queries().items()}
