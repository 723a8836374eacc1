"""Wire format of transactions and blocks.

Writing needs no Python: every part of a transaction is an expression on its
row, and the parts are joined in order. Parts come in chunks of a bounded
number, so a transaction of any size is never one group. Reading walks
variable-length fields, which Catalyst has no operator for; it runs on Arrow
batches.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections import Counter, deque
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .hashing import compact_size_hex, from_hex, header_hex, le_hex, reverse_hex, to_hex, txid

PARTS_PER_CHUNK = 4096

TX_SCHEMA = (
    "version int, "
    "vin array<struct<prev_hash:string,prev_index:bigint,script_sig:binary,sequence:bigint>>, "
    "vout array<struct<value:bigint,script:binary>>, "
    "locktime bigint, size bigint"
)
HEADER_BYTES = 80
WINDOW_BYTES = 8 << 20
# What a task holds of a block that comes in pieces, and of the rows of one whose end it has not seen.
HELD_BYTES = 64 << 20
HELD_BATCHES = 4
BLOCK_TX_SCHEMA = (
    "offset bigint, version int, prev_hash string, merkle_root string, timestamp bigint, bits bigint, "
    "nonce bigint, numtxs bigint, blockindex bigint, tx_offset bigint, tx_size bigint, raw_tx binary, fault string"
)


def encode_tx_table(txs: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(hash, chunk, raw): serialized transactions from their tables.

    ``txs`` has hash, version, locktime, nin and nout. A transaction with at
    most ``PARTS_PER_CHUNK`` parts, head and tail included, is one row; a
    larger one is the concatenation of its chunks.

    The part number of an output needs the number of inputs. It is given when
    the parts of a transaction have met, so only the outputs of transactions of
    several chunks, which are set apart first, are joined for it.
    """
    large = _large(txs.filter(F.col("nin") + F.col("nout") + 3 > PARTS_PER_CHUNK))
    tables = (txs, inputs, outputs)
    small = [df.join(large, "hash", "left_anti") for df in tables]
    encoded = _encode_small(*small)
    if large.isEmpty():
        return encoded
    return encoded.unionByName(_encode_large(*[df.join(large, "hash", "left_semi") for df in tables]))


def _large(rows: DataFrame) -> DataFrame:
    """Distinct hashes of ``rows``, written first: as Spark then knows how few they are, what they are joined with is not shuffled."""
    return materialize(rows.select("hash").distinct(), "large")


def _fixed_parts(txs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(hash, part, digits) of all parts but the outputs."""
    nin, nout = F.col("nin").cast("long"), F.col("nout").cast("long")
    framed = F.array(
        F.struct(F.lit(0).cast("long").alias("part"), F.concat(le_hex(F.col("version"), 4), compact_size_hex(nin)).alias("digits")),
        F.struct((nin + 1).alias("part"), compact_size_hex(nout).alias("digits")),
        F.struct((nin + nout + 2).alias("part"), le_hex(F.col("locktime"), 4).alias("digits")),
    )
    spent = inputs.select(
        "hash",
        (F.col("vin").cast("long") + 1).alias("part"),
        F.concat(
            reverse_hex(F.col("prev_hash")),
            le_hex(F.col("prev_index"), 4),
            compact_size_hex(F.length("script_sig_hex") / 2),
            F.col("script_sig_hex"),
            le_hex(F.col("sequence"), 4),
        ).alias("digits"),
    )
    return txs.select("hash", F.inline(framed)).unionByName(spent)


def _output_digits() -> Column:
    return F.concat(le_hex(F.col("satoshis"), 8), compact_size_hex(F.length("script_hex") / 2), F.col("script_hex")).alias("digits")


def _packed() -> Column:
    """A part as bytes, which are half its digits; digits that are no bytes stay as they are."""
    data = from_hex(F.col("digits"))
    return F.struct("kind", "part", data.alias("data"), F.when(data.isNull(), F.col("digits")).alias("digits"))


def _joined_parts(parts: Column) -> Column:
    in_order = F.transform(F.array_sort(parts), lambda p: F.coalesce(F.hex(p["data"]), p["digits"]))
    return F.unhex(F.array_join(in_order, "")).alias("raw")


def _encode_small(txs: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """``encode_tx_table`` of transactions whose parts are one chunk."""
    fixed, made, first = 0, 1, 2
    chunk = F.floor(F.col("part") / PARTS_PER_CHUNK).alias("chunk")
    only = F.lit(0).cast("long").alias("chunk")
    rows = _fixed_parts(txs, inputs).select("hash", chunk, F.lit(fixed).alias("kind"), "part", "digits")
    outs = outputs.filter("hash IS NOT NULL").select(
        "hash", only, F.lit(made).alias("kind"), F.col("pos").cast("long").alias("part"), _output_digits()
    )
    # The number of the first output, as often as the transaction is there.
    starts = txs.select(
        "hash", only, F.lit(first).alias("kind"), (F.col("nin") + 2).cast("long").alias("part"), F.lit("").alias("digits")
    )
    found = (
        rows.unionByName(outs).unionByName(starts).groupBy("hash", "chunk").agg(F.collect_list(_packed()).alias("all"))
    )

    def of(kind: int) -> Column:
        return F.filter("all", lambda p: p["kind"] == kind)

    def at(part: Column, p: Column) -> Column:
        return F.struct(part.alias("part"), p["data"].alias("data"), p["digits"].alias("digits"))

    placed = F.transform(of(fixed), lambda p: at(p["part"], p))
    numbered = F.transform(of(first), lambda s: F.transform(of(made), lambda p: at(s["part"] + p["part"], p)))
    parts = found.select("hash", "chunk", F.concat(placed, F.flatten(numbered)).alias("parts")).filter(F.size("parts") > 0)
    return parts.select("hash", "chunk", _joined_parts(F.col("parts")))


def _encode_large(txs: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """``encode_tx_table`` in chunks of a bounded number of parts."""
    made = outputs.join(txs.select("hash", "nin"), "hash").select(
        "hash", (F.col("nin") + 2 + F.col("pos")).cast("long").alias("part"), _output_digits()
    )
    parts = _fixed_parts(txs, inputs).unionByName(made).withColumn("kind", F.lit(0))
    chunked = parts.groupBy("hash", F.floor(F.col("part") / PARTS_PER_CHUNK).alias("chunk"))
    return chunked.agg(F.collect_list(_packed()).alias("parts")).select("hash", "chunk", _joined_parts(F.col("parts")))


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each key over its chunks, which arrive in order."""
    key, state = None, None

    def finish() -> list[str]:
        return [hashlib.sha256(state.digest()).digest()[::-1].hex()]

    for batch in batches:
        keys, ids = [], []
        for name, raw in zip(batch.column("hash").to_pylist(), batch.column("raw").to_pylist()):
            if name != key:
                if key is not None:
                    keys, ids = keys + [key], ids + finish()
                key, state = name, hashlib.sha256()
            state.update(raw)
        yield pa.RecordBatch.from_pydict({"hash": pa.array(keys, pa.string()), "txid": pa.array(ids, pa.string())})
    if key is not None:
        yield pa.RecordBatch.from_pydict({"hash": [key], "txid": finish()})


def txids(raw: DataFrame) -> DataFrame:
    """(hash, txid) of serialized transactions in chunks.

    One chunk is hashed by expressions. The chunks of a larger transaction go
    through one running hash, which holds a chunk at a time.
    """
    large = _large(raw.filter("chunk > 0"))
    whole = raw.join(large, "hash", "left_anti").select("hash", txid(F.col("raw")).alias("txid"))
    chunks = raw.join(large, "hash", "left_semi").repartition("hash").sortWithinPartitions("hash", "chunk")
    return whole.unionByName(chunks.select("hash", "raw").mapInArrow(_hash_chunks, "hash string, txid string"))


def _join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per transaction from its chunks, which come in order."""
    key, parts = None, []

    def whole() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([b"".join(parts)], pa.binary())], names=["hash", "raw"])

    for batch in batches:
        for name, raw in zip(batch.column("hash").to_pylist(), batch.column("raw").to_pylist()):
            if name != key:
                if key is not None:
                    yield whole()
                key, parts = name, []
            parts.append(raw)
    if key is not None:
        yield whole()


def whole_transactions(raw: DataFrame) -> DataFrame:
    """(hash, raw): each serialized transaction as one value.

    Tables that hold a transaction as one value need this. Only transactions
    of several chunks are put together, one at a time; a value over Spark's
    limit of 2 GiB fails, it is not left out.
    """
    large = _large(raw.filter("chunk > 0"))
    chunks = raw.join(large, "hash", "left_semi").repartition("hash").sortWithinPartitions("hash", "chunk")
    kind = raw.schema["hash"].dataType.simpleString()
    put_together = chunks.select("hash", "raw").mapInArrow(_join_chunks, f"hash {kind}, raw binary")
    return raw.join(large, "hash", "left_anti").select("hash", "raw").unionByName(put_together)


def block_pieces(blocks: DataFrame, raw: DataFrame) -> DataFrame:
    """(height, blockindex, chunk, data): pieces of serialized blocks.

    ``raw`` is a transaction chunk with its height and blockindex. The piece
    with blockindex -1 is the header with the transaction count.
    """
    head = blocks.select(
        "height",
        F.lit(-1).cast("long").alias("blockindex"),
        F.lit(0).cast("long").alias("chunk"),
        F.unhex(F.concat(header_hex(), compact_size_hex(F.col("numtxs")))).alias("data"),
    )
    body = raw.select("height", "blockindex", F.col("chunk").cast("long").alias("chunk"), F.col("raw").alias("data"))
    return head.unionByName(body)


class Short(ValueError):
    """The bytes end before ``needed``."""

    def __init__(self, needed: int):
        super().__init__("short buffer")
        self.needed = needed


# Least bytes of an input, an output and a transaction.
INPUT_BYTES, OUTPUT_BYTES, TX_BYTES = 41, 9, 10


def read_count(buf: bytes, at: int) -> tuple[int, int]:
    """Variable-length count at ``at`` and the offset behind it."""
    if at >= len(buf):
        raise Short(at + 1)
    width = {0xFD: 2, 0xFE: 4, 0xFF: 8}.get(buf[at], 0)
    if not width:
        return buf[at], at + 1
    end = at + 1 + width
    if end > len(buf):
        raise Short(end)
    return int.from_bytes(buf[at + 1 : end], "little"), end


def tx_end(buf: bytes, at: int) -> int:
    """Offset behind the transaction at ``at``; nothing else is made of it."""
    n, at = read_count(buf, at + 4)
    for _ in range(n):
        size, at = read_count(buf, at + 36)
        at += size + 4
        if at > len(buf):
            raise Short(at)
    n, at = read_count(buf, at)
    for _ in range(n):
        size, at = read_count(buf, at + 8)
        at += size
        if at > len(buf):
            raise Short(at)
    if at + 4 > len(buf):
        raise Short(at + 4)
    return at + 4


def read_tx(buf: bytes, at: int) -> tuple[tuple, int]:
    """Fields of the transaction at ``at`` and the offset behind it.

    Every count and length is held against the bytes that are there first.
    """
    start = at
    (version,) = struct.unpack_from("<i", buf, at)
    n, at = read_count(buf, at + 4)
    if n > (len(buf) - at) // INPUT_BYTES:
        raise Short(at + n * INPUT_BYTES)
    vin, vout = [], []
    for _ in range(n):
        prev, index = struct.unpack_from("<32sI", buf, at)
        size, at = read_count(buf, at + 36)
        if size > len(buf) - at - 4:
            raise Short(at + size + 4)
        script = buf[at : at + size]
        (sequence,) = struct.unpack_from("<I", buf, at + size)
        at += size + 4
        vin.append({"prev_hash": prev[::-1].hex(), "prev_index": index, "script_sig": script, "sequence": sequence})
    n, at = read_count(buf, at)
    if n > (len(buf) - at) // OUTPUT_BYTES:
        raise Short(at + n * OUTPUT_BYTES)
    for _ in range(n):
        (value,) = struct.unpack_from("<q", buf, at)
        size, at = read_count(buf, at + 8)
        if size > len(buf) - at:
            raise Short(at + size)
        vout.append({"value": value, "script": buf[at : at + size]})
        at += size
    (locktime,) = struct.unpack_from("<I", buf, at)
    return (version, vin, vout, locktime, at + 4 - start), at + 4


def read_header(buf: bytes, at: int) -> tuple[int, str, str, int, int, int]:
    version, prev, root, time, bits, nonce = struct.unpack_from("<i32s32sIII", buf, at)
    return version, prev[::-1].hex(), root[::-1].hex(), time, bits, nonce


WIRE_ERRORS = (struct.error, IndexError, ValueError, OverflowError)


def decode_tx_table(df: DataFrame, raw: str = "raw", unspent: str | None = None) -> DataFrame:
    """Rows of ``df`` with the decoded transaction instead of ``raw``.

    Undecodable bytes leave the new columns null. ``unspent`` names a column
    with a list of output positions; it goes, and each output has in a field
    ``unspent`` how often its position is listed.
    """
    kept = [f for f in df.schema.fields if f.name not in (raw, unspent)]
    listed = [] if unspent is None else [F.col(unspent).alias("_unspent")]
    ordered = df.select(*[f.name for f in kept], F.col(raw).alias("_raw"), *listed)
    names = ["version", "vin", "vout", "locktime", "size"]
    sample = ordered.select(*[f.name for f in kept])
    made = TX_SCHEMA if unspent is None else TX_SCHEMA.replace("script:binary>", "script:binary,unspent:bigint>")
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in sample.schema.fields] + [made])
    vin_type = pa.list_(
        pa.struct(
            [
                ("prev_hash", pa.string()),
                ("prev_index", pa.int64()),
                ("script_sig", pa.binary()),
                ("sequence", pa.int64()),
            ]
        )
    )
    vout_fields = [("value", pa.int64()), ("script", pa.binary())]
    vout_type = pa.list_(pa.struct(vout_fields if unspent is None else [*vout_fields, ("unspent", pa.int64())]))
    types = [pa.int32(), vin_type, vout_type, pa.int64(), pa.int64()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = []
            for buf in batch.column("_raw").to_pylist():
                try:
                    decoded.append(read_tx(buf, 0)[0] if buf is not None else (None,) * 5)
                except WIRE_ERRORS:
                    decoded.append((None,) * 5)
            if unspent is not None:
                for tx, positions in zip(decoded, batch.column("_unspent").to_pylist()):
                    times = Counter(positions or ())
                    for pos, output in enumerate(tx[2] or ()):
                        output["unspent"] = times[pos]
            columns = list(zip(*decoded)) if decoded else [()] * 5
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(kept))] + arrays, names=[f.name for f in kept] + names
            )

    return ordered.mapInArrow(decode, ddl)


def block_batches(offset: int, read: Callable[[int, int], bytes], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``BLOCK_TX_SCHEMA`` for one block of ``size`` bytes, in batches of bounded size.

    ``read(at, n)`` gives up to n bytes of the block from ``at`` on. Only a
    window of it is held; the window grows when one transaction is larger. A
    block that cannot be decoded ends with a row that has only ``offset`` and
    ``fault``; the rows before it are not to be used.
    """
    rows, held = [], 0
    try:
        buf, base = read(0, WINDOW_BYTES), 0
        head = (offset, *read_header(buf, 0))
        n, at = read_count(buf, HEADER_BYTES)
        if not n:
            rows = [(*head, 0, None, None, None, None, None)]
        for index in range(n):
            while True:
                try:
                    end = tx_end(buf, at)
                    break
                except Short as short:
                    if base + short.needed > size:
                        raise
                    more = read(base + at, max(WINDOW_BYTES, 2 * (len(buf) - at), short.needed - at))
                    if len(more) <= len(buf) - at:
                        raise
                    buf, base, at = more, base + at, 0
            rows.append((*head, n, index, base + at, end - at, buf[at:end], None))
            held, at = held + end - at, end
            if held >= WINDOW_BYTES or len(rows) == PARTS_PER_CHUNK:
                yield _block_tx_batch(rows)
                rows, held = [], 0
    except WIRE_ERRORS as error:
        rows.append((offset, *[None] * 11, f"not a block: {error}"))
    if rows:
        yield _block_tx_batch(rows)


def _whole_block(offset: int, read: Callable[[int, int], bytes], size: int) -> Iterator[pa.RecordBatch]:
    """``block_batches`` of a good block, the last row of a bad one.

    A few batches are held until the end is seen. Of a block with more of
    them the end is looked up before any row goes out.
    """

    def judged(last: pa.RecordBatch) -> pa.RecordBatch | None:
        bad = last.column("fault").null_count < last.num_rows
        return last.slice(last.num_rows - 1) if bad else None

    batches = block_batches(offset, read, size)
    held = list(islice(batches, HELD_BATCHES + 1))
    last = held[-1] if len(held) <= HELD_BATCHES else deque(block_batches(offset, read, size), 1).pop()
    fault = judged(last)
    if fault is not None:
        yield fault
        return
    yield from held
    yield from batches


def _block_tx_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in BLOCK_TX_SCHEMA.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in BLOCK_TX_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)


def decode_block_table(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per transaction of each serialized block in ``df``.

    Columns: ``offset``, the header fields, numtxs, blockindex, tx_offset (in
    the block), tx_size, raw_tx and fault. A block without transactions gives
    one row with null transaction columns. Bytes that are no block give one
    row with only ``offset`` and ``fault``, to be set aside.

    With a column ``at`` the rows are pieces of blocks as ``fetch_blocks``
    gives them, and a block may have any size: what a task does not hold of
    it lies in a temporary file.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset, buf in zip(batch.column("offset").to_pylist(), batch.column("_raw").to_pylist()):
                if buf is not None:
                    yield from _whole_block(offset, lambda at, n, b=buf: b[at : at + n], len(buf))

    def decode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ("offset", "_at", "_raw")]))
        held, block, size = None, None, 0

        def read(at: int, n: int) -> bytes:
            held.seek(at)
            return held.read(n)

        for offset, at, piece in rows:
            if at == 0:
                if held is not None:
                    yield from _whole_block(block, read, size)
                    held.close()
                held, block, size = tempfile.SpooledTemporaryFile(HELD_BYTES), offset, 0
            held.seek(at)
            held.write(piece)
            size = at + len(piece)
        if held is not None:
            yield from _whole_block(block, read, size)
            held.close()

    if "at" in df.columns:
        return df.select("offset", F.col("at").alias("_at"), F.col(raw).alias("_raw")).mapInArrow(decode_pieces, BLOCK_TX_SCHEMA)
    return df.select("offset", F.col(raw).alias("_raw")).mapInArrow(decode, BLOCK_TX_SCHEMA)


def tx_record(df: DataFrame) -> Column:
    """Display form of a decoded transaction as a JSON text column."""
    vin = F.transform(
        df["vin"],
        lambda i: F.struct(
            F.struct(i["prev_hash"].alias("hash"), i["prev_index"].alias("n")).alias("prevout"),
            to_hex(i["script_sig"]).alias("scriptSig"),
            F.regexp_replace(
                F.lpad(F.lower(F.hex(i["sequence"])), 8, "0"), "^0{1,4}(?=.{4})", ""
            ).alias("sequence"),
        ),
    )
    vout = F.transform(
        df["vout"], lambda o: F.struct(o["value"].alias("value"), to_hex(o["script"]).alias("scriptPubKey"))
    )
    return F.to_json(
        F.struct(df["version"].alias("version"), vin.alias("vin"), vout.alias("vout"), df["locktime"].alias("locktime"))
    )
