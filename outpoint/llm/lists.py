"""Inverted lists that travel packed, and components of what they bring together.

A task sends one row per bucket with all its keys of that bucket: 32-bit rests
of the keys, ids, set sizes, and how many keys each id has. A key costs a few
bytes and no JVM row. The number of buckets follows the number of keys, so a
bucket stays bounded.

Lists are worked through in two passes. The first takes all pairs of short
lists, and of long ones the pairs with the first id and the next one. They are
checked exactly and united. The second takes from long lists every pair of
ids that are still apart. So no link between components is lost, while a group
of copies costs its size and not its square.

Before a pair is checked, sketches of both sets bound how much they can share:
every element flips one bit of a sketch, so two sketches differ in no more
bits than the sets differ in elements. That rules out nearly all pairs that
are not linked, and never one that is. In the second pass the sketches are
compared where the list is, so ruled-out pairs are not even rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import written
from .components import components

#: Keys of a bucket; a bucket is worked through in one task.
BUCKET_KEYS = 1 << 20
#: Keys that a task holds before it sends them.
SEND_KEYS = 1 << 19
#: All pairs of a list up to this length are checked at once.
SHORT_LIST = 4
#: Bytes of texts whose sets are compared at once, and from where on texts are compressed.
VERIFY_BYTES = 1 << 19
LONG_TEXT = 512
#: Bits of a sketch per element of the set, at least. Sets that share little differ in 0.4 bits an element and more,
#: those that link in less than 0.29.
SKETCH_BITS = 1.25
#: Rows from which on groups are worked through, and pairs whose sketches are compared at once.
GROUPS_ROWS = 1 << 13
PAIRS_AT_ONCE = 1 << 15
#: Bits of the filter of asked ids (2 MB), whatever their number.
FILTER_BITS = 24

PACKED = "bucket int, keys binary, ids binary, sizes binary, times binary, known binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("keys", "ids", "sizes", "times", "known"))])

_U = np.uint64


def bucket_count(keys: float) -> int:
    return int(keys // BUCKET_KEYS) + 1


def pack(ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray, buckets: int, known: list[tuple[int, int]] = ()) -> pa.RecordBatch:
    """A batch of ``PACKED`` for keys (64-bit hashes) with their ids and set sizes, and links that need no check."""
    bucket = ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    if 4 * np.count_nonzero((ids[1:] != ids[:-1]) | (sizes[1:] != sizes[:-1])) > len(ids):  # else keys of an id already stand together
        order = np.lexsort((sizes, ids))
        ids, sizes, keys, bucket = ids[order], sizes[order], keys[order], bucket[order]
    order = np.argsort(bucket, kind="stable")
    ids, sizes, keys, bucket = ids[order], sizes[order], keys[order].astype(np.uint32), bucket[order]
    names = np.unique(bucket)
    cuts = np.append(np.searchsorted(bucket, names), len(bucket))
    out: dict[str, list] = {"bucket": [], "keys": [], "ids": [], "sizes": [], "times": []}
    for b, lo, hi in zip(names, cuts, cuts[1:], strict=False):
        part, size = ids[lo:hi], sizes[lo:hi]  # a repeated id may have sets of several sizes
        new = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (size[1:] != size[:-1])))
        out["bucket"].append(int(b))
        out["keys"].append(keys[lo:hi].tobytes())
        out["ids"].append(part[new].tobytes())
        out["sizes"].append(size[new].astype(np.int32).tobytes())
        out["times"].append(np.diff(np.append(new, hi - lo)).astype(np.int32).tobytes())
    links = [b""] * len(names)
    if len(known):
        if not links:
            links, out = [b""], {"bucket": [0]} | {n: [b""] for n in ("keys", "ids", "sizes", "times")}
        links[0] = np.array(known, np.int64).tobytes()
    return pa.RecordBatch.from_pydict(out | {"known": links}, schema=PACKED_ARROW)


def _unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, ids and sizes of a bucket in the order of key, size and id, without repeats and single ids."""
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["keys"]])
    times = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["times"]])
    ids = np.repeat(np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]]), times)
    sizes = np.repeat(np.concatenate([np.frombuffer(x, np.int32) for x in pdf["sizes"]]), times)
    # Sorting numbers that end in their places is much faster than sorting places.
    order = np.sort((keys.astype(np.uint64) << _U(32)) | np.arange(len(keys), dtype=np.uint64))
    again = (order[1:] >> _U(32)) == (order[:-1] >> _U(32))
    use = (order[np.append(again, False) | np.append(False, again)] & _U(0xFFFFFFFF)).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
    keys, ids, sizes = keys[use], ids[use], sizes[use]
    order = np.lexsort((ids, sizes, keys))
    keys, ids, sizes = keys[order], ids[order], sizes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]) | (sizes[1:] != sizes[:-1])
    return keys[new], ids[new], sizes[new]


def _scan(least: int, of: int):
    """Pairs of a bucket to check now (a, b), known links (list is -1), and members of its long lists (a, size as b)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, ids, sizes = _unpacked(pdf)
        starts = np.searchsorted(keys, keys)
        lengths = np.searchsorted(keys, keys, "right") - starts
        every = np.arange(len(keys))
        far = every[(lengths > SHORT_LIST) & (every > starts)]
        found = [(starts[far], far)]
        for step in range(1, SHORT_LIST):
            i = every[: max(0, len(keys) - step)]
            i = i[(keys[i] == keys[i + step]) & ((lengths[i] <= SHORT_LIST) | (step == 1))]
            found.append((i, i + step))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        fits = (of * sizes[i].astype(np.int64) >= least * sizes[j].astype(np.int64)) & (ids[i] != ids[j])
        i, j = i[fits], j[fits]
        low, high = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        long = lengths > SHORT_LIST
        name = (int(pdf["bucket"].iloc[0]) << 32) + keys[long].astype(np.int64)
        pairs = pd.DataFrame({"a": low[new], "b": high[new], "list": pd.array([pd.NA] * int(new.sum()), "Int64")})
        members = pd.DataFrame({"a": ids[long], "b": sizes[long].astype(np.int64), "list": pd.array(name, "Int64")})
        known = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["known"]]).reshape(-1, 2)
        links = pd.DataFrame({"a": known[:, 0], "b": known[:, 1], "list": pd.array([-1] * len(known), "Int64")})
        return pd.concat([pairs, links, members], ignore_index=True)

    return run


def sketch_bits(n: int) -> int:
    return max(64, 1 << max(0, int(n * SKETCH_BITS) - 1).bit_length())


def sketches_of(at: np.ndarray, hashes: np.ndarray) -> list[bytes]:
    """Bits that the distinct elements of each set flip, sets being from ``at`` on; more bits for more elements."""
    ns = np.diff(at)
    bits, out = np.array([sketch_bits(n) for n in ns.tolist()], np.int64), [b""] * len(ns)
    for size in np.unique(bits).tolist():
        mine = np.flatnonzero(bits == size)
        use = hashes[np.repeat(bits == size, ns)]
        place = np.repeat(np.arange(len(mine)), ns[mine]) * size + (use % _U(size)).astype(np.int64)
        flips = (np.bincount(place, minlength=len(mine) * size) & 1).astype(np.uint8)
        packed = np.packbits(flips, bitorder="little").tobytes()
        for k, i in enumerate(mine.tolist()):
            out[i] = packed[k * size // 8 : (k + 1) * size // 8]
    return out


def sketch(hashes: np.ndarray) -> bytes:
    return sketches_of(np.array([0, len(hashes)]), hashes)[0]


def _sketches(sets: Callable):
    """Sizes and sketches of the sets of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, first = batch.column(1).to_pylist(), 0
            while first < len(packed):  # a few at a time, as they grow when they are unpacked
                last, size, found = first, 0, []
                while last < len(packed) and (size < VERIFY_BYTES or last == first):
                    found.append(unpacked_text(packed[last]))
                    size += len(found[-1])
                    last += 1
                rows, hashes = sets(found)
                at = np.searchsorted(rows, np.arange(len(found) + 1))
                bits = pa.array(sketches_of(at, hashes), pa.binary())
                columns = [batch.column(0).slice(first, len(found)), pa.array(np.diff(at).astype(np.int64)), bits]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "sketch"])
                first = last

    return run


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as they would be with fewer bits."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def may_link(a: np.ndarray, b: np.ndarray, sizes_a, sizes_b, least: int, of: int) -> np.ndarray:
    """Whether sets with these sketches (of one length) and sizes can be as similar as ``least / of``."""
    apart = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    total = sizes_a + sizes_b
    return (least + of) * (total - apart) >= 2 * least * total


def _possible(least: int, of: int):
    """The pairs (a, b) whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.concatenate([batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4)])
            both = pa.concat_arrays([batch.column(3), batch.column(5)])
            words, at, bits = _words_of(both)
            i = np.arange(batch.num_rows)
            j = i + batch.num_rows
            i, j = np.where(words[i] <= words[j], i, j), np.where(words[i] <= words[j], j, i)
            keep = _far(i, j, sizes, words, at, bits, least, of)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return run


def _words_of(sketches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of 64-bit words of each sketch, where they begin, and the words."""
    data, at = tb.string_parts(sketches)
    return np.diff(at) >> 3, at >> 3, np.frombuffer(data.tobytes(), np.uint64)


def _far(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, words: np.ndarray, at: np.ndarray, bits: np.ndarray, least: int, of: int):
    """Which pairs of rows may link by their sketches, the rows of ``bits`` from ``at`` on; ``i`` has the shorter ones."""
    keep = np.zeros(len(i), bool)
    shape = words[i] * (1 << 32) + words[j]
    for both in np.unique(shape):
        w, v = int(both) >> 32, int(both) & 0xFFFFFFFF
        use = np.flatnonzero(shape == both)
        x = bits[at[i[use]][:, None] + np.arange(w)]
        y = _folded(bits[at[j[use]][:, None] + np.arange(v)], w)
        keep[use] = may_link(x, y, sizes[i[use]], sizes[j[use]], least, of)
    return keep


def _pairs_apart(rows: pa.Table, least: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids of one head, in order of head and size, that share a list, are in different components and may link."""
    heads, ids, parts, sizes = (rows[c].to_numpy() for c in ("head", "a", "part", "n"))
    sketch, shared = rows["sketch"].combine_chunks(), rows["lists"].combine_chunks()
    words, at, bits = _words_of(sketch)
    # Per head, sizes rise: who is too small for the row that is a step away is so for all further ones.
    i, found = np.arange(len(ids)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    held, count, step = [], 0, 0
    while len(i) or held:
        step += 1
        i = i[i + step < len(ids)]
        i = i[(heads[i] == heads[i + step]) & (of * sizes[i] >= least * sizes[i + step])]
        ahead = i[parts[i] != parts[i + step]]
        held.append((ahead, ahead + step))
        count += len(ahead)
        if count >= PAIRS_AT_ONCE or not len(i):
            x, y = (np.concatenate(k) for k in zip(*held, strict=True))
            for lo in range(0, len(x), PAIRS_AT_ONCE):
                p, q = x[lo : lo + PAIRS_AT_ONCE], y[lo : lo + PAIRS_AT_ONCE]
                may = _far(p, q, sizes, words, at, bits, least, of)
                found.append((p[may], q[may]))
            held, count = [], 0
    x, y = (np.concatenate(k) for k in zip(*found, strict=True))
    # An id may come with several sets, and is no pair with itself.
    meet = [ids[p] != ids[q] and not set(shared[p].as_py()).isdisjoint(shared[q].as_py()) for p, q in zip(x.tolist(), y.tolist(), strict=True)]
    x, y = ids[x[meet]], ids[y[meet]]
    return np.minimum(x, y), np.maximum(x, y)


def _apart(least: int, of: int):
    """Pairs of ids that share a long list, are in different components and may link.

    A group has all long lists with one smallest id (head), so that ids which
    share many lists meet once. Groups come whole and one after the other;
    many small ones are worked through together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b = _pairs_apart(pa.Table.from_batches(held), least, of)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = batch.column(0).to_numpy()
            if size >= GROUPS_ROWS and (cut := int(np.searchsorted(heads, heads[-1]))) + int(heads[0] != held[-1].column(0)[-1].as_py()):
                yield pairs([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield pairs(held)

    return run


def list_components(
    packed: DataFrame, bodies: Callable[..., DataFrame], sets: Callable, least: int, of: int, sized: bool = True, again: bool = False
) -> DataFrame:
    """(node, component) of ids whose sets are as similar as ``least / of`` and that lists bring together.

    ``bodies`` gives (id, body) for ids that may be in a filter, body being a
    ``packed_text``: texts are smaller than their sets, and compressed where
    they are long. ``sets`` makes (row, hash) of the distinct elements of a
    list of texts, in order. Without ``sized`` the packed sizes mean nothing.

    Most ids that meet are ruled out by their sketches. With ``again`` bodies
    are got (``bodies`` then takes what packs a text, too) for the sketches,
    which alone are kept, and again for the pairs that are left; else once.
    """
    scan = _scan(least if sized else 0, of)
    scanned = written(packed.groupBy("bucket").applyInPandas(scan, "a long, b long, list long"), "scanned")
    met = written(scanned.filter("list IS NULL").select("a", "b").distinct(), "met")
    asked = met.select(F.col("a").alias("id")).union(met.select("b"))
    wanted = id_filter(asked, "id")
    texts = bodies(wanted, plain_text) if again else written(bodies(wanted), "bodies")
    known_sets = written(texts.mapInArrow(_sketches(sets), "id long, n long, sketch binary"), "sketches")

    def checked(pairs: DataFrame) -> DataFrame:
        left = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        return similar_pairs(pairs, written(bodies(id_filter(left, "id"), packed_text), "bodies") if again else texts, sets, least, of)

    x = known_sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x"))
    y = known_sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("y"))
    both = met.join(x, "a").join(y, "b").select("a", "b", "n_a", "x", "n_b", "y")
    pairs = written(both.mapInArrow(_possible(least, of), "a long, b long").distinct(), "pairs")
    known = scanned.filter("list = -1").select("a", "b")
    parts = components(checked(pairs).union(known))

    members = scanned.filter("list >= 0").select("a", "list")
    placed = members.join(parts.select(F.col("node").alias("a"), "component"), "a", "left")
    placed = written(placed.select("a", "list", F.coalesce("component", "a").alias("part")), "placed")
    ends = placed.groupBy("list").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("a").alias("head"))
    split = written(ends.filter("lo < hi").select("list", "head"), "split")
    if split.isEmpty():
        return parts
    rest = placed.join(split, "list").groupBy("head", "a").agg(F.first("part").alias("part"), F.collect_set("list").alias("lists"))
    rest = rest.join(known_sets.withColumnRenamed("id", "a"), "a")
    rest = rest.select("head", "a", "part", "n", "lists", "sketch").repartition("head").sortWithinPartitions("head", "n", "a")
    rest = rest.mapInArrow(_apart(least, of), "a long, b long").distinct()
    more = written(rest.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if more.isEmpty():
        return parts
    merged = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(merged.union(checked(more)))


def _verify(sets: Callable, least: int, of: int):
    """The pairs (a, b) whose bodies x and y have sets of a similarity of ``least / of`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            first = 0
            while first < batch.num_rows:  # a few at a time, as bodies grow when they are unpacked
                last, size, bodies = first, 0, []
                while last < batch.num_rows and (size < VERIFY_BYTES or last == first):
                    bodies += [unpacked_text(x[last]), unpacked_text(y[last])]
                    size += len(bodies[-1]) + len(bodies[-2])
                    last += 1
                rows, hashes = sets(bodies)
                n = np.bincount(rows, minlength=len(bodies)).reshape(-1, 2).sum(1)
                pair = rows >> 1
                hashes = tb.sort_segments(pair, hashes)
                same = (pair[1:] == pair[:-1]) & (hashes[1:] == hashes[:-1])
                shared = np.bincount(pair[1:][same], minlength=last - first)
                keep[first:last] = (n > 0) & ((least + of) * shared >= least * n)
                first = last
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return run


def plain_text(text: bytes) -> bytes:
    return b"=" + text


def packed_text(text: bytes) -> bytes:
    return zstandard.compress(text, 1) if len(text) >= LONG_TEXT else plain_text(text)


def unpacked_text(body: bytes) -> bytes:
    return body[1:] if body[:1] == b"=" else zstandard.decompress(body)


def similar_pairs(pairs: DataFrame, texts: DataFrame, sets: Callable, least: int, of: int) -> DataFrame:
    """Exact check of ``pairs`` (a, b) on ``texts`` (id, body): those with a similarity of ``least / of`` or more."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("body").alias("x")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")
    found = both.select("a", "b", "x", "y").mapInArrow(_verify(sets, least, of), "a long, b long")
    return written(found.distinct(), "checked")


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """Bits set for the ids of ``column``, as a table of fixed size; other ids may share a bit."""
    bits = ids.select(F.pmod(F.col(column), F.lit(1 << FILTER_BITS)).alias("bit"))
    each = F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))")
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(each.alias("bits"))
    found = words.toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def in_filter(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be among those of the filter."""
    bit = np.mod(ids, 1 << FILTER_BITS)
    return (table[bit >> 6] >> (bit & 63).astype(np.uint64)) & _U(1) == 1
