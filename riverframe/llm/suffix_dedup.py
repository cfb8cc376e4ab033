"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes when it is covered by a string of `length` bytes that also starts in a document with a
smaller id. Suffixes are ranked by growing prefixes and drop out as soon as their rank is unique:

1. Equal texts are ranked whole; of each group only the smallest id goes on.
2. Rank by the first length/2 bytes (a fingerprint names the rank) at anchors: positions whose rank is
   the least in some window of all the half-length strings that a full-length string holds, so equal
   full-length strings have equal anchors. Tasks rank their own texts first and send one row per rank;
   Spark deals ranks to buckets, and ranks of a single document drop out.
3. Double: around each anchor left, strings of the full length are ranked by their bytes. Equal
   surroundings are settled as one, others string by string; each occurrence above the smallest id of
   its rank is removed. Again tasks settle what they can before they send rows on.
4. Buckets of more than HOT rows hold a rank whose surroundings differ almost everywhere. No task takes such
   a bucket: Spark groups its full-length strings one by one for their smallest ids and joins those back.

The order of suffixes is only needed among equal prefixes, so names stand for ranks, and strings longer
than `length` are never compared. Texts are UTF-8; null counts as empty. Rows without an id are left
out. Rows that repeat an id, with equal texts or different ones, are treated alike: none is smaller than the
other. A text is one value of its task, which takes texts in parts of about 16 MB or one at a time. An empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop, keyed, size_at_most, table
from .shingles import _TABLE, _powers, mix

FLUSH = 1 << 24
#: Bits of a rank's name that tell its bucket.
BUCKET_BITS = 31
#: Most rows of a bucket that one task settles; a bucket holds about 16,000 anchors before any rank drops out.
HOT = 1 << 17
#: Most bytes of bucket numbers that are broadcast; more are joined by a shuffle.
BROADCAST_MOST = 8 << 20
#: Where ids repeat with different texts, a row is told by its id's number and, in so many bits below it, by that of the text.
VERSION_BITS = 20


def slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over every window of `width` neighbours."""
    n = 1
    while 2 * n <= width:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, ranks by the first length // 2 bytes) of a text's anchors."""
    half = length // 2
    width = length - half + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[: len(data)], out=sums[1:])
    rank = mix((sums[half:] - sums[:-half]) * inverse[: len(data) - half + 1])
    least = slide(rank, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(slide(np.concatenate((edge, least, edge)), width, np.maximum) == rank)
    return at, rank[at]


def split(rank: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a rank, and what tells it from the bucket's others."""
    return (rank % np.uint64(buckets)).astype(np.int64), ((rank // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of a sorted array of buckets."""
    if len(bucket):
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bucket)]))):
            yield int(bucket[a]), slice(int(a), int(b))


def texts(batches: Iterator[pa.RecordBatch], flush: int = FLUSH) -> Iterator[list[tuple]]:
    """Rows of batches as lists of about `flush` bytes."""
    rows, size = [], 0
    for batch in batches:
        ids, data = batch.column(0), batch.column(1)
        rest = [batch.column(j) for j in range(2, batch.num_columns)]
        for i in range(batch.num_rows):
            raw = data[i].as_buffer()
            rows.append((ids[i].as_py(), np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), *[c[i] for c in rest]))
            size += len(rows[-1][1])
            if size >= flush:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def send_ranks(length: int, buckets: int, shift: int) -> Callable:
    """(id, data) -> (bucket, ids, keys): ranks with their smallest ids by bucket; in one row of a bucket below 0 all ids
    of the ranks met twice here, which are shared whatever other tasks hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in texts(batches):
            found = [(i, anchors(d, length)[1]) for i, d in rows]
            rank = np.concatenate([r for _, r in found])
            ids = np.repeat(np.array([i for i, _ in found], np.int64), [len(r) for _, r in found])
            bucket, key = split(rank, buckets)
            order = np.lexsort((ids, key, bucket))
            bucket, key, ids = bucket[order], key[order], ids[order]
            new = np.ones(len(ids), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])
            again = np.ones(len(ids), bool)
            again[1:] = new[1:] | (ids[1:] >> shift != ids[:-1] >> shift)
            group = np.cumsum(new) - 1
            many = np.bincount(group, weights=again)[group] > 1 if len(ids) else new
            use = many & again
            passed = -1 - int(rows[0][0]) % buckets
            out = {"bucket": [passed], "ids": [ids[use].tobytes()], "keys": [bucket[use].astype(np.uint32).tobytes() + key[use].tobytes()]}
            bucket, key, ids = bucket[new], key[new], ids[new]
            for b, s in by_bucket(bucket):
                for name, value in (("bucket", b), ("ids", ids[s].tobytes()), ("keys", key[s].tobytes())):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64()), ("ids", pa.binary()), ("keys", pa.binary())]))

    return run


def shared_ranks(shift: int) -> Callable:
    """One bucket's rows -> (id, key) of the ranks that several documents have."""
    return lambda part: _shared(part, shift)


def _shared(part: pa.Table, shift: int) -> pa.Table:
    bucket = part["bucket"][0].as_py()
    found = [(np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(k.as_buffer(), np.uint32)) for i, k in zip(part["ids"], part["keys"])]
    ids = np.concatenate([i for i, _ in found])
    if bucket < 0:
        full = [(k[len(i) :].astype(np.int64) << BUCKET_BITS) | k[: len(i)] for i, k in found]
        return pa.table({"id": ids, "key": np.concatenate(full)})
    keys = np.concatenate([k for _, k in found])
    order = np.lexsort((ids, keys))
    ids, keys = ids[order], keys[order]
    new = np.ones(len(ids), bool)
    new[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(new) - 1
    last = ids[np.append(np.flatnonzero(new)[1:] - 1, len(ids) - 1)]
    use = ids[new][group] >> shift != last[group] >> shift
    return pa.table({"id": ids[use], "key": (keys[use].astype(np.int64) << BUCKET_BITS) | bucket})


def settle(key: np.ndarray, around: np.ndarray, ids: np.ndarray, at: np.ndarray, length: int, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rank full-length strings around anchors of equal keys.

    around: fixed-width bytes, the text from `side` before the anchor to `side` behind it and two bytes
    that tell how much of either side there is. Returns (ids, starts, ends) of removed stretches, and
    which rows another task may still have to settle: those with a string that is not removed."""
    half = length // 2
    side = length - half
    order = np.lexsort((ids, around, key))
    key, around, ids, at = key[order], around[order], ids[order], at[order]
    n = len(ids)
    new_key = np.ones(n, bool)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= around[1:] != around[:-1]
    group = np.cumsum(new) - 1
    smallest = ids[new][group]
    raw = np.frombuffer(around.tobytes(), np.uint8).reshape(n, -1)
    before, behind = raw[:, -2].astype(np.int64) - 1, raw[:, -1].astype(np.int64) - 1
    moved = np.arange(side + 1)
    valid = (moved <= before[:, None]) & (side - moved <= behind[:, None])
    gone = valid & (ids >> shift > smallest >> shift)[:, None]
    # Keys with several surroundings: compare string by string, one row for each surrounding.
    kinds = np.bincount(np.cumsum(new_key) - 1, weights=new)[np.cumsum(new_key) - 1]
    reps = np.flatnonzero(new & (kinds > 1))
    if len(reps):
        better = np.zeros((len(reps), side + 1), bool)
        for i in range(side + 1):
            ok = np.flatnonzero(valid[reps, i])
            if len(ok) < 2:
                continue
            r = reps[ok]
            strings = np.ascontiguousarray(raw[r, side - i : side - i + length])
            strings = np.concatenate((strings, np.ones((len(r), 1), np.uint8)), axis=1).view(f"S{length + 1}").ravel()
            o = np.lexsort((ids[r], strings, key[r]))
            first = np.ones(len(o), bool)
            first[1:] = (key[r][o][1:] != key[r][o][:-1]) | (strings[o][1:] != strings[o][:-1])
            low = ids[r][o][first][np.cumsum(first) - 1]
            better[ok[o], i] = ids[r][o] >> shift > low >> shift
        where = np.full(group[-1] + 1, -1, np.int64)
        where[group[reps]] = np.arange(len(reps))
        mine = where[group]
        gone |= valid & (mine >= 0)[:, None] & better[np.maximum(mine, 0)]
    edge = np.zeros((n, 1), bool)
    wide = np.concatenate((edge, gone, edge), axis=1)
    row, first = np.nonzero(wide[:, 1:] & ~wide[:, :-1])
    _, last = np.nonzero(wide[:, :-1] & ~wide[:, 1:])
    keep = np.zeros(n, bool)
    keep[order] = (valid & ~gone).any(axis=1)
    return ids[row], at[row] - (last - 1), at[row] - first + length, keep


def send_strings(length: int, buckets: int, shift: int) -> Callable:
    """(id, data, keys) -> rows for buckets (bucket, ids, keys, at, around), or stretches settled here (bucket below 0)."""
    half = length // 2
    side = length - half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in texts(batches, FLUSH // 4):
            parts = []
            for i, data, wanted in rows:
                at, rank = anchors(data, length)
                bucket, key = split(rank, buckets)
                full = (key.astype(np.int64) << BUCKET_BITS) | bucket
                use = np.isin(full, wanted.values.to_numpy(zero_copy_only=False))
                at, full = at[use], full[use]
                padded = np.concatenate((np.zeros(side, np.uint8), data, np.zeros(side, np.uint8)))
                around = np.lib.stride_tricks.sliding_window_view(padded, half + 2 * side)[at]
                reach = np.stack((np.minimum(at, side) + 1, np.minimum(len(data) - at - half, side) + 1), axis=1).astype(np.uint8)
                parts.append((full, np.concatenate((around, reach), axis=1), np.full(len(at), i, np.int64), at))
            full, around, ids, at = (np.concatenate([p[j] for p in parts]) for j in range(4))
            if not len(full):
                continue
            around = np.ascontiguousarray(around).view(f"S{half + 2 * side + 2}").ravel()
            gone, starts, ends, keep = settle(full, around, ids, at, length, shift)
            full, around, ids, at = full[keep], around[keep], ids[keep], at[keep]
            settled = -1 - int(rows[0][0]) % buckets
            out = {"bucket": [settled], "ids": [gone.tobytes()], "keys": [b""], "at": [starts.tobytes()], "around": [ends.tobytes()]}
            bucket = full & ((1 << BUCKET_BITS) - 1)
            order = np.lexsort((full, bucket))
            full, around, ids, at, bucket = full[order], around[order], ids[order], at[order], bucket[order]
            for b, s in by_bucket(bucket):
                for name, value in (("bucket", b), ("ids", ids[s].tobytes()), ("keys", full[s].tobytes()), ("at", at[s].tobytes()), ("around", around[s].tobytes())):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64()), *[(c, pa.binary()) for c in ("ids", "keys", "at", "around")]]))

    return run


def settle_bucket(length: int, shift: int) -> Callable:
    """One bucket's rows -> (id, start, stop) of removed stretches."""
    width = length // 2 + 2 * (length - length // 2) + 2

    def run(part: pa.Table) -> pa.Table:
        def column(name: str, kind: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in part[name]])

        ids, at = column("ids", "i8"), column("at", "i8")
        if part["bucket"][0].as_py() < 0:
            starts, ends = at, column("around", "i8")
        else:
            ids, starts, ends, _ = settle(column("keys", "i8"), column("around", f"S{width}"), ids, at, length, shift)
        return pa.table({"id": ids, "start": starts, "stop": ends})

    return run


def spread(length: int) -> Callable:
    """(ids, at, around) of hot buckets -> (string, id, start): each full-length string around an anchor."""
    half = length // 2
    side = length - half
    width = half + 2 * side + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in zip(*batch.columns):
                ids, at, around = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(packed, (np.int64, np.int64, np.uint8)))
                raw = around.reshape(-1, width)
                before, behind = raw[:, -2].astype(np.int64) - 1, raw[:, -1].astype(np.int64) - 1
                for i in range(side + 1):
                    ok = np.flatnonzero((i <= before) & (side - i <= behind))
                    strings = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(ok), [None, pa.py_buffer(raw[ok, side - i : side - i + length].tobytes())])
                    yield pa.RecordBatch.from_arrays([strings.cast(pa.binary()), pa.array(ids[ok]), pa.array(at[ok] - i)], ["string", "id", "start"])

    return run


def removed(strings: DataFrame, length: int, shift: int, hot_rows: int) -> DataFrame:
    """(id, start, stop) of the removed stretches in the table of strings by bucket."""
    rows = strings.filter("bucket >= 0").groupBy("bucket").agg(F.sum(F.octet_length("ids") / 8).alias("n"))
    hot = table(rows.filter(F.col("n") > hot_rows).select("bucket"), "hot")
    if size_at_most(hot, F.lit(8), BROADCAST_MOST):
        hot = F.broadcast(hot)
    settled = strings.join(hot, "bucket", "left_anti").groupBy("bucket").applyInArrow(settle_bucket(length, shift), "id bigint, start bigint, stop bigint")
    single = strings.join(hot, "bucket", "left_semi").select("ids", "at", "around").mapInArrow(spread(length), "string binary, id bigint, start bigint")
    least = single.groupBy("string").agg(F.min("id").alias("least"))
    later = single.join(least, "string").filter(F.shiftright("id", shift) > F.shiftright("least", shift))
    return settled.union(later.select("id", "start", (F.col("start") + length).alias("stop")))


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, data, whole, starts, stops) -> (id, n_bytes, n_removed, n_spans, kept_sha256, kept)."""
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for rows in texts(batches):
        out: list[list] = [[] for _ in names]
        for i, data, whole, starts, stops in rows:
            n = len(data)
            step = np.zeros(n + 1, np.int64)
            if whole.as_py():
                step[0], step[n] = 1, -1
            elif starts.is_valid:
                np.add.at(step, starts.values.to_numpy(zero_copy_only=False), 1)
                np.add.at(step, stops.values.to_numpy(zero_copy_only=False), -1)
            gone = np.cumsum(step)[:n] > 0
            kept = data[~gone].tobytes()
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (n > 0 and gone[0]))
            for column, value in zip(out, (i, n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.string()), pa.array(out[5], pa.binary())], names)


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT) -> DataFrame:
    """One row per input row with an id: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left)."""
    named, names, _ = keyed(docs, id_col, text_col)
    key, shift = F.col("__key"), 0
    if names is not None:
        least = F.min("__key").over(Window.partitionBy("id"))
        names = table(names.select("__key", F.col("id").alias("__id"), (F.shiftleft(least, VERSION_BITS) + F.col("__key") - least).alias("__version")), "versions")
        named, key, shift = named.join(names, "__key"), F.col("__version"), VERSION_BITS
    rows = named.filter(F.col("__key").isNotNull()).select(key.alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    first = rows.groupBy(F.sha2("data", 256).alias("sha")).agg(F.min("id").alias("id"), F.max(F.octet_length("data")).cast("bigint").alias("n"))
    first = table(first.groupBy("id").agg(F.sum("n").alias("n")), "first")
    total = first.agg(F.sum("n")).first()[0] or 0
    # About 16k anchors a bucket; the names of buckets suffice for about 900 TB of different texts.
    buckets = int(min((1 << BUCKET_BITS) - 1, max(64, total * 2 // length // 16384)))
    # Both joins of this table deal the texts by id, in one job: Spark shuffles them once and reuses that.
    own = rows.join(first.select("id"), "id", "left_semi")
    sent = own.mapInArrow(send_ranks(length, buckets, shift), "bucket bigint, ids binary, keys binary")
    shared = sent.groupBy("bucket").applyInArrow(shared_ranks(shift), "id bigint, key bigint").groupBy("id").agg(F.collect_set("key").alias("keys"))
    strings = table(own.join(shared, "id").mapInArrow(send_strings(length, buckets, shift), "bucket bigint, ids binary, keys binary, at binary, around binary"), "strings")
    gone = table(removed(strings, length, shift, hot_rows).groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")), "gone")
    drop(strings)
    marked = rows.join(first.select("id", F.lit(True).alias("first")), "id", "left").join(gone, "id", "left")
    whole = F.col("first").isNull() & (F.octet_length("data") >= length)
    cut = marked.select("id", "data", whole.alias("whole"), "starts", "stops").mapInArrow(remove, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    if names is not None:
        cut = cut.join(names.select(F.col("__version").alias("id"), "__id"), "id").select(F.col("__id").alias("id"), *[c for c in cut.columns if c != "id"])
    return cut.withColumnRenamed("id", id_col)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
