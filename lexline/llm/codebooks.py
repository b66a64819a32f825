"""Compress vectors to product codes: Lloyd rounds over members that stay where their entry lives.

A vector is cut into equal parts. Each part position has a codebook, and each part is a member of its
nearest entry. Members are dealt once by (position, entry, salt): a table whose tasks own whole
entries, or with the salt an even share of one. Owners sum up their own members, and the few sums
per entry make the next codebooks. Members are then judged where they lie; those that keep their
entry stay in place, and only those that change it go through the next shuffle.

The salt is a hash of the row over as many values as the table has blocks of ``rows_per_owner`` rows, so
an entry that holds most parts (one vector repeated, say) has as many owners as that asks for.

All codebooks together have ``parts * entries`` entries, whatever the number of rows. They are the one
thing that goes through the driver and to all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexline.operators.joins import salted_join
from lexline.session import durable

ROWS_PER_OWNER = 1_000_000
#: Components from here on are no part of the model: their squares would not fit into a long.
LARGEST = 2.0**19
#: Bytes that the table of distances between a run of parts and one codebook may take.
WORK_BYTES = 8 << 20

MEMBER = "position int, entry int, salt int, row long, part binary"


def valid_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector has only finite components below ``LARGEST``."""

    def good(x):
        return x.isNotNull() & (F.abs(x) < LARGEST)

    rows = vectors.select(
        F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")
    )
    return rows.where(F.col("v").isNotNull() & F.coalesce(F.forall("v", good), F.lit(False)))


def whole(v: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(v * scale).astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every part, the lower one of two, and its squared distance."""
    step = max(1, WORK_BYTES // max(1, 8 * codebook.size))
    index, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for i in range(0, len(parts), step):
        gap = parts[i : i + step, None, :] - codebook[None, :, :]
        far = np.einsum("nej,nej->ne", gap, gap)
        index[i : i + step] = best = far.argmin(1)
        error[i : i + step] = far[np.arange(len(far)), best]
    return index, error


def _members(position, entry, row, parts: np.ndarray, salts: int) -> pa.RecordBatch:
    """Rows of ``MEMBER``; the salt depends on the row and the entry, so an entry's rows spread evenly."""
    n, width = parts.shape
    mixed = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    salt = ((mixed + entry.astype(np.uint64)) % np.uint64(salts)).astype(np.int32)
    data = np.ascontiguousarray(parts.astype("<i4"))
    ends = (np.arange(n + 1) * width * 4).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    columns = [position.astype(np.int32), entry.astype(np.int32), salt, row.astype(np.int64)]
    return pa.RecordBatch.from_arrays(
        [*[pa.array(c) for c in columns], binary], ["position", "entry", "salt", "row", "part"]
    )


def _parts(column: pa.Array, width: int) -> np.ndarray:
    held = b"".join(x.as_buffer() for x in column)
    return np.frombuffer(held, "<i4").reshape(len(column), width).astype(np.int64)


def first_members(rows: DataFrame, codebooks: np.ndarray, scale: int, salts: int) -> DataFrame:
    """One member row for each part of each vector, at its nearest entry."""
    parts, _, width = codebooks.shape

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = whole(_matrix(batch.column(0), parts * width), scale).reshape(-1, parts, width)
            row = batch.column(1).to_numpy(zero_copy_only=False)
            for p in range(parts):
                entry, _ = nearest(v[:, p], codebooks[p])
                yield _members(np.full(len(row), p), entry, row, v[:, p], salts)

    return rows.select("v", F.monotonically_increasing_id().alias("row")).mapInArrow(cut, MEMBER)


def judged(members: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``members`` with ``next``, their nearest entry now. No row moves."""
    width = codebooks.shape[2]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column(0).to_numpy()
            parts = _parts(batch.column(4), width)
            found = np.zeros(batch.num_rows, np.int32)
            for p in np.unique(position):
                at = position == p
                found[at] = nearest(parts[at], codebooks[p])[0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found)], [*batch.schema.names, "next"]
            )

    return members.mapInArrow(judge, f"{MEMBER}, next int")


def moved(members: DataFrame, salts: int) -> DataFrame:
    """The rows of ``judged`` that change their entry, at the new one."""
    salt = F.pmod(F.xxhash64("row", "next"), F.lit(salts)).cast("int")
    away = members.where(F.col("next") != F.col("entry"))
    there = away.select("position", F.col("next").alias("entry"), salt.alias("salt"), "row", "part")
    return there.repartition("position", "entry", "salt")


def updated(members: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks of the entries' means, rounded down; an entry without members stays as it is."""
    parts, entries, width = codebooks.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            slot = batch.column(0).to_numpy().astype(np.int64) * entries + batch.column(1).to_numpy()
            np.add.at(total[:, :width], slot, _parts(batch.column(2), width))
            total[:, width] += np.bincount(slot, minlength=len(total))
        used = np.flatnonzero(total[:, width])
        flat = total[used].reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width + 1)), pa.array(np.tile(np.arange(width + 1), len(used))), pa.array(flat)],
            ["slot", "place", "total"],
        )

    found = members.select("position", "entry", "part").mapInArrow(sums, "slot long, place long, total long")
    # One row for each component of each entry, whatever the number of members.
    rows = found.groupBy("slot", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
    total = {(r["slot"], r["place"]): int(r["total"]) for r in rows}
    new = codebooks.copy()
    for slot, place in total:
        if place < width:
            p, e = divmod(slot, entries)
            new[p, e, place] = total[slot, place] // total[slot, width]
    return new


def fit(
    rows: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    rows_per_owner: int = ROWS_PER_OWNER,
) -> np.ndarray | None:
    """Codebooks (part, entry, component) of ``valid_vectors`` after ``rounds`` rounds.

    The first entries are the vectors of the smallest ids, without an id last, of equal ids the
    smaller vector first. Vectors have the length of the first of them that cuts into ``parts``; rows
    of another length are left aside. None where there are no vectors.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits for a part, so at most 256 entries")
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    cuts = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    head = cuts.orderBy(*order).select(F.size("v")).first()
    if head is None:
        return None
    fitting = rows.where(F.size("v") == head[0])
    seeds = np.array([r["v"] for r in fitting.orderBy(*order).select("v").limit(entries).collect()])
    width = head[0] // parts
    codebooks = np.ascontiguousarray(whole(seeds, scale).reshape(-1, parts, width).transpose(1, 0, 2))

    salts = 1 + fitting.count() // rows_per_owner
    members = durable(first_members(fitting, codebooks, scale, salts).repartition("position", "entry", "salt"))
    for last in [False] * (rounds - 1) + [True] * (rounds > 0):
        codebooks = updated(members, codebooks)
        if not last:
            now = durable(judged(members, codebooks))
            stay = now.where(F.col("next") == F.col("entry")).drop("next")
            members = stay.unionByName(durable(moved(now, salts)))
    return codebooks


def encode(rows: DataFrame, codebooks: np.ndarray, scale: int = 256) -> DataFrame:
    """(vec_id, label, code, error) of the vectors of the codebooks' length."""
    parts, _, width = codebooks.shape
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = whole(_matrix(batch.column(2), parts * width), scale).reshape(-1, parts, width)
            codes, error = np.empty((len(v), parts), np.uint8), np.zeros(len(v), np.int64)
            for p in range(parts):
                index, far = nearest(v[:, p], codebooks[p])
                codes[:, p] = index
                error += far
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    fitting = rows.where(F.size("v") == parts * width).select("vec_id", "label", "v")
    return fitting.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    rows_per_owner: int = ROWS_PER_OWNER,
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), one row for each kept vector.

    ``code`` has two hexadecimal digits for each part, ``error`` is the squared distance to the entries
    over all parts, ``label_error`` its sum over the rows of the same label, nulls together (null if a
    long can't hold it). Left out are rows whose vector is null, holds a null, NaN or infinite component
    or one of ``LARGEST`` or more, or has another length than the codebooks (see ``fit``). Null and
    repeated keys are kept, one result for each row; other columns are left aside; an empty table
    gives no rows.
    """
    rows = valid_vectors(vectors, key, vector, label)
    codebooks = fit(rows, parts, entries, rounds, scale, rows_per_owner)
    if codebooks is None:
        codebooks, rows = np.zeros((parts, 0, 1), np.int64), rows.limit(0)
    tag = {"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))}
    coded = durable(encode(rows, codebooks, scale).withColumns(tag).withColumn("_row", F.monotonically_increasing_id()))
    on = ["_none", "_label"]
    sums = durable(coded.groupBy(*on).agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("e"), F.count("*").alias("n")))
    return salted_join(
        coded,
        sums.select(*on, F.col("e").cast("decimal(38,0)").try_cast("long").alias("label_error")),
        on,
        ["_row"],
        how="inner",
        counts=sums.select(*on, "n"),
    ).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
