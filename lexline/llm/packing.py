"""Pack documents into token sequences: concatenate them all and cut.

Pass one turns texts into ids, writes them with a running token count per partition, and so fixes
which partition holds which documents in which order. The totals of the partitions, one number
each, are summed up to the offset of each partition. Pass two cuts every document where a multiple
of the sequence length lies, by its global offset alone; no document waits for another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexline.llm import bpe
from lexline.session import durable

#: Bytes of texts that are encoded together, or of ids in a batch given back to Spark, one document more at most.
BATCH_BYTES = 4 << 20


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, before, n_tokens, ids): the ids of every document with ``end_id`` after them.

    ``ids`` are 16-bit little-endian numbers, or 32-bit for vocabularies that need it. ``before``
    counts the ids of earlier documents of the same ``part``.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part int, before long, n_tokens long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, before = bpe.load(tokenizer), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], model.dtype).tobytes(), model.dtype.itemsize
        for batch in batches:
            for keys, texts in runs(*batch.columns[:2]):
                ids = [own + end for own in model.ids(texts)]
                counts = np.array([len(own) // width for own in ids], np.int64)
                upto = before + np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.array(np.full(len(counts), part, np.int32)),
                        pa.array(upto - counts),
                        pa.array(counts),
                        pa.array(ids, pa.binary()),
                    ],
                    ["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before = int(upto[-1])

    return rows.mapInArrow(encode, schema)


def runs(keys: pa.Array, texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Consecutive rows whose texts have ``most`` bytes together, or one row that has more."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(upto[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + most, "right")))
        yield keys.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 1024,
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece of a document: (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    Piece rows are the boundary records: ``offset`` is the piece's place in its sequence, ``start``
    its place in its document, ``ids`` its ids as 32-bit little-endian numbers. All sequences but
    the last are full. A null or empty text has the end id alone; repeated rows are packed each;
    an empty table gives no rows; other columns are left aside.
    """
    kept = durable(token_ids(docs, tokenizer, end_id, key, text))
    # One row per partition of the first pass.
    totals = kept.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = totals.select(
        "part",
        (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"),
    )
    placed = kept.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("at"), "n_tokens", "ids"
    )
    kind = kept.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner, ids, held = [], [], [], 0
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)]
            for i, (at, n) in enumerate(zip(*columns, strict=True)):
                own = batch.column(3)[i].as_buffer()
                wide = np.frombuffer(own, f"<u{own.size // n}").astype("<u4")
                for lo, hi in pieces(int(at), int(n), length):
                    rows.append((lo, hi - lo, int(n), (at + lo) // length, (at + lo) % length))
                    owner.append(i)
                    ids.append(wide[lo:hi].tobytes())
                    held += 4 * (hi - lo)
                if rows and (held >= BATCH_BYTES or i == batch.num_rows - 1):
                    numbers = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(owner)), *numbers, pa.array(ids, pa.binary())],
                        ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                    )
                    rows, owner, ids, held = [], [], [], 0

    return placed.mapInArrow(cut, schema)


def pieces(at: int, n: int, length: int) -> list[tuple[int, int]]:
    """Cuts of a document of ``n`` ids whose first lies at ``at``, from and to, in its own ids."""
    cuts = [0, *range(length - at % length, n, length), n]
    return list(zip(cuts, cuts[1:], strict=False))
