"""Scores under a bigram model whose counts lie in a log-frequency Bloom filter.

Counts are quantised to the base of a logarithm; an n-gram of level j is put into the filter j
times, once with each number up to j, and its level is read back by probing with 1, 2, ... until
a probe fails. Rates come from these levels and are smoothed towards the word's own rate:
(c(v, w) + k * p(w)) / (c(v) + k + e). Of V words that do not follow v, the filter answers a known
share with a count of 1 all the same; ``e`` is that mass, so that the rates after v add up to one.

Training: every task counts the n-grams of its texts, sorted by hash, in one block for each segment
of the hash range; each segment is summed and turned into bits of its own. The filter is sent to the
workers if its measured size is below a limit; beyond it, the distinct n-grams of a block of texts are
dealt to the segments, each of which is read once for a bounded share of them, and their levels go
back to the block, with the same result.

Exact word counts, which the base score needs, are summed as a table. The most frequent words, a
fixed number, are sent to the workers; occurrences of all others are joined with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexline.llm.common import bounded_batches
from lexline.llm.hashing import many_word_hashes, mix, run_hashes, window_hashes, word_hashes
from lexline.session import bucketed, durable

#: Stand-ins for the end of a text and for what is before its first word: any fixed numbers do.
END, START = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)
#: n-grams a task holds before it gives them out.
_HELD = 2_000_000
#: Tokens after which a block of texts is closed: what one task scores at a time with a filter that is not sent.
_BLOCK = 500_000
#: n-grams that are looked up in a filter at once, few enough for a processor's cache.
_LOOKED_UP = 1 << 17


@dataclass(frozen=True)
class Settings:
    """Levels are powers of ``base``; each entry has ``bits`` bits and ``probes`` of them set. A segment
    is made for every ``segment_tokens`` training tokens. ``frequent`` words' counts and a filter of at
    most ``broadcast_bytes`` are sent to the workers."""

    base: float = 1.5
    bits: int = 14
    probes: int = 8
    weight: float = 300.0
    segment_tokens: int = 1_500_000
    frequent: int = 1 << 17
    broadcast_bytes: int = 256 << 20


def tokens(text: str | None) -> np.ndarray:
    return np.append(word_hashes(text), END)


def bigrams(token: np.ndarray) -> np.ndarray:
    return window_hashes(np.concatenate([[START], token]), 2)


def many_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``tokens`` of all ``texts``, one after another, and how many each has."""
    words, n = many_word_hashes(texts)
    return np.insert(words, np.cumsum(n), END), n + 1


def _firsts(length: np.ndarray) -> np.ndarray:
    return np.cumsum(length) - length


def many_bigrams(token: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``bigrams`` of all texts of ``many_tokens``, one after another."""
    context = np.concatenate([[START], token[:-1]])
    context[_firsts(length)] = START
    return run_hashes([context, token])


def _kinds(texts: pa.Array) -> np.ndarray:
    """All n-grams of ``texts`` that are counted: a start for each, its tokens and its bigrams."""
    token, length = many_tokens(texts)
    return np.concatenate([np.full(len(length), START), token, many_bigrams(token, length)])


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)


def expected(level: np.ndarray, base: float) -> np.ndarray:
    """Mean of the counts of a level, if a count of c is as frequent as 1 / c**2; 0 for level 0."""
    low = np.ceil(base ** (level - 1) - 1e-9)
    high = np.maximum(low, np.ceil(base**level - 1e-9) - 1)
    # Sums over 1 / c and 1 / c**2 from low to high by the midpoint rule, which is right for one count.
    a, b = low - 0.5, high + 0.5
    mean = np.where(high > low, np.log(b / np.maximum(a, 0.5)) / (1 / np.maximum(a, 0.5) - 1 / b), low)
    return np.where(level > 0, mean, 0.0)


def _places(hashes: np.ndarray, level: int, probe: int, size: np.ndarray | int) -> np.ndarray:
    step = 0x9E3779B97F4A7C15 * (16 * level + probe + 1) % (1 << 64)
    return (mix(hashes ^ np.uint64(step)) >> np.uint64(11)) % np.asarray(size, np.uint64)


def fill(hashes: np.ndarray, counts: np.ndarray, settings: Settings) -> bytes:
    """Bits of one segment."""
    level = levels(counts, settings.base)
    size = 8 * max(8, -(-int(level.sum()) * settings.bits // 8))
    bits = np.zeros(size, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        own = hashes[level >= j]
        for p in range(settings.probes):
            bits[_places(own, j, p, size).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Segments 0 to ``n`` - 1 of the hash range, or some of them."""

    def __init__(self, segments: dict[int, bytes], n: int, settings: Settings):
        self.settings, self.n = settings, n
        self.size = np.zeros(n, np.int64)
        self.first = np.zeros(n, np.int64)
        at = 0
        for s, bits in segments.items():
            self.size[s], self.first[s], at = 8 * len(bits), at, at + len(bits)
        self.bits = np.frombuffer(b"".join(segments.values()), np.uint8)

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """Levels of ``hashes``, which are best sorted, so that those of one segment stand together."""
        parts = [self._level(hashes[at : at + _LOOKED_UP]) for at in range(0, len(hashes), _LOOKED_UP)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _level(self, hashes: np.ndarray) -> np.ndarray:
        segment = segment_of(hashes, self.n)
        size, first = self.size[segment], self.first[segment]
        found, alive, j = np.zeros(len(hashes), np.int64), np.flatnonzero(size > 0), 0
        # Those that are alive, side by side, as each probe asks for all of them.
        left, size, first = hashes[alive], size[alive].astype(np.uint64), first[alive]
        while len(alive):
            j += 1
            for p in range(self.settings.probes):
                place = _places(left, j, p, size).view(np.int64)
                hit = np.flatnonzero((self.bits[first + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1)
                if len(hit) < len(alive):
                    alive, left, size, first = alive[hit], left[hit], size[hit], first[hit]
                if not len(alive):
                    break
            found[alive] = j
        return found


def segment_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _sorted(hashes: np.ndarray) -> np.ndarray:
    """Distinct hashes in order; ``np.unique`` alone puts them into a hash table, which takes several times as long."""
    hashes = np.sort(hashes)
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])] if len(hashes) else hashes


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def _counting(kinds):
    """Function for mapInArrow over texts that yields (hashes, counts) of ``kinds(texts)``, many texts together."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        parts, n = [], 0
        for batch in batches:
            parts.append(kinds(batch.column(0)))
            n += len(parts[-1])
            if n >= _HELD:
                yield np.unique(np.concatenate(parts), return_counts=True)
                parts, n = [], 0
        if n:
            yield np.unique(np.concatenate(parts), return_counts=True)

    return held


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, c) of every distinct token of ``texts`` (text), the end among them."""
    held = _counting(lambda texts: many_tokens(texts)[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, counts in held(batches):
            for at in range(0, len(hashes), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[part].view(np.int64)), pa.array(counts[part])], ["hash", "n"]
                )

    return texts.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("c"))


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes byte by byte, the high bytes of all first: these hardly change and compress."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8).T[::-1]).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1)[::-1].T).view(np.uint64).ravel()


def train_filter(texts: DataFrame, segments: int, settings: Settings) -> DataFrame:
    """(segment, bits, wrong) over the words and bigrams of ``texts`` (text); ``wrong`` is the share of
    n-grams that are not there but have a level all the same."""
    held = _counting(_kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, counts in held(batches):
            ends = np.searchsorted(segment_of(hashes, segments), np.arange(segments + 1))
            for s in np.flatnonzero(ends[1:] > ends[:-1]):
                own = slice(ends[s], ends[s + 1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s], pa.int32()),
                        pa.array([_packed(hashes[own])], pa.binary()),
                        pa.array([counts[own].astype("<u4").tobytes()], pa.binary()),
                    ],
                    ["segment", "hashes", "counts"],
                )

    def gather(group: pa.Table) -> pa.Table:
        hashes = np.concatenate([_unpacked(x.as_py()) for x in group["hashes"]])
        counts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in group["counts"]]).astype(np.int64)
        bits = fill(*_summed(hashes, counts), settings)
        wrong = np.unpackbits(np.frombuffer(bits, np.uint8)).mean() ** settings.probes
        columns = {"segment": group["segment"][:1], "bits": pa.array([bits], pa.binary()), "wrong": pa.array([wrong])}
        return pa.table(columns)

    blocks = texts.mapInArrow(count, "segment int, hashes binary, counts binary")
    return blocks.groupBy("segment").applyInArrow(gather, "segment int, bits binary, wrong double")


@dataclass(frozen=True)
class Known:
    """What all tasks know: the exact counts ``c`` of the most frequent words, sorted by ``hash``,
    ``total``, which is N + V + 1, and ``noise``, the sum of counts that a context's V words have by
    mistake."""

    hash: np.ndarray
    c: np.ndarray
    total: float
    noise: float

    def exact(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is among the most frequent, and its place there."""
        signed = hashes.view(np.int64)
        where = np.minimum(np.searchsorted(self.hash, signed), max(0, len(self.hash) - 1))
        return (self.hash[where] == signed if len(self.hash) else np.zeros(len(signed), bool)), where


def known_words(counts: DataFrame, total: float, noise: float, settings: Settings) -> Known:
    """The most frequent words of ``word_counts``, a fixed number, and how many texts begin: as many as end."""
    start, end = (int(np.array([x]).view(np.int64)[0]) for x in (START, END))
    top = counts.orderBy(F.col("c").desc(), "hash").limit(settings.frequent).toPandas()
    texts = counts.where(F.col("hash") == F.lit(end)).select("c").toPandas()["c"]
    hashes, c = np.append(top["hash"].to_numpy(np.int64), start), np.append(top["c"].to_numpy(np.int64), texts.sum())
    order = np.argsort(hashes)
    return Known(hashes[order], c[order], total, noise)


def _text_scores(texts: list[np.ndarray], level_of, known: Known, settings: Settings) -> np.ndarray:
    """``_scores`` of texts that are each given by their tokens."""
    token = np.concatenate(texts)
    return _scores(token, np.array([len(t) for t in texts]), _distinct(token), level_of, known, settings)


def _distinct(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different words of ``token`` and the start, and where those of ``token`` and at last the start stand."""
    return np.unique(np.append(token, START), return_inverse=True)


def _scores(
    token: np.ndarray, length: np.ndarray, distinct: tuple[np.ndarray, np.ndarray], level_of, known: Known, settings: Settings
) -> np.ndarray:
    """log10 of the smoothed probability of each text's tokens. A pair of words has no greater count than
    either of them, and a word that was never learned follows none. Each n-gram is looked up once."""
    words, at = distinct
    first = _firsts(length)
    count = expected(level_of(words), settings.base)
    is_known, where = known.exact(words)
    count[is_known] = known.c[where[is_known]]
    single = count[at]
    c_w, c_v = single[:-1], np.roll(single, 1)[:-1]
    c_v[first] = single[-1]
    pairs, at = np.unique(many_bigrams(token, length), return_inverse=True)
    c_vw = np.minimum(expected(level_of(pairs), settings.base)[at], np.minimum(c_w, c_v))
    k, mass = settings.weight, np.where(c_v > 0, c_v + known.noise, 0.0)
    return np.add.reduceat(np.log10((c_vw + k * (c_w + 1) / known.total) / (mass + k)), first)


def score(
    docs: DataFrame, training: Column, text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """The columns of ``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``lm_score``, replaced if they are there.

    ``training`` says which rows are learned from. A null text is an empty one, which has the end as
    its only token. Repeated rows count and are scored each. With nothing to learn from, N is 0 and
    every token is unknown.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "lm_score", "_row", "_rare", "_block")
    base = docs.drop(*[c for c in docs.columns if c.lower() in made])
    learned = docs.where(F.coalesce(training, F.lit(False))).select(F.col(text).cast("string"))
    counts = durable(word_counts(learned))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total = float(n + v + 1)
    segments = 1 + n // settings.segment_tokens
    stored = durable(train_filter(learned, segments, settings))
    size, wrong = stored.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0)), F.coalesce(F.avg("wrong"), F.lit(0.0))).first()
    small = size <= settings.broadcast_bytes

    known = known_words(counts, total, float(v * wrong), settings)
    frequent = spark.sparkContext.broadcast(known)
    sent = spark.sparkContext.broadcast(
        Filter({r["segment"]: bytes(r["bits"]) for r in stored.toLocalIterator()}, segments, settings) if small else None
    )
    schema = "_row long, _n long, _known long, _sum double, _rare binary, _score double, _block long"
    place = base.columns.index(text)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, common, model = TaskContext.get().partitionId() << 33, frequent.value, sent.value
        block, held = row, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            token, length = many_tokens(batch.column(place))
            words, at = distinct = _distinct(token)
            is_known, where = common.exact(words)
            logs = np.zeros(len(words))
            logs[is_known] = np.log10(common.c[where[is_known]] + 1)
            first, at = _firsts(length), at[:-1]
            n_known = np.add.reduceat(is_known[at].astype(np.int64), first)
            rare = token[~is_known[at]].tobytes()
            rare_ends = 8 * np.concatenate([[0], np.cumsum(length - n_known)]).astype(np.int32)
            scores = _scores(token, length, distinct, model.level, common, settings) if model else None
            blocks = []
            for n in length.tolist():
                blocks.append(block)
                row, held = row + 1, held + n
                if held >= _BLOCK:
                    block, held = row, 0
            columns = [
                pa.array(np.arange(row - len(length), row)),
                pa.array(length),
                pa.array(n_known),
                pa.array(np.add.reduceat(logs[at], first)),
                pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(rare_ends.tobytes()), pa.py_buffer(rare)]),
                pa.nulls(len(length), pa.float64()) if scores is None else pa.array(scores),
                pa.array(blocks, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=pa.schema([*batch.schema, *fields]))

    fields = [
        pa.field("_row", pa.int64()),
        pa.field("_n", pa.int64()),
        pa.field("_known", pa.int64()),
        pa.field("_sum", pa.float64()),
        pa.field("_rare", pa.binary()),
        pa.field("_score", pa.float64()),
        pa.field("_block", pa.int64()),
    ]
    out_schema = spark.createDataFrame([], schema).schema
    measured = base.mapInArrow(measure, type(out_schema)([*base.schema.fields, *out_schema.fields]))
    measured = durable(measured) if small else bucketed(measured, "_block")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, packed in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                hashes, times = np.unique(np.frombuffer(packed.as_py(), np.int64), return_counts=True)
                if len(hashes):
                    rows = pa.array(np.full(len(hashes), r))
                    yield pa.RecordBatch.from_arrays([rows, pa.array(hashes), pa.array(times)], ["_row", "hash", "times"])

    found = durable(
        measured.select("_row", "_rare")
        .mapInArrow(rare, "_row long, hash long, times long")
        .join(counts, "hash")
        .groupBy("_row")
        .agg(F.sum("times").alias("_more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("_more_sum"))
    )
    joined = measured.drop("_rare").join(found, "_row", "left")
    if not small:
        joined = joined.drop("_score").join(_by_probes(measured, place, stored, segments, n, frequent, settings), "_row")
    nothing = F.lit(0)
    return joined.select(
        *[F.col(f"`{x}`") for x in base.columns],
        F.col("_n").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_more", nothing)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_sum") + F.coalesce("_more_sum", nothing) - F.col("_n") * float(np.log10(total))).alias("base_score"),
        F.col("_score").alias("lm_score"),
    )


def _by_probes(
    measured: DataFrame, place: int, stored: DataFrame, segments: int, learned: int, frequent, settings: Settings
) -> DataFrame:
    """(_row, _score) for a filter that is too large to send. A block of texts asks each segment for its
    distinct n-grams, so a frequent one is asked once a block. Where far more tokens are scored than were
    ``learned``, the blocks are parted by a salt, and a segment is sent once for each: a group holds the
    n-grams of at most twice ``segment_tokens`` tokens and one segment, whatever the size of the corpus."""
    texts = measured.select("_block", "_row", F.col(f"`{measured.columns[place]}`").cast("string").alias("text"))
    scored = measured.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    salts = max(1, round(scored / max(1, learned)))

    def probes(own: pa.Table) -> pa.Table:
        hashes = _sorted(_kinds(own["text"].combine_chunks()))
        ends = np.searchsorted(segment_of(hashes, segments), np.arange(segments + 1))
        asked = np.flatnonzero(ends[1:] > ends[:-1])
        packed = [_packed(hashes[ends[s] : ends[s + 1]]) for s in asked]
        block = own["_block"][0].as_py()
        return pa.table(
            {
                "_block": pa.array([block] * len(asked), pa.int64()),
                "segment": pa.array(asked, pa.int32()),
                "hashes": pa.array(packed, pa.binary()),
            }
        )

    def read(asked: pa.Table, own: pa.Table) -> pa.Table:
        bits = {s.as_py(): b.as_py() for s, b in zip(own["segment"], own["bits"], strict=True)}
        model = Filter(bits, segments, settings)
        # Blocks have many n-grams in common: each is looked up once.
        hashes = [_unpacked(x.as_py()) for x in asked["hashes"]]
        distinct, at = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]), return_inverse=True)
        level = model.level(distinct).astype(np.uint8)[at]
        told = [x.tobytes() for x in np.split(level, np.cumsum([len(h) for h in hashes])[:-1])] if hashes else []
        return pa.table(
            {"_block": asked["_block"], "segment": asked["segment"], "levels": pa.array(told, pa.binary())}
        )

    def rate(own: pa.Table, told: pa.Table) -> pa.Table:
        token, length = many_tokens(own["text"].combine_chunks())
        hashes = _sorted(np.concatenate([[START], token, many_bigrams(token, length)]))
        # Segments are parts of the hash range, so levels in their order are in that of the hashes.
        order = np.argsort(told["segment"].to_numpy())
        levels_of = told["levels"].to_pylist()
        level = np.concatenate([np.frombuffer(levels_of[k], np.uint8) for k in order]).astype(np.int64)
        level_of = lambda h: level[np.searchsorted(hashes, h)]
        scores = _scores(token, length, _distinct(token), level_of, frequent.value, settings)
        return pa.table({"_row": own["_row"], "_score": pa.array(scores, pa.float64())})

    salt = F.pmod(F.xxhash64("_block"), F.lit(salts)).alias("salt")
    # The table is dealt by its blocks: neither of the two steps that read texts shuffles them.
    asked = texts.select("_block", "text").groupBy("_block").applyInArrow(probes, "_block long, segment int, hashes binary")
    sent = stored.select("segment", "bits").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    told = (
        asked.select("*", salt)
        .groupBy("segment", "salt")
        .cogroup(sent.groupBy("segment", "salt"))
        .applyInArrow(read, "_block long, segment int, levels binary")
    )
    return texts.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(rate, "_row long, _score double")
