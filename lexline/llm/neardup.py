"""Near duplicates by HyperMinHash: registers, bands, corrected estimate, exact check.

A document's set of word shingles is hashed; the first bits choose one of the registers, which keeps
the smallest of the remaining bits in short: its count of leading zeros and the bits after the first
one. Empty registers borrow from others in an order fixed for each register, so short texts have
whole bands too. Four registers are a band, and documents that share a band are candidates.

Documents with equal sets are one class from the start. In a band's bucket not all pairs are made:
all members are held against one leader, and links join them to components; in further rounds, if
there are any, other leaders meet members of other components. Such candidates pass the estimate from
their registers, corrected for chance collisions and six standard deviations wide, and are then
confirmed on their full shingle sets.

What is left are buckets that still hold several components. Their members are put together to
clusters, clusters are cut into blocks of bounded size, and each pair of blocks counts the common
shingles of all its members at once, by products of the bit rows of their full sets. Only links that
join components leave a block pair, fewer than its members. So every pair of a bucket is tested or
already joined, no link between components is lost, and no list of pairs is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexline.llm.components import components
from lexline.llm.hashing import LOWER, window_hashes, word_hashes
from lexline.session import durable

#: Collisions of two different registers, for sets of equal size, as a share of 2 ** -mantissa bits:
#: the constant of the published estimator. Fixed value.
_COLLISIONS = 0.169919487159739093975


@dataclass(frozen=True)
class Settings:
    """``words`` a shingle, similarity of ``percent`` or more. ``registers`` is a power of two and a
    multiple of ``band``. At 75 percent, 32 bands of 4 miss a pair with a chance of 5 in a million."""

    words: int = 5
    percent: int = 75
    registers: int = 128
    band: int = 4
    mantissa: int = 10
    leader_rounds: int = 1
    block: int = 512


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, in order."""
    word = word_hashes(text)
    return np.unique(window_hashes(word, max(1, min(words, len(word))))) if len(word) else word


def shingles(text: str | None, words: int = 5) -> set[bytes]:
    """The shingles themselves, words joined by a space."""
    ws = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    return {b" ".join(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set()


def registers(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    """Leading zeros and mantissa of the smallest rest in each register; 65535 where there is none."""
    bits = settings.registers.bit_length() - 1
    which = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(hashes) else []
    rest = hashes[first] & np.uint64((1 << (64 - bits)) - 1)
    fraction, exponent = np.frexp(rest.astype(np.float64))
    scale = 1 << settings.mantissa
    code = (64 - bits - exponent) * scale + np.maximum((2 * fraction - 1) * scale, 0).astype(np.int64)
    out = np.full(settings.registers, 0xFFFF, np.uint16)
    out[which[first]] = code.astype(np.uint16)
    return out


def _probes(settings: Settings, most: int = 256) -> np.ndarray:
    """Registers that an empty one looks at, in order; after them the following ones."""
    n = settings.registers
    order = np.random.default_rng(7).integers(0, n, (most, n))
    return np.vstack([order, (np.arange(n)[None, :] + np.arange(1, n)[:, None]) % n])


def densify(rows: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Fill empty registers of each row, which has one at least that is not."""
    full, out = rows != 0xFFFF, rows.copy()
    at_row, at = np.nonzero(~full)
    for probe in probes:
        if not len(at):
            break
        source = probe[at]
        ok = full[at_row, source]
        out[at_row[ok], at[ok]] = rows[at_row[ok], source[ok]]
        at_row, at = at_row[~ok], at[~ok]
    return out


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(id, set_hash, n_shingles, registers) of every row; registers are 16-bit numbers, null for
    an empty set."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, set_hash binary, n_shingles long, registers binary"
    probes = _probes(settings)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                hashes = [shingle_hashes(t.as_py(), settings.words) for t in batch.column(1)]
                rows = np.array([registers(h, settings) for h in hashes])
                some = np.array([len(h) > 0 for h in hashes])
                rows[some] = densify(rows[some], probes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in hashes], pa.binary()),
                        pa.array([len(h) for h in hashes], pa.int64()),
                        pa.array([r.tobytes() if ok else None for r, ok in zip(rows, some, strict=True)], pa.binary()),
                    ],
                    ["id", "set_hash", "n_shingles", "registers"],
                )

    return rows.mapInArrow(sign, schema)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, settings: Settings) -> np.ndarray:
    """Similarity of rows of registers, less the collisions that chance brings about."""
    ratio = n_a / n_b
    by_chance = _COLLISIONS * 2.0**-settings.mantissa * 4 * ratio / (1 + ratio) ** 2
    return (a == b).mean(1) - by_chance


def _likely(pairs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) whose sizes and registers allow the similarity."""
    side = lambda x: classes.select(
        F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}")
    )
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = sized.where(
        100 * F.least("n_a", "n_b") >= settings.percent * F.greatest("n_a", "n_b")
    )
    kind = sized.schema["a"].dataType.simpleString()
    p = settings.percent / 100

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731,B023
            a, b = (np.array([np.frombuffer(r.as_buffer(), np.uint16) for r in get(x)]) for x in ("r_a", "r_b"))
            n_a, n_b = (get(x).to_numpy() for x in ("n_a", "n_b"))
            # Fewer shingles than registers fill about 1 - 1/e of them with values of their own.
            own = (1 - np.exp(-1)) * np.minimum(np.minimum(n_a, n_b), settings.registers)
            ok = estimate(a, b, n_a, n_b, settings) >= p - 6 * np.sqrt(p * (1 - p) / own)
            yield pa.RecordBatch.from_arrays([get("a"), get("b")], ["a", "b"]).filter(pa.array(ok))

    return sized.mapInArrow(passed, f"a {kind}, b {kind}")


def _confirmed(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")
    kind = both.schema["a"].dataType.simpleString()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, last = [], (None, set())
            for t_a, t_b in zip(batch.column(2), batch.column(3), strict=True):
                t_a = t_a.as_py()
                if t_a != last[0]:
                    last = (t_a, shingles(t_a, settings.words))
                a, b = last[1], shingles(t_b.as_py(), settings.words)
                shared = len(a & b)
                ok.append(100 * shared >= settings.percent * (len(a) + len(b) - shared) > 0)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(linked, f"a {kind}, b {kind}")


def _placed(members: DataFrame, reached: DataFrame | None) -> DataFrame:
    """Members with the component that the links so far give them."""
    if reached is None:
        return members.withColumn("component", F.col("id"))
    return members.join(reached, "id", "left").select(
        "id", "bucket", F.coalesce("component", "id").alias("component")
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked when their sets of distinct shingles are similar enough; ``component_id``
    is the smallest key that links can reach. ``kept`` marks the document that has it. A text of
    fewer words than a shingle is one shingle; a null or blank one has none and is linked with
    nothing. Rows with the same key are one document. A null key is linked by equal sets alone; it
    is kept if no document with a key has its set. An empty table gives no rows.
    """
    signed = durable(signatures(docs, key, text, settings))
    some = F.col("n_shingles") > 0
    classes = durable(
        signed.where(some)
        .groupBy("set_hash")
        .agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    )
    named = classes.where(F.col("id").isNotNull())
    width = 2 * settings.band
    bands = named.select(
        "id",
        F.explode(
            F.array(
                *[
                    F.xxhash64(F.lit(j), F.substring("registers", 1 + j * width, width))
                    for j in range(settings.registers // settings.band)
                ]
            )
        ).alias("bucket"),
    )
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = durable(bands.join(shared.select("bucket"), "bucket"))
    wanted = members.select("id").distinct()
    texts = durable(
        docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(wanted, "id")
    )
    named = durable(named.join(wanted, "id"))

    links = reached = tested = None
    for step in range(settings.leader_rounds):
        placed = _placed(members, reached)
        order = F.struct(F.xxhash64(F.lit(step), "id").alias("h"), "id", "component")
        leaders = placed.groupBy("bucket").agg(F.min(order).alias("leader"))
        pairs = (
            placed.join(leaders, "bucket")
            .where(F.col("component") != F.col("leader.component"))
            .select(F.least("id", "leader.id").alias("a"), F.greatest("id", "leader.id").alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = durable(pairs)
        found = _confirmed(_likely(pairs, named, settings), texts, settings)
        links = durable(found if links is None else links.unionByName(found))
        tested = pairs if tested is None else tested.unionByName(pairs)
        reached = components(links)
    more = durable(_links_across(_placed(members, reached), texts, settings))
    if reached is None or not more.isEmpty():
        reached = components(more if links is None else links.unionByName(more))

    by_class = classes.select("set_hash", "id").join(reached, "id", "left").select(
        "set_hash", F.coalesce("component", "id").alias("component_id")
    )
    grouped = signed.where(some).join(by_class, "set_hash")
    alone = signed.where(~some).withColumn("component_id", F.col("id"))
    columns = ["id", "n_shingles", "component_id"]
    out = grouped.select(*columns).unionByName(alone.select(*columns))
    return out.select(
        F.col("id").alias(key),
        "n_shingles",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _links_across(placed: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) that join components which meet in a bucket: at least as many as it takes.

    Buckets of one component are done. The members of the others are joined to clusters, block
    numbers are dealt by hash, and a block pair holds two blocks at most.
    """
    spans = placed.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("first")
    )
    mixed = durable(placed.join(spans.where("low <> high").select("bucket", "first"), "bucket"))
    clusters = components(mixed.select(F.col("id").alias("a"), F.col("first").alias("b"))).select(
        "id", F.col("component").alias("cluster")
    )
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / F.lit(settings.block)).cast("int")
    own = mixed.select("id", "component").distinct().join(clusters, "id").join(sizes, "cluster")
    dealt = own.select(
        "cluster", "id", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")
    )
    # A block meets itself and every other one: as many copies of a row as its cluster has blocks.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = dealt.join(texts, "id").select(
        "cluster", "id", "component", "text", "block", other
    ).select(
        "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "text"
    )
    kind = rows.schema["id"].dataType.simpleString()

    def joined(group: pa.Table) -> pa.Table:
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        order = np.argsort(group["block"].to_numpy(), kind="stable")
        ids, comps = (np.array(group[c].to_pylist(), object)[order] for c in ("id", "component"))
        column = group["text"]
        sets = [shingle_hashes(column[int(k)].as_py(), settings.words) for k in order]
        found = spanning_links(sets, list(comps), settings.percent, int((group["block"].to_numpy() == i).sum()) if i != j else 0)
        kinds = group.schema.field("id").type
        return pa.table([pa.array([ids[x] for x, _ in found], kinds), pa.array([ids[y] for _, y in found], kinds)], ["a", "b"])

    return rows.groupBy("cluster", "i", "j").applyInArrow(joined, f"a {kind}, b {kind}")


def spanning_links(sets: list[np.ndarray], comps: list, percent: int, first: int = 0) -> list[tuple[int, int]]:
    """Links between sets of different components that join all components that links join.

    With ``first``, only pairs of one of the first so many sets and one of the others are looked at.
    """
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    number = {c: k for k, c in enumerate(dict.fromkeys(comps))}
    group = np.array([number[c] for c in comps])
    if len(number) < 2:
        return []
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    # Hashes of one set alone are in no intersection.
    common = times[at] > 1
    column = (np.cumsum(times > 1) - 1)[at[common]]
    owner = owner[common]
    rows, columns = (slice(0, first), slice(first, n)) if first else (slice(0, n), slice(0, n))
    shared = np.zeros((len(range(n)[rows]), len(range(n)[columns])), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 8192
    for start in range(0, int((times > 1).sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        bits = np.zeros((n, width), np.float32)
        bits[owner[lo:hi], column[lo:hi] - start] = 1
        shared += bits[rows] @ bits[columns].T
    shared = shared.astype(np.int64)
    linked = 100 * shared >= percent * (size[rows][:, None] + size[columns][None, :] - shared)
    linked &= (shared > 0) & (group[rows][:, None] != group[columns][None, :])
    # One link for each pair of components that a union still finds apart.
    root = list(range(len(number)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, shift = [], columns.start
    for x, y in zip(*np.nonzero(linked), strict=True):
        a, b = find(group[x]), find(group[y + shift])
        if a != b:
            root[a] = b
            out.append((int(x), int(y) + shift))
    return out
