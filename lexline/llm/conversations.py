"""Repair the structure of conversations: the cheapest edits after which roles alternate.

After the edits a conversation is empty, or an optional system message and then pairs of user and
assistant. A shortest path through four states finds them: nothing yet, after system, after user, after
assistant. Rows that must go cost the same in every state, so only the others, the live ones, are
steps. The path is computed backwards as a vector of costs to the end, one for each state.

Rank-convergence parallel Viterbi: a conversation above ``rows_per_chunk`` rows is cut into chunks,
and all chunks start at once from a speculative cost vector, that of the end. Vectors that
differ by a constant lead to the same edits, and after a few rows most vectors do. In a fix-up pass
a chunk reruns from the vector that its successor found, side by side with its first run, and stops
where the two differ by a constant alone. The vectors of a conversation are few, so a pass offers
all of them to all its chunks; passes go on until each chunk has been run from its true vector.
With these, each chunk is traced from all four states, and the states at the cuts are followed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexline.session import durable

ROWS_PER_CHUNK = 20_000
BYTES_PER_CHUNK = 32 << 20
#: Conversations that are cut, those with most rows; any other has less than that share of all rows.
MOST_LONG = 250_000
#: Characters of a text that order rows of one turn and role; rows with equal ones follow a hash.
ORDER_CHARS = 64
RESULTS_PER_BATCH = 2_000

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The one state that an inserted or renamed row can lead to, and the role it has.
TURN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
RENAME, DELETE, INSERT = 2, 3, 2
#: Costs from each state after the last row.
END = (0, 2 * INSERT, INSERT, 0)
PAIRS = {"su", "ua", "au"}

Vector = tuple[int, int, int, int]

# --- rows ---------------------------------------------------------------------------------------


def spaced(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows after the damage that crc32 of ``key:turn`` decides.

    A null in the checked text, a role or a text is one space. Dropped rows stay as marks with
    ``gone``, so that no conversation is lost.
    """
    name = F.concat(spaced(F.col(key)), F.lit(":"), spaced(F.col(turn)))
    kind = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    said = spaced(F.col(text))
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said)
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        F.col(key).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(spaced(F.col(role))).alias("role"),
        said.alias("text"),
        (kind == 0).alias("gone"),
        F.explode(times).alias("_copy"),
    ).drop("_copy")


#: Rows of a conversation in order. Rows alike in all of it are equal.
ORDER = ["turn", "role", "_head", "_hash"]


def ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_head": F.substring("text", 1, ORDER_CHARS), "_hash": F.xxhash64("text")})


def kind_of(role: str, truncated: bool) -> str:
    """A live row's part in the path: s, u, a or x for any other initial, upper case if truncated."""
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if truncated else initial


# --- costs and edits ----------------------------------------------------------------------------


@lru_cache(1 << 16)
def step(kind: str, after: Vector) -> tuple[Vector, int]:
    """Costs before a live row from those after it, as (costs less their minimum, minimum)."""
    late, initial = int(kind.isupper()), kind.lower()
    costs = []
    for state in range(4):
        best = min(DELETE + after[state], RENAME + late + after[TURN[state]])
        kept = KEPT.get((state, initial))
        costs.append(best if kept is None else min(best, late + after[kept]))
    for _ in range(2):  # two inserted rows lead to any state that is worth it
        costs = [min(c, INSERT + costs[TURN[state]]) for state, c in enumerate(costs)]
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(1 << 18)
def edits(kind: str, after: Vector, state: int) -> tuple[str, int]:
    """The cheapest edits at a live row, of equal ones the ASCII-least, and the state after them.

    ``D`` deletes the row, ``K`` keeps it, ``U`` and ``A`` rename it to user and assistant; ``u`` and ``a`` in
    front of it insert such a row.
    """
    before, least = step(kind, after)
    late, initial, made = int(kind.isupper()), kind.lower(), ""
    while True:
        now, turn = before[state] + least, TURN[state]
        if now == DELETE + after[state]:
            return made + "D", state
        if now == INSERT + before[turn] + least:
            made, state = made + ROLE[turn][0], turn
            continue
        kept = KEPT.get((state, initial))
        if kept is not None and now == late + after[kept]:
            return made + "K", kept
        return made + ROLE[turn][0].upper(), turn


def closing(state: int) -> str:
    """Rows inserted after the last row."""
    return {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}[state]


def backward(kinds: Iterable[str], end: Vector) -> tuple[list[Vector], int]:
    """Cost vectors before each live row and after the last, and the sum of what was taken off."""
    vectors, total = [end], 0
    for kind in reversed(list(kinds)):
        vector, least = step(kind, vectors[-1])
        vectors.append(vector)
        total += least
    return vectors[::-1], total


def rerun(kinds: list[str], end: Vector, known: Vector, start: Vector, total: int) -> tuple[Vector, int]:
    """The same as ``backward`` at the first row, given that ``known`` led to ``start`` and ``total``.

    Stops as soon as the two runs differ by a constant.
    """
    lead = 0
    for kind in reversed(kinds):
        if end == known:
            return start, total + lead
        end, a = step(kind, end)
        known, b = step(kind, known)
        lead, total = lead + a, total - b
    return (end, lead) if end != known else (start, total + lead)


def traced(kinds: list[str], vectors: list[Vector], state: int) -> tuple[list[str], int]:
    out = []
    for kind, after in zip(kinds, vectors[1:], strict=True):
        made, state = edits(kind, after, state)
        out.append(made)
    return out, state


# --- results ------------------------------------------------------------------------------------

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


class Finished:
    """Counts, audit and digest of one conversation, fed with its rows in order."""

    def __init__(self):
        self.counts = dict.fromkeys(COUNTS, 0)
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0
        self.state, self.initial = START, None
        self.first, self.last, self.turns = None, None, 0

    def line(self, role: str, text: str) -> None:
        self.digest.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def insert(self) -> None:
        self.state = TURN[self.state]
        self.line(ROLE[self.state], "")
        self.audit.append("I")
        self.counts["cost"] += INSERT

    def row(self, turn: int | None, role: str, text: str, made: str | None) -> None:
        """``made`` are the edits of a live row, None for a row that must go."""
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        initial = role[:1]
        self.counts["illegal"] += self.initial is not None and self.initial + initial not in PAIRS
        self.initial = initial
        body = text.rstrip(SPACE)
        late = bool(body) and made is not None and body[-1] not in ".!?"
        self.counts["truncated"] += late
        if made is None:
            self.counts["duplicate" if body else "blank"] += 1
            made = "D"
        for _ in made[:-1]:
            self.insert()
        edit = made[-1]
        if edit == "D":
            self.counts["cost"] += DELETE
        elif edit == "K":
            self.counts["cost"] += late
            self.state = KEPT[self.state, initial]
            self.line(role, text)
        else:
            self.counts["cost"] += RENAME + late
            self.state = TURN[self.state]
            self.line(ROLE[self.state], text)
        self.audit.append(edit if edit in "DK" else "R")

    def result(self) -> tuple:
        for _ in closing(self.state):
            self.insert()
        if self.first is not None:
            self.counts["gaps"] = self.last - self.first + 1 - self.turns
        return (*self.counts.values(), "".join(self.audit), self.digest.hexdigest())


def _batch(keys: list, results: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*results, strict=True))
    kinds = [pa.int64()] * len(COUNTS) + [pa.string()] * 2
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, kind), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
        ["conv_id", *COUNTS, "audit", "repaired_sha256"],
    )


def _grouped(batches: Iterator[pa.RecordBatch], open_group: Callable, add: Callable, close: Callable):
    """Results of runs of rows with equal first columns, batch by batch."""
    nothing = object()
    current, state, keys, results = nothing, None, [], []
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if current is nothing or row[0] != current:
                if current is not nothing:
                    keys.append(current)
                    results.append(close(state))
                current, state = row[0], open_group()
            add(state, row)
        if len(keys) >= RESULTS_PER_BATCH:
            yield _batch(keys, results, kind)
            keys, results = [], []
    if current is not nothing:
        yield _batch([*keys, current], [*results, close(state)], kind)


# --- conversations of one chunk -----------------------------------------------------------------


def whole(rows: list[tuple]) -> tuple:
    """The result of a conversation from its rows (turn, role, text) in order."""
    seen, kinds, live = set(), [], []
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        is_live = bool(body) and (role, text) not in seen
        live.append(is_live)
        if is_live:
            seen.add((role, text))
            kinds.append(kind_of(role, body[-1] not in ".!?"))
    vectors, _ = backward(kinds, END)
    made, _ = traced(kinds, vectors, START)
    made, done = iter(made), Finished()
    for is_live, row in zip(live, rows, strict=True):
        done.row(*row, next(made) if is_live else None)
    return done.result()


def short_conversations(rows: DataFrame) -> DataFrame:
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {RESULT}"

    def add(held: list, row: tuple) -> None:
        if not row[4]:
            held.append(row[1:4])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _grouped(batches, list, add, whole)

    return (
        ordered(rows)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", *ORDER)
        .select("conv_id", "turn", "role", "text", "gone")
        .mapInArrow(repair, schema)
    )


# --- conversations of many chunks ---------------------------------------------------------------

#: A run of a chunk: from the vector after it to the one before it, and the sum of what was taken off.
RUN = "no long, part int, end array<int>, start array<int>, total long"
REQUEST = "no long, part int, want array<int>, end array<int>, start array<int>, total long"
CHUNK = "no long, part int, end array<int>"
TRACE = "no long, part int, seq long, made array<string>, exits array<int>"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


def _kinds(chunk: pa.Table) -> list[str]:
    return chunk.sort_by("seq").column("kind").to_pylist()


def first_runs(live: DataFrame) -> DataFrame:
    def run(chunk: pa.Table) -> pa.Table:
        vectors, total = backward(_kinds(chunk), END)
        no, part = (chunk.column(c)[0].as_py() for c in ("no", "part"))
        return _table([(no, part, END, vectors[0], total)], RUN)

    return live.groupBy("no", "part").applyInArrow(run, RUN)


def _followed(runs: pa.Table) -> tuple[int, list[tuple], set, dict]:
    """The true vector after each chunk, from the last chunk on, as far as the runs reach."""
    known, parts = {}, set()
    for r in runs.to_pylist():
        known[r["part"], tuple(r["end"])] = (tuple(r["start"]), r["total"])
        parts.add(r["part"])
    vector, out = END, []
    for part in sorted(parts, reverse=True):
        out.append((part, vector))
        if (part, vector) not in known:
            break
        vector, _ = known[part, vector]
    return runs.column("no")[0].as_py(), out, parts, known


def requests(runs: DataFrame) -> DataFrame:
    """Runs that are still asked for: every vector met in a conversation, for every chunk of it."""

    def ask(group: pa.Table) -> pa.Table:
        no, out, parts, known = _followed(group)
        if len(out) == len(parts):
            return _table([], REQUEST)
        met = sorted({start for start, _ in known.values()})
        return _table(
            [
                (no, part, vector, END, *known[part, END])
                for part in sorted(parts)
                for vector in met
                if (part, vector) not in known
            ],
            REQUEST,
        )

    return runs.groupBy("no").applyInArrow(ask, REQUEST)


def fix_up(asked: DataFrame, live: DataFrame) -> DataFrame:
    def run(wanted: pa.Table, chunk: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return _table([], RUN)
        kinds, out = _kinds(chunk), []
        for r in wanted.to_pylist():
            want, end, start = (tuple(r[c]) for c in ("want", "end", "start"))
            out.append((r["no"], r["part"], want, *rerun(kinds, want, end, start, r["total"])))
        return _table(out, RUN)

    return asked.groupBy("no", "part").cogroup(live.groupBy("no", "part")).applyInArrow(run, RUN)


def true_ends(runs: DataFrame) -> DataFrame:
    def follow(group: pa.Table) -> pa.Table:
        no, out, _, _ = _followed(group)
        return _table([(no, part, vector) for part, vector in out], CHUNK)

    return runs.groupBy("no").applyInArrow(follow, CHUNK)


def traces(ends: DataFrame, live: DataFrame) -> DataFrame:
    """The edits of every live row, and the state after its chunk, for each state before its chunk."""

    def run(end: pa.Table, chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("seq")
        kinds = chunk.column("kind").to_pylist()
        vectors, _ = backward(kinds, tuple(end.column("end")[0].as_py()))
        paths = [traced(kinds, vectors, state) for state in range(4)]
        made, exits = zip(*[p[0] for p in paths], strict=True), [p[1] for p in paths]
        no, part = (chunk.column(c)[0].as_py() for c in ("no", "part"))
        seq = chunk.column("seq").to_pylist()
        return _table([(no, part, s, list(m), exits) for s, m in zip(seq, made, strict=True)], TRACE)

    return ends.groupBy("no", "part").cogroup(live.groupBy("no", "part")).applyInArrow(run, TRACE)


def entries(traced_rows: DataFrame) -> DataFrame:
    """(no, part, entry): the state before each chunk, followed from the first one."""

    def follow(group: pa.Table) -> pa.Table:
        state, out = START, []
        for r in group.sort_by("part").to_pylist():
            out.append((r["no"], r["part"], state))
            state = r["exits"][state]
        return _table(out, "no long, part int, entry int")

    chunks = traced_rows.groupBy("no", "part").agg(F.first("exits").alias("exits"))
    return chunks.groupBy("no").applyInArrow(follow, "no long, part int, entry int")


def long_conversations(rows: DataFrame, chunks: int) -> DataFrame:
    """Results of conversations whose rows (with ``no``) are cut into about ``chunks`` chunks.

    A chunk is what a range of the sort by conversation and order has of one conversation. Equal
    rows are told apart by their place in the input, so any conversation can be cut. The digest of
    a conversation needs its lines one after the other: they stream through one task, which holds no
    more than the audit.
    """
    marked = ordered(rows).withColumn("_row", F.monotonically_increasing_id())
    sort = ["no", *ORDER, "_row"]
    placed = durable(
        marked.repartitionByRange(chunks, *sort)
        .sortWithinPartitions(*sort)
        .withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()})
        .drop("_head", "_hash", "_row")
    )
    body = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    late = ~F.substring(body, -1, 1).isin(".", "!", "?")
    live = durable(
        placed.where(~F.col("gone") & (body != ""))
        .groupBy("no", "role", F.sha2("text", 256))
        .agg(F.min(F.struct("seq", "part", F.when(late, F.upper(kind)).otherwise(kind).alias("kind"))).alias("at"))
        .select("no", "at.part", "at.seq", "at.kind")
    )
    runs = durable(first_runs(live))
    while True:
        asked = durable(requests(runs))
        if asked.isEmpty():
            break
        runs = runs.unionByName(durable(fix_up(asked, live)))
    found = durable(traces(durable(true_ends(runs)), live))
    made = found.join(entries(found), ["no", "part"]).select("seq", F.element_at("made", F.col("entry") + 1).alias("made"))

    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {RESULT}"

    def add(done: Finished, row: tuple) -> None:
        if not row[4]:
            done.row(*row[1:4], row[5])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _grouped(batches, Finished, add, Finished.result)

    return (
        placed.join(made, "seq", "left")
        .repartition("no")
        .sortWithinPartitions("no", "seq")
        .select("conv_id", "turn", "role", "text", "gone", "made")
        .mapInArrow(finish, schema)
    )


def repair(
    rows: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    rows_per_chunk: int = ROWS_PER_CHUNK,
    bytes_per_chunk: int = BYTES_PER_CHUNK,
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for
    each conversation of ``rows``, after the damage of ``damaged``.

    Rows without a key are one conversation. Rows are taken by turn, without one first; rows of one
    turn by role, the first 64 characters of the text and a hash of it, so equal rows are neighbours.
    A null role or text is one space: such a text is blank, such a role is none of the three. A
    conversation whose rows are all dropped has zeros, an empty audit and the digest of nothing.
    Other columns are left aside; an empty table gives no rows.
    """
    rows_per_chunk, bytes_per_chunk = max(1, rows_per_chunk), max(1, bytes_per_chunk)
    narrow = damaged(rows, key, turn, role, text)
    size = F.sum(F.octet_length("text"))
    counts = narrow.groupBy("conv_id").agg(F.count("*").alias("rows"), size.alias("bytes"))
    above = (F.col("rows") > rows_per_chunk) | (F.col("bytes") > bytes_per_chunk)
    # At most MOST_LONG rows are broadcast.
    long = durable(
        counts.where(above)
        .orderBy(F.desc("rows"), "conv_id")
        .limit(MOST_LONG)
        .withColumn("no", F.monotonically_increasing_id())
    )
    n, total, total_bytes = long.agg(F.count("*"), F.sum("rows"), F.sum("bytes")).first()
    if not n:
        return short_conversations(narrow)
    names = F.broadcast(long.select(F.col("conv_id").alias("_id"), "no"))
    split = narrow.join(names, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    short = short_conversations(split.where(F.col("no").isNull()).drop("no"))
    chunks = 1 + int(max(total / rows_per_chunk, total_bytes / bytes_per_chunk))
    return short.unionByName(long_conversations(split.where(F.col("no").isNotNull()), chunks))
