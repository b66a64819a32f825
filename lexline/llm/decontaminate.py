"""Find and cut passages of test items in documents with a generalised suffix automaton.

The automaton of the items' words knows every run of words of every item. A document streams
through it word by word; the state and the length of the longest run that ends here are all it
needs. Where that run is as long as a window, its words are hit.

Items are a reference set: they are read in blocks of at most ``max_words`` words, one automaton
each, so what is sent to the workers has a fixed bound. With more than one block the documents
pass once for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexline.session import durable

#: Bytes of text that are worked on and given back together, one document more at most.
BATCH_BYTES = 4 << 20

#: Bytes that stand between words; A-Z are lowered first.
_WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPLIT = bytes(b if b in _WORD_BYTES else 32 for b in _LOWER)
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
_LOWER_CHARS = {b: b + 32 for b in range(65, 91)}


def words(text: str | bytes | None) -> list[bytes]:
    """Words of digits, letters a-z and anything outside ASCII."""
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_SPLIT).split()


class SuffixAutomaton:
    """Of the word sequences of several items, with the items that each window stands in."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        items = [(name, ws) for name, ws in items if ws]
        self.window = window
        self.ids: dict[bytes, int] = {}
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for name, ws in items]
        self.link, self.length = [-1], [0]
        step: list[dict[int, int]] = [{}]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(step, last, w)
        self.width = max(1, len(self.ids))
        self.step = {v * self.width + w: to for v, nexts in enumerate(step) for w, to in nexts.items()}
        # By the state that holds a window, or the whole of a shorter item: its words and items.
        found: dict[int, dict[int, set[str]]] = {}
        for name, ws in coded:
            m, v = min(window, len(ws)), 0
            for i, w in enumerate(ws):
                v = self.step[v * self.width + w]
                while self.length[self.link[v]] >= m and self.link[v] > 0:
                    v = self.link[v]
                if i + 1 >= m:
                    found.setdefault(v, {}).setdefault(m, set()).add(name)
        # All marks that the runs ending in a state carry, from it up its links.
        self.carried: dict[int, list[tuple[int, frozenset[str]]]] = {}
        own = {v: [(m, frozenset(names)) for m, names in by.items()] for v, by in found.items()}
        for v in sorted(range(len(self.length)), key=self.length.__getitem__):
            upper = self.carried.get(self.link[v], []) if v else []
            if v in own or upper:
                self.carried[v] = own.get(v, []) + upper

    def _extend(self, step: list[dict[int, int]], last: int, w: int) -> int:
        """The state of the run ``last`` followed by ``w``, made where it is missing."""
        old = step[last].get(w)
        if old is not None:
            if self.length[old] == self.length[last] + 1:
                return old
            return self._copy(step, last, w, old)
        new = self._state(step, self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        elif self.length[step[p][w]] == self.length[p] + 1:
            self.link[new] = step[p][w]
        else:
            self.link[new] = self._copy(step, p, w, step[p][w])
        return new

    def _state(self, step: list[dict[int, int]], length: int, nexts: dict[int, int]) -> int:
        step.append(nexts)
        self.length.append(length)
        self.link.append(0)
        return len(step) - 1

    def _copy(self, step: list[dict[int, int]], p: int, w: int, old: int) -> int:
        """Part the runs of ``old`` that are no longer than ``p`` and one word into a state of their own."""
        new = self._state(step, self.length[p] + 1, dict(step[old]))
        self.link[new], self.link[old] = self.link[old], new
        while p >= 0 and step[p].get(w) == old:
            step[p][w] = new
            p = self.link[p]
        return new

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Spans of hit words (from, to), apart and in order; items; the longest run."""
        ids, step, link, length, width = self.ids, self.step, self.link, self.length, self.width
        carried, spans, names, longest = self.carried, [], set(), 0
        v = n = 0
        for i, word in enumerate(ws):
            w = ids.get(word)
            if w is None:
                v = n = 0
                continue
            to = step.get(v * width + w)
            while to is None:
                v = link[v]
                n = length[v]
                to = step.get(v * width + w)
            v, n = to, n + 1
            if n > longest:
                longest = n
            if v in carried:
                for m, own in carried[v]:
                    if n >= m:
                        spans.append((i + 1 - (n if m >= self.window else m), i + 1))
                        names |= own
        return merged(spans), names, longest


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def find_spans(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    max_words: int = 250_000,
) -> DataFrame:
    """The columns of ``docs`` with ``n_words``, ``longest``, ``spans`` and ``items``.

    ``spans`` holds runs of hit word numbers, from 0 and without the end; ``items`` the ids of all
    items with an occurring window, as text, in order. A null or empty text has no words. Items
    without words or without an id match nothing, repeated items count once, and without items nothing
    is hit. If ``docs`` has columns of these four names, they are replaced.
    """
    return _found(docs, items, window, text, item_id, item_text, max_words, None)


def remove_passages(
    docs: DataFrame,
    items: DataFrame,
    *,
    max_run: int = 0,
    max_share: float = 0.5,
    window: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    max_words: int = 250_000,
) -> DataFrame:
    """``remove_spans`` of ``find_spans``, found and cut in one pass over the texts."""
    cut = (max_run, max_share)
    return _found(docs, items, window, text, item_id, item_text, max_words, cut)


def _found(docs, items, window, text, item_id, item_text, max_words, cut) -> DataFrame:
    spark, names = docs.sparkSession, {"n_words", "longest", "spans", "items"}
    found = docs.drop(*[c for c in docs.columns if c.lower() in names])
    found = found.withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "longest": F.lit(0).cast("long"),
            "spans": F.array().cast("array<struct<from:long,to:long>>"),
            "items": F.array().cast("array<string>"),
        }
    )
    schema = found.schema
    place = schema.fieldNames().index(text)
    chosen = items.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")
    )
    blocks = _blocks(((r["id"], words(r["text"])) for r in chosen.toLocalIterator()), max_words)
    block, first = next(blocks), True
    while block is not None:
        later = next(blocks, None)
        if not first:
            found = durable(found)
        automaton = spark.sparkContext.broadcast(SuffixAutomaton(block, window))
        mark = _marker(automaton, place, cut if later is None else None)
        found, first, block = found.mapInArrow(mark, schema), False, later
    return found


def _blocks(items: Iterable[tuple[str, list[bytes]]], max_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """At least one block, so that words are counted without any items too."""
    block, held = [], 0
    for name, ws in items:
        if block and held + len(ws) > max_words:
            yield block
            block, held = [], 0
        block.append((name, ws))
        held += len(ws)
    yield block


def _runs(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``BATCH_BYTES`` of text each."""
    start, held = 0, 0
    for i, t in enumerate(batch.column(place)):
        held += t.as_buffer().size if t.is_valid else 0
        if held >= BATCH_BYTES or i == batch.num_rows - 1:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0


def _marker(automaton, place: int, cut: tuple[int, float] | None):
    """Marks spans; with ``cut`` also takes the longer ones out, and documents that are mostly hit."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton.value
        for whole in batches:
            for batch in _runs(whole, place):
                earlier = [batch.column(batch.num_columns - k) for k in (3, 2, 1)]
                rows, marks, texts = [], [], []
                for i, t in enumerate(batch.column(place)):
                    body = t.as_py()
                    ws = words(body)
                    spans, names, most = machine.scan(ws)
                    before = [(s["from"], s["to"]) for s in earlier[1][i].as_py()]
                    spans = merged([*spans, *before]) if before else spans
                    if cut is not None:
                        if sum(b - a for a, b in spans) > cut[1] * len(ws):
                            continue
                        texts.append(without(body, [(a, b) for a, b in spans if b - a > cut[0]]))
                    rows.append(i)
                    marks.append(
                        (
                            len(ws),
                            max(most, earlier[0][i].as_py()),
                            [{"from": a, "to": b} for a, b in spans],
                            sorted(names | set(earlier[2][i].as_py())),
                        )
                    )
                if len(rows) < batch.num_rows:
                    batch = batch.take(pa.array(rows, pa.int64()))
                columns = batch.columns[:-4]
                if cut is not None:
                    columns[place] = pa.array(texts, batch.schema.field(place).type)
                marks = list(zip(*marks, strict=True)) or [()] * 4
                for values, field in zip(marks, list(batch.schema)[-4:], strict=True):
                    columns.append(pa.array(values, field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return mark


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])


def remove_spans(
    found: DataFrame, *, max_run: int = 0, max_share: float = 0.5, text: str = "text"
) -> DataFrame:
    """Result of ``find_spans`` without the passages: spans of more than ``max_run`` words are cut
    out of the text, and a document of whose words more than ``max_share`` are hit goes as a whole.
    Spans shorter than a window are whole items of few words; by default these are cut as well.

    A cut takes the text from the first character of the first word to the last of the last, and
    leaves all else as it is. Documents without such spans are returned unchanged, null texts too.
    """
    rows = found.where(n_hit(F.col("spans")) <= F.lit(max_share) * F.col("n_words"))
    names = rows.columns
    place, at_spans = names.index(text), names.index("spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(at_spans).to_pylist()
            texts = [
                without(t.as_py(), [(s["from"], s["to"]) for s in own if s["to"] - s["from"] > max_run])
                for t, own in zip(batch.column(place), spans, strict=True)
            ]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rows.mapInArrow(cut, rows.schema)


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words numbered in ``spans``, and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER_CHARS))]
    out, end = [], 0
    for lo, hi in spans:
        out.append(text[end : places[lo][0]])
        end = places[hi - 1][1]
    return "".join([*out, text[end:]])
