"""Toxicity by a learned lexicon, found with misspellings, weighed by context.

The lexicon holds words, and beginnings of words, that stand in toxic training documents far more
often than chance allows. It is a trie; words of a text run through the trie intersected with
the Levenshtein automaton of distance one, made deterministic as far as texts ask for it, so most
words are done after a few characters. A hit inside quotation marks, or with a word of reporting
close before it, counts as quoted. What exact, stem, misspelled and quoted hits say about a
document is learned from the same training documents by a logistic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexline.llm.common import uniform

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_SPLIT = "[^\\p{L}\\p{M}\\p{N}]+"
_OPEN, _CLOSE = "\"“„«‘", "\"”“»’"
#: Kinds of hits, from the strongest.
EXACT, STEM, FUZZY = 1, 2, 3
#: A count above this says no more than this.
_MOST = 3


@dataclass(frozen=True)
class Settings:
    """At most ``train_rows`` labelled documents are learned from, picked by a hash; at most
    ``max_terms`` terms and as many stems, those of the strongest evidence. ``evidence`` is the least
    log-likelihood ratio, ``odds`` the least ratio of shares. An entry must be the strongest of
    ``support`` toxic training texts at least, or stand in a quarter as many as such entries do:
    others stand beside those that tell. A quotation is looked for ``window`` characters before and after a hit."""

    train_rows: int = 20_000
    max_terms: int = 5_000
    evidence: float = 14.0
    support: int = 2
    odds: float = 40.0
    stem_lengths: tuple[int, ...] = (4, 5, 6)
    fuzzy_from: int = 4
    window: int = 60
    reporting: tuple[str, ...] = ("said", "says", "called", "quote", "quoted", "word", "term", "dijo", "sagte", "dit")


class Matcher:
    """Trie of terms and stems, walked together with a Levenshtein automaton of distance one.

    A state is a set of (node, edits, owed): ``owed`` is a character that must come next to finish
    an exchange of neighbours. States are numbered when they are first met.
    """

    def __init__(self, terms: list[str], stems: list[str], fuzzy_from: int = 4):
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, bool] = {}
        self.stem: set[int] = set()
        for t in terms:
            self.term[self._add(t)] = len(t) >= fuzzy_from
        for s in stems:
            self.stem.add(self._add(s))
        self.start()

    def _add(self, text: str) -> int:
        at = 0
        for c in text:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({})
            at = self.children[at][c]
        return at

    def start(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.kinds: list[int] = []
        self.first = self._state(self._skips({(0, 0, "")}))

    def _skips(self, found: set) -> frozenset:
        """With lexicon characters left out, one edit each."""
        more = {(child, 1, "") for node, e, owed in found if not e and not owed for child in self.children[node].values()}
        # An exact place says all that the same place with an edit does.
        return frozenset(x for x in found | more if not x[1] or x[2] or (x[0], 0, "") not in found)

    def _state(self, places: frozenset) -> int:
        if places not in self.number:
            self.number[places] = len(self.sets)
            self.sets.append(places)
            self.moves.append({})
            kind = 0
            for node, e, owed in places:
                if node in self.term and not owed and (not e or self.term[node]):
                    here = FUZZY if e else EXACT
                    kind = min(kind, here) if kind else here
            self.kinds.append(kind)
        return self.number[places]

    def _move(self, state: int, c: str) -> int:
        """-1: nothing can follow; -2: a stem is complete."""
        out = set()
        for node, e, owed in self.sets[state]:
            nexts = self.children[node]
            if owed:
                if c == owed:
                    out.add((node, 1, ""))
                continue
            if c in nexts:
                to = nexts[c]
                if not e and to in self.stem:
                    self.moves[state][c] = -2
                    return -2
                out.add((to, e, ""))
            if not e:
                out.add((node, 1, ""))
                for d, to in nexts.items():
                    if d != c:
                        out.add((to, 1, ""))
                        if c in self.children[to]:
                            out.add((self.children[to][c], 1, d))
        found = self._skips(out)
        if len(self.sets) > 200_000:
            # Rarely met; the walk goes on from a state of the new table.
            self.start()
            return self._state(found) if found else -1
        self.moves[state][c] = to = self._state(found) if found else -1
        return to

    def kind(self, word: str) -> int:
        """0 if the word is no hit, else EXACT, STEM or FUZZY; ``word`` is in lower case."""
        state, moves = self.first, self.moves
        for c in word:
            to = moves[state].get(c)
            if to is None:
                to = self._move(state, c)
                moves = self.moves
            if to < 0:
                # A whole term that begins with a stem is known by its stem.
                return STEM if to == -2 else 0
            state = to
        return self.kinds[state]


@dataclass
class Lexicon:
    settings: Settings
    terms: list[str]
    stems: list[str]
    #: Words that only look like a term: they stand in clean training documents.
    clean: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))
    matcher: Matcher | None = None

    def __getstate__(self):
        return {**self.__dict__, "matcher": None}

    def counts(self, text: str) -> tuple[int, int, int, int]:
        """Exact, stem, misspelled and quoted hits of a whole text."""
        if self.matcher is None:
            self.matcher = Matcher(self.terms, self.stems, self.settings.fuzzy_from)
        kind, low, found = self.matcher.kind, text.lower(), [0, 0, 0, 0]
        for m in _WORD.finditer(low):
            k = kind(m.group())
            if k and not (k == FUZZY and m.group() in self.clean):
                found[3 if self._quoted(low, *m.span()) else k - 1] += 1
        return tuple(found)

    def _quoted(self, text: str, lo: int, hi: int) -> bool:
        before = text[max(0, lo - self.settings.window) : lo].rpartition("\n")[2]
        after = text[hi : hi + self.settings.window].partition("\n")[0]
        for a, b in zip(_OPEN, _CLOSE, strict=True):
            begun = before.count(a) % 2 == 1 if a == b else before.rfind(a) > before.rfind(b)
            if begun and b in after:
                return True
        near = _WORD.findall(before)[-3:]
        return any(w in self.settings.reporting for w in near)

    def score(self, text: str | None) -> float:
        x = _inputs(np.array([self.counts(text)]) if text else np.zeros((1, 4)))
        return float(1 / (1 + np.exp(-(x @ self.weights)[0])))


def _inputs(counts: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(counts), 1)), np.log1p(np.minimum(counts, _MOST))])


def _logistic(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights for rows ``x`` with counts of either label, by Newton steps."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        n = toxic + clean
        slope = x.T @ (toxic - n * p) - penalty @ w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, key: str = "doc_id", seed: int = 5) -> DataFrame:
    """(text, toxic) of at most ``train_rows`` labelled documents; a document with several labels is
    toxic if one says so; null labels and null texts are left out. The chosen labels are sent to
    the documents, which stay where they are."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull())
        .groupBy(key)
        .agg((F.max("toxic") == 1).alias("toxic"))
        .orderBy(uniform(seed, F.col(key)), key)
        .limit(settings.train_rows)
    )
    # train_rows pairs of a key and a flag.
    rows = docs.join(F.broadcast(chosen), key).where(F.col("text").isNotNull())
    # Copies say the same thing once.
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic"))


def _evidence(df: DataFrame, n_toxic: int, n_clean: int, settings: Settings) -> DataFrame:
    """Rows (term, toxic, clean) of enough evidence, strongest first, at most ``max_terms``."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = n_toxic / (n_toxic + n_clean)
    part = lambda x, e: F.when(x > 0, x * F.ln(x / ((a + b) * e))).otherwise(0.0)
    g = 2 * (part(a, share) + part(b, 1 - share))
    odds = ((a + 0.5) / (n_toxic + 1)) / ((b + 0.5) / (n_clean + 1))
    return df.withColumn("g", g).where((F.col("g") >= settings.evidence) & (odds >= settings.odds)).orderBy(
        F.col("g").desc(), "term"
    ).limit(settings.max_terms)


def _counted(terms: Column, rows: DataFrame) -> DataFrame:
    hit = F.col("is_toxic")
    return (
        rows.select(F.col("toxic").alias("is_toxic"), F.explode(F.array_distinct(terms)).alias("term"))
        .groupBy("term")
        .agg(F.sum(F.when(hit, 1).otherwise(0)).alias("toxic"), F.sum(F.when(hit, 0).otherwise(1)).alias("clean"))
    )


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id") -> Lexicon:
    """Learn a lexicon and its weights; without labels of both kinds it is empty and scores 0.5 or the
    share that there is."""
    rows = training_rows(docs, labels, settings, key).withColumn(
        "words", F.filter(F.array_distinct(F.split(F.lower("text"), _SPLIT)), lambda w: F.length(w) > 2)
    )
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = total.get(True, 0), total.get(False, 0)
    terms, stems = [], []
    if n_toxic and n_clean:
        vocabulary = _counted(F.col("words"), rows)
        words = _evidence(vocabulary, n_toxic, n_clean, settings).collect()
        starts = F.flatten(
            F.transform(
                F.col("words"),
                lambda w: F.transform(
                    F.filter(F.array(*map(F.lit, settings.stem_lengths)), lambda n: n < F.length(w)),
                    lambda n: F.substr(w, F.lit(1), n),
                ),
            )
        )
        begun = _evidence(_counted(starts, rows), n_toxic, n_clean, settings).collect()
        terms, stems = _supported(rows, words, _varied(words, begun), settings)
    lexicon = Lexicon(settings, terms, stems)
    if n_toxic and n_clean and (terms or stems):
        lexicon.clean = _lookalikes(vocabulary, lexicon)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([sent.value.counts(t.as_py()) for t in batch.column(0)]).reshape(-1, 4)
            columns = [pa.array(np.minimum(c, _MOST), pa.int32()) for c in found.T]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["e", "s", "f", "q", "toxic"])

    schema = "e int, s int, f int, q int, toxic boolean"
    seen = rows.select("text", "toxic").mapInArrow(cells, schema).groupBy("e", "s", "f", "q").agg(
        F.sum(F.when(F.col("toxic"), 1).otherwise(0)).alias("toxic"), F.count("*").alias("n")
    ).collect()
    if seen:
        x = _inputs(np.array([[r["e"], r["s"], r["f"], r["q"]] for r in seen]))
        toxic = np.array([r["toxic"] for r in seen], float)
        lexicon.weights = _logistic(x, toxic, np.array([r["n"] for r in seen]) - toxic)
    return lexicon


def _varied(words: list, begun: list) -> list:
    """Stems that no single word accounts for, the strongest of those that begin alike."""
    by_word = sorted((w["term"], w["toxic"]) for w in words)
    out = []
    for r in sorted(begun, key=lambda r: (-r["g"], -len(r["term"]), r["term"])):
        s = r["term"]
        if any(s.startswith(x["term"]) or x["term"].startswith(s) for x in out):
            continue
        if max((n for t, n in by_word if t.startswith(s)), default=0) < 0.8 * r["toxic"]:
            out.append(r)
    return out


def _supported(rows: DataFrame, words: list, stems: list, settings: Settings) -> tuple[list[str], list[str]]:
    """Terms and stems that are the strongest entry of enough toxic training texts."""
    entries = sorted([(-r["g"], False, r["term"]) for r in words] + [(-r["g"], True, r["term"]) for r in stems])
    rank = {(is_stem, t): i for i, (_, is_stem, t) in enumerate(entries)}

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ws in batch.column(0).to_pylist():
                own = [rank.get((False, w), len(rank)) for w in ws]
                own += [rank.get((True, w[:n]), len(rank)) for w in ws for n in settings.stem_lengths if len(w) > n]
                found.append(min(own, default=len(rank)))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], ["entry"])

    counts = rows.where("toxic").select("words").mapInArrow(strongest, "entry int").groupBy("entry").count()
    alone = {r["entry"] for r in counts.collect() if r["count"] >= settings.support and r["entry"] < len(rank)}
    in_texts = {(is_stem, r["term"]): r["toxic"] for is_stem, rs in ((False, words), (True, stems)) for r in rs}
    size = [in_texts[e[1:]] for e in entries]
    usual = sorted(size[i] for i in alone)[len(alone) // 2] if alone else 0
    kept = [i for i in range(len(entries)) if i in alone or size[i] >= max(5, usual / 4)]
    chosen = [entries[i] for i in kept]
    return [t for _, is_stem, t in chosen if not is_stem], [t for _, is_stem, t in chosen if is_stem]


def _lookalikes(vocabulary: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Words one edit from a term that clean training documents use as often as chance has it.

    They come from at most ``train_rows`` documents and lie next to at most ``max_terms`` terms.
    """
    sent = vocabulary.sparkSession.sparkContext.broadcast(lexicon)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        matcher = Matcher(own.terms, own.stems, own.settings.fuzzy_from)
        for batch in batches:
            ok = [matcher.kind(w.as_py()) == FUZZY for w in batch.column(0)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    clean = vocabulary.where("clean > 0 and clean >= toxic").select("term")
    return frozenset(r["term"] for r in clean.mapInArrow(near, "term string").collect())


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``toxicity``, from 0 to 1, replaced if it is there.

    Whole texts are read. A null or empty text has no hits and the score of such.
    """
    base = docs.drop(*[c for c in docs.columns if c.lower() == "toxicity"])
    place, sent = base.columns.index(text), docs.sparkSession.sparkContext.broadcast(lexicon)
    out = base.withColumn("toxicity", F.lit(0.0))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = sent.value
        for batch in batches:
            scores = [learned.score(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())],
                schema=pa.schema([*batch.schema, pa.field("toxicity", pa.float64())]),
            )

    return base.mapInArrow(rate, out.schema)
