"""Language by a string kernel: n-gram presence, Nystrom landmarks, kernel ridge regression.

Two texts are alike by the n-grams, of several lengths together, that stand in both; how often does
not count. A bounded sample of labelled texts is learned from: some are landmarks, all are mapped to
their likeness to these, and a ridge regression against each language in turn gives its weights.
A text is then scored by its row of n-gram bits times the landmarks' bits times the weights, a
batch of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexline.llm.common import uniform

_LETTER = regex.compile(r"\p{L}")
#: Characters that are turned into n-grams at a time; a longer text takes several turns.
_PIECE = 1 << 20
#: Texts scored in one product.
_ROWS = 64
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``per_language`` labelled texts are learned from for each language, longer ones by a piece of
    ``train_chars`` characters; ``landmarks`` of them are landmarks. n-grams are hashed to ``bits`` bits."""

    orders: tuple[int, ...] = (2, 3, 4)
    per_language: int = 250
    landmarks: int = 25
    train_chars: int = 20_000
    bits: int = 20
    ridge: float = 1e-2


def grams(text: str, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a text in lower case, one array for each order and piece."""
    most = max(orders)
    for at in range(0, max(1, len(text)), _PIECE):
        piece = text[at : at + _PIECE + most - 1].lower()
        codes = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
        h = np.zeros(len(codes), np.uint32)
        for n in range(1, most + 1):
            if len(codes) < n:
                break
            # Of the n characters that begin here.
            h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(1)
            if n in orders:
                mixed = h * np.uint32(0x9E3779B1)
                yield (mixed >> np.uint32(32 - bits)).astype(np.int32)


@dataclass
class Model:
    """``place`` gives a hash's column or none (-1), ``bits`` the landmarks' columns, ``weights`` one
    column for each language with the intercept last."""

    settings: Settings
    languages: list[str]
    place: np.ndarray
    bits: np.ndarray
    weights: np.ndarray

    def likeness(self, rows: np.ndarray) -> np.ndarray:
        return _normed(rows @ self.bits.T, rows.sum(1), self.bits.sum(1))

    def scores(self, texts: list[str]) -> np.ndarray:
        rows = np.zeros((len(texts), self.bits.shape[1]), np.float32)
        for i, text in enumerate(texts):
            for h in grams(text, self.settings.orders, self.settings.bits):
                columns = self.place[h]
                rows[i, columns[columns >= 0]] = 1
        like = self.likeness(rows)
        return like @ self.weights[:-1] + self.weights[-1]


def _normed(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return shared / np.sqrt(np.maximum(a, 1)[:, None] * np.maximum(b, 1)[None, :])


def sample(labelled: DataFrame, settings: Settings, key: str = "doc_id", seed: int = 3) -> DataFrame:
    """At most ``per_language`` rows (lang, n, text) of each language, picked by a hash of the key.

    Languages are counted first, and each gives about twice what is needed to the ranking, so no
    language is ranked as a whole. Of a text longer than ``train_chars`` a piece from anywhere is taken.
    """
    beyond = F.length("text") - settings.train_chars
    start = 1 + F.floor(uniform(seed + 1, F.col(key)) * (beyond + 1)).cast("int")
    piece = F.when(beyond > 0, F.substr("text", start, F.lit(settings.train_chars))).otherwise(F.col("text"))
    fit = labelled.select(
        F.col("lang").cast("string").alias("lang"), piece.alias("text"), uniform(seed, F.col(key)).alias("u"), key
    )
    counts = fit.groupBy("lang").agg(F.count("*").alias("rows"))
    chance = F.lit(2.0 * settings.per_language + 50) / F.col("rows")
    chosen = fit.join(F.broadcast(counts), "lang").where(F.col("u") < chance)
    n = F.row_number().over(Window.partitionBy("lang").orderBy("u", key, "text"))
    return chosen.select("lang", n.alias("n"), "text").where(F.col("n") <= settings.per_language)


def fit(labelled: DataFrame, settings: Settings = Settings(), key: str = "doc_id") -> Model | None:
    """Learn from rows with ``text`` and ``lang``; None where there are none."""
    orders, bits = settings.orders, settings.bits

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.concatenate([*grams(t.as_py(), orders, bits), np.empty(0, np.int32)])) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f.tobytes() for f in found], pa.binary())],
                ["lang", "n", "grams"],
            )

    named = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = sample(named, settings, key).mapInArrow(featured, "lang string, n int, grams binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["n"]))
    found = [np.frombuffer(r["grams"], np.int32) for r in rows]
    languages = sorted({r["lang"] for r in rows})
    marks = [i for i, r in enumerate(rows) if r["n"] <= settings.landmarks]
    known = np.unique(np.concatenate([found[i] for i in marks]))
    place = np.full(1 << bits, -1, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    features = np.zeros((len(rows), max(1, len(known))), np.float32)
    for i, f in enumerate(found):
        columns = place[f]
        features[i, columns[columns >= 0]] = 1
    model = Model(settings, languages, place, features[marks], np.zeros(0))

    like = model.likeness(features).astype(np.float64)
    values, vectors = np.linalg.eigh(like[marks])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # to coordinates in which the kernel is a product
    z = np.hstack([like @ root, np.ones((len(rows), 1))])
    target = np.array([[1.0 if r["lang"] == x else -1.0 for x in languages] for r in rows])
    penalty = settings.ridge * len(rows) / max(1, len(languages)) * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    w = np.linalg.lstsq(z.T @ z + penalty, z.T @ target, rcond=None)[0]
    model.weights = np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32)
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``lang_pred`` and ``lang_score``, replaced if they are there.

    A null text, one without a letter, and every text without a model is ``und`` with score 0. The
    score is half the winning regression's value plus a half, held between 0 and 1; ties go to the
    first language by name. Texts are read whole.
    """
    names = {"lang_pred", "lang_score"}
    base = docs.drop(*[c for c in docs.columns if c.lower() in names])
    out = base.withColumns({"lang_pred": F.lit(UNKNOWN), "lang_score": F.lit(0.0)})
    if model is None:
        return out
    place, sent = base.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                texts = batch.column(place).to_pylist()
                lettered = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
                names, values = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if lettered:
                    scores = learned.scores([texts[i] for i in lettered])
                    best = scores.argmax(1)
                    values[lettered] = np.clip(scores[np.arange(len(best)), best] / 2 + 0.5, 0, 1)
                    for i, b in zip(lettered, best, strict=True):
                        names[i] = learned.languages[b]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names), pa.array(values)],
                    schema=pa.schema([*batch.schema, pa.field("lang_pred", pa.string()), pa.field("lang_score", pa.float64())]),
                )

    return base.mapInArrow(score, out.schema)
