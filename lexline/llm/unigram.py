"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton gives all vocabulary pieces that end at a character. Dynamic programming
carries, for each character, the best score of a path to it, the number of pieces on that path and
whether it ends in an unknown character; nothing is kept to walk back. Ties go to the piece that
begins first, as in the tokenizer, and unknown characters in a row are one piece. Words are counted
one by one, as the tokenizer cuts before each space, and their counts are kept in a bounded cache.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark of a space, and what an unknown character scores below the lowest piece. Fixed values.
SPACE, PENALTY = "▁", 10.0


class _Counts(dict):
    """Pieces of a word, found when first asked for. It forgets all when it is full."""

    def __init__(self, count, most: int = 400_000):
        self.count, self.most = count, most

    def __missing__(self, word: str) -> int:
        n = self.count(SPACE + word)
        if len(self) >= self.most:
            self.clear()
        if len(word) < 64:
            self[word] = n
        return n


class Unigram:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - PENALTY
        self.words = _Counts(self.count)

    def count(self, word: str) -> int:
        """Pieces on the best path through ``word``."""
        ending: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, piece in self.automaton.iter(word):
            ending[end].append(piece)
        score, pieces, unknown = [0.0], [0], [False]
        for i, c in enumerate(word):
            best = None
            # Longest first, so the earliest beginning wins a tie.
            for length, own in sorted(ending[i], reverse=True):
                s = score[i + 1 - length] + own
                if best is None or s > best:
                    best, n, u = s, pieces[i + 1 - length] + 1, False
            if c not in self.single and (best is None or score[i] + self.unknown > best):
                best, n, u = score[i] + self.unknown, pieces[i] + (not unknown[i]), True
            score.append(best)
            pieces.append(n)
            unknown.append(u)
        return pieces[-1]

    def text_count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        words = (marked[1:] if marked[0] == SPACE else marked).split(SPACE)
        return sum(map(self.words.__getitem__, words))


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Unknown, then all ordinary pieces of a sentencepiece file with their scores, as a unigram model."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(file.get_piece_size()) if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i))]
    return [("<unk>", 0.0), *[(file.id_to_piece(i), file.get_score(i)) for i in ids]]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    """Once for each Python worker."""
    return Unigram(vocabulary(path))


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``n_tokens``, replaced if it is there.

    ``path`` is a sentencepiece file, the same on all machines. A null or empty text has no tokens;
    repeated rows are counted each; texts are read whole.
    """
    base = docs.drop(*[c for c in docs.columns if c.lower() == "n_tokens"])
    place, out = base.columns.index(text), base.withColumn("n_tokens", F.lit(0).cast("long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            n = pa.array([model.text_count(t.as_py()) for t in batch.column(place)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], schema=pa.schema([*batch.schema, pa.field("n_tokens", pa.int64())]))

    return base.mapInArrow(count, out.schema)
