"""Token ids of a byte-level BPE file, each word of a run of texts encoded once."""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The split pattern of byte-level BPE. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """``ids(texts)``: little-endian 16- or 32-bit ids that ``tokenizers`` gives without special tokens.

    A space followed by anything but white space begins a new piece of the split pattern, so a text can
    be cut before each such space. The words of many texts are encoded together, each different one
    once, and put into place by their numbers. A text whose spaces meet other white space is encoded
    whole, and so is one with a special token's text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        vocab = spec["model"]["vocab"]
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        split = spec.get("pre_tokenizer") or {}
        if (
            spec["model"]["type"] != "BPE"
            or spec.get("normalizer")
            or split.get("type") != "ByteLevel"
            or split.get("add_prefix_space")
            or not split.get("use_regex", True)
            or spec["model"].get("ignore_merges")
        ):
            self.words = None
            return
        import tiktoken

        char = _byte_chars()
        special = set(self.special)
        ranks = {bytes(char[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: Of each id, whether it begins with a space.
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each of ``texts``; null has none. All are held at once, so hand over runs of bounded size."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts, "")
        if self.words is None:
            return [self._whole(t) for t in texts.to_pylist()]
        split = pc.split_pattern(texts, " ")
        words, at = split.values.dictionary_encode(), split.offsets.to_numpy()
        place, known = words.indices.to_numpy(), words.dictionary
        # A word that is empty or begins with white space follows a space that may begin no piece.
        unsafe = pc.or_(pc.equal(known, ""), pc.utf8_is_space(pc.utf8_slice_codeunits(known, 0, 1)))
        known = pc.if_else(unsafe, "x", known)
        line = pc.binary_join(pa.ListArray.from_arrays([0, len(known)], known), " ")[0].as_py()
        ids = self._numbers(" " + line)
        first = np.append(np.flatnonzero(self.begins[ids]), len(ids))
        # The first word of a text has no space before it and is encoded alone.
        later = np.ones(len(place), bool)
        later[at[:-1]] = False
        sizes = np.where(later, np.diff(first)[place], 0)
        ends = np.cumsum(sizes)
        places = np.repeat(first[:-1][place] - (ends - sizes), sizes)
        places += np.arange(len(places))
        joined, width = ids[places].tobytes(), self.dtype.itemsize
        to = (ends[at[1:] - 1] * width).tolist()
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        odd = np.add.reduceat(unsafe.to_numpy(zero_copy_only=False)[place] & later, at[:-1]) > 0
        heads = split.values.take(pa.array(at[:-1])).to_pylist()
        found = [self._numbers(h).tobytes() + joined[a:b] for h, a, b in zip(heads, [0, *to], to, strict=False)]
        for i in np.flatnonzero(special | odd).tolist():
            text = texts[i].as_py()
            found[i] = self._whole(text) if special[i] else self._numbers(text).tobytes()
        return found

    def _numbers(self, text: str) -> np.ndarray:
        return self.words.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


def _byte_chars() -> dict[str, int]:
    """The byte that each character of the vocabulary file stands for: printable ones stand for
    themselves, the others in order for those from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """Once for each Python worker."""
    return ByteBpe(path)
