"""Token ids of many texts at once, with the ids of words that a worker has met kept for the next batch."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ship

# Words in these letters (Latin-1) are cut and lower-cased here as the tokenizer does it; any other word
# goes through the tokenizer whole. Fixed value: the split pattern of the vocabulary file, for Latin-1.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"\n|\x00|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n\x00]+")
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_ODD = "\x00"  # stands for a word that goes through the tokenizer whole
KEPT = 400_000  # pieces whose ids a worker keeps


def _byte_letters() -> dict[int, str]:
    """Letters that stand for the bytes in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class _Table(dict):
    """Piece to its number; the ids of piece k are flat[start[k]:start[k + 1]]. The line end is number 0."""

    def __init__(self, encode) -> None:
        super().__init__({"\n": 0})
        self.encode, self.flat, self.start = encode, array("I"), array("q", [0, 0])

    def __missing__(self, piece: str) -> int:
        self.flat.extend(self.encode(piece))
        self.start.append(len(self.flat))
        self[piece] = n = len(self.start) - 2
        return n


class Words:
    """Ids of the words of a text. White space never joins or changes words in the vocabularies that drop it,
    so a text's ids are those of its words, one after the other."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            steps = (json.load(f).get("pre_tokenizer") or {}).get("pretokenizers") or []
        if not any(s.get("pattern", {}).get("Regex") == _SPLIT for s in steps):
            raise ValueError("a vocabulary of words with word ends that drops white space is needed")
        self.whole = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.table = _Table(self._ids)

    def _ids(self, piece: str) -> list[int]:
        if piece[0] == _ODD:
            return self.whole.encode(piece[1:], add_special_tokens=False).ids
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.whole.model.tokenize(spelled)]

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of the pieces of all words, each word closed by 0."""
        odd = []
        lines = "\n".join(words)
        if "<|" in lines or not _PLAIN.fullmatch(lines.replace("\n", "")):
            odd = [w for w in words if "<|" in w or not _PLAIN.fullmatch(w)]
            rare = set(odd)
            lines = "\n".join(_ODD if w in rare else w for w in words)
        pieces = _PIECES.findall(lines.lower() + "\n")
        if odd:
            whole = iter(odd)
            pieces = [_ODD + next(whole) if p == _ODD else p for p in pieces]
        if len(self.table) > KEPT:
            self.table = _Table(self._ids)
        return np.fromiter(map(self.table.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts (NULL is empty); ids before each text (n + 1 numbers); ids before the end of
        each word; whether a sentence ends with the word."""
        texts = pc.fill_null(column, "") if column.null_count else column
        split = pc.ascii_split_whitespace(texts)
        before_row = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        word = coded.indices.to_numpy().astype(np.int64)
        if len(distinct) == 0:
            return (np.empty(0, dtype=np.uint32), np.zeros(len(column) + 1, dtype=np.int64),
                    np.empty(0, dtype=np.int64), np.empty(0, dtype=bool))
        number = self._numbers(distinct)
        start = np.frombuffer(self.table.start, dtype=np.int64)
        flat = _gather(np.frombuffer(self.table.flat, dtype=np.uint32), start[number], np.diff(start)[number])
        closed = np.cumsum(np.diff(start)[number])[number == 0]
        size = np.diff(closed, prepend=0)
        closes = pc.match_substring_regex(coded.dictionary, "[.!?]$").to_numpy(zero_copy_only=False)
        ends = np.cumsum(size[word])
        starts = np.concatenate(([0], ends))[before_row]
        return _gather(flat, (closed - size)[word], size[word]), starts, ends, closes[word]


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices flat[start:start + size], one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start - (ends - size), size)]


_KEPT: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """The worker's tokenizer for this file."""
    if path not in _KEPT:
        _KEPT[path] = Words(path)
    return _KEPT[path]


ship(__name__)
