"""The word tokenizer: whole texts as ids, word by word.

Splitting a text at ASCII white space and encoding the words one by one gives
the ids of the whole text: the vocabulary's normaliser and its splitting
pattern never look across white space, and its special tokens hold none.

A null or empty text has no ids. A text of any length is encoded word by word,
so memory follows its words, and a word that repeats is encoded once a worker.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa

from .common import remembered

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker remembers.
MEMO = 1_000_000
#: Parts of words that a worker remembers besides.
PARTS = 1 << 19
#: Words that are encoded in one call.
CALL = 512
#: Marks that end a run of letters, and the last letter that counts as Latin here.
MARKS, LATIN = string.punctuation.encode(), "\u024f"


def tokenizer(path: str | None = None):
    def load():
        import public_tokenizers
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        out.no_truncation()
        out.no_padding()
        return out

    return remembered(("tokenizer", path), load)


def pieces(path: str | None = None) -> pa.Array:
    """The table of pieces, in the order of ids: UTF-8 with a space after each. decode() of a vocabulary without a decoder gives
    the pieces with a space between. As large as the vocabulary, about 50,000 entries."""

    def load():
        t = tokenizer(path)
        known = {i: piece.encode() + b" " for piece, i in t.get_vocab().items()}
        return pa.array([known.get(i) for i in range(max(known) + 1)], pa.large_binary())

    return remembered(("pieces", path), load)


def id_type(path: str | None = None) -> str:
    """The narrowest of two little-endian types that hold the vocabulary's ids."""
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def _encoded(words: list[bytes], path: str | None) -> list[bytes]:
    """Ids of each word, in the vocabulary's id_type; many words a call."""
    kind = np.dtype(id_type(path))
    encode, out = tokenizer(path).encode, []
    for i in range(0, len(words), CALL):
        part = words[i : i + CALL]
        found = encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, kind).tobytes()
        ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(part)), side="right") * kind.itemsize
        last = 0
        for end in ends.tolist():
            out.append(ids[last:end])
            last = end
    return out


def _pieces_encoded(pieces: list[str]) -> list[bytes]:
    """Ids of pieces that parts_of gives, by VOCABULARY's model alone: nothing else in the tokenizer changes them, except that
    bytes stand as letters."""

    def load():
        from tokenizers.pre_tokenizers import ByteLevel

        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        return {c: shown(chr(c))[0][0] for c in range(0x80, ord(LATIN) + 1)}

    kind, letters, model = np.dtype(id_type()), remembered("bytes as letters", load), tokenizer().model.tokenize
    found = [[t.id for t in model(p if p.isascii() else p.translate(letters))] for p in pieces]
    ids = np.array([i for x in found for i in x], kind).tobytes()
    ends = np.cumsum([0, *map(len, found)]) * kind.itemsize
    return [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def parts_of(word: bytes) -> tuple[str, str] | None:
    """A word of Latin letters with ASCII marks behind them: the letters in lower case, and the marks or nothing. VOCABULARY's
    splitting pattern parts them, and its normaliser lowers letters and leaves both as they are. None for any other word."""
    letters = word.rstrip(MARKS)
    lower = letters.decode().lower()
    if lower.isalpha() and max(lower) <= LATIN:
        return lower, word[len(letters) :].decode()
    return None


def encoded_words(words: list[bytes], path: str | None = None) -> list[bytes]:
    """Ids of each word, in the vocabulary's id_type. With VOCABULARY, letters and marks are encoded apart, once a worker: most
    rare words differ from others in case or marks only."""
    if path is not None:
        return _encoded(words, path)
    table = remembered("parts of words", lambda: {"": b""})
    parts = list(map(parts_of, words))
    new = {x for p in parts if p for x in p if x not in table}
    if new:
        new = list(new)
        if len(table) + len(new) > PARTS:
            table = {x: table[x] for p in parts if p for x in p if x in table}
        table.update(zip(new, _pieces_encoded(new)))
    others = iter(_encoded([w for w, p in zip(words, parts) if not p], None))
    return [table[p[0]] + table[p[1]] if p else next(others) for p in parts]


class WordIds(dict):
    """word -> ids. Words beyond MEMO are encoded whenever they are met: the first million hold the frequent ones."""

    def __init__(self, path: str | None = None):
        self.path = path

    def texts(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text. Each word is looked up once; those not remembered are encoded together."""
        found, new, holes = [], {}, []
        for text in texts:
            words = text.split() if text else []
            parts = list(map(self.get, words))
            found.append(parts)
            i = -1
            while True:
                try:
                    i = parts.index(None, i + 1)
                except ValueError:
                    break
                holes.append((parts, i, words[i]))
                new[words[i]] = b""
        if new:
            new = dict(zip(new, encoded_words(list(new), self.path)))
            for parts, i, word in holes:
                parts[i] = new[word]
            if len(self) + len(new) <= MEMO:
                self.update(new)
        return list(map(b"".join, found))


def word_ids(path: str | None = None) -> WordIds:
    """A worker's memory of words."""
    return remembered(("words", path), lambda: WordIds(path))
