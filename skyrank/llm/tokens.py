"""Token ids of whole texts from public tokenizers, with one look-up per stretch of text.

A text is cut before white space that follows other text, and for byte-level BPE also behind runs of ASCII letters.  No token of
the tokenizers used here reaches over such a cut, so each stretch has the same ids wherever it stands.  The stretches of some
megabytes become a dictionary; a worker remembers the ids of stretches it has met and asks the tokenizer only for new ones.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

_ASCII_BLANK = np.zeros(256, bool)
_ASCII_BLANK[[*range(9, 14), 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER = ~_LETTER & (np.arange(256) < 128)
#: The rest of Unicode's White_Space property, as UTF-8.
_BLANKS = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: Stretches a worker remembers (twice that for a while), and the longest of them in bytes.
REMEMBERED, LONGEST = 300_000, 48


def cuts_of_words(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where stretches begin: texts, ASCII white space behind a character that is no white space, and
    other ASCII characters behind an ASCII letter.
    """
    at = np.flatnonzero(_OTHER[data])
    at = at[at > 0]
    before = data[at - 1]
    letter, blank = _LETTER[before], _ASCII_BLANK[before]
    late = np.flatnonzero(before >= 0x80)
    for sign in _BLANKS:
        same = late[at[late] >= len(sign)]
        for i, byte in enumerate(sign):
            same = same[data[at[same] - len(sign) + i] == byte]
        blank[same] = True
    return _joined(at[letter | (_ASCII_BLANK[data[at]] & ~blank)], starts)


def cuts_at_spaces(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where stretches begin: texts, and each run of ASCII spaces."""
    space = data == 32
    return _joined(np.flatnonzero(space[1:] & ~space[:-1]) + 1, starts)


def _joined(cuts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    every = np.concatenate([cuts, starts])
    every.sort(kind="stable")
    return every[np.diff(every, prepend=-1) != 0]


class Memo:
    """Ids of texts by way of their stretches; what was not met for a while is forgotten."""

    def __init__(self, cut: Callable, encode: Callable[[list[bytes]], list[bytes]]):
        self.cut, self.encode_new, self.known, self.old = cut, encode, {}, {}

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has.

        ``data`` are the UTF-8 bytes of the texts and ``bounds`` the n + 1 offsets into them.
        """
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
        starts = bounds[:-1][np.diff(bounds) > 0]
        cuts = self.cut(data, starts)
        parts = pa.Array.from_buffers(pa.large_binary(), len(cuts), [
            None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        found = pa.array(self._look_up(parts.dictionary.to_pylist()), pa.large_binary()).take(parts.indices)
        _, offsets, ids = found.buffers()
        ends = np.frombuffer(offsets, np.int64)[found.offset:found.offset + len(found) + 1] // 4
        flat = np.frombuffer(ids, "<u4", int(ends[-1])).astype(np.int64)
        return flat, np.diff(ends[np.searchsorted(cuts, bounds)])

    def _look_up(self, parts: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.old = {}, self.known
        out = list(map(self.known.get, parts))
        missed = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in missed:
            out[i] = self.old.get(parts[i])
            if out[i] is None:
                new.append(i)
        for i, ids in zip(new, self.encode_new([parts[i] for i in new])):
            out[i] = ids
        self.known.update((parts[i], out[i]) for i in missed if len(parts[i]) <= LONGEST)
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(4)
def byte_bpe(path: str, plain_specials: bool = False) -> Memo:
    """A byte-level BPE file of the ``tokenizers`` library.

    ``plain_specials``: the strings of special tokens inside a text are ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"    # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain_specials
    stop = tokenizer.token_to_id("Ċ")    # the newline byte
    simple = re.compile(f" ?[^{re.escape(''.join(map(chr, np.flatnonzero(_ASCII_BLANK))))}{b''.join(_BLANKS).decode()}]+").fullmatch
    word, model = re.compile(rb" ?[A-Za-z]+").fullmatch, tokenizer.model
    specials = [] if plain_specials else [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]

    def cut(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        cuts, whole = cuts_of_words(data, starts), data.tobytes() if specials else b""
        for special in specials:    # a special token stays in one piece
            at = whole.find(special)
            while at >= 0:
                inside = slice(*np.searchsorted(cuts, [at + 1, at + len(special)]))
                cuts = np.delete(cuts, inside)
                at = whole.find(special, at + len(special))
        return _joined(cuts, starts)

    def encode(parts: list[bytes]) -> list[bytes]:
        # a run of ASCII letters is one word to the model; of the rest, stretches without inner or odd white
        # space are asked for some at a time, a newline between them
        out = [_packed([t.id for t in model.tokenize(p.decode().replace(" ", "Ġ"))]) if len(p) <= LONGEST and word(p) else None for p in parts]
        left = [i for i, x in enumerate(out) if x is None]
        text = {i: parts[i].decode() for i in left}
        plain = [i for i, t in text.items() if len(t) <= LONGEST and simple(t)] if stop is not None else []
        groups = [plain[i:i + 64] for i in range(0, len(plain), 64)]
        for some, e in zip(groups, tokenizer.encode_batch_fast(["\n".join([text[i] for i in g]) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == stop), len(ids)).tolist()
            packed, a = ids.tobytes(), 0
            for i, b in zip(some, ends):
                out[i] = packed[4 * a:4 * b]
                a = b + 1
        rest = [i for i in left if out[i] is None]
        for i, e in zip(rest, tokenizer.encode_batch_fast([text[i] for i in rest], add_special_tokens=False)):
            out[i] = _packed(e.ids)
        return out

    return Memo(cut, encode)


@lru_cache(4)
def pieces(path: str) -> Memo:
    """A ``sentencepiece`` model with byte fallback, over texts to which a space has been added in front."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    lone = _packed([model.piece_to_id("▁")])
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in names):
        raise ValueError("a piece has a space behind other text; stretches of text do not tokenise on their own")

    def encode(parts: list[bytes]) -> list[bytes]:
        # the model adds the first space of a stretch itself, but not to an empty text
        ids = model.encode([p[1:].decode() for p in parts], num_threads=1)
        return [lone if p == b" " else _packed(x) for p, x in zip(parts, ids)]

    return Memo(cuts_at_spaces, encode)


def largest_id(path: str) -> int:
    from tokenizers import Tokenizer
    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


def byte_level_spellings(path: str) -> tuple[pa.Array, np.ndarray]:
    """The bytes of every entry of a byte-level BPE file, and their lengths."""
    from tokenizers import Tokenizer
    names = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    # the alphabet of such files: printable bytes stand for themselves, the others for code points from 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    entries = [b""] * (max(names.values()) + 1)
    for name, number in names.items():
        entries[number] = bytes(code[c] for c in name) if all(c in code for c in name) else name.encode()
    return pa.array(entries, pa.large_binary()), np.array([len(e) for e in entries], np.int64)


def piece_spellings(path: str) -> tuple[pa.Array, np.ndarray]:
    """The same for a piece model."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        entries.append(bytes([int(name[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", name) else name.replace("▁", " ").encode())
    return pa.array(entries, pa.large_binary()), np.array([len(e) for e in entries], np.int64)
