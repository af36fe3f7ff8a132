"""Fast whole-text encoding with files of the `tokenizers` library.

A text is cut where the tokenizer's own pre-tokenizer always cuts: at spaces and, where no apostrophe or
unusual character could matter, around runs of punctuation marks. Arrow numbers the distinct pieces, every distinct piece goes once through the library's normalizer, pre-tokenizer and model, and a
text's ids are gathered from its pieces' ids. Texts in which a cut could matter (runs of white space,
control separators, special-token strings) go to the library whole.
"""

from __future__ import annotations

import gc
import os
from codecs import charmap_decode
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces, and pre-tokens of pieces, that a worker remembers; beyond it they are forgotten. Affects speed only.
REMEMBERED, WORDS = 400_000, 120_000
#: Bytes of text encoded together.
TOGETHER = 5_000_000

_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = r"[\x00\x01\x{1c}-\x{1f}\x{85}]"
_RUN = r"[!-&(-/:-@\[-`{-~]+"  # of ASCII marks but the apostrophe
_UNUSUAL = r"'|[^\x00-\x7f\p{L}]"
#: Byte-level models show a byte as itself where it prints, else as the next free character from 256.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}
_TABLE = "".join(chr(_SHOWN.get(b, b)) for b in range(256))


def _quoted(text: str) -> str:
    """A pattern for the text itself."""
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{{{ord(c):x}}}" for c in text)


class Encoder:
    """ids of whole texts; `spaced`: a space belongs to the word after it (byte-level BPE), else white
    space is dropped (word BPE). Special tokens' strings in a text become their ids, as the library has it;
    with `special_as_text` they are ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.cut, self.normalize, self.model = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.normalizer, self.tokenizer.model
        # the two kinds that can be cut at spaces: a space joins the next word, or vanishes
        probe = [p for p, _ in self.cut(self.normalize.normalize_str(" Ab c") if self.normalize else " Ab c")]
        if len(probe) != 2:
            raise ValueError("no known rule for cutting texts before this pre-tokenizer")
        self.spaced = len(probe[0]) == 3
        self.space = probe[0][0] if self.spaced else ""
        if self.normalize and self.normalize.normalize_str("Ab") != "ab":
            raise ValueError("no known rule for this normalizer")
        # texts in which a string of the added tokens may stand, in either case
        added = "|".join(_quoted(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content)
        self.odd = (f" (?:{_SPACES}|\\z)|{_ODD}" if self.spaced else _ODD) + (f"|(?i:{added})" if added else "")
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.start, self.count, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def _word(self, word: str) -> tuple[int, ...]:
        """ids of one pre-token, written as the model expects it."""
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= WORDS:
                self.words.clear()
            ids = self.words[word] = tuple([t.id for t in self.model.tokenize(word)])
        return ids

    def _piece(self, piece: str) -> Sequence[int]:
        if self.normalize and not piece.isascii():
            piece = self.normalize.normalize_str(piece)
        lead = self.space if self.spaced and piece[:1] == " " else ""
        base = piece[1:] if lead else piece
        if base.isalpha():  # one pre-token by any of these rules, remembered as a piece
            return [t.id for t in self.model.tokenize(lead + (base if base.isascii() else charmap_decode(base.encode(), "strict", _TABLE)[0]))]
        return tuple(i for word, _ in self.cut(piece) for i in self._word(word))

    def _learn(self, new: list[str]) -> None:
        """Encodes pieces for the first time."""
        collecting = gc.isenabled()
        gc.disable()  # many small objects, none in cycles
        tokenize, other = self.model.tokenize, self._piece
        if self.spaced and not self.normalize:  # most pieces are one word, written byte by byte with its space
            got = [[t.id for t in tokenize(charmap_decode(p.encode(), "strict", _TABLE)[0])] if (p[1:] if p[:1] == " " else p).isalpha() else other(p) for p in new]
        else:
            got = [other(p) for p in new]
        if collecting:
            gc.enable()
        counts = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(got), np.int32, int(counts.sum()))
        first = len(self.index)
        self.index.update(zip(new, range(first, first + len(new)), strict=True))
        if first + len(new) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros(max(len(x), len(new)), np.int64)]) for x in (self.start, self.count))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        self.start[first : first + len(new)] = self.used + np.cumsum(counts) - counts
        self.count[first : first + len(new)] = counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Number of each piece in the memory."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        numbers = list(map(self.index.get, distinct))
        new = [k for k, n in enumerate(numbers) if n is None]
        if new:
            first = len(self.index)
            self._learn([distinct[k] for k in new])
            for n, k in enumerate(new, first):
                numbers[k] = n
        return np.array(numbers, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def _cut_all(self, texts: pa.Array) -> pa.Array:
        """Each text's pieces; a piece's leading space is kept where it matters."""
        if not self.spaced:
            texts = pc.ascii_lower(texts)
        plain = pc.invert(pc.match_substring_regex(texts, pattern=_UNUSUAL))
        if self.spaced:
            marked = pc.replace_substring_regex(texts, pattern=f" ?{_RUN}|\n+", replacement="\x01\\0\x01")
            return pc.split_pattern(pc.replace_substring(pc.if_else(plain, marked, texts), pattern=" ", replacement="\x01 "), "\x01")
        return pc.utf8_split_whitespace(pc.if_else(plain, pc.replace_substring_regex(texts, pattern=_RUN, replacement=r" \0 "), texts))

    def _some(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.index) > REMEMBERED:
            self._clear()
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        odd = pc.match_substring_regex(texts, pattern=self.odd).to_numpy(zero_copy_only=False).astype(bool)
        for k in np.flatnonzero(odd).tolist():
            out[k] = np.asarray(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.int32)
        kept = np.flatnonzero(~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
        if not len(kept):
            return out
        plain = texts.take(pa.array(kept))
        lists = self._cut_all(plain)
        pieces, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        if not len(pieces):
            return out
        numbers = self._numbers(pieces)
        n = self.count[numbers]
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[numbers] - upto + n, n) + np.arange(upto[-1])]
        bounds = np.concatenate([[0], upto])[np.concatenate([[0], ends])]
        for k, a, b in zip(kept.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[k] = ids[a:b]
        return out

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """int32 ids of each text, in order."""
        from ._common import by_size

        texts = texts.cast(pa.large_string())
        for a, b in by_size(texts, pc.binary_length(texts).to_pylist(), TOGETHER):
            yield from self._some(texts[a:b])
            pa.default_memory_pool().release_unused()  # workers live on, for other stages too


_LOADED: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder a worker process and file."""
    if (path, special_as_text) not in _LOADED:
        _LOADED[path, special_as_text] = Encoder(path, special_as_text)
    return _LOADED[path, special_as_text]
