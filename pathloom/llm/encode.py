"""Exact tokenizer output for whole texts from cached pieces.

The tokenizers split a text into words before they merge anything, and no word
crosses the places where a piece is cut here, so the ids of a text are the ids
of its pieces in order:

* ``words``: for tokenizers that drop white space; pieces are the runs outside
  ``[\\x20\\x09-\\x0D]``, cut further where their pattern always ends a word
  (``_fine_pieces``) and, if they lower-case, lower-cased where this is the same
  for every character alone (ASCII and U+00C0 to U+00FF).  A text that may hold
  an added token is not cut further.  Pieces of such letters alone are one word
  each and go to the model as they are.
* ``spaced``: for byte-level tokenizers whose words may begin with a space; a
  piece is a run of those six characters and the run of others after it, cut
  further where their pattern always ends a word (``_spaced_pieces``), unless the
  text may hold an added token.  Pieces of letters, of digits or of marks alone
  are one word each, a space before them included, and go to the model as they
  are.  A text that has other white space (where such a cut could fall inside a
  run) is encoded whole.
* ``whole``: for all other tokenizers; every text is encoded whole.

``mode_of`` reads from the tokenizer's file which of these holds.

Pieces are encoded once and kept in a bounded cache of the worker.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from . import shared
from .words import _LOWER, _SPACE, buffers, split_words

MOST_PIECES, SLICE = 500_000, 8 << 20

_ODD = np.zeros(256, bool)
_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: UTF-8 forms of the other white space (and of U+180E, U+200B-D, which some tables count as such).
_ODD_FORMS = frozenset(
    c.encode() for c in ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", "᠎", *map(chr, range(0x2000, 0x200E)), " ", " ", " ", " ", "⁠", "　"]
)


def _odd_rows(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows whose text has other white space."""
    found = [i for i in np.flatnonzero(_ODD[raw]).tolist() if any(bytes(raw[i : i + k]) in _ODD_FORMS for k in (1, 2, 3))]
    return np.unique(np.searchsorted(offs, found, "right") - 1) if found else np.zeros(0, np.int64)


# Kinds of bytes: letters, digits, marks, the apostrophe, the second byte of a letter of U+00C0 to U+00FF (set where it follows 0xC3), others 0.
_LETTER, _DIGIT, _MARK, _APOSTROPHE, _LATIN = range(1, 6)
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]], _KIND[48:58] = _LETTER, _DIGIT
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]], _KIND[39] = _MARK, _APOSTROPHE
_LATINS = np.zeros(256, bool)
_LATINS[0x80:0xC0], _LATINS[[0x97, 0xB7]] = True, False
#: Whether a word always ends between two kinds: before and after a digit, between letters and marks; contractions begin with the
#: apostrophe.  Every cut is before an ASCII character, which composes with none before it.
_ENDS = np.zeros((8, 8), bool)
_ENDS[:, _DIGIT] = _ENDS[_DIGIT, 1:5] = True
_ENDS[np.ix_([_LETTER, _LATIN], [_MARK, _APOSTROPHE])] = _ENDS[_MARK, _LETTER] = True
_ENDS = _ENDS.ravel()
_LOWER_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


#: The same for words that may begin with a space and hold several digits.  No cut is after an apostrophe and before a letter.
_SPACED_ENDS = np.zeros((8, 8), bool)
_SPACED_ENDS[_LETTER, [_DIGIT, _MARK, _APOSTROPHE]] = _SPACED_ENDS[_DIGIT, [_LETTER, _MARK, _APOSTROPHE]] = True
_SPACED_ENDS[_MARK, [_LETTER, _DIGIT]] = _SPACED_ENDS[_APOSTROPHE, _DIGIT] = True
_SPACED_ENDS = _SPACED_ENDS.ravel()
_SPACED_WORD = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-/:-@\[-`{-~]+)")


def _spaced_pieces(raw: np.ndarray, offs: np.ndarray, added: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(pieces, pointers).

    Of a run of white space before something else, the last character is a piece of its own or, if it is a space, begins the next one.
    """
    low = _LOWER[raw].tobytes()
    held = [i for a in added for m in re.finditer(re.escape(a), low) for i in range(*m.span())]
    cut, ws = np.zeros(len(raw) + 1, bool), _SPACE[raw]
    kind = _KIND[raw]
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    second = second[_LATINS[raw[second]]]
    kind[second] = kind[second - 1] = _LETTER
    cut[1:-1] = _SPACED_ENDS[kind[:-1] * np.uint8(8) + kind[1:]]
    last = ws[:-1] & ~ws[1:]
    last[offs[(offs > 0) & (offs < len(raw))] - 1] = False
    cut[:-2] |= last
    cut[1:-1] |= last & (raw[:-1] != 32)
    if held:
        row = np.unique(np.searchsorted(offs, held, "right") - 1)
        for a, b in zip(offs[row].tolist(), offs[row + 1].tolist()):
            cut[a:b] = False
    cut[1:-1] |= ws[1:] & ~ws[:-1]
    cut[offs] = True
    at = np.flatnonzero(cut).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))])
    return pieces, np.searchsorted(at, offs)


def _fine_pieces(texts: pa.Array, lower: bool, added: list[bytes]) -> tuple[pa.Array, np.ndarray, bool]:
    """(pieces, pointers, whether they were cut further and, with ``lower``, lower-cased)."""
    words, ptr = split_words(texts, lower=False)
    raw, offs = buffers(words)
    low = _LOWER[raw]
    if not len(raw) or any(low.tobytes().find(a) >= 0 for a in added):
        return words, ptr, False
    kind = _KIND[raw]
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    kind[second[_LATINS[raw[second]]]] = _LATIN
    cut = np.empty(len(raw), bool)
    cut[1:] = _ENDS[kind[:-1] * np.uint8(8) + kind[1:]]
    cut[offs[:-1]] = True
    at = np.append(np.flatnonzero(cut), len(raw))
    if lower:
        low[second] += np.where((raw[second] < 0x9F) & (raw[second] != 0x97), 0x20, 0).astype(np.uint8)
        odd = raw >= 0x80
        odd[second] = False
        odd &= raw != 0xC3
        odd = np.flatnonzero(odd)
        if len(odd):  # other characters may compose with a letter, by its case
            of = np.zeros(len(at) - 1, bool)
            of[np.searchsorted(at, odd, "right") - 1] = True
            low = np.where(np.repeat(of, np.diff(at)), raw, low)
    pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(low if lower else np.ascontiguousarray(raw))])
    return pieces, np.searchsorted(at[:-1], offs[ptr]), True


# The parts of tokenizer files for which the cuts above are right.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False}
_PLAIN_NORMALIZERS = [{"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}]


def mode_of(path: str) -> str:
    """How texts may be cut for the tokenizer of a file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for t in spec.get("added_tokens") or []:
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or any(c.isspace() for c in t["content"]):
            return "whole"
    if spec.get("truncation") or (spec.get("model") or {}).get("dropout"):
        return "whole"
    normalizer, split = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    steps = [] if normalizer is None else normalizer.get("normalizers", [normalizer])
    if not steps and split.items() >= _BYTES.items() and split.get("use_regex"):
        return "spaced"
    parts = split.get("pretokenizers", [split])
    first = {"type": "Split", "pattern": {"Regex": _WORD_PATTERN}, "behavior": "Removed", "invert": True}
    if all(x in _PLAIN_NORMALIZERS for x in steps) and parts[0] == first and all(x.items() >= _BYTES.items() and not x.get("use_regex") for x in parts[1:]):
        return "words"
    return "whole"


class Encoder:
    """``encode(texts)`` gives (uint32 ids of all texts, pointers), as the tokenizer gives them for each whole text."""

    def __init__(self, path: str, mode: str | None = None):
        mode = mode or mode_of(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.mode = Tokenizer.from_file(path), mode
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normalizer, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        self.lower = mode == "words" and {"type": "Lowercase"} in normalizer.get("normalizers", [normalizer])
        self.added = [t["content"].encode().lower() for t in spec.get("added_tokens") or []]
        #: Pieces that are one word, and the model's own form of their characters; none if it is not plainly bytes.
        self.word, self.letters = _SPACED_WORD if mode == "spaced" else _LOWER_LETTERS, None
        plain = not any(map(_SPACED_WORD.fullmatch, self.added)) if mode == "spaced" else self.lower and len(split.get("pretokenizers", ())) == 2
        if plain and spec.get("post_processor") is None:
            some = [*range(32, 127), *range(0xC0, 0x100)] if mode == "spaced" else [*range(97, 123), *range(0xDF, 0x100)]
            self.letters = {10: "\n"} | {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in some if c not in (0xD7, 0xF7)}
        self.slot: dict[bytes, int] = {}
        self.ids, self.ptr = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int32)

    def _forget(self) -> None:
        """Keep the pieces that most slices used, at most half of the room."""
        n = len(self.slot)
        uses = self.uses[:n]
        keep = np.flatnonzero(uses >= max(2, np.partition(uses, n - MOST_PIECES // 2)[n - MOST_PIECES // 2]))[: MOST_PIECES // 2]
        names = list(self.slot)
        size = self.ptr[keep + 1] - self.ptr[keep]
        ends = np.concatenate([[0], np.cumsum(size)])
        self.ids = self.ids[np.repeat(self.ptr[keep] - ends[:-1], size) + np.arange(ends[-1])]
        self.ptr, self.uses = ends, np.append(uses[keep] // 2, np.int32(0))
        self.slot = {names[i]: k for k, i in enumerate(keep.tolist())}

    def _learn(self, pieces: list[bytes], fine: bool) -> None:
        model = self.tokenizer.model
        for i in range(0, len(pieces), 4096):
            words, rest = [], pieces[i : i + 4096]
            if fine and self.letters is not None:
                whole = list(map(self.word.fullmatch, rest))
                words, rest = [p for p, m in zip(rest, whole) if m], [p for p, m in zip(rest, whole) if not m]
            forms = b"\n".join(words).decode().translate(self.letters).split("\n") if words else []
            got = [[t.id for t in model.tokenize(w)] for w in forms]
            got += [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in rest], add_special_tokens=False)]
            part, n, size = words + rest, len(self.slot), np.fromiter(map(len, got), np.int64, len(got))
            first, flat = self.ptr[n], np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))
            while n + len(part) + 1 > len(self.ptr):
                self.ptr = np.concatenate([self.ptr, np.zeros_like(self.ptr)])
                self.uses = np.concatenate([self.uses, np.zeros(len(self.ptr) - len(self.uses), np.int32)])
            while first + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + 1, np.uint32)])
            self.ids[first : first + len(flat)] = flat
            self.ptr[n + 1 : n + 1 + len(part)] = first + np.cumsum(size)
            self.slot.update(zip(part, range(n, n + len(part))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.mode == "whole":
            got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.concatenate([[0], np.cumsum([len(g) for g in got], dtype=np.int64)])
        raw, offs = buffers(texts)
        whole = _odd_rows(raw, offs) if self.mode == "spaced" else np.zeros(0, np.int64)
        if self.mode == "spaced":
            pieces, ptr, fine = *_spaced_pieces(raw, offs, self.added), True
        else:
            pieces, ptr, fine = _fine_pieces(texts, self.lower, self.added)
        coded = pieces.dictionary_encode()
        text, at = buffers(coded.dictionary)
        text, at = text.tobytes(), at.tolist()
        kinds = [text[a:b] for a, b in zip(at, at[1:])]
        if len(self.slot) > MOST_PIECES:
            self._forget()
        self._learn([k for k in kinds if k not in self.slot], fine)
        slots = np.fromiter(map(self.slot.__getitem__, kinds), np.int64, len(kinds))
        self.uses[slots] += 1
        at = slots[coded.indices.to_numpy(zero_copy_only=False)] if len(pieces) else np.zeros(0, np.int64)
        size = self.ptr[at + 1] - self.ptr[at]
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        out = self.ids[np.repeat(self.ptr[at] - ends[:-1], size) + np.arange(ends[-1])]
        out_ptr = ends[ptr]
        if len(whole):
            rows = [out[a:b] for a, b in zip(out_ptr[:-1], out_ptr[1:])]
            got = self.tokenizer.encode_batch([texts[int(i)].as_py() for i in whole], add_special_tokens=False)
            for i, e in zip(whole, got):
                rows[i] = np.array(e.ids, np.uint32)
            out, out_ptr = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return out, out_ptr


_encoders: dict = {}
shared.caches.append(_encoders.clear)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, ptr: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each text."""
    n = len(ptr) - 1
    return np.insert(ids, ptr[1:], np.uint32(end)), ptr + np.arange(n + 1)
