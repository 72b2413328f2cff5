"""Token ids of whole texts by the tokenizers library, each distinct word encoded once in a worker."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from tokenizers import Tokenizer

from .scan import Table, buffers, bytes_hash

#: Words that a worker remembers; beyond it starts anew.
REMEMBERED = 1_500_000
#: Bytes of a text that are read at once.
AT_ONCE = 1 << 18
#: One space or line feed between two characters that are no white space: no piece of the tokenizers below reaches across it.
_GAP = re.compile(r"(?<=\S)[ \n](?=\S)")
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Normalizer and pre-tokenizer of the tokenizers of which that is known. Others encode whole texts.
PARTED = [
    (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    ),
]
_SPACES = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_LETTERS = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_encoders: dict[str, Encoder] = {}


class Encoder:
    """encode() gives the ids of Tokenizer.encode(text, add_special_tokens=False); special tokens' strings are ordinary text.

    The pre-tokenizers in PARTED always part a non-space from a following space or line feed, and a letter from a following
    full stop or comma. So a text is the sequence of its words, each with the one space or line feed before it, and each is
    encoded once and remembered: it is looked up by a hash, and its bytes are compared. Texts with any other or repeated
    white space, or with a word whose hash another one has, are encoded without memory, in stretches that end at such a gap;
    so are all texts of other tokenizers, in one go.
    """

    def __init__(self, path: str):
        self.whole, self.listed = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        kind = json.loads(self.whole.to_str())
        special = [(i, t.content) for i, t in self.listed.get_added_tokens_decoder().items() if t.special]
        self.parted = bool(special) and any(kind["normalizer"] == n and kind["pre_tokenizer"] == p for n, p in PARTED)
        self.mark_id, self.mark = max(special, default=(-1, ""))
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.table, self.ids, self.used = Table(), np.zeros(1 << 16, self.dtype), 0
        self.words = 0  # of each: where its ids start, how many it has, where its bytes start, how many it has
        self.starts, self.counts, self.places, self.sizes = (np.zeros(1 << 12, t) for t in (np.int32, np.int32, np.int64, np.int32))
        self.bytes, self.held = np.zeros(1 << 16, np.uint8), 0

    def _append(self, **columns: np.ndarray) -> None:
        """Values of new words; room doubles when it is used up."""
        for name, new in columns.items():
            there = getattr(self, name)
            if self.words + len(new) > len(there):
                there = np.r_[there, np.zeros(max(len(there), len(new)), there.dtype)]
                setattr(self, name, there)
            there[self.words : self.words + len(new)] = new

    def stretches(self, text: str) -> Iterator[str]:
        """A text in parts of about AT_ONCE characters whose ids, one after the other, are the text's."""
        at = 0
        while self.parted and len(text) - at > AT_ONCE and (gap := _GAP.search(text, at + AT_ONCE)):
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:]

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.whole.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, self.dtype)

    def _remember(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        sizes = np.array([len(w) for w in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        while self.held + len(flat) > len(self.bytes):
            self.bytes = np.r_[self.bytes, np.zeros_like(self.bytes)]
        self.bytes[self.held : self.held + len(flat)] = flat
        self._append(places=self.held + np.cumsum(sizes) - sizes, sizes=sizes)
        self.held += len(flat)
        self.words += len(words)

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.listed.encode_batch_fast([self.mark.join(words)], add_special_tokens=False)[0].ids, np.int64)
        at = np.flatnonzero(ids == self.mark_id)
        ids = ids[ids != self.mark_id].astype(self.dtype)
        stops = np.r_[at - np.arange(len(at)), len(ids)]
        starts = np.r_[0, stops[:-1]]
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[self.used : self.used + len(ids)] = ids
        self._append(starts=starts + self.used, counts=stops - starts)
        self.used += len(ids)

    def _run(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        docs = len(offsets) - 1
        first, parts = offsets[:-1][offsets[:-1] < offsets[1:]], (data == 32) | (data == 10)
        gaps = parts.copy()
        parts[first] = True
        starts = np.flatnonzero(parts)
        ends = np.r_[starts[1:], len(data)]
        # texts that aren't words with one space or line feed between them
        odd = gaps[starts] & (ends - starts < 2)
        around = np.r_[np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)]
        inner = np.flatnonzero(gaps[starts] & (ends - starts > 1))
        at = starts[inner] + 3
        a, b, c, d, e = (around[at + i] for i in (-3, -2, -1, 1, 2))
        far = lambda x, y: ((x == 0xC2) & ((y == 0x85) | (y == 0xA0))) | ((x >= 0xE1) & (x <= 0xE3) & ((y == 0x9A) | (y == 0x80) | (y == 0x81)))
        odd[inner] |= _SPACES[c] | _SPACES[d] | far(b, c) | far(a, b) | far(d, e)
        less = np.flatnonzero(data[:-1] == 60)
        whole = set((np.searchsorted(offsets, np.r_[starts[odd], less[data[less + 1] == 124]], side="right") - 1).tolist())
        # a full stop or comma after a letter is a word of its own
        stop, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
        two = data[np.maximum(ends - 3, 0)]
        letter = _LETTERS[before] | ((two == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
        parts[(ends - 1)[((stop == 46) | (stop == 44)) & letter & (ends - starts > 2)]] = True
        starts = np.flatnonzero(parts)
        ends = np.r_[starts[1:], len(data)]
        h = bytes_hash(data, starts, ends)
        h[h == 0] = 1
        found = self.table.find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            keys, at = np.unique(h[new], return_index=True)
            at, text = new[at], data.tobytes()
            words = [text[i:j].decode() for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            clean = np.array([self.mark not in w for w in words])  # else its text is whole anyway
            self._learn([w if ok else "" for w, ok in zip(words, clean.tolist(), strict=True)])
            self._remember(words)
            self.table.add(keys)
            found[new] = self.table.find(h[new])
        sizes = ends - starts
        same = self.sizes[found] == sizes
        there = np.repeat(np.where(same, self.places[found], 0) - starts, sizes) + np.arange(len(data))
        unlike = np.flatnonzero(self.bytes[np.minimum(there, self.held - 1)] != data)
        clashes = np.r_[starts[~same], unlike]  # another word of the same hash is remembered
        whole |= set((np.searchsorted(offsets, clashes, side="right") - 1).tolist())
        counts = self.counts[found].astype(np.int64)
        ends_at = np.r_[0, np.cumsum(counts)]
        flat = self.ids[np.repeat(self.starts[found] - ends_at[:-1], counts) + np.arange(ends_at[-1])]
        bounds = ends_at[np.searchsorted(starts, offsets)]
        return [self._whole(data[offsets[i] : offsets[i + 1]].tobytes()) if i in whole else flat[bounds[i] : bounds[i + 1]] for i in range(docs)]

    def encode(self, text: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        if not self.parted:
            return [self._whole((t or "").encode()) for t in text.to_pylist()]
        long = pa.compute.greater(pa.compute.binary_length(text), AT_ONCE).to_numpy(zero_copy_only=False)
        if (long == True).any():  # noqa: E712 (null for a null text)
            parts = [list(self.stretches(t or "")) for t in text.to_pylist()]
            flat = self._encode(pa.array([p for x in parts for p in x], pa.large_string()))
            ends = np.cumsum([len(x) for x in parts])
            return [np.concatenate(flat[e - len(x) : e]) for e, x in zip(ends.tolist(), parts, strict=True)]
        return self._encode(text)

    def _encode(self, text: pa.Array) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, data, offsets in buffers(text, AT_ONCE):
            if self.table.size > REMEMBERED or self.held > 32 * REMEMBERED:
                self.forget()
            out += self._run(data, offsets) if len(data) else [np.zeros(0, self.dtype)] * (len(offsets) - 1)
        return out


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
