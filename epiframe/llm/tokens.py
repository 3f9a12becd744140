"""Token ids of whole texts by a tokenizers file, through a cache of word pieces."""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa

from .common import _EXACT, _powers, mix64, not_bytes, text_bytes

_BLANK = not_bytes([*range(9, 14), 0x20]) == 0
_LETTER = not_bytes([b for b in range(256) if not chr(b).isalpha() or b > 127]) == 1
_STOP = np.isin(np.arange(256), list(b".,;:!?"))
#: White-space characters beyond ASCII, and the first two UTF-8 bytes of such.
_EXOTIC = re.compile("[\x85\xa0  -     　]")
_EXOTIC_BYTES = [(0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)]
#: Byte-level alphabet: bytes that are no printable Latin-1 characters stand from U+0100 on.
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_BYTE_LEVEL = {b: 0x100 + i for i, b in enumerate(_HIDDEN)}
_BREAK = chr(_BYTE_LEVEL[0x0A])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Places:
    """Hash table in arrays: 64-bit keys to small integers, whole batches at a time."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.zeros(1 << bits, dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where unknown. Keys are not 0."""
        slot = (keys & self.mask).view(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((there != keys) & (there != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(self.mask)
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct new keys."""
        slot = (keys & self.mask).view(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = keys[free]
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            lost = np.ones(len(keys), dtype=bool)
            lost[won] = False
            todo = todo[lost[todo]]
            slot[todo] = (slot[todo] + 1) & int(self.mask)


class Encoder:
    """Encodes batches of texts; equal pieces are encoded once and looked up after.

    Texts are cut where this byte-level BPE always ends a word: around white space
    (the last space of a run belongs to what follows) and between an ASCII letter
    and a stop or comma. Texts with white space beyond ASCII go to the tokenizer
    whole, and so do texts with a special token's string, which the library then makes
    that token. Pieces are known by a 64-bit hash of their bytes. The cache is bounded and starts anew when full.
    """

    def __init__(self, path: str, bits: int = 22):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.bits = bits
        self._clear()

    def _clear(self) -> None:
        self.places = _Places(self.bits)
        self.known = 0
        self.ids = np.zeros(1 << 16, dtype=np.uint16 if self.vocabulary <= 1 << 16 else np.uint32)
        self.edges = np.zeros((1 << self.bits) // 2 + 1, dtype=np.int32)

    def _add(self, keys: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        at = int(self.edges[self.known])
        need = at + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(need + need // 2 - at, dtype=self.ids.dtype)])
        self.ids[at:need] = ids
        self.edges[self.known + 1:self.known + 1 + len(keys)] = at + ends
        self.places.add(keys, np.arange(self.known, self.known + len(keys), dtype=np.int32))
        self.known += len(keys)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pieces: Latin words and stops by the model at once, others by the whole tokenizer."""
        model, plain, rest, ids, ends = self.tokenizer.model.tokenize, [], [], [], []
        lines = b"\n".join([p.replace(b"\n", b"\0") for p in pieces])  # no piece of both is plain
        texts = lines.decode().split("\n")
        byte_texts = lines.decode("latin-1").translate(_BYTE_LEVEL).split(_BREAK)
        for i, text in enumerate(texts):
            if text.isalpha() or text[1:].isalpha() and text[0] == " " or text in ".,;:!?":
                if text.isascii() or max(text) < "ɐ":
                    ids += [t.id for t in model(byte_texts[i])]
                    plain.append(i)
                    ends.append(len(ids))
                    continue
            rest.append(i)
        self._add(keys[plain], np.array(ids, dtype=np.uint32), np.array(ends, dtype=np.int64))
        if rest:
            ids, bounds = self._whole([pieces[i].decode() for i in rest])
            self._add(keys[rest], ids, bounds[1:])

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in new])]).astype(np.int64)
        return np.fromiter((i for x in new for i in x), dtype=np.uint32, count=int(bounds[-1])), bounds

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and the bounds of each text in them."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return self.ids[:0], offsets
        starts = _cuts(data, offsets)
        powers, inverses = _powers(len(data) + 1)
        ends = np.append(starts[1:], len(data))
        keys = np.add.reduceat(_EXACT[data] * powers[:len(data)], starts) * inverses[starts]
        keys = mix64(keys + (ends - starts).view(np.uint64)) | np.uint64(1)
        if self.known + len(keys) // 2 > len(self.edges) - 1 and self.known:
            self._clear()
        first = np.searchsorted(starts, offsets)
        raw = data.tobytes()
        whole = sorted({*_exotic_rows(texts, data, offsets), *_rows_with(self.special, raw, offsets)})
        index = self.places.find(keys)
        new = index < 0
        for r in whole:
            new[first[r]:first[r + 1]] = False
            index[first[r]:first[r + 1]] = -1
        new = np.flatnonzero(new)
        if len(new):
            unique, where = np.unique(keys[new], return_index=True)
            at = new[where]
            room = len(self.edges) - 1 - self.known
            if len(unique) > room:  # more new pieces in one batch than the cache holds
                return self._uncached(texts)
            self._learn(unique, [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            index[new] = self.places.find(keys[new])
        begin = self.edges[index].astype(np.int64)
        size = self.edges[index + 1] - begin
        source = self.ids
        if whole:  # rows encoded whole stand behind the known pieces, in the row's first piece
            ids, bounds = self._whole([texts[r].as_py() for r in whole])
            for r, a, b in zip(whole, bounds[:-1].tolist(), bounds[1:].tolist()):
                size[first[r]:first[r + 1]] = 0
                begin[first[r]], size[first[r]] = len(source) + a, b - a
            source = np.concatenate([source, ids.astype(source.dtype)])
        stop = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=stop[1:])
        take = np.repeat((begin - stop[:-1]).astype(np.int32), size)
        take += np.arange(stop[-1], dtype=np.int32)
        return source[take], stop[first]

    def _uncached(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._whole([t or "" for t in texts.to_pylist()])


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where pieces start; the pieces cover the buffer."""
    blank = _BLANK[data]
    begin = np.zeros(len(data), dtype=bool)
    row = offsets[:-1][np.diff(offsets) > 0]
    begin[1:] = blank[1:] != blank[:-1]  # a run's start, and what follows it
    last = np.flatnonzero(begin[1:] & blank[:-1])  # a run's last character; a space goes with what follows
    begin[last] = True
    begin[last[data[last] == 0x20] + 1] = False
    begin[1:] |= _STOP[data[1:]] & _LETTER[data[:-1]]
    # a run at a row's end is not followed by anything: it stays whole
    end = row[1:] - 1
    run = end[blank[end] & begin[end]]
    inner = run[(run > 0) & ~np.isin(run, row)]
    begin[inner[blank[inner - 1]]] = False
    begin[row] = True
    return np.flatnonzero(begin)


def _exotic_rows(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> list[int]:
    high = np.flatnonzero(data[:-1] >= 0xC2)
    doubt = np.zeros(len(high), dtype=bool)
    for a, b in _EXOTIC_BYTES:
        doubt |= (data[high] == a) & (data[high + 1] == b)
    rows = np.unique(np.searchsorted(offsets, high[doubt], "right") - 1).tolist()
    return [r for r in rows if _EXOTIC.search(texts[r].as_py())]


def _rows_with(strings: list[bytes], raw: bytes, offsets: np.ndarray) -> list[int]:
    rows = []
    for s in strings:
        at = raw.find(s)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(s) <= offsets[row + 1]:
                rows.append(row)
            at = raw.find(s, at + 1)
    return rows


def encoder(path: str) -> Encoder:
    """This Python worker's encoder for a vocabulary file; it outlives the task."""
    own = vars(sys).setdefault("_epiframe_encoders", {})
    if path not in own:
        own[path] = Encoder(path)
    return own[path]


def append_id(ids: np.ndarray, bounds: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Put ``last`` behind every text's ids."""
    n = len(bounds) - 1
    bounds = bounds + np.arange(n + 1)
    out = np.empty(len(ids) + n, dtype=np.uint32)
    own = np.ones(len(out), dtype=bool)
    own[bounds[1:] - 1] = False
    out[own] = ids
    out[bounds[1:] - 1] = last
    return out, bounds
