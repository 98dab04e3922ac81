"""Exact, fast encoding with a word-wise tokenizer of the `tokenizers` library.

The library itself encodes each distinct unit once; units are looked up by hash and their ids gathered by
arrays.  A unit is a maximal piece of text between ASCII white space, cut further where an ASCII letter or
digit (or a Latin-1 letter) meets ASCII punctuation other than the apostrophe.  The tokenizer's normaliser
(NFC, white space to blanks, lower case) and its splitting pattern never join text across such a place, so
the ids of a text are the ids of its units in order.  Texts that hold one of the tokenizer's special strings
are given to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from varloom.llm import bytescan as bs

#: Distinct units that a worker remembers; beyond that it starts anew.
REMEMBERED = 1 << 20
#: Units that are looked up at once.
CHUNK = 1 << 18
_SEPARATOR = "\x01"

_ASCII_WORD = bs.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_PUNCT = bs.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_PUNCT[0x27] = False
_LATIN_TAIL = bs.byte_class((0x80, 0xBF))
_LATIN_TAIL[[0x97, 0xB7]] = False

_loaded: dict[str, WordTokenizer] = {}
bs.DROPS.append(_loaded.clear)


def default_path() -> str:
    """The public vocabulary file that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str) -> WordTokenizer:
    """One tokenizer a worker, until another operator begins there."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size()
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        ids = self.library.encode(_SEPARATOR, add_special_tokens=False).ids
        self.separator = ids[0] if len(ids) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.table = bs.HashTable(22)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.lengths = np.zeros(REMEMBERED + CHUNK, np.int64), np.zeros(REMEMBERED + CHUNK, np.int64)

    def _library_ids(self, units: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(units, add_special_tokens=False)]

    def _encode_units(self, units: list[str]) -> list[np.ndarray]:
        """The ids of each unit; many units are joined by a character that has an id of its own."""
        if self.separator is None:
            return self._library_ids(units)
        out: list[np.ndarray] = []
        groups = [units[k : k + 500] for k in range(0, len(units), 500)]
        for group, ids in zip(groups, self._library_ids([f" {_SEPARATOR} ".join(g) for g in groups]), strict=True):
            cut = np.flatnonzero(ids == self.separator)
            parts = np.split(ids, cut)
            parts[1:] = [p[1:] for p in parts[1:]]
            out += parts if len(parts) == len(group) else self._library_ids(group)
        return out

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        new, first = np.unique(h, return_index=True)
        units = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        ids = self._encode_units(units)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lengths.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(total, len(self.ids)), np.uint32)])
        low = self.table.count
        self.starts[low : low + len(ids)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[low : low + len(ids)] = lengths
        if total:
            self.ids[self.used : self.used + total] = np.concatenate(ids)
        self.used += total
        self.table.add(new)

    def _units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = bs.NOT_SPACE[data]
        word, punct = _ASCII_WORD[data], _PUNCT[data]
        latin_end = np.zeros(len(data), bool)
        lead = data == 0xC3
        latin_end[1:] = lead[:-1] & _LATIN_TAIL[data[1:]]
        latin_start = np.zeros(len(data), bool)
        latin_start[:-1] = latin_end[1:]
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = ((word[:-1] | latin_end[:-1]) & punct[1:]) | (punct[:-1] & (word[1:] | latin_start[1:]))
        edge[bounds] = True
        start, end = edge[:-1].copy(), edge[1:].copy()
        start[1:] |= ~kept[:-1]
        end[:-1] |= ~kept[1:]
        return np.flatnonzero(kept & start), np.flatnonzero(kept & end) + 1

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        place = self.table.find(h)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            if self.table.count + len(missing) > len(self.starts):
                self._forget()
                missing = np.arange(len(h))
            self._learn(data, starts[missing], ends[missing], h[missing])
            place = self.table.find(h)
        return place

    def _encode_segment(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = self._units(data, bounds)
        lowered, ids, after, total = bs.LOWER[data], [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        for low in range(0, len(starts), CHUNK):
            first, last = starts[low : low + CHUNK], ends[low : low + CHUNK]
            place = self._places(lowered, first, last, bs.span_hash(lowered, first, last))
            lengths = self.lengths[place]
            summed = np.cumsum(lengths)
            gather = np.repeat(self.starts[place] - (summed - lengths), lengths)
            gather += np.arange(len(gather))
            ids.append(self.ids[gather])
            after.append(summed + total)
            total += int(summed[-1])
        return np.concatenate(ids), np.concatenate(after)[np.searchsorted(starts, bounds)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after another, and the rows' offsets; nulls are empty."""
        all_ids, all_bounds, base = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        for _, _, data, bounds in bs.pieces(column):
            raw = data.tobytes() if self.special else b""
            if any(s in raw for s in self.special):
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                each = self._library_ids(texts)
                ids, ends = np.concatenate([np.zeros(0, np.uint32), *each]), np.cumsum([0, *map(len, each)])
            else:
                ids, ends = self._encode_segment(data, bounds)
            all_ids.append(ids)
            all_bounds.append(ends[1:] + base)
            base += len(ids)
        return np.concatenate(all_ids), np.concatenate(all_bounds)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, each closed by end_id."""
    rows = len(bounds) - 1
    out_bounds = bounds + np.arange(rows + 1)
    out = np.full(len(ids) + rows, end_id, np.uint32)
    inner = np.ones(len(out), bool)
    inner[out_bounds[1:] - 1] = False
    out[inner] = ids
    return out, out_bounds
