"""Whole-text token ids from a ``tokenizers`` file, encoding each distinct chunk of text once.

Byte-pair merges never cross a pre-token, so the ids of a text are those of its chunks wherever the cuts fall on
pre-token borders.  Cuts are made only where the bytes on both sides prove such a border for any tokenizer that
keeps runs of letters, of digits and of other signs apart and lets one blank at most go with what follows:

* before a single blank, and on both sides of a single line end, between two visible characters;
* before an ASCII sign that follows a letter.

Only ASCII and the letters of four two-byte blocks count as known; a chunk with anything else in it (blanks of other
kinds, combining marks, other scripts), and a whole text that holds a special token's string, goes to the library as it stands.  A table of bounded
size holds the ids of short chunks under their own bytes; all others are made by the library whenever they occur.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from maskloom.llm.words import mix, ragged, text_bytes

#: Chunks a worker's table holds, at about 70 bytes each; beyond it the table starts anew.
CHUNKS = 800_000
#: Bytes of text to be encoded at once: a slice knows each of its chunks once.
ENCODE_BYTES = 3 << 20
#: Bytes of a chunk's key; the last one is its length, so longer chunks aren't kept.
_KEY = 24

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN = _VISIBLE & ~_LETTER
_SIGN[0x30:0x3A] = False
#: First bytes of two-byte letters that stay one letter when lowered: U+00C0-00FF, U+0140-017F, U+0400-047F.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC3, 0xC5, 0xD0, 0xD1]] = True
#: Chunks that are a run of known letters, perhaps after a blank.
_WORD = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_LETTERS = [c for c in map(chr, range(256)) if c.isalpha() and c not in "ªµº"]


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions of UTF-8 bytes before which a text may be cut, see above."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    blank = np.flatnonzero((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) + 1
    sign = np.flatnonzero(_SIGN[data[1:]]) + 1

    def after_letter(at: np.ndarray) -> np.ndarray:
        last, lead = data[at - 1], np.where(at > 1, data[at - 2], 0)
        return _LETTER[last] | (last >= 0x80) & _LEAD[lead] & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))  # but for the signs of multiplication and division

    blank = blank[(_VISIBLE[data[blank + 1]] | _LEAD[data[blank + 1]]) & (_VISIBLE[data[blank - 1]] | after_letter(blank))]
    return np.concatenate([blank, blank[data[blank] == 0x0A] + 1, sign[after_letter(sign)]])


class _Known:
    """Ids by chunk: exact keys of three words in order of a hash; where two keys share a hash the first alone is kept."""

    def __init__(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.key, self.first, self.size = np.zeros((0, 3), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def keys(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Keys of chunks, and which chunks have one."""
        data, offsets = text_bytes(chunks)
        n = np.diff(offsets)
        step = np.arange(_KEY)
        raw = np.concatenate([data, np.zeros(_KEY, np.uint8)])[offsets[:-1, None] + step]
        raw[step >= n[:, None]] = 0
        raw[:, -1] = np.minimum(n, 255)
        return np.ascontiguousarray(raw).view("<u8"), n < _KEY

    @staticmethod
    def hashes(key: np.ndarray) -> np.ndarray:
        return mix(key[:, 0] + mix(key[:, 1] + mix(key[:, 2])))

    def find(self, key: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where unknown."""
        if not len(self.hash):
            return np.full(len(key), -1)
        h = self.hashes(key)
        order = np.argsort(h)
        at = np.empty(len(h), np.int64)
        at[order] = np.minimum(np.searchsorted(self.hash, h[order]), len(self.hash) - 1)
        return np.where((self.key[at] == key).all(1), at, -1)

    def add(self, ids: np.ndarray) -> int:
        """Ids after those that are there; where they begin."""
        begin = self.used
        if begin + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids) // 2), np.uint32)])
        self.ids[begin : begin + len(ids)] = ids
        self.used += len(ids)
        return begin

    def keep(self, key: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        h, own = np.unique(self.hashes(key), return_index=True)
        at = np.searchsorted(self.hash, h)
        if len(self.hash):
            free = self.hash[np.minimum(at, len(self.hash) - 1)] != h
            h, own, at = h[free], own[free], at[free]
        self.hash, self.key = np.insert(self.hash, at, h), np.insert(self.key, at, key[own], 0)
        self.first, self.size = np.insert(self.first, at, first[own]), np.insert(self.size, at, size[own])


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # what the model reads for a letter and for a blank before one, asked of the library itself
        self.table = {ord(c): self._read(c) for c in _LETTERS}
        self.table[32] = self._read(" a").removesuffix(self.table[ord("a")])
        trial = " " + "".join(_LETTERS)
        self.by_model = self._read(trial) == trial.translate(self.table)

    def _read(self, text: str) -> str:
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return "|".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def direct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has, from the library alone."""
        return self._joined([x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    @staticmethod
    def _joined(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        return np.array([i for x in found for i in x], np.uint32), sizes

    def _learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of new chunks; a single run of letters is a pre-token, which the model takes as it is."""
        word = pc.match_substring_regex(chunks, _WORD).to_numpy(zero_copy_only=False) & self.by_model
        found: list = [None] * len(chunks)
        texts, model, table = chunks.to_pylist(), self.tokenizer.model, self.table
        for i in np.flatnonzero(word).tolist():
            found[i] = [t.id for t in model.tokenize(texts[i].translate(table))]
        rest = np.flatnonzero(~word).tolist()
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = x.ids
        return self._joined(found)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; null is empty."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        begins = np.zeros(len(data) + 1, bool)
        begins[cuts(data)] = True
        for special in self.special:  # such a text stays whole
            for i in np.flatnonzero(pc.fill_null(pc.match_substring(texts, special), False).to_numpy(zero_copy_only=False)).tolist():
                begins[offsets[i] : offsets[i + 1]] = False
        begins[offsets] = True
        at = np.flatnonzero(begins)
        coded = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        if len(self.known.hash) > CHUNKS:
            self.known = _Known()
        known, chunks = self.known, coded.dictionary
        key, short = known.keys(chunks)
        place = known.find(key)
        place[~short] = -1
        old = place >= 0
        first, size = np.zeros(len(place), np.int64), np.zeros(len(place), np.int32)
        first[old], size[old] = known.first[place[old]], known.size[place[old]]
        begin = known.used
        if not old.all():
            new = np.flatnonzero(~old)
            # those that stay first, so that the ids of the others can go again
            new = new[np.argsort(~short[new], kind="stable")]
            ids, sizes = self._learn(chunks.take(pa.array(new)))
            size[new], first[new] = sizes, known.add(ids) + np.cumsum(sizes) - sizes
            stay = new[: int(short[new].sum())]
            begin += int(size[stay].sum())
            known.keep(key[stay], first[stay], size[stay])
        index = coded.indices.to_numpy()
        n = size[index].astype(np.int64)
        ids = known.ids[ragged(first[index], n)]
        known.used = begin
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[np.searchsorted(at, offsets)])


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per worker and file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
