"""Token ids by a public tokenizer, word by word.

The tokenizer maps ASCII white space to gaps that no token crosses, and neither its normaliser nor its pre-tokenizer looks
past one. So a text's ids are those of its words in turn, and a word met before needs no second run of the tokenizer. Where
the normaliser lower-cases, words of lower-case Latin letters need no normaliser and ASCII marks behind such a word are a
word of their own. tests/llm holds all this against whole texts.

Words are numbers here, not objects: a slice's words are hashed together, found in an open table, and their ids copied by one
gather. A word is known by its 64-bit hash and its first eight bytes.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tessera.llm.bytescan import LOWER, SPACE, Prefix, slices

CACHED_WORDS = 1_000_000
BULK = 100
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_TAIL = np.zeros(256, dtype=bool)  # second bytes of the lower-case letters from U+00DF to U+00FF
_TAIL[0x9F:0xC0] = True
_TAIL[0xB7] = False
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


class Known:
    """Words by hash, and the ids of each: an open table over flat arrays, less than half full."""

    def __init__(self, bits: int = 16):
        self.bits, self.n, self.used = bits, 0, 0
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        room = 1 << bits - 1
        self.hashes, self.heads = np.empty(room, dtype=np.uint64), np.empty(room, dtype=np.uint64)
        self.begins, self.counts = np.empty(room, dtype=np.int64), np.empty(room, dtype=np.int64)
        self.ids = np.empty(4 * room, dtype=np.uint32)

    def find(self, hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 where unknown."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        rows, at = np.arange(len(hashes)), (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(rows):
            held = self.slots[at]
            full = held >= 0
            same = full & (self.hashes[held] == hashes[rows]) & (self.heads[held] == heads[rows])
            out[rows[same]] = held[same]
            go = full & ~same
            rows, at = rows[go], (at[go] + 1) & (len(self.slots) - 1)
        return out

    def _place(self, numbers: np.ndarray) -> None:
        at = (self.hashes[numbers] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            lost = self.slots[at] != numbers
            numbers, at = numbers[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def add(self, hashes: np.ndarray, heads: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Distinct words that are not known yet."""
        n = self.n + len(hashes)
        if 2 * n > len(self.slots):
            self.bits = (2 * n - 1).bit_length()
            self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
            for name in ("hashes", "heads", "begins", "counts"):
                setattr(self, name, np.concatenate([getattr(self, name)[: self.n], np.empty((1 << self.bits - 1) - self.n, dtype=getattr(self, name).dtype)]))
            self._place(np.arange(self.n, dtype=np.int32))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(len(self.ids), len(ids)), dtype=np.uint32)])
        own = slice(self.n, n)
        self.hashes[own], self.heads[own], self.counts[own] = hashes, heads, counts
        self.begins[own] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(ids)] = ids
        self._place(np.arange(self.n, n, dtype=np.int32))
        self.n, self.used = n, self.used + len(ids)


class Encoder:
    """Slices of texts to ids. Only for tokenizers that drop white space.

    When CACHED_WORDS are known, or their ids outgrow them eightfold, all are forgotten; the frequent ones are soon known
    again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.lowers = steps == ["NFC", "Replace", "Lowercase"]
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.mergers = [Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)]  # ASCII letters stand for themselves
        self.mergers[0].pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.mergers[1].pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_bytes])
        self.known = Known()

    def forget(self) -> None:
        self.known = Known()

    @staticmethod
    def _parted(encoded, n: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(encoded.ids, dtype=np.uint32)
        return np.bincount(np.array(encoded.word_ids, dtype=np.int64), minlength=n) if len(ids) else np.zeros(n, dtype=np.int64), ids

    def _learn(self, words: list[bytes], plain: np.ndarray, hashes: np.ndarray, heads: np.ndarray) -> None:
        """`plain`: 0 ASCII letters, 1 other lower-case Latin letters among them, 2 anything else."""
        for kind in range(3):
            own = np.flatnonzero(plain == kind)
            if not len(own):
                continue
            texts = b"\n".join([words[k] for k in own.tolist()]).decode("utf-8", "replace").split("\n")
            if kind == 2:
                parts = [self._parted(self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False), len(texts))]
            else:
                bulks = [texts[k : k + BULK] for k in range(0, len(texts), BULK)]
                done = self.mergers[kind].encode_batch([" ".join(b) for b in bulks], add_special_tokens=False)
                parts = [self._parted(x, len(b)) for x, b in zip(done, bulks)]
            self.known.add(hashes[own], heads[own], np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and kind of all words, marks behind plain words apart."""
        if not len(data):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        inside = ~SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not self.lowers:
            return starts, ends, np.full(len(starts), 2)
        lead, tail = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        lead[:-1] = (data[:-1] == 0xC3) & _TAIL[data[1:]]
        tail[1:] = lead[:-1]
        letter = _LETTER[data]
        total = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        ascii_, latin = total(letter), total(letter | lead | tail)
        body = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))[ends - 1] + 1
        marked = (body < ends) & (body > starts)
        marked[marked] = (latin[body] - latin[starts] == body - starts)[marked]
        rows = np.repeat(np.arange(len(starts)), 1 + marked)
        mark = np.zeros(len(rows), dtype=bool)
        mark[1:] = rows[1:] == rows[:-1]
        starts = np.where(mark, body[rows], starts[rows])
        ends = np.where(marked[rows] & ~mark, body[rows], ends[rows])
        size = ends - starts
        return starts, ends, np.where(ascii_[ends] - ascii_[starts] == size, 0, np.where(latin[ends] - latin[starts] == size, 1, 2))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in `data`, and each text's first id."""
        if self.known.n > CACHED_WORDS or self.known.used > 8 * CACHED_WORDS:
            self.forget()
        if self.lowers:
            data = LOWER[data]
        starts, ends, kind = self._units(data, offsets)
        hashes = Prefix(data).of(starts, ends)
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        heads = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))[starts] & _LOW_BYTES[np.minimum(ends - starts, 8)]
        numbers = self.known.find(hashes, heads)
        gaps = np.flatnonzero(numbers < 0)
        if len(gaps):
            order = gaps[np.lexsort((heads[gaps], hashes[gaps]))]
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (heads[order[1:]] != heads[order[:-1]])
            new = order[fresh]
            whole = data.tobytes()
            self._learn([whole[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())], kind[new], hashes[new], heads[new])
            numbers[gaps] = self.known.find(hashes[gaps], heads[gaps])
        counts = self.known.counts[numbers]
        done = np.concatenate([[0], np.cumsum(counts)])
        ids = self.known.ids[np.repeat(self.known.begins[numbers] - done[:-1], counts) + np.arange(done[-1])]
        return ids, done[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def packed(column: pa.Array, path: str, limit: int = 1 << 21):
    """(row, ids as bytes) of every text in turn; nulls are empty."""
    tool = encoder(path)
    for row, _, data, offsets in slices(column, limit):
        ids, first = tool.encode(data, offsets)
        whole, ends = ids.astype("<u4", copy=False).tobytes(), (4 * first).tolist()
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            yield row + k, whole[a:b]
