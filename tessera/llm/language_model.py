"""Interpolated modified Kneser-Ney bigram model, kept as sorted arrays that workers map into memory.

Counting: tasks combine their own counts and send packed arrays to ranges of sorted keys. Word hashes are split by their
leading bits, which are uniform; a word's id is its place among all sorted hashes. A bigram's key is (context id, word id)
in one 64-bit integer; its ranges are cut by the words' counts, and within a frequent context by the second word, so no
range holds a whole hot context. Continuation counts are one more packed sum by word id.

Files: raw little-endian arrays in the shared folder, one set per range. Workers map them; the maps' pages are the file
system's, so the model may be larger than memory. A store that is not mounted is copied to an unnamed scratch file first.

Every text counts as its words and one end. A null text is empty; a null id counts as the text '' when rows are split, so
it is trained on. Repeated rows count each time. An empty training set gives the uniform model. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import tempfile
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bytescan import slices, words
from tessera.llm.shared import place

END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text among word hashes
BEGIN = (1 << 32) - 1  # context id of a text's first word
TABLES = 12  # leading bits by which word counts are summed up for cutting ranges
GATHER = 1 << 22


def _open(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return fs, path


def _save(uri: str, array: np.ndarray) -> None:
    """Under the final name only once complete; a second attempt of a task writes the same bytes."""
    fs, path = _open(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{np.random.default_rng().integers(1 << 62):x}"
    with fs.open_output_stream(part) as out:
        out.write(memoryview(np.ascontiguousarray(array)).cast("B"))
    fs.move(part, path)


def _load(uri: str, dtype: str) -> np.ndarray:
    fs, path = _open(uri)
    if fs.get_file_info(path).size == 0:
        return np.empty(0, dtype=dtype)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with tempfile.TemporaryFile() as copy, fs.open_input_stream(path) as source:
        while chunk := source.read(1 << 22):
            copy.write(chunk)
        copy.flush()
        return np.memmap(copy, dtype=dtype, mode="r")


def _texts(batches):
    """(first row's number in its batch, batch, token hashes, first token of each text) with an end after every text."""
    for batch in batches:
        for row, _, data, offsets in slices(batch.column("text")):
            hashes, first = words(data, offsets)
            counts = np.diff(first) + 1
            ends = np.cumsum(counts)
            tokens = np.empty(int(ends[-1]), dtype=np.uint64)
            at_end = np.zeros(len(tokens), dtype=bool)
            at_end[ends - 1] = True
            tokens[at_end], tokens[~at_end] = END, hashes
            yield row, batch, tokens, ends - counts


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
    return key[heads], np.add.reduceat(count, heads) if len(heads) else count


class _Outbox:
    """Counts by key, combined and handed on as packed rows per range once `GATHER` keys have come together."""

    SCHEMA = "shard int, keys binary, counts binary"

    def __init__(self, cut):
        self.cut, self.keys, self.counts, self.size = cut, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray):
        self.keys.append(keys)
        self.counts.append(counts.astype(np.int64))
        self.size += len(keys)
        if self.size >= GATHER:
            self.keys, self.counts = ([x] for x in _sums(self.keys, self.counts))
            self.size = len(self.keys[0])
            if self.size >= GATHER // 2:
                yield from self.flush()

    def flush(self):
        if not self.keys:
            return
        keys, counts = _sums(self.keys, self.counts)
        self.keys, self.counts, self.size = [], [], 0
        bounds = self.cut(keys)
        rows = [(s, keys[a:b], counts[a:b]) for s, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
        for s, k, c in rows:
            # Keys by byte planes and counts as short as they fit: sorted keys then compress well.
            small = c.astype("<u1") if c.max() < 256 else c.astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], type=pa.int32()), pa.array([np.ascontiguousarray(k.view(np.uint8).reshape(-1, 8).T).tobytes()]), pa.array([small.tobytes()])],
                names=["shard", "keys", "counts"],
            )


def _unpack(batch: pa.RecordBatch):
    for s, k, c in zip(*(batch.column(n).to_pylist() for n in ("shard", "keys", "counts"))):
        keys = np.ascontiguousarray(np.frombuffer(k, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
        yield s, keys, np.frombuffer(c, dtype="<u1" if len(c) == len(keys) else "<i8").astype(np.int64)


def _shards(batches):
    """(shard, keys, sums) of every shard of a partition; rows come sorted by shard."""
    now, keys, counts = None, [], []
    for batch in batches:
        for s, k, c in _unpack(batch):
            if now is not None and s != now:
                yield now, *_sums(keys, counts)
                keys, counts = [], []
            now = s
            keys.append(k)
            counts.append(c)
    if now is not None:
        yield now, *_sums(keys, counts)


def _by_shard(df: DataFrame, shards: int) -> DataFrame:
    return df.repartition(shards, "shard").sortWithinPartitions("shard")


@dataclass
class Model:
    """What all workers need besides the arrays: sizes, offsets of the ranges and discounts."""

    uri: str
    vocabulary: list[int]  # words in each range of word hashes
    bigrams: list[int]  # upper keys of the bigram ranges, the last left out
    tokens: int
    distinct: int  # distinct bigrams
    discounts: list[float]
    lower_discounts: list[float]
    lower_left: float  # mass that the lowest order hands to the uniform distribution

    @property
    def words(self) -> int:
        return sum(self.vocabulary)


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of entries with counts 1 to 4."""
    if not all(n):
        return [0.5, 0.75, 0.9]  # too little to estimate from
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(d, 0.01), k + 0.99) for k, d in enumerate((1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]))]


def _minus(counts: np.ndarray, discounts: list[float]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(counts, 3)]


class _Vocabulary:
    """Ids of word hashes. Ranges are by leading bits: range = hash * shards / 2**64."""

    def __init__(self, uri: str, sizes: tuple[int, ...]):
        self.sizes = sizes
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.hashes = [_load(f"{uri}/words/{s}.hash", "<u8") if n else np.empty(0, "<u8") for s, n in enumerate(sizes)]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes; -1 for unknown words."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        for s, a, b in _runs(_cut_hashes(len(self.sizes))(hashes)):
            own = self.hashes[s]
            if len(own):
                at = np.minimum(np.searchsorted(own, hashes[a:b]), len(own) - 1)
                out[a:b] = np.where(own[at] == hashes[a:b], at + self.offsets[s], -1)
        return out


def _runs(bounds):
    return [(s, a, b) for s, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]


def _cut_hashes(shards: int):
    edges = np.array([-(-(s << 64) // shards) for s in range(1, shards)], dtype=np.uint64)
    return lambda keys: [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


def _cut_keys(uppers: list[int]):
    edges = np.array(uppers, dtype=np.uint64)
    return lambda keys: [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


@lru_cache(maxsize=2)
def _vocabulary(uri: str, sizes: tuple[int, ...]) -> _Vocabulary:
    return _Vocabulary(uri, sizes)


def _identified(tokens: np.ndarray, vocabulary: _Vocabulary) -> np.ndarray:
    distinct, back = np.unique(tokens, return_inverse=True)
    return vocabulary.ids(distinct)[back]


def _contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[first] = BEGIN
    return out


def _ranges(histogram: dict[int, int], heavy: list[tuple[int, int]], words: int, shards: int, end: int) -> list[int]:
    """Upper keys of bigram ranges of about equal token counts.

    `histogram`: tokens per block of ids; `heavy`: (id, count) of words too frequent for one range. A heavy word's context
    is cut evenly over second words, whose ids are uniform hashes.
    """
    total = sum(histogram.values())
    if not total or shards < 2:
        return []
    share, edges, run = total / shards, [], 0.0
    blocks = 1 << TABLES
    rest = dict(histogram)
    for word, n in heavy:
        rest[word * blocks // words] -= n
        parts = max(2, math.ceil(n / share))
        context = BEGIN if word == end else word
        edges += [(context << 32) + (p * words // parts) for p in range(parts)] + [(context + 1) << 32]
    for block in sorted(rest):
        run += rest[block]
        if run >= share:
            edges.append((-(-(block + 1) * words // blocks)) << 32)
            run = 0.0
    return sorted({e for e in edges if 0 < e < 1 << 64})


def train(docs: DataFrame, *, shards: int | None = None) -> Model:
    """Counts `docs` (text) and writes the model's arrays below the shared folder.

    `shards`: ranges of each array, by default the session's shuffle partitions.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    uri = place(spark, "ngrams")
    texts = docs.select(F.col("text").cast("string"))

    def count_words(batches):
        box = _Outbox(_cut_hashes(shards))
        for _, _, tokens, _ in _texts(batches):
            yield from box.add(*np.unique(tokens, return_counts=True))
        yield from box.flush()

    def write_words(batches):
        for s, keys, counts in _shards(batches):
            _save(f"{uri}/words/{s}.hash", keys)
            _save(f"{uri}/words/{s}.count", counts)
            yield pa.RecordBatch.from_arrays([pa.array([s], type=pa.int32()), pa.array([len(keys)]), pa.array([int(counts.sum())])], names=["shard", "n", "total"])

    found = {r["shard"]: r for r in _by_shard(texts.mapInArrow(count_words, _Outbox.SCHEMA), shards).mapInArrow(write_words, "shard int, n long, total long").collect()}
    sizes = tuple(found[s]["n"] if s in found else 0 for s in range(shards))
    tokens, n_words = sum(r["total"] for r in found.values()), sum(sizes)
    if n_words >= BEGIN:
        raise ValueError(f"{n_words} distinct words; ids have 32 bits")
    if not n_words:
        return Model(uri, list(sizes), [], 0, 0, _discounts([0]), _discounts([0]), 1.0)
    offsets = np.concatenate([[0], np.cumsum(sizes)])

    def weigh(batches):  # one row per range and block of ids, and the words too frequent for a range
        for batch in batches:
            for s in batch.column("id").to_pylist():
                if not sizes[s]:
                    continue
                counts = _load(f"{uri}/words/{s}.count", "<i8")
                blocks = (np.arange(offsets[s], offsets[s + 1]) << TABLES) // n_words
                sums = np.bincount(blocks - blocks[0], weights=counts).astype(np.int64)
                heavy = np.flatnonzero(counts > tokens // (2 * shards))
                keys = np.concatenate([blocks[0] + np.flatnonzero(sums), heavy + offsets[s]])
                values = np.concatenate([sums[sums > 0], counts[heavy]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys)) >= len(keys) - len(heavy)), pa.array(keys), pa.array(values)], names=["heavy", "key", "n"])

    histogram, heavy = {}, []
    for r in spark.range(0, shards, 1, shards).mapInArrow(weigh, "heavy boolean, key long, n long").groupBy("heavy", "key").agg(F.sum("n").alias("n")).collect():
        if r["heavy"]:
            heavy.append((r["key"], r["n"]))
        else:
            histogram[r["key"]] = r["n"]
    # The end of a text is no context, its beginning is one; both are as frequent as texts are.
    own = _load(f"{uri}/words/{int(END) * shards >> 64}.hash", "<u8")
    end = int(offsets[int(END) * shards >> 64] + np.searchsorted(own, END))
    uppers = _ranges(histogram, heavy, n_words, shards, end)
    id_edges = [n_words * s // shards for s in range(1, shards)]

    def count_pairs(batches):
        box, vocabulary = _Outbox(_cut_keys(uppers)), _vocabulary(uri, sizes)
        for _, _, hashes, first in _texts(batches):
            ids = _identified(hashes, vocabulary)
            keys = (_contexts(ids, first).astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
            yield from box.add(*np.unique(keys, return_counts=True))
        yield from box.flush()

    def write_pairs(batches):
        """Bigrams of a range; hands on continuation counts per word, and per context its parts of this range."""
        for s, keys, counts in _shards(batches):
            _save(f"{uri}/pairs/{s}.key", keys)
            _save(f"{uri}/pairs/{s}.count", counts)
            context = (keys >> np.uint64(32)).astype(np.int64)
            heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            table = np.stack([context[heads], np.add.reduceat(counts, heads), *(np.add.reduceat(hit.astype(np.int64), heads) for hit in (counts == 1, counts == 2, counts > 2))])
            _save(f"{uri}/contexts/{s}", table)
            of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
            info = pa.RecordBatch.from_arrays([pa.array([-1 - s], type=pa.int32()), pa.array([np.array([len(keys), *of], dtype="<i8").tobytes()]), pa.array([b""])], names=["shard", "keys", "counts"])
            yield info
            box = _Outbox(_cut_keys(id_edges))
            yield from box.add(*np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True))
            yield from box.flush()

    from tessera.llm.shared import stored

    pairs = stored(_by_shard(texts.mapInArrow(count_pairs, _Outbox.SCHEMA), len(uppers) + 1).mapInArrow(write_pairs, _Outbox.SCHEMA), "continuations")
    infos = [np.frombuffer(r["keys"], dtype="<i8") for r in pairs.where("shard < 0").select("keys").collect()]
    distinct, *of = np.sum(infos, axis=0).tolist()

    def write_lower(batches):
        for s, keys, counts in _shards(batches):
            low = id_edges[s - 1] if s else 0
            high = id_edges[s] if s < len(id_edges) else n_words
            dense = np.zeros(high - low, dtype=np.int64)
            dense[keys.astype(np.int64) - low] = counts
            _save(f"{uri}/lower/{s}", dense)
            yield pa.RecordBatch.from_arrays([pa.array([int((counts == k).sum())]) for k in (1, 2, 3, 4)] + [pa.array([int((counts > 2).sum())])], names=["n1", "n2", "n3", "n4", "more"])

    rows = _by_shard(pairs.where("shard >= 0"), shards).mapInArrow(write_lower, "n1 long, n2 long, n3 long, n4 long, more long").collect()
    n = [sum(r[k] for r in rows) for k in ("n1", "n2", "n3", "n4", "more")]
    lower = _discounts(n[:4])
    left = (lower[0] * n[0] + lower[1] * n[1] + lower[2] * n[4]) / distinct
    return Model(uri, list(sizes), uppers, tokens, distinct, _discounts(of), lower, left)


class _Reader:
    """The mapped arrays of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.vocabulary = _vocabulary(model.uri, tuple(model.vocabulary))
        present = lambda path, dtype: self._maybe(path, dtype)
        self.counts = [present(f"words/{s}.count", "<i8") for s in range(len(model.vocabulary))]
        self.lower = [present(f"lower/{s}", "<i8") for s in range(len(model.vocabulary))]
        self.lower_edges = [model.words * s // len(model.vocabulary) for s in range(1, len(model.vocabulary))]
        pairs = range(len(model.bigrams) + 1)
        self.keys = [present(f"pairs/{s}.key", "<u8") for s in pairs]
        self.pair_counts = [present(f"pairs/{s}.count", "<i8") for s in pairs]
        self.contexts = [present(f"contexts/{s}", "<i8").reshape(5, -1) for s in pairs]

    def _maybe(self, path: str, dtype: str) -> np.ndarray:
        fs, at = _open(f"{self.model.uri}/{path}")
        return _load(f"{self.model.uri}/{path}", dtype) if fs.get_file_info(at).type == pyarrow.fs.FileType.File else np.empty(0, dtype)

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of sorted ids; 0 for -1."""
        return self._dense(self.counts, self.vocabulary.offsets[1:-1], self.vocabulary.offsets[:-1], ids)

    def continuation(self, ids: np.ndarray) -> np.ndarray:
        return self._dense(self.lower, self.lower_edges, [0, *self.lower_edges], ids)

    @staticmethod
    def _dense(parts, edges, starts, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), dtype=np.int64)
        known = int(np.searchsorted(ids, 0))
        bounds = [known, *(np.maximum(known, np.searchsorted(ids, np.asarray(edges)))).tolist(), len(ids)]
        for s, a, b in _runs(bounds):
            if len(parts[s]):
                out[a:b] = parts[s][ids[a:b] - starts[s]]
        return out

    def pair(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted bigram keys; 0 if unseen."""
        out = np.zeros(len(keys), dtype=np.int64)
        for s, a, b in _runs(_cut_keys(self.model.bigrams)(keys)):
            own = self.keys[s]
            if len(own):
                at = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
                out[a:b] = np.where(own[at] == keys[a:b], self.pair_counts[s][at], 0)
        return out

    def context(self, ids: np.ndarray) -> np.ndarray:
        """Rows total, n1, n2, n3+ of sorted context ids; a context may lie across several ranges."""
        out = np.zeros((4, len(ids)), dtype=np.int64)
        low = ids.astype(np.uint64) << np.uint64(32)
        first = np.searchsorted(np.array(self.model.bigrams, dtype=np.uint64), low, side="right")
        last = np.searchsorted(np.array(self.model.bigrams, dtype=np.uint64), low + np.uint64(0xFFFFFFFF), side="right")
        for s in range(int(first.min(initial=0)), int(last.max(initial=-1)) + 1):
            own = self.contexts[s]
            here = np.flatnonzero((first <= s) & (s <= last) & (ids >= 0))
            if own.shape[1] and len(here):
                at = np.minimum(np.searchsorted(own[0], ids[here]), own.shape[1] - 1)
                hit = own[0][at] == ids[here]
                out[:, here[hit]] += own[1:, at[hit]]
        return out


@lru_cache(maxsize=1)
def _reader(text: str) -> _Reader:
    return _Reader(Model(**json.loads(text)))


def log_probabilities(reader: _Reader, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: log10 of the model's and of the base probability, and whether the token was in training."""
    m = reader.model
    distinct, back = np.unique(tokens, return_inverse=True)
    ids = reader.vocabulary.ids(distinct)
    order = np.argsort(ids, kind="stable")
    counts, continuations = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
    counts[order], continuations[order] = reader.count(ids[order]), reader.continuation(ids[order])
    if m.distinct:
        lower = np.maximum(continuations - _minus(continuations, m.lower_discounts), 0) / m.distinct + m.lower_left / (m.words + 1)
    else:
        lower = np.full(len(ids), 1.0 / (m.words + 1))
    word = ids[back]
    context = _contexts(word, first)
    seen, place_of = np.unique(context, return_inverse=True)
    total, n1, n2, n3 = reader.context(seen)[:, place_of] if m.distinct else np.zeros((4, len(word)), dtype=np.int64)
    keys = (context.astype(np.uint64) << np.uint64(32)) | (word.astype(np.uint64) & np.uint64(0xFFFFFFFF))
    asked = (word >= 0) & (context >= 0)
    pairs, where = np.unique(keys[asked], return_inverse=True)
    found = np.zeros(len(word), dtype=np.int64)
    found[asked] = reader.pair(pairs)[where]
    d = m.discounts
    some = np.maximum(total, 1)
    p = np.where(total > 0, np.maximum(found - _minus(found, d), 0) / some + (d[0] * n1 + d[1] * n2 + d[2] * n3) / some * lower[back], lower[back])
    base = np.log10((counts + 0.5) / (m.tokens + 0.5 * (m.words + 1)))
    return np.log10(p), base[back], (counts > 0)[back]


def score(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with n_tokens, n_known, train_tokens, base_score, score and perplexity of every text."""
    text = json.dumps(asdict(model))
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kept = [f for f in rows.schema if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"])

    def run(batches):
        reader = _reader(text)
        for row, batch, tokens, first in _texts(batches):
            scores, base, known = log_probabilities(reader, tokens, first)
            n = np.diff(np.append(first, len(tokens)))
            sums = np.add.reduceat(scores, first)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name).slice(row, len(first)) for f in kept), *map(pa.array, (n, np.add.reduceat(known.astype(np.int64), first), np.full(len(n), model.tokens), np.add.reduceat(base, first), sums, 10 ** (-sums / n)))],
                names=[*(f.name for f in kept), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return rows.mapInArrow(run, schema)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
