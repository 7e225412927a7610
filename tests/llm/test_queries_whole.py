"""Whole queries against plain Python where SQL cannot say them, and what null ids and empty tables give."""

from __future__ import annotations

import math
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import binary_output, bytescan, language_model, packing, quality, queries, shared, substring_dedup, tokens

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def rows(spark, folder):
    return sorted((r["doc_id"], r["text"]) for r in queries.table(spark, folder, "documents").select("doc_id", "text").collect())


def encoded(text):
    """By the tokenizer's own run over the whole text."""
    return tokens.encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_files_of_the_table(spark, folder, rows):
    got = sorted(tuple(r) for r in queries.op4_orc_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    start = 0
    for (d, at, n, crc), (want, text) in zip(got, rows, strict=True):
        ids = [*encoded(text), 1]
        assert (d, at, n, crc) == (want, start, len(ids), brute.crc(ids))
        start += len(ids)


def test_rules_in_plain_python(spark, folder, rows):
    docs = queries.table(spark, folder, "documents")
    intercept, rules = queries.quality_model(spark, docs, folder)
    assert rules
    got = {r["doc_id"]: r for r in queries.op8_rule_ensemble(spark, folder).collect()}
    for d, text in rows:
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        stats = dict(zip((f"s_{s}" for s in quality.STATS), quality._stats(data, np.array([0, len(data)]))[0]))
        fired = sum(w for w, rule in rules if all((stats[name] > t) if above else (stats[name] <= t) for name, above, t in rule))
        score = 1 / (1 + math.exp(-(intercept + fired)))
        assert abs(got[d]["score"] - score) < 1e-9
        assert got[d]["predicted"] == int(got[d]["score"] >= 0.5) and got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)


def test_bloom_filters_skip_stripes(spark):
    """The files hold Bloom filter streams for the id, and an id that is in none of them reads no row."""
    out = shared.place(spark, "orc")
    df = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("a text of number "), "id").alias("text"))
    binary_output.write(df, out, PATH, 1, files=2, stride=1000)
    found = spark.read.orc(out)
    file = found.inputFiles()[0].removeprefix("file://")
    orc = spark._jvm.org.apache.orc.OrcFile
    reader = orc.createReader(spark._jvm.org.apache.hadoop.fs.Path(file), orc.readerOptions(spark._jsc.hadoopConfiguration()))
    inner = reader.rows()
    column = 1  # the first field of the row
    kinds = [s.getKind().toString() for s in inner.readStripeFooter(reader.getStripes().get(0)).getStreamsList() if s.getColumn() == column]
    inner.close()
    assert any("BLOOM_FILTER" in k for k in kinds) and "ROW_INDEX" in kinds
    assert [len(r["ids"]) for r in binary_output.lookup(spark, out, [20]).collect()] == [len(encoded("a text of number 20")) + 1]
    assert binary_output.lookup(spark, out, [21]).count() == 0


def test_null_ids_and_empty_tables(spark):
    data = [(None, "one two three"), (1, "four"), (None, None), (None, "one two three")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"score": F.lit("clash"), "ids": F.lit(0), "class": F.lit(1)})
    out = shared.place(spark, "orc")
    binary_output.write(df, out, PATH, 1)
    got = binary_output.digests(binary_output.read(spark, out)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, None, 1] and got[-1]["start"] == sum(r["n_tokens"] for r in got[:-1])
    packed = packing.pack(df, PATH, 2)
    assert {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {
        None: sum(len(encoded(t)) + 1 for d, t in data if d is None), 1: len(encoded("four")) + 1}
    scored = quality.score(df, (0.3, [(1.0, (("s_words", True, 1.0),))]), keep=["doc_id"]).collect()
    assert len(scored) == 4 and all(0 < r["score"] < 1 for r in scored)
    model = language_model.train(df)
    assert language_model.score(df, model, keep=["doc_id"]).count() == 4
    empty = df.limit(0)
    out = shared.place(spark, "orc")
    binary_output.write(empty, out, PATH, 1)
    assert binary_output.digests(binary_output.read(spark, out)).count() == 0
    assert quality.score(empty, (0.0, []), keep=["doc_id"]).count() == 0
    assert packing.pack(empty, PATH, 2).count() == 0


def test_texts_over_a_slice(spark, monkeypatch):
    """Texts longer than the parts that anchors are searched in, in slices shorter than a text."""
    monkeypatch.setattr(substring_dedup, "PART", 700)
    pick = random.Random(9)
    say = lambda n: "".join(pick.choice("ab cd\\n") for _ in range(n))
    shared_part = say(900)
    texts = [say(1500) + shared_part + say(300), say(50) + shared_part, say(2500), "é" * 800, None]
    for length in (400, 60):
        want = brute.repeated_bytes(texts, length)
        unit = substring_dedup.Unit(length, 16, 24)
        spots = []
        for t in texts:
            data = np.frombuffer((t or "").encode(), dtype=np.uint8)
            if len(data) >= length:
                spots.append(substring_dedup.anchors(bytescan.Prefix(data), len(data), length, unit.gram))
        monkeypatch.setattr(substring_dedup, "PART", 1 << 25)
        whole = [substring_dedup.anchors(bytescan.Prefix(np.frombuffer(t.encode(), dtype=np.uint8)), len(t.encode()), length, unit.gram) for t in texts if t and len(t.encode()) >= length]
        monkeypatch.setattr(substring_dedup, "PART", 700)
        assert all((a == b).all() for a, b in zip(spots, whole, strict=True))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.digests(df, length=length, gram=16, block=24).collect())
        assert got == [(d, *w) for d, w in enumerate(want)]
