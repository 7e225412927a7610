"""The pipeline's stages, each on what its predecessor kept."""

import brute
import corpus_pipeline
import pytest
from harness import connect, normal
from pyspark.sql import functions as F

from tessera.llm import decontamination, queries, shared


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = queries.table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        done = shared.stored(stage(spark, docs, folder), "stage")
        out.append((name, docs, done))
        docs = done
    return out


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_order_and_columns(stages, spark, folder):
    assert [n for n, _, _ in stages] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]
    assert all(done.dtypes == queries.table(spark, folder, "documents").dtypes for _, _, done in stages[:-1])


def test_quality_keeps_good_documents(stages, spark, folder):
    _, before, after = stages[0]
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, folder, "labels").collect()}
    kept = dict(texts(after))
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    assert all(dict(texts(before))[d] == t for d, t in kept.items())


def test_lines(stages):
    _, before, after = stages[1]
    want = brute.kept_lines(texts(before))
    assert {d: t for d, t in texts(after)} == {d: w[3] for d, w in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_one_of_each(stages):
    _, before, after = stages[2]
    want = brute.near_groups(texts(before))
    assert {d for d, _ in texts(after)} == {d for d, (_, c) in want.items() if d == c}


def test_no_leaks(stages, spark, folder):
    _, before, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, folder, "benchmark").collect()]
    leaks = {d for d, *_ in brute.contained(texts(before), items)}
    assert {d for d, _ in texts(after)} == {d for d, _ in texts(before)} - leaks


def test_packed(stages):
    _, before, after = stages[4]
    rows = after.toPandas()
    ids = {d: brute.encoded(t, queries.tokenizer_path(), 2) for d, t in texts(before)}
    assert rows.groupby("doc_id").length.sum().to_dict() == {d: len(x) for d, x in ids.items()}


BASE = " ".join(f"word{k}" for k in range(60))
LEAK = "a passage of the benchmark that should never be seen by the model under test"
ROWS = [
    (3, BASE), (None, BASE + " more"), (3, BASE), (3, "another text under the same number"), (5, BASE.replace("word7 ", "")), (None, "alone without a number"), (None, "alone without a number"),
    (6, ""), (7, ""), (8, None), (None, None), (9, LEAK), (9, "clean text with the number of a leak"), (None, LEAK + " indeed"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, equal rows, and columns whose names the operators use themselves."""
    rows = [(d, t, "en", "s", 0, k) for k, (d, t) in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _th int")
    return df.withColumns({"_id": F.col("_th"), "_row": F.lit("x"), "kept": F.lit(1), "component_id": F.lit(2), "exact": F.lit("y"), "near": F.lit("z"), "score": F.lit("w")})


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_near_copies_with_null_and_repeated_ids(spark, folder, odd):
    out = corpus_pipeline.one_of_each(spark, odd, folder)
    left = [(3, BASE), (3, ROWS[3][1]), (None, ROWS[5][1]), (6, ""), (7, ""), (8, None), (None, None), (9, LEAK), (9, ROWS[12][1]), (None, ROWS[13][1])]
    left.remove((None, ROWS[13][1]))  # a near copy of the leak
    assert out.columns == odd.columns and pairs(out) == sorted(left, key=repr)


def test_leaks_with_null_and_repeated_ids(odd, spark):
    items = spark.createDataFrame([(1, LEAK, "k"), (None, None, "k")], "item_id long, text string, doc_id string")
    out = decontamination.clean(odd, items)
    assert out.columns == odd.columns and pairs(out) == sorted((r for r in ROWS if LEAK not in (r[1] or "")), key=repr)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, folder, odd, stage):
    for docs in (odd, odd.limit(0)):
        out = stage(spark, docs, folder)
        if stage is corpus_pipeline.packed:
            assert out.groupBy("doc_id").count().count() == docs.select("doc_id").distinct().count()
        else:
            assert out.columns == docs.columns and out.count() <= docs.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, folder, name):
    got = normal(queries.QUERIES[name](spark, folder).toPandas())
    assert got == normal(connect(folder).execute(queries.ORACLES[name]).df())
