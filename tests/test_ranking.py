"""Both ways of each search give the same result, and match brute force."""

import re

import numpy as np
from pyspark.sql import functions as F

from tessera.catalog.registry import Inputs
from tessera.operators import dense, dense_clusters, events, sparse, sparse_blocks


def rows(df, rank):
    return sorted((r["qid"], r["chunk_id"], round(r["score"], 6), r[rank]) for r in df.collect())


def scoped(spark, folder):
    t = Inputs(spark, folder)
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), "text")
    doc_scope = t.documents.select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("u"), F.col("doc_id") % 3).alias("user_id"), "lang")
    asked = t.benchmark.select(F.col("item_id").alias("qid"), "text")
    asked_scope = t.benchmark.select(F.col("item_id").alias("qid"), F.concat(F.lit("u"), F.col("item_id") % 4).alias("user_id"),
                                     F.when(F.col("item_id") % 2 == 0, "en").alias("lang"))
    return docs, doc_scope, asked, asked_scope


def test_sparse_scan_equals_blocks(spark, folder):
    docs, doc_scope, asked, asked_scope = scoped(spark, folder)
    p, q = sparse.postings(docs, "chunk_id").cache(), sparse.postings(asked, "qid").cache()
    want = rows(sparse.sparse_top_k(p, q), "sparse_rank")
    found = sparse_blocks.block_top_k(sparse_blocks.block_index(p), q)
    assert want == rows(found.hits, "sparse_rank")
    # Far fewer documents are scored than share a term with a question.
    matches = p.join(q.select("qid", "term_idx"), "term_idx").select("qid", "chunk_id").distinct().count()
    assert found.candidates.count() < 0.4 * matches
    limits = dict(chunk_scope=doc_scope, question_scope=asked_scope, exact=["user_id"], optional=["lang"])
    scanned = rows(sparse.sparse_top_k(p, q, **limits), "sparse_rank")
    assert scanned == rows(sparse.sparse_top_k(p, q, max_question_rows=1, **limits), "sparse_rank")
    assert scanned and {q for q, *_ in scanned} <= {q for q in range(1000) if q % 4 != 3}
    small = sparse_blocks.block_index(p, scope=doc_scope, exact=["user_id"], block=4)
    assert small.where("n > 40").count() == 0  # parts are cut by a hash, so sizes vary
    assert scanned == rows(sparse_blocks.block_top_k(small, q, seed_rows=20, **limits).hits, "sparse_rank")


def test_sparse_small_blocks(spark, folder, monkeypatch):
    docs, _, asked, _ = scoped(spark, folder)
    p, q = sparse.postings(docs, "chunk_id").cache(), sparse.postings(asked, "qid").cache()
    want = rows(sparse.sparse_top_k(p, q), "sparse_rank")
    monkeypatch.setattr(sparse, "SCORE_CELLS", 200)
    assert rows(sparse.sparse_top_k(p, q), "sparse_rank") == want


def test_dense_against_brute_force_and_clusters(spark, folder):
    t = Inputs(spark, folder)
    chunks = t.embeddings.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("dense"), (F.col("label") % 2).cast("string").alias("user_id"))
    asked = t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qdense"), F.lit("1").alias("user_id"))
    got = rows(dense.dense_top_k(chunks, asked, 5, exact=["user_id"]), "dense_rank")
    table = t.embeddings.toPandas()
    m = np.array(table["embedding"].tolist(), dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    allowed = np.flatnonzero(table["label"] % 2 == 1)
    scores = np.round(m @ m[allowed].T, 9)
    ids = table["vec_id"].astype(str).to_numpy()[allowed]
    want = []
    for i, qid in enumerate(table["vec_id"]):
        order = sorted(range(len(allowed)), key=lambda j: (-scores[i, j], ids[j]))[:5]
        want += [(qid, ids[j], round(float(scores[i, j]), 6), r) for r, j in enumerate(order)]
    assert got == sorted(want)
    assert rows(dense.dense_top_k(chunks, asked, 5, exact=["user_id"], max_questions=60), "dense_rank") == got
    index = dense_clusters.cluster_index(chunks, centres=30, part_rows=10)
    assert rows(dense_clusters.cluster_top_k(index, asked, 5, exact=["user_id"]).hits, "dense_rank") == got


def test_far_clusters_are_not_opened(spark):
    pick = np.random.default_rng(3)
    middles = pick.normal(size=(25, 16))
    data = np.concatenate([m + 0.05 * pick.normal(size=(40, 16)) for m in middles] + [np.zeros((3, 16))])
    chunks = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "chunk_id long, dense array<double>")
    asked = chunks.where("chunk_id % 40 = 7").select(F.col("chunk_id").alias("qid"), F.col("dense").alias("qdense"))
    found = dense_clusters.cluster_top_k(dense_clusters.cluster_index(chunks, centres=60, part_rows=16), asked, 5)
    assert rows(found.hits, "dense_rank") == rows(dense.dense_top_k(chunks, asked, 5), "dense_rank")
    assert found.opened.agg(F.sum("n")).first()[0] < 0.2 * chunks.count() * asked.count()


def test_wrong_dimension_fails(spark):
    import pytest

    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "chunk_id string, dense array<float>")
    with pytest.raises(Exception, match="vector dimension must be 2, found 1"):
        dense.validate_vectors(df, 2).collect()


def test_own_embedder(spark):
    dense.register_embedder("length", lambda texts: np.array([[len(x), 1.0] for x in texts]))
    df = spark.createDataFrame([(1, "abc"), (2, "x" * 5000), (3, None)], "chunk_id long, text string")
    got = {r["chunk_id"]: list(r["dense"]) for r in dense.embed_with(df, "chunk_id", "length", 2).collect()}
    assert got == {1: [3.0, 1.0], 2: [5000.0, 1.0], 3: [0.0, 1.0]}
    assert [r["dense"][0] for r in dense.embed_with(df.where("chunk_id = 2"), "chunk_id", "length", 2, char_limit=4000).collect()] == [4000.0]


def test_row_numbers_across_blocks(spark):
    df = spark.range(0, 1000, 3).select(F.lit("k").alias("key"), F.col("id").alias("pos"))
    got = [r["n"] for r in events.number_rows(df, "key", "pos", "n", block=50).orderBy("pos").collect()]
    assert got == list(range(1, 335))


def test_unknown_job_is_lost(spark):
    log = spark.createDataFrame([("a", 1, "running"), ("a", 2, "done")], "job_id string, seq long, state string")
    cursors = spark.createDataFrame([("a", 1), ("zzz", 4)], "job_id string, cursor long")
    found, heads = events.events_since(log, cursors, ["seq"])
    assert [(r["job_id"], r["position"]) for r in found.collect()] == [("a", 1)]
    got = {r["job_id"]: (r["new_cursor"], r["done"], r["lost"]) for r in heads.collect()}
    assert got == {"a": (2, True, False), "zzz": (4, True, True)}


def test_job_age_counts_clock_seconds(spark):
    jobs = spark.sql("SELECT 'a' AS job_id, timestamp_ntz'2024-01-01 01:59:59.9' AS created_at, true AS done "
                     "UNION ALL SELECT 'b', timestamp_ntz'2024-01-01 02:00:00.1', true")
    now = F.lit("2024-01-01 03:00:00").cast("timestamp_ntz")
    assert [r["job_id"] for r in events.live_jobs(jobs, now).collect()] == ["b"]


def _cancelling():
    """Two words of one dimension and opposite signs, one that shares the dimension, one that does not."""
    import hashlib

    at = {}
    for word in (f"w{i}" for i in range(2000)):
        digest = hashlib.md5(word.encode()).hexdigest()
        at.setdefault((int(digest, 16) % 64, digest[0] < "8"), []).append(word)
    up, down = at[5, True], at[5, False]
    return up[0], down[0], up[1], down[1], at[6, True][0]


def test_texts_whose_terms_cancel_score_as_in_sql(spark):
    up, down, up2, down2, other = _cancelling()
    docs = spark.createDataFrame([(1, f"{up2} {other}"), (2, f"{up} {down}"), (3, other), (4, ""), (5, None)], "chunk_id long, text string")
    got = {r["chunk_id"]: r["dense"] for r in dense.hash_embed(docs, "chunk_id").collect()}
    assert np.isnan(got[2][5]) and [x for i, x in enumerate(got[2]) if i != 5] == [0.0] * 63
    assert not any(got[4]) and not any(got[5])
    # The second question holds dimension 5, though its own terms cancel there; the third does not; the fourth is lost itself.
    asked = spark.createDataFrame([(1, up), (2, f"{up2} {down2} {other}"), (3, other), (4, f"{up2} {down2}")], "qid long, text string")
    asked = dense.hash_embed(asked, "qid").withColumnRenamed("dense", "qdense")
    chunks = dense.hash_embed(docs, "chunk_id")
    hits = dense.dense_top_k(chunks, asked, 2)
    first = {(r["qid"], r["dense_rank"]): (r["chunk_id"], r["score"]) for r in hits.collect()}
    assert first[1, 0][0] == 2 and np.isnan(first[1, 0][1]) and first[1, 1] == (1, round(0.5 ** 0.5, 9))
    assert first[2, 0][0] == 2 and np.isnan(first[2, 0][1]) and first[2, 1] == (3, 1.0)
    assert first[3, 0] == (3, 1.0) and first[3, 1] == (1, round(0.5 ** 0.5, 9))
    assert [first[4, r][0] for r in (0, 1)] == [1, 2] and all(np.isnan(first[4, r][1]) for r in (0, 1))
    clustered = dense_clusters.cluster_top_k(dense_clusters.cluster_index(chunks, centres=2, part_rows=2), asked, 2).hits
    assert {(r["qid"], r["dense_rank"]): (r["chunk_id"], str(r["score"])) for r in clustered.collect()} == {k: (c, str(s)) for k, (c, s) in first.items()}


def test_term_vectors_scan_equals_postings(spark, folder):
    docs, doc_scope, asked, asked_scope = scoped(spark, folder)
    q = sparse.postings(asked, "qid").cache()
    limits = dict(chunk_scope=doc_scope, question_scope=asked_scope, exact=["user_id"], optional=["lang"])
    for more in ({}, limits, {"max_question_rows": 1}):
        want = rows(sparse.sparse_top_k(sparse.postings(docs, "chunk_id"), q, **more), "sparse_rank")
        assert want and rows(sparse.sparse_top_k(sparse.term_vectors(docs, "chunk_id"), q, **more), "sparse_rank") == want


def test_texts_of_one_key_add_up_without_term_rows(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "alpha"), (2, None), (3, "")], "chunk_id long, text string")
    found = sparse.postings(docs, "chunk_id")
    assert sorted((r["chunk_id"], r["tf"]) for r in found.collect()) == [(1, 1), (1, 2)]
    # Term rows are neither grouped nor moved: the one exchange moves texts.
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 1 and not re.search(r"keys=\[[^\]]*term", plan)


def test_questions_that_are_alike_are_searched_once(spark, folder):
    docs, doc_scope, asked, asked_scope = scoped(spark, folder)
    # Every question 40 times, each with a number of its own behind it; some numbers stand in documents.
    many = asked.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(39)))).select(
        (F.col("qid") * 40 + F.col("n")).alias("qid"), F.col("qid").alias("_of"), F.concat_ws(" ", "text", (F.col("n") + 10).cast("string")).alias("text"))
    limits = many.select("qid", "_of").join(asked_scope.withColumnRenamed("qid", "_of"), "_of").drop("_of").cache()
    vectors, terms = sparse.term_vectors(docs, "chunk_id").cache(), sparse.postings(many, "qid").cache()
    scope = dict(exact=["user_id"], optional=["lang"])
    for filters in ({}, dict(chunk_scope=doc_scope, question_scope=limits, **scope)):
        want = rows(sparse.sparse_top_k(vectors, terms, **filters), "sparse_rank")
        assert want and want == rows(sparse.sparse_top_k(vectors, terms, shared_above=1, **filters), "sparse_rank")
    chunks = dense.hash_embed(docs, "chunk_id").join(doc_scope, "chunk_id")
    vectors = dense.hash_embed(many, "qid").withColumnRenamed("dense", "qdense").join(limits, "qid").cache()
    want = rows(dense.dense_top_k(chunks, vectors, **scope), "dense_rank")
    assert want and want == rows(dense.dense_top_k(chunks, vectors, shared_above=1, **scope), "dense_rank")


def test_a_batch_of_alike_questions_scans_for_its_heads_alone(spark, monkeypatch):
    shipped = []
    monkeypatch.setattr(dense._Questions, "__init__", lambda self, rows, *a, _old=dense._Questions.__init__: (shipped.append(len(rows)), _old(self, rows, *a))[1])
    monkeypatch.setattr(sparse._TermIndex, "__init__", lambda self, rows, heads, *a, _old=sparse._TermIndex.__init__: (shipped.append(len(heads)), _old(self, rows, heads, *a))[1])
    docs = spark.createDataFrame([(1, "who calls the office"), (2, "stock 1007"), (3, "nothing")], "chunk_id long, text string")
    asked = spark.range(3000).select(F.col("id").alias("qid"), F.concat(F.lit("who calls fn_"), (F.col("id") + 1000).cast("string")).alias("text"))
    found = sparse.sparse_top_k(sparse.term_vectors(docs, "chunk_id"), sparse.postings(asked, "qid"))
    assert found.groupBy("chunk_id").count().orderBy("chunk_id").collect() == [(1, 3000), (2, 1)]
    near = dense.dense_top_k(dense.hash_embed(docs, "chunk_id"), dense.hash_embed(asked, "qid").withColumnRenamed("dense", "qdense"))
    assert near.count() == 9000
    assert shipped[0] == 1 and shipped[1] <= 128


def test_block_search_makes_no_rows_of_question_chunk_pairs(spark, folder):
    docs, doc_scope, asked, asked_scope = scoped(spark, folder)
    p, q = sparse.postings(docs, "chunk_id").cache(), sparse.postings(asked, "qid").cache()
    limits = dict(chunk_scope=doc_scope, question_scope=asked_scope, exact=["user_id"], optional=["lang"])
    for filters, index in (({}, sparse_blocks.block_index(p)), (limits, sparse_blocks.block_index(p, scope=doc_scope, exact=["user_id"]))):
        shipped, joined = (sparse_blocks.block_top_k(index, q, max_question_rows=most, **filters) for most in (10**6, 1))
        want = rows(sparse.sparse_top_k(p, q, **filters), "sparse_rank")
        assert want and rows(shipped.hits, "sparse_rank") == want == rows(joined.hits, "sparse_rank")
        assert shipped.candidates.count() <= joined.candidates.count()
        plans = [found.hits._jdf.queryExecution().optimizedPlan().toString() for found in (shipped, joined)]
        assert ["MapInArrow" in plan for plan in plans] == [True, False]
