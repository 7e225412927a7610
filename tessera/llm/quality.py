"""Quality classifier: rules from tree paths, weighted by a lasso logistic model, compiled to column expressions.

Statistics of a text come from one pass over its bytes. Labels, language, source and ids are never inputs. A null text
counts as empty; its statistics are zeros and it gets a score like any text. Repeated rows are scored alike; a label
repeated for one id counts as often as it is given, and null labels are left out. Without labels of both classes the
model is the constant share of label 1 (one half without labels). Other columns are carried, never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import SPACE, slices, words

SAMPLED = 20_000  # labelled rows that the model is fitted on, at most
STATS = [
    "chars", "words", "word_length", "digits", "upper", "marks", "wide", "lines", "line_length", "distinct_words", "top_word",
    "bang", "dollar", "percent", "star", "hash", "amp", "pipe", "period", "comma", "colon", "url", "longest_word", "top_byte",
]
_SINGLE = [ord(c) for c in "!$%*#&|.,:/"]
_MARKS = np.array([chr(b).isascii() and not chr(b).isalnum() and 32 < b < 127 for b in range(256)])


def _stats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    hashes, first = words(data, offsets)
    out = np.zeros((len(offsets) - 1, len(STATS)))
    for k in range(len(out)):
        text, own = data[offsets[k] : offsets[k + 1]], hashes[first[k] : first[k + 1]]
        if not len(text):
            continue
        seen = np.bincount(text, minlength=256)
        chars = len(text) - seen[128:192].sum()
        spaces = seen[SPACE].sum()
        n, body = max(1, len(own)), max(1, chars - spaces)
        counts = np.unique(own, return_counts=True)[1]
        gaps = np.diff(np.flatnonzero(SPACE[text]), prepend=-1, append=len(text))
        printed = seen.copy()
        printed[SPACE] = 0
        out[k] = [
            math.log1p(chars), math.log1p(len(own)), body / n, seen[48:58].sum() / body, seen[65:91].sum() / body, seen[_MARKS].sum() / n,
            seen[192:].sum() / body, math.log1p(seen[10]), math.log1p(chars / (1 + seen[10])), len(counts) / n, counts.max(initial=0) / n,
            *(seen[b] / n for b in _SINGLE), math.log1p(gaps.max()), printed.max() / body,
        ]
    return out


def _rows(batches):
    for batch in batches:
        parts = [_stats(data, offsets) for _, _, data, offsets in slices(batch.column("text"))]
        table = np.concatenate(parts) if parts else np.zeros((0, len(STATS)))
        kept = [batch.column(c) for c in batch.schema.names if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.ascontiguousarray(table[:, j])) for j in range(len(STATS)))], names=[*names, *(f"s_{s}" for s in STATS)])


def statistics(df: DataFrame) -> DataFrame:
    """The frame with the statistics s_* in place of its text; give it only the columns that are needed besides."""
    kept = [f for f in df.schema if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"s_{s} double" for s in STATS)])
    return df.mapInArrow(_rows, schema)


Rule = list[tuple[str, bool, float]]  # (statistic, above, threshold), all to hold


def _paths(node, features: list[str], so_far: Rule = ()) -> list[Rule]:
    """Conjunctions of every inner and outer node of a fitted tree but its root."""
    found = [list(so_far)] if so_far else []
    if node.subtreeDepth() == 0:
        return found
    name, threshold = features[node.split().featureIndex()], node.split().threshold()
    return found + _paths(node.leftChild(), features, [*so_far, (name, False, threshold)]) + _paths(node.rightChild(), features, [*so_far, (name, True, threshold)])


def _slim(rule: Rule) -> tuple:
    """One condition per statistic and side: the tightest."""
    tight: dict[tuple[str, bool], float] = {}
    for name, above, t in rule:
        t = round(t, 9)
        old = tight.get((name, above))
        tight[name, above] = t if old is None else (max if above else min)(old, t)
    return tuple(sorted((name, above, t) for (name, above), t in tight.items()))


def holds(rule: Rule) -> Column:
    """1.0 where every condition holds, else 0.0."""
    out = F.lit(True)
    for name, above, t in rule:
        out = out & ((F.col(name) > t) if above else (F.col(name) <= t))
    return F.when(out, 1.0).otherwise(0.0)


def fit(labelled: DataFrame, *, label: str = "quality", trees: int = 12, depth: int = 3, penalty: float = 0.002, most: int = SAMPLED) -> tuple[float, list[tuple[float, Rule]]]:
    """(intercept, [(weight, rule)]) from rows of text and label; a sample of at most `most` rows, in hash order, is fitted."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    features = [f"s_{s}" for s in STATS]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = statistics(labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), F.xxhash64(text).alias("h"), text.alias("text")))
    sample = rows.orderBy("h", "y").limit(most).drop("h").coalesce(1).persist()
    try:
        share = sample.agg(F.count("y").alias("n"), F.avg("y").alias("p")).first()
        if not share["n"] or share["p"] in (0.0, 1.0):
            p = (share["n"] * (share["p"] or 0) + 0.5) / (share["n"] + 1)
            return math.log(p / (1 - p)), []
        # Rare labels weigh as much as common ones, so that the trees look for both.
        weighted = sample.withColumn("w", F.when(F.col("y") == 1, 0.5 / share["p"]).otherwise(0.5 / (1 - share["p"])))
        table = VectorAssembler(inputCols=features, outputCol="x").transform(weighted)
        forest = RandomForestClassifier(labelCol="y", featuresCol="x", weightCol="w", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=7).fit(table)
        rules = list(dict.fromkeys(_slim(r) for t in forest.trees for r in _paths(t._call_java("rootNode"), features)))
        if not rules:
            return math.log(share["p"] / (1 - share["p"])), []
        hits = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="x").transform(sample.select("y", *(holds(r).alias(f"r{k}") for k, r in enumerate(rules))))
        lasso = LogisticRegression(labelCol="y", featuresCol="x", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=100).fit(hits.select("y", "x"))
        weights = lasso.coefficients.toArray().tolist()
        return lasso.intercept, [(w, r) for w, r in zip(weights, rules) if w]
    finally:
        sample.unpersist()


def probability(model: tuple[float, list[tuple[float, Rule]]]) -> Column:
    """The model as an expression over the statistics."""
    out = F.lit(float(model[0]))
    for weight, rule in model[1]:
        out = out + weight * holds(rule)
    return 1.0 / (1.0 + F.exp(-out))


def score(docs: DataFrame, model, keep: list[str] = ()) -> DataFrame:
    """The columns `keep` of `docs` and `score`, the probability of label 1."""
    rows = docs.select(*dict.fromkeys(keep), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) if "text" not in keep else None
    if rows is None:
        raise ValueError("the text is replaced by its statistics; join it back by id, or keep the other columns")
    return statistics(rows).select(*keep, probability(model).alias("score"))
