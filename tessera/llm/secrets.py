"""Secret scans: fixed patterns, and strings that look random to two character Markov models.

All work is DataFrame expressions. A text is scanned in place; positions are code points, ends exclusive. A null text is
empty; empty texts and texts without secrets give zero counts and empty span lists. Repeated rows and repeated or null ids
are scanned row by row, never joined or grouped. Other columns are ignored. An empty table, or samples of one label only,
trains models that are flat where nothing was seen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "markov"]
# Patterns of the base kinds; a match counts when `least` characters of group `group` are there.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"  # a run of 32 or more is the greedy match of a run that passes
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_.=-"
SYMBOLS = len(ALPHABET) + 1  # 0: the start, and any other character
BLOCK = 256
SAMPLED = 20_000  # labelled strings of each kind that the models learn from, at most
LEAST = 16  # characters of a `markov` span, at least
UNIT = 1000  # log ratios are kept in thousandths, so sums are exact in any order


def _running(lengths: Column) -> Column:
    """Sum of the elements before each position, by blocks: n*n/256 steps instead of n*n."""
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lengths, F.lit(1), b * BLOCK), zero, add))
    return F.transform(
        F.sequence(F.lit(0), F.size(lengths) - 1),
        lambda k: F.element_at(blocks, (F.floor(k / BLOCK) + 1).cast("int")) + F.aggregate(F.slice(lengths, (F.floor(k / BLOCK) * BLOCK + 1).cast("int"), (k % BLOCK).cast("int")), zero, add),
    )


def _found(df: DataFrame, name: str, pattern: str, group: int, least: int, maybe: Column | None = None) -> DataFrame:
    """Adds column `name`: array of (start, kind, end, value) of the matches, in order."""
    text = F.col("text")
    none = F.array().cast("array<string>")
    scan = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    df = df.withColumn("_m", scan(0) if maybe is None else F.when(maybe, scan(0)).otherwise(none))
    hit = F.size("_m") > 0
    df = df.withColumns({
        "_v": F.when(hit, scan(group)).otherwise(none) if group else F.col("_m"),
        "_g": F.transform(F.when(hit, F.split(text, pattern, -1)).otherwise(none), lambda x: F.length(x).cast("long")),
        "_l": F.transform("_m", lambda x: F.length(x).cast("long")),
    })
    # Before match k stand gaps 0..k and matches 0..k-1.
    df = df.withColumn("_s", F.when(hit, _running(F.zip_with(F.slice("_g", F.lit(2), F.size("_l")), "_l", lambda g, m: g + m))).otherwise(F.array().cast("array<long>")))
    kind = KINDS.index(name)
    spans = F.transform(
        F.when(hit, F.sequence(F.lit(0), F.size("_m") - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(
            (F.get("_s", k) + F.get("_g", F.lit(0))).alias("start"), F.lit(kind).alias("kind"),
            (F.get("_s", k) + F.get("_g", F.lit(0)) + F.get("_l", k)).alias("end"), F.get("_v", k).alias("value"),
        ),
    )
    return df.withColumn(name, F.filter(spans, lambda x: F.length(x["value"]) >= least)).drop("_m", "_v", "_g", "_l", "_s")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and the spans of the three base kinds."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    df = _found(df, "assign", ASSIGN, 2, 8, text.contains(":") | text.contains("="))
    df = _found(df, "access", ACCESS, 0, 16, text.contains("AKIA"))
    return _found(df, "hex", HEX, 0, 32)


def _codes(value: Column) -> Column:
    """Numbers of the characters; a start symbol comes first."""
    return F.concat(F.array(F.lit(0)), F.transform(F.split(value, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c))))


def samples(docs: DataFrame, most: int = SAMPLED) -> DataFrame:
    """(value, label) for training: values of base spans are random (1), other words are ordinary (0).

    At most `most` of each label, in the order of a hash; ordinary words come from about a tenth as many texts.
    """
    found = base_spans(docs)
    values = F.flatten(F.array("assign", "access", "hex"))
    random = found.select(F.explode(F.transform(values, lambda x: x["value"])).alias("value")).withColumn("label", F.lit(1))
    # Texts are drawn by a hash, about most / 10 of them, so that none of them moves.
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    share = min(1.0, most / 10 / max(1, texts.count()))
    texts = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) <= share * (1 << 30))
    ordinary = texts.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("value"))
    ordinary = ordinary.where(~F.col("value").rlike("^(AKIA[A-Z0-9]{12,}|[0-9a-f]{32,})$")).withColumn("label", F.lit(0))
    pick = lambda df: df.orderBy(F.xxhash64("value")).limit(most)
    return pick(random).unionByName(pick(ordinary))


def train(labelled: DataFrame) -> list[int]:
    """Log-likelihood ratios (random over ordinary) of every character pair, in thousandths of a nat.

    First-order models with half a count added to each pair; the table has (alphabet + 1) squared entries.
    """
    codes = labelled.select("label", _codes(F.col("value")).alias("c"))
    pairs = codes.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda k: F.get("c", k - 1) * SYMBOLS + F.get("c", k))).alias("pair"))
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for a in range(SYMBOLS):
        row = range(a * SYMBOLS, (a + 1) * SYMBOLS)
        sums = [sum(counts.get((label, p), 0) for p in row) for label in (0, 1)]
        for p in row:
            ordinary, random = ((counts.get((label, p), 0) + 0.5) / (sums[label] + 0.5 * SYMBOLS) for label in (0, 1))
            out.append(round(UNIT * math.log(random / ordinary)))
    return out


def score(value: Column, model: list[int]) -> Column:
    """Log-likelihood ratio of a string, in thousandths of a nat."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    state = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("sum"))

    def step(s, c):
        code = F.instr(F.lit(ALPHABET), c)
        return F.struct(code.alias("last"), (s["sum"] + F.get(table, s["last"] * SYMBOLS + code)).alias("sum"))

    return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), state, step, lambda s: s["sum"])


PLACES = "array<struct<start:bigint,end:bigint>>"


def _apart(run: Column, base: Column) -> Column:
    """What is left of a run outside the base spans (in order), in pieces of LEAST or more characters."""
    none = F.array().cast(PLACES)
    piece = lambda a, b: F.when(b - a >= LEAST, F.array(F.struct(a.alias("start"), b.alias("end")))).otherwise(none)
    return F.aggregate(
        F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])),
        F.struct(run["start"].alias("at"), none.alias("out")),
        lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), F.concat(s["out"], piece(s["at"], b["start"])).alias("out")),
        lambda s: F.concat(s["out"], piece(s["at"], run["end"])),
    )


def stretches(value: Column, model: list[int], least_total: int, least_mean: int) -> Column:
    """Start and end of every random stretch of a string, in one pass over its characters.

    A stretch begins where the running sum of (log ratio - least_mean) leaves zero. It is closed when that sum is back at zero or
    has fallen by least_total from its maximum, and ends at the maximum over LEAST or more characters. So whatever raises the
    sum by more than least_total is in a stretch, or cut by the end of one. It counts if its log ratio reaches least_total.
    """
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    zero = F.lit(0).cast("long")
    none = F.array().cast(PLACES)
    # top: the maximum so far; best, end: that over LEAST or more characters, and where it is.
    fields = ["last", "at", "begin", "sum", "top", "best", "end", "out"]
    state = lambda *values: F.struct(*(v.alias(n) for n, v in zip(fields, values)))

    def closed(s):
        size = s["end"] - s["begin"]
        counts = (size >= LEAST) & (s["best"] >= 0) & (s["best"] + least_mean * size >= least_total)
        return F.when(counts, F.concat(s["out"], F.array(F.struct(s["begin"].alias("start"), s["end"].alias("end"))))).otherwise(s["out"])

    def step(s, c):
        code = F.instr(F.lit(ALPHABET), c)
        at = s["at"] + 1
        now = s["sum"] + F.get(table, s["last"] * SYMBOLS + code) - least_mean
        over = (now <= 0) | (s["top"] - now >= least_total)
        further = (now > s["best"]) | (at - s["begin"] <= LEAST)
        fresh = lambda restart, value: F.when(over, restart).otherwise(value)
        return state(
            code, at, fresh(at, s["begin"]), fresh(zero, now), fresh(zero, F.greatest(s["top"], now)),
            fresh(zero, F.when(further, now).otherwise(s["best"])), fresh(at, F.when(further, at).otherwise(s["end"])), F.when(over, closed(s)).otherwise(s["out"]),
        )

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.aggregate(chars, state(F.lit(0), zero, zero, zero, zero, zero, zero, none), step, closed)


def scan(docs: DataFrame, model: list[int], *, least_total: int = 10 * UNIT, least_mean: int = UNIT // 4) -> DataFrame:
    """doc_id, text, `base` and `spans`: arrays of (start, kind, end), ordered by start and kind.

    Base spans are cut out of the runs of key characters. A piece of 16 or more is a `markov` span if its log ratio reaches
    `least_total` and `least_mean` per character; of any other piece those stretches are that do.
    """
    df = _found(base_spans(docs), "markov", CANDIDATE, 0, LEAST)
    bare = lambda xs: F.transform(xs, lambda x: F.struct(x["start"], x["kind"], x["end"]))
    df = df.withColumns({"base": F.array_sort(bare(F.flatten(F.array("assign", "access", "hex"))))})
    part = lambda x, p: F.substring(x["value"], (p["start"] - x["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int"))
    df = df.withColumn("piece", F.flatten(F.transform("markov", lambda x: F.transform(
        _apart(x, F.col("base")), lambda p: F.struct(p["start"], p["end"], part(x, p).alias("value"))))))
    df = df.withColumn("piece", F.transform("piece", lambda p: F.struct(p["start"], p["end"], p["value"], score(p["value"], model).alias("sum"))))
    span = lambda a, b: F.struct(a.alias("start"), F.lit(KINDS.index("markov")).alias("kind"), b.alias("end"))
    likely = F.flatten(F.transform("piece", lambda p: F.when(
        (p["sum"] >= least_total) & (p["sum"] >= least_mean * (p["end"] - p["start"])), F.array(span(p["start"], p["end"])),
    ).otherwise(F.transform(stretches(p["value"], model, least_total, least_mean), lambda q: span(p["start"] + q["start"], p["start"] + q["end"])))))
    df = df.withColumn("likely", likely)
    return df.select("doc_id", "text", "assign", "access", "hex", "base", F.array_sort(F.concat("base", "likely")).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, SHA-256 of the base spans, and all spans."""
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found.select("doc_id", *map(size, KINDS[:3]), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
