"""Definition blocks of source code, found line by line.

There is no grammar here.  Lines carry an indent (Python) or a bracket depth (JavaScript, TypeScript,
Go) obtained by running sums within a file; a definition line opens a block and the block ends with
its indent or depth.  This is approximate: strings that hold triple quotes, several statements on one
line, and continuation lines at the left margin can move a boundary.  A Python file whose triple
quotes do not pair up, and a file whose brackets do not, is cut into line windows instead.

A file stays one row: its lines are arrays, and `code_blocks` works out the sums over Arrow batches of files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import constants as K
from tessera.functions.script_noise import without_brace_noise
from tessera.functions.text import lines_with_ends, strip
from tessera.operators.code_blocks import BLOCK, KINDS, blocks_of, families, marked
from tessera.operators.chunk_docs import window_parts

_BRACE_GRAMMARS = ["javascript", "typescript", "tsx", "go"]
# Short strings and comments, with possessive loops so a long line cannot backtrack.
_PY_NOISE = (
    r"(\"\"\"|''')|\"(?:\\.|[^\"\\\n])*+\"|'(?:\\.|[^'\\\n])*+'|#(?!.*(?:\"\"\"|''')).*"
)


def _bare(text: Column, grammar: Column) -> Column:
    """The text without strings and comments in languages with braces, else null."""
    braces = grammar.isin(_BRACE_GRAMMARS)
    return F.when(braces, without_brace_noise(F.when(braces, text), grammar))


def file_lines(files: DataFrame, key: str = "fid", keep: list[str] | None = None) -> DataFrame:
    """(key, grammar, *keep, n, line, bare): 1-based lines of each file, placed by file; `bare` is the line without strings and
    comments in languages with braces, else null."""
    columns = [key, "grammar", *(keep or [])]
    spread = files.select(*columns, "content").repartition(key)
    text = F.col("content")
    both = F.arrays_zip(lines_with_ends(text).alias("line"), F.coalesce(lines_with_ends(_bare(text, F.col("grammar"))), F.array().cast("array<string>")).alias("bare"))
    rows = spread.select(*columns, F.posexplode(both).alias("_p", "_l"))
    return rows.select(*columns, (F.col("_p") + 1).alias("n"), "_l.line", "_l.bare")


def _with_lines(files: DataFrame) -> DataFrame:
    """Files with what tasks split up: `_lines` and `_code` of Python files, lines and these without strings and comments (triple
    quotes stay); of files with braces `_text`, all of it."""
    text, python = F.col("content"), F.col("grammar") == "python"
    code = lambda line: F.regexp_replace(F.regexp_replace(line, r"[\r\n]+$", ""), _PY_NOISE, "$1")
    split = files.withColumn("_lines", F.when(python, lines_with_ends(text)))
    return split.withColumns({"_code": F.transform("_lines", code), "_text": F.when(~python, text)})


def python_blocks(files: DataFrame, key: str = "fid", keep: list[str] | None = None) -> DataFrame:
    """(key, *keep, n, line, code, kind, class_name, function_name): the lines of Python files with the definition they belong to;
    uncovered and class-level lines included. `code` is the line without strings and comments."""
    columns = [key, *(keep or [])]
    source = _with_lines(files.withColumn("grammar", F.lit("python"))).select(*columns, "grammar", "_lines", "_code", "_text")
    schema = StructType([*[source.schema[c] for c in columns], *StructType.fromDDL("n int, line string, code string, kind string, class_name string, function_name string")])
    names = schema.names

    def find(batches):
        for batch in families(batches):
            row, n, line, m = marked(batch)
            good = np.flatnonzero(m.good)
            taken = [batch.column(c).take(pa.array(row[good])) for c in columns]
            texts = [line.take(pa.array(good)), m.code.take(pa.array(good)), *(pa.array(x[good].tolist(), pa.string()) for x in (KINDS[m.kind], m.class_name, m.function_name))]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(n[good].astype(np.int32)), *texts], names=names)

    return source.mapInArrow(find, schema)


def code_chunks(files: DataFrame, key: str = "fid", shorten_above: int | None = None) -> DataFrame:
    """Chunks of code files (columns: key, grammar, content): header, definitions, or line windows.

    Files of unknown grammar, unreadable files, and files where nothing qualified get windows.  A block has its whole text,
    lines, signature and docstring.  With `shorten_above`, definitions of more lines are indexed by signature and docstring
    alone and keep their text in `full_body`.  `large_function` marks them either way.
    """
    grammar = F.col("grammar")
    known = grammar.isin("python", *_BRACE_GRAMMARS)
    source = _with_lines(files.where(known).select(key, "grammar", "content")).select(key, "grammar", "_lines", "_code", "_text")
    schema = StructType([*[source.schema[c] for c in (key, "grammar")], *StructType.fromDDL(f"content string, _blocks array<struct<{BLOCK}>>")])

    def find(batches):
        for batch in families(batches):
            blocks, defined = blocks_of(batch)
            # A definition has text, so its file is not cut into windows and need not come back whole.
            texts = pc.binary_join(batch.column("_lines").filter(pa.array(~defined)), "")
            content = pc.replace_with_mask(pa.nulls(batch.num_rows, pa.string()), pa.array(~defined), texts.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "grammar")), content, blocks], [key, "grammar", "content", "_blocks"])

    found = source.mapInArrow(find, schema)
    found = found.withColumn("_blocks", F.filter("_blocks", lambda b: F.exists(b["lines"], lambda line: line.rlike(r"(?U)[^\s]"))))
    # A file without any block is cut into windows in its own row, so that a file is worked on once for both.
    none = F.lit(None).cast("string")
    window = lambda p: F.struct(
        p["chunk_type"].alias("kind"), F.lit(False).alias("definition"), none.alias("class_name"), none.alias("function_name"),
        p["start_line"].alias("start_line"), p["end_line"].alias("end_line"), F.array(p["text"]).alias("lines"))
    windows = F.transform(window_parts(F.col("content")), window).cast(found.schema["_blocks"].dataType)
    has_block = F.size("_blocks") > 0
    other = files.where(~F.coalesce(known, F.lit(False))).select(key, "grammar", F.lit(True).alias("_cut"), F.explode(windows).alias("_b"))
    pieces = found.select(key, "grammar", (~has_block).alias("_cut"), F.explode(F.when(has_block, F.col("_blocks")).otherwise(windows)).alias("_b"))
    blocks = pieces.unionByName(other).select(key, "grammar", "_cut", "_b.*")

    lines, is_python = F.col("lines"), grammar == "python"
    body = F.array_join(lines, "")
    plain = F.transform(F.slice(lines, 1, 5), lambda l: F.regexp_replace(l, r"\s+$", ""))
    closing = F.try_element_at(F.filter(F.transform(plain, lambda l, i: F.when(l.endswith(":"), i + 1)), lambda i: i.isNotNull()), F.lit(1))
    signature = F.when(is_python, F.array_join(F.slice(plain, 1, F.coalesce(closing, F.lit(5))), "\n")).otherwise(plain[0])
    quoted = r"(?s)\A\s*([rRuUbB]{0,2}(?:\"\"\".*?\"\"\"|'''.*?'''|\"[^\"\n]*\"|'[^'\n]*'))"
    docstring = F.when(is_python, F.nullif(F.regexp_extract(F.substr("_body", F.length("signature") + 1), quoted, 1), F.lit("")))
    length = F.col("end_line") - F.col("start_line") + 1
    shortened = F.lit(False) if shorten_above is None else F.col("definition") & (length > shorten_above)
    short = strip(F.concat_ws("\n", "signature", docstring))
    has_lines = F.col("kind") != "module_header"
    cut = F.col("_cut")
    return blocks.withColumns({"_body": body, "signature": signature, "_short": shortened}).select(
        key,
        F.col("kind").alias("chunk_type"),
        "function_name",
        "class_name",
        F.when(has_lines & ~cut, F.col("signature")).alias("signature"),
        F.when(has_lines, F.col("start_line")).alias("start_line"),
        F.when(has_lines, F.col("end_line")).alias("end_line"),
        F.when(F.col("_short"), short).otherwise(strip(F.col("_body"))).alias("text"),
        F.when(F.col("_short"), F.col("_body")).alias("full_body"),
        (F.col("definition") & (length > K.LARGE_DEFINITION_LINES)).alias("large_function"),
        F.when(~cut, "block").when(F.col("kind") == "function", "generic_window").otherwise("whole").alias("chunking"),
    )


def uncovered_lines(lines: DataFrame, ranges: DataFrame, key: str = "fid") -> DataFrame:
    """Lines outside every [start_line, end_line] of the same file, by one sweep: a range adds one at its start and takes it
    off behind its end, and a line is uncovered where the running sum is zero.  Lines and marks meet by file only, in file
    order; marks of one place are summed first."""
    whole = ranges.where(F.col("start_line") <= F.col("end_line"))
    marks = whole.select(key, F.explode(F.array(
        F.struct(F.col("start_line").alias("n"), F.lit(1).alias("_m")), F.struct((F.col("end_line") + 1).alias("n"), F.lit(-1).alias("_m")))).alias("_e"))
    marks = marks.groupBy(key, F.col("_e.n").alias("n")).agg(F.sum("_e._m").alias("_m"))
    both = lines.withColumn("_m", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True)
    # Marks come before the lines of their place.
    so_far = Window.partitionBy(key).orderBy("n", F.col("_m").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("_open", F.sum(F.coalesce("_m", F.lit(0))).over(so_far))
    return swept.where(F.col("_m").isNull() & (F.col("_open") == 0)).select(*lines.columns)
