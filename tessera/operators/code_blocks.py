"""Which block each line of a file belongs to, over Arrow batches of files: running sums and extremes by file, block and method.

Lines come as arrays in the row of their file, so no line is a row and nothing moves or is sorted.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from tessera.functions.script_noise import bare_text

# Tasks receive these helpers with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_LINES = 500_000  # lines worked on at a time, about
BATCH_BYTES = 4_000_000  # bytes of files with braces, likewise
KINDS = np.array(["module_header", "class", "function", "method"])
HEADER, CLASS, FUNCTION, METHOD = range(4)
_TRIPLE = "\"\"\"|'''"
_PY_DEF = re.compile(r"^\s*(?:async\s+)?def\s+(\w+)", re.A)
_PY_CLASS = re.compile(r"^\s*class\s+(\w+)", re.A)
_PY_HEAD = re.compile(r"^(?:async\s+)?(?:def|class)\s+(\w+)", re.A)
_TO_CLOSING = re.compile(rf"^.*?(?:{_TRIPLE})")
_PAIRS = re.compile(rf"(?:{_TRIPLE}).*?(?:{_TRIPLE})")
_FROM_OPENING = re.compile(rf"(?:{_TRIPLE}).*$")
_S = r"[ \t\n\x0b\f\r]"
_WORD = r"[A-Za-z_$][\w$]*"
# Definition starts per grammar: (kind, pattern); the first group is the name.
_JS_RULES = [
    (FUNCTION, re.compile(rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_WORD})", re.A)),
    (CLASS, re.compile(rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_WORD})", re.A)),
    (FUNCTION, re.compile(rf"^\s*(?:export\s+)?(?:const|let|var)\s+({_WORD})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:<[^>]*>\s*)?(?:\([^)]*\)?|{_WORD})\s*(?::[^=]+)?(?:=>|$|\{{?\s*$)", re.A)),
]
_GO_RULES = [
    (FUNCTION, re.compile(r"^func\s+(?:\([^)]*\)\s*)?(\w+)", re.A)),
    (CLASS, re.compile(r"^type\s+(\w+|\()", re.A)),
]
_METHOD = re.compile(
    rf"^\s*(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*\*?\s*"
    rf"(?!(?:if|for|while|switch|catch|return|function|new|else|do|try|throw|await|typeof)\b)(#?{_WORD})\s*(?:<[^>]*>)?\s*\(", re.A)


def _has(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


class Parts:
    """Lines in runs that begin where `first` holds."""

    def __init__(self, first: np.ndarray):
        self.of, self.start = np.cumsum(first) - 1, np.flatnonzero(first)

    def before(self, value: np.ndarray) -> np.ndarray:
        """Running sum in the run, without the line itself."""
        total = np.cumsum(value) - value
        return total - total[self.start][self.of]

    def upto(self, value: np.ndarray) -> np.ndarray:
        return self.before(value) + value

    def sum(self, value: np.ndarray) -> np.ndarray:
        return np.add.reduceat(value.astype(np.int64), self.start)

    def least(self, value: np.ndarray, where: np.ndarray, none: int) -> np.ndarray:
        """Per run; `none` where no line counts, and no value is above it."""
        return np.minimum.reduceat(np.where(where, value.astype(np.int64), none), self.start)

    def greatest(self, value: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(np.where(where, value.astype(np.int64), -1), self.start)

    def follows(self, mark: np.ndarray, flag: np.ndarray) -> np.ndarray:
        """At lines with `mark`: whether the marked line before it in the run has `flag`."""
        at, out = np.flatnonzero(mark), np.zeros(len(mark), dtype=bool)
        out[at[1:]] = flag[at[:-1]] & (self.of[at[1:]] == self.of[at[:-1]])
        return out


def _names(found: np.ndarray, none: int, name_of) -> np.ndarray:
    """Per run, the name in the line `found`, or null."""
    out = np.full(len(found), None, dtype=object)
    for k in np.flatnonzero(found < none):
        out[k] = name_of(found[k])
    return out


class Marks:
    """Per line: whether its file was understood, its kind, block and names; `code` is the line without strings and comments."""

    def __init__(self, good, kind, definition, class_name, function_name, unit, member, code):
        self.good, self.kind, self.definition, self.class_name, self.function_name = good, kind, definition, class_name, function_name
        self.unit, self.member, self.code = unit, member, code


def python_marks(first: np.ndarray, line: pa.Array, code: pa.Array) -> Marks:
    """`first` marks the first line of each file; `code` is without simple strings and comments, triple quotes left in.

    A unit is a top-level statement, a member a statement at the indent of a class body; decorators belong to the definition
    below them.
    """
    files, size = Parts(first), len(first)
    at = np.arange(size)
    quotes = _count(code, _TRIPLE)
    inside = files.before(quotes) % 2 == 1
    filled = inside | _has(code, r"[^ \t\n\x0b\f\r]")
    blank = pc.utf8_length(line).to_numpy(zero_copy_only=False) - pc.utf8_length(pc.utf8_ltrim(line, " \t\f")).to_numpy(zero_copy_only=False)
    # From here on `code` is what lies outside triple quotes: cut up to a closing one, whole pairs, and from an opening one.
    code = pc.if_else(pa.array(inside & (quotes == 0)), "", code)
    cut = quotes > 0
    if cut.any():
        texts = (_TO_CLOSING.sub("", c) if i else c for c, i in zip(code.filter(pa.array(cut)).to_pylist(), inside[cut]))
        code = pc.replace_with_mask(code, pa.array(cut), pa.array([_FROM_OPENING.sub("", _PAIRS.sub("", c)) for c in texts], code.type))
    stmt = filled & ~inside & ~_has(code, rf"^{_S}*[)\]}}]")
    deco = _has(code, rf"^{_S}*@")
    is_def, is_class = _has(code, rf"^{_S}*(?:async{_S}+)?def{_S}+\w"), _has(code, rf"^{_S}*class{_S}+\w")
    text = lambda k: code[int(k)].as_py()

    top = stmt & (blank == 0)
    start = top & ~files.follows(top, deco)
    unit = files.upto(start.astype(np.int64))
    units = Parts(first | start)
    head = units.least(at, top & (is_def | is_class), size)
    holds = head < size
    kind_of = np.where(holds, np.where(is_class[np.minimum(head, size - 1)], CLASS, FUNCTION), HEADER)
    name = _names(head, size, lambda k: (m.group(1) if (m := _PY_HEAD.match(text(k))) else ""))
    behind = at > head[units.of]
    body = units.least(blank, stmt & (blank > 0) & behind, 1 << 40)
    in_unit = holds[units.of] & (at >= units.least(at, filled, size)[units.of]) & (at <= units.greatest(at, filled)[units.of])
    of_class = (kind_of == CLASS)[units.of]
    level = stmt & of_class & (blank == body[units.of]) & behind
    opens = level & ~units.follows(level, deco)
    member = units.upto(opens.astype(np.int64))
    members = Parts(first | start | opens)
    m_head = members.least(at, level & is_def, size)
    m_name = _names(m_head, size, lambda k: _PY_DEF.match(text(k)).group(1))
    in_method = in_unit & (m_head < size)[members.of] & (at >= members.least(at, filled, size)[members.of]) & (at <= members.greatest(at, filled)[members.of])
    kind = np.where(in_method, METHOD, np.where(in_unit, np.where(of_class, CLASS, FUNCTION), HEADER))
    return Marks(
        (files.sum(quotes) % 2 == 0)[files.of], kind, kind >= FUNCTION, np.where(in_unit & of_class, name[units.of], None),
        np.where(in_method, m_name[members.of], np.where(kind == FUNCTION, name[units.of], None)), np.where(in_unit, unit, -1), np.where(in_method, member, -1), code)


def brace_marks(first: np.ndarray, is_go: np.ndarray, code: pa.Array) -> Marks:
    """As python_marks, for JavaScript, TypeScript and Go; `code` is without strings and comments, `is_go` goes by line."""
    files, size = Parts(first), len(first)
    at = np.arange(size)
    delta = _count(code, r"[{(\[]") - _count(code, r"[})\]]")
    depth = files.before(delta)
    after = depth + delta
    text = lambda k: code[int(k)].as_py()

    line_kind, line_name = np.full(size, -1), np.full(size, None, dtype=object)
    for k in np.flatnonzero((depth <= 0) & _has(code, r"function|class|const|let|var|^func|^type")):
        found = text(k)
        for rule_kind, rule in _GO_RULES if is_go[k] else _JS_RULES:
            if m := rule.search(found):
                line_kind[k], line_name[k] = rule_kind, m.group(1)
                break
    start = line_kind >= 0
    unit = files.upto(start.astype(np.int64))
    units = Parts(first | start)
    kind_of, name = line_kind[units.start], line_name[units.start]
    braces = _count(code, r"\{")
    closed = (after <= 0) & ((units.upto(braces) > 0) | _has(code, rf"[;)]{_S}*$") | _has(code, rf"^type{_S}"))
    end = units.least(at, closed, size)
    end = np.where(end < size, end, units.start)
    in_unit = (kind_of >= 0)[units.of] & (at <= end[units.of])
    is_class = (kind_of == CLASS)[units.of] & ~is_go
    opens, m_name_at = np.zeros(size, dtype=bool), np.full(size, None, dtype=object)
    for k in np.flatnonzero(in_unit & is_class & (depth == 1) & (at > units.start[units.of]) & ~_has(code, rf";{_S}*$")):
        if m := _METHOD.search(text(k)):
            opens[k], m_name_at[k] = True, m.group(1)
    member = units.upto(opens.astype(np.int64))
    members = Parts(first | start | opens)
    m_end = members.greatest(at, np.zeros(size, dtype=bool))
    m_least = members.least(at, (after <= 1) & (members.upto(braces) > 0), size)
    m_end = np.where(m_least < size, m_least, m_end)
    in_method = in_unit & is_class & (member > 0) & (at <= m_end[members.of])
    kind = np.where(in_method, METHOD, np.where(in_unit, kind_of[units.of], HEADER))
    return Marks(
        (files.sum(delta) == 0)[files.of], kind, (kind >= FUNCTION) | ((kind == CLASS) & is_go), np.where(in_unit & is_class, name[units.of], None),
        np.where(in_method, m_name_at[members.start][members.of], np.where(in_unit & (kind_of == FUNCTION)[units.of], name[units.of], None)),
        np.where(in_unit, unit, -1), np.where(in_method, member, -1), code)


def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    """(position of the row, element) of a list column; nulls count as empty."""
    lists = batch.column(name)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _split(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of files with braces with their lines in `_lines` and, without strings, comments and the ends of lines, in `_code`.
    Python ends lines where Spark's expression does."""
    lines, code = [], []
    for text, grammar in zip(batch.column("_text").to_pylist(), batch.column("grammar").to_pylist()):
        own = [] if text is None else text.splitlines(True)
        left = [] if text is None else bare_text(text, grammar).splitlines(True)[: len(own)]
        lines.append(own)
        code.append([line.rstrip("\r\n") for line in left + own[len(left):]])
    kind = pa.list_(pa.string())
    for name, values in (("_lines", lines), ("_code", code)):
        batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(values, kind))
    return batch


def families(batches):
    """Python files and files of languages with braces apart, with their lines, a bounded number of lines or bytes at a time."""
    for batch in batches:
        python = batch.column("grammar").to_numpy(zero_copy_only=False) == "python"
        for own, is_python in ((python, True), (~python, False)):
            if not own.any():
                continue
            part = batch if own.all() else batch.filter(pa.array(own))
            # Of files with braces the bytes are known, not yet the lines.
            size = part.column("_lines").value_lengths() if is_python else pc.binary_length(part.column("_text"))
            at = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // (BATCH_LINES if is_python else BATCH_BYTES)
            for cut in np.split(np.arange(part.num_rows), np.flatnonzero(np.diff(at)) + 1):
                piece = part.slice(cut[0], len(cut))
                yield piece if is_python else _split(piece)


def marked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, Marks]:
    """(row, line number from 1, line, marks) of a batch of one family of grammars (columns: grammar, _lines, _code)."""
    row, line = flat(batch, "_lines")
    _, code = flat(batch, "_code")
    first = np.diff(row, prepend=-1) != 0
    n = np.arange(len(row)) - np.flatnonzero(first)[np.cumsum(first) - 1] + 1
    grammar = batch.column("grammar").to_numpy(zero_copy_only=False)
    if len(grammar) and grammar[0] == "python":
        return row, n, line, python_marks(first, line, code)
    return row, n, line, brace_marks(first, (grammar == "go")[row], code)


BLOCK = "kind string, definition boolean, class_name string, function_name string, start_line int, end_line int, lines array<string>"


def blocks_of(batch: pa.RecordBatch) -> tuple[pa.ListArray, np.ndarray]:
    """The blocks of each file as one list of structs (see BLOCK), in no fixed order, and whether one is a definition."""
    row, line = flat(batch, "_lines")
    if not len(row):
        empty = pa.array([], pa.struct([("kind", pa.string()), ("definition", pa.bool_()), ("class_name", pa.string()), ("function_name", pa.string()),
                                        ("start_line", pa.int32()), ("end_line", pa.int32()), ("lines", pa.list_(pa.string()))]))
        return pa.ListArray.from_arrays(pa.array(np.zeros(batch.num_rows + 1, dtype=np.int32)), empty), np.zeros(batch.num_rows, dtype=bool)
    row, n, line, m = marked(batch)
    keep = np.flatnonzero(m.good)
    keep = keep[np.lexsort((n[keep], m.member[keep], m.unit[keep], m.kind[keep], row[keep]))]
    same = np.stack([row[keep], m.kind[keep], m.unit[keep], m.member[keep]])
    begin = np.flatnonzero(np.append(True, (same[:, 1:] != same[:, :-1]).any(axis=0))) if len(keep) else np.empty(0, dtype=np.int64)
    bounds = np.append(begin, len(keep))
    head, last = keep[begin], keep[bounds[1:] - 1]
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), line.take(pa.array(keep)).cast(pa.string()))
    rows = pa.StructArray.from_arrays(
        [pa.array(KINDS[m.kind[head]].tolist(), pa.string()), pa.array(m.definition[head]), pa.array(m.class_name[head].tolist(), pa.string()),
         pa.array(m.function_name[head].tolist(), pa.string()), pa.array(n[head].astype(np.int32)), pa.array(n[last].astype(np.int32)), lists],
        ["kind", "definition", "class_name", "function_name", "start_line", "end_line", "lines"])
    starts = np.searchsorted(row[head], np.arange(batch.num_rows + 1)).astype(np.int32)
    defined = np.bincount(row[head][m.definition[head]], minlength=batch.num_rows) > 0
    return pa.ListArray.from_arrays(pa.array(starts), rows), defined
