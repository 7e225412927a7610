"""What is left of JavaScript and TypeScript without strings, comments, templates, regular expressions and JSX text, and of Go
without strings and comments.

JavaScript: one scan over the text with a stack of modes, since these nest: code in a template's `${...}`, templates in that code, code in
the braces of JSX, JSX in that code.  The brackets of code stay, all else goes but the ends of lines, so lines keep their
numbers.  Where a value may begin, a slash opens a regular expression and (outside plain TypeScript) a `<` an element.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tasks receive these helpers with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_RUN = re.compile(r"[^'\"`/{}<]+")
# Loops run over stretches, not characters, and never go back.
_STRING = re.compile(r"\"(?:[^\"\\\r\n]++|\\(?:\r\n|.))*+\"?|'(?:[^'\\\r\n]++|\\(?:\r\n|.))*+'?", re.S)
_ATTRIBUTE = re.compile(r"\"[^\"]*+\"?|'[^']*+'?")
_COMMENT = re.compile(r"//[^\r\n]*|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\r\n])*+\]|[^/\\\[\r\n])++/[a-z]*+")
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\.|\$(?!\{))*+", re.S)
_ELEMENT = re.compile(r"<(?:>|[A-Za-z_][\w.:-]*(?=[\s/>]))")
_GENERIC = re.compile(r"<\s*[A-Za-z_]\w*\s*(?:,|extends\b)")
_TAG_PART = re.compile(r"[^'\"{/>]+")
_TEXT = re.compile(r"[^<{]+")
_NAME = re.compile(r"[\w$]+\Z")
_NOT_ENDS = re.compile("[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+")
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await", "default", "extends", "instanceof"}


# Comments and strings of Go; raw strings know no escapes.
_GO = re.compile(r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/|//[^\r\n]*+|\"[^\"\\\r\n]*+(?:\\[^\n\r\x85\u2028\u2029][^\"\\\r\n]*+)*+\"|"
                 r"'[^'\\\r\n]*+(?:\\[^\n\r\x85\u2028\u2029][^'\\\r\n]*+)*+'|`[^`]*+`")


def _may_begin(last: str, marks: str) -> bool:
    """Whether a value may stand after this code."""
    if not last:
        return True
    if last[-1].isalnum() or last[-1] in "_$":
        return _NAME.search(last).group() in _BEFORE_VALUE
    return last[-1] in marks


def bare_script(text: str, elements: bool = True) -> str:
    """`elements`: whether `<` may open JSX."""
    out: list[str] = []
    last = ""  # the last code that is not blank
    # Frames: ["code", open braces], ["template"], ["tag", depth, closing?] and ["text", depth].
    stack: list[list] = [["code", 0]]
    at, size = 0, len(text)

    def gone(piece: str):
        if ends := _NOT_ENDS.sub("", piece):
            out.append(ends)

    while at < size:
        frame = stack[-1]
        if frame[0] == "template":
            found = _TEMPLATE.match(text, at)
            gone(found.group())
            at = found.end()
            if text.startswith("${", at):
                stack.append(["code", 0])
                at, last = at + 2, ""
            else:
                stack.pop()  # a backtick, or the end
                at, last = at + 1, ")"
            continue
        if frame[0] == "text":
            if found := _TEXT.match(text, at):
                gone(found.group())
                at = found.end()
            elif text[at] == "{":
                stack.append(["code", 0])
                at, last = at + 1, ""
            elif text.startswith("</", at):
                stack.append(["tag", frame[1], True])
                at += 2
            else:
                stack.append(["tag", frame[1] + 1, False])
                at += 1
            continue
        if frame[0] == "tag":
            if found := _TAG_PART.match(text, at) or _ATTRIBUTE.match(text, at):
                gone(found.group())
                at = found.end()
            elif text[at] == "{":
                stack.append(["code", 0])
                at, last = at + 1, ""
            elif found := _COMMENT.match(text, at):
                gone(found.group())
                at = found.end()
            elif text[at] == "/":
                if text.startswith("/>", at):
                    _leave(stack, frame[1] - 1)
                    at, last = at + 2, ")"
                else:
                    at += 1
            else:  # >
                stack.pop()
                if frame[2]:
                    _leave(stack, frame[1] - 1, popped=True)
                elif stack[-1][0] == "text":
                    stack[-1][1] = frame[1]
                else:
                    stack.append(["text", frame[1]])
                at, last = at + 1, ")"
            continue
        if found := _RUN.match(text, at):
            piece = found.group()
            out.append(piece)
            last = piece.rstrip()[-16:] or last
            at = found.end()
            continue
        c = text[at]
        if c in "'\"":
            found = _STRING.match(text, at)
            gone(found.group())
            at, last = found.end(), ")"
        elif c == "`":
            stack.append(["template"])
            at += 1
        elif c == "{":
            frame[1] += 1
            out.append(c)
            at, last = at + 1, c
        elif c == "}":
            if frame[1] == 0 and len(stack) > 1:
                stack.pop()
                last = ")"
            else:
                frame[1] = max(0, frame[1] - 1)
                out.append(c)
                last = c
            at += 1
        elif c == "/":
            if found := _COMMENT.match(text, at):
                gone(found.group())
                at = found.end()
            elif _may_begin(last, "(,=:[!&|?{};+-*%<>~^") and (found := _REGEX.match(text, at)):
                gone(found.group())
                at, last = found.end(), ")"
            else:
                out.append(c)
                at, last = at + 1, c
        elif elements and _may_begin(last, "(,=:[!&|?{;>") and _ELEMENT.match(text, at) and not _GENERIC.match(text, at):
            stack.append(["tag", 1, False])
            at += 1
        else:
            out.append(c)
            at, last = at + 1, c
    return "".join(out)


def _leave(stack: list[list], depth: int, popped: bool = False) -> None:
    """Ends an element; with the outermost one, the code around it goes on."""
    if not popped:
        stack.pop()
    if depth <= 0:
        if stack[-1][0] == "text":
            stack.pop()
    elif stack[-1][0] == "text":
        stack[-1][1] = depth


def bare_go(text: str) -> str:
    return _GO.sub(lambda found: _NOT_ENDS.sub("", found.group()), text)


def bare_text(text: str, grammar: str) -> str:
    """What is left of a file of a language with braces."""
    return bare_go(text) if grammar == "go" else bare_script(text, grammar != "typescript")


@F.pandas_udf(StringType())
def _bare(text: pd.Series, grammar: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else bare_text(t, g) for t, g in zip(text, grammar)], dtype=object)


def without_brace_noise(text: Column, grammar: Column) -> Column:
    """The column form, for JavaScript, TypeScript and Go; null stays null."""
    return _bare(text, grammar)
