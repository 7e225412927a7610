"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingles(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    w = words(text)
    width = min(width, len(w))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if width else set()


def near_groups(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component)."""
    sets = [(d, shingles(t)) for d, t in docs]
    boss = {d: d for d, _ in docs}

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                boss[q] = p
    return {d: (len(x), find(d)) for d, x in sets}


def contained(docs, items, percent: int = 75):
    """(doc, item, found, size)."""
    out = set()
    for item, text in items:
        want = shingles(text)
        for doc, body in docs:
            if want:
                w = words(body)
                width = len(next(iter(want)))
                n = len(want & {tuple(w[k : k + width]) for k in range(len(w) - width + 1)})
                if 100 * n >= percent * len(want):
                    out.add((doc, item, n, len(want)))
    return out


def kneser_ney(train: list[str | None], docs: list[str | None]):
    """(tokens, known, base, score) per document; modified Kneser-Ney over word pairs, a uniform floor below."""
    text = lambda t: [*words(t), None]
    one, two = Counter(), Counter()
    for t in train:
        tokens = text(t)
        one.update(tokens)
        two.update(zip(["<begin>", *tokens], tokens))
    n, v = sum(one.values()), len(one)
    follows = Counter(w for _, w in two)
    total, kinds = Counter(), defaultdict(Counter)
    for (c, _), k in two.items():
        total[c] += k
        kinds[c][min(k, 3)] += 1

    def discounts(counts):
        of = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
        if not all(of):
            return [0, 0.5, 0.75, 0.9]
        y = of[0] / (of[0] + 2 * of[1])
        return [0, *(min(max(d, 0.01), k + 0.99) for k, d in enumerate((1 - 2 * y * of[1] / of[0], 2 - 3 * y * of[2] / of[1], 3 - 4 * y * of[3] / of[2])))]

    high, low = discounts(two.values()), discounts(follows.values())
    left = sum(low[min(c, 3)] for c in follows.values()) / len(two) if two else 1.0

    def unigram(w):
        own = max(follows[w] - low[min(follows[w], 3)], 0) / len(two) if two else 0
        return own + left / (v + 1)

    def pair(c, w):
        if not total[c]:
            return unigram(w)
        k = two[c, w]
        back = sum(high[j] * m for j, m in kinds[c].items()) / total[c]
        return max(k - high[min(k, 3)], 0) / total[c] + back * unigram(w)

    out = []
    for t in docs:
        tokens = text(t)
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        score = sum(math.log10(pair(c, w)) for c, w in zip(["<begin>", *tokens], tokens))
        out.append((len(tokens), sum(w in one for w in tokens), base, score))
    return out


KINDS = {
    "assign": (re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]+"), 0, 32),
}


def base_secrets(text: str | None):
    """Counts per kind and spans as text."""
    spans = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, (p, g, n)) in enumerate(KINDS.items()) for m in p.finditer(text or "") if len(m[g]) >= n]
    spans.sort()
    joined = ",".join(s for _, _, s in spans)
    return [sum(k == j for _, k, _ in spans) for j in range(3)], joined, hashlib.sha256(joined.encode()).hexdigest()


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def kept_lines(docs: list[tuple[int, str | None]], edits: int = 2, least: int = 20) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (lines, equal ones gone, near ones gone, remaining text); ids are distinct."""
    seen: dict[bytes, None] = {}
    out = {}
    for doc, text in sorted(docs):
        parts = [] if text is None else text.split("\n")
        kept, equal, near = [], 0, 0
        for line in parts:
            x = line.encode()
            if not WORD.search(line):
                kept.append(line)
            elif x in seen:
                equal += 1
            elif len(x) >= least and any(len(y) >= least and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits for y in seen):
                near += 1
                seen[x] = None
            else:
                seen[x] = None
                kept.append(line)
        out[doc] = (len(parts), equal, near, "\n".join(kept))
    return out


def repeated_bytes(texts: list[str | None], length: int = 400):
    """(bytes, removed, spans, rest) per text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[k : k + length] for x in raw for k in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), dtype=bool)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = True
        left = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(1 for k in range(len(x)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def passages(texts: list[str | None], length: int = 50) -> list[int]:
    """Runs of words, per text, that lie in `length` words which also start elsewhere."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[k : k + length]) for w in split for k in range(len(w) - length + 1))
    out = []
    for w in split:
        held = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                held[k : k + length] = [True] * length
        out.append(sum(held[k] and not (k and held[k - 1]) for k in range(len(w))))
    return out


def nearest(rows, k: int, every: int):
    """query -> [(vec_id, score)] by inner product."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            scores = sorted(((-float(np.dot(x, y)), i) for i, y in good if i != q and len(x) == len(y)))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def encoded(text: str | None, path: str, end: int) -> list[int]:
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
