"""Main text, prefix trie and resampling against plain Python and on awkward rows."""

from __future__ import annotations

import hashlib
import html as references
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bytescan, html_extraction, importance, prefix_trie, queries


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda row: [(v is None, v) for v in row])


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, v) for v in row])


# Main text

@pytest.fixture(scope="module")
def pages(spark, folder):
    return queries.table(spark, folder, "pages")


@pytest.fixture(scope="module")
def field(pages):
    return html_extraction.fit(pages)


def article(page: str) -> str:
    """The paragraphs between the article tags of the given tables' one layout."""
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = (" ".join(references.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split("</?(?:p|h1)>", body))
    return "\n\n".join(x for x in parts if x)


def test_main_text_of_the_pages(spark, folder, pages):
    got = queries.op11_block_field(spark, folder).collect()
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(want)


def test_field_on_layouts_it_has_not_seen(pages, field):
    made = html_extraction.training_pages([r["html"] for r in pages.collect()], seed=99, layouts=300)
    wrong = total = 0
    for page, marks in made:
        got = html_extraction.labels(page, field)
        wrong += sum(a != b for a, b in zip(got, marks))
        total += len(marks)
    assert len(made) > 150 and wrong < 0.03 * total


LONG = "The council met on Tuesday to discuss the new bridge, which engineers say will take three years to build. Residents spoke for two hours, and most were in favour."


def test_parts_around_and_inside_an_article(field):
    page = f"""<html><head><title>x</title></head><body><header><a href="/">Site</a></header><nav><ul><li><a>Home</a><li><a>News</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies to make this site work as you would expect it to.</p></div>
    <article><h1>Bridge&nbsp;vote</h1><p>{LONG}<p>{LONG.replace('Tuesday', '<i>Wednes</i>day<!-- x -->')}
    <div class="advert"><p>Buy two lamps and get the third one free this week.</p></div><p>5 &lt; 6 &amp;amp; {LONG}</p>
    <form><label>Your mail</label><button>Subscribe</button></form><script>var x = "<p>no</p>";</script>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I have never read such a well written piece about a bridge.</p></div></section></article>
    <aside class="sidebar"><h3>More</h3><a>Other story</a></aside><footer>&copy; 2024 Site</footer></body></html>"""
    assert html_extraction.main_text(page, field).split("\n\n") == ["Bridge vote", LONG, LONG.replace("Tuesday", "Wednesday"), "5 < 6 &amp; " + LONG]


def test_blocks_follow_omitted_and_misplaced_tags():
    text = lambda page: [(b.text, b.element.tag) for b in html_extraction.blocks(page)]
    assert text("<p>a<p>b<br>c<div>d</p>e</div>f") == [("a", "p"), ("b c", "p"), ("d", "div"), ("e", "div"), ("f", "#page")]
    assert text("<head><title>t</title><meta x><div>a</div>") == [("a", "div")] and text("<head>a<p>b") == [("a", "#page"), ("b", "p")]
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [(x, "li") for x in "abcd"]
    assert text('<td title="a > b">x<td>y</table>z') == [("x", "td"), ("y", "td"), ("z", "td")]
    assert text("<script>if (a < b) x()</script >y<!-- <p>no</p> -->z<style>never closed <p>w") == [("yz", "#page")]
    assert text("a < b <3 <a href='x'>c</a>&eacute;&#8212;&bogus;   <") == [("a < b <3 cé—&bogus; <", "#page")]
    assert text('<p title="never closed>x</p>y') == [("x", "p"), ("y", "#page")]
    assert html_extraction.blocks(None) == html_extraction.blocks("") == html_extraction.blocks("<p> \n</p>") == []


@given(st.text(alphabet="<>/pdivaul!-\"'= &;x\n", max_size=80))
@settings(max_examples=200, deadline=None)
def test_any_text_is_a_page(page):
    html_extraction.blocks(page)


def test_long_and_deep_pages(field):
    deep = "<div class=c>" * 20_000 + "x" + "</div>" * 20_000
    assert [b.text for b in html_extraction.blocks(deep)] == ["x"]
    long = "<article>" + f"<p>{LONG}</p>" * 5_000 + "</article>"
    assert html_extraction.main_text(long, field).count("bridge") == 5_000
    assert len(html_extraction.blocks('<a "' * 3_000)) <= 1


def test_awkward_pages(spark, field):
    data = [(1, None, None, "k"), (None, "u", f"<article><p>{LONG}</p></article>", "k"), (2, "u", "", "k"), (2, "u", "", "k")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, text string").withColumn("n_chars", F.lit("clash"))
    assert collected(html_extraction.extract(df, field), "page_id", "url", "text", "n_chars") == ordered([(1, None, "", 0), (None, "u", LONG, len(LONG)), (2, "u", "", 0), (2, "u", "", 0)])
    assert html_extraction.extract(df.limit(0), field).count() == 0
    assert html_extraction.fit(df.limit(0)).weights  # stand-in words


# Prefix trie

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    own = {c: [a[3:] for a in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + mine[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(brute.WORD.findall(p[-1][1])) if p else 0)
        if p:
            children[p[:-1]].append(p)
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(made[c]) == len(p)).encode()).hexdigest()
    return ordered((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(p)) for p, m in members.items())


def built(df, **how):
    return collected(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(df)), **how), *NODE)


TURNS = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize("segment", [2, 5, 1 << 16])
@pytest.mark.parametrize("seed", range(3))
def test_trie_of_awkward_turns(spark, seed, segment):
    pick = random.Random(seed)
    rows = [(c, pick.choice([t, t, None, 0]), pick.choice(["u", "a", None]), pick.choice(["x", "y z", None, " \t"])) for c in pick.sample(range(150), 90) for t in range(pick.randint(1, 6))]
    rows += [(None, 1, "u", "left out")] * 3 + rows[:5]
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("clash")).withColumn("keys", F.lit(1))
    assert built(df, segment=segment) == trie(rows)


@pytest.mark.parametrize("most", [7, 1 << 20])
def test_trie_of_equal_conversations_over_many_tasks(spark, most):
    rows = [(c, t, "u", f"hello {t}") for c in range(300) for t in range(4 + c // 250)]
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    assert built(df, most=most) == trie(rows)


def test_trie_of_turnless_and_no_conversations(spark):
    # With h = 3 and a first conversation of no more than one turn, a short conversation loses all its own.
    short = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:6]
    rows = [(c, 0, "u", "gone") for c in short]
    assert built(spark.createDataFrame(rows, TURNS)) == trie(rows) == [(short[0], 0, None, 6, 0, 1, 0, hashlib.sha256(",".join(map(str, short)).encode()).hexdigest())]
    assert built(spark.createDataFrame([], TURNS)) == []


def test_trie_of_the_table(spark, folder):
    rows = [tuple(r) for r in queries.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.op12_prefix_trie(spark, folder), *NODE) == trie(rows)


def test_one_very_long_conversation(spark):
    rows = [(20, t, "u", f"turn {t % 50}") for t in range(20_000)] + [(21, t, "u", f"turn {t % 50}") for t in range(15_000)]
    df = spark.createDataFrame(rows, TURNS)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(df))).agg(F.count("*"), F.max("depth"), F.sum("n_convs")).first()
    assert tuple(got) == (20_001, 20_000, 20_001 + 15_001)


@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(0, 6))
@settings(max_examples=80, deadline=None)
def test_sparse_table_finds_extents(values, depth):
    values = np.array([-1, *values[1:]])
    table = prefix_trie.SparseTable(values)
    for p in range(len(values)):
        r = p
        while r + 1 < len(values) and values[r + 1] >= depth:
            r += 1
        left = p
        while left > 0 and values[left] >= depth:
            left -= 1
        assert table.right(np.array([p]), np.array([depth]))[0] == r
        assert table.left(np.array([p]), np.array([depth]))[0] == left


# Importance resampling

PART = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = PART.findall((text or "").translate(brute.LOWER))
    return w, [zlib.crc32(x.encode()) for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 éñ.\n\x00Z~", max_size=40)), max_size=8))
@settings(max_examples=80, deadline=None)
def test_crcs_of_all_runs(texts):
    for row, end, data, offsets in bytescan.slices(pa.array(texts, type=pa.string()), 20):
        got = [[] for _ in range(end - row)]
        for values, owner in importance.crcs(data, offsets):
            for v, k in zip(values.tolist(), owner.tolist()):
                got[k].append(v)
        assert got == [grams(t)[1] for t in texts[row:end]]


def test_crcs_across_lanes_and_long_words():
    text = " ".join(["x" * 5000, "y" * 255, "z", *(f"w{k}" for k in range(2000))])
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    parts = [values.tolist() for values, _ in importance.crcs(data, np.array([0, len(data)]), 3)]
    w = text.split()
    assert parts == [[zlib.crc32(" ".join(w[k : k + n]).encode()) for k in range(len(w) - n + 1)] for n in (1, 2, 3)]


def drawn(docs, target, least=20, percent=25, buckets=10_000):
    s, t = (Counter(c % buckets for x in texts for c in grams(x)[1]) for texts in ([x for _, x in docs], target))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    rows = []
    for d, x in docs:
        w, f = grams(x)
        weight = sum(gain(c % buckets) for c in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    open_ = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    take = percent * len(open_) // 100
    place = [(*r[:4], k + 1 if k < take else None) for k, r in enumerate(open_)]
    return ordered(place + [(*r[:4], None) for r in rows if r[4] < least])


DRAWN = ["doc_id", "n_features", "weight", "score", "rank"]


def test_draw_of_awkward_documents(spark):
    pick = random.Random(2)
    say = lambda k: " ".join(pick.choice(["alpha", "Beta", "gämma", "d4", "e"]) for _ in range(k))
    docs = [(k, say(pick.randint(0, 60))) for k in range(60)] + [(None, say(30)), (7, None), (8, ""), (9, "..."), (61, say(9000)), (62, "same " * 25), (62, "same " * 25)]
    target = [say(10), None, "", "gämma e"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"weight": F.lit("clash"), "bucket": F.lit(1), "part": F.lit(2)}).repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string").withColumn("n", F.lit(1))
    assert collected(importance.resample(df, aim), *DRAWN) == drawn(docs, target)
    kept = importance.draw(df, aim)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in drawn(docs, target) if r[4]}
    assert importance.resample(df.limit(0), aim).count() == 0
    assert collected(importance.resample(df, aim.limit(0)), *DRAWN) == drawn(docs, [])


def test_draw_of_the_table(spark, folder):
    docs = [tuple(r) for r in queries.table(spark, folder, "documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in queries.table(spark, folder, "benchmark").collect()]
    assert collected(queries.op13_importance(spark, folder), *DRAWN) == drawn(docs, target)
