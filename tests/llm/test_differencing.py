"""Differencing of pages with and without article markup, held against a plain loop over the whole query."""

from __future__ import annotations

import random

import numpy as np
import pytest

from findlake.llm import html_text


def table_marks(a, b):
    """Length of the longest common subsequence, by the textbook table."""
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


SCHEMA = "page_id long, url string, html string"


def texts(spark, pages):
    return {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, SCHEMA)).collect()}


def test_pages_with_a_named_article_are_differenced(spark):
    page = "<div>Site</div><article><h1>Story {0}</h1><p>The same words.</p><p>Own words {0}.</p><p>More of {0}</p><p class='notice'>We use your data.</p><p class='notice'>Note on {0}</p></article>"
    found = texts(spark, [(i, f"http://h/{i:02}", page.format(i)) for i in range(12)])
    assert found == {i: f"Story {i} The same words. Own words {i}. More of {i} Note on {i}" for i in range(12)}


def test_copies_lose_nothing_to_each_other(spark):
    named = "<article><p>One article</p><p class='related'>A related finding.</p></article>"
    plain = "<div>Frame</div><p>Plain story</p><div>End</div>"
    other = "<div>Frame</div><p>Another one</p><div>End</div>"
    near = "<article><p>{}</p><p>a</p><p>b</p><p class='notice'>c</p></article>"
    pages = [(i, f"http://n/{i}", named) for i in range(4)] + [(10 + i, f"http://p/{i}", plain) for i in range(100)] + [(200, "http://p/9", other), (201, "http://alone/1", plain), (202, "http://alone/2", plain)]
    pages += [(300 + i, f"http://near/{i}", near.format(i)) for i in range(3)] + [(400, None, None), (401, None, ""), (402, "http://p/3", None)]
    found = texts(spark, pages)
    assert {found[i] for i in range(4)} == {"One article A related finding."}
    assert {found[10 + i] for i in range(100)} == {"Plain story"} and found[200] == "Another one"  # 100 copies are over MANY_COPIES
    assert found[201] == found[202] == "Frame Plain story End"
    assert [found[300 + i] for i in range(3)] == [f"{i} a b c" for i in range(3)]
    assert found[400] == found[401] == found[402] == "" and len(found) == len(pages)


@pytest.mark.parametrize("partitions", [1, 5])
def test_whole_query_against_a_plain_loop(spark, partitions):
    rnd = random.Random(3)
    pages = []
    for i in range(150):
        block = lambda: f"<p{rnd.choice(['', '', ' class=notice'])}>{rnd.choice('abcdefgh')}{rnd.choice(['', '', i])}</p>"
        body = "".join(block() for _ in range(rnd.randrange(6)))
        pages.append((i, f"https://h{rnd.randrange(2)}.org/{rnd.randrange(90):02}", "" if rnd.random() < 0.1 else f"<p>top</p><article>{body}</article><div>end</div>" if rnd.random() < 0.6 else f"<div>top</div>{body}<div>end</div>"))
    seen = {}
    for id_, url, page in sorted(pages, key=lambda p: (*html_text.url_path(p[1]), p[0])):
        if html_text.lines(page):
            seen.setdefault((html_text.url_path(url)[0], tuple(html_text.lines(page))), []).append(id_)
    kinds, expected = list(seen), {id_: "" for id_, _, page in pages if not html_text.lines(page)}
    for k, (host, own) in enumerate(kinds):
        near = [kinds[j][1] for j in (k - 1, k + 1) if 0 <= j < len(kinds) and kinds[j][0] == host]
        names = {t: n for n, t in enumerate(sorted({t for part in (own, *near) for t, _ in part}))}
        keys = lambda part: np.array([names[t] for t, _ in part], np.int64)
        marks = [html_text.shared(keys(own), keys(n)) for n in near]
        assert [m.sum() for m in marks] == [table_marks([t for t, _ in own], [t for t, _ in n]) for n in near]
        article = [p == html_text.INSIDE for _, p in own]
        kept = []
        for at, (text, place) in enumerate(own):
            if place == html_text.PLAIN:
                stays = not any(p != html_text.PLAIN for _, p in own) and not any(m[at] for m in marks)
            elif place == html_text.INSIDE:
                stays = True
            else:
                stays = not any(m[at] and 2 * sum(x and y for x, y in zip(article, m, strict=True)) < sum(article) for m in marks)
            kept += [text] * stays
        expected |= dict.fromkeys(seen[host, own], " ".join(kept))
    frame = spark.createDataFrame(pages, SCHEMA).repartition(partitions)
    assert {r.page_id: r.text for r in html_text.main_text(frame).collect()} == expected and len(expected) == len(pages)


def test_alignment_of_many_lines_keeps_few_rows():
    """10,000 lines a page: the rows of the whole table take 12.5 MB."""
    import tracemalloc

    rnd = random.Random(1)
    a = [rnd.randrange(10**9) for _ in range(10_000)]
    b = [x if rnd.random() < 0.9 else -x for x in a]
    tracemalloc.start()
    marks = html_text.shared(np.array(a, np.int64), np.array(b, np.int64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert marks.tolist() == [x == y for x, y in zip(a, b, strict=True)] and most < 6e6
