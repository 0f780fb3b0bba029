"""What a host's pages say together: articles that are alike, and tables on which only the host can tell."""

import random
import time

import pytest

from citeflow.llm import html_extract
from citeflow.llm.html_extract import induce, main_text

WORDS = [f"{a}{b}" for a in ("mor", "tel", "san", "vik", "ro", "len") for b in ("a", "en", "is", "or", "un", "et")]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def test_equal_articles_stay():
    article = "<article><h1>Same</h1><p>The very same article stands here on each page.</p><p>Opening hours are nine to five.</p></article>"
    pages = [f"<html><body><div><ul><li>other words {i} beside the article</li></ul></div>{article}</body></html>" for i in range(5)]
    host = induce(pages)
    want = "Same\nThe very same article stands here on each page.\nOpening hours are nine to five."
    assert [main_text(p, host) for p in pages] == [want] * 5


def test_a_constant_paragraph_of_an_article_stays():
    rng = random.Random(1)
    bodies = [prose(rng, 30) for _ in range(6)]
    pages = [f'<html><body><article><p class="lead">{b}</p><p class="hours">Opening hours are nine to five.</p></article></body></html>' for b in bodies]
    host = induce(pages)
    assert [main_text(p, host) for p in pages] == [f"{b}\nOpening hours are nine to five." for b in bodies]


def test_long_common_beginnings_stay():
    start = "shared words " * 40
    pages = [f"<html><body><article><h1>Edition</h1><p>{start} and then {i}</p></article></body></html>" for i in range(4)]
    host = induce(pages)
    assert [main_text(p, host) for p in pages] == [f"Edition\n{start.strip()} and then {i}" for i in range(4)]


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<textarea>", "<!--", "<x <y ", "<a b='>", "<a \"'>", "</p", "<![x", "<p><b>"])
def test_odd_markup_takes_linear_time(part):
    start = time.time()
    assert main_text(part * 30_000).count("<") == 0
    assert time.time() - start < 3


def hosts(seed=7):
    """(page_id, url, html, article): on two hosts of three nothing but what varies tells the article."""
    rng, out = random.Random(seed), []
    for h in range(6):
        intro, imprint = prose(rng, 120), prose(rng, 40)
        for k in range(8):
            blocks = [prose(rng, rng.randrange(12, 25)) for _ in range(2)]
            body = "".join(f"<p>{b}</p>" for b in blocks)
            if h % 3 == 0:
                html = f"<body><header>{intro}</header><article>{body}</article><footer>{imprint}</footer></body>"
            elif h % 3 == 1:
                html = f"<body><div>{intro}</div><div>{body}</div><div>{imprint}</div></body>"
            else:
                html = f"<body><table><tr><td>{intro}</td><td><section>{body}</section></td></tr></table><div><div>{imprint}</div></div></body>"
            out.append((len(out), f"https://h{h}.example/{k}", f"<html>{html}</html>", "\n".join(blocks)))
    return out


def test_the_host_decides(spark, monkeypatch):
    given = hosts()
    pages = spark.createDataFrame([r[:3] for r in given], "page_id long, url string, html string").repartition(5)
    want = {r[0]: r[3] for r in given}
    assert {r.page_id: r.text for r in html_extract.extract_main_text(pages).collect()} == want
    alone = {i: main_text(html) for i, _, html, _ in given}
    assert sum(alone[i] != want[i] for i in want) >= len(want) / 3
    # Beyond the size up to which all wrappers go to all tasks, they come before their pages.
    monkeypatch.setattr(html_extract, "SHIPPED", 0)
    odd = [(100, None, "<p>no host</p>"), (101, None, None), (101, None, None), (102, "https://h1.example/", "")]
    more = pages.union(spark.createDataFrame(odd, pages.schema))
    for hot in (4096, 1):
        found = [(r.page_id, r.url, r.text) for r in html_extract.extract_main_text(more, hot=hot).collect()]
        assert len(found) == len(given) + 4 and {i: t for i, _, t in found} == want | {100: "no host", 101: "", 102: ""}
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0
