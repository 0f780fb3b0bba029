"""Wrappers accept every page they come from, in whatever order and parts they were merged, and decide where the article is."""

import random
import re
from collections import defaultdict

import pytest

from citeflow.llm import html_extract as h


def random_page(rng, depth=0):
    """Any nesting of a few tags, so that repeats, options and changes of order all occur."""
    out = []
    for _ in range(rng.randrange(5)):
        tag = rng.choice(["div", "p", "ul", "b", "h2", "#"])
        out.append(f"text {rng.randrange(9)} " if tag == "#" else f"<{tag}>{random_page(rng, depth + 1) if depth < 3 else 'x'}</{tag}>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(20))
def test_wrapper_accepts_its_pages(seed):
    rng = random.Random(seed)
    pages = [random_page(rng) for _ in range(30)]
    whole = h.induce(pages)
    cuts = sorted(rng.sample(range(30), 3))
    merged = h.Wrapper()
    for a, b in zip([0, *cuts], [*cuts, 30], strict=True):
        merged.merge(h.Wrapper.loads(h.induce(pages[a:b]).dumps()))
    for w in (whole, merged):
        pattern = re.compile(w.expression())
        assert all(pattern.fullmatch(h.tokens(h.Page(x))) for x in pages)
        assert all(len(w.at[v]) == len({w.label[k] for k in w.kids[v]}) for v in range(len(w.label)))
    assert (whole.total, sum(whole.chars), sum(whole.linked)) == (merged.total, sum(merged.chars), sum(merged.linked))


def test_resolutions():
    pages = [f"<ul>{'<li><a>x</a></li>' * n}</ul><div>Same note</div>{'<i>opt</i>' * (n % 2)}<p>{f'text {n} ' * 5}</p>" for n in range(1, 6)]
    w = h.induce(pages)
    assert w.expression() == "(?:<page>(?:<ul>(?:<li>(?:<a>(?:#)</>)</>)+</>)(?:<div>(?:#)</>)(?:<i>(?:#)</>)?(?:<p>(?:#)</>)</>)"
    assert [w.constant[k] for k in range(len(w.label)) if w.label[k] == "#"][1:3] == ["Same note", "opt"]
    assert h.main_text(pages[4], w).endswith("text 5 text 5") and "Same note" not in h.main_text(pages[4], w)
    loop = h.induce(["<h2>a</h2><p>b</p><h2>c</h2><ul>d</ul><p>e</p>"])
    assert "(?:(?:<h2>(?:#)</>)?(?:<p>(?:#)</>)?)*" not in loop.expression() and re.fullmatch(loop.expression(), "<page><p>#</><h2>#</><p>#</></>")


def plain_decision(pages):
    """The path of boxes that hold most of the unlinked text, by counting paths over all pages (no class words)."""
    mass, kids = defaultdict(int), defaultdict(set)
    for page in pages:
        path, link, seen = [], 0, []
        for token in re.findall(r"<[^>]*>|[^<]+", page):
            if token[0] != "<":
                for k in range(len(path) + 1):
                    mass[tuple(path[:k])] += len(token.strip()) * (not link)
            elif token[1] == "/":
                link -= path.pop() == "a"
                seen.pop()
            else:
                name, counts = token[1:-1], seen[-1] if seen else {}
                counts[name] = counts.get(name, 0) + 1
                label = f"{name}:{min(8, counts[name])}" if name == "div" and counts[name] > 1 else name
                kids[tuple(path)].add(label)
                path.append(label)
                seen.append({})
                link += name == "a"
    way = [()]
    while boxes := [way[-1] + (k,) for k in kids[way[-1]] if k.split(":")[0] in h.CONTAINERS]:
        best = max(boxes, key=lambda b: mass[b])
        if not mass[best] or 2 * mass[best] < mass[way[-1]]:
            break
        way.append(best)
    return [v for v in way if mass[v] >= 0.8 * mass[()]][-1]


def test_counts_decide_without_names():
    """No class, id or meaningful tag: only the host's counts tell the article from the rest."""
    rng = random.Random(2)
    pages, truth = [], []
    for i in range(40):
        article = [f"Sentence {rng.random()} with some words of page {i}." for _ in range(rng.randrange(1, 6))]
        menu = "".join(f"<a>{rng.random()}</a>" for _ in range(rng.randrange(40, 60)))
        pages.append(f"<html><body><div>{menu}</div><div><div>{'<p>' + '</p><p>'.join(article) + '</p>'}</div></div><div>All rights {i}</div></body></html>")
        truth.append("\n".join(article))
    w = h.induce(pages)
    path, v = [], h.Reader(w).status.index(1)
    while v:
        path.insert(0, w.label[v])
        v = w.parent[v]
    assert tuple(path) == plain_decision(pages) == ("html", "body", "div:2", "div")
    assert [h.main_text(p, w) for p in pages] == truth
    short = next(i for i, t in enumerate(truth) if len(t) < len(re.sub("<[^>]*>", "", pages[i])) / 4)
    assert h.main_text(pages[short], w) == truth[short]


def test_broken_and_long_pages():
    assert h.main_text("<div>" * 1500 + "deep" + "</div>" * 1500) == "deep"
    assert h.main_text("<div>" * 5000 + "<p>deep <b>x</b></p><p>two</p>") == "deep x\ntwo"
    assert h.main_text("İ" * 12 + "<p>First</p><SCRIPT>x</Script><p>Second paragraph here</p>") == "İ" * 12 + "\nFirst\nSecond paragraph here"
    assert h.main_text("</div>" * 20_000 + "<p>" * 20_000 + "end") == "end"
    long = "<article>" + "<p>a word</p><div>b</div>" * 40_000 + "</article>"
    assert h.main_text(long).count("\n") == 79_999
    for name in ("story-header-content", "widget-guide", "has-menu"):
        assert h.main_text(f"<body><article class='{name}'><h1>T</h1><div class='{name}'><p>kept</p></div></article></body>") == "T\nkept"


def test_hot_host_and_merging_levels(spark):
    story = lambda i: " ".join(f"w{i * 7 + k}" for k in range(30))
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i}'}.example/{i}", f"<body><nav>menu</nav><div class='c{i}'>ad {i}</div><main><p>{story(i)}</p></main></body>") for i in range(400)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(70)
    got = h.extract_main_text(d).collect()
    assert {r.page_id: (r.text, r.by_wrapper) for r in got} == {i: (story(i), True) for i, _, _ in rows}
    w = h.induce([r[2] for r in rows])
    assert len(w.label) < 2 * h.VARIANTS + 20
    twice = d.where("page_id = 1").union(d.where("page_id = 1")).union(spark.createDataFrame([(None, None, None), (None, None, "<p>x")], d.schema))
    assert sorted((r.page_id or -1, r.text) for r in h.extract_main_text(twice).collect()) == [(-1, ""), (-1, "x"), (1, story(1)), (1, story(1))]
