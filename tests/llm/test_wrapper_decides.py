"""The inferred wrapper decides what main text is."""

import random
import re

import pytest

from colferry.llm import wrapper as W
from colferry.llm.url_rules import host_path


def host_wrapper(pages):
    both = None
    for p in pages:
        own = W.wrapper(W.parse(p))
        both = own if both is None else W.merge(both, own)
    return W.loads(W.dumps(both))


def test_template_inside_the_article():
    """What a page alone can't tell: a line of the article that all pages of the host have."""
    pages = [f"<body><div class='q{c}'><p>A site</p></div><article><h1>T{c}</h1><div class=zz>Read our letters</div><p>own {c} text of some length</p><p>b{c}</p></article></body>" for c in "abcdef"]
    known = host_wrapper(pages)
    for c, p in zip("abcdef", pages):
        assert W.extract(p, known, len(pages)) == f"T{c}\nown {c} text of some length\nb{c}"
        assert W.extract(p, None) == f"T{c}\nRead our letters\nown {c} text of some length\nb{c}"


def test_region_by_variable_text():
    """No element says where the text is; the wrapper finds it, with the heading before it, and without menus."""
    rnd = random.Random(1)
    words = lambda n: " ".join(rnd.choice("alpha beta gamma delta".split()) + str(rnd.randrange(99)) for _ in range(n))
    pages, wanted = [], []
    for _ in range(8):
        title, body, links = words(4), [words(rnd.randrange(20, 60)) for _ in range(rnd.randrange(2, 6))], [words(2) for _ in range(5)]
        rest = "".join(f"<a href=/x>{x}</a><br>" for x in links)
        pages.append(f"<body><div class=k1><p>The daily thing</p></div><h1>{title}</h1><div class=k2>{rest}</div><div class=k3>{''.join(f'<p>{b}</p>' for b in body)}<ul><li>{words(3)}</ul></div><div class=k4>{words(5)}</div></body>")
        wanted.append([title, *body])
    known = host_wrapper(pages)
    for p, want in zip(pages, wanted):
        got = W.extract(p, known, len(pages)).split("\n")
        assert got[:-1] == want and len(got) == len(want) + 1


def test_names_are_whole():
    """Parts of names and of ids say nothing, and content is not dropped for a common word."""
    assert W.extract('<article><section id="side-effects"><p>a b</p></section><section class="search results"><p>x</p></section></article>', None) == "a b\nx"
    assert W.extract('<article><p>q</p><div class="related-work">r</div></article>', None) == "q\nr"
    assert W.extract('<article><p>q</p><div class="ad-box">r</div><div id="comments">c</div><div role="search">s</div><form>f</form></article>', None) == "q"
    long = "A" * 150_000
    assert W.extract(f'<article><p>one</p><img src="data:{long}"><p>two</p></article>', None) == "one\ntwo"
    assert W.extract(f"<div class=outer><article>{'<div>' * 200}deep{'</div>' * 200}<p>after</p></article></div>", None) == "deep\nafter"
    assert W.extract(f"<article><p>body</p>{'<div>' * 160}<nav>menu</nav>{'</div>' * 160}</article>", None) == "body"


def test_forms_around_pages_and_empty_articles():
    assert W.extract("<form><nav><a>m</a></nav><div class=c><h1>T</h1><p>body</p></div></form>", None) == "T\nbody"
    assert W.extract("<nav>m</nav><article></article><footer>f</footer>", None) == ""
    known = host_wrapper([f"<div class=ad>buy {i}</div><article><p>text {i} that is here</p></article>" for i in range(4)])
    assert W.extract("<div class=ad>buy</div><article></article>", known, 4) == ""
    assert W.extract("<div class=other><p>another kind of page</p></div>", known, 4) == "another kind of page"


def test_copies_are_no_template():
    """A host whose pages are all the same, or nearly, keeps its text."""
    pages = ["<article><h1>T</h1><p>the same text</p></article>"] * 5
    assert W.extract(pages[0], host_wrapper(pages), 5) == "T\nthe same text"
    pages = [f"<article><h1>T</h1><div>a long common text of copies</div><p>x{i}</p></article>" for i in range(5)]
    assert W.extract(pages[0], host_wrapper(pages), 5) == "T\na long common text of copies\nx0"


def planted(page: str) -> str:
    """Brute force: the texts between the article's block tags."""
    inner = re.search("<article>(.*)</article>", page, re.S).group(1)
    import html

    blocks = (re.sub("<br>", " ", b) for b in re.split("</?(?:p|h1)>", inner))
    return "\n".join(t for t in (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in blocks) if t)


@pytest.mark.parametrize("nodes", [W.ALIGNED_NODES, 300])
def test_given_pages(spark, monkeypatch, nodes):
    monkeypatch.setattr(W, "ALIGNED_NODES", nodes)
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = df.collect()
    assert {r["page_id"]: r["text"] for r in W.extract_main(df).collect()} == {r["page_id"]: planted(r["html"]) for r in pages}
    hosts = {r["host"]: r["pages"] for r in W.infer(df).collect()}
    assert sum(hosts.values()) == len(pages) and set(hosts) == {host_path(r["url"])[0] for r in pages}
