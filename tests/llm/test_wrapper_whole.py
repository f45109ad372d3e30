"""Pages of any size: long attributes, deep nesting, long alignments."""

import random
import time

from colferry.llm import wrapper


def test_long_attributes():
    long = "A" * 300_000
    page = f'<article><p>before</p><img src="data:image/png;base64,{long}"><script data-x="{long}">var x = "<p>no</p>";</script><p>after</p></article>'
    assert wrapper.extract(page, None) == "before\nafter"
    assert wrapper.extract('<article><p title="open>text</p><p>more</p></article>', None) == "text\nmore"
    began = time.time()
    for unit in ("<a \"b'", "<a \"'c\"", "<a ", "<p 'x"):
        wrapper.parse(unit * 100_000)
    assert time.time() - began < 60


def test_any_depth():
    for n in (200, 20_000):
        page = f'<div id="page"><article><p>one</p>{"<div>" * n}deep{"</div>" * n}<p>two</p></article></div>'
        own = wrapper.wrapper(wrapper.parse(page))
        assert wrapper.loads(wrapper.dumps(own)) is not None
        both = wrapper.merge(wrapper.loads(wrapper.dumps(own)), own)
        assert wrapper.mass(both) >= 0
        assert wrapper.extract(page, None) == "one\ndeep\ntwo"
    advert = f'<article><p>one</p>{"<div>" * 200}<nav>menu</nav>{"</div>" * 200}<p>two</p></article>'
    assert wrapper.extract(advert, None) == "one\ntwo"


def test_alignment_of_long_sequences():
    b = [f"n{k}" for k in range(400)]
    a = b[:10] + b[30:]  # 20 missing: more than 8 places
    assert wrapper.matches(a, b) == [(i, i if i < 10 else i + 20) for i in range(380)]
    rnd = random.Random(3)
    for _ in range(200):
        x, y = ([rnd.choice("abcd") for _ in range(rnd.randrange(12))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
        got = wrapper.matches(x, y)
        assert len(got) == best[-1][-1] and all(x[i] == y[j] for i, j in got)
        assert all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:]))
