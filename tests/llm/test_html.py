import itertools
import random

import numpy as np
import pytest

from strandloom.llm import html_extract as H

P = "The committee met again on Monday and agreed to nothing. Members left early."
Q = "A much longer paragraph of prose follows here, with several clauses, and it ends with a stop. Then it goes on. And on."
PAGES = [
    (f"<body><header><h1>Site</h1></header><div class=cookie-banner>We use cookies.</div><div id=wrap><div class=post><h1>Title</h1><p>Hello world. This is text.</p><div class=ad-slot>Buy!</div><p>Short</p><ul><li>a</li><li>b c.</li></ul><form><p>Sub</p></form></div><aside>See <a href=x>y</a></aside><section class=comments><p>I like it. {Q}</p></section></div><footer>c</footer></body>", "Title\nHello world. This is text.\nShort\na\nb c."),
    (f"<body><div class=top-bar><a href=/>Home</a></div><nav><ul><li><a href=/a>A</a></ul></nav><main><h1>T</h1><p>{P}</p><p>{Q}</p></main><aside><p>{Q}</p></aside><footer><p>{P}</p></footer></body>", f"T\n{P}\n{Q}"),
    (f"<body><header><a href=/>Logo</a><p>{P}</p></header><article><header><h1>T</h1></header><p>{P}</p><aside class=related><p>{Q}</p></aside><p>{Q}</p><section class=comments><h2>Comments</h2><article class=comment><p>{Q}</p></article></section></article></body>", f"T\n{P}\n{Q}"),
    (f"<body><nav>a</nav><div class=notice>{P}</div><article><h1>T</h1><p>{P}<p>{Q}<div class=ad>{P}</div><p>{Q}</p><form><label>{P}</label></form><p>{P}</article><div id=comments><p>{Q}</p><p>{Q}</p></div></body>", f"T\n{P}\n{Q}\n{Q}\n{P}"),
    (f"<article><h1>T &amp; U&nbsp;V &lt;b&gt; &#233;</h1><p>{P}", f"T & U V <b> é\n{P}"),
    ("<html><head><title>t</title><style>p{}</style><script>var x='<p>no</p>'</script></head><body><article><p>One<br>two <b>th</b>ree</p><!-- gone --><p> \n </p></article></body></html>", "One two three"),
]


@pytest.fixture(scope="module")
def model(spark):
    return H.default_model(spark)


def test_pages(spark, model):
    rows = [(i, f"http://a/{i}", page, "x") for i, (page, _) in enumerate(PAGES)] + [(100, None, None, "x"), (101, "u", "", "x"), (None, "u", "<p", "x"), (102, "u", "<div>" * 3000 + "deep", "x")]
    rows += [rows[0]]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    for i, (_, text) in enumerate(PAGES):
        assert texts[i] == text
    assert texts[100] == texts[101] == texts[None] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_marginals_are_exact(model):
    page = H.parse(f"<nav><a href=x>y</a></nav><div class=post><p>{P}</p></div>")
    feats = H.features(page)
    n = len(page.tags)
    total = np.zeros((n, H.STATES))
    for states in itertools.product(range(H.STATES), repeat=n):
        score = model.root[states[0]] + sum(model.node_score(f)[s] for f, s in zip(feats, states))
        score += sum(model.edge[states[page.parents[i]], states[i]] for i in range(1, n))
        for i, s in enumerate(states):
            total[i, s] += np.exp(score)
    assert np.allclose(model.marginals([H.parse(""), page])[1], total / total.sum(axis=1, keepdims=True), atol=1e-9)


def test_test_pages_against_their_articles(spark, model):
    import html as lib
    import re

    for row in H.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), model).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", row["html"], re.DOTALL)[1]
        blocks = [" ".join(lib.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert row["text"] == "\n".join(b for b in blocks if b)


def composed(seed):
    """A page put together from parts that training pages do not have in this form, and its article's text."""
    rng = random.Random(seed)
    words = "one two river bridge stone cat anhe thntor erou inland winter bread and to of was".split()
    sentence = lambda n=None: " ".join(rng.choice(words) for _ in range(n or rng.randint(4, 25))).capitalize() + rng.choice(".!?")
    prose = lambda: " ".join(sentence() for _ in range(rng.randint(1, 6)))
    links = lambda: "".join(f'<li><a href="/{i}">{rng.choice(words)} {i}</a></li>' for i in range(4))
    outside = [
        f'<nav class="main-menu"><ul>{links()}</ul></nav>', f'<ul class="menu">{links()}</ul>', f'<header class="site-header"><a href="/">{sentence(3)}</a><p>{sentence(5)}</p></header>',
        f'<div id="header"><h2>{sentence(3)}</h2></div>', f"<header><h1>{sentence(2)}</h1><p>{sentence()}</p></header>", f"<footer><p>&copy; {sentence(5)}</p></footer>", f'<div class="footer"><p>{prose()}</p></div>',
    ]
    anywhere = [
        f"<aside><h3>{sentence(3)}</h3><p>{prose()}</p></aside>", f'<div class="sidebar"><p>{prose()}</p><p>{prose()}</p></div>', f'<div class="cookie-notice">{sentence()}</div>', f'<div class="site-notice"><p>{prose()}</p></div>',
        f'<div class="ad">{sentence()}</div>', f'<div class="ad-box"><a href="/b">{sentence()}</a></div>', f'<section class="promo"><p>{sentence()}</p></section>', f'<div class="sponsored-content"><p>{prose()}</p></div>',
        f"<form><p>{prose()}</p><input></form>", f'<div class="newsletter-signup"><p>{prose()}</p></div>', f'<div id="comments"><h3>{sentence(2)}</h3><ol><li><p>{prose()}</p></li><li><p>{prose()}</p></li></ol></div>',
        f'<section id="reader-comments"><p>{prose()}</p><p>{prose()}</p></section>', f'<ul class="commentlist"><li>{prose()}</li><li>{prose()}</li></ul>', f'<div class="related-posts"><ul>{links()}</ul></div>',
    ]
    title = sentence(5)
    body, text = [f"<h1>{title}</h1>"], [title]
    for _ in range(rng.randint(2, 60)):
        kind, a, b = rng.randrange(8), prose(), sentence(3)
        made, lines = {
            0: (f"<h2>{b}</h2>", [b]), 1: (f"<ul><li>{a}</li><li>{b}</li></ul>", [a, b]), 2: (f"<blockquote>{a}</blockquote>", [a]), 3: (f"<div>{a}</div>", [a]), 4: (f"<p>{a} <b>{b}</b> <a href=/x>{b}</a></p>", [f"{a} {b} {b}"]),
        }.get(kind, (f"<p>{a}</p>", [a]))
        body.append(made)
        text += lines
        if rng.random() < 0.1:
            body.append(rng.choice(anywhere))
    opening, closing = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div class="story-body">', "</div>"), ('<div id="main">', "</div>")])
    around = lambda: "".join(rng.choice(outside + anywhere) for _ in range(rng.randint(1, 3)))
    wrap = rng.choice(["", '<div class="wrapper">', '<div id="page">'])
    return f"<html><body>{wrap}{around()}{opening}{''.join(body)}{closing}{around()}</body></html>", "\n".join(text)


def test_composed_pages(model):
    made = [composed(seed) for seed in range(300)]
    parsed = [H.parse(page) for page, _ in made]
    right = [H.main_text(p, m) == text for p, m, (_, text) in zip(parsed, model.marginals(parsed), made)]
    assert sum(right) >= 0.98 * len(right)
