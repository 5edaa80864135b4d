"""Labelled training pages for the extraction model, composed from parts whose labels are known by construction.

data-label on an element gives its label and that of its descendants, up to another label.
"""

from __future__ import annotations

from itertools import count, cycle

LABEL_ATTRIBUTE = "data-label"

_SENTENCES = (
    "The river rose in the night and the lower fields were under water by morning.",
    "Nobody had expected the bridge to hold, but it did.",
    "Der Rat beschloss, die Straße erst im Frühjahr zu erneuern.",
    "Les habitants ont attendu toute la nuit avant de rentrer chez eux.",
    "Los vecinos abrieron las puertas y ofrecieron mantas a todos.",
    "Short answer: yes.",
    "She kept a list of every name, every house &amp; every boat.",
)

#: Names of elements that hold an article, and of those that hold anything else.
_CONTENT_NAMES = (
    "content", "article", "content", "post", "entry", "story", "main", "content", "article-body", "entry-content", "post-content", "story-body", "article-content",
    "main-content", "post-body", "article-text", "articleBody", "page-body text", "story text", "hentry post",
)
_BOILER_NAMES = (
    "menu navbar navigation nav breadcrumb breadcrumbs header masthead topbar top banner footer bottom copyright legal disclaimer sidebar side widget "
    "complementary archive ad ads advert advertisement adsense sponsored sponsor promo promotion cookie cookies consent gdpr notice alert notification "
    "popup modal overlay paywall subscribe subscription newsletter signup search login register form comments comment commentlist reader discussion responses "
    "replies respond disqus share social sharing related recommended popular trending pagination pager tags meta byline toolbar"
).split()
_SUFFIXES = ("", "", "", "", "", "", "", "", "", "", "", "", "-box", "-bar", "-list", "-area", "-section", "-block", "-inner", "-content", "-item", "-slot", "-container", "-links", "-wrap")
_PREFIXES = ("", "", "", "", "site-", "", "", "", "page-", "", "", "", "main-")

#: Places of an article: what opens and closes around its body.
_PLACES = (
    ("<article>", "</article>"),
    ("<main data-label=frame><article data-label=content>", "</article></main>"),
    ("<main>", "</main>"),
    ("<div{name}>", "</div>"),
    ("<article>", "</article>"),
    ("<section{name}>", "</section>"),
    ("<div{name}>", "</div>"),
    ('<main role="main"{name}>', "</main>"),
    ("<div{name}><div{name}>", "</div></div>"),
    ("<article{name}>", "</article>"),
    ("<div>", "</div>"),
    ("", ""),
)

#: Elements that are not the article by their tag alone.
_BOILER_TAGS = ("nav", "header", "footer", "aside", "form", "nav", "header", "footer", "aside", "dialog", "menu", "button")
_BOILER_INSIDE = (
    "{sentence}",
    "<p>{sentence}</p>",
    "<ul>{links}</ul>",
    "<h3>Some words</h3><p>{sentence} {sentence}</p>",
    "{sentence} {sentence}",
    "<p>{sentence} {sentence} {sentence}</p><p>{sentence}</p>",
    "<h2>Words</h2><ul>{links}</ul>",
    '<a href="/">Some words</a>',
    "<p>{sentence}</p><button>Good</button>",
    "<ol><li><p>{sentence} {sentence}</p></li><li><p>{sentence}</p></li></ol>",
    '<div class="item"><p>{sentence}</p></div><div><b>Ann</b><p>{sentence} {sentence}</p></div>',
    '<span>Some words</span> <a href="/">more</a>',
    "<article class='comment'><p>{sentence} {sentence}</p></article><article class='comment'><p>{sentence}</p></article>",
    "<article><p>{sentence} {sentence}</p></article>",
    "<p>{sentence} {sentence} {sentence} {sentence} {sentence} {sentence} {sentence}</p><p>{sentence} {sentence} {sentence} {sentence}</p>",
    "<h3>Some words</h3><div class='comment'><p>{sentence} {sentence} {sentence} {sentence} {sentence}</p></div><div class='comment'><p>{sentence} {sentence}</p></div>",
    "<p>{sentence} {sentence} {sentence} {sentence} {sentence}</p><blockquote>{sentence}</blockquote><p>{sentence} {sentence} {sentence} {sentence} {sentence} {sentence}</p>",
    "<h1>The Daily Page</h1><p>{sentence}</p>",
    '<div class="logo">The Daily Page</div><p>{sentence}</p>',
    '<label>A word <input name="q"></label><button>Send</button>',
    "<header><h3>Some words</h3></header><p>{sentence} {sentence}</p>",
    "<table><tr><td>A word</td><td>{sentence}</td></tr></table>",
    "<h1>The Daily Page</h1>",
    "<div><p>{sentence} {sentence} {sentence}</p><p>{sentence}</p></div>",
    "&copy; 2020 The Daily Page. All rights reserved.",
)
_BOILER_LISTS = ("{links}", "<li>{sentence}</li><li>{sentence} {sentence}</li>", "<li><p>{sentence}</p></li><li><p>{sentence} {sentence}</p></li>")

#: Pieces of an article.
_CONTENT = (
    "<h1>{sentence}</h1>",
    "<h1>A title</h1>",
    "<p>{sentence}</p>",
    "<h2>Part of the story</h2>",
    "<p>{sentence} {sentence} {sentence}</p>",
    "<p>{sentence} {sentence} {sentence} {sentence} {sentence} {sentence} {sentence}</p>",
    "<p><b>{sentence}</b></p>",
    "<div>{sentence} {sentence} {sentence}</div>",
    "<p><b>A heading<br>",
    "<p>Word</p>",
    "<p>{sentence} <a href='/r'>a link</a> and <em>more</em> <strong>of it</strong>. {sentence}</p>",
    "<p>{sentence} <span>{sentence}</span> <i>so</i> <code>x = 1</code></p>",
    "<ul><li>{sentence}</li><li>One point</li><li>Another point</li></ul>",
    "<div><p>{sentence} {sentence}</p></div>",
    "<ol><li>{sentence}</li><li>{sentence}</li></ol>",
    "<blockquote><p>{sentence} {sentence}</p></blockquote>",
    "<blockquote>{sentence} {sentence}</blockquote>",
    "<pre>a = 1\nb = 2</pre>",
    "<figure><figcaption>{sentence}</figcaption></figure>",
    "<table><tr><th>Year</th><th>Level</th></tr><tr><td>1901</td><td>4.2</td></tr></table>",
    "<div>{sentence}</div>",
    "<section><h2>Next</h2><p>{sentence} {sentence}</p></section>",
    "<header><h1>{sentence}</h1></header>",
    "<h3>Later</h3>",
    "<dl><dt>Level</dt><dd>{sentence}</dd></dl>",
    "{sentence} {sentence}",
)


def _fill(part: str, sentences) -> str:
    while "{sentence}" in part:
        part = part.replace("{sentence}", next(sentences), 1)
    return part.replace("{links}", "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("news", "local sport", "weather", "about us")))


def _labelled(part: str, label: str) -> str:
    """The part with a label on its first element."""
    if not part.startswith("<"):
        return part
    end = min(i for i in (part.find(" "), part.find(">")) if i > 0)
    return f"{part[:end]} {LABEL_ATTRIBUTE}={label}{part[end:]}"


def _boiler(k: int) -> str:
    """The k-th boilerplate element: by tag alone, by a name alone, or both, around one of the insides."""
    inside = _BOILER_INSIDE[k * 7 % len(_BOILER_INSIDE)]
    if k % 4 == 0:
        tag = _BOILER_TAGS[k // 4 % len(_BOILER_TAGS)]
        return f"<{tag}>{inside}</{tag}>"
    name = _PREFIXES[k * 3 % len(_PREFIXES)] + _BOILER_NAMES[k * 5 % len(_BOILER_NAMES)] + _SUFFIXES[k * 3 % len(_SUFFIXES)]
    tag = ("div", "div", "section", "ul", "div", "aside", "div", "footer", "nav", "header")[k // 4 % 10]
    if tag == "ul":
        inside = _BOILER_LISTS[k % len(_BOILER_LISTS)]
    return f'<{tag} {"id" if k % 5 == 0 else "class"}="{name}">{inside}</{tag}>'


def labelled_pages(pages: int = 600) -> list[str]:
    """Pages that go through all places, names, parts and pieces, with boilerplate before, within and after the article."""
    places, sentences, pieces, number = cycle(_PLACES), cycle(_SENTENCES), cycle(_CONTENT), count()
    names = cycle(_CONTENT_NAMES)
    boiler = lambda: _labelled(_fill(_boiler(next(number)), sentences), "boiler")
    out = []
    for i in range(pages):
        opening, closing = next(places)
        while "{name}" in opening:
            opening = opening.replace("{name}", f' {"id" if i % 4 == 0 else "class"}="{next(names)}"', 1)
        before, after = [boiler() for _ in range(i % 4)], [boiler() for _ in range(i % 3 + 1)]
        body = [_fill(next(pieces), sentences) for _ in range(4 + i % 9)]
        if not opening:  # a header that stands alone is the site's
            body = [_labelled(part, "content") for part in body if not part.startswith("<header")]
        elif LABEL_ATTRIBUTE not in opening:
            opening = _labelled(opening, "content")
        for k in range((i + i // 4) % 4):
            body.insert(max(0, len(body) - k * 3), boiler())
        whole = "".join(before) + opening + "".join(body) + closing + "".join(after)
        if i % 2:
            whole = f'<div class="{("wrapper", "container", "page", "site")[i // 2 % 4]}">{whole}</div>'
        out.append(f"<!DOCTYPE html><html><head><title>x</title></head><body>{whole}</body></html>")
    return out
