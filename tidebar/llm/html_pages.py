"""Labelled pages for training the extraction model, made from layouts written for this package.

Elements carry ``data-main``: 1 if their own text belongs to the article, 0 if not; elements
without it take the label of the element around them.
"""

from __future__ import annotations

import random
import re

_TOP = (
    '<nav><ul>{links}</ul></nav>',
    '<header class="site-header"><div class="logo">{short}</div><ul class="menu">{links}</ul></header>',
    '<div id="header"><div id="navigation">{inline}</div></div>',
    '<div class="topbar navbar"><ul>{links}</ul></div><div class="breadcrumb">{inline}</div>',
)
_SIDE = (
    '<aside class="sidebar"><h3>{short}</h3><ul>{links}</ul></aside>',
    '<div class="sidebar widget"><p>{text}</p><ul>{links}</ul></div>',
    '<div id="sidebar" class="related"><h4>{short}</h4>{inline}</div>',
    '<aside><p>{text}</p></aside>',
)
_EXTRA = (
    '<div class="ad">{text}</div>',
    '<div class="advert banner"><p>{text}</p></div>',
    '<div class="sponsored promo"><a href="#">{short}</a></div>',
    '<div class="cookie-notice" role="dialog"><p>{text}</p><button>{short}</button></div>',
    '<div class="notice alert">{text}</div>',
    '<form class="newsletter"><label>{short}</label><input name="q"><button>{short}</button></form>',
    '<form action="/search"><p>{text}</p><select><option>{short}</option></select></form>',
    '<div class="share social"><ul>{links}</ul></div>',
    '<section class="related-posts"><h3>{short}</h3><ul>{links}</ul></section>',
)
_COMMENTS = (
    '<section id="comments" class="comments"><h3>{short}</h3><div class="comment"><p>{text}</p></div><div class="comment"><p>{text}</p></div></section>',
    '<div class="comment-list"><ol><li class="comment"><div class="comment-body"><p>{text}</p></div></li></ol></div>',
    '<div class="reader-comments"><p>{text}</p><p>{text}</p></div>',
    '<div id="disqus_thread" class="discussion replies"><p>{text}</p></div>',
)
_FOOT = (
    '<footer>&copy; {short} &middot; {text}</footer>',
    '<div id="footer" class="site-footer"><p>{text}</p>{inline}</div>',
    '<footer class="footer"><ul>{links}</ul><p>{short}</p></footer>',
    '<div class="copyright legal">{text}</div>',
)
_BODY = (
    '<article data-main="1"><h1>{short}</h1>{paragraphs}{inner}</article>',
    '<main><article class="post" data-main="1"><h1 class="title">{short}</h1>{paragraphs}{inner}</article></main>',
    '<div class="article-body entry-content" data-main="1"><h1>{short}</h1>{paragraphs}{inner}</div>',
    '<div id="content"><div class="post-content" data-main="1"><h2>{short}</h2>{paragraphs}{inner}</div></div>',
    '<main role="main" data-main="1"><h1>{short}</h1>{paragraphs}{inner}</main>',
    '<div id="main"><div class="story" data-main="1"><h1>{short}</h1><section>{paragraphs}</section>{inner}</div></div>',
    '<div class="content" data-main="1"><h1>{short}</h1>{paragraphs}{inner}</div>',
    '<div id="content" data-main="1">{paragraphs}{inner}</div>',
    '<div class="page"><div data-main="1"><h1>{short}</h1>{paragraphs}{inner}</div></div>',
    '<section class="content" data-main="1"><h2>{short}</h2>{paragraphs}{inner}</section>',
    '<div data-main="1">{paragraphs}</div>',
    '<div class="container"><div class="text" data-main="1">{paragraphs}{inner}</div></div>',
    '<div role="main" data-main="1"><div class="top"><h1>{short}</h1></div><div class="block">{paragraphs}{inner}</div></div>',
    '<div class="outer"><div class="inner"><h1 data-main="1">{short}</h1><div class="box" data-main="1">{paragraphs}{inner}</div></div></div>',
    '<table><tr><td class="left"><ul>{links}</ul></td><td class="middle" data-main="1">{paragraphs}{inner}</td></tr></table>',
)
_PARAGRAPHS = (
    '<p>{text}</p>', '<p>{text} <a href="#">{short}</a> {text}</p>', '<p><b>{text}<br><p>{text}</p>', '<blockquote><p>{text}</p></blockquote>',
    '<h2>{short}</h2><p>{text}</p>', '<ul><li>{text}</li><li>{short}</li></ul>', '<table><tr><td>{short}</td><td>{text}</td></tr></table>',
    '<pre>{text}</pre>', '<figure><figcaption>{short}</figcaption></figure>', '<div>{text}</div>', '<p>{short}</p>', '<div><p>{text}</p><p>{text}</p></div>',
)
_SYLLABLES = "an be co da el fi go ha in jo ka lu mo ne or pa qui ra so te un ver wi xe yo za the is of and".split()


def labelled_pages(n: int = 200, seed: int = 11) -> list[str]:
    """``n`` pages with ``data-main`` marks."""
    rng = random.Random(seed)

    def words(low: int, high: int, stop: str = "") -> str:
        return " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))).capitalize() + stop

    def renamed(layout: str) -> str:
        """Now and then with class names that say nothing, so that the model learns from structure and text, too."""
        if rng.random() < 0.65:
            return layout
        return re.sub(r' (class|id)="[^"]*"', lambda m: rng.choice(("", f' {m[1]}="{words(1, 1).lower()}"')), layout)

    def fill(layout: str, mark: bool = True) -> str:
        out = layout.replace("{links}", "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 7))))
        out = out.replace("{inline}", " | ".join(f'<a href="#">{words(1, 2)}</a>' for _ in range(rng.randint(2, 5))))
        while "{text}" in out:
            out = out.replace("{text}", " ".join(words(4, 18, ".") for _ in range(rng.randint(1, 4) if rng.random() < 0.96 else rng.randint(20, 120))), 1)
        while "{short}" in out:
            out = out.replace("{short}", words(2, 8), 1)
        return out.replace(">", ' data-main="0">', 1) if mark else out

    pages = []
    for _ in range(n):
        paragraphs = "".join(fill(rng.choice(_PARAGRAPHS), False) for _ in range(rng.randint(1, 12)))
        inner = "".join(fill(rng.choice(_EXTRA + _SIDE[:1] + _COMMENTS)) for _ in range(rng.choice((0, 0, 0, 1, 2))))
        body = fill(renamed(rng.choice(_BODY)), False).replace("{paragraphs}", paragraphs).replace("{inner}", inner)
        bare = rng.random() < 0.3  # nothing but the article, or hardly more
        parts = [] if bare else [fill(rng.choice(_TOP)), *[fill(rng.choice(_EXTRA)) for _ in range(rng.randint(0, 2))]]
        whole = rng.random() < (0.6 if bare else 0.2)
        parts.append(f"<h1>{words(2, 8)}</h1>{paragraphs}{inner}" if whole else body)
        if not bare:
            parts += [fill(rng.choice(_SIDE)) for _ in range(rng.randint(0, 1))] + [fill(rng.choice(_COMMENTS)) for _ in range(rng.randint(0, 1))]
        if not bare or rng.random() < 0.3:
            parts.append(fill(rng.choice(_FOOT)))
        pages.append(f'<html data-main="0"><head><title>{words(2, 6)}</title></head><body data-main="{int(whole)}">{"".join(parts)}</body></html>')
    return pages
