"""Pages whose layouts the extraction model has never seen: (html, main text) pairs, written by hand after common site builders."""

import random

_WORDS = "river stone lantern harbour market winter engine paper signal valley copper garden window thread meadow tower candle anchor forest bridge letter island mirror basket hammer violet saddle kettle orchard compass".split()

#: A = article sentence, S = short article text, N = other sentence, L = other short text.
_LAYOUTS = (
    '<div class="wp-site-blocks"><div class="wp-block-group menu-bar"><a href="/">L</a><a href="/a">L</a><a href="/b">L</a></div><div class="entry-content wp-block-post-content"><h1 class="wp-block-heading">S</h1><p>A A A</p><p>A A</p><ul><li>A</li><li>A</li></ul><p>A A A A</p></div><div class="wp-block-latest-posts sidebar-right"><h2>L</h2><a href="/c">L</a><a href="/d">L</a></div><div class="site-info footer-credits">N</div></div>',
    '<div id="wrapper"><div id="mainmenu"><ul><li><a href="x">L</a><li><a href="y">L</a></ul></div><table><tr><td class="leftcol"><a href="1">L</a><br><a href="2">L</a></td><td class="maintext"><h2>S</h2><p>A A A<p>A A A A<p>A</td></tr></table><div id="bottom">N</div></div>',
    '<header class="l-header"><a class="brand" href="/">L</a><nav class="l-nav"><a href="/1">L</a> <a href="/2">L</a></nav></header><main class="l-main"><article class="c-story"><h1>S</h1><div class="c-story__body"><p>A A</p><figure><img src="a.png"><figcaption>S</figcaption></figure><p>A A A</p><blockquote>A</blockquote><p>A A</p></div></article><aside class="c-related"><h3>L</h3><ul><li><a href="/3">L</a></li><li><a href="/4">L</a></li></ul></aside></main><footer class="l-footer"><p>N</p><a href="/5">L</a></footer>',
    '<div class="cookie-banner">N <button>L</button></div><div class="navbar navbar-default"><ul class="nav"><li><a href="#">L</a></li><li><a href="#">L</a></li></ul></div><div class="container"><div class="row"><div class="col-md-8"><h1>S</h1><p class="lead">A A</p><p>A A A</p><p>A A A A</p></div><div class="col-md-4 sidebar"><div class="widget"><h4>L</h4><ul><li><a href="#">L</a></li></ul></div></div></div><div id="comments" class="comments-area"><h3>L</h3><ol class="commentlist"><li><p>N</p></li><li><p>N N</p></li></ol></div></div><div class="footer">N</div>',
    '<nav class="sphinxsidebar"><h3><a href="i">L</a></h3><ul><li><a href="j">L</a></li><li><a href="k">L</a></li></ul></nav><div class="document"><div class="body" role="main"><section><h1>S</h1><p>A A A</p><pre>S S</pre><p>A A</p><dl><dt>S</dt><dd>A A</dd></dl></section></div></div><div class="footer" role="contentinfo">N</div>',
    '<body class="post-template"><div class="site-nav"><a href="/">L</a><a href="/t">L</a></div><section class="post-full-content"><h1>S</h1><div class="post-content"><p>A A A A</p><h2>S</h2><p>A A A</p><hr><p>A A</p></div></section><section class="subscribe-form"><h3>L</h3><p>N</p><form><input name="e"><button>L</button></form></section><div class="read-next-feed"><a href="/p">L</a><a href="/q">L</a></div><footer>N</footer></body>',
    '<center><font size=2><a href="a.html">L</a> | <a href="b.html">L</a> | <a href="c.html">L</a></font></center><h1>S</h1><p>A A A</p><p>A A A A</p><p>A A</p><hr><center><font size=1><a href="a.html">L</a> N</font></center>',
    '<div role="banner"><a href="/">L</a></div><div role="navigation"><ul><li><a href="/1">L</a></li><li><a href="/2">L</a></li></ul></div><div role="main"><div class="headline"><h1>S</h1></div><div class="copy"><p>A A A</p><p>A A</p><div class="ad-slot">N</div><p>A A A</p></div></div><div role="complementary"><h2>L</h2><p>N</p></div><div role="contentinfo">N</div>',
)


def unseen_pages(n: int = 80, seed: int = 5) -> list[tuple[str, str]]:
    rng = random.Random(seed)
    some = lambda a, b, end: " ".join(rng.choices(_WORDS, k=rng.randint(a, b))).capitalize() + end
    out = []
    for k in range(n):
        main, page = [], []
        # single capitals stand for text; tags and attributes have none alone
        for c in _split(_LAYOUTS[k % len(_LAYOUTS)]):
            if c in ("A", "S", "N", "L"):
                t = some(8, 22, ".") if c in "AN" else some(2, 6, "")
                main += [t] if c in "AS" else []
                page.append(t)
            else:
                page.append(c)
        out.append((f"<html><head><title>{some(2, 4, '')}</title></head>{''.join(page)}</html>", " ".join(main)))
    return out


def _split(layout: str) -> list[str]:
    import re

    return re.split(r"(?<![A-Za-z])([ASNL])(?![A-Za-z])", layout)
