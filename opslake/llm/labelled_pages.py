"""Labelled pages that extraction learns from. Fixed values, made for this library.

A page is a list of fragments of HTML. ``+`` before a fragment marks its blocks as main text, ``-`` marks what stands
around it. ``%`` is replaced by words; ``%%`` by a long passage.
"""

from __future__ import annotations

import random

PAGES = [
    ["-<title>%</title><nav><ul><li><a href='/a'>%</a></li><li><a href='/b'>%</a></li><li><a>%</a></li></ul></nav><div class='ad'>%%</div>", "+<article><h1>%</h1><p>%%</p><p>%%</p><p>%</p></article>", "-<footer>&copy; % &middot; %%</footer>"],
    ["-<nav><ul><li><a href='/a'>%</a></li><li><a href='/b'>%</a></li></ul></nav><div class='ad'>%</div>", "+<article><h1>%</h1><p><b>%.<br><p>%</p><p>%</p><p><b>%%<br></article>", "-<footer>&copy; %</footer>"],
    ["-<header><div class='logo'>%</div><div id='menu'><a>%</a> | <a>%</a> | <a>%</a></div></header>", "+<main><h1>%</h1><p>%%</p><h2>%</h2><p>%</p><ul><li>%</li><li>%%</li></ul><p>%%</p></main>", "-<aside class='sidebar'><h3>%</h3><ul><li><a>%</a></li><li><a>%</a></li></ul></aside><footer><p>%%</p><p>&copy; %</p></footer>"],
    ["-<div id='cookie-notice'><p>We use cookies. %%</p><button>Accept</button></div><div class='navbar'><a>%</a><a>%</a></div><div class='breadcrumbs'><a>%</a> &gt; <a>%</a></div>", "+<div class='content'><h1>%</h1><p>%%</p><blockquote>%%</blockquote><p>%</p><pre>%</pre></div>", "-<div class='comments'><h3>Comments</h3><div class='comment'><p>%%</p></div><div class='comment'><p>%</p></div></div><div class='footer'>%</div>"],
    ["-<div class='banner'>%</div><div class='top-bar'>%</div>", "+<div id='main'><article class='post'><h1 class='entry-title'>%</h1><div class='entry-content'><p>%%</p><p>%%</p><p>%</p></div></article></div>", "-<section id='comments'><h2>%</h2><ol><li class='comment'><p>%%</p></li><li class='comment'><p>%%</p></li></ol><form><label>%</label><textarea></textarea><button>%</button></form></section><div class='widget'><h4>%</h4><p>%%</p></div>"],
    ["-<header><h2>%</h2><p>%%</p></header><nav><a>%</a><a>%</a></nav><div class='notice'>%%</div>", "+<article><h1>%</h1><p>%%</p>", "-<div class='advertisement'><p>%%</p></div>", "+<p>%%</p><figure><img src='x'><figcaption>%</figcaption></figure><p>%</p>", "-<div class='share'><a>%</a><a>%</a></div>", "+</article>", "-<div class='related'><h3>%</h3><ul><li><a>%</a></li><li><a>%</a></li></ul></div><footer>%%</footer>"],
    ["-<div class='header'><p>%%</p></div><ul class='menu'><li><a>%</a></li><li><a>%</a></li></ul>", "+<section class='article-body'><h1>%</h1><p>%%</p><table><tr><th>%</th><th>%</th></tr><tr><td>%</td><td>%</td></tr></table><p>%%</p></section>", "-<form action='/s'><p>%%</p><label>%</label><input><select><option>%</option><option>%</option></select></form><div class='ads'>%%</div><div class='cookie-banner'><p>%%</p></div><footer><ul><li><a>%</a></li></ul>%</footer>"],
    ["-<div role='navigation'><a>%</a> <a>%</a></div><div role='banner'>%</div>", "+<div role='main'><h1>%</h1><p>%</p><p>%</p><p>%%</p></div>", "-<div role='complementary'><p>%%</p></div><div role='contentinfo'>%</div><div role='alert'>%%</div>"],
    ["-<div class='promo'><p>%%</p></div><div class='subscribe newsletter'><p>%%</p><form><input><button>%</button></form></div>", "+<div class='story text'><h1>%</h1><p>%%</p><p>%%</p><dl><dt>%</dt><dd>%%</dd></dl></div>", "-<div class='sponsored'><p>%%</p></div><div class='sidebar'><p>%%</p><p>%%</p></div><div class='tags'><a>%</a></div><div class='pagination'><a>%</a><a>%</a></div><div class='copyright'>%</div>"],
    ["-<nav><p>%%</p><ul><li>%</li><li>%</li></ul></nav>", "+<article><header><h1>%</h1></header><section><p>%%</p><h2>%</h2><p>%%</p></section>", "-<aside><p>%%</p></aside>", "+<p>%%</p></article>", "-<div class='comments'><article class='comment'><p>%%</p></article><article class='comment'><p>%</p></article></div><aside><p>%%</p></aside><footer><p>%%</p></footer>"],
    ["-<div id='header'><h1>%</h1></div><div id='nav'><a>%</a></div><div id='sidebar'><h3>%</h3><p>%%</p></div>", "+<div id='content'><h2>%</h2><p>%%</p><p>%</p><h3>%</h3><p>%%</p></div>", "-<div id='ad-bottom'><p>%%</p></div><div id='footer'><p>%%</p></div>"],
    ["-<nav><a>%</a><a>%</a></nav><div class='ad'>%%</div>", "+<div><h1>%</h1><p>%%</p><div><p>%%</p><p>%</p></div></div>", "-<div class='comments'><p>%%</p></div><footer>%</footer>"],
    ["-<header><a>%</a></header>", "+<article><div><h1>%</h1><div><section><p>%%</p><p>%</p></section><section><h2>%</h2><div>%%</div></section></div></div></article>", "-<aside><div><p>%%</p></div></aside><footer><div><p>%%</p></div></footer>"],
    ["-<div><nav><ul><li><a>%</a></li></ul></nav></div>", "+<main><section><div><h1>%</h1><p>%</p><p>%%</p><ul><li>%</li><li>%</li></ul></div></section></main>", "-<div class='sidebar'><div><p>%%</p></div></div><div><footer><p>%</p></footer></div>"],
    ["", "+<h1>%</h1><p>%%</p><p>%</p><p>%%</p>", ""],
    ["-<nav><a>%</a><a>%</a></nav>", "+<body><p>%%</p><p>%%</p><p>%</p></body>", "-<footer>%</footer>"],
    ["-<div class='alert'><p>%%</p></div><div class='modal popup'><p>%%</p></div><div class='skip'><a>%</a></div>", "+<div class='page'><div class='body'><h1>%</h1><div>%%</div><div>%</div><div>%%</div></div></div>", "-<div class='author-bio'><p>%%</p></div><div class='reply'><p>%%</p></div><div class='social'><a>%</a></div><noscript>%%</noscript>"],
    ["-<aside><h3>%</h3><p>%%</p></aside><form><p>%%</p><p>%</p></form><div class='advert'><p>%</p></div>", "+<article><h1>%</h1><h2>%</h2><p>%</p><ol><li>%%</li><li>%</li></ol><p>%%</p></article>", "-<section class='comments'><p>%%</p><p>%%</p></section><div class='notice'><p>%</p></div><footer><nav><a>%</a></nav><p>&copy; 2020 %</p></footer>"],
]
_SYLLABLES = "ba ne ti ro lu ka me si do vu pa le ri no tu ga he".split()


def labelled(copies: int = 4, seed: int = 7) -> list[list[tuple[str, int]]]:
    """Each page ``copies`` times, with other words: fragments of HTML with their labels."""
    pick = random.Random(seed)

    def words(low: int, high: int) -> str:
        made = " ".join("".join(pick.choices(_SYLLABLES, k=pick.randint(1, 4))) for _ in range(pick.randint(low, high)))
        return made.capitalize() + pick.choice(["", ".", ".", "."])

    def filled(fragment: str) -> str:
        out = fragment.split("%%")
        long = [" ".join(words(4, 16) for _ in range(pick.randint(1, 8))) for _ in out[1:]] + [""]
        return "".join("".join(x + words(1, 9) * (i < len(short) - 1) for i, x in enumerate(short)) + more for more, short in zip(long, (p.split("%") for p in out), strict=True))

    return [[(filled(f[1:]), int(f[0] == "+")) for f in page if f] for page in PAGES for _ in range(copies)]
