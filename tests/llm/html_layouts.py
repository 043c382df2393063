"""Pages of other layouts than the sample's, each with the main text that an extractor should give."""

P1 = "The council met on Monday to discuss the new bridge, and after two hours of debate it agreed to fund the first stage."
P2 = "Work will begin in March. Residents near the river were told that noise would be kept to daytime hours, as far as possible."
P3 = "Asked about the cost, the mayor said that it was within the budget; a report on the second stage follows in autumn."
H = "Council agrees to fund new bridge"
NAV = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li><li><a href=/w>Weather</a></li></ul>"
FOOT = "<p><a href=/t>Terms</a> <a href=/p>Privacy</a> <a href=/c>Contact</a></p><p>Copyright 2024 The Paper. All rights reserved.</p>"


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>{H}</title><script>var a='<p>';</script></head><body>{body}</body></html>"


def ps(*texts: str) -> str:
    return "".join(f"<p>{t}</p>" for t in texts)


LAYOUTS = {
    "semantic": (page(f"<header><h1>The Paper</h1></header><nav>{NAV}</nav><main><article><h1>{H}</h1>{ps(P1, P2, P3)}</article></main><footer>{FOOT}</footer>"), [H, P1, P2, P3]),
    "hashed_names": (page(f"<div class=x7Gh2><div class=q1>{NAV}</div></div><div class=kk3z><article class=p0Xa><h1>{H}</h1>{ps(P1, P2, P3)}</article></div><footer class=zz81>{FOOT}</footer>"), [H, P1, P2, P3]),
    "main_with_aside": (page(f"<nav>{NAV}</nav><main><h1>{H}</h1>{ps(P1)}<aside><h3>Related</h3><ul><li><a href=1>Old bridge closes</a></li><li><a href=2>River levels rise</a></li></ul></aside>{ps(P2, P3)}</main><footer>{FOOT}</footer>"), [H, P1, P2, P3]),
    "table_inside": (page(f"<nav>{NAV}</nav><article><h1>{H}</h1>{ps(P1)}<table><tr><th>Stage</th><th>Cost</th></tr><tr><td>First</td><td>2 million</td></tr></table>{ps(P2)}</article><footer>{FOOT}</footer>"), [H, P1, "Stage", "Cost", "First", "2 million", P2]),
    "linked_list_inside": (page(f"<nav>{NAV}</nav><article><h1>{H}</h1>{ps(P1)}<ul><li><a href=a>The report of the first stage, in full</a></li><li><a href=b>The minutes of the meeting on Monday</a></li></ul>{ps(P2)}</article><footer>{FOOT}</footer>"), [H, P1, "The report of the first stage, in full", "The minutes of the meeting on Monday", P2]),
    "figure_and_quote": (page(f"<nav>{NAV}</nav><article><h1>{H}</h1><figure><img src=x><figcaption>The river at the site, seen from the north bank.</figcaption></figure>{ps(P1)}<blockquote><p>It is a good day for the town.</p></blockquote>{ps(P2)}</article><footer>{FOOT}</footer>"), [H, "The river at the site, seen from the north bank.", P1, "It is a good day for the town.", P2]),
    "footer_wrapper": (page(f"<nav>{NAV}</nav><div class=content><h1>{H}</h1>{ps(P1, P2)}</div><div class=td-footer-wrapper><div>About us: the paper of the town since 1890.</div>{FOOT}</div>"), [H, P1, P2]),
    "cookie_notice": (page(f"<div class='cookie-consent'><p>We use cookies to improve this site. By going on you agree.</p></div><nav>{NAV}</nav><article><h1>{H}</h1>{ps(P1, P2, P3)}</article><footer>{FOOT}</footer>"), [H, P1, P2, P3]),
    "named_comments": (page(f"<nav>{NAV}</nav><article><h1>{H}</h1>{ps(P1, P2)}</article><section id=comments><h2>Comments</h2><div class=comment><p>About time too, we have waited for years for this.</p></div><div class=comment><p>And who pays for the second stage then?</p></div></section><footer>{FOOT}</footer>"), [H, P1, P2]),
    "comments_in_article": (page(f"<nav>{NAV}</nav><article><h1>{H}</h1>{ps(P1, P2)}<div class='comments-list'><div><p>About time too, we have waited for years for this.</p></div></div></article><footer>{FOOT}</footer>"), [H, P1, P2]),
    "search_and_signup": (page(f"<header><form action=/q><label>Search the site</label><button>Go</button></form></header><article><h1>{H}</h1>{ps(P1)}<div class=newsletter-signup><p>Get our letter each morning.</p></div>{ps(P2)}</article><footer>{FOOT}</footer>"), [H, P1, P2]),
    "plain_divs": (page(f"<div class=a1>{NAV}</div><div class=b2><div><h1>{H}</h1>{ps(P1, P2, P3)}</div></div><div class=c3>{FOOT}</div>"), [H, P1, P2, P3]),
    "blog_post": (page(f"<div id=header><h1>My weblog</h1></div><div id=sidebar>{NAV}</div><div class=post><h2>{H}</h2><div class=entry-content>{ps(P1, P2, P3)}</div></div><div id=footer>{FOOT}</div>"), [H, P1, P2, P3]),
    "formula": (page(f"<nav>{NAV}</nav><article><h1>{H}</h1><p>The load is <math><mi>q</mi><mo>=</mo><mn>5</mn></math> units, as planned.</p>{ps(P1)}</article><footer>{FOOT}</footer>"), [H, "The load is q=5 units, as planned.", P1]),
    "code_sample": (page(f"<nav>{NAV}</nav><main><article><h1>{H}</h1>{ps(P1)}<pre><code>for x in bridge: print(x)</code></pre>{ps(P2)}</article></main><footer>{FOOT}</footer>"), [H, P1, "for x in bridge: print(x)", P2]),
    "advert_between": (page(f"<nav>{NAV}</nav><article><h1>{H}</h1>{ps(P1)}<div class=ad-slot><span>Buy the best boots in town, now at half price.</span></div>{ps(P2)}</article><footer>{FOOT}</footer>"), [H, P1, P2]),
}


def scores(kept: list[str], want: list[str]) -> tuple[float, float]:
    """Recall and precision by characters of blocks."""
    hit = sum(len(t) for t in want if t in kept)
    return hit / sum(map(len, want)), hit / max(1, sum(map(len, kept)))
