"""The labelled table: page layouts whose blocks are marked + (article) or - (anything else), with their number of words.

{+30} stands for a block of some 30 words that belongs to the article. Every layout
is written out several times with other lengths, so that the table has some
hundreds of blocks and no length is a mark of a layout. Class names that say
nothing (k1, k2, ...) stand for those that no list knows; names that mislead are
among them, so that names are a weak hint.
"""

from __future__ import annotations

import random
import re

LAYOUTS = (
    # An article element; things around it and in it.
    "<nav><ul><li><a>{-1}</a></li><li><a>{-1}</a></li><li><a>{-1}</a></li></ul></nav><div class=ad>{-9}</div><article><h1>{+9}</h1><p>{+60}</p><p>{+12}</p><p>{+2}</p><p>{+40}</p></article><footer>{-12}</footer>",
    "<nav><ul><li><a>{-1}</a></li><li><a>{-2}</a></li></ul></nav><div class=k1>{-9}</div><article><h1>{+9}</h1><p>{+60}</p><p>{+1}</p><p>{+2}</p><p>{+7}</p></article><footer>{-12}</footer>",
    "<nav><a>{-1}</a></nav><article><p>{+1}</p></article><footer>{-9}</footer>",
    "<article><h1>{+3}</h1><p>{+1}</p></article><div class=sidebar><p>{-45}</p></div>",
    "<header class=k1><h1>{-5}</h1><p>{-14}</p></header><div class=cookie-notice><p>{-30}</p></div><article><header><h1>{+8}</h1></header><p>{+50}</p><p>{+70}</p></article><aside><p>{-60}</p></aside><footer><p>{-20}</p></footer>",
    "<div class=k2>{-25}</div><article><h2>{+7}</h2><p>{+35}</p><p>{+3}</p><p>{+35}</p></article><div class=k3><p>{-40}</p><p>{-30}</p></div>",
    "<article><p>{+40}</p><aside>{-30}</aside><p>{+50}</p><nav>{-4}</nav><form><p>{-6}</p><input></form><p>{+20}</p><footer>{-5}</footer></article><div class=banner>{-25}</div>",
    "<main><h1>{+5}</h1><p>{+50}</p><div class=share-buttons>{-3}</div><p>{+40}</p><div class=newsletter><p>{-18}</p></div><p>{+9}</p><div class=ad>{-8}</div><p>{+30}</p></main>",
    "<article><h2><a>{+6}</a></h2><p>{+40}</p><ul><li><a>{+3}</a></li><li><a>{+4}</a></li></ul><p>{+20}</p></article><div class=related><a>{-5}</a></div>",
    "<article class=ad-free-article><h1>{+6}</h1><div class=header-image><p>{+12}</p></div><p>{+40}</p><div class=notice-text><p>{+25}</p></div><p>{+30}</p></article><div class=k4><p>{-20}</p></div>",
    "<div class=notice>{-9}</div><article><header><h1>{+6}</h1></header><p>{+40}</p></article><section class=comments><h3>{-2}</h3><article class=comment><p>{-30}</p></article><article><p>{-25}</p></article></section>",
    "<main><article><h1>{+6}</h1><p>{+60}</p><p>{+60}</p><p>{+5}</p></article><section class=k5><h3>{-2}</h3><div><p>{-14}</p></div><div><p>{-20}</p></div></section></main>",
    "<main><article><h1>{+6}</h1><p>{+60}</p><p>{+70}</p></article><section class=k6><article><p>{-14}</p></article><article><p>{-17}</p></article></section></main>",
    "<main><h1>{+7}</h1><article><p>{+50}</p><p>{+4}</p><p>{+60}</p></article></main><aside><h2>{-3}</h2><p>{-30}</p></aside>",
    "<form id=page><nav><a>{-2}</a></nav><article><h1>{+5}</h1><p>{+40}</p><p>{+3}</p></article><p>{-6}</p></form>",
    "<div role=main><h1>{+6}</h1><p>{+45}</p><blockquote>{+30}</blockquote><table><tr><td>{+3}</td><td>{+4}</td></tr></table></div><div role=complementary><p>{-35}</p></div>",
    # Containers with names.
    "<div id=content><h2>{+4}</h2><p>{+40}</p><ul><li>{+5}</li><li>{+2}</li></ul><blockquote>{+30}</blockquote></div><div id=comments><h3>{-2}</h3><p>{-40}</p><p>{-8}</p></div>",
    "<div class=post-content><p>{+50}</p><p>{+1}</p></div><div class=widget>{-30}</div><div class=sidebar><h3>{-2}</h3><p>{-25}</p></div>",
    "<div class=site-header><p>{-6}</p></div><div class=entry><h1>{+5}</h1><p>{+40}</p><p>{+30}</p></div><div class=newsletter-signup><p>{-18}</p></div><div class=footer>{-14}</div>",
    # Containers whose names say nothing: words, links and neighbours.
    "<div class=k1><a>{-1}</a> <a>{-1}</a> <a>{-2}</a></div><div class=k2><h1>{+6}</h1><p>{+50}</p><p>{+60}</p><p>{+8}</p><p>{+40}</p></div><div class=k3><a>{-2}</a> {-4}</div>",
    "<div class=k1><a>{-1}</a></div><div class=k4>{-9}</div><div class=k2><h1>{+6}</h1><p>{+50}</p><p>{+60}</p></div><div class=k7><div><p>{-12}</p></div><div><p>{-15}</p></div></div><div class=k8><a>{-3}</a></div>",
    "<div><a>{-1}</a> <a>{-1}</a> <a>{-1}</a></div><h1>{+5}</h1><p>{+40}</p><p>{+40}</p><div>{-1}</div>",
    "<table><tr><td><a>{-1}</a></td><td><a>{-2}</a></td></tr></table><p>{+30}</p><p>{+60}</p><p>{+6}</p><p>{+40}</p><p><a>{-2}</a></p>",
    "<div>{-1}</div><div>{-2}</div><div>{+50}</div><div>{+40}</div><div><a>{-1}</a></div><div>{-1}</div>",
    "<ul><li><a>{-1}</a></li><li><a>{-3}</a></li><li><a>{-1}</a></li></ul><p>{+40}</p><p>{+3}</p><p>{+40}</p><ul><li><a>{-1}</a></li></ul>",
    "<p>{+30}</p><p>{+5}</p><p>{+30}</p><p><a>{-12}</a></p>",
    "<p>{+30}</p><p>{+30}</p>",
    "<p>{+30}</p>",
    "<p>{+6}</p>",
    "<div class=k1><div class=k2><p>{+40}</p></div><div class=k2><p>{+35}</p></div><div class=k2><p>{+9}</p></div><div class=k2><p>{+45}</p></div></div><div class=k3><a>{-4}</a></div>",
)
#: How often each layout is written out.
TIMES = 4


def pages(times: int = TIMES) -> list[str]:
    rng = random.Random(20)
    out = []
    for layout in LAYOUTS:
        for k in range(times):
            length = lambda m: max(1, round(int(m[2]) * (1 if not k else rng.choice((0.4, 0.7, 1, 1.5, 2.2)))))  # noqa: B023, E731
            out.append("<html><body>" + re.sub(r"\{([+-])(\d+)\}", lambda m: m[1] + " ".join(["w"] * length(m)), layout) + "</body></html>")
    return out
