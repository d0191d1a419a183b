"""Hand-labelled pages for training the extraction model.

``y`` marks an element whose text is main text, ``n`` one whose text is not; the mark holds for all
elements below until another mark. Words carry no information; structure, names and link shares do.
"""

from __future__ import annotations

_S = "Ta ro mi le so na ku te li wa po ne sa ri mo, ta lo ke ni va su re po la mi to ne. Ka so li ma ro ti pe na. "
_T = "Ro ti la me so ka nu le pa ri wo. "


def _links(n: int) -> str:
    return "".join(f'<li><a href="/{i}">ta ro</a></li>' for i in range(n))


# Fixed training pages, each a usual layout.
PAGES = [
    f'<body n><nav><ul>{_links(6)}</ul></nav><div class="ad">{_T}</div><article y><h1>{_T}</h1><p>{_S * 2}</p><p>{_S}<p>{_T}</p>'
    f"</article><footer>&copy; ta ro mi &middot; {_T}</footer></body>",
    f'<body n><header><h1>ta ro</h1><nav><a href="/">ta</a> <a href="/b">ro</a></nav></header><main y><h2>{_T}</h2><p>{_S}</p>'
    f"<ul><li>{_T}</li><li>{_S}</li></ul><p>{_S * 3}</p></main><aside><h3>ta ro</h3><ul>{_links(4)}</ul></aside>"
    f"<footer><p>{_T}</p></footer></body>",
    f'<body n><div id="menu"><a href="/">ta</a><a href="/x">ro mi</a></div><div id="content" y><h1>{_T}</h1><div class="entry"><p>{_S}'
    f'</p><blockquote>{_S}</blockquote><p>{_S}</p></div><div class="comments" n><h3>ta</h3><div class="comment"><p>{_S}</p></div>'
    f'<div class="comment"><p>{_T}</p></div></div></div><div id="footer">{_T}<a href="/c">ta ro</a></div></body>',
    f'<body n><div class="cookie-notice"><p>{_T}</p><button>ta</button></div><div class="page"><div class="sidebar"><ul>{_links(5)}'
    f'</ul><p>{_T}</p></div><div class="post" y><h1>ta ro mi</h1><p>{_S}</p><p>{_S * 2}</p><form n><label>ta</label><input><p>{_T}</p>'
    f'<button>ro</button></form><p>{_S}</p></div></div><footer><ul>{_links(3)}</ul></footer></body>',
    f"<body n><header><p>{_T}</p></header><section y><article><h1>{_T}</h1><p>{_S}</p><table><tr><td>ta ro</td><td>mi le so</td></tr>"
    f'</table><p>{_S}</p></article></section><section id="comments"><h2>ta ro</h2><ol><li><p>{_S}</p></li><li><p>{_T}</p></li></ol>'
    f"</section><footer>{_T}</footer></body>",
    f'<body n><div class="banner">{_T}</div><ul class="nav">{_links(7)}</ul><div y><p>{_S}</p><p>{_S}</p><pre>ta ro mi</pre><p>{_T}</p>'
    f'<div class="advert" n><p>{_S}</p></div><p>{_S * 2}</p><div class="share" n><a href="/f">ta</a> <a href="/t">ro</a></div></div>'
    f'<div class="related"><h3>ta ro</h3><ul>{_links(4)}</ul></div><div class="footer"><p>{_T}</p></div></body>',
    f'<body n><nav>{_T}</nav><article y><header><h1>{_T}</h1><p>{_T}</p></header><p>{_S}</p><aside class="ad" n><p>{_S}</p></aside>'
    f"<h2>ta ro</h2><p>{_S}</p><p>{_T}</p></article><aside><p>{_S}</p></aside><form><p>{_T}</p><input></form><footer><p>{_S}</p>"
    f"</footer></body>",
    f'<body n><div class="newsletter"><form><p>{_T}</p><input></form></div><article class="post" y>{_S}<br>{_S}<p>{_T}</p><p>{_S}</p>'
    f'<div><p>{_S}</p></div></article><div class="notice">{_S}</div><div class="comment-list"><p>{_S}</p></div><footer>{_T}</footer></body>',
    f'<body n><div class="top"><a href="/">ta</a></div><p y>{_S}</p><p y>{_S}</p><h2 y>{_T}</h2><p y>{_S * 2}</p><div class="sponsor">{_T}'
    f'</div><p y>{_T}</p><div class="footer">{_T}</div></body>',
    f"<body n><article y><h1>{_T}</h1><p>{_S}</p><figure><figcaption>{_T}</figcaption></figure><p>{_S}</p>"
    f'<section class="reader-comments" n><div class="comment"><p>{_S}</p></div><div><p>{_T}</p></div></section></article>'
    f'<div role="navigation">{_T}<ul>{_links(5)}</ul></div></body>',
    f"<body n><nav>{_S * 3}</nav><article y><h1>ta</h1><p>{_T}</p><p>ro.</p></article><footer>{_S * 2}</footer></body>",
    f'<body n><div class="ads">{_S * 2}</div><article y><p>ta ro</p><div><p>{_T}</p></div></article><div class="side"><p>{_S}</p></div>',
    f"<body n><header>{_S}</header><main y><p>ro mi.</p><h2>ta</h2><p>{_S}</p><form n><p>{_S}</p></form></main><aside><p>{_S}</p></aside>",
    f'<body n><aside>{_S * 2}</aside><article y>ta ro mi<p>le so</p></article><div class="comments"><p>{_S * 2}</p><p>{_T}</p></div>',
    f'<body n><header>{_T}</header><div class="post-content" y><h1>ta</h1><p>{_T}</p><ul><li>ro</li><li>{_T}</li></ul></div>'
    f'<div class="user-comment"><div><p>{_S}</p></div></div><div id="cookies"><p>{_S}</p></div></body>',
]
