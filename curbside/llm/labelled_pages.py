"""Labelled pages from which the extraction model is trained.

``y=1`` marks an element as main text and ``y=0`` as surroundings; what lies inside inherits the mark, and elements
without a mark that hold no main text are surroundings. "Comments" and "Related stories" are headings that name surroundings. ``{S}`` stands for a paragraph, ``{T}`` for a short sentence, ``{W}`` for one to three words; each use draws another text.
"""

from __future__ import annotations

import random

_MENU = "<ul><li><a href=/a>{W}</a></li><li><a href=/b>{W}</a></li><li><a href=/c>{W}</a></li></ul>"

PAGES = [
    f"<body><nav>{_MENU}</nav><div class=ad>{{T}}</div><article y=1><h1>{{T}}</h1><p>{{S}}</p><p>{{W}}.</p><p>{{S}}</p></article><footer>{{T}}</footer></body>",
    f"<body><header><h2>{{W}}</h2>{_MENU}</header><main y=1><h1>{{T}}</h1><p>{{T}}</p><ul><li>{{T}}</li><li>{{S}}</li></ul><p>{{S}}</p></main><aside><h3>{{W}}</h3><p>{{S}}</p></aside><footer><p>{{S}}</p></footer></body>",
    f"<body><div id=header>{_MENU}</div><div id=wrapper><div class=content y=1><h2>{{T}}</h2><p>{{S}}</p><p>{{S}}</p><blockquote>{{T}}</blockquote></div><div class=sidebar><p>{{S}}</p>{_MENU}</div></div><div id=footer>{{T}}</div></body>",
    f"<body><div class=cookie-notice><p>{{S}}</p><button>{{W}}</button></div><div class=nav>{_MENU}</div><div class=post-body y=1><p>{{S}}</p><p>{{S}}</p><div class=advert y=0>{{S}}</div><p>{{S}}</p></div><div class=comments><h3>{{W}}</h3><div class=comment><p>{{S}}</p></div><div class=comment><p>{{S}}</p></div></div></body>",
    f"<body><nav>{_MENU}</nav><article y=1><h1>{{W}}</h1><p>{{T}}</p><aside y=0><p>{{T}}</p></aside><p>{{S}}</p><form y=0><label>{{W}}</label><p>{{T}}</p></form><p>{{W}}.</p><section id=comments y=0><h2>{{W}}</h2><article class=comment><p>{{S}}</p></article><p>{{T}}</p></section></article><footer>{{T}}</footer></body>",
    "<body><h1 y=1>{T}</h1><p y=1>{S}</p><p y=1>{S}</p><p y=1>{T}</p><hr><p class=footer>{T}</p></body>",
    f"<body><div class=top><div class=menu>{_MENU}</div></div><div><div><h1 y=1>{{T}}</h1><p y=1>{{S}}</p><p y=1>{{S}}</p><p y=1>{{S}}</p></div></div><div class=newsletter><p>{{T}}</p></div><div class=related>{_MENU}</div></body>",
    f"<body><header><p>{{T}}</p></header><section class=story y=1><h2>{{T}}</h2><p>{{S}}</p><table><tr><td>{{W}}</td><td>{{T}}</td></tr><tr><td>{{W}}</td><td>{{W}}</td></tr></table><pre>{{S}}</pre><p>{{S}}</p></section><div class='banner promo'>{{S}}</div><div role=navigation>{_MENU}</div></body>",
    f"<body><nav>{_MENU}</nav><div class=notice><p>{{S}}</p></div><article y=1><header y=0><p>{{T}}</p></header><h1>{{T}}</h1><div><p>{{S}}</p><p>{{T}}</p></div><div class=share y=0>{_MENU}</div><ol><li>{{S}}</li><li>{{W}}</li></ol><footer y=0><p>{{T}}</p></footer></article></body>",
    f"<body><div class=page><div class=breadcrumbs>{_MENU}</div><div class=entry-content y=1><p>{{S}}</p><h3>{{W}}</h3><p>{{T}}</p><dl><dt>{{W}}</dt><dd>{{S}}</dd></dl></div><div class=widget><h4>{{W}}</h4><p>{{T}}</p></div><div class=login><form><p>{{T}}</p></form></div></div><footer>{_MENU}<p>{{S}}</p></footer></body>",
    "<body><main y=1><article><h1>{W}</h1><p>{W}</p><p>{S}</p></article><div class=sponsored y=0><p>{S}</p></div><div class='user-comments' y=0><ul><li><p>{S}</p></li><li>{S}</li></ul></div></main><div class=popup><p>{S}</p></div></body>",
    f"<body><div id=banner>{{T}}</div><div id=main y=1><h1>{{T}}</h1><p>{{S}} <a href=/x>{{W}}</a> {{S}}</p><p>{{S}}</p><figure><figcaption>{{T}}</figcaption></figure><p>{{W}}.</p></div><div id=sidebar><p>{{S}}</p><p>{{T}}</p></div><div id=copyright>{{T}}</div></body>",
    f"<body><nav>{_MENU}</nav><article y=1><h1>{{W}}</h1><p>{{W}}</p></article><footer>{{S}}</footer></body>",
    "<body><article y=1><h1>{T}</h1><p>{S} <span class=ad y=0>{T}</span> {S}</p><p>{S} <em class=term>{W}</em> {S} <a class=share href=/s y=0>{W}</a></p><p><span class=text>{S}</span></p><p>{T}</p></article><footer>{T}</footer></body>",
    "<body><main y=1><h1>{T}</h1><p>{S}</p><h2>{W}</h2><p>{S} <small class=sponsored y=0>{S}</small></p><p>{S}</p></main><section y=0><h2>Comments</h2><p>{S}</p><p>{S}</p><ol><li>{S}</li></ol></section></body>",
    "<body><div class=wrap><div y=1><h1>{T}</h1><p>{S}</p><p>{S}</p><p><b class=lead>{T}</b> {S}</p></div><div y=0><h3>Related stories</h3><p>{T}</p><p>{S}</p></div></div><div class=footer><p>{T} <span class=copyright>{W}</span></p></div></body>",
    f"<body><div class=layout><aside>{_MENU}<p>{{S}}</p></aside><div y=1><p>{{S}}</p><p>{{S}}</p><p>{{S}}</p></div></div><div class=legal><p>{{S}}</p></div></body>",
]


def labelled_pages(repeats: int = 6, seed: int = 7) -> list[str]:
    """Every page ``repeats`` times, each time with other texts."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice("aeioulnrstmdh") for _ in range(rng.randint(2, 9)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(rng.randint(lo, hi)))

    def paragraph() -> str:
        return " ".join(f"{words(3, 9).capitalize()}, {words(2, 9)}." for _ in range(rng.randint(1, 6)))

    out = []
    for page in PAGES * repeats:
        for mark, draw in (("{S}", paragraph), ("{T}", lambda: words(3, 11).capitalize() + "."), ("{W}", lambda: words(1, 3).capitalize())):
            while mark in page:
                page = page.replace(mark, draw(), 1)
        out.append(page)
    return out
