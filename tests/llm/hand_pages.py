"""Pages written by hand, from no generator: (name, html, main text)."""

P = "The river rose in the night, and by morning the lower fields were under water. Nobody had expected it, least of all the farmers."
Q = "It took the council three weeks to agree on a new dam, and another two before the first stone was laid in the mud."
R = "Since then, the meadows have been dry every spring; the herons, though, have not come back."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact us</a></li></ul></nav>'
END = '<footer><p>&copy; 2024 The Valley Times. All rights reserved.</p></footer>'

PAGES = [
    ("list with a link", f"<article><h1>T</h1><p>{P}</p><ul><li>one thing</li><li>two <a href=x>link</a></li><li>three things</li></ul><p>{Q}</p></article>", f"T\n\n{P}\n\none thing\n\ntwo link\n\nthree things\n\n{Q}"),
    ("comments without names", f"<body><article><h1>T</h1><p>{P}</p><p>{Q}</p></article><section><h3>Comments</h3><ul><li><p>Nice one, thanks.</p></li><li><p>I do not agree.</p></li></ul></section></body>", f"T\n\n{P}\n\n{Q}"),
    ("comments within the article", f"<article><h1>T</h1><p>{P}</p><p>{Q}</p><section><h3>Comments</h3><ul><li><p>Nice one, thanks.</p></li><li><p>I do not agree.</p></li></ul></section></article>", f"T\n\n{P}\n\n{Q}"),
    ("footer without a name", f"<body><p>{P}</p><p>{Q}</p><div>All rights reserved</div></body>", f"{P}\n\n{Q}"),
    ("hidden parts", f'<article><p>{P}</p><div hidden><p>secret words here</p></div><p style="display: none">x</p><p aria-hidden="true">y</p><p>{Q}</p></article>', f"{P}\n\n{Q}"),
    ("a news page", f"<html><body><header><h1>The Valley Times</h1></header>{NAV}<main><article><h1>Flood</h1><p>{P}</p><p>{Q}</p><p>{R}</p></article></main><aside><h3>Popular</h3><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></aside>{END}</body></html>", f"Flood\n\n{P}\n\n{Q}\n\n{R}"),
    ("paragraphs as divs", f'<div class="page">{NAV}<div class="story"><div>{P}</div><div>{Q}</div><div>{R}</div></div>{END}</div>', f"{P}\n\n{Q}\n\n{R}"),
    ("a cookie notice", f'<body><div class="cookie-consent"><p>We use cookies to make this site better.</p><button>OK</button></div><article><h1>T</h1><p>{P}</p><p>{Q}</p></article></body>', f"T\n\n{P}\n\n{Q}"),
    ("an advert in the text", f'<article><p>{P}</p><div class="ad-slot"><a href="/buy">Buy boots, half price today only</a></div><p>{Q}</p><p>{R}</p></article>', f"{P}\n\n{Q}\n\n{R}"),
    ("a bare page", f"<p>{P}</p><p>{Q}</p><p>{R}</p>", f"{P}\n\n{Q}\n\n{R}"),
    ("quote and code", f"<article><h1>T</h1><p>{P}</p><blockquote><p>{Q}</p></blockquote><pre>a  =  1\nb = 2</pre><p>{R}</p></article>", f"T\n\n{P}\n\n{Q}\n\na = 1 b = 2\n\n{R}"),
    ("character references and scripts", "<article><h1>Tom &amp; Ann</h1><script>var a = '<p>no</p>';</script><style>p{}</style><p>5 &lt; 6 &#233; caf&eacute;, and " + P + "</p><noscript>turn it on</noscript></article>", "Tom & Ann\n\n5 < 6 é café, and " + P),
    ("a newsletter form", f"<article><h1>T</h1><p>{P}</p><form><label>Your address</label><input name=q><button>Send</button></form><p>{Q}</p></article>", f"T\n\n{P}\n\n{Q}"),
    ("headings in an article", f"<article><h1>T</h1><p>{P}</p><h2>The dam</h2><p>{Q}</p><h3>The birds</h3><p>{R}</p></article>", f"T\n\n{P}\n\nThe dam\n\n{Q}\n\nThe birds\n\n{R}"),
    ("a sidebar of links", f'<div><div class="sidebar"><h4>Archives</h4><ul><li><a href=a>May</a></li><li><a href=b>June</a></li></ul></div><div class="content"><h1>T</h1><p>{P}</p><p>{Q}</p></div></div>', f"T\n\n{P}\n\n{Q}"),
    ("share buttons", f'<article><h1>T</h1><div class="share"><a href=x>Facebook</a> <a href=y>Mail</a></div><p>{P}</p><p>{Q}</p></article>', f"T\n\n{P}\n\n{Q}"),
    ("text around inline marks", f"<article><p>{P} <b>Bold</b>, <i>and</i> <a href=x>linked</a>words.</p><p>{Q}</p></article>", f"{P} Bold, and linkedwords.\n\n{Q}"),
    ("unclosed paragraphs", f"<article><h1>T</h1><p>{P}<p>{Q}<p>{R}</article>", f"T\n\n{P}\n\n{Q}\n\n{R}"),
    ("a table of figures", f"<article><h1>T</h1><p>{P}</p><table><tr><td>1901</td><td>3 m</td></tr><tr><td>1954</td><td>4 m</td></tr></table><p>{Q}</p></article>", f"T\n\n{P}\n\n1901\n\n3 m\n\n1954\n\n4 m\n\n{Q}"),
    ("nothing but a menu", f"<html><body>{NAV}{END}</body></html>", ""),
    ("a blog without names", f"<body><div><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></div><div><h1>T</h1><p>{P}</p><p>{Q}</p><p>{R}</p></div><div>Copyright 2023</div></body>", f"T\n\n{P}\n\n{Q}\n\n{R}"),
]
