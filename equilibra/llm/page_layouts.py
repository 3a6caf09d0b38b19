"""Labelled page layouts for fitting the extraction model.

Each layout is a page skeleton in which ``<!--main-->`` and ``<!--/main-->``
enclose the article.  Slots are filled with texts of sampled pages: ``{h}`` a
heading, ``{p}`` paragraphs, ``{li}`` list items, ``{links}`` a list of links,
``{s}`` one short text, ``{t}`` one sentence.
"""

from __future__ import annotations

_HEAD = "<!DOCTYPE html><html><head><title>{s}</title><style>.x{{color:red}}</style><script>var a='</div>';</script></head><body>"
_END = "</body></html>"

LAYOUTS = tuple(_HEAD + x + _END for x in (
    "<nav><ul>{links}</ul></nav><div class=\"ad\">{t}</div><!--main--><article><h1>{h}</h1>{p}</article><!--/main--><footer>&copy; {s} &middot; {t}</footer>",
    "<header><a href=\"/\">{s}</a><p>{t}</p></header><nav>{inline}</nav><main><!--main--><h1>{h}</h1>{p}<h2>{s}</h2>{p}<!--/main--></main><aside><h3>{s}</h3><p>{t}</p><ul>{links}</ul></aside><footer><p>{t}</p>{inline}</footer>",
    "<div id=\"header\"><div class=\"logo\">{s}</div><div class=\"tagline\">{t}</div></div><div id=\"menu\"><ul>{links}</ul></div><div id=\"content\"><!--main--><h1>{h}</h1>{p}<ul>{li}</ul>{p}<!--/main--></div><div id=\"sidebar\"><h3>{s}</h3><p>{t}</p><ul>{links}</ul></div><div id=\"footer\">{t}</div>",
    "<div class=\"cookie-notice\"><p>{t}</p><button>{s}</button></div><div class=\"navbar\">{inline}</div><div class=\"post\"><!--main--><h1 class=\"post-title\">{h}</h1><div class=\"post-body\">{p}<blockquote>{t}</blockquote>{p}</div><!--/main--><div class=\"share\">{inline}</div></div><div class=\"comments\"><h3>{s}</h3><div class=\"comment\"><p>{t}</p></div><div class=\"comment\"><p>{t}</p></div></div><div class=\"site-footer\">{t}</div>",
    "<header class=\"site-header\"><h2>{s}</h2><nav>{inline}</nav></header><section class=\"article-body\"><!--main--><h1>{h}</h1>{p}{p}<!--/main--></section><section id=\"comments\"><h2>{s}</h2><ol><li><p>{t}</p></li><li><p>{t}</p></li></ol><form><label>{s}</label><textarea>{t}</textarea><button>{s}</button></form></section><footer><ul>{links}</ul><p>{t}</p></footer>",
    "<table><tr><td class=\"left\"><ul>{links}</ul></td><td class=\"main\"><!--main--><h1>{h}</h1>{p}<table><tr><td>{s}</td><td>{s}</td></tr></table>{p}<!--/main--></td><td class=\"right\"><div class=\"advert\">{t}</div></td></tr></table><div class=\"copyright\">&copy; {t}</div>",
    "<div class=\"banner\"><p>{t}</p></div><ul class=\"breadcrumb\">{links}</ul><div class=\"entry-content\"><!--main--><h1>{h}</h1>{p}<!--/main--><div class=\"ad-slot\"><p>{t}</p></div><!--main-->{p}<!--/main--></div><div class=\"related\"><h3>{s}</h3><ul>{links}</ul></div><div class=\"newsletter\"><form><p>{t}</p><input type=\"text\"><button>{s}</button></form></div><footer>{t}</footer>",
    "<div role=\"banner\"><p>{t}</p></div><div role=\"navigation\">{inline}</div><div role=\"main\"><!--main--><h1>{h}</h1>{p}<h2>{s}</h2>{p}<pre>{t}</pre><!--/main--></div><div role=\"complementary\"><p>{t}</p><p>{t}</p></div><div role=\"contentinfo\"><p>{t}</p></div>",
    "<nav class=\"menu\"><a href=\"#\">{s}</a><a href=\"#\">{s}</a></nav><article class=\"story\"><!--main--><h1>{h}</h1>{p}<figure><img src=\"a.png\"><figcaption>{t}</figcaption></figure>{p}<!--/main--><aside class=\"promo\"><p>{t}</p></aside><!--main-->{p}<!--/main--></article><div class=\"reader-comments\"><p>{t}</p><p>{t}</p><p>{t}</p></div><footer class=\"footer\"><p>{t}</p></footer>",
    "<div class=\"top\"><span>{s}</span><form action=\"/search\"><input><button>{s}</button></form></div><div class=\"wrapper\"><div class=\"nav\"><ul>{links}</ul></div><div class=\"text\"><!--main--><h1>{h}</h1>{p}{p}<!--/main--></div><div class=\"widget\"><h4>{s}</h4><p>{t}</p></div></div><div class=\"notice\"><p>{t}</p></div><div class=\"bottom\">{inline}</div>",
    "<div class=\"alert notice\"><p>{t}</p></div><div class=\"container\"><!--main--><h1>{h}</h1>{p}<ol>{li}</ol>{p}<!--/main--><div class=\"sponsored\"><p>{t}</p></div><div class=\"author-bio\"><p>{t}</p></div></div><div class=\"disqus comment-list\"><div><p>{t}</p></div><div><p>{t}</p></div></div><footer><small>&copy; {s}</small></footer>",
    "<header><h1>{s}</h1></header><main><!--main--><article><h2>{h}</h2>{p}</article><!--/main--><section class=\"comments-area\"><article class=\"comment\"><p>{t}</p></article><article class=\"comment\"><p>{t}</p></article></section></main><aside class=\"sidebar\"><section><h3>{s}</h3><p>{t}</p></section></aside><footer>{t}</footer>",
    "<div><a href=\"/\">{s}</a> {inline}</div><!--main--><h1>{h}</h1>{p}{p}{p}<!--/main--><hr><div>&copy; {s} {inline}</div>",
    "<div class=\"modal popup\"><p>{t}</p></div><div class=\"masthead\">{t}</div><div class=\"page\"><div class=\"content\"><!--main--><h1>{h}</h1><div>{p}</div><h3>{s}</h3><div>{p}</div><!--/main--></div><div class=\"side\"><p>{t}</p>{inline}</div></div><form class=\"login\"><p>{t}</p><label>{s}</label></form><div class=\"legal\"><p>{t}</p></div>",
))
