"""SQL expressions that rewrite the given tables, valid in Spark and in DuckDB.

They add what the generated tables lack (roles, media, feeds, links between
pages, URLs in text) to every row, as functions of the row itself.
"""

ID = "CAST(page_id AS VARCHAR(20))"
H1 = "regexp_extract(html, '<h1>(.*?)</h1>', 1)"
ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"


def _in_article(markup: str) -> str:
    return f"replace(html, '<article>', concat('<article>', {markup}))"


CONTENT_TYPE = (
    "CASE page_id % 5 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'application/xhtml+xml' "
    "WHEN 2 THEN 'application/rss+xml' WHEN 3 THEN 'application/json' ELSE 'image/png' END"
)

WITH_ROLES = _in_article(
    f"'<div role=\"Navigation\"><p>Go ', {ID}, '<i>on</i></p></div><section role=\"main\"><u>kept</u></section>"
    "<div role=\"contentinfo\"><em>gone</em></div>'"
)

WITH_CLASSES = _in_article(
    f"'<div class=\"left Sidebar-', {ID}, '\"><p><i>gone</i></p></div><h2 class=\"read-more\">gone</h2>"
    "<section id=\"site-menu\"><u>gone</u></section><h3 class=\"ad\">kept</h3><h4 class=\"navy\">kept</h4>'"
)

# odd pages lose their article and offer two weaker candidates
WITH_MAIN = (
    "CASE WHEN page_id % 2 = 0 THEN html ELSE replace(replace(html, '<article>', "
    f"concat('<div class=\"x content\">low ', {ID}, '</div><div id=\"content\">high ', {ID}, '</div><div>')), "
    "'</article>', '</div>') END"
)

WITH_LINKS = _in_article(
    f"'Visit <a href=\"/a\"> the <b>page</b> ', {ID}, '</a> now<a href=\"/b\"> </a>"
    "<a href=\"/c\">one<a href=\"/d\">two</a></a>'"
)

# only blocks count in structured text; a paragraph in an item shows twice
WITH_BLOCKS = _in_article(
    f"'<h2> Part ', {ID}, ' </h2>loose<ul><li>item <p>in <b>side</b></p></li></ul>'"
)

AS_FEED = (
    "concat('<?xml version=\"1.0\"?><rss version=\"2.0\"><channel><title>Feed</title>', "
    f"CASE WHEN page_id % 3 = 0 THEN concat('<description>Nothing in ', {ID}, '</description>') ELSE "
    f"concat('<item><title>', {H1}, '</title><link>http://feed.example.com/1</link>"
    f"<description><![CDATA[<p>', {ARTICLE}, '</p> <p>more ', {ID}, '</p>]]></description></item>"
    f"<item><description>plain ', {ID}, '</description><title>Second</title>"
    "<content:encoded><![CDATA[x <b>y</b>]]></content:encoded></item>') END, '</channel></rss>')"
)

SOME_FEEDS = f"CASE WHEN page_id % 4 = 0 THEN {AS_FEED} ELSE html END"

WITH_GAPS = "concat('  ', replace(text, ' ', '   '), chr(10), ' ', chr(10), chr(10), 'end  ')"

WITH_URLS = (
    "concat('(http://a.example.com/', CAST(doc_id AS VARCHAR(20)), ') ', text, "
    "' (see https://b.example.com/x?y=1#z) and [www.c.org] or ftp://d.example.net/e  ( )')"
)

# role, class, link, URL and excluded element in the article of every page
WITH_ALL = _in_article(
    f"'<div role=\"banner\">gone</div><p class=\"social-x\">gone</p><p>See <a href=\"/n\">note ', {ID}, "
    "'</a> (http://e.example.com/q) here</p><form>gone</form>'"
)

URL_VARIANTS = (
    "CASE page_id % 4 WHEN 0 THEN url "
    f"WHEN 1 THEN concat('HTTP://User@Host:8080/a;b/c', {ID}, ';p=1?q=1&r=/2#f?g', url) "
    f"WHEN 2 THEN concat('https://h', {ID}, '.example.com?only=', url) ELSE concat(url, '#') END"
)

HREFS = f"array('/x', concat('c', {ID}, '.html'), '//host/x', 'http://h.example.org/y', 'HTTP://h/x', 'tel:1')"

URL_QUERIES = (
    f"CASE page_id % 3 WHEN 0 THEN concat('http://h/p', {ID}, ';v=1?a=b c&k=*~%20&e=#top') "
    f"WHEN 1 THEN concat('https://h/p', {ID}, '?flag') ELSE concat('https://h/p', {ID}) END"
)

MORE_LINKS = _in_article(
    f"'<a href=\" /p', {ID}, '?a=1#frag \">x</a><a href=\"http://other.example.org/z\">y</a><a href=\"#t\">t</a>"
    "<a href=\"mailto:a@b.c\">m</a><a>no</a><a href=\"next.html;v=2\">r</a>'"
)

# a site of pages on three hosts: page k of a host links to pages 2k+1, 2k+2
# and back to its parent, next to the word links it has already
SITE_URL = f"concat('http://site', CAST(page_id % 3 AS VARCHAR(20)), '.example.com/p/', {ID})"
_K = "CAST(floor(page_id / 3) AS BIGINT)"
SITE_HTML = _in_article(
    f"'<a href=\"/p/', CAST(3 * (2 * {_K} + 1) + page_id % 3 AS VARCHAR(20)), '\">a</a>"
    f"<a href=\"/p/', CAST(3 * (2 * {_K} + 2) + page_id % 3 AS VARCHAR(20)), '#x\">b</a>"
    f"<a href=\"/p/', CAST(3 * CAST(floor(({_K} - 1) / 2) AS BIGINT) + page_id % 3 AS VARCHAR(20)), '\">up</a>"
    "<a href=\"http://away.example.org/\">out</a>'"
)
SITE_SEEDS = ["http://site0.example.com/p/0", "http://site1.example.com/p/1", "http://site2.example.com/p/2"]

WITH_MEDIA = _in_article(
    f"'<img src=\"/i/p', CAST(page_id % 50 AS VARCHAR(20)), '.png\"><img data-src=\"d', {ID}, '.jpg?w=1\" "
    "srcset=\"/s/1.png 1x, /s/two 2x,\"><img src=\"\"><picture><source srcset=\" /w/', "
    f"{ID}, '.webp 1x, /no.png\"><img src=\"http://cdn.example.org/x.y/logo.GIF\"></picture>"
    f"<video src=\"/v/', {ID}, '.mp4\"><source src=\"v2.webm\"><source></video>"
    "<audio><source src=\"/a/.hidden\"><source src=\"/a/end.\"><source src=\"/a/s.ogg\"></audio>'"
)

WITH_FACTS = (
    "CASE doc_id % 4 WHEN 0 THEN concat('The Royal Society Of London met 35% of 1,200 people. ', text) "
    "WHEN 1 THEN concat(text, ' the average rate') WHEN 2 THEN concat('extraordinarily ', text, ' a1 2b') "
    "ELSE text END"
)

WITH_RESEARCH = (
    "CASE doc_id % 5 WHEN 0 THEN concat('Researchers found that ', text) "
    "WHEN 1 THEN concat(text, ' According to  the study, data shows evidence suggests it was published in 1999.') "
    "WHEN 2 THEN concat(text, ' 40') ELSE text END"
)

WITH_NOISE = (
    "concat(text, CASE doc_id % 4 WHEN 0 THEN concat(chr(10), ' Top 10', chr(10), '42 ', chr(10), 'Morello') "
    "WHEN 1 THEN concat(chr(10), '12 January 5, 2024', chr(10), chr(10), 'a/rss/b', chr(10), 'next page') "
    "WHEN 2 THEN concat(chr(10), 'view all | home') ELSE '' END)"
)

AS_PARAGRAPHS = "replace(text, chr(10), concat(chr(10), ' ', chr(10)))"
