import hashlib
import os
import random
import re
import time
from collections import Counter, defaultdict
from html import unescape

from tarnlake.llm import html, warc

BIG = "<p>" + "long payload é " * 90
ODD = [(-1, "http://a.example/x", None), (-2, None, ""), (-3, "http://a.example/y", "short"), (-4, "http://a.example/y", "short"), (-5, "u", BIG), (-6, "u", BIG), (-7, "v", BIG), (-8, "v\r\nX: 1", BIG + "!"), (None, "n", BIG), (-9, "r", "same"), (-9, "r", "same")]


def with_odd(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    return pages.unionByName(spark.createDataFrame(ODD, "page_id long, url string, html string"))


def test_warc_round_trip(spark, sf):
    pages = with_odd(spark, sf)
    groups = defaultdict(list)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    for p, b in rows:
        groups[b].append(p)
    want = Counter()
    for p, b in rows:
        top = max((x for x in groups[b] if x is not None), default=None)
        revisit = len(b) >= 1000 and p != top
        want[(p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None)] += 1
    assert Counter(map(tuple, warc.archive_round_trip(pages).collect())) == want
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_without_dictionary(spark):
    pages = spark.createDataFrame(ODD[:3], "page_id long, url string, html string")
    assert warc.train_dictionary(pages) == b""
    assert warc.archive_round_trip(pages).count() == 3


def test_dictionary_is_embedded(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    d = warc.train_dictionary(pages)
    assert d
    uri = warc.write_archives(pages.coalesce(1), f"file://{tmp_path}", d).first()["uri"]
    raw = open(uri.removeprefix("file://"), "rb").read()
    assert raw[:4] == b"\x5d\x2a\x4d\x18" and raw[8 : 8 + len(d)] == d
    assert b"\x28\xb5\x2f\xfd" == raw[8 + len(d) : 12 + len(d)]


def article(h):
    body = re.sub(r"<br>", " ", re.search(r"<article>(.*)</article>", h, re.S)[1])
    blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(x for x in blocks if x)


def test_articles_of_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: (r.url, article(r.html)) for r in pages.collect()}
    got = html.extract(pages).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (*want[r.page_id], len(want[r.page_id][1]))


def test_differencing_without_declared_content(spark):
    shell = "<div>Welcome to the site</div><div>Today: {0}</div><p>{1}</p><p>Mail us</p>"
    rows = [(k, f"http://h.example/news/{k}", shell.format(k, f"Story {k} text")) for k in range(5)]
    rows += [(7, "http://other.example/", shell.format(7, "Alone")), (8, "http://copy.example/a", "<p>one</p>"), (9, "http://copy.example/b", "<p>one</p>")]
    rows += [(10, None, None), (11, "", "x &amp; y"), (12, "no host", "<p>z</p><p>z</p>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(5):
        assert got[k] == f"Today: {k}\n\nStory {k} text"
    assert got[7] == "Welcome to the site\n\nToday: 7\n\nAlone\n\nMail us"
    assert (got[8], got[9], got[10], got[11], got[12]) == ("one", "one", "", "x & y", "z\n\nz")


def test_copies_and_nearest_page(spark):
    """A run of copies is compared with the page beside it, and a page with the closer of its neighbours."""
    kind = "page_id long, url string, html string"
    shell = "<div>Our site</div><p>{0}</p><p>Mail us</p>"
    rows = [(k, f"http://h.example/a/{k}", shell.format("Same story")) for k in range(6)] + [(9, "http://h.example/b", shell.format("Other story"))]
    # by path: /a/1, /b/1, /b/2, /c/1; /b/1 and /b/2 are the closest, and share a section's line
    urls = {20: "/a/1", 21: "/b/1", 22: "/b/2", 23: "/c/1"}
    rows += [(k, f"http://n.example{u}", f"<p>Site</p><p>Section {u[1]}</p><p>Text {k}</p>") for k, u in urls.items()]
    # all lines of 30 stand in the closer page 31, which leaves them to the page before; all of 41 in both
    rows += [(29, "http://s.example/a", "<p>Site</p><p>x</p>"), (30, "http://s.example/b1", "<p>Site</p><p>Body</p>"), (31, "http://s.example/b2", "<p>Site</p><p>Body</p><p>More</p>")]
    rows += [(40, "http://t.example/a", "<p>Site</p><p>x</p>"), (41, "http://t.example/b", "<p>Site</p>"), (42, "http://t.example/c", "<p>Site</p><p>y</p>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, kind)).collect()}
    assert [got[k] for k in range(6)] == ["Same story"] * 6 and got[9] == "Other story"
    assert [got[k] for k in urls] == ["Section a\n\nText 20", "Text 21", "Text 22", "Section c\n\nText 23"]
    assert (got[29], got[30], got[31], got[40], got[41], got[42]) == ("x", "Body", "More", "x", "", "y")


def test_body_beside_a_teaser(spark):
    """A teaser card or a class name that declares content decides its own lines only, not the plain ones."""
    for card in ("<article><p>Read next</p></article>", '<div class="post-content">Read next</div>', "<main><p>Read next</p></main>"):
        shell = "<div>Our site</div><nav>menu {0}</nav><div><p>Body {0} one</p><p>Body {0} two</p></div>" + card + "<p>Mail us</p>"
        rows = [(k, f"http://h.example/{k}", shell.format(k)) for k in range(4)] + [(9, "http://alone.example/", shell.format(9))]
        got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert [got[k] for k in range(4)] == [f"Body {k} one\n\nBody {k} two\n\nRead next" for k in range(4)]
        assert got[9] == "Our site\n\nBody 9 one\n\nBody 9 two\n\nRead next\n\nMail us"


def test_zones():
    page = """<html><body class="has-sidebar"><header>Site</header><div id="cookie-notice">We use</div><article><header><h1>T</h1></header>
    <p>Hello <b>big</b>&nbsp;world<p>Second<ul><li>one<li>two</ul><form>f</form><aside>s</aside><section class="comments"><p>c</p></section>
    <script>if(a<b)"</p>"</script><!-- <p>no</p> --></article><div class="ad">buy</div><footer>x</footer>"""
    assert [x for x in html.page_lines(page) if x[1] != html.CHROME] == [("T", 1), ("Hello big world", 1), ("Second", 1), ("one", 1), ("two", 1)]
    assert html.page_lines('a < b <i title="x>y">c</i><a href="open>d</a>') == [("a < b cd", 0)]
    assert html.page_lines("<p>" * 20000 + "x") == [("x", 0)]


def test_chrome_by_class_and_role():
    for mark in ('class="user-comments"', 'id="commentlist"', 'class="siteNav topnav"', 'class="alert alert-info"', 'role="search"', 'class="cookieBar"', "style='display: none'", "hidden", 'aria-hidden="true"'):
        page = f"<main><p>a</p><div {mark}><p>gone</p><div>too</div></div><p>b</p></main>"
        assert [x for x, z in html.page_lines(page) if z != html.CHROME] == ["a", "b"], mark
    for mark in ('class="lead"', 'class="headline"', 'class="adapter"', 'data-ad="1"', 'class="caption"'):
        assert ("kept", 1) in html.page_lines(f"<main><div {mark}>kept</div></main>"), mark


def test_names_that_hint_inside_an_article(spark):
    """Inside an article they go only where the nearest page has the same lines; math is text."""
    shell = """<article><h1>T{0}</h1><p class="share">Share this</p><p class="share">share of {0}</p><div class="related-work"><p>related {0}</p></div>
    <h2 id="search">Search {0}</h2><p>let <math><mi>x</mi><mo>=</mo><mn>{0}</mn><annotation>x={0}</annotation></math> be</p><div class="comments">c{0}</div></article>"""
    rows = [(k, f"http://h.example/{k}", shell.format(k)) for k in range(3)] + [(9, "http://alone.example/", shell.format(9))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in (0, 1, 2, 9):
        share = ["Share this"] if k == 9 else []
        assert got[k].split("\n\n") == [f"T{k}", *share, f"share of {k}", f"related {k}", f"Search {k}", f"let x={k} be"]


def test_differencing_decides(spark, sf, monkeypatch):
    """With sharing turned off, texts change: by differencing alone on the table, by default on pages without an article."""
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    plain = [(k, f"http://h.example/{k}", f"<div>Site</div><p>Text {k}</p>") for k in range(4)]
    plain = spark.createDataFrame(plain, "page_id long, url string, html string")
    texts = lambda df, zones: {r.page_id: r.text for r in html.extract(df, zones).collect()}
    by_lines, by_default = texts(pages, False), texts(plain, True)
    hosts = defaultdict(list)
    for r in pages.collect():
        hosts[r.url.split("/")[2]].append((re.sub(r"[?#].*", "", "/" + r.url.split("/", 3)[3]), r.page_id, [x for x, _ in html.page_lines(r.html)]))
    changed = 0
    for group in hosts.values():
        group.sort()
        for i, (path, page_id, lines) in enumerate(group):
            near = [group[j] for j in (i - 1, i + 1) if 0 <= j < len(group)]
            near.sort(key=lambda g: -len(os.path.commonprefix([g[0], path])))
            for _, _, other in near:  # brute force: the nearest page that leaves something
                left = [x for k, x in enumerate(lines) if k not in html.common_lines(lines, other)[0]]
                if left:
                    break
            want = left if near else lines
            assert by_lines[page_id] == "\n\n".join(want)
            changed += want != lines
    assert changed > 10 and by_default == {k: f"Text {k}" for k in range(4)}


def test_hostile_markup_is_linear():
    """A megabyte each; tags, quotes, comments and elements that never close."""
    pieces = ["<a ", "<a \"'>", "<a =\"'>", '<a b="1 ', "<!x", "<", "<p>", "<ul>", "<i><div>", "&#", "</script ", "<svg>", "<b></i>"]
    for piece in pieces:
        page = piece * (1_000_000 // len(piece))
        began = time.process_time()
        html.page_lines(page)
        assert time.process_time() - began < (1 if piece == "<a " else 10), piece
    assert html.page_lines("<a " * 3 + "x") == [("<a <a <a x", 0)]


def test_common_lines_is_longest():
    rnd = random.Random(2)

    def dp(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        mine, other = html.common_lines(a, b)
        assert len(mine) == len(other) == dp(a, b)
        assert [a[i] for i in sorted(mine)] == [b[j] for j in sorted(other)]


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_lines_of_long_pages():
    """More than two million matches: own '0' cells, then a shared footer among other '0' cells."""
    rnd = random.Random(4)
    footer = [f"f{k}" for k in range(60)]
    mixed = lambda n: sum(([f] + ["0"] * rnd.randint(0, n) for f in footer), [])
    a, b = ["own"] + ["0"] * 1400 + mixed(3) + ["end"], ["menu"] + ["0"] * 1600 + mixed(5)
    assert a.count("0") * b.count("0") > 2_000_000
    mine, other = html.common_lines(a, b)
    assert [a[i] for i in sorted(mine)] == [b[j] for j in sorted(other)]
    assert len(mine) == lcs_length(a, b)


def test_common_lines_cut_in_two():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randint(0, 40))] for _ in range(2))
        for bits in (1, 50, 300):
            mine, other = html.common_lines(a, b, bits)
            assert len(mine) == len(other) == lcs_length(a, b)
            assert [a[i] for i in sorted(mine)] == [b[j] for j in sorted(other)]


def test_extract_empty(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
