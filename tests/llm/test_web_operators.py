import hashlib
import math
import os
import random
import time
from collections import Counter

import pytest

from skyquilt.llm import html as H
from skyquilt.llm import queries
from skyquilt.llm import quotes as T
from skyquilt.llm import urlfilter as U


# quotations


def conversation(spark, rows):
    return spark.createDataFrame([(*r, "spare") for r in rows], "conv_id long, turn long, role string, text string, position string")


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there\nhow are you"), (1, 1, "a", "> Hello there\n> how are you\nFine"), (1, 2, "u", "New topic\n\nsecond  para"), (1, 3, "a", "Bob wrote:\n>> hello   THERE\n> fine\nok"),
        (1, 4, "a", "> second para\nyes"), (1, 5, "u", "> yes\n>> second para\ngood\n> unknown"), (1, 6, "u", "> hello there\n> and more"), (2, 0, "u", "> Fine"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in T.reply_ordered(conversation(spark, rows)).collect()}
    assert [got[1, t]["parent_turn"] for t in range(7)] == [None, 0, None, 1, 2, 4, 0]
    assert [got[1, t]["root_turn"] for t in range(7)] == [0, 0, 2, 0, 2, 2, 0]
    assert [t for t in sorted(range(7), key=lambda t: got[1, t]["position"])] == [0, 1, 3, 6, 2, 4, 5]
    assert got[1, 3]["body"] == "ok" and got[1, 3]["n_quotes"] == 2 and got[1, 5]["n_linked"] == 2 and got[2, 0]["n_linked"] == 0 and got[2, 0]["body"] == ""


def test_quotes_against_brute_force(spark):
    rng = random.Random(5)
    rows, parent = [], {}
    for c in range(12):
        for t in range(25):
            if t and rng.random() < 0.6:
                p = rng.randrange(t)
                parent[c, t] = p
                rows.append((c, t, "u", f"> own text {c} {p} z\n\nown text {c} {t} z"))
            else:
                rows.append((c, t, "u", f"own text {c} {t} z"))
    got = {(r["conv_id"], r["turn"]): r for r in T.reply_ordered(conversation(spark, rows)).collect()}

    def root(c, t):
        while (c, t) in parent:
            t = parent[c, t]
        return t

    for c in range(12):
        order = sorted(range(25), key=lambda t: (root(c, t), t))
        for t in range(25):
            r = got[c, t]
            assert (r["parent_turn"], r["root_turn"], r["position"], r["body"]) == (parent.get((c, t)), root(c, t), order.index(t), f"own text {c} {t} z")


def test_quotes_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "u", ""), (1, 0, "u", "same"), (1, 0, "u", "same"), (1, 1, "a", "> same\n" * 3000 + "x"), (1, 2, "a", ">>>> \n>\n>> deep")]
    got = T.reply_ordered(conversation(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(r["position"] for r in got if r["conv_id"] == 1) == [0, 1, 2, 3]
    assert next(r for r in got if r["conv_id"] == 1 and r["turn"] == 1)["parent_turn"] == 0
    assert T.reply_ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("line,level", [("> a", 1), (">> a", 2), ("> > a", 2), (">>>a", 3), ("a > b", 0), ("", 0)])
def test_levels(line, level):
    assert T.level_of(line)[0] == level


# pages


@pytest.mark.parametrize("source,text", [
    (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<p>a <b>b</b>\n c<br>d</p><p>e", "a b c d\ne"),
    ("<body><header>Site</header><nav>m</nav><main><h1>T</h1><p>x</p><div class='comments'>c</div><form>f</form></main><aside>s</aside><footer>f</footer>", "T\nx"),
    ("<article><header><h1>T</h1></header><ul><li>1<li>2</ul><table><tr><td>a<td>b</table></article>", "T\n1\n2\na\nb"),
    ("<script>var a='</p>';</script><style>p{}</style><!-- no --><p title='a>b'>x&nbsp;y &lt;z&gt;</p>", "x y <z>"),
    ("<div id='cookie-banner'>no</div><div role=navigation>no</div><div hidden>no</div><p>yes</p>", "yes"),
    ('<p>Hello <a href="foo>text</a>', "Hello text"), ("<p title='a\">b</p><p id=\"x>c", "b\nc"), ("a <b", "a"), ("a < b <", "a < b <"), ("x</ p>y", "xy"), ("<!-- open", ""), ("<li>1<ul><li>2</ul><li>3", "1\n2\n3"),
    ("<p>a<p>b<div>c<p>d</div>e", "a\nb\nc\nd\ne"), ("<p>unclosed <b>bold<p>next", "unclosed bold\nnext"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<div class='article-header-shadow'>kept? no</div><p class='lead'>lead</p>", "lead"),
])
def test_main_text(source, text):
    assert H.main_text(source) == text


def test_site_style_tree(spark):
    page = lambda i: f"<body><div class=top>Best site</div><div class=story><p>Story {i} tells of {i * 7}.</p><p>More of {i}.</p></div><div class=legal>All the same words</div></body>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(20)] + [(100 + i, f"http://b{i}.example/x", page(i)) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "Story 5 tells of 35.\nMore of 5."
    assert got[100] == "Best site\nStory 0 tells of 0.\nMore of 0.\nAll the same words"


def test_pages_alike_keep_their_articles(spark):
    # alike, but not copies of one page
    rows = [(i, "http://a.example/x", f"<body><!-- {i} --><div class=top>Site</div><article><h1>T</h1><p>Same</p></article></body>") for i in range(12)]
    assert {r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"T\nSame"}


def test_copies_are_no_template(spark):
    page = lambda i: f"<body><div class=top>Best site</div><div class=story><p>Story {i} tells of {i * 7}.</p></div></body>"
    rows = [(i, "http://a.example/x", page(0)) for i in range(12)]
    rows += [(100 + i, "http://b.example/x", page(i if i < 20 else 0)) for i in range(100)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert {got[i] for i in range(12)} == {"Best site\nStory 0 tells of 0."}
    assert all(got[100 + i] == f"Story {i if i < 20 else 0} tells of {i * 7 if i < 20 else 0}." for i in range(100))


def holds(x):
    """Whether a branch has an article, outside noise."""
    return not x.noise and (x.name in ("article", "main") or any(holds(c) for c in x.children if isinstance(c, H.Node)))


def plain_tree(rows):
    """{host: {path of labels}} of low importance, from the definition: entropies over distinct pages."""
    pages = {}
    for _, url, source in rows:
        pages.setdefault(split(url)[0], {})[source or ""] = H.tree(source or "")
    out = {}
    for host, roots in pages.items():
        seen = {}
        for root in roots.values():
            own, whole = {}, len(words_left(root))
            stack = [(root, (), False)]
            while stack:
                x, path, inside = stack.pop()
                if x.noise:
                    continue
                block = x.name in H.BLOCK and x.name not in ("html", "body", "article", "main")
                beside = holds(root) and block and not inside and not holds(x) and x.name != "h1"
                named = bool(path) and bool({"ad", "promo", "social", "related"} & set(path[-1].partition(".")[2].split("-")))
                doubted = beside or named and (not inside or x.name in ("div", "section", "span", "ul"))
                if doubted or block:
                    kids = [c.label if isinstance(c, H.Node) else "#" for c in x.children if isinstance(c, H.Node) or c.strip()]
                    style, content, n, any_doubt = own.setdefault(path, ([], [], 0, False))
                    own[path] = (style + [tuple(k for i, k in enumerate(kids) if i == 0 or kids[i - 1] != k)], content + [inner(x)], n + len(words_left(x)), any_doubt or doubted)
                stack += [(c, (*path, c.label), inside or x.name in ("article", "main")) for c in reversed(x.children) if isinstance(c, H.Node)]
            for path, (style, content, n, any_doubt) in own.items():
                seen.setdefault(path, []).append((tuple(style), tuple(content), n / max(1, whole), any_doubt))
        for path, found in seen.items():
            m, v = len(found), []
            for k in (0, 1):
                count = Counter(f[k] for f in found)
                v.append(1.0 if m == 1 else sum(-n / m * math.log(n / m) for n in count.values()) / math.log(m))
            v = [(m * x + 2) / (m + 2) for x in v]
            importance = 0.2 * v[0] + 0.8 * v[1]
            if any(f[3] for f in found):
                importance *= sum(f[2] for f in found) / (m + 2)
            if importance < 0.2:
                out.setdefault(host, set()).add(path)
    return out


def inner(x):
    return tuple(c.strip() if isinstance(c, str) else inner(c) if not c.noise else "" for c in x.children)


def words_left(x):
    return [] if x.noise else [w for c in x.children for w in (c.split() if isinstance(c, str) else words_left(c))]


def test_site_style_tree_against_brute_force(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    rows, want = [], {}
    for i in range(160):
        host = rng.choice(["a.x", "b.x", "b.x", "c.x", f"one{i}.x"])
        ad = f'<div class="{rng.choice(["ad", "promo"])}">{word()} {word()} {i}</div>' if rng.random() < 0.8 else ""
        story = "".join(f"<p>{word()} {word()} {i} {n} {word()}</p>" for n in range(rng.randint(1, 6)))
        legal = f"<div class=legal>{rng.choice(['all rights', 'all rights', 'all rights', 'some rights'])}</div>"
        body = f"<article><h1>{word()} {i}</h1>{story}<p class=tail>read on</p></article>" if host != "b.x" else f"<div class=story>{story}</div>"
        rows.append((i, f"http://{host}/{i}", f"<body><div class=top>{host}</div>{ad}{body}{legal}<div class=box><h2>{rng.choice('AB')}</h2><ul><li>x<li>y</ul></div></body>"))
    rows += [(1000 + i, *rng.choice(rows)[1:]) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    low = plain_tree(rows)

    def key(path):
        k = 0
        for label in path:
            k = H.path_key(f"{k}/{label}")
        return k

    nodes = H.unimportant_nodes(H.style_counts(df.selectExpr("regexp_extract(url, '//([^/]*)', 1) AS host", "html"))).collect()
    assert {(r["host"], r["path"]) for r in nodes} == {(h, key(p)) for h, paths in low.items() for p in paths}
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    for i, url, source in rows:
        left = []

        def go(x, path, gone):
            if x.noise or path in gone:
                return
            left.extend(c if isinstance(c, str) else go(c, (*path, c.label), gone) or "" for c in x.children)

        go(H.tree(source), (), low.get(split(url)[0], set()))
        want[i] = " ".join(" ".join(left).split())
    assert {i: " ".join(t.split()) for i, t in got.items()} == want
    assert not any("rights" in t or "read on" in t for i, t in got.items() if i < 1000 and rows[i][1].startswith("http://a.x"))


def test_no_class_takes_words_out_of_an_article(spark):
    page = lambda i: f'<body><div class="x{i % 3}">beside {i}</div><article><h1>Title {i}</h1><p class="social">own words of page {i} stay here</p><p>{"more text " * 9}of page {i}</p><div class="promo">buy {i}</div></article></body>'
    rows = [(i, f"http://a.x/{i}", page(i)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, text in got.items():
        assert f"own words of page {i} stay here" in text and f"Title {i}" in text
        # what is beside an article goes by its share, under any name; so do boxes of adverts within
        assert "beside" not in text and "buy" not in text


def test_a_heading_beside_the_article_stays(spark):
    rows = [(i, f"http://a.x/{i}", f"<h1>Head {i}</h1><div>small {i}</div><main><p>{'text ' * 30}{i}</p></main>") for i in range(5)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"].startswith(f"Head {r['page_id']}") and "small" not in r["text"] for r in got)
    # without an article, small blocks are text like others
    rows = [(i, f"http://a.x/{i}", f"<h1>Head {i}</h1><div>small {i}</div><p>{'text ' * 30}{i}</p>") for i in range(5)]
    assert all("small" in r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_the_tree_needs_no_class_words_on_the_tables(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html").collect()

    def texts():
        rows = [(n, r["url"], r["html"]) for n, r in enumerate(pages)]
        low = plain_tree(rows)

        def left(x, path, gone):
            if x.noise or path in gone:
                return ""
            return " ".join(c if isinstance(c, str) else left(c, (*path, c.label), gone) for c in x.children)

        return [left(H.tree(s or ""), (), low.get(split(u)[0], set())) for _, u, s in rows]

    with_words = texts()
    monkeypatch.setattr(H, "DOUBTED_WORDS", frozenset())
    assert texts() == with_words


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_the_tree_decides_on_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    changed = 0
    for r in pages.collect():
        changed += got[r["page_id"]] != H.main_text(r["html"])
        article = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        assert got[r["page_id"]] == H.main_text(article)
    assert changed == len(got)


@pytest.mark.parametrize("part", ["<a ", "<a href='x", "<a '\">", "<", "</", "<!--", "<script>", "<b>", "<div>", "<li>", "</p>", "<td><tr>", "&amp"])
def test_hostile_pages_take_linear_time(part):
    began = time.process_time()
    H.main_text(part * (300_000 // len(part)))
    assert time.process_time() - began < 5


def test_copies_under_other_menus_keep_their_article(spark):
    page = lambda i, text: f"<body><div class=top>Menu {i}</div><article><h1>T{i}</h1><p>{text}</p></article></body>"
    rows = [(i, f"http://a.example/{i}", page(i, "The same long text." if i % 5 else f"Own text {i}.")) for i in range(50)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(("The same long text." if i % 5 else f"Own text {i}.") in t for i, t in got.items())


def test_salted_join_is_the_broadcast_one(spark, monkeypatch):
    rows = [(i, "http://a.example/x", f"<body><div class=top>Site</div><p>Text {i}</p></body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    a = sorted(map(tuple, H.extract(df).collect()))
    monkeypatch.setattr(H, "BROADCAST_NODES", 0)
    assert sorted(map(tuple, H.extract(df).collect())) == a and a[0][2] == "Text 0"


def test_pages_odd_rows(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    rows = [(1, None, None, 3), (2, "no scheme", "", 3), (3, "http://h/", deep, 3), (3, "http://h/", deep, 3), (None, "http://h/", "<p>" + "long " * 100000, 3)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 4, 4, 499999]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# URLs


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[end:]
    stop = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), tail[:stop]


def verdict(url, listed):
    host, path = split(url)
    best = None
    for rule, what in U.RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, what)
    return (host, path, *(best or (None, "block" if host + path in listed else "allow")))


URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/1", "https://example.org/en/12?x=/de/#y", "http://www.x.com/fr/1", "http://x.com/de/", "http://com/de/x", "http://xcom/de/x", "http://a.net?q=1", "http://a.net#t", "ftp://org/", "http://org", "http://É.net/a", "http://a.net/b?c://d/e"]


@pytest.mark.parametrize("most_bits,broadcast", [(U.MOST_BITS, 1 << 28), (512, 1 << 28), (2048, 0)])
def test_urls_against_brute_force(spark, monkeypatch, most_bits, broadcast):
    monkeypatch.setattr(U, "BROADCAST_BITS", broadcast)
    rng = random.Random(3)
    urls = URLS + [f"http://h{rng.randrange(40)}.net/p/{rng.randrange(60)}" for _ in range(2500)]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    keys = {"".join(split(u)) for u in urls}
    listed = {k for k in keys if hashlib.md5(k.encode()).hexdigest() < "5"}
    table = spark.createDataFrame([(k,) for k in [*listed, *listed, None, "elsewhere.net/x"]], "key string")
    got = {r["page_id"]: tuple(r)[1:] for r in U.judge(pages, table, most_bits=most_bits).collect()}
    assert got == {i: verdict(u, listed) for i, u in enumerate(urls)}


def test_urls_without_rows_or_list(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    assert U.judge(pages, none).collect()[0]["verdict"] == "allow"
    assert U.judge(spark.createDataFrame([], "page_id long, url string"), none).collect() == []


# all


def test_names():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{i}" for i in range(1, 14)] and set(queries.ORACLES) <= set(queries.QUERIES)
