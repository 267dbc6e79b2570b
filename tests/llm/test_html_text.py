import math

from helpers import clashing, prose

from matchbook.llm import html_text as h

PAGES = "page_id long, url string, html string"


def page(body, head="<title>t</title><style>p{}</style><script>var x='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def texts(spark, rows):
    table = clashing(spark.createDataFrame(rows, PAGES), "text", "host", "path", "imp")
    return {r["page_id"]: r["text"] for r in h.main_text(table).collect()}


def test_blocks_markup_and_references(spark):
    rows = [
        (1, "http://a.org/1", page("<nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>The  title</h1><p><b>First &amp; foremost<br>"
                                   "second\n line</b><p>Caf&eacute; &lt;tag&gt; &#128512;<ul><li>one<li>two</ul></article>"
                                   "<footer>&copy; a</footer>")),
        (2, "http://b.org/1", page("<div class='ad box'>Buy</div><div id=comments><p>nice post</p></div><main><p>Text</main>"
                                   "<aside>more</aside><form>name <input></form><div class='cookie-notice'>ok</div><!-- no -->")),
        (3, "http://c.org/1", None), (4, None, ""), (5, "", "just text"), (6, "x", "<p>open <i>never</div> closed"),
        (7, "http://d.org", page("<header>Site</header><article><header><h1>Own head</h1></header><p>Body</p></article>")),
        (None, "http://e.org", page("<article><p>" + prose(1, 50_000) + "</p></article>")),
        (8, "http://f.org", page("<p>a<script>if (a<b) '</p>'</script>b<table><tr><td>c<td>d</table>")),
        (8, "http://f.org", page("<p>a<script>if (a<b) '</p>'</script>b<table><tr><td>c<td>d</table>"))]
    got = texts(spark, rows)
    assert got[1] == "The title\n\nFirst & foremost second line\n\nCafé <tag> 😀\n\none\n\ntwo"
    assert got[2] == "Text" and got[3] == "" and got[4] == "" and got[5] == "just text"
    assert got[6] == "open never\n\nclosed" and got[7] == "Own head\n\nBody" and got[None] == prose(1, 50_000)
    assert got[8] == "a b\n\nc\n\nd" or got[8] == "a\n\nb\n\nc\n\nd"
    assert h.main_text(spark.createDataFrame(rows, PAGES)).count() == len(rows)


def test_open_heads_and_inline_formulas(spark):
    rows = [
        (1, "http://h1.org", "<html><head><title>t</title><body><article><p>text"),
        (2, "http://h2.org", "<html><head><title>t</title><article><p>text"),
        (3, "http://h3.org", "<head><meta charset=x><script>a()</script><b>bold</b> text"),
        (4, "http://h4.org", "<head><title>t</title>\n loose text"),
        (5, "http://h5.org", "<html><head><noscript><link rel=x><body><p>text"),
        (6, "http://h6.org", page("<article><p>Let <math><mi>x</mi><mo>=</mo><msup><mi>y</mi><mn>2</mn></msup>"
                                  "<annotation encoding=tex>x=y^2</annotation></math> hold.</p></article>")),
        (7, "http://h7.org", page("<article><p>Press <svg viewBox='0 0 1 1'><title>icon</title><style>p{}</style><path d=x />"
                                  "<text>OK</text><text>now</text></svg> to go.<p>next</article>")),
        (8, "http://h8.org", page("<article><p>open <svg><g><p>two <math><mi>z</p><p>three</article>")),
        (9, "http://h9.org", "<html><head><title>t</title></head><body><p>closed</p></body></html>")]
    got = texts(spark, rows)
    assert got[1] == got[2] == got[5] == "text" and got[3] == "bold text" and got[4] == "loose text"
    assert got[6] == "Let x=y2 hold." and got[7] == "Press OK now to go.\n\nnext"
    assert got[8] == "open\n\ntwo z\n\nthree" and got[9] == "closed"


def test_names_inside_an_article_are_only_a_prior(spark):
    parts = ("<h2 id=search-algorithms>Search</h2><section id=social-impact><p>impact</p></section>"
             "<div class=related-work>work</div><p class=notice>notice</p>")
    rows = [(1, "http://n1.org", page(f"<article><h1>One</h1>{parts}</article>"))]
    rows += [(100 + i, f"http://n2.org/{i}", page(
        f"<article><h1>t{i}</h1><p>{prose(i, 20)}</p><div class='related-work w-1/2'><h3>r{i}</h3><p>{prose(900 + i, 5)}</p></div>"
        f"<div class=share-bar>Share this page</div><aside>x{i}</aside></article>"
        f"<div class=comments><p>{prose(500 + i, 5)}</p></div>")) for i in range(60)]
    got = texts(spark, rows)
    assert got[1] == "One\n\nSearch\n\nimpact\n\nwork\n\nnotice"
    assert all(got[100 + i] == f"t{i}\n\n{prose(i, 20)}\n\nr{i}\n\n{prose(900 + i, 5)}" for i in range(60))


def test_named_elements_around_whole_pages_stay(spark):
    """Named parts are in the tree: a form around every page holds its text."""
    rows = [(i, f"http://form.org/{i}", page(
        f"<form id=login><nav>Menu</nav><div class=body><p>{prose(i, 30)}</p></div></form>")) for i in range(40)]
    got = texts(spark, rows)
    assert all(got[i] == prose(i, 30) for i in range(40))


def site(n, host="s.org"):
    """Pages with unlabelled boilerplate around an unlabelled body."""
    return [(i, f"http://{host}/{i}", page(
        f"<div class=hero><p>Welcome to the site</p><p>Best offers of the day</p></div>"
        f"<div class=story><h2>{prose(i, 6)}</h2><p>{prose(1000 + i, 40 + i)}</p><p>{prose(5000 + i, 30)}</p></div>"
        f"<div class=legal>All rights reserved</div>")) for i in range(n)]


def test_low_importance_branches_go(spark):
    got = texts(spark, site(120))
    for i, text in got.items():
        assert text == f"{prose(i, 6)}\n\n{prose(1000 + i, 40 + i)}\n\n{prose(5000 + i, 30)}"


def test_few_pages_and_copies_keep_their_text(spark):
    body = page("<article><h1>Same</h1><p>" + prose(1, 60) + "</p></article>")
    rows = [(i, "http://copies.org/x", body) for i in range(60)] + [(100 + i, f"http://u{i}.org", page(
        f"<article><h1>{prose(i, 4)}</h1><p>{prose(i, 50)}</p></article>")) for i in range(40)]
    got = texts(spark, rows)
    assert all(prose(1, 60) in got[i] for i in range(60)) and all(prose(i, 50) in got[100 + i] for i in range(40))


def test_importance_against_brute_force(spark):
    rows = site(40) + [(100 + i, f"http://t.org/{i}", page(f"<div class=story><p>{prose(i % 3, 9)}</p></div><article>{i}</article>")) for i in range(9)]
    rows += [(200 + i, "http://t.org/0", rows[-9][2]) for i in range(5)]            # copies count once
    pages = [(host, h._elements(h.read_page(x.encode()))) for host, x in {(u.split("/")[2], x) for _, u, x in rows}]

    def tree(rows_of):
        out = {}
        for path in {p for e in rows_of for p in e}:
            have = [e[path] for e in rows_of if path in e]
            m, marks = len(have), {}
            for e in have:
                for t in e[0]:
                    marks[t] = marks.get(t, 0) + 1
            base = math.log(max(m, 2))
            content = 1 - sum(math.log(k) for k in marks.values()) / len(marks) / base
            forms = {}
            for e in have:
                if e[2]:
                    forms[tuple(e[2])] = forms.get(tuple(e[2]), 0) + 1
            n = sum(forms.values())
            shape = -sum(k / n * math.log(k / n) for k in forms.values()) / base if forms else 0
            keep = h.DECAY ** len(forms)
            out[path] = (m, (1 - keep) * shape + keep * content if forms else content)
        return out
    everywhere = tree([e for _, e in pages])
    want = {}
    for host in {x for x, _ in pages}:
        for path, (m, imp) in tree([e for x, e in pages if x == host]).items():
            everywhere_m, everywhere_imp = everywhere[path]
            prior = ((everywhere_m - 1) * everywhere_imp + h.PRIOR_PAGES) / (everywhere_m - 1 + h.PRIOR_PAGES)
            prior, weight = (1, h.ARTICLE_PAGES) if "/article" in path else (prior, h.PRIOR_PAGES)
            want[host, h.digest(path)] = ((m - 1) * imp + weight * prior) / (m - 1 + weight)
    table = spark.createDataFrame([(u.split("/")[2], x) for _, u, x in rows], "host string, html string")
    got = {(r["host"], r["path"]): r["imp"] for r in h.importance(table, "host", "html").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_large_host_keeps_its_articles(spark):
    """Many child sequences on many pages of one host: the entropy to the base
    m is low, the texts differ.  Paragraphs and menus are told apart still."""
    n = 20_500

    def body(i):
        paragraphs = 19 + i // 50 % 40 if i % 50 == 0 else 1 + i % 18
        return page("<div class=legal>All rights reserved</div><article><h1>t%d</h1>%s</article>" % (
            i, "".join(f"<p>w{i} w{j}</p>" for j in range(paragraphs))))
    table = spark.createDataFrame([(i, f"http://big.org/{i}", body(i)) for i in range(n)], PAGES).repartition(16)
    tree = {r["path"]: r for r in h.importance(table.selectExpr("'big.org' AS host", "html"), "host", "html").collect()}
    article = tree[h.digest("/html/body/article")]
    assert article["pages"] == n and article["imp"] < h.LEAST and article["content"] > 0.9
    assert article["size"] > 0.5 * article["whole"]
    got = h.main_text(table).selectExpr("page_id", "length(text) AS n", "instr(text, 'rights') AS legal").collect()
    assert len(got) == n and all(r["legal"] == 0 for r in got)
    assert all(r["n"] >= len(f"t{r['page_id']}") + 2 + len(f"w{r['page_id']} w0") for r in got)


def test_many_templates_none_of_which_holds_most_text(spark):
    """Three kinds of article, each below half of the host's text."""
    rows = []
    for i in range(3000):
        shape = "".join(f"<p>w{i} v{j}</p>" for j in range(1 + i % 7)) + "<ul></ul>" * (i // 3 % 2)
        rows.append((i, f"http://three.org/{i}", page(f"<div class=kind{'abc'[i % 3]}><h2>t{i}</h2>{shape}</div>")))
    got = texts(spark, rows)
    assert all(got[i].startswith(f"t{i}\n\nw{i} v0") for i in range(3000))


def test_removals_joined_without_a_broadcast_agree(spark, monkeypatch):
    want = texts(spark, site(60))
    monkeypatch.setattr(h, "broadcast_if_fits", lambda df: df)
    assert texts(spark, site(60)) == want


def test_empty_table(spark):
    assert h.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_comments_and_related_blocks_go_wherever_they_stand(spark):
    rows = []
    for i in range(60):
        rows.append((i, f"http://m.org/{i}", page(
            f"<main><header><p>Channel {i}</p></header><article><h1>t{i}</h1><p>{prose(i, 40)}</p></article>"
            f"<div class=comments><div class=comment><p>{prose(700 + i, 12)}</p></div><div class=comment><p>{prose(800 + i, 9)}</p></div></div>"
            f"<section id=related><p>{prose(900 + i, 8)}</p></section></main>")))
        rows.append((100 + i, f"http://i.org/{i}", page(
            f"<article><header><h1>t{i}</h1></header><p>{prose(i, 40)}</p>"
            f"<section class=comments><p>{prose(700 + i, 30)}</p></section><div class='related-posts'><p>{prose(5 + i, 6)}</p></div></article>")))
    got = texts(spark, rows)
    assert all(got[i] == got[100 + i] == f"t{i}\n\n{prose(i, 40)}" for i in range(60))


def test_varied_text_under_an_unlucky_name_stays(spark):
    rows = [(i, f"http://v.org/{i}", page(
        f"<div class=top><a href=/>Home</a> <a href=/x>All</a></div><h1>t{i}</h1><div class=intro><p>{prose(i, 30)}</p></div>"
        f"<div class=related-work><h2>Related work {i}</h2><p>{prose(300 + i, 25)}</p></div>"
        f"<section id=search-algorithms><p>{prose(600 + i, 25)}</p></section>"
        f"<div class=strip><a href=/{i}>{prose(900 + i, 3)}</a> <a href=/y{i}>{prose(950 + i, 3)}</a></div>")) for i in range(60)]
    got = texts(spark, rows)
    assert all(got[i] == f"t{i}\n\n{prose(i, 30)}\n\nRelated work {i}\n\n{prose(300 + i, 25)}\n\n{prose(600 + i, 25)}" for i in range(60))


def test_names():
    def name(tag, inside=False, **attrs):
        return h.name_of(tag, [(k.rstrip("_"), v) for k, v in attrs.items()], inside)
    assert name("div", class_="comments") == name("div", id="comments") == name("nav") == name("header") == h.STRONG
    assert name("div", class_="x share-bar") == name("section", inside=True, class_="comment-list") == h.STRONG
    assert name("div", class_="related-work") == name("section", inside=True, id="related") == name("p", True, class_="notice") == h.WEAK
    assert name("h2", class_="search") == name("main", class_="search") == name("div", class_="story") == h.UNSAID
    assert name("header", inside=True) == name("div", True, class_="page-header") == h.UNSAID


def test_branch_decision_against_brute_force(spark):
    rows = [(u.split("/")[2], x) for _, u, x in site(30)] + [("q.org", page(
        f"<div class=nav-top><a href=x>all</a></div><article><p>same words</p><p>{prose(i, 20)}</p><div class=ad>buy</div></article>"
        f"<div class=foot>{i % 4} <a>contact us</a></div><form><p>{prose(i + 50, 90)}</p></form>")) for i in range(25)]
    tree = h.importance(spark.createDataFrame(rows, "host string, html string"), "host", "html")
    got = tree.withColumn("score", h.branch_score()).collect()
    assert len(got) > 12
    for r in got:
        name, inside, share = r["kind"] % h.INSIDE, r["kind"] >= h.INSIDE, r["size"] / r["whole"]
        want = (max(r["content"], r["imp"]) - h.LEAST) / (1 - h.LEAST) - h.NAME_WEIGHTS[name] - h.BESIDE_WEIGHT * r["beside"]
        want += h.INSIDE_WEIGHTS[name] if inside else 0
        want -= h.LINK_WEIGHT * r["linked"] / r["size"]
        want += h.MOST_WEIGHT if share > h.MOST_TEXT and not inside and r["beside"] < 0.5 else min(share, h.MOST_TEXT)
        assert abs(r["score"] - want) < 1e-9
    by = {(r["host"], r["path"]): r for r in got}
    foot = by["q.org", h.digest("/html/body/div.foot")]
    assert foot["beside"] == 1 and foot["linked"] == 25 * len("contact us") and foot["size"] == 25 * len("0 contact us")
    assert by["q.org", h.digest("/html/body/article")]["beside"] == 0 and by["q.org", h.digest("/html/body/form")]["score"] < 0


def test_links_and_places_of_a_page():
    p = h.read_page(b"<div><a href=x>one</a> two</div><article><p>three <a>four</a></p></article><p><a>five</a></p>")
    e = h._elements(p)
    assert e["/div"][1:4:2] == (7, 3) and e["/div"][4] and not e["/article"][4] and not e["/article/p"][4]
    assert e["/article/p"][3] == 4 and e["/p"][3] == 4 and e["/p"][4]
