import time

from pyspark.sql import functions as F

from tessera.llm import html

PAGE = "<!DOCTYPE html><html><head><title>t {k}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}<footer>&copy; f</footer></body></html>"
ARTICLE = "<nav><ul><li><a href=x>menu</a></li></ul></nav><div class=\"ad\">buy {k}</div><article><h1>Title {k} &amp; more</h1><p><b>first\n  {k}<br>line<p>second &lt;{k}&gt;</p><div class='comments'><p>reader {k}</p></div></article><aside>side</aside>"
PLAIN = "<div id=top class=site-header>Site {k}</div><div id=\"m{k}\"><div class=x1><h2>Head {k}</h2><p>long text number {k} about water and stone</p><ul><li>one {k}</li><li>two</li></ul></div><div class=note>The same on every page</div></div><form>mail</form><div class='cookie-notice'>cookies</div>"


def pages(spark, given):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(given)], "page_id bigint, url string, html string")


def test_articles_and_plain_containers(spark):
    given = [(f"http://a.com/{k}", PAGE.format(k=k, body=ARTICLE.format(k=k))) for k in range(12)]
    given += [(f"http://b.com/{k}", PAGE.format(k=k, body=PLAIN.format(k=k))) for k in range(12)]
    got = {r["page_id"]: r for r in html.extract(pages(spark, given).withColumn("text", F.lit(1)).withColumn("host", F.lit(1))).collect()}
    for k in range(12):
        assert got[k]["text"] == f"Title {k} & more\nfirst {k} line\nsecond <{k}>"
        assert got[12 + k]["text"] == f"Head {k}\nlong text number {k} about water and stone\none {k}\ntwo"
        assert got[k]["n_chars"] == len(got[k]["text"])


def test_nulls_repeats_broken_and_no_pages(spark):
    given = [(None, None), ("x", ""), ("http://c.com", "plain &amp text &am"), ("http://c.com", "plain &amp text &am"), ("http://d.com/", "<p>a<p>b<div>c<td>d"), ("http://e.com", "<article><p>x" + "<div>" * 3000 + "deep"), ("http://f.com", "<p>open <a href='q"), ("http://g.com", "<!-- never closed <p>x")]
    got = [r["text"] for r in html.extract(pages(spark, given)).orderBy("page_id").collect()]
    assert got[:5] == ["", "", "plain & text &am", "plain & text &am", "a\nb\nc\nd"]
    assert got[5] == "x\ndeep" and got[6].startswith("open") and got[7] == ""
    assert html.extract(pages(spark, given).limit(0)).count() == 0


def test_alignment_finds_optional_and_repeated_parts():
    trees = [html.page_tree(f"<body><article><h1>t{k}</h1>{'<p>x%d</p>' % k * (k % 3)}{'<ul><li>q</li></ul>' if k % 2 else ''}</article></body>") for k in range(6)]
    whole = trees[0]
    for t in trees[1:]:
        whole = html.align(whole, t)
    article = whole["d"][0]["d"][0]
    assert [(x["k"], x["o"]) for x in article["d"]] == [("h1", False), ("p", True), ("ul", True)]
    assert article["d"][1]["r"] and article["d"][0]["s"] and article["d"][2]["d"][0]["t"] == "q"


def ruled(given):
    """The main text of each page of one host."""
    whole = html.page_tree(given[0])
    for page in given[1:]:
        whole = html.align(whole, html.page_tree(page))
    rule = html.rules(whole)
    return [html.main_text(page, rule) for page in given]


def test_small_parts_beside_the_main_one_stay():
    long = "long text {k} " * 60
    post = "<div class=top>Site</div><div class=post><h1>Title {k}</h1><div class=lead>Lead {k}</div><div class=entry><p>" + long + "</p></div>{more}</div><footer>f {k}</footer>"
    given = [PAGE.format(k=k, body=post.format(k=k, more=f"<div class=more><p>section {k}</p></div>" if k == 5 else "")) for k in range(20)]
    want = [f"Title {k}\nLead {k}\n{(long.format(k=k)).strip()}" + ("\nsection 5" if k == 5 else "") for k in range(20)]
    assert ruled(given) == want
    two = "<nav>menu {k}</nav><article class=lead><p>Lead {k}</p></article><article class=body><p>" + long + "</p></article><aside>s {k}</aside>"
    assert ruled([PAGE.format(k=k, body=two.format(k=k)) for k in range(20)]) == [f"Lead {k}\n{long.format(k=k).strip()}" for k in range(20)]
    # alike on the few pages that have it
    rare = "<div class=a><p>text {k}</p></div>{more}"
    given = [PAGE.format(k=k, body=rare.format(k=k, more="<div class=b><p>the same section</p></div>" if k < 10 else "")) for k in range(20)]
    assert ruled(given) == [f"text {k}" + ("\nthe same section" if k < 10 else "") for k in range(20)]


def test_texts_that_copies_share_are_not_the_templates():
    body = "<div class=post><h1>Title {k}</h1><p>text {k}</p>{more}<div class=note>The same on every page</div></div>"
    shared = "<pre>code</pre><table><tr><td>cell</td></tr></table><figure><figcaption>caption</figcaption></figure>"
    given = [PAGE.format(k=k, body=body.format(k=k, more="<p>cell</p>")) for k in range(10)] + [PAGE.format(k=50, body=body.format(k=50, more=shared))] * 9
    got = ruled(given)
    assert got[:10] == [f"Title {k}\ntext {k}\ncell" for k in range(10)]
    assert got[10:] == ["Title 50\ntext 50\ncode\ncell\ncaption"] * 9
    # copies alone say nothing about a template, nor do constants within an article
    copies = [PAGE.format(k=1, body=body.format(k=1, more=shared))] * 20 + [PAGE.format(k=2, body=body.format(k=2, more=shared))]
    assert ruled(copies)[0] == "Title 1\ntext 1\ncode\ncell\ncaption\nThe same on every page"
    article = "<article><h1>Title {k}</h1><div class=kind>essay</div><p>text {k}</p></article>"
    assert ruled([PAGE.format(k=k, body=article.format(k=k)) for k in range(12)])[3] == "Title 3\nessay\ntext 3"
    # the template's text is dropped in its place only
    place = "<div class=post><div class=note>note</div><div class=text>{t}</div><p>text {k}</p></div>"
    got = ruled([PAGE.format(k=k, body=place.format(k=k, t="note" if k == 4 else f"other {k}")) for k in range(12)])
    assert got[4] == "note\ntext 4" and got[5] == "other 5\ntext 5"


def test_matches_pair_equal_keys_in_order_and_leave_none_out():
    for xs, ys in (("", ""), ("abc", ""), ("", "abc"), ("abc", "abc"), ("abcd", "xbyd"), ("aab", "baa"), ("abab", "cabcab"), ("a" * 5, "a" * 3)):
        got = list(html._matches(list(xs), list(ys)))
        assert [i for i, _ in got if i is not None] == list(range(len(xs)))
        assert [j for _, j in got if j is not None] == list(range(len(ys)))
        assert all(xs[i] == ys[j] for i, j in got if i is not None and j is not None)
    assert [(i, j) for i, j in html._matches(list("abcd"), list("xbyd")) if None not in (i, j)] == [(1, 1), (3, 3)]


def test_long_unlike_pages_align_in_linear_time():
    def page(letters):
        return "<body><div class=post>" + "".join(f"<div class={letters[k % 2]}x{'abcdefghij'[k % 10]}><p>text {k}</p></div>" for k in range(6000)) + "</div></body>"

    began = time.perf_counter()
    both = html.align(html.page_tree(page("ab")), html.page_tree(page("cd")))
    assert time.perf_counter() - began < 10
    post = both["d"][0]["d"][0]
    assert len(post["d"]) == 12000 and all(x["o"] for x in post["d"])
