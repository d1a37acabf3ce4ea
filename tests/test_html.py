from gleanspark.html import ops
from gleanspark.html.dom import parse
from gleanspark.html.select import BadSelector, select
from gleanspark.operators import pages as P

PRODUCTS = "<ul><li class=product><h2>Wireless Mouse</h2><span class=price>$1,299.99</span><a href=/p/mouse>x</a><li class=product><h2>Keyboard</h2><span class=price>USD 89</span><a href=/p/keys>y</a></ul>"


def test_tree_repairs():
    root = parse("<p>a<b>b<p>c<table><tr><td>1<td>2<tr><td>3</table><li>x<li>y")
    assert [n.tag for n in root.walk()].count("tbody") == 1
    assert len(select(root, "tr")) == 2 and len(select(root, "tr > td")) == 3 and len(select(root, "li")) == 2
    assert parse("").text() == ""


def test_selectors():
    root = parse('<div id=a class="x y"><p>1</p><p data-k="ab c">2</p><span>3</span></div>')
    assert [n.text() for n in select(root, "#a > p:nth-child(2)")] == ["2"]
    assert [n.text() for n in select(root, "p + span, p:first-child")] == ["1", "3"]
    assert [n.text() for n in select(root, ".x.y p:not([data-k])")] == ["1"]
    assert [n.text() for n in select(root, '[data-k~="c"], [data-k^=zz]')] == ["2"]
    for bad in ("", "p[", ":has(p)", "> >"):
        try:
            select(root, bad)
            raise AssertionError(bad)
        except BadSelector:
            pass


def test_records():
    fields = [{"name": "name", "selector": "h2", "type": "text"}, {"name": "price", "selector": ".price", "type": "number"}, {"name": "link", "selector": "a", "type": "attribute", "attribute": "href"}, {"name": "none", "selector": "p[", "type": "list"}, {"name": "miss", "selector": "h5", "type": "text"}]
    got = ops.extract(PRODUCTS, {"baseSelector": "li.product", "fields": fields})
    assert got == [{"name": "Wireless Mouse", "price": 1299.99, "link": "/p/mouse", "none": [], "miss": None}, {"name": "Keyboard", "price": 89.0, "link": "/p/keys", "none": [], "miss": None}]
    assert ops.extract(PRODUCTS, {"baseSelector": "li[", "fields": fields}) == []
    assert [ops.number(x) for x in ("$1,234,567.50", "42", "-15.5", "Only 7 left", "Out of stock", None)] == [1234567.5, 42, -15.5, 7, None, None]


def test_tables():
    t = ops.tables("<table><caption>Prices</caption><thead><tr><th>A<th>B</thead><tr><td colspan=2>merged<td>x<tr><td></table>")[0]
    assert t == {"caption": "Prices", "headers": ["A", "B"], "rows": [["merged", "", "x"]], "row_count": 1, "column_count": 3}
    assert ops.tables("<p>none") == [] and ops.tables(None) == []


def test_contacts():
    c = ops.contacts('<a href="mailto:Sales@acme.io?x">m</a><a href="tel:+1 415 555 0132">t</a><a href="https://x.com/acme">x</a> hello@acme.io logo@2x.png me@example.com', "https://acme.io")
    assert c["emails"] == ["sales@acme.io", "hello@acme.io"] and c["phones"] == ["+1 415 555 0132"] and c["socials"] == {"twitter": "https://x.com/acme"}


def test_fit_and_markdown():
    page = "<nav><a href=/>Home</a></nav><article><h1>T</h1><p>" + "A long sentence with many words in it. " * 12 + "</p><li>x</li><table><tr><td>1</table></article><footer>f</footer><script>s()</script>"
    fit = ops.fit_html(page)
    assert "long sentence" in fit and "Home" not in fit and "<table>" in fit and "s()" not in fit
    assert ops.fit_html("  ") == "" == ops.fit_html(None)
    md = ops.markdown("<h2>A  b</h2><p>x <b>y</b> <a href='/u' title='t'>z</a></p><ol><li>1<ul><li>2</ul></ol><pre><code class=language-py>f()\n</code></pre><table><tr><th>a|b<tr><td>c</table>")
    assert md == '## A b\n\nx **y** [z](/u "t")\n\n1. 1\n   - 2\n\n```py\nf()\n```\n\n| a\\|b |\n| --- |\n| c |'


def test_links():
    assert ops.links('<base href="/b/"><a href="c#d">1</a><a href="c">2</a><a href="javascript:x">3</a><a href="//h.test/x">4</a>', "https://a.test/q") == ["https://a.test/b/c", "https://h.test/x"]


def test_render(spark):
    df = spark.createDataFrame([(1, "https://a.test/", "<p>x  y"), (2, None, None), (3, "::", "")], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in P.render(df, ["text", "TEXT", "tables", "links"]).collect()}
    assert got[1].text == "x y" and got[2].text is None and got[3].tables == [] and got[3].page_error is None
    rec = P.extract(df, {"baseSelector": "p", "fields": [{"name": "n", "selector": "", "type": "nested", "fields": [{"name": "t", "selector": ".", "type": "text"}]}]}).where("page_id = 1").first()
    assert rec.records[0].n.t == "x  y"
