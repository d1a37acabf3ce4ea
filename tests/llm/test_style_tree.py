import random

from gleanspark.llm import main_content as M

SCHEMA = "page_id bigint, url string, html string, content string, content_type string, only_main_content boolean, host string"
WORDS = [a + b + c for a in "bdfgkm" for b in ("ra", "lo", "ti", "su") for c in ("len", "mar", "dok", "pin", "sat")]


def page(rng, k, title=True):
    """An article in a section, a menu, a box of links that all pages of the site have, a footer. No class says which is which."""
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(25)) + "."
    head = f"<h1>{text()[:40]}</h1>" if title else ""
    lines = ["<body>", "<div>", "<a href=/a/b>Start here</a>", "<a href=/a/c>All offers of the week</a>", "</div>", f"<section>{head}", f"<p>{text()}</p>", f"<p>{text()}</p>", "</section>", "<div>", "<p>Read by many people</p>", "<p>Our letter comes on Fridays</p>", "</div>", "<footer>", f"<p>Rights of {2000 + k}</p>", "</footer>", "</body>"]
    return "\n".join(lines)


def rows(rng, hosts=4, pages=12):
    return [(100 * h + k, f"https://s{h}.test/n/{k}x", page(rng, k), None, "html", None, "clash") for h in range(hosts) for k in range(pages)]


def test_importance_of_branches(spark):
    """Branches that all pages show alike have little importance, those of the articles much, wherever the title stands."""
    df = spark.createDataFrame(rows(random.Random(1)), SCHEMA)
    nodes = M._nodes(df, "page_id").cache()
    rated = {(r.page, r.branch): r.importance for r in M.branch_importance(nodes).collect()}
    where = {(r.page, r.line_no): r.branch for r in nodes.collect()}
    assert all(rated[p, where[p, 7]] > 0.8 and rated[p, where[p, 3]] < M.IMPORTANT and rated[p, where[p, 11]] < M.IMPORTANT and rated[p, where[p, 15]] < M.IMPORTANT for p, _ in rated)
    assert all(0 <= x <= 1 for x in rated.values())
    found = {(r.page_id, r.line_no) for r in M.main_lines(df).collect()}
    assert found == {(p, n) for p in {p for p, _ in rated} for n in (6, 7, 8)}


def test_tree_without_titles(spark):
    """Without titles and names only the merged tree tells: the same boxes go."""
    rng = random.Random(2)
    df = spark.createDataFrame([(k, "https://one.test/", page(rng, k, False), None, "html", True, "") for k in range(20)] + [(50, None, None, None, None, None, ""), (51, "x", "", "", "html", True, "")], SCHEMA)
    nodes = M._nodes(df, "page_id").cache()
    low = {(r.page, r.branch) for r in M.branch_importance(nodes).collect() if r.importance < M.IMPORTANT}
    gone = {(r.page, r.line_no) for r in nodes.collect() if (r.page, r.branch) in low}
    assert gone == {(k, n) for k in range(20) for n in (3, 4, 11, 12, 15)}


def test_names_of_addresses():
    assert M.subject("https://h.test/a/why-tea-matters.html?x") == ("matters",) and M.subject(None) == () and M.subject("https://h.test/blog/green_lanterns/index.html") == ("green", "lanterns")
    assert M.about("Green is it", ("green", "lanterns")) and not M.about("x", ())


def test_menus_of_one_line(spark):
    """A menu whose items stand in one line in another choice and order on each page is as unimportant as its items."""
    rng = random.Random(3)
    items = ["Start here", "All offers of the week", "Our letter comes on Fridays", "Read by many people", "Write to us", "Where we are"]

    def with_menu(k):
        menu = "".join(f"<li><a href=/{j}>{x}</a></li>" for j, x in enumerate(rng.sample(items, 4)))
        return page(rng, k).replace("<body>\n", f"<body>\n<nav><ul>{menu}</ul></nav>\n")

    df = spark.createDataFrame([(k, "https://one.test/", with_menu(k), None, "html", True, "") for k in range(20)], SCHEMA)
    nodes = M._nodes(df, "page_id").cache()
    rated = {(r.page, r.branch): r.importance for r in M.branch_importance(nodes).collect()}
    assert all(rated[r.page, r.branch] < M.IMPORTANT for r in nodes.where("line_no = 2").collect())
