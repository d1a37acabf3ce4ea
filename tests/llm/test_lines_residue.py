from gleanspark.llm.repeated_lines import repeated_lines, without_repeated_lines
from gleanspark.llm.residue import Index, residue

SCHEMA = "scrape_id bigint, url string, title string, content string, key bigint, site string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA)


def test_repeated_lines(spark):
    rows = [(k, f"https://{'WWW.' * (k % 2)}A.test:8{k}/x", None, f"Own line number{'x' * k}\n Shared\xa0{k}  TIMES \n{k}{k}\n") for k in range(10)]
    rows += [(0, *rows[0][1:]), (20, None, None, "Shared 1 times"), (21, "https://b.test/", None, "shared 1 times"), (22, "https://a.test/", None, None), (23, "https://a.test/", None, ""), (None, "https://a.test/", None, "shared 1 times")]
    df = frame(spark, rows)
    got = {(r.scrape_id, r.line_no) for r in repeated_lines(df).where("line_docs >= 10").collect()}
    assert got == {(k, 2) for k in range(10)}
    clean = {r.scrape_id: r.content for r in without_repeated_lines(df).where("scrape_id is not null").collect()}
    assert clean[3] == "Own line numberxxx\n33\n" and clean[21] == "shared 1 times" and clean[22] is None and clean[23] == ""
    assert repeated_lines(frame(spark, [])).count() == 0


def test_nine_documents_and_two_deliveries_are_too_few(spark):
    rows = [(k, "https://a.test/", None, "Same line\nSame line") for k in range(9)]
    assert repeated_lines(frame(spark, rows + rows)).where("line_docs >= 10").count() == 0


def test_residue(spark):
    page = "When the orchard was measured, Lomi kept its kettles with great care. Some postcards cost 12, others nothing at all. " * 4
    rows = [
        (1, None, "{{title}}", page), (2, None, "x", page + "\nDear [insert name here], thank you."), (3, None, "x", "# Session expired. Log in again to read this page.\n\nZurück zur Startseite"),
        (4, None, "x", "Please switch on JavaScript to see this page"), (5, None, "x", "Lomi Lorem ipsum dolor sit amet consectetur"), (6, None, None, page), (7, None, "Error", None), (8, None, "Error", "  "),
        (9, None, "x", page + "\nThe tag `{{ user.name }}` is replaced while the page is drawn.\n```\n<h1>{{ a.title }}</h1>\n```"), (10, None, "x", "Lomi is closed on Mondays."),
        (11, None, "x", page + ' Why "page not found" messages should be friendly is the theme of Lomi.'), (4, None, "x", "Please switch on JavaScript to see this page"), (12, None, "x", "word " * 50000),
    ]
    got = {r.scrape_id: r.kind for r in residue(frame(spark, rows)).collect()}
    assert got == {1: "placeholder", 2: "placeholder", 3: "message", 4: "script", 5: "filler"}
    assert residue(frame(spark, [])).count() == 0


def test_index_without_corpus():
    ix = Index({}, 0)
    assert ix.judge(None, None) is None and ix.judge("", "Account suspended") == "message"
