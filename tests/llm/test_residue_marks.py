import time

from gleanspark.llm.residue import Index

PAGE = "When the orchard was measured, Lomi kept its kettles with great care. "


def test_marks_of_any_length_and_over_lines():
    ix = Index({}, 0)
    for opening, closing in (("{{", "}}"), ("${", "}"), ("#{", "}"), ("<%", "%>")):
        for inside in ("a", "title | default(" + "'long words' " * 20 + ")", "if x\n  then y\nend", ""):
            assert ix.judge(None, f"{PAGE}{opening}{inside}{closing} {PAGE}") == "placeholder"
        assert ix.judge(None, f"{PAGE}{closing} and {opening} {PAGE}") is None
        assert ix.judge(None, f"{PAGE}\n```\n{opening}a\nb{closing}\n```\n") is None
        began = time.time()
        assert ix.judge(None, opening * 200_000) is None and time.time() - began < 5


def test_messages_beside_code_and_lone_names():
    ix = Index({}, 100_000)
    trace = "\n".join(f"at module{chr(97 + k % 26)} handler worker socket stream buffer" for k in range(400))
    names = "\n".join(["Lomikaru"] * 300)
    for message in ("Account suspended", "The page could not be found on this server"):
        assert ix.judge(None, f"{message}\n```\n{trace}\n```") == "message"
        assert ix.judge(None, f"{message}\n{names}") == "message"
    assert ix.judge(None, f"Account suspended\n{trace}") is None


def test_filler_words_are_learned(spark):
    """Invented words that stand in for text are learned from their company, those of a text about it are not; exemplars are a parameter."""
    import random

    from gleanspark.llm.residue import residue

    rng = random.Random(5)
    words = ["vobis", "tarlen", "miscura", "pelodo", "quarens", "ostini", "brevado", "sunteli"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    plain = "The old mill by the river of Lomi was painted into the night, and nobody minded the noise. "
    rows = [(k, None, f"Lorem ipsum {say(12)}. {say(9)} ipsum.") for k in range(8)]
    rows += [(20 + k, None, f"{plain * 3}Designers of mill {k} paste lorem ipsum into drafts.") for k in range(8)]
    rows += [(50 + k, None, f"{plain * 2}Page {k}.") for k in range(40)]  # most documents have no filler
    rows += [(40, None, say(14)), (41, None, plain * 2), (42, "Designers paste drafts", plain), (43, None, "We moved to another harbour")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "scrape_id bigint, title string, content string, kind int")
    assert {r.scrape_id: r.kind for r in residue(df).collect()} == {k: "filler" for k in [*range(8), 40]}
    own = [("message", "We moved to another harbour"), ("placeholder", "{{x}}")]
    assert {r.scrape_id: r.kind for r in residue(df, labelled=own).collect()}[43] == "message"
