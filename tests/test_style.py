"""Styles as columns. All names are invented."""

import time

import pytest

from marginalia.operators import style
from marginalia.operators.detect import detect_styles

APA = (
    "Text (Adams & Brown, 2001) and (Clark, 2003).\n\nReferences\n\nAdams, B. C., & Brown, D. (2001). A study of things. Journal of Stuff, 12(3), 45-67.\n"
    "Clark, E. (2003). Another study. Journal of Things, 1(2), 3-4. https://doi.org/10.1000/x1\nDavis, F., Evans, G., & Foster, H. (2010a). More. Big Review, 5(1), 9-19.\n"
)
VANCOUVER = (
    "Seen [1] and [2,3] and [2].\n\nReferences\n1. Adams BC, Brown D. Study of things. J Stuff. 2001;12(3):45-67.\n2. Clark E. Another study. J Things. 2003;1(2):3-4.\n"
    "3. Davis F, Evans G. More on this. Big Rev. 2010;5(1):9-19.\n"
)


def styles(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in detect_styles(docs).orderBy("doc_id").collect()]


def counts(spark, text):
    rows = spark.createDataFrame([(text,)], "text string")
    return style.with_signals(rows, "text").select("_signals.*").first().asDict()


def test_styles(spark):
    apa, vancouver, harvard, empty, null = styles(spark, APA, VANCOUVER, "(Smith 2020) (Lee 2001) (Ito 1999)", "", None)
    assert apa[:2] == ("apa", "author-year") and vancouver[:2] == ("vancouver", "numeric") and harvard[0] == "harvard"
    assert empty == null == ("apa", "author-year", 0.6)


def test_no_python_in_the_plan(spark):
    plan = detect_styles(spark.createDataFrame([(1, "x")], "doc_id long, text string").coalesce(1))._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "Python" not in plan and "Exchange" not in plan


REST = " word" * 40  # parentheses are counted in the first part of a text


@pytest.mark.parametrize(
    ("text", "signal", "expected"),
    [
        ("[1] and [2, 3-5], Table [6], group [7], [8]", "brackets", 3),  # what ends in p is a label
        ("[1]" + " " * 40 + "Fig." + " " * 40 + "[2]", "brackets", 2),  # a label stands within 30 characters
        ("\U0001f600" * 50 + "Table [3] and \U0001f600[4]", "brackets", 1),
        ("so\u00b9,\u00b2 it \u00b3 is.\u2074", "raised", 2),
        ("word.12 results7 0.5 x=.5 (.5 vol3 CO2 b2% t(4).5 p (3)2 a301 a0", "glued", 3),
        ("(1) so (2-4) and (2020), n = (5), SD (6), (7)% page (8), (301)" + REST, "parentheses", 2),
        ("(open (1) also\n(2) close) (3)" + REST, "parentheses", 2),
        ("(1,\n2) x (2) also (\n3) (1,\n3)" + REST, "parentheses", 3),
        ("x\nReferences\n" + "".join(f"{i}. y\n" for i in range(1, 6)), "numbered", True),
        ("x\nReferences\n" + "a line\n" * 30 + "".join(f"{i}. y\n" for i in (1, 2, 4, 5, 6)), "numbered", False),
        ("words " * 20 + "\n1. a\n2. b\n3. c\n4. d\n5. e\n", "numbered", True),
    ],
    ids=range(11),
)
def test_signals(spark, text, signal, expected):
    assert counts(spark, text)[signal] == expected


def test_parentheses_are_counted_where_little_else_is_found_only(spark):
    assert counts(spark, "[1] [2] [3] (4)")["parentheses"] == 0


def test_long_texts(spark):
    """Many places of each kind, and of one line that opens parentheses."""
    texts = [unit * (400_000 // len(unit)) for unit in ("so [1] it.2 (Smith, 2001). ", "it (2) was (n (3) x) ", "(", "\n", "1. a\n", "a1", "1,", "\n ")] + ["[" + "1, " * 100_000 + "1]", "a" + "1," * 100_000 + "1"]
    start = time.time()
    assert len(styles(spark, *texts)) == len(texts) and counts(spark, texts[-2])["brackets"] == counts(spark, texts[-1])["glued"] == 1
    assert time.time() - start < 60
