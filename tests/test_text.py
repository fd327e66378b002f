from pyspark.sql import functions as F

from ragweave.functions import text as T
from ragweave.operators import evaluate


def values(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_line_joining(spark):
    assert values(spark, ["a\nb", "a\n\nb", "a\n\n\nb", "", None], T.join_wrapped_lines) == ["a b", "a\n\nb", "a\n\n\nb", "", None]


def test_boilerplate(spark):
    texts = ["x *** START OF A *** body *** END OF A *** y", "x *** start of a *** body", "body *** END OF A *** y", "*** END OF A *** m *** START OF A ***", " plain "]
    assert values(spark, texts, T.trim_boilerplate) == ["body", "body", "body", "", "plain"]


def test_contents_slice(spark):
    assert values(spark, ["a CONTENTS b CONTENTS c", "TABLE OF CONTENTS x CONTENTS y", "none"], T.contents_slice) == ["CONTENTS c", "TABLE OF CONTENTS x CONTENTS y", "none"]


def test_white_space(spark):
    assert values(spark, ["a  \x1c b", "  "], T.normalize_space) == ["a b", ""]
    assert values(spark, ["a b c", ""], T.word_count) == [3, 0]


def test_headings(spark):
    assert values(spark, ["Chapter in which", "Prop. 3", "Chapter on", "book X"], T.is_heading) == [True, True, False, True]
    assert values(spark, ["Problems of life", "Preface", "A preface"], T.is_removed_heading) == [True, True, False]


def test_quoted_span(spark):
    assert values(spark, ["it's Tom's", "a \"b' c", "one ' only"], T.has_quoted_span) == [True, True, False]


def test_sub_chunks(spark):
    long = "a" * 1700
    got = values(spark, ["short", f"p one\n\n{long}", "x" * 500 + "\n" + "y" * 400], T.sub_chunks)
    assert got == [["short"], ["p one", "a" * 800, "a" * 800, "a" * 100], ["x" * 500, "y" * 400]]


def test_display(spark):
    assert values(spark, ["aaa bbb ccc"], lambda c: T.wrap(c, 7)) == ["aaa bbb\nccc"]
    assert [r.v for r in spark.createDataFrame([(0.0,), (None,), (0.12345,)], "x double").select(T.display_score(F.col("x")).alias("v")).collect()] == ["N/A", "N/A", "0.1235"]


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "hopping": "hop", "relational": "relat", "generalization": "gener", "happy": "happi", "agreed": "agre", "controlling": "control", "probate": "probat", "adoption": "adopt", "sky": "sky"}
    assert {w: T.porter_stem(w) for w in pairs} == pairs


def test_rouge(spark):
    rows = spark.createDataFrame([("b x d e", "a b c d e"), ("", "a"), (None, None), ("running", "runs run")], "r string, c string")
    got = [round(r.v, 4) for r in rows.select(evaluate.rouge_l(F.col("r"), F.col("c")).alias("v")).collect()]
    assert got == [0.6667, 0.0, 0.0, 0.6667]


def test_lcs_against_table():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        row = [0] * (len(a) + 1)
        for x in b:
            new = [0]
            for i, y in enumerate(a):
                new.append(row[i] + 1 if x == y else max(row[i + 1], new[-1]))
            row = new
        assert evaluate.lcs_length(a, b) == row[-1]
