"""Line rules, one by one, and documents that lose too much."""

import pytest
from pyspark.sql import functions as F

from priceloom.llm import quality


@pytest.mark.parametrize(
    "line, fails",
    [
        ("A plain sentence of several words.", False), ("He said so (twice)", False), ("Heading of four words", False), ("A line of words that just stops", True),
        ("Home | About | Contact | Help.", True), ("one » two » three » four.", True), ("All rights reserved 2020.", True), ("Alle Rechte vorbehalten.", True), ("Tous droits réservés.", True), ("Política de privacidad.", True),
        ("We use cookies, " + "and this sentence is a long one that goes on " * 5 + "here.", False), ("### $$$ %%% ab.", True), ("buy! now! cheap! offer!", True), ("Wow! That is a fine thing to say.", False),
    ],
)
def test_lines(spark, line, fails):
    assert spark.createDataFrame([(line,)], "x string").select(quality.line_fails(F.col("x")).alias("f")).head().f is fails


def test_documents(spark):
    good = "\n".join(" ".join(f"{w}{k}" for k in range(12)) + "." for w in "alpha beta gamma delta".split())
    rows = [(1, good), (2, good + "\nAll rights reserved."), (3, "all of this just goes on and on\n" * 1 + "and here it never seems to end " + good.split("\n")[0]), (4, None), (5, ""), (6, " \n "), (7, "no end to this line of many words which is the only one that there is"), (1, good)]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, lines string, words string")
    got = sorted((r.doc_id, r.kept, r.base_failed) for r in quality.judged(docs).collect())
    assert got == [(1, True, False), (1, True, False), (2, True, False), (3, True, False), (4, False, True), (5, False, True), (6, False, True), (7, False, False)]
    assert {r.doc_id: r.text for r in quality.clean_text(docs).collect()}[2] == good
    assert quality.judged(docs.limit(0)).collect() == []
