"""Scores of the language model against a plain version, word by word."""

import random
import re
from math import exp, log

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from priceloom.llm import languages as L
from tests.conftest import SF


def plain_word(model, words, grams, word):
    """Score in each language, and the share of the word that is known."""
    if word in words:
        return list(words[word]), 1.0
    padded, at, rows, seen = f" {word} ", 0, [], set()
    while at < len(padded):
        n = next((n for n in range(L.LONGEST, 0, -1) if at + n <= len(padded) and padded[at : at + n] in grams), 0)
        if n:
            rows.append([x + (L.LONGEST - n) * log(L.BACKOFF) for x in grams[padded[at : at + n]]])
            seen |= {k for k in range(at, at + n) if n >= L.KNOWN or any(low <= ord(padded[k]) <= high for low, high in L.UNSPACED)}
        at += max(1, n - 1)
    scores = [sum(r[k] for r in rows) / len(rows) for k in range(len(model.languages))] if rows else [log(1e-7)] * len(model.languages)
    return scores, len(seen - {0, len(padded) - 1}) / len(word)


def plain(model, words, grams, text):
    found = [plain_word(model, words, grams, w) for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    if not found:
        return "und", 0.0, 0.0
    sums = [sum(s[k] for s, _ in found) for k in range(len(model.languages))]
    best = max(range(len(sums)), key=lambda k: sums[k])
    return model.languages[best], 1 / sum(exp(max(-50.0, L.SHARPEN * (x - max(sums)))) for x in sums), sum(k for _, k in found) / len(found)


@pytest.fixture(scope="module")
def small():
    rng = random.Random(6)
    syllables = {"aa": "ba ri to lo", "bb": "sch un ker ta", "zh": "的 一 是 不 了 人"}
    words, grams = {}, {}
    for k, parts in enumerate(syllables.values()):
        for _ in range(40):
            word = "".join(rng.choices(parts.split(), k=rng.randint(1, 3)))
            words.setdefault(word, [-9.0, -9.0, -9.0])[k] = -rng.random() * 4
            padded = f" {word} "
            for n in range(1, L.LONGEST + 1):
                for i in range(len(padded) - n + 1):
                    grams.setdefault(padded[i : i + n], [-9.0, -9.0, -9.0])[k] = -rng.random() * 4
    import numpy as np

    def table(scores):
        """A table that says every score, so that nothing rests on the shared one."""
        n = len(syllables)
        rows = np.array(list(scores.values()))
        return pa.array(list(scores)), L.Table(np.arange(len(rows) + 1) * n, np.tile(np.arange(n), len(rows)), rows.ravel(), np.zeros(n))

    return L.Model(list(syllables), table(words), table(grams)), words, grams


def test_scores_are_those_of_the_plain_version(small):
    model, words, grams = small
    rng = random.Random(7)
    letters = "barilotschunke的一是不了xyzñ"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts += [None, "", " 12 !", "Bari TOLO schunker", "x" * 5000, "的一是" * 900, "qqqq", "bari" * 700, "퟿ \U0001f600 ba"]
    names, scores, known = L._judge(model, pa.array(texts))
    for text, *got in zip(texts, names, scores, known, strict=True):
        want = plain(model, words, grams, text)
        assert got[0] == want[0] and got[1:] == pytest.approx(want[1:]), text


def test_odd_tables_have_defined_results(spark):
    docs = spark.createDataFrame([(1, None, "x", "y"), (1, "", "x", "y"), (None, "12 !", "x", "y"), (2, "Guten Tag", "x", "y"), (2, "Guten Tag", "x", "y")], "doc_id long, text string, lang_pred string, score string")
    empty = L.learn(docs.limit(0).selectExpr("text", "text AS lang"))
    assert {(r.lang_pred, r.score, r.known) for r in L.identify(docs, empty).collect()} == {("und", 0.0, 0.0)}
    model = L.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    got = L.identify(docs, model).collect()
    assert sorted(r.lang_pred == "und" for r in got) == [False, False, True, True, True] and len({(r.lang_pred, r.score) for r in got if r.row.doc_id == 2}) == 1
    assert [r.row.lang_pred for r in got] == ["x"] * 5 and L.identify(docs.limit(0), model).collect() == []


def test_tables_are_smoothed_frequencies():
    import numpy as np

    counts = [{0: 3, 2: 1}, {1: 5}, {}, {0: 1}]
    lang, n = [k for c in counts for k in c], [float(x) for c in counts for x in c.values()]
    table = L.counted_table(np.cumsum([0, *map(len, counts)]), np.array(lang), np.array(n), 3)
    total = [4, 5, 1]
    want = [[log((c.get(k, 0) + L.SMOOTH) / (total[k] + L.SMOOTH * 5)) for k in range(3)] for c in counts]
    assert table.dense(np.array([3, 0, 1, 2, 0])) == pytest.approx(np.array([want[k] for k in (3, 0, 1, 2, 0)]))


def test_copies_and_other_languages(spark):
    """Two hundred thousand copies of one labelled text teach it once, beside few others; rows without an id teach nothing."""
    copies = spark.range(200_000).selectExpr("'only this text, again and again' AS text", "'en' AS lang")
    others = spark.createDataFrame([(f"noch ein text {k} mehr", "de") for k in range(50)] + [("again", "en"), (None, "fr"), ("rien", None)], "text string, lang string")
    model = L.learn(copies.unionAll(others), 100)
    assert model.languages == ["de", "en"]
    docs = spark.createDataFrame([(1, "this text again"), (2, "noch mehr")], "doc_id long, text string")
    assert {r.row.doc_id: r.lang_pred for r in L.identify(docs, model).collect()} == {1: "en", 2: "de"}
    ids = spark.createDataFrame([(None,), (1,), (4,)], "doc_id long").select(L.held_out(F.col("doc_id")), L.learnt(F.col("doc_id"))).collect()
    assert tuple(ids[0]) == (False, False) and all(a != b for a, b in ids[1:])
