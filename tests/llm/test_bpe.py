"""BPE against the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from priceloom.llm import bpe
from tests.conftest import SF

PARTS = [*"aabbcdeé  st\n\t12ß漢.,!'", "<|endoftext|>", "'re", " \n", " ", "\x1c", " ", "\x85", "👍🏽", "the ", "tion", "  ", "<|endof"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read()


def texts_of(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def encoded(texts, vocabulary):
    ids, counts = bpe.Encoder(vocabulary).ids(texts)
    ends = counts.cumsum()
    return [ids[b - n : b].tolist() for b, n in zip(ends, counts, strict=True)]


@pytest.mark.parametrize("symbols", [1, 300, bpe.INDEX_SYMBOLS])
def test_same_ids_as_the_library(library, vocabulary, monkeypatch, symbols):
    monkeypatch.setattr(bpe, "INDEX_SYMBOLS", symbols)
    texts = [*texts_of(1, 300), "", " ", "a" * 5000, "ab" * 3000 + " " * 2000, "<|endoftext|>" * 3]
    assert encoded(texts, vocabulary) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_is_cut_as_the_library_does(library, vocabulary):
    texts = [f"a{c}1{c}.{c}{c} {c} b" for c in map(chr, [*range(0x3100), *range(0xA000, 0xA100), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)])]
    assert encoded(texts, vocabulary) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_rows(spark, library, vocabulary):
    texts = [None, "", *texts_of(2, 40), "x y" * 70_000]
    docs = spark.createDataFrame([(k // 2, t, "r", [k], 0) for k, t in enumerate(texts)], "doc_id long, text string, row string, ids array<int>, n int").repartition(3)
    rows = bpe.encode(docs, vocabulary)
    assert rows.columns == ["row", "ids"] and rows.schema["row"].dataType.names == ["doc_id", "row", "ids", "n"]
    got = {r.row.ids[0]: r.ids for r in rows.collect()}
    assert got == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    back = bpe.decode(rows.selectExpr("row.ids[0] AS k", "ids"), vocabulary).select("row.k", "text").collect()
    assert {r.k: r.text for r in back} == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.encode(docs.limit(0), vocabulary).collect() == []
    assert bpe.encode(docs.select("text"), vocabulary).count() == len(texts)


def test_any_ids_decode_as_the_library_does(spark, library, vocabulary):
    rng = random.Random(3)
    lists = [[rng.randrange(50257) for _ in range(rng.randint(0, 30))] for _ in range(200)] + [[50256, 0, 50256], [200, 201, 202], []]
    rows = spark.createDataFrame([(k, i) for k, i in enumerate(lists)], "k int, ids array<long>")
    got = {r.row.k: r.text for r in bpe.decode(rows, vocabulary).collect()}
    assert got == {k: library.decode(i, skip_special_tokens=False) for k, i in enumerate(lists)}
    odd = spark.createDataFrame([(1, None), (2, [None, 64, -1, 99_999])], "k int, ids array<int>")
    assert {r.row.k: r.text for r in bpe.decode(odd, vocabulary).collect()} == {1: "", 2: library.decode([64])}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary.read(bpe.PATH.replace("byte_bpe_50k", "word_bpe_49k"))


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for d, t in docs.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
    rows = bpe.query(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(docs)
