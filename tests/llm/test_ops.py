import random
import re

import pytest
from pyspark.sql import functions as F

from priceloom.llm import chats, decontaminate, languages, licences, mixing, neardups, pages, quality, queries, sharding, substrings
from tests.conftest import SF

LONG = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
TEXTS = [(None, "apache license here and nothing else to see"), (1, None), (2, ""), (3, "one two"), (3, "one two"), (4, LONG), (5, LONG + " end"), (6, " \t\n"), (7, "Straße ñandú 漢字"), (8, "A" * 200_000)]
CLASHING = "row string, key string, node string, block string, found string, n string, h string, mark string, found_id string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long, repeated and equal rows, with columns of clashing names."""
    rows = [(d, t, None if k % 2 else "en", "s" if k % 3 else None, len(t or ""), *"abcdefghi") for k, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(same, name):
    same(queries.QUERIES[name], queries.SQL[name])


OPERATORS = {
    "substrings": lambda d: substrings.dedup_substrings(d, block_bytes=1000, group=100),
    "licences": licences.scan_licences,
    "mixing": mixing.mix,
    "languages": lambda d: languages.identify(d, languages.learn(d)),
    "decontaminate": lambda d: decontaminate.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id = 3")),
    "neardups": neardups.drop_near_duplicates,
    "sharding": lambda d: sharding.shard_rows(d, 1000),
    "quality": quality.judged,
    "clean": quality.clean_text,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, name):
    assert OPERATORS[name](odd).collect() is not None
    assert OPERATORS[name](odd.limit(0)).collect() == []


def test_rows_that_must_stay(odd):
    assert substrings.dedup_substrings(odd).count() == len(TEXTS)
    assert decontaminate.find_overlaps(odd, odd.select(F.col("doc_id").alias("item_id"), "text")).count() == len(TEXTS)
    assert sharding.shard_rows(odd, 1000).count() == len(TEXTS)
    kept = {r.doc_id for r in neardups.drop_near_duplicates(odd).collect()}
    assert kept == {None, 1, 2, 3, 4, 6, 7, 8}


def test_substrings_in_small_groups(spark):
    rng = random.Random(1)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for d in range(40):
        own = [rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = passage[rng.randint(0, 12) :]
        rows.append((d, " ".join(own)))
    found = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=900, group=50).collect()
    got, spans = {r.doc_id: r.kept for r in found}, {r.doc_id: {p for s in r.spans for p in range(s["first"], s["last"])} for r in found}
    seen: dict[tuple, int] = {}
    for d, text in rows:
        words = text.split()
        for i in range(len(words) - 12):
            seen.setdefault(tuple(words[i : i + 13]), d)
    for d, text in rows:
        words = text.split()
        gone = {p for i in range(len(words) - 12) if seen[tuple(words[i : i + 13])] < d for p in range(i, i + 13)}
        assert got[d] == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert spans[d] == gone


def test_neardups_in_a_family_of_unlike_copies(spark, monkeypatch):
    """Copies of copies: many pairs near the limit, held against all pairs, in blocks of a few rows."""
    monkeypatch.setattr(neardups, "BLOCK_ROWS", 7)
    monkeypatch.setattr(neardups, "PIVOT_ROWS", 3)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for d in range(120):
        own = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 5))):
            own[rng.randrange(len(own))] = f"x{rng.random()}"
        rows.append((d * 7 % 1000, " ".join(own)))
    shingles = {d: {tuple(t.split()[i : i + 4]) for i in range(147)} for d, t in rows}
    root = {d: d for d in shingles}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in shingles:
        for b in shingles:
            same = len(shingles[a] & shingles[b])
            if a < b and 100 * same >= 80 * (len(shingles[a]) + len(shingles[b]) - same):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {d: find(d) for d in shingles}
    got = {r.doc_id: r.component_id for r in neardups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(want.values())) > 1
    assert got == want


def test_one_row_of_each_group_of_near_duplicates_stays(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(100))
    near = lambda k: f"{text(k)} end"
    rows = [
        *[(1, text(1), "a"), (1, text(1), "a"), (1, text(1), "b"), (2, text(1), "a"), (None, text(1), "a")],  # repeated rows
        *[(5, text(2), "a"), (5, near(2), "a"), (6, near(2), "a")],  # near copies of one id
        *[(None, text(3), "a"), (None, text(3), "b"), (None, near(3), "a")],  # no id at all
        *[(1, text(4), "a"), (None, text(5), "a")],
        *[(7, None, "a"), (7, None, "a"), (8, "", "a")],  # these link with nothing
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tags", F.create_map(F.lit("k"), F.lit(1)))
    got = neardups.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    found = [(r.doc_id, (r.text or "-")[:2]) for r in got.collect()]
    assert sorted(found, key=str) == sorted([(1, "t1"), (5, "t2"), (None, "t3"), (1, "t4"), (None, "t5"), (7, "-"), (7, "-"), (8, "-")], key=str)


def test_licences_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(-1, f"x {dict(reversed(licences.CLAUSES))['bsd']} y"), (-2, "GNU general, public License? cc by cc BY mit license"), (-3, "the license of this work and that"), (-4, dict(licences.CLAUSES[:25])["lgpl"])]
    docs = docs.union(spark.createDataFrame(extra, "doc_id long, text string"))
    found = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    for d in docs.collect():
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in d.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places = sorted((i, label) for phrase, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        row = found[d.doc_id]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert (row.first_word, row.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, row.base_labels.split(","))) <= set(filter(None, row.labels.split(",")))
        assert 0 <= row.score <= 1
    assert found[-1].labels == "bsd" and "lgpl" in found[-4].labels.split(",")
    assert found[-3].labels == ""


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = languages.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in found if r.held_out]
    assert own and sum(r.lang_pred == r.lang for r in own) >= 0.95 * len(own)
    odd = spark.createDataFrame([(1, None), (2, "12 34 !"), (3, "")], "doc_id long, text string")
    model = languages.learn(docs)
    assert [(r.lang_pred, r.score) for r in languages.identify(odd, model).collect()] == [("und", 0.0)] * 3


def test_only_learned_languages_pass(spark):
    import corpus_pipeline

    rng = random.Random(3)
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(60))
    chinese = lambda: "，".join("".join(rng.choices("的一是不了人我在有他这为之大来以个中上们", k=rng.randint(4, 12))) for _ in range(30))
    strange = ["съешь ещё этих мягких французских булок да выпей чаю " * 40, "わたしはガラスを食べられます、それは私を傷つけません。" * 40, "ξεσκεπάζω την ψυχοφθόρα βδελυγμία " * 40, noise]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    more = [(-k, t, None) for k, t in enumerate(strange, 1)] + [(10**6 + k, chinese(), "zh") for k in range(40)]
    every = docs.union(spark.createDataFrame(more, docs.schema))
    got = {r.doc_id for r in corpus_pipeline.in_known_language(spark, every, SF).select("doc_id").collect()}
    with_letters = {r.doc_id for r in every.filter(F.col("text").rlike(r"\p{L}")).collect()}
    assert got == {d for d in with_letters if d >= 0} and len(got) > 200
    known = {r.doc_id: r.known for r in languages.identify(every, languages.learn(docs)).select("row.doc_id", "known").collect()}
    assert known[-1] == known[-2] == known[-3] == 0 < known[-4] < 0.4


def test_pages_held_out():
    by = pages.field()
    made = pages.labelled_pages(200, seed=99)
    right = sum(pages.main_text(html, by) == "\n\n".join(main) for html, main in made)
    assert right >= 0.93 * len(made)
    assert pages.main_text(None, by) == pages.main_text("", by) == ""
    assert pages.main_text("<article><p>a&nbsp;&amp; b\n c.</p><p>Second one.<script>x</script></article><footer>&copy; x</footer>", by) == "a & b c.\n\nSecond one."


@pytest.mark.parametrize(
    "html, text",
    [
        ("<html><head><title>T</title><body><article><p>First here.</p></article></body></html>", "First here."),
        ("<title>T</title><meta charset=utf-8><article><p>First here.</p></article>", "First here."),
        ("<html><head><title>T<body><article><p>First here.</p></article></html>", "First here."),
        ("<head><title>On <div> tags</title><noscript><div>Turn it on.</div></noscript><link rel=x></head><article><p>First here.</p></article>", "First here."),
        ("<head><noscript><style>x</style><body><article><p>First here.</p></article>", "First here."),
        ("<head><template><p>Later.</p></template><script>a</script><article><p>First here.</p></article>", "First here."),
        ("<article><noscript>Off.<p>First here.</p><p>Second here.</p></article>", "First here.\n\nSecond here."),
        ("<article><svg><path d='m'><p>First here.</p><p>Second here.</p></article>", "First here.\n\nSecond here."),
        ("<article><svg><foreignObject><div>Label</div></foreignObject></svg><p>First here.</p></article>", "First here."),
        ("<article><form><select><option>One<input></form><p>First here.</p></article>", "First here."),
        ("<article><p>So <math><semantics><mrow><mi>a</mi><mo>=</mo><mn>2</mn></mrow><annotation>a = 2</annotation></semantics></math> holds.</p></article>", "So a=2 holds."),
    ],
)
def test_pages_lose_no_article(html, text):
    assert "\n\n".join(b[0] for b in pages.Blocks().read(html).found) == text


def test_pages_without_head_end():
    by = pages.field()
    for html, _ in pages.labelled_pages(100, seed=5):
        assert pages.main_text(html.replace("</head>", ""), by) == pages.main_text(html, by)
        assert pages.main_text(html.replace("</title></head><body>", "<body>"), by) == pages.main_text(html, by)


def test_pages_table(spark):
    rows = spark.createDataFrame([(1, "u", None), (1, "u", None), (2, None, "<p>unclosed"), (3, "v", "<script>never closed")], "page_id long, url string, html string")
    assert pages.extract(rows).count() == 4
    assert pages.extract(rows.limit(0)).count() == 0


def test_mix_meets_its_targets(spark):
    found = mixing.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"), F.max(F.col("copies")).alias("copies")).collect():
        assert abs(r.taken - r.target) <= 2 * r.most and r.copies <= 2


def test_shards_hold_their_limit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in sharding.shards(docs, 60_000).groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("shard_bytes").alias("said")).collect():
        assert r.bytes == r.said and (r.bytes <= 60_000 or r.n == 1)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns[: len(columns)] == columns
    kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "2")).select("doc_id").collect()}
    near = {r.doc_id for r in neardups.query(spark, SF).filter("kept").collect()}
    hit = {r.doc_id for r in decontaminate.query(spark, SF).filter("contaminated").collect()}
    known = {r.doc_id for r in spark.read.parquet(str(tmp_path / "0")).select("doc_id").collect()}
    assert kept == (near & known) - hit
    assert sorted(docs.select(*columns).collect()) == sorted(corpus_pipeline.run(spark, SF).select(*columns).collect())
