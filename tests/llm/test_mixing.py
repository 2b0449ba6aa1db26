"""The mix holds what its query says, row by row, whatever repeats."""

from collections import Counter

from pyspark.sql import functions as F

from priceloom.llm import mixing


def test_mix_takes_what_the_query_says(spark):
    rows = [(k % 50 if k % 7 else None, " ".join(["w"] * (k % 9)) if k % 11 else None, f"s{k % 3}" if k % 5 else None, {"k": k % 2}) for k in range(400)] + [(1, "a b c", "s1", {"k": 0})] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,int>").withColumns({"row": F.lit("r"), "g": F.lit(1), "mark": F.lit("m"), "size": F.lit(-1)})
    words = lambda t: len((t or "").split())
    want = Counter()
    for r in mixing.copies(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = Counter((r.doc_id, r.source, words(r.text)) for r in mixing.mix(docs).collect())
    assert got == +want
    again = Counter(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert again == Counter(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs.limit(0)).collect() == []
    taken = Counter(str(r) for r in mixing.mix(docs.filter("doc_id = 1 AND source = 's1' AND text = 'a b c'")).collect())
    assert max(taken.values()) <= 2 * 70
