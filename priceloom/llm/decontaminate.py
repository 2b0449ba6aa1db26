"""Benchmark decontamination: an FM-index per shard of documents is searched for every benchmark window.

Windows are WIDTH consecutive words of an item; a shorter item is one window. A shard is a slice of documents of about
SHARD_BYTES. An occurrence consists of benchmark words only, so the index is built over the shard's runs of benchmark words
that are long enough, set apart by separators; nothing that could match is left out. Windows are found by backward search,
their places by sampled suffix positions, and overlapping ones are merged into removal spans.

The benchmark is cut into pieces that overlap by a window, and the pieces are dealt to blocks of about BLOCK_BYTES. Tasks
build the windows of a block as arrays; the driver hands each block on to the others and holds one at a time. A task searches
a shard for one block after the other and holds one block, so a large benchmark costs time, not memory. PASS blocks, with a
bounded size, go with one pass over the documents; more take a further pass. Nothing of the documents is shuffled.

Null and empty texts have no words and no hits; null and empty items have no windows. Item ids may be of any type that is
a string when cast; items with one id are one item, and so are all items without an id, which has no name but counts.
Repeated rows are handled alike. Other columns are not read. An empty benchmark hits nothing.
"""

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.llm import words as W
from priceloom.llm.fmindex import FMIndex
from priceloom.llm.shared import table

WIDTH = 10
#: Bytes of benchmark text in a block and in a piece of an item, and blocks of one pass.
BLOCK_BYTES, PIECE_BYTES, PASS = 4 << 20, 1 << 20, 32
#: Bytes of documents searched at a time.
SHARD_BYTES = 8 << 20
#: Symbols of an index; a shard with more benchmark words gets several.
INDEX_SYMBOLS = 1 << 20


class Phrases:
    """The distinct windows of some items, by length, in symbols of their own vocabulary."""

    def __init__(self, items: list, texts: pa.Array, width: int = WIDTH):
        words = W.split(texts, W.ALNUM)
        marks = W.fingerprints(words, fold=True)
        self.vocabulary = np.unique(marks)
        symbols = (np.searchsorted(self.vocabulary, marks) + 1).astype(np.int32)
        #: The names of the items, None for those without an id.
        self.names = sorted({i for i in items if i is not None}) + [None] * (None in items)
        number = {name: k for k, name in enumerate(self.names)}
        item = np.array([number[i] for i in items], np.int64)[words.document()]
        length = np.minimum(words.counts, width)[words.document()]
        starts = np.arange(len(symbols))
        starts = starts[np.repeat(words.base[1:], words.counts) - starts >= length]
        #: For each length the distinct windows, and of each the items that hold it: owners[offsets[k] : offsets[k + 1]].
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(length):
            own = starts[length[starts] == n]
            windows = symbols[own[:, None] + np.arange(n)]
            distinct, which = np.unique(windows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), item[own]], axis=1), axis=0)
            self.groups.append((distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))
        self.shortest = min((g[0].shape[1] for g in self.groups), default=0)
        self.likely = np.zeros(1 << 20, bool)
        self.likely[self.vocabulary >> np.uint64(44)] = True

    def symbols(self, marks: np.ndarray) -> np.ndarray:
        """The symbol of each word, 0 for those of no item."""
        out = np.zeros(len(marks), np.int64)
        maybe = np.flatnonzero(self.likely[marks >> np.uint64(44)])
        at = np.searchsorted(self.vocabulary, marks[maybe])
        same = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == marks[maybe]
        out[maybe[same]] = at[same] + 1
        return out

    def occurrences(self, words: W.Words, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word and length of each occurrence in the shard; and first word and item of each occurrence of an item."""
        none = np.zeros(0, np.int64)
        if not self.groups or not len(words.starts):
            return none, none, none, none
        symbols = self.symbols(marks)
        begins = np.zeros(len(symbols) + 1, bool)
        begins[words.base] = True
        known = symbols > 0
        edge = np.diff(known.astype(np.int8), prepend=0, append=0)
        starts = np.flatnonzero((edge == 1) | (begins & np.append(known, False)))
        ends = np.flatnonzero((edge == -1) | (begins & np.append(False, known)))
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        found: list[tuple[np.ndarray, ...]] = []
        total = np.cumsum(ends - starts + 1)
        for k in np.unique(total // INDEX_SYMBOLS):
            mine = total // INDEX_SYMBOLS == k
            s, e = starts[mine], ends[mine]
            size = e - s + 1  # with a separator
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            where = np.where(at < np.repeat(e - s, size), np.repeat(s, size) + at, -1)
            index = FMIndex(np.where(where >= 0, symbols[where], 0))
            for phrases, offsets, owners in self.groups:
                low, high = index.search(phrases)
                n = high - low
                which = np.repeat(np.arange(len(phrases)), n)
                first = where[index.locate(_ranges(low, n))]
                several = np.diff(offsets)[which]
                found.append((first, np.full(len(first), phrases.shape[1]), np.repeat(first, several), owners[_ranges(offsets[which], several)]))
        return tuple(np.concatenate([f[k] for f in found]) if found else none for k in range(4))


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... for n numbers, each after the other."""
    return np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


FOUND = pa.struct([("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string())), ("n_words", pa.int64())])
FOUND_SQL = "struct<spans:array<struct<first:bigint,last:bigint>>,items:array<string>,n_words:bigint>"


def _scan(blocks, texts: pa.Array, earlier: list | None) -> pa.Array:
    """One shard: the spans (first word, word after the last) and items of each document, with those found earlier."""
    words = W.split(texts, W.ALNUM)
    marks = W.fingerprints(words, fold=True)
    doc_of = lambda at: np.searchsorted(words.base, at, "right") - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    items: list[set] = [set() for _ in range(len(texts))]
    for phrases in blocks:
        first, length, at, item = phrases.occurrences(words, marks)
        for d, a, b in np.unique(np.stack([doc_of(first), first, first + length], axis=1), axis=0).tolist():
            spans[d].append((a - int(words.base[d]), b - int(words.base[d])))
        for d, i in np.unique(np.stack([doc_of(at), item], axis=1), axis=0).tolist():
            items[d].add(phrases.names[i])
    for d, old in enumerate(earlier or ()):
        spans[d] += [(x["first"], x["last"]) for x in old["spans"]]
        items[d].update(old["items"])
    rows = [{"spans": merge(s), "items": sorted(i, key=lambda x: (x is None, x)), "n_words": int(n)} for s, i, n in zip(spans, items, words.counts, strict=True)]
    return pa.array(rows, FOUND)


def merge(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for first, last in sorted(spans):
        if out and first <= out[-1]["last"]:
            out[-1]["last"] = max(last, out[-1]["last"])
        else:
            out.append({"first": first, "last": last})
    return out


def pieces(benchmark: DataFrame, width: int = WIDTH, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """item, text: the items' words in pieces that overlap by a window less one word, each distinct piece once."""

    def cut(batches):
        for batch in W.pieces(batches):
            words = W.split(batch.column("text"), W.ALNUM)
            items, texts = [], []
            for item, first, last in zip(batch.column("item").to_pylist(), words.base[:-1], words.base[1:], strict=True):
                while first < last:
                    end = int(np.searchsorted(words.ends[:last], words.starts[first] + piece_bytes, "right"))
                    end = min(last, max(end, first + width))
                    items.append(item)
                    texts.append(words.text(first, end).decode())
                    first = last if end == last else end - width + 1
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], ["item", "text"])

    named = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text IS NOT NULL")
    return named.mapInArrow(cut, "item string, text string").distinct()


def _blocks(benchmark: DataFrame, width: int, block_bytes: int):
    """The pickled Phrases of each block, one after the other."""
    rows = pieces(benchmark, width, min(PIECE_BYTES, block_bytes))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0

    def build(group):
        return pa.table({"packed": pa.array([pickle.dumps(Phrases(group.column("item").to_pylist(), group.column("text"), width))], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, -(-total // block_bytes)))))
    return (bytes(r.packed) for r in dealt.groupBy("block").applyInArrow(build, "packed binary").toLocalIterator())


def find_overlaps(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of docs in a struct `row`, with `found`: spans (first word, word after the last), items, n_words."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"), F.lit(None).cast(FOUND_SQL).alias("found"))
    sent = [docs.sparkSession.sparkContext.broadcast(packed) for packed in _blocks(benchmark, width, block_bytes)]
    for k in range(0, max(1, len(sent)), PASS):

        def search(batches, own=sent[k : k + PASS]):
            only = pickle.loads(own[0].value) if len(own) == 1 else None

            def one_by_one():
                for block in own:
                    yield only or pickle.loads(block.value)
                    vars(block).pop("_value", None)  # the next block takes its place

            for batch in W.pieces(batches, limit=shard_bytes):
                texts, found = batch.column("text"), batch.column("found")
                earlier = None if found.null_count == len(found) else found.to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("row"), texts, _scan(one_by_one(), texts, earlier)], ["row", "text", "found"])

        rows = rows.mapInArrow(search, rows.schema)
    return rows.select("row", "found")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no benchmark window occurs."""
    return find_overlaps(docs, benchmark, **options).filter(F.size("found.spans") == 0).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("found.items")), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
    )


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '{_W}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_W}') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i+9], ' '))) AS x
       FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS x
       FROM d, lens WHERE len(w) >= n),
hit AS (SELECT DISTINCT r, i, n, x FROM dw SEMI JOIN bw USING (n, x)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, list(DISTINCT item_id::VARCHAR ORDER BY item_id::VARCHAR) AS items FROM hit JOIN bw USING (n, x) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
