"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds the hashes of its distinct SHINGLE-word shingles. Documents with equal sets form a class, and only
one of each class is looked at further. Two collections of SIDE sketches, each of two minhashes, are formed; the key of
a table combines a sketch of one collection with one of the other, so 4 * SIDE minhashes serve SIDE ** 2 tables of four
minhashes each. A key can be shared only if both its sketches are, so sketches that nobody shares are dropped first.
At a similarity of 0.8 a pair is missed by all tables with a probability of 2 * (1 - 0.8 ** 2) ** SIDE, below 1e-4.

Candidates are confirmed on full sets. The smallest member of a bucket is its pivot. Each member is compared with the
smallest of its pivots, then with those of its pivots that this left in another component; for most groups that settles
it. Where a bucket's members still lie in several components, those outside the largest one are held against all members
in blocks: a task counts the common shingles of two blocks as a product of 0/1 matrices, and only links that join two
components leave it. So no link in a bucket is lost, and no pairs are emitted. Members meet their pivot in blocks too, so
a pivot's text is sent once for BLOCK_BYTES of members and no group of copies meets in one task.

Components come from rounds that give each node its smallest neighbour as parent, hang its other neighbours on that and
shorten all paths to a third. Aggregates are written before they are joined, so that both sides of a join are plain exchanges: Spark
splits the partitions of a node or pivot with very many rows. Tables that nothing reads again are deleted.

Null and empty texts have no shingles and link with nothing. A text with fewer words than a shingle is one shingle.
Rows that share a doc_id are documents of their own; a component is named by the smallest id that is not null, and a
null doc_id is kept only if its component has no other. `kept` marks all rows with that id; drop_near_duplicates leaves
one row of a component. An empty table gives an empty result. Other columns are not read. doc_id must be an integer.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceloom.llm import words as W
from priceloom.llm.shared import ASCII_WORD, discard, row_hash, stored, table

SHINGLE, SIDE, SIMILAR = 4, 10, 80
#: Rows up to which a list of documents to fetch is sent to every task; a longer one is joined by a shuffle.
SEND_ROWS = 200_000
#: The most rows and bytes of a block of texts, and how many shingles are counted at a time.
BLOCK_ROWS, BLOCK_BYTES, SLAB = 384, 2 << 20, 4096
#: The most members that meet their pivot in one block.
PIVOT_ROWS = 128
#: Bytes of text sketched at a time.
PIECE_BYTES = 1 << 20
_SALT, _ODD = W.constants(4 * SIDE, 11), W.constants(4 * SIDE, 12)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = W.split(texts, W.SPACED)
    h = W.fingerprints(words, fold=True)
    g = W.grams(h, width)
    out = []
    for a, b in zip(words.base[:-1], words.base[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(g[a : b - width + 1]))
        else:
            out.append(W.grams(h[a:b], b - a, seed=30 + b - a)[:1] if b > a else np.zeros(0, W.U64))
    return out


def _sketch(batches, width: int):
    for batch in W.pieces(batches, limit=PIECE_BYTES):
        sets = shingle_sets(batch.column("text"), width)
        size = np.array([len(s) for s in sets])
        some = np.flatnonzero(size)
        start = (np.cumsum(size) - size)[some]
        flat = np.concatenate([*sets, np.zeros(0, W.U64)])
        least = np.zeros((len(sets), 4 * SIDE), W.U64)
        whole = np.zeros((len(sets), 2), W.U64)
        if len(some):
            for k in range(4 * SIDE):
                least[some, k] = np.minimum.reduceat((flat ^ _SALT[k]) * _ODD[k], start)
            whole[some, 0] = np.add.reduceat(W.mix(flat), start)
            whole[some, 1] = np.add.reduceat(W.mix(flat ^ _SALT[0]), start)
        pairs = W.mix(least[:, 0::2] + W.mix(least[:, 1::2])).view(np.int64)
        lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
        n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(size, pa.int64()), n_bytes, pa.array([x.tobytes() for x in whole], pa.binary()), lists(pairs[:, :SIDE]), lists(pairs[:, SIDE:])],
            ["doc_id", "mark", "n_shingles", "bytes", "whole", "left", "right"],
        )


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def sketches(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, mark (of the text), n_shingles, bytes, whole (names the set) and both collections of sketches."""
    return _marked(docs).mapInArrow(lambda b: _sketch(b, width), "doc_id long, mark long, n_shingles long, bytes long, whole binary, left array<long>, right array<long>")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """key, pivot (its smallest node), for every key that several nodes have. The sums start before the shuffle."""
    return stored(rows.groupBy(key).agg(F.min("node").alias("pivot"), F.max("node").alias("top")).filter("pivot < top").select(key, "pivot"))


def members(classes: DataFrame) -> DataFrame:
    """pivot, node, bytes: the members of every bucket with two or more, once for each pivot. classes: node, bytes, left, right."""
    tag = lambda side: F.transform(side, lambda v, i: F.struct(F.lit(side == "left").alias("is_left"), F.xxhash64(F.lit(side), i, v).alias("sketch")))
    single = classes.select("node", "bytes", F.inline(F.concat(tag("left"), tag("right"))))
    sketched = _shared(single, "sketch")
    common = single.join(sketched, "sketch", "left_semi")
    side = lambda is_left: F.collect_list(F.when(F.col("is_left") == is_left, F.col("sketch")))
    both = common.groupBy("node", "bytes").agg(side(True).alias("left"), side(False).alias("right"))
    rows = both.select("node", "bytes", F.explode("left").alias("l"), "right").select("node", "bytes", "l", F.explode("right").alias("r"))
    keyed = stored(rows.select("node", "bytes", F.xxhash64("l", "r").alias("key")))
    keys = _shared(keyed, "key")
    found = stored(keyed.join(keys, "key").select("pivot", "node", "bytes").filter("pivot < node").distinct())
    discard(sketched, keyed, keys)
    return found


def _alike(size_a: np.ndarray, size_b: np.ndarray, same: np.ndarray, similar: int) -> np.ndarray:
    return 100 * same >= similar * (size_a + size_b - same)


def _parts(n: Column, size: Column, rows: int) -> Column:
    return F.greatest(F.ceil(n / rows), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def _block(n: Column) -> Column:
    return F.pmod(F.xxhash64("node"), n).cast("int")


def confirmed(pairs: DataFrame, texts: DataFrame, similar: int = SIMILAR, width: int = SHINGLE) -> DataFrame:
    """a, b: those of the pairs (pivot, node, bytes) that are similar. Members meet their pivot in blocks."""
    split = stored(pairs.groupBy("pivot").agg(_parts(F.count("*"), F.sum("bytes"), PIVOT_ROWS).alias("parts")).filter("parts > 1"))
    dealt = stored(pairs.join(split, "pivot", "left").select("pivot", "node", _block(F.coalesce("parts", F.lit(1))).alias("block")))
    of = lambda rows, at: rows.join(texts.select(F.col("node").alias("text_of"), "text"), F.col(at) == F.col("text_of")).select("pivot", "block", F.col(at).alias("node"), "text")
    rows = of(dealt, "node").union(of(dealt.select("pivot", "block").distinct(), "pivot"))

    def compare(key, rows):
        pivot, nodes = key[0].as_py(), rows.column("node").to_numpy()
        sets = shingle_sets(rows.column("text"), width)
        own = next(s for s, n in zip(sets, nodes, strict=True) if n == pivot)
        same = np.array([len(np.intersect1d(own, s, assume_unique=True)) for s in sets])
        alike = _alike(len(own), np.array([len(s) for s in sets]), same, similar) & (nodes != pivot)
        return pa.table({"a": np.full(alike.sum(), pivot), "b": nodes[alike]})

    found = stored(rows.groupBy("pivot", "block").applyInArrow(compare, "a long, b long"))
    discard(split, dealt)
    return found


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b); root is the smallest node that can be reached."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        parent = stored(now.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        above = lambda at, top: parent.select(F.col("u").alias(at), F.col("m").alias(top))
        hung = parent.select("u", "m").join(above("m", "up"), "m", "left").join(above("up", "top"), "up", "left")
        hung = hung.select("u", F.coalesce("top", "up", "m").alias("v"), F.col("up").isNotNull().alias("moved"))
        several = not parent.filter("n > 1").isEmpty()
        if several:
            # The other neighbours of a node hang on its parent from now on.
            rest = now.join(parent, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved"))
            hung = hung.union(rest).groupBy("u", "v").agg(F.max("moved").alias("moved"))
        before, now = now, stored(hung)
        discard(before, parent)
        if not several and now.filter("moved").isEmpty():
            found = stored(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct()))
            discard(now)
            return found


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root, of all nodes) after the links (a, b) between roots. Both tables are discarded."""
    if links.isEmpty():
        discard(links)
        return roots
    found = components(links)
    out = stored(roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    discard(roots, links, found)
    return out


def _at_roots(pairs: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
    """pairs with root_<column>, the root of the node in each of the columns."""
    for c in columns:
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c)
    return pairs


def _cross(rest: pa.Table, others: pa.Table, similar: int, width: int) -> pa.Table:
    """Links between two blocks of nodes, as pairs of roots: no more than it takes to join the roots that they join."""
    a, b = (shingle_sets(x.column("text"), width) for x in (rest, others))
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))
    same = np.zeros((len(a), len(b)), np.float32)
    at = [[np.searchsorted(common, s[np.isin(s, common, assume_unique=True)]) for s in side] for side in (a, b)]
    for low in range(0, len(common), SLAB):
        ones = []
        for side in at:
            part = np.zeros((len(side), SLAB), np.float32)
            for k, own in enumerate(side):
                part[k, own[np.searchsorted(own, low) : np.searchsorted(own, low + SLAB)] - low] = 1
            ones.append(part)
        same += ones[0] @ ones[1].T
    size_a, size_b = (np.array([len(s) for s in side]) for side in (a, b))
    root_a, root_b = rest.column("root").to_numpy(), others.column("root").to_numpy()
    i, j = np.nonzero(_alike(size_a[:, None], size_b[None, :], same.astype(np.int64), similar) & (root_a[:, None] != root_b[None, :]))
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    links = []
    for x, y in np.unique(np.stack([root_a[i], root_b[j]], axis=1), axis=0).tolist():
        if (p := top(x)) != (q := top(y)):
            up[max(p, q)] = min(p, q)
            links.append((x, y))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _across(star: DataFrame, roots: DataFrame, texts: DataFrame, similar: int, width: int) -> DataFrame:
    """a, b: links between roots that join members of one pivot's buckets (star: pivot, node, bytes).

    The members outside the most frequent component of a pivot are held against all members, block by block; the pivot was
    held against all of them before.
    """
    at = stored(_at_roots(star.select("pivot", "node", "bytes"), roots, "node").withColumnRenamed("root_node", "root"))
    per_root = at.groupBy("pivot", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    per_pivot = per_root.groupBy("pivot").agg(F.max(F.struct("n", "root", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("roots"))
    open_ = per_pivot.filter("roots > 1").select(
        "pivot",
        F.col("top.root").alias("main"),
        _parts(F.col("n"), F.col("bytes"), BLOCK_ROWS).alias("n_all"),
        _parts(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes"), BLOCK_ROWS).alias("n_rest"),
    )
    open_ = stored(open_)
    met = at.join(open_, "pivot").join(texts.select("node", "text"), "node")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = met.filter("root <> main").select("pivot", "root", "text", _block(F.col("n_rest")).alias("i"), upto("n_all").alias("j"))
    others = met.select(*[F.col(c).alias(c) for c in ("pivot", "root", "text")], upto("n_rest").alias("i"), _block(F.col("n_all")).alias("j"))
    keys = ["pivot", "i", "j"]

    def cross(rest, others):
        some = rest.num_rows and others.num_rows
        return _cross(rest, others, similar, width) if some else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    found = stored(rest.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(cross, "a long, b long"))
    discard(at, open_)
    return found


def roots_of(star: DataFrame, texts: DataFrame, similar: int = SIMILAR, width: int = SHINGLE) -> DataFrame:
    """node, root for all nodes of texts (node, bytes, text), joined by the similar pairs of each bucket (star: pivot, node, bytes)."""
    roots = stored(texts.select("node", F.col("node").alias("root")))
    first = stored(star.groupBy("node").agg(F.min("pivot").alias("pivot"), F.first("bytes").alias("bytes")))
    roots = _joined(roots, confirmed(first, texts, similar, width))
    apart = stored(_at_roots(star, roots, "pivot", "node").filter("root_pivot <> root_node").select("pivot", "node", "bytes"))
    if not apart.isEmpty():
        links = confirmed(apart, texts, similar, width)
        roots = _joined(roots, stored(_at_roots(links, roots, "a", "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))))
        discard(links)
        roots = _joined(roots, _across(star, roots, texts, similar, width))
    discard(first, apart)
    return roots


def _judged(docs: DataFrame, similar: int, width: int) -> DataFrame:
    """The columns of near_duplicates and root, a number of the component; null for rows without shingles."""
    rows = stored(sketches(docs, width))
    classes = rows.filter("n_shingles > 0").groupBy("whole").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("bytes", "doc_id", "mark")).alias("one"), F.first("left").alias("left"), F.first("right").alias("right")
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    star = members(classes.select("node", "one.bytes", "left", "right"))
    nodes = star.select("node").union(star.select("pivot")).distinct()
    wanted = stored(classes.select("node", "one.doc_id", "one.mark").join(nodes, "node", "left_semi"))
    few = wanted.count() <= SEND_ROWS
    source = _marked(docs)
    same = source["doc_id"].eqNullSafe(wanted["doc_id"]) & (source["mark"] == wanted["mark"])
    texts = stored(source.join(F.broadcast(wanted) if few else wanted, same).select("node", F.octet_length("text").cast("long").alias("bytes"), "text").dropDuplicates(["node"]))
    roots = roots_of(star, texts, similar, width)
    labelled = classes.select("whole", "node", "first_id").join(roots, "node", "left")
    names = stored(labelled.filter("root IS NOT NULL").groupBy("root").agg(F.min("first_id").alias("least_id")))
    alone = F.col("root").isNull()
    named = labelled.join(names, "root", "left").select("whole", F.when(alone, F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"), F.coalesce("root", "node").alias("root"))
    named = stored(named)
    discard(classes, star, wanted, texts, roots, names)
    joined = rows.filter("n_shingles > 0").select("doc_id", "mark", "n_shingles", "whole").join(named, "whole").drop("whole")
    none = rows.filter("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return joined.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, similar: int = SIMILAR, width: int = SHINGLE) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, kept for every row of docs; mark is the xxhash64 of the text."""
    return _judged(docs, similar, width).drop("root")


def drop_near_duplicates(docs: DataFrame, similar: int = SIMILAR, width: int = SHINGLE) -> DataFrame:
    """One row of each component of docs, and all rows without shingles.

    The row with the smallest doc_id stays, nulls last, then the smallest mark. Of rows equal in both, one stays: the one
    with the smallest hash of its columns. Texts are shuffled once.
    """
    best = _judged(docs, similar, width).filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("best"))
    stay = stored(best.select(F.coalesce("best.doc_id", F.lit(0)).alias("id"), "best.none", "best.mark"))
    key = ["id", "none", "mark"]
    worded = F.coalesce(F.col("text").rlike(ASCII_WORD), F.lit(False))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.filter(worded).select(F.struct("*").alias("row"), row_hash(docs).alias("least"), F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"), F.xxhash64("text").alias("mark"))
    # Spark drops all but the first of equal rows before the shuffle too.
    once = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("least"))).filter("nth = 1")
    return docs.filter(~worded).unionByName(once.join(stay, key, "left_semi").select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


_W = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT doc_id, len(s)::BIGINT AS n_shingles, low AS component_id, doc_id = low AS kept
FROM s JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) ON a = doc_id
"""
