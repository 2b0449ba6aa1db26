"""Substring deduplication with prefix-partitioned suffix trees, cut off at WIDTH words.

A suffix begins at a word and counts up to its WIDTH-th word. Suffixes are dealt out by a prefix of as many words as it
takes for a group to fit in memory: prefixes are counted two words at a time, those with more than GROUP suffixes are
extended by two more, and neighbours are joined to groups of about GROUP. Within a group the suffixes are sorted; a run of
equal ones is a node of the group's subtree at depth WIDTH, with at least two leaves if it repeats. Below that depth the
trees need no nodes: a maximal repeat is a chain of such windows, and its span is the union of theirs.

Documents are dealt to blocks by a hash of id and text. A block sends each distinct suffix once, with the smallest id
that has it, so however often a passage or a copy occurs, a group gets one leaf for it from each block. Back goes one
bit a leaf: whether another block has it with a smaller id. Suffixes go as 64-bit fingerprints of their words and are told
apart within their group only, which is named by hashes of other seeds: with some million suffixes in a group, a false
repeat is expected in fewer than one of a million groups. Sent as words, they would take ten times the text.

Null texts have no words. A null doc_id is larger than any other. Rows with one doc_id do not remove words from each
other. An empty table gives an empty result. Other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.llm import words as W
from priceloom.llm.shared import table

WIDTH = 13
BLOCK_BYTES = 8 << 20
GROUP = 2 << 20
#: Bits that each word of a prefix adds to its code, and the most words of a prefix.
BITS, DEEPEST = 6, 10
LAST_ID = np.iinfo(np.int64).max


def _codes(h: np.ndarray, depth: int) -> np.ndarray:
    """The codes of the prefixes of `depth` words; only starts with that many words behind them count."""
    code = np.zeros(len(h), np.int64)
    for k in range(1, depth + 1):
        own = W.grams(h, k, seed=100 + k) >> W.U64(64 - BITS)
        code[: len(own)] = (code[: len(own)] << BITS) | own.astype(np.int64)
    return code


def _count(batches, depth: int, opened: np.ndarray, width: int):
    """How many suffixes there are by prefix, below the prefixes `opened` of two words less."""
    for batch in W.pieces(batches):
        words = W.split(batch.column("text"), W.SPACED)
        code = _codes(W.fingerprints(words, fold=False), depth)[words.windows(width)]
        above = code >> (2 * BITS)
        at = np.minimum(np.searchsorted(opened, above), len(opened) - 1)
        codes, n = np.unique(code[opened[at] == above], return_counts=True)
        yield pa.RecordBatch.from_pydict({"code": codes, "n": n.astype(np.int64)})


def _bins(cells: pa.Table, group: int, last: bool) -> pa.Table:
    """Of the prefixes below one: those to extend, and those at which a group of about `group` suffixes begins."""
    cells = cells.sort_by("code")
    code, n = cells.column("code").to_numpy(), cells.column("n").to_numpy()
    large = (n > group) & (not last)
    bin_of = np.cumsum(np.where(large, group, n)) // group
    begins = np.append(True, np.diff(bin_of) > 0)
    return pa.table({"code": np.concatenate([code[large], code[begins]]), "extend": np.append(np.ones(large.sum(), bool), np.zeros(begins.sum(), bool))})


def _binned(group: int, last: bool):
    return lambda cells: _bins(cells, group, last)


def prefix_groups(docs: DataFrame, width: int = WIDTH, group: int = GROUP) -> tuple[int, np.ndarray]:
    """The depth of the longest prefix in words, and the codes (at that depth) at which a new group begins.

    A prefix is extended only if it has over `group` suffixes, and each extended one gives a group's beginning for every
    `group` of them and one more: what comes to the driver and goes to the tasks is a few numbers for each group.
    """
    depth, opened, begins = 0, np.zeros(1, np.int64), np.zeros(0, np.int64)
    while len(opened):
        depth += 2
        last = depth >= min(DEEPEST, width - 1)
        counts = docs.select("text").mapInArrow(lambda b, d=depth, o=opened: _count(b, d, o, width), "code long, n long")
        counts = counts.groupBy("code").agg(F.sum("n").alias("n"), F.expr(f"code div {1 << (2 * BITS)}").alias("above"))
        rows = counts.groupBy("above").applyInArrow(_binned(group, last), "code long, extend boolean").toPandas()
        codes, extend = rows["code"].to_numpy(np.int64), rows["extend"].to_numpy(bool)
        opened = np.sort(codes[extend])
        begins = np.concatenate([begins << (2 * BITS), codes[~extend]])
    return depth, np.unique(begins)[1:]


def _pack(values: np.ndarray) -> bytes:
    """Compressed byte planes."""
    return pa.compress(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, n * 8, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


class Block:
    """The suffixes of a block's documents. Two passes that see its rows in any order build the same leaves."""

    def __init__(self, rows: pa.Table, depth: int, bounds: np.ndarray, width: int):
        ids = rows.column("doc_id").cast(pa.int64()).fill_null(LAST_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids = rows.take(pa.array(order)), ids[order]
        self.words = W.split(self.rows.column("text"), W.SPACED)
        h = W.fingerprints(self.words, fold=False)
        self.at = np.flatnonzero(self.words.windows(width))
        keys = W.grams(h, width)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        group = np.searchsorted(bounds, _codes(h, depth)[self.at], "right").astype(np.int32)
        owner = self.ids[self.words.document()[self.at]]
        by_key = np.argsort(keys, kind="stable")
        keys, group, owner = keys[by_key], group[by_key], owner[by_key]
        first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        leaf = np.cumsum(first) - 1
        keys, group, smallest = keys[first], group[first], owner[first]
        #: Windows in the order of their keys: the number of the leaf, and whether the block itself has a smaller id.
        self.windows, self.leaf, self.later = self.at[by_key], leaf, owner > smallest[leaf] if len(leaf) else first
        by_group = np.argsort(group, kind="stable")
        self.by_group, self.keys, self.smallest = by_group, keys[by_group], smallest[by_group]
        self.groups, start = np.unique(group[by_group], return_index=True)
        self.ends = np.append(start, len(keys))

    def leaves(self):
        for k, g in enumerate(self.groups):
            own = slice(self.ends[k], self.ends[k + 1])
            yield int(g), own.stop - own.start, _pack(np.diff(self.keys[own], prepend=np.uint64(0))), _pack(self.smallest[own])

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which words start a window that a document with a smaller id has too."""
        bits = np.zeros(len(self.keys), bool)
        for k, g in enumerate(self.groups):
            if int(g) in answers:
                n = self.ends[k + 1] - self.ends[k]
                bits[self.ends[k] : self.ends[k + 1]] = np.unpackbits(np.frombuffer(answers[int(g)], np.uint8), count=n)
        of_leaf = np.empty(len(bits), bool)
        of_leaf[self.by_group] = bits
        return np.sort(self.windows[of_leaf[self.leaf] | self.later])


def _subtree(rows: pa.Table) -> pa.Table:
    """For each leaf of each block in this group, whether another block has it with a smaller id."""
    sizes = rows.column("n").to_numpy()
    cells = list(zip(rows.column("keys").to_pylist(), rows.column("ids").to_pylist(), sizes, strict=True))
    keys = np.concatenate([np.cumsum(_unpack(k, n)) for k, _, n in cells])
    ids = np.concatenate([_unpack(d, n) for _, d, n in cells]).view(np.int64)
    order = np.argsort(keys, kind="stable")
    nodes = np.append(True, np.diff(keys[order]) != 0)
    smallest = np.minimum.reduceat(ids[order], np.flatnonzero(nodes))
    flag = np.empty(len(keys), bool)
    flag[order] = ids[order] > smallest[np.cumsum(nodes) - 1]
    parts = [(b, f) for b, f in zip(rows.column("block").to_pylist(), np.split(flag, np.cumsum(sizes)[:-1]), strict=True) if f.any()]
    group = rows.column("suffixes")[0].as_py()
    return pa.table({"block": pa.array([b for b, _ in parts], pa.int32()), "suffixes": pa.array([group] * len(parts), pa.int32()), "bits": pa.array([np.packbits(f).tobytes() for _, f in parts], pa.binary())})


def _spans(gone: np.ndarray, base: np.ndarray) -> pa.Array:
    """The runs of words that go, document by document: first word and word after the last."""
    cut = np.zeros(len(gone) + 1, bool)
    cut[base] = True
    starts = np.flatnonzero(gone & (cut[:-1] | ~np.append(False, gone[:-1])))
    ends = np.flatnonzero(gone & (cut[1:] | ~np.append(gone[1:], False))) + 1
    doc = np.searchsorted(base, starts, "right") - 1
    offsets = np.searchsorted(doc, np.arange(len(base)))
    runs = pa.StructArray.from_arrays([pa.array(starts - base[doc]), pa.array(ends - base[doc])], ["first", "last"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)


def _kept_texts(words: W.Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    size = (words.ends - words.starts + 1)[kept]
    out_start = np.cumsum(size) - size
    out = np.full(size.sum(), 0x20, np.uint8)
    step = np.arange(len(out)) - np.repeat(out_start, size)
    inner = step < np.repeat(size - 1, size)
    out[inner] = words.data[(np.repeat(words.starts[kept], size) + step)[inner]]
    n = np.append(0, np.cumsum(kept))[words.base]
    begin = np.append(out_start, len(out))[n]
    raw = out.tobytes()
    return pa.array([raw[a : max(a, b - 1)].decode() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.string())


RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<first:bigint,last:bigint>>, kept string"


def dedup_substrings(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, spans (the maximal runs of words that go) and kept: the words that stay, joined by one space."""
    depth, bounds = prefix_groups(docs, width, group)
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", block.alias("block"))

    def index(key, rows):
        own = list(Block(rows, depth, bounds, width).leaves())
        columns = dict(zip(("suffixes", "n", "keys", "ids"), zip(*own, strict=True), strict=True)) if own else {"suffixes": [], "n": [], "keys": [], "ids": []}
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({"block": pa.array([key[0].as_py()] * len(own), pa.int32())} | {c: pa.array(v, t) for (c, v), t in zip(columns.items(), kinds, strict=True)})

    def remove(rows, answers):
        own = Block(rows, depth, bounds, width)
        bits = dict(zip(answers.column("suffixes").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        gone = W.covered(own.repeated(bits), width, len(own.words.starts))
        removed = np.diff(np.append(0, np.cumsum(gone))[own.words.base])
        return pa.table({"doc_id": own.rows.column("doc_id"), "n_words": own.words.counts.astype(np.int64), "n_removed": removed.astype(np.int64), "spans": _spans(gone, own.words.base), "kept": _kept_texts(own.words, ~gone)})

    leaves = rows.groupBy("block").applyInArrow(index, "block int, suffixes int, n long, keys binary, ids binary")
    answers = leaves.groupBy("suffixes").applyInArrow(_subtree, "block int, suffixes int, bits binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_W = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '{_W}'), []) AS w FROM documents),
win AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i:i+12], ' ')))) AS x
        FROM d WHERE len(w) >= 13),
first AS (SELECT x, min(doc_id) AS low FROM win GROUP BY x HAVING count(*) > 1),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (x) WHERE doc_id > low) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
