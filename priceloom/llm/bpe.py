"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into pieces of about PIECE_BYTES. Of a piece the distinct words (in the tokenizer's sense) are laid out as one
array of symbols, and an index holds, for the rank of each pair that can be merged, all its positions in that array. Ranks that
have positions are active. They are applied in ascending order: all positions of the lowest one are merged from left to right,
and the two pairs beside each new symbol enter the lists of their own ranks; positions that an earlier merge took are
recognised and left out. A merge only makes pairs of higher ranks (which Vocabulary checks), so each word meets its merges in
the order in which it would meet them alone. Documents then get the ids of their words.

An index takes at most INDEX_SYMBOLS symbols, or one word; words beyond that get an index of their own. Nothing is shuffled;
the vocabulary, whose size does not grow with the data, is broadcast. Special tokens in a text become their ids, as the
tokenizer file says. Decoding joins the bytes of the ids; what is not UTF-8 becomes U+FFFD.

Null and empty texts have no ids, null lists of ids decode to an empty text; ids that the vocabulary lacks are left out.
Repeated rows are handled alike; other columns go along in a struct `row`, so that no names clash. An empty table gives an
empty result.
"""

import json
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.llm import words as W
from priceloom.llm.shared import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BYTES, INDEX_SYMBOLS = 8 << 20, 1 << 20
#: Ids decoded at a time.
PIECE_IDS = 4 << 20

# White space, and how byte-level tokenizers cut texts into words.
SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in visible else spare))
        spare += b not in visible
    return out


class Vocabulary:
    """The ids, bytes and merges of a byte-level BPE tokenizer file."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        byte_of = {c: k for k, c in enumerate(byte_characters())}
        self.special = special
        #: Bytes of each id, None where there is none.
        self.bytes: list[bytes | None] = [None] * (1 + max([*tokens.values(), *special.values()]))
        for token, k in tokens.items():
            self.bytes[k] = bytes(byte_of[c] for c in token)
        for token, k in special.items():
            self.bytes[k] = token.encode()
        self.single = np.array([tokens[c] for c in byte_characters()], np.int64)
        #: The border between words, and what is left where a symbol was merged into the one before.
        self.border, self.gone = len(self.bytes), len(self.bytes) + 1
        self.base = len(self.bytes) + 2
        self.left, self.right, self.made = ([tokens[t] for t in part] for part in (*zip(*merges, strict=True), map("".join, merges)))
        self.ranks = {a * self.base + b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        first: dict[int, int] = {}
        for r, k in enumerate(self.made):
            first.setdefault(k, r)
        if len(first) < len(merges) or any(first.get(k, -1) >= r for part in (self.left, self.right) for r, k in enumerate(part)):
            raise ValueError("a merge uses a token that a later merge makes, or two merges make the same token")

    @classmethod
    def read(cls, path: str = PATH) -> "Vocabulary":
        """A tokenizer file of the kind whose words are cut by WORDS; others are refused."""
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        cut, model, added = given["pre_tokenizer"], given["model"], given["added_tokens"]
        plain = not given["normalizer"] and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in added})


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def merged(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after another, and how many each has: one pair occurrence index over all of them."""
    size = np.array([len(w) for w in words], np.int64)
    symbols = np.full(int(size.sum()) + len(words) + 1, v.border, np.int64)
    # Each word begins after a border.
    place = np.arange(int(size.sum())) + np.repeat(np.arange(1, len(words) + 1), size)
    symbols[place] = v.single[np.frombuffer(b"".join(words), np.uint8)]
    known = np.array(sorted(v.ranks), np.int64)
    rank = np.array([v.ranks[k] for k in known.tolist()], np.int64)
    pairs = symbols[:-1] * v.base + symbols[1:]
    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
    hit = np.flatnonzero(known[at] == pairs)
    own = rank[at[hit]]
    order = np.argsort(own, kind="stable")
    starts = np.flatnonzero(np.diff(own[order], prepend=-1))
    index = {int(own[order[a]]): part.tolist() for a, part in zip(starts, np.split(hit[order], starts[1:]), strict=True)} if len(hit) else {}

    sym, after, before = symbols.tolist(), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    ranks, base, gone, left, right, made = v.ranks, v.base, v.gone, v.left, v.right, v.made
    active = list(index)
    heapify(active)
    while active:
        r = heappop(active)
        a, b, new = left[r], right[r], made[r]
        positions = index.pop(r)
        positions.sort()
        for i in positions:
            j = after[i]
            if sym[i] != a or sym[j] != b:
                continue
            k, h = after[j], before[i]
            sym[i], sym[j] = new, gone
            after[i], before[k] = k, i
            for pair, p in ((sym[h] * base + new, h), (new * base + sym[k], i)):
                found = ranks.get(pair)
                if found is not None:
                    if found in index:
                        index[found].append(p)
                    else:
                        index[found] = [p]
                        heappush(active, found)
    out = np.array(sym, np.int64)
    word = np.cumsum(out == v.border) - 1
    real = out < v.border
    return out[real].astype(np.int32), np.bincount(word[real], minlength=len(words)).astype(np.int64)


def _slices(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[starts[k] : starts[k] + counts[k]] for all k, one after another."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.find = regex.compile(WORDS).findall
        longest_first = sorted(v.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if v.special else None

    def _numbered(self, text: str, numbers: Numbers) -> array:
        """The words of a text by number; special tokens are words of their own, and no other word reaches over them."""
        if self.special is None or not self.special.search(text):
            return array("q", map(numbers.__getitem__, self.find(text)))
        out, begin = array("q"), 0
        for m in self.special.finditer(text):
            out.extend(map(numbers.__getitem__, self.find(text, begin, m.start())))
            out.append(numbers[(m.group(),)])
            begin = m.end()
        out.extend(map(numbers.__getitem__, self.find(text, begin)))
        return out

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        numbers = Numbers()
        lists = [self._numbered(t, numbers) for t in texts]
        words = [k.encode() if isinstance(k, str) else b"" for k in numbers]
        parts, counts, first = [], [], 0
        size = np.cumsum([len(w) + 1 for w in words])
        while first < len(words):
            done = int(size[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(size, done + INDEX_SYMBOLS, "right")))
            ids, n = merged(words[first:last], self.v)
            parts.append(ids)
            counts.append(n)
            first = last
        ids, n = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (parts, counts))
        starts = np.cumsum(n) - n
        specials = [(k, self.v.special[w[0]]) for w, k in numbers.items() if not isinstance(w, str)]
        if specials:
            number, own = map(np.array, zip(*specials, strict=True))
            starts[number], n[number] = len(ids) + np.arange(len(number)), 1
            ids = np.concatenate([ids, own.astype(np.int32)])
        flat = np.concatenate([np.frombuffer(w, np.int64) for w in lists]) if lists else np.zeros(0, np.int64)
        per_word = n[flat]
        total = np.append(0, np.cumsum(per_word))
        ends = np.cumsum([len(w) for w in lists], dtype=np.int64)
        return _slices(ids, starts[flat], per_word).astype(np.int32), np.diff(total[ends], prepend=0)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """ids (array of int) of the text, and the other columns in a struct `row`; the text itself is not carried along."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches):
        encoder = Encoder(sent.value)
        for batch in W.pieces(batches, limit=PIECE_BYTES):
            texts = [t.decode("utf-8", "replace") if t else "" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ids, counts = encoder.ids(texts)
            offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["row", "ids"])

    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("row") if others else F.struct(F.lit(True).alias("any")).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>")


def _decoded(lists: pa.ListArray, v: Vocabulary) -> list[str]:
    out = []
    for k in range(len(lists)):
        ids = lists[k].values
        own = ids.drop_null().to_numpy(zero_copy_only=False) if ids is not None else np.zeros(0, np.int32)
        own = own[(own >= 0) & (own < len(v.bytes))]
        parts = [b"".join(filter(None, map(v.bytes.__getitem__, own[a : a + PIECE_IDS].tolist()))) for a in range(0, len(own), PIECE_IDS)]
        out.append(b"".join(parts).decode("utf-8", "replace"))
    return out


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """text of the ids, and all columns in a struct `row`."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches):
        for batch in batches:
            step = max(1, min(len(batch), PIECE_IDS * len(batch) // max(1, len(batch.column("ids").flatten()))))
            for a in range(0, len(batch), step):
                part = batch.slice(a, step)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(_decoded(part.column("ids"), sent.value), pa.string())], ["row", "text"])

    given = rows.select(F.struct("*").alias("row"), F.col(ids).cast("array<int>").alias("ids"))
    return given.mapInArrow(work, f"row {given.schema['row'].dataType.simpleString()}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary.read()
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    back = decode(coded.select("row.doc_id", "ids"), vocabulary)
    return back.select(
        "row.doc_id",
        F.size("row.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("row.ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
