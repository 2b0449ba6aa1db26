"""Language identification by word-first backoff.

A word that the model knows scores its log frequency in each language. An unseen word is scored by the longest of its
character n-grams that are known, falling back from LONGEST characters to one; each step down costs BACKOFF. A document
goes to the language with the largest sum; score is that language's share when each word counts with weight SHARPEN.

The model is learned from the labelled rows that `training` names: about MOST_ROWS distinct texts a language, those with the
smallest hashes (a bounded sample; the only one here). Spark counts their words, and from these all n-grams; all of them are
kept. A key has a score only in the languages in which it was seen and shares that of unseen keys in the others, so the model
grows with what the sample holds and not with keys times languages. It is brought to the driver as Arrow and goes to the tasks.

known is the mean over the words of how much the model knows of each: all of a known word, else the share of its letters
within known n-grams of KNOWN or more characters. A letter of a script without spaces between words counts if any of its
n-grams is known, as such "words" are whole clauses. The padding alone never counts.

Texts that are null or have no letter are `und`, with score and known 0. With no labelled row every text is. Ties go to the language
that comes first by code point. Repeated rows are judged alike, and other columns are not read.
"""

from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.llm import words as W
from priceloom.llm.shared import table

MOST_ROWS, LONGEST = 4000, 4
BACKOFF, SMOOTH, SHARPEN = 0.4, 0.5, 0.25
UNKNOWN = "und"
#: The least length of an n-gram that shows a word to be of a learned language, and the least share for a document to be.
#: At sf0.01 learned languages have 0.99 and more, random letters 0.34 at most, unlearned scripts 0.
KNOWN, LEAST_KNOWN = 3, 0.4
#: Scripts without spaces between words: Thai and Lao, Tibetan, Myanmar, Khmer, ideographs and kana.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
LETTER = r"\p{L}+"
#: Bytes of text judged at a time.
PIECE_BYTES = 1 << 20


def _hashed(codes: np.ndarray) -> list[np.ndarray]:
    """For n from 1 to LONGEST a 64-bit hash of the n characters from each place on; the last places lack some."""
    out = [W.mix(codes.astype(W.U64) + W.U64(1))]
    for n in range(1, LONGEST):
        out.append(W.mix(out[-1][:-1] * W.U64(0x9E3779B97F4A7C15) + codes[n:].astype(W.U64) + W.U64(1)) if len(codes) > n else np.zeros(0, W.U64))
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Table:
    """Scores of keys by language. Row k has `more` than `base` in the languages lang[starts[k] : starts[k + 1]]; a last row has none."""

    def __init__(self, starts: np.ndarray, lang: np.ndarray, more: np.ndarray, base: np.ndarray):
        self.starts, self.lang, self.more, self.base = np.append(starts, starts[-1]), lang, more, base

    def dense(self, rows: np.ndarray) -> np.ndarray:
        """The scores of the rows in all languages."""
        counts = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(counts)
        flat = np.repeat(self.starts[rows] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
        out = np.tile(self.base, (len(rows), 1))
        out[np.repeat(np.arange(len(rows)), counts), self.lang[flat]] += self.more[flat]
        return out


def counted_table(starts: np.ndarray, lang: np.ndarray, n: np.ndarray, languages: int) -> Table:
    """Smoothed log frequencies from how often each key was seen in each language."""
    keys = len(starts) - 1
    total = np.bincount(lang, n, languages) + SMOOTH * (keys + 1)
    base = np.log(SMOOTH / total)
    return Table(starts, lang, np.log((n + SMOOTH) / total[lang]) - base[lang], base)


def _prints(words: pa.Array) -> np.ndarray:
    """A 64-bit fingerprint of each word."""
    data, offsets = W.utf8(words)
    return W.fingerprints(W.Words(data, offsets, offsets[:-1], offsets[1:], offsets), fold=False) if len(words) else np.zeros(0, W.U64)


class Model:
    """words and grams: the keys, and the table of their scores."""

    def __init__(self, languages: list[str], words: tuple[pa.Array, Table], grams: tuple[pa.Array, Table]):
        self.languages = languages
        prints = _prints(words[0])
        order = np.argsort(prints)
        self.prints, self.rows, self.word_scores, self.gram_scores = prints[order], order, words[1], grams[1]
        self.floor = np.full(len(languages), log(1e-7))
        #: By length, the hashes of the n-grams in order and the row of each.
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []
        length = pc.utf8_length(grams[0]).to_numpy(zero_copy_only=False)
        for n in range(1, LONGEST + 1):
            own = np.flatnonzero(length == n)
            codes = _codes("".join(grams[0].take(pa.array(own)).to_pylist())).reshape(-1, n)
            hashes = _hashed(codes.ravel())[n - 1][::n] if len(own) else np.zeros(0, W.U64)
            order = np.argsort(hashes)
            self.by_length.append((hashes[order], own[order]))

    def _longest(self, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each place the length and row of the longest known n-gram that ends no later than `end`; length 0 for none."""
        length, row = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        for n, (h, (known, rows)) in enumerate(zip(_hashed(codes), self.by_length, strict=True), 1):
            if len(known) and len(h):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero((known[at] == h) & (np.arange(len(h)) + n <= end[: len(h)]))
                length[hit], row[hit] = n, rows[at[hit]]
        return length, row

    def unseen(self, words: pa.Array) -> np.ndarray:
        """Of each word the score in each language by its n-grams, and how much of it is known. All words take a step at a time."""
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = _codes(" " + "  ".join(words.to_pylist()) + " ")
        stop = np.cumsum(size + 2)
        start = stop - size - 2
        length, row = self._longest(codes, np.repeat(stop, size + 2))
        unspaced = np.zeros(len(codes), bool)
        for low, high in UNSPACED:
            unspaced |= (codes >= low) & (codes <= high)
        total, steps = np.zeros((len(words), len(self.languages))), np.zeros(len(words), np.int64)
        wide, single = np.zeros(len(codes) + 1, np.int64), np.zeros(len(codes), bool)
        at, live = start.copy(), np.arange(len(words))
        while len(live):
            p = at[live]
            n = length[p]
            hit = n > 0
            total[live[hit]] += self.gram_scores.dense(row[p[hit]]) + ((LONGEST - n[hit]) * log(BACKOFF))[:, None]
            steps[live[hit]] += 1
            long = n >= KNOWN
            wide[p[long]] += 1
            wide[(p + n)[long]] -= 1
            for k in range(1, KNOWN):
                some = p[hit & (n >= k)] + k - 1
                single[some] |= unspaced[some]
            at[live] = p + np.maximum(1, n - 1)
            live = live[at[live] < stop[live]]
        seen = np.append(0, np.cumsum((np.cumsum(wide[:-1]) > 0) | single))
        share = (seen[stop - 1] - seen[start + 1]) / np.maximum(size, 1)
        scores = np.where(steps[:, None] > 0, total / np.maximum(steps, 1)[:, None], self.floor)
        return np.column_stack([scores, share])

    def score(self, words: pa.Array) -> np.ndarray:
        """Of each distinct word the score in each language, and how much of it is known."""
        prints = _prints(words)
        found = np.minimum(np.searchsorted(self.prints, prints), max(0, len(self.prints) - 1))
        known = self.prints[found] == prints if len(self.prints) else np.zeros(len(words), bool)
        out = np.column_stack([np.zeros((len(words), len(self.languages))), np.ones(len(words))])
        out[known, :-1] = self.word_scores.dense(self.rows[found[known]]) if known.any() else 0
        rest = np.flatnonzero(~known)
        if len(rest):
            out[rest] = self.unseen(words.take(pa.array(rest)))
        return out


def _collected(counts: DataFrame, languages: list[str]) -> tuple[pa.Array, Table]:
    """The keys of counts (key, lang, n) and their table."""
    rows = counts.groupBy("key").agg(F.collect_list(F.struct("lang", "n")).alias("found")).toArrow().sort_by("key").combine_chunks()
    found = rows.column("found").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.struct({"lang": pa.string(), "n": pa.int64()})))
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    lang = pc.index_in(found.flatten().field("lang"), value_set=pa.array(languages, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = found.offsets.to_numpy().astype(np.int64)
    keys = rows.column("key").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
    return keys, counted_table(starts - starts[0], lang, found.flatten().field("n").to_numpy(zero_copy_only=False).astype(float), len(languages))


def learn(labelled: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """labelled: text and lang; rows without either are left out, and copies of a text count once."""
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", F.xxhash64("text").alias("h"))
    # The threshold comes from how many texts there are; evenly hashed ones then keep about most_rows of each language.
    share = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).select(F.col("lang").alias("own"), F.least(F.lit(1.0), F.lit(most_rows) / F.col("n")).alias("share"))
    near = rows.join(F.broadcast(share), F.col("lang") == F.col("own")).filter((F.col("h") / F.lit(2.0**64) + 0.5) <= F.col("share"))
    sample = near.groupBy("lang", "h").agg(F.any_value("text").alias("text"))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({LETTER})"))).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n"))
    words = words.persist()
    padded = F.concat(F.lit(" "), F.col("key"), F.lit(" "))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, n))))
    grams = words.select("lang", "n", F.explode(pieces).alias("key")).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())  # a name for each language
    found = [_collected(counts, languages) for counts in (words, grams)]
    words.unpersist()
    return Model(languages, *found)


def _judge(model: Model, texts: pa.Array) -> tuple[list, list, list]:
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    lists = pc.split_pattern_regex(lower, r"\PL+")
    encoded = lists.values.dictionary_encode()
    is_word = pc.not_equal(encoded.dictionary, "").to_numpy(zero_copy_only=False)
    scores = np.zeros((len(encoded.dictionary), len(model.languages) + 1))
    if is_word.any():
        scores[is_word] = model.score(encoded.dictionary.filter(pa.array(is_word)))
    indices = encoded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    sums = np.zeros((len(lists), len(model.languages)))
    for k in range(len(model.languages)):
        running = np.append(0.0, np.cumsum((scores[:, k] - scores[:, 0])[indices]))
        sums[:, k] = running[offsets[1:]] - running[offsets[:-1]]
    n = np.append(0, np.cumsum(is_word[indices]))
    n = n[offsets[1:]] - n[offsets[:-1]]
    running = np.append(0.0, np.cumsum(scores[indices, -1]))
    known = np.clip((running[offsets[1:]] - running[offsets[:-1]]) / np.maximum(n, 1), 0, 1)
    best = sums.argmax(axis=1)
    odds = np.exp(np.clip(SHARPEN * (sums - sums.max(axis=1, keepdims=True)), -50, 0))
    share = 1 / odds.sum(axis=1)
    return [model.languages[b] if c else UNKNOWN for b, c in zip(best, n, strict=True)], [float(s) if c else 0.0 for s, c in zip(share, n, strict=True)], known.tolist()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs in a struct `row`, with lang_pred, score and known."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def judge(batches):
        with_text = (pa.RecordBatch.from_arrays([b.column("row"), b.column("row").field("text")], ["row", "text"]) for b in batches)
        for batch in W.pieces(with_text, limit=PIECE_BYTES):
            if sent.value.languages:
                names, scores, known = _judge(sent.value, batch.column("text"))
            else:
                names, scores, known = [UNKNOWN] * len(batch), [0.0] * len(batch), [0.0] * len(batch)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.float64())], ["row", "lang_pred", "score", "known"])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(judge, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, known double")


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(_fold(doc_id) == 0, F.lit(False))


def learnt(doc_id: Column) -> Column:
    """Whether the model may learn from a document; a null id is in no fold, so neither held out nor learnt."""
    return F.coalesce(_fold(doc_id) != 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(learnt(F.col("doc_id"))).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
