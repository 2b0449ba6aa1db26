"""Licence scans with a generalised suffix automaton over the words of licence templates.

A text streams through the automaton word by word; at each word the matching statistics say how long a stretch of any
template ends there. A base phrase occurs where the match is long enough and its state lies below the phrase's own.
Templates are the clauses of licence_texts. Long matches are chained by template, in order of their places in both the
text and the template: by dynamic programming, each match gets the best chain that ends with it. A label is given where a
chain covers COVER of its template, and the chain is its span. score is the largest covered share, and 1 for any base phrase.
A short template, such as an SPDX line, has to be covered whole.

The automaton has some hundred states and goes to the tasks with the code. Words of no template cannot continue a
match, so only runs of template words are walked. Null texts count as empty and have no words. Repeated rows are
handled alike, an empty table gives an empty result, and other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.llm import words as W
from priceloom.llm.licence_texts import CLAUSES
from priceloom.llm.shared import table

#: The shortest match of a chain, the most words between two matches in the text and in the template, and the share that a
#: chain has to cover of its template.
LONG, GAP, SKIP, COVER = 4, 12, 30, 0.6

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


class Automaton:
    """A generalised suffix automaton; sequences hold small integers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Of each state, one (sequence, end) of every sequence that has its strings.
        self.ends: list[dict[int, set[int]]] = [{}]
        for k, seq in enumerate(sequences):
            last = 0
            for i, symbol in enumerate(seq):
                last = self._extend(last, symbol)
                at = last
                while at > 0:
                    self.ends[at].setdefault(k, set()).add(i + 1)
                    at = self.link[at]
        # A state split off later lacks the ends of what it was split from: gather them from below.
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for k, own in self.ends[state].items():
                if self.link[state] > 0:
                    self.ends[self.link[state]].setdefault(k, set()).update(own)

    def _new(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, symbol: int) -> int:
        """The state of the strings of p with symbol added, of that length alone."""
        q = self.next[p][symbol]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        new, p = self._new(self.length[last] + 1), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, symbol)
        return new

    def statistics(self, symbols):
        """For each symbol the state and length of the longest match that ends there."""
        state = length = 0
        for symbol in symbols:
            while symbol not in self.next[state] and state:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            else:
                length = 0
            yield state, length

    def state_of(self, seq: list[int]) -> int:
        state = 0
        for symbol in seq:
            state = self.next[state][symbol]
        return state


class Scanner:
    def __init__(self, phrases: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] | None = None):
        phrases, templates = phrases or PHRASES, templates or CLAUSES
        split = [p.split() for p in [*phrases, *[text for _, text in templates]]]
        names = sorted({w for s in split for w in s})
        marks = W.fingerprints(W.split(pa.array(names, pa.string()), W.ALNUM), fold=True)
        order = np.argsort(marks)
        self.marks, self.symbol = marks[order], order + 1
        number = {w: k + 1 for k, w in enumerate(names)}
        seqs = [[number[w] for w in s] for s in split]
        self.automaton = Automaton(seqs)
        self.labels, self.sizes, self.n_phrases = [*phrases.values(), *[label for label, _ in templates]], [len(s) for s in seqs], len(phrases)
        self.shortest = min(self.sizes[: self.n_phrases])
        own = [self.automaton.state_of(s) for s in seqs[: self.n_phrases]]
        #: The phrases that end wherever a long enough match ends in the state.
        self.phrases_at: list[list[int]] = []
        for state in range(len(self.automaton.next)):
            above, at = set(), state
            while at > 0:
                above.add(at)
                at = self.automaton.link[at]
            self.phrases_at.append([k for k, s in enumerate(own) if s in above])

    def symbols(self, words: W.Words) -> np.ndarray:
        h = W.fingerprints(words, fold=True)
        at = np.minimum(np.searchsorted(self.marks, h), len(self.marks) - 1)
        return np.where(self.marks[at] == h, self.symbol[at], 0)

    def scan(self, texts: pa.Array) -> list[dict]:
        words = W.split(texts, W.ALNUM)
        symbols = self.symbols(words)
        doc = words.document()
        known = symbols > 0
        edge = np.append(True, doc[1:] != doc[:-1]) if len(doc) else known
        begins = known & (edge | ~np.append(False, known[:-1])) if len(doc) else known
        starts = np.flatnonzero(begins)
        run = np.cumsum(begins)[known] - 1
        ends = starts + np.bincount(run, minlength=len(starts)) if len(starts) else starts
        out = [{"n_words": int(n), "places": [], "matches": []} for n in words.counts]
        listed = symbols.tolist()
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a < self.shortest:
                continue
            row, base = out[doc[a]], int(words.base[doc[a]])
            stats = list(self.automaton.statistics(listed[a:b]))
            for k, (state, length) in enumerate(stats):
                for p in self.phrases_at[state]:
                    if length >= self.sizes[p]:
                        row["places"].append((a + k + 1 - self.sizes[p] - base, p))
                # A match that the next word does not lengthen is a longest one.
                if length >= LONG and (k + 1 == len(stats) or stats[k + 1][1] <= length):
                    row["matches"].append((a + k + 1 - base, length, state))
        return [self._row(r) for r in out]

    def _row(self, found: dict) -> dict:
        places = sorted(found["places"])
        base = sorted({self.labels[p] for _, p in places})
        chains = self._chains(found["matches"])
        labels, score = set(base), 1.0 if base else 0.0
        spans = []
        for t, first, last, share in chains:
            score = max(score, share)
            if share >= (COVER if self.sizes[t] > 2 * LONG else 1.0):
                labels.add(self.labels[t])
                spans.append({"label": self.labels[t], "first": first, "last": last, "share": share})
        return {
            "n_words": found["n_words"], "n_base": len(places), "first_word": places[0][0] if places else None, "last_word": places[-1][0] if places else None,
            "base_labels": ",".join(base), "labels": ",".join(sorted(labels)), "score": score, "spans": spans,
        }

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """template, first word, word after the last and covered share of the best chain that ends with each match, the best
        first; chains that share a match with a better one are left out."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in matches:
            for t, places in self.automaton.ends[state].items():
                if t >= self.n_phrases:
                    by_template.setdefault(t, []).extend((end, place, length) for place in sorted(places))
        out = []
        for t, own in by_template.items():
            best, before = [n for _, _, n in own], [-1] * len(own)
            for j, (end, place, length) in enumerate(own):
                for i in range(j - 1, -1, -1):
                    if own[i][0] < end - length - GAP:
                        break
                    new = min(length, end - own[i][0], place - own[i][1])
                    if new > 0 and end - new - own[i][0] <= GAP and place - new - own[i][1] <= SKIP and best[i] + new > best[j]:
                        best[j], before[j] = best[i] + new, i
            used = [False] * len(own)
            for j in sorted(range(len(own)), key=lambda k: (-best[k], k)):
                chain = [j]
                while before[chain[-1]] >= 0:
                    chain.append(before[chain[-1]])
                if not any(used[k] for k in chain):
                    for k in chain:
                        used[k] = True
                    first = own[chain[-1]]
                    out.append((t, first[0] - first[2], own[j][0], min(1.0, best[j] / self.sizes[t])))
        return out


RESULT = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])))])
RESULT_SQL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint,share:double>>"


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id and what was found in its text: counts, labels, score, and spans of templates in words."""

    def scan(batches):
        scanner = Scanner()
        for batch in W.pieces(batches):
            found = pa.array(scanner.scan(batch.column("text")), RESULT)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found.flatten()], ["doc_id", *[f.name for f in RESULT]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {RESULT_SQL}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents")).drop("spans")
