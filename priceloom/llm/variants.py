"""Spelling variant grouping: words one error apart, found with forward and backward minimal acyclic automata.

One error lies either in the second half of a word, whose first half is then matched exactly, or in the first half, and then
the second half is. So a forward automaton of the dictionary reads the first half and completes the rest with one error, and a
backward automaton, of the reversed words, does the same from the end. States know how many words come before each of their
transitions, so that reading a word gives its number (a minimal perfect hash), by which its count is found. What the backward
search finds with an equal first half the forward search found before; it is left out there and then.

The dictionary is dealt out by the beginning of the words (and, reversed, by their end): words meet in the group of their first
LEVELS[0] characters. Groups of more than `most` words are split by longer beginnings, level by level. Words whose exact half
is too short for the next level stay, and if too many stay, the dictionary of the group is cut into blocks and each of them asks
every block. Small groups share a bucket. So a task holds an automaton of some `most` words, and no pairs are listed: a word
gives one row for each direction, and one for each block where there are some.

A word's form is its near word of largest count, if that is at least TIMES its own; the smallest in code-point order of several.
Its root is found by pointer doubling: counts grow by TIMES a step, so chains are short.

Runs of letters of null texts: none. A null doc_id counts as an empty one in the damage that `damaged_words` does. Repeated rows
count again, other columns are not read. Words have four characters at least: half of a shorter one is no group. An empty table
gives an empty result.
"""

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.llm.shared import CRC_TABLE_SQL, crc32_sql, discard, stored, table

SHORTEST, LEAST, TIMES = 5, 3, 2
#: Words of a group, of a bucket about, and of a block.
MOST = 20_000
LETTERS = r"[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def level(k: int) -> int:
    """Lengths of beginnings: 2, 3, 4, 6, 8, 12, 16, ..."""
    return (2 if k % 2 == 0 else 3) << (k // 2)


class Automaton:
    """A minimal acyclic automaton of distinct words that are given in order; `near` gives words by their place in it."""

    def __init__(self, words: list[str]):
        #: Of each state its transitions (to a state, past so many words), whether a word ends there, and how many words it holds.
        self.next: list[dict[str, tuple[int, int]]] = []
        self.ends: list[bool] = []
        self.holds: list[int] = []
        register: dict[tuple, int] = {}
        open_: list[tuple[str, list, list]] = [("", [False], [])]  # on the path of the last word: character, whether it ends, edges

        def settle(depth: int) -> None:
            """States of the last word below that depth get no more transitions: each becomes the registered equal one, or is registered."""
            while len(open_) > depth:
                char, ends, edges = open_.pop()
                key = (ends[0], tuple(edges))
                state = register.get(key)
                if state is None:
                    state = register[key] = len(self.next)
                    past, moves = int(ends[0]), {}
                    for c, to in edges:
                        moves[c] = (to, past)
                        past += self.holds[to]
                    self.next.append(moves)
                    self.ends.append(ends[0])
                    self.holds.append(past)
                if open_:
                    open_[-1][2].append((char, state))
                else:
                    self.start = state

        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            settle(same + 1)
            open_.extend((c, [False], []) for c in word[same:])
            open_[-1][1][0] = True
            last = word
        settle(0)

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with the first `exact` characters and have exactly one error after them."""
        moves, ends, size, found = self.next, self.ends, len(word), set()
        state, number = self.start, 0

        def complete(state: int, number: int, i: int) -> None:
            while i < size:
                step = moves[state].get(word[i])
                if step is None:
                    return
                state, number, i = step[0], number + step[1], i + 1
            if ends[state]:
                found.add(number)

        for i in range(size + 1):
            own = word[i] if i < size else None
            if i >= exact:
                for char, (to, past) in moves[state].items():
                    complete(to, number + past, i)
                    if own is not None and char != own:
                        complete(to, number + past, i + 1)
                if own is not None:
                    complete(state, number, i + 1)
            step = moves[state].get(own)
            if step is None:
                break
            state, number = step[0], number + step[1]
        return found


def damaged_words(docs: DataFrame) -> DataFrame:
    """key: a row for each run of letters, in lower case; where 97 divides the CRC of doc_id and run, the run lacks a character."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({LETTERS})"))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("key"))


def dealt(words: DataFrame, exact: Column, most: int) -> DataFrame:
    """bucket, text, asks, holds and the other columns of words: which words ask and which are held in each bucket.

    words: text, in reading order, and any others; exact: how many characters of it are matched exactly.
    """
    rest = words.withColumns({"exact": exact, "size": F.length("text")})
    buckets = max(1, -(-words.count() // most))
    out, k, mine = [], 0, []
    carried = words.columns
    while True:
        here, after = level(k), level(k + 1)
        rows = rest.withColumn("key", F.substring("text", 1, here))
        heavy = stored(rows.groupBy("key").count().filter(F.col("count") > most).select("key"))
        mine.append(heavy)
        if heavy.isEmpty():
            light, deep = rows, None
        else:
            light, deep = rows.join(heavy, "key", "left_anti"), rows.join(heavy, "key", "left_semi")
        asks = (F.col("exact") >= here) & F.col("asked")
        out.append(light.select(F.concat(F.lit("/"), F.pmod(F.xxhash64("key"), F.lit(buckets))).alias("bucket"), *carried, asks.alias("asks"), F.lit(True).alias("holds")))
        if deep is None:
            break
        # Those whose exact half is shorter than the next level stay with the words that they can be near to.
        stays = deep.filter(F.col("size") <= 2 * after)
        blocks = stays.groupBy("key").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
        stays = stays.join(blocks, "key")
        name = lambda block: F.concat(F.lit(f"{here}:"), F.col("key"), F.lit("/"), block)  # noqa: B023, E731
        held = F.pmod(F.xxhash64("text"), F.col("blocks"))
        out.append(stays.select(name(held).alias("bucket"), *carried, F.lit(False).alias("asks"), F.lit(True).alias("holds")))
        asking = stays.filter((F.col("exact") < after) & F.col("asked")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        out.append(asking.select(name(F.col("block")).alias("bucket"), *carried, F.lit(True).alias("asks"), F.lit(False).alias("holds")))
        # Written once, so that no level works out the levels before it again.
        rest = stored(deep.filter(F.col("size") >= 2 * after - 2).withColumn("asked", F.col("asked") & (F.col("exact") >= after)).drop("key"))
        mine.append(rest)
        k += 1
    found = reduce(DataFrame.unionByName, out)
    found.used = mine
    return found


def _search(rows: pa.Table) -> pa.Table:
    """Of each word that asks in this bucket: how many near words it has here, and the best of them."""
    backward = rows.column("backward")[0].as_py()
    texts, counts, asks, holds = (rows.column(c).to_pylist() for c in ("text", "n", "asks", "holds"))
    count_of = {t: n for t, n, h in zip(texts, counts, holds, strict=True) if h}
    words = sorted(count_of)
    number_of = [count_of[w] for w in words]
    automaton = Automaton(words)
    out = {"word": [], "n": [], "n_near": [], "form": [], "form_n": []}
    for text, n, asking in zip(texts, counts, asks, strict=True):
        if asking:
            half = len(text) // 2
            exact = len(text) - half if backward else half
            near = automaton.near(text, exact)
            own = text[::-1] if backward else text
            best, best_n, many = None, 0, 0
            for k in near:
                word = words[k][::-1] if backward else words[k]
                if backward and word.startswith(own[:half]):
                    continue
                many += 1
                if number_of[k] > best_n or (number_of[k] == best_n and word < best):
                    best, best_n = word, number_of[k]
            for name, value in zip(out, (own, n, many, best, best_n if many else None), strict=True):
                out[name].append(value)
    return pa.table(out, pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())]))


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """words: distinct word and n (positive). word, n, n_near, form and form_n (the near word of largest n, and its n)."""
    own = lambda text, backward: words.select(text.alias("text"), "n", F.lit(True).alias("asked"), F.lit(backward).alias("backward"))
    half = F.floor(F.length("text") / 2)
    forward = dealt(own(F.col("word"), False), half, most)
    backward = dealt(own(F.reverse("word"), True), F.length("text") - half, most)
    rows = forward.unionByName(backward)
    # Buckets are small in bytes and dear in work: as many partitions as there are buckets, which Spark does not put together.
    rows = rows.repartition(max(1, -(-2 * words.count() // most)), "backward", "bucket")
    found = rows.groupBy("backward", "bucket").applyInArrow(_search, "word string, n long, n_near long, form string, form_n long")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), "form")))
    one = stored(found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best")))
    discard(*forward.used, *backward.used)
    return one.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))


def with_roots(words: DataFrame) -> DataFrame:
    """words (word, form, others) with root: where following the forms ends. Each round doubles the steps that a word has gone."""
    gone = stored(words.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = gone.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ahead = stored(gone.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        discard(gone)
        moved = not ahead.filter("moved").isEmpty()
        gone = ahead
        if not moved:
            break
    found = words.join(gone.select("word", "root"), "word", "left")
    return found.withColumn("root", F.coalesce("root", "word"))


def spelling_variants(words: DataFrame, most: int = MOST) -> DataFrame:
    """words: distinct word and n (positive). word, form, root, n, n_near, form_n."""
    clear = F.col("form_n") >= TIMES * F.col("n")
    near = near_words(words, most).withColumns({"form": F.when(clear, F.col("form")), "form_n": F.when(clear, F.col("form_n"))})
    return with_roots(near).select("word", "form", "root", "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = damaged_words(table(spark, sf_dir, "documents")).filter(F.length("key") >= SHORTEST)
    words = stored(keys.groupBy(F.col("key").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST))
    return spelling_variants(words)


SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
own AS (SELECT d || ':' || run AS id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql("id")} AS h FROM own, crc_table),
keys AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM keys WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
cuts AS (SELECT word, n, k, left(word, k::INT) || '*' || substr(word, k::INT + 2) AS star, left(word, k::INT) || substr(word, k::INT + 2) AS less FROM words, unnest(range(length(word))) AS r(k)),
pairs AS (SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.star = b.star AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS form, max(n) AS form_n FROM pairs GROUP BY word),
formed AS (SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * words.n THEN form END AS form, CASE WHEN form_n >= {TIMES} * words.n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS at FROM formed UNION ALL SELECT steps.word, formed.form FROM steps JOIN formed ON steps.at = formed.word WHERE formed.form IS NOT NULL),
ended AS (SELECT steps.word, steps.at AS root FROM steps JOIN formed ON steps.at = formed.word WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM formed JOIN ended USING (word)
"""
