"""Search within names: substrings by a trigram index, and the ladder of searches for a name's candidates.

A needle is in a name only if all its runs of GRAM characters are, so it is looked for under the run that fewest names have, and
then in the names found there. Every run of GRAM characters is in many names of a large catalog, so the ladder looks for needles
of LONG characters and more under runs of LONG. Joins are on equal grams; no needle meets all names. Letter case is ignored. Needles of fewer
characters than `shortest` find nothing, nor do null ones; null names are in no index.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions import models as D
from priceloom.functions import text as X
from priceloom.operators import similarity
from priceloom.sources.tables import discard, stored

GRAM, LONG = 3, 6
#: Fewest candidates of a name for which the ladder goes no further: to the model's words, and to the brand.
FEW, FEWER = 5, 3


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, F.lit(n))))


def trigram_index(names: DataFrame, shortest: int = GRAM, longest: int = GRAM) -> DataFrame:
    """gram, name: the runs of `shortest` to GRAM characters of the distinct names, and those of `longest`."""
    own = names.select("name").filter("name IS NOT NULL").distinct()
    every = [grams(F.lower("name"), n) for n in sorted({*range(min(shortest, GRAM), GRAM + 1), longest})]
    return own.select(F.explode(reduce(lambda a, b: F.concat(a, b), every)).alias("gram"), "name")


def frequencies(index: DataFrame) -> DataFrame:
    """gram, n: how many names have it."""
    return index.groupBy("gram").agg(F.count("*").alias("n"))


def rarest_runs(needles: DataFrame, held: DataFrame, shortest: int = GRAM, longest: int = GRAM) -> DataFrame:
    """needle, gram: of each needle the run that fewest names have (held: frequencies()). Needles with a run that no name has are left out."""
    asked = needles.select(F.lower("needle").alias("needle")).distinct().filter(F.length("needle") >= shortest)
    size = F.length("needle")
    own = reduce(lambda out, n: F.when(size == n, grams(F.col("needle"), n)).otherwise(out), range(shortest, GRAM), grams(F.col("needle"), GRAM))
    if longest > GRAM:
        own = F.when(size >= longest, grams(F.col("needle"), longest)).otherwise(own)
    runs = asked.select("needle", F.explode(own).alias("gram")).join(held, "gram", "left")
    rarest = runs.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    return rarest.filter("rarest.n > 0").select("needle", "rarest.gram")


def holding(rarest: DataFrame, index: DataFrame) -> DataFrame:
    """needle, name: the names of the index that hold the needle, which are looked for under its rarest run."""
    return rarest.join(index, "gram").filter(F.lower("name").contains(F.col("needle"))).select("needle", "name")


def names_with(needles: DataFrame, index: DataFrame, shortest: int = GRAM, longest: int = GRAM) -> DataFrame:
    """needle, name: the names of the index that hold the needle. The index was made with the same `shortest` and `longest`."""
    return holding(rarest_runs(needles, frequencies(index), shortest, longest), index)


def search_words(name: Column) -> Column:
    """The words of a name under which it is looked for: articles, fan series, and words of four characters and more with dashes, dots and slashes."""
    plain = D.found(F.lower(name), r"([a-z0-9][a-z0-9._\-/]{3,})")
    return F.filter(D.distinct(plain, D.apple_articles(name), D.fan_series(name)), lambda t: F.length(t) >= 4)


def _first(array: Column, n: int) -> Column:
    return F.slice(array, 1, n)


def ladder(names: DataFrame, items: DataFrame) -> DataFrame:
    """product_name, name, step, found: the candidates of each name among the distinct names of items (product_id, name).

    step is the first of these that finds one, and found how many of the step's needles the candidate holds:
    1 equal names (and then no more); 2 a search word within the candidate; 3 the letters and number that a search word begins
    with; 4, of names with fewer than FEWER items so far, one of the first three model words; 5, with fewer than FEW, the
    brand; 6, with fewer than FEW, brand and one of the first two numbers.
    """
    items = items.select("product_id", "name").filter("name IS NOT NULL").distinct()
    ids = stored(items.groupBy("name").agg(F.count("*").alias("n")).withColumn("key", X.name_key(F.col("name"))))
    index = stored(trigram_index(ids, longest=LONG))
    held = stored(frequencies(index))
    own = stored(names.select("product_name").filter("product_name IS NOT NULL").distinct())
    exact = stored(own.join(ids, X.name_key(F.col("product_name")) == F.col("key")).filter("key <> ''").select("product_name", "name", F.lit(1).alias("step"), F.lit(1).alias("found")))
    # The words of a name take long to find, so names are spread over tasks.
    rest = similarity.spread(own.join(exact, "product_name", "left_anti"))
    used = [ids, index, held, own, exact, rest]

    def search(asked: DataFrame, needles: dict[int, Column]) -> DataFrame:
        """product_name, name, step and found of the first of the steps that finds the name; asked: product_name and what the needles of each step (arrays) come from."""
        each = [F.transform(F.array_distinct(F.transform(of, F.lower)), lambda t: F.struct(F.lit(step).alias("step"), t.alias("needle"))) for step, of in needles.items()]
        rows = stored(asked.select("product_name", F.explode(reduce(lambda a, b: F.concat(a, b), each)).alias("row")).select("product_name", "row.*"))
        # Written, so that Spark knows how few they are where most needles have a run that no name has.
        rarest = stored(rarest_runs(rows, held, longest=LONG))
        # All rows of a name go to one task at once.
        hits = rows.join(holding(rarest, index), "needle").select("product_name", "name", "step").repartition("product_name")
        best = hits.groupBy("product_name", "name").agg(F.min("step").alias("step"), *(F.count_if(F.col("step") == n).cast("int").alias(f"of_{n}") for n in needles))
        found = F.coalesce(*(F.when(F.col("step") == n, F.col(f"of_{n}")) for n in needles))
        out = stored(best.select("product_name", "name", "step", found.alias("found")))
        used.extend((rows, rarest, out))
        return out

    def short_of(most: int, asked: DataFrame, found: DataFrame) -> DataFrame:
        """The names asked that have fewer items."""
        enough = found.join(ids, "name").groupBy("product_name").agg(F.sum("n").alias("n")).filter(F.col("n") >= most)
        out = similarity.spread(asked.join(enough, "product_name", "left_anti"))
        used.append(out)
        return out

    def added(known: DataFrame, more: DataFrame) -> DataFrame:
        """What the later step finds besides."""
        out = stored(more.join(known, ["product_name", "name"], "left_anti"))
        used.append(out)
        return out

    name = F.col("product_name")
    word = search_words(name)
    head = F.transform(word, lambda t: F.regexp_extract(t, r"^([a-z]{1,4}-?[0-9]{3,5})", 1))
    found = [exact, search(rest, {2: word, 3: F.array_except(F.filter(head, lambda t: t != ""), word)})]
    # Most names have enough candidates; only of the others the items are counted.
    enough = found[-1].groupBy("product_name").agg(F.count("*").alias("n")).filter(F.col("n") >= FEW)
    lacking = stored(rest.join(enough, "product_name", "left_anti"))
    known = stored(found[-1].join(lacking, "product_name", "left_semi"))
    used.extend((lacking, known))
    few, fewer = short_of(FEW, lacking, known), short_of(FEWER, lacking, known)
    hints = F.filter(_first(D.model_hints(name), 3), lambda t: F.length(t) >= 4)
    found.append(added(known, search(fewer, {4: hints})))
    known = known.unionByName(found[-1])
    few = short_of(FEW, few, known)
    brand = F.when(F.length(D.brand(name)) >= 3, F.lower(D.brand(name)))
    found.append(added(known, search(few, {5: F.array_compact(F.array(brand))})))
    known = known.unionByName(found[-1])
    few = short_of(FEW, few, known)
    # Both the brand and a number: candidates of the brand that hold a number, which the search by numbers gives.
    last = stored(few.select("product_name", F.lower(D.brand(name)).alias("brand"), _first(D.found(name, r"\b([0-9]{3,5})\b"), 2).alias("numbers")).filter("brand IS NOT NULL"))
    used.append(last)
    both = search(last, {6: F.col("numbers")}).join(last.select("product_name", "brand"), "product_name").filter(F.lower("name").contains(F.col("brand"))).drop("brand")
    found.append(added(known, both))
    # No pair is found by two of these.
    out = stored(reduce(DataFrame.unionByName, found))
    discard(*used)
    return out


def ranked(candidates: DataFrame, most: int | None = None) -> DataFrame:
    """The candidates of ladder() with their rank: step, number of needles found, then the shorter and smaller name; `most` of each name."""
    order = Window.partitionBy("product_name").orderBy("step", F.desc("found"), F.length("name"), "name")
    rows = candidates.withColumn("rank", F.row_number().over(order))
    return rows if most is None else rows.filter(F.col("rank") <= most)
