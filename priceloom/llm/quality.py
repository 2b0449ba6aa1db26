"""Quality rules, line first, in DataFrame operations only.

Every line is judged by itself. A line fails
- navigation: it has three or more `|`, `>`, `»`, `›`, `•` or `·` between short items (three words an item or fewer),
- boilerplate: it is short (up to SHORT characters) and holds a phrase of BOILERPLATE, in any of four languages,
- punctuation: it has UNENDED words or more and does not end like a sentence, or over a third of its characters that are not
  white space are symbols of SYMBOLS, or over two thirds of its words end in the same mark (`!`, `#`, `$`, `%`, `&`, `*`).
Failing lines are removed; a document that keeps less than KEEP of its words is rejected. Before that come the base
rules: fewer than MIN_WORDS words, or more than REPEATED of the words in 5-word windows that occur again.

All is done within a row; the work for a row grows with its length (times its logarithm for the windows), and nothing
is shuffled. Null and empty texts have no words and fail. Repeated rows are judged alike. Lines without a word count
for nothing. Other columns are not read.
"""

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.llm.shared import ASCII_SPACE, ASCII_WORD, table

SPACES = " \t\n\x0b\f\r"
SYMBOLS, LOUD = "#*$%&|<>", "!#$%&*"
#: Without one of these characters a line can only fail as boilerplate.
SUSPECT = "[#*$%&|<>»›•·!]"
MIN_WORDS, REPEATED, WINDOW, KEEP = 10, 20, 5, 0.5
SHORT, UNENDED = 160, 5
#: The last characters of a line that ends like a sentence, a heading of a list or a quotation.
ENDS = (".", "!", "?", "…", ":", ";", "。", "！", "？", '"', "”", "’", "»", ")", "]")

# Phrases of page furniture, lower case.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "back to top", "click here to", "cookie policy", "enable javascript",
    "follow us on", "javascript is disabled", "log in to", "lorem ipsum", "our newsletter", "powered by",
    "privacy policy", "sign up for", "skip to content", "subscribe to", "terms of service", "terms of use",
    "uses cookies", "we use cookies",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "nach oben", "newsletter abonnieren", "nutzungsbedingungen", "zum inhalt springen",
    "accepter les cookies", "aller au contenu", "haut de page", "mentions légales", "politique de confidentialité", "tous droits réservés",
    "aceptar las cookies", "aviso legal", "política de privacidad", "saltar al contenido", "todos los derechos reservados", "términos de uso", "volver arriba",
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, ASCII_SPACE), "")


def _without(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, f"[{re.escape(characters)}]", "")


def line_fails(line: Column) -> Column:
    """Whether a line with at least one word fails. The cheap tests come first: few lines reach the counting."""
    marks = F.length(line) - F.length(_without(line, "|>»›•·"))
    n_words = F.regexp_count(line, F.lit(ASCII_WORD))
    solid = F.length(_without(line, SPACES))
    symbols = F.length(line) - F.length(_without(line, SYMBOLS))
    enders = F.length(line) - F.length(_without(line, LOUD))
    loud = F.greatest(*[F.regexp_count(line, F.lit(rf"[{m}]([\x20\x09-\x0D]|$)")) for m in LOUD])
    # exists() over one element lower-cases the line once for all phrases.
    boilerplate = (F.length(line) <= SHORT) & F.exists(F.array(F.lower(line)), lambda low: reduce(or_, [low.contains(phrase) for phrase in BOILERPLATE]))
    unended = ~F.right(F.rtrim(line, F.lit(SPACES)), F.lit(1)).isin(*ENDS) & (n_words >= UNENDED)
    navigation = (marks >= 3) & (n_words <= 4 * (marks + 1))
    shouting = (enders >= 3) & (n_words >= 3) & (3 * enders > 2 * n_words) & (3 * loud > 2 * n_words)
    return (line.rlike(SUSPECT) & (navigation | (3 * symbols > solid) | shouting)) | boilerplate | unended


def _repeated_words(words: Column) -> Column:
    """How many words lie in windows of five that occur twice or more among these words."""
    n = F.size(words) - WINDOW + 1
    marks = F.transform(F.slice(words, 1, n), lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    return F.when(n >= 2, marks)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_words; no line is dropped yet."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(ASCII_WORD))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        _words(F.col("text")).alias("words"),
        lines.alias("lines"),
    )
    base = base.withColumns({"n_words": F.size("words").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long"), "windows": _repeated_words(F.col("words"))})
    base = base.withColumn("n_distinct", F.size(F.array_distinct("windows")))
    # Only rows with a repeated window pay for sorting.
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("pairs", F.when(F.col("n_distinct") < F.size("windows"), pairs))
    near = F.zip_with("pairs", F.slice("pairs", 2, F.greatest(F.size("pairs") - 1, F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.array_compact(near))))
    base = base.withColumn("at", F.when(F.col("pairs").isNotNull(), at))
    widths = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(widths, F.lit(0), lambda acc, x: acc + x)
    base = base.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long"))
    dups = F.size("lines") - F.size(F.array_distinct("lines"))
    failing = F.aggregate(F.filter("lines", line_fails), F.lit(0), lambda acc, x: acc + F.regexp_count(x, F.lit(ASCII_WORD)))
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", dups.cast("long").alias("n_dup_lines"), "n_repeat_words", (F.col("n_words") - failing).alias("kept_words"))


def judged(docs: DataFrame) -> DataFrame:
    """measured() with base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return measured(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("kept_words") >= KEEP * F.col("n_words")))


def clean_text(docs: DataFrame) -> DataFrame:
    """The rows of docs without their failing lines; lines without a word stay."""
    good = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(ASCII_WORD) | ~line_fails(x))
    return docs.withColumn("text", F.array_join(good, "\n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


_LOUD = ", ".join(rf"len(regexp_extract_all(x, '[{m}]([\x20\x09-\x0D]|$)'))" for m in "!#$%&*")
_W = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_W}') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines FROM d),
one AS (SELECT r, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM w),
win AS (SELECT r, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS x,
               lead(x, 4) OVER o IS NOT NULL AS whole FROM one WINDOW o AS (PARTITION BY r ORDER BY i)),
win2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win WHERE whole),
reps AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next_i FROM win2 WHERE n > 1),
rep AS (SELECT r, sum(least(5, coalesce(next_i - i, 5)))::BIGINT AS n_repeat_words FROM reps GROUP BY r),
ln AS (SELECT r, unnest(lines) AS x FROM w),
lf AS (SELECT r, len(regexp_extract_all(x, '{_W}')) AS n,
              length(x) - length(translate(x, '|>»›•·', '')) AS marks,
              length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS solid,
              length(x) - length(translate(x, '#*$%&|<>', '')) AS symbols,
              greatest({_LOUD}) AS loud, length(x) <= {SHORT} AND regexp_matches(lower(x), '{"|".join(BOILERPLATE)}') AS furniture,
              right(rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ({", ".join(f"'{e}'" for e in ENDS)}) AS unended FROM ln),
good AS (SELECT r, sum(n)::BIGINT AS kept_words FROM lf
         WHERE NOT ((marks >= 3 AND n <= 4 * (marks + 1)) OR furniture OR (unended AND n >= {UNENDED}) OR 3 * symbols > solid OR (n >= 3 AND 3 * loud > 2 * n))
         GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(kept_words, 0)::BIGINT AS kept_words
      FROM w LEFT JOIN rep USING (r) LEFT JOIN good USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_words >= 0.5 * n_words AS kept
FROM m
"""
