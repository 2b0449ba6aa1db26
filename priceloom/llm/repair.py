"""Conversation structure repair by a rank-compressed dynamic program.

A conversation's turns are edited so that their role initials read `(s?(ua)+)?`, at the least cost. What an edit does to the
roles is a step between four states: nothing yet, after s, after u, after a. A macro edit is a run of insertions and the edit of
one turn; as a code (I...I and D, K or R) it is prefix-free, and codes are ordered as strings. A layer of the program holds for
each state the least cost and, in place of the audit string, its rank among the states' audit strings: two strings compare as
the ranks they continue and then the codes, since no code begins another. Each state has a parent (state and code), from which
the audit is read back at the end. Costs of a layer count from its least one, so few layers differ, and a step is remembered.

Conversations are dealt out by their id, sorted by turn and read one at a time. One of more than CHUNK turns is cut by range
into chunks: a chunk is solved for each state it may begin in, the chunks' costs and ranks are put together as layers are, and
then each chunk is read back from the state in which it has to end. What the chunks before have seen comes as hashes. The whole
of a long conversation is only joined, chunk after chunk, where its hash is taken.

Order within a conversation: turn (nulls first), role, the first characters of the text, SHA-256 of the text. Null roles and
texts are one space, and so are a null conv_id and turn in `damaged`. Rows without a conv_id are one conversation. A role
without a first character can't be kept. Repeated rows are duplicates. Gaps beyond 64 bits are the largest number. Other
columns are not read. An empty table gives an empty result.
"""

import hashlib
from ast import literal_eval
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceloom.llm.shared import CRC_TABLE_SQL, crc32_sql, discard, stored, table

#: Turns of a conversation from which it is cut into chunks of about so many.
CHUNK = 20_000
#: Characters of a text by which turns are ordered before its hash.
BEGIN = 64
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Of each state the one after each initial that may follow, and the initial that an inserted or renamed turn gets.
STATES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
ADDED, ROLES = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
#: Insertions after the last turn that make a state an accepted one.
TAIL = {"": "", "a": "", "u": "I", "s": "II"}
ORDER = ("turn", "role", "begin", "mark")


@lru_cache(None)
def steps(must_go: bool, truncated: bool, initial: str) -> list[tuple[str, str, int, str]]:
    """From a state, to a state, cost and code of each macro edit of a turn. Two insertions in a run only return to where one was."""
    out = []
    for begin in STATES:
        at = begin
        for inserted in range(2):
            cost, code = inserted * INSERT, "I" * inserted
            out.append((begin, at, cost + DELETE, code + "D"))
            if not must_go:
                if initial in STATES[at]:
                    out.append((begin, STATES[at][initial], cost + truncated * TRUNCATED, code + "K"))
                out.append((begin, ADDED[at], cost + RENAME + truncated * TRUNCATED, code + "R"))
            at = ADDED[at]
    return out


def merge(candidates: dict[str, list[tuple]]) -> tuple[tuple, int, dict]:
    """The next layer from (cost, rank, code, parent) by state: its (state, cost above the least, rank), the least cost, and the parents.

    rank and code may be anything that compares as the audit strings do.
    """
    best = {state: min(c, key=lambda x: x[:3]) for state, c in candidates.items() if c}
    least = min(b[0] for b in best.values())
    ranked = sorted(best, key=lambda s: best[s][1:3])
    return tuple((s, best[s][0] - least, ranked.index(s)) for s in sorted(best)), least, {s: (b[3], b[2]) for s, b in best.items()}


@lru_cache(200_000)
def advance(layer: tuple, must_go: bool, truncated: bool, initial: str) -> tuple[tuple, int, dict]:
    at = {s: (cost, rank) for s, cost, rank in layer}
    candidates: dict[str, list[tuple]] = {}
    for begin, end, cost, code in steps(must_go, truncated, initial):
        if begin in at:
            candidates.setdefault(end, []).append((at[begin][0] + cost, at[begin][1], code, begin))
    return merge(candidates)


def start(state: str) -> tuple:
    return ((state, 0, 0),)


def solve(kinds: list[tuple[bool, bool, str]], layer: tuple) -> tuple[tuple, int, list[dict]]:
    """The last layer after turns of those kinds, what its costs count from, and the parents of each turn."""
    total, parents = 0, []
    for kind in kinds:
        layer, least, own = advance(layer, *kind)
        total += least
        parents.append(own)
    return layer, total, parents


def finish(layer: tuple) -> tuple[int, str]:
    """The least cost with the insertions at the end, and the state before them."""
    cost, _, state = min((c + INSERT * len(TAIL[s]), rank, s) for s, c, rank in layer)
    return cost, state


def codes(parents: list[dict], state: str) -> tuple[list[str], str]:
    """The code of each turn on the way to the state, and the state that the way begins in."""
    out = []
    for own in reversed(parents):
        state, code = own[state]
        out.append(code)
    return out[::-1], state


def rewritten(turns: list[tuple[str, str]], edits: list[str], state: str, tail: str) -> list[str]:
    """The repaired lines of turns (role, text), from a state on."""
    lines = []
    for (role, text), code in zip([*turns, ("", "")], [*edits, tail], strict=True):
        for edit in code:
            if edit == "K":
                state = STATES[state][role[0]]
                lines.append(f"{role}:{text}")
            elif edit != "D":
                state = ADDED[state]
                lines.append(f"{ROLES[state]}:{text if edit == 'R' else ''}")
    return lines


def blank(text: str) -> bool:
    return not text.strip(" \t\n\v\f\r")


class Turns:
    """What is to be known of the turns of a conversation, or of a chunk of one, in order."""

    def __init__(self, rows: list[dict], seen: set[bytes] = frozenset()):
        self.rows, seen = rows, set(seen)
        self.faults, self.kinds = {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for r in rows:
            fault = ""
            if blank(r["text"]):
                fault = "blank"
            elif r["same"] in seen:
                fault = "duplicate"
            elif r["text"].rstrip(" \t\n\v\f\r")[-1] not in ".!?":
                fault = "truncated"
            seen.add(r["same"])
            if fault:
                self.faults[fault] += 1
            self.kinds.append((fault in ("blank", "duplicate"), fault == "truncated", r["role"][:1] if r["role"][:1] in ("s", "u", "a") else ""))
        initials = [r["role"][:1] for r in rows]
        self.ends = (initials[0], initials[-1]) if rows else None
        self.illegal = sum(map(illegal, initials, initials[1:]))
        numbers = [r["turn"] for r in rows if r["turn"] is not None]
        self.span = (numbers[0], numbers[-1], len(set(numbers))) if numbers else None

    def lines(self, edits: list[str], state: str, tail: str) -> list[str]:
        return rewritten([(r["role"], r["text"]) for r in self.rows], edits, state, tail)


def illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def gaps(first: int, last: int, distinct: int) -> int:
    return min(last - first + 1 - distinct, (1 << 63) - 1)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _result(span, faults: dict, illegal_: int, cost: int, audit: str, digest) -> dict:
    return {"gaps": gaps(*span) if span else 0, **faults, "illegal": illegal_, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest()}


def repaired(rows: list[dict]) -> dict:
    """The result for a whole conversation."""
    turns = Turns([r for r in rows if r["given"]])
    layer, total, parents = solve(turns.kinds, start(""))
    cost, state = finish(layer)
    edits, begin = codes(parents, state)
    text = "\n".join(turns.lines(edits, begin, TAIL[state]))
    return _result(turns.span, turns.faults, turns.illegal, total + cost, "".join(edits) + TAIL[state], hashlib.sha256(text.encode()))


def _runs(batches, keys: tuple[str, ...]):
    """The rows of each run of equal keys, in order, whatever batches they come in."""
    key, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            own = tuple(r[k] for k in keys)
            if own != key and rows:
                yield rows
                rows = []
            key = own
            rows.append(r)
    if rows:
        yield rows


def _by_conversation(rows: DataFrame, work, keys: tuple[str, ...], order: tuple[str, ...], schema: str) -> DataFrame:
    """What work makes of the rows of each run of keys; results go on in batches."""
    names = schema.split(", ")

    def run(batches):
        out = []
        for found in _runs(batches, keys):
            out.append(work(found))
            if len(out) >= 1000:
                yield from table_of(out)
                out = []
        yield from table_of(out)

    def table_of(out):
        return pa.Table.from_pylist(out, _arrow(names)).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _arrow(fields: list[str]) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in fields])


def _summary(rows: list[dict]) -> dict:
    """Of a chunk, for each state it may begin in, the cost and the rank of each state it may end in; and what meets the next chunk."""
    turns = Turns([r for r in rows if r["tag"] == 1], {r["same"] for r in rows if r["tag"] == 0})
    ways = {}
    for state in STATES:
        layer, total, _ = solve(turns.kinds, start(state))
        ways[state] = [(s, total + c, rank) for s, c, rank in layer]
    return {"conv": rows[0]["conv"], "chunk": rows[0]["chunk"], "ways": repr((ways, turns.ends, turns.span, turns.faults, turns.illegal))}


def _joined(chunks: pa.Table) -> pa.Table:
    """The states in which each chunk begins and ends, and with the last chunk the result but for the audit and the hash."""
    rows = sorted(chunks.to_pylist(), key=lambda r: r["chunk"])
    layer, total, parents, ends, span = start(""), 0, [], None, None
    faults, wrong = dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0
    for r in rows:
        ways, own_ends, own_span, own_faults, own_wrong = literal_eval(r["ways"])
        candidates: dict[str, list[tuple]] = {}
        for begin, cost, rank in layer:
            for end, more, order in ways[begin]:
                candidates.setdefault(end, []).append((cost + more, rank, order, begin))
        layer, least, own = merge(candidates)
        total += least
        parents.append(own)
        wrong += own_wrong + (ends is not None and illegal(ends, own_ends[0]))
        ends = own_ends[1]
        faults = {k: n + own_faults[k] for k, n in faults.items()}
        if own_span:
            span = own_span if span is None else (span[0], own_span[1], span[2] + own_span[2] - (span[1] == own_span[0]))
    cost, state = finish(layer)
    numbers = {"gaps": gaps(*span) if span else 0, **faults, "illegal": wrong, "cost": total + cost}
    out, tail = [], TAIL[state]
    for r, own in zip(reversed(rows), reversed(parents), strict=True):
        before = own[state][0]
        out.append({"conv": r["conv"], "chunk": r["chunk"], "begins": before, "finishes": state, "tail": tail, **(dict.fromkeys(numbers, 0) if out else numbers)})
        state, tail = before, ""
    return pa.Table.from_pylist(out, _arrow(JOINED.split(", ")))


JOINED = "conv string, chunk int, begins string, finishes string, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _read_back(rows: list[dict]) -> dict:
    """The audit of a chunk and its repaired lines."""
    plan = next(r for r in rows if r["tag"] == -1)
    turns = Turns([r for r in rows if r["tag"] == 1], {r["same"] for r in rows if r["tag"] == 0})
    edits, _ = codes(solve(turns.kinds, start(plan["begins"]))[2], plan["finishes"])
    lines = turns.lines(edits, plan["begins"], plan["tail"])
    return {"conv": plan["conv"], "chunk": plan["chunk"], "audit": "".join(edits) + plan["tail"], "lines": "\n".join(lines) if lines else None}


def _hashed(batches):
    """The audit and the hash of each conversation, whose chunks come in order; one chunk's text is held at a time."""
    def done():
        return pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], _arrow(["conv string", "audit string", "repaired_sha256 string"]))

    conv, audit, digest, some = None, [], None, False
    for batch in batches:
        for k in range(len(batch)):
            r = batch.slice(k, 1).to_pylist()[0]
            if r["conv"] != conv:
                if conv is not None:
                    yield done()
                conv, audit, digest, some = r["conv"], [], hashlib.sha256(), False
            audit.append(r["audit"])
            if r["lines"] is not None:
                digest.update(("\n" if some else "").encode() + r["lines"].encode())
                some = True
    if conv is not None:
        yield done()


def _long(rows: DataFrame, n: int) -> DataFrame:
    """The result for conversations of more than CHUNK turns, n turns in all."""
    parts = -(-n // CHUNK) + 1
    cut = rows.filter("given").repartitionByRange(parts, "conv", *ORDER, "tie").withColumn("chunk", F.spark_partition_id())
    cut = stored(cut.select("conv", "chunk", "turn", "role", "text", "begin", "mark", "same"))
    marks = cut.select("conv", "chunk", "same").distinct()
    before = Window.partitionBy("conv", "same")  # a row for each chunk at most
    seen = marks.withColumn("first", F.min("chunk").over(before)).filter(F.col("chunk") > F.col("first"))
    turns = cut.withColumn("tag", F.lit(1)).unionByName(seen.select("conv", "chunk", "same", F.lit(0).alias("tag")), allowMissingColumns=True)
    keys = ("conv", "chunk")
    parts = stored(_by_conversation(turns, _summary, keys, ("tag", *ORDER), "conv string, chunk int, ways string"))
    plan = stored(parts.groupBy("conv").applyInArrow(_joined, JOINED))
    turns = turns.unionByName(plan.select("conv", "chunk", "begins", "finishes", "tail", F.lit(-1).alias("tag")), allowMissingColumns=True)
    texts = stored(_by_conversation(turns, _read_back, keys, ("tag", *ORDER), "conv string, chunk int, audit string, lines string"))
    hashed = texts.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_hashed, "conv string, audit string, repaired_sha256 string")
    numbers = [f.split(" ")[0] for f in RESULT.split(", ")[:6]]
    out = stored(plan.groupBy("conv").agg(*[F.sum(c).alias(c) for c in numbers]).join(hashed, "conv"))
    discard(cut, parts, plan, texts)
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with the damage that the CRC of conv_id and turn gives; of dropped rows `given` is false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "copy": F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))})
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") != 0).alias("given"))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id and the columns of RESULT. turns: conv_id, turn, role, text and given (false: a row that only names its conversation)."""
    mark = F.sha2(F.col("text").cast("binary"), 256)
    rows = turns.select(
        F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit("-")).alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), "given", F.monotonically_increasing_id().alias("tie"),
    ).withColumns({"begin": F.substring("text", 1, BEGIN), "mark": mark, "same": F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", mark).cast("binary"), 256))})
    sizes = stored(rows.filter("given").groupBy("conv").count().filter(F.col("count") > CHUNK))
    n = sizes.agg(F.sum("count")).first()[0]
    names = F.when(F.col("conv") != "-", F.substring("conv", 2, 1 << 30)).try_cast(turns.schema["conv_id"].dataType).alias("conv_id")
    short = rows if n is None else rows.join(sizes, "conv", "left_anti")
    columns = [f.split(" ")[0] for f in RESULT.split(", ")]
    short = short.select("conv", "turn", "role", "text", "given", "begin", "mark", "same")
    out = _by_conversation(short, lambda found: {"conv": found[0]["conv"], **repaired(found)}, ("conv",), ORDER, f"conv string, {RESULT}").select(names, *columns)
    if n is None:
        return out
    return out.unionByName(_long(rows.join(sizes, "conv", "left_semi"), n).select(names, *columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
given AS (SELECT conv_id, coalesce(':' || conv_id::VARCHAR, '-') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
hashed AS (SELECT *, {crc32_sql("id")} % 20 AS kind FROM given, crc_table),
damage AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
           FROM hashed, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS r(copy)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, left(text, {BEGIN}), sha256(text)) AS k FROM damage),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY k) > 1 AS again, lead(role) OVER (PARTITION BY conv ORDER BY k) AS later,
         regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare FROM placed),
turns AS (SELECT *, left(role, 1) AS initial, bare = '' AS blank, bare <> '' AND again AS duplicate, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM seen),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
           count(*) FILTER (later IS NOT NULL AND initial || left(later, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM turns GROUP BY conv),
follows(st, nx, named) AS (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
runs AS (SELECT st, '' AS code, st AS here, []::VARCHAR[] AS added FROM follows UNION ALL SELECT st, 'I', nx, [named || ':'] FROM follows
  UNION ALL SELECT x.st, 'II', y.nx, [x.named || ':', y.named || ':'] FROM follows x JOIN follows y ON x.nx = y.st),
edits AS (SELECT runs.*, nx, named, edit FROM runs JOIN follows ON here = follows.st, (VALUES ('D'), ('K'), ('R')) AS e(edit)),
best AS (SELECT DISTINCT conv, 0::BIGINT AS k, '' AS st, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS b FROM given
  UNION ALL
  SELECT best.conv, best.k + 1, CASE edit WHEN 'D' THEN here WHEN 'K' THEN initial ELSE nx END AS st, min({{
    'c': b.c + {INSERT} * length(code) + CASE edit WHEN 'D' THEN {DELETE} ELSE truncated::INT * {TRUNCATED} + CASE edit WHEN 'R' THEN {RENAME} ELSE 0 END END,
    'a': b.a || code || edit,
    'l': b.l || added || CASE edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [named || ':' || text] END}})
  FROM best JOIN turns ON best.conv = turns.conv AND best.k + 1 = turns.k JOIN edits ON best.st = edits.st
  WHERE edit = 'D' OR (NOT blank AND NOT duplicate AND (edit = 'R' OR initial = nx OR (here = '' AND initial = 's')))
  GROUP BY best.conv, best.k, 3),
tails AS (SELECT st, code, added FROM runs WHERE (st IN ('', 'a') AND code = '') OR (st = 'u' AND code = 'I') OR (st = 's' AND code = 'II')),
ended AS (SELECT best.conv, min({{'c': b.c + {INSERT} * length(code), 'a': b.a || code, 'l': b.l || added}}) AS b
  FROM best LEFT JOIN counts ON best.conv = counts.conv JOIN tails USING (st) WHERE k = coalesce(n, 0) GROUP BY best.conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       b.c AS cost, b.a AS audit, sha256(array_to_string(b.l, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM given) JOIN ended USING (conv) LEFT JOIN counts USING (conv)
"""
