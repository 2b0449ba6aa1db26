"""The log of decisions against a replay by hand."""

import random

from priceloom.operators import ledger as L

ITEMS = "supplier string, name_key string, product_id string"
DECISIONS = "number long, supplier string, name_key string, action string, product_id string, seen long, duplicates boolean"


class ByHand:
    def __init__(self, items):
        self.items, self.sets, self.undone = items, [], []

    def state(self):
        out = {}
        for k, came in self.items.items():
            batches = [b for b, s in self.sets if k in s]
            own = [(b, s[k]) for b, s in self.sets if k in s and b not in [u for _, u in self.undone]]
            version = max([*batches, *[at for at, u in self.undone if any(b == u and k in s for b, s in self.sets)]], default=0)
            out[k] = (max(own)[1][0] if own else came, version)
        return out

    def decide(self, batch, decisions):
        now, done, given, out = self.state(), {}, {}, {}
        blocked = {(k, v[1]) for b, s in self.sets if b not in [u for _, u in self.undone] for k, v in s.items() if v[1]}
        for number, supplier, name, action, pid, seen, free in sorted(decisions, key=lambda d: d[0]):
            k, sets = (supplier or "", name), pid if action == "confirm" else None
            others = [j for j, (p, _) in now.items() if j[0] == k[0] and j != k and p == sets and sets]
            if k not in now:
                out[number] = "gone"
            elif now[k][1] != seen:
                out[number] = "stale"
            elif (k, sets) in blocked:
                out[number] = "blocked"
            elif action == "confirm" and pid is None:
                out[number] = "no_id"
            elif others and not free:
                out[number] = "conflict"
            elif k in done:
                out[number] = "later"
            else:
                done[k] = number
                if sets and (k[0], sets) in given and not free:
                    out[number] = "taken"
                    continue
                given.setdefault((k[0], sets), k)
                out[number] = "accepted"
                done[k] = (sets, pid if action == "reject" else None)
        self.sets.append((batch, {k: v for k, v in done.items() if isinstance(v, tuple)}))
        return out

    def undo(self, batch):
        left = [b for b, s in self.sets if b not in [u for _, u in self.undone] and s]
        if left:
            self.undone.append((batch, max(left)))


def test_batches_and_undoing_against_a_replay_by_hand(spark, tmp_path):
    rng = random.Random(2)
    items = {(s, f"name{k}"): rng.choice([None, str(k), str(k % 3)]) for s in ("a", "b", "") for k in range(6)}
    frame = spark.createDataFrame([(s or None, n, p) for (s, n), p in items.items()] + [("a", None, "1"), ("a", "", "1")], ITEMS)
    known, by_hand, path = L.items_of(frame), ByHand(items), str(tmp_path / "log")
    L.append(path, L.empty_log(spark))
    seen_outcomes = set()
    for batch in range(1, 7):
        log = spark.read.schema(L.LOG).parquet(path)
        now = L.state(known, log)
        assert {(r.supplier, r.name_key): (r.product_id, r.version) for r in now.collect()} == by_hand.state()
        if batch in (3, 5):
            L.append(path, L.undo_last(log, batch))
            by_hand.undo(batch)
            continue
        versions = {k: v for k, (_, v) in by_hand.state().items()}
        made = []
        for number in range(90):
            k = rng.choice([*items, ("a", "nobody")])
            seen = versions.get(k, 0) if rng.random() < 0.9 else rng.randint(0, 5)
            made.append((number, k[0] or None, k[1], rng.choice(("confirm", "confirm", "confirm", "clear", "reject")), rng.choice([None, "0", "1", "2", "7", "8", "9"]), seen, rng.choice((True, False, None, False))))
        judged = L.judge(spark.createDataFrame(made, DECISIONS), now, L.blocked_ids(log))
        got = {r.number: r.outcome for r in judged.collect()}
        assert got == by_hand.decide(batch, made)
        seen_outcomes |= set(got.values())
        L.append(path, L.log_rows(judged, batch))
    assert seen_outcomes >= {"accepted", "stale", "conflict", "later", "taken", "gone", "no_id", "blocked"}


def test_nothing_to_undo_and_empty_tables(spark):
    log = L.empty_log(spark)
    assert L.undo_last(log, 1).collect() == []
    items = spark.createDataFrame([], ITEMS)
    assert L.state(L.items_of(items), log).collect() == []
    decisions = spark.createDataFrame([(1, "a", "x", "confirm", "5", 0, None)], DECISIONS)
    assert [r.outcome for r in L.judge(decisions, L.state(items, log)).collect()] == ["gone"]
    assert L.judge(decisions.limit(0), L.state(items, log)).collect() == []
