"""Payloads of any shape against a walk over the parsed JSON."""

import json
import random

from priceloom.sources import nested

OFFER = {"position_price": {"amount": "12,50", "converted": {"BYN": {"amount": "10.00"}}}, "shop_id": 7, "product_url": "u", "warranty": 12, "stock_status": {"text": "in"}}
SHOPS = {"7": {"title": "Seven", "html_url": "s7"}, "8": {"name": "Eight"}}


def found(spark, payloads):
    rows = nested.nested_offers(spark.createDataFrame(payloads, "product_id string, payload string")).collect()
    return sorted((r.product_id, r.seller_id, r.seller, r.seller_url, r.price, r.url, r.warranty, r.stock) for r in rows)


def test_forms_of_positions(spark):
    want = ("7", "Seven", "s7", 10.0, "u", "12", "in")
    payloads = [
        ("map", json.dumps({"positions": {"main": [OFFER, OFFER], "other": "none"}, "shops": SHOPS})),
        ("list", json.dumps({"positions": [OFFER, 5, None], "shops": SHOPS})),
        ("deep", json.dumps({"data": [{"blocks": {"x": [{"entry": OFFER}]}}], "shops": SHOPS})),
        ("none", json.dumps({"positions": {}})), ("bad", "{no json"), ("null", None), ("scalar", "5"), ("map", json.dumps({"positions": {"main": [OFFER, OFFER], "other": "none"}, "shops": SHOPS})),
    ]
    assert found(spark, payloads) == [("deep", *want), ("list", *want), ("map", *want)]
    assert found(spark, []) == []


def test_sellers_and_prices(spark):
    offers = [
        {"price": 5, "seller": {"name": "In", "id": 3, "url": "iu"}, "shop_id": 9},
        {"price": {"amount": 6}, "shop_id": 8},
        {"price": "7.00", "vendor_name": "Named"},
        {"position_price": {"amount": 0}, "price": "8"},
        {"price": -1}, {"price": None}, {"title": "no price"}, {"price": {"amount": 6}, "shop_id": "8"},
        {"price": 9, "shop": {}, "store": {"title": "Stored"}},
    ]
    got = found(spark, [("p", json.dumps({"positions": {"a": offers}, "shops": SHOPS}))])
    assert got == sorted([("p", "3", "In", "iu", 5.0, "iu", "", ""), ("p", "8", "Eight", "", 6.0, "", "", ""), ("p", "", "Named", "", 7.0, "", "", ""), ("p", "", "Stored", "", 9.0, "", "", "")])


def walk(node):
    if isinstance(node, dict):
        price = node.get("position_price")
        if isinstance(price, dict) and type(price.get("amount")) is int and price["amount"] > 0:
            yield price["amount"]
    for part in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        yield from walk(part)


def test_amounts_at_any_depth(spark):
    rng = random.Random(4)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.2:
            return rng.choice([1, "x", None, True])
        if kind < 0.5:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(("a", "position_price", "position_price", "amount", "amount")): rng.randint(-2, 9) if rng.random() < 0.3 else made(depth - 1) for _ in range(rng.randint(0, 4))}

    trees = [made(7) for _ in range(150)] + [[[[[[[[{"position_price": {"amount": 5}}]]]]]]]]
    rows = nested.amounts(spark.createDataFrame([(str(k), json.dumps(t)) for k, t in enumerate(trees)] + [("x", None)], "product_id string, payload string")).collect()
    assert sorted((r.product_id, r.price) for r in rows) == sorted((str(k), float(p)) for k, t in enumerate(trees) for p in walk(t))
    assert len(rows) > 10


def test_payloads_stay_one_row(spark, monkeypatch):
    """Sellers are looked up within the payload and not joined; offers at any depth of one payload that agree are one."""
    plans = []
    kept = nested.stored
    monkeypatch.setattr(nested, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    low = {"price": {"amount": "1 010,50"}, "shop_id": " 7 ", "stock_status": {"text": " in"}}
    deep = dict(low, warranty=3)
    for _ in range(2 * nested.LEVELS + 3):
        deep = {"x": [deep]} if _ % 2 else [deep, [], {}]
    payloads = [("p", json.dumps({"shops": {"7": {"title": " Seven "}}, "rows": [low, deep, {"price": {"amount": {"y": 1}}, "a": {"price": 3}}]})), ("p", "[]"), ("q", json.dumps({"positions": [{"price": [1]}, {"price": "{5}"}], "b": {"price": 2}}))]
    assert found(spark, payloads) == [("p", "", "—", "", 3.0, "", "", ""), ("p", "7", "Seven", "", 1010.5, "", "", "in"), ("q", "", "—", "", 2.0, "", "", "")]
    assert len(plans) > 2 and not any("Join" in p for p in plans)
    assert sum(p.count("Aggregate [") for p in plans) == 1
