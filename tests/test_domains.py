"""Keywords (P12), domains (C07), entity candidates and contexts."""

import pytest
from pyspark.sql import functions as F

from repolens.operators import corpus as C
from repolens.operators import domains as D
from repolens.operators.substrings import containing


def words(spark, text, make):
    return spark.createDataFrame([(text,)], "x string").select(make(F.col("x")).alias("w")).first().w


def test_identifier_parts(spark):
    assert words(spark, "userOrder_item-v2.test/X\\yABc", D.identifier_parts) == ["user", "Order", "item", "v2", "test", "X", "y", "ABc"]
    assert words(spark, "src/Core/userCart/ab/order-line_no.test.ts", D.path_words) == ["user", "cart", "order", "line", "test"]
    assert words(spark, "The big Cart, for all-of us!  (pay)", D.description_words) == ["cart", "allof", "pay"]


def test_keywords(spark):
    files = spark.createDataFrame([("p", "src/cartItem.ts"), ("p", "lib/cart.ts"), ("q", "a/b.ts")], "project_id string, path string")
    modules = spark.createDataFrame([("p", "cartStore")], "project_id string, module string")
    meta = spark.createDataFrame([("p", "my-shop", "A shop for carts"), ("q", None, None)], "project_id string, name string, description string")
    out = {(r.project_id, r.keyword): r.n for r in D.keywords(files, modules, meta).collect()}
    assert out == {("p", "cart"): 3, ("p", "item"): 1, ("p", "cartstore"): 1, ("p", "store"): 1, ("p", "my"): 1, ("p", "shop"): 2, ("p", "carts"): 1}


def plain(keywords):
    """The classification as nested loops."""
    hit = lambda ws: sum(any(w in k or k in w for k in keywords) for w in ws.split())
    best, domain, sub, size = 0, "general", "general", 1
    scores = {d: hit(ws) for d, ws in D.DOMAINS.items()}
    for d, ws in D.DOMAINS.items():
        if scores[d] > best:
            best, domain, size, most = scores[d], d, len(ws.split()), 0
            for s, sws in D.SUB_DOMAINS[d].items():
                if hit(sws) > most:
                    most, sub = hit(sws), s
    conf = min(1, best / min(size, 8)) if best else 0
    if sub not in ("general", domain):
        conf = min(1, conf + 0.1)
    if best and best >= 2 * max([v for d, v in scores.items() if d != domain], default=0):
        conf = min(1, conf + 0.1)
    return domain, sub, best, pytest.approx(min(0.95, conf))


@pytest.mark.parametrize("keywords", [
    ["patient", "clinical"], ["tenant"], ["order", "carts", "ship"], ["shipment", "tracking", "route", "delivery", "fleet", "driver", "cargo", "load", "warehouse"], ["zzz"], ["a"],
    ["rent", "plan", "team"], ["nota"], ["commission"], ["device", "sensors", "alerting"], ["parser", "lint", "cli", "score", "metric", "sdk"], ["post", "tag", "postage"], ["st", "an"]])
def test_domains(spark, keywords):
    out = D.classify_domains(spark.createDataFrame([("p", k) for k in keywords], "project_id string, keyword string")).collect()
    assert [(r.domain, r.sub_domain, r.score, r.confidence) for r in out] == [plain(keywords)]


def test_domains_are_found_per_project(spark):
    rows = [("p", "patient"), ("q", "cart"), ("r", "zzz")]
    out = {r.project_id: r.domain for r in D.classify_domains(spark.createDataFrame(rows, "project_id string, keyword string")).collect()}
    assert out == {"p": "healthtech", "q": "e-commerce", "r": "general"}


def test_substrings_meet_by_an_equi_join(spark):
    texts = ["alphabet", "betamax", "", "a", "alpha-alpha", "日本語"]
    names = ["alpha", "bet", "a", "", "本", "alphabet soup", "alpha-alpha"]
    out = containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in names], "name string"), gram=3)
    assert sorted((r.text, r.name) for r in out.collect()) == sorted((t, n) for t in texts for n in names if n in t)
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


TEXT = """Task: title, description, dueDate
- order table: id, total
Note: nothing else
Invoice goes to Customer and Invoice.

The Customer pays. The The Invoice. Éric Ab Ab Ab

Customer again, Shipment alone.

Shipment Shipment Warehouse. Warehouse Warehouse"""


def test_candidates(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")
    out = {r.entity: (r.kind, r.n) for r in C.entity_candidates(docs).collect()}
    assert out == {"Task": ("inline", 3), "Order": ("inline", 2), "Invoice": ("noun", 3), "Customer": ("noun", 3), "Shipment": ("noun", 3), "Warehouse": ("noun", 3)}


def test_contexts(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "Alone Alone Alone"), (3, "userX")], "doc_id long, text string")
    out = {(r.doc_id, r.entity): r.context for r in C.entity_contexts(docs, C.entity_candidates(docs)).collect()}
    # the first paragraph holds Task, Invoice and Customer (Order stands there in lower case only)
    assert out == {(1, "Task"): "task", (1, "Invoice"): "task", (1, "Customer"): "task", (1, "Order"): "order", (1, "Shipment"): "customer", (1, "Warehouse"): "shipment",
                   (2, "Alone"): "alone"}
