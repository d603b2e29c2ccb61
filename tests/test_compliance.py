"""Compliance rules and integrations (C08), style ranking (C12), barrel
consumers (R02) and degradations (T02) on literal rows."""

from __future__ import annotations

from repolens.operators import compliance as CP
from repolens.operators import corpus as C
from repolens.operators import refactor as RF


def test_compliance_rules(spark):
    domains = spark.createDataFrame([("tax", "fintech", "tax-processing"), ("care", "healthtech", "ehr"), ("shop", "e-commerce", "general"),
                                     ("plain", "general", "general"), ("quiet", "iot", "general"), ("br", "devtools", "cli-tool")],
                                    "project_id string, domain string, sub_domain string")
    terms = spark.createDataFrame([("tax", "cpf"), ("care", "userEmail"), ("care", "brasil"), ("shop", "Phone"), ("plain", "word"), ("plain", None), ("br", "CNPJ"), ("br", "address")],
                                  "project_id string, keyword string")
    got = {}
    for r in sorted(CP.compliance(domains, terms).collect(), key=lambda r: r.place):
        got.setdefault(r.project_id, []).append((r.rule, r.origin))
    assert got == {
        "tax": [("PCI-DSS", "domain"), ("LGPD", "sub_domain"), ("RFB-Compliance", "sub_domain")],
        # a form of LGPD is there, but only LGPD itself covers personal data
        "care": [("HIPAA", "domain"), ("LGPD-Health", "domain"), ("PII-Protection", "personal data")],
        "shop": [("CDC", "domain"), ("PII-Protection", "personal data")],
        "br": [("LGPD", "brazilian words")]}


def test_integrations_by_keyword_or_path(spark):
    terms = spark.createDataFrame([("p", "mongoose"), ("p", "BullMQ"), ("q", "nothing")], "project_id string, keyword string")
    files = spark.createDataFrame([("p", "src/Kafka/a.ts"), ("r", "lib/pay-stripe.ts"), ("r", None)], "project_id string, path string")
    got = sorted((r.project_id, r.name, r.kind, r.found_by) for r in CP.integrations(terms, files).collect())
    assert got == [("p", "BullMQ", "queue", "bull"), ("p", "Kafka", "queue", "kafka"), ("p", "MongoDB", "database", "mongo"), ("r", "Stripe", "payment", "stripe")]
    assert CP.integrations(terms.limit(0), files.limit(0)).count() == 0


FACETS = ("doc_id int, domain string, contexts bigint, entities bigint, integrations bigint, databases bigint, queues bigint, websockets bigint, "
          "workflows bigint, security boolean, compliance boolean, scalability boolean, performance boolean")


def test_style_ranking(spark):
    rows = [(1, "general", 0, 0, 0, 0, 0, 0, 0, False, False, False, False), (2, "saas", 6, 8, 4, 1, 2, 1, 3, True, True, True, True)]
    got = {}
    for r in sorted(C.rank_styles(spark.createDataFrame(rows, FACETS)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.doc_id, []).append((r.style, r.score))
    assert got[1] == [("layered-monolith", 95), ("clean-architecture", 40), ("modular-monolith", 25), ("hexagonal", 10), ("event-driven", 5), ("microservices", -25)]
    # equal scores in the order of the styles
    assert got[2] == [("event-driven", 100), ("modular-monolith", 95), ("hexagonal", 80), ("clean-architecture", 75), ("microservices", 75), ("layered-monolith", 20)]


def test_facets_of_a_text(spark):
    text = "Order Customer Order Customer Order Customer. We use PostgreSQL and Kafka.\n\nnothing else"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    got = {r.doc_id: r for r in C.requirement_facets(docs).collect()}
    assert got[1].entities == 2 and got[1].contexts == 1 and got[1].integrations >= 1
    for k in (2, 3):
        assert (got[k].domain, got[k].entities, got[k].integrations, got[k].security) == ("general", 0, 0, False)


def test_barrel_consumers_must_import_the_barrel(spark):
    barrel = [("p", "m/index.ts", f"m/{x}.ts") for x in "abcd"]
    edges = barrel + [("p", "u/both.ts", "m/index.ts"), ("p", "u/both.ts", "m/a.ts"), ("p", "u/both.ts", "m/b.ts"), ("p", "u/direct.ts", "m/a.ts"),
                      ("p", "u/barrel.ts", "m/index.ts"), ("q", "u/both.ts", "m/a.ts")]
    df = spark.createDataFrame(edges, "project_id string, src string, dst string")
    got = [(r.barrel, r.outgoing, r.siblings, r.consumers) for r in RF.barrel_candidates(df).collect()]
    assert got == [("m/index.ts", 4, 4, 1)]
