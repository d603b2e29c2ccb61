"""Requirements mining over a text corpus.

Input ``docs``: (doc_id, text), whole texts.  All per-document work is
done in a single projection (array functions over fixed pattern tables),
so there is no shuffle except where facets are de-duplicated per document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions.core import ascii_regex
from repolens.session import materialize

# Domain keyword dictionaries, in the order they are tried.
DOMAIN_KEYWORDS = {
    "e-commerce": ["cart", "checkout", "payment", "product", "catalog", "order", "shipping", "inventory", "price",
                   "discount", "coupon"],
    "fintech": ["transaction", "account", "balance", "transfer", "payment", "ledger", "wallet", "kyc", "compliance",
                "bank"],
    "healthcare": ["patient", "appointment", "prescription", "diagnosis", "medical", "health", "doctor", "hospital",
                   "clinical"],
    "saas": ["tenant", "subscription", "billing", "plan", "feature", "onboarding", "workspace", "organization"],
    "social": ["post", "feed", "follow", "comment", "like", "notification", "profile", "message", "friend"],
    "education": ["course", "student", "lesson", "quiz", "enrollment", "grade", "instructor", "curriculum"],
    "logistics": ["shipment", "tracking", "warehouse", "delivery", "route", "fleet", "driver", "cargo"],
    "crm": ["contact", "lead", "pipeline", "deal", "opportunity", "campaign", "customer", "sales"],
}

# Integration patterns (case-insensitive) and their types, in order.
INTEGRATION_PATTERNS = [
    (r"\b(rest\s*api|http\s*endpoint|api\s*endpoint|restful)\b", "rest-api"),
    (r"\bgraphql\b", "graphql"),
    (r"\bgrpc\b", "grpc"),
    (r"\b(postgres|mysql|mongodb|sqlite|redis|database|db)\b", "database"),
    (r"\b(kafka|rabbitmq|sqs|queue|pubsub|event\s*bus)\b", "queue"),
    (r"\b(websocket|ws|real.?time|socket)\b", "websocket"),
    (r"\b(stripe|twilio|sendgrid|aws|gcp|azure|firebase|third.?party|external)\b", "external-service"),
]

# Non-functional patterns (case-insensitive).
AUTH_PATTERN = r"\b(jwt|oauth|oauth2|session|token|api.?key|bearer|saml|sso|openid|auth0|cognito|firebase\s*auth)\b"
DB_PATTERN = (r"\b(postgres(?:ql)?|mysql|mariadb|mongodb|mongo|sqlite|redis|dynamodb|cassandra|cockroachdb|"
              r"supabase|prisma|typeorm|drizzle|sequelize|mongoose)\b")
STACK_PATTERN = r"\b(typescript|javascript|python|go|golang|java|rust|ruby|php|c#|\.net|kotlin|swift|elixir)\b"
SCALE_PATTERN = r"\b(horizontal|vertical|auto.?scal|load.?balanc|cluster|replica)"
PERF_PATTERN = r"\b(\d+\s*ms|\d+\s*rps|low.?latency|real.?time|sub.?second)"
SECURITY_FLAGS = [(r"\b(https|ssl|tls|encryption)\b", "TLS/HTTPS required"), (r"\b(rbac|role.?based|permission)\b", "RBAC"),
                  (r"\b(rate.?limit|throttl)", "Rate limiting"), (r"\b(input.?validation|sanitiz)", "Input validation")]
COMPLIANCE_FLAGS = [(r"\bgdpr\b", "GDPR"), (r"\bhipaa\b", "HIPAA"), (r"\bpci[\s-]?dss\b", "PCI-DSS"),
                    (r"\bsoc[\s-]?2\b", "SOC 2")]
ACTOR_PATTERN = (r"\b(user|admin|customer|client|manager|operator|viewer|editor|moderator|owner|member|guest|"
                 r"subscriber|agent|analyst|developer|support|staff)\b")


def ci(pattern: str) -> str:
    """Case-insensitive pattern (RE2 / oracle form)."""
    return "(?i)" + pattern


def starts(pattern: str) -> str:
    """Character class of what a match of ``pattern`` begins with, '' if its
    alternatives do not all begin with a plain letter, a digit or a dot."""
    body = pattern.removeprefix(r"\b")
    depth, parts = 0, [""]
    for c in body[1:] if body.startswith("(") and not body.startswith("(?") else body:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            break
        if c == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    found = []
    for part in parts:
        head = re.match(r"([A-Za-z])(?![?*{])|(\\d\+)|(\\\.)(?![?*{])", part)
        if head is None:
            return ""
        found.append({1: head[0], 2: "0-9", 3: r"\."}[head.lastindex])
    return "[" + "".join(sorted(set(found))) + "]"


def jci(pattern: str) -> str:
    """Case-insensitive pattern for Spark, with ASCII word boundaries; where a
    match begins with one of few characters they are looked for first, which
    is far cheaper at most places of a text than the boundary."""
    first = starts(pattern) if pattern.startswith(r"\b") else ""
    return "(?i)" + (f"(?={first})" if first else "") + ascii_regex(pattern)


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, jci(pattern), 0), F.lit(""))


# ------------------------------------------------------------ C09 ----
def detect_domain(docs: DataFrame) -> DataFrame:
    """Best domain per document: most dictionary keywords contained in the
    lower-cased text; the first domain wins ties; none -> 'general'."""
    rows = docs.select("doc_id", F.lower("text").alias("low"))  # once per text, not per keyword
    low = F.col("low")
    scores = F.array(*[
        F.struct(sum((F.when(low.contains(k), 1).otherwise(0) for k in kws), F.lit(0)).alias("score"),
                 F.lit(-i).alias("o"), F.lit(d).alias("domain"))
        for i, (d, kws) in enumerate(DOMAIN_KEYWORDS.items())])
    rows = rows.select("doc_id", F.array_max(scores).alias("b"))
    return rows.select("doc_id", F.when(F.col("b.score") > 0, F.col("b.domain")).otherwise("general").alias("domain"),
                       F.col("b.score").cast("bigint").alias("score"))


def integrations(docs: DataFrame) -> DataFrame:
    """Integration mentions per document: (doc_id, name, type); a name keeps
    the type of the first pattern that found it."""
    arrays = [F.transform(F.regexp_extract_all(F.col("text"), F.lit(jci(p)), 0),
                          _tag_match(i, t)) for i, (p, t) in enumerate(INTEGRATION_PATTERNS)]
    ex = docs.select("doc_id", F.explode(F.concat(*arrays)).alias("m"))
    return (ex.groupBy("doc_id", F.col("m.name").alias("name"))
            .agg(F.min_by("m.type", "m.i").alias("type")))


def _tag_match(i: int, t: str):
    return lambda m: F.struct(F.lit(i).alias("i"), F.lower(F.trim(m)).alias("name"), F.lit(t).alias("type"))


def non_functional(docs: DataFrame) -> DataFrame:
    """First stack / auth / database / scalability / performance mention and
    the security and compliance flags, per document."""
    t = F.col("text")
    sec = F.array_join(F.filter(F.array(*[F.when(t.rlike(jci(p)), F.lit(n)) for p, n in SECURITY_FLAGS]),
                                lambda x: x.isNotNull()), ",")
    comp = F.array_join(F.filter(F.array(*[F.when(t.rlike(jci(p)), F.lit(n)) for p, n in COMPLIANCE_FLAGS]),
                                 lambda x: x.isNotNull()), ",")
    return docs.select("doc_id", _first(t, STACK_PATTERN).alias("preferred_stack"),
                       _first(t, AUTH_PATTERN).alias("auth"), _first(t, DB_PATTERN).alias("database"),
                       _first(t, SCALE_PATTERN).alias("scalability"), _first(t, PERF_PATTERN).alias("performance"),
                       sec.alias("security"), comp.alias("compliance"))


def actors(docs: DataFrame) -> DataFrame:
    """Distinct actor words per document (lower-cased)."""
    return (docs.select("doc_id", F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(F.col("text"), F.lit(jci(ACTOR_PATTERN)), 1), lambda m: F.lower(m)))).alias("actor")))


# ------------------------------------------------------------ C10 ----
# Capitalised words that name no entity, and the least count of the others.
NOUN_STOP = ["The", "This", "That", "When", "Each", "Every", "Some", "API", "REST", "HTTP", "JWT", "SQL"]
NOUN_MIN = 3
NOUN_PATTERN = r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)*)\b"
# The same: the first character is looked for before its boundary.
NOUN_SEARCH = r"(?=[A-Z])(?<![A-Za-z0-9_])([A-Z][a-z]+(?:[A-Z][a-z]+)*+)(?![A-Za-z0-9_])"
INLINE_ENTITY = r"^(?:[-*]\s+)?([A-Za-z0-9_]+)\s+(?:entity|model|table)[:\s]+(.+)"
INLINE_COLON = r"^([A-Z][a-zA-Z]+)\s*:\s*(.+)"


def _pascal(name: Column) -> Column:
    words = F.split(name, r"[-_\s]+")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def entity_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, entity, kind, n, place): definitions in one line with two or
    more fields (``inline``, n fields) and capitalised nouns that a text has
    ``NOUN_MIN`` times or more (``noun``, n times), in the order in which a
    text has them, each name once."""
    text = F.coalesce("text", F.lit(""))

    def defined(row):
        line, entity = row["line"], row["entity"]
        pick = lambda g: F.when(entity, F.regexp_extract(line, "(?i)" + INLINE_ENTITY, g)).otherwise(F.regexp_extract(line, INLINE_COLON, g))
        return F.struct(F.lit(0).alias("kind"), row["place"].alias("place"), _pascal(pick(1)).alias("entity"), F.size(F.split(pick(2), r",\s*")).cast("bigint").alias("n"))

    # lines of neither form, which are most, leave before anything is taken from them
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("place"), line.rlike("(?i)" + INLINE_ENTITY).alias("entity")))
    lines = F.filter(lines, lambda r: r["entity"] | r["line"].rlike(INLINE_COLON))
    inline = F.filter(F.transform(lines, defined), lambda d: d["entity"].isNotNull() & (F.length(d["entity"]) >= 2) & (d["n"] >= 2))
    nouns = F.transform(F.regexp_extract_all(text, F.lit(NOUN_SEARCH), 1), lambda w, i: F.struct(F.lit(1).alias("kind"), i.alias("place"), w.alias("entity"), F.lit(1).cast("bigint").alias("n")))
    nouns = F.filter(nouns, lambda d: (F.length(d["entity"]) >= 3) & ~d["entity"].isin(NOUN_STOP))
    rows = docs.select("doc_id", F.explode(F.concat(inline, nouns)).alias("e")).select("doc_id", "e.*")
    # plain numbers per name, so that the aggregate hashes and need not sort: 2^31 * line + fields, by the first line
    noun = F.col("kind") == 1
    per = rows.groupBy("doc_id", "entity").agg(
        F.min(F.when(~noun, F.col("place").cast("bigint") * (1 << 31) + F.col("n"))).alias("inline"),
        F.sum(F.when(noun, F.col("n"))).alias("times"), F.min(F.when(noun, F.col("place"))).alias("place"))
    per = per.where(F.col("inline").isNotNull() | (F.col("times") >= NOUN_MIN))
    defined_in = F.col("inline").isNotNull()  # a definition goes before a noun
    return per.select("doc_id", "entity", F.when(defined_in, "inline").otherwise("noun").alias("kind"),
                      F.when(defined_in, F.col("inline") % (1 << 31)).otherwise(F.col("times")).cast("bigint").alias("n"),
                      F.when(defined_in, F.shiftright("inline", 31)).otherwise(F.col("place")).cast("bigint").alias("place"))


def kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1-$2"), r"[\s_]+", "-"))


def entity_contexts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, entity, context): a text's first paragraph that names an entity
    and another puts it in the context of the first entity there; an entity
    that never stands beside another has its own.

    Paragraphs are compared inside the row of their text, so only the
    candidates are shuffled."""
    order = F.array_sort(F.collect_list(F.struct(F.when(F.col("kind") == "inline", 0).otherwise(1).alias("k"), "place", "entity")))
    named = candidates.groupBy("doc_id").agg(order.alias("es"))  # the distinct names of one text
    met = docs.select("doc_id", F.split("text", r"\n\n+").alias("ps")).join(named, "doc_id")
    held = F.transform("ps", lambda p: F.filter("es", lambda e: p.contains(e["entity"])))
    met = met.select("doc_id", "es", F.filter(F.transform(held, lambda h, i: F.struct(i.alias("i"), h["entity"].alias("names"))), lambda g: F.size(g["names"]) >= 2).alias("groups"))
    first = lambda e: F.get(F.filter(F.col("groups"), lambda g: F.array_contains(g["names"], e["entity"])), F.lit(0))
    rows = met.select("doc_id", F.explode(F.transform("es", lambda e: F.struct(e["entity"].alias("entity"), F.get(first(e)["names"], F.lit(0)).alias("leader")))).alias("x"))
    return rows.select("doc_id", "x.entity", kebab(F.coalesce("x.leader", "x.entity")).alias("context"))


# ------------------------------------------------------------ C12 ----
STYLES = ["layered-monolith", "clean-architecture", "hexagonal", "modular-monolith", "microservices", "event-driven"]


def requirement_facets(docs: DataFrame, workflows: DataFrame | None = None) -> DataFrame:
    """One row per document: what its text asks for, counted.  Columns:
    doc_id, domain, contexts, entities, integrations, databases, queues,
    websockets, workflows, security, compliance, scalability, performance.

    ``workflows``: (doc_id, workflows), where known."""
    found = materialize(entity_candidates(docs))  # read twice
    named = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entities"))
    areas = entity_contexts(docs, found).groupBy("doc_id").agg(F.count_distinct("context").alias("contexts"))
    kind = lambda t: F.count_if(F.col("type") == t)
    links = integrations(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("integrations"), kind("database").alias("databases"),
                                                     kind("queue").alias("queues"), kind("websocket").alias("websockets"))
    asks = non_functional(docs).select("doc_id", (F.col("security") != "").alias("security"), (F.col("compliance") != "").alias("compliance"),
                                       F.col("scalability").isNotNull().alias("scalability"), F.col("performance").isNotNull().alias("performance"))
    out = detect_domain(docs).select("doc_id", "domain")
    for part in (asks, named, areas, links) + ((workflows,) if workflows is not None else ()):
        out = out.join(part, "doc_id", "left")
    if workflows is None:
        out = out.withColumn("workflows", F.lit(0))
    flags = ["security", "compliance", "scalability", "performance"]
    counts = ["contexts", "entities", "integrations", "databases", "queues", "websockets", "workflows"]
    return out.select("doc_id", "domain", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
                      *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])


def rank_styles(facets: DataFrame) -> DataFrame:
    """(doc_id, style, score, rank): architecture styles by what a document
    asks for; equal scores keep the order of ``STYLES``."""
    c = F.col
    n, e, i, w = c("contexts"), c("entities"), c("integrations"), c("workflows")
    queue, socket, base = c("queues") > 0, c("websockets") > 0, c("databases") > 0
    # points of a style when nothing applies, then (condition, points)
    points = {
        "layered-monolith": (50, [(n <= 2, 20), (e <= 5, 15), (i <= 2, 10), (n > 5, -30)]),
        "clean-architecture": (40, [((n >= 2) & (n <= 5), 20), (e >= 3, 15), (c("security"), 10), (i >= 2, 10)]),
        "hexagonal": (30, [(i >= 3, 25), (base & queue, 15), (c("compliance"), 10), (i < 2, -20)]),
        "modular-monolith": (45, [((n >= 3) & (n <= 8), 25), (e >= 5, 15), (c("domain") != "general", 10), (n < 2, -20)]),
        "microservices": (20, [(n >= 5, 30), (c("scalability"), 15), (queue, 10), (n < 3, -30), (e < 5, -15)]),
        "event-driven": (25, [(queue, 30), (socket, 20), (w >= 3, 15), (c("performance"), 10), (~queue & ~socket, -20)])}
    score = lambda s: sum((F.when(t, p).otherwise(0) for t, p in points[s][1]), F.lit(points[s][0]))
    rows = F.array(*[F.struct((-score(s)).alias("o"), F.lit(k).alias("k"), F.lit(s).alias("style")) for k, s in enumerate(STYLES)])
    return facets.select("doc_id", F.posexplode(F.sort_array(rows)).alias("r", "x")).select(
        "doc_id", "x.style", (-F.col("x.o")).cast("bigint").alias("score"), (F.col("r") + 1).cast("bigint").alias("rank"))
