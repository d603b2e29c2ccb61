"""Compliance rules and external integrations of projects.

``terms``: (project_id, keyword); ``domains``: (project_id, domain,
sub_domain), as C07 gives them; ``files``: (project_id, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of domains and sub-domains, in order, and the words
# that stand for Brazil and for personal data.
RULES = {
    "fintech": ["PCI-DSS"], "tax-processing": ["LGPD", "RFB-Compliance"], "healthtech": ["HIPAA", "LGPD-Health"],
    "e-commerce": ["CDC"], "hr-management": ["LGPD-Employment"],
}
BRAZILIAN = ["cpf", "cnpj", "cep", "lgpd", "brasil", "brazil", "pt-br", "ptbr", "receita"]
PERSONAL = ["email", "password", "phone", "address", "ssn", "cpf", "passport", "birth"]
# Integrations with their kind and the words that show them, in order.
INTEGRATIONS = [
    ("Stripe", "payment", ["stripe"]), ("PagSeguro", "payment", ["pagseguro"]), ("Mercado Pago", "payment", ["mercadopago", "mercado-pago"]),
    ("PIX", "payment", ["pix"]), ("OAuth2/OIDC", "auth", ["oauth", "oidc", "openid"]), ("JWT", "auth", ["jwt", "jsonwebtoken"]),
    ("Keycloak", "auth", ["keycloak"]), ("Auth0", "auth", ["auth0"]), ("PostgreSQL", "database", ["postgres", "postgresql", "pg"]),
    ("MongoDB", "database", ["mongo", "mongodb", "mongoose"]), ("Redis", "database", ["redis", "ioredis"]), ("MySQL", "database", ["mysql", "mysql2"]),
    ("SQLite", "database", ["sqlite"]), ("RabbitMQ", "queue", ["rabbitmq", "amqp"]), ("Kafka", "queue", ["kafka"]), ("AWS SQS", "queue", ["sqs"]),
    ("BullMQ", "queue", ["bull", "bullmq"]), ("AWS S3", "storage", ["s3", "aws-sdk"]), ("MinIO", "storage", ["minio"]),
    ("Receita Federal", "government", ["receita", "rfb", "ecac", "sefaz"]), ("SERPRO", "government", ["serpro"]), ("eSocial", "government", ["esocial"]),
    ("Email (SMTP)", "other", ["smtp", "nodemailer", "sendgrid", "ses"]), ("ElasticSearch", "other", ["elastic", "elasticsearch"]), ("Sentry", "other", ["sentry"])]


def _any_of(text: Column, words: list[str]) -> Column:
    return F.greatest(*[text.contains(w) for w in words]) if len(words) > 1 else text.contains(words[0])


def compliance(domains: DataFrame, terms: DataFrame) -> DataFrame:
    """(project_id, rule, origin, place): the rules of a project's domain, then
    of its sub-domain; LGPD for Brazilian words, unless some form of it is
    there; PII-Protection for words of personal data, unless LGPD or GDPR
    itself is there.  Projects without a rule give no rows."""
    word = F.lower("keyword")
    seen = terms.groupBy("project_id").agg(F.max(_any_of(word, BRAZILIAN)).alias("brazilian"), F.max(_any_of(word, PERSONAL)).alias("personal"))
    table = F.create_map(*[x for k, v in RULES.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    none = F.array().cast("array<struct<rule:string,origin:string>>")
    rules = lambda c: F.coalesce(F.transform(table[F.col(c)], lambda r: F.struct(r.alias("rule"), F.lit(c).alias("origin"))), none)
    extra = lambda test, rule, origin: F.when(test, F.array(F.struct(F.lit(rule).alias("rule"), F.lit(origin).alias("origin")))).otherwise(none)
    p = domains.join(seen, "project_id", "left").withColumn("r", F.concat(rules("domain"), rules("sub_domain")))
    p = p.withColumn("r", F.concat("r", extra(F.col("brazilian") & ~F.exists("r", lambda x: x["rule"].contains("LGPD")), "LGPD", "brazilian words")))
    p = p.withColumn("r", F.concat("r", extra(F.col("personal") & ~F.exists("r", lambda x: x["rule"].isin("LGPD", "GDPR")), "PII-Protection", "personal data")))
    return p.select("project_id", F.posexplode("r").alias("i", "x")).select("project_id", "x.rule", "x.origin", (F.col("i") + 1).cast("bigint").alias("place"))


def integrations(terms: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, name, kind, found_by): integrations that a keyword or a
    path shows, with the first word of theirs that does.

    Each row gives flags and a project their maxima: no project's keywords or
    paths are put together."""
    words = sorted({w for _, _, ws in INTEGRATIONS for w in ws})
    text = terms.select("project_id", F.lower("keyword").alias("t")).unionByName(files.select("project_id", F.lower("path").alias("t")))
    flags = text.groupBy("project_id").agg(*[F.max(F.col("t").contains(w)).alias(f"w{i}") for i, w in enumerate(words)])
    first = lambda ws: F.coalesce(*[F.when(F.col(f"w{words.index(w)}"), w) for w in ws])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), first(ws).alias("found_by")) for n, k, ws in INTEGRATIONS])
    return (flags.select("project_id", F.explode(F.filter(rows, lambda r: r["found_by"].isNotNull())).alias("r"))
            .select("project_id", "r.name", "r.kind", "r.found_by"))
