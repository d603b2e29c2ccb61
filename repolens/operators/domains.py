"""Project keywords (P12) and business domains.

``files``: (project_id, path); ``modules``: (project_id, module); ``meta``:
(project_id, name, description), any number of rows a project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolens.functions.core import round6
from repolens.operators.substrings import containing

# Path segments that say nothing about a project.
GENERIC_SEGMENTS = "src lib app core common shared utils helpers index main __init__ test tests spec __tests__ node_modules dist build .git".split()

# Keywords of the domains, in the order they are tried.
DOMAINS = {
    "fintech": "payment transaction invoice billing ledger account transfer wallet bank loan credit debit finance fiscal tax irpf imposto receita declaracao contribuinte pix boleto nfe nota-fiscal",
    "healthtech": "patient medical health diagnosis prescription clinical hospital doctor appointment ehr fhir dicom sus prontuario consulta exame",
    "e-commerce": "product cart order catalog shipping checkout inventory price discount coupon store shop marketplace seller buyer carrinho pedido estoque frete",
    "edtech": "student course lesson quiz grade enrollment teacher classroom curriculum lms aluno aula nota matricula professor",
    "devtools": "analyzer analysis architect lint linter ast parser scanner refactor mcp cli plugin extension sdk compiler transpiler bundler formatter debugger profiler intelligence code-review anti-pattern score metric dependency-graph",
    "saas": "tenant subscription plan workspace organization team member role permission billing api-key webhook dashboard",
    "iot": "device sensor telemetry mqtt gateway firmware signal measurement monitoring alert threshold",
    "content-management": "article post blog page cms content media publish author category tag comment",
    "real-estate": "property listing tenant landlord rent lease imovel aluguel inquilino condominio",
    "logistics": "shipment route delivery warehouse fleet driver tracking dispatch load cargo entrega rastreamento frota motorista",
    "hr-management": "employee payroll leave attendance hiring candidate department salary benefit funcionario folha ferias ponto contratacao",
}
# Keywords of the sub-domains, in the order they are tried.
SUB_DOMAINS = {
    "fintech": {"tax-processing": "irpf tax imposto fiscal receita declaracao contribuinte deducao rendimento", "payment-gateway": "payment pix boleto stripe checkout charge",
                "banking": "bank account transfer balance statement ledger", "invoicing": "invoice billing nfe nota-fiscal fatura", "lending": "loan credit installment interest amortization"},
    "healthtech": {"ehr": "patient record prontuario clinical ehr", "telemedicine": "appointment consulta video teleconsulta", "diagnostics": "diagnosis exame lab result"},
    "e-commerce": {"marketplace": "seller buyer marketplace commission", "retail": "product catalog inventory store shop", "logistics": "shipping delivery frete tracking warehouse"},
    "edtech": {"lms": "course lesson enrollment lms aula", "assessment": "quiz grade exam prova nota"},
    "devtools": {"code-intelligence": "analyzer analysis architect anti-pattern score metric intelligence refactor", "mcp-server": "mcp perception reasoning validation tool-calling",
                 "cli-tool": "cli command terminal argv yargs commander", "ide-extension": "extension plugin language-server lsp vscode", "build-tool": "bundler compiler transpiler webpack esbuild vite"},
    "saas": {"multi-tenant": "tenant workspace organization", "subscription": "subscription plan billing trial"},
    "iot": {"monitoring": "sensor telemetry monitoring measurement", "device-management": "device firmware gateway provision"},
    "content-management": {"cms": "article post publish cms content", "media": "media image video upload gallery"},
    "real-estate": {"property-management": "property tenant rent lease condominio", "listings": "listing search filter imovel"},
    "logistics": {"fleet-management": "fleet driver vehicle frota motorista", "delivery": "delivery shipment tracking entrega rastreamento", "warehouse": "warehouse inventory stock storage"},
    "hr-management": {"payroll": "payroll salary folha benefit compensation", "recruitment": "hiring candidate interview contratacao", "time-tracking": "attendance leave ponto ferias"},
}
FULL_SCORE, SUB_BOOST, GAP_BOOST, MOST = 8, 0.1, 0.1, 0.95


# ------------------------------------------------------------ P12 ----
def identifier_parts(name: Column) -> Column:
    """The words of an identifier in camel, snake, kebab, dot or slash case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), r"[-_./\\]", " ")
    return F.filter(F.split(spaced, r"\s+"), lambda w: w != "")


def description_words(text: Column) -> Column:
    """Words of more than three characters, in lower case, letters and digits only."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 3)
    return F.transform(words, lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))


def path_words(path: Column) -> Column:
    segments = F.filter(F.split(path, "/"), lambda s: ~F.lower(s).isin(GENERIC_SEGMENTS))
    words = F.flatten(F.transform(segments, lambda s: identifier_parts(F.regexp_replace(s, r"\.[^.]+$", ""))))
    return F.transform(F.filter(words, lambda w: F.length(w) > 2), lambda w: F.lower(w))


def keywords(files: DataFrame | None = None, modules: DataFrame | None = None, meta: DataFrame | None = None) -> DataFrame:
    """(project_id, keyword, n): the words of paths, module names, project
    names and descriptions, with how often each was found."""
    lower = lambda words: F.transform(words, lambda w: F.lower(w))
    parts = []
    if files is not None:
        parts.append(files.select("project_id", path_words(F.col("path")).alias("words")))
    if modules is not None:
        parts.append(modules.select("project_id", F.concat(F.array(F.lower("module")), lower(identifier_parts(F.col("module")))).alias("words")))
    if meta is not None:
        none = F.array().cast("array<string>")
        parts.append(meta.select("project_id", F.concat(F.coalesce(lower(identifier_parts(F.col("name"))), none), F.coalesce(description_words(F.col("description")), none)).alias("words")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.select("project_id", F.explode("words").alias("keyword")).where(F.col("keyword") != "")
    return rows.groupBy("project_id", "keyword").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


# ------------------------------------------------------------ C07 ----
def domain_table(spark: SparkSession) -> DataFrame:
    """(place, domain, sub_place, sub_domain, word): the fixed tables as rows;
    sub_domain is null for the words of the domain itself."""
    rows = [(i, d, None, None, w) for i, (d, words) in enumerate(DOMAINS.items()) for w in words.split()]
    rows += [(i, d, k, s, w) for i, d in enumerate(DOMAINS) for k, (s, words) in enumerate(SUB_DOMAINS[d].items()) for w in words.split()]
    return spark.createDataFrame(rows, "place int, domain string, sub_place int, sub_domain string, word string")


def matched_words(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(keyword, word): pairs of which either holds the other."""
    k, w = terms.select(F.col("keyword").alias("text")).distinct(), words.select("word").distinct()
    inside = containing(k, w.withColumnRenamed("word", "name")).select(F.col("text").alias("keyword"), F.col("name").alias("word"))
    around = containing(w.withColumnRenamed("word", "text"), k.withColumnRenamed("text", "name")).select(F.col("name").alias("keyword"), F.col("text").alias("word"))
    return inside.unionByName(around).distinct()


def classify_domains(terms: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(project_id, domain, sub_domain, score, confidence) for the keywords
    (project_id, keyword): the first domain with most of its words matched.
    The sub-domain is the best of the last domain, in table order, that beat
    all before it and has a matched sub-domain."""
    table = domain_table(terms.sparkSession) if table is None else table
    seen = terms.select("project_id", "keyword").join(matched_words(terms, table), "keyword").select("project_id", "word").distinct()
    hits = seen.join(table, "word")
    size = table.where("sub_domain IS NULL").groupBy("place", "domain").agg(F.count(F.lit(1)).alias("size"))
    score = hits.where("sub_domain IS NULL").groupBy("project_id", "place", "domain").agg(F.count(F.lit(1)).alias("score"))
    subs = hits.where("sub_domain IS NOT NULL").groupBy("project_id", "place", "sub_place", "sub_domain").agg(F.count(F.lit(1)).alias("n"))
    best_sub = subs.groupBy("project_id", "place").agg(F.min_by("sub_domain", F.struct((-F.col("n")).alias("n"), "sub_place")).alias("sub"))
    # one row for each domain of a project: a small window
    by = Window.partitionBy("project_id").orderBy("place")
    ranked = (score.join(best_sub, ["project_id", "place"], "left").join(size, ["place", "domain"])
              .withColumn("before", F.coalesce(F.max("score").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    record = F.col("score") > F.col("before")
    per = ranked.groupBy("project_id").agg(
        F.min_by(F.struct("place", "domain", "score", "size"), F.struct((-F.col("score")).alias("s"), "place")).alias("b"),
        F.max_by("sub", F.when(record & F.col("sub").isNotNull(), F.col("place"))).alias("sub"),
        F.sort_array(F.collect_list("score"), asc=False).alias("scores"))  # one score for each domain
    second = F.coalesce(F.get("scores", F.lit(1)), F.lit(0))
    sub = F.coalesce("sub", F.lit("general"))
    raw = F.least(F.lit(1.0), F.col("b.score") / F.least(F.col("b.size"), F.lit(FULL_SCORE)))
    raw = F.when((sub != "general") & (sub != F.col("b.domain")), F.least(F.lit(1.0), raw + SUB_BOOST)).otherwise(raw)
    raw = F.when(F.col("b.score") >= 2 * second, F.least(F.lit(1.0), raw + GAP_BOOST)).otherwise(raw)
    found = per.select("project_id", "b.domain", sub.alias("sub_domain"), F.col("b.score").cast("bigint").alias("score"), round6(F.least(F.lit(MOST), raw)).alias("confidence"))
    return (terms.select("project_id").distinct().join(found, "project_id", "left")
            .select("project_id", *[F.coalesce(c, F.lit("general")).alias(c) for c in ("domain", "sub_domain")],
                    F.coalesce("score", F.lit(0)).cast("bigint").alias("score"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")))
