"""Module inventory from the file structure (P06 mode b, C01).

Module of a file: first directory, or the second level under a source root
(src, lib, app, packages, modules, features, apps); test folders and
vendored files are skipped.  The description is the first pattern that
matches the module name or any of its file names.  Instead of collecting
all file names of a module, each file contributes the index of the first
pattern its name matches and the module keeps the minimum, so the
aggregation stays partial however large a module is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions.core import basename

TEST_DIRS = ["tests", "test", "__tests__"]
SOURCE_ROOTS = ["src", "lib", "app", "packages", "modules", "features", "apps"]
HINT_EXT = r"\.(ts|js|py|dart|go|java|rb|php|cs|tsx|jsx)$"
HINT_SKIP = ["index", "main", "__init__"]
TOP_MODULES = 15

# Module description patterns, in the order they are tried.
MODULE_PATTERNS = [
    ("auth", "Autenticação e autorização"), ("user", "Gestão de usuários"),
    ("payment|billing|charge|invoice", "Pagamentos e faturamento"), ("order|cart|checkout", "Pedidos e checkout"),
    ("product|catalog|item", "Catálogo de produtos"), ("notif", "Sistema de notificações"),
    ("email|mail|smtp", "Envio de emails"), ("report|analytics|dashboard", "Relatórios e analytics"),
    ("config|setting", "Configuração do sistema"), ("util|helper|common|shared", "Utilitários compartilhados"),
    ("middleware|interceptor|guard|pipe", "Middleware e interceptors"),
    ("database|db|migration|seed", "Banco de dados e migrations"),
    ("api|controller|route|endpoint", "API endpoints"), ("service|business|domain", "Lógica de negócio"),
    ("model|entity|schema", "Modelos de dados"), ("test|spec|fixture", "Testes"),
    ("validator|validation|sanitiz", "Validação de dados"), ("security|crypto|encrypt", "Segurança e criptografia"),
    ("cache|redis", "Cache e performance"), ("queue|worker|job|task", "Processamento assíncrono"),
    ("log|monitor|trace|metric", "Logging e monitoramento"), ("file|upload|storage|s3", "Armazenamento de arquivos"),
    ("search|elastic|index", "Busca e indexação"), ("chat|message|websocket|socket", "Comunicação em tempo real"),
    ("i18n|locale|translation", "Internacionalização"), ("theme|style|design", "Design system e temas"),
    ("component|widget|ui", "Componentes de UI"), ("page|screen|view", "Páginas/telas"),
    ("hook|composable", "Hooks/composables reutilizáveis"), ("store|state|redux|bloc", "Gerenciamento de estado"),
    ("navigation|router|routing", "Navegação e rotas"), ("bridge", "Camada de integração"),
    ("core", "Núcleo e orquestração"), ("event", "Sistema de eventos"), ("type", "Definições de tipos"),
    ("mcp", "MCP Server"), ("cli", "Interface de linha de comando"), ("cloud", "Serviço cloud / API"),
    ("autonomy", "Automação e self-healing"), ("app", "Aplicação principal"),
]


def module_structural(path) -> Column:
    """Mode (b) module name, or NULL for skipped files."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(p, "/")
    first = parts.getItem(0)
    return (F.when(p.contains("node_modules") | (F.size(parts) < 2) | first.isin(TEST_DIRS), F.lit(None))
            .when(first.isin(SOURCE_ROOTS), F.when(F.size(parts) > 2, parts.getItem(1)).otherwise(first))
            .otherwise(first))


def first_pattern(text: Column) -> Column:
    """1-based index of the first description pattern found in ``text``."""
    expr = None
    for i, (pat, _) in enumerate(MODULE_PATTERNS, start=1):
        c = text.rlike(pat)
        expr = F.when(c, F.lit(i)) if expr is None else expr.when(c, F.lit(i))
    return expr


def module_inventory(nodes: DataFrame, top: int = TOP_MODULES) -> DataFrame:
    """Top ``top`` modules per project by file count, with a description.

    ``nodes``: (project_id, path), e.g. the graph's node set."""
    n = nodes.select("project_id", "path").distinct().withColumn("module", module_structural("path")) \
        .where(F.col("module").isNotNull())
    hint = F.lower(F.regexp_replace(basename("path"), HINT_EXT, ""))
    n = n.withColumn("hint_idx", F.when(~F.regexp_replace(basename("path"), HINT_EXT, "").isin(HINT_SKIP),
                                        first_pattern(hint)))
    g = n.groupBy("project_id", "module").agg(F.count(F.lit(1)).alias("files"), F.min("hint_idx").alias("hint_idx"))
    g = g.withColumn("idx", F.least(first_pattern(F.lower(F.col("module"))), F.col("hint_idx")))
    w = Window.partitionBy("project_id").orderBy(F.desc("files"), "module")
    top_g = g.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)
    descs = F.array(*[F.lit(d) for _, d in MODULE_PATTERNS])
    return top_g.select("project_id", "module", F.col("files").cast("bigint").alias("files"), "rank",
                        F.when(F.col("idx").isNotNull(), F.element_at(descs, F.col("idx")))
                        .otherwise(F.concat(F.lit("Módulo "), F.col("module"))).alias("description"))
