"""Inference from paths: modules (P06 c), entities (P11), endpoints (P13),
module details (C02), untested modules, critical files, size classes (C03)."""

import pytest

from repolens.functions import inference as I
from repolens.operators import enrich as E

FILES = "project_id string, path string"
EDGES = "project_id string, src string, dst string, weight double"


def column(spark, values, make):
    df = spark.createDataFrame([(v,) for v in values], "path string")
    return {r.path: r.x for r in df.select("path", make("path").alias("x")).collect()}


MODULES = {
    "src/modules/cart/x.ts": "cart", "a/features/login.ts": "login.ts", "Packages/core/src/x.ts": "core", "src/modules/": "modules",
    "app/domain/services/billing/f.py": "billing", "app/domain/services/f.py": "domain/services", "core/cart/f.ts": "cart", "src/domain/ab/c.ts": None,
    "domain/__init__/deep/x.py": "deep", "application/x": None, "orders/views.py": "orders", "src/views.py": None, "web/admin.py": "web",
    "src/main/java/com/acme/shop/A.java": "shop", "x/org/y": "org", "App/Http/Controllers/UserController.php": "User", "App/Http/Controllers/Admin/XController.php": "Admin",
    "App/Http/Requests/AbRequest.php": "Requests", "cmd/server/main.go": "server", "x/pkg/a.go": None, "pkg/store/a.go": "store", "src/lib/utils/f.ts": None, "tools/src/f.ts": "tools",
    ".github/x.yml": None, "a.ts": None, "src/node_modules/x.ts": None, "src/payments/deep/utils/x.ts": "deep",
}


def test_modules(spark):
    assert column(spark, MODULES, I.module_inferred) == MODULES


def test_resources(spark):
    want = {"a/routes/userRouter.ts": "user", "a/routes/index.ts": "", "shop/order/index.ts": "order", "controllers/base.php": "", "a/Order-Items_View.py": "orderitems", "x/cart.controller.ts": "cart.",
            "routes.ts": "routes", "Controller.ts": "", "my_shop/Controller.ts": "myshop"}
    assert column(spark, want, I.resource_name) == want


def test_entity_names(spark):
    want = {"src/models/customer-order.model.ts": "Customer Order.Model", "x/customer-order.model.ts": "Customer Order", "a/entities/user_role.py": "User Role", "x/Index.entity.ts": None, "src/schema/base.ts": None,
            "b/car.entity.ts": "Car", "a/x.ts": None, "models/a.b.ts": "A.B", "src/éclair.schema.js": "éClair"}
    assert column(spark, want, I.entity_name) == want


def test_entities_are_listed_once(spark):
    df = spark.createDataFrame([("p", "b/models/User.ts"), ("p", "a/entities/user.ts"), ("p", "c/dto/item.schema.ts"), ("q", "models/user.ts"), ("p", "x.ts")], FILES)
    assert sorted((r.project_id, r.name, r.source, r.layer) for r in E.entities(df).collect()) == [
        ("p", "Item", "c/dto/item.schema.ts", "dto"), ("p", "User", "a/entities/user.ts", "entity"), ("q", "User", "models/user.ts", "unknown")]


def served(spark, paths, edges=()):
    files = spark.createDataFrame([("p", p) for p in paths], FILES)
    out = E.endpoints(files, spark.createDataFrame([("p", a, b, 1.0) for a, b in edges], EDGES))
    return sorted((r.method, r.endpoint, r.file, r.handler, r.has_auth, r.has_validation) for r in out.collect())


@pytest.mark.parametrize("path, want", [
    ("a/routes/health.ts", [("GET", "/health", "health_check", False, False)]), ("a/routes/metrics.ts", [("GET", "/metrics", "get_metrics", True, False)]),
    ("a/routes/auth.ts", [("POST", "/auth/login", "login", False, True), ("POST", "/auth/refresh", "refresh_token", True, False), ("POST", "/auth/register", "register", False, True)]),
    ("a/routes/searchView.ts", [("GET", "/search/search", "search_search", True, True), ("POST", "/search/search", "advanced_search_search", True, True)]),
    ("a/routes/user-router.ts", [("DELETE", "/user/{id}", "delete_user", True, True), ("GET", "/user", "list_user", True, True), ("GET", "/user/{id}", "get_user", True, True),
                                 ("POST", "/user", "create_user", True, True), ("PUT", "/user/{id}", "update_user", True, True)]),
    ("a/routes/index.ts", []), ("a/lib/user.ts", [])])
def test_endpoints(spark, path, want):
    assert served(spark, [path], [(path, "x/jwt.ts"), (path, "x/user.dto.ts")]) == [(m, e, path, *rest) for m, e, *rest in want]


def test_the_first_file_of_an_endpoint_counts(spark):
    out = served(spark, ["b/routes/user.js", "b/routes/user.ts"], [("b/routes/user.ts", "x/guard.ts")])
    assert {r[2] for r in out} == {"b/routes/user.js"} and not any(r[4] for r in out)


def test_details(spark):
    df = spark.createDataFrame([("p", "src/modules/cart/a.ts", 3), ("p", "src/modules/cart/a.test.ts", 4), ("p", "src/modules/pay/b.service.ts", 5), ("p", "src/modules/pay/pay.controller.ts", 6), ("p", "a.ts", 9)],
                               FILES + ", lines int")
    details = E.module_details(df)
    out = {r.module: (r.files, r.lines, r.tests, r.controllers, r.services) for r in details.collect()}
    assert out == {"cart": (2, 7, 1, 0, 0), "pay": (2, 11, 0, 1, 1)}
    assert [(r.module, r.files) for r in E.untested_modules(details).collect()] == [("pay", 2)]


def test_critical_files_and_sizes(spark):
    edges = spark.createDataFrame([("p", "a", "b", 2.0), ("p", "a", "c", 1.0), ("p", "c", "b", 1.0)], EDGES)
    assert [(r.path, r.weight, r["rank"]) for r in E.critical_files(edges, 2).orderBy("rank").collect()] == [("a", 3.0, 1), ("b", 3.0, 2)]
    files = spark.createDataFrame([("s", "x", 10_000), ("m", "x", 10_001), ("l", "x", 50_001), ("e", "x", 100_001)] + [("n", str(i), 0) for i in range(51)], FILES + ", lines int")
    assert {r.project_id: r.size_class for r in E.size_classes(files).collect()} == {"s": "small", "m": "medium", "l": "large", "e": "enterprise", "n": "medium"}
