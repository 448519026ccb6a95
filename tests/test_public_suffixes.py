import random

from cartloom.functions.urls import with_url_components
from cartloom.sources.public_suffixes import registrable_domains, suffix_rules


def plain(host, rules):
    """The list's own algorithm: all rules are tried."""
    if host.replace(".", "").isdigit():
        return host
    labels = host.split(".")
    best = (False, 1)
    for rule in rules:
        spared, parts = rule.startswith("!"), rule.lstrip("!").split(".")
        if len(parts) <= len(labels) and all(p in ("*", x) for p, x in zip(reversed(parts), reversed(labels), strict=False)):
            best = max(best, (spared, len(parts) - spared))
    return ".".join(labels[-(best[1] + 1) :])


def test_equals_trying_all_rules(spark):
    pick = random.Random(4)
    label = lambda: pick.choice("abcde")
    name = lambda most: ".".join(label() for _ in range(pick.randint(1, most)))
    rules = sorted({pick.choice(["", "", "*.", "!"]) + name(4) for _ in range(150)})
    hosts = sorted({name(7) for _ in range(600)} | {"10.0.0.1", "a", "e.e.e.e.e.e.e.e.e.e.e"})
    lines = [(f"  {r.upper()} comment" if i % 3 else r,) for i, r in enumerate(rules)] + [("// a.b",), ("",), (None,), ("*",), (rules[0],)]
    table = suffix_rules(spark.createDataFrame(lines, "rule string"))
    got = {r.host: r.domain for r in registrable_domains(spark.createDataFrame([(h,) for h in [*hosts, None, hosts[0]]], "host string"), table).collect()}
    assert got == {h: plain(h, rules) for h in hosts}


def test_components_by_a_table_of_rules(spark):
    urls = ["https://www.oldnavy.shop.gap.example/x", "https://a.b.公司.cn/", "no url", None, "https://x.y.z.w/1", "https://x.y.z.w/2"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    rules = suffix_rules(spark.createDataFrame([("公司.cn",), ("*.w",)], "rule string"))
    got = {r.i: (r.domain, r.error is None) for r in with_url_components(df, suffixes=rules).collect()}
    assert got == {0: ("oldnavy.gap.example", True), 1: ("b.xn--55qx5d.cn", True), 2: (None, False), 3: (None, False), 4: ("y.z.w", True), 5: ("y.z.w", True)}
    none = with_url_components(df.limit(0), suffixes=rules.limit(0))
    assert none.collect() == [] and "domain" in none.columns


def test_the_join_has_no_hint_and_no_cross_product(spark):
    hosts = spark.range(10).selectExpr("concat('a', id, '.b.c') AS host")
    plan = registrable_domains(hosts, suffix_rules(spark.createDataFrame([("b.c",)], "rule string")))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
