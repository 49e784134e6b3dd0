"""Layered settings, sinks and the synthetic corpus."""

from pyspark.sql import functions as F

from corpusloom.operators import graph, lexer, settings, symbols
from corpusloom.sources import files, sinks, synthetic

ENTRY = "name string, provider string, kind string, base_url string, proxy string, headers map<string,string>, structured string"


def test_layers_and_credentials(spark):
    entries = spark.createDataFrame(
        [("a", "p", "openai", " ", None, {"x": "1", "y": None}, None), ("b", None, "openai", "http://u:pw@own/v1/", "http://px/", None, "prompt")], ENTRY
    )
    providers = spark.createDataFrame([("p", "https://api.example.com/v1", None, {"x": "0", "y": "2"})], "name string, base_url string, proxy string, headers map<string,string>")
    rows = {r["name"]: r for r in settings.resolved(entries, providers, {"proxy": "http://d"}).collect()}
    assert rows["a"]["base_url"] == "https://api.example.com/v1" and rows["a"]["proxy"] == "http://d" and rows["a"]["headers"] == {"x": "1", "y": "2"}
    assert rows["b"]["headers"] == {} and rows["b"]["structured"] == "prompt"
    models = settings.resolved(entries, providers, {})
    keys = spark.createDataFrame([("z", "https://own/v1", "k1"), (None, None, "k2")], "name string, base_url string, key string")
    assert {r["name"]: r["has_key"] for r in settings.with_credentials(models, keys, None).collect()} == {"a": False, "b": True}
    lines = {r["name"]: r["line"] for r in settings.overview(models).collect()}
    assert len({len(x) for x in lines.values()}) == 1 and "pw" not in lines["b"] and "proxy px" in lines["b"]


def test_problems(spark):
    entries = spark.createDataFrame([("a", "gone", "other", None, None, None, "xml"), ("b", "p", "openai", None, None, None, None), ("b", "p", "openai", None, None, None, None)], ENTRY)
    providers = spark.createDataFrame([("p", "u", None, None)], "name string, base_url string, proxy string, headers map<string,string>")
    got = {(r["name"], r["problem"]) for r in settings.problems(entries, providers).collect()}
    assert got == {("a", "unknown provider"), ("a", "kind"), ("a", "structured output mode"), ("a", "no base url"), ("b", "repeated name")}
    bad = spark.createDataFrame([({"name": "1", "colour": "2"},)], "m map<string,string>").select(settings.unknown_fields(F.col("m"), ["name"]).alias("u")).first()["u"]
    assert list(bad) == ["colour"]


def test_sinks_replace_only_their_modules(spark, tmp_path):
    one = spark.createDataFrame([("M01", "a"), ("M02", "b")], "module_id string, reason string")
    sinks.write_json(one, f"{tmp_path}/e")
    sinks.write_json(one.filter("module_id = 'M02'").withColumn("reason", F.lit("c")), f"{tmp_path}/e")
    assert {(r["module_id"], r["reason"]) for r in spark.read.json(f"{tmp_path}/e").collect()} == {("M01", "a"), ("M02", "c")}
    sinks.write_texts(one, "reason", f"{tmp_path}/t")
    assert {r["value"] for r in spark.read.text(f"{tmp_path}/t").collect()} == {"a", "b"}
    assert files.json_table(spark, f"{tmp_path}/missing", "a int").count() == 0


def test_synthetic_corpus_facts(spark):
    lexed = lexer.lexed(synthetic.corpus(spark, 7, 5)).cache()
    edges, ambiguous, unresolved = symbols.call_edges(lexed)
    assert (edges.count(), ambiguous.count(), unresolved.count()) == (3 * 5 + 4 * 4, 0, 0)
    rings = graph.module_cycles(edges.select("module_id", "src", "dst"), "module_id").collect()
    assert {(r["module_id"], len(r["members"])) for r in rings} == {("M01", 5), ("M04", 5), ("M07", 5)}
    assert symbols.functions(lexed).filter("kind = '对外接口'").count() == 35 and symbols.dependencies(lexed).count() == 0


def test_network_overridden(spark):
    rows = [({}, False), ({"verify_ssl": "true", "proxy": " "}, False), ({"verify_ssl": "False"}, True), ({"ca_bundle": "/x"}, True), ({"connect_timeout": "3"}, True), ({"proxy_from_env": "false"}, True), (None, False), ({"other": "x"}, False)]
    table = spark.createDataFrame(rows, "m map<string,string>, expected boolean")
    assert all(r["o"] == r["expected"] for r in table.select("expected", settings.network_overridden(F.col("m")).alias("o")).collect())
