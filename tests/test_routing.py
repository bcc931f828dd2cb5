"""What routing sends to the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import routing


def test_queries_are_not_broadcast(spark):
    """Queries that a small table is exploded to, and what is found of them, stay off the driver, whatever sizes are estimated."""
    queries = spark.range(50).select("id", F.explode(F.array(F.lit("blue ring"), F.concat(F.lit("P."), "id"), F.lit("rings"), F.lit("the blue ring of old"))).alias("query")).select((F.col("id") * 10).alias("query_id"), "query")
    gazetteer = spark.createDataFrame([("blue ring", "Blue ring", "name", 3), ("ring", "Ring", "topic", 2)], "key string, term string, field string, record_count long")
    vocab = spark.createDataFrame([("blue", 3), ("ring", 5)], "term string, records long")
    tokens = spark.createDataFrame([("a", "names", 0, "blue")], "record_id string, field string, p int, term string")
    shapes = spark.createDataFrame([("A.9",)], "shape string")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1e6
    found = routing.gazetteer_matches(queries.withColumnRenamed("query", "text"), gazetteer, vocab, tokens)
    routed = routing.routed(queries, tokens, vocab, gazetteer, shapes, ["title", "identifiers"], correct=False)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    # the shapes of identifiers, a small table as it is, may be sent
    assert routed._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") <= 2
    assert found.count() == 150 and routed.count() == 200
    assert {(r.query, r.kind, r.term) for r in routed.where("query_id = 10").collect()} == {("blue ring", "name", "Blue ring"), ("P.1", "identifier", None), ("rings", "topic", "Ring"), ("the blue ring of old", "name", "Blue ring")}
