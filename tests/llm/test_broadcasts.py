"""What grows with the documents is never broadcast, however small Spark takes it for."""

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import line_chunks, simhash
from ledgerline.llm.common import cut
from ledgerline.operators.skew import dealt_join


def joins(df):
    """Broadcast and sorted joins of the plan."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")


@pytest.mark.parametrize("fields", [simhash.TWO, simhash.THREE])
def test_replicas_of_a_small_file_of_nodes_are_not_broadcast(spark, fields):
    nodes = cut(spark.range(500).select(F.xxhash64("id").alias("fp")), "few-nodes")
    assert joins(simhash.links(nodes, fields=fields)) == (0, 1)


def test_star_rounds_broadcast_nothing(spark):
    edges = cut(spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long"), "few-edges")
    assert joins(simhash._star(edges, True)) == (0, 1)


def test_facts_of_documents_are_joined_by_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, k string")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"))
    broadcast, merged = joins(dealt_join(rows, facts, ["k"], "n", merge=True))
    assert (broadcast, merged) == (2, 1)  # the slots of hot keys, on both sides
    assert sorted(dealt_join(rows, facts, ["k"], "n", merge=True).collect(), key=lambda r: r["id"]) == [(1, "a", 2), (2, "a", 2), (3, None, 1)]


def test_first_occurrences_of_lines_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, "one line of words\nanother line of words\na third line") for i in range(3)], "doc_id long, text string")
    assert joins(line_chunks.repeats(docs, 0))[0] == 0
