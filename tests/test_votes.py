from fieldlens.operators import similarity


def test_votes_are_dealt_before_repeats_are_sought(spark):
    tries = spark.createDataFrame([(1, 1, [3, 3, 4]), (1, 2, [3]), (1, 2, [3, 5]), (2, 1, []), (2, 2, None), (3, 1, [9])], "row_key long, variant int, numbers array<long>")
    voted = similarity.votes(tries)
    assert sorted(map(tuple, voted.collect())) == [(1, 3, 2), (1, 4, 1), (1, 5, 1), (3, 9, 1)]
    # no aggregate stands below the first exchange, where a task would hold all rows of its split
    plan = voted._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan[plan.rindex("Exchange") if "Exchange" in plan else plan.rindex("RepartitionByExpression"):]
