from palimpsest.operators import batches


def test_covering_steps_reach_every_batch(spark):
    sizes = {(0, 0): 2, (0, 1): 9, (1, 0): 4}
    groups = spark.createDataFrame([(h, t, n) for (h, t), n in sizes.items()], "head int, task int, n_batches long")
    plan = batches.round_robin(groups, 2, batches.covering_steps(groups, 2)).collect()
    assert {(r.head, r.task, r.batch_no) for r in plan} == {(h, t, b) for (h, t), n in sizes.items() for b in range(n)}
    assert sorted(r.step for r in plan) == list(range(36))
