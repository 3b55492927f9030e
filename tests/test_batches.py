from collections import Counter

import pytest
from pyspark.sql import functions as F

from doclens.operators import batches as B
from doclens.operators import lengths as L
from doclens.operators import runlog as G


def lengths(spark, *sizes):
    return spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n int")


def test_bucket_edges(spark):
    sizes = [0, 9, 10, 24, 25, 49, 50, 99, 100, 199, 200, 201]
    rows = lengths(spark, *sizes).select(
        "n",
        L.bucket_of(F.col("n")).alias("b"),
        L.bucket_or_missing(F.col("n")).alias("m"),
        L.batch_bucket_of(F.col("n")).alias("batch"),
    )
    found = {r["n"]: (r["b"], r["m"], r["batch"]) for r in rows.collect()}
    assert [found[n][0] for n in sizes] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, None, None]
    assert found[200] == (None, -1, 4)
    assert found[201] == (None, -1, None)


def test_length_filters_differ_at_the_limit(spark):
    rows = lengths(spark, 199, 200, 201)
    assert [r["n"] for r in L.filter_length(rows, 200, F.col("n")).collect()] == [199]
    assert [r["n"] for r in L.filter_encodable(rows, 200, F.col("n")).collect()] == [199, 200]


@pytest.fixture
def bucketed(spark):
    """300 rows in two buckets, one of which holds nine tenths."""
    ids = F.transform(
        F.sequence(F.lit(1), F.when(F.col("doc_id") % 10 == 0, 12).otherwise(F.col("doc_id") % 8 + 1)),
        lambda i: (i + 4).cast("int"),
    )
    return B.bucketed(spark.range(300).withColumnRenamed("id", "doc_id").withColumn("ids", ids))


def test_bucket_shares(spark, bucketed):
    rows = [tuple(r) for r in L.bucket_stats(bucketed).orderBy("bucket_id").collect()]
    assert rows == [(0, 270, 300, 0.9), (1, 30, 300, 1.0)]


def test_an_epoch_holds_every_row_once(spark, bucketed):
    rows = B.epoch_batches(bucketed, 32).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(300))
    fill = Counter((r["bucket_id"], r["batch"]) for r in rows)
    assert sorted(fill.values()) == [14, 30] + [32] * 8
    assert all(len({r["slot"] for r in rows if (r["bucket_id"], r["batch"]) == key}) == n for key, n in fill.items())
    again = B.epoch_batches(bucketed.repartition(3), 32).collect()
    assert {(r["doc_id"], r["batch"], r["slot"]) for r in again} == {(r["doc_id"], r["batch"], r["slot"]) for r in rows}


def test_sampled_batches_are_full_and_follow_the_shares(spark, bucketed):
    rows = B.sample_batches(bucketed, 200, 8, seed=1).collect()
    assert len(rows) == 1600
    per_step = {}
    for r in rows:
        per_step.setdefault(r["step"], set()).add(r["bucket_id"])
    assert all(len(b) == 1 for b in per_step.values())
    share = sum(b == {0} for b in per_step.values()) / 200
    assert 0.8 < share < 0.97


def test_shuffled_batches(spark, bucketed):
    rows = B.shuffled_batches(bucketed, 32, 2).collect()
    assert Counter(r["epoch"] for r in rows) == {0: 300, 1: 300}
    orders = [tuple(r["doc_id"] for r in rows if r["epoch"] == e and r["batch"] == 0) for e in (0, 1)]
    assert set(orders[0]) != set(orders[1])
    with pytest.raises(ValueError):
        B.shuffled_batches(bucketed, 32, 0)


def test_time_major_turns_batches_around(spark, bucketed):
    rows = B.training_rows(B.epoch_batches(bucketed, 16))
    columns = {(r["bucket_id"], r["batch"], r["pos"]): r["column"] for r in B.time_major(rows, "encoder").collect()}
    for r in rows.collect():
        for pos, id_ in enumerate(r["encoder"]):
            assert columns[r["bucket_id"], r["batch"], pos][r["slot"]] == id_


def test_pad_and_bucket_uses_the_longest_row(spark):
    rows = spark.createDataFrame([(0, [5] * 3), (0, [5] * 12), (1, [5] * 200), (2, [5] * 201)], "batch long, ids array<int>")
    found = Counter((r["batch"], len(r["encoder"])) for r in B.pad_and_bucket(rows).collect())
    assert found == {(0, 25): 2, (1, 200): 1}


def test_wrong_lengths_are_counted(spark, bucketed):
    rows = B.training_rows(bucketed)
    assert all(r["bad_encoder"] == r["bad_decoder"] == r["bad_weights"] == 0 for r in B.length_violations(rows).collect())
    broken = rows.withColumn("decoder", F.slice("decoder", 1, 2))
    assert all(r["bad_decoder"] == r["n"] for r in B.length_violations(broken).collect())


# --- run log ---


def log(spark, losses):
    return spark.createDataFrame([(i, float(x), 0.5) for i, x in enumerate(losses)], "step long, loss double, step_time double")


def test_checkpoints_are_full_groups_and_huge_losses_have_no_perplexity(spark):
    found = G.checkpoint_rollup(log(spark, [1.0, 3.0, 400.0, 400.0, 9.0]), per=2).orderBy("checkpoint").collect()
    assert [(r["checkpoint"], r["loss"]) for r in found] == [(0, 2.0), (1, 400.0)]
    assert found[0]["perplexity"] == pytest.approx(2.718281828**2)
    assert found[1]["perplexity"] == float("inf")


def test_the_rate_drops_above_the_last_three(spark):
    losses = [5, 4, 6, 7, 7, 8, 1, 9]
    points = spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "checkpoint long, loss double")
    found = G.plateau_drops(points, 1.0, 0.5).orderBy("checkpoint").collect()
    # The third has only two before it; the fifth equals the largest.
    assert [r["dropped"] for r in found] == [0, 0, 0, 1, 0, 1, 0, 1]
    assert [r["rate"] for r in found] == [1, 1, 1, 0.5, 0.5, 0.25, 0.25, 0.125]


def test_first_nan(spark):
    assert tuple(G.first_nan(log(spark, [1, float("nan"), 2, float("nan")])).first()) == (1, 2)
    assert tuple(G.first_nan(log(spark, [1])).first()) == (None, 0)


def test_logits(spark):
    rows = spark.range(4000).withColumn("v", F.array(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(-900.0)))
    assert rows.select(G.logit_argmax(F.col("v")).alias("i")).distinct().collect()[0]["i"] == 1
    drawn = Counter(r["i"] for r in rows.select(G.logit_sample(F.col("v"), 3, F.col("id")).alias("i")).collect())
    assert set(drawn) == {0, 1, 2}
    assert drawn[1] / 4000 == pytest.approx(0.4223, abs=0.03)
