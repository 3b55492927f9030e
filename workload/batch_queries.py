"""Bucket and batch queries."""

from pyspark.sql import functions as F

from doclens.operators import batches as B
from doclens.operators import lengths as L
from doclens.operators import vocab as V
from doclens.session import written
from workload import common as C
from workload.common import Registry
from workload.text_queries import BUCKETED

R = Registry()
_BASE = f"WITH {C.corpus_sql()}, {BUCKETED}"


def bucketed(spark, sf):
    return B.bucketed(C.encoded_short(spark, sf))


def bucketed_lengths(spark, sf):
    """Buckets need lengths only, so the vocabulary is not built."""
    sizes = C.tokenised(spark, sf).select("doc_id", F.size("tokens").alias("n_tokens"))
    return L.assign_buckets(sizes, F.col("n_tokens"))


@R.add("bucket_assign", f"{_BASE} SELECT doc_id, n::INTEGER AS n_tokens, bucket_id, size AS bucket_len FROM bucketed")
def bucket_assign(spark, sf):
    return bucketed_lengths(spark, sf)


_BATCH_BUCKET = (
    "batched AS (SELECT doc_id // 16 AS batch, max(len(tokens))::INTEGER AS longest FROM tokens GROUP BY 1), "
    "sized AS (SELECT *, CASE WHEN longest < 10 THEN 0 WHEN longest < 25 THEN 1 WHEN longest < 50 THEN 2 "
    "WHEN longest < 100 THEN 3 WHEN longest <= 200 THEN 4 END AS bucket_id FROM batched)"
)


@R.add(
    "batch_bucket",
    f"WITH {C.TOKENS}, {_BATCH_BUCKET} SELECT batch, longest, bucket_id, "
    "[10, 25, 50, 100, 200][bucket_id + 1] AS bucket_len FROM sized",
)
def batch_bucket(spark, sf):
    batched = C.tokenised(spark, sf).withColumn("batch", F.floor(F.col("doc_id") / 16))
    return L.batch_buckets(batched, F.size("tokens"))


@R.add(
    "pad_and_bucket",
    f"WITH {C.corpus_sql()}, short AS (SELECT doc_id, doc_id // 4 AS batch, ids FROM ids WHERE len(ids) <= 200), "
    "longest AS (SELECT batch, max(len(ids)) AS n FROM short GROUP BY batch), "
    "sized AS (SELECT batch, CASE WHEN n < 10 THEN 10 WHEN n < 25 THEN 25 WHEN n < 50 THEN 50 "
    "WHEN n < 100 THEN 100 ELSE 200 END AS size FROM longest) "
    "SELECT doc_id, batch, array_to_string(list_concat(list_resize([]::INTEGER[], size - len(ids), 4), ids), ' ') AS encoder "
    "FROM short JOIN sized USING (batch)",
)
def pad_and_bucket(spark, sf):
    tokens = C.tokenised_once(spark, sf)
    docs = V.encode(L.filter_encodable(tokens), C.vocabulary(tokens)).select("doc_id", "ids")
    padded = B.pad_and_bucket(written(docs, "encoded").withColumn("batch", F.floor(F.col("doc_id") / 4)))
    return padded.select("doc_id", "batch", F.array_join("encoder", " ").alias("encoder"))


_STATS = (
    "stats AS (SELECT bucket_id, count(*) AS n FROM bucketed GROUP BY bucket_id), "
    "shares AS (SELECT bucket_id, n, sum(n) OVER ()::BIGINT AS total, sum(n) OVER (ORDER BY bucket_id)::DOUBLE "
    "/ sum(n) OVER () AS share FROM stats)"
)


@R.add("bucket_stats", f"{_BASE}, {_STATS} SELECT bucket_id, n, total, round(share, 6) AS share FROM shares")
def bucket_stats(spark, sf):
    return L.bucket_stats(bucketed_lengths(spark, sf)).withColumn("share", F.round("share", 6))


_STEPS = (
    f"steps AS (SELECT step, {C.unit_sql(3, 'step')} AS u FROM range(500) AS r(step)), "
    "drawn AS (SELECT step, min(bucket_id) AS bucket_id FROM steps JOIN shares ON share > u GROUP BY step)"
)


@R.add("sample_buckets", f"{_BASE}, {_STATS}, {_STEPS} SELECT step, bucket_id FROM drawn")
def sample_buckets(spark, sf):
    return B.sample_buckets(L.bucket_stats(bucketed_lengths(spark, sf)), 500, 3)


_SAMPLE = (
    f"draws AS (SELECT step, slot, bucket_id, floor({C.unit_sql(4, 'step', 'slot')} * n)::BIGINT + 1 AS rn "
    "FROM drawn JOIN stats USING (bucket_id), range(32) AS s(slot)), "
    f"numbered AS (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY {C.hex_sql(3, 'doc_id')}, doc_id) AS rn FROM bucketed), "
    "sampled AS (SELECT d.step, d.slot::INTEGER AS slot, d.bucket_id, b.doc_id, b.ids, b.size, b.n FROM draws d "
    "JOIN numbered b ON d.bucket_id = b.bucket_id AND d.rn = b.rn)"
)


@R.add("sample_batch", f"{_BASE}, {_STATS}, {_STEPS}, {_SAMPLE} SELECT step, slot, bucket_id, doc_id FROM sampled")
def sample_batch(spark, sf):
    # Read for the shares, the numbers and the drawn rows: texts are tokenised once.
    sampled = B.sample_batches(written(bucketed_lengths(spark, sf), "lengths"), 500, 32, 3)
    return sampled.select("step", "slot", "bucket_id", "doc_id")


_ROW = (
    "array_to_string(list_concat(list_resize([]::INTEGER[], size - n, 4), ids), ' ') AS encoder, "
    "array_to_string(list_concat(list_concat([0], ids), list_resize([]::INTEGER[], size - n - 1, 4)), ' ') AS decoder, "
    "array_to_string(list_transform(range(1, size + 1), lambda i: CASE WHEN i <= n THEN 1 ELSE 0 END), ' ') AS weights"
)


def _texts(rows):
    return [
        F.array_join("encoder", " ").alias("encoder"),
        F.array_join("decoder", " ").alias("decoder"),
        F.array_join(F.transform("weights", lambda w: w.cast("int")), " ").alias("weights"),
    ]


@R.add(
    "training_batches",
    f"{_BASE}, {_STATS}, {_STEPS}, {_SAMPLE} SELECT step, slot, bucket_id, {_ROW} FROM sampled",
)
def training_batches(spark, sf):
    rows = B.training_rows(B.sample_batches(bucketed(spark, sf), 500, 32, 3))
    return rows.select("step", "slot", "bucket_id", *_texts(rows))


_EPOCH = (
    f"epoch AS (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY {C.hex_sql(5, 'doc_id')}, doc_id) - 1 AS rn FROM bucketed)"
)


@R.add(
    "epoch_batches",
    f"{_BASE}, {_EPOCH} SELECT bucket_id, rn // 32 AS batch, (rn % 32)::INTEGER AS slot, doc_id, {_ROW} FROM epoch",
)
def epoch_batches(spark, sf):
    rows = B.training_rows(B.epoch_batches(bucketed(spark, sf), 32, 5))
    return rows.select("bucket_id", "batch", "slot", "doc_id", *_texts(rows))


@R.add(
    "inference_batches",
    f"{_BASE} SELECT doc_id, bucket_id, array_to_string(list_concat(list_resize([]::INTEGER[], size - n, 4), ids), ' ') AS encoder, "
    "array_to_string(list_resize([]::INTEGER[], size, 0), ' ') AS decoder, "
    "array_to_string(list_transform(range(1, size + 1), lambda i: CASE WHEN i <= n THEN 1 ELSE 0 END), ' ') AS weights FROM bucketed",
)
def inference_batches(spark, sf):
    rows = B.inference_rows(bucketed(spark, sf))
    return rows.select("doc_id", "bucket_id", *_texts(rows))


@R.add(
    "time_major",
    f"{_BASE}, {_EPOCH}, padded AS (SELECT bucket_id, rn // 32 AS batch, rn % 32 AS slot, "
    "list_concat(list_resize([]::INTEGER[], size - n, 4), ids) AS encoder FROM epoch), "
    "flatrows AS (SELECT bucket_id, batch, slot, unnest(encoder) AS id, generate_subscripts(encoder, 1) - 1 AS pos FROM padded) "
    "SELECT bucket_id, batch, pos::INTEGER AS pos, array_to_string(list(id ORDER BY slot), ' ') AS ids "
    "FROM flatrows GROUP BY bucket_id, batch, pos",
)
def time_major(spark, sf):
    rows = B.training_rows(B.epoch_batches(bucketed(spark, sf), 32, 5))
    turned = B.time_major(rows.select("bucket_id", "batch", "slot", "bucket_len", "encoder"), "encoder")
    return turned.select("bucket_id", "batch", "pos", F.array_join("column", " ").alias("ids"))


@R.add(
    "length_checks",
    f"{_BASE} SELECT bucket_id, count(*) AS n, 0::BIGINT AS bad_encoder, 0::BIGINT AS bad_decoder, 0::BIGINT AS bad_weights "
    "FROM bucketed GROUP BY bucket_id",
)
def length_checks(spark, sf):
    return B.length_violations(B.training_rows(bucketed(spark, sf)))


@R.add(
    "shuffled_batches",
    f"SELECT epoch, doc_id, (row_number() OVER (PARTITION BY epoch ORDER BY {C.hex_sql(9, 'epoch', 'doc_id')}, doc_id) - 1) // 32 AS batch "
    "FROM (SELECT doc_id, unnest([0, 1, 2]) AS epoch FROM documents)",
)
def shuffled_batches(spark, sf):
    return B.shuffled_batches(C.documents(spark, sf, "doc_id"), 32, 3, 9).select("epoch", "doc_id", "batch")
