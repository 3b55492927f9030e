from pathlib import Path

import pytest
from pyspark.sql import functions as F

from doclens.functions.text import joined, word_terms
from doclens.operators.weights import fit_tfidf
from doclens.operators import dense as D
from doclens.operators import runlog as G
from doclens.operators import vocab as V
from doclens.schemas import VECTORS
from doclens.session import scratch_path, shared_dir
from doclens.sources import corpus as S
from doclens.sources import sgml, tables
from doclens.streaming import jobs

RECORDS = (
    b'<!DOCTYPE lewis SYSTEM "lewis.dtd">\n'
    b'<REUTERS TOPICS="YES" CGISPLIT="TRAINING-SET" NEWID="1">\n<DATE>&#5;26-FEB</DATE>'
    b"<TOPICS><D>cocoa</D><D>grain</D></TOPICS><PLACES><D>usa</D></PLACES>"
    b"<TEXT>&#2;\n<TITLE>T</TITLE><BODY>  Up 1,000.5 &amp; \xfc \xef\xbf\xbdok&#127;&#3;</BODY></TEXT>\n</REUTERS>\n"
    b'<REUTERS NEWID="2" TOPICS="NO" CGISPLIT="PUBLISHED-TESTSET">\n<TOPICS></TOPICS><TEXT TYPE="UNPROC">direct\ntext &lt;x&gt;'
    b"</TEXT>\n</REUTERS>\n"
    b'<REUTERS TOPICS="BYPASS" CGISPLIT="TRAINING-SET" NEWID="3"><TOPICS/><TEXT>\n<TITLE>only</TITLE>tail</TEXT></REUTERS>\n'
    b'<REUTERS TOPICS="YES" CGISPLIT="TRAINING-SET" NEWID="4"><TOPICS/><TEXT>lead<BODY></BODY></TEXT></REUTERS>\n'
    b'<REUTERS TOPICS="YES" NEWID="5"><TOPICS/><TEXT><TITLE>t</TITLE>tail</TEXT></REUTERS>\n'
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.sgm").write_bytes(RECORDS)
    (tmp_path / "b.txt").write_bytes(RECORDS)
    return str(tmp_path)


def test_records(spark, folder):
    rows = {r["doc_id"]: r for r in sgml.read_sgml(spark, folder).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert rows[1]["text"] == "  Up 1,000.5 &  �ok\x7f"
    assert rows[1]["topics"] == ["cocoa", "grain"]
    assert rows[2]["text"] == "direct\ntext <x>"
    assert [rows[i]["split"] for i in range(1, 6)] == ["train", "test", "train", "train", "test"]
    assert rows[4]["text"] == ""
    assert rows[5]["text"] == ""
    tokens = {r["doc_id"]: r["tokens"] for r in V.with_tokens(sgml.read_sgml(spark, folder)).collect()}
    assert tokens[3] == tokens[4] == []


def test_only_records_with_topics(spark, folder):
    assert {r["doc_id"] for r in sgml.read_sgml(spark, folder, everything=False).collect()} == {1, 4, 5}


def test_a_broken_record_fails_the_read(spark, tmp_path):
    (tmp_path / "a.sgm").write_bytes(b'\n<REUTERS NEWID="1"><TEXT></REUTERS>')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        sgml.read_sgml(spark, str(tmp_path)).collect()


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    record = '<REUTERS TOPICS="NO" NEWID="{}"><TOPICS/><TEXT><BODY>word {}</BODY></TEXT></REUTERS>\n'
    (tmp_path / "a.sgm").write_text("\n" + "".join(record.format(i, i) for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        docs = sgml.read_sgml(spark, str(tmp_path))
        assert docs.rdd.getNumPartitions() > 3
        assert sorted(r["doc_id"] for r in docs.collect()) == list(range(2000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_vocabulary_files(spark, tmp_path):
    rows = [(",", 5), ('"', 6), ("\n", 7), (" ", 8), ("é", 9), ('a"b', 10), ("\\", 11), ("null", 12)]
    vocab = spark.createDataFrame(rows, "symbol string, id int")
    tables.export_vocab_csv(vocab, str(tmp_path / "csv"))
    assert sorted(map(tuple, tables.import_vocab_csv(spark, str(tmp_path / "csv")).collect())) == sorted(rows)
    assert tables.vocab_path("x", "word", 1, 10) != tables.vocab_path("x", "word", 1, 20)


def test_vectors_are_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.sql("SELECT 1L AS doc_id, 'train' AS split, array(0.5D) AS vec")

    path = str(tmp_path / "vectors")
    for _ in range(2):
        assert tables.cached_vectors(spark, path, build).select("vec").first()["vec"] == [0.5]
    assert len(calls) == 1


def test_labels_file(spark, docs, tmp_path):
    tables.write_labels(docs, str(tmp_path / "labels"))
    rows = dict(map(tuple, spark.read.schema("i long, l string").csv(str(tmp_path / "labels")).collect()))
    assert rows[1] == "pets,en" and not rows[3] and len(rows) == 6


def test_shards_are_full_and_sorted_by_length(spark, tmp_path):
    rows = spark.range(25).select(
        F.col("id").alias("doc_id"),
        F.array_repeat(F.lit(7), (F.col("id") * 7 % 25).cast("int")).alias("ids"),
        F.when(F.col("id") < 3, "test").otherwise("train").alias("split"),
    )
    path = str(tmp_path / "shards")
    tables.write_training_shards(rows, path, 10)
    shards = {}
    for r in tables.read_training_shards(spark, path, True).collect():
        shards.setdefault(r["shard"], []).append(len(r["ids"]))
    assert {s: len(v) for s, v in shards.items()} == {0: 10, 1: 10, 2: 2}
    assert max(shards[0]) < min(shards[1]) and max(shards[1]) < min(shards[2])
    assert tables.read_training_shards(spark, path, False).count() == 3
    held = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(
        F.countDistinct("shard").alias("shards")
    )
    assert [r["shards"] for r in held.collect()] == [1] * 4


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_model_sees_whole_buckets(spark):
    rows = spark.createDataFrame(
        [(1, 0, [4] * 9 + [7]), (2, 1, [4] * 20 + [5] * 5), (3, 0, [6] * 10)], "doc_id long, bucket_id int, encoder array<int>"
    )

    def load():
        return lambda ids: ids.sum(axis=1, keepdims=True).astype("float64")

    found = {r["doc_id"]: r["vec"] for r in D.score_model(rows, load).collect()}
    assert found == {1: [43.0], 2: [105.0], 3: [60.0]}


def test_word_vectors(spark, docs):
    tokens = V.with_tokens(docs)
    vocab = V.build_vocab(V.symbol_counts(tokens), most_common=10)
    capped = D.capped_tokens(tokens, vocab)
    model = D.fit_embedding(capped, 8, min_count=1, partitions=1)
    vecs = {r["doc_id"]: r["vec"] for r in D.embed_documents(capped, model).collect()}
    assert all(len(v) == 8 for v in vecs.values())
    assert vecs[3] == [0.0] * 8


def test_text_and_labels_tokenises_after_the_filter(spark, docs):
    plan = S.text_and_labels(docs, split="train")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Project") < plan.index("Filter")


# --- streams ---


@pytest.fixture
def stream_folder(spark, docs, tmp_path):
    path = str(tmp_path / "docs")
    docs.repartition(3).write.parquet(path)
    return path


def _terms_and_seeds(docs):
    terms = V.with_tokens(docs).withColumn("terms", word_terms(joined(F.col("tokens"))))
    model = fit_tfidf(terms, min_df=1, max_df=1.0)
    return model, model.dense_rows(terms.filter("doc_id in (1, 2, 5)"))


def test_scores_use_every_term(spark, docs):
    model, centers = _terms_and_seeds(docs)
    assert len(centers[0]) == len(model.rows) > 15
    found = {r["doc_id"]: r["cluster"] for r in jobs.score_documents(docs, model, centers).collect()}
    assert (found[1], found[2], found[5]) == (0, 1, 2)
    # rare words alone decide
    odd = docs.limit(1).select(F.lit(99).cast("long").alias("doc_id"), F.lit("tonnes fell").alias("text"))
    assert jobs.score_documents(odd, model, centers).first()["cluster"] == 1


def test_stream_counts_equal_batch_counts(spark, docs, stream_folder, tmp_path):
    stream = jobs.read_document_stream(spark, stream_folder, docs.schema, files_per_batch=1)
    out = str(tmp_path / "out")
    jobs.stream_symbol_counts(stream, out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = V.symbol_counts(V.with_tokens(docs))
    assert dict(map(tuple, jobs.latest_counts(spark, out).collect())) == dict(map(tuple, batch.collect()))


def _run_bytes(out):
    return {p.parent.relative_to(out).as_posix(): p.stat().st_size for p in out.glob("level=*/run=*/*.parquet")}


def test_counts_are_levels_of_runs(spark, tmp_path):
    """Thirteen batches, of which all but the first change one symbol: a batch writes what it changed, runs
    are merged by level, and a batch that is run again, or a merge that left its sources, changes nothing."""
    folder, out, cp = (tmp_path / n for n in ("in", "out", "cp"))
    folder.mkdir()
    words = " ".join("x" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(2000))
    schema = "doc_id long, text string"
    for i in range(13):
        path = str(tmp_path / f"batch{i}")
        spark.createDataFrame([(i, words if i == 0 else "again")], schema).coalesce(1).write.parquet(path)
        (file,) = Path(path).glob("*.parquet")
        file.rename(folder / f"{i:02}.parquet")
        stream = jobs.read_document_stream(spark, str(folder), schema, files_per_batch=1)
        jobs.stream_symbol_counts(stream, str(out), str(cp), fan=3).trigger(availableNow=True).start().awaitTermination()
        counts = dict(map(tuple, jobs.latest_counts(spark, str(out)).collect()))
        assert counts.get("again", 0) == i and counts["xbc"] == 1
        sizes = _run_bytes(out)
        if i:
            assert sizes[f"level=0/run={i}"] < 5_000
    levels = jobs._runs(spark, str(out))
    assert max(levels) >= 2 and all(len(runs) <= 4 for runs in levels.values())
    stale = spark.createDataFrame([("again", 1)], "symbol string, n bigint")
    stale.write.mode("overwrite").parquet(f"{out}/level=0/run=1")
    spark.createDataFrame([("never", 9)], "symbol string, n bigint").write.parquet(f"{out}/level=0/run=99")
    (out / "level=0/run=99/_SUCCESS").unlink()
    counts = dict(map(tuple, jobs.latest_counts(spark, str(out)).collect()))
    assert counts["again"] == 12 and "never" not in counts and len(counts) == 2001


def test_latest_counts_of_nothing(spark, tmp_path):
    assert jobs.latest_counts(spark, str(tmp_path / "none")).count() == 0


def test_stream_encodes_beyond_the_limit(spark, docs, stream_folder, tmp_path):
    vocab = V.build_vocab(V.symbol_counts(V.with_tokens(docs)), most_common=20)
    stream = jobs.read_document_stream(spark, stream_folder, docs.schema)
    out = str(tmp_path / "out")
    encoded = V.encode(V.with_tokens(stream), vocab, max_symbols=6).select("doc_id", "ids")
    writer = encoded.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    wanted = V.encode(V.with_tokens(docs), vocab).select("doc_id", "ids")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, wanted.collect()))


def test_stream_scores_equal_batch_scores(spark, docs, stream_folder, tmp_path):
    model, centers = _terms_and_seeds(docs)
    stream = jobs.read_document_stream(spark, stream_folder, docs.schema, files_per_batch=1)
    out = str(tmp_path / "out")
    for _ in range(2):  # a restart adds nothing
        query = jobs.stream_score(stream, model, centers, out, str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination()
    found = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert found == sorted(map(tuple, jobs.score_documents(docs, model, centers).collect()))
    assert len(found) == 6


def test_unreadable_records_are_rows(spark, tmp_path):
    good = '<REUTERS TOPICS="YES" CGISPLIT="TRAINING-SET" NEWID="1"><TEXT>led</TEXT></REUTERS>'
    (tmp_path / "a.sgm").write_text(good + "\n<REUTERS NEWID=\"2\"><TEXT><BODY>x</TEXT></REUTERS>\n")
    rows = sgml.read_sgml(spark, str(tmp_path), mode="PERMISSIVE").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows) == [(0, ""), (1, "led")]
    with pytest.raises(Exception):  # noqa: B017
        sgml.read_sgml(spark, str(tmp_path)).collect()


def test_vectors_are_built_again_after_a_failed_write(spark, tmp_path):
    path = tmp_path / "vectors"
    path.mkdir()
    made = spark.createDataFrame([(1, "train", [1.0])], VECTORS)
    assert tables.cached_vectors(spark, str(path), lambda: made).count() == 1
    assert tables.cached_vectors(spark, str(path), lambda: made.limit(0)).count() == 1


def test_drops_look_back_over_recorded_checkpoints(spark):
    rows = [(0, 1.0), (1, 1.0), (2, 1.0), (4, 9.0), (7, 1.0)]
    found = G.plateau_drops(spark.createDataFrame(rows, "checkpoint long, loss double")).orderBy("checkpoint").collect()
    assert [r["dropped"] for r in found] == [0, 0, 0, 1, 0]
    assert found[-1]["rate"] == pytest.approx(0.009)
