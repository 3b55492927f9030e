"""Skip-gram word vectors by hierarchical softmax, trained by generated code with a state of its own per task.

The library's Word2Vec reads its vectors from a broadcast, which all tasks of an executor share and write to:
they slow each other down and the partial models are not apart. It also asks the broadcast vocabulary, under a
lock, for every node of every pair. Here the same steps run over arrays that belong to the task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.session import written

# The library's defaults.
RATE, WINDOW, SENTENCE = 0.025, 5, 1000

_SCHEMA = "id int, moved boolean, vector array<float>"
# Ids below ``words`` are words, the others inner nodes of the Huffman tree. Counts are falling. The logistic
# function is a table of 1,000 steps from -6 to 6, read 83 to the unit, and the seeds are the library's.
_CODE = """
public Object generate(Object[] references) { return new SkipGram(references); }

final class SkipGram extends org.apache.spark.sql.execution.BufferedRowIterator {
  private static final int SIZE = %(size)d;
  private final dev.ludovic.netlib.blas.BLAS blas = org.apache.spark.ml.linalg.BLAS$.MODULE$.javaBLAS();
  private final Object[] references;
  private final float[] logistic = new float[1000], change = new float[SIZE];
  private scala.collection.Iterator input;
  private java.util.Random random;
  private int words, next;
  private float[] in, out;
  private boolean[] moved;
  private int[] starts, nodes;
  private byte[] codes;
  private double rate = %(rate)r;

  public SkipGram(Object[] references) { this.references = references; }

  public void init(int index, scala.collection.Iterator[] inputs) {
    partitionIndex = index;
    input = inputs[0];
  }

  protected void processNext() throws java.io.IOException {
    if (in == null) {
      prepare();
      train();
    }
    while (next < 2 * words && !shouldStop()) {
      int id = next++;
      if (moved[id] || partitionIndex == 0) {
        int at = (id < words ? id : id - words) * SIZE;
        float[] vector = java.util.Arrays.copyOfRange(id < words ? in : out, at, at + SIZE);
        append(new org.apache.spark.sql.catalyst.expressions.GenericInternalRow(new Object[] {
          Integer.valueOf(id), Boolean.valueOf(moved[id]), UnsafeArrayData.fromPrimitiveArray(vector)}));
      }
    }
  }

  private void prepare() {
    java.nio.LongBuffer counts = java.nio.ByteBuffer.wrap((byte[]) references[0]).asLongBuffer();
    words = counts.remaining();
    tree(counts);
    in = new float[words * SIZE];
    out = new float[words * SIZE];
    moved = new boolean[2 * words];
    for (int i = 0; i < logistic.length; i++) {
      double e = Math.exp((2.0 * i / logistic.length - 1.0) * 6);
      logistic[i] = (float) (e / (e + 1.0));
    }
    InternalRow[] state = (InternalRow[]) references[1];
    if (state == null) {
      java.util.Random first = new org.apache.spark.util.random.XORShiftRandom(%(seed)dL);
      for (int i = 0; i < in.length; i++) in[i] = (first.nextFloat() - 0.5f) / SIZE;
    } else {
      for (int r = 0; r < state.length; r++) {
        int id = state[r].getInt(0);
        int at = (id < words ? id : id - words) * SIZE;
        System.arraycopy(state[r].getArray(1).toFloatArray(), 0, id < words ? in : out, at, SIZE);
      }
    }
    random = new org.apache.spark.util.random.XORShiftRandom(
      %(seed)dL ^ ((partitionIndex + 1) << 16) ^ ((-%(iteration)d - 1) << 8));
  }

  private void tree(java.nio.LongBuffer counts) {
    long[] count = new long[2 * words + 1];
    int[] parent = new int[2 * words];
    byte[] side = new byte[2 * words];
    java.util.Arrays.fill(count, Long.MAX_VALUE);
    for (int w = 0; w < words; w++) count[w] = counts.get(w);
    int leaf = words - 1, node = words, root = 2 * words - 2;
    for (int made = words; made <= root; made++) {
      int one = leaf >= 0 && count[leaf] < count[node] ? leaf-- : node++;
      int two = leaf >= 0 && count[leaf] < count[node] ? leaf-- : node++;
      count[made] = count[one] + count[two];
      parent[one] = made;
      parent[two] = made;
      side[two] = 1;
    }
    starts = new int[words + 1];
    for (int w = 0; w < words; w++) {
      int depth = 0;
      for (int n = w; n != root; n = parent[n]) depth++;
      starts[w + 1] = starts[w] + depth;
    }
    nodes = new int[starts[words]];
    codes = new byte[starts[words]];
    for (int w = 0; w < words; w++) {
      int d = starts[w + 1];
      for (int n = w; n != root; n = parent[n]) {
        codes[--d] = side[n];
        nodes[d] = (parent[n] - words) * SIZE;
      }
    }
  }

  private void train() {
    long seen = 0, last = 0;
    int[] row = new int[0];
    while (input.hasNext()) {
      ArrayData ids = ((InternalRow) input.next()).getArray(0);
      int n = ids.numElements(), kept = 0;
      if (row.length < n) row = new int[n];
      for (int i = 0; i < n; i++) {
        int id = ids.getInt(i) - %(first)d;
        if (id >= 0) row[kept++] = id;
      }
      for (int from = 0; from < kept; from += %(sentence)d) {
        int to = Math.min(kept, from + %(sentence)d);
        if (seen - last > 10000) {
          last = seen;
          rate = Math.max(%(rate)r * (1 - (%(partitions)d * (double) seen + %(before)dL) / %(total)dL), %(rate)r * 0.0001);
        }
        seen += to - from;
        sentence(row, from, to);
      }
    }
  }

  private void sentence(int[] row, int from, int to) {
    for (int at = from; at < to; at++) {
      int reach = %(window)d - random.nextInt(%(window)d);
      int end = Math.min(to - 1, at + reach);
      for (int near = Math.max(from, at - reach); near <= end; near++) {
        if (near != at) pair(row[at], row[near]);
      }
    }
  }

  private void pair(int word, int other) {
    int x = other * SIZE, end = starts[word + 1];
    java.util.Arrays.fill(change, 0f);
    for (int d = starts[word]; d < end; d++) {
      int y = nodes[d];
      float f = blas.sdot(SIZE, in, x, 1, out, y, 1);
      if (f > -6 && f < 6) {
        float g = (float) ((1 - codes[d] - logistic[(int) ((f + 6) * 83.0)]) * rate);
        blas.saxpy(SIZE, g, out, y, 1, change, 0, 1);
        blas.saxpy(SIZE, g, in, x, 1, out, y, 1);
        moved[words + y / SIZE] = true;
      }
    }
    blas.saxpy(SIZE, 1f, change, 0, 1, in, x, 1);
    moved[other] = true;
  }
}
"""


def fit_vectors(
    rows: DataFrame, counts: list[int], size: int, seed: int, partitions: int, iterations: int, first: int = 0
) -> DataFrame:
    """(id, vector): the vectors of the words 0, 1, ... of falling ``counts``.

    ``rows`` has one column of id arrays, in which word 0 is ``first`` and ids below are left out. Its partitions, ``partitions`` of them, are
    trained side by side and each vector is averaged over those that moved it. Every run gives the same
    vectors. A task holds its own two tables of words x size numbers.
    """
    if len(counts) * size >= 2**31 - 1:
        raise ValueError(f"{len(counts)} words of {size} numbers do not fit an array; raise min_count")
    known, tokens, state = np.array(counts, ">i8").tobytes(), sum(counts), None
    for iteration in range(1, iterations + 1):
        code = _CODE % {
            "size": size,
            "rate": RATE,
            "window": WINDOW,
            "sentence": SENTENCE,
            "first": first,
            "seed": seed,
            "iteration": iteration,
            "partitions": partitions,
            "before": (iteration - 1) * tokens,
            "total": iterations * tokens + 1,
        }
        trained = _generated(rows, code, [known, state], _SCHEMA)
        values = [F.get("vector", i) for i in range(size)]
        means = [F.coalesce(F.avg(F.when(F.col("moved"), v)), F.max(v)).cast("float") for v in values]
        named = [mean.alias(f"_v{i}") for i, mean in enumerate(means)]
        vector = F.array(*[F.col(f"_v{i}") for i in range(size)])
        found = written(trained.groupBy("id").agg(*named).select("id", vector.alias("vector")), "vectors")
        if iteration < iterations:
            state = found._jdf.queryExecution().executedPlan().executeCollect()
    return found.filter(F.col("id") < len(counts))


def _generated(rows: DataFrame, code: str, references: list, schema: str) -> DataFrame:
    """The rows that a ``BufferedRowIterator``, given as Java code, makes of each partition. Executors compile
    it as they compile the code of a query."""
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    jvm = sc._jvm

    def single(package, name):
        return getattr(getattr(package, f"{name}$"), "MODULE$")

    held = sc._gateway.new_array(jvm.java.lang.Object, len(references))
    for i, reference in enumerate(references):
        held[i] = reference
    sql = jvm.org.apache.spark.sql
    comments = single(jvm.scala.collection.immutable, "Map").empty()
    source = sql.catalyst.expressions.codegen.CodeAndComment(code, comments)
    timing = single(sql.execution.metric, "SQLMetrics").createTimingMetric(sc._jsc.sc(), "duration", -1)
    factory = sql.execution.WholeStageCodegenEvaluatorFactory(jvm.scala.util.Right(source), timing, held)
    row = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.InternalRow")
    tag = single(jvm.scala.reflect, "ClassTag").apply(row)
    made = rows._jdf.queryExecution().toRdd().mapPartitionsWithEvaluator(factory, tag)
    columns = sql.types.StructType.fromDDL(schema)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(made, columns, False), spark)
