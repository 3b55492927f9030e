"""Row types shared by the sources and operators."""

from pyspark.sql import types as T

VOCABULARY = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("id", T.IntegerType()),
    T.StructField("n", T.LongType()),
    T.StructField("kept", T.BooleanType()),
])

VECTORS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("split", T.StringType()),
    T.StructField("vec", T.ArrayType(T.DoubleType())),
])

# Reserved symbol ids.
SPECIAL_IDS = {"<GO>": 0, "<UNK>": 1, "<STOP>": 2, "<PUNCT>": 3, "<PAD>": 4}
GO, UNK, STOP, PUNCT, PAD = range(5)
FIRST_FREE_ID = 5

# Length buckets.
BUCKETS = (10, 25, 50, 100, 200)
