"""Schemas and fixed values shared by all operators."""

from pyspark.sql import types as T

# The return-type kinds of a method, in order of preference.
TYPE_KINDS = [
    "type_identifier",
    "boolean_type",
    "floating_point_type",
    "generic_type",
    "scoped_type_identifier",
    "integral_type",
    "void_type",
]

# Cells the CSV form of the data treats as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Bodies that count as empty.
EMPTY_BODIES = ["{}", "{\n }"]

# Placeholder for the hidden name and for a missing prediction.
MASK_TOKEN = "<extra_id_0>"
NO_PREDICTION = "<no_prediction>"

# Sizes and seed of the standard dataset.
SEED = 42
HOLDOUT_ROWS = 10_000
VALIDATION_ROWS = 5_000
SAMPLE_ROWS = 4_000
MAX_LENGTH = 512
PREDICT_BATCH = 16
VOCAB_SIZE = 32_000

# Ids below FIRST_WORD_ID are reserved: padding, unknown word, hidden name.
PAD_ID, UNK_ID, MASK_ID, FIRST_WORD_ID = 0, 1, 2, 3
IGNORE_ID = -100

SOURCE_SUFFIX = ".java"

METHOD_COLUMNS = [
    "identifier", "formal_parameters", "modifiers", "block", *TYPE_KINDS, "file_path",
]

_STRING = T.StringType()

EXTRACTED = T.StructType(
    [
        T.StructField(name, T.ArrayType(_STRING) if name == "modifiers" else _STRING)
        for name in METHOD_COLUMNS
    ]
    + [T.StructField("method_no", T.IntegerType())]
)

METHODS = T.StructType([T.StructField("id", T.LongType()), *EXTRACTED.fields[:-1]])

METHODS_CSV = T.StructType([T.StructField(name, _STRING) for name in METHODS.names])

PAIRS = T.StructType(
    [
        T.StructField("example_id", T.LongType()),
        T.StructField("run_id", _STRING),
        T.StructField("label", _STRING),
        T.StructField("prediction", _STRING),
    ]
)

VECTORS = T.StructType(
    [T.StructField("word", _STRING), T.StructField("vec", T.ArrayType(T.FloatType()))]
)
