"""Text to dense vectors."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import PurePath

import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.functions import scalars


def hashed_vectors(df: DataFrame, column: str, dims: int = 256, name: str = "embedding") -> DataFrame:
    """Unit-length hashed term counts of the whole text; needs no model file."""
    counted = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dims).transform(
        df.withColumn("__words", scalars.words(column)))
    scaled = Normalizer(inputCol="__tf", outputCol="__unit").transform(counted)
    return scaled.withColumn(name, vector_to_array("__unit", "float32")).drop("__words", "__tf", "__unit")


def model_vectors(df: DataFrame, column: str, make_predict: Callable, batch_size: int = 64,
                  name: str = "embedding") -> DataFrame:
    """Vectors from a user's own encoder.

    ``make_predict`` runs once per Python worker and returns a function from an array of texts to
    a 2-d array; Spark feeds it batches of ``batch_size``.
    """
    encode = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(name, encode(F.col(column)))


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


TEXTS = 64  # texts encoded at a time


def subword_ids(df: DataFrame, column: str, path: str, max_length: int | None = None, pad: int = 0, name: str | None = None) -> DataFrame:
    """Ids of a subword tokenizer's file, as ``<column>_encode_<file>`` unless named.

    With ``max_length`` cut and padded on the right with ``pad`` to that length.  The whole text is encoded and no
    special tokens are added; a null text is empty.  ``path`` must be readable on every executor.
    """
    name = name or f"{column}_encode_{PurePath(path).stem}"
    kept = [c for c in df.columns if c != name]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(name, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path).encode_batch_fast
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                ids = [x.ids for x in encode([t or "" for t in part.column("__text").to_pylist()], add_special_tokens=False)]
                if max_length is not None:
                    ids = [(x + [pad] * (max_length - len(x)))[:max_length] for x in ids]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(ids, pa.list_(pa.int64()))], [*kept, name])

    return df.select(*kept, F.col(column).alias("__text")).mapInArrow(run, schema)
