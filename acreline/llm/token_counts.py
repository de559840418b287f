"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.llm.encoding import encoder, read_tokenizer


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: (id, n_bytes, n_tokens, over_limit).

    Texts are encoded in portions of about equal bytes; longer ones are cut at white space,
    which this kind of tokenizer never crosses (see `encoding`). No special token is added;
    special strings inside a text count as the tokenizer's own default has it. A NULL or
    empty text has 0 bytes and 0 tokens. NULL ids and repeated rows stay as they are: one
    row out for each row in. Other columns are not read. There is no shuffle.
    """
    tokenizer = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    id_type = docs.schema[id_col].dataType

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer.value)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            n_bytes = [len(t or b"") for t in texts]
            n_tokens = [sum(map(len, ids)) // 4 for ids in encode.texts(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    counted = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
               .mapInArrow(lengths, f"id {id_type.simpleString()}, n_bytes long, n_tokens long"))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
