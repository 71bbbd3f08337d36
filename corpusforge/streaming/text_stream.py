"""Streaming use of the stateless text operators.

Normalisation, tokenisation, the length/ratio filter, label filtering and
post-processing are plain column expressions, so the same functions run on a
streaming DataFrame. These helpers wire a file source to a file sink with a
checkpoint location (exactly-once file sink, restartable after failure).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rules import normalise_tokenise
from ..operators.filters import clean_condition


def tokenise_stream(lines: DataFrame, text_col: str = "text", lang_col: str = "lang",
                    out_col: str = "tok") -> DataFrame:
    """Streaming (or batch) tokenisation: one projection."""
    return lines.withColumn(out_col, normalise_tokenise(text_col, lang_col))


def clean_stream(pairs: DataFrame, src: str = "src", tgt: str = "tgt", min_len: int = 1, max_len: int = 100,
                 ratio: float = 1.8) -> DataFrame:
    """Streaming (or batch) length / ratio filter."""
    return pairs.where(clean_condition(src, tgt, min_len, max_len, ratio))


def run_tokenise(spark: SparkSession, source_dir: str, source_glob: str, sink_dir: str, checkpoint_location: str,
                 text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> StreamingQuery:
    """Tokenise every new Parquet file of ``source_dir`` (matching
    ``source_glob``) into ``sink_dir``; processes what is available, then
    stops (``availableNow``)."""
    schema = spark.read.option("pathGlobFilter", source_glob).parquet(source_dir).schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", source_glob)
              .option("maxFilesPerTrigger", 1).parquet(source_dir))
    cols = list(keep or [c for c in schema.fieldNames() if c != text_col])
    out = tokenise_stream(stream, text_col, lang_col).select(*cols, F.col("tok"))
    return (out.writeStream.format("parquet").option("checkpointLocation", checkpoint_location)
            .trigger(availableNow=True).start(sink_dir))
