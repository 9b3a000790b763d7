"""Incremental extraction over arriving pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import canonical_url
from ..operators.page_text import extract_page_text
from ..options import ExtractOptions
from ..plans.extract import paragraph_filter
from ..schemas import PAGES
from ..session import remove_folder
from ..sources.pages import admit
from ..sources.sinks import unique_texts


def _seen(spark: SparkSession, path: str, key: str, batch_id: int, fresh: DataFrame) -> DataFrame:
    """Keys of earlier batches that also occur in `fresh`.

    The long history is only scanned, one narrow column of it; what is
    shuffled or broadcast is this batch's keys.
    """
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return fresh.select(key).limit(0)
    history = spark.read.schema(f"{key} string, batch_id long").parquet(path)
    earlier = history.filter(F.col("batch_id") != batch_id).select(key)
    return earlier.join(fresh.select(key), key, "left_semi").distinct()


def process_batch(batch: DataFrame, batch_id: int, out: str, options: ExtractOptions, keep_paragraphs) -> None:
    """Extract one batch: each canonical URL once ever, each text once ever.

    Every output sits in its own `batch_id` folder and a batch ignores its
    own folder as history, so running a batch again writes the same rows.
    The URL list goes last: a batch counts as seen only after its texts are
    there.
    """
    spark = batch.sparkSession
    if "content_type" in batch.columns:
        batch = admit(batch)
    # copies of one URL shrink inside each task: only the id is compared
    first = batch.groupBy(canonical_url(F.col("url")).alias("url")).agg(F.min("page_id").alias("page_id"))
    fresh = first.join(_seen(spark, f"{out}/urls", "url", batch_id, first), "url", "left_anti")
    pages = batch.join(fresh.select("page_id"), "page_id", "left_semi")
    texts = unique_texts(extract_page_text(pages, options, keep_paragraphs))
    folder = f"batch_id={batch_id}"
    staged = f"{out}/_staged/{folder}"
    try:
        texts.write.mode("overwrite").parquet(staged)
        texts = spark.read.parquet(staged)
        old = _seen(spark, f"{out}/texts", "content_hash", batch_id, texts)
        texts.join(old, "content_hash", "left_anti").select(*texts.columns).write.mode("overwrite").parquet(
            f"{out}/texts/{folder}"
        )
    finally:
        remove_folder(spark, f"{out}/_staged")
    fresh.select("url").write.mode("overwrite").parquet(f"{out}/urls/{folder}")


def stream_extract(
    spark: SparkSession,
    source: str | DataFrame,
    out: str,
    options: ExtractOptions = ExtractOptions(),
    model_factory: Callable | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the stream: texts under `out`/texts, handled URLs under `out`/urls.

    `source` is a folder or glob of Parquet pages, or a streaming DataFrame.
    """
    if isinstance(source, DataFrame):
        stream = source
    else:
        reader = spark.readStream.schema(PAGES)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        stream = reader.parquet(source)
    keep = paragraph_filter(options, model_factory)
    writer = stream.writeStream.foreachBatch(
        lambda batch, batch_id: process_batch(batch, batch_id, out, options, keep)
    ).option("checkpointLocation", f"{out}/_checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
