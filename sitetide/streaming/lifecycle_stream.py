"""Incremental lifecycle: every arriving scan is applied to the page state exactly once.

State is a row of folders, one for each micro-batch, and a folder holds what its batch changed: the page rows that its
scans touched, events, applied scans. The newest row of a page counts. So what a batch writes follows the batch, not the
history; every COMPACT batches all pages are written once together, and older folders are read no more for them. Page rows
lie in parts by competitor: a batch reads the parts of the competitors that it scans. A batch that is retried writes the
same folder again from the same predecessors, and scans that were applied before are skipped by id.

The rows of a scan may be spread over micro-batches. Each row says how many rows its scan has; until all have
arrived, they wait in the folder, and so do later scans of the same competitor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sitetide.operators import diff as D
from sitetide.operators.joins import join_dimension
from sitetide.operators.lifecycle import diff_events, new_events, new_page_rows, page_id, transition
from sitetide.operators.windows import first_wins
from sitetide.schemas import TABLES, struct
from sitetide.session import cut_lineage

# One row per sitemap entry; a scan without entries is one row with a null URL. Without n_rows, what a batch has of a
# scan is the whole scan.
SCAN_SCHEMA = struct(
    "scan_run_id string, competitor_id string, scanned_at timestamp, is_complete boolean, url string, "
    "normalized_url string, lastmod string, source_url string, n_rows bigint")

STATE_TABLES = {
    "pages": TABLES["pages"],
    "page_events": TABLES["page_events"],
    "applied_scans": struct("scan_run_id string, competitor_id string, is_complete boolean"),
    "pending": SCAN_SCHEMA,
}
#: Tables of which all folders together are the state; of ``pending`` the last one is.
LOGS = ("page_events", "applied_scans")
#: Parts of the page rows, and batches after which all pages are written together.
PARTS, COMPACT = 16, 64
WHOLE = "all_pages"


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Batch numbers with a finished snapshot."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    done = []
    for name in names:
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/applied_scans/_SUCCESS")
        if name.startswith("batch=") and fs.exists(marker):
            done.append(int(name.removeprefix("batch=")))
    return sorted(done)


def _part() -> Column:
    return F.pmod(F.xxhash64("competitor_id"), F.lit(PARTS)).cast("int")


def _latest(layers: list[DataFrame]) -> DataFrame:
    """One row a page, from the last layer that has it."""
    numbered = [layer.withColumn("_layer", F.lit(i)) for i, layer in enumerate(layers)]
    together = numbered[0]
    for layer in numbered[1:]:
        together = together.unionByName(layer)
    return first_wins(together, D.KEY, [F.col("_layer").desc()]).drop("_layer")


def _page_layers(spark: SparkSession, root: str, versions: list[int], parts: list[int] | None = None) -> list[DataFrame]:
    """The page rows by batch, oldest first, from the last batch that wrote all of them; with ``parts`` only these."""
    whole = [v for v in versions if v % COMPACT == COMPACT - 1]
    folders = [f"{root}/batch={v}/{WHOLE}" for v in whole[-1:]] + [f"{root}/batch={v}/pages" for v in versions if not whole or v > whole[-1]]
    schema = STATE_TABLES["pages"]
    layers = [spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])).parquet(f) for f in folders]
    return [(layer if parts is None else layer.filter(F.col("part").isin(parts))).select(schema.names) for layer in layers]


def read_lifecycle_state(spark: SparkSession, root: str, before: int | None = None) -> dict[str, DataFrame]:
    """The state after the last finished batch (older than ``before``, if given); empty tables when there is none."""
    versions = [v for v in _versions(spark, root) if before is None or v < before]
    if not versions:
        return {name: spark.createDataFrame([], schema) for name, schema in STATE_TABLES.items()}
    rest = {
        name: spark.read.schema(schema).parquet(*[f"{root}/batch={v}/{name}" for v in (versions if name in LOGS else versions[-1:])])
        for name, schema in STATE_TABLES.items() if name != "pages"
    }
    return rest | {"pages": _latest(_page_layers(spark, root, versions))}


def apply_round(pages: DataFrame, based: DataFrame, scans: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page rows that change, events) of one scan per competitor (scan_run_id, competitor_id, scanned_at, is_complete).

    pages: those of these competitors; based: competitors that had a complete scan before.
    """
    later = join_dimension(scans, based.distinct().withColumn("_based", F.lit(True)), ["competitor_id"], ["scan_run_id"], "left")
    first = later.filter(F.col("_based").isNull() & F.col("is_complete")).drop("_based")
    later = later.filter("_based").drop("_based")
    as_of = F.col("scanned_at")
    opening = join_dimension(entries, first.select("competitor_id", "scan_run_id", "scanned_at"), ["competitor_id"], ["normalized_url"])
    opening = opening.join(pages.select(*D.KEY), D.KEY, "left_anti")
    baseline = new_page_rows(opening, "baseline", as_of)
    added = new_events(
        opening.withColumn("page_id", page_id()), F.col("page_id"), F.col("scan_run_id"), F.lit("baseline_added"), as_of)
    times = later.select("competitor_id", "scanned_at")
    current = join_dimension(entries, times.select("competitor_id"), ["competitor_id"], ["normalized_url"])
    classified = D.classify_scan(current, pages, later).filter(F.col("change_type").isNotNull())
    touched = cut_lineage(join_dimension(classified, times, ["competitor_id"], ["normalized_url"]))
    return transition(touched, as_of).unionByName(baseline), diff_events(touched, as_of).unionByName(added)


def apply_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """Write what a micro-batch changes; several scans of a competitor go in time order."""
    spark = batch.sparkSession
    versions = [v for v in _versions(spark, root) if v < batch_id]
    state = read_lifecycle_state(spark, root, before=batch_id)
    arrived = batch.select(*[F.col(f.name) if f.name in batch.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCAN_SCHEMA])
    rows = cut_lineage(arrived.unionByName(state["pending"]).join(
        state["applied_scans"].select("scan_run_id"), "scan_run_id", "left_anti").select(*SCAN_SCHEMA.names))
    scans = rows.groupBy("scan_run_id", "competitor_id").agg(
        F.min("scanned_at").alias("scanned_at"), F.bool_and("is_complete").alias("is_complete"),
        (F.count(F.lit(1)) < F.coalesce(F.max("n_rows"), F.lit(0))).alias("waits"))
    in_time = Window.partitionBy("competitor_id").orderBy("scanned_at", "scan_run_id")
    held = F.max("waits").over(in_time)
    ready = scans.withColumn("waits", held).filter(~F.col("waits")).drop("waits")
    turns = cut_lineage(ready.withColumn("turn", F.row_number().over(in_time)))
    seen = turns.agg(F.coalesce(F.max("turn"), F.lit(0)).alias("n"), F.collect_set(_part()).alias("parts")).first()
    scanned = turns.select("competitor_id").distinct()
    based = cut_lineage(state["applied_scans"].filter("is_complete").join(scanned, "competitor_id", "left_semi").select("competitor_id").distinct())
    layers = _page_layers(spark, root, versions, seen["parts"])
    pages = spark.createDataFrame([], STATE_TABLES["pages"])
    if layers and seen["n"]:
        pages = cut_lineage(_latest(layers).join(scanned, "competitor_id", "left_semi"))
    entries = rows.filter(F.col("normalized_url").isNotNull()).groupBy("scan_run_id", *D.KEY).agg(
        F.min_by(F.struct("url", "lastmod", "source_url"), "url").alias("entry"))
    entries = cut_lineage(entries.select("scan_run_id", *D.KEY, "entry.*"))
    changed: list[DataFrame] = []
    events = spark.createDataFrame([], STATE_TABLES["page_events"])
    for turn in range(1, seen["n"] + 1):
        current = turns.filter(F.col("turn") == turn).drop("turn")
        listed = entries.join(current.select("scan_run_id"), "scan_run_id", "left_semi").drop("scan_run_id")
        rows_, events_ = apply_round(_latest([pages, *changed]) if changed else pages, based, current, listed)
        changed.append(cut_lineage(rows_))
        events = events.unionByName(events_)
        based = based.unionByName(current.filter("is_complete").select("competitor_id"))
    folder = f"{root}/batch={batch_id}"
    newest = _latest(changed) if changed else pages.limit(0)
    newest.select(STATE_TABLES["pages"].names).withColumn("part", _part()).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/pages")
    events.write.mode("overwrite").parquet(f"{folder}/page_events")
    rows.join(turns.select("scan_run_id"), "scan_run_id", "left_anti").select(*SCAN_SCHEMA.names).write.mode("overwrite").parquet(f"{folder}/pending")
    if batch_id % COMPACT == COMPACT - 1:
        own = spark.read.schema(STATE_TABLES["pages"]).parquet(f"{folder}/pages").select(STATE_TABLES["pages"].names)
        every = _latest([*_page_layers(spark, root, versions), own])
        every.withColumn("part", _part()).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/{WHOLE}")
    # last, as a batch counts from here on
    turns.select("scan_run_id", "competitor_id", "is_complete").write.mode("overwrite").parquet(f"{folder}/applied_scans")


def start_lifecycle_stream(source: DataFrame, state_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start the query on a streaming frame of ``SCAN_SCHEMA`` rows."""
    writer = source.writeStream.foreachBatch(
        lambda batch, batch_id: apply_batch(batch, batch_id, state_path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
