"""Writers: extracts as CSV, staged and materialised tables as parquet."""

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from kickstand.schemas import TABLES
from kickstand.sources.readers import conform, conformed, flag_bad_rows, read_text_csv

#: Columns of a staged table beside its own: the verdict that parts the rows, and the text of a rejected row.
VERDICT, RAW_ROW = "_good", "_raw_row"


def write_extract(df, path, columns=None):
    """CSV with header and a fixed column order, one file per task."""
    out = df.select(*columns) if columns else df
    out.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def write_named_extract(df, path, name):
    """CSV in the layout of a known table; columns the frame lacks are empty."""
    write_extract(conform(df, TABLES[name]), path)


def materialize(spark, df, path, partition_by=None):
    """Write a parquet snapshot and read it back, so that later jobs start from the stored table."""
    if partition_by:
        # rows of one partition value are gathered before the write; AQE splits the values that are too large
        df = df.hint("rebalance", partition_by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def _shared_folder(spark):
    """Folder that driver and executors share: `spark.checkpoint.dir`, else the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def new_folder(spark, name):
    """A path in the shared folder that nothing else uses; the file system drops it when the driver ends."""
    path = f"{_shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df):
    """Snapshot of a table that several branches of a job read, in the shared folder.

    The table is computed once, on any master alike, later stages read columns of it from parquet, and a lost
    executor costs no recomputation from the source.
    """
    spark = df.sparkSession
    path = new_folder(spark, "stored")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staging_load(spark, csv_path, name, target, rejects=None):
    """Load a CSV file into a typed parquet table; rows with unreadable values go to `rejects`.

    Without `rejects` a bad row fails the load, as a bulk copy would, and the target stays as it was. The text is parsed
    once: one pass writes good and bad rows apart, by a partition column, and counts them on the way. Then the good
    part becomes the target by a rename, and the bad part, read back from the staged files, goes to `rejects`.
    """
    schema = TABLES[name]
    flagged = flag_bad_rows(read_text_csv(spark, csv_path), schema)
    good = F.size("bad_columns") == 0
    raw = F.when(~good, F.to_json(F.struct(*[F.col(f"`{c}`") for c in flagged.columns if c != "bad_columns"])))
    staged = flagged.select(
        *conformed(flagged, schema),
        raw.alias(RAW_ROW),
        F.when(~good, F.col("bad_columns").cast("string")).alias("bad_columns"),
        good.alias(VERDICT),
    )
    counts = Observation()
    observed = staged.observe(counts, F.count_if(~F.col(VERDICT)).alias("bad"), F.max("bad_columns").alias("example"))
    place = new_folder(spark, "staging")
    observed.write.partitionBy(VERDICT).parquet(place)
    if counts.get["bad"] and rejects is None:
        raise ValueError(f"{csv_path}: unreadable values in {counts.get['example']}")
    if rejects is not None:
        names = [c for c in flagged.columns if c != "bad_columns"]
        layout = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
        bad = spark.read.schema(f"{RAW_ROW} string, bad_columns string, {VERDICT} boolean").parquet(place).filter(~F.col(VERDICT))
        bad = bad.select(F.from_json(RAW_ROW, layout).alias("row"), "bad_columns").select("row.*", "bad_columns")
        bad.write.mode("overwrite").option("header", True).csv(rejects)
    _replace_folder(spark, f"{place}/{VERDICT}=true", target)
    return spark.read.schema(schema).parquet(target)


def _replace_folder(spark, source, target):
    """Make `source` the folder `target`: a rename inside one store, a copy between stores."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    source, target = hadoop.Path(source), hadoop.Path(target)
    from_store, to_store = source.getFileSystem(conf), target.getFileSystem(conf)
    to_store.delete(target, True)
    if not from_store.exists(source):
        to_store.mkdirs(target)
        return
    to_store.mkdirs(target.getParent())
    if from_store.getUri().equals(to_store.getUri()):
        from_store.rename(source, target)
    else:
        hadoop.FileUtil.copy(from_store, source, to_store, target, True, conf)
