"""The monthly view by vendor, stored and refreshed from new input files only.

Under its root folder the view keeps

* `loads/load=N`: what refresh N read: a row per input file, and the sums of its rows per month and vendor, in one write;
* `state/month=M`: a month's sums over all loads merged into it, and the last of them (`applied`).

A refresh lists the input files, reads those that no load names, writes their load, and merges the loads that a month
lacks into the months they touch; other months are not read or written. All sums are whole numbers, so a refreshed
view equals one that is built at once. A refresh that stops between its two writes loses and doubles nothing: the
load is there, and the next refresh merges it, into each month that does not have it yet.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from kickstand.functions import columns as X
from kickstand.functions import groups as G
from kickstand.operators.trips import demand_rows
from kickstand.plans import kpi as K
from kickstand.schemas import table_schema
from kickstand.sources.sinks import stored

KEYS = ["month", "vendor"]
MEASURES = ["trips", "incidents", "incident_cents", "tasks", "task_cents"]
_SUMS = "vendor string, " + ", ".join(f"{m} bigint" for m in MEASURES)
LOADS = table_schema(f"source string, path string, size bigint, modified bigint, month date, {_SUMS}, load bigint")
STATE = table_schema(f"{_SUMS}, applied bigint, month date")


# --- sums of each source ----------------------------------------------------------


def _per_month(df, time_col, **sums):
    keys = {k: X.as_col(c) for k, c in K.vendor_month(time_col).items()}
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*[F.coalesce(s, F.lit(0)).cast("bigint").alias(n) for n, s in sums.items()])


def _cents(column):
    return F.sum(F.round(column * 100).cast("bigint"))


SOURCES = {
    "trips": lambda df: K.monthly_trips(demand_rows(df)),
    "incidents": lambda df: _per_month(df, "occurred_at", incidents=F.count("*"), incident_cents=_cents(F.col("cost_usd"))),
    "tasks": lambda df: _per_month(
        df, "created_at", tasks=F.count("*"), task_cents=_cents(F.col("cost_usd") + F.col("parts_cost_usd"))
    ),
}


# --- files ------------------------------------------------------------------------


def input_files(spark, path):
    """(path, size, time of change) of the data files under a path or glob, from the file system's listing alone."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in store.globStatus(place) or []:
        for f in store.listStatus(status.getPath()) if status.isDirectory() else [status]:
            if f.isFile() and f.getPath().getName()[0] not in "._":
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


class ChangedInput(ValueError):
    """A file that an earlier load has read is not the same any more."""


class MonthlyView:
    """A stored monthly view. `readers` gives, per source, a function (spark, files) -> rows of those files."""

    def __init__(self, spark, root, readers):
        self.spark, self.root, self.readers = spark, root.rstrip("/"), readers

    def _table(self, name, schema):
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, df, name, partition):
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition)
        writer.parquet(f"{self.root}/{name}")

    def loads(self):
        return self._table("loads", LOADS)

    def new_files(self, paths):
        """Files that no load has read, as (source, path, size, modified); an error if a file that one has read changed."""
        listed = [(source, *f) for source, path in paths.items() for f in input_files(self.spark, path)]
        if not listed:
            return []
        frame = self.spark.createDataFrame(listed, "source string, path string, size bigint, modified bigint")
        read = self.loads().filter(X.keys_known("path")).select("source", "path", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
        joined = frame.join(read, ["source", "path"], "left")
        changed = joined.filter((F.col("size") != F.col("_size")) | (F.col("modified") != F.col("_modified"))).select("path").first()
        if changed:
            raise ChangedInput(f"{changed['path']} changed after it was read")
        # as many rows as the listing above, which the driver holds anyhow
        return [tuple(r) for r in joined.filter(F.col("_size").isNull()).select("source", "path", "size", "modified").collect()]

    def refresh(self, **paths):
        """Read the new files under `paths` (source=path or glob) and bring the view up to date; returns those files."""
        files = self.new_files(paths)
        if files:
            last = self.loads().agg(F.max("load")).first()[0] or 0
            sums = []
            for source in dict.fromkeys(f[0] for f in files):
                sums.append(SOURCES[source](self.readers[source](self.spark, [f[1] for f in files if f[0] == source])))
            sums = G.merge_measures(KEYS, *sums)
            missing = {m: F.lit(0).cast("bigint") for m in MEASURES if m not in sums.columns}
            named = self.spark.createDataFrame(files, "source string, path string, size bigint, modified bigint")
            rows = sums.withColumns(missing).unionByName(named, allowMissingColumns=True)
            self._write(rows.withColumn("load", F.lit(last + 1).cast("bigint")), "loads", "load")
        self.merge()
        return files

    def merge(self):
        """Merge the loads that months lack into those months."""
        state, loads = self._table("state", STATE), self.loads().filter(F.col("path").isNull())
        done = state.groupBy(F.col("month").alias("_month")).agg(F.max("applied").alias("_applied"))
        same = F.col("month").eqNullSafe(F.col("_month"))
        fresh = loads.join(done, same, "left").filter(F.col("load") > F.coalesce("_applied", F.lit(0)))
        fresh = fresh.select(*KEYS, *MEASURES, F.col("load").alias("applied"))
        touched = fresh.select(F.col("month").alias("_month")).distinct()
        held = state.join(touched, same, "left_semi").unionByName(fresh)
        merged = held.groupBy(*KEYS).agg(*[X.total(m).alias(m) for m in MEASURES], F.max("applied").alias("applied"))
        # every row of a month names the month's last load; a month has one row per vendor
        merged = merged.withColumn("applied", F.max("applied").over(Window.partitionBy("month")))
        # a snapshot first: the months it is made of are about to be replaced
        self._write(stored(merged.select(*[f.name for f in STATE.fields])), "state", "month")

    def read(self):
        """month, vendor, counts and costs as of the last refresh."""
        return self._table("state", STATE).select(
            *KEYS,
            "trips",
            "incidents",
            (F.col("incident_cents") / 100).alias("cost_incidents"),
            "tasks",
            (F.col("task_cents") / 100).alias("cost_tasks"),
        )
