"""CSV and parquet readers.

CSV files are read as text by header name and cast column by column: a schema given to the CSV
reader binds by position, and inference would read the data twice.
"""

import re
from functools import reduce

from pyspark.sql import functions as F

from kickstand import constants as C
from kickstand.functions import columns as X
from kickstand.schemas import TABLES


#: Stores that tasks can open by themselves, and how much of a file they read at a time to find its first line.
URI_SCHEMES = ("file", "hdfs", "s3", "gs", "abfs")
HEADER_BYTES = 1 << 14


class MissingColumns(ValueError):
    """A required column was not found in the source."""


def csv_files(spark, path):
    """Data files that a path, a glob or a list of them names, on any file system that Spark reads."""
    found = []
    for text in [path] if isinstance(path, str) else path:
        place = spark._jvm.org.apache.hadoop.fs.Path(text)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in store.globStatus(place) or []:
            inner = store.listStatus(status.getPath()) if status.isDirectory() else [status]
            found += [f.getPath().toString() for f in inner if f.isFile() and f.getPath().getName()[0] not in "._"]
    return sorted(found)


def _first_lines(batches):
    """First line of each file, read in tasks; compression is told by the file's name."""
    import pyarrow as pa
    import pyarrow.fs

    for batch in batches:
        lines = []
        for path in batch["path"].to_pylist():
            store, place = pyarrow.fs.FileSystem.from_uri(path)
            held = b""
            with store.open_input_stream(place, compression="detect") as stream:
                while b"\n" not in held and (more := stream.read(HEADER_BYTES)):
                    held += more
            lines.append(held.split(b"\n", 1)[0])
        yield pa.RecordBatch.from_arrays([batch["path"], pa.array(lines, pa.binary())], names=["path", "header"])


def header_groups(spark, files):
    """Files by their header line: one job over all files, and one row per distinct header for the driver.

    Tasks open the files themselves where they can (URI_SCHEMES); files of other stores are read by Spark as text.
    """
    parts = min(len(files), 4 * spark.sparkContext.defaultParallelism)
    if all(f.split(":", 1)[0] in URI_SCHEMES for f in files):
        listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(parts)
        first = listed.mapInArrow(_first_lines, "path string, header binary")
    else:
        lines = spark.read.text(files).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("nth"))
        first = lines.filter("file_block_start = 0").groupBy(F.col("file_path").alias("path")).agg(F.min_by("value", "nth").alias("header"))
    grouped = first.groupBy("header").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    # all paths are in the driver's listing anyhow
    return sorted(r["paths"] for r in grouped.select("paths").collect())


def read_text_csv(spark, path, **options):
    """CSV with a header, every column as text; empty text is NULL.

    Files are grouped by their header line and united by column name, so files of one glob may order their
    columns differently or lack some; a column that a file lacks is NULL there.
    """
    reader = spark.read.options(header=True, nullValue="", **options)
    files = csv_files(spark, path)
    if len(files) < 2:
        return reader.csv(path)
    # files that differ in their line end or quotes alone have the same columns
    groups = {}
    for held in header_groups(spark, files):
        groups.setdefault(tuple(reader.csv(held[0]).columns), []).extend(held)
    frames = [reader.schema(", ".join(f"`{c.replace('`', '``')}` string" for c in names)).csv(sorted(held)) for names, held in sorted(groups.items(), key=lambda g: min(g[1]))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def require_columns(df, names, source="table"):
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumns(f"{source}: missing {missing}, found {df.columns}")
    return df


def conformed(df, schema):
    """The columns of `conform`."""
    picked = []
    for field in schema.fields:
        if field.name not in df.columns:
            picked.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            picked.append(_cast(F.col(field.name), df.schema[field.name].dataType, field).alias(field.name))
    return picked


def conform(df, schema):
    """Columns of `schema` in its order, cast by name; absent columns are NULL, bad values NULL."""
    return df.select(*conformed(df, schema))


def _cast(col, have, field):
    if have == field.dataType:
        return col
    kind = field.dataType.simpleString()
    if have.simpleString() != "string":
        return col.cast(field.dataType)
    if kind == "timestamp_ntz":
        return X.parse_time(col)
    if kind == "date":
        return X.parse_time(col).cast("date")
    if kind in ("int", "bigint"):
        # "3.0" is how a numeric column with gaps is written as CSV
        whole = F.when(F.trim(col).rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(F.trim(col), r"\.0*$", ""))
        return whole.try_cast(field.dataType)
    return F.trim(col).try_cast(field.dataType) if kind != "string" else col


def read_table(spark, path, name=None, schema=None, required=(), fmt="csv"):
    """Typed table from CSV or parquet; `name` picks one of the known layouts."""
    schema = schema or TABLES[name]
    raw = read_text_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
    return conform(require_columns(raw, required, path), schema)


def optional_table(spark, path, name, **kwargs):
    """Typed table, or an empty one with the same columns when no path is given."""
    if path is None:
        return spark.createDataFrame([], TABLES[name])
    return read_table(spark, path, name, **kwargs)


def flag_bad_rows(raw, schema):
    """Raw rows with `bad_columns`: the names of the columns of `schema` whose text cannot be read."""
    cast = {
        f.name: _cast(F.col(f.name), raw.schema[f.name].dataType, f)
        for f in schema.fields
        if f.name in raw.columns
    }
    failed = [
        F.when(X.blank_to_null(name).isNotNull() & value.isNull(), F.lit(name)) for name, value in cast.items()
    ]
    return raw.withColumn("bad_columns", F.filter(F.array(*failed), lambda c: c.isNotNull()))


def split_bad_rows(raw, schema):
    """(good rows cast to `schema`, rejected raw rows with the names of the columns that failed)."""
    flagged = flag_bad_rows(raw, schema)
    good = conform(flagged.filter(F.size("bad_columns") == 0).select(*raw.columns), schema)
    return good, flagged.filter(F.size("bad_columns") > 0)


# --- raw trips --------------------------------------------------------------------


def detect_columns(columns, candidates=None):
    """Physical column per logical name, None where no header fits.

    Headers and aliases are compared by their letters and digits. All pairs that fit are ranked at once: a header
    equal to an alias goes before one that contains it, and then the earlier header goes first. Two headers that
    are the same text after that comparison are ambiguous, and an error if one of them is wanted.
    """
    plain = {name: re.sub(r"[\W_]", "", name.lower()) for name in columns}
    found = {}
    for logical, aliases in (candidates or C.TRIP_HEADERS).items():
        words = {re.sub(r"[\W_]", "", alias.lower()) for alias in aliases}
        fits = [
            (plain[name] not in words, place, name)
            for place, name in enumerate(columns)
            if any(word in plain[name] for word in words)
        ]
        found[logical] = min(fits)[2] if fits else None
        twins = [name for name in columns if found[logical] and plain[name] == plain[found[logical]]]
        if len(twins) > 1:
            raise ValueError(f"ambiguous headers for {logical}: {twins}")
    return found


def trips_canon(
    raw,
    mapping=None,
    vendor_map=None,
    fallback=C.FALLBACK_VENDOR,
    start=None,
    end=None,
):
    """Canonical trips from raw text trips: one narrow projection, no shuffle.

    Rows without a readable start time are dropped, vendors are mapped to their canonical names, and
    the area is the start area name, else the end area name (numbers when there are no name columns).
    `start` and `end` are closed limits on the day. Distances become whole metres.
    """
    mapping = mapping or detect_columns(raw.columns)
    missing = [k for k in C.REQUIRED_TRIP_HEADERS if mapping.get(k) is None]
    if missing:
        raise MissingColumns(f"trips: no column found for {missing} among {raw.columns}")

    names = [mapping.get(k) for k in ("start_area_name", "end_area_name") if mapping.get(k)]
    numbers = [mapping.get(k) for k in ("start_area_num", "end_area_num") if mapping.get(k)]
    area_name = X.first_text(*names) if names else F.lit(None).cast("string")
    # numbers count only when the source has no name column, and the start number is preferred as a whole
    area_num = (
        F.floor(X.as_col(numbers[0]).cast("string").try_cast("double")).cast("int")
        if numbers and not names
        else F.lit(None).cast("int")
    )
    km, metres = mapping.get("distance_km"), mapping.get("distance_m")
    if km:
        distance = F.round(X.as_col(km).cast("string").try_cast("double") * 1000)
    elif metres:
        distance = F.round(X.as_col(metres).cast("string").try_cast("double"))
    else:
        distance = F.lit(None)

    trips = raw.select(
        X.vendor_canon(mapping["vendor"], vendor_map, fallback).alias("vendor"),
        X.parse_time(F.col(mapping["start_time"]).cast("string")).alias("started_at"),
        area_name.alias("area_name"),
        area_num.alias("area_num"),
        distance.cast("int").alias("distance_m"),
    ).filter(F.col("started_at").isNotNull())
    trips = trips.withColumns({"day": F.to_date("started_at"), "hour": F.hour("started_at")})
    if start is not None:
        trips = trips.filter(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        trips = trips.filter(F.col("day") <= F.lit(end).cast("date"))
    return trips


def rejected_trips(raw, mapping=None):
    """Raw rows that `trips_canon` drops because their start time cannot be read."""
    mapping = mapping or detect_columns(raw.columns)
    time = X.parse_time(F.col(f"`{mapping['start_time']}`").cast("string"))
    return raw.filter(time.isNull())


def read_raw_trips(spark, path, **kwargs):
    """Canonical trips straight from raw CSV; only the detected columns are parsed."""
    raw = read_text_csv(spark, path)
    mapping = detect_columns(raw.columns)
    wanted = [c for c in dict.fromkeys(mapping.values()) if c]
    return trips_canon(raw.select(*[F.col(f"`{c}`").alias(c) for c in wanted]), mapping, **kwargs)
