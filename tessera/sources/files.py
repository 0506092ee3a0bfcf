"""Sources and sinks. Every sink can be run again without harm."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tsv(spark: SparkSession, paths: list[str] | str, columns: list[str], header: bool = True, mode: str = "DROPMALFORMED") -> DataFrame:
    """Tab-separated files, all columns as text, malformed lines left out (see operators.rowparse for their reasons)."""
    return spark.read.csv(paths, sep="\t", header=header, schema=", ".join(f"`{c}` string" for c in columns), mode=mode)


def typed_tsv(spark: SparkSession, paths: list[str] | str, schema: str, header: bool = False) -> DataFrame:
    return spark.read.csv(paths, sep="\t", header=header, schema=schema)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, lines that are no JSON of the schema)."""
    lines = spark.read.text(path).where("trim(value) != ''")
    read = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"))
    good = read.where("row._bad is null").select("row.*").drop("_bad")
    return good, read.where("row._bad is not null").select(F.col("value").alias("_bad"))


def labelled_union(parts: dict[str, DataFrame], column: str = "split") -> DataFrame:
    """Tables of one schema in one, each row with the name of its part."""
    out = None
    for name, df in parts.items():
        part = df.withColumn(column, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def file_inventory(spark: SparkSession, glob: str) -> DataFrame:
    """(path, bytes, sha256, empty, copies) of files; contents are hashed where they lie. Empty files, which no scan gives, are taken from the listing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(glob)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    none = [(f.getPath().toString(), 0, hashlib.sha256(b"").hexdigest()) for f in listed if f.isFile() and f.getLen() == 0]
    files = spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).unionByName(spark.createDataFrame(none, "path string, bytes bigint, sha256 string"))
    copies = files.groupBy("sha256").agg(F.count("*").alias("copies"))
    return files.join(copies, "sha256").select("path", "bytes", "sha256", (F.col("bytes") == 0).alias("empty"), "copies")


def zip_members(spark: SparkSession, glob: str, wanted: tuple[str, ...]) -> DataFrame:
    """(archive, member, content) of the wanted members of ZIP archives, one archive a task at a time."""
    import io
    import zipfile

    import pyarrow as pa

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.rsplit("/", 1)[-1] in wanted:
                            yield pa.RecordBatch.from_pydict({"archive": [path], "member": [name], "content": pa.array([z.read(name)], pa.binary())})

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInArrow(run, "archive string, member string, content binary")


def table_mark(df: DataFrame) -> dict:
    """Rows and summed hashes: the same for the same rows in any order."""
    row = df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("hashes")).first()
    return {"rows": row.rows, "hashes": str(row.hashes), "schema": df.schema.simpleString()}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_partitioned(df: DataFrame, path: str, by: list[str], rows: int = 5_000_000) -> bool:
    """Partitioned Parquet, a writer for every ``rows`` rows of a partition value; an equal table already there is kept (False), another is an error."""
    spark = df.sparkSession
    if _exists(spark, f"{path}/_SUCCESS"):
        there = spark.read.parquet(path).select(*df.columns)
        typed = there.select(*(F.col(f.name).cast(f.dataType) for f in df.schema))
        if table_mark(typed)["hashes"] != table_mark(df)["hashes"]:
            raise ValueError(f"{path} holds another table")
        return False
    # At most a row for every ``rows`` rows.
    large = df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > rows).select(*(F.col(c).alias(f"__k_{c}") for c in by), "__n")
    keyed = df.join(F.broadcast(large), [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by], "left").select(*df.columns, F.pmod(F.xxhash64(*df.columns), F.coalesce(F.ceil(F.col("__n") / rows), F.lit(1))).alias("__writer"))
    keyed.repartition(*by, "__writer").drop("__writer").write.partitionBy(*by).parquet(path)
    return True


def partitioned(spark: SparkSession, path: str, **values) -> DataFrame:
    """A partitioned table, only the directories of the given partition values."""
    df = spark.read.parquet(path)
    for name, value in values.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def attach(spark: SparkSession, folder: str, names: list[str], prefix: str = "") -> list[str]:
    """Temporary views of the tables of a folder, for queries in SQL; nothing can be written through them."""
    views = []
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(prefix + name)
        views.append(prefix + name)
    return views


def write_shards(df: DataFrame, path: str, rows: int = 200_000) -> DataFrame:
    """Shards of a bounded number of rows, published at once: written beside the path and renamed when whole. (shard, bytes, sha256) of each.

    Shards that are there already are kept.
    """
    spark = df.sparkSession
    if not _exists(spark, f"{path}/_SUCCESS"):
        jvm = spark._jvm
        part, final = jvm.org.apache.hadoop.fs.Path(f"{path}.part"), jvm.org.apache.hadoop.fs.Path(path)
        fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(part, True)  # what an interrupted run left
        df.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(f"{path}.part")
        if not fs.rename(part, final):
            raise OSError(f"{path} could not be published")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.substring_index("path", "/", -1).alias("shard"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def resumable(identity_there: str | None, identity_now: str) -> bool:
    """Whether work goes on from a checkpoint: nothing there is a fresh start (False), the same identity goes on, another one is an error."""
    if identity_there is None:
        return False
    if identity_there != identity_now:
        raise ValueError("the checkpoint belongs to other work")
    return True


def append_unique(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends rows; a schema that differs, or a key that is there or twice in the rows, is an error."""
    spark = df.sparkSession
    if not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError("a key is repeated")
    if _exists(spark, path):
        there = spark.read.parquet(path)
        if [(f.name, f.dataType) for f in there.schema] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError("the schema differs")
        if not df.join(there.select(*key), key, "left_semi").isEmpty():
            raise ValueError("a key is there already")
    df.write.mode("append").parquet(path)


def upsert(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The table with new rows added; an equal row changes nothing, a differing one of the same key is an error while read."""
    mark = lambda df: df.select(key, F.xxhash64(*sorted(df.columns)).alias("mark"))
    clash = mark(rows).join(mark(table).withColumnRenamed("mark", "old"), key)
    if not clash.where("mark != old").isEmpty():
        raise ValueError("a row of this key has other values")
    return table.unionByName(rows.join(table.select(key), key, "left_anti").select(*table.columns))


def canonical_json(value) -> bytes:
    """Sorted keys, no blanks, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def identity(value) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def write_record(path: str, record: dict, spark: SparkSession | None = None) -> None:
    """A run record with its own hash, written once; an existing file is never overwritten.

    With a session it is written to the file system of the path, which a cluster shares.
    """
    text = json.dumps(record | {"record_sha256": identity(record)}, sort_keys=True)
    if spark is None:
        with open(path, "x") as f:
            f.write(text)
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    except Exception as e:
        if "exist" in str(e).lower():
            raise FileExistsError(path) from e
        raise
    out.write(bytearray(text.encode()))
    out.close()


def read_record(path: str, spark: SparkSession | None = None) -> dict:
    if spark is None:
        with open(path) as f:
            record = json.load(f)
    else:
        record = json.loads(spark.read.text(path, wholetext=True).first()[0])
    mark = record.pop("record_sha256", None)
    if mark != identity(record):
        raise ValueError(f"{os.path.basename(path)} was changed")
    return record


def read_registry(text: str) -> dict[str, dict[str, str]]:
    """A two-level 'name:' / '  key: value' file; repeated names or keys are errors."""
    out: dict[str, dict[str, str]] = {}
    current = None
    for line in text.splitlines():
        body = line.split("#", 1)[0].rstrip()
        if not body:
            continue
        name, _, value = body.strip().partition(":")
        if not body.startswith(" "):
            if name in out:
                raise ValueError(f"{name} is there twice")
            current = out[name] = {}
        elif current is None or name in current:
            raise ValueError(f"{name} is there twice or under no name")
        else:
            current[name] = value.strip().strip("\"'")
    return out


def typed_registry(spark: SparkSession, text: str) -> DataFrame:
    """(name, enabled, quarters, unit, label) of a registry of concepts; a wrong period, missing field or repeated name is an error."""
    rows = []
    for name, spec in read_registry(text).items():
        period = spec.get("period_type")
        quarters = int(spec["qtrs"]) if spec.get("qtrs", "").isdigit() else None
        if quarters != {"instant": 0, "duration": 4}.get(period) or not spec.get("unit"):
            raise ValueError(f"{name}: a balance has 0 quarters, an amount 4, and both a unit")
        rows.append((name, spec.get("enabled", "true") == "true", quarters, spec["unit"], spec.get("label")))
    return spark.createDataFrame(rows, "name string, enabled boolean, quarters int, unit string, label string")
