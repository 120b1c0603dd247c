"""A table of rows by key, in which the last write of a key wins, in pieces of Parquet that a manifest names.

Each load writes new pieces beside the old ones: the partitions it touches, merged, and the buckets it touches of
an index that says in which partition each key is. Then it writes the next manifest, whose number no other load
can take as well: that one step makes all of it current. A load that is lost before leaves pieces that
nothing names (``vacuum`` removes them); of two loads at once the second to finish merges again, into what the
first has made of the table. Readers keep the pieces that they have begun with.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.session import durable, remove_folder

BUCKETS = 64  #: of the index of keys


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    place, files = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What the table consists of: version, schema, keys, partition, and the folders of its ``rows`` by partition and of
    its ``index`` by bucket. None before the first load; the latest without ``version``."""
    known = [int(n.split(".")[0]) for n in _names(spark, f"{path}/manifests") if n.endswith(".json")]
    if not known:
        return None
    number = max(known) if version is None else version
    return json.loads(spark.read.text(f"{path}/manifests/{number}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, new: dict) -> bool:
    """Writes a manifest under its number, unless there is one of that number."""
    fs = spark._jvm.org.apache.hadoop.fs
    draft, files = _files(spark, f"{path}/drafts/{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(new), "utf-8"))
    out.close()
    target, _ = _files(spark, f"{path}/manifests/{new['version']}.json")
    files.mkdirs(target.getParent())
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        fs.FileContext.getFileContext(files.makeQualified(draft).toUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(draft), files.makeQualified(target), options)
    except Exception as e:
        files.delete(draft, False)
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    return True


def _part(partition: str) -> Column:
    """A partition's name, null having one of its own."""
    return F.when(F.col(partition).isNull(), "null").otherwise(F.concat(F.lit("is"), F.hex(F.encode(F.col(partition).cast("string"), "UTF-8"))))


def _bucket(keys: list[str]) -> Column:
    return F.concat(F.lit("b"), F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("string"))


def _read(spark: SparkSession, path: str, schema: T.StructType, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table as of its latest, or a given, manifest; none before its first load."""
    made = manifest(spark, path, version)
    return None if made is None else _read(spark, path, T.StructType.fromJson(made["schema"]), [*made["rows"].values()])


def one_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``; rows that tie there are told apart by all their columns, so the
    choice never depends on how they were dealt."""
    rest = [F.desc_nulls_last(c) for c, t in rows.dtypes if c not in keys and not t.startswith("map")]
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))).where("_rn = 1").drop("_rn")


def latest_wins(old: DataFrame | None, new: DataFrame, keys: list[str], arrived: list[str]) -> DataFrame:
    """One row per key: a new row over an old one, whatever they say, and of new ones the last by ``arrived``."""
    rows = new.withColumn("_new", F.lit(1))
    rows = rows.unionByName(old.withColumn("_new", F.lit(0)), allowMissingColumns=True) if old is not None else rows
    return one_per_key(rows, keys, [F.desc("_new"), *(F.desc_nulls_last(c) for c in arrived)]).drop("_new")


def _written(rows: DataFrame, path: str, kind: str, by: str) -> dict[str, str]:
    """Writes ``rows`` in a folder for each value of ``by``, of files of a fitting size: {value: folder}."""
    piece = f"{kind}/{uuid.uuid4().hex}"
    rows.hint("rebalance", by).write.partitionBy(by).parquet(f"{path}/{piece}")
    found = [n for n in _names(rows.sparkSession, f"{path}/{piece}") if n.startswith(f"{by}=")]
    return {n.removeprefix(f"{by}="): f"{piece}/{n}" for n in found}


def stage(new: DataFrame, path: str, keys: list[str], arrived: list[str], partition: str) -> dict:
    """Writes the pieces that a load changes and returns the manifest that would make them current.

    Read and written are only the partitions that the load names or that the index has its keys in, whose number
    is what comes to the driver."""
    spark = new.sparkSession
    made = manifest(spark, path) or {"version": 0, "keys": keys, "partition": partition, "rows": {}, "index": {}}
    if (made["keys"], made["partition"]) != (keys, partition):
        raise ValueError(f"the table at {path} has the keys {made['keys']} in partitions by {made['partition']}")
    columns = [c for c in new.columns if c not in arrived or c in keys]
    schema = T.StructType.fromJson(made["schema"]) if "schema" in made else T.StructType([T.StructField(f.name, f.dataType) for f in new.select(columns).schema])
    columns = schema.fieldNames()
    once = durable(latest_wins(None, new, keys, arrived).select(*(c for c in columns if c in new.columns), _part(partition).alias("_part")))  # read for the rows and for the index
    winners = once.select(*keys, "_part")
    named = {r[0]: r[1] for r in winners.groupBy(_bucket(keys)).agg(F.collect_set("_part")).collect()}  # the load's buckets and partitions
    entries = T.StructType([*(T.StructField(k, schema[k].dataType) for k in keys), T.StructField("_part", T.StringType())])
    index = _read(spark, path, entries, [f for b, f in made["index"].items() if b in named])
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    written = lambda held, kind: held.alias("i").join(winners.alias("w"), same, kind)
    before = [r[0] for r in written(index, "left_semi").select("_part").distinct().collect()]
    touched = set(before).union(*named.values())
    old = [f for p, f in made["rows"].items() if p in touched]
    merged = once
    if old:
        rest = written(_read(spark, path, schema, old), "left_anti")
        merged = rest.withColumn("_part", _part(partition)).unionByName(once, allowMissingColumns=True)
    placed = (winners if index.isEmpty() else written(index, "left_anti").unionByName(winners)).withColumn("_bucket", _bucket(keys))
    rows = {p: f for p, f in made["rows"].items() if p not in touched} | _written(merged, path, "rows", "_part")
    buckets = {b: f for b, f in made["index"].items() if b not in named} | _written(placed, path, "index", "_bucket")
    return {"version": made["version"] + 1, "schema": schema.jsonValue(), "keys": keys, "partition": partition, "rows": rows, "index": buckets}


def upsert(new: DataFrame, path: str, keys: list[str], arrived: list[str], partition: str, attempts: int = 10) -> int:
    """Merges a load into the table at ``path``: the last write of a key wins, also where it says another partition.
    Columns named in ``arrived`` say in which order the rows of the load came and aren't stored, unless they
    are keys. Null keys are keys, and a null partition is a partition. Returns the table's new version."""
    for _ in range(attempts):
        made = stage(new, path, keys, arrived, partition)
        if _publish(new.sparkSession, path, made):
            return made["version"]
    raise RuntimeError(f"{attempts} other loads came first at {path}")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes pieces that none of the last ``keep`` manifests names, and the manifests before; to be run while no load runs.
    Returns how many pieces went."""
    last = (manifest(spark, path) or {"version": 0})["version"]
    numbers = range(max(1, last - keep + 1), last + 1)
    used = {"/".join(f.split("/")[:2]) for n in numbers for made in [manifest(spark, path, n)] for kind in ("rows", "index") for f in made[kind].values()}
    pieces = [f"{kind}/{n}" for kind in ("rows", "index") for n in _names(spark, f"{path}/{kind}")]
    gone = [p for p in pieces if p not in used]
    for p in [*gone, *(f"manifests/{n}.json" for n in range(1, last - keep + 1)), "drafts"]:
        remove_folder(spark, f"{path}/{p}")
    return len(gone)
