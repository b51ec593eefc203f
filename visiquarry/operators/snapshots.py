"""Snapshot tables: runs' rows are staged, checked and published by a manifest that readers follow.

A table is two folders under the root: data, in folders by commit, client and run, and the manifest, a row for each commit,
client and run that was published. A commit first writes its data, where no reader looks yet; then its keys are checked in
themselves and against what is stored of the same runs; only then its manifest rows are written, in one job whose output appears at once. A
write that fails before leaves data that no manifest names, and the table as it was. A commit that is repeated under its name is
known and not written again. One writer at a time commits to a table.

A manifest row appends to its run, replaces it (marts, written anew by each analysis) or drops it (retention). Per run the rows after
the newest replacement or drop count.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .keys import KEYS
from .runs import NATURAL_KEYS, RETENTION, kept_runs

MANIFEST = "client string, run_id long, commit string, seq long, op string, n_rows long"


class KeyConflict(ValueError):
    """A natural key occurs twice in a run."""


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A folder of Parquet; None if it doesn't exist."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def manifest(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Every published row of the manifest."""
    found = _read(spark, f"{root}/{table}/manifest", MANIFEST)
    return spark.createDataFrame([], MANIFEST) if found is None else found


def live(entries: DataFrame) -> DataFrame:
    """client, run_id, commit of the data that counts."""
    turn = F.max(F.when(F.col("op") != "append", F.col("seq")))
    since = entries.groupBy(*KEYS).agg(F.coalesce(turn, F.lit(-1)).alias("since"))
    return entries.join(since, [*KEYS]).where((F.col("seq") >= F.col("since")) & (F.col("op") != "drop")).select(*KEYS, "commit").distinct()


def read(spark: SparkSession, root: str, table: str, client: str | None = None, run_id: int | None = None) -> DataFrame:
    """Rows of a table; of one client's run only the folders that its manifest rows name are listed."""
    entries = manifest(spark, root, table)
    if client is not None:
        entries = entries.where(F.col("client") == client)
    if run_id is not None:
        entries = entries.where(F.col("run_id") == run_id)
    now = live(entries)
    base = f"{root}/{table}/data"
    if client is not None and run_id is not None:
        commits = [r["commit"] for r in now.collect()]  # those of one run
        if not commits:
            return _data(spark, base).limit(0).drop("commit")
        return _data(spark, base, *(f"{base}/commit={c}/client={client}/run_id={run_id}" for c in commits)).drop("commit")
    return _data(spark, base).join(now, [*KEYS, "commit"], "left_semi").drop("commit")


def _data(spark: SparkSession, base: str, *paths: str) -> DataFrame:
    """Rows below a table's data, the names of folders as text and run_id as a number, whatever they look like."""
    found = spark.read.option("basePath", base).parquet(*(paths or (base,))).schema
    folders = {"client": "string", "commit": "string", "run_id": "bigint"}
    schema = ", ".join(f"`{f.name}` {folders.get(f.name, f.dataType.simpleString())}" for f in found.fields)
    return spark.read.schema(schema).option("basePath", base).parquet(*(paths or (base,)))


def commit(rows: DataFrame, root: str, table: str, name: str, op: str = "append", keys: tuple[str, ...] | None = None) -> bool:
    """Publish rows (client, run_id, ...) as the commit ``name``; False if it is known already. KeyConflict leaves the table as it was.

    ``keys``: the natural keys beside client and run, by default those of the fact table; () checks nothing.
    """
    spark = rows.sparkSession
    entries = manifest(spark, root, table)
    if not entries.where(F.col("commit") == name).isEmpty():
        return False
    staged = f"{root}/{table}/data/commit={name}"
    rows.withColumn("run_id", F.col("run_id").cast("long")).write.mode("overwrite").partitionBy(*KEYS).parquet(staged)
    written = spark.read.schema(_schema(rows)).parquet(staged)
    keys = NATURAL_KEYS.get(table, ()) if keys is None else keys
    if keys:
        twice = _repeated(written, keys)
        if op == "append":
            stored = _read_or_none(spark, root, table, written)
            if stored is not None:
                twice = twice.unionByName(written.select(*KEYS, *keys).join(stored.select(*KEYS, *keys), [*KEYS, *keys], "left_semi"))
        first = twice.limit(1).collect()
        if first:
            raise KeyConflict(f"{table}: repeated key {first[0].asDict()}")
    seq = (entries.agg(F.max("seq")).first()[0] or 0) + 1
    told = written.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows")).select("client", "run_id", F.lit(name).alias("commit"), F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), "n_rows")
    told.coalesce(1).write.mode("append").parquet(f"{root}/{table}/manifest")
    return True


def _schema(rows: DataFrame) -> str:
    """Columns with the folder columns last."""
    types = dict(rows.dtypes) | {"run_id": "bigint", "client": "string"}
    return ", ".join(f"`{c}` {types[c]}" for c in [*(c for c in rows.columns if c not in KEYS), *KEYS])


def _repeated(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*KEYS, *keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def _read_or_none(spark: SparkSession, root: str, table: str, rows: DataFrame) -> DataFrame | None:
    """What is stored of the runs in ``rows``."""
    now = live(manifest(spark, root, table)).join(rows.select(*KEYS).distinct(), [*KEYS], "left_semi")
    if now.isEmpty():
        return None
    return _data(spark, f"{root}/{table}/data").join(now, [*KEYS, "commit"], "left_semi").drop("commit")


def publish_mart(rows: DataFrame, root: str, mart: str, name: str) -> bool:
    """A report table: the runs in ``rows`` replace what was published for them; other runs stay."""
    return commit(rows, root, f"mart_{mart}", name, "replace", ())


def retire(runs: DataFrame, root: str, table: str, name: str, n: int = RETENTION) -> bool:
    """Drop all runs of a table but each client's newest ``n``, whatever their state; their data stays until it is vacuumed."""
    spark = runs.sparkSession
    entries = manifest(spark, root, table)
    if not entries.where(F.col("commit") == name).isEmpty():
        return False
    gone = live(entries).select(*KEYS).distinct().join(kept_runs(runs, n).select("client", F.col("run_id").cast("long").alias("run_id")), [*KEYS], "left_anti")
    seq = (entries.agg(F.max("seq")).first()[0] or 0) + 1
    told = gone.select("client", "run_id", F.lit(name).alias("commit"), F.lit(seq).cast("long").alias("seq"), F.lit("drop").alias("op"), F.lit(0).cast("long").alias("n_rows"))
    told.coalesce(1).write.mode("append").parquet(f"{root}/{table}/manifest")
    return True
