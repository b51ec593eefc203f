"""Real-user web vitals: landed beacons to samples, 75th percentiles and one field audit per URL.

``start`` is the stream; every other function is plain columns and runs on batches too. The percentile is exact, the nearest
rank over all samples of a (URL, metric). What the stream keeps for it are counts by value, which merge: a micro-batch adds the
counts of its samples to those of the key buckets that it touches and reads no sample again. Every batch writes new versions of
its buckets and, last, the list of each bucket's newest version ("heads"); readers follow a list, so a batch that fails leaves
what they see, and one that runs again replaces its own folders with the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.vitals import dominant

METRICS = ("LCP", "INP", "CLS", "TTFB")
RATINGS = ("good", "needs-improvement", "poor")
MIN_SAMPLES, QUANTILE, MAX_PAYLOAD = 5, 0.75, 50
SAMPLE = "struct<url:string,metric:string,value:double,rating:string,navigationType:string,attribution:string>"

# What attribution each metric carries; all but the names in TEXT are numbers.
ATTRIBUTION = {
    "LCP": ("target", "url", "timeToFirstByte", "resourceLoadDelay", "resourceLoadDuration", "elementRenderDelay"),
    "INP": ("interactionTarget", "interactionType", "inputDelay", "processingDuration", "presentationDelay", "longestScriptUrl", "longestScriptDuration"),
    "CLS": ("largestShiftTarget", "largestShiftValue", "largestShiftTime", "loadState"),
    "TTFB": ("waitingDuration", "cacheDuration", "dnsDuration", "connectionDuration", "requestDuration"),
}
TEXT = frozenset(("target", "url", "interactionTarget", "interactionType", "longestScriptUrl", "largestShiftTarget", "loadState"))


def valid_sample(s: Column) -> Column:
    finite = s["value"].isNotNull() & ~F.isnan(s["value"]) & (s["value"] >= 0) & (s["value"] < float("inf"))
    return F.coalesce(F.try_parse_url(s["url"], F.lit("HOST")).isNotNull() & s["metric"].isin(*METRICS) & finite & s["rating"].isin(*RATINGS), F.lit(False))


def validate(beacons: DataFrame, payload: str = "payload") -> DataFrame:
    """beacons with samples (array) and accepted: one bad sample, none or over fifty of them reject the payload."""
    out = beacons.withColumn("samples", F.from_json(payload, f"array<{SAMPLE}>", {"mode": "PERMISSIVE"}))
    ok = F.col("samples").isNotNull() & F.size("samples").between(1, MAX_PAYLOAD) & F.forall("samples", valid_sample)
    return out.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def allowed_origin(beacons: DataFrame, origins: DataFrame, origin: str = "origin") -> DataFrame:
    """Beacons from a client's own origins; a client without a list takes all. origins: client, origin."""
    listed = origins.select("client").distinct().withColumn("has_list", F.lit(True))
    own = origins.select("client", F.col("origin").alias(origin)).distinct().withColumn("own", F.lit(True))
    out = beacons.join(listed, "client", "left").join(own, ["client", origin], "left")
    return out.where(F.col("has_list").isNull() | F.col("own").isNotNull()).drop("has_list", "own")


def samples(validated: DataFrame, received_at: Column | None = None) -> DataFrame:
    """One row per accepted sample."""
    at = F.current_timestamp() if received_at is None else received_at
    rows = validated.where("accepted").select("client", at.alias("received_at"), F.explode("samples").alias("s"))
    return rows.select("client", "received_at", "s.url", "s.metric", "s.value", "s.rating", F.col("s.navigationType").alias("navigation_type"), "s.attribution")


def p75(rows: DataFrame, order: str = "seq", least: int = MIN_SAMPLES) -> DataFrame:
    """client, url, metric, n, value, attribution: the sample at rank ceil(0.75 n) of each key with ``least`` or more."""
    key = ("client", "url", "metric")
    counts = rows.where(F.col("metric").isin(*METRICS)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    placed = rows.join(counts, [*key]).withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("value", order)))
    return placed.where(F.col("place") == F.ceil(F.col("n") * QUANTILE)).drop("place", order)


def decode_attribution(metric: Column, attribution: Column) -> Column:
    """The attribution text as one struct with the fields of every metric: no number is 0, no text is null, {} is null."""
    fields = sorted({f for names in ATTRIBUTION.values() for f in names})
    own = {f: F.array(*(F.lit(m) for m, names in ATTRIBUTION.items() if f in names)) for f in fields}
    get = {f: F.get_json_object(attribution, f"$.{f}") for f in fields}
    value = lambda f: F.nullif(get[f], F.lit("")) if f in TEXT else F.coalesce(get[f].try_cast("double"), F.lit(0.0))
    made = F.struct(*(F.when(F.array_contains(own[f], metric), value(f)).alias(f) for f in fields))
    return F.when(attribution.isNotNull() & (F.regexp_replace(attribution, r"\s", "") != "{}"), made)


def field_audits(percentiles: DataFrame) -> DataFrame:
    """One audit per URL from its percentiles; URLs without LCP, INP and CLS have none.

    Where the percentiles carry attribution, the audit has that of each metric's own sample (null if it sent none) as
    ``attribution``, and the largest part of its TTFB as ``ttfb_phase``.
    """
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    made = [of("LCP", "value").alias("lcp_ms"), of("INP", "value").alias("inp_ms"), of("CLS", "value").alias("cls"), of("TTFB", "value").alias("ttfb_ms"), F.sum("n").alias("samples")]
    told = "attribution" in percentiles.columns
    if told:
        percentiles = percentiles.withColumn("_a", decode_attribution(F.col("metric"), F.col("attribution")))
        for metric, fields in ATTRIBUTION.items():
            own = F.when((F.col("metric") == metric) & F.col("_a").isNotNull(), F.struct(*(F.col(f"_a.{f}").alias(f) for f in fields)))
            made.append(F.first(own, True).alias(f"_{metric.lower()}"))
    out = percentiles.groupBy("client", "url").agg(*made).where("lcp_ms is not null or inp_ms is not null or cls is not null")
    if not told:
        return out
    phase = F.when(F.col("_ttfb").isNotNull(), dominant({f: F.col(f"_ttfb.{f}") for f in ATTRIBUTION["TTFB"]}))
    parts = [m.lower() for m in ATTRIBUTION]
    whole = F.struct(F.lit("field").alias("source"), *(F.col(f"_{m}").alias(m) for m in parts))
    return out.withColumns({"ttfb_phase": phase, "attribution": whole}).drop(*(f"_{m}" for m in parts))


def status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("client").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("url").alias("urls"))


def windowed_p75(rows: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """An addition to the exact figure: approximate percentiles by time window, with late samples dropped after ``delay``."""
    held = rows.withWatermark("received_at", delay)
    return held.groupBy(F.window("received_at", window), "client", "url", "metric").agg(F.percentile_approx("value", QUANTILE, 1000).alias("value"), F.count(F.lit(1)).alias("n"))


KEY = ("client", "url", "metric")
BUCKETS = 64
#: coarse bins a doubling of the value; a key has at most some 65,000 of them, whatever its samples
BINS = 64


def value_counts(rows: DataFrame, order: str = "seq") -> DataFrame:
    """bucket, key, value, n, attribution (of the first sample with this value, by ``order``)."""
    valid = rows.where(F.col("metric").isin(*METRICS))
    out = valid.groupBy(*KEY, "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.col(order)).alias("seq"), F.min_by("attribution", order).alias("attribution"))
    return out.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int"))


def merged_counts(counts: DataFrame) -> DataFrame:
    """Counts of several batches as one."""
    return counts.groupBy("bucket", *KEY, "value").agg(F.sum("n").alias("n"), F.min_by("attribution", "seq").alias("attribution"), F.min("seq").alias("seq")).select("bucket", *KEY, "value", "n", "seq", "attribution")


def p75_of_counts(counts: DataFrame, least: int = MIN_SAMPLES) -> DataFrame:
    """bucket, key, n, value, attribution: as ``p75``, from counts by value.

    Coarse bins of a key are ranked first and then only the values of the bin that holds the rank, so no window runs over all
    values of a key.
    """
    key = ("bucket", *KEY)
    binned = counts.withColumn("bin", F.floor(F.log2(F.col("value") + 1) * BINS))
    bins = binned.groupBy(*key, "bin").agg(F.sum("n").alias("in_bin"))
    upto = F.sum("in_bin").over(Window.partitionBy(*key).orderBy("bin"))
    placed = bins.withColumns({"upto": upto, "total": F.sum("in_bin").over(Window.partitionBy(*key))}).where(F.col("total") >= least)
    rank = F.ceil(F.col("total") * QUANTILE)
    held = placed.where((F.col("upto") >= rank) & (F.col("upto") - F.col("in_bin") < rank)).select(*key, "bin", F.col("total"), (rank - F.col("upto") + F.col("in_bin")).alias("rank"))
    inside = binned.join(held, [*key, "bin"]).withColumn("to", F.sum("n").over(Window.partitionBy(*key).orderBy("value")))
    found = inside.where((F.col("to") >= F.col("rank")) & (F.col("to") - F.col("n") < F.col("rank")))
    return found.select(*key, F.col("total").alias("n"), "value", "attribution")


def heads(spark: SparkSession, root: str, batch: int) -> dict[int, int]:
    """The newest version (a batch number) of every bucket after a batch; at most BUCKETS rows. Empty before the first batch."""
    if batch < 0:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{root}/heads/batch={batch}").collect()}


def _versions(spark: SparkSession, root: str, table: str, versions: dict[int, int], schema: str) -> DataFrame:
    """Rows of the named versions of buckets; no other folder is read."""
    if not versions:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/{table}/batch={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.option("basePath", f"{root}/{table}").schema(schema + ", batch long").parquet(*paths).drop("batch")


COUNTS = "bucket int, client string, url string, metric string, value double, n long, seq long, attribution string"
PERCENTILES = "bucket int, client string, url string, metric string, n long, value double, attribution string"


def add_batch(spark: SparkSession, root: str, number: int) -> None:
    """Bring counts and percentiles up to the samples of a batch. A batch that runs again gives the same versions."""
    before = heads(spark, root, number - 1)
    new = value_counts(spark.read.parquet(f"{root}/samples/batch={number}"))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most BUCKETS
    known = _versions(spark, root, "counts", {b: before[b] for b in touched if b in before}, COUNTS)
    columns = [c.split()[0] for c in COUNTS.split(", ")]
    merged_counts(new.select(columns).unionByName(known.select(columns))).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/counts/batch={number}")
    now = _versions(spark, root, "counts", {b: number for b in touched}, COUNTS)
    p75_of_counts(now).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/p75/batch={number}")
    # a bucket without a key of enough samples has no folder of percentiles and is listed all the same
    listed = [(b, number if b in touched else v) for b, v in sorted((before | dict.fromkeys(touched, number)).items())]
    spark.createDataFrame(listed, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{root}/heads/batch={number}")


def start(spark: SparkSession, source: str, root: str, schema: str = "client string, origin string, payload string", origins: DataFrame | None = None, files_per_batch: int = 1000, beacon_id: str | None = None, sent_at: str | None = None, delay: str = "1 hour") -> StreamingQuery:
    """Read landed beacon files and stop: samples, rejects, counts and percentiles under ``root``.

    With ``beacon_id`` and ``sent_at`` (columns of the schema) a beacon that is sent again within ``delay`` counts once.
    """
    beacons = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    if beacon_id is not None:
        beacons = beacons.withWatermark(sent_at, delay).dropDuplicatesWithinWatermark(["client", beacon_id])

    def land(batch: DataFrame, number: int) -> None:
        checked = validate(batch if origins is None else allowed_origin(batch, origins)).persist()
        samples(checked).withColumn("seq", F.xxhash64("url", "metric", "value", "received_at", "attribution")).write.mode("overwrite").parquet(f"{root}/samples/batch={number}")
        checked.where("not accepted").drop("samples", "accepted").write.mode("overwrite").parquet(f"{root}/rejects/batch={number}")
        checked.unpersist()
        add_batch(spark, root, number)

    return beacons.writeStream.foreachBatch(land).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def current_p75(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """client, url, metric, n, value, attribution after a batch: one version of every bucket."""
    newest = heads(spark, root, batch)
    rows = spark.read.schema(PERCENTILES + ", batch long").parquet(f"{root}/p75")
    pairs = spark.createDataFrame(sorted(newest.items()), "bucket int, batch long")
    return rows.join(F.broadcast(pairs), ["bucket", "batch"]).drop("bucket", "batch")  # at most BUCKETS rows, and folders are pruned by them


def last_batch(query: StreamingQuery) -> int:
    """The number of the newest batch that a query has run; -1 if none."""
    return max((p["batchId"] for p in query.recentProgress if p["numInputRows"] or p["batchId"] == 0), default=-1)
