"""Series in files: reading them onto a grid, runs as directories, exports, telemetry capture."""

from __future__ import annotations

import datetime
import json
import urllib.parse
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.checks import check
from ..operators.routing import class_coverage
from ..operators.summary import fill_gaps
from ..plans.model import model_hash, outputs, topology

LONG = "run_id string, scenario_id long, series_id string, class_id string, bin long, value double"


class SeriesError(ValueError):
    pass


def resolve(uri: str, base: str) -> str:
    """A file: reference relative to the model's directory; other schemes are refused."""
    if not uri.startswith("file:"):
        raise SeriesError(f"{uri}: only file: references are read")
    path = uri.removeprefix("file:").removeprefix("//")
    return path if path.startswith("/") else f"{base.rstrip('/')}/{path}"


HEADERS = ("bin_index,value", "bin_index,classid,value")
_NUMBER = r"^[+-]?(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(Infinity|\u221e)$"


def _plain(path):
    """A path or URI as a path: no scheme, one slash at its start."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "^[A-Za-z0-9]+:/+", "/")


def _index(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(n, p.rstrip("/")) for n, p in paths.items()], "name string, path string").select("name", F.regexp_replace("path", "^[A-Za-z0-9]+:/+", "/").alias("path"))


def parse_files(files: DataFrame, bins: int | None = None) -> DataFrame:
    """Rows (name, line, bin, class_id, value, error) of files (name, content) bin_index[,classId],value. A grid has 10 000 bins at
    most, so a file is one row of text; its first line must be a header, and every other one that is not blank a bin and a
    value (blank or NaN is NaN). error says what is wrong: header, row, bin, range or value; the row stays."""
    lines = F.split("content", "\r?\n")
    head = F.lower(F.trim(F.regexp_replace(lines[0], "^\ufeff", "")))
    known = files.select("name", head.alias("_head"), F.posexplode_outer(F.slice(lines, 2, 1 << 30)).alias("_i", "_line"))
    known = known.where(~head_ok(F.col("_head")) | (F.trim(F.coalesce("_line", F.lit(""))) != ""))
    known = known.withColumns({"_c": F.split("_line", ",", -1), "_classed": F.col("_head") == HEADERS[1]})
    shape = F.when(F.col("_classed"), F.size("_c") >= 3).otherwise(F.size("_c") == 2)
    number = F.trim(F.element_at("_c", -1))
    bin_ = F.when(F.trim(F.col("_c")[0]).rlike(r"^[+-]?\d{1,9}$"), F.trim(F.col("_c")[0]).try_cast("long"))
    blank = (number == "") | (F.lower(number) == "nan")
    error = (
        F.when(~head_ok(F.col("_head")), "header").when(~shape, "row").when(bin_.isNull(), "bin").when((bin_ < 0) | (bin_ >= (bins if bins is not None else 1 << 30)), "range")
        .when(~blank & ~number.rlike(_NUMBER), "value")
    )
    value = F.when(blank, F.lit(float("nan"))).otherwise(F.regexp_replace(F.regexp_replace(number, ",", ""), "\u221e", "Infinity").try_cast("double"))
    # The first row of a file without a header stands for all of it.
    rows = known.where(head_ok(F.col("_head")) | F.col("_i").isNull() | (F.col("_i") == 0))
    return rows.select("name", (F.coalesce("_i", F.lit(-1)) + 2).alias("line"), bin_.alias("bin"), F.when(F.col("_classed"), F.trim(F.col("_c")[1])).alias("class_id"), value.alias("value"), error.alias("error"))


def head_ok(head):
    return head.isin(*HEADERS)


def read_all(spark: SparkSession, paths: dict[str, str], bins: int | None = None) -> DataFrame:
    """parse_files() of all the named files (or folders of files) in one read; names come by a join with the files' own paths."""
    text = spark.read.text(list(paths.values()), wholetext=True).select(F.col("value").alias("content"), _plain(F.col("_metadata.file_path")).alias("_file"))
    keyed = text.withColumn("path", F.explode(F.array("_file", F.regexp_replace("_file", "/[^/]*$", ""))))
    # A file without a byte gives no row; its text is empty.
    return parse_files(_index(spark, paths).join(keyed, "path", "left").select("name", F.coalesce("content", F.lit("")).alias("content")), bins)


def _strict(rows: DataFrame, paths: dict[str, str]) -> DataFrame:
    """rows without their errors; raises for the first of them, or for a bin that occurs twice."""
    bad = rows.where("error is not null").sort("name", "line").first()
    if bad:
        raise SeriesError(f"{paths.get(bad.name, bad.name)}, line {bad.line}: {bad.error} is not as it must be (bin {bad.bin})")
    twice = rows.groupBy("name", "bin", "class_id").count().where("count > 1").sort("name", "bin").first()
    if twice:
        raise SeriesError(f"{paths.get(twice.name, twice.name)}: bin {twice.bin} occurs twice")
    return rows.select("name", "bin", "class_id", "value")


def _on_grid(spark: SparkSession, paths: dict[str, str], bins: int) -> DataFrame:
    """Files side by side on a grid of `bins`: bins that are absent are 0; anything malformed is an error."""
    rows = _strict(read_all(spark, paths, bins).withColumn("class_id", F.lit(None).cast("string")), paths)
    side = rows.groupBy("bin").pivot("name", list(paths)).agg(F.first("value"))
    return spark.range(bins).select(F.col("id").alias("bin")).join(side, "bin", "left").select("bin", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in paths])


def read_series(spark: SparkSession, path: str, bins: int) -> DataFrame:
    """One file on a grid: (bin, value)."""
    return _on_grid(spark, {"value": path}, bins)


def read_roles(spark: SparkSession, roles: dict[str, str | None], bins: int, parallelism: float | None = None) -> DataFrame:
    """A node's role series side by side, in one read; failures default to errors. A role without a file (a constraint that
    names none) is NaN throughout; parallelism counts only where it is a positive number, else it is null."""
    files = {r: p for r, p in roles.items() if p}
    out = _on_grid(spark, files, bins) if files else spark.range(bins).select(F.col("id").alias("bin"))
    out = out.withColumns({r: F.lit(float("nan")) for r, p in roles.items() if not p} or {})
    if parallelism is not None:
        out = out.withColumn("parallelism", F.lit(float(parallelism) if 0 < parallelism < float("inf") else None).cast("double"))
    if "failures" not in out.columns and "errors" in out.columns:
        out = out.withColumn("failures", F.col("errors"))
    return out


def read_ordered(spark: SparkSession, path: str, bins: int) -> DataFrame:
    """Telemetry t,value: the values of a file in order of t are the bins, and as many as those."""
    rows = spark.read.schema("t long, value double").option("header", True).csv(path).withColumn("_file", F.input_file_name())
    wrong = rows.groupBy("_file").count().where(F.col("count") != bins).first()
    if wrong or not rows.take(1):
        raise SeriesError(f"{path}: {wrong['count'] if wrong else 0} rows for {bins} bins")
    at = F.row_number().over(W.partitionBy("_file").orderBy("t")) - 1
    return rows.select(at.cast("long").alias("bin"), "value")


def _is_number(text: str) -> bool:
    try:
        int(text)
    except ValueError:
        return False
    return True


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """A series as people paste it: tabs or commas, with or without a header, thousands separators; bins 0..n-1 once each."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    head = lines.limit(1).first()
    if head is None:
        raise SeriesError(f"{path} is empty")
    sep = "\t" if head.value.count("\t") > head.value.count(",") else ","
    cells = F.split("value", sep, 2)
    rows = lines.select(cells[0].alias("b"), cells[1].alias("v")).select(F.expr("try_cast(trim(b) as long)").alias("bin"), F.expr("try_cast(regexp_replace(trim(v), '[, \"]', '') as double)").alias("value"))
    # A first line whose bin is no number is a header; on any other line that is an error.
    odd = rows.where("bin is null")
    if odd.count() > (0 if rows.where("bin is not null").isEmpty() or _is_number(head.value.split(sep)[0]) else 1):
        raise SeriesError(f"{path}: a line without a bin")
    rows = rows.where("bin is not null")
    got = rows.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.count("*").alias("n"), F.count_distinct("bin").alias("d")).first()
    if not got.n or got.lo != 0 or got.hi != got.n - 1 or got.d != got.n:
        raise SeriesError(f"{path}: bins are not 0..n-1, once each")
    return rows


# --- runs -------------------------------------------------------------------------------------------------------------


def kind_of(name: str) -> str:
    """What a measure is, by its name: stock, ratio, time or flow."""
    n = name.lower()
    for kind, parts in (("stock", ("queue", "backlog", "depth", "wip")), ("ratio", ("util", "ratio", "efficiency", "rate")), ("time", ("latency", "time", "ms", "minutes"))):
        if any(p in n for p in parts):
            return kind
    return "flow"


#: Bins and scenarios whose digests one row gathers.
RANGE = 1024


def digests(rows: DataFrame) -> DataFrame:
    """A Merkle digest (SHA-256) of each series (scenario_id, series_id, class_id, bin, value): of ranges of bins, of the ranges of
    a scenario, then of RANGE scenarios, RANGE times as many, and so on. No row gathers more than RANGE parts, and the
    order within a part is that of bins or ids, so digests are the same however the rows are partitioned."""
    key = ["series_id", "class_id"]
    sha = lambda parts: F.sha2(F.array_join(parts, ",").cast("binary"), 256)
    cell = F.transform(F.array_sort(F.collect_list(F.struct("bin", "value"))), lambda x: F.concat_ws(":", x["bin"], F.coalesce(x["value"].cast("string"), F.lit("null"))))
    leaf = rows.groupBy(*key, "scenario_id", F.floor(F.col("bin") / RANGE).alias("part")).agg(F.count("*").alias("n"), sha(cell).alias("sha"))

    def up(level: DataFrame, by: list, order: str) -> DataFrame:
        parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "sha"))), lambda x: F.concat_ws(":", x[order], x["sha"]))
        return level.groupBy(*key, *by).agg(F.sum("n").alias("n"), sha(parts).alias("sha"))

    level = up(leaf, ["scenario_id"], "part")
    most = rows.agg(F.max("scenario_id")).first()[0] or 0
    while most > 0:
        level = up(level.withColumn("up", F.floor(F.col("scenario_id") / RANGE)), ["up"], "scenario_id").withColumnRenamed("up", "scenario_id")
        most //= RANGE
    return level.select(*key, F.col("n").alias("points"), F.col("sha").alias("sha256"))


def run_hash(index: DataFrame, model: dict | None) -> str:
    """The hash of a run: of its model's hash and of the digests of its series (as many as a model has), in their order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("series_id", "class_id", "sha256"))), lambda x: F.concat_ws(":", x["series_id"], x["class_id"], x["sha256"]))
    head = model_hash(model) if model else ""
    return index.agg(F.sha2(F.concat(F.lit(head + "|"), F.array_join(parts, ",")).cast("binary"), 256)).first()[0]


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, there whole or not at all: written beside its place and renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = to.getFileSystem(conf)
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(to, False)
    if not fs.rename(new, to):
        raise SeriesError(f"{path} could not be written")


def get_text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    return row.value if row else ""


def _manifest(run: str, series: Sequence[str], model: dict | None, tags: Sequence[str], **more) -> str:
    made = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return json.dumps({"run_id": run, "model_hash": model_hash(model) if model else None, "grid": (model or {}).get("grid"), "created": made, "tags": list(tags), "series": [{"id": s, "kind": kind_of(s)} for s in series], **more})


def _long(df: DataFrame, series: Sequence[str], run: str) -> DataFrame:
    long = df.unpivot(["scenario_id", "bin"], list(series), "series_id", "value").where(~F.col("series_id").startswith("__temp_"))
    parts = F.split("series_id", "@")
    return long.select(F.lit(run).alias("run_id"), "scenario_id", "series_id", F.coalesce(F.get(parts, F.lit(2)), F.lit("DEFAULT")).alias("class_id"), "bin", "value")


def write_rows(rows: DataFrame, root: str, run: str, model: dict | None = None, tags: Sequence[str] = (), series: Sequence[str] | None = None, **more) -> dict:
    """Rows (scenario_id, series_id, class_id, bin, value) as a run: Parquet and an index with a digest of each series in a folder
    of this attempt, then the manifest, which names the folder. A run is there once its manifest is; what a lost attempt
    left is never read. Gives the manifest."""
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    data = f"{root}/runs/{run}/{attempt}"
    rows.select(F.lit(run).alias("run_id"), "scenario_id", "series_id", "class_id", F.col("bin").cast("long").alias("bin"), F.col("value").cast("double").alias("value")).write.parquet(f"{data}/series")
    digests(spark.read.schema(LONG).parquet(f"{data}/series")).select(F.lit(run).alias("run_id"), "*").write.parquet(f"{data}/index")
    index = spark.read.parquet(f"{data}/index")
    names = series or [r.series_id for r in index.select("series_id").distinct().sort("series_id").collect()]  # as many as a model has
    text = _manifest(run, names, model, tags, attempt=attempt, run_hash=run_hash(index, model), **more)
    put_text(spark, f"{root}/runs/{run}/manifest.json", text)
    return json.loads(text)


def write_run(df: DataFrame, series: Sequence[str], root: str, run: str, model: dict | None = None, tags: Sequence[str] = ()) -> dict:
    """A run of a wide frame's series (of a model with outputs, those)."""
    series = outputs(model, list(series)) if model else list(series)
    return write_rows(_long(df, series, run), root, run, model, tags, series)


def write_model_run(df: DataFrame, model: dict, root: str, run: str, tags: Sequence[str] = ()) -> dict:
    """A run of an evaluated model with all that it has: totals (class DEFAULT), the classes of series that have any, and of
    each edge its flow (edge_<id>_flowVolume), by class too. The manifest says how far classes cover the series."""
    from ..plans.class_vectors import class_ids, vector
    from ..plans.run_state import edge_rows

    made = [c for c in df.columns if c not in ("scenario_id", "bin") and not c.endswith("__classes") and not c.startswith("__temp_")]
    kept, ids = outputs(model, made), class_ids(model)
    cell = lambda s, c, v: F.struct(F.lit(s).alias("series_id"), F.lit(c).alias("class_id"), v.cast("double").alias("value"))
    classed = [s for s in kept if vector(s) in df.columns]
    cells = [cell(s, "DEFAULT", F.col(s)) for s in kept] + [cell(s, c, F.col(vector(s))[i]) for s in classed for i, c in enumerate(ids)]
    rows = df.select("scenario_id", "bin", F.explode(F.array(*cells)).alias("_c")).select("scenario_id", "bin", "_c.*")
    flows = edge_rows(df, model).where("flow is not null")
    name = F.concat(F.lit("edge_"), F.regexp_replace("edge_id", "[^A-Za-z0-9_]+", "_"), F.lit("_flowVolume"))
    parts = F.map_concat(F.create_map(F.lit("DEFAULT"), F.col("flow")), F.coalesce("classes", F.create_map().cast("map<string,double>")))
    edges = flows.select("scenario_id", "bin", name.alias("series_id"), F.explode(parts).alias("class_id", "value"))
    coverage = "none" if not classed else "full" if len(classed) == len(kept) else "partial"
    return write_rows(rows.unionByName(edges), root, run, model, tags, classes=ids, class_coverage=coverage)


def read_manifest(spark: SparkSession, root: str, run: str) -> dict:
    return json.loads(get_text(spark, f"{root}/runs/{run}/manifest.json"))


def read_run(spark: SparkSession, root: str, run: str) -> DataFrame:
    """The rows of a run as its manifest has it: (run_id, scenario_id, series_id, class_id, bin, value)."""
    return spark.read.schema(LONG).parquet(f"{root}/runs/{run}/{read_manifest(spark, root, run)['attempt']}/series")


def read_index(spark: SparkSession, root: str, run: str) -> DataFrame:
    return spark.read.parquet(f"{root}/runs/{run}/{read_manifest(spark, root, run)['attempt']}/index")


def verify_run(spark: SparkSession, root: str, run: str) -> list[str]:
    """Series whose digests are not those of the index."""
    now = digests(read_run(spark, root, run)).select("series_id", "class_id", F.col("sha256").alias("now"))
    off = read_index(spark, root, run).join(now, ["series_id", "class_id"], "full").where("now is null or sha256 is null or now <> sha256")
    return sorted({r.series_id for r in off.select("series_id").collect()})


# --- run directories: a CSV file per series with JSON beside them ----------------------------------------------------------


def write_run_dir(df: DataFrame, series: Sequence[str], path: str, model: dict, warnings: Sequence[dict] = ()) -> None:
    """A run of one scenario as series/<id>.csv (bin_index,value), series/index.json, run.json and, last, manifest.json."""
    spark, grid = df.sparkSession, model["grid"]
    series = outputs(model, [s for s in series if not s.startswith("__temp_")])
    rows, staged = _long(df, series, "run"), f"{path}/_staged-{uuid.uuid4().hex}"
    lines = rows.select("series_id", F.col("bin").alias("bin_index"), "value")
    lines.repartition("series_id").sortWithinPartitions("series_id", "bin_index").write.option("header", True).partitionBy("series_id").csv(staged)
    _rename_parts(spark, staged, f"{path}/series", series)
    index = {r.series_id: r for r in digests(rows).collect()}  # a row per series
    entries = [{"id": s, "kind": kind_of(s), "path": f"series/{s}.csv", "points": index[s].points, "hash": f"sha256:{index[s].sha256}"} for s in series]
    put_text(spark, f"{path}/series/index.json", json.dumps({"schemaVersion": 1, "grid": grid, "series": entries}))
    put_text(spark, f"{path}/run.json", json.dumps({"schemaVersion": 1, "grid": grid, "series": [{"id": e["id"], "path": e["path"]} for e in entries], "warnings": list(warnings)}))
    put_text(spark, f"{path}/manifest.json", json.dumps({"schemaVersion": 1, "modelHash": f"sha256:{model_hash(model)}", "seriesHashes": {e["id"]: e["hash"] for e in entries}}))


def _rename_parts(spark: SparkSession, staged: str, to: str, series: Sequence[str]) -> None:
    """Moves each series' one part file of a partitioned write to <to>/<id>.csv; nothing is read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at(to))
    for folder in fs.listStatus(at(staged)):
        name = folder.getPath().getName()
        if name.startswith("series_id="):
            part = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            fs.delete(at(f"{to}/{urllib.parse.unquote(name[10:])}.csv"), False)
            fs.rename(part, at(f"{to}/{urllib.parse.unquote(name[10:])}.csv"))
    fs.delete(at(staged), True)


def read_run_dir(spark: SparkSession, path: str, strict: bool = True) -> tuple[dict, DataFrame]:
    """(grid, rows (series_id, bin, value)) of such a directory: the index names the series and their files, which are read at
    once and joined to it by path; bins that are absent are 0. Without strict, lines that cannot be read are left out."""
    about = json.loads(get_text(spark, f"{path}/series/index.json"))
    paths = {e["id"]: f"{path}/{e['path']}" for e in about["series"]}
    found = read_all(spark, paths, int(about["grid"]["bins"]))
    rows = _strict(found, paths) if strict else found.where("error is null").select("name", "bin", "class_id", "value")
    every = _index(spark, paths).select("name").join(spark.range(int(about["grid"]["bins"])).select(F.col("id").alias("bin")))
    return about["grid"], every.join(rows.select("name", "bin", "value"), ["name", "bin"], "left").select(F.col("name").alias("series_id"), "bin", F.coalesce("value", F.lit(0.0)).alias("value"))


def write_csv_run(df: DataFrame, series: Sequence[str], root: str, run: str, model: dict | None = None, tags: Sequence[str] = ()) -> None:
    """A run of scenario 0 as a folder of bin_index,value files per series, with index and manifest beside it."""
    series = outputs(model, list(series)) if model else list(series)
    rows, spark = _long(df.where("scenario_id = 0"), series, run), df.sparkSession
    rows.select("series_id", F.col("bin").alias("bin_index"), "value").repartition("series_id").sortWithinPartitions("series_id", "bin_index").write.mode("overwrite").option("header", True).partitionBy("series_id").csv(f"{root}/{run}/series")
    digests(rows).write.mode("overwrite").json(f"{root}/{run}/index")
    put_text(spark, f"{root}/{run}/manifest.json", _manifest(run, series, model, tags))


def read_csv_run(spark: SparkSession, root: str, run: str) -> DataFrame:
    """(series_id, class_id, bin, value) of such a folder, all its files in one read; the index names the series."""
    index = spark.read.json(f"{root}/{run}/index").select("series_id", "class_id")
    rows = spark.read.schema("bin_index long, value double, series_id string").option("header", True).csv(f"{root}/{run}/series")
    return rows.join(index, "series_id").select("series_id", "class_id", F.col("bin_index").alias("bin"), "value")


def export_rows(long: DataFrame, start: str, bin_minutes: int) -> DataFrame:
    """(time_bin, component_id, measure, value) of series ids measure@COMPONENT[@CLASS]."""
    parts = F.split("series_id", "@")
    at = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("bin") * bin_minutes).cast("int"))
    return long.select(at.alias("time_bin"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("component_id"), parts[0].alias("measure"), "value")


def export(long: DataFrame, path: str, form: str, start: str, bin_minutes: int) -> None:
    """CSV, NDJSON or Parquet with the same four columns."""
    rows = export_rows(long, start, bin_minutes)
    writer = rows.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "ndjson": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[form]()


def capture(df: DataFrame, series: str, path: str, missing: str = "zero", invalid: str = "zero") -> DataFrame:
    """Telemetry of one series under a gap policy, as bin_index,value files; gives the gaps by kind."""
    filled = fill_gaps(df.select("bin", F.col(series).alias("value")), "value", missing, invalid)
    filled.select(F.col("bin").alias("bin_index"), "value").write.mode("overwrite").option("header", True).csv(path)
    return filled.where("gap is not null").groupBy("gap").agg(F.count("*").alias("n"))


def capture_classes(classes: DataFrame, declared: Sequence[str], path: str, missing: str = "zero", invalid: str = "zero") -> DataFrame:
    """Telemetry of nodes by class (node_id, scenario_id, class_id, bin, total, value) as bin_index,classId,value files per
    node, with a manifest of how far the declared classes cover each node; gives the manifest's rows. Time goes by files, not by
    bytes: nodes are dealt to a fixed number of tasks (by size, few bytes would be one task's), a file each, and tasks put
    their files in place themselves. The manifest comes last."""
    filled, tasks = fill_gaps(classes, "value", missing, invalid), int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = filled.select("node_id", F.col("bin").alias("bin_index"), F.col("class_id").alias("classId"), "value").repartition(tasks, F.xxhash64("node_id"))  # by node_id itself, Spark may keep what AQE has made one task
    lines.write.mode("overwrite").option("header", True).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("node_id").csv(f"{path}/series")
    gaps = filled.groupBy("node_id").agg(F.count("gap").alias("gaps"))
    rows = class_coverage(filled, declared).join(gaps, "node_id").withColumn("schema_version", F.lit(2))
    rows.write.mode("overwrite").json(f"{path}/manifest")
    return classes.sparkSession.read.schema(rows.schema).json(f"{path}/manifest")


def bundle(df: DataFrame, series: Sequence[str], root: str, model: dict, missing: str = "zero") -> dict:
    """Captured telemetry of several series with the model, as a run: each series filled by policy, gaps counted per series,
    and the rules of conservation that the filled series break."""
    filled = df
    for s in series:
        filled = fill_gaps(filled, s, missing, "zero").withColumnRenamed("gap", f"_gap_{s}")
    counts = filled.agg(*[F.sum(F.col(f"_gap_{s}").isNotNull().cast("long")).alias(s) for s in series]).first().asDict()
    name = f"bundle_{model_hash(model)[:16]}"
    write_run(filled.select("scenario_id", "bin", *series), series, root, name, model, ["telemetry"])
    if topology(model, "nodes"):  # the model says which series are whose: its own rules hold for each node
        from ..plans.run_state import node_rows, warnings

        found = warnings(node_rows(filled.select("scenario_id", "bin", *series), model, internal=True)).groupBy("node_id", "code").agg(F.sum("n").alias("n"))
        broken = {f"{r.node_id}: {r.code}": r.n for r in found.collect()}  # a row per node and rule
    else:
        broken = {r.code: r.n for r in check(filled.withColumn("node_id", F.lit("bundle"))).collect()} if {"arrivals", "served"} <= set(series) else {}
    return {"run_id": name, "gaps": counts, "conservation": broken}
