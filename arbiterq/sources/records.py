"""Record sources: JSON Lines and JSON arrays with a given schema, staged datasets, manifests, caches, vectors. Schemas are never inferred."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROW = """qid STRING, dataset STRING, dataset_family STRING, raw_idx BIGINT, raw_split STRING, question STRING, question_format STRING, options ARRAY<STRING>,
ground_truth ARRAY<STRING>, ground_truth_text STRING, ground_truth_origin STRING, ck_text STRING, ck_text_origin STRING, ck_target_answer STRING,
ck_target_matches_gt BOOLEAN, ck_relation STRING, ck_relation_is_core BOOLEAN, ck_relation_source STRING, ck_sub_type STRING, hop_count INT, source_model STRING, metadata MAP<STRING, STRING>"""
BEHAVIOUR = """qid STRING, model_key STRING, dataset STRING, pk_answer STRING, ck_answer STRING, pk_token_count INT, ck_token_count INT, pk_correct_alias BOOLEAN,
ck_correct_alias BOOLEAN, pk_correct_judge BOOLEAN, ck_correct_judge BOOLEAN, pk_judge_response STRING, ck_judge_response STRING, judge_model STRING, pk_correct BOOLEAN,
ck_correct BOOLEAN, pk_correct_source STRING, ck_correct_source STRING, seed INT, max_new_tokens INT, pk_extracted_at STRING, ck_extracted_at STRING, judge_extracted_at STRING, metadata STRUCT<ck_relation: STRING, ground_truth_text: STRING, dataset_family: STRING>"""
CACHE = "question_hash STRING, question STRING, pk_answer STRING, pk_token_count INT, model_key STRING, extracted_at STRING"
ANSWERS = "method STRING, qid STRING, backbone STRING, dataset STRING, final_answer STRING, predicted_source STRING, judge_response STRING, judge_decision BOOLEAN, raw_response STRING, filtered_doc STRING, raw_answer_response STRING, cost_usd DOUBLE, latency_sec DOUBLE, error STRING, reparsed_at STRING"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any Hadoop file system is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def jsonl(spark: SparkSession, path: str | list[str], schema: str | StructType, mode: str = "FAILFAST", missing_ok: bool = False) -> DataFrame:
    """A row a line; blank lines are skipped. mode: FAILFAST stops at a malformed line, DROPMALFORMED leaves it out."""
    if missing_ok and isinstance(path, str) and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", mode).json(path)


def tolerant(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A missing file is empty; malformed lines go."""
    return jsonl(spark, path, schema, "DROPMALFORMED", missing_ok=True)


def json_records(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A file that is one JSON array, or JSON Lines; told apart by its first character that isn't blank."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    lines = head is None or not head["value"].lstrip().startswith("[")
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", not lines).json(path)


#: Rows of a path and some numbers that may be sent to every task (some 20 MB).
MOST_SENT = 100_000


def sent(few: DataFrame) -> DataFrame:
    """A side of a join that is broadcast if a count allows it."""
    return F.broadcast(few) if few.limit(MOST_SENT + 1).count() <= MOST_SENT else few


def in_file_order(df: DataFrame, name: str = "ordinal", by_time: bool = False) -> DataFrame:
    """A table read from files (not yet changed) with its rows' place from 0 by file name, block and line; by_time: older files first.

    Spark deals blocks to tasks by size, so the order of partitions is not that of files. A block is read by one task in order: its rows
    are counted, the blocks (a row each) are added up in their order, and no row moves.
    """
    meta = df.select("*", F.struct(*((F.col("_metadata.file_modification_time").alias("time"),) if by_time else ()), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")).alias("__block"))
    own = meta.withColumn("__id", F.monotonically_increasing_id())
    blocks = own.groupBy("__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(sent(blocks.select(F.col("__block").alias("__b"), "__first", before.alias("__before"))), F.col("__block") == F.col("__b")).withColumn(name, F.col("__before") + F.col("__id") - F.col("__first")).drop("__id", "__block", "__b", "__first", "__before")


def staged(spark: SparkSession, folder: str, splits: tuple[str, ...] = (), schema: str | StructType | None = None) -> DataFrame:
    """A dataset staged as Parquet files named by split (test.parquet, dev-00000-of-00002.parquet): its rows with raw_split and raw_idx, their
    place over all splits, in the order given or else that of the names."""
    read = spark.read.schema(schema) if schema else spark.read
    df = read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(folder)
    own = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    own = own.withColumn("raw_split", F.regexp_extract(F.col("__path"), r"([A-Za-z]\w*?)(?:-\d+-of-\d+)?\.parquet$", 1))
    if splits:
        own = own.where(F.col("raw_split").isin(*splits))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, splits)), F.col("raw_split")), F.lit(0)) if splits else F.lit(0)
    files = own.groupBy("__path", "raw_split").agg(F.count("*").alias("__n"))  # a row a file
    before = F.coalesce(F.sum("__n").over(Window.orderBy(rank, "raw_split", "__path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = files.select(F.col("__path").alias("__p"), before.alias("__before"))
    return own.join(sent(offsets), F.col("__path") == F.col("__p")).withColumn("raw_idx", F.col("__before") + F.col("__row")).drop("__path", "__p", "__row", "__before")


def numbered(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """``df`` with its rows' place from 0 in the order of its partitions: counts by partition, then an offset each; no row leaves its partition."""
    own = df.withColumn("__id", F.monotonically_increasing_id())
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    own = own.withColumn("__part", part).withColumn("__at", at)
    sizes = own.groupBy("__part").agg(F.max("__at").alias("__last"))
    before = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum(F.col("__last") + 1).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return own.join(sent(before), F.col("__part") == F.col("__p")).withColumn(name, F.col("__before") + F.col("__at")).drop("__id", "__part", "__at", "__p", "__before")  # a row a partition


def head(df: DataFrame, n: int) -> DataFrame:
    """The first n records of a table read from files, in file order. Files are counted by name, twice as many at a time, until they hold n rows; the
    others are not read."""
    files = sorted(p.replace("file:///", "file:/", 1) if p.startswith("file:///") else p for p in df.inputFiles())  # names only, as the metadata has them
    path, at, have, step = F.col("_metadata.file_path"), 0, 0, 1
    while at < len(files) and have < n:
        have += df.where(path.isin(files[at : at + step])).count()
        at, step = at + step, step * 2
    own = df.where(path.isin(files[:at])) if at < len(files) else df
    return in_file_order(own, "__ordinal").where(F.col("__ordinal") < n).drop("__ordinal")


def row_range(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Records [start, end) of a table read from files, in file order; an open end is null."""
    out = in_file_order(df, "__ordinal")
    if start is not None:
        out = out.where(F.col("__ordinal") >= start)
    if end is not None:
        out = out.where(F.col("__ordinal") < end)
    return out.drop("__ordinal")


def discovered(spark: SparkSession, folder: str, schema: str | StructType, glob: str = "*.jsonl", leave_out: str = r"_judge\.jsonl$") -> DataFrame:
    """All record files of a folder but those whose name matches ``leave_out``, with the file's stem as ``dataset``."""
    df = spark.read.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").json(folder)
    named = df.withColumn("__file", F.col("_metadata.file_name")).where(~F.col("__file").rlike(leave_out))
    return named.withColumn("dataset", F.regexp_extract("__file", r"^(.*?)(?:\.[^.]*)?$", 1)).drop("__file")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, qid, split) of a nested split manifest."""
    part = "MAP<STRING, STRUCT<train: ARRAY<STRING>, val: ARRAY<STRING>, test: ARRAY<STRING>>>"
    raw = spark.read.schema(f"name STRING, partition {part}").option("multiLine", True).json(path)
    return unpivoted(raw.select(F.explode("partition").alias("dataset", "lists")))


def unpivoted(df: DataFrame) -> DataFrame:
    """(dataset, lists {train, val, test}) to a row an id."""
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("split"), F.col(f"lists.{s}").alias("qids")) for s in ("train", "val", "test"))))
    return df.select("dataset", sides.alias("x")).select("dataset", "x.split", F.explode("x.qids").alias("qid")).select("dataset", "qid", "split")


def answer_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache; of repeated keys the last line counts, later files after earlier ones. A missing cache is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], CACHE)
    rows = in_file_order(jsonl(spark, path, CACHE), by_time=True)
    rest = [c for c in rows.columns if c not in ("question_hash", "ordinal")]
    last = rows.groupBy("question_hash").agg(F.max_by(F.struct(*rest), "ordinal").alias("r"))
    return last.select("question_hash", *(f"r.{c}" for c in rest))


def layer(spark: SparkSession, canonical: str, shards: str | None, at: int) -> DataFrame:
    """Vectors of one layer (files partitioned by ``layer``): the canonical table, then shards for the qids that it lacks."""
    if not exists(spark, canonical):
        raise FileNotFoundError(canonical)
    return layer_of(spark.read.parquet(canonical), spark.read.parquet(shards) if shards and exists(spark, shards) else None, at)


def layer_of(canonical: DataFrame, shards: DataFrame | None, at: int) -> DataFrame:
    """One layer (from 1) of (qid, layer, ...): a row a qid, of the canonical table if that has it."""
    out = canonical.where(F.col("layer") == at).withColumn("rank", F.lit(0))
    if shards is not None:
        out = out.unionByName(shards.where(F.col("layer") == at).withColumn("rank", F.lit(1)))
    rest = [c for c in out.columns if c not in ("qid", "rank")]
    return out.groupBy("qid").agg(F.min_by(F.struct(*rest), "rank").alias("r")).select("qid", *(f"r.{c}" for c in rest))


def matrix(spark: SparkSession, npy: str, meta: str, schema: str, name: str = "h") -> DataFrame:
    """A one-off import of a dense matrix (.npy, rows by columns) and its row-aligned records; their lengths must agree. The result is to be
    written as Parquet. The file's path is a URI that pyarrow's file systems reach from every executor; each task reads the rows it needs."""
    import numpy as np
    from pyarrow import fs

    uri = npy if "://" in npy else f"file://{npy}"

    def opened():
        files, path = fs.FileSystem.from_uri(uri)
        return files.open_input_file(path)

    with opened() as f:
        version = np.lib.format.read_magic(f)
        shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        began = f.tell()
    if by_column or len(shape) != 2:
        raise ValueError("a matrix in row order is needed")
    records = in_file_order(jsonl(spark, meta, schema))
    if (n := records.count()) != shape[0]:
        raise ValueError(f"{shape[0]} vectors and {n} records")

    def attach(parts):
        width = shape[1] * kind.itemsize
        with opened() as f:
            for p in parts:
                at = p["ordinal"].to_numpy()
                runs = np.split(at, np.flatnonzero(np.diff(at) != 1) + 1) if len(at) else []  # neighbours are one read
                x = [np.frombuffer(f.read_at(len(r) * width, began + int(r[0]) * width), kind).reshape(len(r), -1) for r in runs]
                yield p.assign(**{name: [v.tolist() for r in x for v in r.astype("float32")]})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)
    return records.mapInPandas(attach, f"{kinds}, {name} array<float>").drop("ordinal")


def templates(text: str) -> dict:
    """Prompt templates: name to (system, user), from JSON, or from YAML where its library is installed."""
    try:
        own = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        own = yaml.safe_load(text)
    return {k: ("", v) if isinstance(v, str) else tuple(v) for k, v in own.items()}
