"""Readers with explicit schemas."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .sinks import settle

PROBS = "struct<increase double, hold double, reduce double>"
DECISION_SCHEMA = (
    "decision_date_t string, ticker string, model_main string, inputs_hash string, "
    "prompts_sha struct<disclosure string, macro string, price string, aggregator string, fundamentals string>, "
    f"agent_outputs struct<disclosure struct<probabilities {PROBS}, rationale string, facts_cited array<string>, sentiment string>, "
    f"macro struct<probabilities {PROBS}, rationale string, facts_cited array<string>, regime_label string>, "
    f"price struct<probabilities {PROBS}, rationale string, facts_cited array<string>, momentum_state string>, "
    f"fundamentals struct<probabilities {PROBS}, rationale string, facts_cited array<string>, financial_health string>, "
    f"aggregator struct<probabilities {PROBS}, rationale string, agreement_score double>>, "
    f"final_probabilities {PROBS}, tokens struct<prompt bigint, completion bigint, cost_usd double>, "
    "latency_sec double, seq bigint"
)


def read_table(spark: SparkSession, path: str, schema: StructType | str, aliases: dict[str, Sequence[str]] | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """Read with a fixed schema; `aliases` maps a wanted name to the source names it may have."""
    df = spark.read.schema(schema).options(**options).format(fmt).load(path)
    for name, cands in (aliases or {}).items():
        found = next((c for c in cands if c in df.columns), None)
        if found is None:
            raise ValueError(f"no column for {name}: none of {list(cands)}")
        df = df.withColumnRenamed(found, name)
    return df


def parse_log(lines: DataFrame, col: str = "value", schema: str = DECISION_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(records, corrupt lines) of a JSON-lines column; blank lines are skipped, missing fields are NULL."""
    full = f"{schema}, _corrupt string"
    parsed = lines.where(F.trim(col) != "").withColumn(
        "_r", F.from_json(col, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    good = parsed.where(F.col("_r._corrupt").isNull()).select("_r.*").drop("_corrupt")
    return good, parsed.where(F.col("_r._corrupt").isNotNull()).select(F.col(col).alias("line"))


def read_decision_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_log(spark.read.text(path))


def file_name_parts(name) -> dict:
    """entity, form, date and accession from `{entity}_{form}_{date}_{accession}.txt`."""
    parts = F.split(F.regexp_replace(name, r"\.txt$", ""), "_")
    return {
        "entity": F.upper(F.get(parts, 0)), "form": F.get(parts, 1),
        "filed": F.try_to_timestamp(F.get(parts, 2), F.lit("yyyy-MM-dd")).cast("date"), "accession": F.get(parts, 3),
    }


def _arrow_uri(spark: SparkSession, path: str) -> str:
    """A path as Arrow's file systems take it, in the file system that Spark would read it from."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return f"{at.getScheme()}://{at.getAuthority() or ''}{at.getPath()}"


HIDDEN = re.compile(r"\.|_(?!.*=)|.*\._COPYING_$")  # beginnings of names that Spark's readers skip
LISTED = 10_000  # entries of a folder in a batch
LIST_PARTS, LIST_FOLDERS = 64, 1_000  # tasks that list folders, and folders of a task beyond that
TASK_FILES, TASK_BYTES, BATCH_BYTES = 10_000, 128 << 20, 8 << 20  # of a task that reads files, and of a batch of texts


def listed(spark: SparkSession, uri: str, root: str) -> DataFrame:
    """path, n_bytes and modified (milliseconds) of the files of a folder and its subfolders, written once.

    Tasks list the folders, level by level: one folder's list is in a task at a time, and none in the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = FileSystem.from_uri(uri)
        for b in batches:
            for folder in b["path"]:
                found = files.get_file_info(FileSelector(folder.as_py()))
                for i in range(0, len(found), LISTED):
                    some = [f for f in found[i:i + LISTED] if not HIDDEN.match(f.base_name) and f.type in (FileType.File, FileType.Directory)]
                    yield pa.RecordBatch.from_pydict({
                        "path": pa.array([f.path for f in some], pa.string()), "folder": pa.array([f.type == FileType.Directory for f in some], pa.bool_()),
                        "n_bytes": pa.array([f.size for f in some], pa.int64()), "modified": pa.array([f.mtime_ns // 1_000_000 for f in some], pa.int64())})

    out, folders = None, spark.createDataFrame([(root,)], "path string")
    while True:
        level = settle(folders.mapInArrow(run, "path string, folder boolean, n_bytes bigint, modified bigint"))
        out = level if out is None else out.unionByName(level)
        folders = level.where("folder").select("path")
        n = folders.count()
        if not n:
            return out.where("not folder").drop("folder")
        folders = folders.repartition(min(n, max(LIST_PARTS, -(-n // LIST_FOLDERS))))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, n_bytes, modified and text of the files of a folder and its subfolders.

    Tasks list and read them through Arrow's file systems, so that no name reaches the driver. A file system that Arrow can't
    open, and a pattern of names, go to Spark's reader, which holds the names of all files on the driver.
    """
    uri = _arrow_uri(spark, path)
    try:
        files, root = FileSystem.from_uri(uri)
        if files.get_file_info(root).type != FileType.Directory:
            raise ValueError(path)
    except (OSError, ValueError):
        df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        # Spark's paths are escaped; a plus sign is none
        return df.select(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"), F.col("_metadata.file_size").alias("n_bytes"),
                         F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = FileSystem.from_uri(uri)
        for b in batches:
            texts, size, first = [], 0, 0
            for i, at in enumerate(b["path"], 1):
                with files.open_input_stream(at.as_py()) as f:
                    texts.append(f.read())
                size += len(texts[-1])
                if size >= BATCH_BYTES or i == len(b):
                    yield pa.RecordBatch.from_arrays([*b.slice(first, i - first).columns, pa.array(texts, pa.binary())], names=[*b.schema.names, "text"])
                    texts, size, first = [], 0, i

    names = listed(spark, uri, root)
    all_ = names.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("size")).first()
    parts = max(min(all_.n, spark.sparkContext.defaultParallelism), -(-all_.n // TASK_FILES), -(-all_["size"] // TASK_BYTES), 1)
    df = names.repartition(parts).mapInArrow(run, "path string, n_bytes bigint, modified bigint, text binary")
    return df.withColumns({"modified": F.timestamp_millis("modified"), "text": F.col("text").cast("string")})


def read_documents(spark: SparkSession, path: str, unreadable: bool = False) -> DataFrame:
    """A folder (with its subfolders) of text files, one document each: whole files with size and time, names parsed.

    A document is a file of its name, or the one file in a folder of its name as Spark's writer makes it. Files whose name
    can't be parsed are dropped, or kept with `readable` false.
    """
    name = F.regexp_extract("path", r"([^/=]+?\.txt)(?:/part-[^/]*)?$", 1)
    df = whole_files(spark, path).select(name.alias("file_name"), "n_bytes", "modified", "text")
    df = df.withColumns(file_name_parts(F.col("file_name")))
    named = F.col("filed").isNotNull() & (F.col("accession") != "")
    return df.withColumn("readable", F.coalesce(named, F.lit(False))) if unreadable else df.where(named)


FOLDERS = 256  # subfolders that documents are dealt to: each is listed by a task of its own
UNSAFE = re.compile(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""")  # characters that Spark's writer escapes in names, too


def write_documents(df: DataFrame, path: str, name: str, text: str) -> None:
    """Each row's text as a file of its name, in subfolders by a hash of the name; names are unique, each text ends with a line feed.

    Tasks write the files through Arrow's file systems, each under a hidden name first, so that a repeated task leaves whole
    files only. A file system that Arrow can't open gets them from Spark's writer, as folders `file=<name>`, which takes
    several operations of its file system a document.
    """
    rows = df.select(F.col(name).alias("file"), F.coalesce(F.col(text), F.lit("")).alias("value"))
    uri = _arrow_uri(df.sparkSession, path)
    try:
        files, root = FileSystem.from_uri(uri)
        for i in range(FOLDERS):
            files.create_dir(f"{root}/part={i}")
    except (OSError, ValueError):
        rows.write.partitionBy("file").text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(uri)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            for file, value, part in zip(b["file"], b["value"], b["part"]):
                file, folder = UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", file.as_py()), f"{root}/part={part.as_py()}"
                with files.open_output_stream(f"{folder}/.{file}.{attempt}") as out:
                    out.write(value.as_py().encode())
                    out.write(b"\n")
                files.move(f"{folder}/.{file}.{attempt}", f"{folder}/{file}")
            yield pa.RecordBatch.from_pydict({"n": [len(b)]})

    dealt = rows.withColumn("part", F.crc32("file") % FOLDERS)
    dealt.mapInArrow(write, "n bigint").write.format("noop").mode("overwrite").save()


def flatten_index(df: DataFrame, arrays: dict[str, str], keep: Sequence[str], forms: Sequence[str], start: str, end: str) -> DataFrame:
    """Parallel arrays to rows (output name -> array column), keeping some forms and a date range."""
    zipped = F.arrays_zip(*[F.col(a).alias(n) for n, a in arrays.items()])
    rows = df.select(*keep, F.explode(zipped).alias("_z")).select(*keep, *[F.col(f"_z.{n}").alias(n) for n in arrays])
    return rows.where(F.col("form").isin(*forms) & F.col("filed").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def flatten_facts(df: DataFrame, facts: str, keep: Sequence[str], concepts: Sequence[str]) -> DataFrame:
    """map<concept, map<unit, array<fact>>> to rows with the position of each fact; annual facts only.

    The element position is kept because later elements win among equal filing dates.
    """
    rows = (
        df.select(*keep, F.explode(facts).alias("concept", "_units"))
        .where(F.col("concept").isin(*concepts))
        .select(*keep, "concept", F.posexplode(F.map_entries("_units")).alias("unit_pos", "_u"))
        .select(*keep, "concept", "unit_pos", F.col("_u.key").alias("unit"), F.posexplode("_u.value").alias("pos", "_f"))
        .select(*keep, "concept", "unit_pos", "unit", "pos", "_f.*")
    )
    return rows.where(F.coalesce(F.col("form").startswith("10-K"), F.lit(False)) | F.coalesce(F.col("fp") == "FY", F.lit(False)))


def union_sources(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union by name with the part's name in `tag`; absent columns become NULL."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
