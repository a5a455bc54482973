"""Sources: file trees, manifests, per-sample JSON, label lines, dimensions. All by Spark's readers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.functions.scalar import basename, extension, parent_folder, stem
from curata.session import materialize
from curata.sources.json_arrays import json_records

# File extensions of images.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")

# The manifest's columns in their order.
MANIFEST_COLUMNS = [
    "image_id", "image_path", "fruit_type", "freshness_label", "physical_fruit_id", "capture_session_id", "capture_timestamp", "camera_id", "lighting_condition", "background_type",
    "viewing_angle", "occlusion_level", "distance_category", "storage_condition", "days_since_purchase", "annotator", "annotation_confidence",
]


def file_tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, name, stem, extension, folder, length, is_image) of the files below a folder; contents only on request.
    Spark's readers leave out empty files and names that begin with a dot or underscore: ``file_listing`` has those."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    out = df.select("path", basename(F.col("path")).alias("name"), stem(F.col("path")).alias("stem"), extension(F.col("path")).alias("extension"), parent_folder(F.col("path")).alias("folder"), "length", *(["content"] if content else []))
    return out.withColumn("is_image", F.col("extension").isin(*IMAGE_EXTENSIONS))


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, extension, folder, length) of every file below a folder, empty and hidden ones too; nothing is opened.

    Folders are listed breadth first: each round deals the table of open folders over tasks, which list a folder each without descending, and the
    folders that they find are open in the next. So a deep or a large folder is no one task's work, and there are as many rounds as levels."""
    from curata.session import filesystem, qualified

    schema = "path string, length long, is_folder boolean"

    def listed(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        system, _ = filesystem(base)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = [f for f in system.get_file_info(pafs.FileSelector(folder)) if f.type in (pafs.FileType.File, pafs.FileType.Directory)]
                folders = [f.type == pafs.FileType.Directory for f in found]
                yield pa.RecordBatch.from_arrays([pa.array([f.path for f in found], pa.string()), pa.array([f.size or 0 for f in found], pa.int64()), pa.array(folders, pa.bool_())], names=["path", "length", "is_folder"])

    base = qualified(spark, root)
    tasks = spark.sparkContext.defaultParallelism * 4
    opened, files, n = spark.createDataFrame([(filesystem(base)[1],)], "path string"), None, 1
    while n:
        found = materialize(opened.repartition(min(n, tasks)).mapInArrow(listed, schema), "listing")
        here = found.filter("NOT is_folder")
        files = here if files is None else files.unionByName(here)
        opened = found.filter("is_folder").select("path")
        n = opened.count()
    return files.select("path", basename(F.col("path")).alias("name"), extension(F.col("path")).alias("extension"), parent_folder(F.col("path")).alias("folder"), "length")


def image_size(content: bytes) -> tuple[str | None, int | None, int | None]:
    """(format, width, height) from the head of a PNG, JPEG or BMP file; nulls where there is no sound one."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and content[12:16] == b"IHDR" and len(content) >= 24:
        return "png", int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    if content[:2] == b"BM" and len(content) >= 26:
        return "bmp", int.from_bytes(content[18:22], "little"), abs(int.from_bytes(content[22:26], "little", signed=True))
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 <= len(content) and content[at] == 0xFF:
        marker, length = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return "jpeg", int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 2 + length
    return None, None, None


def dataset_scan(spark: SparkSession, root: str, quality: DataFrame | None = None) -> DataFrame:
    """(path, class, split, length, sha256, format, width, height, aspect_ratio, readable, and the columns of ``quality``) of the images of a
    tree root/split/class/file. Readable is what has a sound head with a size; pixels are not decoded, so measures of
    them come in ``quality``, a table by path."""
    tree = file_tree(spark, root, content=True).filter("is_image")
    kept = "path string, class string, split string, length long, sha256 string, format string, width int, height int"

    def heads(batches):
        import pyarrow as pa

        for batch in batches:
            found = [image_size(c.as_py() or b"") for c in batch.column("content")]
            known = [batch.column(c) for c in ("path", "class", "split", "length", "sha256")]
            more = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*known, *more], names=[c.split()[0] for c in kept.split(", ")])

    split = F.element_at(F.split("path", "/"), -3)
    rows = tree.select("path", F.col("folder").alias("class"), split.alias("split"), "length", F.sha2("content", 256).alias("sha256"), "content").mapInArrow(heads, kept)
    rows = rows.withColumns({"aspect_ratio": F.coalesce(F.try_divide(F.col("width"), F.col("height")), F.lit(0.0)), "readable": F.col("format").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0)})
    return rows.join(quality, "path", "left") if quality is not None else rows


def class_folders(spark: SparkSession, root: str) -> DataFrame:
    """(path, class) of images, the class being their folder."""
    return file_tree(spark, root).filter("is_image").select("path", F.col("folder").alias("class"))


def folder_layout(paths: DataFrame, root: str) -> DataFrame:
    """One row (layout): flat, split (train/valid/test at the first level) or nested, from the paths of a tree."""
    parts = F.split(F.regexp_replace(F.col("path"), "^.*" + root.rstrip("/").split("/")[-1] + "/", ""), "/")
    df = paths.select(F.size(parts).alias("depth"), F.element_at(parts, 1).alias("top"))
    splits = F.max(F.lower("top").isin("train", "valid", "val", "test") & (F.col("depth") > 2))
    return df.agg(F.when(splits, "split").when(F.max("depth") <= 2, "flat").otherwise("nested").alias("layout"))


def hashed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, md5, length) of all files."""
    return file_tree(spark, root, content=True).select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), "length")


def manifest_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV manifest as text columns with ``row_number``, the number of the record in its file (the header is 1). Blank rows are left out,
    nulls are empty texts, a byte-order mark is accepted; columns that the file lacks are empty. Files of a folder are
    numbered each by itself; a file whose records may hold line breaks is one task's work, as they can't be told from its middle."""
    df = spark.read.option("header", "true").option("encoding", "UTF-8").option("multiLine", "true").csv(path)
    df = df.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in df.columns})
    names = df.columns
    # a multi-line file is read whole by one task, in order, so ids rise with its records; they are numbered file by file
    of = Window.partitionBy("_file").orderBy("_at")
    df = df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()}).withColumn("row_number", (F.row_number().over(of) + 1).cast("long")).drop("_file", "_at")
    df = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in names], "row_number")
    some = F.concat(*[F.trim(c) for c in names]) != ""
    missing = [c for c in (columns or MANIFEST_COLUMNS) if c not in names]
    return df.filter(some).withColumns({c: F.lit("") for c in missing}) if missing else df.filter(some)


def manifest_json(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A JSON manifest, an array of records or an object with ``records``, as text columns with ``row_number`` from 1. A large file is read by
    several tasks."""
    names = columns or MANIFEST_COLUMNS
    found = json_records(spark, path, "records")
    record = F.from_json("value", ",".join(f"`{c}` string" for c in names))
    return found.select(record.alias("r"), "row_number").select(*[F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c) for c in names], "row_number")


def manifest(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    if path.lower().endswith(".csv"):
        return manifest_csv(spark, path, columns)
    if path.lower().endswith(".json"):
        return manifest_json(spark, path, columns)
    raise ValueError(f"a manifest is .csv or .json: {path}")


SAMPLE = (
    "sample_id string, session_id string, timestamp double, image_path string, label string, predicted_label string, predicted_confidence double, "
    "tracking_id long, accepted boolean, rejection_reason string, _corrupt string"
)


def sample_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Per-sample JSON files; session files are left out, files that don't parse come with ``_corrupt``."""
    df = spark.read.schema(SAMPLE).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    return df.withColumn("file", F.col("_metadata.file_name")).filter(~F.col("file").startswith("session_"))


def diagnostics(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Diagnostics JSON files, a list or an object with ``frames``; ``record`` is the DDL of a frame."""
    return json_records(spark, path, "frames").select(F.from_json("value", record).alias("f")).select("f.*")


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(split, stem, line_no, raw) of label files at split/labels/stem.txt."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.col("_metadata.file_path"))
    parts = F.split("file", "/")
    return df.select(F.element_at(parts, -3).alias("split"), stem(F.col("file")).alias("stem"), F.posexplode(F.split("value", "\n")).alias("pos", "raw")).select("split", "stem", (F.col("pos") + 1).alias("line_no"), F.regexp_replace("raw", "\r$", "").alias("raw"))


def class_names(spark: SparkSession, text: str) -> DataFrame:
    """(class_id, name) from a data config with ``nc`` and ``names``: a list or a mapping, as JSON or in the usual YAML forms."""
    try:
        names = json.loads(text)["names"]
    except ValueError:
        names = _yaml_names(text)
    pairs = list(enumerate(names)) if isinstance(names, list) else sorted((int(k), v) for k, v in names.items())
    return spark.createDataFrame(pairs, "class_id int, name string")


def _yaml_names(text: str):
    lines = [line.split("#")[0].rstrip() for line in text.splitlines()]
    at = next(i for i, line in enumerate(lines) if line.startswith("names:"))
    inline = lines[at][len("names:") :].strip()
    if inline.startswith("["):
        return [x.strip().strip("'\"") for x in inline.strip("[]").split(",")]
    body = []
    for line in lines[at + 1 :]:
        if line and not line.startswith((" ", "-")):
            break
        if line.strip():
            body.append(line.strip())
    if body and body[0].startswith("-"):
        return [x[1:].strip().strip("'\"") for x in body]
    return {k.strip(): v.strip().strip("'\"") for k, v in (x.split(":", 1) for x in body)}


def item_dimension(spark: SparkSession, path: str) -> DataFrame:
    """(item, typical_min, typical_max, storage, fault) from a JSON object of items by name; ``fault`` names an unusable range."""
    from curata.operators.rules import range_fault

    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "map<string,struct<name:string,typical_shelf_life_days:array<int>,storage:string>>")
    df = whole.select(F.explode(items).alias("key", "v")).select(F.lower("key").alias("item"), F.col("v.typical_shelf_life_days").alias("days"), F.col("v.storage").alias("storage"))
    return df.select("item", F.get("days", F.lit(0)).alias("typical_min"), F.get("days", F.lit(1)).alias("typical_max"), "storage", range_fault(F.col("days")).alias("fault"))


def availability_dimension(spark: SparkSession, path: str) -> DataFrame:
    """(item, availability, class_id, source) from a JSON object by item; keys in lower case."""
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "map<string,struct<availability:string,class_id:string,source:string>>")
    return whole.select(F.explode(items).alias("key", "v")).select(F.lower(F.trim("key")).alias("item"), "v.*")


def frame_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A stream of frame rows from the Parquet files that appear in a folder. ``frames.frame_log`` streams raw frames."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
