"""Manifests: JSON lines with aliases, prepared datasets with checks, delimited text, speaker annotations."""

from __future__ import annotations

import json
import re
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """JSON lines of a schema; an alias copies a column to a new name, and a name that is taken is an error."""
    rows = spark.read.schema(schema).json(path)
    taken = [new for new in (aliases or {}).values() if new in rows.columns]
    if taken:
        raise ValueError(f"alias collides with a column: {taken}")
    return rows.select("*", *[F.col(old).alias(new) for old, new in (aliases or {}).items()])


def result_files(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """The text lines of all files of that name below a folder, each with its file."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder).select("value", F.col("_metadata.file_path").alias("file"))


def with_prefix(rows: DataFrame, column: str, prefix: str, listing: DataFrame) -> DataFrame:
    """rows with prefix/ before the paths of column that exist there; listing has one row per existing path."""
    full = rows.withColumn("_full", F.concat(F.lit(prefix.rstrip("/") + "/"), F.col(column)))
    found = listing.select(F.col("path").alias("_full")).distinct().withColumn("_found", F.lit(True))
    return full.join(found, "_full", "left").withColumn(column, F.when(F.col("_found"), F.col("_full")).otherwise(F.col(column))).drop("_full", "_found")


def write_prepared(rows: DataFrame, path: str) -> dict:
    """Writes rows as a manifest and returns the digest of its content, which does not depend on the order of rows;
    `prepare` keeps the digest on disk."""
    rows.write.json(f"{path}/manifest")
    return content_digest(rows)


def content_digest(rows: DataFrame) -> dict:
    """Number of rows and a digest of them, as sums over row hashes, which combine anywhere."""
    line = F.to_json(F.struct(*sorted(rows.columns)))
    parts = [F.sum(F.conv(F.substring(F.sha2(line, 256), k, 12), 16, 10).cast("decimal(38,0)")).cast("string") for k in (1, 13, 25)]
    n, *sums = rows.agg(F.count(F.lit(1)), *parts).first()
    return {"rows": n, "digest": "-".join(map(str, sums))}


def read_prepared(spark: SparkSession, path: str, schema: str, expected: dict) -> DataFrame:
    """A prepared manifest, after a check of its content against its digest."""
    rows = spark.read.schema(schema).json(f"{path}/manifest")
    found = content_digest(rows)
    if found != expected:
        raise ValueError(f"manifest differs from its digest: {found}")
    return rows


def delimited(lines: Column, names: list[str], mark: str = "|") -> list[Column]:
    """The fields of delimited lines; the last one keeps further marks."""
    parts = F.split(lines, f"\\Q{mark}\\E", len(names))
    return [F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)]


def prompted(spark: SparkSession, lines: str, prompts: str) -> DataFrame:
    """(speaker, text, prompt_text) of files of `speaker|text` lines and of `speaker|prompt` lines; a speaker without a
    prompt has null, and of several prompts the first in order counts."""
    read = lambda path, names: spark.read.text(path).filter("trim(value) <> ''").select(*delimited(F.col("value"), names))
    one = read(prompts, ["speaker", "prompt_text"]).groupBy("speaker").agg(F.min("prompt_text").alias("prompt_text"))
    return read(lines, ["speaker", "text"]).join(one, "speaker", "left").select("speaker", "text", "prompt_text")


def rttm(lines: Column) -> Column:
    """(file, start, end, speaker) of an RTTM line; null for lines of other types."""
    f = F.split(F.trim(lines), "\\s+")
    start, length = F.get(f, F.lit(3)).try_cast("double"), F.get(f, F.lit(4)).try_cast("double")
    segment = F.struct(F.get(f, F.lit(1)).alias("file"), start.alias("start"), (start + length).alias("end"), F.get(f, F.lit(7)).alias("speaker"))
    return F.when((F.get(f, F.lit(0)) == "SPEAKER") & start.isNotNull() & length.isNotNull(), segment)


def textgrid(text: Column) -> Column:
    """(start, end, words) of the intervals of a TextGrid with anything in them."""
    rows = F.regexp_extract_all(text, F.lit(r'(?s)xmin = [0-9.]+\s+xmax = [0-9.]+\s+text = "[^"]*"'), 0)
    one = lambda r: F.struct(F.regexp_extract(r, r"xmin = ([0-9.]+)", 1).cast("double").alias("start"), F.regexp_extract(r, r"xmax = ([0-9.]+)", 1).cast("double").alias("end"), F.regexp_extract(r, r'text = "([^"]*)"', 1).alias("words"))
    return F.filter(F.transform(rows, one), lambda s: F.trim(s["words"]) != "")


def write_assets(assets: DataFrame, folder: str) -> None:
    """Writes (asset, content) as files folder/<asset>, each by the task that has its row: for assets that Spark derives; a
    dataset's own are there already. The folder must be mounted on all executors, as the one in spark.checkpoint.dir is;
    ValueError for a store that is no mounted folder."""
    root = folder.removeprefix("file://")
    if "://" in root:
        raise ValueError(f"not a mounted folder: {folder}")

    def write(rows) -> None:
        Path(root).mkdir(parents=True, exist_ok=True)
        for row in rows:
            part = Path(root) / f".{row.asset}.{uuid.uuid4().hex}"
            part.write_bytes(bytes(row.content))
            # a task that runs again puts the same file in its place
            part.replace(Path(root) / row.asset)

    assets.foreachPartition(write)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(asset, size_bytes, sha256) of the files below a folder; hidden and empty files don't count. Contents are hashed
    where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    relative = F.regexp_replace("path", "^.*?" + re.escape(folder.removeprefix("file://").rstrip("/")) + "/", "")
    return files.select(relative.alias("asset"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def prepare(rows: DataFrame, path: str, asset: str, folder: str) -> None:
    """Writes a prepared dataset: path/manifest (rows as JSON lines), path/inventory (the assets that they name, with sizes
    and digests), path/digest (of both), and, last, the marker path/complete. A row without an asset, or one that isn't
    in the folder, is an error."""
    spark = rows.sparkSession
    lacking = rows.join(inventory(spark, folder).select(F.col("asset").alias(asset)), asset, "left_anti").limit(3).select(asset).collect()
    if lacking:
        raise ValueError(f"missing assets: {[r[0] for r in lacking]}")
    rows.write.json(f"{path}/manifest")
    inventory(spark, folder).join(rows.select(F.col(asset).alias("asset")).distinct(), "asset", "left_semi").write.json(f"{path}/inventory")
    digests = {n: content_digest(spark.read.schema(s).json(f"{path}/{n}")) for n, s in (("manifest", rows.schema), ("inventory", _INVENTORY))}
    line = json.dumps({"folder": folder} | digests, sort_keys=True)
    spark.range(1).select(F.lit(line).alias("value")).write.text(f"{path}/digest")
    spark.range(1).select(F.lit("complete").alias("value")).write.text(f"{path}/complete")


_INVENTORY = "asset string, size_bytes long, sha256 string"


def read_with_assets(spark: SparkSession, path: str, schema: str, asset: str, verify: bool = True) -> DataFrame:
    """A prepared dataset's rows beside their assets' sizes and digests. ValueError without the marker, and where the
    manifest or the inventory differs from its digest on disk, or (if verify) an asset is missing, changed, or extra."""
    try:
        marker = spark.read.text(f"{path}/complete").count()
    except AnalysisException:
        marker = 0
    if not marker:
        raise ValueError(f"no complete prepared dataset: {path}")
    digest = json.loads(spark.read.text(f"{path}/digest").first()["value"])
    rows, listed = spark.read.schema(schema).json(f"{path}/manifest"), spark.read.schema(_INVENTORY).json(f"{path}/inventory")
    for name, df in (("manifest", rows), ("inventory", listed)):
        if content_digest(df) != digest[name]:
            raise ValueError(f"{name} differs from its digest")
    if verify:
        found = inventory(spark, digest["folder"]).select("asset", F.struct("size_bytes", "sha256").alias("now"))
        both = listed.select("asset", F.struct("size_bytes", "sha256").alias("then")).join(found, "asset", "full")
        wrong = both.filter(~F.col("now").eqNullSafe(F.col("then")))
        fault = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "extra").otherwise("changed")
        faults = [f"{r.fault} {r.asset}" for r in wrong.select("asset", fault.alias("fault")).orderBy("asset").limit(5).collect()]
        if faults:
            raise ValueError(f"assets differ from the inventory: {', '.join(faults)}")
    return rows.join(listed.withColumnRenamed("asset", asset), asset)
