"""Readers and writers of manifests, conversations, images and logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.lang import let
from grainmill.functions.text import stem, strip

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str, some: bool = False) -> DataFrame:
    """A file of one object a line; blank lines are skipped, others must parse. With ``some`` a file without rows is an error."""
    found = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if some and found.isEmpty():
        raise ValueError(f"no records in {path}")
    return found


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines for ``.jsonl``, an array otherwise."""
    return read_json_lines(spark, path, schema) if path.endswith(".jsonl") else read_json_array(spark, path, schema)


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``id`` and ``content`` of the images below a folder; the id is the path below it with ``_`` for ``/``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = found.where(F.lower("path").rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$"))
    below = F.regexp_replace("path", r"^.*?\Q" + folder.rstrip("/") + r"\E/", "")
    return found.select("path", F.regexp_replace(F.regexp_replace(below, r"\.[^./]*$", ""), "/", "_").alias("id"), "content")


def load_records(spark: SparkSession, manifest: str | None = None, folder: str | None = None, schema: str = "id string, image string", limit: int | None = None) -> DataFrame:
    """Rows of the manifest if there is one, or the images below the folder by path; the first ``limit`` of them, in input order."""
    if manifest is None and folder is None:
        raise ValueError("neither a manifest nor a folder")
    if manifest is not None:
        found = read_manifest(spark, manifest, schema)
        return found if limit is None else with_order(found).orderBy("_ord").limit(limit).drop("_ord")
    found = scan_images(spark, folder).select("id", F.col("path").alias("image"))
    return found if limit is None else found.orderBy("image").limit(limit)


def with_order(df: DataFrame) -> DataFrame:
    """Add ``_ord``: ids ascending in input order, to be added before any shuffle."""
    return df.withColumn("_ord", F.monotonically_increasing_id())


def default_id(df: DataFrame, id_col: str = "id", image: str = "image") -> DataFrame:
    return df.withColumn(id_col, F.coalesce(F.col(id_col), stem(F.col(image))))


def is_remote(path: Column) -> Column:
    return path.rlike(r"^(https?://|data:)")


def resolve(path: Column, folder: str) -> Column:
    """Absolute and remote paths as they are, others below the folder."""
    return F.when(path.startswith("/") | is_remote(path), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))


def resolve_record(path: Column, folder: str | None = None, manifest: str | None = None) -> Column:
    """As :func:`resolve`, below the folder if there is one, else beside the manifest; without either the path stays."""
    base = folder if folder is not None else manifest.rpartition("/")[0] if manifest is not None else None
    return path if base is None else resolve(path, base)


def resolve_existing(df: DataFrame, path: str, folder: str, files: DataFrame) -> DataFrame:
    """Paths that are among the ``path`` of ``files``, or that begin with http, as they are; others below the folder."""
    here = files.select(F.col("path").alias("_file")).distinct()
    joined = df.join(here, F.col(path) == F.col("_file"), "left")
    stays = F.col("_file").isNotNull() | F.col(path).startswith("http")
    below = F.when(F.col(path).startswith("/"), F.col(path)).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), F.col(path)))
    return joined.withColumn(path, F.when(stays, F.col(path)).otherwise(below)).drop("_file")


def is_video(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(mp4|avi|mkv|mov|wmv|flv|webm|mpeg)$")


def normalize_media(df: DataFrame, image: str = "image", video: str = "video") -> DataFrame:
    """Add ``media`` (array) and ``modality``: an image beats a video, neither is text."""
    array = lambda c: F.col(c) if df.schema[c].dataType.typeName() == "array" else F.when(F.col(c).isNotNull(), F.array(c))
    return df.withColumns(
        {"modality": F.when(F.col(image).isNotNull(), "image").when(F.col(video).isNotNull(), "video").otherwise("text"), "media": F.coalesce(array(image), array(video))}
    )


def data_url(path: Column, content: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    mime = F.when(suffix == "jpg", "image/jpeg").when(suffix.isin(*IMAGE_SUFFIXES), F.concat(F.lit("image/"), suffix)).otherwise("application/octet-stream")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def answer_text(response: Column) -> Column:
    """Text of the first choice's message in a response's JSON; null if it has none.

    The content is a string, taken as it is, or an array of which the parts of type text count, stripped, by line.
    """
    def told(content: Column) -> Column:
        value = F.try_variant_get(content, "$", "string")
        parts = F.from_json(value, "array<struct<type:string,text:string>>")
        texts = F.filter(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: strip(p["text"])), lambda t: t != "")
        return F.when(F.schema_of_variant(content) == "STRING", value).otherwise(F.nullif(F.array_join(texts, "\n"), F.lit("")))

    return let(F.try_variant_get(F.try_parse_json(response), "$.choices[0].message.content", "variant"), told)


def image_statistics(raster: np.ndarray) -> tuple[float, float, float, float]:
    """Sharpness (mean absolute gradients), contrast, brightness and entropy of a luminance raster.

    The entropy is that of a density over 256 bins of [0, 255], whose sum is not one; only its rank matters.
    """
    x = raster.astype(np.float32)
    gradients = [float(np.abs(np.diff(x, axis=a)).mean()) if x.shape[a] > 1 else 0.0 for a in (0, 1)]
    density = np.histogram(x, bins=256, range=(0, 255), density=True)[0]
    density = density[density > 0]
    return sum(gradients), float(x.std()), float(x.mean()), float(-(density * np.log2(density)).sum())


def score_rasters(df: DataFrame, pixels: str = "pixels", height: str = "height", width: str = "width") -> DataFrame:
    """Add the four statistics to rows with a raster of 8-bit luminance; decoding files needs a decoder that is not part of this library."""

    @F.pandas_udf("sharpness double, contrast double, brightness double, entropy double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, h, w in batches:
            found = [image_statistics(np.frombuffer(d, np.uint8).reshape(a, b)) for d, a, b in zip(data, h, w, strict=True)]
            yield pd.DataFrame(found, columns=["sharpness", "contrast", "brightness", "entropy"])

    return df.withColumn("_s", run(pixels, height, width)).select(*df.columns, "_s.*")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_json_export(df: DataFrame, path: str, order: str) -> None:
    """One file in input order, for small exports."""
    df.orderBy(order).coalesce(1).write.json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
