"""Readers and writers of folders, lists, annotations and exports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGES = ("jpg", "jpeg", "png", "bmp", "webp")


def list_images(spark: SparkSession, folder: str, extensions: tuple[str, ...] = IMAGES) -> DataFrame:
    """(path, name, identity, length) of the images under a folder; identity is the parent folder's name. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    parts = F.split("path", "/")
    known = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions)
    return files.where(known).select("path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("identity"), "length")


def identity_layout(images: DataFrame) -> DataFrame:
    """Images as gallery, probe or unknown: by name ``gallery*``, by folder ``unknown``, else probe."""
    role = F.when(F.lower("identity") == "unknown", "unknown").when(F.lower("name").startswith("gallery"), "gallery").otherwise("probe")
    return images.withColumn("role", role)


def read_template_media(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="image string, template long, media long")


def read_template_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="p1 long, p2 long, label int")


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``name 10 numbers score``: (image, landmarks array of 5 points, face_score)."""
    parts = F.split(F.trim("value"), r"\s+")
    numbers = F.transform(F.slice(parts, 2, 10), lambda x: x.cast("double"))
    points = F.transform(
        F.sequence(F.lit(0), F.lit(4)), lambda i: F.array(F.element_at(numbers, 2 * i + 1), F.element_at(numbers, 2 * i + 2))
    )
    return spark.read.text(path).select(parts[0].alias("image"), points.alias("landmarks"), parts[11].cast("double").alias("face_score"))


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pairs under either column naming; a missing label is 0. A byte-order mark is no part of the first name."""
    df = spark.read.csv(path, header=True)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None))
    return df.select(
        pick("image1", "image1_path").alias("image1"),
        pick("image2", "image2_path").alias("image2"),
        F.coalesce(pick("label").cast("int"), F.lit(0)).alias("label")
    )


def match_truth(images: DataFrame, truth: DataFrame) -> DataFrame:
    """``images (path)`` with the identity of ``truth (path, identity)`` by full path, else by base name."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    full = truth.groupBy("path").agg(F.min("identity").alias("by_path"))
    names = truth.groupBy(base("path").alias("base")).agg(F.min("identity").alias("by_name"))
    joined = images.withColumn("base", base("path")).join(full, "path", "left").join(names, "base", "left")
    return joined.select(*images.columns, F.coalesce("by_path", "by_name").alias("identity"))


def sections(lines: DataFrame, header: str) -> DataFrame:
    """``lines (file, line, value)`` with the header line each belongs to, as ``section``: a running maximum within a file."""
    own = Window.partitionBy("file").orderBy("line")
    at = F.max(F.when(F.col("value").rlike(header), F.struct("line", "value"))).over(own)
    return lines.withColumn("section", at).where(~F.col("value").rlike(header) & F.col("section").isNotNull())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): whole files split by the reader of the file, blank lines left out."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).where("trim(value) <> ''")


def read_face_labels(lines: DataFrame, least: float = 0.0) -> DataFrame:
    """Sections ``# name width height`` of rows of 4, 5 or 19 numbers: boxes, landmark weights, ignored small faces.

    19 numbers are a box and five (x, y, visibility) landmarks; a landmark at -1 has weight 0. A face whose
    longer side is under ``least`` is ignored.
    """
    rows = sections(lines, r"^#")
    numbers = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    head = F.split(F.trim(F.regexp_replace("section.value", r"^#\s*", "")), r"\s+")
    rows = rows.select("file", F.col("section.line").alias("section"), "line", head.alias("head"), numbers.alias("n"))
    x1, y1, x2, y2 = (F.element_at("n", i) for i in (1, 2, 3, 4))
    point = lambda k: F.struct(
        F.element_at("n", F.lit(5 + 3 * k)).alias("x"),
        F.element_at("n", F.lit(6 + 3 * k)).alias("y"),
        F.when(F.element_at("n", F.lit(5 + 3 * k)) < 0, 0.0).otherwise(1.0).alias("weight")
    )
    marks = F.when(F.size("n") == 19, F.array(*[point(k) for k in range(5)]))
    ignore = F.greatest(x2 - x1, y2 - y1) < least
    order = Window.partitionBy("file", "section").orderBy("line")
    return rows.select(
        F.col("head")[0].alias("image"),
        F.try_element_at("head", F.lit(2)).cast("int").alias("width"),
        F.try_element_at("head", F.lit(3)).cast("int").alias("height"),
        (F.row_number().over(order) - 1).alias("box"),
        x1.alias("x1"),
        y1.alias("y1"),
        x2.alias("x2"),
        y2.alias("y2"),
        marks.alias("landmarks"),
        ignore.alias("ignore")
    )


def read_face_boxes(lines: DataFrame) -> DataFrame:
    """Lists of ``--image.jpg`` lines (or bare image paths), a count and box rows ``x y w h ...``; the last image counts too."""
    rows = sections(lines, r"(?i)(^--|\.(jpg|png)$)")
    parts = F.split(F.trim("value"), r"\s+")
    boxes = rows.where(F.size(parts) >= 4).select(
        "file",
        F.col("section.value").alias("image"),
        F.col("section.line").alias("section"),
        "line",
        F.transform(parts, lambda x: x.cast("double")).alias("n")
    )
    order = Window.partitionBy("file", "section").orderBy("line")
    n = lambda i: F.element_at("n", F.lit(i))
    return boxes.select(
        F.regexp_replace("image", "^--", "").alias("image"),
        (F.row_number().over(order) - 1).alias("box"),
        n(1).alias("x1"),
        n(2).alias("y1"),
        (n(1) + n(3)).alias("x2"),
        (n(2) + n(4)).alias("y2")
    )


COCO = "images array<struct<id long, file_name string, width long, height long>>, annotations array<struct<id long, image_id long, category_id long, bbox array<double>, area double, iscrowd int>>, categories array<struct<id long, name string>>"


def read_coco(spark: SparkSession, path: str, least_side: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Images and boxes of COCO JSON: xyxy corners, empty and small boxes left out, crowds marked ignore, classes numbered in order of category id."""
    doc = spark.read.schema(COCO).json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select("i.*")
    categories = doc.select(F.posexplode(F.array_sort(F.transform("categories", lambda c: c["id"]))).alias("class", "category_id"))
    notes = doc.select(F.explode("annotations").alias("a")).select("a.*")
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    boxes = notes.where((w >= least_side) & (h >= least_side) & (F.col("area") > 0)).join(F.broadcast(categories), "category_id")
    return images, boxes.select(
        F.col("image_id").alias("image"),
        "class",
        F.col("id").alias("gt"),
        x.alias("x1"),
        y.alias("y1"),
        (x + w).alias("x2"),
        (y + h).alias("y2"),
        (F.coalesce("iscrowd", F.lit(0)) == 1).alias("ignore")
    )


VOC = "filename string, size struct<width int, height int>, object array<struct<name string, difficult int, bndbox struct<xmin double, ymin double, xmax double, ymax double>>>"


def read_voc(spark: SparkSession, path: str, classes: list[str], least_side: float = 0.0) -> DataFrame:
    """Boxes of VOC XML, from 1-based to 0-based pixels; other classes are left out.

    Difficult objects are marked ignore, and so are those with a side under ``least_side``: WIDER's
    annotations in this form are of the class ``face`` alone, with small faces to be ignored.
    """
    doc = spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(path)
    found = doc.select("filename", F.posexplode("object").alias("gt", "o"))
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("o.name")) - 1
    return found.where(at >= 0).select(
        F.col("filename").alias("image"),
        at.cast("int").alias("class"),
        F.col("gt").cast("long").alias("gt"),
        *[(F.col(f"o.bndbox.{s}") - 1).alias(d) for s, d in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))],
        (
            (F.coalesce("o.difficult", F.lit(0)) == 1) | (
                F.least(F.col("o.bndbox.xmax") - F.col("o.bndbox.xmin"), F.col("o.bndbox.ymax") - F.col("o.bndbox.ymin")) < least_side
            )
        ).alias("ignore")
    )


def coco_results(dets: DataFrame) -> DataFrame:
    """Detections as COCO result lines: one JSON object a row."""
    body = F.struct(
        F.col("image").alias("image_id"),
        F.col("class").alias("category_id"),
        F.array("x1", "y1", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h")).alias("bbox"),
        "score"
    )
    return dets.select(F.to_json(body).alias("value"))


def csv_ready(*frames: DataFrame) -> DataFrame:
    """The union of frames under the sorted union of their columns; lists and structs as JSON."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    nested = (T.ArrayType, T.StructType, T.MapType)
    return out.select(*[F.to_json(c).alias(c) if isinstance(out.schema[c].dataType, nested) else F.col(c) for c in sorted(out.columns)])


def write_csv(path: str, *frames: DataFrame) -> None:
    csv_ready(*frames).write.csv(path, header=True, mode="overwrite")


def read_feature_files(spark: SparkSession, folder: str, glob: str = "*.bin", fill: float | None = None) -> DataFrame:
    """(path, embedding) of binary features: four 32-bit integers (rows, columns, stride, type), then float32 values.

    With ``fill`` that number is added as a last element; it tells distractors from others where they are pooled.
    """
    @F.pandas_udf("array<float>")
    def decode(content: pd.Series) -> pd.Series:
        def one(raw: bytes):
            rows, columns = np.frombuffer(raw, "<i4", 2)
            return np.frombuffer(raw, "<f4", rows * columns, offset=16)

        return content.map(one)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    embedding = decode("content")
    return files.select(
        "path", (F.concat(embedding, F.array(F.lit(fill).cast("float"))) if fill is not None else embedding).alias("embedding")
    )


def decode_float_blob(column: str):
    """Little-endian float32 vectors of a BINARY column."""
    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return decode(column)


def markdown_report(title: str, metrics: DataFrame, most: int = 1000) -> str:
    """A Markdown table of ``metrics (metric, value)``, at most ``most`` rows: a report is of an aggregate."""
    rows = metrics.limit(most).collect()
    lines = [f"| {r['metric']} | {'insufficient data' if r['value'] is None else f'{r['value']:.6g}'} |" for r in rows]
    return "\n".join([f"# {title}", "", "| metric | value |", "|-|-|", *lines, ""])


def read_face_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Folders ``event/image.txt`` of a name, a count and rows ``x y w h score``: detections by image, in file order."""
    files = spark.read.text(
        folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt"
    ).withColumn("file", F.input_file_name())
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    parts = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    rows = lines.where(
        (F.col("line") >= 2) & (F.size(F.split(F.trim("value"), r"\s+")) >= 5)
    ).select("file", F.col("line").cast("long").alias("line"), parts.alias("n"))
    n = lambda i: F.element_at("n", F.lit(i))
    path = F.split("file", "/")
    return rows.select(
        F.element_at(path, -2).alias("event"),
        F.regexp_replace(F.element_at(path, -1), r"\.txt$", "").alias("image"),
        (F.col("line") - 2).alias("det"),
        n(1).alias("x1"),
        n(2).alias("y1"),
        (n(1) + n(3)).alias("x2"),
        (n(2) + n(4)).alias("y2"),
        n(5).alias("score")
    )


def html_report(title: str, metrics: DataFrame, most: int = 1000) -> str:
    """An HTML table of ``metrics (metric, value)``, at most ``most`` rows."""
    from html import escape

    cells = [
        f"<tr><td>{escape(str(r['metric']))}</td><td>{'insufficient data' if r['value'] is None else f'{r['value']:.6g}'}</td></tr>" for r in metrics.limit(most).collect()
    ]
    return f"<!doctype html><title>{escape(title)}</title><h1>{escape(title)}</h1><table>{''.join(cells)}</table>\n"


def json_report(metrics: DataFrame, most: int = 1000) -> str:
    import json

    return json.dumps({r["metric"]: r["value"] for r in metrics.limit(most).collect()}, sort_keys=True)


LVIS = "images array<struct<id long, coco_url string, file_name string, width long, height long, neg_category_ids array<long>, not_exhaustive_category_ids array<long>>>, annotations array<struct<id long, image_id long, category_id long, bbox array<double>, area double>>, categories array<struct<id long, name string, frequency string>>"


def read_lvis(spark: SparkSession, path: str, least_side: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, boxes and categories of LVIS JSON: as ``read_coco``, and of which classes an image is known to have none or not all.

    A file is named by its last part where only its address is given; there are no crowds.
    """
    doc = spark.read.schema(LVIS).json(path, multiLine=True)
    image = doc.select(F.explode("images").alias("i")).select("i.*")
    name = F.coalesce("file_name", F.element_at(F.split("coco_url", "/"), -1))
    images = image.select("id", name.alias("file_name"), "width", "height", "neg_category_ids", "not_exhaustive_category_ids")
    ids = F.array_sort(F.transform("categories", lambda c: c["id"]))
    classes = doc.select(F.posexplode(ids).alias("class", "category_id"))
    categories = doc.select(F.explode("categories").alias("c")).select("c.*").join(
        F.broadcast(classes), F.col("id") == F.col("category_id")
    ).select("class", "category_id", "name", "frequency")
    notes = doc.select(F.explode("annotations").alias("a")).select("a.*")
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    kept = notes.where((w >= least_side) & (h >= least_side) & (F.col("area") > 0)).join(F.broadcast(classes), "category_id")
    boxes = kept.select(
        F.col("image_id").alias("image"),
        "class",
        F.col("id").alias("gt"),
        x.alias("x1"),
        y.alias("y1"),
        (x + w).alias("x2"),
        (y + h).alias("y2"),
        F.lit(False).alias("ignore")
    )
    return images, boxes, categories


def read_cityscapes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Images and boxes of street scenes in COCO's form: images without a box that counts are left out, and the city is the folder of the file."""
    images, boxes = read_coco(spark, path)
    counted = boxes.where("not ignore").select(F.col("image").alias("id")).distinct()
    parts = F.split("file_name", "/")
    return images.join(counted, "id", "left_semi").withColumn("city", F.when(F.size(parts) > 1, F.element_at(parts, -2))), boxes


def decode_images(files: DataFrame, decode, most_bytes: int = 10 << 20, most_pixels: int = 40_000_000) -> DataFrame:
    """The boundary to a decoder: ``files (path, content)`` to (path, status, height, width, channels, pixels).

    ``decode(bytes)`` gives an array of height x width x channels bytes, upright, or raises. Contents over
    ``most_bytes`` never leave the JVM. Status is ``ok``, ``empty``, ``too_large``, ``not_an_image`` or
    ``too_many_pixels``; only ``ok`` rows have the rest.
    """
    size = F.coalesce(F.length("content"), F.lit(0))
    early = F.when(size == 0, "empty").when(size > most_bytes, "too_large")
    rows = files.select("path", early.alias("status"), F.when(early.isNull(), F.col("content")).alias("content"))

    def one(path: str, status: str | None, content: bytes | None) -> tuple:
        if status is not None:
            return path, status, None, None, None, None
        try:
            image = np.asarray(decode(bytes(content)), dtype=np.uint8)
            height, width, channels = image.shape
        except Exception:  # noqa: BLE001: a decoder may raise anything at bad bytes
            return path, "not_an_image", None, None, None, None
        if height * width > most_pixels:
            return path, "too_many_pixels", None, None, None, None
        return path, "ok", height, width, channels, image.tobytes()

    def run(frames):
        for frame in frames:
            made = [one(*row) for row in frame.itertuples(index=False)]
            yield pd.DataFrame(
                made, columns=["path", "status", "height", "width", "channels", "pixels"]
            ).astype({"height": "Int32", "width": "Int32", "channels": "Int32"})

    return rows.mapInPandas(run, "path string, status string, height int, width int, channels int, pixels binary")


def verification_pairs(images: DataFrame, same: DataFrame) -> DataFrame:
    """(pair_idx, label, first, second) of interleaved ``images (idx, content)``: images 2k and 2k + 1 are pair k of ``same (pair_idx, label)``.

    Pairs without both images are left out. Pickled sets are to be turned into tables once: a pickle of
    unknown origin is a program.
    """
    side = lambda k, name: images.where(F.col("idx") % 2 == k).select(
        F.floor(F.col("idx") / 2).alias("pair_idx"), F.col("content").alias(name)
    )
    return same.select("pair_idx", "label").join(side(0, "first"), "pair_idx").join(side(1, "second"), "pair_idx")


def pdf_report(title: str, metrics: DataFrame, most: int = 1000, lines: int = 48) -> bytes:
    """A PDF of the rows of ``metrics (metric, value)``, at most ``most``, ``lines`` on a page; characters outside Latin-1 are shown as ?."""
    rows = [f"{r['metric']}: {'insufficient data' if r['value'] is None else f'{r['value']:.6g}'}" for r in metrics.limit(most).collect()]
    pages = [rows[i : i + lines] for i in range(0, len(rows), lines)] or [[]]
    safe = lambda t: t.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    ]
    for i, page in enumerate(pages):
        shown = [title, "", *page]
        text = b"BT /F1 11 Tf 14 TL 50 800 Td " + b" ".join(b"(" + safe(t) + b") Tj T*" for t in shown) + b" ET"
        objects.append(
            f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode()
        )
        objects.append(f"<< /Length {len(text)} >>\nstream\n".encode() + text + b"\nendstream")
    out, at = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        at.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{n:010d} 00000 n \n" for n in at)
    return out + f"xref\n0 {len(at) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(at) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()
