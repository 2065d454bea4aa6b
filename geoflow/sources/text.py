"""Readers of text files with points: CSV, OBJ and PLY. Ids follow the order of lines inside each file.

``parts`` reads each folder of part files as one file (see ``file_of``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import gapless_rank
from ..functions.tables import stored


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line): lines of all files, and the split of which file each was read from."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def file_of(parts: bool) -> Column:
    """The file that a line counts to.

    With ``parts`` a folder stands for one file, which its part files make up one after the other by name, as the
    writers in ``sinks`` leave them.
    """
    return F.regexp_replace("path", "/[^/]*$", "") if parts else F.col("path")


def with_ids(rows: DataFrame, name: str, parts: bool = False) -> DataFrame:
    """``rows`` of ``numbered_lines``, still as they were read (without a join, a shuffle or a sort), numbered from 0 in each file.

    A task reads a split from its start to its end, so that the rows need no sorting: they are counted as they come, stored, and the
    number of a file's rows in earlier splits is added. Only one row for each split is put in order and given to all tasks.
    """
    here = stored(rows.withColumn("__id", F.monotonically_increasing_id()))
    splits = here.groupBy("path", "block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")).withColumn("file", file_of(parts))
    before = Window.partitionBy("file").orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "block", "file", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return here.join(F.broadcast(splits), ["path", "block"]).withColumn(name, F.col("__id") + F.col("__shift")).drop("path", "block", "__id", "__shift")


def read_points_csv(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(file, point_id, x, y, z): the first three numbers of each line; lines without them are skipped."""
    words = F.split(F.trim(F.translate("line", ",", " ")), r"\s+")
    rows = numbered_lines(spark, path).select("path", "block", *[F.get(words, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate("xyz")])
    return with_ids(rows.dropna(subset=["x", "y", "z"]), "point_id", parts).select("file", "point_id", "x", "y", "z")


def _elements(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, block, line, t): OBJ lines whose first word is ``kind``, and their words.

    Other lines go before any is split. The words are made by ``explode``, of one row each, as filters on a plain column would split each line again.
    """
    trimmed = F.trim("line")
    rows = numbered_lines(spark, path).filter(trimmed.startswith(kind) & F.substring(trimmed, len(kind) + 1, 1).isin("", *" \t\n\x0b\f\r"))
    return rows.select("path", "block", "line", F.explode(F.array(F.split(trimmed, r"\s+"))).alias("t"))


def read_obj_vertices(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(file, point_id, x, y, z); a bad coordinate and those after it are 0."""
    number = [F.get("t", F.lit(i + 1)).try_cast("double") for i in range(3)]
    good = [F.coalesce(F.when(sum((n.isNull().cast("int") for n in number[:i]), F.lit(0)) == 0, number[i]), F.lit(0.0)) for i in range(3)]
    points = _elements(spark, path, "v").select("path", "block", *[g.alias(c) for g, c in zip(good, "xyz", strict=True)])
    return with_ids(points, "point_id", parts).select("file", "point_id", "x", "y", "z")


def read_obj_faces(spark: SparkSession, path: str, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Faces (file, face_id, v0, v1, v2) and bad face lines (file, line). Faces have exactly three corners numbered from 1."""
    corner = [(F.substring_index(F.get("t", F.lit(i + 1)), "/", 1).try_cast("long") - 1).alias(f"v{i}") for i in range(3)]
    right = (F.size("t") == 4) & F.coalesce(F.least(*[F.coalesce(F.col(f"v{i}"), F.lit(-1)) for i in range(3)]) >= 0, F.lit(False))
    faces = _elements(spark, path, "f").select("path", "block", "line", "t", *corner)
    sound, bad = faces.filter(right).select("path", "block", "v0", "v1", "v2"), faces.filter(~right)
    return with_ids(sound, "face_id", parts).select("file", "face_id", "v0", "v1", "v2"), bad.select(file_of(parts).alias("file"), "line")


def read_obj(spark: SparkSession, path: str, parts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, faces and bad face lines, as ``read_obj_vertices`` and ``read_obj_faces`` give them."""
    return read_obj_vertices(spark, path, parts), *read_obj_faces(spark, path, parts)


def read_obj_colours(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(file, point_id, x, y, z, red, green, blue) of OBJ vertices; colours are null unless every vertex of the file has them.

    Colours over 1 are taken as bytes, for the whole file; results lie in 0 to 1. Lines with fewer than three numbers go.
    """
    names = ("x", "y", "z", "red", "green", "blue")
    rows = _elements(spark, path, "v").select("path", "block", *[F.get("t", F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)]).dropna(subset=names[:3])
    whole = F.count_if(F.col("red").isNull() | F.col("green").isNull() | F.col("blue").isNull()) == 0
    rows = with_ids(rows, "point_id", parts)
    files = rows.groupBy("file").agg(whole.alias("__all"), F.max(F.greatest("red", "green", "blue")).alias("__most"))
    rows = rows.join(files, "file")
    scale = F.when(F.col("__most") > 1, 255.0).otherwise(1.0)
    colours = [F.when(F.col("__all"), F.least(F.greatest(F.col(n) / scale, F.lit(0.0)), F.lit(1.0))).alias(n) for n in names[3:]]
    return rows.select("file", "point_id", *names[:3], *colours)


def read_ply(spark: SparkSession, path: str, columns: tuple[str, ...] = ("x", "y", "z"), parts: bool = False) -> DataFrame:
    """(file, point_id, *columns) of ASCII PLY vertices; a property that a file lacks is null, rows too short are dropped.

    Only header lines of a file meet in one task; list properties and comments are passed over. Files that are
    not ASCII PLY have no rows.
    """
    lines = with_ids(numbered_lines(spark, path).withColumn("line", F.trim("line")), "nth", parts)
    ends = lines.filter("line = 'end_header'").groupBy("file").agg(F.min("nth").alias("end"))

    def header(rows: pd.DataFrame) -> pd.DataFrame:
        names, count, inside = [], 0, False
        at = rows.sort_values("nth")["line"].tolist()
        for word in map(str.split, at):
            if word[:1] == ["element"]:
                inside = word[1] == "vertex"
                count = int(word[2]) if inside else count
            elif word[:1] == ["property"] and inside and len(word) >= 3 and word[1] != "list":
                names.append(word[2])
        sound = at[0] == "ply" and "ascii" in at[1]
        return pd.DataFrame({"file": [rows["file"].iat[0]], "end": [rows["end"].iat[0]], "n": [count if sound else 0], "names": [names]})

    heads = lines.join(ends, "file").filter("nth < end").groupBy("file").applyInPandas(header, "file string, end long, n long, names array<string>")
    body = lines.join(heads, "file").filter("nth > end and nth <= end + n").withColumn("t", F.split("line", r"\s+")).filter(F.size("t") >= F.size("names"))
    values = F.map_from_arrays("names", F.slice("t", F.lit(1), F.size("names")))
    rows = body.select("file", "nth", *[F.try_element_at(values, F.lit(c)).try_cast("double").alias(c) for c in columns])
    return gapless_rank(rows, ["file"], [F.col("nth")], "point_id").select("file", "point_id", *columns)


def read_numeric_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of CSV files with a header as doubles; cells that are missing or no numbers are NaN."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(float("nan"))).alias(c) for c in rows.columns])
