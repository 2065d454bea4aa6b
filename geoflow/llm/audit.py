"""Filter interaction audit: what each filter removes for every order of the filters, by streaming with retraction.

Files arrive as available-now micro-batches. Whether a text is a copy depends on rows that come later: the state of
a text holds the least id so far and the rows that have it; texts are kept in buckets by their hash. When a smaller id arrives, the mask under which those rows
were counted is retracted and they are counted again as copies. Counters of masks by part are all that the audit needs.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.window import Window

from ..functions.tables import shared_folder
from .common import whole_text

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Words are what is between these.
BLANKS = r"[\x20\x09-\x0D]+"
#: Micro-batches that the files are dealt into.
BATCHES = 4
#: The id of rows without one: after all others.
LAST = (1 << 63) - 1
#: What a row counts for; what the state holds of a text.
COUNTED = ["part", "mask", "quality", "toxic"]
TEXT = ["a", "b", "id", *COUNTED, "n"]
ROW = "bucket long, a long, b long, id long, part string, mask int, quality int, toxic int, n long, done boolean"
CHANGE = "part string, mask int, quality int, toxic int, n long"
#: Rows of the table for each bucket of texts: the states of a bucket are read and written together.
BUCKET_ROWS = 20_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def failures(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that a text fails; E needs the other rows."""
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = (F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * upper > 3 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, id, part, mask, quality, toxic) of documents with doc_id, text and lang; a and b stand for the text."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")])
    rows = docs.select("doc_id", "lang", whole_text(docs).alias("text"))
    text = F.col("text")
    rows = rows.withColumn("words", words_of(text)).select(
        "doc_id", F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), failures(text, F.col("words")).alias("mask"),
    )
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")]
    return rows.join(marks, "doc_id", "left").select("a", "b", "id", "part", "mask", *flags)


def _counted(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    return rows.groupby(keys, sort=False)["n"].sum().reset_index()


def folded(buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of the rows of a text in one batch, those of the least id; all others are copies for good and only counted.

    So a text that a third of all rows have sends one row for each batch to its state.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            batch["n"] = 1
            least = batch.groupby(["a", "b"], sort=False)["id"].transform("min")
            copy = batch["id"] > least
            first = _counted(batch[~copy], ["a", "b", "id", *COUNTED])
            copies = _counted(batch[copy].assign(mask=batch["mask"] | COPY), COUNTED)
            copies = copies.assign(a=np.arange(len(copies)), b=0, id=LAST)
            for rows, done in ((first, False), (copies, True)):
                if len(rows):
                    yield rows.assign(bucket=rows["a"] % buckets, done=done)[["bucket", "a", "b", "id", *COUNTED, "n", "done"]]

    return fold


def packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def updated(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters that the new rows of a bucket's texts bring.

    The state holds, for each text of the bucket, the least id so far and what is counted for its rows (part, mask, labels, number).
    """
    arrived = pd.concat([*batches], ignore_index=True)
    final, arrived = arrived[arrived["done"]], arrived[~arrived["done"]]
    held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else arrived.iloc[:0][TEXT]
    both = pd.concat([held.assign(old=True), arrived[TEXT].assign(old=False)], ignore_index=True).astype({"old": bool})
    least = both.groupby(["a", "b"], sort=False)["id"].transform("min")
    late = both["id"] > least
    changes = [final]
    taken = both[late & both["old"]]  # a smaller id came: what was counted is taken back, then counted as copies
    changes += [taken.assign(n=-taken["n"]), both[late].assign(mask=both["mask"] | COPY), both[~late & ~both["old"]]]
    out = _counted(pd.concat([x[[*COUNTED, "n"]] for x in changes]), COUNTED)
    if len(arrived):
        state.update((packed(_counted(both[~late], TEXT[:-1])),))
    yield out[out["n"] != 0][["part", "mask", "quality", "toxic", "n"]]


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(part, mask, quality, toxic, n): the documents of each part by the filters that they fail, over all files at ``path``.

    The files are read as a stream of about ``batches`` available-now micro-batches. The changes of a micro-batch are summed and
    written to a folder of its number in the shared folder, which a repeated one replaces; state and progress lie there too.
    The states, about 50 bytes a distinct text, are held by the state store that the session asks for: where they are larger than
    the executors' memory, that should be the one in RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    docs = spark.read.parquet(path)
    if not {"doc_id", "text", "lang"} <= set(docs.columns):
        raise ValueError("documents need doc_id, text and lang")
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    each = -(-len(docs.inputFiles()) // batches)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", max(each, 1)).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may also name a single file
    buckets = -(-docs.count() // BUCKET_ROWS) + 1
    rows = judged(stream, labels).mapInPandas(folded(buckets), ROW)
    changes = rows.groupBy("bucket").applyInPandasWithState(updated, CHANGE, "rows binary", "append", "NoTimeout")

    def count(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0").write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    count(spark.createDataFrame([], CHANGE), -1)  # so that an empty table has counters as well
    changes.writeStream.foreachBatch(count).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(f"{CHANGE}, batch long").parquet(f"{folder}/counters")
    return found.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0")


def interactions(counted: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Everything follows from how many documents of a part fail which filters: 32 masks, whatever the number of documents.
    """
    good, bad = F.sum(F.col("quality") * F.col("n")), F.sum(F.col("toxic") * F.col("n"))
    masks = counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), good.alias("good"), bad.alias("toxic"))
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            steps.append(("".join(order), k + 1, name, before, bit))
            before |= bit
    listed = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(f).alias("filter"), F.lit(b).alias("before"), F.lit(own).alias("own")) for o, k, f, b, own in steps])
    rows = parts.withColumn("s", F.explode(listed)).select("part", "masks", "s.*")

    def total(what: str, holds) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda acc, m: acc + F.when(holds(m["mask"]), m[what]).otherwise(0))

    before, own = F.col("before"), F.col("own")
    failing = lambda m: m.bitwiseAND(own) > 0
    early = lambda m: m.bitwiseAND(before) > 0
    here = lambda m: failing(m) & ~early(m)
    rows = rows.select(
        "part", "filter_order", "step", "filter", total("n", lambda m: ~failing(m) & ~early(m)).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda m: failing(m) & early(m)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
    )
    of_filter = Window.partitionBy("part", "filter")
    return rows.withColumn("shapley", F.sum("removed").over(of_filter)).drop("filter")


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The whole audit over the Parquet files at ``path`` with doc_id, text and lang; ``labels`` has doc_id, quality and toxic.

    Null text is empty, null lang the part of the empty string. A text is a copy if a smaller id has the very same text: rows that repeat
    the least id are none, rows of null id come after all others. Of several labels of one id any 1 counts; null labels
    and rows without labels count for nothing. Further columns are not read. Of an empty table the result is empty.
    """
    return interactions(counters(spark, path, labels, batches))
