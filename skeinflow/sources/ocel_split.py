"""One large OCEL document read by many tasks, and documents written by many.

The text is read with ``}`` as line separator, so Spark's own reader splits a file
into blocks on any store, and blocks begin right after a bracket.  Whether a block
begins inside a string, and how deep, is found as a scan over blocks: every task
sums up its block for either case, and the sums are added in order of blocks.
Then elements of the top-level arrays are cut out; what is left at the ends of
blocks is put together from piece to piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinflow.sources.ocel import EVENT, LINKS, THING, TYPE, log_tables
from skeinflow.sources.scratch import keep

#: Bytes of text that are looked at together.
STEP = 1 << 20
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
ELEMENT, HEAD, MIDDLE, TAIL, SECTION = range(5)


def brackets(text: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions of the brackets outside strings, +1 or -1 for each, and whether the text ends inside a string.

    The text does not begin right after a backslash.
    """
    quote = text == 34
    if (slash := text == 92).any():
        other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(text))))  # the last character that is no backslash
        at = np.flatnonzero(quote)
        before = at - 1
        run = np.where(before >= 0, before - np.where(before >= 0, other[before], -1), 0)
        quote[at[run % 2 == 1]] = False
    within = (np.cumsum(quote) + inside) & 1
    opening, closing = (text == 123) | (text == 91), (text == 125) | (text == 93)
    at = np.flatnonzero((opening | closing) & (within == 0))
    return at, np.where(opening[at], 1, -1), int(within[-1]) if len(within) else inside


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """(file, block) and stretches of its text, which all end in a closing bracket, in order."""
    end = pa.array([""])
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts, texts = batch.column(0), batch.column(1), pc.fill_null(batch.column(2).cast(pa.string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1)
        marks = (files.dictionary_encode().indices.to_numpy(zero_copy_only=False), starts.to_numpy(zero_copy_only=False), size // STEP)
        turns = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1
        for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows], strict=True):
            lines = pa.concat_arrays([texts.slice(lo, hi - lo), end])  # joined, the last one ends in a bracket too
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "}")
            yield (files[lo].as_py(), starts[lo].as_py()), np.frombuffer(joined[0].as_buffer(), np.uint8)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, flips, delta0, delta1): whether quotes are odd, and the change of depth if the block begins outside or inside a string."""
    found: dict = {}
    for key, text in _blocks(batches):
        flips, *deltas = found.get(key, (0, 0, 0))
        ends = [0, 0]
        for begin in (0, 1):
            _, change, ends[begin] = brackets(text, begin ^ flips)
            deltas[begin] += int(change.sum())
        found[key] = (ends[0], *deltas)
    rows = [(*k, *v) for k, v in found.items()]
    yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string(), *[pa.int64()] * 4])], names=["file", "block", "flips", "delta0", "delta1"])


def _cut(begins: dict[tuple[str, int], tuple[int, int]]):
    """Elements and pieces of a task's blocks: (file, block, kind, section, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: list[tuple] = []

        def close():
            if key is not None:
                if depth >= 3:
                    out.append((*key, MIDDLE if entered else TAIL, section, b"".join(held)))
                out.append((*key, SECTION, section, None))

        for here, text in _blocks(batches):
            if here != key:
                close()
                key, held, section = here, [], None
                inside, depth = begins[here]
                entered = depth >= 3  # within an element that began before the block
            at, change, inside = brackets(text, inside)
            levels = depth + np.cumsum(change)
            raw, start = text.tobytes(), 0
            # a section opens from 1 to 2, an element runs from 2 to 3 and back
            turns = np.flatnonzero(((change == 1) & ((levels == 2) | (levels == 3))) | ((change == -1) & (levels == 2)))
            for i in turns.tolist():
                p = int(at[i])
                if change[i] == 1 and levels[i] == 2:
                    m = _KEY.search(raw, max(0, p - 1000), p) if raw[p] == 91 else None
                    section = m[1].decode() if m else ""
                elif change[i] == 1:
                    start = p
                else:
                    out.append((*key, HEAD if entered else ELEMENT, section, b"".join([*held, raw[start : p + 1]])))
                    held, entered = [], False
            depth = int(levels[-1]) if len(levels) else depth
            if depth >= 3:
                held.append(raw[start:])
            if len(out) > 2000:
                yield _rows(out)
                out.clear()
        close()
        yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    cols = [[x.decode() if isinstance(x, bytes) else x for x in (r[i] for r in out)] for i in range(5)]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file", "block", "kind", "section", "text"])


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(section, text) of every object in a top-level array of the JSON documents in the files of ``path``, one document a file."""
    lines = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    sums = lines.mapInArrow(_summed, "file string, block long, flips long, delta0 long, delta1 long").collect()  # a row for each block
    begins: dict[tuple[str, int], tuple[int, int]] = {}
    file, inside, depth = None, 0, 0
    for r in sorted(sums):
        if r.file != file:
            file, inside, depth = r.file, 0, 0
        begins[r.file, r.block] = inside, depth
        depth += r.delta1 if inside else r.delta0
        inside ^= r.flips
    made = keep(lines.mapInArrow(_cut(begins), "file string, block long, kind int, section string, text string"), "elements")
    last = made.where(F.col("kind") == SECTION).select("file", "block", "section")
    way = Window.partitionBy("file").orderBy("block")  # a row for each block
    entered = last.select("file", "block", F.last("section", True).over(way.rowsBetween(Window.unboundedPreceding, -1)).alias("entered"))
    known = made.where(F.col("kind") != SECTION).join(entered, ["file", "block"]).withColumn("section", F.coalesce("section", "entered")).drop("entered")
    pieces = known.where(F.col("kind") != ELEMENT)
    order = Window.partitionBy("file").orderBy("block", "kind")  # two rows for each block at most
    numbered = pieces.withColumn("item", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("file", "item").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "text", "section"))).alias("p"))  # the blocks of one element
    whole = joined.select(F.col("p")[0]["section"].alias("section"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return known.where(F.col("kind") == ELEMENT).select("section", "text").union(whole)


def read_large_log(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of ``read_log`` from documents of any size: a file is read by as many tasks as it has blocks.

    Events and objects are parsed once and written; their tables are read from there.
    """
    found = elements(spark, path)

    def part(section: str, kind: str) -> DataFrame:
        return found.where(F.col("section") == section).select(F.from_json("text", kind).alias("x")).select("x.*")

    kinds = [part(s, TYPE).select(F.lit(k).alias("of"), "name", "attributes") for k, s in (("event", "eventTypes"), ("object", "objectTypes"))]
    return log_tables(keep(part("events", EVENT), "events"), keep(part("objects", THING), "objects"), kinds[0].union(kinds[1]))


def write_documents(events: DataFrame, objects: DataFrame, e2o: DataFrame, path: str, rows: int = 100_000, attributes: DataFrame | None = None) -> None:
    """OCEL documents, each with about ``rows`` events and objects and the lists of all types, as text files below ``path``.

    ``attributes`` (event_id, name, value) are written with their events.  Types
    list the attributes that their events have.  Links to objects that do not
    exist are left out.
    """
    spark = events.sparkSession
    total = events.count() + objects.count()
    files = max(1, -(-total // rows))
    held = e2o.join(objects.select(F.col("id").alias("object_id")).distinct(), "object_id", "left_semi")
    links = held.groupBy(F.col("event_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("object_id").alias("objectId"), "qualifier"))).alias("relationships"))
    own = attributes if attributes is not None else spark.createDataFrame([], "event_id string, name string, value string")
    named = own.groupBy(F.col("event_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("attributes"))
    full = events.join(links, "id", "left").join(named, "id", "left").select(
        "id", "type", F.date_format(F.col("time").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("time"),
        F.coalesce("attributes", F.array().cast("array<struct<name:string,value:string>>")).alias("attributes"), F.coalesce("relationships", F.array().cast(LINKS)).alias("relationships"),
    )
    pairs = own.join(events.select(F.col("id").alias("event_id"), "type"), "event_id").groupBy("type").agg(F.array_sort(F.collect_set("name")).alias("names"))
    kinds = events.select("type").distinct().join(pairs, "type", "left").select(F.to_json(F.struct(
        F.col("type").alias("name"), F.coalesce(F.transform("names", lambda n: F.struct(n.alias("name"), F.lit("string").alias("type"))), F.array().cast("array<struct<name:string,type:string>>")).alias("attributes"))).alias("text"))
    things = objects.select("type").distinct().select(F.to_json(F.struct(F.col("type").alias("name"), F.array().cast("array<struct<name:string,type:string>>").alias("attributes"))).alias("text"))
    every, numbers = spark.range(files).select(F.col("id").cast("int").alias("file")), F.sequence(F.lit(0), F.lit(files - 1))
    parts = [
        kinds.select(F.explode(numbers).alias("file"), F.lit(0).alias("part"), "text"),  # types times documents
        things.select(F.explode(numbers).alias("file"), F.lit(1).alias("part"), "text"),
        full.select(F.pmod(F.xxhash64("id"), F.lit(files)).cast("int").alias("file"), F.lit(2).alias("part"), F.to_json(F.struct(*full.columns)).alias("text")),
        objects.select(F.pmod(F.xxhash64("id"), F.lit(files)).cast("int").alias("file"), F.lit(3).alias("part"), F.to_json(F.struct("id", "type")).alias("text")),
    ]
    lines = parts[0].select("file", "part", F.lit(1).alias("at"), "text")
    for p in parts[1:]:
        lines = lines.union(p.select("file", "part", F.lit(1), "text"))
    for i, name in enumerate(("eventTypes", "objectTypes", "events", "objects")):
        lines = lines.union(every.select("file", F.lit(i), F.lit(0), F.lit(("{" if i == 0 else "],") + f'"{name}":[')))
    lines = lines.union(every.select("file", F.lit(4), F.lit(0), F.lit("]}")))
    before = Window.partitionBy("file").orderBy("part", "at", "text")  # a document
    comma = F.when((F.col("at") == 1) & (F.lag("at").over(before) == 1), ",").otherwise("")
    dealt = lines.withColumn("value", F.concat(comma, "text")).sortWithinPartitions("file", "part", "at", "text")
    dealt.select("file", "value").write.partitionBy("file").text(path)
