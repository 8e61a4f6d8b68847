"""Whole files in a shared folder: written beside their place, then renamed, so that no reader sees half of one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.operators.relations import pattern_maps
from skeinflow.plans.tree import Node, conformance_form
from skeinflow.sources.ocel import graph_json, log_name
from skeinflow.sources.ocel_split import write_documents

#: Bytes of an uploaded log.
MOST_BYTES = 200 << 20


def _place(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def publish(spark: SparkSession, path: str, chunks: Iterable[bytes], most: int | None = None) -> str:
    """Write a file from chunks; it appears whole, or not at all if they break off or hold more than ``most`` bytes.  An earlier file is replaced."""
    fs, staged = _place(spark, f"{path}.{uuid.uuid4().hex}.uploading")
    fs.mkdirs(staged.getParent())
    done = 0
    try:
        out = fs.create(staged)
        try:
            for chunk in chunks:
                done += len(chunk)
                if most is not None and done > most:
                    raise ValueError(f"more than {most} bytes")
                out.write(bytearray(chunk))
        finally:
            out.close()
        # a rename that replaces: the old file or the new one is there at any time
        context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context.rename(fs.makeQualified(staged), fs.makeQualified(_place(spark, path)[1]), options)
    except BaseException:
        fs.delete(staged, False)
        raise
    return path


def register_log(spark: SparkSession, folder: str, name: str, chunks: Iterable[bytes], most: int = MOST_BYTES) -> str:
    """Take an uploaded log into ``folder`` under a safe name; a broken or too large upload leaves nothing."""
    return publish(spark, f"{folder}/{log_name(name)}", chunks, most)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first().value


def _json(value) -> Iterator[bytes]:
    yield json.dumps(value).encode()


def write_graph(spark: SparkSession, folder: str, name: str, edges: dict[tuple[str, str], int]) -> str:
    """The graph of a log as a JSON file; at most activities squared edges."""
    return publish(spark, f"{folder}/{name}.json", [graph_json(edges).encode()])


def write_conformance(relations: DataFrame, patterns: DataFrame, tree: Node, folder: str, name: str) -> dict[str, str]:
    """The files that conformance checking takes, by what they hold: ``log`` (a folder of documents), ``patterns`` and ``tree``.

    The log keeps links to its own objects alone, and its type lists are taken
    from the data, without declared attributes; see ``write_documents``.
    """
    spark = relations.sparkSession
    events = relations.groupBy(F.col("eid").alias("id")).agg(F.min("activity").alias("type"), F.min("ts").alias("time"))
    objects = relations.groupBy(F.col("oid").alias("id")).agg(F.min("otype").alias("type"))
    links = relations.select(F.col("eid").alias("event_id"), F.col("oid").alias("object_id"), F.lit("").alias("qualifier"))
    log = f"{folder}/{name}-log"
    write_documents(events, objects, links, log)
    maps = pattern_maps(patterns)
    form = conformance_form(tree, maps)
    return {
        "log": log,
        "patterns": publish(spark, f"{folder}/{name}-patterns.json", _json(maps)),
        "tree": publish(spark, f"{folder}/{name}-tree.json", _json(form)),
    }


def read_patterns(spark: SparkSession, path: str) -> dict[str, dict[str, list[str]]]:
    return json.loads(read_text(spark, path))


def read_conformance_tree(spark: SparkSession, path: str) -> tuple[Node, dict[str, dict[str, list[str]]]]:
    """The tree and the patterns of its leaves, as ``conformance_form`` took them; an open flower is a leaf there, so its activities are gone."""
    kinds = {"Loop": "redo", "Concurrency": "parallel", "ExclusiveChoice": "exclusive", "Sequence": "sequence"}
    names = {"related": "relational", "divergent": "divergent", "convergent": "convergent", "deficient": "deficient"}
    found: dict[str, dict[str, list[str]]] = {v: {} for v in names.values()}

    def node(form: dict) -> Node:
        if "operator" in form:
            return Node(kinds[form["operator"]], [node(c) for c in form["children"]])
        if form["activity"] is None:
            return Node("tau")
        for key, kind in names.items():
            found[kind][form["activity"]] = form[key]
        return Node(form["activity"])

    return node(json.loads(read_text(spark, path))), found
