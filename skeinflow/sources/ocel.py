"""Object-centric event logs in JSON, and directly-follows graphs as JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions.timestamps import parse_time

LINKS = "array<struct<objectId:string,qualifier:string>>"
TYPE = "struct<name:string,attributes:array<struct<name:string,type:string>>>"
#: Attribute values are kept as JSON texts.
EVENT = f"struct<id:string,type:string,time:string,attributes:array<struct<name:string,value:string>>,relationships:{LINKS}>"
THING = f"struct<id:string,type:string,attributes:array<struct<name:string,value:string,time:string>>,relationships:{LINKS}>"
SCHEMA = f"eventTypes array<{TYPE}>, objectTypes array<{TYPE}>, events array<{EVENT}>, objects array<{THING}>"


def log_name(name: str) -> str:
    """A safe file name: no path parts, ``.json`` or ``.jsonocel``."""
    if re.search(r"\.\.|[/\\]", name) or not re.search(r"\.(json|jsonocel)$", name):
        raise ValueError(f"not a log name: {name!r}")
    return name


def read_log(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of an OCEL 2.0 JSON log: events, objects, e2o, o2o, event_attributes, object_attributes, types.

    One JSON document is one row, so a single file is read by one task; see
    ``read_large_log`` for large ones.
    """
    log = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    kinds = [
        log.select(F.lit(k).alias("of"), F.explode(c).alias("t")).select("of", "t.name", "t.attributes")
        for k, c in (("event", "eventTypes"), ("object", "objectTypes"))
    ]
    return log_tables(log.select(F.explode("events").alias("e")).select("e.*"), log.select(F.explode("objects").alias("o")).select("o.*"), kinds[0].union(kinds[1]))


def log_tables(event: DataFrame, thing: DataFrame, kinds: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``read_log`` from events, objects and types as a document has them."""
    return {
        "events": event.select("id", "type", parse_time(F.col("time")).alias("time"), F.col("time").alias("time_text")),
        "objects": thing.select("id", "type"),
        "e2o": event.select(F.col("id").alias("event_id"), F.explode("relationships").alias("r")).select("event_id", F.col("r.objectId").alias("object_id"), "r.qualifier"),
        "o2o": thing.select(F.col("id").alias("source_id"), F.explode("relationships").alias("r")).select("source_id", F.col("r.objectId").alias("object_id"), "r.qualifier"),
        "event_attributes": event.select(F.col("id").alias("event_id"), F.explode("attributes").alias("a")).select("event_id", "a.*", value_kind("a.value")),
        "object_attributes": thing.select(F.col("id").alias("object_id"), F.explode("attributes").alias("a")).select(
            "object_id", "a.name", "a.value", parse_time(F.col("a.time")).alias("time"), value_kind("a.value")
        ),
        "types": kinds,
    }


def value_kind(column: str):
    """Kind of an attribute value: time, integer, float, boolean, string or null, tried in this order."""
    v = F.col(column)
    return (
        F.when(v.isNull(), "null").when(v.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), "time")
        .when(v.try_cast("bigint").isNotNull() & v.rlike(r"^-?\d+$"), "integer").when(v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "float")
        .when(v.isin("true", "false"), "boolean").otherwise("string").alias("kind")
    )


def write_log(events: DataFrame, objects: DataFrame, e2o: DataFrame, path: str) -> None:
    """One JSON line per event and object; links to objects that do not exist are left out, types follow from the data."""
    held = e2o.join(objects.select(F.col("id").alias("object_id")).distinct(), "object_id", "left_semi")
    links = held.groupBy(F.col("event_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("object_id").alias("objectId"), "qualifier"))).alias("relationships"))
    full = events.join(links, "id", "left").select("id", "type", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("time"), F.coalesce("relationships", F.array().cast(LINKS)).alias("relationships"))
    rows = full.select(F.to_json(F.struct("id", "type", "time", "relationships")).alias("value"), F.lit("events").alias("part"))
    rows = rows.union(objects.select(F.to_json(F.struct("id", "type")), F.lit("objects")))
    rows.write.partitionBy("part").text(path)


def read_written_log(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The inverse of ``write_log``."""
    event = spark.read.schema(f"id string, type string, time string, relationships {LINKS}").json(f"{path}/part=events")
    return {
        "events": event.select("id", "type", parse_time(F.col("time")).alias("time")),
        "objects": spark.read.schema("id string, type string").json(f"{path}/part=objects"),
        "e2o": event.select(F.col("id").alias("event_id"), F.explode("relationships").alias("r")).select("event_id", F.col("r.objectId").alias("object_id"), "r.qualifier"),
    }


def graph_json(edges: dict[tuple[str, str], int]) -> str:
    """A directly-follows graph as JSON; nodes are those on an edge."""
    nodes = sorted({x for e in edges for x in e})
    return json.dumps(
        {
            "nodes": [{"id": n, "label": n} for n in nodes],
            "edges": [{"id": f"{a}->{b}", "source": a, "target": b, "label": f"Edge {a}-{b}", "cost": c} for (a, b), c in sorted(edges.items())],
        }
    )


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, weight) of graph files; edges without a cost weigh null."""
    schema = "nodes array<struct<id:string,label:string>>, edges array<struct<id:string,source:string,target:string,label:string,cost:bigint>>"
    graph = spark.read.schema(schema).option("multiLine", True).json(path)
    return graph.select(F.explode("edges").alias("e")).select("e.source", "e.target", F.col("e.cost").alias("weight"))


def graph_edges(text: str) -> dict[tuple[str, str], int | None]:
    """Edges of a graph as JSON; those without a cost weigh None."""
    return {(e["source"], e["target"]): None if e.get("cost") is None else int(e["cost"]) for e in json.loads(text)["edges"]}


def cost_json(costs: dict[tuple[str, str], float]) -> str:
    """Keys ``a:b``; read back at the first colon, so names with a colon do not survive."""
    return json.dumps({f"{a}:{b}": c for (a, b), c in sorted(costs.items())})


def read_costs(text: str) -> dict[tuple[str, str], float]:
    return {tuple(k.split(":", 1)): float(v) for k, v in json.loads(text).items()}
