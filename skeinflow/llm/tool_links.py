"""Chat formatting: link tool calls to their results, order them, check arguments, write canonical JSON.

Input is one row per call and one per result;
calls and results meet in a hash join on conversation and identifier.  A call
stands ``after`` the calls it names there; its level is one more than the
largest of theirs (a call on a cycle, or after one, gets no level).  A
conversation of at most ``LOCAL`` such links is ordered within one task; longer
ones by joins, round after round until none changes, as many as their longest
chain.  Arguments are parsed, checked against the tool's schema of required
names and types and, where it has one, its JSON schema at every depth, and
written again: keys sorted at every depth, no spaces, whole numbers without a
fraction.
The output has one row per part, so a conversation of any length is many rows
that no task has to hold together; (turn, level, call_id, part) orders them.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

from skeinflow.llm._io import Scratch, pick, ship

#: Links between the calls of a conversation up to which one task orders them all.
LOCAL = 100_000
#: Bytes of all JSON schemas together that are sent to tasks at most; more are an error.
SCHEMAS = 16 << 20
_KINDS = {str: "string", bool: "boolean", int: "integer", float: "number", dict: "object", list: "array", type(None): "null"}


def _once(pairs: list[tuple]) -> dict:
    """An object; a name that comes twice is an error."""
    if len(found := dict(pairs)) < len(pairs):
        raise ValueError("a name comes twice")
    return found


def canonical_json(text: str) -> tuple[str, str]:
    """(canonical JSON, JSON schema type) of a JSON text; one that is no JSON becomes a string of type ``malformed``.

    Whole numbers are written in digits, however they were given, other numbers
    in the shortest form of their double.  Names that come twice in an object and
    halves of surrogate pairs are malformed.
    """

    def even(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("not a JSON number")
            return int(x) if x.is_integer() else x
        if isinstance(x, list):
            return [even(y) for y in x]
        return {k: even(y) for k, y in x.items()} if isinstance(x, dict) else x

    try:
        value = even(json.loads(text, object_pairs_hook=_once))
        written = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        written.encode()
    except (ValueError, RecursionError):
        return json.dumps(text, ensure_ascii=False), "malformed"
    return written, _KINDS[type(value)]


def _same(a, b) -> bool:
    """Equal as JSON values: a number is never a boolean."""
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


def faults(value, schema: dict | bool, at: str = "") -> Iterator[str]:
    """What is wrong with a JSON value by a JSON schema, outer faults first, names in order.

    Read are type, enum, const, minimum, maximum, minLength, maxLength, minItems,
    maxItems, required, properties, additionalProperties, items, anyOf, allOf and
    not, and the schemas true and false; other words say nothing.
    """
    where = at or "arguments"
    if isinstance(schema, bool):
        if not schema:
            yield f"extra {where}"
        return
    kind = _KINDS[type(value)]
    wanted = schema.get("type")
    wanted = [wanted] if isinstance(wanted, str) else wanted
    if wanted is not None and kind not in wanted and not (kind == "integer" and "number" in wanted):
        yield f"type of {where}"
        return
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        yield f"enum of {where}"
    if "const" in schema and not _same(value, schema["const"]):
        yield f"const of {where}"
    size = value if kind in ("integer", "number") else len(value) if kind in ("string", "array") else None
    low, high = {"string": ("minLength", "maxLength"), "array": ("minItems", "maxItems")}.get(kind, ("minimum", "maximum"))
    if size is not None and not schema.get(low, size) <= size <= schema.get(high, size):
        yield f"range of {where}"
    for part in schema.get("allOf", ()):
        yield from faults(value, part, at)
    if "anyOf" in schema and all(any(faults(value, part, at)) for part in schema["anyOf"]):
        yield f"choice of {where}"
    if "not" in schema and not any(faults(value, schema["not"], at)):
        yield f"choice of {where}"
    if kind == "array" and "items" in schema:
        for i, x in enumerate(value):
            yield from faults(x, schema["items"], f"{at}[{i}]")
    if kind == "object":
        known, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
        for k in sorted(set(schema.get("required", ())) - set(value)):
            yield f"missing {at}.{k}".replace(" .", " ")
        for k in sorted(value):
            yield from faults(value[k], known.get(k, rest), f"{at}.{k}".removeprefix("."))


def _checked(schemas: dict[str, str]):
    """For ``mapInArrow``: the rows with ``nested``, the first fault of their arguments by their tool's JSON schema."""
    read = {tool: json.loads(text) for tool, text in schemas.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tools, args = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("tool", "args"))
            found = [next(faults(json.loads(a), read[t]), None) if t in read else None for t, a in zip(tools, args, strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "nested"])

    return run


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with ``args``, their arguments as one JSON text, and ``kinds``, the type of each."""
    for batch in batches:
        texts, kinds = [], []
        for pairs in batch.column(batch.schema.get_field_index("arguments")).to_pylist():
            named = {k: canonical_json("null" if v is None else v) for k, v in pairs or ()}
            texts.append("{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{named[k][0]}" for k in sorted(named)) + "}")
            kinds.append([(k, named[k][1]) for k in sorted(named)])
        columns = [*batch.columns, pa.array(texts, pa.string()), pa.array(kinds, pa.map_(pa.string(), pa.string()))]
        yield pa.record_batch(columns, names=[*batch.schema.names, "args", "kinds"])


def quoted(text) -> F.Column:
    """A JSON string; null is the JSON null."""
    text = F.col(text) if isinstance(text, str) else text
    written = F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.when(text.isNull(), F.lit("null")).otherwise(written)


def ordered(links: list[tuple[str, str]]) -> dict[str, int]:
    """The level of each call of one conversation's (call, call that it needs) that stands on no cycle and after none."""
    open_, next_ = Counter(c for c, _ in links), defaultdict(list)
    for call, needs in links:
        next_[needs].append(call)
    level = {c: 0 for c in next_ if c not in open_}
    ready = list(level)
    for needs in ready:  # grows while it is read
        for call in next_.get(needs, ()):
            open_[call] -= 1
            if not open_[call]:
                level[call] = level[needs] + 1  # calls come in order of level, so the last one needed has the largest
                ready.append(call)
    return {c: n for c, n in level.items() if c in open_}


def _ordered(kind: pa.DataType):
    """For ``mapInArrow`` over rows sorted by conversation: (conv_id, call_id, level)."""

    def rows(conv, links: list) -> pa.RecordBatch:
        found = ordered(links)
        return pa.record_batch([pa.array([conv] * len(found), kind), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int32())], names=["conv_id", "call_id", "level"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, links = None, []
        for batch in batches:
            for c, call, needs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != conv and links:
                    yield rows(conv, links)
                    links = []
                conv = c
                links.append((call, needs))
        if links:
            yield rows(conv, links)

    return run


def levels(calls: DataFrame, scratch: Scratch, local: int | None = None) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that name no known call; null on or after a cycle.

    Conversations of more than ``local`` links, ``LOCAL`` if it is null, are ordered by joins.
    """
    local = LOCAL if local is None else local
    keys = ["conv_id", "call_id"]
    known = scratch.put(calls.select(*keys).distinct(), "known")
    edges = calls.select(*keys, F.explode("after").alias("needs")).distinct()
    edges = scratch.put(edges.join(known.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi").select(*keys, "needs"), "edges")
    first = scratch.put(known.join(edges, keys, "left_anti").withColumn("level", F.lit(0)), "level0")
    large = scratch.put(edges.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > local).select("conv_id"), "large")
    small = pick(edges, large, ["conv_id"], "left_anti").select(*keys, "needs").repartition("conv_id").sortWithinPartitions("conv_id")
    out = [first, scratch.put(small.mapInArrow(_ordered(to_arrow_type(calls.schema["conv_id"].dataType)), StructType([calls.schema["conv_id"], StructField("call_id", StringType()), StructField("level", IntegerType())])), "ordered")]
    if large.limit(1).count():
        edges = scratch.put(pick(edges, large, ["conv_id"]).select(*keys, "needs"), "large-edges")
        done = scratch.put(pick(first, large, ["conv_id"]).select(*keys, "level"), "large0")
        while True:
            rest = edges.join(done.select(*keys), keys, "left_anti")
            met = done.select("conv_id", F.col("call_id").alias("needs"), "level")
            ready = rest.join(met, ["conv_id", "needs"], "left").groupBy(*keys).agg(
                F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("open")
            ).where("open = 0").select(*keys, (F.col("level") + 1).alias("level"))
            ready = scratch.put(ready, "ready")
            if ready.limit(1).count() == 0:
                break
            out.append(ready)
            done = done.union(ready)
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return known.join(found, keys, "left")


def problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``problem``: null if the arguments meet the tool's schema, else what is wrong with the first name.

    ``schemas`` has tool, required array<string>, types map<string,string>; the
    number of tools is small by nature and at most ten thousand, else an error.
    Of several schemas for a tool, the smallest by required names and then by
    types counts.  A column ``schema`` may hold a JSON schema of the arguments
    (null: none; of several the smallest text; see ``faults``), which is asked
    last; a text that is no JSON object is an error.  ``calls`` has ``args`` and
    ``kinds``, the JSON and the JSON type of each argument.
    """
    if schemas.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 tools")
    tools = schemas.groupBy("tool").agg(F.min_by(F.struct("required", "types"), F.struct("required", F.array_sort(F.map_entries("types")))).alias("s"), F.lit(True).alias("known")).select("tool", "s.*", "known")
    texts = {}
    if "schema" in schemas.columns:
        texts = {r.tool: r.text for r in schemas.where("schema is not null").groupBy("tool").agg(F.min("schema").alias("text")).collect()}
        if sum(map(len, texts.values())) > SCHEMAS:
            raise ValueError(f"more than {SCHEMAS} bytes of JSON schemas")
        if odd := sorted(t or "" for t, x in texts.items() if not isinstance(json.loads(x), dict)):
            raise ValueError(f"the schema of {odd[0]} is no object")
    if texts:
        calls = calls.mapInArrow(_checked(texts), StructType([*calls.schema.fields, StructField("nested", StringType())]))
    else:
        calls = calls.withColumn("nested", F.lit(None).cast("string"))
    joined = calls.join(F.broadcast(tools), "tool", "left")
    names = F.coalesce(F.map_keys("arguments"), F.array().cast("array<string>"))
    missing = F.array_sort(F.array_except(F.coalesce("required", F.array().cast("array<string>")), names))

    def is_wrong(k):
        wanted, found = F.element_at("types", k), F.element_at("kinds", k)
        return F.coalesce((wanted != found) & ~((wanted == "number") & (found == "integer")), F.lit(False))

    broken = F.array_sort(F.filter(names, lambda k: F.element_at("kinds", k) == "malformed"))
    wrong = F.array_sort(F.filter(names, is_wrong))
    problem = (
        F.when(F.col("known").isNull(), F.lit("unknown tool"))
        .when(F.size(broken) > 0, F.concat(F.lit("malformed "), broken[0]))
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), missing[0]))
        .when(F.size(wrong) > 0, F.concat(F.lit("type of "), wrong[0]))
        .otherwise(F.col("nested"))
    )
    return joined.withColumn("problem", problem).drop("required", "types", "known", "nested")


def _first(rows: DataFrame, order: list, keys: list[str], scratch: Scratch, tag: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with one row for each conv_id and call_id, the first by ``order``, and the others.

    Rows with a null key are all in the first table.  The first is found by
    partial aggregates, so an id may be on any number of rows.
    """
    both = " and ".join(f"{k} is not null" for k in keys)
    numbered = scratch.put(rows.withColumn("row", F.monotonically_increasing_id()), tag)
    first = numbered.where(both).groupBy(*keys).agg(F.min_by("row", F.struct(*order, "row")).alias("row"), F.count("*").alias("rows"))
    repeated = scratch.put(first.where("rows > 1").select(*keys, F.col("row").alias("kept")), f"{tag}-repeated")
    if repeated.limit(1).count() == 0:
        return numbered.drop("row"), numbered.where("false").drop("row")
    marked = numbered.join(repeated, keys, "left")
    return tuple(marked.where(c).drop("row", "kept") for c in ("kept is null or kept = row", "kept <> row"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, repeats: bool = False) -> DataFrame:
    """One row per call and per result: conv_id, turn, level, call_id, part (0 call, 1 result), status, json.

    ``calls``: conv_id, turn, call_id, tool, arguments map<string,string> of JSON
    texts, after array<string>.  ``results``: conv_id, call_id, content.  Status
    of a call is ``ok``, ``no result``, ``cycle`` or its arguments' problem; of a
    result ``ok``, or ``no call`` for one whose call is missing (turn and level
    null).  A call_id that is repeated in a conversation links once: the call
    of the smallest turn, tool and arguments, and the smallest content.  With
    ``repeats`` the other rows stay too, with status ``repeated id``, their own
    JSON, the turn of calls only and no level.  Rows
    with a null conv_id or call_id link with nothing and stay.  Empty tables
    give an empty table; extra columns are not read.
    """
    scratch = Scratch(calls.sparkSession, "links")
    keys = ["conv_id", "call_id"]
    both = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    ship(calls.sparkSession)
    named = calls.select("conv_id", "turn", "call_id", "tool", F.col("arguments").cast("map<string,string>").alias("arguments"), F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    schema = StructType([*named.schema.fields, StructField("args", StringType()), StructField("kinds", MapType(StringType(), StringType()))])
    named = named.mapInArrow(_canonical, schema)
    one, more_calls = _first(named, ["turn", "tool", "args", "after"], keys, scratch, "calls")
    said = results.select(*keys, F.col("content").cast("string").alias("content"))
    answers, more_said = _first(said, [F.col("content").isNull(), "content"], keys, scratch, "answers")
    lone, answers = answers.where(~both), answers.where(both).withColumn("answered", F.lit(True))
    level = levels(one.where(both), scratch)
    checked = problems(one, schemas).join(level, keys, "left").join(answers.select(*keys, "answered"), keys, "left")
    status = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("level").isNull() & both, F.lit("cycle"))
        .when(F.col("answered").isNull(), F.lit("no result")).otherwise(F.lit("ok"))
    )
    call_json = F.concat(
        F.lit('{"arguments":'), F.col("args"), F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("tool"), F.lit(',"type":"call"}')
    )
    result_json = F.concat(F.lit('{"content":'), quoted("content"), F.lit(',"id":'), quoted("call_id"), F.lit(',"type":"result"}'))
    placed = scratch.put(checked.select("conv_id", "turn", F.col("level").cast("int").alias("level"), "call_id", F.lit(0).alias("part"), status.alias("status"), call_json.alias("json")), "placed")
    where = placed.where(both).select(*keys, "turn", "level", F.lit(True).alias("called"))
    held = answers.join(where, keys, "left").select(*keys, "turn", "level", "content", "called").union(
        lone.join(where.where("false"), keys, "left").select(*keys, "turn", "level", "content", "called")
    )
    out = placed.union(held.select("conv_id", "turn", "level", "call_id", F.lit(1).alias("part"), F.when(F.col("called"), "ok").otherwise("no call").alias("status"), result_json.alias("json")))
    if repeats:
        for rows, turn, part, written in ((more_calls, F.col("turn"), 0, call_json), (more_said, F.lit(None).cast(calls.schema["turn"].dataType).alias("turn"), 1, result_json)):
            out = out.union(rows.select("conv_id", turn, F.lit(None).cast("int").alias("level"), "call_id", F.lit(part).alias("part"), F.lit("repeated id").alias("status"), written.alias("json")))
    return out
