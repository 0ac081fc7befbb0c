"""Chat formatting: tool calls are linked to their results, ordered, validated, and written as canonical JSON.

A message's text may hold marks: <tool_call>{"id", "name", "arguments"}</tool_call>, <tool_result>{"id",
"content"}</tool_result> and, in any message, <tools>[{"name", "parameters"}]</tools> with JSON schemas of the conversation's
tools. Every message gives one row for its plain text and one for each mark.

Calls and results meet in a hash join on (conversation, identifier); the first call of an identifier owns it. A result
comes after its call, and a call after the results that its arguments name as {"$ref": identifier}: rows are placed once
all before them are, so the order is topological and otherwise that of the messages. Arguments are validated against
the schema joined on (conversation, name), else against the given registry.

All is done with rows, joins and aggregations with partial sums: no conversation is gathered in one task, however long. Rows of conversations
without any mark take no part in the joins.

Defined results: null text is an empty message; null roles are "unknown"; null conversations or turns take part in no
link; repeated rows are answered each; a mark that is no valid JSON object stays a row of kind "broken" with its text; equal identifiers: the first call (turn, then
place in the text) is linked, later ones have status "repeated"; calls on a cycle of references have status "cycle";
further columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import json
import math
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import column, materialise

STEPS = 6  # along chains of references, in a job
_MARK = re.compile(r"<(tool_call|tool_result|tools)>(.*?)</\1>", re.S)

_FIELDS = [("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("kind", pa.string()), ("call_id", pa.string()), ("name", pa.string()), ("body", pa.string()), ("needs", pa.list_(pa.string()))]
SCHEMA = "conv_id long, turn long, seq long, role string, kind string, call_id string, name string, body string, needs array<string>"


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, and no escapes but the needed ones."""
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    return text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")


def _load(text: str) -> object:
    def no(name):
        raise ValueError(name)

    return json.loads(text, parse_constant=no)


def _references(value: object) -> list[str]:
    if isinstance(value, dict):
        if isinstance(value.get("$ref"), str) and len(value) == 1:
            return [value["$ref"]]
        return [r for v in value.values() for r in _references(v)]
    return [r for v in value for r in _references(v)] if isinstance(value, list) else []


def parse(role: str, text: str) -> list[tuple]:
    """(kind, call_id, name, body, needs) of a message's plain text and of each of its marks, in order."""
    out: list[tuple] = []
    plain = _MARK.sub("", text) if "<tool" in text else text
    if plain.strip() or "<tool" not in text:
        out.append(("message", None, None, plain if plain is text else plain.strip(), []))
    for m in _MARK.finditer(text) if "<tool" in text else ():
        kind, raw = m.group(1), m.group(2)
        try:
            value = _load(raw)
            if kind == "tools" and isinstance(value, list):
                out += [("schema", None, str(t["name"]), canonical(t.get("parameters", {})), []) for t in value]
                continue
            if not isinstance(value, dict) or kind == "tools":
                raise ValueError("not an object")
            name = value["id"]
            if not isinstance(name, (str, int)):
                raise ValueError("identifier")
            if kind == "tool_call":
                arguments = value.get("arguments", {})
                arguments = _load(arguments) if isinstance(arguments, str) else arguments
                out.append(("call", str(name), str(value["name"]), canonical(arguments), sorted(set(_references(arguments)))))
            else:
                out.append(("result", str(name), None, canonical(value.get("content")), []))
        except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
            out.append(("broken", None, None, raw, []))
    return out


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    return isinstance(value, _TYPES[kind]) if kind in _TYPES else True


#: Keywords that constrain values but aren't checked here; a schema that has one can't be answered for.
_UNCHECKED = ("$dynamicRef", "$recursiveRef", "additionalItems", "unevaluatedItems", "unevaluatedProperties")


def _same_key(value: object) -> object:
    """Equal for values that JSON Schema takes as equal: 1 is 1.0, but not true."""
    if isinstance(value, dict):
        return ("object", frozenset((k, _same_key(v)) for k, v in value.items()))
    return ("array", tuple(map(_same_key, value))) if isinstance(value, list) else (isinstance(value, bool), value)


def _target(root: object, ref: str) -> object:
    """What a local reference (JSON pointer) names."""
    if ref != "#" and not ref.startswith("#/"):
        raise LookupError(ref)
    for part in unquote(ref[1:]).split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        root = root[int(part)] if isinstance(root, list) and part.isdecimal() else root[part]
    return root


def problems(value: object, schema: object, at: str = "$", root: object = None, met: tuple[str, ...] = ()) -> list[str]:
    """Where a value breaks a JSON schema: all of draft 2020-12 but format and other annotations; a keyword of _UNCHECKED
    and a reference that isn't local are problems themselves. root: the whole schema; met: references followed for this value."""
    if schema is True or not isinstance(schema, dict):
        return [f"{at}: nothing is allowed"] if schema is False else []
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []  # another call's result, not known here
    root = schema if root is None else root
    deeper = lambda v, s, a: problems(v, s, a, root)
    here = lambda s: problems(value, s, at, root, met)
    unsure = lambda *found: list(dict.fromkeys(p for f in found for p in f if ": unsupported " in p))
    known = not _references(value)  # what results will bring decides no negation
    out = [f"{at}: unsupported keyword {k}" for k in _UNCHECKED if k in schema]
    if "$ref" in schema:
        ref = schema["$ref"]
        try:
            target = _target(root, ref)
            out += [f"{at}: {ref} names itself"] if ref in met else problems(value, target, at, root, (*met, ref))
        except (LookupError, ValueError, TypeError, AttributeError):
            out.append(f"{at}: unsupported $ref {ref}")
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: is not {' or '.join(kinds)}"]
    same = lambda a, b: _same_key(a) == _same_key(b)
    if "enum" in schema and not any(same(value, e) for e in schema["enum"]):
        out.append(f"{at}: is none of the enum")
    if "const" in schema and not same(value, schema["const"]):
        out.append(f"{at}: is not the constant")
    if _is(value, "number"):
        for key, fails in (("minimum", lambda b: value < b), ("maximum", lambda b: value > b), ("exclusiveMinimum", lambda b: value <= b), ("exclusiveMaximum", lambda b: value >= b), ("multipleOf", lambda b: b and math.fmod(value, b) != 0)):
            if key in schema and fails(schema[key]):
                out.append(f"{at}: {key}")
    if isinstance(value, (str, list, dict)):
        low, high = {str: ("minLength", "maxLength"), list: ("minItems", "maxItems"), dict: ("minProperties", "maxProperties")}[type(value)]
        if len(value) < schema.get(low, 0) or len(value) > schema.get(high, len(value)):
            out.append(f"{at}: {low} or {high}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: pattern")
    if isinstance(value, dict):
        named, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        out += [f"{at}.{k}: is missing" for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            fitting = [s for p, s in patterns.items() if re.search(p, k)]
            for s in ([named[k]] if k in named else []) + fitting:
                out += deeper(v, s, f"{at}.{k}")
            if k not in named and not fitting and "additionalProperties" in schema:
                out += deeper(v, schema["additionalProperties"], f"{at}.{k}")
            if "propertyNames" in schema:
                out += deeper(k, schema["propertyNames"], f"{at}.{k} (name)")
        dependent = schema.get("dependencies", {}) | schema.get("dependentRequired", {})
        for k, needs in [*dependent.items(), *schema.get("dependentSchemas", {}).items()]:
            if k in value:
                out += [f"{at}.{n}: is missing" for n in needs if n not in value] if isinstance(needs, list) else here(needs)
    if isinstance(value, list):
        each = schema.get("items", True)
        heads = each if isinstance(each, list) else schema.get("prefixItems", ())
        for i, v in enumerate(value):
            out += deeper(v, heads[i] if i < len(heads) else True if isinstance(each, list) else each, f"{at}[{i}]")
        if schema.get("uniqueItems") and len(set(map(_same_key, value))) < len(value):
            out.append(f"{at}: uniqueItems")
        if "contains" in schema:
            found = [deeper(v, schema["contains"], at) for v in value]
            out += unsure(*found)
            n = found.count([])
            if n < schema.get("minContains", 1) or known and n > schema.get("maxContains", n):
                out.append(f"{at}: contains")
    for s in schema.get("allOf", ()):
        out += here(s)
    if "if" in schema and known:
        found = here(schema["if"])
        out += unsure(found) + here(schema.get("else" if found else "then", True))
    if "not" in schema and known:
        found = here(schema["not"])
        out += unsure(found) if found else [f"{at}: not"]
    for key, good in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1 or n > 1 and not known)):
        if key in schema:
            found = [here(s) for s in schema[key]]
            if key == "oneOf" or not good(found.count([])):
                out += unsure(*found)
            if not good(found.count([])):
                out.append(f"{at}: {key}")
    return out


def events(messages: DataFrame) -> DataFrame:
    """One row for each message's plain text and each mark."""

    def scan(batches):
        for batch in batches:
            rows: list[tuple] = []
            for c, t, r, x in zip(*(column(batch, n) for n in ("conv_id", "turn", "role", "text"))):
                rows += [(c, t, i, r or "unknown", *e) for i, e in enumerate(parse(r or "unknown", x or ""))]
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*rows), _FIELDS)], schema=pa.schema(_FIELDS))

    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(scan, SCHEMA)


def _written(df: DataFrame, registry: dict[str, object]) -> DataFrame:
    """Validates calls and adds the canonical JSON of each row."""
    fields = [("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("call_id", pa.string()), ("status", pa.string()), ("valid", pa.bool_()), ("problems", pa.list_(pa.string())), ("at_turn", pa.int64()), ("level", pa.int64()), ("json", pa.string())]

    def scan(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                found, valid = [], None
                body = {"role": row["role"]}
                if row["kind"] == "call":
                    arguments = json.loads(row["body"])
                    schema = json.loads(row["schema"]) if row["schema"] is not None else registry.get(row["name"])
                    try:
                        found = ["$: the tool has no schema"] if schema is None else problems(arguments, schema)
                    except (re.error, TypeError, KeyError, AttributeError, RecursionError) as e:
                        found = [f"$: the schema can't be used ({type(e).__name__})"]
                    valid = not found
                    body |= {"tool_call": {"id": row["call_id"], "name": row["name"], "arguments": arguments}}
                elif row["kind"] == "result":
                    body |= {"tool_call_id": row["call_id"], "content": json.loads(row["body"])}
                elif row["kind"] == "schema":
                    body |= {"tool": {"name": row["name"], "parameters": json.loads(row["body"])}}
                else:
                    body |= {"content": row["body"]}
                out.append((*(row[c] for c in ("conv_id", "turn", "seq", "kind", "call_id", "status")), valid, found, row["at_turn"], row["level"], canonical(body)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*out), fields)], schema=pa.schema(fields))

    return df.mapInArrow(scan, "conv_id long, turn long, seq long, kind string, call_id string, status string, valid boolean, problems array<string>, at_turn long, level long, json string")


def _step(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Places the nodes all of whose nodes before are placed; fresh: whether a node was, in this step or one before."""
    before = nodes.select("conv_id", F.col("node").alias("before"), "at").join(edges, ["conv_id", "before"])
    before = before.groupBy("conv_id", "node").agg(F.max("at").alias("least"), F.max(F.col("at").isNull()).alias("blocked"))
    above = F.struct(F.col("least.turn").alias("turn"), (F.col("least.level") + 1).alias("level"))
    place = F.when(F.col("least").isNotNull() & (above > F.col("own")), above).otherwise(F.col("own"))
    free = F.col("at").isNull() & ~F.coalesce("blocked", F.lit(False))
    return nodes.join(before, ["conv_id", "node"], "left").select("conv_id", "node", "own", F.when(free, place).otherwise(F.col("at")).alias("at"), (F.col("fresh") | free).alias("fresh"))


def link(messages: DataFrame, registry: dict[str, object] | None = None) -> DataFrame:
    """Rows in topological order by (conv_id, at_turn, level, seq): kind, status, validity and canonical JSON of each."""
    found = events(messages)
    plain = found.where("kind IN ('message', 'broken')").select("*", F.lit(None).cast("string").alias("schema"), F.when(F.col("kind") == "broken", "broken").otherwise("message").alias("status"), F.col("turn").alias("at_turn"), F.lit(0).cast("long").alias("level"))
    marks = materialise(found.where("kind NOT IN ('message', 'broken')"), "marks")
    if not marks.limit(1).count():
        return _written(plain, registry or {})
    schemas = marks.where("kind = 'schema'").groupBy("conv_id", "name").agg(F.min(F.struct("turn", "seq", "body"))["body"].alias("schema"))
    first = F.struct("turn", "seq")
    owners = marks.where("kind = 'call'").groupBy("conv_id", "call_id").agg(F.min(first).alias("owner"))
    answered = marks.where("kind = 'result'").groupBy("conv_id", "call_id").agg(F.min(first).alias("answer"))
    linked = marks.join(owners, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left").join(schemas, ["conv_id", "name"], "left")
    status = (
        F.when(F.col("kind") == "schema", "schema")
        .when((F.col("kind") == "result") & F.col("owner").isNull(), "no_call")
        .when((F.col("kind") == "call") & (F.col("owner") != first), "repeated")
        .when(F.col("answer").isNull(), "no_result")
        .otherwise("linked")
    )
    linked = materialise(linked.select(*found.columns, F.when(F.col("kind") == "call", F.col("schema")).alias("schema"), status.alias("status")), "linked")
    # Edges between identifiers: a result after its call, a call after the results that it names.
    call = linked.where("kind = 'call' AND status <> 'repeated'")
    edges = materialise(call.select("conv_id", F.concat(F.lit("c"), "call_id").alias("node"), F.explode("needs").alias("n")).select("conv_id", F.concat(F.lit("r"), "n").alias("before"), "node").unionByName(call.select("conv_id", F.concat(F.lit("c"), "call_id").alias("before"), F.concat(F.lit("r"), "call_id").alias("node"))).distinct(), "edges")
    nodes = linked.where("status IN ('linked', 'no_result')").groupBy("conv_id", F.concat(F.when(F.col("kind") == "call", "c").otherwise("r"), "call_id").alias("node")).agg(F.min(F.struct("turn", F.lit(0).cast("long").alias("level"))).alias("own"))
    nodes = materialise(nodes.select("conv_id", "node", "own", F.lit(None).cast(nodes.schema["own"].dataType).alias("at")), "nodes")
    rounds = 0
    while True:  # a node is placed once all nodes before it are; each job takes STEPS steps along the chains of references
        after = nodes.withColumn("fresh", F.lit(False))
        for _ in range(STEPS):
            after = _step(after, edges)
        after, rounds = materialise(after, f"nodes{rounds}", share=8), rounds + 1
        nodes = after.drop("fresh")
        if not after.where("fresh").limit(1).count():
            break
    # What could not be placed lies on a cycle of references, or after one: it keeps its own place.
    nodes = nodes.select("conv_id", "node", F.coalesce("at", "own").alias("at"), F.col("at").isNull().alias("turning"))
    placed = linked.withColumn("node", F.concat(F.when(F.col("kind") == "call", "c").when(F.col("kind") == "result", "r"), "call_id")).join(nodes, ["conv_id", "node"], "left")
    placed = placed.withColumn("status", F.when(F.col("turning") & F.col("status").isin("linked", "no_result"), "cycle").otherwise(F.col("status")))
    own = F.col("status").isin("linked", "no_result")
    ordered = placed.select(
        *plain.columns[:-2],
        F.when(own & (F.col("at.turn") > F.col("turn")), F.col("at.turn")).otherwise(F.col("turn")).alias("at_turn"),
        F.when(own & (F.col("at.turn") >= F.col("turn")), F.col("at.level")).otherwise(F.lit(0)).cast("long").alias("level"),
    )
    return _written(plain.unionByName(ordered), registry or {})
