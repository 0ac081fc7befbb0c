import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from cinelake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ADD = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "integer", "minimum": 0}}, "required": ["a", "b"], "additionalProperties": False}


def call(id_, name, **arguments):
    return f"<tool_call>{json.dumps({'id': id_, 'name': name, 'arguments': arguments})}</tool_call>"


def result(id_, content):
    return f"<tool_result>{json.dumps({'id': id_, 'content': content})}</tool_result>"


def linked(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS status", "2 AS json", "3 AS level", "4 AS kind")
    return chat.link(df, **options).orderBy("conv_id", "at_turn", "level", "seq").collect()


def test_links_order_and_validation(shipped):
    rows = [
        (1, 0, "system", f"Tools: <tools>{json.dumps([{'name': 'add', 'parameters': ADD}])}</tools>"),
        (1, 1, "tool", result("x", 3)),  # told before its call
        (1, 2, "assistant", "I add. " + call("x", "add", a=1, b=2) + call("y", "add", a={"$ref": "x"}, b=-1)),
        (1, 3, "tool", result("y", {"k": [1, "é"]})),
        (1, 4, "assistant", call("x", "add", a=9, b=9) + call("z", "nothing")),
        (1, 5, "tool", result("w", None)),
        (1, 6, "assistant", "<tool_call>{broken</tool_call>"),
        (2, 0, "user", "plain"),
    ]
    out = linked(shipped, rows)
    status = {(r.kind, r.call_id, r.turn): r.status for r in out}
    assert status[("result", "x", 1)] == "linked" and status[("call", "x", 4)] == "repeated"
    assert status[("call", "z", 4)] == "no_result" and status[("result", "w", 5)] == "no_call" and status[("broken", None, 6)] == "broken"
    order = [(r.kind, r.call_id) for r in out if r.conv_id == 1 and r.status == "linked"]
    assert order == [("call", "x"), ("result", "x"), ("call", "y"), ("result", "y")]
    valid = {(r.call_id, r.turn): (r.valid, r.problems) for r in out if r.kind == "call"}
    assert valid[("x", 2)] == (True, []) and valid[("y", 2)] == (False, ["$.b: minimum"]) and valid[("z", 4)][0] is False
    assert next(r.json for r in out if r.kind == "call" and r.turn == 2) == '{"role":"assistant","tool_call":{"arguments":{"a":1,"b":2},"id":"x","name":"add"}}'
    assert next(r.json for r in out if r.conv_id == 2) == '{"content":"plain","role":"user"}'


def brute(rows):
    """Status and place of each row, one by one: what joins and rounds have to give."""
    found = [(c, t, i, *e[:2]) + (e[4],) for c, t, r, x in rows for i, e in enumerate(chat.parse(r, x))]
    first = {}
    for c, t, i, kind, name, _ in found:
        key = (c, kind, name)
        first[key] = min(first.get(key, (t, i)), (t, i))
    status, own, needs = {}, {}, {}
    for c, t, i, kind, name, refs in found:
        call, answer = first.get((c, "call", name)), first.get((c, "result", name))
        if kind == "result":
            s = "linked" if call else "no_call"
        elif kind == "call":
            s = "repeated" if call != (t, i) else "linked" if answer else "no_result"
        else:
            s = kind
        status[c, t, i] = s
        if s in ("linked", "no_result"):
            node = (c, kind[0], name)
            own[node] = min(own.get(node, (t, 0)), (t, 0))
            if kind == "call":
                needs[node] = {(c, "r", n) for n in refs or ()}
                needs.setdefault((c, "r", name), set()).add(node)
    at = {}
    while True:
        free = [n for n in own if n not in at and all(b in at for b in needs.get(n, ()) if b in own)]
        if not free:
            break
        at |= {n: max([own[n], *((at[b][0], at[b][1] + 1) for b in needs.get(n, ()) if b in own)]) for n in free}
    out = []
    for c, t, i, kind, name, _ in found:
        s, node = status[c, t, i], (c, kind[0], name)
        if s in ("linked", "no_result"):
            if node not in at:
                out.append((c, t, i, kind, name, "cycle", t, 0))
                continue
            place = at[node]
            out.append((c, t, i, kind, name, s, max(t, place[0]), place[1] if place[0] >= t else 0))
        else:
            out.append((c, t, i, kind, name, s, t, 0))
    return sorted(out, key=str)


def test_generated_conversations(shipped):
    """References, cycles, repeats, missing calls and results, and a chain of fifty calls, against brute force."""
    rng = random.Random(11)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            marks = []
            for _ in range(rng.randint(0, 3)):
                name = f"i{rng.randint(0, 5)}"
                if rng.random() < 0.5:
                    marks.append(result(name, t))
                else:
                    marks.append(call(name, "f", **{f"a{k}": {"$ref": f"i{rng.randint(0, 6)}"} for k in range(rng.choice([0, 0, 1, 2]))}))
            rows.append((c, t, "assistant", "text " + " ".join(marks)))
    chain = [(99, 0, "tool", "".join(result(f"n{i}", i) for i in range(50))), (99, 1, "assistant", "".join(call(f"n{i}", "f", **({"x": {"$ref": f"n{i - 1}"}} if i else {})) for i in reversed(range(50))))]
    rows += chain
    out = linked(shipped, rows)
    assert sorted(((r.conv_id, r.turn, r.seq, r.kind, r.call_id, r.status, r.at_turn, r.level) for r in out), key=str) == brute(rows)
    assert max(r.level for r in out) == 99 and {"cycle", "repeated", "no_call", "no_result", "linked"} <= {r.status for r in out}
    written = {(r.conv_id, r.turn, r.seq): r.json for r in out}
    assert all(j == chat.canonical(json.loads(j)) for j in written.values())


def test_cycles_settle(shipped):
    rows = [(1, 0, "assistant", call("a", "f", x={"$ref": "b"}) + call("b", "f", x={"$ref": "a"})), (1, 1, "tool", result("a", 1) + result("b", 2)), (1, 2, "assistant", call("c", "f")), (1, 3, "tool", result("c", 1))]
    out = linked(shipped, rows)
    assert {r.call_id: r.status for r in out} == {"a": "cycle", "b": "cycle", "c": "linked"}


def test_edges(shipped):
    rows = [(1, 0, None, None), (None, None, "user", "x"), (1, 1, "user", ""), (1, 1, "user", ""), (2, 0, "user", "a\n\"\\ é\x01" * 5000), (None, 3, "assistant", call("q", "f")), (3, 0, "user", "<tool_call>[]</tool_call>" + '<tool_call>{"id":1,"name":"f","arguments":"{\\"a\\": NaN}"}</tool_call>')]
    out = linked(shipped, rows)
    assert len(out) == 8
    assert [r.json for r in out if (r.conv_id, r.turn) == (1, 0)] == ['{"content":"","role":"unknown"}']
    assert json.loads(next(r.json for r in out if r.conv_id == 2))["content"] == rows[4][3]
    assert [r.status for r in out if r.conv_id == 3] == ["broken", "broken"]
    assert linked(shipped, []) == []


def test_whole_sample(shipped):
    df = shipped.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    out = chat.link(df).collect()
    want = sorted((r.conv_id, r.turn, json.dumps({"content": r.text, "role": r.role}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))) for r in df.collect())
    assert sorted((r.conv_id, r.turn, r.json) for r in out) == want


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20))
def test_canonical_is_stable(value):
    once = chat.canonical(value)
    assert chat.canonical(json.loads(once)) == once


def test_schemas():
    schema = {"type": "object", "properties": {"k": {"enum": ["a", 1]}, "n": {"type": ["number", "null"], "maximum": 5}, "l": {"type": "array", "items": {"type": "string", "pattern": "^x"}, "maxItems": 2}, "o": {"oneOf": [{"type": "string"}, {"minLength": 2}]}}}
    good = [{}, {"k": 1}, {"n": None}, {"n": 5.0}, {"l": ["x", "xy"]}, {"o": "a"}]
    bad = [[], {"k": True}, {"k": "b"}, {"n": 6}, {"n": "1"}, {"l": ["y"]}, {"l": ["x"] * 3}, {"o": "ab"}]
    assert all(not chat.problems(v, schema) for v in good) and all(chat.problems(v, schema) for v in bad)


def test_further_keywords():
    pair = {"$defs": {"p": {"type": "object", "properties": {"x": {"type": "integer"}, "next": {"$ref": "#/$defs/p"}}}}, "properties": {"a": {"$ref": "#/$defs/p"}}}
    cases = [
        (pair, {"a": {"x": 1, "next": {"x": 2}}}, {"a": {"next": {"x": "2"}}}),
        ({"not": {"type": "string"}}, 1, "a"),
        ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, {"a": 1, "b": 2}, {"a": 1, "c": 2}),
        ({"patternProperties": {"^n": {"type": "integer"}}, "additionalProperties": False}, {"n1": 1}, {"n1": "1"}),
        ({"patternProperties": {"^n": True}, "additionalProperties": False}, {"n": 1}, {"m": 1}),
        ({"propertyNames": {"maxLength": 2}}, {"ab": 1}, {"abc": 1}),
        ({"uniqueItems": True}, [1, True, "1", [1]], [{"a": 1}, {"a": 1.0}]),
        ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, ["a", 1], ["a", "b"]),
        ({"contains": {"const": 3}, "maxContains": 1}, [1, 3], [3, 3]),
        ({"contains": {"const": 3}}, [3, 3], [1]),
        ({"dependentRequired": {"a": ["b"]}}, {"a": 1, "b": 1}, {"a": 1}),
        ({"dependentSchemas": {"a": {"maxProperties": 1}}}, {"b": 1, "c": 1}, {"a": 1, "b": 1}),
    ]
    for schema, good, bad in cases:
        assert chat.problems(good, schema) == [] and chat.problems(bad, schema), schema
    assert chat.problems({}, {"unevaluatedProperties": False}) == ["$: unsupported keyword unevaluatedProperties"]
    assert chat.problems({}, {"not": {"unevaluatedProperties": False}}) == ["$: unsupported keyword unevaluatedProperties"]
    assert chat.problems(1, {"$ref": "https://example.org/x"}) == ["$: unsupported $ref https://example.org/x"]
    assert chat.problems(1, {"$ref": "#"}) == ["$: # names itself"]
