"""Tool calls and their results, linked, ordered, validated and written as canonical JSON.

Calls and results are hash-joined by identifier.  Calls are ordered by levels: a call comes one level after
the last call it depends on (Kahn's algorithm, all conversations at once, a join a level).  Arguments are
checked against the tool's JSON schema, and each call is one line of JSON with sorted keys.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

#: nesting up to which a call's arguments count as JSON
DEEPEST = 100

_KINDS: dict[str, tuple[type, ...]] = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "array": (list,), "object": (dict,), "null": (type(None),)}


def canonical(value: Any) -> str:
    """JSON with sorted keys, no spaces, and letters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parsed(text: str | None) -> tuple[Any, str | None]:
    """The value of a JSON text, or the text itself and what is wrong with it.

    Numbers that JSON does not have, lone surrogates (which no encoding can write) and nesting beyond ``DEEPEST`` are refused.
    """

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        value = json.loads(text or "", parse_constant=refuse)
        open_, depth = [value], 0
        while open_:
            depth += 1
            if depth > DEEPEST:
                return text, "arguments are nested too deeply"
            open_ = [x for v in open_ if isinstance(v, (list, dict)) for x in (v.values() if isinstance(v, dict) else v)]
        canonical(value).encode()
    except UnicodeEncodeError:
        return text, "arguments hold a lone surrogate"
    except RecursionError:
        return text, "arguments are nested too deeply"
    except ValueError:
        return text, "arguments are no JSON"
    return value, None


def _same(a: Any, b: Any) -> bool:
    """Equal as JSON: true is not 1, and 1.0 is."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def _is_kind(value: Any, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _KINDS[kind]) or kind == "integer" and isinstance(value, float) and value.is_integer()


def first_problem(value: Any, schema: dict[str, Any], at: str = "$") -> str | None:
    """Why the value does not fit the schema, or None. Knows types, enums, bounds, lengths, items and properties."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(_is_kind(value, k) for k in kinds):
        return f"{at}: not of type {'|'.join(kinds)}"
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        return f"{at}: not one of the allowed values"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            return f"{at}: below minimum"
        if value > schema.get("maximum", value):
            return f"{at}: above maximum"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at}: too short"
        if len(value) > schema.get("maxLength", len(value)):
            return f"{at}: too long"
    if isinstance(value, list) and "items" in schema:
        return next((p for i, x in enumerate(value) if (p := first_problem(x, schema["items"], f"{at}[{i}]"))), None)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in sorted(schema.get("required", [])):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            if name in known:
                if p := first_problem(value[name], known[name], f"{at}.{name}"):
                    return p
            elif schema.get("additionalProperties") is False:
                return f"{at}.{name}: not allowed"
    return None


def call_levels(calls: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id`` and ``level`` (0: depends on nothing) of each call; null where calls wait for each other.

    Dependencies on calls that the conversation does not have are ignored.  There is a round for each level.
    """
    ids = calls.select("conv_id", "call_id").distinct()
    needs = calls.select("conv_id", "call_id", F.explode("depends_on").alias("needed")).distinct()
    have = ids.select("conv_id", F.col("call_id").alias("needed"))
    needs = written(needs.join(have, ["conv_id", "needed"], "left_semi"), "needs")
    placed = ids.join(needs, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0))
    done, left, level = [written(placed, "level")], needs, 0
    while not left.isEmpty():
        level += 1
        met = done[-1].select("conv_id", F.col("call_id").alias("needed"))
        rest = written(left.join(met, ["conv_id", "needed"], "left_anti"), "needs")
        now = left.select("conv_id", "call_id").distinct().join(rest, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level))
        done.append(written(now, "level"))
        if done[-1].isEmpty():
            break
        left = rest
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return ids.join(found, ["conv_id", "call_id"], "left")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, Any]]) -> DataFrame:
    """One row per call, with its place in its conversation and its line of JSON.

    ``calls``: ``conv_id``, ``turn``, ``call_id``, ``name``, ``arguments`` (JSON text), ``depends_on`` (array of ids).
    ``results``: ``conv_id``, ``call_id``, ``turn``, ``content``.  ``schemas``: JSON schema of each tool's arguments.
    Of several calls or results of one identifier the one of the first turn counts.  ``problem`` says what is wrong
    with a call (unknown tool, no JSON, a lone surrogate, nesting over ``DEEPEST``, schema, circular dependency); such calls are kept, with ``valid`` false.
    Null or empty arguments are no JSON.  A call without a result has ``linked`` false and a null result.  Results
    without a call are not returned.  Null identifiers link to nothing and are left out.  Other columns are not read.
    """

    key = ["conv_id", "call_id"]
    named = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    fields = ["turn", "name", "arguments", "depends_on"]
    own = named.groupBy(*key).agg(F.min(F.struct(*fields)).alias("c")).select(*key, *[f"c.{f}" for f in fields])
    own = written(own.withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>"))), "calls")
    answers = results.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r")).select(*key, F.col("r.content").alias("content"), F.lit(True).alias("linked"))
    linked = own.drop("depends_on").join(answers.hint("shuffle_hash"), key, "left").join(call_levels(own), key, "left")

    @F.pandas_udf("struct<problem: string, line: string>")
    def checked(call_id, name, arguments, content, linked, level):  # noqa: ANN001, ANN202
        import pandas as pd

        def one(i, tool, text, result, has, circular):  # noqa: ANN001, ANN202
            value, problem = parsed(text)
            if problem is None:
                problem = first_problem(value, schemas[tool]) if tool in schemas else "unknown tool"
            problem = problem or ("circular dependency" if circular else None)
            return problem, canonical({"arguments": value, "call_id": i, "name": tool, "result": result if has else None})

        rows = [one(*r) for r in zip(call_id, name, arguments, content, linked, level.isna())]
        return pd.DataFrame(rows, columns=["problem", "line"])

    linked = linked.withColumn("linked", F.coalesce("linked", F.lit(False)))
    out = linked.withColumn("_c", checked("call_id", "name", "arguments", "content", "linked", "level"))
    out = out.select(*key, "turn", "level", "name", "linked", F.col("_c.problem").isNull().alias("valid"), F.col("_c.problem").alias("problem"), F.col("_c.line").alias("line"))
    late = F.coalesce("level", F.lit((1 << 31) - 1)).alias("late")
    placed = numbered(out.select(*key, late, "turn"), ["conv_id", "late", "turn", "call_id"], "place").select(*key, "place")
    first = placed.groupBy("conv_id").agg(F.min("place").alias("first"))
    return out.join(placed.join(first, "conv_id").select(*key, (F.col("place") - F.col("first")).alias("position")), key)


SCHEMAS: dict[str, dict[str, Any]] = {
    "search": {"type": "object", "required": ["limit", "text"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 400}, "limit": {"type": "integer", "minimum": 20, "maximum": 200}, "turn": {"type": "integer"}}},
    "summarise": {"type": "object", "required": ["limit", "text"], "properties": {"text": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 1500}}},
}


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the conversations table stands for.

    A user's turn is a call, of ``search`` if its text has under 200 characters, else of ``summarise``, that depends on
    the call of half its turn number; an assistant's turn is the result of the call of the turn before.
    """
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn, size = F.col("turn"), F.char_length("text")
    asked = turns.where("role = 'user'")
    arguments = F.to_json(F.struct("text", F.col("turn"), size.alias("limit")))
    calls = asked.select(
        "conv_id", "turn", name(turn).alias("call_id"), F.when(size < 200, "search").otherwise("summarise").alias("name"), arguments.alias("arguments"),
        F.when(turn > 0, F.array(name(F.floor(turn / 2)))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
