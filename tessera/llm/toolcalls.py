"""Tool calls and their results, linked, ordered, validated and serialised. DataFrame operations only.

Messages are JSON where tools are concerned: an assistant's text may be an
object with `tool_calls`, a list of {id, name, arguments}, and a tool's text an
object with `tool_call_id` and `content`. Arguments are a JSON object or a
string that holds one; `{{id}}` within makes a call depend on another.

Calls and results meet in a hash join on conversation and identifier, so a long
conversation is many rows and never one value.

Order: where calls depend on earlier ones only, (turn, nth) is a topological
order and every call has level 0, without any round of joins. A call that
depends on a later one is a level above it. Levels are found for the
conversations with such calls only: in one step where a conversation's calls and
their needs are few (SMALL), else by rounds that settle calls without open
dependencies and at the same time shorten chains to half their length.

JSON is handled in a marked form, in which strings begin with `s` and numbers
are strings that begin with `n`: no parser then changes a number. The variant
type sorts the keys.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: A JSON string. Possessive, so that no text is too long for it.
STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: A JSON string or number, or what is between them.
TOKEN = STRING + r'|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|[^"0-9-]++|.'
CALLS = "stool_calls array<struct<sid string, sname string, sarguments string>>"
RESULT = "stool_call_id string, scontent string"
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
#: Level of what is on a circle of dependencies or behind one.
NEVER = 1 << 40
#: Calls and needs of a conversation up to which its levels are found within one row.
SMALL = 1000


def bound(value: Column, of) -> Column:
    """of(value), with value computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def number(text: Column) -> Column:
    """One text for each number, exact: digits, with a point where the number has few zeros, else with an exponent."""

    def form(t: Column) -> Column:
        whole, part = F.regexp_extract(t, "^-?([0-9]+)", 1), F.regexp_extract(t, r"\.([0-9]+)", 1)
        exponent = F.coalesce(F.regexp_extract(t, "[eE]([+-]?[0-9]+)$", 1).try_cast("long"), F.lit(0).cast("long"))

        def digits(d: Column) -> Column:
            short = F.rtrim(d, F.lit("0"))
            power = exponent - F.length(part) + F.length(d) - F.length(short)
            point = F.length(short) + power
            plain = (
                F.when(short == "", "0")
                .when((power >= 0) & (power <= 21), F.concat(short, F.repeat(F.lit("0"), power.cast("int"))))
                .when((power < 0) & (point > 0), F.concat(F.substring(short, F.lit(1), point.cast("int")), F.lit("."), F.substring(short, (point + 1).cast("int"), F.length(short))))
                .when((power < 0) & (point > -7), F.concat(F.lit("0."), F.repeat(F.lit("0"), (-point).cast("int")), short))
                .otherwise(F.concat(short, F.lit("e"), power.cast("string")))
            )
            return F.when(F.startswith(t, F.lit("-")) & (short != ""), F.concat(F.lit("-"), plain)).otherwise(plain)

        return F.when(F.regexp_like(t, F.lit("[eE][+-]?[0-9]{10,}$")), F.lower(t)).otherwise(bound(F.ltrim(F.concat(whole, part), F.lit("0")), digits))

    return bound(text, form)


def marked(text: Column) -> Column:
    """JSON text with its strings and numbers marked; what isn't JSON isn't afterwards."""
    mark = lambda t: F.when(F.startswith(t, F.lit('"')), F.concat(F.lit('"s'), F.substr(t, F.lit(2)))).when(F.regexp_like(t, F.lit("^-?[0-9]")), F.concat(F.lit('"n'), number(t), F.lit('"'))).otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), mark), "")


def sorted_json(form: Column) -> Column:
    """Canonical JSON of a marked form: keys sorted, no spaces; null if it isn't JSON."""
    unmark = lambda t: F.when(F.startswith(t, F.lit('"n')), F.substring(t, F.lit(3), F.length(t) - 3)).when(F.startswith(t, F.lit('"s')), F.concat(F.lit('"'), F.substr(t, F.lit(3)))).otherwise(t)
    rest = lambda t: F.length(F.regexp_replace(t, STRING, '"')) - F.length(F.regexp_replace(F.regexp_replace(t, STRING, '"'), r"[^ \t\r\n]", ""))
    # the parser leaves out what stands after a value
    whole = lambda out: F.when(rest(form) == rest(out), F.array_join(F.transform(F.regexp_extract_all(out, F.lit(TOKEN), F.lit(0)), unmark), ""))
    return bound(F.to_json(F.try_parse_json(form)), whole)


def canonical(text: Column) -> Column:
    """Canonical JSON of a JSON text; null if it isn't JSON or repeats a key."""
    return sorted_json(marked(text))


def whole(text: Column) -> Column:
    """Marked form of a JSON text; null if it isn't JSON."""
    return bound(marked(text), lambda form: F.when(sorted_json(form).isNotNull(), form))


def quoted(text: Column) -> Column:
    """A JSON string, or null."""
    one = F.to_json(F.struct(text.alias("s")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(one, F.lit(6), F.length(one) - 6))


def plain(field: Column) -> Column:
    """A string or number of a marked message without its mark; else its canonical JSON."""
    return F.when(F.startswith(field, F.lit("s")) | F.startswith(field, F.lit("n")), F.substr(field, F.lit(2))).otherwise(sorted_json(field))


def calls_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, nth, call_id, name, form, arguments) of every call in every message; form: the marked arguments, null if they aren't JSON; arguments: as canonical JSON."""
    parsed = messages.filter("role = 'assistant'").select("conv_id", "turn", F.from_json(whole(F.col("text")), CALLS, STRICT).alias("m"))
    spread = parsed.select("conv_id", "turn", F.posexplode("m.stool_calls").alias("nth", "c"))
    given = F.col("c.sarguments")
    text = F.when(F.startswith(given, F.lit("s")), F.substr(given, F.lit(2)))
    form = F.when(text.isNotNull(), marked(text)).when(F.startswith(given, F.lit("n")), F.concat(F.lit('"'), given, F.lit('"'))).otherwise(given)
    held = spread.select("conv_id", "turn", "nth", plain(F.col("c.sid")).alias("call_id"), plain(F.col("c.sname")).alias("name"), text.alias("text"), form.alias("form")).withColumn("arguments", sorted_json(F.col("form")))
    return held.select("conv_id", "turn", "nth", "call_id", "name", F.when(F.col("arguments").isNotNull(), F.col("form")).alias("form"), F.coalesce("arguments", quoted(F.col("text"))).alias("arguments"))


def results_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, content) of every tool message; content: canonical JSON, that of a string if it isn't JSON itself."""
    parsed = messages.filter("role = 'tool'").select("conv_id", "turn", F.from_json(whole(F.col("text")), RESULT, STRICT).alias("m"))
    given = F.col("m.scontent")
    text = F.substr(given, F.lit(2))
    content = F.when(F.startswith(given, F.lit("s")), F.coalesce(canonical(text), quoted(text))).when(F.startswith(given, F.lit("n")), text).otherwise(F.coalesce(sorted_json(given), F.lit("null")))
    return parsed.filter("m is not null").select("conv_id", "turn", plain(F.col("m.stool_call_id")).alias("call_id"), content.alias("content"))


#: Keywords of JSON Schema that are checked, and those that say nothing of a value (fixed values).
CHECKED = {"type", "properties", "required", "additionalProperties", "items", "enum", "minimum", "maximum"}
SAID = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}


def literal(value) -> str:
    """Canonical JSON of a value of a schema."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{literal(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(literal, value)) + "]"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return json.dumps(value, ensure_ascii=False)


def faults_of(value: Column, schema: dict, at: str = "") -> Column:
    """What is wrong with a marked variant by a JSON Schema: an array of messages."""
    if unknown := schema.keys() - CHECKED - SAID:
        raise ValueError(f"schema keywords that aren't supported: {sorted(unknown)}")
    name = at or "arguments"
    inner = lambda key: f"{at}.{key}" if at else key
    none = F.array().cast("array<string>")
    said = lambda wrong, text: F.when(F.coalesce(wrong, F.lit(False)), F.array(F.lit(text))).otherwise(none)

    def check(v: Column) -> Column:
        kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
        figure = F.coalesce(F.startswith(text, F.lit("n")), F.lit(False)) & (kind == "STRING")
        is_ = {
            "string": (kind == "STRING") & ~figure,
            "number": figure,
            "integer": figure & F.regexp_like(text, F.lit("^n-?[0-9]+(e[0-9]+)?$")),
            "boolean": kind == "BOOLEAN",
            "null": kind == "VOID",
            "array": F.startswith(kind, F.lit("ARRAY")),
            "object": F.startswith(kind, F.lit("OBJECT")),
        }
        types = schema.get("type", [])
        types = [types] if isinstance(types, str) else types
        wrong = F.lit(False)
        if types:
            wrong = ~F.array_contains(F.array(*[is_[t] for t in types]), True)
        found = []
        if "enum" in schema:
            found.append(said(~sorted_json(F.to_json(v)).isin([literal(x) for x in schema["enum"]]), f"value of {name}"))
        size = F.substr(text, F.lit(2)).try_cast("double")
        for key, beyond in (("minimum", lambda x: size < x), ("maximum", lambda x: size > x)):
            if key in schema:
                found.append(said(figure & beyond(float(schema[key])), f"{key} of {name}"))
        fields = F.try_variant_get(v, "$", "map<string,variant>")
        for key in schema.get("required", []):
            found.append(said(is_["object"] & ~F.map_contains_key(fields, F.lit("s" + key)), f"missing {inner(key)}"))
        for key, of in schema.get("properties", {}).items():
            found.append(F.when(is_["object"] & F.map_contains_key(fields, F.lit("s" + key)), faults_of(F.try_element_at(fields, F.lit("s" + key)), of, inner(key))).otherwise(none))
        if schema.get("additionalProperties") is False:
            extra = F.array_except(F.map_keys(fields), F.array(*[F.lit("s" + k) for k in schema.get("properties", {})]).cast("array<string>"))
            found.append(F.when(is_["object"], F.transform(extra, lambda k: F.concat(F.lit("unknown " + inner("")), F.substr(k, F.lit(2))))).otherwise(none))
        if "items" in schema:
            each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: faults_of(x, schema["items"], f"{name}[]"))
            found.append(F.when(is_["array"], F.flatten(each)).otherwise(none))
        return F.when(wrong, F.array(F.lit(f"type of {name}"))).otherwise(F.concat(none, *found))

    return bound(value, check)


def faults(name: Column, form: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with marked arguments of the tool of that name: a sorted array of messages."""
    value = F.try_parse_json(form)
    out = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        of = F.when(value.isNull(), F.array(F.lit("not JSON"))).otherwise(F.sort_array(F.array_distinct(faults_of(value, {"type": "object"} | schema))))
        out = F.when(name == tool, of).otherwise(out)
    return out


def levels_within(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls of small conversations whose level isn't 0, from edges (conv_id, call_id, need, w); null: on a circle or behind one.

    A conversation is an array of its calls' needs. Each pass over it settles
    the calls whose needs are settled; after as many passes as there are calls,
    what isn't settled never is.
    """
    calls = edges.select("conv_id", F.explode(F.array("call_id", "need")).alias("call_id")).distinct()
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("call_id")) - 1  # SMALL rows at most
    calls = calls.withColumn("place", place)
    to = calls.select("conv_id", F.col("call_id").alias("need"), F.col("place").alias("to"))
    needs = edges.join(to, ["conv_id", "need"]).groupBy("conv_id", "call_id").agg(F.collect_list(F.struct("to", "w")).alias("needs"))
    none = F.array().cast("array<struct<to: int, w: bigint>>")
    each = calls.join(needs, ["conv_id", "call_id"], "left").select("conv_id", F.struct("place", "call_id", F.coalesce("needs", none).alias("needs")).alias("c"))
    whole_ = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("calls"))
    open_ = F.lit(-1).cast("long")

    def settle(levels: Column, _: Column) -> Column:
        level = lambda e: F.get(levels, e["to"])
        above = lambda needs: F.aggregate(needs, F.lit(0).cast("long"), lambda m, e: F.when((m < 0) | (level(e) < 0), open_).otherwise(F.greatest(m, level(e) + e["w"])))
        return F.transform("calls", lambda c: above(c["needs"]))

    rounds = F.sequence(F.lit(1), F.size("calls"))
    levels = F.aggregate(rounds, F.transform("calls", lambda c: open_), settle)
    found = whole_.select("conv_id", F.explode(F.arrays_zip("calls", levels.alias("level"))).alias("z"))
    found = found.select("conv_id", F.col("z.calls.call_id").alias("call_id"), F.col("z.level").alias("level")).filter("level <> 0")
    return found.select("conv_id", "call_id", F.when(F.col("level") > 0, F.col("level")).alias("level"))


def levels(first: DataFrame, small: int = SMALL) -> DataFrame:
    """(conv_id, call_id, level) of the calls (conv_id, call_id, call_turn, call_nth, call_row, arguments) whose level isn't 0; null: on a circle or behind one.

    An edge leads from a call to what it needs, and weighs 1 if that is a later
    call (or itself). A level is the greatest weight of a path. Small
    conversations are done in one step (levels_within). In others each round
    settles the calls without edges, and replaces an edge to a call that has one
    edge by the two together, so chains shrink by half. What then needs itself
    is on a circle; so is all that is left when a round changes nothing, as
    every call then needs several others that are left.
    """
    key = ["conv_id", "call_id"]
    place = F.struct("call_turn", "call_nth", "call_row")
    needs = first.select(*key, place.alias("place"), F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r"\{\{([^{}]+)\}\}"), F.lit(1)))).alias("need"))
    known = first.select("conv_id", F.col("call_id").alias("need"), place.alias("of"))
    edges = needs.join(known, ["conv_id", "need"]).select(*key, "need", (F.col("of") >= F.col("place")).cast("long").alias("w"))
    edges = save(edges, "needs")
    some = save(edges.filter("w > 0").select("conv_id").distinct(), "forward")
    edges = save(edges.join(some, "conv_id", "left_semi"), "edges")
    # every call that is only needed stands in some call's needs, so there are at most twice as many calls as needs
    few = save(edges.groupBy("conv_id").agg(F.count("*").alias("n")).filter(3 * F.col("n") <= small).select("conv_id"), "small")
    within = save(levels_within(edges.join(few, "conv_id", "left_semi")), "levels")
    edges = save(edges.join(few, "conv_id", "left_anti"), "edges")
    nodes = save(edges.select("conv_id", F.explode(F.array("call_id", "need")).alias("call_id")).distinct().withColumn("level", F.lit(0).cast("long")), "nodes")
    while not edges.isEmpty():
        out = edges.groupBy(*key).agg(F.count("*").alias("many"), F.max(F.struct("need", "w")).alias("only"))
        state = nodes.join(out, key, "left").select("conv_id", F.col("call_id").alias("need"), F.col("level").alias("of"), F.coalesce("many", F.lit(0)).alias("many"), "only")
        step = edges.join(state, ["conv_id", "need"])
        short = F.col("many") <= 1
        step = step.select(*key, F.when(F.col("many") == 1, F.col("only.need")).when(F.col("many") > 1, F.col("need")).alias("need"), F.when(F.col("many") == 1, F.col("w") + F.col("only.w")).otherwise(F.col("w")).alias("w"), F.when(short, F.col("of") + F.col("w")).otherwise(F.lit(0)).alias("least"), short.alias("moved"))
        step = save(step.withColumn("least", F.when(F.col("need") == F.col("call_id"), F.lit(NEVER)).otherwise(F.least("least", F.lit(NEVER)))), "step")
        if step.filter("moved or least > 0").isEmpty():
            nodes = nodes.join(edges.select(*key, F.lit(NEVER).alias("l")).distinct(), key, "left").select(*key, F.coalesce("l", "level").alias("level"))
            break
        risen = step.groupBy(*key).agg(F.max("least").alias("least"))
        nodes = save(nodes.join(risen, key, "left").select(*key, F.greatest("level", F.coalesce("least", F.lit(0))).alias("level")), "nodes")
        edges = step.filter("need is not null").groupBy(*key, "need").agg(F.max("w").alias("w"))
        edges = save(edges.join(nodes.filter(F.col("level") < NEVER), key, "left_semi"), "edges")
    return within.unionByName(nodes.filter("level > 0").select(*key, F.when(F.col("level") < NEVER, F.col("level")).alias("level")))


def link(messages: DataFrame, schemas: dict[str, dict], small: int = SMALL) -> DataFrame:
    """(conv_id, call_id, name, kind, level, turn, nth, result_turn, status, faults, json): a row for each call and each result of messages (conv_id, turn, role, text).

    kind: call or result. Rows of a conversation in the order of (level, turn,
    nth, kind) are in topological order, each result after its call; level is 0
    but for calls that need a later one, which are a level above it.
    status of a call: answered, or open without a later result; repeated if an
    earlier one has its identifier (the first counts); circular on a circle of
    dependencies or behind one. Of a result: linked to the first call of its
    identifier if that came before and no earlier result did, else repeated;
    orphan without a call before it. Calls and results without an identifier
    are open and orphans. faults, of a call: by its tool's JSON Schema (type,
    also a list or none, properties, required, additionalProperties, items,
    enum, minimum, maximum; other keywords raise). json: canonical JSON of the
    row, with equal text for equal numbers and all their digits; arguments that
    aren't JSON, or repeat a key, are serialised as the string they are.
    Other messages, null and empty texts and texts that aren't JSON have no
    rows; repeated messages count as repeated calls and results; extra columns
    are ignored; an empty table gives an empty result.
    """
    messages = messages.select("conv_id", "turn", "role", "text")
    calls = save(calls_of(messages).withColumn("row", F.monotonically_increasing_id()), "calls")
    results = save(results_of(messages).withColumn("row", F.monotonically_increasing_id()), "results")
    key = ["conv_id", "call_id"]
    named = calls.filter("call_id is not null and conv_id is not null")
    first = named.groupBy(*key).agg(F.min(F.struct("turn", "nth", "row", "name", "arguments")).alias("c"))
    first = save(first.select(*key, F.col("c.turn").alias("call_turn"), F.col("c.nth").alias("call_nth"), F.col("c.row").alias("call_row"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments")), "first")
    after = results.join(first, key).filter(F.col("turn") > F.col("call_turn"))
    answer = after.groupBy(*key).agg(F.min(F.struct("turn", "row")).alias("r")).select(*key, F.col("r.turn").alias("result_turn"), F.col("r.row").alias("result_row"))
    raised = levels(first, small).select(*key, "level", F.lit(True).alias("raised"))
    placed = first.join(answer, key, "left").join(raised, key, "left").withColumn("level", F.when(F.col("raised"), F.col("level")).otherwise(F.lit(0).cast("long")))
    keys = save(placed.select(*key, F.col("name").alias("call_name"), "call_row", "call_turn", "call_nth", "result_turn", "result_row", "level"), "placed")

    call = calls.join(keys, key, "left")
    mine = F.coalesce(F.col("row") == F.col("call_row"), F.lit(False))
    status = F.when(F.col("call_row").isNull(), "open").when(~mine, "repeated").when(F.col("level").isNull(), "circular").when(F.col("result_turn").isNull(), "open").otherwise("answered")
    call_json = F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit("}"))
    call = call.select(*key, "name", F.lit("call").alias("kind"), F.when(mine, F.col("level")).alias("level"), "turn", "nth", F.when(mine, F.col("result_turn")).alias("result_turn"), status.alias("status"), faults(F.col("name"), F.col("form"), schemas).alias("faults"), call_json.alias("json"))
    result = results.join(keys, key, "left")
    own = F.coalesce(F.col("row") == F.col("result_row"), F.lit(False))
    late = F.coalesce(F.col("turn") > F.col("call_turn"), F.lit(False))
    result_json = F.concat(F.lit('{"content":'), F.col("content"), F.lit(',"tool_call_id":'), quoted(F.col("call_id")), F.lit("}"))
    result = result.select(*key, F.col("call_name").alias("name"), F.lit("result").alias("kind"), F.when(own, F.col("level")).alias("level"), F.when(own, F.col("call_turn")).otherwise(F.col("turn")).alias("turn"), F.when(own, F.col("call_nth")).otherwise(F.lit(0)).alias("nth"), F.col("turn").alias("result_turn"), F.when(own, "linked").when(late, "repeated").otherwise("orphan").alias("status"), F.array().cast("array<string>").alias("faults"), result_json.alias("json"))
    return call.unionByName(result)


def from_turns(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as tool messages: each system and user turn calls a tool with its text, each assistant turn is the result of the call of the turn before.

    From the third turn on, a user's call refers to the call two turns before.
    So that each kind of fault and link occurs, the remainder k of
    (7 * conv_id + turn) / 13 changes a user's call: 0 has its turn as a string,
    1 no text, 2 an unknown argument, 3 refers to the call two turns later, 4
    has the identifier of the call two turns before, 5 has arguments that aren't
    JSON, 6 calls an unknown tool, 7 refers to itself, 8 writes its turn with an
    exponent; and an assistant's result: 9 answers a call that isn't there.
    """
    text = F.coalesce("text", F.lit(""))
    k = F.pmod(7 * F.col("conv_id") + F.col("turn"), F.lit(13))
    user, turn = F.col("role") == "user", F.col("turn").cast("string")
    ident = lambda t: F.concat(F.lit("c"), t.cast("string"))
    refer = F.when(k == 3, F.col("turn") + 2).when(k == 7, F.col("turn")).when(F.col("turn") >= 2, F.col("turn") - 2)
    fields = F.concat_ws(
        ",",
        F.concat(F.lit('"turn":'), F.when(k == 0, quoted(turn)).when(k == 8, F.concat(turn, F.lit(".0e0"))).otherwise(turn)),
        F.when(k != 1, F.concat(F.lit('"text":'), quoted(text))),
        F.when(k == 2, F.lit('"guess":true')),
        F.concat(F.lit('"context":"{{'), ident(refer), F.lit('}}"')),
    )
    asked = F.when(k == 5, quoted(text)).otherwise(F.concat(F.lit("{"), fields, F.lit("}")))
    arguments = F.when(user, asked).otherwise(F.concat(F.lit('{"text":'), quoted(text), F.lit("}")))
    name = F.when(user & (k == 6), "guess").when(user, "reply").otherwise("configure")
    own = F.when(user & (k == 4) & (F.col("turn") >= 2), F.col("turn") - 2).otherwise(F.col("turn"))
    called = F.concat(F.lit('{"tool_calls":[{"id":'), quoted(ident(own)), F.lit(',"name":'), quoted(name), F.lit(',"arguments":'), arguments, F.lit("}]}"))
    answered = F.concat(F.lit('{"tool_call_id":'), quoted(F.when(k == 9, F.lit("none")).otherwise(ident(F.col("turn") - 1))), F.lit(',"content":'), quoted(text), F.lit("}"))
    answers = F.col("role") == "assistant"
    return turns.select("conv_id", "turn", F.when(answers, "tool").otherwise("assistant").alias("role"), F.when(answers, answered).otherwise(called).alias("text"))


#: Schemas of the tools that from_turns() calls.
TURN_TOOLS = {
    "reply": {"properties": {"text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}, "context": {"type": "string"}}, "required": ["text", "turn"], "additionalProperties": False},
    "configure": {"properties": {"text": {"type": "string"}}, "required": ["text"], "additionalProperties": False},
}
