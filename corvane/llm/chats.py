"""Tool-call linking and canonical chat messages, in DataFrame functions alone.

Messages are rows; a conversation is never gathered into one value, so a conversation of any length is no hot task. Calls and results
meet in one small row a (conversation, call identifier), made with partial sums, and every message finds its row by a hash join. Calls
and results are ordered topologically by contraction, in joins: a result needs its call, a call the results that it names; `level` is the round
after which all that a row needs is there, so sorting by it puts everything after its needs.

Defined cases: a call or result without conversation or identifier links with nothing ("unidentified"); of repeated calls the earliest
turn counts and each is marked; arguments that are no JSON object are a problem, null ones are an empty object; a tool without a schema
is "unknown tool"; a result before its call comes after it in the order; what needs an unknown call, or stands in a circle of needs or
behind one, has no level; what needs nothing has level 0; texts of any length are kept whole; repeated rows stay, each with the same
links; parameter names may hold any character; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane.llm.mixing import word_count
from corvane.llm.shared import Scratch, table

#: JSON kinds by the names that schemas use.
KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|DECIMAL.*", "object": "OBJECT.*", "array": "ARRAY.*"}


def problems_of(tool: Column, arguments: Column, schemas: dict) -> Column:
    """What is wrong with the arguments, in the schema's order: a tool's parameters are {name: {type, required, minLength, minimum, maximum}}."""
    tree = F.try_parse_json(F.coalesce(arguments, F.lit("{}")))

    def member(key: str, kind: str) -> Column:
        if "'" in key or "\\" in key:  # no path can name it
            return F.try_variant_get(F.element_at(F.try_variant_get(tree, "$", "map<string,variant>"), F.lit(key)), "$", kind)
        return F.try_variant_get(tree, f"$['{key}']", kind)

    found = [F.when(tree.isNull() | ~F.schema_of_variant(tree).startswith("OBJECT"), F.lit("arguments: no object"))]
    found.append(F.when(~F.coalesce(tool, F.lit("")).isin(*schemas), F.lit("unknown tool")))
    for name, parameters in schemas.items():
        for key, rule in parameters.items():
            kind = F.schema_of_variant(member(key, "variant"))
            missing = kind.isNull() | (kind == "VOID")
            wrong = ~missing & ~kind.rlike(f"^(?:{KINDS[rule['type']]})$")
            bad = F.when(missing, F.lit(f"{key}: missing") if rule.get("required") else F.lit(None)).when(wrong, F.lit(f"{key}: no {rule['type']}"))
            for bound, test in (("minLength", lambda v, key=key: F.length(member(key, "string")) < v), ("minimum", lambda v, key=key: member(key, "double") < v), ("maximum", lambda v, key=key: member(key, "double") > v)):
                if bound in rule:
                    bad = bad.when(test(rule[bound]), F.lit(f"{key}: {bound}"))
            found.append(F.when(F.coalesce(tool, F.lit("")) == name, bad))
    return F.array_compact(F.array(*found))


def link_tool_calls(messages: DataFrame, schemas: dict) -> DataFrame:
    """messages: conv_id, turn, role, content, kind (message, call, result), call_id, tool, arguments (JSON), and perhaps depends_on (call identifiers) -> a row a message.

    order_turn, order_rank: sorting a conversation by them puts every result after its call and leaves the rest in turn. level: the topological one.
    json: the message with sorted keys and without blanks; its arguments' keys are sorted too.
    """
    needs = F.col("depends_on") if "depends_on" in messages.columns else F.lit(None).cast("array<string>")
    rows = messages.select("conv_id", "turn", "role", "content", "kind", "call_id", "tool", "arguments", needs.alias("depends_on"))
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    links = (
        rows.filter((is_call | is_result) & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
        .groupBy("conv_id", "call_id")
        .agg(F.count(F.when(is_call, 1)).alias("calls"), F.count(F.when(is_result, 1)).alias("results"), F.min(F.when(is_call, F.col("turn"))).alias("call_turn"), F.min(F.when(is_result, F.col("turn"))).alias("result_turn"))
    )
    ordered = rows.filter((is_call | is_result) & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    step = F.concat("kind", F.lit(":"), "call_id")
    needed = F.when(is_result, F.array(F.concat(F.lit("call:"), "call_id"))).otherwise(F.transform("depends_on", lambda x: F.concat(F.lit("result:"), x)))
    levels = dependency_levels(ordered.select("conv_id", step.alias("call_id"), needed.alias("depends_on")))
    levels = levels.select("conv_id", F.split_part("call_id", F.lit(":"), F.lit(1)).alias("kind"), F.expr("substring(call_id, position(':' in call_id) + 1)").alias("call_id"), "level")
    joined = rows.join(links.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(levels.hint("shuffle_hash"), ["conv_id", "kind", "call_id"], "left")
    inside = (is_call | is_result) & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    status = (
        F.when(~(is_call | is_result), "message")
        .when(F.col("calls").isNull(), "unidentified")
        .when(is_call & (F.col("calls") > 1), "repeated")
        .when(is_call, F.when(F.col("results") > 0, "answered").otherwise("unanswered"))
        .otherwise(F.when(F.col("calls") > 0, "linked").otherwise("orphan"))
    )
    tree = F.try_parse_json(F.coalesce("arguments", F.lit("{}")))
    rest = F.to_json(F.struct(F.when(is_call | is_result, F.col("call_id")).alias("call_id"), F.when(~is_call, F.col("content")).alias("content"), "role", F.when(is_call, F.col("tool")).alias("tool"), "turn"))  # nulls are left out
    arguments = F.to_json(tree)
    message = F.when(is_call & arguments.isNotNull(), F.concat(F.lit('{"arguments":'), arguments, F.when(rest == "{}", "}").otherwise(F.concat(F.lit(","), F.substr(rest, F.lit(2)))))).otherwise(rest)
    linked = F.when(is_call, F.col("result_turn")).when(is_result, F.col("call_turn"))
    return (
        joined.withColumn("problems", F.when(is_call, problems_of(F.col("tool"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>")))
        .select(
            "conv_id", "turn", "kind", "call_id", status.alias("status"), linked.alias("linked_turn"),
            F.when(is_result, F.greatest("turn", "call_turn")).otherwise(F.col("turn")).alias("order_turn"),
            F.when(is_result & (F.col("call_turn") >= F.col("turn")), 1).otherwise(0).alias("order_rank"),
            F.when(inside, F.col("level")).otherwise(0).alias("level"),
            F.array_join("problems", "; ").alias("problems"),
            message.alias("json"),
        )
    )


def dependency_levels(calls: DataFrame) -> DataFrame:
    """calls: conv_id, call_id, depends_on (array of call identifiers) -> conv_id, call_id, level: the rounds after which all that it needs is done.

    A topological order by contraction. What needs nothing more has its level. A call with one need left is a link: its level is the greater of
    a number and its need's level plus a weight, and such functions compose, so chains are ranked by pointer jumping, four times as far a
    round. Calls with several needs stay, their needs moved to the ends of those chains, where equal ones become one. A chain takes a round in
    the logarithm of its length, a tree contracts as fast; only what branches and meets again goes on by rounds of its own.
    Calls in a cycle, or behind one, or behind an unknown call get a null level; repeated calls are one, with the needs of all.
    """
    scratch = Scratch(calls.sparkSession, "levels")
    key = ["conv_id", "call_id"]
    given = F.concat(F.array(F.struct(F.lit(False).alias("open"), F.lit(None).cast("string").alias("needed"), F.lit(0).cast("long").alias("weight"))),
                     F.transform(F.coalesce("depends_on", F.array().cast("array<string>")), lambda x: F.struct(F.lit(True).alias("open"), x.alias("needed"), F.lit(1).cast("long").alias("weight"))))
    rows = calls.select(*key, F.explode(given).alias("n")).select(*key, "n.*")
    done, links, every, needed = [], [], None, []  # needed: the tables that the result reads
    while True:
        edges = scratch.keep(rows.groupBy(*key, "open", "needed").agg(F.max("weight").alias("weight")), "edges")
        seen = Observation()
        own = edges.groupBy(*key).agg(
            F.count_if("open").alias("left"), F.max(F.when(~F.col("open"), F.col("weight"))).alias("least"), F.max(F.when(F.col("open"), F.col("needed"))).alias("needed"), F.max(F.when(F.col("open"), F.col("weight"))).alias("weight"),
        ).observe(seen, F.count_if(F.col("left") == 0).alias("ready"), F.count_if(F.col("left") == 1).alias("links"), F.count_if(F.col("left") > 1).alias("more"))
        calls_left = scratch.keep(own, "calls")
        every = calls_left.select(*key) if every is None else every  # a row a call
        needed.append(calls_left)
        found = seen.get
        if not found.get("ready") and not found.get("links"):
            break  # nothing can move: unknown needs and circles
        ready = calls_left.filter("left = 0").select(*key, F.col("least").alias("level"))
        done.append(ready)
        known = ready.withColumns({"least": F.col("level"), "needed": F.lit(None).cast("string"), "weight": F.lit(0).cast("long")})
        if found["links"]:
            ends = _chain_ends(scratch, calls_left.filter("left = 1").select(*key, "least", "needed", "weight"))
            at = ready.select("conv_id", F.col("call_id").alias("needed"), F.col("level").alias("__level"))
            reached = F.when(F.col("__level").isNotNull(), F.greatest("least", F.col("__level") + F.col("weight")))
            link = scratch.keep(ends.join(at, ["conv_id", "needed"], "left").select(*key, reached.alias("level"), "least", "needed", "weight"), "links")
            links.append(link)
            known = known.select(*link.columns).unionByName(link)
        if not found["more"]:
            break
        # Needs of what is left: a number where the need has a level, its chain's end where it is a link, itself otherwise.
        behind = known.select("conv_id", F.col("call_id").alias("needed"), F.lit(True).alias("__known"), F.col("level").alias("__level"), F.col("least").alias("__least"), F.col("needed").alias("__end"), F.col("weight").alias("__on"))
        several = calls_left.filter("left > 1").select(*key)
        met = edges.join(several, key, "left_semi").join(behind, ["conv_id", "needed"], "left")
        number = F.struct(F.lit(False).alias("open"), F.lit(None).cast("string").alias("needed"), (F.col("weight") + F.coalesce("__level", "__least", F.lit(0))).alias("weight"))
        moved = F.struct(F.lit(True).alias("open"), F.col("__end").alias("needed"), (F.col("weight") + F.col("__on")).alias("weight"))
        same = F.struct("open", "needed", "weight")
        rows = met.select(*key, F.explode(F.when(F.col("__known").isNull(), F.array(same)).when(F.col("__level").isNotNull(), F.array(number)).otherwise(F.array(number, moved))).alias("n")).select(*key, "n.*")
    for link in reversed(links):  # what waited for a later contraction, the last first
        settled = link.filter("level IS NOT NULL").select(*key, "level")
        if link is links[-1]:
            needed.append(link)
        else:
            later = reduce(DataFrame.unionByName, done).select("conv_id", F.col("call_id").alias("needed"), F.col("level").alias("__level"))
            late = link.filter("level IS NULL").join(later, ["conv_id", "needed"]).select(*key, F.greatest("least", F.col("__level") + F.col("weight")).alias("level"))
            settled = scratch.keep(settled.unionByName(late), "settled")
            needed.append(settled)
        done.append(settled)
    scratch.drop_others(*needed)
    if not done:
        return every.withColumn("level", F.lit(None).cast("int"))
    return every.join(reduce(DataFrame.unionByName, done).withColumn("level", F.col("level").cast("int")), key, "left")


def _chain_ends(scratch: Scratch, links: DataFrame) -> DataFrame:
    """conv_id, call_id, least, needed, weight: each link's need moved to the first that is no link, by pointer jumping.

    What still points at a link after a round is counted; distances to ends have no gaps, so if a round brings none of those to its end, they
    run in circles.
    """
    at, before, jumps = links.withColumn("going", F.lit(True)), None, 1
    while True:
        step = at
        for k in range(jumps):
            ahead = at.select("conv_id", F.col("call_id").alias("needed"), F.col("least").alias("__least"), F.col("needed").alias("__end"), F.col("weight").alias("__on"))
            met = step.join(ahead, ["conv_id", "needed"], "left")
            hit = F.col("__on").isNotNull()
            step = met.select(
                "conv_id", "call_id", F.greatest("least", F.col("__least") + F.col("weight")).alias("least"), F.when(hit, F.col("__end")).otherwise(F.col("needed")).alias("needed"),
                (F.col("weight") + F.coalesce("__on", F.lit(0))).alias("weight"), (hit if k == jumps - 1 else F.lit(True)).alias("going"),
            )
        seen = Observation()
        moved = scratch.keep(step.observe(seen, F.count_if("going").alias("going")), "ends")
        going = seen.get.get("going") or 0
        if before is not None:
            scratch.drop(at)
        if going == 0 or going == before:
            return moved
        at, before, jumps = moved, going, 3


#: What a reply takes.
SCHEMAS = {"reply": {"prompt": {"type": "string", "required": True, "minLength": 1}, "words": {"type": "integer", "required": True, "minimum": 1, "maximum": 100}}}


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """A user's turn calls the tool `reply`, identified by conversation and turn; the assistant's next turn is its result; other turns are messages."""
    turn, key = F.col("turn"), F.col("conv_id").cast("string")
    user, assistant = F.coalesce(F.col("role") == "user", F.lit(False)), F.coalesce(F.col("role") == "assistant", F.lit(False))
    return conversations.select(
        "conv_id", "turn", "role", F.col("text").alias("content"),
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        F.when(user, F.concat(key, F.lit("-"), turn.cast("string"))).when(assistant, F.concat(key, F.lit("-"), (turn - 1).cast("string"))).alias("call_id"),
        F.when(user, F.lit("reply")).alias("tool"),
        F.when(user, F.to_json(F.struct(word_count(F.col("text")).alias("words"), F.col("text").alias("prompt")))).alias("arguments"),
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(turns_as_calls(table(spark, sf_dir, "conversations")), SCHEMAS)


ORACLE = """
WITH m AS (
  SELECT conv_id, turn, role, text,
    CASE WHEN role = 'user' THEN 'call' WHEN role = 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE WHEN role = 'user' THEN conv_id || '-' || turn WHEN role = 'assistant' THEN conv_id || '-' || (turn - 1) END AS call_id,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS words
  FROM conversations),
links AS (
  SELECT conv_id, call_id, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'result') AS results,
    min(turn) FILTER (kind = 'call') AS call_turn, min(turn) FILTER (kind = 'result') AS result_turn
  FROM m WHERE kind <> 'message' GROUP BY ALL)
SELECT m.conv_id, m.turn, m.kind, m.call_id,
  CASE WHEN kind = 'message' THEN 'message' WHEN calls IS NULL THEN 'unidentified' WHEN kind = 'call' AND calls > 1 THEN 'repeated'
    WHEN kind = 'call' THEN CASE WHEN results > 0 THEN 'answered' ELSE 'unanswered' END
    ELSE CASE WHEN calls > 0 THEN 'linked' ELSE 'orphan' END END AS status,
  CASE kind WHEN 'call' THEN result_turn WHEN 'result' THEN call_turn END AS linked_turn,
  CASE WHEN kind = 'result' THEN greatest(m.turn, call_turn) ELSE m.turn END AS order_turn,
  CASE WHEN kind = 'result' AND call_turn >= m.turn THEN 1 ELSE 0 END AS order_rank,
  CASE WHEN kind = 'result' AND m.call_id IS NOT NULL THEN CASE WHEN calls > 0 THEN 1 END ELSE 0 END AS level,
  CASE WHEN kind = 'call' THEN concat_ws('; ',
    CASE WHEN text IS NULL THEN 'prompt: missing' WHEN length(text) < 1 THEN 'prompt: minLength' END,
    CASE WHEN words < 1 THEN 'words: minimum' WHEN words > 100 THEN 'words: maximum' END) ELSE '' END AS problems,
  CASE kind
    WHEN 'call' THEN '{"arguments":' || CASE WHEN text IS NULL THEN '{' ELSE '{"prompt":' || to_json(text)::VARCHAR || ',' END || '"words":' || words || '},'
      || coalesce('"call_id":' || to_json(m.call_id)::VARCHAR || ',', '') || '"role":"user","tool":"reply"' || coalesce(',"turn":' || m.turn, '') || '}'
    ELSE '{' || concat_ws(',', CASE WHEN kind = 'result' THEN '"call_id":' || to_json(m.call_id)::VARCHAR END, '"content":' || to_json(text)::VARCHAR, '"role":' || to_json(role)::VARCHAR, '"turn":' || m.turn) || '}' END AS json
FROM m LEFT JOIN links l ON m.conv_id = l.conv_id AND m.call_id = l.call_id
"""
