"""Tool calls and results: linked, ordered, validated and written as canonical JSON.

Everything is DataFrame work.  Calls and results meet in a hash join by call
id.  A call may depend on several others; its topological level is the length of
the longest path below it.  Every round joins the dependencies with what they
depend on themselves: a path through calls of one dependency doubles (pointer
doubling), and calls whose dependencies are all known are done.  Arguments are
parsed as variants, whose JSON text has its keys in order and no white space,
and checked field by field against the tool's schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdrank.llm.common import materialise, narrow

CALL_COLUMNS = ("group_id", "call_id", "seq", "name", "arguments", "depends_on")
RESULT_COLUMNS = ("group_id", "call_id", "seq", "content")


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, depth, state) of calls (call_id, depends_on array): depth 0
    without a known dependency, else one more than the deepest of those it
    depends on.  ``state``: ``ok``; ``missing`` if a path ends at an unknown
    call; ``cycle`` (depth NULL) if one never ends.  ``call_id`` must be unique
    and not NULL; NULL dependencies and NULL arrays are none, repeated ones one.

    Chains, and sections that open and close, take a number of rounds that grows
    with the logarithm of their length; calls that each need several calls of
    the level before take one round a level.
    """
    wanted = calls.select("call_id", F.explode("depends_on").alias("up")).where("up is not null").distinct()
    known = calls.select(F.col("call_id").alias("up"), F.lit(True).alias("known"))
    checked = materialise(wanted.join(known, "up", "left"), "dependencies")
    edges = checked.where("known").select("call_id", "up", F.lit(1).cast("long").alias("steps"))
    lost = checked.where("known is null").select("call_id", F.lit(True).alias("missing")).distinct()
    nodes = materialise(
        calls.select("call_id", F.lit(0).cast("long").alias("depth")).join(lost, "call_id", "left").select(
            "call_id", "depth", F.coalesce("missing", F.lit(False)).alias("missing"), F.lit(False).alias("endless")
        ),
        "call-nodes",
    )
    count = nodes.count()  # no path of more steps is without a cycle
    while not edges.isEmpty():
        below = edges.groupBy("call_id").agg(
            F.count("*").alias("ways"), F.min("up").alias("next_up"), F.min("steps").alias("more")
        )
        above = nodes.join(below, "call_id", "left").select(
            F.col("call_id").alias("up"), F.col("depth").alias("up_depth"), F.col("missing").alias("up_missing"),
            F.col("endless").alias("up_endless"), F.coalesce("ways", F.lit(0)).alias("ways"), "next_up", "more",
        )
        # A dependency without open ones of its own, or with one, hands on what it
        # knows; the second kind is passed over for the one below it.
        moved = materialise(
            edges.join(above, "up").select(
                "call_id",
                F.when(F.col("ways") == 1, F.col("next_up")).when(F.col("ways") > 1, F.col("up")).alias("up"),
                (F.col("steps") + F.when(F.col("ways") == 1, F.col("more")).otherwise(F.lit(0))).alias("steps"),
                (F.col("steps") + F.col("up_depth")).alias("depth"),
                F.col("up_missing").alias("missing"), F.col("up_endless").alias("endless"),
                (F.col("ways") <= 1).alias("told"),
            ).withColumn(
                "endless", F.col("endless") | F.coalesce(F.col("up") == F.col("call_id"), F.lit(False))
                | (F.col("steps") > F.lit(count))
            ),
            "call-dependencies",
        )
        news = moved.groupBy("call_id").agg(
            F.max("depth").alias("new_depth"), F.bool_or("missing").alias("new_missing"),
            F.bool_or("endless").alias("new_endless"),
        )
        stuck = moved.where("told or endless").isEmpty()  # every open call waits for several: all below cycles
        nodes = materialise(
            nodes.join(news, "call_id", "left").select(
                "call_id", F.greatest("depth", F.coalesce("new_depth", F.lit(0))).alias("depth"),
                (F.col("missing") | F.coalesce("new_missing", F.lit(False))).alias("missing"),
                (F.col("endless") | (F.coalesce("new_endless", F.lit(False)) | F.lit(stuck) & F.col("new_depth").isNotNull()))
                .alias("endless"),
            ),
            "call-nodes",
        )
        if stuck:
            break
        ended = nodes.where("endless").select("call_id")
        edges = materialise(
            moved.where("up is not null").join(ended, "call_id", "left_anti")
            .groupBy("call_id", "up").agg(F.max("steps").alias("steps")),
            "call-edges",
        )
    return nodes.select(
        "call_id", F.when(~F.col("endless"), F.col("depth")).alias("depth"),
        F.when(F.col("endless"), "cycle").when(F.col("missing"), "missing").otherwise("ok").alias("state"),
    )


def _with_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``parsed`` (variant) and ``errors`` (sorted strings)."""
    by_tool = schemas.groupBy("name").agg(
        F.sort_array(F.collect_set(F.struct("field", "type", "required"))).alias("fields")
    )
    given = "try_variant_get(parsed, '$', 'map<string,variant>')"
    return (
        calls.join(by_tool, "name", "left")
        .withColumn("parsed", F.expr("try_parse_json(arguments)"))
        .withColumn("given", F.expr(given))
        .withColumn("errors", F.expr("""
            case when fields is null then array('unknown tool')
                 when parsed is null then array('not json')
                 when given is null then array('not an object')
                 else array_sort(array_union(
                   transform(filter(fields, f -> f.required and given[f.field] is null),
                             f -> concat('missing ', f.field)),
                   array_union(
                     transform(filter(fields, f -> given[f.field] is not null
                                  and not startswith(schema_of_variant(given[f.field]), f.type)),
                               f -> concat('wrong type ', f.field)),
                     transform(filter(map_keys(given), k -> not array_contains(transform(fields, f -> f.field), k)),
                               k -> concat('unknown ', k))))) end"""))
        .drop("given", "fields")
    )


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result: (group_id, call_id, seq, kind, level,
    status, errors, json).

    ``calls`` has ``CALL_COLUMNS`` (``depends_on``: an array of call ids),
    ``results`` ``RESULT_COLUMNS`` and ``schemas`` (name, field, type, required), where type begins a variant
    type's name, as BIGINT or STRING; other columns are ignored.  ``level``
    orders topologically: a call at depth d has 2 d, its results 2 d + 1.

    Status of a call: ``ok``, ``unanswered``, ``missing`` (depends on an unknown
    call), ``cycle``, ``no id``, or ``repeated`` (an earlier call has its id; it
    is not linked and has no level).  Of a result: ``ok``, ``orphan``, ``no id``.
    Arguments that are NULL or no JSON are an error, written as null.  The JSON has
    ordered keys and no white space.  An id shared by many rows costs a row
    each: results meet only the first call of an id, by seq and arguments.
    """
    calls = narrow(calls, **{c: c for c in CALL_COLUMNS})
    results = narrow(results, **{c: c for c in RESULT_COLUMNS})
    checked = _with_errors(calls, schemas)
    identity = F.struct("seq", "group_id", "name", "arguments", "depends_on")
    firsts = materialise(
        calls.where("call_id is not null").groupBy("call_id")
        .agg(F.min(identity).alias("first"), F.count("*").alias("times")),
        "first-calls",
    )
    depth = levels(firsts.select("call_id", F.col("first.depends_on").alias("depends_on")))
    answered = results.where("call_id is not null").select("call_id").distinct().withColumn("answered", F.lit(True))
    known = firsts.join(depth, "call_id").join(answered, "call_id", "left")
    call_rows = checked.withColumn("own", F.struct("seq", "group_id", "name", "arguments", "depends_on")).join(
        known, "call_id", "left"
    ).select(
        "group_id", "call_id", "seq", F.lit("call").alias("kind"),
        F.when(F.col("own").eqNullSafe(F.col("first")), 2 * F.col("depth")).alias("level"),
        F.when(F.col("call_id").isNull(), "no id")
        .when(~F.col("own").eqNullSafe(F.col("first")), "repeated")
        .when(F.col("state") != "ok", F.col("state"))
        .when(F.col("answered"), "ok").otherwise("unanswered").alias("status"),
        "errors",
        F.to_json(
            F.struct(
                F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"),
                F.lit("call").alias("type"),
            ), {"ignoreNullFields": "false"},
        ).alias("json"),
    )
    result_rows = results.join(depth.select("call_id", "depth"), "call_id", "left").join(
        firsts.select("call_id", F.lit(True).alias("known")), "call_id", "left"
    ).select(
        "group_id", "call_id", "seq", F.lit("result").alias("kind"), (2 * F.col("depth") + 1).alias("level"),
        F.when(F.col("call_id").isNull(), "no id").when(F.col("known"), "ok").otherwise("orphan").alias("status"),
        F.expr("cast(array() as array<string>)").alias("errors"),
        F.to_json(
            F.struct(F.col("content").alias("content"), F.col("call_id").alias("id"), F.lit("result").alias("type")),
            {"ignoreNullFields": "false"},
        ).alias("json"),
    )
    return call_rows.unionByName(result_rows)


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as tool traffic: a user's turn is a call (``open`` for the
    first two turns, else ``follow``, which depends on the call two turns before
    and on the one that opened its section of ``SECTION`` turns); the assistant's
    next turn is its result.  Other roles are messages
    (``conversation_messages``).  Ids are ``conversation:turn``, NULL if either is.

    Arguments are spoilt by the length of the text, modulo ``SPOIL``: 0 loses the
    closing brace, 1 writes ``chars`` as text, 2 leaves out ``text``, 3 adds
    ``note``.  So the validation has something to find."""
    turns = narrow(conversations, group_id="conv_id", seq="turn", role="role", content="text")
    ident = lambda turn: F.concat_ws(":", F.col("group_id"), turn)
    named = F.col("group_id").isNotNull() & F.col("seq").isNotNull()
    follows = F.col("seq") >= 2
    opened = F.col("seq") - (F.col("seq") - F.col("seq") % 2) % SECTION
    before = F.array_distinct(F.array(
        ident(F.col("seq") - 2), ident(F.when(opened < F.col("seq"), opened).otherwise(F.col("seq") - 2))
    ))
    spoilt = F.coalesce(F.length("content") % SPOIL, F.lit(-1))
    written = F.to_json(F.struct(
        F.col("seq").alias("turn"),
        F.when(spoilt != 2, F.col("content")).alias("text"),
        F.when(spoilt != 1, F.length("content")).alias("chars"),
        F.when(follows, before).alias("after"),
        F.when(spoilt == 3, F.lit("spare")).alias("note"),
    ))
    as_text = F.concat(
        F.lit('{"chars":"'), F.length("content").cast("string"), F.lit('",'), written.substr(F.lit(2), F.length(written))
    )
    calls = turns.where("role = 'user'").select(
        "group_id", F.when(named, ident(F.col("seq"))).alias("call_id"), "seq",
        F.when(follows, "follow").otherwise("open").alias("name"),
        F.when(spoilt == 0, written.substr(F.lit(1), F.length(written) - 1))
        .when(spoilt == 1, as_text).otherwise(written).alias("arguments"),
        F.when(named & follows, before).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select(
        "group_id", F.when(named, ident(F.col("seq") - 1)).alias("call_id"), "seq", "content"
    )
    return calls, results


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """The turns that are neither call nor result (system and other roles, NULL
    among them), as rows like those of ``link_tool_calls``: kind ``message``,
    status ``ok``, no id, no level, no errors."""
    turns = narrow(conversations, group_id="conv_id", seq="turn", role="role", content="text")
    return turns.where("not coalesce(role in ('user', 'assistant'), false)").select(
        "group_id", F.lit(None).cast("string").alias("call_id"), "seq", F.lit("message").alias("kind"),
        F.lit(None).cast("long").alias("level"), F.lit("ok").alias("status"),
        F.expr("cast(array() as array<string>)").alias("errors"),
        F.to_json(F.struct("content", "role", F.lit("message").alias("type")), {"ignoreNullFields": "false"}).alias("json"),
    )


SECTION = 8  # turns that share an opening call
SPOIL = 23

#: Argument schemas of the tools that ``conversation_calls`` makes.
CONVERSATION_SCHEMAS = [
    ("open", "turn", "BIGINT", True), ("open", "text", "STRING", True), ("open", "chars", "BIGINT", True),
    ("follow", "turn", "BIGINT", True), ("follow", "text", "STRING", True), ("follow", "chars", "BIGINT", True),
    ("follow", "after", "ARRAY", True),
]
