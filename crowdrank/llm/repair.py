"""Operator 11: conversation structure repair by iterative-deepening A*.

A conversation should read ``(s?(ua)+)?`` in role initials: an optional system
turn, then user and assistant in turn, the assistant last; or nothing.  Its
turns are edited in order: Keep (0), Rerole to user or assistant (3), Delete
(4, the only edit of a blank or repeated turn) and Insert an empty user or
assistant turn anywhere (3); a truncated turn that is not deleted adds 3.

*Search.*  A state is (turn, what the structure expects next).  Depth-first
search takes edits in ASCII order of their initials (D, I, K, R) under a bound
on the whole cost; the next bound is the least estimate that went beyond.  The
estimate is what the remaining turns cost whatever the structure.  A table keeps,
for each state that failed, the least cost it has been shown to need, so
that it is entered again only with more.  The first path that is accepted
under the least sufficient bound is the cheapest, and among those the least in
ASCII order.  What Rerole and Insert make follows from the state, so the
initials (the audit) say all.

*Any length.*  Turns are put in order by one range shuffle of narrow rows (no
text) and cut into blocks of ``BLOCK`` turns, so one long conversation is many
blocks.  A stretch that lies inside a block is searched at once.  One that
touches a block's edge may go on beyond it: it is searched from each state it
could be entered in to each it could be left in, and the stretches of a
conversation are then chained by their costs.  Inserts belong to the turn they
precede, so that an audit of a stretch is never the start of another one, and
the least audit of the whole is made of the least audits of its stretches.
Equal turns (turn number, role, text) are one row with a count: all but the
first are deleted.

*Order.*  By turn number, NULL first; ties by role, then by the SHA-256 of the
text.  Defined cases: NULL role or text reads as one space, so the turn fits
nowhere or is blank; an empty role has no initial and fits nowhere; NULL
conversation ids are one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdrank.llm.common import lean_batches, materialise

# States: nothing yet, after system, after user, after assistant.  Accepting: START, ASSISTANT.
START, SYSTEM, USER, ASSISTANT = range(4)
NEEDS = "uuau"  # the initial that an Insert or a Rerole makes in each state
AFTER = (USER, USER, ASSISTANT, USER)  # the state after it
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3  # costs
#: What a conversation that stops in a state still needs: cost and edits.
ENDING = {START: (0, ""), SYSTEM: (2 * INSERT, "IuIa"), USER: (INSERT, "Ia"), ASSISTANT: (0, "")}
END = 4  # "left" at the end of the conversation
NEVER = 1 << 40
BLOCK = 64  # turns searched at once
CHUNK_BITS = 11  # 2,048 turns are handed to Python at once
TASK_TURNS = 16_384  # turns per task of the search: bytes say nothing of its time
MOST_INSERTS = 2  # at one place; two more would come back to the same state
ROLE = {"u": "user", "a": "assistant"}
SPACE = r"\x20\x09-\x0D"


# --- the search ---------------------------------------------------------------


@lru_cache(maxsize=None)
def moves(state: int, initial: str, forced: bool, truncated: bool) -> tuple[tuple[str, int, int], ...]:
    """(edits, cost, next state) of one turn in ASCII order of the initials:
    none or some Inserts, then Delete, Keep or Rerole.  Edits are upper-case
    initials; what an Insert or a Rerole makes follows in lower case.  Inserts
    just before a Delete are left out: after it they cost the same and come
    first in ASCII order."""
    out = [("D", DELETE, state)]
    if forced:
        return tuple(out)
    extra = TRUNCATED if truncated else 0
    made, cost, at = "", 0, state
    for _ in range(MOST_INSERTS + 1):
        kept = KEEPS.get((at, initial))
        if kept is not None:
            out.append((f"{made}K", cost + extra, kept))
        out.append((f"{made}R{NEEDS[at]}", cost + REROLE + extra, AFTER[at]))
        made, cost, at = f"{made}I{NEEDS[at]}", cost + INSERT, AFTER[at]
    return tuple(sorted(out, key=lambda m: audit_of(m[0])))


def audit_of(edits: str) -> str:
    return "".join(c for c in edits if c.isupper())


Turn = tuple[str, bool, bool, int]  # initial, forced to go, truncated, further copies (all go)


class Stretch:
    """Consecutive turns, searched to one state they may be left in."""

    def __init__(self, turns: list[Turn], leave: int):
        self.turns, self.leave = turns, leave
        n = len(turns)
        self.estimate = [0] * (n + 1)
        possible = [set() for _ in range(n)] + [{START, SYSTEM, USER, ASSISTANT} if leave == END else {leave}]
        for i in range(n - 1, -1, -1):
            _, forced, truncated, copies = turns[i]
            least = DELETE if forced else TRUNCATED if truncated else 0
            self.estimate[i] = self.estimate[i + 1] + least + DELETE * copies
            possible[i] = {
                s for s in (START, SYSTEM, USER, ASSISTANT)
                if any(to in possible[i + 1] for _, _, to in moves(s, *turns[i][:3]))
            }
        self.possible = possible
        self.shown: dict[tuple[int, int], int] = {}  # failed states: the least cost they need

    def needs(self, i: int, state: int) -> int:
        if state not in self.possible[i]:
            return NEVER
        return self.shown.get((i, state), self.estimate[i])

    def descend(self, i: int, state: int, left: int, path: list[str]) -> int:
        """-1 with ``path`` (from its end) if the rest costs at most ``left``,
        else the least cost that the rest has been shown to need."""
        if i == len(self.turns):
            cost, edits = ENDING[state] if self.leave == END else (0, "")
            if cost <= left:
                path.append(edits)
                return -1
            return cost
        least = NEVER
        initial, forced, truncated, copies = self.turns[i]
        for edits, cost, to in moves(state, initial, forced, truncated):
            cost += DELETE * copies
            need = self.needs(i + 1, to)
            if cost + need <= left:
                need = self.descend(i + 1, to, left - cost, path)
                if need < 0:
                    path.append(edits + "D" * copies)
                    return -1
            least = min(least, cost + need)
        self.shown[i, state] = least
        return least

    def search(self, enter: int) -> tuple[int, str] | None:
        """(cost, edits by turn, each followed by ``;``, then those at the end)."""
        bound = self.needs(0, enter)
        while bound < NEVER:
            path: list[str] = []
            beyond = self.descend(0, enter, bound, path)
            if beyond < 0:
                return bound, ";".join(reversed(path))
            bound = beyond
        return None


# --- turns, faults, order -----------------------------------------------------


def turn_units(turns: DataFrame) -> DataFrame:
    """One row per distinct (conversation, turn number, role, text) of
    ``turns`` (conv_id, turn, role, text), with how often it is there."""
    spaced = F.lit(" ")
    rows = turns.select(
        turns["conv_id"].cast("string").alias("conv"), turns["turn"].cast("long").alias("turn"),
        F.coalesce(turns["role"], spaced).alias("role"), F.coalesce(turns["text"], spaced).alias("text"),
    )
    mark = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    return rows.withColumn("mark", mark).groupBy("conv", "turn", "role", "mark").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")
    )


def with_faults(units: DataFrame) -> DataFrame:
    """The first fault of each row, without the texts: ``blank``, ``repeated``
    (role and text seen at an earlier turn) and ``truncated``."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    narrow_units = units.select(
        "conv", "turn", "role", "mark", "copies", blank.alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("cut_off"),
    )
    # The first turn of a text is one row per text, joined on all that names a
    # row, so a text that fills a conversation is no hot key.
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = narrow_units.groupBy("conv", "role", "mark").agg(F.min(place).alias("p")).select(
        F.col("conv").alias("c"), F.col("p.turn").alias("t"), F.col("role").alias("r"), F.col("mark").alias("m"),
        F.lit(True).alias("is_first"),
    )
    same = (
        F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m"))
    )
    repeated = ~F.col("blank") & F.col("is_first").isNull()
    return narrow_units.join(first, same, "left").select(
        "conv", "turn", "role", "mark", "copies", "blank", repeated.alias("repeated"),
        (~F.col("blank") & ~repeated & F.col("cut_off")).alias("truncated"),
    )


def in_order(faults: DataFrame) -> DataFrame:
    """``faults`` with ``pos``, the place in the whole order, written once so
    that every later step sees the same places."""
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("mark").asc()]
    placed = faults.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(placed.withColumn("pos", F.monotonically_increasing_id()), "turns-in-order")


# --- stretches ----------------------------------------------------------------

STRETCH = (
    "conv string, pos long, turns long, first string, last string, illegal long, whole boolean, "
    "options array<struct<enter:int,leave:int,cost:long,rank:int,edits:string>>"
)
LEGAL = {"su", "ua", "au"}


def _stretch(part: pd.DataFrame, opens: bool, closes: bool) -> tuple:
    """One row of ``STRETCH``; ``opens`` and ``closes`` say whether the turns
    are known to start and to end their conversation."""
    initials = [role[:1] for role in part["role"]]
    copies = part["copies"].tolist()
    forced = (part["blank"] | part["repeated"]).tolist()
    turns = list(zip(initials, forced, part["truncated"].tolist(), [c - 1 for c in copies]))
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])) + sum(copies) - len(copies)
    options = []
    for enter in (START,) if opens else (START, SYSTEM, USER, ASSISTANT):
        options.append((enter, []))
    for leave in (END,) if closes else (START, SYSTEM, USER, ASSISTANT):
        stretch = Stretch(turns, leave)  # what one entry shows helps the next
        for enter, found in options:
            best = stretch.search(enter)
            if best is not None:
                found.append((leave, *best))
    rows = []
    for enter, found in options:
        found.sort(key=lambda f: audit_of(f[2]))
        rows += [(enter, leave, cost, rank, edits) for rank, (leave, cost, edits) in enumerate(found)]
    first = part.iloc[0]
    return (
        first["conv"], int(first["pos"]), len(turns), initials[0], initials[-1], illegal, opens and closes, rows
    )


def _stretches(chunk: pd.DataFrame) -> pd.DataFrame:
    """Searches the stretches of one chunk, block by block."""
    chunk = chunk.sort_values("pos", ignore_index=True)
    conv = chunk["conv"].tolist()
    out = []
    for start in range(0, len(chunk), BLOCK):
        end = min(start + BLOCK, len(chunk))
        at = start
        while at < end:
            to = at + 1
            while to < end and conv[to] == conv[at]:
                to += 1
            # Only inside the chunk is the row before or after known.
            opens = at > 0 and conv[at - 1] != conv[at]
            closes = to < len(chunk) and conv[to] != conv[at]
            out.append(_stretch(chunk.iloc[at:to], opens, closes))
            at = to
    return pd.DataFrame(out, columns=[f.split()[0] for f in STRETCH.split(", ")])


CHAIN = "pos long, enter int, leave int, tail string, tail_cost long, joints long"


def _chain(parts: pd.DataFrame) -> pd.DataFrame:
    """Which option each stretch of one conversation takes: the cheapest whole,
    the least audit among those.  Costs are added from the end, options are
    taken from the start by rank."""
    parts = parts.sort_values("pos", ignore_index=True)
    options = [
        [(o["enter"], o["leave"], o["cost"], o["rank"]) for o in row] for row in parts["options"]
    ]
    rest = [{s: cost for s, (cost, _) in ENDING.items()} | {END: 0}]
    for row in reversed(options):
        need: dict[int, int] = {}
        for enter, leave, cost, _ in row:
            need[enter] = min(need.get(enter, NEVER), cost + rest[-1].get(leave, NEVER))
        rest.append(need)
    rest.reverse()
    state, out = START, []
    for k, row in enumerate(options):
        fits = [
            (rank, leave) for enter, leave, cost, rank in row
            if enter == state and cost + rest[k + 1].get(leave, NEVER) == rest[k][state]
        ]
        _, leave = min(fits)
        joint = int(k > 0 and parts["last"][k - 1] + parts["first"][k] not in LEGAL)
        out.append([int(parts["pos"][k]), state, leave, "", 0, joint])
        state = leave
    if state != END:
        out[-1][3], out[-1][4] = ENDING[state][1], ENDING[state][0]
    return pd.DataFrame(out, columns=[f.split()[0] for f in CHAIN.split(", ")])


def choose_edits(placed: DataFrame) -> DataFrame:
    """(conv, pos, turns, cost, illegal, edits) per stretch of ``in_order``'s rows."""
    chunk = F.shiftright("pos", CHUNK_BITS)  # places start anew in every partition, far apart
    columns = ["conv", "pos", "role", "copies", "blank", "repeated", "truncated"]
    tasks = placed.count() // TASK_TURNS + 1
    stretches = materialise(
        placed.select(*columns, chunk.alias("chunk")).repartition(tasks, "chunk").groupBy("chunk")
        .applyInPandas(lambda rows: _stretches(rows), STRETCH),
        "stretches",
    )
    took = F.col("options")[0]
    whole = stretches.where("whole").select(
        "conv", "pos", "turns", took["cost"].alias("cost"), "illegal", took["edits"].alias("edits")
    )
    open_ended = stretches.where("not whole")
    bare = F.transform("options", lambda o: F.struct(
        o["enter"].alias("enter"), o["leave"].alias("leave"), o["cost"].alias("cost"), o["rank"].alias("rank")
    ))
    chained = (
        open_ended.select("conv", "pos", "first", "last", bare.alias("options"))
        .groupBy("conv").applyInPandas(lambda rows: _chain(rows), CHAIN)
    )
    option = F.filter("options", lambda o: (o["enter"] == F.col("enter")) & (o["leave"] == F.col("leave")))[0]
    pieced = open_ended.join(chained, "pos").select(
        "conv", "pos", "turns", (option["cost"] + F.col("tail_cost")).alias("cost"),
        (F.col("illegal") + F.col("joints")).alias("illegal"),
        F.concat(option["edits"], F.col("tail")).alias("edits"),
    )
    return materialise(whole.unionByName(pieced), "chosen-edits")


# --- results ------------------------------------------------------------------


def summaries(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit."""
    copies = F.col("copies")

    def count(when: Column, how_many: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, how_many)), F.lit(0)).cast("long")

    faults = placed.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        count(F.col("blank"), copies).alias("blank"),
        count(~F.col("blank"), F.when(F.col("repeated"), copies).otherwise(copies - 1)).alias("duplicate"),
        count(F.col("truncated"), F.lit(1)).alias("truncated"),
    )
    audit = F.regexp_replace("edits", "[a-z;]", "")
    edits = chosen.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_sort(F.collect_list(F.struct("pos", audit.alias("audit")))).alias("audits"),
    )
    return faults.alias("f").join(edits.alias("e"), F.expr("f.conv <=> e.conv")).select(
        "f.conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
        F.array_join(F.transform("audits", lambda a: a["audit"]), "").alias("audit"),
    )


def repaired_turns(units: DataFrame, placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv, pos, step, role, text) of the turns that stay or are put in, in
    the order of (pos, step)."""
    pieces = F.split("edits", ";")
    by_turn = chosen.select("pos", "turns", F.posexplode(pieces).alias("k", "edit")).where("edit rlike '[IKR]'").select(
        F.least(F.col("pos") + F.col("k"), F.col("pos") + F.col("turns") - 1).alias("pos"),
        (F.col("k") == F.col("turns")).alias("at_end"), "edit",
    )
    named = by_turn.join(placed.select("pos", "conv", "turn", "role", "mark"), "pos")
    texts = units.select(
        F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("mark").alias("m"), "text"
    )
    same = (
        F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m"))
    )
    made = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    # An edit is its initial, for I and R followed by the initial that is made.
    steps = F.regexp_extract_all("edit", F.lit("([IR][ua]|K)"), F.lit(1))
    return (
        named.join(texts, same)
        .select("conv", "pos", "at_end", "role", "text", F.posexplode(steps).alias("k", "step"))
        .select(
            "conv", "pos", (F.col("k") + F.when(F.col("at_end"), 1000).otherwise(0)).alias("step"),
            F.when(F.col("step") == "K", F.col("role")).otherwise(made[F.substring("step", 2, 1)]).alias("role"),
            F.when(F.col("step").startswith("I"), "").otherwise(F.col("text")).alias("text"),
        )
    )


def _stream_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    nothing = object()
    conv, digest = nothing, None
    for batch in batches:
        done = []
        for name, line in zip(batch["conv"], batch["line"]):
            if conv is nothing or name != conv:
                if conv is not nothing:
                    done.append((conv, digest.hexdigest()))
                conv, digest = name, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        yield pd.DataFrame(done, columns=["conv", "sha256"])
    if conv is not nothing:
        yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv", "sha256"])


def conversation_hashes(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of the ``role:text`` lines of each conversation, joined
    by newlines.  A hash runs through its conversation in order, so a
    conversation's lines pass one task, streamed: one batch is in memory."""
    lean_batches(turns.sparkSession)
    lines = turns.select("conv", "pos", "step", F.concat_ws(":", "role", "text").alias("line"))
    ordered = lines.repartition("conv").sortWithinPartitions("conv", "pos", "step")
    return ordered.select("conv", "line").mapInPandas(_stream_hashes, "conv string, sha256 string")


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs ``turns`` (conv_id, turn, role, text; other columns take no
    part).  Returns the summary per conversation (its id as text, ``conv``) and
    the repaired turns."""
    units = materialise(turn_units(turns), "turn-units")
    placed = in_order(with_faults(units))
    chosen = choose_edits(placed)
    return summaries(placed, chosen), repaired_turns(units, placed, chosen)


def damage(conversations: DataFrame) -> DataFrame:
    """A test harness: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped
    (0), emptied (1), loses its ``[.!?]`` (2), is repeated (3) or gets the role
    user (4).  NULLs read as one space."""
    spaced = F.lit(" ")
    name = F.concat(
        F.coalesce(conversations["conv_id"].cast("string"), spaced), F.lit(":"),
        F.coalesce(conversations["turn"].cast("string"), spaced),
    )
    draw = F.crc32(name.cast("binary")) % 20
    text = F.coalesce(conversations["text"], spaced)
    return conversations.select(
        "conv_id", "turn",
        F.when(draw == 4, "user").otherwise(F.coalesce(conversations["role"], spaced)).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(draw == 0, F.array().cast("array<int>")).when(draw == 3, F.array(F.lit(0), F.lit(1)))
                  .otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
