"""Conversation repair, fill-in-the-middle and sharding against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from crowdrank.llm import fill_middle, queries, repair, sharding
from tests.llm.conftest import docs_rows

SHAPE = "(s?(ua)+)?"
ROLE = {"u": "user", "a": "assistant"}


# --- 11: conversation repair ----------------------------------------------------


def ordered(rows):
    """Turns of one conversation with their faults, in the stated order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda w: (w[0] is not None, w[0] or 0, w[1], hashlib.sha256(w[2].encode()).digest()))
    seen, out = set(), []
    for turn, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        if not last:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if last[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def brute_repair(rows):
    """(cost, audit, repaired lines) by uniform-cost search over whole role strings."""
    turns = ordered(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch(SHAPE, roles):
            return cost, audit, "\n".join(lines)
        if (i, roles) in done:
            continue
        done.add((i, roles))

        def go(extra, edit, j, initial, line, now=(cost, audit, roles, lines)):
            c, a, r, ls = now
            if initial is None:
                heapq.heappush(heap, (c + extra, a + edit, j, r, ls))
            elif initial and regex.fullmatch(SHAPE, r + initial, partial=True):
                heapq.heappush(heap, (c + extra, a + edit, j, r + initial, (*ls, line)))

        for initial, role in ROLE.items():
            go(3, "I", i, initial, f"{role}:")
        if i < len(turns):
            _, role, text, fault = turns[i]
            go(4, "D", i + 1, None, None)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                go(more, "K", i + 1, role[:1], f"{role}:{text}")
                for initial, name in ROLE.items():
                    go(3 + more, "R", i + 1, initial, f"{name}:{text}")


def chained_repair(rows):
    """The same by a table over the four states, for long conversations."""
    turns = ordered(rows)
    best = {"": (0, "", ())}

    def grown(table):
        out = dict(table)
        for _ in range(3):
            for at, (cost, audit, lines) in list(out.items()):
                to = "a" if at == "u" else "u"
                new = (cost + 3, audit + "I", (*lines, f"{ROLE[to]}:"))
                out[to] = min(out.get(to, new), new)
        return out

    for _, role, text, fault in turns:
        more = 3 if fault == "truncated" else 0
        step: dict = {}

        def offer(state, entry):
            step[state] = min(step.get(state, entry), entry)

        for at, (cost, audit, lines) in grown(best).items():
            offer(at, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            if role[:1] and at + role[:1] in ("s", "u", "su", "ua", "au"):
                offer(role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            to = "a" if at == "u" else "u"
            offer(to, (cost + 3 + more, audit + "R", (*lines, f"{ROLE[to]}:{text}")))
        best = step
    ends = grown(best)
    cost, audit, lines = min(ends[s] for s in ("", "a") if s in ends)
    return cost, audit, "\n".join(lines)


def stated(rows):
    turns = ordered(rows)
    numbers = [t for t, *_ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    faults = Counter(f for *_, f in turns)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal


def random_turns(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "cut off", "", " \t\n", None, "Why?  ", "end.\x0b", "well ", "...", "ok"]
    texts += [f"line {k}{'.' if k % 5 else ''}" for k in range(60)]
    return [(rng.choice([k, k, k, k, k - 1, None]), rng.choice(roles[:2] if k % 9 else roles), rng.choice(texts))
            for k in range(n)]


def test_search_equals_uniform_cost_search():
    rng = random.Random(3)
    for _ in range(250):
        rows = random_turns(rng, rng.randint(1, 6))
        turns = [(r[:1], f in ("blank", "duplicate"), f == "truncated", 0) for _, r, _, f in ordered(rows)]
        cost, edits = repair.Stretch(turns, repair.END).search(repair.START)
        want = brute_repair(rows)
        assert (cost, repair.audit_of(edits)) == want[:2]
        assert chained_repair(rows) == want


def test_failed_states_are_not_searched_again():
    rng = random.Random(4)
    rows = [("u" if rng.random() < 0.6 else "a", rng.random() < 0.1, rng.random() < 0.1, 0) for _ in range(64)]
    stretch, calls = repair.Stretch(rows, repair.END), Counter()
    descend = stretch.descend

    def counted(i, state, left, path):
        calls[i, state, left] += 1
        return descend(i, state, left, path)

    stretch.descend = counted
    assert stretch.search(repair.START)
    assert max(calls.values()) <= 2


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(5)
    talks = {k: random_turns(rng, rng.randint(1, 7)) for k in range(120)}
    talks[500] = random_turns(rng, 330)  # many blocks
    talks[501] = [(1, "user", "same.")] * 200 + [(2, "assistant", "end.")]  # one row, often
    talks[502] = [(None, "user", "a."), (None, "assistant", "b.")]
    talks[None] = random_turns(rng, 5)
    return talks


def result_of(spark, talks, block=repair.BLOCK, chunk_bits=repair.CHUNK_BITS):
    rows = [(c, t, r, x, "c", 7) for c, turns in talks.items() for t, r, x in turns]
    random.Random(6).shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, pos int")
    summary, turns = repair.repair_conversations(frame.repartition(5))
    hashes = {r.conv: r.sha256 for r in repair.conversation_hashes(turns).collect()}
    return {
        r.conv: ((r.gaps, r.blank, r.duplicate, r.truncated, r.illegal), r.cost, r.audit, hashes.get(r.conv))
        for r in summary.collect()
    }


def test_repair_equals_the_table_at_any_block_size(spark, conversations, monkeypatch):
    want = {}
    for conv, rows in conversations.items():
        cost, audit, lines = chained_repair(rows)
        digest = hashlib.sha256(lines.encode()).hexdigest() if lines else None
        want[None if conv is None else str(conv)] = (stated(rows), cost, audit, digest)
    assert result_of(spark, conversations) == want
    monkeypatch.setattr(repair, "BLOCK", 3)
    monkeypatch.setattr(repair, "CHUNK_BITS", 4)
    assert result_of(spark, conversations) == want


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    summary, turns = repair.repair_conversations(repair.damage(none))
    assert summary.count() == 0 and repair.conversation_hashes(turns).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(10)]
    rows += [(None, None, None, None), (7, 99, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = Counter()
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        want[c, t, "user" if draw == 4 else role, text] += {0: 0, 3: 2}.get(draw, 1)
    assert Counter(map(tuple, repair.damage(frame).collect())) == +want


# --- 12: fill-in-the-middle -------------------------------------------------------


def brute_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(text), "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_equals_slices_and_round_trips(spark, odd_docs):
    more = [(k, t, "en", "s", 0) for k, t in enumerate(
        ["<", "<<", "<P", "a<P>b", "x<S>", "<M", "<S<P", "\U0001f600" * 9, "é" * 50, "<M<M<"] * 12, 1000
    )]
    rows = docs_rows() + more
    frame = odd_docs.select("doc_id", "text", F.col("n").alias("fim")).unionByName(
        spark.createDataFrame([(r[0], r[1], "x") for r in more], "doc_id long, text string, fim string")
    )
    done = fill_middle.fill_in_middle(frame)
    form, out = F.col("fim.form"), F.col("fim.output")
    got = done.select(
        "doc_id", "text", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", out.alias("output"),
        F.col("fim.sha256").alias("sha"), fill_middle.restore(out, form).alias("back"),
        fill_middle.restored_sha256(out, form).alias("back_sha"),
        fill_middle.piece_text(F.col("text"), F.col("fim.pieces")).alias("spelled"),
    ).collect()
    assert len(got) == len(rows)
    assert {"plain", "psm", "spm"} == {r.form for r in got}
    for r in got:
        text = r.text or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r.doc_id, r.text)
        assert r.back == text and r.spelled == r.output
        assert r.sha == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.back_sha == hashlib.sha256(text.encode()).hexdigest()


def test_piece_table_cuts_at_every_place():
    text = "a<P"
    for low in range(4):
        for high in range(low, 4):
            table = fill_middle.PieceTable.of(text)
            table.cut(low)
            table.cut(high)
            assert len(table.pieces) == 3 and table.text() == text
            for form in fill_middle.ARRANGEMENTS:
                assert fill_middle.PieceTable.parse(table.arrange(form).text(), form).text() == text


def test_fill_in_middle_of_nothing(no_docs):
    assert fill_middle.fill_in_middle(no_docs).count() == 0


# --- 13: sharding -----------------------------------------------------------------


def brute_shard(key, weights):
    import math

    name = "\x00" if key is None else str(key)

    def bid(shard):
        u = (int(hashlib.md5(f"{name}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        return -math.log(u) / weights[shard], shard

    return min(map(bid, weights))[1]


def test_shards_equal_brute_force_and_slots_are_gapless(spark, odd_docs):
    weights, grown = {0: 1.0, 1: 2.0, 2: 0.5}, {0: 1.0, 1: 2.0, 2: 0.5, 3: 1.0}
    out = sharding.number_rows(sharding.assign_shards(odd_docs, weights, grown))
    got = out.collect()
    want = Counter()
    for doc_id, text, *_ in docs_rows():
        data = (text or "").encode()
        to = brute_shard(doc_id, grown)
        shard = brute_shard(doc_id, weights)
        assert to in (shard, 3)
        want[doc_id, len(data) + 1, zlib.crc32(data), shard, to] += 1
    assert Counter((r.key, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_weights_share_the_records_and_growth_moves_few(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    weights = {0: 1.0, 1: 3.0}
    out = sharding.assign_shards(rows, weights, {**weights, 2: 1.0}).cache()
    share = out.where("shard = 1").count() / 20_000
    moved = out.where("shard <> grown_shard").count() / 20_000
    assert abs(share - 0.75) < 0.015 and abs(moved - 0.2) < 0.015
    with pytest.raises(ValueError):
        sharding.assign_shards(rows, {0: 0.0})


def test_a_hot_key_is_spread_over_partitions(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text")
    ).repartition(4)
    out = sharding.number_rows(sharding.assign_shards(rows, dict.fromkeys(range(4), 1.0)))
    slots = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("d"))
    assert all(r.n == r.top + 1 == r.d for r in slots.collect())


def test_sharding_of_nothing(no_docs):
    assert sharding.number_rows(sharding.assign_shards(no_docs, {0: 1.0})).count() == 0


# --- the registered queries -------------------------------------------------------


@pytest.mark.parametrize("name, columns", [
    ("op11_repair", "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"),
    ("op12_fill_middle", "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256"),
    ("op13_sharding", "doc_id size text_crc32 law shard slot grown_shard"),
])
def test_queries_return_the_stated_columns(spark, name, columns):
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert out.columns == columns.split()
    strings = {"form", "audit", "law"} | {c for c in out.columns if c.endswith("sha256")}
    for field in out.schema.fields:
        kind = "string" if field.name in strings else "int" if "shard" in field.name else "bigint"
        assert field.dataType.simpleString() == kind
