"""Every operator against a brute-force version, on odd and empty tables."""

import base64
import hashlib
import json
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crowdrank.llm import (
    bpe, components, fingerprints, hamming_search, language_id, near_dedup, packing, quality, tool_calls,
    toxicity, url_filter,
)
from tests.llm.conftest import docs_rows, text_of

JSON_FILE = P.path("byte_bpe_50k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


# --- 2: packing -------------------------------------------------------------


def test_packing_covers_every_id_once(odd_docs):
    pieces = packing.pack_documents(odd_docs, JSON_FILE, window=64, segment_tokens=512).collect()
    plain = Tokenizer.from_file(JSON_FILE)
    want = Counter()
    for doc_id, text, *_ in docs_rows():
        want[doc_id, tuple(plain.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    windows = defaultdict(list)
    by_doc = defaultdict(list)
    for p in pieces:
        ids = struct.unpack(f"<{p.length}I", p.ids)
        windows[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id, p.doc_tokens].append((p.start, ids))
    for parts in windows.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
        assert sum(n for _, n in parts) <= 64
    tokens = sum(len(ids) * c for (_, ids), c in want.items())
    assert sum(p.length for p in pieces) == tokens
    for (doc_id, ids), times in want.items():
        if times == 1 and sum(1 for d, i in want if d == doc_id and len(i) == len(ids)) == 1:
            got = sorted(by_doc[doc_id, len(ids)])
            assert tuple(x for _, part in got for x in part) == ids
            assert [s for s, _ in got] == [0, *np.cumsum([len(i) for _, i in got])[:-1].tolist()]
    padding = sum(
        0 if n & (n - 1) == 0 else 64 - n for n in (sum(k for _, k in parts) for parts in windows.values())
    )
    assert padding < 0.05 * tokens


def test_packing_cuts_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(60):
        total, window = int(rng.integers(1, 60)), int(rng.integers(3, 12))
        sentences = np.unique(rng.integers(1, total + 1, int(rng.integers(1, 10))))
        docs = np.unique(np.append(rng.choice(sentences, max(1, len(sentences) // 2)), total))
        cuts = packing.choose_cuts(total, docs, sentences, window, 1.0, 12.0)
        assert cuts[-1] == total and all(0 < b - a <= window for a, b in zip([0, *cuts], cuts))

        kind = np.full(total + 1, 2)
        kind[sentences], kind[docs], kind[total] = 1, 0, 0
        fee = [0.0, 1.0, 12.0]
        natural = [p for p in range(1, total + 1) if kind[p] < 2]
        allowed = {*natural, *(p + window for p in natural[:-1]), *range(window, total, window)}
        best = {0: 0.0}
        for p in sorted(x for x in allowed if x <= total):
            reach = [best[q] + window - (p - q) for q in best if 0 < p - q <= window]
            if reach:
                best[p] = min(reach) + fee[kind[p]]
        cost = sum(window - (b - a) + fee[kind[b]] for a, b in zip([0, *cuts], cuts))
        assert cost == pytest.approx(best[total])


def test_packing_of_nothing(no_docs):
    assert packing.pack_documents(no_docs, JSON_FILE).count() == 0


# --- 10: byte-level BPE -------------------------------------------------------


def test_bpe_equals_the_library_and_decodes(odd_docs):
    encoded = bpe.encode_corpus(odd_docs, RANKS, P.PATTERN, block_tokens=300, word_buckets=3)
    got = Counter(
        (r.doc_id, r.n_tokens, r.ids, bytes(r.decoded)) for r in bpe.decode_ids(encoded, RANKS).collect()
    )
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for doc_id, text, *_ in docs_rows():
        ids = plain.encode_ordinary(text or "")
        want[doc_id, len(ids), struct.pack(f"<{len(ids)}I", *ids), (text or "").encode()] += 1
    assert got == want


def test_bpe_of_nothing(no_docs):
    assert bpe.encode_corpus(no_docs, RANKS, P.PATTERN).count() == 0


# --- 7: near duplicates -------------------------------------------------------


def brute_components(rows, size, percent):
    sets, parent = [], {}
    for doc_id, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        n = min(size, len(words))
        sets.append((doc_id, {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()))
        parent.setdefault(doc_id, doc_id)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return Counter(
        (d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets
    )


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_on_odd_rows(odd_docs, size):
    got = Counter(map(tuple, near_dedup.near_duplicates(odd_docs, shingle=size).collect()))
    assert got == brute_components([r[:2] for r in docs_rows()], size, 80)


def test_near_duplicates_of_chained_copies(spark):
    """Copies of copies whose ends are far apart, around the threshold."""
    rng = np.random.default_rng(3)
    rows, words = [], [f"a{i}" for i in range(80)]
    for k in range(120):
        words = list(words) if k % 30 else [f"b{k}_{i}" for i in range(80)]
        for at in rng.integers(0, 80, int(rng.integers(1, 7))):
            words[at] = f"c{rng.integers(0, 50)}"
        rows.append((int(rng.permutation(10_000)[0]) * 1000 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, near_dedup.near_duplicates(docs, shingle=2).collect()))
    assert got == brute_components(rows, 2, 80)


def related_clusters(each, clusters=3, words=120):
    """Clusters of near copies; texts of different clusters are alike, but not enough for a link."""
    rng, rows = np.random.default_rng(each), []
    common = [f"w{i}" for i in range(words)]
    for c in range(clusters):
        base = list(common)
        for at in range(c, words, 24):
            base[at] = f"own{c}_{at}"
        for k in range(each):
            text = list(base)
            text[int(rng.integers(0, words))] = f"x{c}_{k}"
            rows.append((c * 10_000 + k, " ".join(text)))
    return rows


@pytest.mark.parametrize("hot", [1_000, 7])
def test_related_clusters_are_not_paired_member_by_member(spark, monkeypatch, hot):
    """Pairs across clusters grow with the members, not with their product."""
    monkeypatch.setattr(near_dedup, "HOT_CLASS", hot)
    if hot == 7:  # the ways beyond the broadcast bounds
        monkeypatch.setattr(components, "MAX_BROADCAST_ROWS", 0)
        monkeypatch.setattr(near_dedup, "MAX_BROADCAST_SIDES", 0)
    formed, real, sizes = [], near_dedup._across, (20, 60) if hot > 7 else (40,)
    monkeypatch.setattr(near_dedup, "_across", lambda *given: formed.append(real(*given)) or formed[-1])
    for each in sizes:
        rows = related_clusters(each)
        docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string").repartition(4)
        got = Counter(map(tuple, near_dedup.near_duplicates(docs, shingle=2).collect()))
        assert got == brute_components(rows + rows[:9], 2, 80)
        assert len({c for _, _, c, _ in got}) == 3 and formed[-1].count() <= 2 * each


def test_wide_clusters_keep_their_links(spark):
    """Chains whose members lie far from any centre, with a few links between chains."""
    rng, rows, ends = np.random.default_rng(11), [], []
    common = [f"w{i}" for i in range(90)]
    for chain in range(8):
        words = list(common)
        for k in range(25):
            for at in rng.integers(0, 90, 3):
                words[at] = f"c{chain}_{rng.integers(0, 40)}" if rng.random() < 0.6 else common[at]
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, near_dedup.near_duplicates(docs, shingle=2).collect()))
    assert got == brute_components(rows, 2, 80)


def test_large_cluster_is_not_measured_against_every_partner(spark, monkeypatch):
    """Many single texts beside one large cluster: comparisons with centres grow with the rows."""
    rng, words = np.random.default_rng(12), [f"w{i}" for i in range(100)]
    rows = []
    for k in range(120):
        text = list(words)
        for at in rng.integers(0, 100, 2 if k < 80 else 9):
            text[at] = f"x{rng.integers(0, 9)}_{k if k % 3 else at}"
        rows.append((k, " ".join(text)))
    measured, real = [], near_dedup._beside

    def noted(given, key, sets):
        if key == "centre":
            measured.append(given.count())
        return real(given, key, sets)

    monkeypatch.setattr(near_dedup, "_beside", noted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, near_dedup.near_duplicates(docs, shingle=2).collect()))
    assert got == brute_components(rows, 2, 80)
    assert len(measured) == 2 and sum(measured) <= 2 * len(rows)


def test_near_duplicates_of_nothing(no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_components_of_a_long_chain(spark, monkeypatch, most):
    monkeypatch.setattr(components, "MAX_BROADCAST_ROWS", most)
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (601, 600), (600, 601), (None, 3)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(201)}, 600: 600, 601: 600}


# --- 9: fingerprints ------------------------------------------------------------


def test_fingerprint_edits_on_odd_rows(odd_docs):
    got = fingerprints.fingerprint_edits(odd_docs).withColumn(
        "same", fingerprints.likeness(F.col("anchors"), F.col("edited_anchors"))
    ).collect()
    assert len(got) == len(docs_rows())
    own = defaultdict(set)
    for r in got:
        own[r.text].add(str(r.anchors))
        assert 0 <= r.same <= 1 and r.n_chars == len(r.text)
    assert all(len(v) == 1 for v in own.values())
    texts = {r[0]: r[1] or "" for r in docs_rows() if r[0] is not None and r[0] != 10}
    edited = {r.doc_id: r.edited for r in got}
    ids = sorted(texts)
    for a, b in [(1, 2), (4, 5), (8, 9), (12, 13), (13, 14), (ids[-1], ids[0])]:
        half = len(texts[a]) // 2
        assert edited[a] == texts[a][:len(texts[a]) - half] + texts[b][:half]


def test_syncmers_by_hand(spark):
    text = text_of(9, 120)
    df = spark.createDataFrame([(text,), ("a b",), ("",), (None,)], "text string")
    h = "transform(regexp_extract_all(text, '(\\\\S{1,8})', 1), u -> xxhash64(u))"
    rows = fingerprints.with_anchors(df, "text", "anchors").withColumn("h", F.expr(h)).withColumn(
        "g", F.expr("transform(sequence(0, greatest(size(h) - 2, 0)), i -> xxhash64(get(h, i), get(h, i + 1)))")
    ).collect()
    g, w = rows[0].g, fingerprints.K - fingerprints.S + 1
    want = [i for i in range(len(rows[0].h) - fingerprints.K + 1) if min(g[i:i + w]) in (g[i], g[i + w - 1])]
    assert [a.pos for a in rows[0].anchors] == want
    assert [len(r.anchors) for r in rows[1:]] == [2, 0, 0]


def test_short_texts_have_anchors(spark):
    rows = [(text_of(k, n),) for n in range(6, 13) for k in range(20)]
    got = fingerprints.with_anchors(spark.createDataFrame(rows, "text string"), "text", "anchors").withColumn(
        "other", F.expr("transform(array('x', 'y'), (u, i) -> struct(i AS pos, xxhash64(u) AS anchor))")
    ).withColumn("same", fingerprints.likeness(F.col("anchors"), F.col("other"))).collect()
    assert all(r.anchors and r.same == 0 for r in got)


def test_char_syncmers_by_hand(spark):
    texts = [text_of(9, 120), "你好世界\U0001f600été" * 20 + "z", "x" * 90, "", None, "ab", *(text_of(k, 7)[:33] for k in range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    inner = "transform(sequence(1, greatest(length(text) - 7, 1)), i -> xxhash64(substring(text, i, 8)))"
    w = fingerprints.WINDOW - fingerprints.INNER + 1
    short = 0
    for r in fingerprints.with_char_anchors(df, "text", "anchors").withColumn("g", F.expr(inner)).collect():
        g = r.g or []
        want = [i for i in range(len(g) - w + 1) if min(g[i:i + w]) in (g[i], g[i + w - 1])]
        if not want and r.text:
            short += len(g) >= w
            want = range(len(g))
            assert [a.anchor for a in r.anchors] == g
        assert [a.pos for a in r.anchors] == list(want)
    assert short


def test_fingerprints_outlast_a_shift_without_white_space(spark):
    plain = "".join(chr(0x4E00 + x) for x in np.random.default_rng(3).integers(0, 5000, 2000))
    docs = spark.createDataFrame([(1, plain), (2, "x" + plain)], "doc_id long, text string")
    got = fingerprints.fingerprint_edits(docs).withColumn(
        "same", fingerprints.likeness(F.col("anchors"), F.col("next_anchors"))
    ).collect()
    assert all(r.same > 0.95 for r in got)


def test_edited_anchors_are_those_of_the_edited_text(spark, odd_docs):
    rng = np.random.default_rng(8)
    sizes = [*range(1, 140, 6), 127, 128, 129, 63, 64, 65, 400, 50, 31, 32, 33, 1000, 126, 2, 130, 62]
    rows = [(k, "".join(map(chr, rng.integers(97, 123, n)))) for k, n in enumerate(map(int, rng.permutation(sizes)))]
    rows.append((len(rows), " " * 200))
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), odd_docs):
        got = fingerprints.with_char_anchors(fingerprints.fingerprint_edits(docs), "edited", "want").collect()
        assert got and all(r.edited_anchors == r.want for r in got)


def test_fingerprints_of_nothing_and_one(spark, no_docs):
    assert fingerprints.fingerprint_edits(no_docs).count() == 0
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert fingerprints.fingerprint_edits(one).first().edited == "abab"


# --- 6: URL filters ---------------------------------------------------------------


def test_url_rules(spark):
    rules = [
        url_filter.host_path_rule("net/", "block"), url_filter.host_path_rule("example.net/en/", "allow"),
        url_filter.host_path_rule("org/fr/", "allow"), url_filter.Rule("any", "zz+", (), "block", 1),
        *url_filter.WORD_RULES,
    ]
    cases = {
        "http://A.Example.NET/en/x?y": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
        "http://x.net": ("x.net", "", None, "allow"), "http://x.net?/": ("x.net", "", None, "allow"),
        "http://x.net:80/": ("x.net:80", "/", None, "allow"), "http://net/": ("net", "/", "net/", "block"),
        "http://a.org/FR/": ("a.org", "/FR/", None, "allow"), "http://a.org/login#x": ("a.org", "/login", None, "block"),
        "http://my-net/": ("my-net", "/", None, "allow"), "http://b.org/zzz": ("b.org", "/zzz", "any", "block"),
        "no scheme/net/": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://": ("", "", None, "allow"), "x://y.net/://z.org/fr/": ("y.net", "/://z.org/fr/", "net/", "block"),
    }
    rows = [(k, u, "clash", "clash") for k, u in enumerate(cases)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = url_filter.filter_urls(pages, rules).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url], r.url
    empty = pages.limit(0)
    assert url_filter.filter_urls(empty, rules).count() == 0
    assert url_filter.filter_urls(pages, []).where("verdict = 'allow'").count() == len(rows)


# --- 4: Hamming search --------------------------------------------------------------


def test_search_is_exact_with_ties_and_hot_codes(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 64)).round(3)
    vectors[100:200] = vectors[7]  # a third of all rows is one vector
    vectors[200:220] = vectors[9] * (1 + 1e-3 * rng.normal(size=(20, 64)))
    vectors[220:230] = vectors[20]
    vectors[np.arange(220, 230), np.arange(54, 64)] *= -1  # differ from row 20 in one dimension each, the last one's too
    rows = [(i, v.tolist(), "clash", 1) for i, v in enumerate(vectors)]
    rows += [rows[3], (None, vectors[0].tolist(), "x", 1), (900, None, "x", 1), (1000, [], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string, distance int")
    asked = df.where("vec_id % 10 = 0")
    got = sorted(map(tuple, hamming_search.search(df, asked, k=5).collect()))
    bits = vectors > 0
    want = []
    for q in range(0, 300, 10):
        apart = (bits != bits[q]).sum(axis=1)
        order = sorted((int(d), i) for i, d in enumerate(apart) if i != q)[:5]
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(order)]
    assert got == sorted(want)
    assert hamming_search.search(df.limit(0), asked.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert hamming_search.search(few, few, k=5).count() == 6


def test_probes_are_not_broadcast(spark, monkeypatch):
    """A few queries make thousands of probes, which must not pass through the driver."""
    plans, write = [], hamming_search.materialise

    def noted(df, name, *more):
        if name == "nearest-codes":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, *more)

    monkeypatch.setattr(hamming_search, "materialise", noted)
    vectors = np.random.default_rng(5).normal(size=(40, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    hamming_search.search(df, df.where("vec_id < 2"), k=3)
    assert plans
    for plan in plans:
        probing = [line for line in plan.splitlines() if "Join" in line and "segment" in line]
        assert probing and all("SortMergeJoin" in line for line in probing)


def test_codes_of_odd_vectors(spark):
    long = [1.0] * 64 + [-2.0] + [0.5] * 10_000
    rows = [
        (1, [1.0, -1.0, 0.0, 2.0]), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, []), (5, None), (None, [1.0]),
        (6, [-1.0] * 63 + [1.0]), (7, [1.0] * 64), (8, long), (1, [1.0, -1.0, 0.0, 2.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.code for r in hamming_search.codes_of(df, "vec_id", "embedding").collect()}
    assert got == {1: 9, 2: 2, 6: -(1 << 63), 7: -1, 8: -1}
    assert got.keys() == {r.vec_id for r in hamming_search.codes_of(df, "vec_id", "embedding", 32).collect()}


# --- 5: tool calls ----------------------------------------------------------------------


def test_tool_calls_link_order_and_validate(spark):
    calls = [
        ("g", "c", 1, "t", '{"z":1, "a":{"y":2,"x":[1, "q"]}}', None),
        ("g", "d", 2, "t", '{"z":"no"}', ["c"]), ("g", "e", 3, "t", "{bad", ["c", "d", "d", None]), ("g", "f", 4, "t", "[1]", ["c", "x"]),
        ("g", "h", 5, "t", None, ["i", "c"]), ("g", "i", 6, "none", "{}", ["h", "d"]), ("g", "c", 9, "t", '{"z":2}', None),
        (None, None, None, None, None, None), ("g", "k", 1, "t", '{"z":3,"u":1}', ["f"]),
    ]
    results = [("g", "c", 2, "yes"), ("g", "c", 3, None), ("g", "nobody", 3, "x"), ("g", None, 3, "x"), ("g", "e", 4, 'q"\n')]
    schemas = spark.createDataFrame([("t", "z", "BIGINT", True), ("t", "a", "OBJECT", False)],
                                    "name string, field string, type string, required boolean")
    c = spark.createDataFrame(calls, "group_id string, call_id string, seq long, name string, arguments string, depends_on array<string>").withColumn("depth", F.lit("clash"))
    r = spark.createDataFrame(results, "group_id string, call_id string, seq long, content string").withColumn("level", F.lit("clash"))
    rows = tool_calls.link_tool_calls(c, r, schemas).collect()
    got = {(x.kind, x.call_id, x.seq): (x.level, x.status, x.errors) for x in rows}
    assert len(rows) == len(calls) + len(results)
    assert got["call", "c", 1] == (0, "ok", [])
    assert got["call", "d", 2] == (2, "unanswered", ["wrong type z"])
    assert got["call", "e", 3] == (4, "ok", ["not json"])
    assert got["call", "f", 4] == (2, "missing", ["not an object"])
    assert got["call", "k", 1] == (4, "missing", ["unknown u"])
    assert got["call", "h", 5][:2] == (None, "cycle") and got["call", "i", 6] == (None, "cycle", ["unknown tool"])
    assert got["call", "c", 9][:2] == (None, "repeated") and got["call", None, None][1] == "no id"
    assert got["result", "c", 2][:2] == got["result", "c", 3][:2] == (1, "ok")
    assert got["result", "nobody", 3][:2] == (None, "orphan") and got["result", None, 3][1] == "no id"
    text = next(x.json for x in rows if x.kind == "call" and x.call_id == "c" and x.seq == 1)
    assert text == '{"arguments":{"a":{"x":[1,"q"],"y":2},"z":1},"id":"c","name":"t","type":"call"}'
    for x in rows:
        assert json.dumps(json.loads(x.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == x.json
    assert tool_calls.link_tool_calls(c.limit(0), r.limit(0), schemas).count() == 0


def test_levels_of_a_long_chain(spark):
    calls = spark.createDataFrame([(f"c{i}", [f"c{i - 1}"] if i else None) for i in range(70)], "call_id string, depends_on array<string>")
    got = {r.call_id: r.depth for r in tool_calls.levels(calls).collect()}
    assert got == {f"c{i}": i for i in range(70)}


def brute_levels(calls):
    """call id → (depth, state), by marking and then by depth-first search."""
    on_cycle = set()
    for start in calls:
        seen, todo = set(), list(calls[start])
        while todo:
            x = todo.pop()
            if x in calls and x not in seen:
                seen.add(x)
                todo += calls[x]
        if start in seen or seen & on_cycle:
            on_cycle.add(start)
    endless = {c for c in calls if c in on_cycle}
    for _ in calls:
        endless |= {c for c in calls if set(calls[c]) & endless}

    def walk(c):
        below = [walk(u) for u in calls[c] if u in calls]
        lost = any(u not in calls for u in calls[c]) or any(m for _, m in below)
        return max((d + 1 for d, _ in below), default=0), lost

    out = {}
    for c in calls:
        out[c] = (None, "cycle") if c in endless else (lambda w: (w[0], "missing" if w[1] else "ok"))(walk(c))
    return out


@pytest.mark.parametrize("back", [0, 3])
def test_levels_of_many_dependencies(spark, back):
    rng = np.random.default_rng(back)
    calls = {f"c{i}": [f"c{j}" for j in rng.integers(-1, i, rng.integers(0, 4))] if i else [] for i in range(40)}
    for _ in range(back):  # some edges the other way make cycles
        i, j = sorted(rng.integers(20, 40, 2))
        calls[f"c{i}"].append(f"c{j}")
    df = spark.createDataFrame(list(calls.items()), "call_id string, depends_on array<string>")
    got = {r.call_id: (r.depth, r.state) for r in tool_calls.levels(df).collect()}
    assert got == brute_levels(calls)


def test_conversation_roles_and_spoilt_arguments(spark):
    rows = [
        ("a", 0, "system", "be kind"), ("a", 1, "user", "x" * 23), ("a", 2, "assistant", None), ("a", 3, "user", "x" * 24),
        ("a", 5, "user", "x" * 25), ("a", 7, "user", "x" * 26), ("a", 9, "user", "long " * 30_000), ("a", 9, None, "?"),
        (None, None, None, None), ("a", 10, "tool", ""), ("b", None, "user", None), ("b", None, "assistant", "y"),
    ]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumn("kind", F.lit("clash"))
    calls, results = tool_calls.conversation_calls(df)
    schemas = spark.createDataFrame(tool_calls.CONVERSATION_SCHEMAS, "name string, field string, type string, required boolean")
    linked = tool_calls.link_tool_calls(calls, results, schemas).unionByName(tool_calls.conversation_messages(df)).collect()
    assert len(linked) == len(rows)
    found = {r.seq: (r.level, r.status, r.errors) for r in linked if r.kind == "call" and r.group_id == "a"}
    assert found == {
        1: (0, "ok", ["not json"]), 3: (2, "unanswered", ["wrong type chars"]), 5: (4, "unanswered", ["missing text"]),
        7: (6, "unanswered", ["unknown note"]), 9: (8, "unanswered", []),
    }
    assert sorted(r.json for r in linked if r.kind == "message") == [
        '{"content":"","role":"tool","type":"message"}', '{"content":"?","role":null,"type":"message"}',
        '{"content":"be kind","role":"system","type":"message"}', '{"content":null,"role":null,"type":"message"}',
    ]


# --- 8: language ---------------------------------------------------------------------------


def test_language_profiles_and_odd_texts(spark, odd_docs, no_docs):
    train = spark.createDataFrame(
        [("the cat and the dog sat on the mat " * 5, "en"), ("der hund und die katze auf der matte " * 5, "de"),
         (None, "en"), ("x", None), ("123", "digits")], "text string, lang string")
    profiles = language_id.collect_profiles(language_id.train_profiles(train))
    assert profiles[0] == ["de", "en"]
    got = [(r.text, r.found.lang_pred, r.found.score)
           for r in language_id.identify(odd_docs, profiles, result_col="found").collect()]
    assert len(got) == len(docs_rows())
    for text, lang, score in got:
        assert 0 <= score <= 1
        assert (lang == "und") == (not any(c.isalpha() for c in text or ""))
    test = spark.createDataFrame([("the mat and the cat",), ("die katze und der hund",)], "text string")
    assert [r.found.lang_pred for r in language_id.identify(test, profiles, result_col="found").collect()] == ["en", "de"]
    none = language_id.collect_profiles(language_id.train_profiles(no_docs))
    assert language_id.identify(test, none, result_col="found").first().found.lang_pred == "und"


def test_out_of_place_by_hand():
    def grams(text):
        s = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        return Counter([c for c in s if c != " "] + [s[i:i + 2] for i in range(len(s) - 1)] + [s[i:i + 3] for i in range(len(s) - 2)])

    text = "Ab, ab! 12 ba cab"
    code, times = np.unique(language_id.ngram_codes(text), return_counts=True)
    assert sorted(times.tolist()) == sorted(grams(text).values())
    codes, ranks = np.sort(code), np.array([np.arange(len(code))[::-1]])
    apart, most = language_id.out_of_place(text, codes, ranks, 300)
    own = {int(c): k for k, c in enumerate(code[np.argsort(-times, kind="stable")])}
    assert apart[0] == sum(abs(own[int(c)] - int(ranks[0][i])) for i, c in enumerate(codes)) and most == 300 * len(code)


# --- 1 and 3: trained classifiers ---------------------------------------------------------------


def labelled(spark, n=600):
    rows, labels = [], []
    rng = np.random.default_rng(2)
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 300, 60)]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            for at in rng.integers(0, 60, 4):
                words[at] = f"slur{rng.integers(0, 4)}"
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, "en", "site" + str(i % 5), len(text)))
        if i % 3 != 2:
            labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_quality_co_training(spark, odd_docs, no_docs):
    docs, labels, _ = labelled(spark)
    model = quality.train(docs, labels)
    got = quality.score(docs, model).select("doc_id", "quality_score.score").collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 5 != 0) for r in got]) > 0.98
    odd = quality.score(odd_docs, model, result_col="found").select("found.*").collect()
    assert len(odd) == len(docs_rows()) and all(0 <= v <= 1 for r in odd for v in r)
    blank = quality.train(no_docs, labels.limit(0))
    assert quality.score(docs, blank).first().quality_score.score == pytest.approx(0.5)
    assert quality.score(no_docs, model).count() == 0


def test_quality_is_that_of_one_process_over_all_rows(spark):
    """Brute force: all features in one array, the loss summed row by row."""
    docs, labels, rows = labelled(spark)
    odd = [(labels.first().doc_id, 1 - labels.first().quality, 0), (None, 1, 0), (2, None, 0)]
    model = quality.train(docs, labels.union(spark.createDataFrame(odd, labels.schema)))
    marks = {}
    for r in [*map(tuple, labels.collect()), *odd]:
        if r[0] is not None and r[1] is not None:
            marks[r[0]] = min(r[1], marks.get(r[0], 1))
    has = [r for r in rows if r[0] in marks]
    rest = [r for r in rows if r[0] not in marks]
    shapes = lambda part: np.array([quality.text_shape(r[1]) for r in part])
    slots = lambda part: np.array([quality.meta_slots(*r[2:]) for r in part])
    edges = np.quantile(shapes(has), np.linspace(0, 1, quality.BINS + 1)[1:-1], axis=0).T
    views = [quality.text_matrix(shapes(rest), edges).astype(float), quality.meta_matrix(slots(rest)).astype(float)]
    seen = []

    def pool(judges, weights):
        out = []
        for own in (0, 1):
            theta, scale = judges[1 - own]
            slope, curve, n = 0, 0, 0
            for x, z in zip(views[own], views[1 - own]):
                p = 1 / (1 + np.exp(-(scale[0] * (z @ theta) + scale[1])))
                if p >= quality.CONFIDENT or p <= 1 - quality.CONFIDENT:
                    q = 1 / (1 + np.exp(-x @ weights[own]))
                    slope, curve, n = slope + (q - (p >= 0.5)) * x, curve + q * (1 - q) * np.outer(x, x), n + 1
            seen.append(n)
            out.append((slope if n else np.zeros(views[own].shape[1]), curve, n))
        return out

    y = np.array([marks[r[0]] for r in has], float)
    aside = np.array([zlib.crc32(b"aside%d" % r[0]) % 4 == 0 for r in has])
    want = quality.co_train(shapes(has), slots(has), y, aside, edges, pool, len(rest))
    assert max(seen) > 100
    for a, b in ((model.text, want.text), (model.meta, want.meta), (model.both, want.both)):
        assert np.allclose(a, b, rtol=1e-6, atol=1e-8)


def test_quality_learns_from_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(100, 120)] + [(100, 1, 1), (None, 1, 1), (10, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    got = quality.score(odd_docs, quality.train(odd_docs, labels), result_col="found").select("found.*").collect()
    assert len(got) == len(docs_rows()) and all(0 <= v <= 1 for r in got for v in r)


def test_meta_view_learns_from_the_text_view():
    """With few labels, pseudo-labels of the text view teach the metadata view."""
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.5).astype(float)
    shapes = np.column_stack([y + 0.2 * rng.normal(size=400), rng.normal(size=400)])
    slots = np.array([[0, 128 + int(v), 256] for v in y])
    few = np.arange(400) < 60
    aside = np.arange(60) % 4 == 0
    edges = np.quantile(shapes[few], np.linspace(0, 1, quality.BINS + 1)[1:-1], axis=0).T
    bins = quality.text_bins(shapes[~few], edges)
    pool = lambda judges, weights: quality.view_sums(bins, slots[~few], judges, weights)
    model = quality.co_train(shapes[few], slots[few], y[few], aside, edges, pool, len(bins))
    alone = quality.co_train(shapes[few], slots[few], y[few], aside, edges, pool, 0)
    assert abs(model.meta[129] - model.meta[128]) > abs(alone.meta[129] - alone.meta[128])
    assert np.mean((model.score(shapes, slots)[2] >= 0.5) == y) > 0.97


def test_toxicity_learns_from_positives_and_unlabelled(spark, odd_docs, no_docs):
    docs, labels, rows = labelled(spark, 1500)
    fold = F.col("doc_id") % 4 != 0
    model = toxicity.train(docs, labels, usable=fold)
    got = toxicity.score(docs, model).where("doc_id % 4 = 0").select("doc_id", "score").collect()
    truth = {r[0]: "slur" in r[1].lower() for r in rows}
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in got]) > 0.98
    odd = toxicity.score(odd_docs, model, result_col="found").select("found").collect()
    assert len(odd) == len(docs_rows()) and all(0 <= r.found <= 1 for r in odd)
    none = toxicity.train(no_docs, labels.limit(0), usable=F.lit(True))
    assert 0 < toxicity.score(docs, none).first().score < 0.5
    assert toxicity.score(no_docs, model).count() == 0


def test_toxicity_descends_on_the_risk_of_all_texts(spark, odd_docs):
    """Brute force: the risk's slope summed text by text in one process."""
    docs, labels, rows = labelled(spark, 900)
    toxic = labels.where("toxic = 1").select("doc_id")
    rows = [(r[0], r[1]) for r in rows]
    chosen = toxicity.surprising_slots(*toxicity.slot_frequencies(docs.select("doc_id", "text"), toxic))
    table = toxicity.feature_table(docs, toxic, chosen)
    known = {r.doc_id for r in toxic.collect()}
    x = np.zeros((len(rows), len(chosen) + 1))
    slots = toxicity.WordSlots(toxicity.SLOT_BITS)
    for k, (_, text) in enumerate(rows):
        index, count = toxicity.word_slots(text, slots)
        for i, v in zip(index, np.log1p(count).astype(np.float16)):
            if i in chosen:
                x[k, np.searchsorted(chosen, i)] = v
    x[:, -1] = 1

    def sums(theta):
        out = []
        for part in ([k for k, r in enumerate(rows) if r[0] in known], range(len(rows))):
            slope, total = 0, 0
            for k in part:
                p = 1 / (1 + np.exp(-x[k] @ theta))
                slope, total = slope + p * (1 - p) * x[k], total + p
            out += [[len(part), total], slope]
        return np.concatenate(out)

    theta = np.append(np.linspace(-0.5, 0.5, len(chosen)), -1.0)
    assert len(chosen) and np.allclose(toxicity.risk_sums(table)(theta), sums(theta))
    assert np.allclose(toxicity.descend(theta, toxicity.risk_sums(table), 0.1, 4), toxicity.descend(theta, sums, 0.1, 4))
    # NULL and repeated ids and labels, odd texts
    odd = spark.createDataFrame([(k, k % 2) for k in range(100, 120)] + [(101, 0), (None, 1), (10, 1), (13, None)],
                                "doc_id long, toxic int")
    model = toxicity.train(odd_docs, odd, usable=F.lit(True))
    got = toxicity.score(odd_docs, model, result_col="found").select("found").collect()
    assert len(got) == len(docs_rows()) and all(0 <= r.found <= 1 for r in got)


def test_rare_toxic_words_are_counted_over_all_texts(spark):
    docs, labels, rows = labelled(spark, 1500)
    rare = [r[0] for r in rows if r[0] % 7 == 0 and r[0] % 3 != 2][:22]
    docs = docs.withColumn("text", F.when(F.col("doc_id").isin(rare), F.concat("text", F.lit(" rarely"))).otherwise(F.col("text")))
    docs = docs.unionByName(docs.where("doc_id < 70").withColumn("doc_id", F.col("doc_id") + 10_000))
    weights, _ = toxicity.train(docs, labels, usable=F.lit(True), max_positive=40, max_unlabelled=100)
    assert weights[toxicity.WordSlots(toxicity.SLOT_BITS)[b"rarely"][0]] > 0
    toxic = labels.where("toxic = 1").select("doc_id")
    counted, n_p, n_u = toxicity.slot_frequencies(docs.select("doc_id", "text"), toxic)
    in_p, in_u = np.zeros((2, 1 << toxicity.SLOT_BITS), np.int64)
    for r in counted.collect():
        in_p[r.slot], in_u[r.slot] = r.in_p, r.in_u
    assert (toxicity.surprising_slots(counted, n_p, n_u) == toxicity.surprising(in_p, in_u, n_p, n_u)).all()
    assert (n_p, n_u) == (toxic.count(), docs.count())
    slots = toxicity.WordSlots(toxicity.SLOT_BITS)
    known = {r.doc_id for r in toxic.collect()}
    for got, kept in ((in_p, known), (in_u, None)):
        want = np.zeros_like(got)
        for text in {r.text for r in docs.collect() if kept is None or r.doc_id in kept}:
            want[toxicity.word_slots(text, slots)[0]] += 1
        assert (got == want).all()


def test_risk_stays_near_zero_on_the_unseen_negatives():
    rng = np.random.default_rng(4)
    row = lambda words: (np.array(sorted(words), np.int32), np.ones(len(words), np.float16))
    noise = lambda: {int(x) for x in rng.integers(100, 5000, 30)}
    positive = [row(noise() | {7}) for _ in range(60)]
    unlabelled = [row(noise() | ({7} if k % 10 == 0 else set())) for k in range(600)]
    weights, bias = toxicity.fit_nnpu(positive, unlabelled, 0.1)
    z = np.array([weights[i].sum() + bias for i, _ in unlabelled])
    p = 1 / (1 + np.exp(-z))
    assert p.mean() - 0.1 >= -0.05 and np.mean((p > 0.5) == (np.arange(600) % 10 == 0)) > 0.97
