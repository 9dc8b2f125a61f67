"""Hand-made cases for operators that SQL does not express, and invariants."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F
from stemma.functions import numerals
from stemma.functions import text as T
from stemma.operators import aggregates, compare, diffs, extraction, graphs, intervals, joins, logs
from stemma.sources import tables
from stemma.streaming import logs as streams


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_numerals(spark):
    cases = {"一": 1, "十": 10, "十二": 12, "三百六十五": 365, "二萬七千七百五十九": 27759, "一億": 100_000_000, "〇": 0, "四分": None, "": None, None: None}
    assert {k: numerals.numeral_value(k) for k in cases} == cases
    assert {k: numerals.numeral_value(k) for k in ("两万三", "一亿二千万", "兩百零五", "十二萬", "20", "x", "")} == {"两万三": 20003, "一亿二千万": 120_000_000, "兩百零五": 205, "十二萬": 120_000, "20": 20, "x": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string").withColumn("v", numerals.numeral_value_udf("s"))
    assert {r.s: r.v for r in df.collect()} == cases


def test_numerals_of_the_query_are_the_keys(spark):
    from stemma.plans import catalog

    assert catalog.QUERIES["f9_numerals"](spark, "/root/testdata/sf0.001").where("value != o_orderkey OR value IS NULL").count() == 0


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_occurrences_and_references(spark):
    r = random.Random(2)
    data = [(["".join(r.choice("ab")) for _ in range(r.randint(0, 7))], [r.choice("abc") for _ in range(r.randint(0, 7))]) for _ in range(60)]
    df = spark.createDataFrame(data, "a array<string>, b array<string>").withColumn("n", T.lcs_length("a", "b"))
    assert all(x.n == lcs(x.a, x.b) for x in df.collect())
    texts = ["", None, "aaaa", "banana", "a.b.a", "xaxa", "aa"]
    for needle in ("a", "aa", "ana", ".", "zz"):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.all_occurrences("t", F.lit(needle)).alias("p"), T.apart(T.all_occurrences("t", F.lit(needle)), len(needle)).alias("q"))
        for x in df.collect():
            t = x.t or ""
            assert x.p == [i for i in range(len(t)) if t.startswith(needle, i)], (t, needle)
            assert len(x.q) == t.count(needle)
    df = spark.createDataFrame([("see word3 and end12, 3 alone", ["3", "12"])], "t string, n array<string>")
    assert df.select(T.mark_refs("t", "n")).first()[0] == "see word[^3] and end[^12], 3 alone"
    assert spark.range(1).select(T.floor_div(F.lit(-7), F.lit(2)), T.floor_mod(F.lit(-7), F.lit(2))).first()[:] == (-4, 1)
    assert spark.sql("SELECT length('𠀀a') = 2").first()[0]


def test_relocate_anchor(spark):
    docs = spark.createDataFrame([(1, "one two one three"), (2, "nothing here")], "doc_id long, text string")
    m = spark.createDataFrame([(1, 1, "two", None), (2, 1, "one", 2), (3, 1, "one", 3), (4, 2, "absent", 1)], "mention_id long, doc_id long, anchor string, ordinal int")
    assert rows(joins.relocate_anchor(m, docs), "mention_id", "start", "status") == [(1, 4, "unique"), (2, 8, "ordinal"), (3, None, "needs_review"), (4, None, "missing")]


def test_intervals_equal_brute_force(spark):
    r = random.Random(5)
    make = lambda n: [(r.randint(0, 3), i, s := r.randint(0, 400), s + r.randint(1, 150)) for i in range(n)]
    a, b = make(60), make(60)
    schema = "doc int, id int, start int, end int"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    want = sorted((x[0], x[1], y[1]) for x, y in itertools.product(a, b) if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert rows(intervals.overlapping(da, db, "doc", 32), "doc", "left_id", "right_id") == want
    docs = spark.createDataFrame([(i, 600) for i in range(5)], "doc int, n int")
    for x in intervals.char_coverage(docs, da, "doc", "n").collect():
        chars = {c for d, _, s, e in a if d == x.doc for c in range(s, e)}
        gaps = sum(1 for i in range(600) if i not in chars and (i == 0 or i - 1 in chars))
        assert (x.covered, x.gaps) == (len(chars), gaps)
    cut = intervals.atomic_segments(docs, da, "doc", "n", 32).collect()
    for x in cut:
        assert x.spans == sorted(i for d, i, s, e in a if d == x.doc and s <= x.start and x.end <= e)
    for d in range(5):
        mine = sorted((x.start, x.end) for x in cut if x.doc == d)
        assert mine[0][0] == 0 and mine[-1][1] == 600 and all(p[1] == q[0] for p, q in itertools.pairwise(mine))
    kept = logs.resolve_spans(da.withColumn("priority", F.col("id") % 3), "doc").collect()
    for d in range(4):
        plain = best_spans([(s, e, i % 3, i) for doc, i, s, e in a if doc == d])
        assert sorted(x.id for x in kept if x.doc == d) == sorted(p[3] for p in plain)


def best_spans(spans):
    """Spans (start, end, priority, id) that overlap no better one that is taken."""
    taken = []
    for x in sorted(spans, key=lambda r: (r[2] is None, -(r[2] or 0), r[0] - r[1], r[0], r[3])):
        if all(x[1] <= y[0] or y[1] <= x[0] for y in taken):
            taken.append(x)
    return taken


def test_spans_are_settled_piece_by_piece(spark):
    r = random.Random(8)
    for n in range(60):
        length = r.choice([3, 20, 200])
        spans = [(s := r.randint(0, 300), s + r.randint(1, length), r.choice([None, 1, 2, 3]), i) for i in range(r.randint(0, 150))]
        walk, found = logs.SpanWalk(r.choice([1, 4, 30])), []
        for x in sorted(spans, key=lambda x: x[:2]):
            found += walk.add(x)
        assert sorted(found + walk.settle(), key=repr) == sorted(best_spans(spans), key=repr), n
    # one chain without a cut: few of its spans wait at any time
    walk, most, taken = logs.SpanWalk(100), 0, 0
    for i in range(50_000):
        taken += len(walk.add((2 * i, 2 * i + 3, i * 7919 % 101, i)))
        most = max(most, len(walk.waiting))
    assert most <= 400 and taken + len(walk.settle()) > 10_000
    # priorities that rise along the chain keep it waiting to its end, but it is settled
    rising = [(2 * i, 2 * i + 3, i, i) for i in range(5000)]
    walk, found = logs.SpanWalk(100), []
    for x in rising:
        found += walk.add(x)
    assert len(found + walk.settle()) == 2500
    schema = "doc string, start int, end int, priority int, id long"
    rows_ = [(d, s := r.randint(0, 900), s + r.randint(0, 60), r.choice([None, 1, 2]), i) for i in range(900) for d in ("a", None)] + [("b", None, 4, 1, 1), ("c", 1, 5, None, 1)]
    got = logs.resolve_spans(spark.createDataFrame(rows_, schema), "doc", 20).collect()
    for d in ("a", None, "b", "c"):
        assert sorted(x.id for x in got if x.doc == d) == sorted(x[3] for x in best_spans([x[1:] for x in rows_ if x[0] == d and x[1] is not None and x[1] < x[2]]))
    assert logs.resolve_spans(spark.createDataFrame([], schema), "doc").count() == 0


def test_best_claims_equal_all_pairs(spark):
    r = random.Random(12)
    pick = lambda n, k, none: [r.choice([None] * none + list(range(k))) for _ in range(r.randint(0, n))]
    one = lambda i: (i, r.choice("ab"), r.choice(["x", "y", None]), pick(4, 3, 1), [str(x) for x in pick(4, 3, 0)], r.choice([None, 1, 2]))
    steps, claims = [one(i) for i in range(60)] + [(60, "c", "x", [1], ["1"], 1)], [one(i) for i in range(120)]
    schema = "{} int, op string, system string, inputs array<int>, terms array<string>, modulus int"

    def score(s, c):
        same = lambda i: s[i] is not None and s[i] == c[i]
        inputs = sum(min(s[3].count(v), c[3].count(v)) for v in set(s[3]) - {None})
        return 4 + (2 if same(2) else -2) + 2 * inputs + 2 * len(set(s[4]) & set(c[4])) + 2 * same(5)

    want = {s[0]: [(-x, i) for x, i in sorted((-score(s, c), c[0]) for c in claims if c[1] == s[1])[:5]] for s in steps}
    for widest in (8, 4, 0):
        got = joins.claims_to_steps(spark.createDataFrame(steps, schema.format("step_id")), spark.createDataFrame(claims, schema.format("claim_id")), 5, widest).collect()
        for s in steps:
            assert [(x.score, x.claim_id) for x in sorted(got, key=lambda x: x["rank"]) if x.step_id == s[0]] == want[s[0]], (widest, s)


def test_weighted_pairs_lose_none_and_meet_few(spark):
    r = random.Random(13)
    items = {i: {t: r.choice([0.1, 0.2, 0.3]) for t in {min(int(r.expovariate(0.2)), 30) for _ in range(6)}} for i in range(120)}
    df = spark.createDataFrame([(i, t, w) for i, x in items.items() for t, w in x.items()], "id int, token int, weight double")
    for least in (0.25, 0.55, 0.85):
        want = sorted((a, b) for a, b in itertools.combinations(items, 2) if min(sum(w for t, w in items[x].items() if t in items[y]) for x, y in ((a, b), (b, a))) >= least)
        got = rows(compare.weighted_pairs(df, least), "a", "b")
        assert got == want and want


def test_partition_diff(spark):
    s = "doc int, pos int, length int, type string"
    base = spark.createDataFrame([(1, 1, 5, "a"), (1, 2, 5, "a"), (1, 3, 4, "b"), (1, 4, 6, "c"), (1, 5, 2, "d")], s)
    final = spark.createDataFrame([(1, 1, 10, "a"), (1, 2, 4, "x"), (1, 3, 3, "c"), (1, 4, 3, "c"), (1, 5, 2, "d")], s)
    assert [x.op for x in diffs.partition_diff(base, final, "doc").orderBy("region").collect()] == ["merge", "set_type", "split"]


def test_fingerprint_does_not_depend_on_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 3)
    one, two = (diffs.dataset_fingerprint(d, "id", "x").first() for d in (df, df.orderBy(F.desc("id")).repartition(7)))
    assert one == two != diffs.dataset_fingerprint(df.where("id > 0"), "id", "x").first()


def test_history_with_undos_of_undos(spark):
    r = random.Random(9)
    entries = [(k, i, r.choice([None, r.randint(0, i)]) if i else None) for k in range(4) for i in range(30)]
    got = {(x.k, x.id): x.stands for x in logs.active_history(spark.createDataFrame(entries, "k int, id int, reverts int"), "k").collect()}
    for k in range(4):
        undone: set = set()
        for _, i, back in sorted((e for e in entries if e[0] == k), key=lambda e: -e[1]):
            if i not in undone and back is not None and back < i:
                undone.add(back)
        assert all(got[k, i] == (i not in undone) for i in range(30))


def replay(log, depends):
    """The passes of the replay, one decision at a time, until no effect of an inactive decision is left."""
    invalid = set()
    while True:
        status, applied = replay_once(log, depends, invalid)
        fresh = {d for d in applied if status[d] != "active"} - invalid
        if not fresh:
            return status
        invalid |= fresh


def replay_once(log, depends, invalid):
    status = {d["decision"]: "active" for d in log}
    row = {d["decision"]: d for d in log}
    parents = {}
    for child, parent in depends:
        parents.setdefault(child, set()).add(parent)

    def reach(x):
        seen, todo = set(), list(parents.get(x, ()))
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += parents.get(y, ())
        return seen

    def fall():
        while True:
            hit = [d for d in status if status[d] == "active" and any(status.get(p, "active") != "active" for p in parents.get(d, ()))]
            if not hit:
                return
            for d in hit:
                status[d] = "needs_revalidation"

    for d in status:
        if d in invalid or d in reach(d) or any(p not in status for p in parents.get(d, ())):
            status[d] = "needs_revalidation"
    fall()
    applied = set()
    for d in sorted(log, key=lambda d: -d["decision"]):
        if d["action"] == "retract" and status[d["decision"]] == "active":
            t = d["target"]
            if t in row and row[t]["session"] == d["session"]:
                applied.add(d["decision"])
                if t < d["decision"]:
                    status[t] = "retracted"
            else:
                status[d["decision"]] = "needs_revalidation"
    fall()
    active = [d for d in log if status[d["decision"]] == "active"]
    cuts = [d for d in active if d["action"] == "resegment"]
    applied |= {d["decision"] for d in cuts}
    for d in active:
        if d["action"] != "resegment" and any(x["session"] == d["session"] and x["doc"] == d["doc"] and x["start"] < d["end"] and d["start"] < x["end"] and x["revision"] > d["revision"] for x in cuts):
            status[d["decision"]] = "stale"
    contexts = [d for d in log if d["action"] == "attach_context" and status[d["decision"]] == "active"]
    applied |= {d["decision"] for d in contexts}
    for d in log:
        if d["action"] == "decide" and d["kind"] in ("select", "bind") and status[d["decision"]] == "active" and any(x["session"] == d["session"] and x["revision"] > d["revision"] for x in contexts):
            status[d["decision"]] = "stale"
    live = [d for d in log if status[d["decision"]] == "active" and d["action"] == "decide"]
    for d in live:
        rest = [x for x in live if (x["session"], x["slot"], x["kind"]) == (d["session"], d["slot"], d["kind"])]
        if d["kind"] in ("select", "bind", "scope"):
            clash = any(x["payload"] != d["payload"] for x in rest)
        else:
            clash = d["kind"] == "facets" and any(x["facets"][k] != v for x in rest for k, v in d["facets"].items() if k in x["facets"])
        if clash:
            status[d["decision"]] = "conflicted"
    fall()
    return status, applied


def state_of(log, status):
    """Entries of every slot, decision by decision."""
    state = {}
    for d in sorted(log, key=lambda d: d["revision"]):
        if status[d["decision"]] != "active" or d["action"] != "decide":
            continue
        slot = state.setdefault((d["session"], d["slot"], d["kind"]), {})
        one = d["decision"]
        if d["kind"] == "reject":
            slot.setdefault(d["payload"], (None, d["payload"], one))
        elif d["kind"] == "note":
            slot[one] = (None, d["payload"], one)
        elif d["kind"] == "facets":
            slot.update({k: (k, v, one) for k, v in d["facets"].items()})
        else:
            slot[0] = (None, d["payload"], one)
    ordered = lambda k, x: sorted(x, key=lambda e: (e[0] or "", e[2]))
    return {(*k, i): e for k, x in state.items() for i, e in enumerate(ordered(k, x.values()), 1)}


def test_replay_equals_a_loop(spark):
    r = random.Random(11)
    log = []
    kinds = list(logs.FOLDS)
    for i in range(260):
        s, slot = r.randint(0, 900), r.randint(0, 30)
        a = r.choices(["decide", "retract", "resegment", "attach_context"], [24, 5, 2, 1])[0]
        kind = kinds[slot % 6]
        log.append({"session": r.randint(0, 3), "decision": i, "revision": i, "action": a, "target": r.randint(0, i) if a == "retract" else None, "doc": r.randint(0, 2), "start": s, "end": s + r.randint(1, 90), "slot": str(slot), "payload": r.choice("xy"), "kind": kind, "facets": {r.choice("pqrs"): r.choice("xxxxy") for _ in range(2)} if kind == "facets" else None, "branch": r.choice(["root", "main", "main", "mine", "other"])})
    for i in range(5, 260, 9):  # retractions of what stands just before them in their session
        before = [d["decision"] for d in log[:i] if d["session"] == log[i]["session"]]
        if before:
            log[i].update(action="retract", target=before[-1])
    depends = [(i, r.randint(0, i - 1)) for i in range(20, 260, 7)] + [(10, 12), (12, 10), (50, 999)]
    schema = "session int, decision int, revision int, action string, target int, doc int, start int, end int, slot string, payload string, kind string, facets map<string,string>, branch string"
    df = spark.createDataFrame([tuple(d.values()) for d in log], schema)
    edges = spark.createDataFrame(depends, "child int, parent int")
    branches = spark.createDataFrame([("main", "root"), ("mine", "main"), ("other", "main")], "child string, parent string")
    for branch, seen in (("mine", {"root", "main", "mine"}),):
        mine = [d for d in log if d["branch"] in seen]
        got = logs.replay_decisions(df, edges, branches, branch)
        want = replay(mine, depends)
        assert {x.decision: x.status for x in got.collect()} == want
        assert len(set(want.values())) == 5 and want != replay_once(mine, depends, set())[0]
        state = {(x.session, x.slot, x.kind, x.pos): (x.name, x.value, x.decision) for x in logs.effective_state(got).collect()}
        assert state == state_of(mine, want)


def test_overlay(spark):
    units = spark.createDataFrame([(1, 10, 0, "a", "t"), (1, 11, 1, "b", "t"), (1, 12, 2, "c", "t"), (2, 20, 0, "d", "t")], "doc int, id int, pos int, text string, type string")
    ops = spark.createDataFrame([(1, 11, 1, "merge", None), (1, 10, 1, "set_type", "x"), (1, 10, 2, "set_type", "y"), (2, 20, 1, "merge", None)], "doc int, target int, seq int, op string, value string")
    assert rows(logs.apply_overlay(units, ops), "doc", "id", "type", "text", "n") == [(1, 10, "y", "ab", 2), (1, 12, "t", "c", 1), (2, 20, "t", "d", 1)]


def test_assignment_is_the_best_of_all_permutations(spark):
    r = random.Random(4)
    one = lambda: {"kind": r.choice("KL"), "ports": r.sample("abc", r.randint(0, 3)), **{x: r.choice(["x", "y", None]) for x in ("scope", "method", "quantity")}}
    for _ in range(300):
        p, e = [one() for _ in range(r.randint(0, 5))], [one() for _ in range(r.randint(0, 6))]

        def cost(chosen):
            s = [compare.layer_scores(w, e[j]) for w, j in zip(p, chosen, strict=True)]
            return sum(x[1] + x[2] for y in s for x in y.values()), -sum(x[0] for y in s for x in y.values()), tuple(chosen)

        got = compare.best_assignment(p, e)
        if len(e) < len(p):
            assert got is None
        else:
            assert tuple(got) == min(map(cost, itertools.permutations(range(len(e)), len(p))))[2]
    # forty of both: each predicate has one event that fits it wholly
    p = [{"kind": "K", "ports": [str(i)], "scope": str(i % 7), "method": None, "quantity": i} for i in range(40)]
    e = [dict(x, method="m") for x in p]
    r.shuffle(e)
    assert [e[j]["quantity"] for j in compare.best_assignment(p, e)] == list(range(40))


def test_obligations_without_events_tell_why(spark):
    fields = "span int, kind string, ports array<string>, scope string, method string, quantity long"
    o = spark.createDataFrame([(i, i, "K", ["a"], None, "m", 3) for i in range(6)] + [(6, 6, "Z", ["a"], None, None, None)], f"obligation int, {fields}")
    e = spark.createDataFrame([(1, 4, "K", ["a"], "s", "m", 3), (2, 5, "K", ["a"], None, None, 4), (3, 6, "K", [], None, None, None)], f"event int, {fields}")
    issues = spark.createDataFrame([(2, 0, "text_ambiguity"), (1, 0, "parser_gap"), (3, 1, "missing_external_data"), (4, 2, "unheard"), (5, 4, "parser_error")], "issue int, span int, cause string")
    got = {x.obligation: x for x in compare.obligation_scoring(o, e, ["K"], issues).collect()}
    assert {k: x.status for k, x in got.items()} == {0: "parser_error", 1: "missing_context", 2: "missing", 3: "missing", 4: "pass", 5: "fail", 6: "unsupported"}
    assert (got[5].method_tp, got[5].method_fp, got[5].method_fn, got[5].rate_fp, got[5].rate_fn) == (0, 0, 1, 1, 1)
    assert {x.status for x in compare.obligation_scoring(o, e, ["K"]).collect()} == {"missing", "pass", "fail", "unsupported"}


def test_closure_is_idempotent_and_bears_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (None, 1)], "child int, parent int")
    once = graphs.closure(e)
    twice = graphs.closure(once.withColumnsRenamed({"node": "child", "ancestor": "parent"}))
    assert rows(once, "node", "ancestor") == rows(twice, "node", "ancestor")
    assert rows(graphs.on_cycles(e), "node") == [(1,), (2,), (3,), (5,)]


def test_blocking_keeps_every_pair(spark):
    r = random.Random(6)
    pick = lambda n, k: [str(r.randint(0, k)) for _ in range(r.randint(0, n))]
    items = [(i, pick(4, 2), pick(2, 4), pick(2, 4), pick(2, 4), pick(3, 3), pick(3, 3)) for i in range(50)]
    df = spark.createDataFrame(items, "id int, ops array<string>, channels array<string>, roles array<string>, targets array<string>, wording array<string>, terms array<string>")
    got = {(x.a, x.b): x.score for x in compare.compare_items(df).collect()}

    def score(x, y):
        share = lambda m, p, w: round(min(w, m / p * w), 3) if p else 0
        both = lambda i: (len(set(x[i]) & set(y[i])), len(set(x[i]) | set(y[i])))
        n = lcs(x[1], y[1])
        role = both(3)
        return round(share(n, max(len(x[1]), len(y[1])), 0.24) + share(*both(2), 0.2) + share(role[0] if n else 0, role[1], 0.18) + share(*both(4), 0.18) + share(*both(5), 0.08) + share(*both(6), 0.12), 3)

    want = {(x[0], y[0]): s for x, y in itertools.combinations(items, 2) if (s := score(x, y)) >= 0.4}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.002 for k in want)


def test_sources(spark, tmp_path):
    (tmp_path / "whole.json").write_text(json.dumps({"chunks": [{"id": 1}, {"id": 2}]}, indent=1))
    assert rows(tables.read_records(spark, f"file://{tmp_path}/whole.json", "chunks"), "id") == [(1,), (2,)]
    (tmp_path / "sites.json").write_text('{"_schemaNote": "about", "id": null}\n{"id": 3}\n')
    assert rows(tables.read_star(spark, {"s": f"file://{tmp_path}/sites.json"})["s"], "id") == [(3,)]
    (tmp_path / "n.csv").write_text("id,name\n1,x\n")
    (tmp_path / "e.csv").write_text("source,target,type\n1,2,in\n")
    n, e = tables.read_graph(spark, f"file://{tmp_path}/n.csv", f"file://{tmp_path}/e.csv")
    assert n.first().name == "x" and e.first().type == "in"
    (tmp_path / "t.txt").write_text("12. first\nsecond")
    assert rows(tables.read_text_lines(spark, f"file://{tmp_path}/t.txt"), "line", "source_number", "text") == [(0, 12, "first"), (1, None, "second")]
    good = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    out = f"file://{tmp_path}/published"
    assert tables.publish(good, out, F.lit(None).cast("string")) == 2 and tables.publish(good.limit(1), out, F.lit(None).cast("string")) == 1
    with pytest.raises(ValueError, match="bad b"):
        tables.publish(good, out, F.when(F.col("v") == "b", "bad b"))
    assert spark.read.parquet(out).count() == 1
    tables.write_postings(spark.createDataFrame([("ab", 1), ("ac", 2), ("b", 1)], "token string, doc int"), f"file://{tmp_path}/post")
    assert spark.read.parquet(f"file://{tmp_path}/post").where("first = 'a'").count() == 2


def test_pages_to_groups(spark):
    html = '<h2>Head</h2><a href="/1">one</a><a href="/1">one</a><h2> </h2><h3>Next</h3><a href="/2"><b>two</b></a>'
    got = tables.pages_to_groups(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string"))
    assert rows(got.where("NOT is_parent"), "label", "url", "parent") == [("one", "/1", "Head"), ("two", "/2", "Next")]


def test_streams_agree_with_batches(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):
        ev.where(f"event_id % 3 = {i}").union(ev.where(f"event_id % 30 = {i}")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = streams.stream_decision_metrics(stream(), "365 days", "1 day").writeStream.outputMode("append").format("memory").queryName("m").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {(x.start, x.event_type): x.n for x in streams.event_windows(ev, "1 day").collect()}
    assert all(batch[x.start, x.event_type] == x.n for x in spark.table("m").collect())
    q = streams.stream_decision_metrics(stream(), "365 days", "1 day").writeStream.outputMode("complete").format("memory").queryName("all_of_it").option("checkpointLocation", f"file://{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(x.start, x.event_type): x.n for x in spark.table("all_of_it").collect()} == batch
    out = f"file://{tmp_path}/latest"
    q = stream().writeStream.foreachBatch(streams.upsert_latest(out, "user_id", ["ts", "event_id"])).option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    last = streams.read_latest(spark, out, q.lastProgress["batchId"], ev.schema)
    assert rows(last, "user_id", "event_id") == rows(streams.latest(ev, "user_id", ["ts", "event_id"]), "user_id", "event_id")
    assert streams.sessions(ev, "1 hour").agg(F.sum("n")).first()[0] == ev.count()


def test_latest_state_rewrites_only_what_a_batch_meets(spark, tmp_path):
    import datetime as dt
    import os

    r = random.Random(5)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    schema = "user_id long, event_id long, ts timestamp, value double"
    batches = [[(u, 1000 + u, day(u % 9), 0.5) for u in range(400)], [], [(7, 2000, day(10), 1.0), (8, 2001, day(-5), 1.0), (None, 2002, day(10), 1.0)], [(7, 2003, day(10), 2.0)], [(r.randrange(500), 3000 + i, day(r.randrange(16)), 3.0) for i in range(60)]]
    frame = lambda rows_: spark.createDataFrame(rows_, schema)
    out, seen = f"file://{tmp_path}/state", []
    files = lambda: {(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{tmp_path}/state/") for f in fs if f.endswith(".parquet") and "/state/state/" not in d}
    for n, batch in enumerate(batches):
        before = files()
        streams.upsert_latest(out, "user_id", ["ts", "event_id"], "6 days", 16)(frame(batch), n)
        new = {f: size for f, size in files().items() if f not in before}
        if n == 3:
            assert len(new) == 1 and sum(new.values()) < 0.2 * sum(before.values())
        if n in (1, 3, 4):  # a batch that comes again, by a writer that knows nothing of the first, changes nothing
            streams.upsert_latest(out, "user_id", ["ts", "event_id"], "6 days", 16)(frame(batch), n)
        seen += batch
        last, newest = {}, max(x[2] for x in seen)
        for x in seen:
            last[x[0]] = max(last.get(x[0], x), x, key=lambda y: (y[2], y[1]))
        want = {(u, x[1]) for u, x in last.items() if x[2] >= newest - dt.timedelta(days=6)}
        assert {(x.user_id, x.event_id) for x in streams.read_latest(spark, out, n, schema, "6 days").collect()} == want
    assert len([d for d in os.listdir(f"{tmp_path}/state/state") if d.startswith("v=")]) == 2


def test_cycles_equal_reach_and_long_ones_settle(spark):
    r = random.Random(11)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(75)] + [(100, 101), (101, 100), (102, 102), (102, 103), (None, 1), (1, None), (101, 104), (104, 105)]
    pairs += [(x, x + 1) for x in range(200, 230)] + [(230, 210), (215, 225), (222, 212)]
    to = {}
    for x, y in pairs:
        if x is not None and y is not None:
            to.setdefault(x, set()).add(y)

    def reaches_itself(x):
        seen, open_ = set(), [x]
        while open_:
            for y in to.get(open_.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    open_.append(y)
        return x in seen

    df = lambda x: spark.createDataFrame(x, "child long, parent long")
    want = sorted((x,) for x in to if reaches_itself(x))
    assert rows(graphs.on_cycles(df(pairs)), "node") == want and 10 < len(want) < len(to)
    assert graphs.on_cycles(df([])).count() == 0
    n = 300
    long = spark.range(n).selectExpr("id AS child", f"(id + 1) % {n} AS parent").union(spark.range(n, n + 100).selectExpr("id", "id + 1"))
    assert graphs.on_cycles(long).agg(F.count("*"), F.min("node"), F.max("node")).first()[:] == (n, 0, n - 1)


def all_pairs_aligned(left, right, generic_terms, generic_ops, k):
    """Alignment by meeting every pair of a block."""
    out = []
    for x in left:
        found = []
        for y in right:
            if x["system"] is None or x["chapter"] is None or (x["system"], x["chapter"]) != (y["system"], y["chapter"]):
                continue
            both = lambda c: ({*(x[c] or [])} & {*(y[c] or [])}) - {None}  # noqa: E731, B023
            link, titled = x["id"] in (y["linked"] or []), bool(x["title"]) and bool(y["title"]) and (x["title"] in y["title"] or y["title"] in x["title"])
            nt, nc, no, ng = len(both("terms") - {*generic_terms}), len(both("constants")), len(both("ops") - {*generic_ops}), len(both("terms"))
            gap = None if x["place"] is None or y["place"] is None else abs(x["place"] - y["place"])
            near = 0 if gap is None else max(0, 5 - gap)
            score = 20 * link + 16 * titled + 6 * nt + 4 * nc + 2 * no + near
            if link or titled and (nt or nc or near >= 2):
                tier = "high"
            elif titled or nt and (nc or near >= 2) or nt >= 2 and near >= 1:
                tier = "medium"
            elif nt + nc + no == 0 and ng:
                tier = "generic_only"
            elif score >= 5:
                tier = "review"
            else:
                continue
            found.append((-score, gap is None, gap or 0, y["id"], tier))
        out += [(x["id"], y, -s, tier, i + 1) for i, (s, _, _, y, tier) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("few, widest, n", [(2, 2, 80), (1, 8, 60), (64, 8, 60)])
def test_aligned_items_equal_all_pairs(spark, few, widest, n):
    r = random.Random(few * 10 + widest)
    some = lambda xs, most: r.choice([None, [r.choice([*xs, None]) for _ in range(r.randrange(most + 1))]])
    schema = "id long, system string, chapter long, title string, terms array<string>, constants array<long>, ops array<string>, place double, linked array<long>"

    def items(first):
        return [dict(
            id=first + i, system=r.choice(["s", "s", "s", "t", None]), chapter=r.choice([1, 1, 1, 2]), title=r.choice([None, "", "ab", "abc", "b", "x y", "x", "long title of its own", f"t{i}"]),
            terms=some(["red", "old", "w1", "w2", f"v{i % 7}"], 4), constants=some([1, 2, i % 9], 2), ops=some(["op0", "add", "set"], 2), place=r.choice([None, 0.0, float(r.randrange(40)), float(r.randrange(40)), r.random() * 40]),
            linked=[] if r.random() < 0.9 else [r.randrange(n)]) for i in range(n)]

    left, right = items(0), items(1000)
    df = lambda rows_: spark.createDataFrame(rows_, schema)
    found = joins.align_scored(df(left).drop("linked"), df(right), ["red", "old"], ["op0"], 3, few, widest)
    got = sorted((x.l_id, x.r_id, round(x.score, 6), x.tier, x["rank"]) for x in found.collect())
    want = [(i, j, round(s, 6), tier, rank) for i, j, s, tier, rank in all_pairs_aligned(left, right, {"red", "old"}, {"op0"}, 3)]
    assert got == want and {x[3] for x in want} == {"high", "medium", "review", "generic_only"}


def test_generic_lists_are_walked_past_what_shares_more(spark):
    """Forty nearer items share an operation and are too far for a tier, so the walk doubles beyond them."""
    item = lambda i, place, ops: dict(id=i, system="s", chapter=1, title=None, terms=["red"], constants=None, ops=ops, place=place, linked=None)
    left = [item(1, 0.0, ["add"])]
    right = [item(100 + i, 10.0 + i, ["add"]) for i in range(40)] + [item(200 + i, 90.0 - i, None) for i in range(5)]
    schema = "id long, system string, chapter long, title string, terms array<string>, constants array<long>, ops array<string>, place double, linked array<long>"
    df = lambda rows_: spark.createDataFrame(rows_, schema)
    found = joins.align_scored(df(left).drop("linked"), df(right), ["red"], [], 3, 2)
    assert rows(found, "l_id", "r_id", "tier", "rank") == [(1, 202, "generic_only", 3), (1, 203, "generic_only", 2), (1, 204, "generic_only", 1)]
    empty = df([])
    assert joins.align_scored(empty.drop("linked"), df(right), ["red"]).count() == joins.align_scored(df(left).drop("linked"), empty, ["red"]).count() == 0


def test_sections_and_notes():
    kinds = ["heading", "source", "translation", "mark", "procedure", "translation", "source", "mark", "translation", "mark", "heading"]
    assert extraction.sections_of(kinds) == [
        (0, "first"), (0, "continues"), (0, "continues"), (0, "continues"), (1, "procedure_after_mark"), (1, "continues"), (2, "source_after_translation"), (2, "continues"), (2, "continues"), (2, "continues"), (3, "heading"),
    ]
    assert extraction.sections_of(["translation", "mark"]) == [(0, "first"), (1, "mark_before_source")]


def test_notes_go_on_to_the_end_of_the_page(spark):
    pages = [[1, 1, 2], [5, 3, 4], [4], [2, 5, 6, 9], [5], [6, 8], [6, 7]]  # a digit in the body, then the notes of the page
    rows_ = [(1, p, i, n) for p, page in enumerate(pages) for i, n in enumerate(page)] + [(2, 0, 0, 2), (2, 1, 0, 1)]
    got = {(r.doc, r.page, r.pos): r.accepted for r in extraction.expected_suffix(spark.createDataFrame(rows_, "doc int, page int, pos int, number int"), "doc", "page", "pos", "number").collect()}
    assert {k for k, v in got.items() if v} == {(1, 0, 1), (1, 0, 2), (1, 1, 1), (1, 1, 2), (1, 4, 0), (1, 6, 0), (1, 6, 1), (2, 1, 0)} and len(got) == len(rows_)


def test_chains_run_to_their_end(spark):
    n = 40
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 999)], "child int, parent int")
    nodes = spark.createDataFrame([(i, i > 0) for i in range(n + 1)] + [(1000, True), (2000, True)], "id int, active boolean")
    got = dict(rows(graphs.propagate_inactive(nodes, edges), "id", "status"))
    assert got[0] == "inactive" and got[2000] == "active" and all(got[i] == "needs_revalidation" for i in [*range(1, n + 1), 1000])
    back = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 5), (3, 1)], "child int, parent int")
    assert rows(graphs.on_cycles(back), "node") == [(1,), (2,), (3,), (5,), (6,), (7,)]


def test_facts_block_conflicts_and_ground_no_cycle(spark):
    a = spark.createDataFrame([("a", "k", "1", True), ("x", "k", "9", False), ("c", "k", "2", True)], "target string, facet string, value string, reviewed boolean")
    rules = spark.createDataFrame([("a", "k", "b", "k"), ("b", "k", "d", "k"), ("x", "k", "y", "k"), ("y", "k", "x", "k"), ("d", "k", "c", "k")], "target string, facet string, to_target string, to_facet string")
    got = {(r.target, r.value): (r.status, r.depth) for r in extraction.derive_facts(a, rules).collect()}
    long = spark.createDataFrame([(str(i), "k", str(i + 1), "k") for i in range(12)], "target string, facet string, to_target string, to_facet string")
    far = extraction.derive_facts(spark.createDataFrame([("0", "k", "v", True)], "target string, facet string, value string, reviewed boolean"), long)
    assert far.count() == 13 and far.agg(F.max("depth")).first()[0] == 12
    assert got == {("a", "1"): ("grounded", 0), ("b", "1"): ("grounded", 1), ("d", "1"): ("grounded", 2), ("c", "1"): ("conflict", None), ("c", "2"): ("conflict", None), ("x", "9"): ("ungrounded", None), ("y", "9"): ("ungrounded", None)}


def test_facts_of_two_premises_and_rejections(spark):
    a = spark.createDataFrame([("a", "k", "1", "x", True), ("b", "k", "1", "x", True), ("c", "k", "1", "y", True), ("q", "k", "7", "x", True)], "target string, facet string, value string, authority string, reviewed boolean")
    rules = spark.createDataFrame([("r1", "a", "k", "d", "k"), ("r1", "b", "k", "d", "k"), ("r2", "a", "k", "e", "k"), ("r2", "c", "k", "e", "k"), ("r3", "q", "k", "z", "k"), ("r4", "d", "k", "f", "k"), ("r5", "a", "k", "f", "k")], "rule string, target string, facet string, to_target string, to_facet string")
    no = spark.createDataFrame([("q", "k", "7")], "target string, facet string, value string")
    got = {(r.target, r.value): (r.status, r.depth, r.n_proofs) for r in extraction.derive_facts(a, rules, no).collect()}
    assert got[("d", "1")] == ("grounded", 1, 1) and ("e", "1") not in got  # premises of two authorities do not meet
    assert got[("q", "7")] == ("rejected", None, 0) and got[("z", "7")] == ("ungrounded", None, 0) and got[("f", "1")] == ("grounded", 1, 2)


def test_overlay_splits_relates_and_rejects(spark):
    units = spark.createDataFrame([(1, 10, 0, "abcdef", "t", "r0"), (1, 11, 1, "gh", "t", "r1"), (1, 12, 2, "ij", "u", "r2")], "doc int, id int, pos int, text string, type string, relations string")
    ops = spark.createDataFrame([(1, 10, 1, "split", "4,2"), (1, 11, 2, "merge", None), (1, 12, 3, "set_relations", "new"), (1, 99, 4, "set_type", "x"), (1, 11, 5, "split", "2"), (1, 10, 6, "merge", None), (1, 10, 7, "replace_text", "z"), (1, 12, 8, "split", "1,1")], "doc int, target int, seq int, op string, value string")
    assert rows(logs.apply_overlay(units, ops), "id", "part", "text", "relations", "n") == [(10, 0, "ab", None, 1), (10, 1, "cd", None, 1), (10, 2, "efgh", None, 2), (12, 0, "ij", "new", 1)]
    assert rows(logs.overlay_rejections(units, ops), "seq", "reason") == [(4, "target_not_found"), (5, "invalid_split_boundaries"), (6, "merge_requires_adjacent_units"), (7, "unsupported_op"), (8, "invalid_split_boundaries")]


def test_names_bind_along_steps(spark):
    ref = spark.createDataFrame([(1, 1, 0, 50, "r", None, "x"), (2, 1, 100, 150, "r", "x", "y"), (3, 1, 200, 250, "r", "y", None), (4, 1, 300, 350, "r", "nobody", None), (5, 1, 400, 450, "r", "x", None)], "ref int, doc int, start int, end int, role string, uses string, gives string")
    events = spark.createDataFrame([(10, 1, 5, 10, "r", None, "v1"), (20, 1, 105, 110, "r", "v1", "v2"), (21, 1, 111, 120, "r", "v9", "v3"), (30, 1, 205, 210, "r", "v3", None), (50, 1, 405, 410, "r", "v1", None), (51, 1, 411, 420, "r", "v1", None)], "event int, doc int, start int, end int, role string, reads string, writes string")
    assert rows(compare.reference_match(ref, events), "ref", "status", "event") == [(1, "match", 10), (2, "match", 20), (3, "mismatch", None), (4, "dependency_unavailable", None), (5, "ambiguous", None)]


def test_unmatched_buckets_and_weak_pairs(spark):
    side = "chunk int, pos int, template string"
    left = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (3, 1, "a"), (3, 2, "b"), (3, 3, "c")], side)
    right = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x"), (2, 2, "y"), (2, 3, "z"), (3, 1, "x"), (3, 2, "y")], side)
    presets = spark.createDataFrame([("b", "x")], "left string, right string")
    got = rows(compare.pair_clauses(left, right, presets, 4), "chunk", "left", "right", "strength")
    assert got == [(1, "a", "x", "ordinal"), (1, "a", "y", "cooccurrence"), (1, "b", "x", "preset"), (1, "b", "y", "ordinal"), (2, "a", "x", "one_to_many"), (2, "a", "y", "one_to_many"), (2, "a", "z", "one_to_many"), (3, "a", "x", "near"), (3, "b", "x", "preset"), (3, "b", "y", "near")]


def test_subsequence_pairs(spark):
    r = random.Random(8)
    data = [([r.choice("abc") for _ in range(r.randint(0, 9))], [r.choice("abc") for _ in range(r.randint(0, 9))]) for _ in range(60)]
    df = spark.createDataFrame(data, "a array<string>, b array<string>")
    for x in df.select("a", "b", T.lcs_length("a", "b").alias("n"), T.lcs_pairs("a", "b").alias("p")).collect():
        assert x.n == len(x.p) == lcs(x.a, x.b) and all(x.a[q.left] == x.b[q.right] for q in x.p)
        assert all(p.left < q.left and p.right < q.right for p, q in itertools.pairwise(x.p))


# --- joins by what names and phrases hold ------------------------------------------


def test_contained_texts_equal_a_nested_loop(spark):
    r = random.Random(21)
    word = lambda n: "".join(r.choice("abc日 ") for _ in range(n))
    texts = [(i, r.choice("xy"), word(r.randint(0, 12)) if i else None) for i in range(150)]
    needles = [(i, r.choice("xy"), word(r.randint(0, 5)) if i else None) for i in range(80)] + [(80, "x", "步日月法"), (81, "x", "日")]
    texts.append((150, "x", "步日月法上"))
    got = joins.contained_in(spark.createDataFrame(texts, "text_id int, s string, text string"), spark.createDataFrame(needles, "needle_id int, s string, needle string"), ["s"]).collect()
    want = sorted((i, j) for i, s, t in texts for j, z, n in needles if s == z and t and n and n in t)
    assert sorted(map(tuple, got)) == want and (150, 80) in want


def test_constants_stay_in_their_source(spark):
    refs = [(1, "a", "x one", ["p", "q"], 10), (2, "b", "x one", [], 5), (3, "a", "none", ["q"], None), (4, "a", "one", [], 90), (5, "a", "", ["zz"], 1)]
    consts = [(10, "a", "x one", [], 99), (11, "b", "one", [], 6), (12, "a", "other", ["q", "p"], 10), (13, "b", "y one", [], 5), (14, "a", "", [], 1)]
    side = lambda rows, i: spark.createDataFrame(rows, f"{i} int, source string, name string, terms array<string>, line int")
    got = {r.ref_id: (r.const_id, r.score) for r in joins.constant_for_name(side(refs, "ref_id"), side(consts, "const_id")).collect()}
    assert got == {1: (10, 100), 2: (11, 60 - 1 + 6), 3: (12, 20), 4: (10, 60 - 9)}


def test_claims_are_bound_by_mention_title_heading_or_family(spark):
    a = [
        (1, "s", [1], "P. 2", "", None, None, [], 0, False), (2, "s", [1], "P. 22", " The  Way", None, None, [], 0, False), (3, "s", [1], "P. 9", "", "HEAD", None, [], 0, False),
        (4, "s", [2], "P. 9", "", None, "f", ["d"], 1, False), (5, "s", [2], "P. 9", "", None, "f", ["d"], 2, False), (6, "s", [2], "P. 9", "", None, None, ["d"], 0, True), (7, "s", [3], "P. 9", "", "", "f", [], 0, False), (8, "t", [1], "P. 2", "", None, None, [], 0, False),
    ]
    k = [(10, "s", 1, None, "see P. 2.", [], True), (11, "s", 1, None, "P. 23 of the way", [], True), (12, "s", 1, None, "P. 2 and HEAD", [], False), (13, "s", 2, "f", "words", ["d"], True), (14, "s", 1, None, "HEADS", [], True)]
    anchors = spark.createDataFrame(a, "anchor int, system string, chunks array<int>, mention string, title string, heading string, family string, distinctive array<string>, n_mentions int, table_like boolean")
    claims = spark.createDataFrame(k, "claim_id int, system string, chunk int, family string, text string, distinctive array<string>, strict boolean")
    got = {r.anchor: (r.claim_ids, r.status) for r in joins.bind_claims(anchors, claims).collect()}
    assert got == {
        1: ([10], "bound"), 2: ([11], "bound"), 3: ([14], "bound"), 4: ([13], "needs_review"), 5: ([], "claim_exists_but_not_bound"), 6: ([], "commentary_only"), 7: ([], "no_claim_extracted"), 8: ([], "no_claim_extracted"),
    }


def test_phrases_that_are_found_are_those_that_are_there(spark, monkeypatch):
    r = random.Random(4)
    words = lambda n: [r.choice("abcdefg") for _ in range(n)]
    quotes = [(i, (w := words(r.randint(0, 12))), i / 10, [i % 3], " ".join(w[:2]), [" ".join(w[2:6]), "a b"], ["a b"]) for i in range(10)]
    sources = [(i, words(r.randint(0, 60)), i / 40, [i % 3]) for i in range(40)]
    q = spark.createDataFrame(quotes, "id int, words array<string>, place double, constants array<int>, title string, clauses array<string>, generic array<string>")
    s = spark.createDataFrame(sources, "id int, words array<string>, place double, constants array<int>").repartition(3)
    run = lambda: sorted(map(tuple, joins.quote_to_source(q, s, ["a b"], (4, 3), 100).collect()))
    got = run()
    grams = lambda w, n: {(n, *w[i : i + n]) for i in range(len(w) - n + 1)}
    holds = lambda w, x: bool(x) and f" {x} " in f" {' '.join(w)} "
    want = {}
    for i, w, _, _, title, clauses, _ in quotes:
        for d, v, _, _ in sources:
            met = [g for n in (3, 4) for g in grams(w, n) & grams(v, n)]
            own = [x for x in set(clauses) - {"a b"} if holds(v, x)]
            if met or own or holds(v, title):
                want[i, d] = (max((g[0] for g in met), default=0), len(met), len(own))
    assert {(r[0], r[1]): (r[2], r[3], r[4]) for r in got} == want and any(x[0] == 0 for x in want.values())
    monkeypatch.setattr(joins, "BROADCAST_GRAMS", 0)
    assert run() == got


def test_a_chain_of_undos_settles_in_few_rounds(spark, monkeypatch):
    rounds = []
    real = logs.materialize
    monkeypatch.setattr(logs, "materialize", lambda df, name: (rounds.append(name), real(df, name))[1])
    n = 3000
    chain = spark.createDataFrame([("k", i, i - 1 if i else None) for i in range(n)], "k string, id int, reverts int")
    got = {r.id: r.stands for r in logs.active_history(chain, "k").collect()}
    assert got == {i: (n - 1 - i) % 2 == 0 for i in range(n)} and rounds.count("waiting") <= 14


def test_terms_know_all_compounds_above_them(spark):
    o = spark.createDataFrame([(1, "a", "component"), (2, "b", "component"), (3, "c", "maximal"), (4, "a", "maximal"), (5, "d", "component"), (6, "d", "component")], "id int, surface string, level string")
    p = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5), (4, 99)], "id int, parent int")
    got = {r.surface: (r.kind, r.n_parents, r.first_parent, r.appears_in_compounds) for r in aggregates.term_index(o, p).collect()}
    assert got == {"a": ("both", 1, 2, 2), "b": ("component", 1, 3, 1), "c": ("maximal", 0, None, 0), "d": ("component", 2, 5, 2)}


def test_a_document_of_many_batches_is_walked_in_order(spark, monkeypatch):
    r = random.Random(3)
    kinds = ["source", "translation", "mark", "procedure"]
    lines = [(d, i, r.choice(kinds + ["heading"] * (d == "b" and i % 50 == 0))) for d in "abc" for i in range(700)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = extraction.sectionize(spark.createDataFrame(lines, "doc string, line int, kind string").repartition(5), "doc", "line", "kind").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for d in "abc":
        mine = sorted(x for x in got if x.doc == d)
        cuts = [i for i, x in enumerate(mine) if x.kind == "heading"]
        for n, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(mine)], strict=True)):
            want = extraction.sections_of([x.kind for x in mine[low:high]])
            assert [(x.part, x.section, x.why) for x in mine[low:high]] == [(n, *w) for w in want]
