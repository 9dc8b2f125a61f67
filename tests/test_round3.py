"""Cases of the third review: ties, exact sums, and joins that must not grow with the pairs they try."""

import random
import re

from stemma.operators import banks, compare, extraction, graphs, intervals, joins
from stemma.plans import catalog


def test_char_coverage_has_no_open_ties():
    windows = re.findall(r"OVER \(([^)]*)\)", catalog.ORACLE_SQL["c16_char_coverage"])
    assert windows and all("ORDER BY s, e, id" in w for w in windows)


def test_equal_spans_make_one_range(spark):
    spans = spark.createDataFrame([("a", 5, 9)] * 40 + [("a", 5, 7), ("a", 9, 12), ("a", 20, 20), ("a", 20, 21), ("b", 0, 3)], "doc string, start int, end int")
    got = sorted((r.doc, r.start, r.end) for r in intervals.merge(spans, "doc").collect())
    assert got == [("a", 5, 12), ("a", 20, 21), ("b", 0, 3)]


def test_stable_lead_sums_exactly(spark, tmp_path):
    rows = [(1, "click", 0.1)] * 1010 + [(1, "view", 51.0), (2, "view", 101.0), (2, "click", 51.01)]
    spark.createDataFrame(rows, "user_id int, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["w12_stable_lead"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(1, "click", 101.0, 51.0)] and dict(got.dtypes)["score"] == "double"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_expected_suffix_walks_in_a_stream(spark):
    """Pages of a document are never collected; a page accepted by chance of what came before keeps its place."""
    notes = spark.createDataFrame([(d, p, i, (p * 3 + i) % 7 if d else p * 3 + i + 1) for d in range(3) for p in range(50) for i in range(3)], "doc int, page int, pos int, number int")
    out = extraction.expected_suffix(notes, "doc", "page", "pos", "number")
    assert "collect_list" not in plan_of(out)
    got = {(r.doc, r.page, r.pos): r.accepted for r in out.collect()}
    assert all(got[0, p, i] for p in range(50) for i in range(3)) and len(got) == 450 and not all(got.values())


def test_strongest_claim_meets_one_claim_a_text(spark):
    terms = spark.createDataFrame([(i, "A" if i % 2 else "b", i % 3) for i in range(300)], "term_id int, text string, value int")
    claims = spark.createDataFrame([(i, "a" if i % 3 else "B", 1 + i % 4, i % 5, i % 2 == 0) for i in range(300)], "claim_id int, text string, value int, level int, strong boolean")
    out = joins.strongest_claim_for_term(terms, claims)
    for below in re.split(r"\n.*Join Inner", out._jdf.queryExecution().optimizedPlan().toString())[1:]:
        assert "Aggregate" in below  # claims are reduced before they meet terms
    ts, cs = terms.collect(), claims.collect()
    want = {}
    for t in ts:
        met = [(k.level, k.claim_id) for k in cs if k.text.lower() == t.text.lower() or (k.strong and k.value == t.value)]
        if met:
            want[t.term_id] = min(met)
    assert {r.term_id: (r.level, r.claim_id) for r in out.collect()} == want


def test_differences_within_compares_blocks(spark):
    rows = [(i, f"k{i % 3}", ["x", f"o{i % 4}"], [f"r{i % 2}"]) for i in range(60)]
    out = compare.differences_within(spark.createDataFrame(rows, "id int, k string, ops array<string>, roles array<string>"), "k", block=2)
    assert len(re.findall("Join Inner", out._jdf.queryExecution().optimizedPlan().toString())) == 1
    want = {(a, b, tuple(sorted(set(ao) - set(bo))), tuple(sorted(set(bo) - set(ao))), tuple(sorted(set(ar) - set(br)))) for a, ka, ao, ar in rows for b, kb, bo, br in rows if ka == kb and a < b}
    assert sorted((r.a, r.b, tuple(r.a_only), tuple(r.b_only), tuple(r.a_roles_only)) for r in out.collect()) == sorted(want)


def test_diagnostic_counts_equal_those_of_pairs(spark):
    """Counts by combinations equal counts of pairs, unknown families, repeated and wide arrays among them, without pairs."""
    r = random.Random(5)
    some = lambda x, n, k: [f"{x}{r.randrange(n)}" for _ in range(r.randrange(k))]
    family = lambda: r.choice([None, "p", "q", "r"])
    wide = lambda i: [f"t{x}" for x in range(12)] if i % 40 == 7 else []
    spans = [(i, f"s{i % 2}", family(), some("t", 8, 4) + wide(i), [r.randrange(6) for _ in range(r.randrange(3))], some("d", 2, 2)) for i in range(120)]
    claims = [(i, f"s{i % 2}", family(), some("t", 8, 4) + wide(i), [r.randrange(6) for _ in range(r.randrange(3))], some("d", 2, 2), r.random() < .3, r.choice([None, "", "add", "cut"]), r.random() < .5) for i in range(120)]
    same = "system string, family string, terms array<string>, `values` array<int>, distinctive array<string>"
    s, c = spark.createDataFrame(spans, "span_id int, " + same), spark.createDataFrame(claims, "claim_id int, " + same + ", titled boolean, op string, strong boolean")
    want = {tuple(x) for x in banks.count_diagnostics(banks.claim_diagnostics(s, c, ["t0", "t1", "t2"], ["add"])).collect()}
    got = banks.diagnostic_counts(s, c, ["t0", "t1", "t2"], ["add"])
    assert {tuple(x) for x in got.collect()} == want and len({x[2:] for x in want}) > 20
    no_wide = banks.diagnostic_counts(s.where("size(terms) < 5"), c.where("size(terms) < 5"), ["t0"], ["add"])
    assert len(re.findall("Join", no_wide._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_contained_in_deals_common_needles(spark):
    texts = [(i, f"s{i % 2}", ["red ring", "ring", "blue"][i % 3]) for i in range(60)]
    needles = [(i, f"s{i % 2}", ["ring", "e", "", "zz"][i % 4]) for i in range(80)]
    t, n = spark.createDataFrame(texts, "text_id int, system string, text string"), spark.createDataFrame(needles, "needle_id int, system string, needle string")
    out = joins.contained_in(t, n, ["system"], salts=3, block=2)
    assert "_salt" in plan_of(out)
    assert sorted(map(tuple, out.collect())) == sorted((i, j) for i, s, x in texts for j, z, y in needles if s == z and y and y in x)


def test_constant_for_name_meets_kinds_once(spark):
    row = lambda i: (i, f"s{i // 2 % 2}", ["old ring", "ring", "new bolt", "bolt x"][i % 4] + ("" if i % 3 else "y"), ["a", f"t{i % 5}"] if i % 7 else [], None if i % 11 == 0 else i % 13 * 4)
    refs, consts = [row(i) for i in range(0, 300, 2)], [(i, s, "z " + n if i % 5 else n, t, line) for i, s, n, t, line in map(row, range(1, 300, 2))]
    same = " int, source string, name string, terms array<string>, line int"
    out = joins.constant_for_name(spark.createDataFrame(refs, "ref_id" + same), spark.createDataFrame(consts, "const_id" + same))
    assert "kind" in plan_of(out)  # rows that agree share one search
    want = {}
    for i, s, n, t, line in refs:
        exact = [(-100, k) for k, z, m, *_ in consts if z == s and m == n]
        for k, z, m, u, other in consts if not exact else []:
            points = 60 * (z == s and (n.endswith(m) or m.endswith(n))) + 20 * len(set(t) & set(u)) if z == s else 0
            d = None if line is None or other is None else abs(line - other)
            near = 0 if d is None else (10 if d == 0 else 6 if d <= 3 else 3 if d <= 8 else 0) - min(d, 40)
            if points > 0 and points + near > 0:
                exact.append((-points - near, k))
        if exact:
            want[i] = min(exact)
    assert {r.ref_id: (-r.score, r.const_id) for r in out.collect()} == want and len(want) > 50


def broadcast_below(plan):
    """Lines of a plan that stand below a broadcast."""
    found, at = [], None
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :|+-"))
        at = at if at is not None and depth > at else None
        if at is not None:
            found.append(line)
        elif "BroadcastExchange" in line:
            at = depth
    return found


def test_combinations_of_claims_are_never_broadcast(spark, monkeypatch):
    """Tables that unfold into combinations look small to Spark: no join may send them to the driver, nor try all pairs of an operation."""
    plans, write = [], joins.materialize
    monkeypatch.setattr(joins, "materialize", lambda df, name: (plans.append(df), write(df, name))[1])
    rows = [(i, f"o{i % 3}", ["x", "y", None][i % 5 % 3], [i % 4, i % 7], [f"t{i % 5}", f"u{i % 3}"], i % 6) for i in range(400)]
    # [1] as inputs and 1 as modulus are two kinds
    rows += [(400 + i, "o9", "x", [1] if i < 3 else [], [], None if i < 3 else 1) for i in range(6)]
    schema = "{} int, op string, system string, inputs array<int>, terms array<string>, modulus int"
    steps, claims = (spark.createDataFrame(rows[i::2], schema.format(name)) for i, name in enumerate(("step_id", "claim_id")))
    out = joins.claims_to_steps(steps, claims)
    for df in [*plans, out]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NOT (s_short" not in plan
        assert not any("Generate explode" in x for x in broadcast_below(plan))

    def score(s, c):
        inputs = sum(min(s[3].count(v), c[3].count(v)) for v in set(s[3]))
        return 4 + (2 if s[2] and s[2] == c[2] else -2) + 2 * inputs + 2 * len(set(s[4]) & set(c[4])) + 2 * (s[5] is not None and s[5] == c[5])

    want = {(s[0], r + 1, c, -x) for s in rows[::2] for r, (x, c) in enumerate(sorted((-score(s, c), c[0]) for c in rows[1::2] if c[1] == s[1])[:5])}
    assert {(x.step_id, x["rank"], x.claim_id, x.score) for x in out.collect()} == want


def test_rounds_of_rules_are_not_broadcast(spark, monkeypatch):
    """Rules and facts are joined by merging in every round, so none passes through the driver."""
    plans, write = [], extraction.materialize
    monkeypatch.setattr(extraction, "materialize", lambda df, name: (plans.append(df), write(df, name))[1])
    facts = spark.createDataFrame([(i, "kind", "v", "a", i % 3 == 0) for i in range(8, 16)], "target int, facet string, value string, authority string, reviewed boolean")
    rules = spark.createDataFrame([(i, i, "kind", i // 2, "kind") for i in range(2, 16)], "rule int, target int, facet string, to_target int, to_facet string")
    out = extraction.derive_facts(facts, rules, spark.createDataFrame([(9, "kind", "v")], "target int, facet string, value string"))
    assert not any("BroadcastExchange" in plan for plan in (x._jdf.queryExecution().executedPlan().toString() for x in [*plans, out]))
    got = {r.target: (r.status, r.depth, r.n_proofs) for r in out.collect()}
    assert got[9] == ("rejected", None, 0) and got[12] == ("grounded", 0, 0) and got[6] == ("grounded", 1, 2) and got[1] == ("grounded", 3, 2) and got[5] == ("ungrounded", None, 2)


def test_first_noisy_claims_equal_those_of_pairs(spark):
    """The first noisy claims come from short lists, also where claims of meaning fill a list; unknown families and repeated terms among them."""
    r = random.Random(8)
    some = lambda x, n, k: [f"{x}{r.randrange(n)}" for _ in range(r.randrange(k))]
    family = lambda: r.choice([None, "p", "q", "r"])
    row = lambda i: (i, f"s{i % 2}", family(), some("t", 8, 4), [r.randrange(6) for _ in range(r.randrange(3))], some("d", 2, 2) if r.random() < .3 else [])
    spans, claims = [row(i) for i in range(150)], [row(i) + (r.random() < .3, r.choice([None, "", "add", "cut"]), r.random() < .5) for i in range(150)]
    same = "system string, family string, terms array<string>, `values` array<int>, distinctive array<string>"
    s, c = spark.createDataFrame(spans, "span_id int, " + same), spark.createDataFrame(claims, "claim_id int, " + same + ", titled boolean, op string, strong boolean")
    how = (s, c, ["t0", "t1", "t2"], ["add"])
    d = banks.claim_diagnostics(*how)
    want = {x.span_id: x.top_noisy for x in banks.noisy_of_diagnostics(d).collect()}
    assert len(want) > 100 and len({len(x) for x in want.values()}) == 3
    for listed in (3, 16, 200):
        out = banks.first_noisy(*how, listed=listed)
        assert {x.span_id: x.top_noisy for x in out.collect()} == want
        assert listed < 200 or "claim_distinctive" not in plan_of(out)
    m = {x.span_id: x for x in banks.target_family_map(s, banks.diagnostic_counts(*how), banks.first_noisy(*how)).collect()}
    for i in range(150):
        x = [y for y in d.where(f"span_id = {i}").collect()] if i % 15 == 0 else None
        if x is not None:
            assert (m[i].n_accepted, m[i].n_rejected, m[i].n_noisy, m[i].n_generic) == (sum(y.compatible and y.strength != "generic_only" for y in x), sum(not y.compatible for y in x), sum(y.quality == "noisy" for y in x), sum(y.strength == "generic_only" for y in x))


def test_single_predicates_are_scored_without_python(spark):
    """Obligations of one predicate equal the assignment, ties and unknown values among them; only those of several reach Python rows."""
    r = random.Random(3)
    one = lambda: (r.choice(["K", "L", "M", None]), [r.choice("abc") for _ in range(r.randrange(4))], r.choice([None, "s", "t"]), r.choice([None, "m", "n"]), r.choice([None, 1, 2]))
    wanted = [(i, i % 90, *one()) for i in range(100)] + [(i, i % 90, *one()) for i in range(0, 100, 9)]
    events = [(1000 - i, r.randrange(80), *one()) for i in range(200)]
    fields = "span int, kind string, ports array<string>, scope string, method string, quantity int"
    issues = [(s, s, r.choice([None, "parser_gap", "interpretive_ambiguity", "x"])) for s in range(90)]
    o, e = spark.createDataFrame(wanted, "obligation int, " + fields), spark.createDataFrame(events, "event int, " + fields)
    names = ("kind", "ports", "scope", "method", "quantity")
    supported, why, asked = ["K", "L"], {s: c for _, s, c in issues}, {}
    for i, span, *x in wanted:
        asked.setdefault((i, span), []).append(dict(zip(names, x)))
    out = compare.obligation_scoring(o, e, supported, spark.createDataFrame(issues, "issue int, span int, cause string"))
    got = {x.obligation: x for x in out.collect()}
    some = set()
    for (i, span), w in asked.items():
        if len(w) == 1:
            want = compare.score_obligation(w, [dict(zip(("event", *names), (x[0], *x[2:]))) for x in events if x[1] == span], supported, why[span])
            some.add(want["status"])
            assert got[i].status == want["status"] and all(tuple(got[i][f"{layer}_{x}"] for x in ("tp", "fp", "fn")) == want[layer] for layer in compare.LAYERS), (i, want, got[i])
    assert len(got) == 100 and len(some) >= 5
    assert "size(wanted" in plan_of(out)  # obligations are told apart before any row goes to Python


def test_combinations_of_frequent_tokens_lose_no_pair(spark, monkeypatch):
    """Short items meet on combinations that reach the least weight and not on each frequent token; wide ones still meet all."""
    r = random.Random(4)
    items = {i: {t: r.choice([.1, .15, .2]) for t in r.sample(range(12), r.randrange(2, 7) if i % 9 else 12)} for i in range(120)}
    sides, meet = [], compare._met_pairs
    monkeypatch.setattr(compare, "_met_pairs", lambda a, b, least: (sides.append((a, b)), meet(a, b, least))[1])
    df = spark.createDataFrame([(i, t, w) for i, x in items.items() for t, w in x.items()], "id int, token long, weight double")
    got = sorted((x.a, x.b) for x in compare.weighted_pairs(df, .42, widest=8).collect())
    met = lambda a, b: sum(w for t, w in items[a].items() if t in items[b]) >= .42
    assert got == [(a, b) for a in range(120) for b in range(a + 1, 120) if met(a, b) and met(b, a)] and len(sides) == 4
    keys = [set(x["keys"]) for x in sides[0][0].collect()]
    assert sum(len(x & y) > 0 for x in keys for y in keys) < len(keys) ** 2 / 2


def test_equal_items_are_compared_once(spark, monkeypatch):
    seen, find = [], compare.candidate_pairs
    monkeypatch.setattr(compare, "candidate_pairs", lambda f: (seen.append(f.count()), find(f))[1])
    row = lambda i, k: (i, [f"w{k % 2}", f"v{k % 3}"], [k % 4], [f"b{k % 3}"], [f"t{k % 5}"], [f"y{k % 2}"], [f"w{k % 2}", f"v{k % 3}"])
    schema = "id int, ops array<string>, channels array<int>, roles array<string>, targets array<string>, wording array<string>, terms array<string>"
    compared = lambda n, **how: {(x.a, x.b): tuple(x)[2:] for x in compare.compare_items(spark.createDataFrame([row(i, i * 7 % n % 20) for i in range(60)], schema), **how).collect()}
    kind = lambda i: i * 7 % 60 % 20
    got = compared(60, block=2)
    assert seen == [20] and all((a, b) in got for a in range(60) for b in range(a + 1, 60) if kind(a) == kind(b))
    apart = {(x.a, x.b): tuple(x)[2:] for x in compare.compare_items(spark.createDataFrame([row(k, k) for k in range(20)], schema)).collect()}
    want = {(a, b): apart[tuple(sorted((kind(a), kind(b))))] for a in range(60) for b in range(a + 1, 60) if kind(a) != kind(b) and tuple(sorted((kind(a), kind(b)))) in apart}
    assert {k: v for k, v in got.items() if kind(k[0]) != kind(k[1])} == want and want


def test_diagnostics_and_lifted_ones_shuffle_no_pairs(spark):
    """Diagnostics equal those of all pairs, each once, and neither they nor those that anchors lift pass through an exchange."""
    r = random.Random(6)
    some = lambda x, n, k: [r.choice([None, *(f"{x}{i}" for i in range(n))]) for _ in range(r.randrange(k))]
    row = lambda i: (i, r.choice(["s0", "s1", None]), r.choice([None, "p", "q"]), some("t", 6, 5), [r.choice([None, 1, 2, 3]) for _ in range(r.randrange(4))], ["d"] if r.random() < .3 else [])
    spans, claims = [row(i) for i in range(60)], [row(i) + (r.random() < .3, r.choice([None, "", "add", "cut"]), r.choice([True, False, None])) for i in range(60)]
    same = "system string, family string, terms array<string>, `values` array<int>, distinctive array<string>"
    s, c = spark.createDataFrame(spans, "span_id int, " + same), spark.createDataFrame(claims, "claim_id int, " + same + ", titled boolean, op string, strong boolean")
    d = banks.claim_diagnostics(s, c, ["t0", "t1"], ["add"])
    known = lambda x, y: {v for v in set(x) & set(y) if v is not None}
    want = sorted((x[0], y[0]) for x in spans for y in claims if x[1] and x[1] == y[1] and (known(x[3], y[3]) or (y[8] and known(x[4], y[4]))))
    got = d.collect()
    assert sorted((x.span_id, x.claim_id) for x in got) == want
    anchors = spark.createDataFrame([(i, j, (i + j) % 2 == 0) for i in range(60) for j in range(0, 60, 3)] + [(1, 3, False)], "span_id int, claim_id int, fits boolean")
    linked = {(x.span_id, x.claim_id): x for x in banks.anchor_linked(d, anchors).collect()}
    assert len(linked) == len(want)
    lifted = 0
    for x in got:
        y = linked[x.span_id, x.claim_id]
        if not x.compatible and x.claim_id % 3 == 0 and (x.span_id + x.claim_id) % 2 == 0:
            weak = x.strength == "weak"
            assert (y.compatible, y.strength, y.quality, y.warnings) == (True, "medium" if weak else x.strength, "plausible" if weak else "noisy", [w for w in x.warnings if w != "family_mismatch"])
            lifted += 1
        else:
            assert x == y
    assert lifted > 10
    for name in ("c9_claim_diagnostics", "c9_anchor_linked"):
        top = plan_of(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")).split("Join")[0]
        assert "Exchange" not in top and "/diagnostics-" not in plan_of(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_chains_fall_in_few_rounds_and_edges_of_one_direction_have_no_cycles(spark, monkeypatch):
    """A chain of 2000 below an inactive node settles in rounds that halve it, in a graph with joins, cycles and lost parents as by a plain walk."""
    wrote = []
    monkeypatch.setattr(graphs, "materialize", lambda df, name, real=graphs.materialize: wrote.append(name) or real(df, name))
    r = random.Random(2)
    edges = [(i, i - 1) for i in range(1, 2000)] + [(3000 + i, 3000 + r.randrange(i)) for i in range(1, 200) for _ in range(r.randrange(3))] + [(5001, 5000), (5000, 5001), (5002, 9999), (5003, 5002)]
    ids = [*range(2000), *range(3000, 3200), 5000, 5001, 5002, 5003]
    idle = {0, *(3000 + r.randrange(1, 200) for _ in range(4))}
    bad = idle | {5002}
    while more := {c for c, p in edges if p in bad and c not in bad}:
        bad |= more
    nodes = spark.createDataFrame([(i, i not in idle) for i in ids], "id int, active boolean")
    got = {x.id: x.status for x in graphs.propagate_inactive(nodes, spark.createDataFrame(edges, "child int, parent int")).collect()}
    assert got == {i: "inactive" if i in idle else "needs_revalidation" if i in bad else "active" for i in ids}
    assert wrote.count("fallen") < 14
    wrote.clear()
    assert graphs.on_cycles(spark.createDataFrame([(i, i - 1) for i in range(1, 2000)], "child int, parent int")).isEmpty() and wrote == ["edges"]


def test_legacy_comparison_meets_blocks_and_loses_no_pair(spark, monkeypatch):
    """Tiles of small blocks give the pairs of brute force, null and absent values among them, without a join on values."""
    monkeypatch.setattr(compare, "TILE", 12)
    r = random.Random(4)
    names = list(compare.FAMILIES)
    items = [(i, [r.choice("ab") for _ in range(2)], *[None if r.random() < .05 else [r.choice([None, "0", "1", "2", "3"]) for _ in range(r.randrange(4))] for _ in names]) for i in range(70)]
    df = spark.createDataFrame(items, "id int, ops array<string>, " + ", ".join(f"{c} array<string>" for c in names))
    want = {}
    for x in items:
        for y in items:
            if x[0] < y[0] and None not in x[2:] and None not in y[2:]:
                n = [len(set(p) & set(q) - {None}) for p, q in zip(x[2:], y[2:], strict=True)]
                s = (.14 if x[1] == y[1] else 0) + sum(min(most, k * one) for k, (one, most) in zip(n, compare.FAMILIES.values(), strict=True))
                if sum(k > 0 for k in n) >= 2 and round(s, 3) >= .3:
                    want[x[0], y[0]] = round(s, 3)
    full = df.where(" AND ".join(f"{c} IS NOT NULL AND NOT array_contains(coalesce(transform({c}, v -> v IS NULL), array()), true)" for c in names))
    ids = {x.id for x in full.collect()}
    out = compare.compare_items_legacy(full)
    got = {(x.a, x.b): round(x.score, 3) for x in out.collect()}
    assert got == {k: v for k, v in want.items() if set(k) <= ids} and len(got) > 3
    assert "FlatMapGroupsInPandas" in plan_of(out)
