"""Hard negatives, URL filters and the divergence audit against brute force, with their odd cases."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stemma.llm import divergence, hard_negatives, url_filter

R = random.Random(11)

# --- divergence --------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def audit(rows, min_docs, top):
    """Rows are (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [[t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)] for text, _, _ in rows]
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), {(lang, s) for _, lang, s in rows}
    for (_, lang, s), found in zip(rows, terms):
        docs[lang].update(set(found))
        count[lang, s].update(found)
    out = set()
    for lang, s in groups:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        sources = sorted(x for g, x in groups if g == lang)
        n = {x: sum(c for t, c in count[lang, x].items() if t in kept) for x in sources}

        def share(c, total):
            return 1 + 1_000_000_000 * (c + 2) // (total + 2 * len(kept))

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        pairs = [(sum(f(share(count[lang, s][t], n[s]), share(count[lang, o][t], n[o])) for t in kept), o) for o in sources if o != s]
        total = {t: sum(count[lang, x][t] for x in sources) for t in kept}
        over = [(f(p, q), t) for t in kept if count[lang, s][t] and (p := share(count[lang, s][t], n[s])) > (q := share(total[t], sum(n.values())))]
        for part, ranked in (("pair", sorted(pairs, key=lambda x: (-x[0], x[1].encode()))), ("term", sorted(over, key=lambda x: (-x[0], x[1].encode()))[:top])):
            out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)}
    return out


def corpus():
    words = ["dog", "dog.", "(dog)", "Cat", "cat,", "ÄRGER", "ärger", "日本", "x1y", "a-b", "rare", "rare!", "rare?", "z" * 90, "q," * 60, "7", "--"]
    rows = [(" ".join(R.choices(words, k=R.randint(0, 12))), R.choice(["en", "de"]), f"s{R.choice([0, 0, 0, 1, 2, 3, 4])}") for _ in range(120)]
    rows += [(None, "en", "none"), ("", None, None), (" \n", "xx", "lonely"), ("dog", None, None), ("dog dog", "en", None)] + [("dog rare.", "en", "s1")] * 3
    return rows


@pytest.mark.parametrize("min_docs,tile", [(3, 256), (10, 2), (40, 3), (1000, 256)])
def test_audit(spark, monkeypatch, min_docs, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK", 3)
    rows = corpus()
    docs = spark.createDataFrame([(i % 50, t, lang, s, 0) for i, (t, lang, s) in enumerate(rows)], DOCS).repartition(3).withColumn("chunk", F.lit("mine"))
    got = [tuple(r) for r in divergence.divergence_audit(docs, min_docs, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == audit(rows, min_docs, 3)


def test_documents_are_told_apart_only_where_bounds_leave_them_open(spark):
    """Ten documents hold a term in two chunks each, so chunks alone would count twenty or ten."""
    rows = [(f"term. term, w{i}", "en", "a") for i in range(5)] + [("term! term", "en", "b")] * 5 + [("nine. nine", "en", "b")] * 9 + [("nine,", "de", "b")] * 5
    docs = spark.createDataFrame([(0, *r, 0) for r in rows], DOCS).repartition(4)
    counts = divergence.chunk_counts(docs)
    kept = divergence.kept_terms(counts, divergence.chunk_terms(counts))
    assert [tuple(r) for r in kept.collect()] == [("en", "term", 0)]


def test_shares_stay_exact_beyond_64_bits():
    import numpy as np

    n, m = np.array([9_000_000_000_000 - 2, 5]), np.array([9_000_000_000_000, 7])
    assert divergence._share(n, m).tolist() == [1 + 10**9, 1 + 10**9]
    n = np.array([10**12 + 7])
    assert divergence._share(n, np.array([7 * 10**12])).tolist() == [1 + 10**9 * (10**12 + 9) // (7 * 10**12)]


def test_audit_of_nothing(spark):
    assert divergence.divergence_audit(spark.createDataFrame([], DOCS)).count() == 0


# --- hard negatives ------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, row string"


def mined(rows, anchor):
    """Rows are (id, vector, label); the row's place breaks the last ties."""
    rows = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]

    def order(s):
        return (-s[0], s[1] is None, s[1] or 0, s[2])

    out = []
    for n, (i, v, c) in enumerate(rows):
        if not anchor(i):
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), j, m, d == c) for m, (j, w, d) in enumerate(rows) if m != n]
        for s, j, m, _ in sorted((x for x in scores if x[3]), key=order)[:5]:
            fits = sorted((x for x in scores if not x[3] and 30 * s <= 100 * x[0] <= 90 * s), key=order)[:10]
            out += [(i, j, k, x[1], s, x[0]) for k, x in enumerate(fits, 1)]
    return Counter(out)


def vectors(n, dim, labels=4, spread=0.3):
    centres = [[R.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    out = []
    for i in range(n):
        c = R.randrange(labels)
        near = R.randrange(labels)
        out.append((i, [round(0.6 * a + 0.5 * b + R.gauss(0, spread), 3) for a, b in zip(centres[c], centres[near])], c))
    return out


ODD_VECTORS = [
    (None, [1.0, 0.5, 0.2], 1), (30, None, 1), (60, [1.0, None], 1), (90, [float("nan"), 1.0], 1), (120, [float("inf")], 1), (150, [1.0, 1.0], None), (180, [], 1), (210, [0.0] * 20, 2),
    (240, [0.7] * 40, 0), (240, [0.7] * 40, 0), (240, [0.7] * 40, 1), (270, [-1.0] * 20, 3),
]


@pytest.mark.parametrize("rows", [vectors(400, 20), vectors(200, 64, 3) + ODD_VECTORS, [(i, [1.0, 0.5 if i % 3 else 0.1], i % 2) for i in range(200)], ODD_VECTORS], ids=["plain", "odd", "ties", "few"])
@pytest.mark.parametrize("block", [16384, 4])
def test_hard_negatives(spark, monkeypatch, rows, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    df = spark.createDataFrame([(i, v, c, "mine") for i, v, c in rows], VECTORS)
    rows = [(i, None if v is None else [None if x is None else float(__import__("numpy").float32(x)) for x in v], c) for i, v, c in rows]
    got = Counter(tuple(r) for r in hard_negatives.hard_negatives(df.repartition(3), F.col("vec_id") % 30 == 0).collect())
    assert got == mined(rows, lambda i: i is not None and i % 30 == 0)


def test_bounds_hold(spark):
    import numpy as np

    g = np.random.default_rng(5)
    x = np.floor(256 * g.normal(size=(80, 48)) + g.normal(size=(80, 1)) * 300)
    parts = x.reshape(80, 16, 3)
    b = hard_negatives._Bounds(parts.mean(2), parts.std(2), 48)
    scores, widths = x @ x.T, []
    for m, d in b.levels:
        middle, spread = m @ m.T, d @ d.T
        assert (scores <= middle + spread + 1e-3).all() and (scores >= middle - spread - 1e-3).all()
        widths.append(spread.mean())
    assert widths[0] >= widths[1] >= widths[2]


def test_no_vectors(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(df, F.col("vec_id") % 30 == 0).count() == 0


def test_scores_that_doubles_cannot_hold_are_refused(spark):
    df = spark.createDataFrame([(0, [1e15, 1e15], 1, ""), (1, [1e15, 1e15], 1, "")], VECTORS)
    with pytest.raises(Exception, match="2\\^53"):
        hard_negatives.hard_negatives(df, F.col("vec_id") == 0).collect()


# --- URL filters ---------------------------------------------------------------


def judged(urls, order=url_filter.ORDER):
    """Brute force of the rules and models, url by url."""
    import hashlib

    rows = []
    for u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        text = host + path
        rows.append((host, path, *(max(fits)[2:] if fits else (None, None)), text, int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 5 == 0))

    def grams(text):
        padded = "\x01" * order + text + "\x02"
        return [padded[i : i + order + 1] for i in range(len(text) + 1)]

    counts, contexts = {"allow": Counter(), "block": Counter()}, {"allow": Counter(), "block": Counter()}
    for _, _, _, verdict, text, held in rows:
        if verdict and not held:
            for g in grams(text):
                for k in range(order + 1):
                    counts[verdict][g[order - k :]] += 1
                    contexts[verdict][g[order - k : order]] += 1

    def p(kind, g):
        out = 1 / url_filter.ALPHABET
        for k in range(order + 1):
            seen = contexts[kind][g[order - k : order]]
            if seen >= url_filter.MIN_SEEN:
                out = (counts[kind][g[order - k :]] + url_filter.WEIGHT * out) / (seen + url_filter.WEIGHT)
        return out

    def bin_of(text):
        g = grams(text)
        return math.floor(sum(round(1e6 * math.log(p("allow", x) / p("block", x))) for x in g) / (url_filter.BIN * len(g)))

    held = [(bin_of(r[4]), r[3]) for r in rows if r[3] and r[5]]
    a, b = sum(v == "allow" for _, v in held), sum(v == "block" for _, v in held)
    limit = 0
    if a and b:
        bins = sorted({x for x, _ in held})
        limit = max(bins, key=lambda t: (sum(x < t and v == "block" for x, v in held) * a - sum(x < t and v == "allow" for x, v in held) * b, -t))
        limit = math.ceil((limit + max((x for x in bins if x < limit), default=limit)) / 2)
    return [(h, q, rule, verdict or ("allow" if bin_of(text) >= limit else "block")) for h, q, rule, verdict, text, _ in rows]


def some_urls(n):
    """Good hosts have letters a to e, bad ones v to z; .org has no rule."""
    out = []
    for i in range(n):
        good = R.random() < 0.6
        host = "".join(R.choices("abcde" if good else "vwxyz", k=6))
        out.append(f"https://{R.choice(['www.', 'm.', ''])}{host}.{R.choice(['com', 'org']) if good else R.choice(['net', 'org'])}/{'en' if good else R.choice(['es', 'fr'])}/{i}{R.choice(['', '?a=1', '#x'])}")
    return out


ODD_URLS = [
    None, "", "no scheme/en/", "http://", "http://COM/", "http://Example.COM/en/x", "http://www.example.com/en/x", "http://a.www.example.com/en/x", "http://www.example.com/EN/x", "http://notexample.com/en/",
    "http://xcom/", "http://a.com", "http://a.com?x=/", "http://a.net/es", "http://a.net/es/", "ftp://x.net/fr/#y", "a://b://c.com/", "http://ü😀.org/\n日", "x" * 30 + "://long.org/" + "y" * 3000, "http://a.org/é", "http://a.org/é",
]


@pytest.mark.parametrize("urls", [some_urls(150) + ODD_URLS, ODD_URLS, [None, "x://a.com/"], ["http://a.org/x"]], ids=["many", "odd", "one kind", "none ruled"])
def test_urls(spark, urls):
    pages = spark.createDataFrame([(i if i % 7 else None, u, "html", "mine") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string").repartition(3)
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect())
    assert got == Counter((i if i % 7 else None, *r) for i, r in enumerate(judged(urls)))


def test_urls_without_a_rule_are_told_apart(spark):
    urls = some_urls(1500)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r for r in url_filter.judge_urls(pages).collect() if r.rule is None]
    right = sum((r.verdict == "allow") == ("/en/" in r.path) for r in got)
    assert len(got) > 300 and right >= 0.98 * len(got)


def test_no_urls(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
