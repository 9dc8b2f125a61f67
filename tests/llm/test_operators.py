"""Each operator against brute force, and the defined odd cases: nulls, empty and long texts,
ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import chat, common, decontaminate, jaccard_join, line_templates, mixing, paragraphs, parsing, quality, token_store, warc

R = random.Random(7)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 9))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(VOCABULARY)
    return " ".join(w)


BASE = prose(120, 1)
LONG = "\n".join(prose(60, 1000 + i) for i in range(60))
ODD = [
    (None, "a text without an id " + prose(60, 5), "s1"), (1, None, "s1"), (2, "", None), (3, " \n\t ", "s2"), (4, BASE, "s1"), (4, BASE, "s1"),
    (5, BASE, None), (6, edited(BASE, 1, 2), "s2"), (7, LONG, "s2"), (8, LONG + "\nend", "s2"), (9, "one", "s1"), (10, "ONE", "s1"), (11, "\x00 nul  and  spaces", "s1"),
]
OPERATORS = {
    "paragraphs": lambda d: paragraphs.dedup_paragraphs(d), "classes": lambda d: jaccard_join.jaccard_classes(d), "keep_one": lambda d: jaccard_join.keep_one(d),
    "verdicts": lambda d: quality.quality_verdicts(d), "filter": lambda d: quality.quality_filter(d), "plan": lambda d: mixing.mixing_plan(d), "mix": lambda d: mixing.mix_sources(d),
    "strings": lambda d: parsing.repeated_strings(d, digest=True), "tokens": lambda d: token_store.read_tokens(token_store.write_tokens(d)), "lines": lambda d: line_templates.drop_template_lines(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(make, name):
    rows = OPERATORS[name](make(ODD)).collect()
    per_row = {"paragraphs", "classes", "verdicts", "plan", "strings", "tokens", "lines"}
    assert len(rows) == len(ODD) if name in per_row else 0 < len(rows) <= 2 * len(ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(make, name):
    assert OPERATORS[name](make([])).count() == 0


@pytest.mark.parametrize("name", ["paragraphs", "keep_one", "filter", "mix", "lines"])
def test_clashing_columns_pass_through(make, name):
    extra = {c: F.lit("mine") for c in ("node", "line", "key", "size_", "hash", "cluster", "number", "n", "removed_", "host")}
    out = OPERATORS[name](make(ODD).withColumns(extra))
    assert all(r["node"] == r["line"] == r["key"] == r["cluster"] == "mine" for r in out.collect())
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def family():
    rows = [(i, prose(R.randint(3, 150), i), "s") for i in range(40)]
    rows += [(100 + i, edited(BASE, i % 7, i), "s") for i in range(60)] + [(200 + i, rows[i][1].upper(), "s") for i in range(10)]
    return rows


def shingles(text, k):
    w = common.words(text, True)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes_of(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("leaf", [128, 5])
def test_jaccard_classes_equal_brute_force(make, family, leaf, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_MEMBERS", 300_000 if leaf > 5 else 0)
    s = {i: shingles(t, 3) for i, t, _ in family}
    links = [(a, b) for a, b in itertools.combinations(sorted(s), 2) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 90 * len(s[a] | s[b])]
    want = classes_of(s, links)
    n = {i: sum(i in p for p in links) for i in s}
    got = jaccard_join.jaccard_classes(make(family)).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.n_links) for r in got} == {i: (want[i], len(s[i]), n[i]) for i in s}


def test_group_keys_lose_no_pair():
    levels = jaccard_join.Levels(90)
    r = np.random.default_rng(3)
    for n in (10, 17, 40, 200, 1500):
        for _ in range(20):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            d = int(levels.groups[levels.of(np.array([n]))[0]] - 1 - levels.spare[levels.of(np.array([n]))[0]])
            cut = r.integers(0, d + 1)
            b = np.unique(np.concatenate([a[cut // 2 :], r.integers(0, 1 << 63, cut - cut // 2, dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 90 * (len(a) + len(b) - shared):
                ka, kb = jaccard_join.group_keys([a, b], levels)
                assert len(np.intersect1d(ka, kb)) > 0


def test_compare_leaves_finds_every_link():
    levels = jaccard_join.Levels(80)
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: r.integers(40, 60)], r.integers(0, 1 << 63, r.integers(0, 12), dtype=np.uint64)])) for _ in range(30)]
    n = np.array([len(x) for x in sets])
    leaf = (np.arange(30), np.ones(30, int), n, np.array([jaccard_join.point_of(x) for x in sets]), np.concatenate(sets), np.cumsum(n) - n)
    i, j = jaccard_join.compare_leaves(leaf, leaf, True, levels)
    want = {(a, b) for a in range(30) for b in range(a + 1, 30) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want


def test_paragraphs_equal_brute_force(make):
    rows = []
    for i in range(30):
        lines = [prose(30, 500 + i), edited(prose(60, 9), i % 4, i), "short line", prose(40, 77)]
        rows.append((i, "\n".join(lines[: 2 + i % 3]), "s"))
    para = [(i, n, shingles(" ".join(x.decode() for x in w), 5)) for i, t, _ in rows for n, w in paragraphs.paragraph_words(t, paragraphs.MIN_WORDS)]
    links = [(a, b) for a, b in itertools.combinations(range(len(para)), 2) if 100 * len(para[a][2] & para[b][2]) >= 80 * len(para[a][2] | para[b][2])]
    root = classes_of(range(len(para)), links)
    want = {(para[x][0], para[x][1]) for x in root if root[x] != x}
    got = {(r.doc_id, r.number) for r in paragraphs.paragraph_removals(make(rows)).collect()}
    assert got == want and want
    kept = {r.doc_id: r.text for r in paragraphs.dedup_paragraphs(make(rows)).collect()}
    assert all(kept[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want) for i, t, _ in rows)


def test_bands_reach_the_recall():
    b = paragraphs.bands_for(80, 3, 0.998)
    assert 1 - (1 - 0.8**3) ** b >= 0.998 > 1 - (1 - 0.8**3) ** (b - 1)


def test_quality_counts_and_depletion(make):
    common_line = "the menu line of this very host is here"
    rows = [(i, common_line + "\n" + prose(60, i), "h") for i in range(40)] + [(100 + i, "\n".join([common_line] * 9) + "\n" + prose(8, 300 + i), "h") for i in range(5)] + [(200, prose(70, 900), "other")]
    got = {r.doc_id: r for r in quality.quality_verdicts(make(rows)).collect()}
    assert all(got[i].kept and got[i].n_removed_words == 9 for i in range(40)) and got[200].kept
    assert not any(got[100 + i].kept for i in range(5)) and got[100].n_dup_lines == 8
    n, chars, symbols, dup, repeat, *_ = quality.text_facts("a b c a b c ## é\n\nx\nx\n x")
    assert (n, chars, symbols, dup, repeat) == (11, 12, 2, 1, 6)


def test_mixture_meets_targets(make):
    rows = [(i, prose(20, i), "abc"[i % 3] if i % 2 else "a") for i in range(3000)]
    plan = mixing.mixing_plan(make(rows)).collect()
    by = {}
    for r in plan:
        assert r.copies in (int(r.rate), int(r.rate) + 1) and r.copies * r.size <= 2 * r.size
        s = by.setdefault(r.source, [0, r.target, 0])
        s[0] += r.copies * r.size
        s[2] += r.size
    assert all(abs(taken - target) < 0.05 * target and target <= 2 * size for taken, target, size in by.values())
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * sum(s for *_, s in by.values()))
    again = {r.doc_id: r.copies for r in mixing.mixing_plan(make(rows)).collect()}
    assert again == {r.doc_id: r.copies for r in plan}
    assert mixing.mix_sources(make(rows)).count() == sum(again.values())


def test_mixture_by_salts_is_the_same(make, monkeypatch):
    rows = [(i, prose(20, i), "abc"[i % 3]) for i in range(300)]
    plain = {r.doc_id: r.copies for r in mixing.mixing_plan(make(rows)).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert plain == {r.doc_id: r.copies for r in mixing.mixing_plan(make(rows)).collect()}


def cut_strings(docs):
    """Brute force of the contract: {doc: (bytes, removed, spans, digest)}."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = t.encode()
        cover = np.zeros(len(b), bool)
        for j in range(len(b) - parsing.WINDOW + 1):
            w = b[j : j + parsing.WINDOW]
            if w in seen:
                cover[j : j + parsing.WINDOW] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        spans = int((np.diff(np.concatenate([[0], cover.astype(int), [0]])) == 1).sum())
        out[i] = (len(b), int(cover.sum()), spans, hashlib.sha256(kept).digest())
    return out


@pytest.mark.parametrize("hot", [200_000, 1])
def test_repeated_strings_equal_brute_force(make, hot):
    shared = prose(40, 3)
    rows = [(i, prose(R.randint(0, 40), 50 + i) + shared[: 90 + i] + prose(20, 90 + i)) for i in range(20)]
    rows += [(30, "x" * 700), (31, "ab" * 300 + "é" * 200), (32, "x" * 99), (33, ""), (34, shared), (35, shared), (36, "Is onhe. " * 60)]
    got = parsing.repeated_strings(make([(i, t, "s") for i, t in rows]), digest=True, hot_phrases=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.starts), bytes(r.kept)) for r in got} == cut_strings(rows)


def test_long_texts_in_pieces(make, monkeypatch):
    monkeypatch.setattr(parsing, "PIECE", 500)
    t = prose(400, 8)
    rows = [(1, t), (2, t[100:1800] + prose(50, 4) + t[300:900])]
    want = cut_strings(rows)
    pieces = [(i, at, p) for group in parsing.pieces([t.encode()]) for i, at, p in group]
    assert {at + j for _, at, p in pieces for j in range(len(p) - 99)} == set(range(len(t) - 99))
    got = parsing.repeated_strings(make([(i, x, "s") for i, x in rows]), digest=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.starts), bytes(r.kept)) for r in got} == want


def test_texts_of_one_id_are_told_apart(make):
    got = parsing.repeated_strings(make([(1, BASE, "s"), (1, prose(90, 44), "s"), (2, BASE, "s")]), digest=True).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, len(BASE)]


def test_tokens_round_trip(make, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.default_tokenizer())
    texts = [BASE, "a  b", " x", "\n\n y \t z", "<|endoftext|> end", "", None, "é ü" * 50, LONG, "\x00a b"]
    files = token_store.write_tokens(make([(i, x, "s") for i, x in enumerate(texts)]))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_tokens(files).collect()}
    start, want, ids = 0, {}, {}
    for i, x in enumerate(texts):
        ids[i] = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] = (start, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        start += len(ids[i])
    assert got == want
    f = token_store.TokenFile(files.first().path)
    assert all(np.array_equal(f.ids(k), ids[int(row["doc_id"])]) for k, row in enumerate(f.index)) and len(f.dictionary_hash) == 64


def test_kept_chunks_are_trimmed():
    e = token_store.ChunkEncoder(token_store.default_tokenizer(), limit=70)
    texts = [prose(80, i) for i in range(6)]
    for x in texts:
        assert e.encode([x])[0].tolist() == [*e.tokenizer.encode(x, add_special_tokens=False).ids, 0]
    assert len(e.at) < 400


def page_rows():
    big = "<p>" + prose(300, 2) + "</p>"
    return [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u\nx", None), (None, "n", big), (7, "u", prose(400, 3)), (3, "again", big)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x") for r in page_rows()], "page_id long, url string, html string, payload string").repartition(2)
    index = warc.archive_pages(pages)
    got = warc.read_warc(index).collect()
    by = sorted((r.page_id or -1, r.record_type, r.refers_to or -1, r.payload_bytes) for r in got)
    n = len(page_rows()[0][2])
    assert by == sorted([(1, "revisit", 3, n), (2, "revisit", 3, n), (3, "response", -1, n), (3, "response", -1, n), (-1, "revisit", 3, n), (4, "response", -1, 5), (5, "response", -1, 5), (6, "response", -1, 0), (7, "response", -1, len(prose(400, 3)))])
    texts = {i: (h or "") for i, _, h in page_rows()}
    for r in got:
        full = texts[r.page_id].encode()
        assert r.payload_digest == hashlib.sha1(full).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == full
    assert {(r.path, r.offset) for r in got} == {(r.path, r.offset) for r in index.collect()}
    assert warc.read_warc(warc.archive_pages(pages.limit(0))).count() == 0


def test_warc_begins_with_its_dictionary(tmp_path):
    import io

    import zstandard

    out = io.BytesIO()
    a = warc.Archive(out)
    records = [warc.encode_record(i, "u", prose(200, i).encode(), "00" * 20, "response", None, 5) for i in range(300)]
    rows = [x for i, r in enumerate(records) for x in a.add(i, r)] + a.close()
    out.seek(0)
    assert out.getvalue()[:4] == (0x184D2A5D).to_bytes(4, "little") and len(rows) == 300
    assert [f["payload"].decode() for _, f in warc.read_archive(out)] == [prose(200, i) for i in range(300)]
    size = int.from_bytes(out.getvalue()[4:8], "little")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(out.getvalue()[8 : 8 + size]))
    at, n, i = rows[123]
    assert d.decompress(out.getvalue()[at : at + n], max_output_size=1 << 20) == records[i]


def test_leaks_equal_brute_force(make, spark):
    items = [(i, prose(R.randint(14, 50), 4000 + i)) for i in range(25)] + [(90, None), (91, " "), (92, prose(20, 4001)), (93, "two words"), (94, prose(900, 6))]
    rows = [(i, prose(80, 7000 + i), "s") for i in range(30)]
    for i in range(25):
        part = edited(items[i][1], max(0, len(items[i][1].split()) // 12 * (i % 3)), i)
        rows.append((100 + i, prose(30, i) + " " + part.upper() + "\n" + prose(25, 60 + i), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, items[-1][1], "s"), (502, items[-1][1], "s"), (503, "two words", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(make(rows), bench).collect()}
    fold = lambda t: b" ".join(common.words(t, True)).decode()
    parts = decontaminate.item_parts(items)
    want = {(d, i) for d, t, _ in rows for i, x in parts if t and 100 * decontaminate.best_edit_distance(x, fold(t))[0] <= 20 * len(x)}
    assert got <= want and len(got) >= 0.97 * len(want) and {(100 + i, i) for i in range(0, 25, 3)} <= got
    left = {r.doc_id for r in decontaminate.decontaminate(make(rows), bench).collect()}
    assert left == {d for d, _, _ in rows} - {d for d, _ in got}
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(make(rows), bench, block=7).collect()}
    assert blocks == got
    assert decontaminate.find_leaks(make(rows), bench.limit(0)).count() == 0 and decontaminate.find_leaks(make([]), bench).count() == 0


def test_edit_distance_of_parts():
    assert decontaminate.best_edit_distance("abc", "xxabcxx") == (0, 5)
    assert decontaminate.best_edit_distance("abcd", "xxabxcdxx")[0] == 1
    assert decontaminate.best_edit_distance("abc", "")[0] == 3


def test_line_templates(make):
    rows = [(i, f"Page {i} of 90 in total\n" + prose(12, i) + f"\nposted by user{'abcdefghijklmnop'[i % 16]}x at noon today", "s") for i in range(30)] + [(99, "Page 1 of 2\nhello there you", "s"), (100, None, "s")]
    got = {r.doc_id: r.text for r in line_templates.drop_template_lines(make(rows)).collect()}
    assert got[99] == "Page 1 of 2\nhello there you" and got[100] is None
    assert all(got[i] == prose(12, i) for i in range(30))
    t = {r.template for r in line_templates.dropped_lines(make(rows)).collect()}
    assert "Page <*> of <*> in total" in t and "posted by <*> at noon today" in t


CHAT = "conv_id long, turn long, role string, text string, position string"
TURNS = [
    (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "Fine.\nAnd what now?"), (1, 2, "user", "I am not sure yet"),
    (1, 3, "assistant", "User wrote:\n> Hello  there\n> how are you?\nAs I said."), (1, 4, "user", ">> Hello there\n> As I said.\nYes"), (1, 4, "user", ">> Hello there\n> As I said.\nYes"),
    (2, 0, "user", "> And what now?\nFrom elsewhere"), (2, 1, None, None), (None, None, "user", "loose"), (3, 0, "user", "> never written\nnew"),
]


def test_quotations_link_and_go(spark):
    df = spark.createDataFrame([(*r, "clash") for r in TURNS], CHAT).repartition(3)
    got = {(r.conv_id, r.position): r for r in chat.link_replies(df).collect()}
    assert len(got) == len(TURNS) - 1
    r = got[1, 3]
    assert (r.content, r.reply_to, r.n_quoted, r.n_linked, r.depth) == ("As I said.", 0, 2, 2, 1)
    r = got[1, 4]
    assert (r.content, r.reply_to, r.n_linked, r.depth) == ("Yes", 3, 2, 2)
    assert (got[1, 1].reply_to, got[1, 2].reply_to, got[1, 2].depth) == (0, 1, 2)
    r = got[2, 0]
    assert (r.content, r.reply_to, r.quotes_conv, r.quotes_position) == ("From elsewhere", None, "1", 1)
    assert got[3, 0].n_linked == 0 and got[3, 0].content == "new" and got[None, 0].content == "loose" and got[2, 1].content == ""
    assert all(x.reply_to is None or x.reply_to < x.position for x in got.values())
    shown = {(x.conv_id, x.position): x.formatted for x in chat.chat_format(chat.link_replies(df)).collect()}
    assert shown[1, 3] == "<|assistant|>\nAs I said.\n<|end|>\n"
    assert chat.link_replies(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == classes_of({x for e in real for x in e}, real)


def letters_changed(text, share, seed):
    r, t = random.Random(seed), list(text)
    for i in r.sample([i for i, c in enumerate(t) if c != " "], int(share * len(t))):
        t[i] = r.choice([c for c in "abcdefghij" if c != t[i]])
    return "".join(t)


@pytest.mark.parametrize("share", [0.05, 0.1, 0.2])
def test_leaks_with_letter_edits_are_found(make, spark, share):
    items = [(i, prose(40, 6000 + i)) for i in range(100)]
    rows = [(i, prose(60, 100 + i) + " " + letters_changed(t, share, i) + " " + prose(60, 300 + i), "s") for i, t in items]
    rows += [(200 + i, prose(200, 9000 + i), "s") for i in range(20)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= {(i, i) for i in range(100)} and len(got) >= 98


def test_letter_edits_in_every_fifth_letter_leave_a_window():
    for i in range(20):
        t = prose(40, 6500 + i)
        e = len(t) * 20 // 100
        changed = "".join("z" if j % 5 == 4 and j // 5 < e else c for j, c in enumerate(t))
        host = prose(50, i) + " " + changed + " " + prose(50, 90 + i)
        at = host.index(changed)
        found = list(decontaminate.find_windows([prose(30, 2), host], decontaminate.ItemIndex([t])))
        assert any(d == 1 and begin <= at and end >= at + len(changed) for d, _, _, begin, end, _ in found)


def test_walks_read_windows_to_their_end():
    head = [prose(40, 6800 + i)[:230] for i in range(50)]
    changed = np.array([(decontaminate.sample_keys([t[:180] + "z" * 50], 230) != decontaminate.sample_keys([t], 230)).mean() for t in head])
    assert changed.mean() > 0.1 and (changed > 0).all()


def test_long_items_are_verified_whole(make, spark):
    item = prose(400, 6) + " the"
    whole = edited(item, 30, 1)
    rows = [(1, "the " + prose(60, 1), "s"), (2, prose(30, 2) + " " + whole + " " + prose(30, 3), "s"), (3, " ".join(item.split()[:200]) + " " + prose(300, 4), "s")]
    got = decontaminate.find_leaks(make(rows), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.length, r.n_words) for r in got} == {(2, 5, len(item), 401)}
    assert {r.distance for r in got} == {decontaminate.best_edit_distance(item, rows[1][1])[0]}


def test_lines_over_the_limit_are_cut(make):
    menu = "the  Menu line of this very host is here"
    rows = [(i, prose(40, i) + "\n" + (menu.upper() if i % 2 else menu) + "\n\n" + prose(40, 500 + i), "h") for i in range(40)] + [(100, menu + "\n" + prose(70, 900), "other")]
    got = {r.doc_id: r for r in quality.quality_filter(make(rows)).collect()}
    assert all(got[i].text == prose(40, i) + "\n\n" + prose(40, 500 + i) and got[i].n_chars == len(got[i].text) for i in range(40))
    assert got[100].text == rows[-1][1] and len(got) == len(rows)


def test_unlinked_texts_of_one_id_both_stay(make):
    one, two = prose(60, 71), prose(60, 72)
    kept = jaccard_join.keep_one(make([(1, one, "s"), (1, two, "s"), (2, two, "s")])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, one), (1, two)])


def letters_edited(text, share, kind, seed):
    r, t = random.Random(seed), list(text)
    for i in sorted(r.sample(range(len(t)), int(share * len(t))), reverse=True):
        do = r.choice(["put", "drop", "change"]) if kind == "mixed" else kind
        if do == "put":
            t.insert(i, r.choice("abcdefghij"))
        else:
            t[i] = r.choice("abcdefghij") if do == "change" else ""
    return "".join(t)


@pytest.mark.parametrize("kind", ["put", "drop", "mixed"])
@pytest.mark.parametrize("share", [0.08, 0.14, 0.19])
def test_leaks_with_letters_put_in_and_left_out_are_found(make, spark, share, kind):
    items = [(i, prose(R.randint(20, 60), 16000 + i)) for i in range(100)]
    rows = [(i, prose(60, 100 + i) + " " + letters_edited(t, share, kind, i) + " " + prose(60, 300 + i), "s") for i, t in items]
    rows += [(200 + i, prose(200, 9000 + i), "s") for i in range(20)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= {(i, i) for i in range(100)} and len(got) >= 95


def test_leaks_odd_rows(make, spark):
    item = prose(40, 31)
    bench = spark.createDataFrame([(1, item, "x"), (2, item, "x"), (None, item, "x"), (3, "abc", "x"), (4, "w" * 9000, "x")], "item_id long, text string, part string")
    rows = [(None, item, "s"), (1, prose(30, 4) + " " + item.upper(), "s"), (1, prose(30, 5), "s"), (2, "abc def", "s"), (3, "xabcx", "s"), (4, prose(9, 1) + " " + "w" * 9000, "s"), (5, "\n".join(prose(300, 50 + i) for i in range(800)) + "\n" + item, "s")]
    docs = make(rows).withColumns({c: F.lit("mine") for c in ("part", "item", "key", "start", "item_id", "text_key")})
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(d, i) for d in (None, 1, 5) for i in (1, 2, None)} | {(2, 3), (4, 4)}
    left = decontaminate.decontaminate(docs, bench)
    assert sorted(r.text for r in left.collect()) == sorted([prose(30, 5), "xabcx"]) and left.columns == docs.columns and left.first()["part"] == "mine"


def test_long_texts_are_searched_in_pieces():
    item = prose(40, 31)
    index = decontaminate.ItemIndex([item])
    index.step = 3000
    text = " ".join(prose(90, i) + " " + item for i in range(30))
    at = {b for i in range(30) for b in [text.index(item, sum(len(prose(90, j)) + len(item) + 2 for j in range(i)))]}
    found = list(decontaminate.find_windows([text], index))
    assert {start for *_, start in found} == at


def test_ids_of_white_space_equal_the_library():
    e = token_store.ChunkEncoder(token_store.default_tokenizer())
    r = random.Random(11)
    signs = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000", "a", "\n", " ", " ", "é", ".", "ab", "1", "'s", "\u200b", "\ufeff"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 9))) for _ in range(100_000)]
    want = [x.ids for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    got = [x[:-1].tolist() for lo in range(0, len(texts), 20_000) for x in e.encode(texts[lo : lo + 20_000])]
    assert got == want


def test_warc_records_keep_the_rules(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").repartition(2)
    seen = {}
    for path in {r.path for r in warc.archive_pages(pages).collect()}:
        fs, p = common.filesystem(path)
        data = fs.open_input_stream(p).read()
        import struct

        import zstandard

        magic, size = struct.unpack("<II", data[:8])
        assert 0x184D2A50 <= magic <= 0x184D2A5F
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        at = 8 + size
        while at < len(data):
            o = d.decompressobj()
            raw = o.decompress(data[at:])
            at = len(data) - len(o.unused_data)
            head, _, rest = raw.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            fields = [x.split(": ", 1) for x in lines]
            f = dict(fields)
            assert first == "WARC/1.1" and len(f) == len(fields) and rest[int(f["Content-Length"]) :] == b"\r\n\r\n"
            assert {"WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length"} <= set(f) and f["WARC-Record-ID"] not in seen
            assert (f["WARC-Type"] == "revisit") == ("WARC-Refers-To-Target-URI" in f) == ("WARC-Profile" in f)
            seen[f["WARC-Record-ID"]] = f
    assert len(seen) == len(page_rows())


def test_a_conversation_called_none_is_its_own(spark):
    df = spark.createDataFrame([("none", 0, "user", "first line"), (None, 1, "user", "> first line\nyes"), ("a", 2, "user", "> yes\nso")], "conv_id string, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.link_replies(df).collect()}
    assert len(got) == 3 and all(r.position == 0 and r.reply_to is None for r in got.values())
    assert got[None].quotes_conv == "none" and got["a"].quotes_conv is None and got["a"].quotes_position == 0


def test_texts_over_a_slice(make):
    long = "\n".join(prose(60, 40_000 + i) for i in range(5500))
    assert len(long) > 1_000_000
    rows = [(1, long, "s"), (2, long + "\nend of it", "s"), (3, prose(80, 3), "s")]
    got = {r.doc_id: r for r in jaccard_join.jaccard_classes(make(rows)).collect()}
    assert (got[1].component_id, got[2].component_id, got[3].component_id) == (1, 1, 3)
    kept = {r.doc_id: r.text for r in paragraphs.dedup_paragraphs(make(rows)).collect()}
    assert kept[1] == long and kept[2] == "end of it" and kept[3] == rows[2][1]
    assert {r.doc_id: r.n_words for r in quality.quality_verdicts(make(rows)).collect()} == {1: 330_000, 2: 330_003, 3: 80}


def test_passages_inside_longer_lines_are_found(make):
    shared = [prose(n, 70_000 + n) for n in (55, 70, 120)]
    rows = [(i, prose(60, 71_000 + i) + " " + shared[i % 3] + ("\n" if i % 2 else " ") + prose(45, 72_000 + i), "s") for i in range(30)]
    rows += [(100 + i, prose(150, 73_000 + i), "s") for i in range(30)]  # clean
    rows += [(200, "\n".join(" ".join(w) for w in np.array_split(shared[2].split(), 9)), "s"), (201, prose(200, 5).upper(), "s"), (202, prose(200, 5), "s"), (202, prose(200, 5), "s")]
    by = {r.doc_id: r for r in paragraphs.removals_by_document(make(rows)).collect()}
    assert set(by) == set(range(3, 30)) | {200, 202}
    cut = {r.doc_id: r.text for r in paragraphs.cut_repeats(make(rows)).collect()}
    assert cut[202] == "" and all(cut[i] == rows[i][1] for i in [0, 1, 2, *range(30, 60)] if i in cut)
    for i in range(3, 30):
        left = cut[i].split()
        assert left[:54] == rows[i][1].split()[:54] and left[-39:] == rows[i][1].split()[-39:]
        gone = len(rows[i][1].split()) - len(left)
        assert gone == by[i].removed_words and 20 <= gone <= len(shared[i % 3].split()) + 12


def test_passages_do_not_hang_on_neighbours():
    texts = [prose(300, 80), "in " * 90 + prose(50, 81), prose(7, 82), "", prose(500, 80)]
    w = [common.HASHES.of(common.words(t)) for t in texts]
    together = paragraphs.passage_starts(np.concatenate(w), np.array([len(x) for x in w]))
    at = np.cumsum([0, *(len(x) for x in w)])
    for i, x in enumerate(w):
        alone = paragraphs.passage_starts(x, np.array([len(x)]))
        assert together[(together >= at[i]) & (together < at[i + 1])].tolist() == (alone + at[i]).tolist()
        if len(x):
            assert alone[0] == 0 and np.diff(alone, append=len(x)).max() < 2 * paragraphs.STRIDE


def test_words_are_cut_with_the_space_after_them():
    assert paragraphs.cut_words("a  b\nc é d\n", [(1, 3)]) == "a  é d\n"
    assert paragraphs.cut_words("a b", [(0, 1), (1, 2)]) == ""


def test_rows_without_an_id_draw_by_their_texts(make):
    rows = [(None, prose(20, i), "a") for i in range(1500)] + [(i, prose(20, i), "b") for i in range(1500)]
    plan = mixing.mixing_plan(make(rows)).collect()
    for source in "ab":
        mine = [r for r in plan if r.source == source]
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) < 0.08 * mine[0].target


def test_words_of_many_texts_at_once():
    texts = [None, "", "  A b\n\nc\td ", BASE, "\n", "x" * 9000 + " é\u00a0é", "one", LONG]
    hashes, owner, line = paragraphs.word_table(texts)
    want = [(i, n, w) for i, t in enumerate(texts) for n, x in enumerate(paragraphs.line_words(t)) for w in x]
    assert list(zip(owner.tolist(), line.tolist(), strict=True)) == [(i, n) for i, n, _ in want]
    by = {}
    for (_, _, w), h in zip(want, hashes.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    assert [len(x) for x in paragraphs.word_table([None, ""])] == [0, 0, 0]
