"""Structure repair, spelling variants and url filters against brute-force versions, and their defined results for awkward rows."""

import hashlib
import itertools
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from loomspan.llm import oracles, repair, spelling, url_filter

BLANK = re.compile(r"[^\x20\x09-\x0D]")
TURNS = "conv_id long, turn long, role string, text string, n long, segment string, mark string"


def conversations(n=60, seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "Why?\n", "so it goes", "", " \t", None, f"text {turn}.", f"{conv} open", "é. \x0b"])
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), role, text))
    rows += [(None, k, r, f"{k}.") for k, r in enumerate(["user", "assistant", "assistant", "user"])]
    rows += rows[:5]
    return rows


def after_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv] += []
        role, text = role if role is not None else " ", text if text is not None else " "
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 1:
            text = ""
        elif h == 2:
            text = re.sub("[.!?]", "", text)
        elif h == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def marks_of(rows):
    out, seen = [], set()
    for _, role, text in rows:
        last = BLANK.findall(text)[-1:]
        out.append("b" if not last else "d" if (role, text) in seen else "" if last[0] in ".!?" else "t")
        seen.add((role, text))
    return out


def all_repairs(rows, marks):
    """Every way to edit with up to two insertions between rows, cheapest first, as (cost, audit, repaired)."""
    found = []

    def go(k, cost, audit, turns, inserted):
        if inserted < 2:
            for role in ("user", "assistant"):
                go(k, cost + 3, audit + "I", [*turns, f"{role}:"], inserted + 1)
        if k == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(t.partition(":")[0][:1] or "-" for t in turns)):
                found.append((cost, audit, "\n".join(turns)))
            return
        # a prefix that no ending can mend is left early
        if not re.fullmatch("(s?(ua)*u?)?", "".join(t.partition(":")[0][:1] or "-" for t in turns)):
            return
        _, role, text = rows[k]
        go(k + 1, cost + 4, audit + "D", turns, 0)
        if marks[k] not in ("b", "d"):
            extra = 3 if marks[k] == "t" else 0
            go(k + 1, cost + extra, audit + "K", [*turns, f"{role}:{text}"], 0)
            for new in ("user", "assistant"):
                go(k + 1, cost + 3 + extra, audit + "R", [*turns, f"{new}:{text}"], 0)

    go(0, 0, "", [], 0)
    return min(found)


def brute(rows):
    out = {}
    for conv, own in after_damage(rows).items():
        marks, turns = marks_of(own), [t for t, _, _ in own if t is not None]
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, text = all_repairs(own, marks)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", "x") for r in rows], TURNS).repartition(3)


@pytest.mark.parametrize("segment", [1024, 2])
def test_repair_against_all_edits(spark, segment):
    rows = [r for r in conversations() if r[1] is None or r[1] < 6]
    found = {r[0]: tuple(r[1:]) for r in repair.damaged_and_repaired(frame(spark, rows), segment).collect()}
    assert found == brute(rows)


def test_repair_of_a_long_conversation_in_segments(spark):
    rng = random.Random(2)
    rows = [(7, k // 2 if k % 5 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{k}.", " ", f"{k}"])) for k in range(900)]
    rows += [(8, 3, "user", "same.")] * 300
    whole = repair.damaged_and_repaired(frame(spark, rows), 2000).orderBy("conv_id").collect()
    assert whole == repair.damaged_and_repaired(frame(spark, rows), 64).orderBy("conv_id").collect()
    assert [r["conv_id"] for r in whole] == [7, 8]


def test_repaired_turns_are_legal(spark):
    rows = conversations(20)
    for segment in (1024, 3):
        turns = defaultdict(list)
        for r in repair.repaired_turns(frame(spark, rows), segment).orderBy("segment", "nth").collect():
            if r["edit"] != "D":
                turns[r["conv_id"]].append(r["role"][:1])
        assert turns
        assert all(re.fullmatch("(s?(ua)+)?", "".join(own)) for own in turns.values())


def test_repair_of_nothing(spark):
    assert repair.damaged_and_repaired(frame(spark, [])).collect() == []
    assert repair.repaired_turns(frame(spark, [])).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert tuple(repair.damaged_and_repaired(frame(spark, [(gone, 0, "user", "a")])).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_sql(spark):
    rows = conversations(40, 9)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    rel = con.execute(oracles.OP11)
    names = [d[0] for d in rel.description]
    expected = {r[0]: r for r in rel.fetchall()}
    found = repair.damaged_and_repaired(frame(spark, rows)).select(*names).collect()
    assert {r[0]: tuple(r) for r in found} == expected


def texts(seed=4, n=80):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(4, 9))) for _ in range(25)] + ["zzzzzz", "zzzzz", "zzzzzzz", "ababab", "bababa"]

    def word():
        w = rng.choice(stems)
        if rng.random() < 0.4:
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abzé") + w[k:], w[:k] + rng.choice("abzÉ") + w[k + 1 :]])
        return w.upper() if rng.random() < 0.1 else w

    rows = [(k, rng.choice([" ", ", ", "1"]).join(word() for _ in range(rng.randrange(0, 200)))) for k in range(n)]
    return [*rows, (None, "zzzzzz zzzzzz"), (900, None), (901, ""), rows[0], rows[0]]


def one_edit(a, b):
    letters = {*a, *b}
    near = {a[:k] + a[k + 1 :] for k in range(len(a))} | {a[:k] + x + a[k:] for k in range(len(a) + 1) for x in letters} | {a[:k] + x + a[k + 1 :] for k in range(len(a)) for x in letters}
    return b in near - {a}


def counted(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def grouped(n):
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("most", [1024, 6])
def test_variants_against_all_pairs(spark, most):
    n = counted(texts())
    assert len(n) > 100
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in texts()], "doc_id long, text string, word string, n long").repartition(3)
    words = spelling.vocabulary(spelling.damaged(spelling.runs(docs)))
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(words, most=most).collect()}
    assert found == grouped(n)


def test_spelling_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts(8))
    expected = set(con.execute(oracles.OP12).fetchall())
    found = spelling.spelling_variants(spark.createDataFrame(texts(8), "doc_id long, text string")).collect()
    assert {tuple(r) for r in found} == expected


def test_chains_of_forms_and_a_word_near_very_many(spark):
    chain = [("a" * k + "b" * (12 - k), 3 * 2**k) for k in range(13)]
    star = [("centre" + a + b, 5) for a in string.ascii_lowercase for b in string.ascii_lowercase]
    words = dict(chain + star)
    found = spelling.variants(spark.createDataFrame([*words.items()], "word string, n long"), most=40).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == grouped(words)
    assert {r["root"] for r in found if r["word"] in dict(chain)} == {"a" * 12}


def test_cells_stay_small(spark):
    rng = random.Random(1)
    words = {"over" + "".join(rng.choice("abc") for _ in range(5)) for _ in range(300)}
    held = spelling.cells(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), 20)
    assert held.groupBy("cell", "size").count().agg({"count": "max"}).first()[0] <= 20
    pairs = {(r["a"], r["b"]) for r in spelling.links(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), 20).collect()}
    assert pairs == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_no_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "1 2"), (3, "words alone")], "doc_id long, text string")).collect() == []
    alone = spelling.spelling_variants(spark.createDataFrame([(-1, "x" * 5000 + " ")] * 3, "doc_id long, text string")).collect()
    assert [(r["form"], r["n_near"]) for r in alone] == [(None, 0)]
    assert alone[0]["root"] == alone[0]["word"]


ENTRIES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"), ("block", "a.b.com"), ("allow", "a.b.com/x/y"), ("block", "a.b.com/x/y"), ("allow", "b.com/x"), ("block", "net/a/b/c"), ("allow", "net/a/b/c/"), ("allow", "")]


def judged(url, rules, default):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1].translate({c: c + 32 for c in range(65, 91)}), found[2]) if found else ("", "")
    fit = [(len(r.host.split(".")) if r.host else 0, len(r.path), r.verdict == "block", r) for r in rules if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit)[3] if fit else None
    return host, path, best.host + best.path if best else None, best.verdict if best else default


def urls():
    rng = random.Random(6)
    made = [None, "", "no scheme", "http://", "://org/", "http://org", "http://ORG/x", "http://a..org/x", "http://É.org/", "http://example.org/en/1?x=/es/", "http://example.org?/es/", "a://b.com/x://y", "http://xexample.org/es/", "http://org/" + "d/" * 3000]
    for _ in range(400):
        host = ".".join(rng.choice(["a", "b", "www", "example"]) for _ in range(rng.randrange(0, 3))) + "." + rng.choice(["org", "com", "net", "example.org"])
        made.append(f"http://{host}/{'/'.join(rng.choice(['a', 'b', 'c', 'x', 'y', 'en', 'es', 'fr', 'de', '1', '12', '']) for _ in range(rng.randrange(0, 5)))}{rng.choice(['', '?q=1', '#de/'])}")
    return [*made, made[0], made[20], made[20]]


@pytest.mark.parametrize("least", [0, 12])
def test_urls_by_trie_and_by_join(spark, least):
    rules = [url_filter.rule(*e) for e in ENTRIES[: len(ENTRIES) - (least > 0)]]
    rows = list(enumerate(urls()))
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in rows], "page_id long, url string, rule string, host string").repartition(3)
    expected = {k: judged(u, rules, "block") for k, u in rows}
    for bound in (1 << 20, 0):
        found = url_filter.judge(pages, rules, "block", trie_bytes=bound)
        assert sorted(found.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
        assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()} == expected
        table = spark.createDataFrame([*rules, ("block", None, "/")], "verdict string, host string, path string")
        found = url_filter.judge(pages, table, "block", trie_bytes=bound)
        assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()} == expected
    kept = url_filter.allowed(pages, rules, "block")
    assert kept.columns == pages.columns
    assert {r["page_id"] for r in kept.collect()} == {k for k, x in expected.items() if x[3] == "allow"}


def test_urls_without_entries_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    for bound in (1 << 20, -1):
        assert [tuple(r)[2:] for r in url_filter.judge(pages, [], trie_bytes=bound).collect()] == [("a.org", "/", None, "allow")]
        assert url_filter.judge(pages.limit(0), [url_filter.rule("block", "org/")], trie_bytes=bound).collect() == []
    with pytest.raises(ValueError, match="verdict"):
        url_filter.rule("deny", "org/")
