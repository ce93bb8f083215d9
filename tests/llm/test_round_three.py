"""Set join, prefix trie and periodic runs against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from tidegrid.llm import periodic, prefix_trie, set_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ----------------------------------------------------------------- set join


def brute_join(rows, share=85):
    sets, up = [], list(range(len(rows)))
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k:k + 4]) for k in range(max(len(w) - 3, 1))} if w else set())

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    best = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            best[top(k)] = min(best.get(top(k), i), i)
    return sorted(((i, len(sets[k]), best.get(top(k))) for k, (i, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def copies():
    """Families of near copies of all sizes around the threshold, a large one, short texts, and odd rows."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for size in [0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 13, 15, 16, 18, 20, 23, 25, 30, 40, 80, 200] * 2:
        base = [r.choice(words) for _ in range(size)]
        for _ in range(r.randint(1, 6)):
            x = list(base)
            for _ in range(r.randint(0, 1 + len(x) // 20)):
                k = r.random()
                if x and k < 0.4:
                    x[r.choice([0, -1, r.randrange(len(x))])] = r.choice(words)
                elif k < 0.7:
                    x.insert(r.choice([0, len(x)]), r.choice(words))
                elif x:
                    x.pop(r.choice([0, -1]))
            rows.append((r.randint(0, 300), r.choice([" ", "\n", "  "]).join(w.upper() if r.random() < 0.1 else w for w in x)))
    hot = [r.choice(words) for _ in range(100)]
    for i in range(80):
        x = list(hot)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            x[r.randrange(100)] = f"z{r.randrange(1000)}"
        rows.append((2000 + i, " ".join(x)))
    rows += [(3000 + i, " ".join(["same", "text"] * r.randint(1, 3) + ["for", "all"])) for i in range(15)]
    return rows + [(None, rows[9][1]), (None, None), (7, None), (None, "only here at once again"), (None, "only here at once again"), (8, " \n\t"), (9, "x" * 100_000)]


@pytest.mark.parametrize("boundary,block", [(None, 2048), (0, 17), (5, 2048), (13, 17), (20, 40)])
def test_join_equals_brute_force(spark, copies, monkeypatch, boundary, block):
    if boundary is not None:
        monkeypatch.setattr(set_join, "cheapest", lambda costs, share: boundary)
    monkeypatch.setattr(set_join, "BLOCK", block)
    df = spark.createDataFrame(copies, "doc_id long, text string").selectExpr("*", "'x' AS id", "1 AS rep", "2 AS n", "3 AS key").repartition(5)
    got = set_join.join(df)
    assert got.columns == ["id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_join(copies)


def test_join_of_few_or_no_documents(spark):
    for rows in ([], [(3, "a b c d e")], [(3, None), (3, None)], [(4, "a b"), (3, "A B"), (5, "b a")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted((tuple(r) for r in set_join.join(df).collect()), key=str) == brute_join(rows)


def test_linked_small_sets_share_a_key():
    """For all sizes: sets that overlap enough share a subset key, others of near sizes do not."""
    import numpy as np

    r = np.random.default_rng(1)
    for boundary in (8, 14):
        for n in range(1, boundary + 1):
            for m in range(n, boundary + 1):
                for both in range(max(n - 3, 0), n + 1):
                    pool = r.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
                    a, b = pool[:n], pool[n - both:]
                    met = set(set_join.subset_keys(a, boundary).tolist()) & set(set_join.subset_keys(b, boundary).tolist())
                    if 100 * both >= 85 * (n + m - both):
                        assert met, (n, m, both)


def test_boundary_follows_the_cost():
    assert set_join.cheapest({}) == 0
    assert set_join.cheapest({6: (1000, 0.0)}) == 0  # lists cost nothing
    assert set_join.cheapest({6: (1000, 1e6)}) >= 6  # long lists


# --------------------------------------------------------------------- trie


def brute_trie(rows, rebuilt=True):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    turns = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
        turns = {c: turns.get(c - c % 20, [])[:h[c]] + v[h[c]:] for c, v in turns.items()}
    nodes = defaultdict(list)
    for c, v in turns.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = defaultdict(set)
    for p in nodes:
        if p:
            kids[p[:-1]].add(p)
    out = []
    for p, members in nodes.items():
        sub, todo = [], [p]
        while todo:
            x = todo.pop()
            sub.append(x)
            todo += kids[x]
        ends = ",".join(map(str, sorted(c for c in members if len(turns[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), sum(not kids[x] for x in sub),
                    sum((len(nodes[x]) - 1) * len(WORD.findall(x[-1][1])) for x in sub if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "hello there", "a b c", None, ""])) for c in range(300) for t in range(r.randint(1, 6))]
    rows += [(1000 + c, t, "user", "same turn") for c in range(120) for t in range(3)]  # copies of one conversation
    rows += [(2000, t, "user", f"turn {t}") for t in range(150)]  # a long one
    rows += [(2100 + c, t, "user", f"turn {t}") for c in range(3) for t in range(140)]
    return rows + [(5, None, "user", "no number"), (5, None, "user", "no number"), (5, 1, "user", "tie"), (None, 1, "user", "no id"), (40, 0, None, None)]


@pytest.mark.parametrize("turns", [1, 40, 500, prefix_trie.TURNS])
@pytest.mark.parametrize("rebuilt", [True, False])
def test_trie_equals_brute_force(spark, turns, rebuilt):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS key", "1 AS depth", "2 AS words").repartition(4)
    lists = prefix_trie.turn_lists(df)
    got = prefix_trie.nodes(prefix_trie.rebuilt(lists) if rebuilt else lists, turns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows, rebuilt)


def test_trie_of_few_or_no_conversations(spark):
    for rows in ([], [(None, 1, "user", "x")], [(21, 1, "user", "x")], [(20, 1, "user", "x"), (21, 1, "user", "y"), (21, 2, "user", "z")]):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert sorted((tuple(r) for r in prefix_trie.nodes(prefix_trie.rebuilt(prefix_trie.turn_lists(df))).collect()), key=str) == brute_trie(rows)


def test_medians_first_balance_the_tree():
    tree = prefix_trie.Tree()
    for k in prefix_trie.medians_first(1000):
        tree.insert([k])

    def height(node):
        return 0 if node == prefix_trie.NIL else 1 + max(height(tree.less[node]), height(tree.more[node]))

    assert height(tree.down[0]) == 10 and sorted(prefix_trie.medians_first(37)) == list(range(37))


# --------------------------------------------------------------------- runs


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        x = 0
        while x < len(w) - q:
            s = x
            while x < len(w) - q and w[x] == w[x + q]:
                x += 1
            if x - s + q >= max(6, 4 * q) and x > s:
                out.setdefault((s, x + q), q)
            x += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def texts_with_runs(r):
    k = r.randrange(6)
    if k == 0:
        return [r.choice("ab") for _ in range(r.randint(0, 400))]
    if k == 1:
        out = []
        for _ in range(r.randint(1, 5)):
            p = [r.choice("abc") for _ in range(r.randint(1, 90))]
            out += (p * 9)[:r.randint(len(p), len(p) * 9)]
        return out
    if k == 2:
        return ["z"] * r.randint(0, 3) + (["a"] * r.randint(1, 30) + ["b"] + ["a"] * r.randint(1, 30)) * r.randint(3, 9) + ["y", "x"]
    if k == 3:  # runs inside periods of runs
        p = ([r.choice("ab")] * r.randint(1, 8) + ["c"]) * r.randint(2, 6) + ["d"]
        p = p * r.randint(1, 4) + [r.choice("abcd")]
        return (p * r.randint(3, 7))[r.randint(0, len(p)):]
    if k == 4:
        a, b = "a", "ab"
        for _ in range(r.randint(5, 13)):
            a, b = b, b + a
        return list(b[:700])
    return ["same"] * r.randint(0, 300)


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_equal_brute_force():
    r = random.Random(1)
    for _ in range(60):
        docs = [texts_with_runs(r) for _ in range(r.randint(1, 12))]
        texts = [r.choice(["", "\n"]) + "".join(w + r.choice([" ", "\n", "\t \r"]) for w in d) for d in docs]
        runs, text = periodic.collapse(pa.array([None, *texts, ""]))
        got = [[(x["start"], x["length"], x["period"]) for x in y] for y in runs.to_pylist()]
        assert got == [[], *map(brute_runs, docs), []]
        assert text.to_pylist() == ["", *(collapsed(d, brute_runs(d)) for d in docs), ""]


def test_runs_of_odd_rows(spark):
    rows = [(1, "a b " * 10, "x"), (1, "a b " * 10, "y"), (None, None, None), (2, "", "z"), (3, " \t ", "z"), (4, "é " * 7 + "  é", "w"), (5, "word " * 30_000 + "end", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").selectExpr("*", "1 AS __text", "2 AS COLLAPSED").repartition(3)
    got = periodic.runs(df)
    assert got.columns == ["doc_id", "text", "__text", "runs", "collapsed"]
    for row in got.collect():
        w = WORD.findall(row.text or "")
        assert [tuple(x) for x in row.runs] == (brute_runs(w) if len(w) < 1000 else [(0, 30_000, 1)])
        assert row.collapsed == collapsed(w, [tuple(x) for x in row.runs])
    assert periodic.runs(df.limit(0)).count() == 0


def test_planted_runs_and_their_digest(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 120)))) for i in range(200)] + [(None, "a b"), (7, None)]
    got = periodic.digest(periodic.runs(periodic.with_planted(spark.createDataFrame(rows, "doc_id long, text string"))))
    want = []
    for i, t in rows:
        w, h = WORD.findall(t or ""), zlib.crc32(("" if i is None else str(i)).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute_runs(w)
        best = min(((-n, s, q) for s, n, q in found), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(found), *((best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4),
                     sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(w, found))))
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(want, key=str) and any(x[1] for x in want)
