"""Operators 11 to 13 against plain Python versions on awkward rows, and on empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair as talk
from tidemark.llm import cover_tree, spelling

DOCS = "doc_id bigint, text string, n bigint, word string, key string, lang string"
VECTORS = "vec_id bigint, embedding array<float>, label int, key string, cell string, m bigint"
TURNS = "conv_id bigint, turn bigint, role string, text string, at bigint, ck string, kind int, block string"


# 11: spelling variants


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def plain_counts(rows, misprint):
    n = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if misprint and h % misprint == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def plain_variants(n, factor=5):
    out = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v)) if near else None
        out[w] = (n[w], len(near), best if best and n[best] >= factor * n[w] else None)
    rows = set()
    for w, (c, many, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.add((w, c, many, form, n[form] if form else None, root))
    return rows


def variants(df, **options):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(df, **options).collect()}


def test_words_are_counted_and_misprinted(spark):
    text = "Grüßen ÉTABLIR établir Étable letters LETTERS letterS lettersÿ naïveté× don't 12letters34"
    rows = [(i, " ".join([text] * (i + 1))) for i in range(9)] + [(None, text), (10**17, text), (4, None), (5, ""), (6, "zz " * 9), (7, text), (7, text), (8, "a" * 5000)]
    df = spark.createDataFrame([(i, t, 1, "w", "k", "en") for i, t in rows], DOCS)
    for misprint in (None, 3, 199):
        got = {r.word: r.n for r in spelling.vocabulary(df, misprint=misprint).collect()}
        assert got == plain_counts(rows, misprint)


@pytest.mark.parametrize("shard_words", [2048, 3])
def test_near_words_are_those_one_edit_away(spark, shard_words):
    rng = random.Random(4)
    words = {"aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaab", "baaaaa", "ababab", "bababa", "abababa", "éaaaaa", "aaaéaa", "÷×ÿàßa", "÷×ÿàß", "÷×ÿàßaa", "x" * 300, "x" * 299 + "y", "x" * 301}
    words |= {"".join(rng.choice("abc") for _ in range(rng.randrange(6, 9))) for _ in range(260)}
    words |= {"station" + "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 4))) for _ in range(60)}
    n = {w: 5 + rng.randrange(4) * (40 if rng.random() < 0.4 else 1) for w in words if len(w) >= 6}
    df = spark.createDataFrame([(w, c, "k", 1) for w, c in n.items()], "word string, n bigint, key string, shard int")
    assert variants(df, shard_words=shard_words) == plain_variants(n)


def test_forms_are_followed_to_the_root(spark):
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 625, "abbbbb": 3125, "bbbbbb": 3125, "zzzzzz": 7}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    got = variants(df)
    assert got == plain_variants(n)
    assert {r[0]: r[5] for r in got}["aaaaaa"] == "aaabbb"  # equal counts are no form


def test_no_words(spark):
    assert spelling.spelling_variants(spelling.vocabulary(spark.createDataFrame([], DOCS), misprint=199)).collect() == []


# 12: near vectors


def plain_links(rows, cosine=0.93):
    able = [(i, v, l) for i, (v, e, l) in enumerate(rows) if l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {i: set() for i in range(len(rows))}
    for (i, _, l), (j, _, k) in itertools.combinations(able, 2):
        a, b = (np.array(rows[x][1], np.float32).astype(float) for x in (i, j))
        if l == k and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
            links[i].add(j), links[j].add(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        seen |= group
        ids = [rows[x][0] for x in group if rows[x][0] is not None]
        for x in group:
            out[x] = (rows[x][0], len(links[x]), min(ids) if ids else None, rows[x][0] == (min(ids) if ids else None))
    return sorted(out, key=str)


def vector_rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(260):
        spread = (0.02, 0.35, 1.0)[i % 3]
        rows.append((i, [float(np.float32(x)) for x in centres[i % 6] + spread * rng.normal(size=8)], i % 2))
    same = rows[3][1]
    rows += [(1000 + i, same, 1) for i in range(70)] + [(2000 + i, [x * 2.0**i for x in same], 1) for i in range(40)]
    rows += [(3000, same, None), (3001, None, 1), (3002, [], 1), (3003, [0.0] * 8, 1), (3004, [float("nan")] + same[1:], 1), (3005, [float("inf")] + same[1:], 1), (3006, [None] + same[1:], 1)]
    rows += [(None, same, 0), (None, same, 0), (None, rows[1][1], 0), (5, same, 1), (5, same, 1), (4000, [1.0, 0.0], 1), (4001, [1.0, 0.1], 1), (4002, [-0.0, 1.0], 1), (4003, [0.0, 1.0], 1), (4004, [3e38] * 8, 1), (4005, [1e-38] * 8, 1)]
    return rows


@pytest.mark.parametrize("block,fan", [(1024, 32), (40, 4), (7, 2)])
def test_links_are_exactly_the_pairs_above_the_cosine(spark, block, fan):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "k", "c", 3) for r in rows], VECTORS)
    got = sorted((tuple(r) for r in cover_tree.near_vectors(df, block=block, fan=fan).collect()), key=str)
    assert got == plain_links(rows)


def test_levels_are_nested_and_cover(spark):
    rng = np.random.default_rng(2)
    u = cover_tree._unit(np.repeat(rng.normal(size=(30, 5)), 6, axis=0) + 0.05 * rng.normal(size=(180, 5)))
    path = cover_tree.cover_levels(u)
    for level, radius in enumerate(cover_tree.RADII):
        assert (np.sqrt(((u - u[path[:, level]]) ** 2).sum(axis=1)) <= radius + 1e-9).all()
        if level:
            assert (path[path[:, level], level] == path[:, level]).all()
            assert set(path[:, level - 1]) <= set(path[:, level])


def test_no_vectors(spark):
    assert cover_tree.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    none = spark.createDataFrame([(1, None, 1, "", "", 1), (None, [0.0], 1, "", "", 1)], VECTORS)
    assert sorted((tuple(r) for r in cover_tree.near_vectors(none).collect()), key=str) == [(1, 0, 1, True), (None, 0, None, True)]


# 13: conversations


def plain_repair(rows):
    """rows: (turn, role, text) after damage, in order. Every edit sequence through the four states, the least kept whole."""
    seen, faults = set(), []
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        again = not blank and (role, text) in seen
        broken = not blank and not again and re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1] not in ".!?"
        seen.add((role, text))
        faults.append((blank, again, broken))
    after = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}
    best = {"": (0, "", [])}

    def put(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value

    def inserted(best):
        for _ in range(3):
            new = dict(best)
            for state, (cost, audit, lines) in best.items():
                to = "a" if state == "u" else "u"
                put(new, to, (cost + 2, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[to]]))
            best = new
        return best

    for (_, role, text), (blank, again, broken) in zip(rows, faults):
        new = {}
        for state, (cost, audit, lines) in inserted(best).items():
            put(new, state, (cost + 3, audit + "D", lines))
            if not blank and not again:
                to = after.get(role[:1], {}).get(state)
                if to:
                    put(new, to, (cost + broken, audit + "K", [*lines, f"{role}:{text}"]))
                to = "a" if state == "u" else "u"
                put(new, to, (cost + 2 + broken, audit + "R", [*lines, {"u": "user:", "a": "assistant:"}[to] + text]))
        best = new
    cost, audit, lines = min((v for s, v in inserted(best).items() if s in ("", "a")), key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(sum(f[k] for f in faults) for k in range(3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        pick = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
        out[conv] += [] if pick == 0 else [(turn, "user" if pick == 4 else role, text)] * (2 if pick == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def talks(n):
    rng = random.Random(n)
    texts = ["Yes.", "No!", "and then", "", " \t", None, "wörd?\n", "Yes. ", "So it is.", "x" * 3000 + "."]
    rows = []
    for conv in [*range(n), None]:
        size = rng.choice((1, 2, 3, 6, 9, 14))
        for k in range(size):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", None, "", "u2")) if rng.random() < 0.4 else ("user", "assistant")[k % 2]
            turn = None if rng.random() < 0.05 else k + (rng.random() < 0.1) * rng.randrange(-3, 9)
            rows.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(40)}."))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2, "b") for r in rows], TURNS)


def test_conversations_are_damaged_and_repaired_as_by_a_plain_search(spark):
    rows = talks(150) + [(7_000_000_000, 1, "user", "Hi."), (7_000_000_000, 1, "user", "Hi.")]
    got = {r.conv_id: tuple(r)[1:] for r in talk.repaired_conversations(frame(spark, rows)).collect()}
    assert got == {c: plain_repair(r) for c, r in plain_damage(rows).items()}


def test_a_long_conversation_is_repaired_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(talk, "BLOCK_BITS", 2)
    rng = random.Random(3)
    rows = [(c, k, rng.choice(("user", "assistant", "system")), f"{rng.randrange(90)}" + rng.choice((".", ""))) for c, size in ((1, 700), (2, 5), (3, 90)) for k in range(size)]
    rows += [(4, 1, "user", "Same.")] * 50
    done = talk.repair(frame(spark, rows).select("conv_id", "turn", "role", "text"))
    hashed = {r.ck: (r.audit, r.repaired_sha256) for r in talk.digests(done).collect()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, *hashed[r.ck]) for r in done.summary.collect()}
    want = {}
    for c in (1, 2, 3, 4):
        want[c] = plain_repair(sorted(((t, r, x) for k, t, r, x in rows if k == c), key=lambda z: (z[0], z[1], z[2])))
    assert got == want


def test_crossings_give_the_least_audit(spark):
    rng = random.Random(1)
    for _ in range(200):
        kinds = [rng.randrange(9) for _ in range(rng.randrange(1, 12))]
        elements = [talk.ROWS[k] for k in kinds]
        cost, leave = talk.best_leave(talk.joined(elements))
        states = talk.crossings(elements, 0, leave)
        audit = "".join(talk.CHOICES[k][p][1] for k, p in zip(kinds, zip(states, states[1:]))) + talk.TAIL[leave]
        best = {0: (0, "")}
        for k in kinds:
            new = {}
            for (b, a), (c, e) in talk.CHOICES[k].items():
                if b in best:
                    new[a] = min(new.get(a, (10**9, "")), (best[b][0] + c, best[b][1] + e))
            best = new
        assert (cost, audit) == min((c + 2 * len(talk.TAIL[s]), e + talk.TAIL[s]) for s, (c, e) in best.items())


def test_no_conversations(spark):
    assert talk.repaired_conversations(frame(spark, [])).collect() == []
    lost = next(t for t in range(200) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    row = talk.repaired_conversations(frame(spark, [(9, lost, "user", "Hi.")])).first()
    assert tuple(row) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_null_ids_meet_no_other(spark):
    rows = [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hello."), (0, 1, "user", "Hi.")]
    got = talk.repair(frame(spark, rows).select("conv_id", "turn", "role", "text")).summary.orderBy(F.col("conv_id").asc_nulls_first()).collect()
    assert [(r.conv_id, r.cost) for r in got] == [(None, 0), (0, 2)]
