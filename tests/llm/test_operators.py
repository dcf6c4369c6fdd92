"""Every corpus operator against a plain Python version on awkward rows, and on an empty table."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import class_lm, document_fingerprints, language_id, mixing, near_dedup, packing, quality_rules, substring_dedup, token_counts, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, token string, n bigint, cls bigint, component string, size string, kept string, score double, rid bigint"
WORD = "amber brook cedar delta ember fjord grove heath islet jetty knoll larch marsh north ocean pines quarry ridge stone trail the of and".split()


def prose(seed: int, n: int, words=None) -> str:
    rng = random.Random(seed)
    out = [rng.choice(words or WORD) + (str(rng.randrange(90)) if rng.random() < 0.5 else "") for _ in range(n)]
    for i in range(0, n, 9):
        out[i] = out[i].capitalize()
        if i:
            out[i - 1] += "."
    return " ".join(out) + "."


def edited(text: str, seed: int, n: int) -> str:
    rng, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "x%d" % rng.randrange(1000)
    return " ".join(w)


def rows():
    base = prose(1, 160)
    out = [(i, prose(100 + i, 60 + 13 * i), "en", f"s{i % 3}") for i in range(12)]
    out += [(20 + i, edited(base, i, i % 6), "en", "s0") for i in range(12)]
    out += [(40, base, "en", "s1"), (41, base, "en", "s1"), (41, base, "en", "s1")]
    out += [(50, None, None, None), (51, "", "en", "s2"), (52, " \n\t ", "en", "s2"), (53, "one two", "en", "s0"), (54, "ONE two", "en", "s0")]
    out += [(None, prose(7, 90), "en", "s1"), (None, prose(7, 90), "en", "s1"), (None, None, "en", None)]
    out += [(60, "\n".join(["same line of text here"] * 30), "en", "s2"), (61, "wörd " * 3000 + "Ünïcode \x01 end.", "de", "s0")]
    out += [(62, "a" * 30_000, "en", "s1"), (63, prose(9, 4000), "en", "s1"), (64, "### $$$ %%% *** " * 12, "en", "s2")]
    return [(k, t, lang, s, None if t is None else len(t), "t", 1, 2, "c", "z", "no", 0.5, 9) for k, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


def test_quality_rules_count_as_plain_python_does(docs, nothing):
    def plain(text):
        text = text or ""
        w = [x for x in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\r")]
        return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    got = quality_rules.quality(docs).collect()
    want = [(r[0], *plain(r[1])) for r in rows()]
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.failed == "") and not (r.base_failed and r.kept)
    assert not [r for r in got if r.doc_id == 64][0].kept
    kept = quality_rules.quality(docs, only_kept=True, carry=docs.columns[:2])
    assert kept.count() == sum(r.kept for r in got) and kept.columns[:2] == ["doc_id", "text"]
    assert quality_rules.quality(nothing).collect() == []


def test_quality_plan_has_no_python_and_no_exchange(docs):
    plan = quality_rules.quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_mixing_keeps_within_a_block_of_the_weights(docs, nothing):
    shares = mixing.units({"a": 5.0, "b": 3.0, "c": 1.3, "d": 0.0}, 97)
    assert sum(shares.values()) == 97 and "d" not in shares
    done = collections.Counter()
    for source, block, slot in mixing.one_period(shares, 97):
        assert block == done[source]
        assert block * 97 // shares[source] <= slot < -(-(block + 1) * 97 // shares[source])
        done[source] += 1
        assert all(abs(done[k] - u * (slot + 1) / 97) < 1 for k, u in shares.items())
    assert done == shares
    with pytest.raises(ValueError):
        mixing.units({str(i): 1.0 for i in range(11)}, 10)
    mixed = mixing.mix(docs, period=20, block=500)
    got = mixed.rows.collect()
    assert len(got) == len(rows()) and {r.source for r in got} == {"", "s0", "s1", "s2"}
    assert mixed.period == 30  # ten slots a source that has text
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for source, u in mixed.shares.items():
        mine = [r for r in got if r.source == source]
        at, want = 0, []
        for k, t, *_ in sorted((r for r in rows() if (r[3] or "") == source), key=lambda r: md5(f"{'' if r[0] is None else r[0]}:{md5(r[1] or '')}")):
            want.append((k, at // 500, len(t or "")))
            at += len(t or "")
        assert sorted(want, key=key) == sorted([(r.doc_id, r.block, r.size) for r in mine], key=key)
        assert all(r.release <= r.slot < r.deadline and r.release == r.block * 30 // u and r.in_mix == (r.slot < mixed.horizon) for r in mine)
    with pytest.raises(ValueError):
        mixing.mix(docs, carry=("size",))
    empty = mixing.mix(nothing)
    assert empty.rows.collect() == [] and empty.horizon == 0
    with_weights = mixing.mix(docs, {"s0": 1.0, "s1": 1.0}, period=20, block=500)
    assert {r.source for r in with_weights.rows.where("slot is null").collect()} == {"", "s2"}


def test_language_codes_decode_held_out_texts(spark, docs, nothing):
    for classes in (2, 4, 6, 9):
        code = language_id.codewords(classes)
        assert len({tuple(r) for r in code}) == classes and (np.abs(code.sum(0)) < classes).all()
    stock = {"aa": "sun moon star sky cloud rain".split(), "bb": "zug bahn gleis wagen fahrt halt".split(), "cc": "mesa silla plato vaso jarra taza".split()}
    made = [(i, prose(i, 40, stock[k]), k) for i in range(150) for k in [sorted(stock)[i % 3]]]
    table = spark.createDataFrame([*made, (900, "12 34", "aa"), (901, None, "bb"), (None, prose(5, 30, stock["bb"]), None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(table).collect()}
    held = [r for r in made if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out for r in held) and sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[901].score == 0 and got[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert len(language_id.identify(docs).collect()) == len(rows())
    assert language_id.identify(nothing).collect() == []


def test_fingerprints_give_the_exact_differences(docs, nothing):
    def units(text):
        for end in (". ", "! ", "? "):
            text = text.replace(end, end[0] + "\n")
        return collections.Counter(x for x in text.split("\n") if x)

    def alike(a, b):
        a, b = units(a), units(b)
        return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0

    got = document_fingerprints.fingerprints(docs).collect()
    assert len(got) == len(rows())
    known = sorted([(k, t or "") for k, t, *_ in rows() if k is not None], key=lambda r: -r[0])
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for (k, text), (_, after) in zip(known, known[1:], strict=False):
        if k == 41:
            continue
        h = len(text) // 2
        changed = text[: len(text) - h] + after[:h]
        r = by_id[k][0]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(alike(text, changed)) and r.near_next == pytest.approx(alike(text, after))
    text_of = {}
    for k, t in known:
        text_of.setdefault(t, set()).add(by_id[k][0].fingerprint)
    assert all(len(v) == 1 for v in text_of.values())
    assert document_fingerprints.fingerprints(nothing).collect() == []
    assert document_fingerprints.fingerprints(docs.where("doc_id = 40")).first().near_next == 1.0


def test_ordered_buckets_meet_at_their_borders(spark, monkeypatch):
    monkeypatch.setattr(document_fingerprints, "BUCKET_ROWS", 7)
    ids = [i * i * (1 if i % 3 else -5) for i in range(100)]
    table = spark.createDataFrame([(k, f"text {k}. More of {k}.") for k in ids], "doc_id bigint, text string")
    got = {r.doc_id: r.edited_sha256 for r in document_fingerprints.fingerprints(table).collect()}
    order = sorted(set(ids), reverse=True)
    assert len(order) == len(ids)
    for i, k in enumerate(order):
        a, b = f"text {k}. More of {k}.", f"text {order[(i + 1) % 100]}. More of {order[(i + 1) % 100]}."
        h = len(a) // 2
        assert got[k] == hashlib.sha256((a[: len(a) - h] + b[:h]).encode()).hexdigest()


def test_peeling_fails_and_retries_larger():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (900, 700))
    common = rng.integers(0, 2**63, 50, dtype=np.uint64)
    first, second = document_fingerprints.differences([(np.append(a, common), np.append(common, b)), (common, common), (a[:0], b[:1])])
    assert first.tolist() == [900, 0, 0] and second.tolist() == [700, 0, 1]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_are_all_attributed(docs, nothing, rule):
    encoder = token_counts.Encoder(open(token_counts.VOCABULARY, "rb").read())
    got = token_counts.section_tokens(docs.where("doc_id is not null and doc_id <> 41"), rule=rule).collect()
    total = collections.Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    for k, t, lang, source, *_ in rows():
        if k is None or k == 41:
            continue
        values = [source or "", lang or "", t or ""]
        assert total[k] == pytest.approx(len(encoder.encoding.encode_ordinary(" ".join(values))))
        assert sum(r.char_end - r.char_start for r in got if r.doc_id == k) == sum(map(len, values))
    assert token_counts.section_tokens(nothing).collect() == []


def test_crossing_tokens_follow_the_rule():
    data = np.frombuffer("ab cdé".encode(), np.uint8)
    start, end, first = np.array([0, 2]), np.array([2, 7]), np.array([0, 4])  # the second token has " c" before the border and "dé" after it
    assert token_counts.attribute(data, start, end, first, "first")[0].tolist() == [2, 0]
    assert token_counts.attribute(data, start, end, first, "most")[0].tolist() == [2, 0]
    assert token_counts.attribute(data, start, end, np.array([0, 3]), "most")[0].tolist() == [1, 1]
    tokens, shared = token_counts.attribute(data, start, end, first, "split")
    assert tokens.tolist() == [1.5, 0.5] and shared.tolist() == [1, 0]


def components(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {k: (len(sets[k]), top(k)) for k in texts}


def test_near_duplicates_equal_all_pairs(spark, docs, nothing):
    got = near_dedup.near_duplicates(docs).collect()
    want = components({r[0]: r[1] for r in rows() if r[0] is not None})
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    nulls = [r for r in got if r.doc_id is None]
    assert all(r.component_id is None and r.kept for r in nulls)
    base = prose(3, 150)
    many = {i: edited(base, i, i % 9) for i in range(250)} | {1000 + i: edited(edited(base, 5, 12), i, i % 4) for i in range(60)}
    table = spark.createDataFrame(list(many.items()), "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table).collect()}
    assert found == components(many)
    assert near_dedup.near_duplicates(nothing).collect() == []


def test_toxicity_learns_pairs_and_scores_held_out(spark, docs, nothing):
    def text(i):
        w = prose(i, 60).split(" ")
        w[10] = ["badword", "badword", "calm"][i % 3]
        w[30] = ["group", "calm", "group"][i % 3]
        return " ".join(w)

    made = [(i, text(i)) for i in range(900)]
    table = spark.createDataFrame([*made, (None, None), (2000, "")], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)] + [(None, 1), (5000, None), (5001, 1)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table, marks).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(got) == 902 and sum(got[i].predicted == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert len(toxicity.toxicity(docs, marks.limit(0)).collect()) == len(rows())
    assert toxicity.toxicity(nothing, marks).collect() == []


def test_substring_dedup_removes_later_passages(spark, docs, nothing):
    passage = prose(77, 60)
    texts = {1: "Alpha is here. " + passage + " Then more follows here.", 2: prose(78, 40) + " " + passage.upper() + "\n" + prose(79, 20), 3: passage, 4: "Short one. Short one.", 5: None, 6: ""}
    table = spark.createDataFrame([(k, t, "extra") for k, t in texts.items()], "doc_id bigint, text string, _row string")
    got = {r.doc_id: r for r in substring_dedup.dedup_units(table).collect()}
    assert got[1].text == texts[1] and got[3].text == "" and got[4].text == texts[4] and got[5].text is None and got[6].text == ""
    spans = got[2]["_spans"]
    assert len(spans) >= 1 and "".join(c for i, c in enumerate(texts[2]) if not any(s.start <= i < s.end for s in spans)) == got[2].text
    assert got[2].text == prose(78, 40) + " " + prose(79, 20) and got[2]["_row"] == "extra"
    whole = substring_dedup.dedup_units(docs).collect()
    assert len(whole) == len(rows()) and substring_dedup.dedup_units(nothing).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.dedup_units(docs.withColumnRenamed("rid", "_spans"))


def test_packing_is_best_fit_and_whole(docs, nothing):
    got = packing.pack(docs, capacities=(64, 256, 1024), shard_tokens=3000).collect()
    need = collections.Counter()
    for k, t, *_ in rows():
        need[k] += len(words(t)) + 1
    have = collections.Counter()
    bins = collections.defaultdict(list)
    for r in got:
        have[r.doc_id] += r.n_tokens
        bins[r.bin_id].append(r)
    assert have == need
    for items in bins.values():
        items.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in items] == np.cumsum([0] + [r.n_tokens for r in items])[:-1].tolist()
        assert items[0].used == sum(r.n_tokens for r in items) and items[0].capacity == min(c for c in (64, 256, 1024) if c >= items[0].used)
    assert packing.pack(nothing).collect() == []


def test_packing_keeps_ids_windows_and_repeated_rows_whole(spark):
    wide = [(2**53 + 1,), (2**53 + 3,), (None,), (-(2**62) - 1,), (None,)]
    table = spark.createDataFrame([(k, f"w{i}") for i, (k,) in enumerate(wide)], "doc_id bigint, text string")
    key = lambda k: (k is None, k or 0)
    assert sorted((r.doc_id for r in packing.pack(table).collect()), key=key) == sorted((k for (k,) in wide), key=key)
    named = spark.createDataFrame([("a", "x"), (None, "y")], "doc_id string, text string")
    assert {r.doc_id for r in packing.pack(named).collect()} == {"a", None}
    far = spark.createDataFrame([(i, "x", w) for i, w in enumerate((0, 1 << 22, 1 << 40, None, 3))], "doc_id bigint, text string, w bigint")
    got = packing.pack(far, window=far["w"]).collect()
    assert {(r.doc_id, r.window) for r in got} == {(i, w) for i, w in enumerate((0, 1 << 22, 1 << 40, None, 3))} and len({r.bin_id for r in got}) == 5
    # Copies of one row, far beyond a shard, are dealt over many.
    same = spark.range(200_000).selectExpr("7L as doc_id", "'same words' as text", "id", "null as bin", "0 as window")
    packed = packing.pack(same, shard_tokens=10_000, capacities=(64, 128))
    sizes = [r["count"] for r in packed.groupBy("shard").count().collect()]
    assert sum(sizes) == 200_000 and len(sizes) == 60 and max(sizes) < 2 * 200_000 / 60
    zero = spark.createDataFrame([(1, "a", 0), (2, "b", None), (3, "c", 5)], "doc_id bigint, text string, n int")
    assert [r.doc_id for r in packing.pack(zero, length=zero["n"]).collect()] == [3]


def test_costs_decide_which_length_opens(spark):
    costs = packing.sequence_costs()
    rates = sorted(zip((512, 1024, 2048, 4096), costs), key=lambda c: c[1] / c[0])
    assert [c for c, _ in rates] == [2048, 1024, 4096, 512]
    table = spark.createDataFrame([(i, "x", 100) for i in range(60)], "doc_id bigint, text string, n int")
    sizes = lambda df: sorted({(r.bin_id, r.used, r.capacity) for r in df.collect()}, key=lambda r: r[1:])
    assert [r[1:] for r in sizes(packing.pack(table, length=table["n"], costs=costs))] == [(2000, 2048)] * 3
    assert [r[1:] for r in sizes(packing.pack(table, length=table["n"]))] == [(2000, 2048), (4000, 4096)]  # in proportion: the longest opens


def plain_best_fit(lengths, capacities, costs):
    bins = []
    where = []
    for n in lengths:
        fits = [(room, -i) for i, (room, _) in enumerate(bins) if room >= n]
        if fits:
            room = min(fits)[0]
            i = max(j for j, (r, _) in enumerate(bins) if r == room)
            where.append(("old", room))
        else:
            size = min((cost / c, -c) for c, cost in zip(capacities, costs, strict=True) if c >= n)[1]
            bins.append([-size, 0])
            i = len(bins) - 1
            where.append(("new", -size))
        bins[i][0] -= n
        bins[i][1] += n
    return where, sorted(min(c for c in capacities if c >= used) for _, used in bins)


def test_best_fit_equals_a_plain_version():
    rng = np.random.default_rng(4)
    for costs in ((10.0, 20.0, 40.0), (10.0, 22.0, 60.0)):
        lengths = np.sort(rng.integers(1, 41, 300))[::-1]
        _, offset, capacity, used = packing.best_fit(lengths, (10, 20, 40), costs)
        _, want = plain_best_fit(lengths.tolist(), (10, 20, 40), costs)
        assert sorted(capacity.tolist()) == want and used.sum() == lengths.sum()


def test_class_model_base_and_mass(spark, docs, nothing):
    got = class_lm.perplexity_scores(docs).collect()
    train = collections.Counter()
    for k, t, *_ in rows():
        if zlib.crc32(b"" if k is None else str(k).encode()) % 10:
            train.update(words(t) + [None])
    n, v = sum(train.values()), len(train)

    def base(t):
        return sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None])

    want = sorted([(k, len(words(t)) + 1, sum(train[w] > 0 for w in [*words(t), None]), round(base(t), 6)) for k, t, *_ in rows()], key=key)
    assert sorted([(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got], key=key) == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in got)
    assert class_lm.perplexity_scores(nothing).collect() == []
    untrained = class_lm.class_scores(docs, docs["doc_id"] < 0).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in untrained)


def test_class_model_is_a_distribution_and_learns_order(spark):
    def text(i):
        rng = random.Random(i)
        return " ".join(x for _ in range(40) for x in (rng.choice(["red", "blue", "green", "white"]), rng.choice(["cat", "dog", "fox", "hen"])))

    table = spark.createDataFrame([(i, text(i)) for i in range(300)] + [(1000, "red"), (1001, "cat"), (1002, "blue cat"), (1003, "cat blue")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in class_lm.class_scores(table, table["doc_id"] < 300, classes=3, clustered=50, rounds=4).collect()}
    assert got[1002].score > got[1003].score and got[1002].base_score == pytest.approx(got[1003].base_score)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    # Fewer listed words than there are: counts of the rest come by the join, and the sums stay the same.
    few = {r.doc_id: r.base_score for r in class_lm.class_scores(table, table["doc_id"] < 300, classes=2, clustered=2, listed=3).collect()}
    assert all(few[k] == pytest.approx(got[k].base_score) for k in got)


def test_pipeline_stages_against_plain_versions(spark, docs, tmp_path):
    folder = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    names = ["quality_rules", "near_dedup", "substring_dedup", "mixing", "packing"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    held = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, folder)
        out.write.parquet(f"{folder}/{name}")
        before, held = held, spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert held.columns == corpus_pipeline.COLUMNS
        if name == "quality_rules":
            good = quality_rules.quality(before).where("kept").count()
            assert held.count() == good > 5
        if name == "near_dedup":
            ids = [r.doc_id for r in held.collect() if r.doc_id is not None]
            want = components({r.doc_id: r.text for r in before.collect() if r.doc_id is not None})
            assert sorted(ids) == sorted({c for _, c in want.values()})
        if name == "substring_dedup":
            assert all(len(r.text) == r.n_chars for r in held.collect())
        if name == "mixing":
            assert {r.doc_id for r in held.collect()} <= {r.doc_id for r in before.collect()}
    empty = docs.select(*corpus_pipeline.COLUMNS).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {r.doc_id for r in held.collect()}


def test_mixing_stage_keeps_every_document_in_slot_order(spark):
    made = [(i, prose(i, 600), "en", "big") for i in range(200)] + [(900, "one short text", "en", "tiny"), (901, "another one", "en", None), (None, "no id", "en", "big"), (None, "no id", "en", "big")]
    table = spark.createDataFrame([(*r, len(r[1])) for r in made], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    held = corpus_pipeline.mixing_stage(spark, table, "")
    assert sorted(map(tuple, held.collect()), key=key) == sorted(map(tuple, table.collect()), key=key)
    slot_of = {r.doc_id: r.slot for r in mixing.mix(table).rows.collect() if r.doc_id is not None}
    order = [slot_of[r.doc_id] for r in held.collect() if r.doc_id is not None]
    assert order == sorted(order) and len(set(order)) > 10
    packed = corpus_pipeline.packing_stage(spark, held, "").collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(r[0] for r in made)
    windows = packing.pack(table, shard_tokens=20_000, window=table["doc_id"] % 3).collect()
    bins = collections.defaultdict(set)
    for r in windows:
        bins[r.bin_id].add(None if r.doc_id is None else r.doc_id % 3)
    assert all(len(v) == 1 for v in bins.values()) and collections.Counter(r.doc_id for r in windows) == collections.Counter(r[0] for r in made)
    assert all(r.window == (None if r.doc_id is None else r.doc_id % 3) for r in windows)


def test_near_dedup_stage_keeps_rows_of_one_id_apart(spark):
    base = prose(1, 160)
    good = [(0, base, "a"), (7, prose(2, 90), "a"), (7, prose(3, 90), "a"), (None, prose(4, 90), "a"), (None, prose(5, 90), "a"), (8, prose(6, 90), "a")]
    gone = [(7, edited(base, 1, 1), "a"), (None, prose(4, 90), "b"), (8, prose(6, 90), "b"), (8, prose(6, 90), "a"), (9, prose(2, 90), "a")]
    table = spark.createDataFrame([(k, t, "en", s, len(t)) for k, t, s in good + gone], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.near_dedup_stage(spark, table, "").collect()]
    assert sorted(got, key=key) == sorted(good, key=key)
    assert near_dedup.near_duplicates(table).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_toxicity_learns_pairs_of_words_that_tell_nothing_alone():
    def text(i):
        w = prose(i, 60).split(" ")
        w[10], w[30] = ["groupa", "groupb"][i % 2], ["insulta", "insultb"][i // 2 % 2]
        return " ".join(w)

    def found(i):
        data = np.frombuffer(text(i).encode(), np.uint8)
        return next(iter(toxicity.terms(np.array([0, len(data)]), data)))

    toxic = np.array([float(i % 2 == i // 2 % 2) for i in range(1800)])
    rows = [found(i) for i in range(1800)]
    model = toxicity.train(rows[:1200], toxic[:1200])
    raw = np.array([model.raw(s, x, np.zeros(1, np.int64))[0] for s, x in rows[1200:]])
    assert ((raw > 0) == (toxic[1200:] == 1)).mean() >= 0.9


def test_mixing_of_more_sources_than_slots(spark):
    many = spark.createDataFrame([(i, "" if i % 2 else "text of its own", f"s{i:02}") for i in range(60)], "doc_id bigint, text string, source string")
    few = mixing.mix(many, {"s58": 3.0, "s59": 1.0, "none": 1.0, "s00": 0.0}, period=8, block=5)
    assert few.shares == {"s58": 15, "s59": 5} and few.period == 20
    assert {r.source for r in few.rows.where("slot is not null").collect()} == {"s58", "s59"}
    every = mixing.mix(many, period=20, block=5)
    got = every.rows.collect()
    assert every.period == 300 and sum(every.shares.values()) == 300 and len(every.shares) == 30
    assert len(got) == 60 and all((r.slot is None) == (r.size == 0) for r in got)
    assert all(r.release <= r.slot < r.deadline for r in got if r.slot is not None)


def test_mixing_spreads_null_ids_and_copies(spark):
    made = [(None, f"text {i}", "a") for i in range(300)] + [(7, "copy", "a")] * 500 + [(i, "x" * 30, "b") for i in range(50)]
    got = mixing.mix(spark.createDataFrame(made, "doc_id bigint, text string, source string"), block=40).rows.collect()
    assert len(got) == 850 and all(r.release <= r.slot < r.deadline for r in got)
    taken = sorted(r.block for r in got if r.doc_id == 7 and r.source == "a")
    first = taken[0]
    assert all(first <= b <= first + 500 * 4 // 40 + 1 for b in taken) and len(set(taken)) >= 50


def test_language_sample_is_by_language_and_decoding_is_plain(spark):
    stock = {"aa": "sun moon star sky cloud rain".split(), "bb": "zug bahn gleis wagen fahrt halt".split(), "cc": "mesa silla plato vaso jarra taza".split()}
    made = [("aa", prose(1, 30, stock["aa"]))] * 3000 + [(k, prose(i, 30, stock[k])) for i in range(120) for k in stock]
    table = spark.createDataFrame(made, "lang string, text string")
    languages, drawn = language_id.sample(table, per_language=20)
    counts = collections.Counter(r.lang for r in drawn.collect())
    assert languages == ["aa", "bb", "cc"] and counts == {"aa": 20, "bb": 20, "cc": 20}
    model = language_id.fit(table, per_language=20)
    got = language_id.predict(table.withColumn("doc_id", table["lang"]), model).collect()
    assert sum(r.lang_pred == r.doc_id for r in got) >= 0.98 * len(got)
    x = np.random.default_rng(1).normal(size=(9, language_id.BUCKETS))
    best, score, _ = model.decode(x)
    for row, b, s in zip(x, best, score):
        margins = [sum(v * w for v, w in zip(row, column)) + bias for column, bias in zip(model.weights.T, model.bias)]
        loss = [sum(math.log1p(math.exp(-m * c)) for m, c in zip(margins, word)) for word in model.code]
        assert loss.index(min(loss)) == b and s == pytest.approx(1 / sum(math.exp(min(loss) - x) for x in loss))
    many = spark.createDataFrame([(f"l{i:04}", f"word{i} again") for i in range(1200)], "lang string, text string")
    names, few = language_id.sample(many, per_language=400, most_sampled=600)
    assert len(names) == 1200 and few.count() == 1200


def test_toxic_labels_are_voted_and_sampled_by_class(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(400)] + [(5, "another text")] * 3 + [(6, None)], "doc_id bigint, text string")
    marks = [(i, int(i < 40)) for i in range(400) if i != 9] + [(1, 0), (2, 0), (2, 0), (3, 1), (8, None), (8, 7), (9, None), (500, 1), (None, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    got = toxicity.sample(docs, labels, most_toxic=1000, most_other=1000).collect()
    ids = {r.text: r.toxic for r in got}
    assert len(got) == len(ids) == 398 and "text number 1" not in ids and ids["text number 2"] == 0 and ids["text number 3"] == 1 and "text number 9" not in ids
    assert "another text" in ids and "text number 5" not in ids  # one text an id, the least
    few = collections.Counter(r.toxic for r in toxicity.sample(docs, labels, most_toxic=10, most_other=30).collect())
    assert few == {1: 10, 0: 30}


def test_machine_equals_the_plain_pairwise_sum():
    rng = np.random.default_rng(5)
    model = toxicity.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    rows = [(np.array([3, 7, 20]), np.array([1.0, 1.4, 2.0])), (np.array([9]), np.array([1.2])), (np.arange(30), rng.random(30))]
    size = np.array([len(s) for s, _ in rows])
    raw = model.raw(np.concatenate([s for s, _ in rows]), np.concatenate([x for _, x in rows]), np.cumsum(size) - size)
    for (slots, x), value in zip(rows, raw):
        want = model.bias + sum(model.linear[s] * w for s, w in zip(slots, x))
        want += sum(float(model.factors[a] @ model.factors[b]) * u * v for i, (a, u) in enumerate(zip(slots, x)) for b, v in list(zip(slots, x))[:i])
        assert value == pytest.approx(want)


def test_token_lengths_are_those_of_the_encoder(spark, docs, nothing):
    got = token_counts.with_token_lengths(docs.select("doc_id", "text", "rid")).collect()
    with open(token_counts.VOCABULARY, "rb") as file:
        encoder = token_counts.Encoder(file.read())
    assert len(got) == len(rows()) and all(r.n_tokens == len(encoder.spans(r.text or "")[1]) and r.rid == 9 for r in got)
    assert token_counts.with_token_lengths(nothing).collect() == []
    with pytest.raises(FileNotFoundError):
        token_counts.with_token_lengths(docs, vocabulary="/nowhere/at/all")


def test_pipeline_stages_equal_their_sql_and_a_plain_packing(spark, docs, tmp_path):
    import duckdb

    folder = str(tmp_path)
    held = docs.select(*corpus_pipeline.COLUMNS).where("doc_id is not null").dropDuplicates(["doc_id"])
    held.write.parquet(f"{folder}/documents")
    con, at = duckdb.connect(), "documents"
    for name, stage in corpus_pipeline.STAGES:
        before = spark.read.parquet(f"{folder}/{at}")
        stage(spark, before, folder).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        con.execute(f"create or replace view documents as select * from '{folder}/{at}/*.parquet'")
        at = name
        if name == "quality_rules":
            want = {r[0] for r in con.execute(f"select doc_id from ({quality_rules.quality_sql()}) q where kept").fetchall()}
            assert {r.doc_id for r in after.collect()} == want
        if name == "substring_dedup":
            texts = {r.doc_id: r.text for r in before.collect()}
            got = {r.doc_id: r.text for r in after.collect()}
            for doc_id, spans, digest in con.execute(f"select doc_id, spans, clean_sha256 from ({substring_dedup.dedup_units_sql()}) q").fetchall():
                gone = [tuple(map(int, s.split("-"))) for s in (spans or "").split(",") if s]
                rest = "".join(c for i, c in enumerate(texts[doc_id]) if not any(a <= i < b for a, b in gone))
                assert hashlib.sha256(rest.encode()).hexdigest() == digest
                assert got.get(doc_id) == (rest if words(rest) or not gone else None)
        if name in ("mixing", "packing"):
            slots = dict(con.execute(f"select doc_id, slot from ({mixing.mix_sql()}) q").fetchall())
        if name == "mixing":
            order = [slots[r.doc_id] for r in after.collect()]
            assert sorted(slots) == sorted(r.doc_id for r in after.collect()) and order == sorted(order, key=lambda s: (s is None, s or 0))
        if name == "packing":
            with open(token_counts.VOCABULARY, "rb") as file:
                encoder = token_counts.Encoder(file.read())
            largest, windows = max(packing.CAPACITIES), collections.defaultdict(list)
            for r in before.collect():
                n = len(encoder.encoding.encode_ordinary(r.text or "")) + 1
                windows[None if slots[r.doc_id] is None else slots[r.doc_id] // corpus_pipeline.WINDOW_SLOTS] += [largest] * (n // largest) + [n % largest] * (n % largest > 0)
            bins = collections.defaultdict(set)
            for r in after.collect():
                bins[r.window].add((r.bin_id, r.capacity))
            assert bins.keys() == windows.keys()
            for window, lengths in windows.items():
                _, want = plain_best_fit(sorted(lengths, reverse=True), packing.CAPACITIES, packing.sequence_costs())
                assert sorted(c for _, c in bins[window]) == want
    (spark.read.parquet(f"{folder}/documents")).write.parquet(f"{folder}/whole/documents.parquet")
    row = lambda r: (r.doc_id, r.piece, r.piece_start, r.n_tokens, r.window, r.capacity)
    assert sorted(map(row, corpus_pipeline.run(spark, f"{folder}/whole").collect()), key=str) == sorted(map(row, spark.read.parquet(f"{folder}/packing").collect()), key=str)


def test_packing_follows_the_order_that_mixing_wrote(spark, tmp_path):
    """Slots equal those of the mix when documents stand in its order, and others when they stand otherwise."""
    made = [(i, prose(i, 3000), "en", "big" if i % 4 else "small") for i in range(260)]
    table = spark.createDataFrame([(*r, len(r[1])) for r in made], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    corpus_pipeline.mixing_stage(spark, table, "").write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    slots = {r.doc_id: r.slot for r in mixing.mix(table).rows.collect()}
    assert {r.doc_id: r.slot for r in mixing.mix(corpus_pipeline.standing(mixed), size="n_chars", place=corpus_pipeline.PLACE).rows.collect()} == slots and len(set(slots.values())) > 5
    mixed.orderBy("doc_id").write.parquet(f"{tmp_path}/sorted")
    other = {r.doc_id: r.slot for r in mixing.mix(corpus_pipeline.standing(spark.read.parquet(f"{tmp_path}/sorted")), size="n_chars", place=corpus_pipeline.PLACE).rows.collect()}
    assert other.keys() == slots.keys() and other != slots
    pieces = lambda name: {(r.doc_id, r.piece, r.bin_id, r.window) for r in corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), "").collect()}
    corpus_pipeline.WINDOW_SLOTS, before = 2, corpus_pipeline.WINDOW_SLOTS
    try:
        first, second = pieces("mixed"), pieces("sorted")
    finally:
        corpus_pipeline.WINDOW_SLOTS = before
    assert {(d, w) for d, _, _, w in first} == {(d, s // 2) for d, s in slots.items()} and first != second
