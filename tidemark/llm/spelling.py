"""Spelling variants: words of a corpus beside the frequent words that differ from them by one code point.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Cut a word in
two halves: the one error lies in one of them, so a near word starts with the first half or ends with the
second. This gives two search schemes, run over a pair of FM-indexes of the delimited vocabulary, one that
extends a match to the right and one that extends it to the left: match the half exactly, then go on across
the other half with one error allowed, every partial match being an interval of suffix ranks.

The vocabulary grows with the corpus, so no task holds it. Words are posted under the halves by which words
of their own length, one less or one more ask for them; only words under one half can be near. Halves are
dealt to shards of about ``shard_words`` rows, each shard has its own indexes, and a half with more words
than that is cut into a grid of (asking part, listed part), so that no common half makes a large task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a run, and those of them that lower() would change though only A-Z are to be.
LETTERS, KEPT_CAPITALS = "A-Za-zÀ-ÿ", "[À-ÖØ-Þ]"
LEAST_LENGTH, LEAST_COUNT, FACTOR, SHARD_WORDS = 6, 5, 5, 2048

_PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
_SENTINEL, _DELIMITER, _FIRST = 0, 1, 2


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` in order, by prefix doubling; the last symbol must be unique."""
    n = len(text)
    rank, wide, k = text.astype(np.int64), np.int64(max(n, 256) + 2), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - k, 0)] = rank[k:] + 1
        key = rank * wide + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class RightwardIndex:
    """FM-index of the reversed delimited text of distinct words: a match, an interval of ranks, grows to the right."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray):
        """``flat`` holds the symbols of all words one after the other, ``starts`` where each starts, and the end."""
        words = len(starts) - 1
        text = np.full(len(flat) + words + 1, _DELIMITER, np.uint8)
        text[np.arange(len(flat)) + np.repeat(np.arange(words), np.diff(starts)) + 1] = flat
        self.delimiters = starts + np.arange(words + 1)
        self.length = len(text)
        turned = np.append(text[::-1], np.uint8(_SENTINEL))
        self.order = suffix_order(turned)
        self.before = turned[self.order - 1]
        self.wide = np.int64(len(turned) + 1)
        # Sorted by symbol and rank: the place of (symbol, rank) is the rank that one more symbol leads to.
        self.steps = np.sort(self.before.astype(np.int64) * self.wide + np.arange(len(turned)))

    def extend(self, symbol: np.ndarray | int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = np.asarray(symbol, np.int64) * self.wide
        return np.searchsorted(self.steps, base + lo), np.searchsorted(self.steps, base + hi)

    def symbols(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, letter) of every letter that can follow each interval; equal intervals are looked into once."""
        each, back = np.unique(lo * self.wide + hi, return_inverse=True)
        a, b = each // self.wide, each % self.wide
        size = b - a
        at = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
        found = np.unique(np.repeat(np.arange(len(each)), size) * 256 + self.before[at])
        owner, letter = found // 256, found % 256
        owner, letter = owner[letter >= _FIRST], letter[letter >= _FIRST]
        # Back to the intervals asked for: each takes the letters of its distinct one.
        first, last = np.searchsorted(owner, back), np.searchsorted(owner, back, side="right")
        many = last - first
        pick = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
        return np.repeat(np.arange(len(lo)), many), letter[pick]

    def word_at(self, rank: np.ndarray) -> np.ndarray:
        """Number of the word between the delimiters that the match at a rank starts and ends with."""
        return np.searchsorted(self.delimiters, self.length - 1 - self.order[rank]) - 1


def one_error(index: RightwardIndex, flat: np.ndarray, starts: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asking word, listed word) where the first ``exact`` symbols agree and the rest differs by exactly one error."""
    size = np.diff(starts)
    query = np.arange(len(size))
    lo, hi = index.extend(_DELIMITER, np.zeros(len(size), np.int64), np.full(len(size), index.wide - 1))
    for at in range(int(exact.max(initial=0))):
        going = at < exact[query]
        a, b = index.extend(flat[np.minimum(starts[query] + at, len(flat) - 1)], lo, hi)
        lo, hi = np.where(going, a, lo), np.where(going, b, hi)
        alive = lo < hi
        query, lo, hi = query[alive], lo[alive], hi[alive]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at, spent = exact[query], np.zeros(len(query), bool)
    while len(query):
        over = at == size[query]
        a, b = index.extend(_DELIMITER, lo[over & spent], hi[over & spent])
        hit = a < b
        found.append((query[over & spent][hit], index.word_at(a[hit])))
        now = np.where(over, 0, flat[np.minimum(starts[query] + at, len(flat) - 1)])
        then = np.where(at + 1 < size[query], flat[np.minimum(starts[query] + at + 1, len(flat) - 1)], 0)
        q, p, s, x, y = [], [], [], [], []

        def push(rows, place, error, a, b, keep):
            q.append(query[rows][keep]), p.append(place[keep]), s.append(error[keep]), x.append(a[keep]), y.append(b[keep])

        rows = np.flatnonzero(~over)
        a, b = index.extend(now[rows], lo[rows], hi[rows])
        push(rows, at[rows] + 1, spent[rows], a, b, a < b)
        # One symbol of the asking word left out; of equal neighbours only the last.
        rows = np.flatnonzero(~over & ~spent & (now != then))
        push(rows, at[rows] + 1, np.ones(len(rows), bool), lo[rows], hi[rows], np.ones(len(rows), bool))
        # Another symbol in its place, or one more before it; an equal one goes in after it.
        free = np.flatnonzero(~spent)
        which, letter = index.symbols(lo[free], hi[free])
        rows = free[which]
        a, b = index.extend(letter, lo[rows], hi[rows])
        other = letter != now[rows]
        push(rows, at[rows], np.ones(len(rows), bool), a, b, other)
        push(rows, at[rows] + 1, np.ones(len(rows), bool), a, b, other & ~over[rows])
        query, at, spent, lo, hi = (np.concatenate(z) for z in (q, p, s, x, y))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (query, query)


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words as symbols, and the starts."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    # a-z and the letters from U+00C0 on, told apart by their place in that order.
    return np.where(points < 0xC0, points - ord("a") + _FIRST, points - 0xC0 + 26 + _FIRST).astype(np.uint8), starts


def search_shard(rows: pa.Table) -> pa.Table:
    """Near pairs of a shard: words that ask from their first or second half, among the words listed."""
    words, keys = rows.column("word").to_pylist(), rows.column("key").to_pylist()
    n, listed, asks = rows.column("n").to_pylist(), rows.column("listed").to_pylist(), rows.column("asks").to_pylist()
    known = {w: c for w, c, is_listed in zip(words, n, listed) if is_listed}
    names = list(known)
    pairs: dict[tuple[str, str], int] = {}
    for side, step in (("p", 1), ("s", -1)):
        asking = {w: len(k) - 1 for w, k, is_asked in zip(words, keys, asks) if is_asked and k[0] == side}
        if not asking or not names:
            continue
        index = RightwardIndex(*_symbols([w[::step] for w in names]))
        queries = list(asking)
        a, b = one_error(index, *_symbols([w[::step] for w in queries]), np.fromiter(asking.values(), np.int64, len(asking)))
        pairs.update(((queries[i], names[j]), known[names[j]]) for i, j in zip(a.tolist(), b.tolist()))
    return pa.Table.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()), pa.array(list(pairs.values()), pa.int64())], schema=_PAIRS)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, misprint: int | None = None) -> DataFrame:
    """(word, n) of all texts. With ``misprint``, a run loses a code point wherever that divides the crc32 of its id and itself."""
    run = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0)))
    cased = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), run.alias("_run"))
    low = F.when(F.col("_run").rlike(KEPT_CAPITALS), F.translate("_run", UPPER, LOWER)).otherwise(F.lower("_run"))
    each = cased.select("_id", low.alias("word"))
    if misprint:
        hashed = each.withColumn("_h", F.crc32(F.concat_ws(":", "_id", "word").cast("binary")))
        at = (F.col("_h") % F.length("word")).cast("int")
        shorter = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        each = hashed.select(F.when(F.col("_h") % misprint == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_length)
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _posts(words: DataFrame, least_length: int) -> DataFrame:
    """(key, word, n, asks): the halves under which a word is listed, and whether it asks there itself."""
    size = F.length("word")

    def keys(side: str, cut) -> Column:
        own = cut(size)
        reach = F.array_distinct(F.array(own, cut(F.greatest(size - 1, F.lit(least_length))), cut(size + 1)))
        return F.transform(reach, lambda k: F.struct(F.concat(F.lit(side), F.substring(F.col("word"), F.lit(1), k) if side == "p" else F.substring(F.col("word"), size - k + 1, k)).alias("key"), (k == own).alias("asks")))

    first = keys("p", lambda s: F.floor(s / 2).cast("int"))
    second = keys("s", lambda s: (s - F.floor(s / 2)).cast("int"))
    return words.select("word", "n", F.explode(F.concat(first, second)).alias("_k")).select("_k.key", "word", "n", "_k.asks")


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, near, near_n): every ordered pair of near words of ``words`` (word, n), words distinct and of [a-zU+00C0-U+00FF]."""
    posts = stage(_posts(words, least_length), "posts")
    blocks = stage(posts.groupBy("key").agg(F.count("*").alias("_size"), F.sum(F.col("asks").cast("long")).alias("_asking")).where("_size > 1 and _asking > 0"), "blocks")
    cut = F.ceil(F.col("_size") / shard_words)
    total = blocks.select((F.col("_size") * cut + F.col("_asking") * (cut - 1)).alias("_rows")).agg(F.sum("_rows")).first()[0] or 0
    shards = -(-total // shard_words) or 1
    own, parts = F.pmod(F.xxhash64("word"), F.col("_parts")), F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)
    cells = F.transform(parts, lambda i: F.struct(i.alias("q"), own.alias("t"), F.lit(True).alias("listed"), (F.col("asks") & (i == own)).alias("asks")))
    more = F.transform(F.filter(parts, lambda i: F.col("asks") & (i != own)), lambda i: F.struct(own.alias("q"), i.alias("t"), F.lit(False).alias("listed"), F.lit(True).alias("asks")))
    dealt = posts.join(blocks.select("key", cut.cast("long").alias("_parts")), "key").select("key", "word", "n", F.explode(F.concat(cells, more)).alias("_c"))
    dealt = dealt.select(F.pmod(F.xxhash64("key", "_c.q", "_c.t"), F.lit(shards)).alias("shard"), "key", "word", "n", "_c.listed", "_c.asks")
    return dealt.groupBy("shard").applyInArrow(search_shard, "word string, near string, near_n bigint").distinct()


def spelling_variants(words: DataFrame, factor: int = FACTOR, least_length: int = LEAST_LENGTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per row of ``words`` (word, n): word, n, n_near, form, form_n, root.

    ``form`` is the near word of largest n (ties: least in code-point order) if that is ``factor`` times the word's
    own or more, else null; ``root`` is the last form reached, the word itself if none. Each form is more frequent
    than its word, so forms have no cycles. No words give no rows.
    """
    words = stage(words, "words")
    around = near_words(words, least_length, shard_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best"))
    enough = -F.col("_best.less") >= F.col("n") * factor
    shaped = words.join(around, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("_best.near")).alias("form"), F.when(enough, -F.col("_best.less")).alias("form_n"))
    shaped = stage(shaped, "shaped")
    hops = shaped.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # every round doubles the reach
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        hops = stage(hops.join(further, "root", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved")), "roots")
        if hops.where("_moved").isEmpty():
            break
    return shaped.join(hops.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_sql(misprint: int = 199) -> str:
    """DuckDB SQL of ``spelling_variants(vocabulary(documents, misprint=misprint))``: words meet under themselves with one place cut or open."""
    return f"""
with recursive crc as materialized (select list(v order by i) as t from (select i, list_reduce(range(0, 8), lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as v from range(0, 256) r(i))),
runs as (select coalesce(cast(doc_id as varchar), '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') as run from documents),
letters as (select run, id || ':' || run as key from runs where length(run) >= {LEAST_LENGTH}),
hashed as (select run, xor(list_reduce(flatten(list_transform(string_split(key, ''), lambda x: case when unicode(x) < 128 then [cast(unicode(x) as bigint)] else [cast(192 + (unicode(x) >> 6) as bigint), cast(128 + (unicode(x) & 63) as bigint)] end)), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) as h from letters, crc),
printed as (select case when h % {misprint} = 0 then run[1 : h % length(run)] || run[h % length(run) + 2 :] else run end as word from hashed),
words as materialized (select word, count(*) as n from printed where length(word) >= {LEAST_LENGTH} group by word having count(*) >= {LEAST_COUNT}),
places as materialized (select word, unnest(range(0, length(word))) as i from words),
cut as materialized (select distinct word, word[1 : i] || word[i + 2 :] as short from places),
opened as materialized (select word, word[1 : i] || '_' || word[i + 2 :] as pattern from places),
near as materialized (
  select a.word, b.word as other from opened a join opened b on a.pattern = b.pattern and a.word <> b.word
  union select word, short from cut semi join words w on w.word = cut.short
  union select short, word from cut semi join words w on w.word = cut.short),
best as (select a.word, count(*) as n_near, min({{'less': -w.n, 'other': other}}) as top from near a join words w on w.word = a.other group by a.word),
shaped as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -top.less >= {FACTOR} * w.n then top.other end as form, case when -top.less >= {FACTOR} * w.n then -top.less end as form_n from words w left join best b on b.word = w.word),
chain as (select word, word as root, 0 as step from words union all select c.word, s.form, c.step + 1 from chain c join shaped s on s.word = c.root where s.form is not null),
last as (select word, max_by(root, step) as root from chain group by word)
select s.word, cast(n as bigint) as n, cast(n_near as bigint) as n_near, form, cast(form_n as bigint) as form_n, root from shaped s join last l on l.word = s.word"""
