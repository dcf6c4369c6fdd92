"""Announcement evidence: listings, corrections, title scans and notice fields.

Rows are announcements ``security_id, channel, title, epoch_ms, adjunct_url``. One
security may hold a third of them, so nothing here orders a whole security in one
task: as-of and running values go through time buckets, distinct values are made
distinct by shuffle, and pairs are built by equality only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import duplicate_keys, union_all, violation
from tidemark.functions.scalars import cash_identity, clean_fragment, compact_date, date_identity, epoch_ms_to_local, minute_text, normalize_page_text
from tidemark.operators.asof import asof_join, running_sum
from tidemark.staging import stage

# Word lists and patterns of the announcement vocabulary.
BUSINESS_PATTERN = "权益分派|分红|派息|现金红利|送股|转增|配股"
CORRECTION_PATTERN = "更正|补充|订正"
KEYWORDS = ("权益分派", "分红派息", "现金红利", "配股", "转增", "送股", "合并", "吸收合并", "要约", "退市", "更正", "补充")
BUSINESS_TERMS = ("分红", "派息", "股息", "分派", "利润分配", "权益分派", "现金分红", "红利", "除权", "除息", "送股", "转增", "配股", "缩股")
# Business words listed beside a correction.
MATCHED_TERMS = "权益分派|分红|派息|现金红利|送股|转增|配股"
IMPLEMENTATION_TITLES = ("实施公告", "实施的公告", "股息派发公告", "支付H股股东")
PROPOSAL_TITLES = ("利润分配方案", "利润分配预案", "利润分配的公告", "分派方案", "分红方案", "分红回报规划", "现金分红计划")
IMPLEMENTATION_MARKER = "实施公告"
IMPLEMENTATION_LISTING = "权益分派实施公告"
TIME_KEY = "(?i)time|date"
CORRECTION_WINDOW_DAYS = 15


def _contains_any(title: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(title, F.lit(word))
    return hit


# -- corrections ----------------------------------------------------------------------


def correction_anchor(corrections: DataFrame, anchors: DataFrame, days: int = CORRECTION_WINDOW_DAYS) -> DataFrame:
    """Latest notice of the same security within a closed number of days before each correction."""
    left = corrections.withColumn("_at", epoch_ms_to_local("epoch_ms"))
    right = anchors.select("security_id", epoch_ms_to_local("epoch_ms").alias("_anchor_at"), F.col("epoch_ms").alias("anchor_ms"), F.col("adjunct_url").alias("anchor_url"))
    joined = asof_join(left, right, ["security_id"], "_at", "_anchor_at", ["anchor_ms", "anchor_url"], bucket="day")
    near = F.col("epoch_ms") - F.col("asof.anchor_ms") <= days * 86_400_000
    return joined.withColumns({"anchor_url": F.when(near, F.col("asof.anchor_url")), "anchor_ms": F.when(near, F.col("asof.anchor_ms"))}).drop("asof", "_at")


def listing_union(rows: DataFrame, days: int = CORRECTION_WINDOW_DAYS) -> tuple[DataFrame, DataFrame]:
    """One row per (security, url): channels, correction routes and anchor; plus violations.

    Channels ch1 and ch2 list distributions. A ch3 title joins when it names both a
    correction and a distribution (route A) or corrects soon after a listed notice
    (route B).
    """
    key = ["security_id", "adjunct_url"]
    listed = rows.where(F.col("channel").isin("ch1", "ch2"))
    base = listed.groupBy(*key).agg(
        F.min(F.struct("channel", "epoch_ms", "title")).alias("_f"), F.sort_array(F.collect_set("channel")).alias("_channels")
    ).select(*key, F.col("_f.title").alias("title"), F.col("_f.epoch_ms").alias("epoch_ms"), F.col("_channels"))
    anchors = base.where(~F.col("title").rlike(CORRECTION_PATTERN))
    third = rows.where((F.col("channel") == "ch3") & F.col("title").rlike(CORRECTION_PATTERN)).select(*key, "title", "epoch_ms")
    routed = correction_anchor(third, anchors, days).withColumn("_a", F.col("title").rlike(BUSINESS_PATTERN))
    kept = routed.where(F.col("_a") | F.col("anchor_url").isNotNull())
    corrections = kept.groupBy(*key).agg(
        F.min(F.struct("epoch_ms", "title")).alias("_f"),
        F.max("_a").alias("_route_a"),
        F.min("anchor_url").alias("anchor_url"),
        F.max("anchor_url").alias("_other"),
    )
    joined = base.join(corrections, key, "full_outer")
    channels = F.when(F.col("_f").isNotNull(), F.array_union(F.coalesce("_channels", F.array().cast("array<string>")), F.array(F.lit("ch3_corr")))).otherwise(F.col("_channels"))
    routes = F.array_compact(F.array(F.when(F.col("_route_a"), F.lit("A")), F.when(F.col("anchor_url").isNotNull(), F.lit("B"))))
    epoch = F.coalesce("epoch_ms", "_f.epoch_ms")
    listing = joined.select(
        *key,
        F.coalesce("title", "_f.title").alias("title"),
        epoch.alias("epoch_ms"),
        minute_text(epoch_ms_to_local(epoch)).alias("disclosure_ts"),
        F.array_join(F.sort_array(channels), "|").alias("channels"),
        F.array_join(routes, "|").alias("correction_routes"),
        F.coalesce("anchor_url", F.lit("")).alias("anchor_url"),
    )
    return listing, violation(corrections, F.col("anchor_url") != F.col("_other"), "CONFLICTING_ANCHORS", key, F.col("_other"))


def nearest_titles(corrections: DataFrame, candidates: DataFrame, k: int = 3, bucket: str = "day") -> DataFrame:
    """k notices of the same security closest in time to each correction, ties by text.

    Candidates get two ordinals per security, one per tie direction. A correction's
    nearest k lie among the k ordinals before and the k after it, so each correction
    meets exactly 2k candidates, by equality.
    """
    base = candidates.select("security_id", F.date_trunc("minute", epoch_ms_to_local("epoch_ms")).alias("ts"), "title")
    base = base.groupBy("security_id", "ts", "title").agg(F.count(F.lit(1)).alias("copies"))
    # Copies of one text are interchangeable: keep at most k of each, which loses no answer.
    base = base.select("security_id", "ts", "title", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)))).alias("copy"))
    dated = base.withColumns({"_b": F.date_trunc(bucket, "ts"), "_one": F.lit(1), "text": F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm"), "title")})

    def ordinal(down: bool) -> DataFrame:
        # Descending text inside a minute needs its own order key.
        ranked = dated.withColumn("_t", F.row_number().over(Window.partitionBy("security_id", "ts").orderBy(F.col("text").desc() if down else F.col("text").asc(), "copy")))
        return running_sum(ranked, ["security_id"], ["_b"], ["ts", "_t"], "_one", "n")

    before, after = ordinal(True), ordinal(False)
    asked = corrections.withColumn("_ts", F.date_trunc("minute", epoch_ms_to_local("epoch_ms")))
    placed = asof_join(asked, before.select("security_id", "ts", "n"), ["security_id"], "_ts", "ts", ["n"], bucket=bucket, tie_break=["n"])
    placed = placed.withColumn("_p", F.coalesce(F.col("asof.n"), F.lit(0))).drop("asof")
    wanted = placed.withColumn("n", F.explode(F.sequence(F.col("_p") - (k - 1), F.col("_p") + k)))
    near = union_all(
        [
            wanted.where(F.col("n") <= F.col("_p")).join(before.select("security_id", "n", "ts", "text"), ["security_id", "n"]),
            wanted.where(F.col("n") > F.col("_p")).join(after.select("security_id", "n", "ts", "text"), ["security_id", "n"]),
        ]
    )
    distance = F.abs(F.timestamp_diff("MINUTE", F.col("_ts"), F.col("ts")))
    order = Window.partitionBy("security_id", "adjunct_url").orderBy("distance", "text")
    ranked = near.withColumn("distance", distance).withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    return ranked.select("security_id", "adjunct_url", "position", "text", F.col("distance").alias("minutes"))


def matched_terms(title: Column, pattern: str = MATCHED_TERMS) -> Column:
    """Business words of a title, each once, in order, joined by |."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(title, F.lit(pattern), F.lit(0)))), "|")


# -- titles -----------------------------------------------------------------------------


def missing_announcements(all_titles: DataFrame, listing: DataFrame, terms: Sequence[str] = BUSINESS_TERMS) -> DataFrame:
    """Business-term titles whose attachment is not listed."""
    candidates = all_titles.where(_contains_any(F.col("title"), terms))
    return candidates.join(listing.select("adjunct_url"), "adjunct_url", "left_anti")


def title_violations(all_titles: DataFrame, expected_ids: DataFrame, terms: Sequence[str] = BUSINESS_TERMS) -> DataFrame:
    """Repeated or conflicting attachments among the candidates, and universe differences."""
    candidates = all_titles.where(_contains_any(F.col("title"), terms))
    seen = all_titles.select("security_id").distinct()
    expected = expected_ids.select("security_id").distinct()
    return union_all(
        [
            duplicate_keys(candidates, ["adjunct_url"], "DUPLICATE_URL"),
            violation(expected.join(seen, "security_id", "left_anti"), F.lit(True), "SECURITY_WITHOUT_TITLES", ["security_id"]),
            violation(seen.join(expected, "security_id", "left_anti"), F.lit(True), "SECURITY_NOT_EXPECTED", ["security_id"]),
        ]
    )


def keyword_hits(titles: DataFrame, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """One row per (keyword, title) hit, tested inside the scan."""
    words = F.filter(F.array(*[F.lit(w) for w in keywords]), lambda w: F.contains(F.col("title"), w))
    return titles.select(F.explode(words).alias("keyword"), "security_id", "title", minute_text(epoch_ms_to_local("epoch_ms")).alias("disclosure_ts"), "adjunct_url")


def classify_title(title: Column) -> Column:
    return F.when(_contains_any(title, IMPLEMENTATION_TITLES), "实施类").when(_contains_any(title, PROPOSAL_TITLES), "方案预案类").otherwise("其他")


def collect_titles(rows: DataFrame, marker: str = "实施") -> DataFrame:
    """Titles with a marker, one per (security, window, url), with their channels."""
    kept = rows.where(F.contains(F.col("title"), F.lit(marker)))
    first = F.min(F.struct("channel", "epoch_ms", "title"))
    grouped = kept.groupBy("security_id", "window", "adjunct_url").agg(first.alias("_f"), F.array_join(F.sort_array(F.collect_set("channel")), "|").alias("channel"))
    return grouped.select("security_id", "window", "adjunct_url", F.col("_f.title").alias("title"), minute_text(epoch_ms_to_local("_f.epoch_ms")).alias("disclosure_ts"), "channel")


def target_matches(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of a target's security whose title holds all of its fragments."""
    joined = rows.join(targets, "security_id")
    return joined.where(F.forall("title_fragments", lambda f: F.contains(F.col("title"), f)))


def target_status(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with whether it landed, how often, and its first attachment."""
    found = target_matches(rows, targets).groupBy("target_id").agg(F.count(F.lit(1)).alias("matches"), F.min("adjunct_url").alias("first_url"))
    return targets.join(found, "target_id", "left").select("target_id", F.col("matches").isNotNull().alias("landed"), F.coalesce("matches", F.lit(0).cast("bigint")).alias("matches"), "first_url")


def select_implementation_notices(listing: DataFrame, required_title: str | None, marker: str = IMPLEMENTATION_MARKER) -> tuple[DataFrame, DataFrame]:
    """Notices by marker or exact title, and a violation when the required title is absent."""
    exact = F.lit(False) if required_title is None else F.col("title") == required_title
    picked = listing.where(F.contains(F.col("title"), F.lit(marker)) | exact)
    counted = listing.agg(F.count_if(exact).alias("_n"))
    return picked, violation(counted, (F.col("_n") == 0) & F.lit(required_title is not None), "REQUIRED_NOTICE_MISSING", ["_n"], F.lit(required_title))


def sequence_in_day(listing: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """n-th document per security and disclosure date in listing order, and its file name.

    ``existing`` shifts the sequence behind documents already numbered that day.
    """
    day = F.substring("disclosure_ts", 1, 10)
    rows = listing.withColumns({"_day": day, "_minute": F.col("disclosure_ts"), "_one": F.lit(1)})
    numbered = running_sum(rows, ["security_id", "_day"], ["_minute"], ["epoch_ms", "adjunct_url"], "_one", "sequence")
    if existing is not None:
        taken = existing.groupBy("security_id", F.substring("disclosure_ts", 1, 10).alias("_day")).agg(F.count(F.lit(1)).alias("_taken"))
        numbered = numbered.join(taken, ["security_id", "_day"], "left").withColumn("sequence", F.col("sequence") + F.coalesce("_taken", F.lit(0))).drop("_taken")
    name = F.concat(F.col("security_id"), F.lit("_"), F.col("_day"), F.lit("_"), F.col("sequence").cast("string"), F.lit(".pdf"))
    return numbered.withColumn("file_name", name).drop("_day", "_minute", "_one")


def listing_summary(listing: DataFrame, small_bytes: int = 10 * 1024) -> DataFrame:
    """Per security: documents, implementation titles, after-close disclosures, small files."""
    local = epoch_ms_to_local("epoch_ms")
    after = local > local.cast("date").cast("timestamp_ntz") + F.expr("interval 15 hours")
    size = F.count_if(F.col("bytes") <= small_bytes) if "bytes" in listing.columns else F.lit(None).cast("bigint")
    stats = listing.groupBy("security_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.contains(F.col("title"), F.lit(IMPLEMENTATION_LISTING))).alias("implementation_titles"),
        F.count_if(after).alias("after_1500"),
        size.alias("small_files"),
    )
    return stats.withColumns({"other_titles": F.col("documents") - F.col("implementation_titles"), "after_1500_ratio": F.round(F.col("after_1500") / F.col("documents"), 6)})


def time_precision(rows: DataFrame) -> DataFrame:
    """Distribution of the time of day and of the stamp's digit count."""
    local = epoch_ms_to_local("epoch_ms")
    return rows.groupBy(F.date_format(local, "HH:mm:ss").alias("time_of_day"), F.length(F.col("epoch_ms").cast("string")).alias("digits")).agg(F.count(F.lit(1)).alias("records")).withColumn("is_midnight", F.col("time_of_day") == "00:00:00")


def time_like_fields(records: DataFrame, column: str = "json", examples: int = 5, buckets: int = 256) -> DataFrame:
    """Per time- or date-like key: rows that have it, non-null values, smallest examples.

    Distinct values are made by shuffle and cut to ``examples`` per (key, hash bucket)
    before they meet, so a hot key never gathers its values.
    """
    parsed = records.select(F.explode(F.from_json(F.col(column), "map<string,string>")).alias("field", "value")).where(F.col("field").rlike(TIME_KEY))
    counts = parsed.groupBy("field").agg(F.count(F.lit(1)).alias("present"), F.count("value").alias("non_null"))
    values = parsed.where(F.col("value").isNotNull()).distinct().withColumn("_b", F.pmod(F.xxhash64("value"), F.lit(buckets)))
    few = values.withColumn("_n", F.row_number().over(Window.partitionBy("field", "_b").orderBy("value"))).where(F.col("_n") <= examples)
    fewer = few.withColumn("_m", F.row_number().over(Window.partitionBy("field").orderBy("value"))).where(F.col("_m") <= examples)
    listed = fewer.groupBy("field").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("examples"))
    return counts.join(listed, "field", "left").select("field", "present", "non_null", F.coalesce("examples", F.lit("")).alias("examples"))


# -- notice fields ---------------------------------------------------------------------------

# Date spellings and field patterns of implementation notices.
NUMERIC_DATE = r"\d{4}\s*(?:年|[./-])\s*\d{1,2}\s*(?:月|[./-])\s*\d{1,2}\s*日?"
CHINESE_DATE = r"[〇零一二三四五六七八九]{4}\s*年\s*[〇零一二三四五六七八九十]{1,3}\s*月\s*[〇零一二三四五六七八九十]{1,3}\s*日"
DATE = f"(?:{NUMERIC_DATE}|{CHINESE_DATE})"
TAX = r"\s*[（(]\s*含\s*税(?:\s*[）)])?"
CASH_PATTERNS = (
    r"((?:[AＡ]\s*股\s*)?每\s*股(?:(?!每\s*股|每\s*10\s*股|元|。|；).){0,60}?\d+(?:\.\d+)?\s*元)" + TAX,
    r"(每\s*10\s*股(?:(?!每\s*股|每\s*10\s*股|元|。|；).){0,70}?\d+(?:\.\d+)?\s*元(?:人民币)?(?:现金)?)" + TAX,
)
RECORD_DATE_PATTERNS = (rf"股权登记日(?:为|是)?\s*(?:：|:)?\s*({DATE})",)
EX_DATE_PATTERNS = (
    rf"除权\s*(?:（\s*息\s*）|\(\s*息\s*\)|除息)?\s*日(?:为|是)?\s*(?:：|:)?\s*({DATE})",
    rf"除息日(?:为|是)?\s*(?:：|:)?\s*({DATE})",
    rf"除权除息日(?:为|是)?\s*(?:：|:)?\s*({DATE})",
)
DATE_TABLE = (
    r"股权登记日\s+最后交易日\s+除权\s*(?:（\s*息\s*）|\(\s*息\s*\))\s*日(?:(?!一、|二、|三、).){0,100}?"
    rf"[AＡ]\s*股\s+({DATE})\s+(?:-|－|—|–)\s+({DATE})"
)
ANNOUNCEMENT_PATTERN = rf"(?:董事会|监事会)\s*({DATE})"
SHARE_PATTERNS = (
    r"(每\s*10\s*股\s*(?:派\s*)?送(?:红)?股\s*\d+(?:\.\d+)?\s*股)",
    r"(每\s*10\s*股\s*转\s*增\s*\d+(?:\.\d+)?\s*股)",
    r"(每\s*股\s*(?:派\s*)?送(?:红)?股\s*\d+(?:\.\d+)?\s*股)",
    r"(每\s*股\s*转\s*增\s*\d+(?:\.\d+)?\s*股)",
)
NO_SHARE_PATTERNS = (
    r"(不\s*(?:派\s*)?送\s*红\s*股\s*[,，、;；]?\s*(?:也\s*)?不\s*(?:以|进行)?\s*(?:资本\s*)?公\s*积\s*金\s*转\s*增\s*股\s*本)",
    r"(不\s*(?:派\s*)?送\s*股\s*[,，、;；]?\s*(?:也\s*)?不\s*转\s*增)",
    r"(仅\s*进行\s*现金\s*红利\s*分配\s*[,，、;；]?\s*无\s*资本\s*公\s*积\s*金\s*转\s*增\s*股\s*本等其他形式的分配方案)",
)
NO_TRANSFER_PATTERNS = (
    r"(不\s*以\s*(?:资本\s*)?公\s*积\s*金\s*转\s*增\s*股\s*本)",
    r"(不\s*进行\s*(?:资本\s*)?公\s*积\s*金\s*转\s*增\s*股\s*本)",
)
REVIEW_MARKERS = "未找到|多个|已取消|更正公告|至少一个|仅明确|NONZERO"
BOUNDARY = 160
MATCH = "array<struct<start:int,stop:int,value:string>>"


def find_matches(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a pattern with their positions (0-based), inside the JVM.

    The text splits at the matches; adding up gap and match lengths gives positions,
    so repeated phrases keep their own places. Three linear scans, no backtracking gap.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value")), lambda x: x["hit"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(MATCH).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("stop"), x["value"].alias("value")))).cast(MATCH).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


# How far a citation reaches around its match: to a sentence end, without one, and where that is too short.
SENTENCE_REACH, OPEN_REACH, WIDE_REACH, SHORTEST_QUOTE = 240, 120, 80, 15


def quote_around(text: Column, start: Column, stop: Column) -> Column:
    """The sentence around a match, within fixed reaches, like a person would cite it."""

    def cut(a: Column, b: Column) -> Column:
        return F.substring(text, a + 1, b - a)

    end = F.length(text)
    back = F.greatest(F.lit(0), start - SENTENCE_REACH)
    tail = F.regexp_replace(cut(back, start), "(?s)^.*[。；！？]", "")
    open_ = F.length(tail) == start - back
    left = F.when(open_, F.greatest(F.lit(0), start - OPEN_REACH)).otherwise(start - F.length(tail))
    head = F.regexp_extract(cut(stop, F.least(end, stop + SENTENCE_REACH)), "(?s)^([^。；！？]*[。；！？])", 1)
    right = F.when(head == "", F.least(end, stop + OPEN_REACH)).otherwise(stop + F.length(head))
    quote = clean_fragment(cut(left, right))
    wide = clean_fragment(cut(F.greatest(F.lit(0), start - WIDE_REACH), F.least(end, stop + WIDE_REACH)))
    return F.when(F.length(quote) < SHORTEST_QUOTE, wide).otherwise(quote)


def _candidates(pages: DataFrame, field: str, anchors: Sequence[str], patterns: Sequence[str], group: int = 1, base: int = 0) -> DataFrame:
    """Matches of a field's patterns; pages without any of its anchor words are skipped unscanned."""
    pages = pages.where(_contains_any(F.col("text"), anchors))
    found = [F.transform(find_matches(F.col("text"), p, group), lambda m, i=i: F.struct(F.lit(base + i).alias("pattern"), m["start"].alias("start"), m["stop"].alias("stop"), m["value"].alias("value"))) for i, p in enumerate(patterns)]
    rows = pages.select("doc_id", "page_no", "text", F.explode(F.concat(*found) if len(found) > 1 else found[0]).alias("m"))
    # A quote never reaches further than 240 characters: cut that context out of the page once.
    origin = F.greatest(F.lit(0), F.col("m.start") - 240)
    return rows.select(
        "doc_id", F.lit(field).alias("field"), "page_no", F.col("m.pattern").alias("pattern"), F.col("m.start").alias("start"), F.col("m.value").alias("value"),
        (F.col("m.start") - origin).alias("_from"), (F.col("m.stop") - origin).alias("_to"),
        F.substring(F.col("text"), origin + 1, F.col("m.stop") + 240 - origin).alias("_ctx"),
    )


def page_borders(clean: DataFrame) -> DataFrame:
    """The end of a page and the beginning of the next one, its page number left out, as a text of the later page."""
    # Page n meets page n + 1 by an equality join, so a long document is not one task's window; only the two cuts are moved.
    tail = F.expr(f"substring(text, greatest(1, length(text) - {BOUNDARY - 1}), {BOUNDARY})")
    head = F.substring(F.regexp_replace("text", r"^\d{1,3}\s+", ""), 1, BOUNDARY)
    ends = clean.select("doc_id", "page_no", tail.alias("_tail"))
    starts = clean.select("doc_id", (F.col("page_no") - 1).alias("page_no"), head.alias("_head"))
    return ends.join(starts, ["doc_id", "page_no"]).select("doc_id", (F.col("page_no") + 1).alias("page_no"), F.concat("_tail", F.lit(" "), "_head").alias("text"))


def notice_candidates(pages: DataFrame) -> DataFrame:
    """Every candidate value of every field with page and quote, exact repeats removed."""
    # Every field scans the same normalised pages, so they are written once.
    clean = stage(pages.select("doc_id", "page_no", normalize_page_text("text").alias("text")).repartition("doc_id", "page_no"), "notice-text")
    borders = page_borders(clean)
    parts = [
        _candidates(clean, "cash", ("含",), CASH_PATTERNS),
        _candidates(clean, "record_date", ("股权登记日",), RECORD_DATE_PATTERNS),
        _candidates(clean, "record_date", ("最后交易日",), (DATE_TABLE,), 1, 90),
        _candidates(clean, "ex_date", ("除权", "除息日"), EX_DATE_PATTERNS),
        _candidates(clean, "ex_date", ("最后交易日",), (DATE_TABLE,), 2, 90),
        _candidates(clean, "announcement_date", ("董事会", "监事会"), (ANNOUNCEMENT_PATTERN,)),
        _candidates(borders, "announcement_date", ("董事会", "监事会"), (ANNOUNCEMENT_PATTERN,), 1, 90),
        _candidates(clean, "nonzero_share", ("送", "增"), SHARE_PATTERNS),
        _candidates(clean, "no_share", ("不", "仅"), NO_SHARE_PATTERNS),
        _candidates(clean, "no_transfer", ("不",), NO_TRANSFER_PATTERNS),
    ]
    # Ten scans meet here; written once, the citation logic is planned once, not per scan.
    matches = stage(union_all(parts), "notice-matches")
    every = matches.withColumn("value", clean_fragment("value")).withColumn("quote", quote_around(F.col("_ctx"), F.col("_from"), F.col("_to")))
    # Border pages come after all pages in the search order.
    order = F.struct((F.col("pattern") >= 90).cast("int").alias("late"), "page_no", "pattern", "start")
    return every.groupBy("doc_id", "field", "value", "quote").agg(F.min(order).alias("ord")).select("doc_id", "field", "value", "quote", "ord", F.col("ord.page_no").alias("page_no"))


def extract_notice_fields(pages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One row per document: cash, record, ex and announcement date, share ratio, notes, confidence.

    ``pages`` is ``(doc_id, page_no, text)``; ``titles`` adds ``(doc_id, title)`` notes.
    """
    found = notice_candidates(pages)
    # Words that make a cash candidate the one being paid.
    actual = (F.contains(F.col("quote"), F.lit("实际")) | F.contains(F.col("quote"), F.lit("本次权益分派方案"))).cast("int")
    implementing = (F.contains(F.col("quote"), F.lit("实施")) | F.contains(F.col("quote"), F.lit("每股分配比例"))).cast("int")
    identity = F.when(F.col("field") == "cash", cash_identity("value")).when(F.col("field").isin("record_date", "ex_date"), date_identity("value")).otherwise(compact_date("value"))
    keyed = found.withColumns({"identity": identity, "pick": F.struct("value", "quote", "page_no")})
    first = F.min_by("pick", F.col("ord"))
    best_cash = F.min_by("pick", F.struct((-actual).alias("a"), (-implementing).alias("i"), F.col("page_no"), F.col("ord")))
    last_page = F.min_by("pick", F.struct((-F.col("page_no")).alias("p"), F.col("ord")))
    per_field = keyed.groupBy("doc_id", "field").agg(first.alias("first"), best_cash.alias("best"), last_page.alias("last"), F.min("identity").alias("lo"), F.max("identity").alias("hi"), F.collect_set(F.when(F.col("field") == "cash", F.col("value"))).alias("values"))

    def of(field: str, value: Column) -> Column:
        return F.max(F.when(F.col("field") == field, value))

    varied = F.col("lo") != F.col("hi")
    wide = per_field.groupBy("doc_id").agg(
        of("cash", F.col("best")).alias("cash"),
        of("cash", varied).alias("cash_varied"),
        of("cash", F.array_join(F.sort_array("values"), "|")).alias("cash_values"),
        of("record_date", F.when(~varied, F.col("first"))).alias("record"),
        of("record_date", varied).alias("record_varied"),
        of("ex_date", F.when(~varied, F.col("first"))).alias("ex"),
        of("ex_date", varied).alias("ex_varied"),
        of("announcement_date", F.col("last")).alias("announced"),
        of("announcement_date", varied).alias("announced_varied"),
        of("nonzero_share", F.col("first")).alias("nonzero"),
        of("no_share", F.col("first")).alias("none"),
        of("no_transfer", F.col("first")).alias("transfer"),
    )
    documents = pages.select("doc_id").distinct()
    rows = documents.join(wide, "doc_id", "left")
    title = F.lit(None).cast("string")
    if titles is not None:
        rows = rows.join(titles.select("doc_id", "title"), "doc_id", "left")
        title = F.col("title")
    rows = rows.withColumn("share", F.coalesce("nonzero", "none", "transfer"))
    incomplete = F.col("cash").isNull() | F.col("record").isNull() | F.col("ex").isNull() | F.col("announced").isNull() | F.col("share").isNull()
    missing_record = F.when(F.coalesce("record_varied", F.lit(False)), F.lit("股权登记日存在多个不同日期候选")).when(F.col("record").isNull(), F.lit("未找到明确股权登记日原句"))
    missing_ex = F.when(F.coalesce("ex_varied", F.lit(False)), F.lit("除权除息日存在多个不同日期候选")).when(F.col("ex").isNull(), F.lit("未找到明确除权除息日原句"))
    pages_of = {"announcement_date": "announced", "cash": "cash", "ex_date": "ex", "record_date": "record", "share_ratio": "share"}
    located = F.concat_ws(",", *[F.when(F.col(source).isNotNull(), F.concat(F.lit(f"{name}=p"), F.col(f"{source}.page_no").cast("string"))) for name, source in pages_of.items()])
    # The texts of the notes, here and in the two above.
    notes = F.concat_ws(
        "; ",
        F.when(F.col("cash").isNull(), F.lit("未找到明确带含税标识的每股或每10股现金分红原句")),
        F.when(F.col("cash_varied"), F.concat(F.lit("PDF含多个税前现金金额候选:"), F.col("cash_values"), F.lit(",已按原文中的实际/本次实施表述优先提取"))),
        F.when(F.contains(F.col("cash.quote"), F.lit("扣税后")), F.lit("现金分红原句同时列示扣税后金额,本列仅摘录含税值")),
        missing_record,
        missing_ex,
        F.when(F.col("announced").isNull(), F.lit("未找到董事会/监事会落款发布日期原句")),
        F.when(F.col("announced_varied"), F.lit("PDF出现多个董事会/监事会落款日期,已提取末页落款供人工确认")),
        F.when(F.col("nonzero").isNotNull(), F.lit("发现明确非零送转候选")),
        F.when(F.col("share").isNull(), F.lit("未找到明确不送不转或非零送转比例原句")),
        F.when(F.col("nonzero").isNull() & F.col("none").isNull() & F.col("transfer").isNotNull(), F.lit("原文仅明确不转增,未明确写出不送股")),
        F.when(F.contains(title, F.lit("已取消")), F.lit("公告标题标记已取消,须与同日更新后公告人工并读")),
        F.when(F.contains(title, F.lit("更正公告")), F.lit("更正公告仅提取其自身明确列示字段,未从被更正公告补全")),
        F.when(F.col("nonzero").isNotNull(), F.lit("NONZERO_SHARE_TRANSFER_REVIEW_REQUIRED")),
        F.when(incomplete, F.lit("至少一个必核字段未从本PDF唯一提取")),
        F.when(located != "", F.concat(F.lit("PDF页码:"), located)),
    )
    picked = {"cash_dividend_raw": "cash", "record_date": "record", "ex_date": "ex", "announcement_date": "announced", "share_ratio": "share"}
    columns = []
    for name, source in picked.items():
        columns.append(F.coalesce(F.col(f"{source}.value"), F.lit("")).alias(name))
        columns.append(F.coalesce(F.col(f"{source}.quote"), F.lit("")).alias(f"{name.removesuffix('_raw')}_quote"))
        columns.append(F.col(f"{source}.page_no").alias(f"{name.removesuffix('_raw')}_page"))
    noted = rows.withColumn("notes", notes)
    return noted.select("doc_id", *columns, "notes", F.when(F.col("notes").rlike(REVIEW_MARKERS), "low").otherwise("high").alias("extraction_confidence"))


def extraction_summary(fields: DataFrame, by: str = "security_id") -> DataFrame:
    """Per security: documents, confidence split, non-zero share notices, incomplete rows."""
    empty = F.lit(False)
    for name in ("cash_dividend_raw", "ex_date", "record_date", "announcement_date", "share_ratio"):
        empty = empty | (F.col(name) == "")
    return fields.groupBy(by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("extraction_confidence") == "high").alias("high"),
        F.count_if(F.col("extraction_confidence") == "low").alias("low"),
        F.count_if(F.contains(F.col("notes"), F.lit("NONZERO_SHARE"))).alias("nonzero_share"),
        F.count_if(empty).alias("incomplete"),
    )
