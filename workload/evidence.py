"""Announcement and notice queries over all events, documents and actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.operators import evidence as evd
from tidemark.sources.readers import announcement_violations, fingerprint_violations, read_announcements
from workload.cases import case

# Channel of a derived announcement: ch1 and ch2 list distributions (some in both), ch3 lists all titles.
ROWS_SQL = """
select security_id, 'ch3' as channel, title_kind as title, epoch_ms, adjunct_url, event_id from announcements_src
union all select security_id, 'ch1', title_kind, epoch_ms, adjunct_url, event_id from announcements_src where title_kind = '2023年年度权益分派实施公告'
union all select security_id, 'ch2', title_kind, epoch_ms, adjunct_url, event_id from announcements_src where title_kind in ('关于现金红利派发的公告') or (title_kind = '2023年年度权益分派实施公告' and event_id % 3 = 0)"""
LOCAL = "(timestamp '1970-01-01 00:00:00' + to_milliseconds(epoch_ms) + interval 8 hours)"


def _rows(t):
    def build():
        src = t.announcements.withColumnRenamed("title_kind", "title")
        title = F.col("title")
        listed = F.when(title == "2023年年度权益分派实施公告", F.when(F.col("event_id") % 3 == 0, F.array(F.lit("ch1"), F.lit("ch2"))).otherwise(F.array(F.lit("ch1")))).when(title == "关于现金红利派发的公告", F.array(F.lit("ch2"))).otherwise(F.array().cast("array<string>"))
        channels = F.explode(F.concat(F.array(F.lit("ch3")), listed))
        return src.select("security_id", channels.alias("channel"), "title", "epoch_ms", "adjunct_url", "event_id")

    return t.landed("announcements", build)


def _corrections(t):
    return t.announcements.withColumnRenamed("title_kind", "title").where(F.col("title").rlike(evd.CORRECTION_PATTERN))


def _anchors(t):
    return _rows(t).where("channel in ('ch1', 'ch2')").select("security_id", "title", "epoch_ms", "adjunct_url").distinct()


STEP = (("anns", ROWS_SQL),)
ANCHORED = """
select security_id, adjunct_url, title, epoch_ms, (select max({'e': a.epoch_ms, 'u': a.adjunct_url}) from (select distinct security_id, epoch_ms, adjunct_url from anns where channel in ('ch1', 'ch2')) a
    where a.security_id = c.security_id and a.epoch_ms <= c.epoch_ms and c.epoch_ms - a.epoch_ms <= {days} * 86400000)['u'] as anchor_url
from (select * from anns where channel = 'ch3' and regexp_matches(title, '更正|补充|订正')) c"""


@case("j13_correction_anchor", "security_id:s adjunct_url:s anchor_url:s", ANCHORED.replace("{days}", "15"), ("announcements_src",), STEP)
def _(t):
    return evd.correction_anchor(_corrections(t), _anchors(t))


@case("j13_correction_anchor_one_day", "security_id:s adjunct_url:s anchor_url:s", ANCHORED.replace("{days}", "1"), ("announcements_src",), STEP)
def _(t):
    return evd.correction_anchor(_corrections(t), _anchors(t), 1)


NEAR = f"""
select security_id, adjunct_url, position, text, minutes from (
  select c.security_id, c.adjunct_url, a.text, abs(date_diff('minute', a.ts, c.ts)) as minutes, row_number() over (partition by c.security_id, c.adjunct_url order by abs(date_diff('minute', a.ts, c.ts)), a.text) as position
  from (select *, date_trunc('minute', {LOCAL}) as ts from anns where channel = 'ch3' and regexp_matches(title, '更正|补充|订正')) c
  join (select security_id, date_trunc('minute', {LOCAL}) as ts, concat(strftime(date_trunc('minute', {LOCAL}), '%Y-%m-%d %H:%M'), ' ', title) as text from (select distinct security_id, title, epoch_ms, adjunct_url from anns where channel in ('ch1', 'ch2'))) a on a.security_id = c.security_id)
where position <= 3"""


@case("j14_nearest_titles", "security_id:s adjunct_url:s position:i text:s minutes:i", NEAR, ("announcements_src",), STEP)
def _(t):
    return evd.nearest_titles(_corrections(t), _anchors(t))


@case(
    "j14_matched_terms",
    "security_id:s adjunct_url:s terms:s",
    f"select security_id, adjunct_url, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(title, '{evd.MATCHED_TERMS}'))), '|'), '') as terms from anns",
    ("announcements_src",),
    STEP,
)
def _(t):
    return _rows(t).select("security_id", "adjunct_url", evd.matched_terms(F.col("title")).alias("terms"))


@case(
    "j15_verify_fingerprints",
    "check:s key:s detail:s",
    """with l as (select concat('doc_', doc_id, '.pdf') as f, doc_id, n_chars * 3 as b from documents)
select 'FILE_MISSING' as "check", f as "key", '' as detail from l where doc_id % 13 = 0
union all select 'SHA256_MISMATCH', f, sha256(cast(doc_id as varchar)) from l where doc_id % 13 <> 0 and doc_id % 7 = 0
union all select 'SIZE_MISMATCH', f, cast(b as varchar) from l where doc_id % 13 <> 0 and doc_id % 5 = 0
union all select 'FILE_TOO_SMALL', f, cast(b as varchar) from l where doc_id % 13 <> 0 and b < 10240""",
)
def _(t):
    docs = t.base("documents").select(F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf")).alias("file_name"), "doc_id", (F.col("n_chars") * 3).alias("bytes"), F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"))
    listing = docs.select("file_name", F.when(F.col("doc_id") % 7 == 0, "0").otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("doc_id") % 5 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"))
    return fingerprint_violations(listing, docs.where("doc_id % 13 <> 0"))


@case(
    "j16_missing_announcements",
    "security_id:s title:s adjunct_url:s",
    "select security_id, title, adjunct_url from anns where channel = 'ch3' and regexp_matches(title, '分红|派息|股息|分派|利润分配|红利|除权|除息|送股|转增|配股|缩股') and adjunct_url not in (select adjunct_url from anns where channel in ('ch1', 'ch2'))",
    ("announcements_src",),
    STEP,
)
def _(t):
    return evd.missing_announcements(_rows(t).where("channel = 'ch3'"), _anchors(t))


@case(
    "j16_title_violations",
    "check:s key:s detail:s",
    """select 'DUPLICATE_URL' as "check", adjunct_url as "key", cast(count(*) as varchar) as detail from anns where regexp_matches(title, '分红|派息|股息|分派|利润分配|红利|除权|除息|送股|转增|配股|缩股') group by adjunct_url having count(*) > 1
       union all select 'SECURITY_NOT_EXPECTED', security_id, '' from (select distinct security_id from anns) where security_id not in (select security_id from anns where channel = 'ch1' and event_id % 5 = 0)""",
    ("announcements_src",),
    STEP,
)
def _(t):
    return evd.title_violations(_rows(t), _rows(t).where("channel = 'ch1' and event_id % 5 = 0"))


@case(
    "j17_keyword_hits",
    "keyword:s security_id:s title:s disclosure_ts:s adjunct_url:s",
    f"""select k as keyword, security_id, title, strftime({LOCAL}, '%Y-%m-%d %H:%M') as disclosure_ts, adjunct_url from anns
        join (values ('权益分派'), ('分红派息'), ('现金红利'), ('配股'), ('转增'), ('送股'), ('合并'), ('吸收合并'), ('要约'), ('退市'), ('更正'), ('补充')) w(k) on contains(title, k) where channel = 'ch3'""",
    ("announcements_src",),
    STEP,
)
def _(t):
    return evd.keyword_hits(_rows(t).where("channel = 'ch3'"))


@case(
    "j19_target_status",
    "target_id:s landed:b matches:i first_url:s",
    """select t.target_id, count(a.adjunct_url) > 0 as landed, count(a.adjunct_url) as matches, min(a.adjunct_url) as first_url
       from (select concat('T', security_id) as target_id, security_id, '更正' as f, case when count(*) % 2 = 0 then '实施' else '股东大会' end as g from anns where channel = 'ch3' group by security_id) t
       left join (select * from anns where channel = 'ch3') a on a.security_id = t.security_id and contains(a.title, t.f) and contains(a.title, t.g) group by 1""",
    ("announcements_src",),
    STEP,
)
def _(t):
    rows = _rows(t).where("channel = 'ch3'")
    other = F.when(F.count(F.lit(1)) % 2 == 0, "实施").otherwise("股东大会")
    targets = rows.groupBy("security_id").agg(F.array(F.lit("更正"), other).alias("title_fragments")).withColumn("target_id", F.concat(F.lit("T"), "security_id"))
    return evd.target_status(rows, targets)


@case(
    "q10_listing_union",
    "security_id:s adjunct_url:s title:s disclosure_ts:s channels:s correction_routes:s anchor_url:s",
    f"""with b as (select security_id, adjunct_url, min(title) as title, min(epoch_ms) as epoch_ms, string_agg(distinct channel, '|' order by channel) as channels from anns where channel in ('ch1', 'ch2') group by 1, 2),
c as (select *, regexp_matches(title, '权益分派|分红|派息|现金红利|送股|转增|配股') as a from anchored)
select security_id, adjunct_url, title, strftime({LOCAL}, '%Y-%m-%d %H:%M') as disclosure_ts, channels, '' as correction_routes, '' as anchor_url from b
union all select security_id, adjunct_url, title, strftime({LOCAL}, '%Y-%m-%d %H:%M'), 'ch3_corr', concat_ws('|', case when a then 'A' end, case when anchor_url is not null then 'B' end), coalesce(anchor_url, '') from c where a or anchor_url is not null""",
    ("announcements_src",),
    (*STEP, ("anchored", ANCHORED.replace("{days}", "15"))),
)
def _(t):
    return evd.listing_union(_rows(t))[0]


@case(
    "q11_listing_summary",
    "security_id:s documents:i implementation_titles:i other_titles:i after_1500:i after_1500_ratio:f6",
    f"""select security_id, count(*) as documents, count(*) filter (contains(title, '权益分派实施公告')) as implementation_titles, count(*) filter (not contains(title, '权益分派实施公告')) as other_titles,
       count(*) filter (cast({LOCAL} as time) > time '15:00:00') as after_1500, round((count(*) filter (cast({LOCAL} as time) > time '15:00:00')) / count(*), 6) as after_1500_ratio from anns where channel = 'ch3' group by 1""",
    ("announcements_src",),
    STEP,
)
def _(t):
    return evd.listing_summary(_rows(t).where("channel = 'ch3'"))


@case(
    "q12_time_precision",
    "time_of_day:s digits:i records:i is_midnight:b",
    f"select strftime({LOCAL}, '%H:%M:%S') as time_of_day, length(cast(epoch_ms as varchar)) as digits, count(*) as records, strftime({LOCAL}, '%H:%M:%S') = '00:00:00' as is_midnight from anns group by 1, 2, 4",
    ("announcements_src",),
    STEP,
)
def _(t):
    return evd.time_precision(_rows(t))


@case(
    "q13_time_like_fields",
    "field:s present:i non_null:i examples:s",
    """with v as (select 'announcementTime' as field, cast(epoch_ms as varchar) as value from announcements_src union all select 'pubDate', case when event_id % 4 = 0 then null else security_id end from announcements_src),
d as (select field, value, row_number() over (partition by field order by value) as n from (select distinct field, value from v where value is not null))
select v.field, count(*) as present, count(v.value) as non_null, max(e.x) as examples from v join (select field, string_agg(value, '|' order by value) as x from d where n <= 5 group by 1) e on e.field = v.field group by 1""",
    ("announcements_src",),
)
def _(t):
    record = F.struct(F.col("epoch_ms").cast("string").alias("announcementTime"), F.when(F.col("event_id") % 4 != 0, F.col("security_id")).alias("pubDate"), F.col("title_kind").alias("title"))
    return evd.time_like_fields(t.announcements.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("json")))


@case(
    "q14_classify_title",
    "adjunct_url:s title_type:s",
    "select adjunct_url, case when contains(title_kind, '实施公告') then '实施类' when contains(title_kind, '利润分配预案') then '方案预案类' else '其他' end as title_type from announcements_src",
    ("announcements_src",),
)
def _(t):
    return t.announcements.withColumn("title_type", evd.classify_title(F.col("title_kind")))


@case(
    "q15_collect_titles",
    "security_id:s window:s adjunct_url:s title:s disclosure_ts:s channel:s",
    f"select security_id, strftime({LOCAL}, '%Y-%m') as \"window\", adjunct_url, min(title) as title, min(strftime({LOCAL}, '%Y-%m-%d %H:%M')) as disclosure_ts, string_agg(distinct channel, '|' order by channel) as channel from anns where contains(title, '实施') group by 1, 2, 3",
    ("announcements_src",),
    STEP,
)
def _(t):
    return evd.collect_titles(_rows(t).withColumn("window", F.date_format(sc.epoch_ms_to_local("epoch_ms"), "yyyy-MM")))


@case("f18_select_implementation_notices", "security_id:s adjunct_url:s title:s", "select security_id, adjunct_url, title from anns where channel = 'ch3' and (contains(title, '实施公告') or title = '关于召开股东大会的通知')", ("announcements_src",), STEP)
def _(t):
    return evd.select_implementation_notices(_rows(t).where("channel = 'ch3'"), "关于召开股东大会的通知")[0]


@case(
    "w2_sequence_in_day",
    "security_id:s adjunct_url:s sequence:i file_name:s",
    f"""select security_id, adjunct_url, n as sequence, concat(security_id, '_', d, '_', n, '.pdf') as file_name from (
  select security_id, adjunct_url, strftime({LOCAL}, '%Y-%m-%d') as d, row_number() over (partition by security_id, strftime({LOCAL}, '%Y-%m-%d') order by epoch_ms, adjunct_url)
    + (select count(*) from anns x where x.channel = 'ch1' and x.security_id = a.security_id and strftime(timestamp '1970-01-01 08:00:00' + to_milliseconds(x.epoch_ms), '%Y-%m-%d') = strftime(timestamp '1970-01-01 08:00:00' + to_milliseconds(a.epoch_ms), '%Y-%m-%d')) as n
  from (select * from anns where channel = 'ch3') a)""",
    ("announcements_src",),
    STEP,
)
def _(t):
    rows = _rows(t).withColumn("disclosure_ts", sc.minute_text(sc.epoch_ms_to_local("epoch_ms")))
    return evd.sequence_in_day(rows.where("channel = 'ch3'"), rows.where("channel = 'ch1'"))


@case(
    "s4_read_announcements",
    "security_id:s channel:s epoch_ms:i disclosure_ts:s adjunct_url:s page_total:i",
    f"select a.security_id, a.channel, a.epoch_ms, strftime({LOCAL}, '%Y-%m-%d %H:%M') as disclosure_ts, a.adjunct_url, t.n as page_total from anns a join (select security_id, channel, count(*) as n from anns group by 1, 2) t on t.security_id = a.security_id and t.channel = a.channel",
    ("announcements_src",),
    STEP,
)
def _(t):
    return read_announcements(t.spark, _landed_json(t), multi_line=False)


def _landed_json(t):
    def build():
        rows = _rows(t)
        totals = rows.groupBy("security_id", "channel").agg(F.count(F.lit(1)).alias("_n"))
        record = F.struct(F.concat(F.lit(" "), "title", F.lit(" ")).alias("announcementTitle"), F.col("epoch_ms").alias("announcementTime"), F.concat(F.lit("http://static.cninfo.com.cn/"), "adjunct_url").alias("adjunctUrl"))
        pages = rows.groupBy("security_id", "channel", F.floor(F.col("event_id") / 200).alias("_page")).agg(F.collect_list(record).alias("announcements")).join(totals, ["security_id", "channel"])
        response = F.struct(F.col("_n").alias("totalRecordNum"), "announcements")
        from tidemark.staging import checkpoint_root
        import uuid

        path = f"{checkpoint_root(t.spark)}/announcements-{uuid.uuid4().hex}"
        pages.select(F.col("security_id").alias("code"), "channel", F.array(response).alias("responses")).write.json(path)
        return path

    return t.shared("announcement_json", build)


@case("s4_announcement_violations", "check:s key:s detail:s", """select 'x' as "check", 'x' as "key", 'x' as detail from announcements_src where event_id < 0""", ("announcements_src",))
def _(t):
    return announcement_violations(read_announcements(t.spark, _landed_json(t), multi_line=False))


@case(
    "s4_broken_announcements",
    "check:s key:s detail:s",
    """with r as (select security_id, channel, event_id, trim(title) as title from anns),
n as (select security_id, channel, count(*) as n from r group by 1, 2)
select 'TOTAL_MISMATCH' as "check", concat(security_id, '/', channel) as "key", concat(n + 1, ' vs ', n) as detail from n
union all select 'MISSING_URL', concat(security_id, '/', channel), title from r where event_id % 7 = 0
union all select 'MISSING_TIME', concat(security_id, '/', channel), title from r where event_id % 11 = 0""",
    ("announcements_src",),
    STEP,
)
def _(t):
    """Every channel announces one record too many, and some records lack their url or their time."""
    rows = _rows(t)
    totals = rows.groupBy("security_id", "channel").agg((F.count(F.lit(1)) + 1).alias("page_total"))
    broken = rows.select(
        "security_id", "channel", F.lit(0).alias("page"), F.trim("title").alias("title"), F.lit(True).alias("has_record"),
        F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("adjunct_url")).alias("adjunct_url"),
        F.when(F.col("event_id") % 11 != 0, F.col("epoch_ms")).alias("epoch_ms"),
    )
    return announcement_violations(broken.join(totals, ["security_id", "channel"]))


# -- notices --------------------------------------------------------------------------------

NOTICE_KEY = "concat_ws('|', security_id, cast(ex_date as varchar), action_type, cast(available_at as varchar))"
NOTICE = f"""
select cast(concat('0x', substr(md5({NOTICE_KEY}), 1, 12)) as bigint) as doc_id, security_id, ex_date, record_date, coalesce(announcement_date, ex_date) as ann, cash_dividend_per_share as cash, share_ratio as ratio, action_type
from actions where action_type in ('CASH_DIVIDEND', 'STOCK_DIVIDEND')"""
CASH_TEXT = "concat('每股派发现金红利', cast(cast(cash as decimal(18,2)) as varchar), '元')"
SHARE_TEXT = "case when action_type = 'STOCK_DIVIDEND' then concat('每10股转增', cast(cast(ratio * 10 as decimal(18,1)) as varchar), '股') when doc_id % 4 = 0 then '不以资本公积金转增股本' else '不送红股,不以公积金转增股本' end"


def _notices(t):
    """Notices numbered by a hash of their action."""
    rows = t.actions.where("action_type in ('CASH_DIVIDEND', 'STOCK_DIVIDEND')")
    key = F.concat_ws("|", "security_id", F.col("ex_date").cast("string"), "action_type", F.col("available_at").cast("string"))
    number = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("bigint")
    return rows.select(number.alias("doc_id"), "security_id", "ex_date", "record_date", F.coalesce("announcement_date", "ex_date").alias("ann"), F.col("cash_dividend_per_share").alias("cash"), F.col("share_ratio").alias("ratio"), "action_type")


def _pages(t):
    """Each notice begins with the text of a document; every document is a notice without any field too."""
    def build():
        texts = t.base("documents").select("doc_id", "text", "source")
        count = texts.count()
        notices = _notices(t).withColumn("_doc", F.col("doc_id") % count).join(texts.select(F.col("doc_id").alias("_doc"), "text"), "_doc", "left").drop("_doc")
        day = lambda c: F.concat_ws("", F.year(c).cast("string"), F.lit("年"), F.month(c).cast("string"), F.lit("月"), F.dayofmonth(c).cast("string"), F.lit("日"))
        amount = F.concat(F.lit("每股派发现金红利"), F.col("cash").cast("decimal(18,2)").cast("string"), F.lit("元"))
        share = F.when(F.col("action_type") == "STOCK_DIVIDEND", F.concat(F.lit("每10股转增"), (F.col("ratio") * 10).cast("decimal(18,1)").cast("string"), F.lit("股"))).when(F.col("doc_id") % 4 == 0, "不以资本公积金转增股本").otherwise("不送红股,不以公积金转增股本")
        second = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("另一股权登记日："), day(F.date_sub("record_date", 30)), F.lit("。"))).otherwise("")
        first_page = F.concat(F.coalesce("text", F.lit("")), F.lit("。本次权益分派方案："), amount, F.lit("（含税）。"), share, F.lit("。股权登记日：　"), day("record_date"), F.lit("，除权除息日："), day("ex_date"), F.lit("。"), second, F.when(F.col("doc_id") % 3 == 0, F.lit("特此公告。某某股份有限公司董事会")).otherwise(""))
        last_page = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("2 ")).otherwise(F.lit("特此公告。某某股份有限公司董事会 ")), day("ann"))
        page = F.posexplode(F.array(first_page, last_page))
        pages = notices.select("doc_id", "security_id", page.alias("p", "text"))
        free = texts.select((-1 - F.col("doc_id")).alias("doc_id"), F.col("source").alias("security_id"), F.lit(1).alias("page_no"), "text")
        return pages.select("doc_id", "security_id", (F.col("p") + 1).alias("page_no"), "text").unionByName(free).repartition("doc_id")

    return t.landed("notice_pages", build)


DAY = "concat(year({c}), '年', month({c}), '月', day({c}), '日')"
# The cited sentences, after white space is made plain.
DATES_QUOTE = f"concat('股权登记日： ', {DAY.format(c='record_date')}, '，除权除息日：', {DAY.format(c='ex_date')}, '。')"
FIELDS_SQL = f"""
select doc_id, {CASH_TEXT} as cash_dividend_raw, case when doc_id % 5 = 0 then '' else {DAY.format(c='record_date')} end as record_date, {DAY.format(c='ex_date')} as ex_date, {DAY.format(c='ann')} as announcement_date,
  {SHARE_TEXT} as share_ratio, case when doc_id % 5 = 0 or action_type = 'STOCK_DIVIDEND' or doc_id % 4 = 0 then 'low' else 'high' end as extraction_confidence,
  concat('本次权益分派方案：', {CASH_TEXT}, '（含税）。') as cash_dividend_quote, case when doc_id % 5 = 0 then '' else {DATES_QUOTE} end as record_date_quote, {DATES_QUOTE} as ex_date_quote from notices"""


FREE_NOTES = "; ".join(
    (
        "未找到明确带含税标识的每股或每10股现金分红原句",
        "未找到明确股权登记日原句",
        "未找到明确除权除息日原句",
        "未找到董事会/监事会落款发布日期原句",
        "未找到明确不送不转或非零送转比例原句",
        "至少一个必核字段未从本PDF唯一提取",
    )
)
NOTES_SQL = f"""
select doc_id, concat_ws('; ', case when doc_id % 5 = 0 then '股权登记日存在多个不同日期候选' end, case when stock then '发现明确非零送转候选' end,
  case when not stock and doc_id % 4 = 0 then '原文仅明确不转增,未明确写出不送股' end, case when stock then 'NONZERO_SHARE_TRANSFER_REVIEW_REQUIRED' end,
  case when doc_id % 5 = 0 then '至少一个必核字段未从本PDF唯一提取' end,
  concat('PDF页码:announcement_date=p2,cash=p1,ex_date=p1', case when doc_id % 5 = 0 then '' else ',record_date=p1' end, ',share_ratio=p1')) as notes
from (select doc_id, action_type = 'STOCK_DIVIDEND' as stock from notices)"""


@case(
    "q16_extract_notice_fields",
    "doc_id:i cash_dividend_raw:s record_date:s ex_date:s announcement_date:s share_ratio:s cash_dividend_page:i announcement_date_page:i extraction_confidence:s notes:s cash_dividend_quote:s record_date_quote:s ex_date_quote:s",
    f"""select f.*, 1 as cash_dividend_page, 2 as announcement_date_page, n.notes from ({FIELDS_SQL}) f join ({NOTES_SQL}) n using (doc_id)
       union all select -1 - doc_id, '', '', '', '', '', 'low', '', '', '', null, null, '{FREE_NOTES}' from documents""",
    ("actions",),
    (("notices", NOTICE),),
)
def _(t):
    return _fields(t)


def _fields(t):
    return evd.extract_notice_fields(_pages(t))


@case(
    "q17_extraction_summary",
    "security_id:s documents:i high:i low:i nonzero_share:i incomplete:i",
    f"""select security_id, count(*) as documents, count(*) filter (extraction_confidence = 'high') as high, count(*) filter (extraction_confidence = 'low') as low, count(*) filter (action_type = 'STOCK_DIVIDEND') as nonzero_share, count(*) filter (record_date = '') as incomplete
       from ({FIELDS_SQL}) f join (select doc_id, security_id, action_type from notices) n using (doc_id) group by 1
       union all select source, count(*), 0, count(*), 0, count(*) from documents group by 1""",
    ("actions",),
    (("notices", NOTICE),),
)
def _(t):
    ids = _pages(t).select("doc_id", "security_id").distinct()
    return evd.extraction_summary(_fields(t).join(ids, "doc_id"))


@case(
    "x7_normalize_url",
    "page_id:i path:s",
    "select page_id, ltrim(url, '/') as path from (select page_id, case when page_id % 2 = 0 then regexp_replace(concat('http://static.cninfo.com.cn//', url), '^.*?static\\.cninfo\\.com\\.cn/', '') else concat('//', page_id) end as url from pages)",
)
def _(t):
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://static.cninfo.com.cn//"), "url")).otherwise(F.concat(F.lit("//"), "page_id"))
    return t.base("pages").select("page_id", sc.normalize_url(raw).alias("path"))


@case(
    "x8_normalize_disclosure_ts",
    "event_id:i normalized:s",
    """select event_id, case when event_id % 5 = 4 then null else strftime(ts, '%Y-%m-%d %H:%M') end as normalized from events""",
)
def _(t):
    # Four accepted spellings and one that is refused.
    ts = F.col("ts").cast("timestamp_ntz")
    spelled = (
        F.when(F.col("event_id") % 5 == 0, F.date_format(ts, "yyyy/M/d H:mm"))
        .when(F.col("event_id") % 5 == 1, F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
        .when(F.col("event_id") % 5 == 2, F.date_format(ts, "yyyy-MM-dd HH:mm"))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit(" "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss")))
        .otherwise(F.date_format(ts, "dd.MM.yyyy HH:mm"))
    )
    return t.base("events").select("event_id", sc.normalize_disclosure_ts(spelled).alias("normalized"))


@case(
    "x9_page_text",
    "doc_id:i page_text:s compact:s",
    "select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as page_text, translate(regexp_replace(text, '\\s+', '', 'g'), './', '--') as compact from documents",
)
def _(t):
    return t.base("documents").select("doc_id", sc.normalize_page_text("text").alias("page_text"), sc.compact_date("text").alias("compact"))
