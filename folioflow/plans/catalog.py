"""The library's queries over the driver's tables, by name, with the same in DuckDB's SQL.

Every name says what is computed on these tables; the operator that computes it is named in its docstring's key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import activity as A
from ..operators import integrity as I
from ..operators import intervals as V
from ..operators import publication as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _student():
    return F.col("event_type") != "error"

@query("""with e as (select user_id, ts, lead(ts) over (partition by user_id order by ts, event_id) nxt from events where event_type <> 'error')
select user_id, sum(least((epoch_us(coalesce(nxt, ts)) - epoch_us(ts)) // 1000, 600000))::bigint capped_ms from e group by user_id""")
def activity_capped_time(t):
    """W1"""
    return A.capped_time(t("events"), counted=_student())


@query("""with e as (select user_id, ts, lead(ts) over (partition by user_id order by ts, event_id) nxt from events where event_type <> 'error')
select user_id, sum(least((epoch_us(coalesce(nxt, ts)) - epoch_us(ts)) // 1000, 21600000))::bigint capped_ms from e group by user_id""")
def activity_capped_time_6h(t):
    """W1"""
    return A.capped_time(t("events"), counted=_student(), cap_ms=21_600_000)


@query(
    "select user_id, arg_max(event_type, row(ts, event_id)) last_state, bool_or(event_type = 'purchase') ever from events group by user_id"
)
def activity_last_state(t):
    """W2"""
    return A.last_state(t("events"), ever=F.col("event_type") == "purchase")


@query(
    "select event_id, ts, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1"
)
def activity_first_only(t):
    """W3"""
    return A.first_only(t("events").select("event_id", "ts", "user_id", "event_type"))


@query("""select event_id, user_id, value from (select *, max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) m from events)
where m is null or value > m""")
def activity_running_max(t):
    """W3"""
    return A.running_max(t("events")).select("event_id", "user_id", "value")


@query(
    "select user_id, json_extract_string(props, '$.k') k, arg_max(event_type, row(ts, event_id)) latest, count(*) visits from events group by all"
)
def activity_position_latest(t):
    """E6"""
    return A.position_latest(t("events").withColumn("k", F.get_json_object("props", "$.k")), ["user_id", "k"], "event_type")


@query(
    """select event_id, user_id, greatest(n - 30, 0)::bigint omitted from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn, count(*) over (partition by user_id) n from events) where rn <= 30"""
)
def activity_tail30(t):
    """The digest's tail is the feature"""
    return A.tail(t("events").select("event_id", "user_id", "ts")).select("event_id", "user_id", "omitted")


@query(
    "select event_id, user_id, seq::int seq from (select *, row_number() over (partition by user_id order by ts, event_id) seq from events) where seq > 20"
)
def activity_after_cursor(t):
    """T4"""
    return A.after_cursor(t("events").select("event_id", "user_id", "ts"), 20).select("event_id", "user_id", "seq")


@query("""select event_id, case when not coalesce(event_type in ('view', 'click', 'purchase'), false) then 'type' when not coalesce(user_id is not null, false) then 'user'
when not coalesce(value >= 1, false) then 'value' when not coalesce(json_extract_string(props, '$.k')::int between 1 and 80, false) then 'position' end reason,
reason is null accepted from events""")
def activity_validate(t):
    """C13, T10"""
    k = F.get_json_object("props", "$.k").cast("int")
    rules = [
        ("type", F.col("event_type").isin("view", "click", "purchase")), ("user", F.col("user_id").isNotNull()),
        ("value", F.col("value") >= 1), ("position", k.between(1, 80))
    ]
    return A.validate(t("events"), rules).select("event_id", "reason", "accepted")


@query("""select event_id, not (ts <= timestamp '2024-01-20 00:00:00' and ts >= timestamp '2024-01-10 00:00:00') clamped,
case when ts <= timestamp '2024-01-20 00:00:00' and ts >= timestamp '2024-01-10 00:00:00' then ts else timestamp '2024-01-20 00:00:00' end ts from events""")
def activity_clamped_time(t):
    """T2"""
    return A.clamp_time(t("events"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 10).select("event_id", "clamped", "ts")


@query("""with e as (select user_id, ts, lead(ts) over (partition by user_id order by ts, event_id) nxt from events where event_type <> 'error'),
s as (select user_id, sum(least((epoch_us(coalesce(nxt, ts)) - epoch_us(ts)) // 1000, 600000))::bigint ms from e group by user_id)
select user_id, case when ms <= 0 then '—' when ms < 60000 then '<1 min' else '~' || ((ms + 30000) // 60000)::varchar || ' min' end label from s""")
def activity_time_label(t):
    """F16 over W1"""
    return A.capped_time(t("events"), counted=_student()).select("user_id", T.minutes(F.col("capped_ms")).alias("label"))


@query("""with recursive e as (select user_id, ts, event_id, row_number() over (partition by user_id order by ts, event_id) rn from events),
f as (select user_id, rn, ts at_ts, event_id last_accepted, 1::bigint accepted from e where rn = 1 union all
select e.user_id, e.rn, case when epoch_us(e.ts) - epoch_us(f.at_ts) >= 86400000000 then e.ts else f.at_ts end,
case when epoch_us(e.ts) - epoch_us(f.at_ts) >= 86400000000 then e.event_id else f.last_accepted end,
f.accepted + (epoch_us(e.ts) - epoch_us(f.at_ts) >= 86400000000)::bigint from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
select user_id, arg_max(accepted, rn) accepted, arg_max(last_accepted, rn) last_accepted from f group by user_id""")
def activity_rate_limited(t):
    """T5"""
    return A.rate_limited(t("events"), 86_400_000)


@query("""select e.event_id, (select arg_max(p.event_id, row(p.ts, p.event_id)) from events p where p.user_id = e.user_id and p.event_type = 'purchase' and (p.ts < e.ts or (p.ts = e.ts and p.event_id < e.event_id))) found
from events e where e.event_type = 'error'""")
def activity_asof_purchase(t):
    """the join of D15 and D16"""
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    return A.asof_last(e, F.col("event_type") == "error", F.col("event_type") == "purchase", "event_id").select("event_id", "found")


@query("select event_type, json_extract_string(props, '$.k') k, count(*) n from events group by all")
def activity_link_counts(t):
    """E5"""
    return A.link_counts(t("events").withColumn("k", F.get_json_object("props", "$.k")), ["event_type", "k"])


@query("select user_id, list_sort(list_distinct(list(event_type))) kinds from events group by user_id")
def activity_distinct_sets(t):
    """E12"""
    return t("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))


ENTITIES_SQL = "replace(replace(replace(replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
BARE_SQL = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '(?i)</(?:p|div|h[1-6]|li|ul|ol|tr|table|article|nav|section|title|header|footer)\s*>|<br\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g')"


@query(f"select page_id, {ENTITIES_SQL.format(x=BARE_SQL)} body from pages")
def page_plain_text(t):
    """F2"""
    return t("pages").select("page_id", T.html_text(F.col("html")).alias("body"))


@query(
    """select page_id, unnest(range(1, len(h) + 1))::int pos, unnest(h) href from (select page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) h from pages) where len(h) > 0"""
)
def page_links(t):
    """hrefs of pages"""
    found = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return t("pages").select("page_id", F.posexplode(found).alias("pos", "href")).select("page_id", (F.col("pos") + 1).alias("pos"), "href")


@query(
    r"select lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) scheme, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) in ('', 'http', 'https', 'mailto') safe, count(*) n from pages group by all"
)
def page_scheme_counts(t):
    """F10"""
    return t("pages").select(
        F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).alias("scheme"), T.safe_scheme(F.col("url")).alias("safe")
    ).groupBy("scheme", "safe").agg(F.count(F.lit(1)).alias("n"))


@query("""with x as (select page_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x)), lambda x: x not in ('table','caption','colgroup','col','thead','tbody','tfoot','tr','th','td','p','br')))) v from pages)
select page_id, len(v)::int n, array_to_string(v, ',') tags from x""")
def page_tag_violations(t):
    """F11"""
    return t("pages").select("page_id", T.table_violations(F.col("html")).alias("v")).select(
        "page_id", F.size("v").alias("n"), F.array_join("v", ",").alias("tags")
    )


@query(r"select regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) path, count(*) n from pages group by 1 having count(*) > 1")
def page_path_collisions(t):
    """E8"""
    return I.duplicates(t("pages").select(F.regexp_extract("url", r"^[^:]*://[^/?#]*([^?#]*)", 1).alias("path")), ["path"])


SLUG_SQL = """regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"""
TITLES_SQL = f"(select page_id, {ENTITIES_SQL.format(x="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} title from pages)"


def _titles(t):
    return t("pages").select("page_id", T.decode_entities(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"))


@query(f"select page_id, case when {SLUG_SQL} = '' then 'publication' else {SLUG_SQL} end slug from {TITLES_SQL}")
def page_slug(t):
    """F1"""
    return _titles(t).select("page_id", T.slugify(F.col("title")).alias("slug"))


@query(f"""with s as (select page_id, case when {SLUG_SQL} = '' then 'publication' else {SLUG_SQL} end slug from {TITLES_SQL}),
n as (select *, row_number() over (partition by slug order by page_id) k from s) select page_id, slug, case when k = 1 then slug else slug || '-' || k::varchar end "name" from n""")
def page_slug_suffix(t):
    """W9"""
    return I.collision_suffix(_titles(t).select("page_id", T.slugify(F.col("title")).alias("slug")), "slug", "page_id")


@query(
    r"select page_id, regexp_extract(url, '^([^#]*)', 1) doc, case when contains(url, '#') then regexp_extract(url, '#(.*)$', 1) else '' end fragment from pages"
)
def page_address(t):
    """F3"""
    return t("pages").select("page_id", T.split_address(F.col("url")).alias("a")).select("page_id", "a.doc", "a.fragment")


@query(
    "select doc_id, line, count(*) n from (select doc_id, unnest(string_split(text, chr(10))) line from documents) group by all having count(*) > 1"
)
def doc_repeated_lines(t):
    """E8"""
    return I.duplicates(t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")), ["doc_id", "line"])


@query("select sha256(text) digest, count(*) n from documents group by 1 having count(*) > 1")
def doc_duplicates(t):
    """E8, F18"""
    return I.duplicates(t("documents").select(F.sha2("text", 256).alias("digest")), ["digest"])


@query("select doc_id, case when length(text) > 120 then left(text, 120) || '…' else text end excerpt from documents")
def doc_excerpt(t):
    """G3"""
    return t("documents").select("doc_id", T.excerpt(F.col("text"), 120).alias("excerpt"))


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def doc_uncovered(t):
    """D10"""
    return I.dangling(t("documents").select("doc_id"), t("labels"), ["doc_id"])


@query("""with a as (select doc_id, sha256(text) h from documents), b as (select doc_id - 1 doc_id, sha256(text) h from documents)
select coalesce(a.doc_id, b.doc_id) doc_id, case when a.h is null then 'added' when b.h is null then 'removed' else 'changed' end change
from a full join b on a.doc_id = b.doc_id where a.h is distinct from b.h""")
def doc_snapshot_diff(t):
    """The later snapshot has every text one id lower"""
    before = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    after = before.select((F.col("doc_id") - 1).alias("doc_id"), "h")
    return I.snapshot_diff(before, after, "doc_id", "h")


@query("""with a as (select doc_id, sha256(text) h from documents), b as (select doc_id - 1 doc_id, sha256(text) h from documents)
select coalesce(a.doc_id, b.doc_id) doc_id, case when a.h is null then 'unexpected' when b.h is null then 'missing' else 'hash' end problem
from a full join b on a.doc_id = b.doc_id where a.h is distinct from b.h""")
def doc_manifest_check(t):
    """What is present has every text one id lower than recorded"""
    recorded = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    present = recorded.select((F.col("doc_id") - 1).alias("doc_id"), "h")
    return I.manifest_check(recorded, present, "doc_id", "h")


@query(
    """select conv_id, turn from conversations u where role = 'user' and not exists (select 1 from conversations a where a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant')"""
)
def conv_unanswered(t):
    """D1, D10"""
    c = t("conversations")
    replies = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return I.dangling(c.where("role = 'user'").select("conv_id", "turn"), replies, ["conv_id", "turn"])


@query(
    """select u.conv_id, u.turn, a.text reply, a.conv_id is not null matched from conversations u left join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant' where u.role = 'user'"""
)
def conv_reply_pairs(t):
    """D1"""
    c = t("conversations")
    replies = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return I.linked(c.where("role = 'user'").select("conv_id", "turn"), replies, ["conv_id", "turn"])


@query(
    "select conv_id, turn, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn)::bigint section from conversations"
)
def conv_sections(t):
    """W6"""
    return I.sections(
        t("conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"], F.col("role") == "user"
    ).select("conv_id", "turn", "section")


@query(
    """select conv_id, turn, lag(turn) over w previous, lead(turn) over w "next", row_number() over w "position", count(*) over (partition by conv_id) total from conversations window w as (partition by conv_id order by turn)"""
)
def conv_nav(t):
    """W7"""
    return I.navigation(t("conversations").select("conv_id", "turn"), "conv_id", "turn")


@query(
    """select conv_id, role, turn, turn + 1 since, lead(turn) over (partition by conv_id, role order by turn) until from (select distinct conv_id, role, turn from conversations where role is not null)"""
)
def conv_context_prefix(t):
    """What of each role the later turns have before them: each statement up to the role's next one"""
    return V.versions(t("conversations").select("conv_id", "role", "turn"), ["conv_id"], "turn", "role")


TERMS_SQL = """(with d as (select conv_id, turn // 2 page, turn % 2 attempt, lower(substr(text, 1, 1)) name, length(text) size from conversations where length(text) > 0),
l as (select conv_id, page, max(attempt) attempt from d group by all) select conv_id, page, name, max(size) size from d join l using (conv_id, page, attempt) group by all)"""


def _terms(t) -> DataFrame:
    """Each text defines its first letter as its length; two turns are a page's attempts, of which the last counts."""
    d = t("conversations").where("length(text) > 0").select(
        "conv_id", F.floor(F.col("turn") / 2).alias("page"), (F.col("turn") % 2).alias("attempt"), F.lower(F.substring("text", 1, 1)).alias("name"),
        F.length("text").alias("size")
    )
    return V.versions(d, ["conv_id"], "page", "name", "attempt")


@query(f"select conv_id, page, name, size, page + 1 since, lead(page) over (partition by conv_id, name order by page) until from {TERMS_SQL}")
def conv_definitions(t):
    """Definitions with the pages on which each is in force; discarded attempts leave none"""
    return _terms(t).select("conv_id", "page", "name", "size", "since", "until")


@query(f"""with v as (select *, lead(page) over (partition by conv_id, name order by page) until from {TERMS_SQL}), u as (select conv_id, turn // 2 page, turn, lower(substr(text, 4, 1)) name from conversations where length(text) > 0)
select u.*, v.size found from u left join v on v.conv_id = u.conv_id and v.name = u.name and v.page < u.page and (v.until is null or u.page <= v.until)""")
def conv_in_force(t):
    """For each text's fourth letter, how the pages before defined it"""
    uses = t("conversations").where("length(text) > 0").select(
        "conv_id", F.floor(F.col("turn") / 2).alias("page"), "turn", F.lower(F.substring("text", 4, 1)).alias("name")
    )
    return V.in_force(uses, _terms(t), ["conv_id"], "page", "name", "size")


@query("select conv_id, count(*) attempts, arg_max(role, turn) role from conversations where turn <= 3 group by conv_id")
def conv_latest_attempt(t):
    """W5"""
    return I.latest_attempt(t("conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


@query("""with o as (select distinct l_orderkey, l_linenumber n from lineitem), g as (select *, n - row_number() over (partition by l_orderkey order by n) k from o),
r as (select l_orderkey, min(n) lo, max(n) hi from g group by l_orderkey, k)
select l_orderkey, string_agg(case when lo = hi then lo::varchar else lo::varchar || '-' || hi::varchar end, ',' order by lo) ranges from r group by l_orderkey""")
def line_ranges(t):
    """C2"""
    return I.page_ranges(t("lineitem"), ["l_orderkey"], "l_linenumber")


@query(
    """select l_orderkey, l_linenumber, previous from (select *, lag(l_linenumber) over (partition by l_orderkey order by l_linenumber) previous from (select distinct l_orderkey, l_linenumber from lineitem)) where l_linenumber > previous + 1"""
)
def line_number_gaps(t):
    """W4"""
    return I.gaps(t("lineitem"), ["l_orderkey"], "l_linenumber")


@query("select l_orderkey, l_linenumber, count(*) n from lineitem group by all having count(*) > 1")
def line_duplicate_keys(t):
    """E8"""
    return I.duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def ref_dangling(t):
    """D4"""
    return I.dangling(
        t("orders").select("o_orderkey", "o_custkey"), t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]
    )


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def ref_published(t):
    """C10"""
    return I.published_only(
        t("orders").select("o_orderkey"), t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")),
        ["o_orderkey"]
    )


@query("""select l_orderkey, l_linenumber, s_suppkey, s_nationkey, c_nationkey, count(*) n from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
where s_nationkey <> c_nationkey group by all""")
def owner_disagreement(t):
    """D2"""
    rows = (
        t("lineitem").select(
            "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey")
        ).join(t("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
        .join(
            t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey"
        ).join(t("customer").select("c_custkey", "c_nationkey"), "c_custkey")
    )
    return I.disagreement(rows, "s_nationkey", "c_nationkey").groupBy(
        "l_orderkey", "l_linenumber", "s_suppkey", "s_nationkey", "c_nationkey"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "select p_name, count(*) n, case when count(*) = 1 then min(p_partkey) end p_partkey, case when count(*) = 1 then 'unique' else 'ambiguous' end verdict from part group by p_name"
)
def name_ambiguity(t):
    """D5, D6"""
    return I.ambiguity(t("part"), "p_name", "p_partkey")


BANDS = [("all", 1, 50), ("low", 1, 20), ("mid", 15, 35), ("ten", 10, 12), ("high", 40, 45)]


@query("""with u(uid, lo, hi) as (values ('all', 1, 50), ('low', 1, 20), ('mid', 15, 35), ('ten', 10, 12), ('high', 40, 45))
select p_partkey, p_size, (select arg_max(uid, row(lo, -hi)) from u where p_size between lo and hi) "owner" from part""")
def band_owner(t):
    """D3: size bands as units"""
    part = t("part").select("p_partkey", "p_size")
    units = part.sparkSession.createDataFrame(BANDS, "uid string, lo int, hi int")
    return I.innermost(part, units, [], "p_size")


@query("""with l as (select l_suppkey, l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber k, l_shipdate::date - date '1970-01-01' lo, l_shipdate::date - date '1970-01-01' + floor(l_quantity)::int hi, l_shipdate::date - date '1970-01-01' + floor(l_extendedprice)::int % 60 - 10 pos from lineitem),
p as (select distinct l_suppkey, pos from l), o as (select l_suppkey, p.pos, arg_max(k, row(lo, -hi, k)) k from p join l using (l_suppkey) where p.pos between lo and hi group by all)
select l_orderkey, l_linenumber, o.k "owner" from l left join o using (l_suppkey, pos)""")
def line_shipments(t):
    """D3: the supplier's shipment that was last to leave and still on its way on a day given by a line's price; shipments take as many days as they hold pieces and overlap in any way"""
    lo = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")
    day = lo + F.floor("l_extendedprice").cast("int") % 60 - 10
    lines = t("lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", key, lo.alias("lo"), (lo + F.floor("l_quantity").cast("int")).alias("hi"), day.alias("day")
    )
    rows = lines.select("l_suppkey", "l_orderkey", "l_linenumber", "day")
    return V.innermost(rows, lines.select("l_suppkey", "k", "lo", "hi"), ["l_suppkey"], "day", name="k").select("l_orderkey", "l_linenumber", "owner")


@query("""with u as (select s_suppkey uid, floor(s_acctbal)::bigint lo, floor(s_acctbal)::bigint + 10 * length(s_name) * (s_nationkey + 1) hi from supplier), c as (select c_custkey, floor(c_acctbal)::bigint pos from customer)
select c_custkey, (select arg_max(uid, row(lo, -hi, uid)) from u where pos between lo and hi) "owner" from c""")
def customer_band(t):
    """D3 without a document key: of the suppliers' bands of balances, the innermost that holds a customer's"""
    lo = F.floor("s_acctbal").cast("long")
    units = t("supplier").select(F.col("s_suppkey").alias("uid"), lo.alias("lo"), (lo + 10 * F.length("s_name") * (F.col("s_nationkey") + 1)).alias("hi"))
    rows = t("customer").select("c_custkey", F.floor("c_acctbal").cast("long").alias("at"))
    return V.innermost(rows, units, [], "at").select("c_custkey", "owner")


@query(
    """select source, case when count(*) filter (where quality is null) = 0 then sum(quality)::bigint end total, count(*) filter (where quality is null) missing from documents left join labels using (doc_id) group by source"""
)
def completeness_rollup(t):
    """E3"""
    rows = t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return I.complete_sum(rows, ["source"], "quality")


@query("""select o_custkey, count(*) filter (where o_orderstatus = 'F' and o_totalprice > 300000) errors, count(*) filter (where o_orderstatus = 'P') reviews,
case when errors > 0 then 'invalid' when reviews > 0 then 'needs_review' else 'validated' end status, case when errors > 0 then 1 when reviews > 0 then 2 else 0 end exit_code from orders group by o_custkey""")
def status_rollup(t):
    """E1"""
    return I.status(
        t("orders"), ["o_custkey"], (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000), F.col("o_orderstatus") == "P"
    )


@query(
    "select o_orderkey, case when o_totalprice > 400000 then 'invalid' when o_totalprice > 200000 then 'review' else 'ok' end verdict from orders"
)
def size_threshold(t):
    """E9"""
    return t("orders").select("o_orderkey", I.size_verdict(F.col("o_totalprice"), 200000, 400000).alias("verdict"))


@query(
    """select 'left' side, doc_id from (select doc_id from documents except all select doc_id from labels) union all select 'right', doc_id from (select doc_id from labels except all select doc_id from documents)"""
)
def set_equality(t):
    """S2"""
    return I.set_equality(t("documents").select("doc_id"), t("labels").select("doc_id"))


@query("""select r.l_orderkey, r.l_linenumber, r.hi from (select l_orderkey, l_linenumber, max(l_linenumber + (l_quantity::int % 3)) hi from lineitem group by all) r
where exists (select 1 from (select l_orderkey, l_linenumber, max(l_linenumber + (l_quantity::int % 3)) hi from lineitem group by all) e where e.l_orderkey = r.l_orderkey and e.l_linenumber < r.l_linenumber and e.hi >= r.l_linenumber)""")
def line_overlaps(t):
    """Each line number opens a range that its quantity lengthens"""
    r = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max(F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).alias("hi")
    )
    return I.overlaps(
        r.withColumn("name", F.col("l_linenumber")), "l_orderkey", "l_linenumber", "hi", "name"
    ).select("l_orderkey", "l_linenumber", "hi")


@query(
    "select p_partkey, left(sha256(p_name || chr(10) || p_brand), 12) reader, concat('Course-', p_brand) folder from part where p_size <= 25 union all select p_partkey, left(sha256(p_name || chr(10) || p_brand), 12), p_brand from part where p_size > 25"
)
def part_identity(t):
    """F19, C4"""
    role = F.when(F.col("p_size") <= 25, "course").otherwise("mixed")
    return t("part").select(
        "p_partkey", T.reader_id(F.col("p_name"), F.col("p_brand")).alias("reader"), T.role_folder(role, F.col("p_brand")).alias("folder")
    )


@query(
    "select c_custkey, c_name, c_nationkey from (select *, row_number() over (partition by c_nationkey order by c_custkey) rn from customer) where rn <= 3"
)
def source_order(t):
    """The first three of each group in source order are the feature"""
    return A.after_cursor(t("customer"), 0, "c_nationkey", ("c_custkey",)).where("seq <= 3").select("c_custkey", "c_name", "c_nationkey")


@query("""select distinct c_custkey passage, o_orderkey exercise from customer join orders on o_custkey = c_custkey union
select distinct o_custkey, l_orderkey from lineitem join orders on o_orderkey = l_orderkey""")
def customer_related(t):
    """Orders of the same customer, or named by a line"""
    orders = t("orders").select(F.col("o_orderkey").alias("exercise"), F.col("o_custkey").alias("doc"))
    links = t("customer").select(
        F.col("c_custkey").alias("passage"), F.col("c_custkey").alias("doc"), F.lit(None).cast("long").alias("exercise")
    )
    named = t("lineitem").select(F.col("l_orderkey").alias("exercise")).join(orders, "exercise").select(
        F.col("doc").alias("passage"), "doc", "exercise"
    )
    return P.related(orders, links.unionByName(named))


@query(
    """select l_orderkey, array_to_string(list_sort(list(distinct l_suppkey)), ',') pages, count(distinct l_suppkey) <> 1 needs_review from lineitem group by l_orderkey"""
)
def order_regions(t):
    """An order's suppliers stand for the pages that a figure spans"""
    f = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey")).alias("regions"))
    return P.figure_pages(f, "l_orderkey", "regions", "l_suppkey").select(
        "l_orderkey", F.array_join("pages", ",").alias("pages"), "needs_review"
    )


@query("select p_partkey, coalesce(s_name, p_name) target from part left join supplier on p_partkey = s_suppkey")
def part_remap(t):
    """D18"""
    links = t("part").select(F.col("p_partkey").alias("k"), "p_name")
    moves = t("supplier").select(F.col("s_suppkey").cast("string").alias("target"), F.col("s_name").alias("new"))
    out = P.remap(links.select(F.col("k").cast("string").alias("target"), "k", "p_name"), moves)
    return out.select(
        F.col("k").alias("p_partkey"),
        F.when(F.col("target") == F.col("k").cast("string"), F.col("p_name")).otherwise(F.col("target")).alias("target")
    )


@query(
    """select o_custkey, count(*) filter (where o_orderstatus = 'F') completed, count(*) filter (where o_orderstatus = 'P') uncertain, count(*) filter (where o_orderstatus = 'O') remaining_minimum, count(*) filter (where o_orderstatus in ('O', 'P')) remaining_maximum from orders group by o_custkey"""
)
def resume_accounting(t):
    """Order states stand for states of calls"""
    state = F.when(
        F.col("o_orderstatus") == "F", "completed"
    ).when(F.col("o_orderstatus") == "P", "uncertain").when(F.col("o_orderstatus") == "O", "open")
    return P.resume_accounting(t("orders").withColumn("state", state), ["o_custkey"])


@query("select conv_id, string_agg(role, ',' order by turn) roles from conversations group by conv_id")
def conv_ordered(t):
    """E7, E11"""
    return P.group_in_order(t("conversations"), "conv_id", "turn", "role").select("conv_id", F.array_join("values", ",").alias("roles"))


@query("""with b as (select p_name path, false draft, p_partkey k from part union all select upper(p_name), true, p_partkey from part where p_size > 40 union all select p_brand || p_partkey::varchar, true, p_partkey from part)
select path, draft, k, case when draft and count(*) filter (where not draft) over (partition by lower(path)) > 0 then 'overwrites' when draft and count(*) filter (where draft) over (partition by lower(path)) > 1 then 'duplicate' end problem from b""")
def part_overlay(t):
    """Drafts under the names that parts have, and under new ones"""
    part = t("part")
    drafts = part.where("p_size > 40").select(F.upper("p_name").alias("path"), F.col("p_partkey").alias("k")).unionByName(
        part.select(F.concat("p_brand", F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").alias("k"))
    )
    return P.overlay(part.select(F.col("p_name").alias("path"), F.col("p_partkey").alias("k")), drafts)


@query("select user_id, count(*) n, count(*) <= 60 accepted from events group by user_id")
def batch_limits(t):
    """G4"""
    return P.within_limits(t("events"), ["user_id"], 60)


@query("select page_id, sha256(html) sha256, strlen(html)::int bytes from pages")
def page_proposal(t):
    """B9, F18"""
    return P.proposal(t("pages"), "page_id", "html")


@query("""with d as (select sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey::varchar || ',"n_regionkey":' || n_regionkey::varchar || '}') d from nation),
six as (select left(d, 6) p, sha256(string_agg(d, '' order by d)) d from d group by 1), three as (select left(p, 3) p, sha256(string_agg(d, '' order by p)) d from six group by 1)
select sha256(string_agg(d, '' order by p)) plan_sha256 from three""")
def nation_plan_hash(t):
    """E13"""
    return I.plan_hash(t("nation"))


@query("select p_partkey, repeat(chr(96), greatest(3, p_size % 7 + 1)::int) fence from part")
def part_fence(t):
    """Each part's name holds a run of as many backticks as its size leaves over by seven"""
    text = F.concat("p_name", F.repeat(F.lit("`"), (F.col("p_size") % 7).cast("int")))
    return t("part").select("p_partkey", T.fence(text).alias("fence"))


@query("""with s as (select o_orderkey, 7 + o_orderkey % 3 n, o_custkey % 9 + 1 one, o_orderkey % 5 + 1 lo, o_orderkey % 5 + o_custkey % 4 hi from orders),
p as (select o_orderkey, case when o_orderkey % 11 = 0 then range(1, n + 1) when lo <= hi and hi <= n and one <= n then list_sort(list_distinct(list_append(range(lo, hi + 1), one))) end pages from s),
x as (select o_orderkey, unnest(pages) x from p), r as (select o_orderkey, x, x - row_number() over (partition by o_orderkey order by x) g from x),
k as (select o_orderkey, min(x) a, max(x) b from r group by o_orderkey, g), j as (select o_orderkey, string_agg(case when a = b then a::varchar else a || '-' || b end, ',' order by a) ranges from k group by o_orderkey)
select p.o_orderkey, ranges, pages from p left join j on j.o_orderkey = p.o_orderkey""")
def order_page_specs(t):
    """C1 and back by C2 of each order's own specification: some null, some reversed or beyond the last page"""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    spec = F.concat((c % 9 + 1).cast("string"), F.lit(", "), (k % 5 + 1).cast("string"), F.lit("-"), (k % 5 + c % 4).cast("string"))
    pages = T.selected_pages(F.when(k % 11 != 0, spec), (k % 3 + 7).cast("int"))
    return t("orders").select("o_orderkey", pages.alias("pages")).withColumn("ranges", T.page_ranges(F.col("pages")))
