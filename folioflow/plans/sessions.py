"""Queries over sessions, aids and positions that the driver's events, orders and conversations stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import activity as A
from ..operators import aids as X
from ..operators import publication as P
from ..operators import sessions as S
from ..operators.integrity import plan_hash
from ..sources import records as R
from ..sources.scratch import scratch
from ..sources.sinks import append_journal, materialize
from .catalog import query

OUTCOME_SQL = "case event_type when 'view' then 'started' when 'click' then 'failed' when 'purchase' then 'succeeded' end"


def _runs(t) -> DataFrame:
    outcome = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "click", "failed").when(
        F.col("event_type") == "purchase", "succeeded"
    )
    return t("events").select("event_id", "user_id", "ts", outcome.alias("outcome"))


@query(f"""with e as (select event_id, user_id, ts, {OUTCOME_SQL} o from events), w as (select event_id, count(*) filter (where o = 'succeeded') over w "version", arg_max(o, row(ts, event_id)) filter (where o is not null) over w known from e window w as (partition by user_id order by ts, event_id))
select event_id, "version", case known when 'started' then 'compiling' when 'succeeded' then 'ready' when 'failed' then case when "version" = 0 then 'error' else 'stale' end else 'idle' end status from w""")
def session_status(t):
    """Each user's events as compiles that start, fail and succeed"""
    return S.status_history(_runs(t), "user_id", ("ts", "event_id")).select("event_id", "version", "status")


@query("""with e as (select event_id, user_id, json_extract_string(props, '$.k')::int % 3 instance, ts, case event_type when 'view' then 'opened' when 'click' then 'rehydrated' when 'purchase' then 'closed' end kind from events),
w as (select *, lag(kind) over (partition by user_id, instance order by ts, event_id) b, row_number() over (partition by user_id, instance, kind order by ts, event_id) n from e where kind is not null)
select event_id, kind from w where case when kind = 'rehydrated' then n = 1 else b is null or b <> kind end""")
def session_lifecycle(t):
    """Views open, clicks rehydrate and purchases close one of three instances of each user"""
    kind = F.when(F.col("event_type") == "view", "opened").when(
        F.col("event_type") == "click", "rehydrated"
    ).when(F.col("event_type") == "purchase", "closed")
    rows = t("events").select(
        "event_id", "user_id", "ts", (F.get_json_object("props", "$.k").cast("int") % 3).alias("instance"), kind.alias("kind")
    )
    return S.lifecycle(rows, "user_id", "instance", ("ts", "event_id"), "kind").select("event_id", "kind")


@query("""with g as (select user_id, ts, event_id, epoch_us(ts) - epoch_us(lag(ts) over w) gap from events window w as (partition by user_id order by ts, event_id)),
b as (select user_id, ts, sum(case when gap is null or gap // 1000 > 21600000 then 1 else 0 end) over (partition by user_id order by ts, event_id) burst from g)
select user_id, min(ts) "first", max(ts) "last", count(*) n from b group by user_id, burst""")
def session_bursts(t):
    """Events of a user with six quiet hours at most between them"""
    return S.bursts(t("events").select("event_id", "user_id", "ts"), 21_600_000, "user_id", "ts", ("ts", "event_id"))


@query("select event_id, user_id % 10 <> 0 student from events where user_id % 10 <> 1 or event_type <> 'error'")
def session_actors(t):
    """Every tenth user is a tutor, and of others the actor isn't named"""
    e = t("events").where("user_id % 10 <> 1 or event_type <> 'error'").withColumn("actor", F.when(F.col("user_id") % 10 == 0, "tutor"))
    student, tutor = S.by_actor(e)
    return student.select("event_id", F.lit(True).alias("student")).unionByName(tutor.select("event_id", F.lit(False).alias("student")))


@query("""with s as (select v::int v, doc_id, case when doc_id % 5 = v then 'x' || v else sha256(coalesce(text, '')) end h from documents, (values (1), (2), (3)) t(v) where doc_id % (v + 3) <> 0),
c as (select coalesce(a.v, b.v + 1) v, a.h is null gone from s a full join s b on a.doc_id = b.doc_id and a.v = b.v + 1 where a.h is distinct from b.h)
select v "version", count(*) filter (where not gone) changed, count(*) filter (where gone) removed from c where v between 2 and 3 group by v""")
def session_content_changes(t):
    """Three versions of the documents, in each of which some are missing and some differ"""
    d, v = F.col("doc_id"), F.col("version")
    s = t("documents").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where(d % (v + 3) != 0)
    s = s.select(
        "version", "doc_id",
        F.when(d % 5 == v, F.concat(F.lit("x"), v.cast("string"))).otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha256")
    )
    gone = F.col("change") == "removed"
    return S.changed_notes(s, "version", "doc_id", "sha256").groupBy("version").agg(F.count_if(~gone).alias("changed"), F.count_if(gone).alias("removed"))


@query("""with s as (select v::int v, doc_id, sha256(coalesce(text, '') || case when length(text) % 7 = v then 'x' else '' end) h from documents, (values (1), (2), (3)) t(v) where doc_id % (v + 3) <> 0)
select coalesce(a.v, b.v + 1) "version", coalesce(a.doc_id, b.doc_id) doc_id, case when a.h is null then 'removed' when b.h is null then 'added' else 'changed' end change from s a full join s b on a.doc_id = b.doc_id and a.v = b.v + 1 where a.h is distinct from b.h and coalesce(a.v, b.v + 1) between 2 and 3""")
def session_changed_notes(t):
    """Each document that a version adds, removes or changes, a row each"""
    d, v = F.col("doc_id"), F.col("version")
    s = t("documents").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where(d % (v + 3) != 0)
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.length("text") % 7 == v, "x").otherwise(""))
    return S.changed_notes(s.select("version", "doc_id", F.sha2(text, 256).alias("sha256")), "version", "doc_id", "sha256")


@query("""select event_id, case when event_type = 'click' then 'edit' when event_type = 'purchase' then 'write' else 'view' end tool,
user_id % 2 = 0 and event_type in ('click', 'purchase') and user_id % 3 <> 0 denied, (ts + interval 2 hour)::date::varchar "day" from events""")
def event_guard(t):
    """Every second user is a tutor; every third writes beside the vault"""
    u, kind = F.col("user_id"), F.col("event_type")
    tool = F.when(kind == "click", "edit").when(kind == "purchase", "write").otherwise("view")
    path = F.concat(F.when(u % 3 == 0, "/vaults/").otherwise("/vault/"), u.cast("string"))
    return t("events").select(
        "event_id", tool.alias("tool"), P.write_denied(tool, path, "/vault", u % 2 == 0).alias("denied"),
        T.local_date(F.col("ts").cast("timestamp"), "+02:00").cast("string").alias("day")
    )


CALLS_SQL = """(select event_id, json_extract_string(props, '$.k')::int k, user_id, case event_type when 'click' then 'edit' when 'purchase' then 'apply_patch' when 'signup' then 'move_file' else 'view' end tool from events)"""


@query(f"""with c as {CALLS_SQL}, p as (select event_id, unnest(case when tool = 'edit' and k % 3 = 0 then ['/home/vault/n' || k || '.md'] when tool = 'edit' and k % 3 = 1 then ['/home/vault/Activity/Layouts/x/y.json'] when tool = 'edit' then []::varchar[]
when tool = 'apply_patch' then case when k % 2 = 0 then ['/home/vault/p' || k || '.md'] else [] end when tool = 'move_file' then ['/home/vault/to' || k || '.md'] else [] end) path from c where user_id % 4 <> 3) select event_id, path from p""")
def event_denied(t):
    """Tool calls of agents under several spellings, with paths in arrays, patches, up folders, and in the one folder that may be written"""
    k, kind, u = F.get_json_object("props", "$.k").cast("int"), F.col("event_type"), F.col("user_id") % 4
    n = k.cast("string")
    edit = F.when(k % 3 == 0, F.concat(F.lit('{"paths": ["../vault/./n'), n, F.lit('.md", 1, ""], "message": "/home/vault/z.md"}'))).when(
        k % 3 == 1, F.lit('{"files": ["Activity/Layouts/x/y.json", "Activity/Layouts/n.json"], "path": null}')
    ).otherwise(F.lit('{"path": "/home/outside.md"}'))
    to = F.when(k % 2 == 0, "vault/p").otherwise("vaults/p")
    patch = F.concat(F.lit('{"input": "*** Begin Patch\\n*** Update File: /home/'), to, n, F.lit('.md\\n@@\\n-a\\n*** End Patch"}'))
    move = F.concat(F.lit('{"source": "/home/a.md", "destination": "to'), n, F.lit('.md"}'))
    calls = t("events").select(
        "event_id", F.when(kind == "click", "edit").when(kind == "purchase", "apply_patch").when(kind == "signup", "move_file").otherwise("view").alias("tool"),
        F.when(kind == "purchase", patch).when(kind == "signup", move).otherwise(edit).alias("arguments"), F.lit("/home/vault").alias("cwd"),
        F.when(u == 0, "Reading-Guide").when(u == 1, " reading_guide ").when(u == 2, "reading guide").otherwise("reading-guide-2").alias("agent")
    )
    return P.denied_writes(calls, "event_id", "/home/vault/", "reading-guide", "Activity/Layouts")


REPLAY_SQL = """l as (select user_id session, event_id seq, ts, case event_type when 'view' then 'hint_revealed' when 'click' then 'explanation_opened' when 'purchase' then 'correction_shown' when 'signup' then 'course_section_opened' else 'correction_hidden' end type,
user_id % 10 = 0 tutor, json_extract_string(props, '$.k')::int k from events), s as (select *, case when k % 2 = 0 then 'q-' || (k % 10) end question, 'e-' || (k % 5) exercise from l where not tutor),
m as (select *, least((epoch_us(coalesce(lead(ts) over (partition by session order by ts, seq), ts)) - epoch_us(ts)) // 1000, 600000) ms from s),
q as (select question, coalesce(max(case when type = 'hint_revealed' then k % 4 end), 0)::int hints, bool_or(type = 'correction_shown') correction_seen, coalesce(arg_max(type = 'correction_shown', row(ts, seq)) filter (where type in ('correction_shown', 'correction_hidden')), false) correction,
count(*) filter (where type = 'explanation_opened') explanations, 0::bigint tutor, sum(ms)::bigint ms from m where question is not null group by question),
x as (select exercise, coalesce(sum(case when question is null then ms end), 0)::bigint ms, false started from m group by exercise)"""


def _log(t) -> DataFrame:
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    what = F.when(kind == "view", "hint_revealed").when(kind == "click", "explanation_opened").when(
        kind == "purchase", "correction_shown"
    ).when(
        kind == "signup", "course_section_opened"
    ).otherwise("correction_hidden")
    none = F.lit(None)
    return t("events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "ts", what.alias("type"), F.when(
            F.col("user_id") % 10 == 0, "tutor"
        ).alias("actor"), F.when(
            k % 2 == 0, F.concat(F.lit("q-"), (k % 10).cast("string"))
        ).alias("question"),
        F.concat(
            F.lit("e-"), (k % 5).cast("string")
        ).alias("exercise"), (k % 4).alias("index"), F.lit(4).alias("total"), F.concat(
            F.lit("c"), (k % 3).cast("string")
        ).alias("course"), (k % 6).alias("section"), F.concat(
            F.lit("t"), F.col("event_id").cast("string")
        ).alias("title"), none.cast("string").alias("url"), none.cast("int").alias("page"),
    )


@query(f"with {REPLAY_SQL} select * from q")
def replay_questions(t):
    """E4"""
    return A.replay(_log(t))["questions"]


@query(
    "select 'c' || (k % 3) course, k % 6 section, arg_max('t' || event_id, row(ts, event_id)) title, 4 total, count(*) visits from (select *, json_extract_string(props, '$.k')::int k from events) where user_id % 10 <> 0 and event_type = 'signup' group by all"
)
def replay_sections(t):
    """E4, E6"""
    return A.replay(_log(t))["sections"]


MINUTES_SQL = "case when ms <= 0 then '—' when ms < 60000 then '<1 min' else '~' || ((ms + 30000) // 60000)::varchar || ' min' end"


@query(f"""with {REPLAY_SQL} select 'question' part, question || ' | ' || hints || ' | ' || case when correction_seen then 'yes' else 'no' end || ' | ' || explanations || ' | ' || tutor || ' | ' || {MINUTES_SQL} line from q
union all select 'exercise', exercise || ' | — | ' || {MINUTES_SQL} from x""")
def replay_summary(t):
    """T12, T13"""
    return A.summary(A.replay(_log(t)))


@query("""with aids as (select o_orderkey aid, o_custkey question, case when o_orderkey % 2 = 0 then o_orderkey when o_orderkey % 3 = 0 then o_orderkey + 1 end answer from orders), questions as (select c_custkey question from customer where c_nationkey < 20),
answers as (select o_orderkey answer, case when o_orderkey % 8 = 0 then o_custkey + 1 else o_custkey end question from orders where o_orderstatus <> 'P'),
links as (select l_orderkey aid, l_suppkey target, case l_linenumber when 1 then '' when 2 then 'h' || (l_partkey % 7) else 'h' || (l_partkey % 3) end fragment from lineitem), course as (select s_suppkey target from supplier where s_nationkey % 3 < 2),
places as (select s_suppkey target, 'h' || n fragment from supplier, range(5) r(n) union all select s_suppkey, 'h0' from supplier where s_suppkey % 5 = 0), hits as (select target, fragment, count(*) n from places group by all),
c as (select l.*, coalesce(n, 0) n from links l semi join course using (target) left join hits h on h.target = l.target and h.fragment = l.fragment)
select aid, 'unknown question' problem from aids where question not in (select question from questions) union select aid, 'unknown answer' from aids where answer is not null and answer not in (select answer from answers)
union select aid, 'answer to another question' from aids join answers using (answer) where aids.question <> answers.question union select aid, 'imprecise course link' from c where fragment = '' union select aid, 'missing or ambiguous course place' from c where fragment <> '' and n <> 1
union select aid, 'no precise course link' from aids where aid not in (select aid from c where fragment <> '' and n = 1)""")
def order_aids(t):
    """Orders are aids for their customer's question, their lines link to places of suppliers, of which two in three are courses"""
    k = F.col("o_orderkey")
    aids = t("orders").select(
        k.alias("aid"), F.col("o_custkey").alias("question"), F.when(k % 2 == 0, k).when(k % 3 == 0, k + 1).alias("answer")
    )
    answers = t("orders").where("o_orderstatus <> 'P'").select(
        k.alias("answer"), F.when(k % 8 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("question")
    )
    questions = t("customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("question"))
    part = F.col("l_partkey")
    fragment = F.when(F.col("l_linenumber") == 1, "").when(
        F.col("l_linenumber") == 2, F.concat(F.lit("h"), (part % 7).cast("string"))
    ).otherwise(F.concat(F.lit("h"), (part % 3).cast("string")))
    links = t("lineitem").select(F.col("l_orderkey").alias("aid"), F.col("l_suppkey").alias("target"), fragment.alias("fragment"))
    supplier = t("supplier")
    documents = supplier.select(
        F.col("s_suppkey").alias("target"),
        F.element_at(F.array(F.lit("course"), F.lit("mixed"), F.lit("exercise")), (F.col("s_nationkey") % 3 + 1).cast("int")).alias("role")
    )
    places = supplier.select(
        F.col("s_suppkey").alias("target"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda n: F.concat(F.lit("h"), n.cast("string")))).alias("fragment")
    )
    places = places.unionByName(
        supplier.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("target"), F.lit("h0").alias("fragment"))
    )
    return X.aid_findings(aids, answers, questions, links, documents, places)


@query("select c_custkey question from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def customer_without_aid(t):
    """Customers without an open order"""
    return X.without_aid(
        t("customer").select(F.col("c_custkey").alias("question")),
        t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("question"))
    )


@query("""with c as (select conv_id, turn, role, length(text) % 4 + 1 lvl, role || turn t from conversations), h as (select * from c where role = 'assistant'), p as (select * from c where role <> 'assistant'),
k as (select p.conv_id, p.turn, h.turn ht, h.t from p left join h on h.conv_id = p.conv_id and h.turn <= p.turn and not exists (select 1 from h x where x.conv_id = h.conv_id and x.turn > h.turn and x.turn <= p.turn and x.lvl <= h.lvl))
select conv_id, turn, coalesce(string_agg(t, ' / ' order by ht), '') path, (select arg_max(x.turn * 10, x.turn) from h x where x.conv_id = k.conv_id and x.turn <= k.turn) page from k group by conv_id, turn""")
def conv_headings(t):
    """An assistant's turn is a heading of a level by its length, and the mark of a page"""
    c = t("conversations").withColumn("name", F.concat("role", F.col("turn").cast("string")))
    marks = c.where("role = 'assistant'")
    headings = marks.select("conv_id", "turn", (F.length("text") % 4 + 1).alias("level"), F.col("name").alias("text"))
    under = X.preceding_headings(c.where("role <> 'assistant'").select("conv_id", "turn"), headings, "conv_id", "turn")
    pages = marks.select("conv_id", "turn", (F.col("turn") * 10).alias("page"))
    return X.starting_page(under.select("conv_id", "turn", F.array_join("headings", " / ").alias("path")), pages, "conv_id", "turn")


@query(
    """select event_id, array_to_string(list_sort(list_filter(json_keys(p), lambda x: x <> 'k')), ',') extra from (select event_id, case when event_id % 4 = 0 then '{"k": 1, "z": 2, "a": {"k": 3}}' else props end p from events) where len(list_filter(json_keys(p), lambda x: x <> 'k')) > 0"""
)
def event_unknown_fields(t):
    """every fourth event has fields that the schema doesn't name"""
    rows = t("events").select(
        "event_id", F.when(F.col("event_id") % 4 == 0, '{"k": 1, "z": 2, "a": {"k": 3}}').otherwise(F.col("props")).alias("text")
    )
    return R.unknown_fields(rows, "k int").select("event_id", F.array_join(F.array_sort("unknown"), ",").alias("extra"))


@query("""with e as (select user_id % 7 session, json_extract_string(props, '$.k')::int % 4 layout, ts from events)
select session, layout, (min(ts) + interval 2 hour)::date::varchar || '-' || session || '-' || layout folder from e group by session, layout""")
def session_folders(t):
    """Seven sessions with four layouts"""
    e = t("events").select(
        (F.col("user_id") % 7).alias("session"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("layout"), "ts"
    )
    return A.journal_folders(e, zone="+02:00")


@query("select ts::date::varchar \"date\", user_id % 7 session, count(*) n, count(distinct event_id) ids from events group by all")
def session_appended(t):
    """The events appended to journals by date and session, in three goes of which one is made twice"""
    e = t("events").select((F.col("user_id") % 7).alias("session"), F.to_date("ts").cast("string").alias("date"), "event_id", "event_type")
    spark, at = e.sparkSession, f"{scratch(e.sparkSession)}/journal"
    for go in (0, 1, 1, 2):
        append_journal(e.where(F.col("event_id") % 3 == go), at, f"go-{go}")
    read = spark.read.schema("event_id long, event_type string, batch string, date string, session long").json(at)
    return read.groupBy("date", "session").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("""with e as (select event_id, user_id % 20 j, event_type, row_number() over (partition by user_id % 20 order by ts, event_id) seq, count(*) over (partition by user_id % 20) n from events)
select j, seq, event_type "type", event_id page from e where j % 5 <> 0 or seq < n""")
def session_journals(t):
    """Events as twenty journals of JSON lines with a header, read again; the last line of every fifth is torn"""
    e = t("events")
    spark, folder = e.sparkSession, scratch(e.sparkSession)
    own = W.partitionBy("j")
    e = e.withColumn("j", F.col("user_id") % 20).withColumns(
        {"seq": F.row_number().over(own.orderBy("ts", "event_id")), "n": F.count(F.lit(1)).over(own)}
    )
    line = F.to_json(F.struct(F.lit(1).alias("v"), F.col("event_type").alias("type"), F.col("event_id").alias("page")))
    torn = (F.col("j") % 5 == 0) & (F.col("seq") == F.col("n"))
    lines = e.select("j", "seq", F.when(torn, F.left(line, F.length(line) - 5)).otherwise(line).alias("value"))
    heads = e.select("j").distinct().select("j", F.lit(0).alias("seq"), F.lit('{"v":1,"type":"header","layout":"a"}').alias("value"))
    # by a hash: Spark leaves out a repartition by j, as both parts have it by their windows, and may then cut them at different j
    rows = lines.unionByName(heads).repartition(F.xxhash64("j")).sortWithinPartitions("j", "seq")
    rows.select("j", "value").write.partitionBy("j").text(folder)
    read = R.read_journal(spark, f"{folder}/*", "v int, type string, page long")
    return read.select(F.regexp_extract("file", r"/j=(\d+)/", 1).cast("long").alias("j"), "seq", "type", "page")


@query("select n_nationkey::varchar document, 'complete' status, n_regionkey::int + 1 pages, true owned, false is_pdf from nation")
def nation_bundles(t):
    """A manifest a nation, written as a file of its own, found, recognised and read"""
    n = t("nation")
    spark, folder = n.sparkSession, scratch(n.sparkSession)
    pages = F.transform(
        F.sequence(F.lit(1), F.col("n_regionkey") + 1),
        lambda p: F.struct(p.cast("int").alias("number"), F.lit("p.png").alias("raw_image"), F.lit("p.json").alias("raw_response"))
    )
    record = F.struct(
        F.lit(3).alias("schema_version"), F.lit("complete").alias("status"), F.col("n_nationkey").cast("string").alias("document"),
        pages.alias("pages")
    )
    n.select(F.col("n_nationkey").alias("k"), F.to_json(record).alias("value")).repartition(F.col("k")).write.partitionBy("k").text(folder)
    manifests = R.read_records(spark, f"{folder}/*/*.txt", R.MANIFEST).select("path", "document", "status", F.size("pages").alias("pages"))
    texts = R.bundle_marker(
        spark.read.text(f"{folder}/*/*.txt").select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    ).select("path", "owned")
    found = R.discover(spark, folder, glob="*.txt").select("path", "is_pdf")
    key = F.regexp_replace("path", "^file:/+", "/")
    tables = [x.withColumn("path", key) for x in (manifests, texts, found)]
    return tables[0].join(tables[1], "path").join(tables[2], "path").drop("path")


@query("select s_suppkey, s_name from supplier")
def supplier_materialized(t):
    """A plan approved by its hash, staged, published under its name and read again"""
    plan = t("supplier").select("s_suppkey", "s_name")
    spark, path = plan.sparkSession, f"{scratch(plan.sparkSession)}/plan"
    materialize(plan, plan_hash(plan).first()[0], path)
    return spark.read.parquet(path)


@query("""select page_id, page_id % 5 in (0, 4) watched from pages""")
def page_watched(t):
    """A10: notes, notes of the activity records, other files, hidden notes, and the layout"""
    p, name = F.col("page_id") % 5, F.col("page_id").cast("string")
    path = F.when(p == 0, F.concat(F.lit("n/"), name, F.lit(".md"))).when(
        p == 1, F.concat(F.lit("Activity/"), name, F.lit(".md"))
    ).when(p == 2, F.concat(F.lit("n/"), name, F.lit(".txt"))).when(
        p == 3, F.concat(F.lit("n/.x/"), name, F.lit(".md"))
    ).otherwise("layout.json")
    return t("pages").select("page_id", T.watched(path, "layout.json").alias("watched"))
