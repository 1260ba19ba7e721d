"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, collocations, decontaminate, embedding_dedup, jaccard_join, line_dedup, mixing, quality_fm, sharding, substring_dedup, token_files,
    url_filter, vector_codes
)
from .common import table
from .shingles import MARK_BASE, MARK_BYTES, MARK_PRIME
from .substring_dedup import LEAST_WORDS, MARK_FACTORS, REACH


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Host, path and verdict of the rules that op3 applies.
RULES = [
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"),
    ("org", "/es/", "block")
]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, url_filter.rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), token_files.token_folder(spark)
    manifest = token_files.write_tokens(docs, vocabulary("word_bpe_49k.json"), folder, end_id=1)
    return token_files.read_tokens(manifest, folder, dict(docs.dtypes)["doc_id"])


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality_fm.score_quality(docs.select("doc_id", "text", "n_chars"), model)
    return scored.select("doc_id", quality_fm.is_held_out().alias("held_out"), "score", "predicted")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))[0]


QUERIES = {
    f.__name__: f for f in (
        op1_decontamination, op2_substring_dedup, op3_url_filters, op4_line_dedup, op5_token_files, op6_jaccard_join, op7_embedding_dedup,
        op8_bpe, op9_quality_fm, op10_sharding, op11_collocations, op12_mixing, op13_vector_codes
    )
}

_REACH = """links as (select a, b from pairs union all select b, a from pairs),
reach(node, c) as (select node, node from nodes union select l.b, r.c from reach r join links l on l.a = r.node), comp as (select node, min(c) c from reach group by node)"""



def _codes_sql(rounds: int) -> str:
    """Rounds of assigning all parts to all entries and taking means, as one table after another."""
    far = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
    tables = [
        """v as materialized (select row_number() over () rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "parts as materialized (select rid, vec_id, p, e[len(e) * p // 4 + 1:len(e) * (p + 1) // 4] x from v, range(4) t(p))",
        "b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 k, x c from parts where vec_id in (select distinct vec_id from v order by vec_id limit 256))"
    ]
    for i in range(rounds + 1):
        tables.append(f"a{i} as materialized (select rid, p, any_value(x) x, min(row({far}, k)) a from parts join b{i} using (p) group by rid, p)")
        if i < rounds:
            tables.append(
                f"""b{i + 1} as materialized (select p, k, coalesce(m.c, b.c) c from b{i} b left join (select p, k, list(c order by pos) c from (select p, a[2] k, pos, floor(sum(x) / count(*)) c from (select p, a, unnest(x) x, generate_subscripts(x, 1) pos from a{i}) group by all) group by p, k) m using (p, k))"""
            )
    return f"""with {", ".join(tables)}, r as (select rid, string_agg(printf('%02x', a[2]::int), '' order by p) code, sum(a[1])::bigint error from a{rounds} group by rid)
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, (select sha256(string_agg(array_to_string(list_transform(c, lambda x: x::bigint), ','), ',' order by p, k)) from b{rounds}) codebooks_sha256 from v join r using (rid)"""


ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": f"""with recursive d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
t as (select doc_id, unnest(w) word, generate_subscripts(w, 1) - 1 pos from d),
marks as (select word, list_reduce(list_prepend(0::bigint, list_transform(range(least(octet_length(encode(word)), {MARK_BYTES}), 0, -1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::bigint)), lambda x, y: (x * {MARK_BASE} + y) % {MARK_PRIME}) m from (select distinct word from t)),
threes as (select doc_id, pos, ({MARK_FACTORS[0]} * m + {MARK_FACTORS[1]} * coalesce(lead(m) over d, 0) + {MARK_FACTORS[2]} * coalesce(lead(m, 2) over d, 0)) % {MARK_PRIME} g from t join marks using (word) window d as (partition by doc_id order by pos)),
cuts as (select doc_id, pos from (select doc_id, pos, g, count(*) over l nl, min(g) over l ml, count(*) over r nr, min(g) over r mr from threes
window l as (partition by doc_id order by pos rows between {REACH} preceding and 1 preceding), r as (partition by doc_id order by pos rows between 1 following and {REACH} following)) where pos = 0 or (nl = {REACH} and nr = {REACH} and g < ml and g <= mr)),
u as (select doc_id, pos::int start_word, (coalesce(lead(pos) over c, len(w)) - pos)::int n, row_number() over c unit, w from cuts join d using (doc_id) window c as (partition by doc_id order by pos)),
k as (select doc_id, unit, start_word, n, case when n < 5 then [array_to_string(w[start_word + 1:start_word + n], ' ')] else list_sort(list_distinct(list_transform(range(start_word + 1, start_word + n - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) end s from u),
sets as (select s, row_number() over () node from (select distinct s from k)), nodes as (select node from sets), g as (select node, unnest(s) x from sets),
pairs as (select a, b from (select a.node a, b.node b, count(*) n from g a join g b on a.x = b.x and a.node < b.node group by all) join sets ka on ka.node = a join sets kb on kb.node = b where 100 * n >= 80 * (len(ka.s) + len(kb.s) - n)),
{_REACH}, places as (select doc_id, unit, start_word, n, c from k join sets using (s) join comp using (node)),
firsts as (select c, min(row(doc_id, unit)) f from places group by c having min(doc_id) <> max(doc_id)),
repeated as (select *, unit - row_number() over (partition by doc_id order by unit) island from places join firsts using (c))
select doc_id, min(start_word) start_word, sum(n)::int n_words, sum(case when row(doc_id, unit) = f then 0 else n end)::int n_removed, min(f[1]) first_id from repeated group by doc_id, island having sum(n) >= {LEAST_WORDS}""",
    "op3_url_filters": """with r(host, path, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
m as (select page_id, arg_max(r.host || r.path, row(length(r.host || r.path), length(r.host))) "rule", arg_max(verdict, row(length(r.host || r.path), length(r.host))) verdict
from p join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by page_id)
select p.page_id, host, path, "rule", coalesce(verdict, 'allow') verdict from p left join m on m.page_id = p.page_id""",
    "op4_line_dedup": """with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) pos from documents),
w as (select *, lead(line) over d b, lead(line, 2) over d c from l window d as (partition by doc_id order by pos)),
later as (select doc_id, pos from (select *, row_number() over (partition by line, b, c order by doc_id, pos) k from w where c is not null and (trim(line) <> '' or trim(b) <> '' or trim(c) <> '')) where k > 1),
gone as (select distinct doc_id, pos + unnest([0, 1, 2]) pos from later),
kept as (select l.doc_id, string_agg(line, chr(10) order by l.pos) filter (where g.pos is null) t, count(*)::int n_lines, count(g.pos)::int n_removed from l left join gone g on g.doc_id = l.doc_id and g.pos = l.pos group by l.doc_id)
select d.doc_id, case when n_removed = 0 then d.text else coalesce(t, '') end "text", n_lines, n_removed from documents d join kept using (doc_id)""",
    "op6_jaccard_join": f"""with recursive d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
k as (select doc_id, case when w is null or len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end s from d),
nodes as (select doc_id node from k), g as (select doc_id, unnest(s) x from k),
pairs as (select a, b from (select a.doc_id a, b.doc_id b, count(*) n from g a join g b on a.x = b.x and a.doc_id < b.doc_id group by all) join k ka on ka.doc_id = a join k kb on kb.doc_id = b where 100 * n >= 80 * (len(ka.s) + len(kb.s) - n)),
{_REACH} select doc_id, len(s)::bigint n_shingles, c component_id from k join comp on node = doc_id""",
    "op7_embedding_dedup": f"""with recursive v as (select vec_id, label, embedding::double[] e from embeddings), nodes as (select vec_id node from v),
good as (select * from v where label is not null and e is not null and list_dot_product(e, e) > 0 and isfinite(list_dot_product(e, e))),
pairs as (select a.vec_id a, b.vec_id b from good a join good b on a.label = b.label and a.vec_id < b.vec_id where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
{_REACH} select vec_id, (select count(*) from links where a = vec_id) n_links, c component_id, vec_id = c kept from v join comp on node = vec_id""",
    "op11_collocations": f"""with pieces as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') w from pieces),
f as materialized (select lang, m, phrase, count(*) f from (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) phrase from w, range(1, 6) t(m)) group by all having count(*) >= {collocations.LEAST}),
n as (select lang, sum(len(w))::bigint n from w group by lang), c as (select lang, m, phrase, f a, string_split(phrase, ' ') w from f where m > 1),
kept as (select * from c where not exists (select 1 from c q where q.lang = c.lang and q.m > c.m and 100 * q.a >= 100 * c.a and contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))),
cuts as (select lang, phrase, a, k, array_to_string(w[1:k], ' ') x, array_to_string(w[k + 1:], ' ') y from kept, range(1, 5) t(k) where k < m),
s as (select cuts.lang, cuts.phrase, a, n, min(row((1000::hugeint * a * n) // (l.f::hugeint * r.f), k, l.f, r.f)) low from cuts join n on n.lang = cuts.lang join f l on l.lang = cuts.lang and l.phrase = x join f r on r.lang = cuts.lang and r.phrase = y group by all)
select * from (select lang, row_number() over (partition by lang order by low[1] desc, a desc, phrase) "rank", phrase, a, low[3]::bigint l, low[4]::bigint r, n, low[1]::bigint score from s) where "rank" <= {collocations.TOP}""",
    "op12_mixing": f"""with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size, substr(md5('{mixing.SEED}:' || coalesce(doc_id::varchar, '')), 1, 16) o from documents),
s as (select source, sum(size) n, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] w from d group by source),
shut as (select *, 3 * sum(n) over () - 4 * coalesce(sum(n) over b, 0) r, sum(w) over () - coalesce(sum(w) over b, 0) open_w, row_number() over (order by n::double / w, source) k from s window b as (order by n::double / w, source rows between unbounded preceding and 1 preceding)),
last as (select r, open_w from shut where not w * r > 4 * n * open_w order by k limit 1),
t as (select source, n, case when w * shut.r > 4 * n * shut.open_w then 2.0 * n::double else w * last.r::double / (2.0::double * last.open_w::double) end::double target from shut, last),
q as (select *, {mixing.BLOCK} * least(floor(target * {mixing.SHARDS} / {mixing.BLOCK * mixing.SHARDS} + 0.5), floor(n * 2 / {mixing.BLOCK}))::bigint upto from t),
l as (select d.*, coalesce(sum(size) over (partition by source order by o, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint start from d)
select doc_id, size, n::bigint source_size, target, (case when n = 0 then 0 else upto // n * size + greatest(0, least(size, upto % n - start)) end)::bigint taken from l join q on l.source is not distinct from q.source""",
    "op13_vector_codes": _codes_sql(vector_codes.ROUNDS),
}
