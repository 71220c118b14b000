"""Named queries over the driver's tables, each with the SQL it has to agree with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import minhash, text
from quarry.operators import dedup, graph, index, lifecycle, search, usage
from quarry.plans import views as V
from quarry.sources import lines as L

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOK = f"regexp_extract_all({_LOW}, '[a-z0-9]{{{{3,}}}}')"
_tok = lambda c: _TOK.format(c)

# --- near-duplicate tasks ---

_OVERLAP = f"""ta as (select id, status, created_at, {_tok('description')} as a from tasks), nb as (select new_id, {_tok('description')} as b from new),
  kw as (select new_id, id, status, created_at, case when len(a) = 0 or len(b) = 0 then 0 else len(list_filter(a, lambda x: list_contains(b, x))) / len(a) end as score from ta, nb)"""
_RANK = "case status when 'executing' then 1 when 'pending' then 2 when 'approved' then 3 when 'created' then 4 when 'classified' then 5 end"


@query(f"""with {V.TASKS}, {V.NEW}, {_OVERLAP}
select new_id, id, round(score, 9) as score from kw where {_RANK} is not null and score >= 0.8
qualify row_number() over (partition by new_id order by {_RANK}, created_at desc, id) = 1""")
def dedup_keyword_first(spark, d):
    return _rounded(dedup.first_match(V.tasks(spark, d), V.new_tasks(spark, d)), "score")


_GRAMS = """list_distinct(case when {0} = '' then [] else list_transform(range(1, len({0}) + 1), lambda i: substr(' ' || {0} || ' ', i, 3)) end)"""
_FLAT = f"trim(regexp_replace({_LOW}, '[^a-z0-9]+', ' ', 'g'))"
_TRI = f"""tfl as (select id, status, created_at, {_FLAT.format('description')} as f from tasks), nf as (select new_id, {_FLAT.format('description')} as f from new),
  tg as (select id, status, created_at, {_GRAMS.format('f')} as a from tfl), ng as (select new_id, {_GRAMS.format('f')} as b from nf),
  tri as (select new_id, id, status, created_at, i / (len(a) + len(b) - i) as score from (select *, len(list_intersect(a, b)) as i from tg, ng) where i > 0)"""
_SCORED = "status not in ('done', 'failed', 'rejected', 'pending_clarification')"


@query(f"""with {V.TASKS}, {V.NEW}, {_TRI}
select new_id, id, round(score, 9) as score from tri where {_SCORED} and score >= 0.55
qualify row_number() over (partition by new_id order by round(score, 12) desc, created_at desc, id) = 1""")
def dedup_trigram_best(spark, d):
    return _rounded(dedup.best_match(V.tasks(spark, d), V.new_tasks(spark, d), dedup.TRIGRAM), "score")


_TFIDF = f"""act as (select * from tasks where {_SCORED}), w as (select id, unnest({_tok('description')}) as t, len({_tok('description')}) as n from act),
  tf as (select id, t, count(*) / any_value(n) as tf from w group by id, t), dfs as (select t, count(*) as df from tf group by t), nn as (select count(*) + 1 as n from act),
  qw as (select new_id, unnest({_tok('description')}) as t, len({_tok('description')}) as n from new), q as (select new_id, t, count(*) / any_value(n) as qtf from qw group by new_id, t),
  k as (select id, t, tf, ln((1 + n) / (1 + df)) + 1 as i0, ln((1 + n) / (2 + df)) + 1 as i1 from tf join dfs using (t), nn),
  base as (select id, sum((tf * i0) ** 2) as base from k group by id),
  qi as (select new_id, t, qtf * (ln((1 + n) / (2 + coalesce(df, 0))) + 1) as qv from q left join dfs using (t), nn), qn as (select new_id, sqrt(sum(qv ** 2)) as qnorm from qi group by new_id),
  sh as (select new_id, id, sum(tf * i1 * qv) as dot, sum(tf ** 2 * (i1 ** 2 - i0 ** 2)) as more from k join qi using (t) group by 1, 2),
  cosine as (select new_id, id, dot / (sqrt(base + more) * qnorm) as score from sh join base using (id) join qn using (new_id))"""


@query(f"""with {V.TASKS}, {V.NEW}, {_TFIDF}
select new_id, id, round(score, 9) as score from cosine join act using (id) where score >= 0.6
qualify row_number() over (partition by new_id order by round(score, 12) desc, created_at desc, id) = 1""")
def dedup_tfidf_best(spark, d):
    return _rounded(dedup.best_tfidf(V.tasks(spark, d), V.new_tasks(spark, d)), "score")


_A, _B = (x.tolist() for x in minhash.permutations())
_SHINGLES = "list_distinct(case when len({0}) < 2 then {0} else list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]) end)"
_TOP = 1 << 64


_M = "4294967295::ubigint"


def _signed(tables: str) -> str:
    """Signatures of (key, w). Factor times hash plus step modulo 2**64 is put together from halves, since products of
    halves fit 64 bits."""
    u = lambda x: f"{x}::ubigint"
    perm = ", ".join(f"({i}, {u(a >> 32)}, {u(a & 0xFFFFFFFF)}, {u(b >> 32)}, {u(b & 0xFFFFFFFF)})" for i, (a, b) in enumerate(zip(_A, _B)))
    return f"""all_w as ({tables}), shi as (select key, unnest({_SHINGLES.format("w")}) as s from all_w),
hashed as materialized (select s, (h // {1 << 32})::ubigint as hh, (h % {1 << 32})::ubigint as hl from (select s, list_reduce(list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::uhugeint), lambda h, b: (xor(h, b) * {minhash.FNV_PRIME}::uhugeint) % {_TOP}::uhugeint, {minhash.FNV_START}::uhugeint) as h from (select distinct s from shi))),
perm(p, ah, al, bh, bl) as (values {perm}),
low as (select key, p, al * hl as lo, (((ah * hl) & {_M}) + ((al * hh) & {_M})) & {_M} as mid, bh, bl from shi join hashed using (s), perm),
mins as (select key, p, min((((((lo >> 32) + mid + bh + (((lo & {_M}) + bl) >> 32)) & {_M}) << 32) | (((lo & {_M}) + bl) & {_M}))) as m from low group by key, p),
sigs as (select key, list(case when m >= {1 << 63}::ubigint then (m::hugeint - {_TOP}::hugeint)::bigint else m::bigint end order by p) as sig from mins group by key),
sig as (select key, coalesce(sig, list_transform(range(0, 64), lambda i: -1::bigint)) as sig from all_w left join sigs using (key))"""


_SAME = "len(list_filter(range(1, 65), lambda i: {0}[i] = {1}[i])) / 64"
_TASK_WORDS = f"select id as key, {_tok('description')} as w from tasks"
_ALL_WORDS = f"{_TASK_WORDS} where {_SCORED} union all select -1 - new_id, {_tok('description')} from new"
_MIN = f"mh as (select -1 - n.key as new_id, t.key as id, {_SAME.format('t.sig', 'n.sig')} as score from sig t, sig n where t.key >= 0 and n.key < 0)"


@query(f"""with {V.TASKS}, {V.NEW}, {_signed(_ALL_WORDS)}, {_MIN}
select new_id, id, round(score, 9) as score from mh join tasks using (id) where score >= 0.7 qualify row_number() over (partition by new_id order by score desc, created_at desc, id) = 1""")
def dedup_minhash_best(spark, d):
    return _rounded(dedup.best_match(V.tasks(spark, d), V.new_tasks(spark, d), dedup.MINHASH), "score")


@query(f"with {V.TASKS}, {_signed(_TASK_WORDS)} select key as id, sig as signature from sig")
def dedup_minhash_signature(spark, d):
    return dedup.signatures(V.tasks(spark, d))


@query(f"with {V.TASKS}, {_signed(_TASK_WORDS)} select min(key) as class_id, count(*) as n from sig group by sig")
def dedup_minhash_classes(spark, d):
    return dedup.signature_classes(V.tasks(spark, d)).select("class_id", "n")


@query(f"""with {V.TASKS}, {_signed(_TASK_WORDS)}, cls as (select min(key) as c, sig from sig group by sig)
select x.c as a, y.c as b, {_SAME.format('x.sig', 'y.sig')} as similarity from cls x, cls y where x.c < y.c and {_SAME.format('x.sig', 'y.sig')} >= 0.7""")
def dedup_minhash_pairs(spark, d):
    return _rounded(dedup.minhash_pairs(V.tasks(spark, d)), "similarity")


@query(f"""with {V.TASKS}, {V.NEW}, {_OVERLAP}, {_TRI}, {_TFIDF}, {_signed(_ALL_WORDS)}, {_MIN},
hits as (select new_id, 1 as l, 'keyword' as layer, id, score, {_RANK} as r from kw where {_RANK} is not null and score >= 0.8
  union all select new_id, 2, 'trigram', id, score, -round(score, 12) from tri where {_SCORED} and score >= 0.55 union all select new_id, 3, 'tfidf', id, score, -round(score, 12) from cosine where score >= 0.6
  union all select new_id, 4, 'minhash', id, score, -round(score, 12) from mh where score >= 0.7)
select new_id, layer, id, round(score, 9) as score from hits join tasks using (id) qualify row_number() over (partition by new_id order by l, r, created_at desc, id) = 1""")
def dedup_cascade(spark, d):
    return _rounded(dedup.cascade(V.tasks(spark, d), V.new_tasks(spark, d)), "score")


@query(f"""with {V.TASKS}, {V.NEW}, {_OVERLAP}, {_TRI},
hit as (select new_id, id, status from kw where score >= 0.8 union select new_id, id, status from tri where score >= 0.55)
select new_id, id from hit where {_RANK} is not null qualify row_number() over (partition by new_id order by {_RANK}, id) = 1""")
def dedup_tx_recheck(spark, d):
    return dedup.admission_hits(V.tasks(spark, d), V.new_tasks(spark, d))


@query(f"""with {V.TASKS}, {V.NEW}, ta as (select id, created_at, {_tok('description')} as a from tasks where {_SCORED}), nb as (select new_id, {_tok('description')} as b from new),
h as (select new_id, id, created_at, len(list_filter(a, lambda x: list_contains(b, x))) as hits from ta, nb)
select new_id, cast(row_number() over (partition by new_id order by hits desc, created_at desc, id) as integer) as place, id, hits from h qualify place <= 5""")
def llm_top5_candidates(spark, d):
    return dedup.candidates_by_tokens(V.tasks(spark, d), V.new_tasks(spark, d))


#: Labelled pairs: twelve words of a document, and the same without one, or for odd ids its next twelve.
_PAIRS = f"""w as (select doc_id, lang as category, doc_id % 2 = 0 as duplicate, {_tok("coalesce(text, '')")} as w from documents),
pairs as (select doc_id, category, duplicate, w[1:12] as a, case when duplicate then list_concat(w[1:doc_id % 12], w[doc_id % 12 + 2:12]) else w[13:24] end as b from w)"""
_IDF = "case when list_contains({0}, x) then 1 else 1 + ln(1.5) end"
_NORM = "list_sum(list_transform(list_distinct({0}), lambda x: (len(list_filter({0}, lambda t: t = x)) / len({0}) * " + _IDF.format("{1}") + ") ** 2))"
_TEXT = "array_to_string({0}, ' ')"
_JUDGED = f"""{_PAIRS}, g as (select *, {_GRAMS.format(_TEXT.format('a'))} as ga, {_GRAMS.format(_TEXT.format('b'))} as gb from pairs),
{_signed("select 2 * doc_id as key, a as w from pairs union all select 2 * doc_id + 1, b from pairs")},
s as (select g.*, len(list_intersect(ga, gb)) as i, len(a) > 0 and len(b) > 0 as filled, list_sum(list_transform(list_intersect(a, b), lambda x: len(list_filter(a, lambda t: t = x)) / len(a) * len(list_filter(b, lambda t: t = x)) / len(b))) as dot,
 {_NORM.format('a', 'b')} as na, {_NORM.format('b', 'a')} as nb, {_SAME.format("x.sig", "y.sig")} as same
 from g join sig x on x.key = 2 * doc_id join sig y on y.key = 2 * doc_id + 1),
v as (select category, duplicate, coalesce(filled and len(list_filter(a, lambda x: list_contains(b, x))) / len(a) >= 0.8, false) as keyword, coalesce(i > 0 and i / (len(ga) + len(gb) - i) >= 0.55, false) as trigram,
 coalesce(filled and dot / sqrt(na * nb) >= 0.6, false) as tfidf, same >= 0.7 as minhash from s),
judged as (select layer, category, duplicate, case layer when 'keyword' then keyword when 'trigram' then trigram when 'tfidf' then tfidf when 'minhash' then minhash else keyword or trigram or tfidf or minhash end as predicted
 from v, (values ('keyword'), ('trigram'), ('tfidf'), ('minhash'), ('cascade')) l(layer))"""
_MEASURES = """select *, case when "precision" + recall = 0 then 0.0 else round(2 * "precision" * recall / ("precision" + recall), 9) end as f1 from
(select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as "precision", case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as recall from counts)"""


def _judged(spark, d):
    w = V.table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"), (F.col("doc_id") % 2 == 0).alias("duplicate"), text.tokens(F.col("text")).alias("w"))
    k = (F.col("doc_id") % 12).cast("int")
    less = F.concat(F.slice("w", F.lit(1), k), F.slice(F.slice("w", 1, 12), k + 2, F.lit(12)))
    pairs = w.select("category", "duplicate", F.array_join(F.slice("w", 1, 12), " ").alias("a"), F.array_join(F.when(F.col("duplicate"), less).otherwise(F.slice("w", 13, 12)), " ").alias("b"))
    return dedup.judged(pairs)


_COUNTS = "count_if(duplicate and predicted) as tp, count_if(not duplicate and predicted) as fp, count_if(not duplicate and not predicted) as tn, count_if(duplicate and not predicted) as fn from judged"


@query(f"with {_JUDGED}, counts as (select layer, {_COUNTS} group by layer) {_MEASURES}")
def dedup_eval(spark, d):
    return _rounded(dedup.confusion(_judged(spark, d), ["layer"]), "f1")


@query(f"with {_JUDGED}, counts as (select category, layer, {_COUNTS} group by category, layer) {_MEASURES}")
def dedup_eval_by_category(spark, d):
    return _rounded(dedup.confusion(_judged(spark, d), ["category", "layer"]), "f1")


# --- tasks ---

_SHOWN = ("id", "status", "repo", "created_at")


@query(f"with {V.TASKS} select id, status, repo, created_at, row_number() over (order by created_at desc, id) as place from tasks where status = 'pending'")
def task_by_status(spark, d):
    from quarry.operators.lineage import placed

    return placed(V.tasks(spark, d).filter("status = 'pending'").select(*_SHOWN), F.desc("created_at"), F.col("id"))


@query(f"with {V.TASKS} select id, status, repo, created_at from tasks order by created_at desc, id")
def task_list_recent(spark, d):
    return V.tasks(spark, d).select(*_SHOWN).orderBy(F.desc("created_at"), "id")


@query(f"""with {V.TASKS} select count_if(status in ('executing', 'pending', 'approved', 'created', 'classified')) as first_match, count_if({_SCORED}) as scored,
count_if(status not in ('done', 'failed', 'rejected', 'interrupted')) as counted from tasks""")
def task_active_sets(spark, d):
    s = F.col("status")
    return V.tasks(spark, d).agg(F.count_if(s.isin(*dedup.FIRST_MATCH_ORDER)).alias("first_match"), F.count_if(~s.isin(*dedup.NOT_SCORED)).alias("scored"), F.count_if(~s.isin(*dedup.NOT_COUNTED)).alias("counted"))


_ROLLUP = """count(*) as total, count_if(status in ('pending', 'created', 'classified')) as pending, count_if(status = 'pending_clarification') as needs_clarification,
count_if(status = 'executing') as executing, count_if(status in ('executing', 'queued', 'approved')) as active, cast(coalesce(sum(tokens_used) filter (tokens_used > 0), 0) as bigint) as tokens from tasks"""


@query(f"with {V.TASKS} select repo, {_ROLLUP} group by repo")
def repo_status_rollup(spark, d):
    return lifecycle.rollup(V.tasks(spark, d), "repo")


@query(f"with {V.TASKS} select {_ROLLUP}")
def dashboard_header(spark, d):
    return lifecycle.rollup(V.tasks(spark, d))


@query(f"""with {V.TASKS}, c as (select count_if(status = 'executing') as e, count_if(status in ('pending', 'created', 'classified')) as p, count_if(status = 'pending_clarification') as c,
string_agg('#' || id, ' ' order by id) filter (status = 'executing' and needs_input) as ids from tasks)
select case when line = '' then 'idle' else line end as line from (select concat_ws(' · ', case when e > 0 then e || ' exec' end, case when p > 0 then p || ' pending' end,
case when c > 0 then c || ' needs clarify' end, ids || ' waiting approval') as line from c)""")
def workspace_oneline(spark, d):
    return lifecycle.one_liner(V.tasks(spark, d))


_DASH = "case status when 'executing' then 0 when 'queued' then 1 when 'approved' then 2 when 'pending' then 3 when 'classified' then 3 when 'created' then 4 when 'interrupted' then 5 when 'failed' then 6 when 'done' then 7 when 'rejected' then 8 else 9 end"


@query(f"with {V.TASKS} select id, repo, status, {_DASH} as rank, created_at from tasks order by rank, created_at desc, id")
def dashboard_rows(spark, d):
    return lifecycle.dashboard(V.tasks(spark, d)).select("id", "repo", "status", lifecycle.dashboard_rank(F.col("status")).alias("rank"), "created_at")


@query(f"with {V.TASKS} select repo, id, created_at from tasks where status = 'executing' and needs_input order by created_at, id limit 1")
def oldest_needs_input(spark, d):
    return lifecycle.oldest_needing_input(V.tasks(spark, d))


@query(f"""with {V.TASKS}, q as (select id, row_number() over (order by created_at, id) as place from tasks where status = 'approved')
select id, case when place <= 1 then 'running' else 'queued' end as state, greatest(place - 1, 0) as queue_place from q""")
def fifo_slots(spark, d):
    return lifecycle.slots(V.tasks(spark, d))


@query(f"""with {V.TASKS}, x as (select id, case id % 4 when 0 then 'small' when 1 then 'large' when 2 then 'reject' else 'ambiguous' end as c, id % 5 = 0 as n, id % 2 = 0 as a, id % 3 = 0 as g, id % 7 = 0 as f from tasks)
select id, case when f then 'pending' when c = 'reject' then 'rejected' when n then 'pending_clarification' when c = 'small' and (a or g) then 'approved' else 'pending' end as status from x""")
def post_classify_transition(spark, d):
    i = F.col("id")
    size = F.element_at(F.lit(["small", "large", "reject", "ambiguous"]), (i % 4).cast("int") + 1)
    return V.tasks(spark, d).select("id", lifecycle.after_classification(size, i % 5 == 0, i % 2 == 0, i % 3 == 0, i % 7 == 0).alias("status"))


@query(f"with {V.TASKS} select id, status, case when status in ('pending', 'classified', 'created', 'approved') then 'approved' end as next from tasks")
def approve_transition(spark, d):
    return V.tasks(spark, d).select("id", "status", lifecycle.approved(F.col("status")).alias("next"))


@query(f"with {V.TASKS} select id, case when id % 2 = 0 then 'interrupted' when id % 3 = 0 then 'done' when id % 5 = 0 then 'interrupted' when id % 7 = 0 then 'done' else 'interrupted' end as status from tasks")
def final_status(spark, d):
    i = F.col("id")
    return V.tasks(spark, d).select("id", lifecycle.final_status(i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 7 == 0).alias("status"))


@query(f"with {V.TASKS} select id, case when status = 'executing' then 'interrupted' else status end as status, case when status = 'executing' then '{lifecycle.ORPHAN_RESULT}' end as result from tasks")
def orphan_sweep(spark, d):
    return lifecycle.swept(V.tasks(spark, d).withColumn("result", F.lit(None).cast("string"))).select("id", "status", "result")


@query(f"""with {V.TASKS}, m as (select distinct s_name as branch from supplier)
select id, case when status = 'interrupted' and b in (select branch from m) then 'done' else status end as status from (select *, 'Supplier#' || lpad(cast(id as varchar), 9, '0') as b from tasks)""")
def merged_refresh(spark, d):
    t = V.tasks(spark, d).withColumn("branch", F.concat(F.lit("Supplier#"), F.lpad(F.col("id").cast("string"), 9, "0")))
    return lifecycle.refreshed(t, V.table(spark, d, "supplier").select(F.col("s_name").alias("branch"))).select("id", "status")


# --- steps ---


@query(f"""with {V.STEPS} select task_id, count(*) as total, count_if(status = 'pending') as pending, count_if(status = 'executing') as executing, count_if(status = 'done') as done,
count_if(status = 'failed') as failed, count_if(status = 'skipped') as skipped from steps group by task_id""")
def step_summary(spark, d):
    return lifecycle.step_summary(V.steps(spark, d))


@query(f"with {V.STEPS} select task_id, min(seq) filter (status not in ('done', 'skipped')) as seq from steps group by task_id")
def next_pending_step(spark, d):
    return lifecycle.next_steps(V.steps(spark, d))


@query(f"with {V.STEPS} select task_id, count_if(status = 'done') as done, count(*) as total, min(seq) filter (status = 'failed') as first_failed from steps group by task_id")
def step_progress(spark, d):
    return lifecycle.step_progress(V.steps(spark, d))




@query(f"""select doc_id as task_id, i + 1 as seq, case i when 0 then 'modify' when 1 then 'test' else 'add' end as verb, source || '/' || i as target_file, 'pending' as status,
case when i = 1 then 'small-model' end as model_override from documents, unnest([0, 1, 2]) u(i) where doc_id not in (select conv_id from conversations)""")
def steps_materialize(spark, d):
    step = lambda verb, i: F.struct(F.lit(verb).alias("verb"), F.concat("source", F.lit(f"/{i}")).alias("target_file"))
    plans = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.to_json(F.array(step("modify", 0), step("test", 1), step("add", 2))).alias("plan_json"))
    have = V.table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"))
    return lifecycle.materialised(plans, have, {"test": "small-model"}).select("task_id", "seq", "verb", "target_file", "status", "model_override")


@query(f"""with {V.ATTEMPTS}, p as (select task_id, seq, min(attempt) filter (ok) as won from attempts group by 1, 2),
s as (select *, min(seq) filter (won is null) over (partition by task_id) as stop from p)
select task_id, seq, case when stop is not null and seq > stop then 'pending' when won is not null then 'done' else 'failed' end as status,
case when stop is not null and seq > stop then 0 else coalesce(won, 2) - 1 end as retry_count from s""")
def step_executor(spark, d):
    return lifecycle.executed(V.attempts(spark, d))


# --- scalar functions ---


@query(f"""with w as (select doc_id, list_filter(list_transform(string_split_regex({_LOW.format("coalesce(text, '')")}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: regexp_replace(x, '[^a-z0-9]+', '', 'g')), lambda x: x <> '') as w from documents),
k as (select doc_id, w, list_filter(w, lambda x: not list_contains([{", ".join(f"'{x}'" for x in text.STOP_WORDS)}], x))[1:4] as k from w)
select doc_id, trim(substr(array_to_string(case when len(k) > 0 then k else w[1:3] end, '-'), 1, 40), '-') as name from k""")
def task_slug(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.task_name(F.coalesce("text", F.lit(""))).alias("name"))


_TR = r"regexp_replace({0}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


@query(f"""with l as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_TR.format('x')}), lambda x: x <> '' and x <> '---') as l from documents),
b as (select doc_id, list_filter(list_transform(l, lambda x: {_TR.format(r"regexp_replace(x, '^[#*\- \t]+', '')")}), lambda x: x <> '') as b from l)
select doc_id, case when length(coalesce(b[1], '')) > 120 then substr(b[1], 1, 120) || '…' else coalesce(b[1], '') end as summary from b""")
def result_summary(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.result_summary(F.col("text")).alias("summary"))


@query(rf"""with o as (select doc_id, regexp_replace({_TR.format(r"translate(coalesce(text, ''), chr(10) || chr(13) || chr(9), '   ')")}, ' {{2,}}', ' ', 'g') as o from documents)
select doc_id, case when length(o) > 200 then substr(o, 1, 200) || '…' else o end as line from o""")
def one_line(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.one_line(F.col("text")).alias("line"))


@query("""select o_orderkey, case when n < 1000 then cast(n as varchar) when n < 10000 then printf('%.1fk', n / 1000) when n < 1000000 then (n // 1000) || 'k' else printf('%.1fM', n / 1000000) end as shown
from (select o_orderkey, o_orderkey * 37 as n from orders)""")
def short_tokens(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", text.short_tokens(F.col("o_orderkey") * 37).alias("shown"))


@query("""select o_orderkey, case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' when s < 86400 then (s // 3600) || 'h' else (s // 86400) || 'd' end as age from (select o_orderkey, o_orderkey * 13 as s from orders)""")
def short_age(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", text.short_age(F.col("o_orderkey") * 13).alias("age"))


@query(f"""select c_custkey, {_TR.format("upper(substr(c_mktsegment, 1, 1)) || substr(lower(c_mktsegment), 2) || ' ' || c_name || ' (' || c_mktsegment || ', ' || c_custkey || ') — ok'")} as line from customer""")
def step_lines(spark, d):
    c = V.table(spark, d, "customer")
    return c.select("c_custkey", text.step_line(F.lit(""), F.lower("c_mktsegment"), F.col("c_name"), F.array("c_mktsegment", F.col("c_custkey").cast("string")), F.lit("ok")).alias("line"))


_COMMANDS = ("index", "task", "status", "workspace", "config", "daemon", "doctor", "completion")


@query(f"""with k as (select unnest([{", ".join(f"'{c}'" for c in _COMMANDS)}]) as known, unnest(range(0, {len(_COMMANDS)})) as i), g as (select distinct lower(substr(p_name, 1, instr(p_name || ' ', ' ') - 1)) as given from part),
s as (select given, known, i, 3 * coalesce((select max(n) from unnest(range(1, 12)) u(n) where n <= least(length(given), length(known)) and substr(given, 1, n) = substr(known, 1, n)), 0) - levenshtein(given, known) as score from g, k)
select given, case when score >= 2 then known end as suggestion from s qualify row_number() over (partition by given order by score desc, i) = 1""")
def levenshtein_suggest(spark, d):
    given = V.table(spark, d, "part").select(F.lower(F.substring_index("p_name", " ", 1)).alias("given")).distinct()
    scores = F.array(*[F.struct(text.suggestion_score(F.col("given"), F.lit(c)).alias("score"), F.lit(-i).alias("i"), F.lit(c).alias("known")) for i, c in enumerate(_COMMANDS)])
    best = F.array_max(scores)
    return given.select("given", F.when(best["score"] >= 2, best["known"]).alias("suggestion"))


# --- index ---


@query(f"with {V.SYMBOLS} select ord, substr(sha256(file_path || chr(0) || name || chr(0) || kind || chr(0) || signature), 1, 24) as symbol_id from symbols")
def symbol_ids(spark, d):
    return V.symbols(spark, d).select("ord", text.symbol_id(F.col("file_path"), F.col("name"), F.col("kind"), F.col("signature")).alias("symbol_id"))


@query(f"""with {V.SYMBOLS} select name, arg_max(ord, ord) as ord, arg_max(kind, ord) as kind, count(*) over () * 0 + 1 as one from symbols group by name""")
def symbol_upsert(spark, d):
    last = index.last_per_key(V.symbols(spark, d).select("name", "ord", "kind"), ["name"], [F.col("ord")])
    return last.withColumn("one", F.lit(1).cast("long"))


_FILES = "files as (select file_path as path, count(*) as symbol_count, max(line) as last_modified, sha256(string_agg(name, ',' order by ord)) as content_hash from symbols group by 1)"


def _files(symbols: DataFrame) -> DataFrame:
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ",")
    return symbols.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("symbol_count"), F.max("line").alias("last_modified"), F.sha2(names, 256).alias("content_hash"))


@query(f"""with {V.SYMBOLS}, {_FILES}, new as (select path, symbol_count + 1 as symbol_count from files where last_modified > 45)
select path, symbol_count from files where path not in (select path from new) union all select * from new""")
def file_upsert(spark, d):
    f = _files(V.symbols(spark, d))
    new = f.filter("last_modified > 45").select("path", (F.col("symbol_count") + 1).alias("symbol_count"))
    return index.upsert(f.select("path", "symbol_count"), new, "path")


@query(f"""with {V.EDGES}, {_FILES}, gone as (select path from files where last_modified > 48), dead as (select id from symbols where file_path in (select path from gone))
select (select count(*) from files where path not in (select path from gone)) as files, (select count(*) from symbols where id not in (select id from dead)) as symbols,
(select count(*) from edges where from_id not in (select id from dead) and to_id not in (select id from dead)) as edges""")
def file_cascade_delete(spark, d):
    s = V.symbols(spark, d)
    f = _files(s)
    parts = index.delete_file(f, s, V.edges(spark, d), f.filter("last_modified > 48"))
    counts = [p.agg(F.count("*").alias(n)) for n, p in zip(("files", "symbols", "edges"), parts)]
    return counts[0].join(counts[1]).join(counts[2])


_KEPT = "('function', 'method', 'struct', 'interface', 'class', 'type')"


@query(f"with {V.SYMBOLS} select id, name, kind, line from symbols where kind in {_KEPT} order by line desc, ord limit 20")
def symbols_top(spark, d):
    return V.symbols(spark, d).filter(F.col("kind").isin("function", "method", "struct", "interface", "class", "type")).orderBy(F.desc("line"), "ord").select("id", "name", "kind", "line").limit(20)


@query(f"with {V.SYMBOLS} select file_path, id, name, case when length(signature) > 20 then substr(signature, 1, 20) || '…' else signature end as signature, row_number() over (partition by file_path order by line, ord) as place from symbols")
def file_context(spark, d):
    from pyspark.sql import window as W

    return V.symbols(spark, d).select("file_path", "id", "name", text.cap(F.col("signature"), 20).alias("signature"), F.row_number().over(W.Window.partitionBy("file_path").orderBy("line", "ord")).cast("long").alias("place"))


@query(f"with {V.EDGES}, {_FILES} select (select count(*) from files) as files, (select count(*) from symbols) as symbols, (select count(*) from edges) as edges")
def overview_counts(spark, d):
    s = V.symbols(spark, d)
    return index.counts(_files(s), s, V.edges(spark, d))


#: Kinds stand for languages here; those of files whose last symbol is far down are empty.
@query(f"with {V.SYMBOLS} select distinct kind as language from symbols where line <= 45")
def languages_present(spark, d):
    return index.languages_present(V.symbols(spark, d).select(F.when(F.col("line") > 45, "").otherwise(F.col("kind")).alias("language")))


_TREE = "f as (select distinct file_path as path, coalesce(nullif(regexp_extract(file_path, '^(.+)/[^/]*$', 1), ''), '.') as dir from paths)"


def _tree_sql(paths):
    return f"""with {V.SYMBOLS}, paths as ({paths}), {_TREE}
    select path as line from f where (select count(*) from f) <= 200 union all
    select dir || '/ (' || count(*) || ' files)' from f where (select count(*) from f) > 200 group by dir"""


@query(_tree_sql("select file_path from symbols union all select 'main.go'"))
def file_tree(spark, d):
    paths = V.symbols(spark, d).select(F.col("file_path").alias("path")).union(spark.createDataFrame([("main.go",)], "path string"))
    return index.file_tree(paths.distinct())


@query(_tree_sql("select r_name || '/' || n_name as file_path from nation join region on r_regionkey = n_regionkey union all select r_name from region"))
def file_tree_small(spark, d):
    n, r = V.table(spark, d, "nation"), V.table(spark, d, "region")
    paths = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat("r_name", F.lit("/"), "n_name").alias("path")).union(r.select("r_name"))
    return index.file_tree(paths)


@query(f"with {V.EDGES} select from_id, to_id from edges")
def call_edges(spark, d):
    return V.edges(spark, d)


def _hub(spark, d):
    return V.table(spark, d, "part").agg(F.max_by(F.col("p_partkey").cast("string"), F.struct("p_name", "p_partkey")).alias("hub"))


_HUB = "(select arg_max(cast(p_partkey as varchar), p_name || lpad(cast(p_partkey as varchar), 12, '0')) from part)"


@query(f"with {V.EDGES} select s.id, s.name from symbols s where id in (select from_id from edges where to_id = {_HUB})")
def callers(spark, d):
    hub = _hub(spark, d).first()[0]
    return graph.callers(V.symbols(spark, d), V.edges(spark, d), F.lit(hub)).select("id", "name")


@query(f"with {V.EDGES} select s.id, s.name from symbols s where id in (select to_id from edges where from_id = {_HUB})")
def callees(spark, d):
    hub = _hub(spark, d).first()[0]
    return graph.callees(V.symbols(spark, d), V.edges(spark, d), F.lit(hub)).select("id", "name")


@query(f"with {V.EDGES} select id, count(to_id) as out_degree from symbols left join edges on from_id = id group by id")
def dangling_nodes(spark, d):
    return graph.out_degrees(V.symbols(spark, d), V.edges(spark, d))


@query(f"""with recursive {V.EDGES}, od as materialized (select s.id, count(e.to_id) o from symbols s left join edges e on e.from_id = s.id group by s.id), nn as (select count(*)::double n from symbols),
r(i, id, rk) as (select 0, id, 1.0::double / (select n from nn) from symbols union all
  (select i, id, 0.15 / (select n from nn) + 0.85 * (sum(dang) over ()) / (select n from nn) + 0.85 * inc from
    (select max(i) + 1 as i, id, sum(d) as dang, sum(c) as inc from
      (select p.i, p.id as id, case when od.o = 0 then p.rk else 0 end as d, 0.0 as c from r p join od on od.id = p.id
       union all select p.i, e.to_id, 0.0, p.rk / od.o from r p join od on od.id = p.id join edges e on e.from_id = p.id) x group by id) y where i <= 20))
select id, round(rk, 6) as rank from r where i = 20""")
def pagerank(spark, d):
    return _rounded(graph.pagerank(V.symbols(spark, d), V.edges(spark, d)), "rank", digits=6)


_WANTED = "large widget plate"


#: A symbol is listed while at most 20 lines stand before it; its callers and callees are its lines.
@query(f"""with {V.EDGES}, w as (select id, ord, name from symbols where {' or '.join(f"contains(lower(name), '{x}')" for x in _WANTED.split() if len(x) > 3)}),
l as (select w.id, w.ord, 'caller' as direction, o.name || '() → ' || w.name || '()' as line, o.id as other_id from w join edges on to_id = w.id join symbols o on o.id = from_id
 union all select w.id, w.ord, 'callee', w.name || '() → ' || o.name || '()', o.id from w join edges on from_id = w.id join symbols o on o.id = to_id),
p as (select id, sum(count(*)) over (order by ord, id) - count(*) as before from l group by id, ord)
select ord, direction, line, other_id from l join p using (id) where before <= 20""")
def relevant_edges(spark, d):
    return graph.relevant_edges(V.symbols(spark, d), V.edges(spark, d), _WANTED)


_SOLD = "(select cast(l_partkey as varchar) from lineitem where l_shipdate {0} date '1995-06-17')"
_SNAPS = f"a as (select id, kind, signature from symbols where id in {_SOLD.format('<')}), b as (select id, case when line > 40 then 'module' else kind end as kind, signature from symbols where id in {_SOLD.format('>=')})"


@query(f"""with {V.SYMBOLS}, {_SNAPS} select id, case when a.id is null then 'added' when b.id is null then 'removed' else 'changed' end as change
from a full join b using (id) where a.id is null or b.id is null or a.kind <> b.kind or a.signature <> b.signature""")
def snapshot_diff(spark, d):
    s = V.symbols(spark, d)
    sold = V.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("id"), (F.col("l_shipdate") < F.lit("1995-06-17").cast("date")).alias("early"))
    before = s.join(sold.filter("early").select("id"), "id", "left_semi")
    after = s.join(sold.filter("not early").select("id"), "id", "left_semi").withColumn("kind", F.when(F.col("line") > 40, "module").otherwise(F.col("kind")))
    return index.snapshot_diff(before, after)


@query(f"with {V.SYMBOLS}, {_FILES} select path from files where path not in (select file_path from symbols where line > 40)")
def deleted_files(spark, d):
    s = V.symbols(spark, d)
    return index.deleted_files(_files(s), s.filter("line > 40").select(F.col("file_path").alias("path")).distinct()).select("path")


@query(f"""with {V.SYMBOLS}, {_FILES}, w as (select file_path as path, count(*), max(line) as last_modified, sha256(string_agg(name, ',' order by ord)) as content_hash from symbols where kind <> 'enum' group by 1)
select w.path, case when f.path is null then 'parse' when f.last_modified = w.last_modified then 'same_time' when f.content_hash = w.content_hash then 'same_content' else 'parse' end as action
from w left join (select * from files where symbol_count > 1) f on f.path = w.path""")
def change_detection(spark, d):
    s = V.symbols(spark, d)
    return index.change_plan(_files(s).filter("symbol_count > 1"), _files(s.filter("kind <> 'enum'")))


# --- search ---


def _docs(spark, d):
    return V.symbols(spark, d).withColumn("doc_comment", F.col("file_path"))


_COLS = ["id", "name", "signature", "doc_comment"]
_BM = rf"""d as (select id, list_concat(list_concat({{t1}}, ['|']), list_concat(list_concat({{t2}}, ['|']), list_concat(list_concat({{t3}}, ['|']), {{t4}}))) as t from symbols),
n as (select count(*)::double as n, avg(len(t) - 3) as avglen from d)"""
_TERMS = "regexp_extract_all({0}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
_BM = _BM.format(**{f"t{i + 1}": _TERMS.format(_LOW.format(c)) for i, c in enumerate(("id", "name", "signature", "file_path"))})


def _bm25(match: str, phrases: dict[str, str], ranked: list[str]) -> str:
    """phrases: name to an expression of how often array t holds it."""
    cols = ", ".join(f"{e} as f_{k}" for k, e in phrases.items())
    idf = ", ".join(f"case when count_if(f_{k} > 0) = 0 or ln((any_value(n) - count_if(f_{k} > 0) + 0.5) / (count_if(f_{k} > 0) + 0.5)) <= 0 then 1e-6 else ln((any_value(n) - count_if(f_{k} > 0) + 0.5) / (count_if(f_{k} > 0) + 0.5)) end as i_{k}" for k in phrases)
    score = " + ".join(f"case when f_{k} > 0 then i_{k} * f_{k} * 2.2 / (f_{k} + 1.2 * (0.25 + 0.75 * (len(t) - 3) / avglen)) else 0 end" for k in ranked)
    return f"with {V.SYMBOLS}, {_BM}, f as (select id, t, {cols} from d), i as (select {idf} from f, n) select id, round(-({score}), 9) as score from f, i, n where {match}"


_has = lambda w: f"len(list_filter(t, lambda x: x = '{w}'))"
_starts = lambda w: f"len(list_filter(t, lambda x: starts_with(x, '{w}')))"
_pair = lambda a, b: f"len(list_filter(range(1, len(t)), lambda i: t[i] = '{a}' and t[i + 1] = '{b}'))"


def _search(spark, d, q):
    return _rounded(search.search(_docs(spark, d), q, "id", _COLS, limit=None), "score")


@query(_bm25("f_a > 0 or f_b > 0", {"a": _has("red"), "b": _has("widget")}, ["a", "b"]))
def search_bm25(spark, d):
    return _search(spark, d, "red widget")


@query(_bm25("f_a > 0", {"a": _starts("wid")}, ["a"]))
def search_prefix(spark, d):
    return _search(spark, d, "wid*")


@query(_bm25("f_a > 0 and f_b > 0", {"a": _has("red"), "b": _has("promo")}, ["a", "b"]))
def search_and(spark, d):
    return _search(spark, d, "red AND promo")


@query(_bm25("f_a > 0 and not f_b > 0", {"a": _has("red"), "b": _has("promo")}, ["a"]))
def search_not(spark, d):
    return _search(spark, d, "red NOT promo")


@query(_bm25("f_a > 0", {"a": _pair("red", "bolt")}, ["a"]))
def search_phrase(spark, d):
    return _search(spark, d, '"red bolt"')


# --- usage ---


@query("""with u as (select conv_id, turn, length(coalesce(text, '')) as n from conversations where role = 'assistant')
select conv_id as session_id, count(*) as turns, cast(sum(n) as bigint) as input_tokens, cast(sum(n // 3) as bigint) as output_tokens, cast(sum(7 * n) as bigint) as cache_read_input_tokens,
count_if(n % 2 = 0) as tool_calls, cast(sum(n) + sum(7 * n) // 10 as bigint) as effective_input, cast((max(turn % 60) - min(turn % 60)) * 60000 as bigint) as wall_clock_ms from u group by conv_id""")
def session_usage(spark, d):
    return usage.session_usage(usage.parsed_sessions(V.session_lines(spark, d))).select("session_id", "turns", "input_tokens", "output_tokens", "cache_read_input_tokens", "tool_calls", "effective_input", "wall_clock_ms")


@query("""with u as (select conv_id, length(coalesce(text, '')) as n from conversations where role = 'assistant')
select conv_id as session_id, case when n % 4 = 0 then 'search' else 'graph' end as tool, count(*) as calls from u where n % 2 = 0 group by 1, 2""")
def session_tools(spark, d):
    u = usage.session_usage(usage.parsed_sessions(V.session_lines(spark, d)))
    return u.select("session_id", F.explode("tool_calls_by_name").alias("tool", "calls"))


_RUNS = """runs as (select l_returnflag || l_linestatus as repo, l_suppkey as task_id, case l_linenumber % 3 when 0 then 'classify' when 1 then 'baseline' else 'mcp' end as variant,
  lpad(cast(l_orderkey as varchar), 12, '0') || l_linenumber || lpad(cast(l_partkey as varchar), 12, '0') || lpad(cast(cast(l_quantity as integer) as varchar), 6, '0') as path, cast(l_quantity as double) as wall, cast(l_partkey as bigint) as eff, cast(l_linenumber as bigint) as tools from lineitem),
last as (select repo, task_id, variant, arg_max(wall, path) as wall, arg_max(eff, path) as eff, arg_max(tools, path) as tools from runs group by 1, 2, 3),
tab as (select repo, task_id, coalesce(max(wall) filter (variant = 'classify'), 0) as classify_wall, coalesce(max(eff) filter (variant = 'baseline'), 0) as baseline, coalesce(max(eff) filter (variant = 'mcp'), 0) as mcp,
  coalesce(max(tools) filter (variant = 'baseline'), 0) as baseline_tools, coalesce(max(tools) filter (variant = 'mcp'), 0) as mcp_tools from last group by 1, 2)"""


def _runs(spark, d):
    line = V.table(spark, d, "lineitem")
    variant = F.element_at(F.lit(["classify", "baseline", "mcp"]), (F.col("l_linenumber") % 3).cast("int") + 1)
    path = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 6, "0"))
    rows = line.select(F.concat("l_returnflag", "l_linestatus").alias("repo"), F.col("l_suppkey").alias("task_id"), variant.alias("variant"), path.alias("path"), F.col("l_quantity").cast("double").alias("wall_clock_sec"), F.col("l_partkey").cast("long").alias("effective"), F.col("l_linenumber").cast("long").alias("tool_calls"))
    return usage.variant_table(usage.latest_runs(rows))


@query(f"with {_RUNS} select repo, task_id, classify_wall, baseline, mcp, round(case when baseline > 0 then mcp / baseline else 0 end, 9) as ratio, baseline_tools, mcp_tools from tab")
def bench_ratio(spark, d):
    return _rounded(_runs(spark, d), "ratio")


@query(f"with {_RUNS} select count_if(baseline > 0) as tasks, round(sum(mcp) filter (baseline > 0) / sum(baseline) filter (baseline > 0), 9) as ratio, round((1 - sum(mcp) filter (baseline > 0) / sum(baseline) filter (baseline > 0)) * 100, 6) as reduction_pct from tab")
def bench_overall(spark, d):
    return usage.overall(_runs(spark, d)).select("tasks", F.round("ratio", 9).alias("ratio"), F.round("reduction_pct", 6).alias("reduction_pct"))


# --- lines and files ---


@query(r"select conv_id, turn, regexp_matches(coalesce(text, ''), '(?i)press\s+(enter|return)\s+to\s+continue|(?i)do you want to proceed\??|(?i)continue\??\s*\[y/n\]|(?i)continue\??\s*\(y/n\)|(?i)apply these edits\??|(?i)confirm\??\s*\[y/n\]|(?i)\(y/n\)\s*:?\s*$|(?i)\[y/n\]\s*:?\s*$') as hit from conversations")
def approval_prompt_hits(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", lifecycle.wants_approval(F.col("text")).alias("hit"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d 00:00:00') || ' order ' || o_orderkey as value from orders where o_orderdate > date '1995-01-11'""")
def log_retention(spark, d):
    lines = V.table(spark, d, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" order "), F.col("o_orderkey").cast("string")).alias("value"))
    return L.retained(lines, F.lit("1995-01-21 00:00:00").cast("timestamp"))


@query("""select l_orderkey, l_linenumber, l_returnflag as layer, l_discount > 0.05 as hit, round(cast(l_discount as double), 3) as score, cast(l_quantity as bigint) as ms, cast(l_partkey as bigint) as cand from lineitem""")
def dedup_log_parse(spark, d):
    none = F.lit(None).cast("string")
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    line = V.table(spark, d, "lineitem")
    made = line.select(L.dedup_log_line(at, F.col("l_returnflag"), F.col("l_discount") > 0.05, F.col("l_discount").cast("double"), F.col("l_quantity").cast("long"), F.col("l_partkey").cast("long"), none, F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_returnflag")), none).alias("value"))
    got = L.parsed_dedup_log(made)
    part = lambda i: F.split("reason", "/")[i]
    return got.select(part(0).cast("long").alias("l_orderkey"), part(1).cast("long").alias("l_linenumber"), part(2).alias("layer"), "hit", "score", "ms", "cand")


_EXTS = ("main.go", "app.tsx", "index.mjs", "tool.py", "README.md", "Dockerfile", "x.dockerfile", "package.json", "data.json", "App.kt", "a.TF", "Makefile")
_LANGS = ("go", "typescript", "javascript", "python", "", "dockerfile", "dockerfile", "json", "", "kotlin", "terraform", "")


@query(f"select p_partkey, {V._pick_sql('p_partkey', _LANGS)} as language from part")
def detect_language(spark, d):
    p = V.table(spark, d, "part")
    return p.select("p_partkey", index.language(F.concat("p_brand", F.lit("/"), V._pick(F.col("p_partkey"), _EXTS))).alias("language"))


@query("""select p_partkey, p_brand = 'Brand#12' or contains(p_type, 'ECON') or p_name like 'red%' as ignored from part""")
def ignore_filter(spark, d):
    p = V.table(spark, d, "part")
    path = F.concat("p_brand", F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), "p_name")
    return p.select("p_partkey", index.ignored(path, ["Brand#12/", "*ECON*/", "red*"]).alias("ignored"))


@query("""select c_custkey, c_name as name, 'deployment' as kind, 'Deployment: ' || c_name as signature, 3 as line from customer union all select c_custkey, 'spec', 'yaml-key', 'spec:', 1 from customer""")
def parse_yaml_keys(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.concat(F.lit("spec:\n  kind: Deployment\n  name: "), "c_name", F.lit("\n  name: other\n# kind: no\n")).alias("content"))
    return L.yaml_symbols(L.numbered(c)).select(F.col("path").cast("long").alias("c_custkey"), "name", "kind", "signature", "line")


@query("""select c_custkey, 'aws_x.' || c_name as name, 'resource' as kind from customer union all select c_custkey, c_mktsegment, 'variable' from customer union all select c_custkey, 'locals', 'locals' from customer""")
def parse_terraform(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.concat(F.lit('resource "aws_x" "'), "c_name", F.lit('" {\n}\n  variable "'), "c_mktsegment", F.lit('" {}\nlocals {\n# data "a" "b"\n')).alias("content"))
    return L.terraform_symbols(L.numbered(c)).select(F.col("path").cast("long").alias("c_custkey"), "name", "kind")


@query("""select c_custkey, 'FROM' as name, 'dockerfile-from' as kind, c_name as doc_comment from customer union all select c_custkey, 'ENV', 'dockerfile-env', 'A=' || c_mktsegment from customer""")
def parse_dockerfile(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.concat(F.lit("from "), "c_name", F.lit("\nRUN x\n# ENV B=1\nENV A="), "c_mktsegment").alias("content"))
    return L.dockerfile_symbols(L.numbered(c)).select(F.col("path").cast("long").alias("c_custkey"), "name", "kind", "doc_comment")


@query("""select c_custkey, 'name' as name, 2 as line from customer union all select c_custkey, 'last', 6 from customer""")
def parse_json_depth(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.concat(F.lit('{\n  "name": "'), "c_name", F.lit('",\n  "deps": {\n    "inner": 1\n  },\n  "last": 2\n}\n')).alias("content"))
    return L.json_symbols(L.numbered(c)).select(F.col("path").cast("long").alias("c_custkey"), "name", "line")


@query("""select c_custkey, c_name as name, case c_custkey % 4 when 0 then 'function' when 1 then 'variable' when 2 then 'module' else 'odd' end as kind, 'def ' || c_name as signature from customer""")
def ctags_kinds(spark, d):
    kind = V._pick(F.col("c_custkey"), ("func", "member", "namespace", "odd"))
    rows = V.table(spark, d, "customer").select(F.to_json(F.struct(F.lit("tag").alias("_type"), F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("path"), F.lit(1).alias("line"), kind.alias("kind"), F.concat(F.lit("/^  def "), "c_name", F.lit("$/")).alias("pattern"))).alias("value"))
    return L.tags(rows).select(F.col("path").cast("long").alias("c_custkey"), "name", "kind", "signature")


@query("""select c_custkey, 1 as n, c_name as question, 'yes' || chr(10) || c_mktsegment as answer from customer union all select c_custkey, 2, 'why', '' from customer""")
def clarify_parse(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.concat(F.lit("# head\nQ1: "), "c_name", F.lit("\nA1: yes\n"), "c_mktsegment", F.lit("\n---\nQ2: why\nA2:\n")).alias("content"))
    return L.clarifications(L.numbered(c)).select(F.col("path").cast("long").alias("c_custkey"), "n", "question", "answer")


@query("""select c_custkey, c_name as name, '/' || c_mktsegment as path from customer""")
def registry_entries(spark, d):
    one = F.struct(F.create_map(F.col("c_name"), F.struct(F.concat(F.lit("/"), "c_mktsegment").alias("path"))).alias("agents"))
    found = L.registry(V.table(spark, d, "customer").select(F.to_json(one).alias("value")))
    return found.join(V.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name")), "name").select("c_custkey", "name", "path")


@query("""select l_orderkey, l_linenumber, list_sort(list_distinct(['f', p_brand])) as refs from lineitem join part on p_partkey = l_partkey""")
def call_ref_names(spark, d):
    rows = V.table(spark, d, "lineitem").join(V.table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    calls = F.array(F.lit("a.b.f"), F.concat(F.lit("x."), "p_brand"), F.lit("f"))
    return rows.select("l_orderkey", "l_linenumber", F.array_sort(F.array_distinct(F.transform(calls, lambda c: F.substring_index(c, ".", -1)))).alias("refs"))


# --- texts that need a scanner, extraction, admission and event windows ---


@query("""select conv_id, turn, '{"classification": "small", "n": ' || turn || '}' as found from conversations""")
def extract_classification(spark, d):
    from quarry.functions import parsing

    said = F.concat(F.lit('Sure {not json} {"x": 1} then {"classification": "small", "n": '), F.col("turn").cast("string"), F.lit("} done {"))
    return V.table(spark, d, "conversations").select("conv_id", "turn", parsing.extract_classification(said).alias("found"))


@query("""select c_custkey, c_name as second, 3 as n from customer""")
def shlex_words(spark, d):
    from quarry.functions import parsing

    words = parsing.shlex_split(F.concat(F.lit("run '"), "c_name", F.lit("' \"a \\\" b\"")))
    return V.table(spark, d, "customer").select("c_custkey", words.alias("w")).select("c_custkey", F.col("w")[1].alias("second"), F.size("w").alias("n"))


@query("""select p_partkey, f || p_partkey as name, k as kind, s as parent_name from part, (values ('Server', 'struct', ''), ('start', 'method', 'Server'), ('make', 'function', '')) v(f, k, s)""")
def extract_symbols(spark, d):
    from quarry.sources import extract

    n = F.col("p_partkey").cast("string")
    code = F.concat(F.lit("package p\n\n// doc\ntype Server"), n, F.lit(" struct {\n\ta int\n}\n\nfunc (s *Server) start"), n, F.lit("() error {\n\treturn nil\n}\n\nfunc make"), n, F.lit("(x string) {\n\ty.start(x)\n}\n"))
    found = extract.symbols(V.table(spark, d, "part").select(n.alias("path"), F.lit("go").alias("language"), code.alias("content")))
    return found.select(F.col("path").cast("long").alias("p_partkey"), "name", "kind", "parent_name")


@query()
def admit_in_order(spark, d):
    return dedup.admit(V.tasks(spark, d), V.new_tasks(spark, d)).select("new_id", "accepted")


def _events(spark, d):
    return V.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""select time_bucket(interval '10 minutes', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def event_windows(spark, d):
    from quarry.streaming import tasks as S

    return S.windowed_counts(_events(spark, d)).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with e as (select user_id, ts, case when ts - lag(ts) over w >= interval '30 minutes' or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from e)
select user_id, min(ts) as start, count(*) as n from s group by user_id, s""")
def event_sessions(spark, d):
    from quarry.streaming import tasks as S

    return S.sessions(_events(spark, d)).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")
