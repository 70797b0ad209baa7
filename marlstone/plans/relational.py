"""Declarative queries over the driver's tables: one statement each, for both dialects."""

PLANS: dict = {}


def plan(f):
    PLANS[f.__name__] = f
    return f


def _stats(d, text="text"):
    t = f"coalesce({text}, '')"
    lines = f"cast(sum(length({t}) - length(replace({t}, {d.nl}, '')) + case when {t} <> '' and right({t}, 1) <> {d.nl} then 1 else 0 end) as bigint) as n_lines"
    return f"count(*) as n_files, {lines}, cast(sum({d.words(t)}) as bigint) as n_words, cast(sum(length({t})) as bigint) as n_chars"


@plan
def text_stats_by_lang(d):
    return f"select coalesce(lang, 'TOTAL') as label, {_stats(d)} from {d.table('documents')} group by rollup(lang)"


@plan
def text_stats_by_source_top(d):
    return f"select source, {_stats(d)} from {d.table('documents')} group by source order by n_chars desc, source"


def _chat(d, keys):
    side = lambda r, x: f"cast(sum(case when role = '{r}' then {x} else 0 end) as bigint)"
    return f"""select {keys}, user_turns, ai_turns, user_words, ai_words, user_chars, ai_chars,
      case when user_words + ai_words = 0 then 0.0 else user_words * 100.0D / (user_words + ai_words) end as user_pct,
      case when user_words + ai_words = 0 then 100.0 else 100.0D - user_words * 100.0D / (user_words + ai_words) end as ai_pct
    from (select conv_id, {side('user', '1')} as user_turns, {side('assistant', '1')} as ai_turns, {side('user', d.words('text'))} as user_words, {side('assistant', d.words('text'))} as ai_words,
      {side('user', 'length(text)')} as user_chars, {side('assistant', 'length(text)')} as ai_chars from {d.table('conversations')} where role in ('user', 'assistant') group by %s) s"""


@plan
def chat_stats(d):
    return (_chat(d, "conv_id") % "conv_id").replace("100.0D", "cast(100 as double)").replace("then 0.0 ", "then cast(0 as double) ").replace("then 100.0 ", "then cast(100 as double) ")


@plan
def chat_stats_rollup(d):
    return chat_stats(d).replace("group by conv_id", "group by grouping sets ((conv_id), ())")


@plan
def chat_role_split(d):
    return f"""select side, n_turns, n_words, cast(n_words as double) * 100 / nullif(sum(n_words) over (), 0) as pct from (
      select case when {d.matches('lower(role)', 'human|user|mensch')} then 'USER' else 'ASSISTANT' end as side, count(*) as n_turns, cast(sum({d.words('text')}) as bigint) as n_words from {d.table('conversations')} group by 1) s"""


@plan
def chat_trim_head_tail(d):
    return f"""select conv_id, turn, n, case when n > 4 and rn = 3 then true else false end as banner_before from (
      select conv_id, turn, row_number() over (partition by conv_id order by turn) as rn, count(*) over (partition by conv_id) as n from {d.table('conversations')}) s where rn <= 2 or rn > n - 2"""


@plan
def chat_transcript(d):
    cut = "case when length(text) > 500 then concat(substring(text, 1, 500), '[...]') else text end"
    return f"select conv_id, {d.joined('turn', f'concat(upper(role), {chr(39)}: {chr(39)}, {cut})', d.nl)} as transcript from {d.table('conversations')} group by conv_id"


@plan
def chat_prev_user_turn(d):
    last = d.last_before("case when role = 'user' then turn end", "conv_id", "turn")
    return f"select conv_id, turn, prev_user from (select conv_id, turn, role, {last} as prev_user from {d.table('conversations')}) s where role = 'assistant'"


@plan
def chat_first_truthy(d):
    return f"select doc_id, coalesce(nullif(lang, ''), nullif(source, ''), 'unknown') as label from {d.table('documents')} where coalesce(nullif(source, ''), nullif(lang, '')) like 'src1%'"


@plan
def doc_mode(d):
    return f"select case when length(text) <= 8000 then 'direct' else 'chunked' end as mode, count(*) as n, cast(sum(length(text)) as bigint) as n_chars from {d.table('documents')} group by 1"


def _chunks(d):
    def end(s, n, t):
        hi = f"least({s} + 8000, {n})"
        w = f"substring({t}, {s} + 4001, {hi} - ({s} + 4000))"
        at = f"strpos(reverse({w}), {d.nl})" if d.__name__ == "Duck" else f"instr(reverse({w}), {d.nl})"
        return f"case when {hi} < {n} and {at} > 0 then {hi} - {at} + 1 else {hi} end"

    i = lambda x: f"cast({x} as integer)"
    return f"""{d.recursive} c as (
      select doc_id, {i('1')} as idx, {i('0')} as s, {i(end('0', 'length(text)', 'text'))} as e, {i('length(text)')} as n, text from {d.table('documents')} where length(text) > 8000
      union all
      select doc_id, {i('idx + 1')}, {i('e - 400')}, {i(end('(e - 400)', 'n', 'text'))}, n, text from c where e < n)"""


@plan
def doc_chunks(d):
    return _chunks(d) + " select doc_id, idx, s as start_at, e as end_at, e - s as len from c"


@plan
def doc_chunk_merge(d):
    return _chunks(d) + f" select doc_id, count(*) as n, {d.joined('idx', 'substring(text, s + 1, 80)', d.nl)} as merged from c group by doc_id"


def _norm(d):
    step = d.replace_all("lower(text)", r"[ \t\r\n_-]+", " ")
    return f"trim({d.replace_all(step, r'[^\pL\pN_ ]', '')})"


@plan
def doc_dedup_latest(d):
    return f"select doc_id, n from (select doc_id, count(*) over (partition by k) as n, row_number() over (partition by k order by doc_id desc) as rn from (select doc_id, {_norm(d)} as k from {d.table('documents')}) a) b where rn = 1"


@plan
def doc_dup_skipped(d):
    return f"select doc_id, kept_id from (select doc_id, max(doc_id) over (partition by k) as kept_id from (select doc_id, {_norm(d)} as k from {d.table('documents')}) a) b where doc_id <> kept_id"


def _links(d):
    return f"(select page_id, {d.extract_all('html', 'href=.([^ >]+).>', 1)} as href from {d.table('pages')})"


@plan
def page_links(d):
    return f"select page_id, href, count(*) as n from {_links(d)} l group by page_id, href"


@plan
def link_degree(d):
    return f"select href, count(*) as usages, count(distinct page_id) as n_pages, count(distinct page_id) >= 5 as coupled from {_links(d)} l group by href"


@plan
def url_id(d):
    return f"select page_id, {d.extract('url', '^[a-z]+://([^/?#]+)', 1)} as host, {d.extract('url', '^[a-z]+://[^/?#]+([^?#]*)', 1)} as path, coalesce(nullif({d.extract('url', '/([0-9]+)([?#].*)?$', 1)}, ''), 'unknown') as id from {d.table('pages')}"


@plan
def ext_classify(d):
    return f"""select label, count(*) as n from (select case e when '' then '(none)' when '.html' then 'HTML' when '.com' then 'Host' when '.php' then 'PHP' else concat('Other (', e, ')') end as label
      from (select {d.extract('url', '([.][a-z]+)[^.]*$', 1)} as e from {d.table('pages')}) a) b group by label"""


def _hits(d):
    rules = "(select 1 as ix, 'contact' as target, 'email' as rule union all select 2, 'contact', 'phone' union all select 1, 'legal', 'license' union all select 1, 'number', 'digits')"
    match = f"""(rule = 'email' and {d.matches('line', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')}) or (rule = 'phone' and {d.matches('line', '[+][0-9][0-9 ().-]+')})
      or (rule = 'license' and {d.matches('line', '[Ll]icen[sc]e')}) or (rule = 'digits' and {d.matches('line', '[0-9][0-9][0-9]+')})"""
    return f"(select doc_id, lineno, line, target, rule from (select doc_id, lineno, line, target, rule, row_number() over (partition by doc_id, lineno, target order by ix) as rn from {d.lines(d.table('documents'), 'doc_id', 'text')} l join {rules} r on {match}) h where rn = 1)"


@plan
def rule_hits(d):
    return f"select doc_id, lineno, target, rule from {_hits(d)} x"


@plan
def rule_hits_by_target(d):
    q = lambda v: f"count(case when verdict = '{v}' then 1 end) as {v}"
    return f"""select target, {q('relevant')}, {q('not_relevant')}, {q('unsure')}, count(*) as total from (
      select h.target, case when l.quality = 1 then 'relevant' when l.quality = 0 then 'not_relevant' else 'unsure' end as verdict from {_hits(d)} h left join {d.table('labels')} l on h.doc_id = l.doc_id) v group by target"""


@plan
def hit_context(d):
    near = f"(select h.doc_id, h.lineno, h.target, l.lineno as near_no, concat(case when l.lineno = h.lineno then '> ' else '  ' end, l.line) as shown from {_hits(d)} h join {d.lines(d.table('documents'), 'doc_id', 'text')} l on h.doc_id = l.doc_id and l.lineno between h.lineno - 3 and h.lineno + 3)"
    return f"select doc_id, lineno, target, count(*) as n, {d.joined('near_no', 'shown', d.nl)} as context from {near} c group by doc_id, lineno, target"


@plan
def verdict_cache(d):
    return f"select d.doc_id, case when l.quality = 1 then 'relevant' when l.quality = 0 then 'not_relevant' else 'unsure' end as verdict, case when l.doc_id is null then 'offline' else 'cache' end as origin from {d.table('documents')} d left join {d.table('labels')} l on d.doc_id = l.doc_id"


@plan
def verdict_todo(d):
    return f"select d.doc_id from {d.table('documents')} d left anti join {d.table('labels')} l on d.doc_id = l.doc_id" if d.__name__ == "Spark" else "select doc_id from documents where doc_id not in (select doc_id from labels)"


@plan
def verdict_key(d):
    return f"select doc_id, substr({d.sha256('concat(source, chr(124), cast(doc_id as ' + ('string' if d.__name__ == 'Spark' else 'varchar') + '), chr(124), text)')}, 1, 16) as cache_key from {d.table('documents')}"


@plan
def whitelist_filter(d):
    return f"select d.doc_id, length(d.text) as len from {d.table('documents')} d where length(d.text) < 500 and not exists (select 1 from {d.table('labels')} l where l.doc_id = d.doc_id and l.toxic = 1)"


@plan
def superset_label(d):
    return f"select d.doc_id, case when k.doc_id is null then 'test_only' else 'everywhere' end as status from {d.table('documents')} d left join (select max(doc_id) as doc_id from {d.table('documents')} group by text) k on d.doc_id = k.doc_id where length(d.text) < 500"


@plan
def graph_internal_external(d):
    return f"select case when p.p_partkey is null then 'external' else 'internal' end as kind, count(*) as n, count(distinct l.l_orderkey) as n_orders from {d.table('lineitem')} l left join (select p_partkey from {d.table('part')} where p_size <= 25) p on l.l_partkey = p.p_partkey group by 1"


@plan
def graph_inverse(d):
    return f"select p.p_partkey, coalesce(i.n, 0) as importers, coalesce(i.n, 0) = 0 as is_entry, coalesce(i.n, 0) >= 5 as coupled from {d.table('part')} p left join (select l_partkey, count(distinct l_orderkey) as n from {d.table('lineitem')} group by l_partkey) i on p.p_partkey = i.l_partkey"


@plan
def callers(d):
    return f"select l_suppkey, count(*) as usages, count(distinct l_orderkey) as n_callers from {d.table('lineitem')} group by l_suppkey"


@plan
def coupled_top(d):
    return f"select l_partkey, n from (select l_partkey, count(distinct l_orderkey) as n from {d.table('lineitem')} group by l_partkey) x where n >= 5 order by n desc, l_partkey limit 50"


def _side(d, name, year):
    return f"{name} as (select o_custkey as c, o_orderpriority as p, o_orderstatus as s from {d.table('orders')} where extract(year from o_orderdate) = {year})"


def _flips(d):
    rank = lambda x: f"case {x} when 'F' then 0 when 'O' then 1 else 2 end"
    return f"""with {_side(d, 'a', 1995)}, {_side(d, 'b', 1996)},
      sa as (select c, p, max(s) as s from a group by c, p having count(*) = 1), sb as (select c, p, max(s) as s from b group by c, p having count(*) = 1),
      f as (select sa.c, sa.p, sa.s as s_from, sb.s as s_to, case when {rank('sb.s')} > {rank('sa.s')} then 'regression' else 'improvement' end as category from sa join sb on sa.c = sb.c and sa.p = sb.p where sa.s <> sb.s)"""


@plan
def delta_flipped(d):
    return _flips(d) + " select category, c, p, s_from, s_to from f"


@plan
def delta_new_removed(d):
    left = lambda x, y, name: f"select '{name}' as category, x.c, x.p, x.s from (select distinct c, p, s from {x}) x where not exists (select 1 from {y} y where y.c = x.c and y.p = x.p and y.s = x.s) and not exists (select 1 from f where f.c = x.c and f.p = x.p)"
    return f"{_flips(d)} {left('b', 'a', 'new')} union all {left('a', 'b', 'removed')}"


@plan
def delta_accepted(d):
    return _flips(d) + f" select f.category, f.c, f.p, f.s_from, f.s_to, k.c_custkey is not null as accepted from f left join (select c_custkey from {d.table('customer')} where c_mktsegment = 'BUILDING') k on f.c = k.c_custkey"


@plan
def delta_thresholds(d):
    over = lambda y: f"(select l_partkey, count(*) as n from {d.table('lineitem')} where extract(year from l_shipdate) = {y} group by l_partkey having count(*) > 5)"
    side = lambda a, b, w: f"select '{w}' as category, a.l_partkey, a.n from {over(a)} a where not exists (select 1 from {over(b)} b where b.l_partkey = a.l_partkey)"
    return f"{side(1996, 1995, 'new')} union all {side(1995, 1996, 'gone')}"


@plan
def delta_records(d):
    text = "string" if d.__name__ == "Spark" else "varchar"
    return f"select distinct 'order' as kind, o_custkey as module, o_orderpriority as exception_type, o_orderstatus as risk, cast(null as {text}) as operation from {d.table('orders')} union all select distinct 'line', l_suppkey, cast(null as {text}), l_returnflag, l_linestatus from {d.table('lineitem')}"


def _snapshots(d):
    return f"with a as (select doc_id, text from {d.table('documents')} where doc_id % 10 <> 1), b as (select doc_id, case when doc_id % 7 = 0 then concat(text, '!') when doc_id % 5 = 0 then replace(text, 'e', 'a') else text end as text from {d.table('documents')} where doc_id % 10 <> 2)"


@plan
def snapshot_diff(d):
    h = d.sha1_blob("text")
    return f"{_snapshots(d)} select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'NEW' when b.doc_id is null then 'DELETED' when a.h = b.h then 'IDENTICAL' else 'MODIFIED' end as status from (select doc_id, {h} as h from a) a full outer join (select doc_id, {h} as h from b) b on a.doc_id = b.doc_id"


@plan
def sync_plan(d):
    n = d.bytes("text")
    return f"{_snapshots(d)} select coalesce(a.doc_id, b.doc_id) as doc_id, case when b.doc_id is null then 'copy' when a.doc_id is null then 'delete' when a.n = b.n then 'skip' else 'overwrite' end as action from (select doc_id, {n} as n from a) a full outer join (select doc_id, {n} as n from b) b on a.doc_id = b.doc_id"


@plan
def hash_status(d):
    whole = lambda t: f"(select source, {d.joined('doc_id', d.sha256('text'), chr(39) + '|' + chr(39))} as h from {t} join (select doc_id as i, source from {d.table('documents')}) s on {t}.doc_id = s.i group by source)"
    return f"{_snapshots(d)} select coalesce(x.source, y.source) as source, case when x.h is null then 'new' when y.h is null then 'unreadable' when x.h = y.h then 'unchanged' else 'changed' end as status from {whole('a')} x full outer join {whole('b')} y on x.source = y.source"


@plan
def hash_changed(d):
    at = f"join (select doc_id as i, source from {d.table('documents')}) s on doc_id = s.i"
    return f"{_snapshots(d)} select s.source, doc_id, status from (select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'new' when b.doc_id is null then 'gone' else 'changed' end as status from a full outer join b on a.doc_id = b.doc_id where a.doc_id is null or b.doc_id is null or a.text <> b.text) x {at}"


@plan
def composite_hash(d):
    node = lambda child, rows: f"(select c_nationkey, {child} >> 6 as k, case when count(*) = 1 then min(h) else sha256(string_agg(h, '|' order by {child})) end as h, sum(p) as p from {rows} x group by 1, 2)"
    rows = f"(select c_nationkey, c_custkey as k, sha256(c_custkey || ':' || case when c_custkey % 4 = 0 then 'missing' else sha256(c_name) end) as h, case when c_custkey % 4 = 0 then 0 else 1 end as p from {d.table('customer')} where c_nationkey <> 3 or c_custkey % 4 = 0)"
    for _ in range(5):  # enough for keys below 2^30: a node with one child has its hash
        rows = node("k", rows)
    return f"select c_nationkey, case when p > 0 then h end as composite from {rows} r"


def _daily(d):
    return f"(select {d.day_of('ts')} as day, event_type, count(*) as n from {d.table('events')} group by 1, 2)"


@plan
def series_master(d):
    return f"select {d.ord_day('day')} as day, " + ", ".join(f"cast(coalesce(sum(case when event_type = '{t}' then n end), 0) as bigint) as {t}_n" for t in ("view", "click", "purchase")) + f" from {_daily(d)} x group by day"


@plan
def series_keep_last(d):
    return f"select {d.ord_day('day')} as day, snap, n from (select day, snap, n, row_number() over (partition by day order by snap desc) as rn from (select day, 1 as snap, sum(n) as n from {_daily(d)} a group by day union all select day, 2, sum(n) + 1 from {_daily(d)} b where extract(day from day) > 15 group by day) u) v where rn = 1".replace("sum(n)", "cast(sum(n) as bigint)")


@plan
def series_retention(d):
    days = f"(select distinct {d.day_of('ts')} as day from {d.table('events')})"
    far = f"x.day >= k.day + interval 13 {'days' if d.__name__ == 'Spark' else 'day'}"
    # one row of candidates per step: the first day 13 or more after the last kept
    return f"""{d.recursive} dd as (select day, min(day) over () as d0, max(day) over () as dl from {days} q),
      nx as (select k.day as day, min(x.day) as nxt from dd k join dd x on {far} group by k.day),
      k as (select distinct d0 as day from dd union all select nx.nxt from k join nx on nx.day = k.day)
      select distinct {d.ord_day('day')} as day from (select day from k union all select distinct dl from dd) u"""


@plan
def series_weekbands(d):
    return f"select {d.ord_day('monday')} as monday, {d.week('monday')} as week from (select {d.week_days('a', 'b')} as monday from (select min(ts) as a, max(ts) as b from {d.table('events')}) r) w where {d.week('monday')} % 2 = 0"


@plan
def day_counts(d):
    return f"select {d.ord_day('o_orderdate')} as day, count(*) as n from {d.table('orders')} group by 1"


@plan
def range_filter(d):
    return f"select event_id, user_id, event_type from {d.table('events')} where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-06 12:00:00'".replace("timestamp '", "timestamp_ntz '" if d.__name__ == "Spark" else "timestamp '")


@plan
def multi_range(d):
    return f"select l.l_orderkey, l.l_linenumber from {d.table('lineitem')} l where exists (select 1 from (select 1 as lo, 5 as hi union all select 20, 22 union all select 48, 50) r where l.l_quantity between r.lo and r.hi)"


@plan
def outcome_rates(d):
    c = lambda s: f"count(case when o_orderstatus = '{s}' then 1 end)"
    return f"select o_orderpriority, {c('F')} as killed, {c('O')} as survived, {c('P')} as timeout, case when count(*) > 0 then 100 * cast({c('F')} + {c('P')} as double) / count(*) end as rate from {d.table('orders')} group by o_orderpriority"


@plan
def stage2_reconcile(d):
    key = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    on = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in key.split(","))
    return f"""select stage, status, count(*) as n from (select 1 as stage, case when b.l_orderkey is null then 'unchecked' when b.s = 'F' then 'covered' else 'gap' end as status from (select distinct {key} from {d.table('lineitem')} where l_returnflag = 'R') a
      left join (select {key}, max(l_linestatus) as s from {d.table('lineitem')} where l_linenumber <= 3 group by {key}) b on {on}
      union all select 2, 'unmatched' from (select distinct {key} from {d.table('lineitem')} where l_linenumber <= 3) b where not exists (select 1 from {d.table('lineitem')} a where a.l_returnflag = 'R' and {on})) u group by stage, status"""


def _grid(d):
    return f"(select r_name, event_type, lang from {d.table('region')} cross join (select distinct event_type from {d.table('events')}) e cross join (select distinct lang from {d.table('documents')}) l)"


@plan
def grid(d):
    return f"select r_name, event_type, lang, row_number() over (order by r_name, event_type, lang) as pos from {_grid(d)} g"


@plan
def grid_resume(d):
    done = "(select 'ASIA' as r, 'view' as t, 'en' as l union all select 'EUROPE', 'click', null)"
    return f"select r_name, event_type, lang from {_grid(d)} g where not exists (select 1 from {done} x where x.r {d.null_safe} g.r_name and x.t {d.null_safe} g.event_type and x.l {d.null_safe} g.lang)"


@plan
def backfill_candidates(d):
    day = d.ord_day("ts")
    return f"select day, pos from (select day, row_number() over (order by day) as pos from (select distinct {day} as day from {d.table('events')} where event_type = 'view') v where day not in (select distinct {day} from {d.table('events')} where event_type = 'purchase' and user_id % 50 = 0)) c where pos > 3"


@plan
def silo_gaps(d):
    seen = f"(select user_id, {d.ord_day('ts')} as day, max(case when event_type = 'view' then 1 else 0 end) as view, max(case when event_type = 'click' then 1 else 0 end) as click, max(case when event_type = 'purchase' then 1 else 0 end) as purchase from {d.table('events')} where user_id is not null group by 1, 2)"
    gap = lambda a, b: f"select '{a}_without_{b}' as gap, user_id, day from {seen} {a}_{b} where {a} = 1 and {b} = 0"
    return " union all ".join(gap(*p) for p in (("view", "click"), ("click", "view"), ("purchase", "click"), ("click", "purchase")))


@plan
def coverage(d):
    letters = d.replace_all("lower(href)", "[^a-z]", "")
    word = d.extract_all("lower(text)", "[a-z]+", 0)
    return f"select k, case when w is null then 'missing' else 'ok' end as status from (select distinct {letters} as k from {_links(d)} l) a left join (select distinct w from (select {word} as w from {d.table('documents')}) b) c on a.k = c.w where k <> ''"


@plan
def count_drift(d):
    return f"select m.c_nationkey, coalesce(x.n, -1) as documented, m.n as measured, case when x.n is null then 'no_data' when x.n = m.n then 'ok' else 'drift' end as status from (select c_nationkey, count(*) as n from {d.table('customer')} group by c_nationkey) m left join (select c_nationkey, count(*) as n from {d.table('customer')} where c_acctbal > 0 and c_nationkey % 6 <> 0 group by c_nationkey) x on m.c_nationkey = x.c_nationkey"


@plan
def first_numeric_cell(d):
    row = "concat('| ', p_name, ' | 12% | ', " + ("format_number(p_retailprice * 10, 1)" if d.__name__ == "Spark" else "format('{{:,.1f}}', p_retailprice * 10)".replace("{{", "{").replace("}}", "}")) + ", ' | 7 |')"
    return f"select p_partkey, cast(replace({d.extract(row, '[|] *([0-9][0-9,.]*) *[|]', 1)}, ',', '') as double) as cell from {d.table('part')}"


@plan
def priority_order(d):
    return f"select c_mktsegment, row_number() over (order by case c_mktsegment when 'MACHINERY' then 1 when 'BUILDING' then 2 else 3 end, c_mktsegment) as pos, n from (select c_mktsegment, count(*) as n from {d.table('customer')} group by c_mktsegment) s"


@plan
def nulls_last_sort(d):
    return f"select c_custkey, row_number() over (order by t asc nulls last, c_custkey) as pos from (select c_custkey, max(o_orderdate) as t from {d.table('customer')} left join {d.table('orders')} on c_custkey = o_custkey group by c_custkey) s"


@plan
def interval_overlap(d):
    v = f"(select user_id, event_id, {d.seconds('ts')} as s, {d.seconds('ts')} + 3600 as e from {d.table('events')} where event_type = 'view')"
    return f"select a.user_id, a.event_id as a_id, b.event_id as b_id from {v} a join {v} b on a.user_id = b.user_id and a.event_id < b.event_id and a.s < b.e and b.s < a.e"


@plan
def gate_status(d):
    return f"select event_type, count(*) as total, count(case when value < 0 then 1 end) as failed, max(case when value < 0 or value is null then 1 else 0 end) = 1 as red from {d.table('events')} group by event_type"


@plan
def json_fields(d):
    return f"select event_id, {d.json_long('props', 'k')} as k from {d.table('events')}"


@plan
def log_category(d):
    return f"select conv_id, turn, case when {d.matches('lower(text)', 'error|fail')} then 'error' when {d.matches('text', '[0-9]+')} then 'calls' when {d.matches('text', '[#=]')} then 'section' else 'other' end as category from {d.table('conversations')}"


@plan
def contains_longest(d):
    return f"select doc_id, {d.max_by('item_id', 'length(b) * 100000 - item_id')} as item_id, count(*) as n from (select d.doc_id, k.item_id, k.text as b from {d.table('documents')} d join {d.table('benchmark')} k on contains(d.text, k.text)) x group by doc_id"


@plan
def rule_index(d):
    b, lines = d.table("benchmark"), f"(select doc_id, unnest(range(1, len(l) + 1)) as lineno, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from {d.table('documents')}))"
    tail = "'([a-z]+)[ ]+([a-z]+)[.]?$'"
    kinds = f"select item_id, 1 as k, regexp_extract(text, '^([^ \n]+ [^ \n]+ [^ \n]+)', 1) as p, p as r, regexp_replace(p, '([.+*?()\\[\\]{{}}|^$\\\\])', '\\\\\\1', 'g') as pattern from {b} where p <> '' union all select item_id, 2, regexp_extract(text, {tail}, 1) as p, p || '[ ]+' || regexp_extract(text, {tail}, 2), p || '[ ]+' || regexp_extract(text, {tail}, 2) from {b} where p <> ''"
    return f"select doc_id, lineno, target, arg_min(pattern, item_id * 10 + k) as pattern from (select doc_id, lineno, 't' || (item_id % 3) as target, item_id, k, pattern from {lines} x join ({kinds}) y on case when k = 1 then contains(line, p) else regexp_matches(line, r) end) z group by doc_id, lineno, target"


@plan
def interval_any(d):
    v = f"(select user_id, event_id, {d.seconds('ts')} as s, {d.seconds('ts')} + case event_id % 6 when 0 then 5 when 1 then 60 when 2 then 900 when 3 then 7200 when 4 then 86400 else 604800 end as e from {d.table('events')} where event_type in ('click', 'purchase'))"
    return f"select a.user_id, a.event_id as a_id, b.event_id as b_id from {v} a join {v} b on a.user_id = b.user_id and a.event_id < b.event_id and a.s < b.e and b.s < a.e"


@plan
def phrase_coverage(d):
    spaced = lambda x: f"concat(' ', array_to_string(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), '  '), ' ')"
    asked = f"(select distinct text as phrase from (select p_name as text from {d.table('part')} union all select array_to_string(string_split_regex(text, '[^A-Za-z]+')[1:3], ' ') from {d.table('benchmark')}) u)"
    return f"select phrase, cast(count(distinct doc_id) as bigint) as documents, cast(coalesce(sum(n), 0) as bigint) as places from {asked} p left join (select q, doc_id, (length(t) - length(replace(t, k, ''))) // length(k) as n from (select phrase as q, {spaced('phrase')} as k from {asked} z) y join (select doc_id, {spaced('text')} as t from {d.table('documents')}) x on contains(t, k) and k <> '  ') h on p.phrase = h.q group by phrase"
