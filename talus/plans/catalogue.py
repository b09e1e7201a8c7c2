"""All registered queries of the core and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talus.functions.text import lines, split_lines, token_estimate, word_tokens
from talus.operators import cache, chunking, corpus, graph, metrics, reports, rule_sets, rules, scoring
from talus.streaming import metrics as streamed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark, sf_dir) -> DataFrame:
    return corpus.files(table(spark, sf_dir, "documents"))


_LINES = """l as (select doc_id, path, language, unnest(range(1, len(x) + 1)) as line_no, unnest(x) as line
  from (select doc_id, concat_ws('/', source, cast(doc_id as varchar)) as path, lang as language, string_split(coalesce(text, ''), chr(10)) as x from documents))"""
_SPLIT_LINES = """l as (select doc_id, language, unnest(range(1, len(x) + 1)) as line_no, unnest(x) as line
  from (select doc_id, language, case when x[-1] = '' then x[:-2] else x end as x
  from (select doc_id, lang as language, regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0B\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') as x from documents)))"""
_sq = lambda s: "'" + s.replace("'", "''") + "'"
_hit = lambda c, ps: "(" + " or ".join(f"regexp_matches({c}, {_sq(p)})" for p in ps) + ")"
_first = lambda c, ps: "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, {_sq(p)}, 0), '')" for p in ps) + ")"
_WEAK = "(regexp_matches(lower(path), 'test') or regexp_matches(lower(line), 'test|example|mock|dummy|fake'))"
_STRONG = "regexp_matches(lower(m), 'password|secret|token|key|credential')"
_CREDENTIALS = f"""{_LINES},
c as (select *, {_first("line", rules.CREDENTIALS)} as m from l where trim(line, ' ') <> '' and not regexp_matches(line, {_sq(rules.COMMENT_MARKS)})),
cred as (select doc_id, line_no, 'Hardcoded Credentials' as type,
  case when {_WEAK} then 'low' when {_STRONG} then 'high' else 'medium' end as severity,
  case when {_WEAK} then 'medium' when {_STRONG} then 'high' else 'medium' end as confidence,
  'Possible hardcoded credential found: ' || m as message from c where m is not null)"""
_COMMENTS = f"""{_LINES.replace("l as", "l2 as", 1)},
k as (select *, case when regexp_matches(line, {_sq(rules.COMMENT_MARKS)}) then line when contains(line, '#') then regexp_extract(line, '#(.*)$', 0)
  when contains(line, '//') then regexp_extract(line, '//(.*)$', 0) end as t from l2),
comm as (select doc_id, line_no, 'Insecure Comment' as type, 'low' as severity, 'medium' as confidence, {_first("t", rules.COMMENTS)} as message from k where {_hit("t", rules.COMMENTS)})"""
_FINDINGS = f"{_CREDENTIALS}, {_COMMENTS}, f as (select * from cred union all select * from comm)"


def findings(files: DataFrame) -> DataFrame:
    return rules.credential_findings(files).unionByName(rules.comment_findings(files))


@query(f"with {_LINES} select doc_id, cast(line_no as integer) as line_no, line from l")
def line_explode(spark, sf_dir):
    return corpus.explode_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""select doc_id, cast(len(x) as bigint) as n_lines, cast(len(list_filter(x, lambda s: trim(s, ' ') = '')) as bigint) as n_blank,
  cast(list_max(list_transform(x, lambda s: length(s))) as bigint) as longest from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)""")
def line_stats(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", lines(F.col("text")).alias("x"))
    return x.select("doc_id", F.size("x").cast("long").alias("n_lines"), F.size(F.filter("x", lambda s: F.trim(s) == "")).cast("long").alias("n_blank"), F.array_max(F.transform("x", F.char_length)).cast("long").alias("longest"))


@query("""select page_id, ext, case when ext in ('py') then 'python' when ext in ('js', 'jsx') then 'javascript' when ext in ('ts', 'tsx') then 'typescript' when ext = 'html' then 'html'
  when ext = 'php' then 'php' when ext = 'md' then 'markdown' when ext in ('yml', 'yaml') then 'yaml' when ext in ('json', 'xml', 'css', 'scss', 'go', 'java', 'c', 'swift') then ext
  when ext = 'rs' then 'rust' when ext = 'rb' then 'ruby' when ext = 'kt' then 'kotlin' when ext = 'cs' then 'csharp' when ext = 'h' then 'c' when ext in ('cpp', 'hpp') then 'cpp' else 'unknown' end as language
  from (select page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) as ext from pages)""")
def language_detect(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", corpus.extension(F.col("url")).alias("ext"), corpus.language(F.col("url")).alias("language"))


@query("select doc_id, concat_ws('/', source, cast(doc_id as varchar)) as path from documents where not regexp_matches(concat_ws('/', source, cast(doc_id as varchar)), '^src1.*/.*$') and not regexp_matches(concat_ws('/', source, cast(doc_id as varchar)), '^.*/.7$')")
def exclude_filter(spark, sf_dir):
    return _files(spark, sf_dir).where(~corpus.excluded(F.col("path"), ("src1*/*", "*/?7"))).select("doc_id", "path")


@query("select doc_id, cast(case when n > 5242880 then 1000 when n > 1048576 then 1000 else 1000 end as bigint) as chunk_size, n as n_bytes from (select doc_id, cast(strlen(coalesce(text, '')) as bigint) as n from documents)")
def adaptive_chunk_size(spark, sf_dir):
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", corpus.adaptive_chunk_size(n).alias("chunk_size"), n.alias("n_bytes"))


def _scan_sql(names) -> str:
    parts = []
    for r in rules.BUILT_IN:
        if r.name in names:
            hit = f"regexp_matches(line, {_sq(r.pattern)})"
            if "(?!" in r.pattern:  # no look-ahead there: what follows the last safe loader
                hit = r"(regexp_matches(line, 'pickle\.loads|jsonpickle') or regexp_matches(regexp_replace(line, '^.*Loader=yaml\.SafeLoader', ''), 'yaml\.load\('))"
            gate = "" if r.language is None else f" and language = {_sq(r.language)}"
            parts.append(f"select doc_id, cast(line_no as integer) as line_no, {_sq(r.name)} as rule, {_sq(r.severity)} as severity from g where {hit}{gate}")
    return f"with {_SPLIT_LINES}, g as (select doc_id, line_no, line, case when language = 'en' then 'python' else language end as language from l) " + " union all ".join(parts)


def _rule_scan(spark, sf_dir, some):
    """English documents stand in for Python files, so that rules of a language have lines to run on."""
    files = _files(spark, sf_dir).select("doc_id", F.when(F.col("language") == "en", "python").otherwise(F.col("language")).alias("language"), "text")
    return rules.scan(corpus.explode_lines(files, cut=split_lines), some).select("doc_id", "line_no", "rule", "severity")


@query(_scan_sql([r.name for r in rules.BUILT_IN]))
def rule_builtin_scan(spark, sf_dir):
    return _rule_scan(spark, sf_dir, rules.BUILT_IN)


@query(_scan_sql(rules.RULE_SETS["Security"]))
def ruleset_security_scan(spark, sf_dir):
    return _rule_scan(spark, sf_dir, rules.rules_of("Security"))


_SAID = "case rule " + " ".join(f"when {_sq(n)} then {_sq(rule_sets.TEXTS[n][0])}" for n in rule_sets.TEXTS) + " end"


def _rule_set(spark, sf_dir, name):
    files = _files(spark, sf_dir).select("doc_id", F.when(F.col("language") == "en", "python").otherwise(F.col("language")).alias("language"), "text")
    return rule_sets.evaluate(files, rule_sets.built_in().sets[name]).select("doc_id", "rule", "line_start", "line_end", "severity", "description")


def _set_sql(names) -> str:
    """No document holds a Python function, so the complexity rule finds nothing there."""
    return f"select doc_id, rule, line_no as line_start, line_no as line_end, severity, {_SAID} as description from ({_scan_sql(names)})"


@query(_set_sql(rule_sets.SETS["Default"]))
def ruleset_default(spark, sf_dir):
    return _rule_set(spark, sf_dir, "Default")


@query(_set_sql(rule_sets.SETS["Code Quality"]))
def ruleset_code_quality(spark, sf_dir):
    return _rule_set(spark, sf_dir, "Code Quality")


@query(f"with {_CREDENTIALS} select doc_id, cast(line_no as integer) as line_no, type, severity, confidence, message from cred")
def credential_scan(spark, sf_dir):
    return rules.credential_findings(_files(spark, sf_dir))


@query(f"with {_COMMENTS} select doc_id, cast(line_no as integer) as line_no, type, severity, confidence, message from comm")
def comment_scan(spark, sf_dir):
    return rules.comment_findings(_files(spark, sf_dir))


_POINTS = "case severity when 'critical' then 10 when 'high' then 7 when 'medium' then 4 when 'low' then 1 when 'info' then 0 else 1 end * cast(case confidence when 'high' then 1.0 when 'medium' then 0.8 when 'low' then 0.5 else 1.0 end as double)"


@query(f"""with {_FINDINGS}, r as (select doc_id, count(*) as n, sum({_POINTS}) as p from f group by 1)
  select d.doc_id, cast(coalesce(n, 0) as bigint) as n_findings, cast(least(100, floor(coalesce(p, 0) / 100 * 100)) as integer) as risk from documents d left join r on d.doc_id = r.doc_id""")
def risk_score(spark, sf_dir):
    return scoring.file_risk(_files(spark, sf_dir))


@query(f"with {_FINDINGS} select severity, count(*) as n, count(distinct doc_id) as n_docs from f group by 1")
def severity_summary(spark, sf_dir):
    return findings(_files(spark, sf_dir)).groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"with {_FINDINGS} select type, severity, count(*) as n from f group by 1, 2")
def type_counts(spark, sf_dir):
    return findings(_files(spark, sf_dir)).groupBy("type", "severity").agg(F.count("*").alias("n"))


@query(f"with {_FINDINGS} select doc_id, cast(line_no as integer) as line_no, type, severity from f where severity in ('medium', 'high')")
def sensitivity_filter(spark, sf_dir):
    return scoring.sensitivity_filter(findings(_files(spark, sf_dir)), "medium").select("doc_id", "line_no", "type", "severity")


@query(f"with {_FINDINGS} select d.doc_id from documents d where d.doc_id not in (select doc_id from f)")
def clean_files_report(spark, sf_dir):
    files = _files(spark, sf_dir)
    return files.select("doc_id").join(findings(files).select("doc_id"), "doc_id", "left_anti")


@query("""select doc_id, cast((p // 800) as integer) as chunk_index, cast(total as integer) as total_chunks, substring(text, p + 1, 1000) as content
  from (select doc_id, text, unnest(range(0, length(text), 800)) as p, len(range(0, length(text), 800)) as total from documents where length(text) > 0)""")
def chunk_fixed(spark, sf_dir):
    return chunking.fixed_chunks(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "total_chunks", "content")


def _line_chunk_sql(size: str, whole: str) -> str:
    """Chunks of lines by recursion over (a, b]: c[k + 1] is where line k begins."""
    return f"""x as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as l from documents),
u as (select doc_id, unnest(range(1, len(l) + 1)) as k, unnest(l) as v from x), w as (select doc_id, list(s order by k) as c from (select doc_id, k, sum(length(v) + 1) over (partition by doc_id order by k) as s from u) group by 1),
y as (select x.doc_id, l, list_prepend(0, c) as c, len(l) as n, length(coalesce(text, '')) as size from x join w using (doc_id)),
r as (select doc_id, l, c, n, 0 as k, 0 as a, least(n, greatest(1, len(list_filter(c, lambda z: z <= {size})) - 1)) as b from y where {whole}
  union all select doc_id, l, c, n, k + 1, b - least(50, b - a), least(n, greatest(b + 1, len(list_filter(c, lambda z: z <= c[b - least(50, b - a) + 1] + {size})) - 1)) from r where b < n)"""


_CHUNK_OUT = "doc_id, k::int as chunk_index, (count(*) over (partition by doc_id))::int as total_chunks, (a + 1)::int as start_line, b::int as end_line, array_to_string(l[a + 1:b], chr(10)) as content"


@query(f"with recursive {_line_chunk_sql('4000', 'true')} select {_CHUNK_OUT} from r")
def chunk_lines(spark, sf_dir):
    return chunking.line_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"with recursive {_line_chunk_sql('4000', 'size > 8000')} select {_CHUNK_OUT} from r union all select doc_id, 0, 1, 1, n::int, array_to_string(l, chr(10)) from y where size <= 8000")
def chunk_review(spark, sf_dir):
    return chunking.review_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


_BREAK = "case when a + 1000 < n and strpos(reverse(substring(text, a + 1, 1000)), chr(10)) > 0 and 1000 - strpos(reverse(substring(text, a + 1, 1000)), chr(10)) > 500 then a + 1000 - strpos(reverse(substring(text, a + 1, 1000)), chr(10)) + 1 else least(n, a + 1000) end"


@query(f"""with recursive x as (select doc_id, text, length(text) as n, 0 as k, 0 as a from documents where text <> ''),
  r as (select *, {_BREAK} as b from x union all select doc_id, text, n, k, a, {_BREAK} as b from (select doc_id, text, n, k + 1 as k, greatest(b - 200, a + 1) as a from r where b < n))
  select doc_id, k::int as chunk_index, (count(*) over (partition by doc_id))::int as total_chunks, a::bigint as start, substring(text, a + 1, b - a) as content from r""")
def chunk_newline(spark, sf_dir):
    return chunking.newline_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("select doc_id, cast(length(coalesce(text, '')) // 4 as bigint) as tokens, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) as bigint) as words from documents")
def token_estimate_by_document(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"), word_tokens(F.col("text")).alias("words"))


@query("select conv_id, count(*) as n_turns, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) order by turn, coalesce(role, ''), coalesce(text, '')) as prompt from conversations group by 1")
def chat_prompt_build(spark, sf_dir):
    return chunking.chat_prompts(table(spark, sf_dir, "conversations"))


@query("""with w as (select conv_id, role, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) as n, length(coalesce(text, '')) // 4 as e from conversations)
  select conv_id, cast(sum(case when role = 'assistant' then 0 else n end) as bigint) as prompt_tokens, cast(sum(case when role = 'assistant' then n else 0 end) as bigint) as completion_tokens,
  cast(sum(n) as bigint) as total_tokens, cast(sum(e) as bigint) as estimated_tokens from w group by 1""")
def chat_token_usage(spark, sf_dir):
    return chunking.token_usage(table(spark, sf_dir, "conversations"))


@query("select doc_id, sha256(concat_ws('/', source, cast(doc_id as varchar)) || ':' || coalesce(text, '')) as cache_key, md5(coalesce(text, '')) as md5 from documents")
def content_hash(spark, sf_dir):
    return cache.content_hash(_files(spark, sf_dir))


@query("select doc_id, md5(coalesce(text, '')) as md5 from documents where md5(coalesce(text, '')) not in (select md5(coalesce(text, '')) from documents where lang = 'en')")
def incremental_changed(spark, sf_dir):
    files = _files(spark, sf_dir)
    return cache.changed(cache.content_hash(files), cache.content_hash(files.where("language = 'en'"))).select("doc_id", "md5")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def cache_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return cache.latest(e, "user_id", "ts", "event_id").drop("ts")


@query("select event_id, user_id from events where epoch(timestamp '2024-01-20 00:00:00') - floor(epoch(ts)) > 604800")
def cache_ttl_expired(spark, sf_dir):
    return cache.expired(table(spark, sf_dir, "events"), "ts", "2024-01-20 00:00:00", 7 * 86400).select("event_id", "user_id")


@query("""select user_id, access_count, cast(row_number() over (order by last_access desc, user_id) as integer) as lru_rank
  from (select user_id, max(ts) as last_access, count(*) as access_count from events group by 1) qualify lru_rank <= 100""")
def lru_keep(spark, sf_dir):
    return cache.lru_keep(table(spark, sf_dir, "events"), "user_id", "ts", 100).drop("last_access")


@query("""with b as (select user_id, floor(epoch(ts)) as s, event_id from events), h as (select *, coalesce(s - lag(s) over (partition by user_id order by s, event_id) <= 3600, false) as hit from b)
  select count(*) as accesses, count(*) filter (hit) as hits, count(*) filter (not hit) as misses, count(distinct user_id) as entries from h""")
def cache_stats(spark, sf_dir):
    return metrics.cache_stats(table(spark, sf_dir, "events"), 3600)


_EDGES = """e as (select distinct url as src, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) as dst from pages where url is not null)"""


@query(f"with {_EDGES} select src, dst from e")
def dep_edges(spark, sf_dir):
    return graph.page_edges(table(spark, sf_dir, "pages"))


_DEGREES = f"""with {_EDGES}, d as (select node, sum(o) as n_out, sum(i) as n_in from (select src as node, 1 as o, 0 as i from e union all select dst, 0, 1 from e) group by 1)
  select node, cast(n_out as bigint) as n_out, cast(n_in as bigint) as n_in, cast(n_out * n_in as bigint) as complexity from d"""


@query(_DEGREES)
def dep_degree(spark, sf_dir):
    return graph.degrees(graph.page_edges(table(spark, sf_dir, "pages")))


@query(f"select * from ({_DEGREES}) order by n_in desc, node limit 10")
def most_depended(spark, sf_dir):
    return dep_degree(spark, sf_dir).orderBy(F.col("n_in").desc(), "node").limit(10)


_NATIONS = """n as (select s_nationkey as src, c_nationkey as dst, count(*) as k from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  where s_nationkey <> c_nationkey group by 1, 2), e as (select src, dst from n),
  r as (select src, dst from e union select r.src, e.dst from r join e on r.dst = e.src)"""


@query(f"with recursive {_NATIONS} select src, dst from r")
def dep_closure(spark, sf_dir):
    return graph.closure(graph.nation_edges(spark, sf_dir))


@query(f"with recursive {_NATIONS} select dst as node, count(distinct src) as n_dependents, round(100.0 * count(distinct src) / (select count(*) from nation), 2) as impact from r where src <> dst group by 1")
def dep_impact(spark, sf_dir):
    n = F.lit(table(spark, sf_dir, "nation").count())
    got = dep_closure(spark, sf_dir).where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("n_dependents"))
    return got.withColumn("impact", F.round(100 * F.col("n_dependents") / n, 2))


@query(f"with recursive {_NATIONS} select src as node from r where src = dst")
def dep_cycles(spark, sf_dir):
    return dep_closure(spark, sf_dir).where("src = dst").select(F.col("src").alias("node"))


_TOTALS = f"""{_FINDINGS}, n as (select count(*) as n_files, cast(sum(case when x[-1] = '' then len(x) - 1 else len(x) end) as bigint) as n_lines
  from (select regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0B\\f\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') as x from documents)),
  tot as (select n_files, n_lines, (select count(*) from f) as n_issues, (select count(*) from f) / n_files as issues_per_file, n_lines / n_files as lines_per_file from n)"""
_BY = """by1 as (select 'language' as kind, lang as name, count(*) as n from documents group by 2 union all select 'category', type, count(*) from f group by 2
  union all select 'severity', s.name, count(f.severity) from (select unnest(['critical', 'high', 'medium', 'low', 'info']) as name) s left join f on f.severity = s.name group by 2)"""
_STAGES = "st as (select event_type as stage, round(coalesce(sum(value), 0), 2) as total_time, count(*) as n_calls, round(coalesce(sum(value), 0) / count(*), 2) as avg_time from events group by 1)"


@query(f"with {_TOTALS} select * from tot")
def usage_totals(spark, sf_dir):
    files = _files(spark, sf_dir)
    return reports.usage_totals(files, findings(files))


@query(f"with {_FINDINGS}, {_BY} select kind, name, n from by1")
def usage_by(spark, sf_dir):
    files = _files(spark, sf_dir)
    return reports.usage_by(files, findings(files))


@query(f"with {_STAGES} select * from st")
def stage_times(spark, sf_dir):
    """Event types stand for stages, their values for seconds."""
    return reports.stage_times(table(spark, sf_dir, "events"), "event_type", "value").withColumns({c: F.round(c, 2) for c in ("total_time", "avg_time")})


@query("""with c as (select event_type as type, case event_type when 'error' then 'api' when 'view' then 'ui' when 'click' then 'ui' else 'uncategorized' end as category from events)
  select 'total' as what, '' as name, count(*) as n from c union all select 'category', category, count(*) from c group by 2 union all select 'type', type, count(*) from c group by 2""")
def error_statistics(spark, sf_dir):
    """Event types stand for types of errors."""
    return reports.error_statistics(table(spark, sf_dir, "events"), {"error": "api", "view": "ui", "click": "ui"}, "event_type")


@query(f"""with {_TOTALS}, {_BY}, {_STAGES}
  select '# Code Review Tool Statistics Report' || chr(10) || chr(10) || '## Analysis Summary' || chr(10) || chr(10) || '- Files analyzed: ' || n_files || chr(10) || '- Lines of code analyzed: ' || n_lines || chr(10)
    || '- Issues found: ' || n_issues || chr(10) || '- Average issues per file: ' || printf('%.2f', issues_per_file) || chr(10)
    || (select chr(10) || '## Issues by Severity' || chr(10) || chr(10) || string_agg('- ' || name || ': ' || n || chr(10), '' order by list_position(['critical', 'high', 'medium', 'low', 'info'], name)) from by1 where kind = 'severity')
    || coalesce((select chr(10) || '## Issues by Category' || chr(10) || chr(10) || string_agg('- ' || name || ': ' || n || chr(10), '' order by n desc, name) from by1 where kind = 'category'), '')
    || (select chr(10) || '## Files by Language' || chr(10) || chr(10) || string_agg('- ' || name || ': ' || n || chr(10), '' order by n desc, name) from by1 where kind = 'language')
    || (select chr(10) || '## Processing Stage Performance' || chr(10) || chr(10) || '| Stage | Total Time (s) | Calls | Avg Time (s) |' || chr(10) || '|-------|---------------|-------|-------------|' || chr(10)
      || string_agg('| ' || stage || ' | ' || printf('%.2f', total_time) || ' | ' || n_calls || ' | ' || printf('%.2f', avg_time) || ' |' || chr(10), '' order by total_time desc, stage) from st) as report from tot""")
def statistics_report(spark, sf_dir):
    files = _files(spark, sf_dir)
    found = findings(files)
    return reports.report(reports.usage_totals(files, found), reports.usage_by(files, found), stage_times(spark, sf_dir))


@query("select event_type, count(*) as n_events, count(distinct user_id) as n_users, round(sum(value), 4) as total_value, round(avg(value), 6) as avg_value from events group by 1")
def metrics_usage(spark, sf_dir):
    return metrics.usage(table(spark, sf_dir, "events"))


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as n_events, count(*) filter (event_type = 'error') as n_errors from events group by 1")
def metrics_by_date(spark, sf_dir):
    return metrics.by_date(table(spark, sf_dir, "events"))


@query("select strftime(ts, '%Y-%m-%d %H:00') as hour, event_type, count(*) as n_events from events group by 1, 2")
def metrics_stream(spark, sf_dir):
    return streamed.run_available(spark, f"{sf_dir}/events.parquet")


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by 1, 2""")
def pricing_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as integer) as place from orders qualify place <= 3")
def latest_orders(spark, sf_dir):
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", place.alias("place")).where("place <= 3")


@query("select c_mktsegment, n_name, count(*) as n, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey group by rollup (c_mktsegment, n_name)")
def balance_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
