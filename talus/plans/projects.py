"""Registered queries over a source tree that Spark derives from the order tables.

No table holds source files, so each part stands for two, of Python and a
script: they import those of the part that most often comes next in an order,
by one of several kinds of statement.
The tree grows with the tables, its imports form a graph with chains, hubs and
cycles that is far from complete, and the SQL knows the edges without reading
any source, so that text, parsing, resolution and search are checked together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talus.operators import blocks, chunking, graph, imports, reviews, syntax_tree
from talus.sources.files import EXCLUDED, glob_pattern
from talus.sources.scratch import discard, stored

from .catalogue import query, table

_AFTER = """t as (select l_partkey as p, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as q from lineitem),
k as (select p, q, count(*) as n from t where q is not null and p <> q group by 1, 2),
b as (select p, q from k qualify row_number() over (partition by p order by n desc, q < p, q) = 1),
f as (select p_partkey as p, 'brand' || regexp_extract(p_brand, '[0-9]+', 0) as d from part),
x as (select p, d, false as script, d || '/p' || p || '.py' as path from f
  union all select p, d, true, d || '/p' || p || case p % 3 when 0 then '.js' when 1 then '.ts' else '/index.tsx' end from f),
s as (select x.p, x.path as src, x.script, y.path as dst, y.d as dst_dir from x join b on x.p = b.p join x y on b.q = y.p and x.script = y.script)"""
#: Two kinds of Python import name the package first: its folder is imported too.
_IMPORTS = f"""{_AFTER}, e as (select src, dst from s union select src, dst_dir from s where not script and p % 5 in (1, 2))"""


def next_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p, q: for each part the other part that most often follows it in an order; ties to the next larger key, or else the smallest."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.lead("l_partkey").over(order).alias("q"))
    counts = pairs.where("p <> q").groupBy("p", "q").count()
    return counts.groupBy("p").agg(F.min_by("q", F.struct(-F.col("count"), F.col("q") < F.col("p"), F.col("q"))).alias("q"))


def _path(script: bool) -> F.Column:
    """The path of a part's file, of p_partkey and p_brand."""
    p = F.col("p_partkey")
    end = F.when(p % 3 == 0, ".js").when(p % 3 == 1, ".ts").otherwise("/index.tsx") if script else F.lit(".py")
    return F.concat(F.lit("brand"), F.regexp_extract("p_brand", "[0-9]+", 0), F.lit("/p"), p.cast("string"), end)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: a Python file and a script for each part; each imports that of the part after it."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    to, that = F.concat(F.lit("brand"), F.regexp_extract("p_brand", "[0-9]+", 0)), F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    after = next_parts(spark, sf_dir).join(part.select(F.col("p_partkey").alias("q"), to.alias("to"), that.alias("that")), "q")
    f = part.join(after.withColumnRenamed("p", "p_partkey"), "p_partkey", "left")
    say = lambda *x: F.concat(*(F.col(c) if c in ("to", "that") else F.lit(c) for c in x))
    p, none = F.col("p_partkey"), F.col("q").isNull()
    python = (
        F.when(none, "value = 1\n")
        .when(p % 5 == 0, say("import os, ", "to", ".", "that", " as other\n"))
        .when(p % 5 == 1, say("from ", "to", " import ", "that", ", missing\n"))
        .when(p % 5 == 2, say("def late():\n    from ..", "to", " import ", "that", "\n"))
        .when(p % 5 == 3, say("import sys\nimport ", "to", ".", "that", ".inner.name\n"))
        .otherwise(say("import ", "to", ".", "that", ", json\nvalue = (\n"))
    )
    script = (
        F.when(none, "let value = 1;\n")
        .when(p % 3 == 0, say("import React from 'react';\nimport { a, b } from '../", "to", "/", "that", "';\n"))
        .when(p % 3 == 1, say('const other = require( "/', "to", "/./x/../", "that", '" );\n'))
        .otherwise(say("import '../../", "to", "/", "that", "';\n"))
    )
    both = F.array(F.struct(_path(False).alias("path"), python.alias("text")), F.struct(_path(True).alias("path"), script.alias("text")))
    return f.select(F.explode(both).alias("f")).select("f.*")


#: A customer's orders as statements of a function, by the first sign of their priority.
_STATEMENTS = {
    "1": "    if a and b:\n        eval(a)",
    "2": "    cur.execute(f'select {a}')",
    "3": "    for i in a:\n        pass",
    "4": "    x = hashlib.md5(a)",
    "5": "    try:\n        pass\n    except:\n        pass",
}
_CODE = f"""w as (select o_custkey as doc_id, o_orderkey, left(o_orderpriority, 1) as pr, case left(o_orderpriority, 1) {" ".join(f"when '{k}' then {s.count(chr(10)) + 1}" for k, s in _STATEMENTS.items())} end as n from orders),
  z as (select *, (2 + sum(n) over (partition by doc_id order by o_orderkey) - n)::int as line from w),
  c as (select doc_id, 1 + sum(n) as lines, 1 + sum(case pr when '1' then 2 when '3' then 1 when '5' then 1 else 0 end) as complexity, any_value(c_nationkey) % 2 = 0 as wide from w join customer on c_custkey = doc_id group by 1)"""


def customer_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a Python function for each customer, with a statement for each of its orders."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("k"))
    said = F.create_map(*(F.lit(x) for kv in _STATEMENTS.items() for x in kv))
    body = o.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "k"))), lambda x: F.element_at(said, x["k"])), "\n").alias("body"))
    head = F.concat(F.lit("def c"), F.col("doc_id").cast("string"), F.when(F.col("c_nationkey") % 2 == 0, "(a, b, c, d, e, f):\n").otherwise("(a):\n"))
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_nationkey")
    return body.join(who, "doc_id").select("doc_id", F.concat(head, "body", F.lit("\n")).alias("text"))


@query(f"with {_CODE} select doc_id, 1 as line_no, 'Function Complexity' as issue, 'medium' as severity from c where complexity > 10")
def code_complexity(spark, sf_dir):
    return syntax_tree.complex_functions(syntax_tree.nodes(customer_code(spark, sf_dir), "complexity"))


@query(f"""with {_CODE} select doc_id, line + 2 as line_no, 'Bare Except' as issue, 'medium' as severity from z where pr = '5'
  union all select doc_id, 1, 'Long Parameter List', 'medium' from c where wide union all select doc_id, 1, 'Long Function/Method', 'low' from c where lines > 50""")
def code_sizes(spark, sf_dir):
    return syntax_tree.sizes(syntax_tree.nodes(customer_code(spark, sf_dir), "sizes"))


@query(f"""with {_CODE} select doc_id, line + 1 as line_no, 'Use of eval' as issue, 'high' as severity from z where pr = '1'
  union all select doc_id, line, 'SQL Injection', 'critical' from z where pr = '2' union all select doc_id, line, 'Weak Hashing Algorithm', 'medium' from z where pr = '4'""")
def code_calls(spark, sf_dir):
    return syntax_tree.dangerous_calls(syntax_tree.nodes(customer_code(spark, sf_dir), "calls"))


@query(f"with {_CODE} select doc_id, line as line_no, 'Unused Variable' as issue, 'info' as severity from z where pr = '4'")
def code_unused(spark, sf_dir):
    return syntax_tree.unused(syntax_tree.nodes(customer_code(spark, sf_dir), "unused"))


@query(f"with {_AFTER} select x.path as doc_id, 1 as line_no, 'Syntax Error' as issue, 'error' as severity from x join b on x.p = b.p where not x.script and x.p % 5 = 4")
def code_syntax_errors(spark, sf_dir):
    files = source_files(spark, sf_dir).where(F.col("path").endswith(".py"))
    got = syntax_tree.syntax_errors(syntax_tree.nodes(files.select(F.col("path").alias("doc_id"), "text"), "syntax_errors"))
    return got.withColumn("line_no", F.lit(1))  # where a parser sees the error depends on its version


def csharp_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, text: a C# class for each supplier, with two methods whose content follows from its key and nation."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    name = F.concat(F.lit("S"), k.cast("string"))
    path = F.concat(F.when(k % 4 == 3, "Services/").when(k % 4 == 2, "Tests/").otherwise("Web/"), name, F.when(k % 4 == 3, ".cs").otherwise("Controller.cs"))
    check = F.when(n % 3 == 0, "        if (!ModelState.IsValid) { return null; }\n").otherwise("        if (id == null) { while (true) { break; } }\n")
    handling = F.when(n % 5 == 0, "None").when(n % 5 == 1, "All").otherwise("Auto")
    text = F.concat(
        F.lit("namespace A {\n  public class "), name, F.lit(" {\n    [HttpGet]\n    public string Get(string id) {\n"), check,
        F.lit("        return Find(id);\n    }\n\n    public object Load(int n)\n    {\n        var s = new Settings { TypeNameHandling = TypeNameHandling."), handling,
        F.lit(" };\n        return Json.Deserialize(n, s);\n    }\n    public int One() { return 1; }\n  }\n}\n"),
    )
    return table(spark, sf_dir, "supplier").select(k.alias("doc_id"), path.alias("path"), text.alias("text"))


@query("""with c as (select s_suppkey as doc_id, s_suppkey % 4 as kind, s_nationkey as n from supplier)
  select doc_id, 4 as line_no, 'Missing Input Validation' as type, 'medium' as severity, case kind when 2 then 'low' else 'medium' end as confidence from c where kind <> 3 and n % 3 <> 0
  union all select doc_id, 11, 'Insecure Deserialization', 'critical', 'high' from c where n % 5 <> 0""")
def csharp_methods(spark, sf_dir):
    return blocks.method_issues(csharp_files(spark, sf_dir))


@query(f"""with {_AFTER}, o as (select x.path, x.p, coalesce(b.p is null, true) as none, 'import ' || y.d || '.p' || b.q as target, y.d as d, 'p' || b.q as that from x left join b on x.p = b.p left join x y on b.q = y.p and not y.script where not x.script),
  cut as (select path, unnest(case when none then ['value = 1'] when p % 5 = 0 then ['import os, ' || d || '.' || that || ' as other'] when p % 5 = 1 then ['from ' || d || ' import ' || that || ', missing']
    when p % 5 = 2 then ['def late():' || chr(10) || '    from ..' || d || ' import ' || that] when p % 5 = 3 then ['import sys', target || '.inner.name'] else [target || ', json' || chr(10) || 'value = (' || chr(10)] end) as content,
    unnest(case when not none and p % 5 = 3 then [0, 1] else [0] end) as k, case when not none and p % 5 = 3 then 2 else 1 end as n from o)
  select path, k::int as chunk_index, n::int as total_chunks, content from cut""")
def chunk_structure(spark, sf_dir):
    files = source_files(spark, sf_dir).where(F.col("path").endswith(".py"))
    return chunking.structure_chunks(files).select("path", "chunk_index", "total_chunks", "content")


#: Codes of the linter lines that stand for line items, by line number.
_CODES = ("E101 tabs", "E501 line too long", "E1 odd", "W291 blank", "F401 unused", "W bare", "E2 space")


def linter_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, text: a linter's output for each order, a line for each of its line items; those of quantity 50 have three fields."""
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("l_linenumber") % len(_CODES) + 1).cast("int"))
    line = F.when(F.col("l_quantity") == 50, F.concat(F.lit("note:"), F.col("l_partkey").cast("string"), F.lit(": no code"))).otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".py:"), F.col("l_linenumber").cast("string"), F.lit(":1: "), code))
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    return one.withColumnRenamed("l_orderkey", "o_orderkey")


def _linter_sql(hit: str) -> str:
    codes = "[" + ", ".join(f"'{c}'" for c in _CODES) + "]"
    return f"""with l as (select l_orderkey as o_orderkey, l_quantity = 50 as short, {codes}[l_linenumber % {len(_CODES)} + 1] as code,
  case when l_quantity = 50 then 'note:' || l_partkey || ': no code' else 'p' || l_partkey || '.py:' || l_linenumber || ':1: ' || {codes}[l_linenumber % {len(_CODES)} + 1] end as line from lineitem),
  k as (select o_orderkey, line, short or not ({hit}) as kept from l)
  select o_orderkey, case when bool_and(kept) then string_agg(line, chr(10) order by line collate "binary") when not bool_or(kept) then '  -> No significant flake8 issues found after filtering.' || chr(10)
    else '  -> Filtered flake8 issues found:' || chr(10) || string_agg('    ' || line, chr(10) order by line collate "binary") filter (kept) || chr(10) end as filtered from k group by 1""".replace(' collate "binary"', "")


@query(_linter_sql("code in ('E1 odd', 'E501 line too long', 'W bare', 'E2 space')"))
def linter_filter(spark, sf_dir):
    return linter_outputs(spark, sf_dir).select("o_orderkey", reviews.filtered_linter(F.col("text")).alias("filtered"))


@query(_linter_sql("code not in ('F401 unused')"))
def linter_filter_prefix(spark, sf_dir):
    return linter_outputs(spark, sf_dir).select("o_orderkey", reviews.filtered_linter(F.col("text"), ("E", "W"), prefix=True).alias("filtered"))


@query("""with l as (select doc_id, x, list_filter(range(1, len(x) + 1), lambda i: i % 7 = 0) as hit from (select doc_id, case when s[-1] = '' then s[:-2] else s end as x
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents)))
  select doc_id, len(hit)::bigint as lines_removed, len(hit)::bigint as lines_added, (len(x) - len(hit))::bigint as lines_same from l""")
def diff_stats(spark, sf_dir):
    """Each document against a version in which every seventh line is another."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("old"))
    new = F.array_join(F.transform(F.split("old", "\n", -1), lambda x, i: F.when((i % 7 == 6) & ((x != "") | (i + 1 < F.size(F.split("old", "\n", -1)))), F.concat(F.lit("<changed "), i.cast("string"), F.lit(">"))).otherwise(x)), "\n")
    return reviews.line_diffs(d.withColumn("new", new)).select("doc_id", "lines_removed", "lines_added", "lines_same")


@query("""with m as (select conv_id, turn, case when turn % 3 = 0 then '# Head' || chr(10) || '## Summary of it' || chr(10) || coalesce(text, '') || chr(10) || '# Next' || chr(10) || 'x' else coalesce(text, '') end as review, coalesce(text, '') as t from conversations)
  select conv_id, turn, case when turn % 3 = 0 then '## Summary of it' || chr(10) || array_to_string(t_until, chr(10)) else array_to_string(s[:10], chr(10)) || chr(10) || '...' end as summary
  from (select *, string_split(t, chr(10)) as s, string_split(t, chr(10)) as t_until from m)""")
def review_summaries(spark, sf_dir):
    """Turns stand for reviews; every third has a heading Summary before its text and another after it."""
    c, text = table(spark, sf_dir, "conversations"), F.coalesce("text", F.lit(""))
    review = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("# Head\n## Summary of it\n"), text, F.lit("\n# Next\nx"))).otherwise(text)
    return c.select("conv_id", "turn", reviews.summary_section(review).alias("summary"))


_ANSWER = """case event_type when 'click' then '{"issues": [{"line_start": 1, "line_end": ' || (event_id % 50) || ', "severity": "high", "description": "d' || user_id || '"}, {"severity": "low"}]}'
  when 'view' then ' {"issues": []} ' when 'error' then '{"issues": [{"line_start": ' when 'signup' then '{"other": 1}' else 'text {"issues": []} around' end"""


@query("""select event_id, event_type in ('click', 'view') as parsed, case event_type when 'click' then 2 when 'view' then 0 else -1 end as n_issues, case when event_type = 'click' then (event_id % 50)::int else -1 end as first_end,
  case when event_type = 'click' then 'd' || user_id end as first_description from events""")
def answer_issues(spark, sf_dir):
    """Events stand for a model's answers: with issues, without, broken, of another kind, and with text around."""
    e = table(spark, sf_dir, "events")
    issues = reviews.parsed_issues(F.expr(_ANSWER))
    got = e.select("event_id", issues.alias("i"))
    return got.select("event_id", F.col("i").isNotNull().alias("parsed"), F.coalesce(F.size("i"), F.lit(-1)).alias("n_issues"), F.coalesce(F.get("i", F.lit(0))["line_end"], F.lit(-1)).alias("first_end"), F.get("i", F.lit(0))["description"].alias("first_description"))


@query(f"select doc_id, source || '/sub/' || doc_id || '.py' as path from documents where doc_id % 40 >= {len(EXCLUDED)}")
def default_excludes(spark, sf_dir):
    """The first documents of each forty lie where one of the default patterns leaves them out, the others don't."""
    hit = F.array(*(F.lit(g.replace("**/", "deep/").replace("*.", "x.") + ("in.py" if g.endswith("/") else "")) for g in EXCLUDED))
    at = (F.col("doc_id") % 40).cast("int")
    path = F.concat("source", F.lit("/"), F.coalesce(F.get(hit, at), F.concat(F.lit("sub/"), F.col("doc_id").cast("string"), F.lit(".py"))))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).where(~F.col("path").rlike("|".join(map(glob_pattern, EXCLUDED))))


def _edges(spark, sf_dir) -> DataFrame:
    files, path = stored(source_files(spark, sf_dir), "source-files")  # requests, scripts and targets each read them
    edges = imports.import_edges(files)
    discard(spark, path)
    return edges


def _changed(spark, sf_dir) -> DataFrame:
    """root: the files of the parts in the orders of the last order date, as the files that changed."""
    o = table(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderdate").alias("o_orderdate"))
    keys = o.join(F.broadcast(last), "o_orderdate").select(F.col("o_orderkey").alias("l_orderkey"))  # one row is broadcast
    some = table(spark, sf_dir, "lineitem").join(keys, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("p_partkey")).distinct()
    roots = table(spark, sf_dir, "part").join(some, "p_partkey").select(F.explode(F.array(_path(False), _path(True))).alias("root"))
    return stored(roots, "changed")[0]


_CHANGED = "c as (select distinct path as root from x join lineitem on l_partkey = x.p join orders on o_orderkey = l_orderkey where o_orderdate = (select max(o_orderdate) from orders))"


@query(f"with {_IMPORTS} select src, dst from e")
def import_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"with recursive {_IMPORTS}, {_CHANGED}, r as (select root, root as node from c union select r.root, e.dst from r join e on r.node = e.src), d as (select r.root, r.node, e.dst from r left join e on r.node = e.src)\n  select root, node, coalesce(string_agg(dst, ',' order by dst), '') as deps from d group by 1, 2")
def import_trees(spark, sf_dir):
    return graph.trees(_edges(spark, sf_dir), _changed(spark, sf_dir)).select("root", "node", F.array_join("deps", ",").alias("deps"))


@query(f"""with recursive {_IMPORTS}, {_CHANGED}, r as (select root, root as node from c union select r.root, e.src from r join e on r.node = e.dst)
  select c.root as node, count(distinct case when e1.src is not null and r.node <> c.root then r.node end) as n_direct, count(distinct case when r.node <> c.root then r.node end) as n_transitive,
  round_even(100.0 * count(distinct case when r.node <> c.root then r.node end) / (select count(*) from x), 2)::double as impact
  from c left join r on r.root = c.root left join e e1 on e1.src = r.node and e1.dst = c.root group by 1""")
def import_impact(spark, sf_dir):
    """For each changed file the files that depend on it."""
    n = 2 * table(spark, sf_dir, "part").count()
    return graph.impact(_edges(spark, sf_dir), _changed(spark, sf_dir), n)


@query(f"""with recursive {_IMPORTS}, r as (select src, dst from e union select r.src, e.dst from r join e on r.dst = e.src),
  m as (select a.src as node, least(a.src, min(b.dst)) as component from r a join r b on a.src = b.src join r z on z.src = b.dst and z.dst = a.src where a.src = a.dst group by a.src)
  select node, component from m""")
def import_components(spark, sf_dir):
    return graph.strong_components(_edges(spark, sf_dir))


@query(f"""with recursive {_IMPORTS}, g as (select src, dst from e where contains(dst, '.')), r as (select src, dst from g union select r.src, g.dst from r join g on r.dst = g.src),
  o as (select src as node from r where src = dst), m as (select r.src, min(r.dst) as component from r join o on r.dst = o.node where r.src in (select node from o) group by 1),
  w as (select component, component as node, 0 as position from (select distinct component from m) union all select w.component, g.dst, w.position + 1 from w join g on g.src = w.node where g.dst <> w.component)
  select component, position, node from w""")
def import_cycles(spark, sf_dir):
    """Folders import nothing, so every cycle runs through files alone, and each file imports one file at most."""
    return graph.cycles(_edges(spark, sf_dir))
