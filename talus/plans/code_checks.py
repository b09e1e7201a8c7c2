"""Registered queries of language rules and code checks, each over its whole table.

No source trees are among the tables: documents and pages stand in for the files of a language.
Patterns with look-ahead have no SQL; the languages that have any are tested against plain searches instead.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions.security_patterns import BY_LANGUAGE
from talus.operators import code_checks, language_rules, syntax_tree

from .catalogue import _LINES, QUERIES, SQL, _files, _sq, query, table


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("path"), F.col("html").alias("text"))


def _scan_sql(language: str) -> str:
    low = " or ".join(f"contains(lower(path), {_sq(w)})" for w in language_rules.TEST_PATHS.get(language, ())) or "false"
    exempt = " and ".join(f"not contains(line, {_sq(w)})" for w in language_rules.EXEMPT.get(language, ())) or "true"
    parts = [f"select doc_id, path, line_no, line, {_sq(t)} as type, {_sq(s)} as severity from k where regexp_matches(line, {_sq(p)})" for t, s, p in BY_LANGUAGE[language]]
    keep, sure = "true", "false"
    if language == "ruby":
        keep = "not (type = 'SQL Injection' and contains(line, '.where(') and contains(line, ':')) and not (type = 'Mass Assignment' and contains(line, '.permit'))"
        sure = "type = 'Mass Assignment' and doc_id in (select doc_id from l where starts_with(ltrim(line), 'class') and contains(line, 'Controller'))"
    confidence = f"case when {sure} then 'high' when {low} then 'low' else 'medium' end"
    return f"with {_LINES}, k as (select * from l where line <> '' and {exempt}), f as ({' union all '.join(parts)}) select doc_id, cast(line_no as integer) as line_no, type, severity, {confidence} as confidence from f where {keep}"


def _register(language: str, files, sql: str | None) -> None:
    name = f"rule_scan_{language}"
    QUERIES[name] = lambda spark, sf_dir: language_rules.scan(files(spark, sf_dir), language)
    if sql:
        SQL[name] = sql


for _language in ("python", "php", "go", "ruby", "rust"):
    _register(_language, _files, _scan_sql(_language))
for _language in ("java", "csharp"):
    _register(_language, _files, None)
_register("javascript", _pages, None)


_HTML = """l as (select page_id, unnest(range(1, len(x) + 1)) as line_no, unnest(x) as line from (select page_id, case when x[-1] = '' then x[:-2] else x end as x
  from (select page_id, regexp_split_to_array(coalesce(html, ''), '\\r\\n|[\\n\\r\\x0B\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') as x from pages)))"""


@query(f"with {_HTML} " + " union all ".join(f"select page_id, cast(line_no as integer) as line_no, {_sq(i)} as issue, {_sq(s)} as severity from l where regexp_matches(line, {_sq(p)})" for i, s, p in code_checks.JAVASCRIPT))
def js_checks(spark, sf_dir):
    return code_checks.javascript_issues(_pages(spark, sf_dir)).withColumnRenamed("doc_id", "page_id")


@query()
def ts_checks(spark, sf_dir):
    return code_checks.typescript_issues(_pages(spark, sf_dir)).withColumnRenamed("doc_id", "page_id")


@query()
def go_checks(spark, sf_dir):
    return code_checks.go_issues(_files(spark, sf_dir))


@query()
def rust_checks(spark, sf_dir):
    return code_checks.rust_issues(_files(spark, sf_dir))


@query()
def rails_validation(spark, sf_dir):
    return language_rules.rails_unvalidated(_files(spark, sf_dir))


@query()
def connection_strings(spark, sf_dir):
    return language_rules.connection_strings(_files(spark, sf_dir))


def _tree(spark, sf_dir, need):
    return syntax_tree.nodes(table(spark, sf_dir, "documents"), need)


@query()
def python_syntax_errors(spark, sf_dir):
    return syntax_tree.syntax_errors(_tree(spark, sf_dir, "syntax_errors"))


@query()
def python_sizes(spark, sf_dir):
    return syntax_tree.sizes(_tree(spark, sf_dir, "sizes"))


@query()
def python_complexity(spark, sf_dir):
    return syntax_tree.complex_functions(_tree(spark, sf_dir, "complexity"))


@query()
def python_unused(spark, sf_dir):
    return syntax_tree.unused(_tree(spark, sf_dir, "unused"))


@query()
def python_calls(spark, sf_dir):
    return syntax_tree.dangerous_calls(_tree(spark, sf_dir, "calls"))


@query()
def python_imports(spark, sf_dir):
    return syntax_tree.imports(_tree(spark, sf_dir, "imports"))
