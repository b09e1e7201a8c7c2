"""Language rules against plain regular expressions, and code checks on hand-made files."""

from __future__ import annotations

import re

import pytest

from talus.functions.security_patterns import BY_LANGUAGE
from talus.operators import code_checks, language_rules

LINES = [
    'cursor.execute("select %s" % x)', "cur.execute(f'select {x}')", "subprocess.call(cmd, shell=True)", "os.system('ls ' + user_input)", "eval(x); exec(y)", "pickle.loads(b)", "yaml.load(f)", "hashlib.md5(x)",
    "print(x)", "assert x", "tempfile.mktemp()", "jwt.decode(t, verify=False)", 'password = "hunter2hunter2"', "document.write(x)", "el.innerHTML = x", "Math.random()", "http://example.org/", "http://localhost/",
    "stmt.executeQuery(\"SELECT * FROM t WHERE a = '\" + a)", "Runtime.getRuntime().exec(cmd + arg)", "new Random()", 'MessageDigest.getInstance("MD5")', "DocumentBuilderFactory.newInstance()", "new ObjectInputStream(in)",
    "SecureRandom r = new SecureRandom();", "Cookie c = new Cookie(a, b);", "new URL(request.getParameter(u))", "$q = mysql_query(\"SELECT \" . $_GET['a']);", "system($_GET['x']);", "unserialize($_POST['a']);", "echo $_GET['x'];", "md5($x);",
    'db.Query("SELECT * FROM t WHERE a = " + a)', 'exec.Command("sh", "-c", input)', "md5.New()", "InsecureSkipVerify: true", "User.where(\"name = '#{params[:a]}'\")", "Marshal.load(params[:x])", "system(\"ls \" + params[:a])", "params.permit!",
    "unsafe { x }", "x.unwrap()", "Command::new(\"sh\").arg(format!(\"{}\", a))", "new SqlCommand(\"select \" + a)", "Process.Start(a + b)", "new BinaryFormatter()", "MD5.Create()", "new Random().Next()", "[AllowAnonymous]", "catch (Exception e) { }", "",
    'Response.Cookies.Append("a", b)', "TypeNameHandling = TypeNameHandling.All", "services.AddCors(o => o.AllowAnyOrigin())", 'Server=a;Database=b;User ID=c;Password=d;',
]
PLAIN = ("python", "php", "go", "rust", "csharp", "javascript")


def _files(spark, *texts, path="src/a"):
    return spark.createDataFrame([(i, path, t) for i, t in enumerate(texts)], "doc_id long, path string, text string")


def _issues(frame):
    return sorted((r.line_no, r.issue) for r in frame.collect())


@pytest.mark.parametrize("language", PLAIN)
@pytest.mark.parametrize("path", ["src/a", "a/Test/x"])
def test_scan_equals_plain_search(spark, language, path):
    got = language_rules.scan(_files(spark, "\n".join(LINES), None, "", path=path), language)
    exempt = language_rules.EXEMPT.get(language, ())
    confidence = "low" if language in language_rules.TEST_PATHS and "test" in path.lower() else "medium"
    want = sorted((n, t, s, confidence) for n, x in enumerate(LINES, 1) for t, s, p in BY_LANGUAGE[language] if re.search(p, x) and not any(w in x for w in exempt))
    assert sorted((r.line_no, r.type, r.severity, r.confidence) for r in got.collect()) == want and want


def test_java_hits_equal_plain_search_where_no_context_acts(spark):
    text = [x for x in LINES if not any(w in x for w in ("createQuery", "expected", "prepareStatement", "escape", "validate"))]
    got = language_rules.scan(_files(spark, "\n".join(text)), "java")
    want = sorted((n, t, s) for n, x in enumerate(text, 1) for t, s, p in BY_LANGUAGE["java"] if re.search(language_rules.java_form(p), x))
    assert sorted((r.line_no, r.type, r.severity) for r in got.collect()) == want and want


def test_plain_form_of_endless_repeats():
    """Fewer rounds stand in for many, which never end on the pattern as given."""
    changed = [(re.sub(r"\{\d+,\}", "{3,}", p), language_rules.java_form(p)) for _, _, p in BY_LANGUAGE["java"] if re.search(r"\)\{\d\d,\}", p)]
    lines = [f"{k}{m}{e}" for k in ("SecureRandom", "Cookie", "URL", "WebClient") for m in ("", "()", "a", ".getHost()") for e in (".next", ".setPath", ".openStream(", ".get(", "")]
    for p, q in changed:
        assert [bool(re.search(p, x)) for x in lines] == [bool(re.search(q, x)) for x in lines]
    assert sum(any(re.search(q, x) for x in lines) for _, q in changed) >= 3


def test_java_context(spark):
    bad = 'st.executeQuery("SELECT a FROM t WHERE b = \'" + b + "\'");'
    far = "\n".join([bad, "", "", "", "", "validate(x);"])
    near = "\n".join([bad, "", "", "validate(x);"])
    clean = "String s = sanitize(q);" + "\n" * 6 + bad
    tested = "@Test\n\n\n\n" + bad.replace("st.", "mock.")
    secret = 'class LoginTest {\nString password = "abcdefgh12345";'
    kinds = [{(r.type, r.confidence) for r in language_rules.scan(_files(spark, t), "java").collect()} for t in (far, near, clean, tested, bad + " // nosec", secret)]
    assert ("SQL Injection", "high") in kinds[0]
    assert ("SQL Injection", "low") in kinds[1] and ("SQL Injection", "medium") in kinds[2]
    assert not kinds[3] and not kinds[4]
    assert all(t != "Hardcoded Secret" for t, _ in kinds[5])


def test_ruby_skips_and_confidence(spark):
    text = "class UsersController\n  def create\n    User.new(params[:user])\n  end\n  def show\n    x = 1\n  end\nend"
    files = _files(spark, text, text.replace("Controller", ""), text.replace("User.new", "User.valid?; User.new"), None)
    assert [(r.doc_id, r.line_no, r.confidence) for r in language_rules.rails_unvalidated(files).collect()] == [(0, 2, "medium")]
    line = "User.where(name: params[:a] + x)"
    want = {t for t, _, p in BY_LANGUAGE["ruby"] if re.search(p, line)}
    got = {r.type for r in language_rules.scan(_files(spark, line), "ruby").collect()}
    assert "SQL Injection" in want and got == want - {"SQL Injection"}
    assert language_rules.scan(_files(spark, line + " # nosec"), "ruby").count() == 0


def test_connection_strings_over_lines(spark):
    text = 'a\nb "Server=x;\nUser ID=u;Password=p"\n\nc = "Data Source=y;uid=u;pwd=p";\n'
    flat = language_rules.CONNECTION.removeprefix("(?is)")
    want = [text.count("\n", 0, m.start()) + 1 for m in re.finditer(flat, text, re.S | re.I)]
    got = sorted(r.line_no for r in language_rules.connection_strings(_files(spark, text, None, "Server")).collect())
    assert got == want and len(want) > 0


def test_javascript(spark):
    text = "console.log(1)\r\neval (x)\rif (a == null) {}\nif (a === null) {}\n$.get(u); jQuery\na != null"
    assert _issues(code_checks.javascript_issues(_files(spark, text, None, ""))) == [(1, "Console Statement"), (2, "Eval Usage"), (3, "Loose Comparison"), (5, "jQuery Usage")]


def test_typescript(spark):
    text = "let a: any, b: any;\ninterface Foo {\ninterface Bar {\nx as Bar\na!.b\nenum color {\nenum Color_A {\nenum Good {\n"
    both = [(2, "Unused Interface"), (4, "Type Assertion"), (5, "Non-null Assertion"), (6, "Enum Naming"), (7, "Enum Naming")]
    assert _issues(code_checks.typescript_issues(_files(spark, text))) == sorted([*both, (1, "Any Type")])
    assert _issues(code_checks.typescript_issues(_files(spark, "\n" + text + "x: any\ny: any"))) == sorted([*((n + 1, i) for n, i in both), (2, "Excessive Any Type")])


def test_go(spark):
    text = "\n".join(
        ['import "fmt"', 'import "a/os"', "import (", '  "strings"', '  y "z/yaml"', "  // x", ")", "os.Exit(1)", "y.Load()", "v, _ := a.B(c)", "// v, _ := a.B(c)", "type E interface{ }"]
        + ["for i := range x {", "  defer f()", "  for {", "  }", "}", "func f(a int) (n int, err error) {", "  return", "}", "select {", "default:", "}", "select {", "case x <- 1:", "default:", "}"]
        + ["type T struct {", *["  a int"] * 16, "}", "type U struct {", *["  a int"] * 15, "}"]
    )
    want = [(1, "Unused Import"), (4, "Unused Import"), (10, "Ignored Error"), (12, "Empty Interface"), (15, "Defer in Loop"), (18, "Naked Return"), (21, "Select With Only Default"), (28, "Large Struct")]
    assert _issues(code_checks.go_issues(_files(spark, text, None))) == want
    assert (10, "Ignored Error") not in _issues(code_checks.go_issues(_files(spark, text, path="a/mock.go")))


def test_rust(spark):
    text = "\n".join(["a.unwrap()", 'b.expect("x")', "// c.clone()", "c.clone()", "unsafe { }", "struct S {", "  a: Mutex<i32>,", "  b: Mutex<i32>,", "}", "enum E {", *["  A,"] * 11, "}", "enum F {", *["  A,"] * 10, "}", *["f(&mut v)"] * 6, *["f(&mut w)"] * 5])
    want = [(1, "Unwrap Usage"), (2, "Expect Usage"), (4, "Clone Usage"), (5, "Unsafe Code"), (8, "Mutex in Struct"), (10, "Large Enum"), (35, "Excessive Mutable Borrowing")]
    assert _issues(code_checks.rust_issues(_files(spark, text, None))) == want
    assert _issues(code_checks.rust_issues(_files(spark, "a.unwrap()", path="tests/a.rs"))) == []


def test_files_without_words_are_passed_over(spark):
    """Most texts hold no word that a pattern needs: neither the patterns nor the folds see them; every pattern has such words."""
    import re

    from talus.functions.security_patterns import BY_LANGUAGE
    from talus.operators import code_checks, language_rules

    assert all(language_rules._needed(re._parser.parse(p)) for found in BY_LANGUAGE.values() for _, _, p in found)
    t = spark.createDataFrame([("plain words",), ("X = NEW  Random ( )",), ("x\nMATH.random()",), (None,), ("",)], "text string")
    assert [bool(r[0]) for r in t.select(language_rules.may_hit(t.text, "java")).collect()] == [False, True, True, False, False]
    some = spark.createDataFrame([("type A interface {}",), ("a := b",), ("select {\ndefault:\n}",), ('import "os"',), ("for x\ndefer y",), (None,)], "text string")
    kept = code_checks._holding(some, ("type", "interface"), ("import", '"')).collect()
    assert [r.text for r in kept] == ["type A interface {}", 'import "os"']
    files = some.selectExpr("monotonically_increasing_id() as doc_id", "'a.go' as path", "text")
    plan = code_checks.go_issues(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(text" in plan
