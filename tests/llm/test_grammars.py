import random
import shutil
import subprocess

import pytest

from commitloom.llm import grammars
from commitloom.llm.grammars import language_of, obeys, parses
from commitloom.llm.grammars.base import Broken
from commitloom.llm.syntax import flag_files, judge, parse_rates

GOOD = {
    "javascript": [
        "", "const {a, b: [c = 1, ...d], ...e} = f(); let x = a?.b?.[c]?.(d) ?? e;", "for (const [k, v] of Object.entries(o)) { if (k) continue; else break }", "const f = async ({a}, [b] = [], ...c) => { await g(a); for await (const x of y) {} };",
        "class A extends B { #p = 1; static s = 2; static { this.t = 3 } get x() { return this.#p } set x(v) {} async *g() { yield* h() } [k]() {} 'q'() {} }", "x = `a ${b + `c ${d}`} e`; y = /[/\\]]+/gi.test(s) ? a / b / c : /x/;", "label: for (;;) { do { continue label } while (x) }",
        "import a, {b as c, default as d} from 'm'; import * as n from \"n\"; export default function () {} export {a as b}; export * from 'x'; export const q = 1;", "a = b\n++c\nif (a) b\nelse c", "var a = {get, set, async, get x() { return 1 }, async f() {}, *g() {}, [k]: 1, 'a-b': 2, ...r, 1: 2}",
        "switch (a) { case 1: case 2: b(); break; default: c() } try { x } catch { y } finally { z }", "new Foo; new a.b.C(1, 2).d(); x = y => ({a: y}); (function () {})(); !function () {}()", "#!/usr/bin/env node\nlet let_ = 1, async = 2, of = 3; async = of; if (a) ; <!-- x".split("; <!--")[0] + ";", "a = (b, c); ({a, b} = c); [a, b] = [b, a]; a **= 2; a ??= b; x = a ? b : c ? d : e",
    ],
    "go": [
        "package main\n", "package p\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n\t. \"x\"\n\t_ \"y\"\n)\n\ntype S struct {\n\tA, B int `json:\"a\"`\n\t*T\n\tm.U\n}\n\ntype I interface {\n\tM(a int, b ...string) (x int, err error)\n\tJ\n\t~int | string\n}\n",
        "package p\nfunc F[T any, K comparable](m map[K]T, f func(T) bool) (r []T) {\n\tfor k, v := range m {\n\t\tif x, ok := f(v), true; ok && x {\n\t\t\tr = append(r, v)\n\t\t} else if k == nil {\n\t\t\tcontinue\n\t\t}\n\t}\n\treturn\n}\n",
        "package p\nvar x = []S{{1, 2}, {A: 3}}\nvar y = map[string][]int{\"a\": {1}}\nconst (\n\tA = iota\n\tB\n)\nfunc g() {\n\tswitch v := x.(type) {\n\tcase int, string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v, ok := <-d:\n\t\t_ = v\n\t}\n\tgo func() {}()\n\tdefer f(a...)\nL:\n\tfor ; i < 10; i++ {\n\t\tbreak L\n\t}\n\tfor range ch {\n\t}\n}\n",
        "package p\nfunc (s *S) m() { if s == (S{}) { return }; var a [3]int; b := a[1:2:3]; p := &T[int]{}; *q = 'x'; r <<= 2; _ = <-c; f(func() {}) }\n", "package p\n\nvar s = `raw\n<<<<<<< a`\n/* multi\nline */ var t = 1\n",
    ],
    "c": [
        "", "#include <a.h>\n#ifdef X\nint f(\n#else\nint f(\n#endif\nvoid) { return 0; }\n", "typedef struct n { int a:3; struct n *next; union { int x; float y; }; } n_t;\nenum e { A, B = 2, };\nstatic const char *const s[] = { \"a\" \"b\", [2] = \"c\" };\n",
        "int (*fp)(int, char *);\nextern int printf(const char *, ...);\nsize_t f(uint32_t a, struct n *p, int v[], void (*cb)(void)) {\n  for (int i = 0, j = 1; i < a; i++, j--) { if (!p) continue; else p = p->next; }\n  do { a = (a > 1) ? (size_t)a : sizeof(struct n) + sizeof a; } while (a--);\n  switch (a) { case 'x': case 1 ... 3: break; default: goto out; }\nout:\n  return (int)*p + a * b;\n}\n",
        "#define M(x) do { x } while (0)\nvoid g(void) { T *t = (T *)malloc(sizeof(*t)); t->a[i].b = &x; *t++ = (struct n){ .a = 1 }; M(a); unsigned long long l = 0xFFULL; f(a, (b), -c); }\n", "int a, *b, c[3][4] = {{0}};\nint old(a, b) int a; char b; { return a; }\n__attribute__((packed)) struct s { char c; } ;\n",
    ],
    "bash": [
        "", "a=1 b=$(c \"$d\") e <<< f > g 2>&1 &", "if [[ $a =~ ^(x|y)$ && ! -f b ]]; then :; elif ((a > 1)); then b; else c; fi | d && e || f", "for i in {1..3} \"$@\"; do echo ${i:-x} `ls`; done < f", "for ((i = 0; i < 3; i++)); do :; done", "case $a in (x|y) b ;; *) c; esac", "f() { local a=(1 2 [3]=4); }; function g { :; }; h() ( x )",
        "cat <<EOF\n$(x\nEOF\necho ok", "cat <<-'E'\n\tif then (\n\tE\nwhile read -r x; do y; done < <(z)", "x=${a//b/c} y=$((1 + (2 * 3))) z=$'a\\'b' # comment (", "select a in b; do break; done; until x; do y; done; time ! z; coproc foo { x; }", "echo a\\\n b; [ -n \"$x\" ] && { y; } || (z)",
    ],
    "python": ["", "async def f(*, a: int = 1, **k) -> None:\n    async with a as b, c: pass\n    return [x async for x in y if (z := x)]\n", "match a:\n    case {'x': [1, *_]} if b: pass\n    case _: pass\n", "\ufeffx = 1\r\ny = f'{a!r:>{w}} {{'\r"],
    "json": ["{}", "[1, 2.5e-3, \"\\u00e9\", null, true]", " \"x\" ", "{\"a\": {\"b\": []}}"],
}
BAD = {
    "javascript": ["function f( {", "for (const 2v of x) {}", "a = ;", "let x = 'a\n'", "if (a { b }", "class A { x( }", "const a = {b: }", "x => { ", "`a ${b`", "1 = a", "a b", "<<<<<<< HEAD\na", "var if = 1", "return }", "import x from", "try { a }", "/abc", "a = b c", "f(a,, b)", "def f(x):\n    return x"],
    "go": ["", "func main() {}", "package p\nfunc f( {", "package p\nfunc f() { if x { }", "package p\nvar x = \"a\n", "package p\nfunc f()\n{\n}\nx := 1\n", "package p\nfunc f() { a := }", "package p\nfunc f() { for i := 0; i < 3 { } }", "package p\nimport fmt\n", "package p\nfunc f() { return 1 2 }", "package p\n<<<<<<< HEAD\n"],
    "c": ["int f( {", "int f(void) { return 0;", "int f(void) { int a int b; }", "int x = ;", "void f(void) { if (a { } }", "void f(void) { f(a,); }", "#if 1\nint a;\n", "#endif\n", "char *s = \"a\n\";", "<<<<<<< HEAD\nint a;\n", "void f(void) { for (;;;) ; }", "int a[;", "def f(x):\n    return x\n", "/* open", "struct { int a }; int b"],
    "bash": ["if x; then y", "fi", "for i in a; do b", "echo 'a", "echo $(a", "f( a", "case x in a) b", "{ a", "a && ", "a | ", "| a", "if then fi", "while x; do done", "echo \"a", "cat <", "a ;; b", "done", "x=(1 2", "[[ a", "echo foo(bar)", "<<<<<<< HEAD\na", "a & & b", "${x"],
    "python": ["print 'x'", "def f(:\n    pass", "x = (1", "if x\n    y", "for 2row in rows: pass", "a = 'b", "<<<<<<< HEAD\nx = 1\n"],
    "json": ["", "{'a': 1}", "{\"a\": 1,}", "[1, 2", "{\"a\": NaN}", "{\"a\" 1}", "// x\n{}", "{} {}", "01"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(language, text):
    assert obeys(text, language)


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in BAD.items() for t in v])
def test_invalid(language, text):
    assert not obeys(text, language)


@pytest.mark.skipif(not shutil.which("bash"), reason="no bash")
@pytest.mark.parametrize("text", GOOD["bash"] + BAD["bash"])
def test_like_bash(text):
    done = subprocess.run(["bash", "-n"], input=text, text=True, capture_output=True, check=False)
    assert obeys(text, "bash") == (done.returncode == 0)


def test_languages():
    assert [language_of(p) for p in ("a/b.PY", "x.tar.js", "a.h", "b.py.orig", "py", "a.py/b", None, ".go")] == ["python", "javascript", "c", None, None, None, None, "go"]
    assert "json" in parses("{}") and parses("def f(:") == []


def test_very_deep_and_long():
    assert obeys("x = 1\n" * 200_000, "python")
    assert obeys("{\n" * 300 + "}\n" * 300, "javascript")
    assert obeys("f(a);\n" * 20_000, "javascript")


PIECES = {
    "c": "int x ; { } ( ) [ ] * = , struct if else for while return #if #endif #else #elif #define \n \" ' 1 a.b -> static case : ? sizeof typedef goto // /* */ do switch enum f(x); @ \\ extern",
    "javascript": "function x ; { } ( ) [ ] => = , let const class extends async await yield * if else for of in return ` ${ } / /re/ \n \" ' 1 a.b ... ? : ?. new import export from default get set static # case switch try catch -- <!-- -->",
    "go": "package main\n func x ; { } ( ) [ ] * := = , type struct interface map chan <- if else for range return go defer select switch case : \n \" ' ` 1 a.b import var const ... goto //",
    "bash": "if then fi else for in do done while case esac ;; ; | & && || ( ) { } $ ${ } $( ) ` \" ' << EOF \n function x = a=b [[ ]] (( )) < > # \\ ! $((",
    "python": "def x : ( ) [ ] { } = , if else for in \n \" ' 1 a.b class return lambda * ** @ async await try except with as import from yield \\ \t match f\" := \0",
    "json": "{ } [ ] : , \" 1 null true false \\ -1 1e5 NaN \n",
}


def test_no_grammar_fails_on_any_text():
    rng = random.Random(9)
    pieces = {k: v.split(" ") for k, v in PIECES.items()}
    everything = sum(pieces.values(), [])
    for _ in range(6000):
        pool = pieces[rng.choice(list(pieces))] if rng.random() < 0.8 else everything
        text = rng.choice([" ", "", "\n"]).join(rng.choice(pool) for _ in range(rng.randint(1, 30)))
        for name, grammar in grammars.GRAMMARS.items():
            try:
                grammar(text)
            except (Broken, SyntaxError):
                pass
            except ValueError:
                assert name == "python"


def test_calls_at_the_top_of_a_file():
    assert judge("javascript", "setup(app);\nlet y = 1;\n") == ("javascript", ["javascript", "c"], False, "valid")
    assert obeys("EXPORT_SYMBOL(foo);\nint a;\n", "c") and not obeys("foo(bar)) ;\n", "c")


def test_a_fault_of_a_parser_is_a_verdict(monkeypatch):
    def fail(text):
        raise TypeError(text)

    monkeypatch.setitem(grammars.GRAMMARS, "go", fail)
    assert judge("go", "package p\n")[2:] == (False, "parser_error")
    assert judge("json", "{}")[2:] == (False, "valid")


@pytest.mark.parametrize(
    ("text", "good"),
    [
        ("#if 0\nThis isn't code, don't read it: {\n#else\nint a;\n#endif\n", True),
        ("#if 0\nint a;\n#else\nint b\n#endif\n", False),
        ("#ifdef A\nint a;\n#else\nint b = ;\n#endif\n", False),
        ("#ifdef A\nint a;\n#elif B\nint b = ;\n#else\nint c;\n#endif\n", False),
        ("#ifdef A\nint f(int x) {\n#else\nint f(void) {\n#endif\nreturn 1;\n#ifndef A\n}\n#else\n}\n#endif\n", True),
        ("#if defined(A)\nvoid f(void) {\n#endif\n#if !defined(A)\nint x;\n#else\n}\n#endif\n", True),
        ("#ifdef __cplusplus\nextern \"C\" {\n#endif\nint f(void);\n#ifdef __cplusplus\n}\n#endif\n", True),
        ("#if 1\nint a;\n#elif x\n'\n#else\n#endif\n", True),
        ("#if A\n#else\n#else\n#endif\n", False),
        ("#if A\n#if B\nint a;\n#else\nint b\n;\n#endif\n#endif\n", True),
    ],
)
def test_conditionals_of_c(text, good):
    assert obeys(text, "c") == good


def test_old_comments_of_scripts():
    assert obeys("<!-- hidden\nvar a = 1;\n--> end\n", "javascript") and not obeys("a --> ;", "javascript")
    assert obeys("while (n --> 0) f();", "javascript")


@pytest.mark.parametrize(("language", "text"), [("javascript", "x = " + "async(" * 60 + "1" + ")" * 60), ("c", "int x = " + "(a * b) + " * 60 + "@"), ("c", "int x = " + "(a * b) + " * 60 + "(c * d);"), ("json", "[" * 200_000 + "]" * 200_000), ("go", "package p\nvar x = " + "(" * 20_000 + "1" + ")" * 20_000)])
def test_no_text_takes_long(language, text):
    assert obeys(text, language) == ("@" not in text)


def test_rates_like_sql(spark, data, tmp_path):
    from commitloom.llm import queries as q
    import duckdb

    flagged = flag_files(spark.read.parquet(f"{data}/blobs.parquet"))
    flagged.write.parquet(str(tmp_path / "flagged"))
    got = {tuple(r) for r in q.p3_rates(spark, data).select("project", "language", "files", "broken", "wrong_extension", "rate").collect()}
    sql = f"WITH f AS (SELECT DISTINCT project, language, blob_id, broken, verdict FROM '{tmp_path}/flagged/*.parquet') SELECT project, language, count(*), count(*) FILTER (broken), count(*) FILTER (verdict = 'wrong_extension'), round(avg(CAST(broken AS INT)), 6) FROM f GROUP BY 1, 2"
    assert got == set(duckdb.sql(sql).fetchall())


def test_operator(spark):
    rows = [(1, "p", "a.py", "x = 1", 9), (2, "p", "b.py", "x = (", 9), (2, "p", "b.py", "x = (", 9), (3, None, "c.js", "def f():\n    pass\n", 9), (4, "p", "d.txt", "x = (", 9), (5, "p", "e.py", None, 9), (6, "p", None, "x", 9), (7, "q", "f.json", "", 9), (None, "q", "g.py", "x = (", 9)]
    df = spark.createDataFrame(rows, "blob_id bigint, project string, path string, content string, verdict int")
    flagged = flag_files(df)
    got = {(r.blob_id, r.verdict) for r in flagged.collect()}
    assert got == {(1, "valid"), (2, "corrupt"), (3, "wrong_extension"), (7, "corrupt")}
    rates = {(r.project, r.language): (r.files, r.broken) for r in parse_rates(flagged).collect()}
    assert rates == {("p", "python"): (2, 1), (None, "javascript"): (1, 1), ("q", "json"): (1, 1)}
    assert flag_files(df.limit(0)).count() == 0
