"""Declaration chunks of small TypeScript and Go sources."""

from __future__ import annotations

import pytest

from corpusmill.operators.chunking import chunk_nodes
from corpusmill.operators.declarations import chunk_code, declaration_nodes, declarations

TS = """import { x } from './y';
// function commented() { }
const s = "class Fake { }";
/* interface Nope { } */
export function add(a: number): { sum: number } {
  function inner() { return 1; }
  return { sum: a };
}
function over(a: string): void;
function over(a: any) {
  return `}${a}`;
}
class Foo<T> extends Bar<{ a: 1 }> {
  method(a: string): void { if (a) { log("}"); } }
}
abstract class Base {
  abstract run(): void;
  protected async doIt(x: number): Promise<void> {
    await x;
  }
}
interface Shape {
  area(): number;
}
type Id = string | number;
type Fn = (a: string) =>
  | void
  | string
const inc = (n: number) => n + 1;
const dec = async n => { return n - 1; }, twice = (q) => q * 2
export const typed: (a: string) => void = (a) => { log(a); };
const cb = useCallback(() => { function helper(z) { return z; } return helper; }, []);
export default class Widget { render() { return 1 } }
export { a, b } from './c';
export * from './d'
export default async function main() { return /[{]/.test("x"); }
const obj = { type: 'a', foo() { return 1; }, export: 3 };
namespace NS {
  export function nested() { return 1; }
}
"""

TS_EXPECTED = [
    (5, "export_statement", "export function add(a: number): { sum: number } {\n"
        "  function inner() { return 1; }\n  return { sum: a };\n}"),
    (5, "function_declaration", "function add(a: number): { sum: number } {\n"
        "  function inner() { return 1; }\n  return { sum: a };\n}"),
    (10, "function_declaration", "function over(a: any) {\n  return `}${a}`;\n}"),
    (13, "class_declaration", "class Foo<T> extends Bar<{ a: 1 }> {\n"
        "  method(a: string): void { if (a) { log(\"}\"); } }\n}"),
    (18, "method_definition",
        "protected async doIt(x: number): Promise<void> {\n    await x;\n  }"),
    (22, "interface_declaration", "interface Shape {\n  area(): number;\n}"),
    (25, "type_alias_declaration", "type Id = string | number;"),
    (26, "type_alias_declaration", "type Fn = (a: string) =>\n  | void\n  | string"),
    (29, "arrow_function", "(n: number) => n + 1"),
    (30, "arrow_function", "(q) => q * 2"),
    (30, "arrow_function", "async n => { return n - 1; }"),
    (31, "arrow_function", "(a) => { log(a); }"),
    (31, "export_statement",
        "export const typed: (a: string) => void = (a) => { log(a); };"),
    (32, "function_declaration", "function helper(z) { return z; }"),
    (33, "class_declaration", "class Widget { render() { return 1 } }"),
    (33, "export_statement", "export default class Widget { render() { return 1 } }"),
    (34, "export_statement", "export { a, b } from './c';"),
    (35, "export_statement", "export * from './d'"),
    (36, "export_statement",
        "export default async function main() { return /[{]/.test(\"x\"); }"),
    (36, "function_declaration", "async function main() { return /[{]/.test(\"x\"); }"),
    (37, "method_definition", "foo() { return 1; }"),
    (39, "export_statement", "export function nested() { return 1; }"),
    (39, "function_declaration", "function nested() { return 1; }"),
]

GO = """package main

// func commented() {}
type Point struct {
\tX, Y int
}

type (
\tA int
\tB string
)

func Add(a, b int) int {
\ts := "func fake() {"
\tr := `raw \\ { `
\tf := func(x int) int { return x }
\treturn a + f(1)
}

func (p *Point) Move(
\tdx int,
) (err error) {
\tswitch v := x.(type) {
\tdefault:
\t\t_ = v
\t}
\treturn nil
}

func Empty() interface{} { return nil }
var g = func() { type T struct{} }
type Alias = map[string]struct{}
"""

GO_EXPECTED = [
    (4, "type_declaration", "type Point struct {\n\tX, Y int\n}"),
    (8, "type_declaration", "type (\n\tA int\n\tB string\n)"),
    (13, "function_declaration", GO[GO.index("func Add"):GO.index("\n\nfunc (p")]),
    (20, "method_declaration", GO[GO.index("func (p"):GO.index("\n\nfunc Empty")]),
    (30, "function_declaration", "func Empty() interface{} { return nil }"),
    (31, "type_declaration", "type T struct{}"),
    (32, "type_declaration", "type Alias = map[string]struct{}"),
]


@pytest.mark.parametrize("path, code, expected", [
    ("a.ts", TS, TS_EXPECTED), ("a.tsx", TS, TS_EXPECTED), ("m.go", GO, GO_EXPECTED)])
def test_declarations(files, path, code, expected):
    rows = declaration_nodes(files({path: code})).collect()
    assert sorted((r.start_line, r.node_type, r.code) for r in rows) == expected


def test_decorators_and_layouts(files):
    source = """@Injectable()
@Component({
  selector: 'app',
})
export class App {
  @Input() name: string;
}

@Entity
class Row { id = 1 }
const after = 1
class Plain
{
}
if (after) { function inIf() { return 2 } }
let first = 1, second = (a = 1, { b }: { b: number } = { b: 2 }): number => {
  return a + b;
}
var chain = list.map(x => x + 1)
export = chain;
export const enum Color { Red }
export declare function ambient(a: string): void;
"""
    rows = declaration_nodes(files({"a.ts": source})).collect()
    got = sorted((r.start_line, r.node_type, r.code.split("\n")[0], r.code[-12:]) for r in rows)
    assert got == [
        (1, "export_statement", "@Injectable()", "e: string;\n}"),
        (5, "class_declaration", "class App {", "e: string;\n}"),
        (9, "class_declaration", "@Entity", "w { id = 1 }"),
        (12, "class_declaration", "class Plain", "ss Plain\n{\n}"),
        (15, "function_declaration", "function inIf() { return 2 }", "{ return 2 }"),
        (16, "arrow_function",
            "(a = 1, { b }: { b: number } = { b: 2 }): number => {", "urn a + b;\n}"),
        (20, "export_statement", "export = chain;", "ort = chain;"),
        (21, "export_statement", "export const enum Color { Red }", "olor { Red }"),
        (22, "export_statement", "export declare function ambient(a: string): void;", "ring): void;"),
    ]


def test_every_row_is_a_file(spark):
    """Also rows whose paths become the same, and rows repeated as a whole."""
    rows = [("s\\x.ts", "typescript", "export function one() { return 1; }"), ("s/x.ts", "typescript", "interface Two { b: string }"),
            ("s/x.ts", "typescript", "interface Two { b: string }"), ("s/y.ts", None, "class No { x = 1 }"), ("s/z.ts", "typescript", None)]
    nodes = declaration_nodes(spark.createDataFrame(rows, "filepath string, language string, content string"))
    assert sorted(r.code for r in nodes.collect()) == [
        "export function one() { return 1; }", "function one() { return 1; }", "interface Two { b: string }", "interface Two { b: string }"]
    assert declaration_nodes(spark.createDataFrame([], "filepath string, language string, content string")).collect() == []


def test_second_declarators(files):
    source = """const a = 1, b: (x: number) => number = (x) => x + 1, c = (y) => y * 2;
let d: Map<string, number> = new Map(), e: Fn = async (z) => { return z; }
const f = g = (w) => w;
var h = { i: (v) => v }, [j, k] = (u) => u;
"""
    found = [(r.start_line, r.code) for r in declaration_nodes(files({"a.ts": source})).collect()]
    assert found == [
        (1, "(x) => x + 1"), (1, "(y) => y * 2"), (2, "async (z) => { return z; }"), (4, "(u) => u")]


def test_unbalanced_brackets_lose_no_file(files):
    rows = declaration_nodes(files({
        "close.ts": "}}})\nfunction after() { return 1; }\n",
        "open.ts": "function before() { return 1; }\nif (x) { [ (\n",
        "deep.ts": "{" * 20_000 + "function inside() { return 1; }" + "}" * 20_000,
    })).collect()
    assert {(r.filepath, r.code) for r in rows} == {
        ("close.ts", "function after() { return 1; }"), ("open.ts", "function before() { return 1; }"),
        ("deep.ts", "function inside() { return 1; }")}


def test_time_grows_with_the_file():
    """No step looks over a whole file again."""
    import time

    one = "class A { run(x: number): void { if (x) { log([1, 2], { a: 'b' }); } } }\nconst f = (q) => q * 2;\n"
    took = []
    for n in (300, 3000):
        started = time.process_time()
        assert sum(1 for _ in declarations(one * n, "typescript")) == 2 * n
        took.append(time.process_time() - started)
    assert took[1] < 25 * max(took[0], 0.02)


def test_long_literals_and_odd_input(files):
    """Nothing here may overflow the matcher or lose the declaration after it."""
    tail = "\nfunction after() { return 1; }\n"
    rows = declaration_nodes(files({
        "escapes.ts": 'const a = "' + "\\n" * 60_000 + '";' + tail,
        "template.ts": "const b = `" + "x\\`\n" * 60_000 + "`;" + tail,
        "comment.ts": "/*" + " * text\n" * 60_000 + "*/" + tail,
        "blank.ts": "\n" * 100_000 + tail,
        "open.ts": "function before() { return 2; }\n/* never closed " + "y" * 50_000,
        "only_comment.ts": "// nothing else",
    })).collect()
    found = {(r.filepath, r.code) for r in rows}
    after = "function after() { return 1; }"
    assert found == {
        ("escapes.ts", after), ("template.ts", after), ("comment.ts", after),
        ("blank.ts", after), ("open.ts", "function before() { return 2; }")}


def test_chunk_code_applies_the_size_rules(files):
    body = "\n".join("  step(%d); // %s" % (i, "c" * 60) for i in range(60))
    source = "export function big() {\n" + body + "\n}\ntype T = 1;\n"
    df = files({"big.ts": source, "x.md": source})
    rows = chunk_code(df).collect()
    kinds = {r.node_type for r in rows}
    assert kinds == {"export_statement", "function_declaration"}
    exported = [r for r in rows if r.node_type == "export_statement"]
    assert min(r.start_line for r in exported) == 1
    assert all(len(r.text) < 1500 + len("// File: big.ts\n") for r in rows)
    # 'type T = 1;' with its header stays under the lower bound.
    assert chunk_nodes(declaration_nodes(df)).count() == len(rows)
