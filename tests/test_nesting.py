"""Units and definitions by nesting, on sources full of brackets that are none."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from cairn.operators import nesting, slicing
from cairn.operators.retrieve import nearest_container

SOURCES = {
"rust": '''//! crate
/// doc { of
#[derive(Debug, Clone)]
pub struct Config<'a> { name: &'a str }
/* outer /* inner } */ still */
impl<'a> Config<'a> {
    /// loads
    pub async fn load(x: char) -> Result<(), E> {
        let s = r#"not } a " brace"#;
        if x == '}' || x == '\\'' { return Err(E); } else { foo(); }
        *self.x = 3;
        items.iter().map(|i| { i + 1 }).collect()
    }
    fn two() {}
}
pub struct Unit;
macro_rules! m { () => { } }
pub(crate) mod inner { pub trait T { fn t(&self); } pub enum E { A, B(u8) } }
''',
"go": '''package main
import ( "fmt" )
// Greet {
func Greet(name string) (string, error) {
	s := `raw } {`
	if x := 1; x > 2 {
		return "}", nil
	} else {
		go func() { fmt.Println('}') }()
	}
	return s +
		"x", nil
}
type Server struct {
	a int
}
func (s *Server) Run(ctx context.Context) { }
var x = 3
''',
"javascript": '''import { a } from "x"
export default class Foo extends Bar {
  static #p = 1
  constructor(a) { super(a) }
  async *gen({a, b}) { yield a }
  get v() { return `t ${a} }` }
}
const f = async (x) => {
  return x.replace(/[}"]/g, '{')
}
export function g(a = {}) {
  describe("x", () => { it("y", function () { z() }) })
}
let q = a / b / c
''',
"typescript": '''export interface Shape { area(): number; name: string }
export abstract class A<T> implements Shape {
  @Input() x: string = "}"
  constructor(private a: number) { super() }
  public area(): number { return 1 }
}
namespace N.M { export type X = { a: 1 }; export enum E { A } }
export const h = (a: string): Promise<void> => { return }
declare function k(a: number): void
''',
"c": '''#include <stdio.h>
#define X(a) do { a; } \\
  while (0)
typedef struct point { int x; } point_t;
struct node { struct node *next; };
static const char *
name_of(int a, char **b)
{
    if (a) { return "}"; }
    else if (b) return '}';
    for (int i = 0; i < 3; i++) { foo(i); }
    int y = bar(3);
    return NULL;
}
int proto(void);
enum color { RED, GREEN };
struct node *make(void) { return 0; }
''',
"cpp": '''namespace a::b {
template <typename T, class U = int>
class Foo : public Bar<T> {
 public:
  Foo(int x) : x_(x) {}
  ~Foo() { }
  virtual int get() const override { return x_; }
  void decl(int);
 private:
  int x_;
};
}
int Foo::run(const std::string& s) { auto r = R"x(})" )x"; return 1; }
enum class Color { R };
''',
"java": '''package p;
import java.util.*;
/** doc { */
@Service("x}")
public class Foo<T> extends Bar implements Baz {
  private final Map<String, Integer> m = new HashMap<>();
  public Foo(int a) { this.a = a; }
  @Override
  public <R> List<R> run(String... a) throws IOException {
    try { x(); } catch (E e) { y("}"); } finally { }
    Runnable r = () -> { z(); };
    return null;
  }
  abstract void nobody();
  interface Inner { void q(); }
  enum E { A(1), B(2); E(int i) {} }
}
record P(int x) { }
''',
"csharp": '''using System;
namespace N.M
{
    [Serializable, Foo("x]")]
    public sealed class A : B<int>
    {
        public int X { get; set; } = 5;
        #region r }
        public A(int a) : base(a) { }
        public override async Task<int> Run(string s)
        {
            var v = @"c:\\"; var w = $"{s}}}";
            return 1;
        }
    }
    public interface I { void M(); }
    struct S { }
}
''',
"php": '''<?php
namespace App;
# comment {
#[Attr]
abstract class A extends B {
  public static function make(array $a = []): ?self { return new self("}"); }
  private $x = 'a}';
}
function f($a) { $s = <<<EOT
 } not
EOT;
 return $s; }
trait T { function t() {} }
''',
"scala": '''package p
object Main extends App {
  def run(a: Int): Int =
    a + 1
  def two(s: String) = { s"""x } ${s}""" }
  val x = 3
}
case class P(x: Int)
trait T { def t: Int }
''',
"ruby": '''module A
  class B < C
    attr_reader :x
    def initialize(a)
      @a = a if a
      while x do
        y
      end
      [1].each do |i|
        puts "end #{i}" unless i
      end
    end
    def empty? = true
    def self.make(x)
      z = if x then 1 else 2 end
      case z
      when 1 then 3
      end
    end
  end
end
''',
}
#: By language: name, kind, first and last line, parent.
WANT = {
    "rust": [("Config", "class", 4, 4, None), ("load", "method", 8, 13, None), ("two", "method", 14, 14, None), ("Unit", "class", 16, 16, None), ("m", "macro", 17, 17, None), ("T", "interface", 18, 18, None), ("t", "method", 18, 18, "T"), ("E", "class", 18, 18, None)],
    "go": [("Greet", "function", 4, 13, None), ("Server", "type", 14, 16, None), ("Run", "method", 17, 17, None)],
    "javascript": [("Foo", "class", 2, 7, None), ("constructor", "method", 4, 4, "Foo"), ("gen", "method", 5, 5, "Foo"), ("v", "method", 6, 6, "Foo"), ("f", "function", 8, 10, None), ("g", "function", 11, 13, None)],
    "typescript": [("Shape", "interface", 1, 1, None), ("area", "method", 1, 1, "Shape"), ("A", "class", 2, 6, None), ("constructor", "method", 4, 4, "A"), ("area", "method", 5, 5, "A"), ("N", "module", 7, 7, None), ("X", "type", 7, 7, "N"), ("E", "enum", 7, 7, "N"), ("h", "function", 8, 8, None), ("k", "function", 9, 9, None)],
    "c": [("point_t", "type", 4, 4, None), ("node", "class", 5, 5, None), ("name_of", "function", 6, 14, None), ("proto", "function", 15, 15, None), ("color", "type", 16, 16, None), ("make", "function", 17, 17, None)],
    "cpp": [("a", "module", 1, 12, None), ("Foo", "class", 2, 11, "a"), ("Foo", "method", 5, 5, "Foo"), ("~Foo", "method", 6, 6, "Foo"), ("get", "method", 7, 7, "Foo"), ("decl", "method", 8, 8, "Foo"), ("run", "method", 13, 13, None), ("Color", "type", 14, 14, None)],
    "java": [("Foo", "class", 4, 17, None), ("Foo", "method", 7, 7, "Foo"), ("run", "method", 8, 13, "Foo"), ("nobody", "method", 14, 14, "Foo"), ("Inner", "interface", 15, 15, "Foo"), ("q", "method", 15, 15, "Inner"), ("E", "class", 16, 16, "Foo"), ("E", "method", 16, 16, "E"), ("P", "class", 18, 18, None)],
    "csharp": [("N", "module", 2, 18, None), ("A", "class", 4, 15, "N"), ("A", "method", 9, 9, "A"), ("Run", "method", 10, 14, "A"), ("I", "interface", 16, 16, "N"), ("M", "method", 16, 16, "I"), ("S", "class", 17, 17, "N")],
    "php": [("App", "module", 2, 2, None), ("A", "class", 4, 8, None), ("make", "method", 6, 6, "A"), ("f", "function", 9, 12, None), ("T", "interface", 13, 13, None), ("t", "method", 13, 13, "T")],
    "scala": [("Main", "object", 2, 7, None), ("run", "method", 3, 4, "Main"), ("two", "method", 5, 5, "Main"), ("x", "variable", 6, 6, "Main"), ("P", "class", 8, 8, None), ("T", "interface", 9, 9, None), ("t", "method", 9, 9, "T")],
    "ruby": [("A", "module", 1, 21, None), ("B", "class", 2, 20, "A"), ("initialize", "method", 4, 12, "B"), ("empty?", "method", 13, 13, "B"), ("self.make", "method", 14, 19, "B")],
}


@pytest.mark.parametrize("language", SOURCES)
def test_definitions_end_where_their_bodies_end(language):
    text = SOURCES[language]
    line = lambda at: text.count("\n", 0, at) + 1
    assert [(n, k, line(a), line(b - 1), p) for n, k, a, b, p, _ in nesting.definitions(text, language)] == WANT[language]


@pytest.mark.parametrize("language", [*SOURCES, "css", "json", "zig", "toml"])
@pytest.mark.parametrize("fill", [True, False])
def test_chunks_hold_their_bounds(language, fill):
    r = random.Random(language)
    bits = ["fn a() {", "}", "{", "x = 1;", "// c {", "/* d", "*/", '"s"', "'", '"', "", "", "def f", "end", "if x", "(", ")", "[1, 2],", "#[a]", "`t`", "foo(bar);"]
    for _ in range(60):
        text = "\n".join(r.choice(["", "  "]) + r.choice(bits) for _ in range(r.randrange(120)))
        spans = slicing.code_spans(text, language, least=20, most=60, fill_gaps=fill)
        assert all(len(slicing.token_starts(text[a:b])) <= 60 for a, b in spans)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:])) and all(0 <= a < b <= len(text) for a, b in spans)


def test_notes_above_a_unit_are_taken_in():
    text = "use a;\n\n/// one {\n/* two\n   more */\n#[derive(A)]\nfn f() {\n" + "    x = 1;\n" * 12 + "}\n"
    ((a, b),) = slicing.code_spans(text, "rust", least=20, most=90, fill_gaps=False)
    assert text[a:b].startswith("/// one") and text[a:b].endswith("}\n")
    ((a, b),) = slicing.code_spans(text, "rust", least=20, most=66, fill_gaps=False)  # no room for all of them
    assert not text[a:b].startswith("/// one") and "fn f" in text[a:b]
    parted = text.replace("more */\n", "more */\n\n")
    ((a, b),) = slicing.code_spans(parted, "rust", least=20, most=90, fill_gaps=False)
    assert parted[a:b].startswith("#[derive")


def test_scan_is_linear():
    """Deep, unclosed and repeated marks in every language."""
    deep = 50_000
    assert [d[4] for d in nesting.definitions("fn a() {" * deep + "}" * deep, "rust")].count("a") == deep - 1
    for text in ("(" * deep, "}" * deep, "'" * deep, '"' * (deep + 1), "/*" * deep, "template <" * 9_000, "typedef " * deep, "x<" * deep + "(", "a " * deep):
        for language in nesting.SYNTAX:
            began = time.time()
            nesting.definitions(text, language)
            assert time.time() - began < 8, (language, text[:9])


def test_mixed_files(spark):
    """Each file by its own language; null and unknown languages, null and empty texts have no definitions."""
    rows = [(k, t, lang) for k, (lang, t) in enumerate(SOURCES.items())] + [(90, None, "go"), (91, "", "java"), (92, "x y", None), (93, "x y", "klingon"), (94, "def f():\n    class C:\n        pass\n", "python"), (95, "# T\n\nwords", "markdown")]
    files = spark.createDataFrame(rows, "doc_id long, text string, programming_language string")
    got = {}
    for x in slicing.definitions(files).collect():
        got.setdefault(x.doc_id, []).append((x.name, x.kind, x.start_line, x.end_line, x.parent_name))
    assert got == {k: WANT[lang] for k, (lang, _) in enumerate(SOURCES.items())} | {94: [("f", "function", 1, 3, None), ("C", "class", 2, 3, "f")]}
    assert {x.doc_id for x in slicing.slice_code(files, fill_gaps=True, least=1).collect()} >= set(range(len(SOURCES)))
    assert slicing.definitions(files.limit(0)).count() == 0


def test_parents_by_one_sweep(spark):
    """Against all pairs, and on a file of 100,000 nested definitions."""
    r = random.Random(5)
    spans = {}
    for _ in range(600):
        a = r.randrange(30)
        spans[r.choice("pqr"), a, a + r.randrange(1, 20), r.randrange(3)] = None
    rows = [(f, f"n{k}", "kind", a, b) for f, a, b, k in spans]
    want = {}
    for f, n, _, a, b in rows:
        around = [(-c, d, m) for g, m, _, c, d in rows if g == f and c <= a and d >= b and (c, d) != (a, b)]
        want[f, n, a, b] = min(around)[2] if around else None
    schema = "path string, name string, kind string, start int, end int"
    got = nearest_container(spark.createDataFrame(rows, schema))
    assert {(x.path, x.name, x.start, x.end): x.parent_name for x in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    n = 100_000
    deep = spark.range(n).select(F.lit("f").alias("path"), F.col("id").cast("string").alias("name"), F.lit("k").alias("kind"), F.col("id").alias("start"), (2 * n - F.col("id")).alias("end"))
    assert nearest_container(deep).where("start > 0 and cast(parent_name as long) <> start - 1 or start = 0 and parent_name is not null").count() == 0
    assert nearest_container(deep.limit(0)).count() == 0
