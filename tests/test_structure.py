"""Declarations, imports, parents and calls in five languages: over lines, with comments and literals, and broken."""

import pytest

from lodemap.sources import structure as S

TS = """import {
  a,
  b as c
} from 'lib';
import Own, { d } from "./own"; import './side';
export { e } from '../e';
// import no from 'comment';
const text = "class Ghost { from 'x' }";
/* class Ghost2 {} */
export default abstract class Shop<T>
  extends Base<Map<string, T>>
  implements Goods, Priced {
  static async sell(
    item: string,
    n = 1
  ): Promise<void> {
    if (item) { load(item, price(n)); }
  }
  #hide() { return `}`; }
  get size(): number { return 1 }
}
export const load = async (url: string) => {
  const inner = () => fetchAll(url);
  return inner();
};
type Size = 's' | 'm';
interface Priced extends One, Two {}
export function* each<T>(xs: T[]) { yield* xs }
const l = await import('./lazy'); const o = require('old');
"""
JAVA = """package shop;
import java.util.List; import static a.B.c;
import x.y.*;
/** class Ghost */
public final class Shop<T extends Item> extends Base<T>
    implements Goods, Priced<T> {
  private final List<T> items = new ArrayList<>();
  public Shop(int n) { super(n); }
  @Override
  public static <R> Map<String, R> sell(
      String item, int n) throws Failure {
    if (check(item)) { return run(() -> price(n)); }
    return null;
  }
  void hide() { }
  interface Inner { int size(); }
}
enum Size { S, M }
"""
GO = """package shop
import (
  "fmt"
  h "net/http" // web
)
import "os"
type Shop struct {
  n int
}
type goods interface { Sell() }
type Size int
func (s *Shop) Sell(n int,
  m int) (int, error) {
  return price(n), nil
}
func hide() { fmt.Println("func Ghost() {") }
"""
PY = """import os, sys as system
from .a.b import (
    c,
    d,
)
class Shop(Base, mixins.Priced):
    async def sell(self, item: str,
                   *, n=1) -> int:
        return price(load(item))
def _hide():
    def inner():
        sell()
    return inner()
"""


def brief(text, language):
    return [(line, end, kind, name, shown, owner) for line, end, kind, name, shown, _, owner in S.symbols_of(text, language)]


def test_typescript():
    assert brief(TS, "typescript") == [
        (8, 8, "const", "text", False, ""), (10, 21, "class", "Shop", True, ""), (13, 18, "method", "sell", True, "Shop"), (19, 19, "method", "#hide", False, "Shop"),
        (20, 20, "method", "size", True, "Shop"), (22, 25, "function", "load", True, ""), (23, 23, "function", "inner", False, ""), (26, 26, "type", "Size", False, ""), (27, 27, "interface", "Priced", False, ""),
        (28, 28, "function", "each", True, ""), (29, 29, "const", "l", False, ""), (29, 29, "const", "o", False, ""),
    ]
    assert {n: s for *_, n, _, s, _ in S.symbols_of(TS, "typescript")}["sell"] == "( item: string, n = 1 ): Promise<void>"
    assert S.imports_of(TS, "typescript") == [(1, "lib", "named", "a,b as c"), (5, "./own", "default", "Own,d"), (5, "./side", "default", ""), (6, "../e", "named", "e"), (29, "./lazy", "dynamic", ""), (29, "old", "require", "")]
    assert S.parents_of(TS, "typescript") == [("Priced", "extends", "One"), ("Priced", "extends", "Two"), ("Shop", "extends", "Base"), ("Shop", "implements", "Goods"), ("Shop", "implements", "Priced")]
    assert S.calls_of(TS, "typescript") == [("inner", "fetchAll", 23), ("load", "inner", 24), ("sell", "load", 17), ("sell", "price", 17)]


def test_java():
    assert brief(JAVA, "java") == [
        (5, 17, "class", "Shop", True, ""), (8, 8, "method", "Shop", True, "Shop"), (10, 14, "method", "sell", True, "Shop"), (15, 15, "method", "hide", False, "Shop"), (16, 16, "interface", "Inner", False, ""), (18, 18, "enum", "Size", False, ""),
    ]
    assert S.imports_of(JAVA, "java") == [(2, "a.B.c", "named", "c"), (2, "java.util.List", "named", "List"), (3, "x.y.*", "named", "*")]
    assert S.parents_of(JAVA, "java") == [("Shop", "extends", "Base"), ("Shop", "implements", "Goods"), ("Shop", "implements", "Priced")]
    assert S.calls_of(JAVA, "java") == [("sell", "check", 12), ("sell", "price", 12), ("sell", "run", 12)]


def test_go():
    assert brief(GO, "go") == [(7, 9, "class", "Shop", True, ""), (10, 10, "interface", "goods", False, ""), (11, 11, "type", "Size", True, ""), (12, 15, "method", "Sell", True, "Shop"), (16, 16, "function", "hide", False, "")]
    assert S.imports_of(GO, "go") == [(3, "fmt", "named", ""), (4, "net/http", "named", "h"), (6, "os", "named", "")]
    assert S.calls_of(GO, "go") == [("Sell", "price", 14)]


def test_python():
    assert brief(PY, "python") == [(6, 9, "class", "Shop", True, ""), (7, 9, "method", "sell", True, "Shop"), (10, 13, "function", "_hide", False, ""), (11, 12, "function", "inner", True, "")]
    assert S.imports_of(PY, "python") == [(1, "os", "namespace", ""), (1, "sys", "namespace", "system"), (2, ".a.b", "named", "c,d")]
    assert S.parents_of(PY, "python") == [("Shop", "extends", "Base"), ("Shop", "extends", "mixins.Priced")]
    assert S.calls_of(PY, "python") == [("_hide", "inner", 13), ("inner", "sell", 12), ("sell", "load", 9), ("sell", "price", 9)]


LITERALS = r"""export function a(x) {
  const r = /[(]/;
  return x / 2 / (r.test("}") ? 3 : 1);
}
const b = (x) => `one ${x.map(y => `two ${y ? `{` : '}'} ${f({ z: 1 })}`).join("(")} \${ \` {`;
function c(v) {
  if (v) /[{]}\/{/.exec(v);
  const d = { e: 1 } / 2, g = [1] / 3;
  return (v) / 2 + `}`.length / 4;
}
const Panel = ({ q }) => { return q.replace(/'/g, "\\"); };
const typed: (n: number) => Promise<void> = async (n) => {
  await c(n);
};
let later
const last = 1 // {
class K { m() { return /}/ } }
"""


def test_literals_that_hold_brackets():
    assert brief(LITERALS, "typescript") == [
        (1, 4, "function", "a", True, ""), (2, 2, "const", "r", False, ""), (5, 5, "function", "b", False, ""), (6, 10, "function", "c", False, ""), (8, 8, "const", "d", False, ""),
        (11, 11, "component", "Panel", False, ""), (12, 14, "function", "typed", False, ""), (16, 16, "const", "last", False, ""), (17, 17, "class", "K", False, ""), (17, 17, "method", "m", True, "K"),
    ]
    assert S.calls_of(LITERALS, "typescript") == [("b", "f", 5), ("typed", "c", 13)]


def test_stray_brackets_stay_local():
    text = "function a() {\n  x(1]);\n}\nfunction b() {\n  y({);\n}\nfunction c() {\n  return 1;\n}}\nfunction d() {\n}\n"
    assert [(line, end, name) for line, end, _, name, *_ in S.symbols_of(text, "javascript")] == [(1, 3, "a"), (4, 6, "b"), (7, 9, "c"), (10, 11, "d")]
    java = 'class A {\n  char c = \'{\';\n  String s = """\n    } " {\n    """;\n  int m() {\n    return \'"\' / 2;\n  }\n}\nclass B {}\n'
    assert [(line, end, name) for line, end, _, name, *_ in S.symbols_of(java, "java")] == [(1, 9, "A"), (6, 8, "m"), (10, 10, "B")]
    go = "package p\nfunc A() string {\n  return `{\n ${ \\`\n}\nfunc B(r rune) bool {\n  return r == '{'\n}\n"
    assert [(line, end, name) for line, end, _, name, *_ in S.symbols_of(go, "go")] == [(2, 5, "A"), (6, 8, "B")]


def test_long_sources_take_time_in_proportion():
    import time

    one = "function f%d(x) {\n  return g(x) / 2 + `${h(/[(]/)}`;\n}\n"
    took = []
    for n in (500, 4000):
        began = time.perf_counter()
        assert len(S.calls_of("".join(one % k for k in range(n)), "javascript")) == 2 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]


@pytest.mark.parametrize("language", ["javascript", "typescript", "java", "go", "python", "cobol", ""])
def test_broken_files_do_not_fail(language):
    for text in ("", "\n", "class {", "function (", "}}}", "import {", "'", "/*", "func (", "class A extends", "`${", "a = (b => {"):
        for find in (S.symbols_of, S.imports_of, S.parents_of, S.calls_of):
            find(text, language)


def test_tables(spark):
    files = spark.createDataFrame([("a.ts", "typescript", TS), ("b.py", "python", PY), ("c", None, None)], "path string, language string, text string")
    assert S.symbols(files).count() == 16 and S.imports(files).count() == 9 and S.hierarchy(files).count() == 7 and S.calls(files).count() == 8
