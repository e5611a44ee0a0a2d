import pytest

from quillon.sources import script


def items(source):
    return [(x["kind"], f"{x['owner']}.{x['name']}" if x["owner"] else x["name"], x["vis"], x["signature"]) for x in script.parse(source).items]


@pytest.mark.parametrize("path, module", [("index.ts", []), ("shop/index.jsx", ["shop"]), ("shop/till.mts", ["shop", "till"]), ("shop/till.spec.ts", None), ("env.d.ts", None), ("a.css", None), ("tests/a.ts", None), ("a/dist/b.js", None), (".ts", None)])
def test_modules(path, module):
    assert script.module_of(path.split("/")) == module


def test_declarations():
    source = """/**
 * Joins.
 *
 * @param a left
 * more
 */
export async function join<T extends { a: 1 }>(a: T, b = '}'): Promise<{ x: T }> { return `${a} }`; }
function plain() { return /[/"}]/.test("x") }
export const twice = (n: number): number => n * 2
export let LIMIT = 10, more = [1,
  2]
const { a, b } = load()
/** @internal */
export type Id = | 'a'
  | 'b'
/** Colours. */ export const enum Hue { Red = 1, Blue, 'x-y' = 3 }
export declare function outside(x: number): void
export default abstract class Base<T> extends Other implements First<T>, ns.Second {}
export interface Box<in out T> { a: string; run(x: { y: 1 }): void
  b?: T, }
if (x) { function inner() {} }
"""
    got = script.parse(source)
    assert items(source) == [
        ("fn", "join", 2, "async function join<T extends { a: 1 }>(a: T, b = '}'): Promise<{ x: T }>"),
        ("fn", "plain", 0, "function plain()"),
        ("fn", "twice", 2, "const twice = (n: number): number =>"),
        ("const", "LIMIT", 2, "let LIMIT = 10"),
        ("const", "more", 2, "let more = [1, 2]"),
        ("type", "Id", 2, "type Id = | 'a' | 'b'"),
        ("enum", "Hue", 2, "const enum Hue"),
        ("fn", "outside", 2, "declare function outside(x: number): void"),
        ("class", "Base", 2, "abstract class Base<T> extends Other implements First<T>, ns.Second"),
        ("interface", "Box", 2, "interface Box<in out T>"),
    ]
    by = {x["name"]: x for x in got.items}
    assert by["join"]["doc"] == ["Joins."] and (by["join"]["start_line"], by["join"]["decl_line"], by["join"]["end_line"]) == (1, 7, 7)
    assert by["Id"]["hidden"] and by["Hue"]["doc"] == ["Colours."] and by["Hue"]["fields"] == ["Red", "Blue", "'x-y'"]
    assert by["Box"]["fields"] == ["a: string", "run(x: { y: 1 }): void", "b?: T"]
    assert got.trait_impls == [{"ty": "Base", "trait_name": "First"}, {"ty": "Base", "trait_name": "ns.Second"}] and not got.parse_errors


def test_classes():
    source = """@sealed({ a: 1 })
export class Till<T> implements Counter {
  static readonly size: number = 0
  private items: Item[] = []
  /** Adds. */
  @logged()
  add(item: Item): void { this.items.push(item) }
  protected sum = (n: number): number => n
  private async secret() {}
  #hash() {}
  get total(): number { return 1 }
  [Symbol.iterator](): Iterator<T> { return x }
  static { run() }
  declared?(x: string): { y: number };
}
class Later { a() {} private b() {} }
export { Later as L }
"""
    assert items(source) == [
        ("class", "Till", 2, "class Till<T> implements Counter"),
        ("fn", "Till.add", 2, "add(item: Item): void"),
        ("fn", "Till.sum", 1, "sum = (n: number): number =>"),
        ("fn", "Till.secret", 0, "async secret()"),
        ("fn", "Till.#hash", 0, "#hash()"),
        ("fn", "Till.total", 2, "get total(): number"),
        ("fn", "Till.[Symbol.iterator]", 2, "[Symbol.iterator](): Iterator<T>"),
        ("fn", "Till.declared", 2, "declared?(x: string): { y: number }"),
        ("class", "Later", 2, "class Later"),
        ("fn", "Later.a", 2, "a()"),
        ("fn", "Later.b", 0, "b()"),
    ]
    got = script.parse(source)
    assert got.items[0]["fields"] == ["static readonly size: number", "private items: Item[]"] and got.items[1]["doc"] == ["Adds."]


def test_module_comment():
    assert script.parse("/** Of the file.\n */\n\n/** Of a. */\nexport const a = 1\n").module_doc == ["Of the file."]
    assert script.parse("/** Of a. */\nexport const a = 1\n").module_doc == []
    tagged = script.parse("/** @file Of the file. */\nexport const a = 1\n")
    assert tagged.module_doc == ["Of the file."] and tagged.items[0]["doc"] == []
    assert script.parse("/**/ /*** no */\nlet x\n").module_doc == []


def test_imports():
    source = """import a, { b as c, type D } from './till'
import type { E } from "../lib/index.js"
import * as all from '@org/kit/deep'
import react from 'react'
import { only } from 'node:fs/promises'
import './look.css'
import '../../../out'
const m = require('./m.cjs'), n = await import(`./no`)
export { y as z } from './y'
export type * from './t.js'
export * as ns from '@/alias/x'
import('./lazy')
"""
    got = [("/" if r["anchored"] else "") + "::".join(r["segments"]) for r in script.parse(source, ["a"]).refs]
    assert got == ["/a::till", "/a::till::b", "/a::till::D", "/lib::E", "@org/kit::deep", "react", "fs::promises::only", "/a::m", "/a::y", "/a::t", "@::alias::x", "/a::lazy"]
    assert [(x[1], x[0]) for x in items(source) if x[0] == "use"] == [("z", "use"), ("*", "use"), ("ns", "use")]


def test_commonjs():
    source = """function a() {}
function b() {}
/** Sets c. */
exports.c = (x) => x.y
module.exports = { a, d: b };
var app = exports = module.exports = {};
/** Gets. */
app.get = function get(path, fn) {};
function Route() {}
Route.prototype.run = (q) => q;
module.exports.limit = 5
this.x = function () {}
"""
    assert items(source) == [
        ("fn", "a", 2, "function a()"),
        ("fn", "b", 2, "function b()"),
        ("fn", "c", 2, "exports.c = (x) =>"),
        ("const", "app", 2, "var app = exports = module.exports = {}"),
        ("fn", "app.get", 2, "get(path, fn)"),
        ("fn", "Route", 0, "function Route()"),
        ("fn", "Route.run", 0, "run(q) =>"),
        ("const", "limit", 2, "module.exports.limit = 5"),
    ]
    assert items("module.exports = class Config {\n  get(key) { return key }\n};\n") == [("class", "Config", 2, "module.exports = class Config"), ("fn", "Config.get", 2, "get(key)")]


def test_broken_and_odd_sources():
    assert script.parse("export function f( {\n").parse_errors and script.parse("").lines == 0
    page = script.parse("export const View = () => <p className='a'>it's {x} / done</p>\nexport const after = 1\n")
    assert [x["name"] for x in page.items] == ["View", "after"]
    assert script.split_query("a.b/c::d") == ["a", "b", "c", "d"]


def test_long_values_are_cut():
    assert items(f"export const a = '{'x' * 200}'\n") == [("const", "a", 2, "const a")]
