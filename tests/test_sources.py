import json
from pathlib import Path

import pytest

from quillon.functions import shell
from quillon.operators import code, graph, guard
from quillon.sources import manifests, rust, transcripts, trees

#: A small crate: a star of parts under `rail`, a framework's calls, tests, a hidden item, and a file with a syntax error.
CRATE = {
    "src/main.rs": "//! Entry point.\nmod core;\nmod rail;\n\nfn main() {\n    rail::install(3);\n}\n",
    "src/core.rs": "//! Shared types.\n\n/// A level.\n#[derive(Clone, Component)]\npub struct Level {\n    pub at: u8,\n}\n\nimpl Level {\n    /// Makes one.\n    pub fn new(at: u8) -> Self {\n        Level { at }\n    }\n    pub fn up(&mut self) {}\n}\n\nimpl Default for Level {\n    fn default() -> Self {\n        Self::new(0)\n    }\n}\n",
    "src/rail/mod.rs": "//! Rails. More words.\n//!\n//! # How to add a rail\n//! Call [`install`].\npub use crate::core::Level;\npub mod cart;\nuse serde::Deserialize;\n\n/// Puts it in.\npub fn install(n: u8) {\n    cart::plugin(n);\n    app.add_systems(Update, cart::roll).insert_resource(Level::new(n));\n}\n\n#[cfg(test)]\nmod tests {\n    use super::*;\n    /// It works.\n    #[test]\n    fn works() {\n        crate::core::Level::new(1);\n    }\n}\n",
    "src/rail/cart.rs": "use super::super::core::{self, Level as L};\nuse super::install;\n\n#[doc(hidden)]\npub fn secret() {}\n\npub(crate) fn plugin(n: u8) {\n    let _ = L::new(n);\n}\n\nfn roll() { install(1) }\n",
    "src/bad.rs": "pub fn open(a: u8 {\n",
    "src/bin/tool.rs": "fn main() {}\n",
}


@pytest.fixture(scope="module")
def crate(spark):
    files = spark.createDataFrame([("p", k, v) for k, v in CRATE.items()], "project_id string, path string, source string")
    return trees.catalog(files, "rust")


@pytest.fixture(scope="module")
def references(spark, crate):
    return code.resolved(crate, spark.createDataFrame([("p", "serde")], "project_id string, name string"))


def test_files_are_ordered_by_path_parts(crate):
    got = crate.files.orderBy("file_id").collect()
    assert [f.path for f in got] == ["src/bad.rs", "src/core.rs", "src/main.rs", "src/rail/cart.rs", "src/rail/mod.rs"]
    assert [f.module for f in got] == [["bad"], ["core"], [], ["rail", "cart"], ["rail"]]
    assert [f.parse_errors for f in got] == [True, False, False, False, False]
    assert all(f.lines == CRATE[f.path].count("\n") for f in got)
    assert sorted(m.module for m in crate.modules.collect()) == [[], ["bad"], ["core"], ["rail"], ["rail", "cart"]]


def test_items(crate):
    got = {(i.owner, i.name): i for i in crate.items.collect()}
    level = got[None, "Level"] if got[None, "Level"].kind == "struct" else next(i for i in crate.items.collect() if i.name == "Level" and i.kind == "struct")
    assert (level.signature, level.fields, level.derives, level.start_line, level.decl_line, level.end_line) == ("struct Level", ["pub at: u8"], ["Clone", "Component"], 3, 5, 7)
    assert got["Level", "new"].vis == 2 and got["Level", "new"].doc == ["Makes one."] and ("Level", "default") not in got
    assert got[None, "secret"].hidden and got[None, "plugin"].vis == 1 and got[None, "roll"].vis == 0
    assert [(t.name, t.doc) for t in crate.tests.collect()] == [("works", ["It works."])]
    assert [(t.ty, t.trait_name) for t in crate.trait_impls.collect()] == [("Level", "Default")]


def test_edges_and_externals(crate, references):
    names = dict(crate.files.select("file_id", "path").collect())
    got = {(names[e.file_id], e.line, "::".join(e.target), e.symbol) for e in code.edges(references).collect()}
    assert got == {
        ("src/main.rs", 6, "rail", "install"),
        ("src/rail/mod.rs", 5, "core", "Level"),
        ("src/rail/mod.rs", 11, "rail::cart", "plugin"),
        ("src/rail/mod.rs", 12, "rail::cart", "roll"),
        ("src/rail/mod.rs", 12, "core", "Level"),
        ("src/rail/cart.rs", 1, "core", None),
        ("src/rail/cart.rs", 1, "core", "Level"),
        ("src/rail/cart.rs", 2, "rail", "install"),
    }
    assert [(u.package, u.main_files, u.test_files) for u in code.external_uses(references).collect()] == [("serde", 1, 0)]
    fan = {tuple(f.node): (f.fan_out, f.fan_in) for f in graph.fan(code.edges(references)).collect()}
    assert fan["core",] == (0, 2) and fan["rail",] == (2, 2)


def test_relations_and_find(crate):
    got = [(r.owner, r.kind, r.target) for r in code.relations(crate, [("makes", "Level::new")], pack=True).orderBy("file_id", "line", "place").collect()]
    assert ("rail::install", "system", "cart::roll (Update)") in got and ("rail::install", "resource", "Level::new(n)") in got
    assert ("rail::install", "makes", "n") in got and ("rail::install", "plugin", "cart::plugin") in got
    assert [(f.what, f.module) for f in code.find(crate, ["cart"]).collect()] == [("module", ["rail", "cart"])]
    assert [(f.what, f.module) for f in code.find(crate, ["Level"]).collect()] == [("item", ["core"])]
    assert code.find(crate, ["Level", "new"]).count() == 1 and code.find(crate, ["nothing"]).count() == 0
    counts = code.check_counts(crate).first()
    assert (counts.module_docs, counts.modules, counts.syntax_errors, counts.documented, counts.test_docs, counts.tests) == (3, 5, 1, 3, 1, 1)


@pytest.mark.parametrize(
    "pattern, callee, method, generics, args, want",
    [
        ("register::<$T>", "register::<A>", None, "A", [], "A"),
        ("register::<$T>", "traps::register::<A<B>>", None, "A<B>", [], "A<B>"),
        ("register::<$T>", "unregister::<A>", None, "A", [], None),
        ("spawn", "world.spawn", "spawn", None, ["x", "y"], "x"),
        ("spawn", "respawn", "respawn", None, ["x"], None),
    ],
)
def test_call_patterns(spark, pattern, callee, method, generics, args, want):
    row = spark.createDataFrame([(callee, method, generics, args)], "callee string, method string, generics string, args array<string>")
    assert row.select(code.captured(pattern).alias("c")).first().c == want


def test_read_tree(spark, tmp_path):
    for path, text in CRATE.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "src/target").mkdir()
    (tmp_path / "src/target/x.rs").write_text("fn x() {}")
    (tmp_path / "src/latin.rs").write_bytes(b"// \xff\xfe")
    got = {r.path: r.source for r in trees.read_tree(spark, str(tmp_path), "src", "rust", "p").collect()}
    assert got == CRATE | {"src/latin.rs": ""}


def test_use_trees():
    refs = rust.parse("use a::{b, c::{d as e, *}, f::{self}};\n").refs
    assert [(r["segments"], r["glob"]) for r in refs] == [(["a", "b"], False), (["a", "c", "d"], False), (["a", "c"], True), (["a", "f"], False)]


def test_manifests(spark):
    crate = manifests.cargo('[package]\nname = "x-y"\n[dependencies]\na-b = "1"\n[dev-dependencies]\nc = "1"\n[target."cfg(unix)".dependencies]\nbevy = "1"\n')
    assert (crate.name, crate.externals, crate.pack) == ("x-y", ["a_b", "bevy", "c"], True)
    assert manifests.cargo("[workspace]\n") is None and manifests.cargo("= broken") is None
    package = manifests.package_json('{"name": "", "devDependencies": {"z": "1"}, "dependencies": {"@s/p": "1"}}', "dir", ("lib", "source"))
    assert (package.name, package.externals, package.source_dir) == ("dir", ["@s/p", "z"], "source")
    assert json.loads(manifests.without_comments('{"a": "//x, }", /* c, */ "b": [1, 2,], // d\n}')) == {"a": "//x, }", "b": [1, 2]}
    texts = {"t.json": '{"extends": "./base", "compilerOptions": {"paths": 1}}', "base.json": '{"compilerOptions": {"paths": 2, "baseUrl": "."}}', "loop.json": '{"extends": "./loop.json"}'}
    assert manifests.inherited("t.json", texts.get) == {"paths": 1, "baseUrl": "."} and manifests.inherited("loop.json", texts.get) == {}
    assert manifests.first_text([{"a": [1, {"b": "x"}]}, "y"]) == "x" and manifests.first_text({"a": 1}) is None
    assert manifests.settings('[[relations]]\ncall = "f"\nname = "n"\n')["relations"] == [("n", "f")]
    with pytest.raises(ValueError):
        manifests.settings("more = 1")
    files = spark.createDataFrame([("p", "package.json", "{}"), ("p", "Cargo.toml", '[package]\nname = "c"'), ("q", "Cargo.toml", "")], "project_id string, path string, source string")
    assert [(m.project_id, m.name) for m in manifests.manifests(files).collect()] == [("p", "c")]


@pytest.mark.parametrize(
    "line, want",
    [
        ("cd x && cat 'a b.rs' | head -n 3", [("cd", ("x",), False), ("cat", ("a b.rs",), False), ("head", ("-n", "3"), True)]),
        ("A=1 sudo /bin/grep -r x > out 2>&1; ls", [("grep", ("-r", "x"), False), ("ls", (), False)]),
        ("cat <<'EOF' > f\nrm x\nEOF\necho done || true", [("cat", (), False), ("echo", ("done",), False), ("true", (), False)]),
        ("echo 'open", []),
        ("a \\\n b", [("a", ("b",), False)]),
    ],
)
def test_shell_commands(line, want):
    assert [(c.program, c.args, c.piped) for c in shell.commands(line)] == want


def test_shell_parts():
    grep = shell.PROGRAMS["grep"]
    assert shell.parsed(("-A", "3", "-e", "x|y", "src", "-n"), grep) == {"pattern": ["x|y"], "word": ["src"]}
    assert shell.parsed(("-rnA3", "--include=*.rs", "x", "--", "-i"), grep) == {"deep": [""], "files": ["*.rs"], "word": ["x", "-i"]}
    assert shell.parsed(("x",), shell.PROGRAMS["rg"]) == {"deep": [""], "word": ["x"]}
    assert shell.requests("rg Level --glob '*.md'; ls | grep x; grep -e Level src", ("rs",)) == [{"pattern": "Level", "low": None, "high": None, "pos": 3, "how": "grep", "kind": "search", "paths": ["src"]}]
    assert [r["kind"] for r in shell.requests("sed -n 3p a.rs; sed 3p a.rs; sed -i.bak -n 3p a.rs; cat", ("rs",))] == ["range", "whole"]
    assert shell.line_range("40,80p") == (40, 80) and shell.line_range("12p") == (12, 12) and shell.line_range("s/a/b/p") is None
    assert shell.lexical("a/./b/../c") == "a/c" and shell.lexical("../x") is None
    assert shell.alternatives(r"fn Level\b|cart::roll", frozenset(["fn"])) == ["Level", "cart::roll"] and shell.alternatives("a b") is None


def test_guard(spark):
    calls = [
        ("Read", {"file_path": "src/long.rs"}, "whole"),
        ("Read", {"file_path": "src/long.rs", "offset": 5}, None),
        ("Read", {"file_path": "src/short.rs"}, None),
        ("Grep", {"pattern": "Level", "path": "src"}, "search"),
        ("Grep", {"pattern": "Level|some text", "path": "src"}, None),
        ("Grep", {"pattern": "Level", "glob": "*.md"}, None),
        ("Grep", {"pattern": "Level", "path": "docs"}, None),
        ("Bash", {"command": "cat src/short.rs && sed -n '3,9p' src/short.rs"}, "range"),
        ("Bash", {"command": "grep -rn 'pub fn Level' src/"}, "search"),
        ("Bash", {"command": "grep -rin Level src"}, None),
        ("Bash", {"command": "ls | grep Level"}, None),
        ("Bash", {"command": "tail ./src/../src/long.rs"}, "whole"),
        ("Edit", {"file_path": "src/long.rs"}, None),
        ("Bash", None, None),
    ]
    rows = spark.createDataFrame([(i, t, json.dumps(x) if x else "not json") for i, (t, x, _) in enumerate(calls)], "call_id long, tool_name string, tool_input string")
    asked = guard.requests(rows, ("rs",), ("rust",), frozenset(["fn", "pub"]))
    files = spark.createDataFrame([("src/long.rs", 101), ("src/short.rs", 100)], "path string, lines int")
    names = spark.createDataFrame([("Level",), ("roll",)], "name string")
    got = {r.call_id: r.reason for r in guard.judged(rows, asked, files, names).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(calls)}


def test_transcripts(spark, tmp_path):
    def used(name, **given):
        return {"type": "assistant", "timestamp": "2024-05-02T10:00:00Z", "message": {"content": [{"type": "text"}, {"type": "tool_use", "name": name, "input": given}]}}

    def said(content):
        return {"type": "user", "message": {"content": [{"type": "tool_result", "content": content}]}}

    lines = [used("Read", file_path="a.rs"), used("Read", file_path="a.rs", limit=3), used("Bash", command="atlas map x; cat b.rs"), used("mcp__atlas__map"), used("Edit", file_path="a.rs"), used("Grep", pattern="x"), said("guard: no"), said([{"text": "guard:"}, {"text": "x"}]), {"type": "user", "message": {"content": "plain"}}]
    (tmp_path / "s1.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    (tmp_path / "s0.jsonl").write_text(json.dumps({"timestamp": "2023-01-01T00", "type": "user"}) + "\n")
    sessions = transcripts.read_sessions(spark, f"file://{tmp_path}")
    got = [tuple(r) for r in transcripts.usage(sessions, "atlas", ".rs", "guard:").collect()]
    assert got == [("2024-05-02", "s1", 2, 1, 1, 1, 1, 2, "33"), ("total", None, 2, 1, 1, 1, 1, 2, "33")]
    assert transcripts.usage(sessions, "atlas", ".rs", "guard:", since="2024-06-01").count() == 1
    assert len(transcripts.usage(sessions, "atlas", ".rs", "guard:", everything=True).collect()) == 3
    edited, commands = transcripts.touched(sessions)
    assert [tuple(r) for r in edited.collect()] == [("s1", "a.rs")] and [tuple(r) for r in commands.collect()] == [("s1", "atlas map x; cat b.rs")]


def test_shared_folder_and_scratch(spark):
    from quillon.runtime import fresh_path, materialize, scratch, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    path = fresh_path(spark, "kept")
    with scratch(spark):
        inner = materialize(spark.range(3), "inner")
        kept = materialize(inner.where("id > 0"), "kept", path)
        gone = inner.inputFiles()[0].removeprefix("file://")
        assert Path(gone).exists()
    assert not Path(gone).exists() and kept.count() == 2
