import json
import subprocess

import pytest

from quillon import cli, project
from test_script_tree import SHOP

LIB = "//! Shapes.\n\npub fn legacy() {}\n\n/// Area.\npub fn area(r: f32) -> f32 { r }\n"


@pytest.fixture
def crate(tmp_path):
    root = tmp_path / "crate"
    (root / "src").mkdir(parents=True)
    (root / "Cargo.toml").write_text('[package]\nname = "shapes"\n')
    (root / "src/lib.rs").write_text(LIB)
    return root


def ask(spark, root, *args, text=()):
    return cli.run(["--root", str(root), *args], lambda: spark, text)


def test_commands_and_codes(spark, crate, tmp_path):
    code, out, _ = ask(spark, crate, "check")
    assert code == 0 and "src/lib.rs:3 fn legacy" in out
    assert ask(spark, crate, "check", "--strict")[0] == 1
    assert "fn area" in ask(spark, crate, "map", ".")[1] and "Area." in ask(spark, crate, "show", "area")[1]
    assert "fn legacy 3-3" in ask(spark, crate, "show", "src/lib.rs:1-4")[1] and "MODULE" in ask(spark, crate, "show", "src/lib.rs")[1]
    assert ask(spark, crate, "show", "nothing")[0] == 2 and ask(spark, crate, "map", "src/nope")[0] == 2
    assert "RECIPES" in ask(spark, crate, "out")[1] and ask(spark, crate, "deps", ".")[0] == 0
    assert project.find_root(crate / "src") == crate and project.find_root(tmp_path) is None
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare/Cargo.toml").write_text('[package]\nname = "x"\n[workspace]\n')
    code, _, err = ask(spark, tmp_path / "bare", "check")
    assert code == 2 and "no folder src" in err and "workspace" in err
    assert project.session_folder("/home/a_b/c.d") == "-home-a-b-c-d"


def test_changes_since_a_revision(spark, crate):
    assert ask(spark, crate, "check", "--changed")[0] == 2
    git = lambda *a: subprocess.run(["git", "-C", str(crate), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (crate / ".gitignore").write_text("made.rs\n")
    git("add", "-A")
    git("commit", "-qm", "x")
    (crate / "src/made.rs").write_text("pub fn made() {}\n")
    assert ask(spark, crate, "check", "--changed", "--strict")[0] == 0 and "made" not in ask(spark, crate, "check")[1]
    (crate / "src/lib.rs").write_text(LIB.replace("/// Area.\n", "").replace("r: f32)", "r: f64)") + "pub mod extra;\npub fn fresh() {}\n")
    (crate / "src/extra.rs").write_text("/// Fine.\npub fn fine() {}\n")
    code, out, _ = ask(spark, crate, "check", "--changed", "HEAD", "--strict")
    assert code == 1 and "missing: src/extra.rs" in out and "fn area" in out and "fn fresh" in out and "legacy" not in out and "fine" not in out
    assert ask(spark, crate, "check", "--changed", "nowhere")[0] == 2
    said = {"message": {"content": [{"type": "tool_use", "name": "Edit", "input": {"file_path": str(crate / "src/extra.rs")}}]}, "type": "assistant"}
    (crate / "session.jsonl").write_text(json.dumps(said) + "\n")
    call = {"cwd": str(crate), "transcript_path": str(crate / "session.jsonl")}
    code, why = cli.hooked("stop", json.dumps(call), lambda: spark)
    assert code == 2 and "src/extra.rs" in why and "fresh" not in why
    assert cli.hooked("stop", json.dumps(call | {"stop_hook_active": True}), lambda: spark) == (0, "")


def test_guard_and_requests(spark, crate):
    (crate / "src/lib.rs").write_text(LIB + "// more\n" * 200)
    call = lambda **i: json.dumps({"cwd": str(crate / "src"), "tool_name": i.pop("tool"), "tool_input": i})
    assert cli.hooked("guard", call(tool="Read", file_path="lib.rs"), lambda: spark)[0] == 2
    assert cli.hooked("guard", call(tool="Read", file_path="/etc/hosts"), lambda: spark) == (0, "")
    assert cli.hooked("guard", call(tool="Grep", pattern="area", path="."), lambda: spark)[0] == 2
    assert cli.hooked("guard", call(tool="Edit", file_path="lib.rs"), lambda: spark) == (0, "") == cli.hooked("guard", "no json", lambda: spark)
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "show", "arguments": {"symbol": "area"}}}, {"id": 4, "method": "tools/call", "params": {"name": "show", "arguments": {"symbol": "none"}}}, {"id": 5, "method": "other"}]
    got = [json.loads(x) for x in ask(spark, crate, "mcp", text=[*map(json.dumps, asked), "{broken", ""])[1].splitlines()]
    assert [g.get("id") for g in got] == [1, 2, 3, 4, 5, None] and len(got[1]["result"]["tools"]) == 5
    assert "Area." in got[2]["result"]["content"][0]["text"] and got[3]["result"]["isError"] and got[4]["error"]["code"] == -32601 and got[5]["error"]["code"] == -32700


def test_scripts_and_usage(spark, tmp_path):
    for path, text in SHOP.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "package.json").write_text('{"name": "shop", "dependencies": {"lodash": "1"}}')
    (tmp_path / "tsconfig.json").write_text('{"compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["./*"]}} /* all */}')
    code, out, err = ask(spark, tmp_path, "map", ".", "--fields")
    assert code == 0 and "5 files" in out and "lodash 1" in out, err
    assert "goods" in ask(spark, tmp_path, "deps", "till")[1] and "Till.add" in ask(spark, tmp_path, "show", "Till.add")[1]
    (tmp_path / "s.jsonl").write_text(json.dumps({"type": "assistant", "timestamp": "2024-05-02T10:00:00Z", "message": {"content": [{"type": "tool_use", "name": "Read", "input": {"file_path": "a.rs"}}]}}) + "\n")
    code, out, _ = cli.run(["usage", f"file://{tmp_path}/s.jsonl"], lambda: spark)
    assert code == 0 and out.splitlines()[0].startswith("date") and out.splitlines()[-1].startswith("total")
