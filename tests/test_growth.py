"""Work is dealt out by what there is to do, not by how few partitions the input came in; and no step's rows grow faster than its input."""

from quillon.operators import code, guard
from quillon.plans import dependencies
from quillon.sources import rust, trees


def test_files_of_one_partition_are_parsed_in_several_and_numbered_across_them(spark, monkeypatch):
    monkeypatch.setattr(trees, "TASK_FILES", (2, 7))
    rows = [(f"p{n % 2}", f"src/m{n}.rs", f"use crate::m{n % 4}::A;\npub struct A;\n") for n in range(60)]
    cat = trees.catalog(spark.createDataFrame(rows, "project_id string, path string, source string").coalesce(1), "rust")
    assert cat.files.rdd.getNumPartitions() > 0 and len({p.rsplit("/", 1)[1].split("-")[1] for p in cat.files.inputFiles()} - {"earlier"}) >= 8
    for p in ("p0", "p1"):
        got = [f.path for f in cat.files.where(f"project_id = '{p}'").orderBy("file_id").select("path", "file_id").collect()]
        assert got == sorted((r[1] for r in rows if r[0] == p), key=lambda x: x.split("/"))
        assert sorted(f.file_id for f in cat.files.where(f"project_id = '{p}'").collect()) == list(range(30))
    assert {(i.project_id, i.in_file) for i in cat.located("items").collect()} == {r[:2] for r in rows}
    found = code.resolved(cat, spark.createDataFrame([], "project_id string, name string"))
    want = {(r[0], ("m" + str(n % 4),) if n % 4 % 2 == n % 2 else (), "A" if n % 4 % 2 == n % 2 else f"m{n % 4}") for n, r in enumerate(rows)}
    assert {(r.project_id, tuple(r.target), r.symbol) for r in found.collect()} == want and found.count() == 60


def test_resolution_needs_no_join_of_references_with_files(spark):
    cat = trees.catalog(spark.createDataFrame([("p", "src/a.rs", "use b::C;\nfn f() { C::new(); }\n")], "project_id string, path string, source string"), "rust")
    plan = cat.located("calls")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2 and "rightHint=(strategy=broadcast)" in plan  # the parsed files, and the few numbers of partitions
    followed = [r["import"] for r in cat.located("refs").orderBy("seq").collect()]
    assert followed == [None, ["b", "C"]]


def test_tokens_found_at_once_are_those_found_one_by_one(monkeypatch):
    text = "//! Doc.\nuse a::b as c;\n/// X.\npub fn f<'a>(x: &'a str) -> u8 { let c = 'x'; call(b'y', \"s\\\"t\", 1.5, r#type)?; x.y::<Z>() }\nconst S: &str = \"open\n"
    at_once = vars(rust.parse(text))
    monkeypatch.setattr(rust._File, "_split", rust._File._lex)
    assert at_once == vars(rust.parse(text)) and at_once["parse_errors"] and at_once["calls"]


def test_commands_are_parsed_once_for_all_that_judging_reads(spark):
    calls = spark.createDataFrame([(n, "Bash", '{"command": "cat a.rs | head; grep -rn Name ."}') for n in range(4)], "call_id long, tool_name string, tool_input string")
    asked = guard.requests(calls, ("rs",))
    files, names = spark.createDataFrame([("a.rs", 500)], "path string, lines int"), spark.createDataFrame([("Name",)], "name string")
    out = guard.judged(calls, asked, files, names)
    assert "mapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString() and "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.verdict, r.reason, r.how) for r in out.collect()] == [("block", "whole", "cat")] * 4


def test_lines_of_one_task_are_bounded(spark, small, monkeypatch):
    monkeypatch.setattr(dependencies, "TASK_LINES", 500)
    assert dependencies._uses(spark, small).rdd.getNumPartitions() >= 12
    plan = dependencies.dependency_tree(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
