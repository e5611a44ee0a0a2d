import pytest
from test_sources import crate  # noqa: F401

from quillon.operators import links
from quillon.plans.reports import Node, Reports, aligned, drawn, field_line, page


@pytest.fixture(scope="module")
def reports(crate):  # noqa: F811
    return Reports(crate, ["serde"], [("makes", "Level::new")], pack=True)


def test_rendering():
    assert field_line("A", "x") == "A             x" and field_line("longer than fourteen", "x") == "longer than fourteenx"
    assert aligned([("a", "1"), ("bbb", "")]) == ["  a    1", "  bbb"]
    assert page(["", "a", "", "", "b", ""]) == "a\n\nb\n"
    assert drawn([Node("a", "x", ["note"], [Node("b")]), Node("cc", "y")]) == ["├── a   x", "│     note", "│   └── b", "└── cc  y"]


def test_deps(reports):
    assert reports.deps(["rail"]) == "crate::rail  (2 files)   fan-out 1 · fan-in 1\n└── core  2 files   Level\n\nexternal    serde 1\n"
    assert reports.deps(["core"], reverse=True) == (
        "crate::core  (1 file)   fan-out 0 · fan-in 1\n└── rail  2 files\n      src/rail/cart.rs:1  Level\n      src/rail/mod.rs:5  Level\n"
    )
    deep = reports.deps(["core"], depth=1, reverse=True)
    assert "    └── rail::cart  1 file" in deep
    assert reports.deps([]).splitlines()[1:4] == ["├── bad   fan-out 0 · fan-in 0", "├── core  fan-out 0 · fan-in 1", "└── rail  fan-out 1 · fan-in 1"]


def test_check(reports):
    text, wrong = reports.check()
    assert wrong and text.splitlines()[0] == "module docs   3 of 5 files"
    for line in ("  missing: src/bad.rs", "           src/rail/cart.rs", "tests         1 of 1 with a doc line", "links         1 checked, 0 broken", "recipes       add a rail (src/rail/mod.rs:3)", "syntax errors src/bad.rs"):
        assert line in text.splitlines()
    assert "syntax errors none" in reports.check(["core"])[0]


def test_howto(reports):
    assert reports.howto() == "RECIPES\n  add a rail  src/rail/mod.rs:3   Call [`install`].\n"
    assert reports.howto("RAIL") == "How to add a rail   (src/rail/mod.rs:3, 1 link ok)\nCall install (src/rail/mod.rs:10).\n"
    assert reports.howto("nothing") == "RECIPES\n"


def test_show(reports):
    text = reports.show(["Level"]).splitlines()
    assert text[0] == "Level  struct · component · impl Default · crate::core · src/core.rs:3-7"
    assert "  fn Level::new(at: u8) -> Self" in text and "  fn Level::up(&mut self)   [no doc]" in text
    assert "used by       src/rail/cart.rs:1 · src/rail/mod.rs:5,12" in text
    assert reports.show(["Level", "new"]).splitlines()[-1] == "called by     Level::default src/core.rs:19 · rail::install src/rail/mod.rs:12"
    assert reports.show(["install"]).splitlines()[-1].startswith("called by     main src/main.rs:6 · cart::roll src/rail/cart.rs:11")
    with pytest.raises(ValueError, match="no symbol nothing"):
        reports.show(["nothing"])


def test_map(reports):
    text = reports.map(["rail"])
    for line in ("MODULE        crate::rail   src/rail/  2 files · 34 lines · rust", "PURPOSE       Rails.", "  cart  [no module doc]", "## mod.rs", "  use crate::core::Level", "## cart.rs", "  pub(crate) fn plugin(n: u8)   [no doc]", "RELATIONS  (bevy pack)", "  internal  core 2", "  external  serde 1", "  used by   crate (root)", "  works  It works.", "RECIPES       howto add a rail", "UNDOCUMENTED  1 of 2 public items in this module"):
        assert line in text.splitlines(), line
    assert "fn roll()" in reports.map(["rail"], private=True) and "      · pub at: u8" in reports.map(["core"], fields=True)
    assert "SHAPE         star: 2 parts -> core, no other sibling imports, no cycles" in reports.map([]).splitlines()


def test_link_scanner(spark):
    line = "See [`a`], [`b c`](x::y(z)), [[docs/f.md]], `code` and ``[`no`]`` [[howto:Do It]]"
    row = spark.createDataFrame([(line,)], "t string").select(links.scanned("t").alias("l")).first()
    assert row.l == ["[`a`]", "[`b c`](x::y(z))", "[[docs/f.md]]", "[[howto:Do It]]"]
    names = spark.createDataFrame([("struct@A<B>::c()",), ("m!",)], "t string")
    from pyspark.sql import functions as F

    assert [r.c for r in names.select(links.cleaned(F.col("t")).alias("c")).collect()] == ["A::c", "m"]
