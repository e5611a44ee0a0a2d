import pytest

from quillon.operators import code
from quillon.plans.reports import Reports
from quillon.sources import manifests, trees

SHOP = {
    "src/index.ts": "/**\n * Shop: a till and its goods.\n */\n\nimport { Till } from './till/drawer'\nimport fs from 'node:fs'\nexport { Till } from './till/drawer'\n/** Runs. */\nexport function main(): void { new Till() }\n",
    "src/till/index.ts": "/** Tills. */\n\nexport { Till } from './drawer'\n",
    "src/till/drawer.ts": "/** The drawer. */\n\nimport { Good } from '@/goods'\nimport { paint } from 'screen/paint.js'\nimport _ from 'lodash/fp'\n/** Holds goods. */\nexport class Till implements Iterable<Good> {\n  /** Adds. */\n  add(g: Good): void {}\n}\n",
    "src/screen/paint.tsx": "import { Till } from '../till'\nimport odd from 'nowhere'\nexport const paint = (t: Till) => <b>{t}</b>\n",
    "src/goods.ts": "/** Goods. */\n\nexport interface Good { price: number }\n",
    "src/goods.test.ts": "import { Good } from './goods'\n",
}
OPTIONS = {"baseUrl": "./src", "paths": {"@/*": ["./*"], "exactly": ["goods.ts"], "out/*": ["../lib/*"]}}


@pytest.fixture(scope="module")
def shop(spark):
    return trees.catalog(spark.createDataFrame([("p", k, v) for k, v in SHOP.items()], "project_id string, path string, source string"), "typescript")


def test_aliases():
    assert manifests.aliases(OPTIONS, "src") == [("@/", False, []), ("exactly", True, ["goods.ts"]), (None, False, [])]
    assert manifests.aliases({}, "src") == [] and manifests.aliases({"baseUrl": "."}, "src") == []


def test_scripts_are_resolved(spark, shop):
    rules = spark.createDataFrame([("p", *a) for a in manifests.aliases(OPTIONS, "src")], "project_id string, prefix string, exact boolean, target array<string>")
    externals = spark.createDataFrame([("p", "lodash")], "project_id string, name string")
    got = {("/".join(r.module), "/".join(r.segments)): (r.tag, r.package, None if r.target is None else "/".join(r.target), r.symbol) for r in code.resolved(shop, externals, rules).collect()}
    assert got == {
        ("", "till/drawer/Till"): ("internal", None, "till/drawer", "Till"),
        ("", "till/drawer"): ("internal", None, "till/drawer", None),
        ("", "fs"): ("external", "fs", None, None),
        ("till", "till/drawer"): ("internal", None, "till/drawer", None),
        ("till/drawer", "@/goods/Good"): ("internal", None, "goods", "Good"),
        ("till/drawer", "screen/paint.js/paint"): ("internal", None, "screen", "paint.js"),
        ("till/drawer", "lodash/fp"): ("external", "lodash", None, None),
        ("screen/paint", "till/Till"): ("internal", None, "till", "Till"),
        ("screen/paint", "nowhere"): ("other", None, None, None),
    }


def test_reports_of_scripts(shop):
    r = Reports(shop, ["lodash"], aliases=manifests.aliases(OPTIONS, "src"))
    text = r.map([])
    assert "(root)   src/  5 files" in text and "typescript" in text and "function main(): void" in text and "external  lodash 1" in text
    assert r.check()[1] and "till/drawer.ts" not in r.check()[0].split("missing")[1].split("public")[0]
    assert "Adds." in r.show(["Till", "add"]) and "Till.add(g: Good): void" in text or "Till.add" in r.map(["till"])
