import numpy as np

from skein.llm import forest
from skein.llm import provenance as P

HAND = "import x\n\n\ndef compute_total(items, factor=3):\n    # adds the values up\n    total = 0\n    for item in items:\n        total += item.value * factor\n    return total\n" * 3


def reason(path, text):
    return P.evidence(path, text)[0]


def test_notices_count_only_in_the_header():
    assert reason("a.go", "// Code generated by protoc-gen-go. DO NOT EDIT.\npackage a\n") == "generated"
    assert reason("a.py", "#!/usr/bin/env python\n# @generated by tool from a.idl\nx = 1\n") == "generated"
    assert reason("a.js", '/* Erzeugt von toolgen 1.2, nicht bearbeiten */\nlet a = 1\n') == "generated"
    assert reason("a.py", HAND + "# @generated by tool\n") == ""
    assert reason("a.js", 'out.write("// <auto-generated> x </auto-generated>")\n' + HAND) == ""
    assert reason("a.c", "// Do not edit the snapshot by hand; it is read.\n// Ids are auto-generated by the server.\nint a;\n") == ""
    assert reason("a.c", "// Copyright (c) 2026 the authors of this repository.\nint a;\n") == ""
    assert reason("a.c", "// Copyright (c) 2016 the left right contributors\nint a;\n") == "vendored"


def test_conventions_of_paths_are_features_and_no_marks():
    for path in ("vendor/x/a.go", "web\\node_modules\\x\\i.js", "./third_party/a.c", "src/a.min.js", "a_pb2.py", "x.pb.go", "p.tab.c", "src/bindings_ab.rs"):
        assert P.place(path) == [1.0] and reason(path, HAND) == "", path
    for path in ("src/vendors/a.go", "app/vendor_portal/a.py", "lib/external_events/a.js", "src/generators/a.py", "src/dist_sort/a.c", "src/lib/a.py"):
        assert P.place(path) == [0.0], path


def test_bulk_data_and_small_tables():
    table = "DATA = [\n" + ("    " + ", ".join(str(i * 7919 % 100000) for i in range(12)) + ",\n") * 40 + "]\n"
    assert reason("a.py", table) == "data"
    assert reason("a.py", HAND + "SMALL = [1, 2, 3, 4, 5, 6, 7, 8]\n") == ""
    assert reason("a.py", "VERSION = '1.2.3'\n") == ""


def test_header_and_opening_are_hidden_from_features():
    a = P.evidence("a.py", "# @generated by tool\n# do not edit\n\n" + HAND)[1]
    assert a == P.evidence("a.py", HAND)[1]
    js = 'function f() {\n  return 1;\n}\n' * 5
    assert P.evidence("a.js", '"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\n' + js) == ("generated", [*P.features("\n" + js), 0.0])
    assert len(P.features("")) + 1 == len(P.FEATURES) == len(a) and all(np.isfinite(a))


def test_a_kind_without_any_notice_is_learned_from_another(spark):
    """Notices stand in third_party only; files of vendor are found by what the forest learned there."""
    rows = [("r", f"third_party/a/x{i}.py", f"t{i}", ("# Vendored from upstream\n" if i % 2 else "") + HAND.replace("total", f"sum{i}"), 1, 1) for i in range(60)]
    rows += [("r", f"vendor/b/x{i}.py", f"v{i}", HAND.replace("total", f"all{i}"), 1, 1) for i in range(30)]
    rows += [("r", f"src/x{i}.py", f"s{i}", HAND.replace("total", f"own{i}"), 1, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "repo string, relative_path string, id string, content string, start_line long, end_line long")
    got = {r["relative_path"] for r in P.mark_files(df).where("marked").collect()}
    assert len([x for x in got if x.startswith("third_party")]) == 60 and len([x for x in got if x.startswith("vendor")]) == 30 and not [x for x in got if x.startswith("src")]


def test_forest_on_held_out_rows():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.7)).astype(float)
    model = forest.train(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    assert (forest.train(x[:0], y[:0]).predict(x[:3]) == 0).all()


def test_unmarked_packed_files_are_found(spark):
    rng = np.random.default_rng(5)
    names = [f"{a}_{b}" for a in ("load", "read", "keep", "sort", "walk", "fold") for b in ("index", "record", "panel", "shelf", "token", "graph")]

    def hand(i):
        out = []
        for _ in range(6):
            f, g, h = rng.choice(names, 3)
            out.append(f"// {f} is kept for the {g}\nfunction {f}({g}, {h}) {{\n  const {f}X = {g}.map((item) => item.{h});\n  return {f}X.filter(Boolean);\n}}\n")
        return "\n".join(out)

    def packed(i):
        v = "abcdefghijklmnopqrstuvwxyz"
        return "var " + ",".join(v) + ";" + "".join(f"function {v[rng.integers(26)]}{rng.integers(99)}({v[rng.integers(26)]},{v[rng.integers(26)]}){{return {v[rng.integers(26)]}.{v[rng.integers(26)]}<<{rng.integers(32)}}}" for _ in range(40))

    rows = [("r", f"src/h{i}.js", f"h{i}", hand(i), 1, 1) for i in range(150)]
    rows += [("r", f"src/m{i}.min.js", f"m{i}", "/*! m license */\n" + packed(i), 1, 1) for i in range(25)] + [("r", f"src/k{i}.js", f"k{i}", "/*! k license */\n" + packed(i), 1, 1) for i in range(25)] + [("r", f"src/u{i}.js", f"u{i}", packed(i), 1, 1) for i in range(15)]
    rows += [("r", "docs/x.md", "md", "# generated", 1, 1), ("r", "src/n.js", "n", None, 1, 1), (None, "src/e.js", "e", "", 1, 1)]
    df = spark.createDataFrame(rows, "repo string, relative_path string, id string, content string, start_line long, end_line long").selectExpr("*", "1 as score", "'y' as label")
    got = {r["relative_path"] for r in P.mark_files(df).where("marked").collect()}
    assert {f"src/m{i}.min.js" for i in range(25)} | {f"src/k{i}.js" for i in range(25)} <= got
    assert len({f"src/u{i}.js" for i in range(15)} & got) >= 13 and len({f"src/h{i}.js" for i in range(150)} & got) <= 2
    assert P.mark_files(df.limit(0)).collect() == []
