from pyspark.sql import functions as F

from skein.functions import embed
from skein.sources.definitions import definitions, refined


def names(text, language):
    return [(d.kind, d.name, d.container, d.start, d.end) for d in definitions(text, language)]


def test_rust_nesting():
    text = "mod graphql {\n    struct Schema {\n        a: u8,\n    }\n    impl Schema {\n        fn build() { /* } */ let s = \"}\"; }\n    }\n}\n"
    assert names(text, "rust") == [("module", "graphql", None, 1, 8), ("struct", "Schema", "graphql", 2, 4), ("impl", "Schema", "graphql", 5, 7), ("function", "build", "graphql::Schema", 6, 6)]


def test_c_definition_and_references():
    text = "struct node { int v; };\nstruct node *next(struct node *n) {\n  return n;\n}\n"
    assert [(k, n) for k, n, *_ in names(text, "c")] == [("struct", "node"), ("function", "next")]


def test_other_languages():
    assert [d.name for d in definitions("package a\n\ntype S struct {\n}\n\nfunc (s *S) F() {\n}\n\nfunc g() {\n}\n", "go")] == ["S", "F", "g"]
    assert [(d.kind, d.name, d.container) for d in definitions("class A {\n  public int f(int a) {\n    return g(a);\n  }\n}\n", "java")] == [("class", "A", None), ("method", "f", "A")]
    ts = "export interface I {\n  a: string;\n}\nexport class B {\n  private run(x: number): void {\n    if (x) { y(); }\n  }\n}\nconst h = (a) => {\n};\n"
    assert [(d.kind, d.name) for d in definitions(ts, "typescript")] == [("interface", "I"), ("class", "B"), ("method", "run"), ("function", "h")]
    assert definitions("anything {", "markdown") == [] and definitions("", "go") == []


def test_refined_pieces():
    text = "\n".join("x" * 50 for _ in range(200))
    parts = refined(text, 10)
    assert "\n".join(c for c, _, _ in parts) == text and all(len(c) <= 2500 for c, _, _ in parts) and parts[0][1] == 10 and parts[-1][2] == 209


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", embed.embed(F.col("t"), embed.HashingEmbedder(8)).alias("v")).collect()}
    assert got[2] is None and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and got[3] == [0.0] * 8


def test_ruby():
    text = "module Store\n  class Shelf < Base\n    # class Comment\n    def initialize(a)\n      @a = a if a\n      if a\n        each do |x|\n          puts \"end\"\n        end\n      end\n    end\n\n    def full? = @a > 3\n\n    def self.build\n      while true do\n        break\n      end\n    end\n  end\nend\n\ndef top\n  1\nend\n"
    got = [(d.kind, d.name, d.container, d.start, d.end) for d in definitions(text, "ruby")]
    assert got == [("module", "Store", None, 1, 21), ("class", "Shelf", "Store", 2, 20), ("method", "initialize", "Store::Shelf", 4, 11), ("method", "full?", "Store::Shelf", 13, 13), ("method", "build", "Store::Shelf", 15, 19), ("function", "top", None, 23, 25)]


def test_objective_c():
    text = "@interface Shelf : NSObject\n- (int)count;\n@end\n\n@implementation Shelf\n- (int)count {\n  return 1;\n}\n+ (Shelf *)make:(int)n {\n  return nil;\n}\n@end\n"
    got = [(d.kind, d.name, d.container, d.start, d.end) for d in definitions(text, "objective-c")]
    assert got == [("class", "Shelf", None, 1, 3), ("class", "Shelf", None, 5, 12), ("method", "count", "Shelf", 6, 8), ("method", "make", "Shelf", 9, 11)]
