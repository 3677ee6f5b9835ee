from pyspark.sql import functions as F

from skein.functions import planner
from skein.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_terms(spark):
    for text, want in [("GraphQLResolver", ["graph", "qlresolver"]), ("foo_bar2Baz", ["foo_bar2baz"]), ("", []), ("éau X", ["au", "x"]), ("a/b.c:d-e", ["a", "b", "c", "d", "e"])]:
        assert one(spark, T.terms(F.col("t")), t=text) == want


def test_path_parts(spark):
    assert one(spark, T.basename(F.col("p")), p="\\src\\a.py/") == "a.py"
    assert one(spark, T.extension(F.col("p")), p="a/.env") == ""
    assert one(spark, T.extension(F.col("p")), p="a/b.tar.gz") == ".gz"


def test_classify(spark):
    cases = {
        "where is the graphql resolver wired up": "natural_language",
        "GraphQLResolver": "identifier",
        "server/crates/api/src/schema.rs": "path",
        "": "natural_language",
        "parser.run now": "path",
        "fix the parser. then test": "mixed",
        "Find GraphQL schema builder": "identifier",
        "two words": "mixed",
        "word": "identifier",
    }
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    assert {r["q"]: r["k"] for r in df.select("q", planner.classify(F.col("q")).alias("k")).collect()} == cases
    assert one(spark, planner.classify(F.col("q")), q=None) == "natural_language"


def test_plan(spark):
    wide, narrow = planner.plan_one(spark, "where is the resolver"), planner.plan_one(spark, "where is the resolver", scoped=True, one_file=True)
    assert narrow.lexical_weight > wide.lexical_weight and narrow.dense_weight < wide.dense_weight and narrow.symbol_lexical_share > wide.symbol_lexical_share
    assert planner.plan_one(spark, "GraphQLResolver").dense_weight == 0


def test_lines_and_snippets(spark):
    assert one(spark, T.line_slice(F.col("t"), 2, 3), t="alpha\nbeta\ngamma\n") == "beta\ngamma\n"
    assert one(spark, T.line_slice(F.col("t"), 2, 3), t="alpha\nbeta\ngamma") == "beta\ngamma" and one(spark, T.line_slice(F.col("t"), 5, 6), t="a\n") == ""
    assert one(spark, T.line_slice(F.col("t"), 1, 1), t="a\nb") == "a\n"
    assert one(spark, T.snippet(F.lit("needle"), F.col("t"), 30), t="x" * 50 + "needle" + "y" * 50).count("needle") == 1
    assert one(spark, T.preview(F.col("t"), 3), t="\nabcd\n") == "abc\n..."
    assert one(spark, T.byte_size(F.col("t")), t="25MB") == 25 * 1024**2
    assert one(spark, T.byte_size(F.col("t")), t="many") is None


def test_json_strings(spark):
    for text, want in (('{"a": "x"}', "x"), ('{"a": 3}', "3"), ('{"a": true}', "true"), ('{"a": null}', None), ('{"a": [1]}', None), ('{"a": {"b": 1}}', None), ("{cut", None), ('{"b": 1}', None)):
        assert one(spark, T.json_string(F.col("j"), "a"), j=text) == want, text


def test_flavors(spark):
    rows = [("where is the userIndex built", "content identifiers basename path"), ("UserIndex", "identifiers basename path content"), ("src/user_index.rs", "path basename identifiers")]
    got = planner.flavored(spark.createDataFrame([(q,) for q, _ in rows] + [(None,)], "query string")).collect()
    assert [" ".join(r["fields"]) for r in got[1:3]] == [f for _, f in rows[1:]] and got[1]["text"] == "user index" and got[2]["text"] == "src user_index rs"


def test_ids(spark):
    got = one(spark, T.chunk_id(F.lit("src/lib.rs"), F.lit(10), F.lit(20), F.col("c")), c="fn example() {}")
    assert len(got) == 22 and got.startswith("chunk_")
