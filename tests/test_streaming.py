from lexiloom.operators import tokens
from lexiloom.streaming import tokens as streaming


def test_counts_of_a_stream_are_those_of_the_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, text in enumerate(["let a = 1;", "a b\na"]):
        (tmp_path / "in" / f"{i}.js").write_text(text)
    source = streaming.read_texts(spark, str(tmp_path / "in"))
    streaming.write_counts(streaming.token_counts(source), "counts", str(tmp_path / "c1")).awaitTermination(60)
    got = {(r.ttype, r.tstr): r.n for r in spark.table("counts").collect()}
    table = spark.createDataFrame([(0, "let a = 1;"), (1, "a b\na")], "file_ord long, text string")
    want = {(r.ttype, r.tstr): r["count"] for r in tokens.tokens(table).groupBy("ttype", "tstr").count().collect()}
    assert got == want
    windows = streaming.windowed_counts(source)
    streaming.write_counts(windows, "windows", str(tmp_path / "c2")).awaitTermination(60)
    assert sum(r.n for r in spark.table("windows").collect()) == sum(want.values())
