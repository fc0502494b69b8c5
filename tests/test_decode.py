"""Encoding and decoding where the tokens stand, with any part of the vocabulary broadcast."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import lexicon
from lexiloom.operators import codec, dictionary, tokens
from lexiloom.plans import queries

TEXTS = [
    (7, "if x == 'a' { return 'a'; } // gone\n\n\tπ = \"q\"  + 0x1F /* open", "js"),
    (8, "if π é ° ° _u 'once'\n", None),
    (9, "only_here " * 3 + "\r\n x", "go"),
    (10, " \n\t ", "js"),
    (11, None, "js"),
    (12, "lonely", None),
]


def expected(files):
    rows = tokens.tokens(files).orderBy("file_ord", "line_no", "tok_no").collect()
    out = {}
    for r in rows:
        out.setdefault(r.file_ord, []).append(r.tstr)
    return out


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("limit", [0, 600, 1 << 20])
def test_any_share_broadcast(spark, packed, limit):
    files = spark.createDataFrame(TEXTS, "file_ord long, text string, lang string")
    counts = dictionary.count(tokens.occurrences(files, "lang"), packed)
    entries = dictionary.of_counts(counts, lexicon.lexicon(spark), packed)
    table = codec.code_table(counts, entries)
    least = codec.frequent_from(table, limit)
    assert (least > table.agg(F.max("n")).first()[0]) == (limit == 0) and (least == 0) == (limit == 1 << 20)
    got = {r.file_ord: r.toks for r in codec.encode_decode(files, table, entries, limit).collect()}
    assert got == expected(files) and set(got) == {7, 8, 9, 12}
    plain = dictionary.build(dictionary.classify(tokens.tokens(files).join(files.select("file_ord", "lang"), "file_ord"), lexicon.lexicon(spark)))
    assert sorted(map(tuple, entries.collect())) == sorted(map(tuple, plain.collect()))
    coded = codec.encode_tokens(tokens.tokens(files), entries).where("tag != 'r'").select("tstr", "tag", "idx").distinct().collect()
    place = {dictionary.TAG[c]: i for i, c in enumerate(dictionary.CLASSES)}
    assert {(r.token, r.code) for r in table.where("code >= 0").collect()} == {(r.tstr, (place[r.tag] << codec.CLASS_BITS) + r.idx) for r in coded}


def test_ids_that_do_not_fit(spark, tmp_path):
    """Ids beyond 32 bits and negative ones are first occurrences too."""
    docs = spark.createDataFrame([(-5, "b a", "en"), (1 << 40, "a c", "en"), (3, "c 'x' 'x'", "xx")], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.file_ord: r.n_tokens for r in queries.dict_decode(spark, str(tmp_path)).collect()} == {-5: 2, 1 << 40: 2, 3: 3}


def test_occurrences_are_not_shuffled(spark):
    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    n = queries.dict_decode(spark, "/root/testdata/sf0.001").agg(F.sum("n_tokens")).first()[0]
    assert 0 < shuffled() - before < n


def test_quick_patterns_and_one_tokenization(spark):
    odd = "\t a \x0b \u0085 é x́ // c\n\"a\\\"b\" '\\\n`x${ y /* z */ .5 ... 0x1g 漢字 \U0001d400  \t  q /\"/ //"
    files = spark.createDataFrame([(1, odd), (2, ""), (3, None)], "file_ord long, text string")
    rows = tokens.occurrences(files).withColumn("ttype", tokens.token_type(F.col("tstr"))).where("ttype is not null").orderBy("file_ord", "pos")
    assert [r.tstr for r in rows.collect()] == expected(files)[1]
    plan = tokens.occurrences(files.repartition(3, "file_ord"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
