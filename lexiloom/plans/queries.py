"""The registered queries of the library's own operators, each over whole tables, beside the SQL that must give the same rows."""

from __future__ import annotations

import lzma

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon, scalars, xz
from ..operators import codec, dictionary, image, ranks, report, respace, svg, tokens
from ..sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Which language's words a document is looked up in; Spanish and unknown ones have none.
LANG_OF = {"en": "js", "fr": "python", "de": "go"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_ord"), "text", "lang")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("file_ord"), "text")


def lang_of(lang: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for key, value in LANG_OF.items():
        chain = chain.when(lang == key, F.lit(value))
    return chain


def with_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents with their classes."""
    docs = documents(spark, sf_dir)
    langs = docs.select("file_ord", lang_of(F.col("lang")).alias("lang"))
    return dictionary.classify(tokens.tokens(docs).join(langs, "file_ord"), lexicon.lexicon(spark))


def plain_classes(spark: SparkSession, found: DataFrame) -> DataFrame:
    return dictionary.classify(found.withColumn("lang", F.lit(None).cast("string")), lexicon.lexicon(spark))


# ---- SQL that the oracles share ----


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LANG_SQL = "CASE " + " ".join(f"WHEN lang = {lit(k)} THEN {lit(v)}" for k, v in LANG_OF.items()) + " END"
LEXICON_SQL = "lexicon(llang, lcls, ltoken) AS (VALUES " + ", ".join(f"({lit(lang)}, {lit(cls)}, {lit(w)})" for cls, of in (("kw", lexicon.KEYWORDS), ("bi", lexicon.BUILTINS)) for lang, words in of.items() for w in sorted(words)) + ")"
DOCS = "SELECT doc_id AS file_ord, text, lang FROM documents"
CONVS = "SELECT conv_id * 1000 + turn AS file_ord, text, NULL::VARCHAR AS lang FROM conversations"
PAGES = "SELECT page_id AS file_ord, html AS text, NULL::VARCHAR AS lang FROM pages"
BENCH = "SELECT item_id AS file_ord, text, NULL::VARCHAR AS lang FROM benchmark"


def re2(pattern: str) -> str:
    """A pattern of the lexical grammar for an engine without possessive loops and look-around; it matches the same."""
    pattern = pattern.replace(tokens.TEMPLATE_HEAD, r"`[^`\\]*(?:\\[^\n][^`\\]*)*\$\{")
    for loop in ("]*", ")*", r"\*+"):
        pattern = pattern.replace(loop + "+", loop)
    return pattern


def token_sql(source: str, p: str = "") -> str:
    """CTEs up to ``{p}tok`` (file_ord, lang, line_no, tok_no, indent, tstr, ttype) of a source (file_ord, text, lang)."""
    return f"""
{p}src AS ({source}),
{p}ln AS (
  SELECT file_ord, lang, unnest(a) AS line, generate_subscripts(a, 1) AS line_no
  FROM (SELECT file_ord, lang, string_split(regexp_replace(text, {lit(re2(tokens.STRING_OR_COMMENT))}, '\\1', 'g'), chr(10)) AS a FROM {p}src)
), {p}bd AS (
  SELECT file_ord, lang, line_no, length(line) - length(ltrim(line, ' ' || chr(9))) AS indent, ltrim(line, ' ' || chr(9)) AS line FROM {p}ln
), {p}raw AS (
  SELECT file_ord, lang, line_no, indent, unnest(a) AS tstr, generate_subscripts(a, 1) - 1 AS tok_no
  FROM (SELECT *, regexp_extract_all(line, {lit(re2(tokens.TOKEN))}, 0) AS a FROM {p}bd WHERE line <> '')
), {p}tok AS (
  SELECT *, CASE WHEN length(tstr) > 1 AND tstr[1] IN ('"', '''', '`') THEN 'STRING' WHEN regexp_matches(tstr, '^\\.?[0-9]') THEN 'NUMBER'
                 WHEN contains({lit(tokens.OPERATOR_CHARS)}, tstr[1]) THEN 'OP' ELSE 'NAME' END AS ttype
  FROM {p}raw WHERE NOT regexp_matches(tstr, '^(?:[ \\t\\r\\f\\v]+$|//|/\\*)')
)"""


def class_sql(p: str = "") -> str:
    """CTEs ``{p}cl``, tokens with cls, and ``{p}dict`` (cls, idx, token, n), from ``{p}tok`` and ``lexicon``."""
    return f"""
{p}known AS (SELECT llang, ltoken, max(CASE WHEN lcls = 'kw' THEN 2 ELSE 1 END) AS known FROM lexicon GROUP BY ALL),
{p}cl AS (
  SELECT t.*, CASE ttype WHEN 'OP' THEN 'op' WHEN 'NUMBER' THEN 'nu' WHEN 'STRING' THEN 'st'
                         ELSE CASE WHEN known = 2 THEN 'kw' WHEN known = 1 THEN 'bi' WHEN regexp_matches(tstr, '^\\p{{L}}') THEN 'id' END END AS cls
  FROM {p}tok t LEFT JOIN {p}known k ON ttype = 'NAME' AND k.ltoken = tstr AND k.llang = {LANG_SQL}
), {p}cnt AS (
  SELECT cls, tstr AS token, count(*) AS n, min({{'f': file_ord, 'l': line_no, 't': tok_no}}) AS f
  FROM {p}cl WHERE cls IS NOT NULL GROUP BY cls, tstr HAVING cls <> 'st' OR count(*) >= 2
), {p}dict AS (
  SELECT cls, token, n, row_number() OVER (PARTITION BY cls ORDER BY
      CASE WHEN cls IN ('id', 'st') THEN -n WHEN cls = 'nu' THEN length(token) ELSE 0 END,
      CASE WHEN cls IN ('id', 'st') THEN f END, token) - 1 AS idx
  FROM {p}cnt
)"""


HEX = "lpad(upper(to_base({0}, 16)), {1}, '0')"
TAGS_SQL = "CASE cls WHEN 'kw' THEN 'k' WHEN 'bi' THEN 'b' WHEN 'op' THEN 'o' WHEN 'nu' THEN 'n' WHEN 'id' THEN 'i' WHEN 'st' THEN 's' END"
ENCODE_SQL = f"""
size AS (SELECT cls, count(*) AS size FROM dict GROUP BY cls),
look AS (
  SELECT CASE d.cls WHEN 'op' THEN 'OP' WHEN 'nu' THEN 'NUMBER' WHEN 'st' THEN 'STRING' ELSE 'NAME' END AS ltype, token,
         min({{'o': CASE d.cls WHEN 'kw' THEN 0 WHEN 'bi' THEN 1 ELSE 2 END, 'cls': d.cls, 'idx': idx, 'size': size}}) AS b
  FROM (SELECT cls, token, max(idx) AS idx FROM dict GROUP BY cls, token) d JOIN size s ON s.cls = d.cls GROUP BY 1, 2
), found AS (
  SELECT t.*, b.cls AS cls, b.idx AS idx, CASE WHEN b.size < 128 THEN 1 WHEN b.size <= 65535 THEN 2 ELSE 4 END AS width
  FROM tok t LEFT JOIN look l ON l.ltype = t.ttype AND l.token = t.tstr
), code AS (
  SELECT *, coalesce({TAGS_SQL}, 'r') AS tag,
         CASE WHEN cls IS NULL THEN '72' || {HEX.format("strlen(tstr)", 4)} || hex(tstr) ELSE hex({TAGS_SQL}) || {HEX.format("idx", "2 * width")} END AS code
  FROM found
)"""


# ---- tokens and dictionaries ----


@query(f"WITH {token_sql(DOCS)}, {LEXICON_SQL}, {class_sql()} SELECT idx, token, n FROM dict WHERE cls = 'id'")
def token_dictionary(spark, sf_dir):
    """Identifiers of documents by descending count, then by first occurrence."""
    ids = with_classes(spark, sf_dir).where("cls = 'id'")
    counts = ids.groupBy(F.col("tstr").alias("token")).agg(F.count("*").alias("n"), F.min(F.struct("file_ord", "line_no", "tok_no")).alias("f")).select("token", "n", "f.*")
    return ranks.frequency_rank(counts, "n", ["file_ord", "line_no", "tok_no"]).select("idx", "token", "n")


@query(f"WITH {token_sql(DOCS)}, {LEXICON_SQL}, {class_sql()} SELECT ttype, coalesce(cls, 'none') AS cls, count(*) AS n, count(DISTINCT tstr) AS n_distinct FROM cl GROUP BY ALL")
def token_class_counts(spark, sf_dir):
    return with_classes(spark, sf_dir).groupBy("ttype", F.coalesce("cls", F.lit("none")).alias("cls")).agg(F.count("*").alias("n"), F.countDistinct("tstr").alias("n_distinct"))


LINES_SQL = """
tl AS (SELECT file_ord, line_no, any_value(indent) AS indent FROM tok GROUP BY ALL),
mk AS (SELECT *, CASE WHEN indent = lag(indent, 1, 0) OVER (PARTITION BY file_ord ORDER BY line_no) THEN 'FF' ELSE upper(to_base(indent + 128, 16)) END AS marker FROM tl)"""


def marked_lines(spark, sf_dir) -> DataFrame:
    source = read(spark, sf_dir, "pages").select(F.col("page_id").alias("file_ord"), F.col("html").alias("text"))
    return codec.indent_markers(tokens.tokens(source).groupBy("file_ord", "line_no").agg(F.first("indent").alias("indent")))


@query(f"WITH {token_sql(PAGES)}, {LINES_SQL} SELECT file_ord, line_no, indent, marker FROM mk")
def line_indent(spark, sf_dir):
    return marked_lines(spark, sf_dir).select("file_ord", "line_no", "indent", "marker")


@query(f"WITH {token_sql(PAGES)}, {LINES_SQL} SELECT file_ord, line_no, marker, indent FROM mk")
def indent_forward_fill(spark, sf_dir):
    """Indents from markers alone; the SQL has those of the text."""
    return codec.restore_indents(marked_lines(spark, sf_dir).drop("indent")).select("file_ord", "line_no", "marker", "indent")


@query(f"WITH {token_sql(PAGES)}, {LEXICON_SQL}, {class_sql()} SELECT idx, token, n FROM dict WHERE cls = 'st'")
def string_having_two(spark, sf_dir):
    source = read(spark, sf_dir, "pages").select(F.col("page_id").alias("file_ord"), F.col("html").alias("text"))
    return dictionary.build(plain_classes(spark, tokens.tokens(source)).where("cls = 'st'")).select("idx", "token", "n")


@query(f"WITH {token_sql(DOCS)}, {LEXICON_SQL}, {class_sql()} SELECT idx, token, n FROM dict WHERE cls = 'nu'")
def number_dictionary(spark, sf_dir):
    return dictionary.build(with_classes(spark, sf_dir).where("cls = 'nu'")).select("idx", "token", "n")


@query(f"WITH {token_sql(DOCS)}, {LEXICON_SQL}, {class_sql()} SELECT cls, idx, token, n FROM dict WHERE cls IN ('kw', 'bi', 'op')")
def keyword_sorted(spark, sf_dir):
    return dictionary.build(with_classes(spark, sf_dir).where(F.col("cls").isin("kw", "bi", "op"))).select("cls", "idx", "token", "n")


@query(f"WITH {LEXICON_SQL} SELECT doc_id, coalesce(llang, 'none') AS lang, count(ltoken) AS n_builtins FROM documents LEFT JOIN lexicon ON llang = {LANG_SQL} AND lcls = 'bi' GROUP BY ALL")
def lookup_left_builtin(spark, sf_dir):
    """Each document with how many built-ins its language has: none if it has no language or no built-ins."""
    docs = read(spark, sf_dir, "documents").select("doc_id", lang_of(F.col("lang")).alias("of"))
    words = lexicon.lexicon(spark).where("cls = 'bi'").groupBy("lang").agg(F.count("*").alias("k"))
    joined = docs.join(F.broadcast(words), F.col("of") == F.col("lang"), "left")
    return joined.select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("k", F.lit(0)).alias("n_builtins"))


EXT_SQL = "ext_lang(ext, elang) AS (VALUES " + ", ".join(f"({lit(e)}, {lit(lang)})" for e, lang in sorted({**lexicon.LANGUAGE_OF, ".py": "python"}.items())) + ")"


@query(f"WITH {EXT_SQL} SELECT doc_id, ext, elang AS lang FROM documents JOIN ext_lang ON elang = {LANG_SQL}")
def lookup_inner_lang(spark, sf_dir):
    """Documents by the extensions of their language; those without one drop out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", lang_of(F.col("lang")).alias("of"))
    return docs.join(F.broadcast(lexicon.ext_lang(spark)), F.col("of") == F.col("lang")).select("doc_id", "ext", "lang")


def coded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    classes = with_classes(spark, sf_dir)
    entries = dictionary.build(classes)
    # The dictionary grows with the corpus, so the join is shuffled on the token.
    return codec.encode_tokens(classes.drop("cls"), entries, small=False), entries


@query(f"""WITH {token_sql(DOCS)}, {LEXICON_SQL}, {class_sql()}, {ENCODE_SQL}, {LINES_SQL},
per AS (SELECT file_ord, line_no, string_agg(code, '' ORDER BY tok_no) AS codes, count(*) AS k FROM code GROUP BY ALL)
SELECT m.file_ord, sum(k)::BIGINT AS n_tokens, md5(string_agg(marker || codes, '' ORDER BY m.line_no)) AS stream_md5
FROM mk m JOIN per p ON p.file_ord = m.file_ord AND p.line_no = m.line_no GROUP BY m.file_ord""")
def dict_encode(spark, sf_dir):
    """Each document's byte stream: its digest and how many tokens it has."""
    rows, _ = coded(spark, sf_dir)
    return codec.streams(rows).select("file_ord", "n_tokens", F.md5("stream_hex").alias("stream_md5"))


@query(f"WITH {token_sql(DOCS)} SELECT file_ord, count(*) AS n_tokens, md5(string_agg(tstr, ' ' ORDER BY line_no, tok_no)) AS tokens_md5 FROM tok GROUP BY file_ord")
def dict_decode(spark, sf_dir):
    """Tokens from tags and indices; the SQL has those of the text."""
    docs = documents(spark, sf_dir).withColumn("lang", lang_of(F.col("lang")))
    ends = docs.agg(F.min("file_ord").alias("a"), F.max("file_ord").alias("b")).first()
    packed = ends["a"] is None or (ends["a"] >= 0 and ends["b"] < 1 << 32)
    counts = dictionary.count(tokens.occurrences(docs, "lang"), packed)
    entries = dictionary.of_counts(counts, lexicon.lexicon(spark), packed)
    toks = codec.encode_decode(docs.select("file_ord", "text"), codec.code_table(counts, entries), entries)
    return toks.select("file_ord", F.size("toks").cast("long").alias("n_tokens"), F.md5(F.array_join("toks", " ")).alias("tokens_md5"))


@query(f"""WITH {token_sql(BENCH)} SELECT file_ord, count(*) AS n_tokens, md5(string_agg(ttype || ' ' || tstr || ' ' || indent, chr(10) ORDER BY line_no, tok_no)) AS tokens_md5
FROM tok GROUP BY file_ord""")
def stream_decode(spark, sf_dir):
    """Tokens parsed from the bytes of streams and of the dictionary block; the SQL has those of the text."""
    source = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file_ord"), "text")
    classes = plain_classes(spark, tokens.tokens(source))
    entries = dictionary.build(classes)
    coded_rows = codec.streams(codec.encode_tokens(classes.drop("cls"), entries, small=False))
    packed = coded_rows.select(F.lit("a").alias("archive_id"), "file_ord", F.unhex("stream_hex").alias("stream")).join(dictionary.serialize(entries).withColumnRenamed("block", "dictionary").withColumn("archive_id", F.lit("a")), "archive_id")
    row = F.concat_ws(" ", "ttype", "tstr", F.col("indent").cast("string"))
    rows = codec.decode_streams(packed).withColumn("row", row)
    return rows.groupBy("file_ord").agg(F.count("*").alias("n_tokens"), F.md5(scalars.ordered_join(F.struct("line_no", "tok_no"), F.col("row"), "\n")).alias("tokens_md5"))


@query(f"WITH {token_sql(CONVS)} SELECT DISTINCT tstr AS token, '72' || {HEX.format('strlen(tstr)', 4)} || hex(tstr) AS raw_hex FROM tok")
def raw_token_bytes(spark, sf_dir):
    return tokens.tokens(conversations(spark, sf_dir)).select(F.col("tstr").alias("token")).distinct().withColumn("raw_hex", scalars.hex_raw_token(F.col("token")))


@query(f"""WITH {token_sql(BENCH)}, {LEXICON_SQL}, {class_sql()}, classes(cls, tag) AS (VALUES ('kw', '6B'), ('bi', '62'), ('op', '6F'), ('nu', '6E'), ('id', '69'), ('st', '73'))
SELECT c.cls, count(token) AS n, md5(c.tag || {HEX.format('count(token)', 4)} || coalesce(string_agg({HEX.format('strlen(token)', 4)} || hex(token), '' ORDER BY idx), '')) AS block_md5
FROM classes c LEFT JOIN dict d ON d.cls = c.cls GROUP BY c.cls, c.tag""")
def dict_serialize(spark, sf_dir):
    source = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file_ord"), "text")
    entries = dictionary.build(plain_classes(spark, tokens.tokens(source)))
    classes = spark.createDataFrame(list(enumerate(dictionary.CLASSES)), "ord int, cls string")
    return dictionary.class_blocks(entries, classes).select("cls", "n", F.md5("block_hex").alias("block_md5"))


def merged(spark, sf_dir) -> DataFrame:
    first = dictionary.build(with_classes(spark, sf_dir))
    return dictionary.merge(first, dictionary.build(plain_classes(spark, tokens.tokens(conversations(spark, sf_dir)))))


MERGE_SQL = f"""WITH {token_sql(DOCS)}, {LEXICON_SQL}, {class_sql()}, {token_sql(CONVS, "b")}, {class_sql("b")},
both_ AS (SELECT 0 AS side, * FROM dict UNION ALL SELECT 1, * FROM bdict),
once AS (
  SELECT cls, token, sum(n)::BIGINT AS n, min({{'s': side, 'i': idx}}) AS f FROM both_ WHERE cls NOT IN ('id', 'st') GROUP BY ALL
  UNION ALL SELECT cls, token, n, {{'s': side, 'i': idx}} FROM both_ WHERE cls IN ('id', 'st')
), m AS (SELECT cls, token, n, row_number() OVER (PARTITION BY cls ORDER BY f) - 1 AS idx FROM once)"""


@query(f"{MERGE_SQL} SELECT cls, idx, token, n FROM m")
def merged_dictionary(spark, sf_dir):
    return merged(spark, sf_dir).select("cls", "idx", "token", "n")


@query(f"{MERGE_SQL} SELECT cls, token, max(idx) AS last_idx, count(*) AS slots FROM m WHERE cls IN ('id', 'st') GROUP BY ALL")
def merged_id_last_index(spark, sf_dir):
    return merged(spark, sf_dir).where("cls in ('id', 'st')").groupBy("cls", "token").agg(F.max("idx").alias("last_idx"), F.count("*").alias("slots"))


# ---- names, widths, bytes ----


@query(f"""WITH i AS (SELECT range AS idx FROM range({scalars.NAMES})), a AS (SELECT {lit(scalars.ALPHABET)} AS s)
SELECT idx, CASE WHEN idx < 53 THEN s[idx + 1] WHEN idx < 2862 THEN s[(idx - 53) // 53 + 1] || s[(idx - 53) % 53 + 1]
  ELSE s[(idx - 2862) // 2809 + 1] || s[(idx - 2862) // 53 % 53 + 1] || s[(idx - 2862) % 53 + 1] END AS name FROM i, a""")
def short_names(spark, sf_dir):
    return spark.range(scalars.NAMES).select(F.col("id").alias("idx"), scalars.short_name(F.col("id")).alias("name"))


@query(f"""WITH w AS (SELECT o_orderkey, CASE WHEN o_orderkey < 128 THEN 1 WHEN o_orderkey <= 65535 THEN 2 ELSE 4 END AS width FROM orders)
SELECT o_orderkey, width::INT AS width, {HEX.format('o_orderkey', '2 * width')} AS packed, o_orderkey AS unpacked FROM w""")
def index_bytes(spark, sf_dir):
    """Numbers packed by width and read back from the bytes."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", scalars.index_width(F.col("o_orderkey")).alias("width"))
    rows = rows.withColumn("raw", scalars.pack_index(F.col("o_orderkey"), F.col("width")))
    return rows.select("o_orderkey", "width", F.hex("raw").alias("packed"), scalars.read_index(F.col("raw"), F.lit(0), F.col("width")).alias("unpacked"))


PATH_SQL = """
u AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS path FROM pages),
b AS (SELECT *, string_split(path, '/')[-1] AS fname FROM u),
e AS (SELECT *, regexp_extract(fname, '[^.].*?(\\.[^.]+)$', 1) AS ext FROM b)"""
CODE_SQL = ", ".join(map(lit, sorted(lexicon.CODE_EXTENSIONS)))


def url_files(spark, sf_dir) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "")
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("fname", scalars.basename(F.col("path")))


@query(f"""WITH {PATH_SQL} SELECT page_id, fname, ext, left(fname, (length(fname) - length(ext))::BIGINT) AS stem,
CASE WHEN lower(ext) = '.py' THEN 'p' WHEN lower(ext) IN ({CODE_SQL}) THEN 'c' WHEN lower(ext) = '.svg' THEN 's' WHEN lower(ext) = '.png' THEN 'g' ELSE '?' END AS file_type,
lower(ext) IN ({CODE_SQL}, '.py', '.svg', '.png') AS supported FROM e""")
def url_route(spark, sf_dir):
    name = F.col("fname")
    return url_files(spark, sf_dir).select("page_id", "fname", scalars.suffix(name).alias("ext"), scalars.stem(name).alias("stem"), files.file_type(name).alias("file_type"), files.supported(name).alias("supported"))


@query(f"""WITH {PATH_SQL} SELECT fname, max(page_id) AS last_id, min(page_id) AS first_ord, arg_max(path, page_id) AS path FROM e GROUP BY fname""")
def basename_last_wins(spark, sf_dir):
    named = url_files(spark, sf_dir).withColumnRenamed("page_id", "file_ord")
    return files.last_of_name(named).select("fname", F.col("file_ord").alias("last_id"), "first_ord", "path")


@query("SELECT doc_id, strlen(text)::BIGINT AS n_bytes, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stream_off FROM documents")
def stream_offsets(spark, sf_dir):
    sizes = read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return ranks.running_offset(sizes, "doc_id", "n_bytes", "stream_off").select("doc_id", "n_bytes", "stream_off")


@query("""SELECT lang AS file_type, count(*) AS files, string_agg(DISTINCT source, ',' ORDER BY source) AS exts, sum(strlen(text))::BIGINT AS orig_bytes,
sum(length(text))::BIGINT AS chars, round(sum(strlen(text)) / nullif(sum(length(text)), 0), 9) AS ratio FROM documents GROUP BY lang""")
def size_report(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("lang").alias("file_type"), F.col("source").alias("ext"), "text")
    sizes = docs.groupBy("file_type").agg(F.sum(F.octet_length("text").cast("long")).alias("orig_bytes"), F.sum(F.length("text").cast("long")).alias("chars"))
    ratio = F.round(report.ratio(F.col("orig_bytes"), F.col("chars"))[1], 9)
    return report.by_type(docs).join(sizes, "file_type").select("file_type", "files", "exts", "orig_bytes", "chars", ratio.alias("ratio"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def ordered_text(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(scalars.ordered_join(F.col("turn"), F.col("text"), "\n").alias("text"))


# ---- comments, SVG ----


@query(f"SELECT page_id, md5(s) AS text_md5, length(s)::INT AS n_chars FROM (SELECT page_id, regexp_replace(regexp_replace(html, {lit(re2(tokens.BLOCK_COMMENT))}, '', 'g'), {lit(re2(tokens.LINE_COMMENT))}, '', 'g') AS s FROM pages)")
def comment_strip(spark, sf_dir):
    text = F.regexp_replace(F.regexp_replace("html", tokens.BLOCK_COMMENT, ""), tokens.LINE_COMMENT, "")
    return read(spark, sf_dir, "pages").select("page_id", text.alias("s")).select("page_id", F.md5("s").alias("text_md5"), F.length("s").alias("n_chars"))


@query(f"SELECT page_id, md5(s) AS text_md5, length(s)::INT AS n_chars FROM (SELECT page_id, regexp_replace(html, {lit(re2(tokens.STRING_OR_COMMENT))}, '\\1', 'g') AS s FROM pages)")
def one_pass_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tokens.strip_comments(F.col("html")).alias("s")).select("page_id", F.md5("s").alias("text_md5"), F.length("s").alias("n_chars"))


def _svg_sql(text: str) -> str:
    for pattern in svg._DROPPED:
        text = f"regexp_replace({text}, {lit(pattern)}, '', 'g')"
    for old, new in svg._LITERAL:
        text = f"replace({text}, {lit(old)}, {lit(new)})"
    for pattern, new in [*svg._REDUNDANT, *svg._BLANKS]:
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(new.replace('$1', chr(92) + '1'))}, 'g')"
    return text


@query(f"SELECT page_id, md5(s) AS text_md5, length(s)::INT AS n_chars FROM (SELECT page_id, {_svg_sql('html')} AS s FROM pages)")
def svg_rewrite_regex(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", svg.rewrite_plain(F.col("html")).alias("s")).select("page_id", F.md5("s").alias("text_md5"), F.length("s").alias("n_chars"))


#: Line items as SVG. Prices end in a quarter, so halves are exact and rounding them goes to the even side.
@query("""WITH q AS (SELECT l_orderkey, l_linenumber, (floor(l_extendedprice)::BIGINT % 10000) * 4 + l_linenumber % 4 AS quarters FROM lineitem),
t AS (SELECT *, quarters // 4 * 10 + CASE quarters % 4 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 8 ELSE 0 END AS tenths FROM q)
SELECT l_orderkey, l_linenumber, '<?xml version="1.0"?><path d="M' || (tenths // 10) || CASE WHEN tenths % 10 = 0 THEN '' ELSE '.' || (tenths % 10) END || ' 0"/>' AS svg FROM t""")
def svg_round_numbers(spark, sf_dir):
    """Numbers of SVG text at one decimal; the declaration's version stays."""
    quarters = (F.col("l_extendedprice").cast("long") % 10000) * 4 + F.col("l_linenumber") % 4
    number = F.format_string("%d.%02d", F.floor(quarters / 4), quarters % 4 * 25)
    text = F.concat(F.lit('<?xml version="1.0"?><path d="M'), number, F.lit(' 0"/>'))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", svg.rounded(text).alias("svg"))


# ---- spaces between tokens ----


def _in(col: str, values) -> str:
    return f"{col} IN ({', '.join(map(lit, values))})"


def _respace_sql(source: str, rules: list[tuple[str, str]]) -> str:
    case = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + " ELSE false END"
    return f"""WITH {token_sql(source)}, w AS (
  SELECT *, lag(ttype) OVER q AS pt, lag(tstr) OVER q AS ps FROM tok WINDOW q AS (PARTITION BY file_ord, line_no ORDER BY tok_no)
), s AS (SELECT *, CASE WHEN {case} THEN ' ' ELSE '' END || tstr AS piece FROM w),
l AS (SELECT file_ord, line_no, repeat(' ', any_value(indent)) || string_agg(piece, '' ORDER BY tok_no) || chr(10) AS line FROM s GROUP BY ALL)
SELECT file_ord, string_agg(line, '' ORDER BY line_no) AS text FROM l GROUP BY file_ord"""


_R = respace
_here = lambda xs: f"(ttype = 'OP' AND {_in('tstr', xs)})"
_prev = lambda xs: f"(pt = 'OP' AND {_in('ps', xs)})"
_WORDS, _CLOSE = _in("ttype", _R.WORDS), _R.CLOSING
_SPACED = f"(pt = 'NAME' AND {_in('ps', _R.SPACED_WORDS)})"
PYTHON_SQL = [
    ("pt IS NULL", "false"),
    (f"{_prev(_CLOSE)} AND {_WORDS}", "true"),
    (f"{_prev([':'])} AND NOT {_here([*_CLOSE, ','])}", "true"),
    (f"{_prev([','])} AND NOT {_here(_CLOSE)}", "true"),
    (f"{_here(_R.PY_COMPARE)} OR {_prev(_R.PY_COMPARE)} OR {_here(_R.PY_ASSIGN)} OR {_prev(_R.PY_ASSIGN)}", "true"),
    (f"pt = 'NAME' AND {_in('ps', sorted(lexicon.KEYWORDS['python']))} AND ttype <> 'OP'", "true"),
    (f"{_in('pt', _R.WORDS)} AND {_WORDS}", "true"),
]
GENERIC_SQL = [
    ("pt IS NULL", "false"),
    (f"{_here(['<', '>'])} AND (contains(ps, 'include') OR contains(ps, 'pragma'))", "false"),
    (f"{_here(['>'])} AND pt = 'NAME'", "false"),
    (f"ttype = 'NAME' AND {_prev(['#'])}", "false"),
    (_here(["@"]), "true"),
    (f"{_here(['('])} AND pt = 'NAME' AND NOT {_SPACED}", "false"),
    (f"{_here(['(', '.'])} AND {_prev([')', ']'])}", "false"),
    (f"{_here(['.', '::'])} OR {_prev(['.', '::'])}", "false"),
    (f"{_prev(_CLOSE)} AND {_WORDS}", "true"),
    (_prev([";"]), "true"),
    (_prev([":"]), f"NOT {_here([*_CLOSE, ','])}"),
    (_prev([","]), f"NOT {_here(_CLOSE)}"),
    (_prev(_R.BINARY), f"NOT {_here(['.', '::', *_CLOSE, ',', ';', ':'])}"),
    (_here(_R.BINARY), f"NOT {_prev(['.', '::', '(', '[', '{', '@'])}"),
    (f"{_SPACED} AND {_here(['('])}", "false"),
    (f"{_SPACED} AND {_here(['{'])}", _in("ps", _R.BRACE_WORDS)),
    (f"{_SPACED} AND NOT {_here(_R.NOT_AFTER_WORD)}", "true"),
    (f"{_in('pt', _R.WORDS)} AND {_WORDS}", "true"),
]


@query(_respace_sql(BENCH, PYTHON_SQL))
def respace_python(spark, sf_dir):
    source = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file_ord"), "text")
    return respace.texts(tokens.tokens(source), respace.python_space())


@query(_respace_sql(CONVS, GENERIC_SQL))
def respace_generic(spark, sf_dir):
    return respace.texts(tokens.tokens(conversations(spark, sf_dir)), respace.generic_space())


@query(_respace_sql(PAGES, GENERIC_SQL))
def respace_markup(spark, sf_dir):
    source = read(spark, sf_dir, "pages").select(F.col("page_id").alias("file_ord"), F.col("html").alias("text"))
    return respace.texts(tokens.tokens(source), respace.generic_space())


# ---- runs, colours ----

#: Events as an image: a user's row of the hours of a day by type of event.
LABELS_SQL = """
lab AS (SELECT DISTINCT 'all' AS img, user_id::INT AS y, (event_id % 512)::INT AS x, (length(event_type) % 8)::INT AS ci FROM events),
rn AS (SELECT img, ci, y, min(x) AS start_x, count(*)::INT AS length FROM (SELECT *, x - row_number() OVER (PARTITION BY img, ci, y ORDER BY x) AS isl FROM lab) GROUP BY img, ci, y, isl),
rw AS (SELECT img, ci, y, count(*)::INT AS n_runs FROM rn GROUP BY ALL),
dl AS (SELECT *, (y - lag(y, 1, -1) OVER (PARTITION BY img, ci ORDER BY y))::INT AS delta FROM rw)"""


def labels(spark, sf_dir) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.select(F.lit("all").alias("img"), F.col("user_id").cast("int").alias("y"), (F.col("event_id") % 512).cast("int").alias("x"), (F.length("event_type") % 8).alias("ci")).distinct()


@query("""SELECT event_type, min(event_id) AS start_id, count(*) AS length
FROM (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS isl FROM events) GROUP BY event_type, isl""")
def event_runs(spark, sf_dir):
    """Maximal stretches of events of one type: runs inside stretches of ids, of which those that touch a border are joined."""
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("img"), F.lit(0).alias("ci"), F.floor(F.col("event_id") / ranks.BUCKET).alias("y"), F.col("event_id").alias("x"))
    part = image.runs(events).select(F.col("img").alias("event_type"), "y", F.col("start_x").alias("a"), F.col("length").cast("long").alias("n"))
    at_border = (F.col("a") == F.col("y") * ranks.BUCKET) | (F.col("a") + F.col("n") == (F.col("y") + 1) * ranks.BUCKET)
    # At most two runs of a type in each stretch touch its borders; the window sees no others.
    order = Window.partitionBy("event_type").orderBy("a")
    border = part.where(at_border).withColumn("new", (F.col("a") != F.lag(F.col("a") + F.col("n"), 1, -1).over(order)).cast("int"))
    joined = border.withColumn("run", F.sum("new").over(order)).groupBy("event_type", "run").agg(F.min("a").alias("start_id"), F.sum("n").alias("length"))
    inner = part.where(~at_border).select("event_type", F.col("a").alias("start_id"), F.col("n").alias("length"))
    return inner.unionByName(joined.select("event_type", "start_id", "length"))


@query(f"WITH {LABELS_SQL} SELECT img, ci, y, start_x, length FROM rn")
def color_runs(spark, sf_dir):
    return image.runs(labels(spark, sf_dir)).select("img", "ci", "y", "start_x", "length")


@query(f"WITH {LABELS_SQL} SELECT img, ci, count(*) AS n_rows, sum(n_runs)::BIGINT AS n_runs, min(y) AS first_y, max(y) AS last_y FROM rw GROUP BY img, ci")
def color_rows(spark, sf_dir):
    """How many rows and runs each colour has."""
    rows = image.row_deltas(image.runs(labels(spark, sf_dir)))
    return rows.groupBy("img", "ci").agg(F.count("*").alias("n_rows"), F.sum("n_runs").alias("n_runs"), F.min("y").alias("first_y"), F.max("y").alias("last_y"))


@query(f"WITH {LABELS_SQL} SELECT img, ci, y, n_runs, delta, CASE WHEN delta < 128 THEN {HEX.format('delta', 2)} ELSE {HEX.format('delta + 32768', 4)} END AS delta_hex FROM dl")
def delta_rows(spark, sf_dir):
    return image.row_deltas(image.runs(labels(spark, sf_dir))).withColumn("delta_hex", image.hex_delta(F.col("delta")))


@query(f"WITH {LABELS_SQL} SELECT img, ci, y, delta FROM dl")
def delta_restore(spark, sf_dir):
    """Rows from their steps; the SQL has the rows themselves."""
    deltas = image.row_deltas(image.runs(labels(spark, sf_dir)))
    numbered = deltas.withColumn("nth", F.row_number().over(Window.partitionBy("img", "ci").orderBy("y"))).drop("y")
    return image.restore_rows(numbered).select("img", "ci", "y", "delta")


_LE = "{h}".replace("{h}", "lpad(upper(to_base({0} % 256, 16)), 2, '0') || lpad(upper(to_base({0} // 256, 16)), 2, '0')")


@query(f"""WITH {LABELS_SQL}, rb AS (
  SELECT r.img, r.ci, r.y, any_value(CASE WHEN delta < 128 THEN {HEX.format('delta', 2)} ELSE {HEX.format('delta + 32768', 4)} END) || {HEX.format('any_value(n_runs)', 2)} ||
    string_agg({_LE.format('start_x')} || CASE WHEN length < 255 THEN {HEX.format('length', 2)} ELSE 'FF' || {_LE.format('length')} END, '' ORDER BY start_x) AS body
  FROM rn r JOIN dl d ON d.img = r.img AND d.ci = r.ci AND d.y = r.y GROUP BY ALL
), cb AS (SELECT ci, {_LE.format('count(*)')} || string_agg(body, '' ORDER BY y) AS body FROM rb GROUP BY ci), k AS (SELECT range::INT AS ci FROM range(8))
SELECT 'all' AS img, md5('00020000' || 'FFFF0000' || '08' || string_agg({HEX.format('k.ci', 2)} || '0000', '' ORDER BY k.ci) || string_agg(coalesce(body, '0000'), '' ORDER BY k.ci)) AS stream_md5
FROM k LEFT JOIN cb ON cb.ci = k.ci""")
def run_bytes(spark, sf_dir):
    """The image stream of the event image: size, palette, runs."""
    palette = spark.range(8).select(F.lit("all").alias("img"), F.col("id").cast("int").alias("ci"), F.col("id").alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    sizes = spark.createDataFrame([("all", 512, 65535)], "img string, width int, height int")
    return image.stream_hex(image.runs(labels(spark, sf_dir)), palette, sizes).select("img", F.md5("stream_hex").alias("stream_md5"))


@query(f"WITH {LABELS_SQL} SELECT img, ci, y, x FROM lab WHERE x < 500")
def runs_expand(spark, sf_dir):
    """Pixels from runs, cut off at a width of 500; the SQL has the labels."""
    sizes = spark.createDataFrame([("all", 500)], "img string, width int")
    return image.expand(image.runs(labels(spark, sf_dir)), sizes).select("img", "ci", "y", "x")


@query("SELECT l_returnflag, count(DISTINCT (l_quantity::INT, (l_tax * 100)::INT, l_linenumber)) AS colors FROM lineitem GROUP BY l_returnflag")
def distinct_colors(spark, sf_dir):
    rgb = [F.round("l_quantity").cast("int"), F.round(F.col("l_tax") * 100).cast("int"), F.col("l_linenumber")]
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct(*rgb).alias("colors"))


@query("""WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings),
e AS (SELECT label, avg(pow(x * 255 - floor(greatest(0, least(255, x * 255))), 2)) AS mse FROM v GROUP BY label)
SELECT label, round(mse, 6) AS mse, round(10 * log10(65025 / mse), 6) AS psnr FROM e""")
def psnr(spark, sf_dir):
    """Embeddings as colours, against themselves clipped and truncated."""
    v = read(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double") * 255)
    kept = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("x")))).cast("double")
    mse = v.groupBy("label").agg(F.avg(F.pow(F.col("x") - kept, 2)).alias("mse"))
    return mse.select("label", F.round("mse", 6).alias("mse"), F.round(scalars.psnr(F.col("mse")), 6).alias("psnr"))


@query()
def kmeans_quantize(spark, sf_dir):
    """Quantity, tax and line number of all line items as colours, quantized to 16."""
    rgb = [F.round(F.col("l_quantity") * 5).cast("int").alias("r"), F.round(F.col("l_tax") * 2550).cast("int").alias("g"), (F.col("l_linenumber") * 36).alias("b")]
    labelled, palette = image.quantize(read(spark, sf_dir, "lineitem").select(*rgb), ["r", "g", "b"])
    sizes = labelled.groupBy("ci").agg(F.count("*").alias("pixels"))
    return sizes.join(F.broadcast(palette), "ci").crossJoin(F.broadcast(image.quality(labelled, palette, ["r", "g", "b"])))


@query()
def lzma_size(spark, sf_dir):
    """Each document's size as an xz stream, and whether it comes back whole."""

    @F.pandas_udf("struct<packed:long,whole:boolean>")
    def packed(text: pd.Series) -> pd.DataFrame:
        out = []
        for raw in map(str.encode, text):
            p = xz.compress(raw)
            out.append((len(p), lzma.decompress(p) == raw))
        return pd.DataFrame(out, columns=["packed", "whole"])

    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.octet_length("text").alias("n_bytes"), packed("text").alias("p")).select("doc_id", "n_bytes", "p.*")
