"""Queries of sources, sinks and markup: tables are written in a form, read back and compared with what SQL says of the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..operators import langid
from ..sources import chat_sources, readers, sinks
from ..sources.shared import new_path
from ..sources.spread import table
from .registry import CHARS_SQL, documents, encode, query


@query("s1_k1_json_lines", "SELECT doc_id::VARCHAR AS doc_id, source, lang, md5(text) AS text_md5 FROM documents")
def s1(spark, sf_dir):
    path = new_path(spark)
    rows = documents(spark, sf_dir).select("source", F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("title"), "text", "lang")
    sinks.write_json_lines(rows, path)
    back = readers.json_lines(spark, path)
    return back.select("doc_id", "source", "lang", F.md5("text").alias("text_md5"))


@query("k2_k3_partitioned_appends", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT lang, text FROM documents UNION ALL SELECT lang, text FROM documents) GROUP BY lang")
def k2(spark, sf_dir):
    path, rows = new_path(spark), documents(spark, sf_dir).select("doc_id", "lang", "text")
    n = sinks.write_json_lines(rows, path, "lang")
    n += sinks.write_json_lines(rows, path, "lang", mode="append")
    back = spark.read.schema("doc_id long, text string, lang string").json(path)
    return back.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("s3_s13_a4_records", "SELECT source || '-' || lang AS source_name, min(doc_id)::VARCHAR AS source_url, count(*) AS n FROM documents GROUP BY ALL")
def s13(spark, sf_dir):
    path = new_path(spark)
    fields = [f.split()[0] for f in readers.SOURCE_RECORD.split(", ")]
    known = {"source_name": F.concat("source", F.lit("-"), "lang"), "source_url": F.col("doc_id").cast("string"), "raw_size_bytes": F.col("doc_id"), "language": F.col("lang")}
    sinks.write_json_lines(documents(spark, sf_dir).select(*(known.get(f, F.lit("")).alias(f) for f in fields)), path)
    rows = readers.records(spark, path)
    firsts = sinks.first_records(rows.withColumn("ord", F.col("raw_size_bytes")), "ord").select("source_name", "source_url")
    return firsts.join(rows.groupBy("source_name").agg(F.count("*").alias("n")), "source_name")


def _plain_prose_sql(x: str) -> str:
    """N8 where there is no balanced markup and no character reference; the patterns in their order."""
    steps = [*((p, "") for p in markup.WIKITEXT_REMOVED), (markup.WIKITEXT_NOWIKI, "\\1"), (markup.WIKITEXT_TAG, ""), (markup.WIKITEXT_SPACE_LINK, ""), (r"\[\[[^\]|]+\|([^\]]*)\]\]", "\\1"), (markup.WIKITEXT_LINK, "\\1"), (markup.WIKITEXT_LABELLED_URL, "\\1"), (markup.WIKITEXT_BRACKETED_URL, ""), (markup.WIKITEXT_URL, ""), ("(?m)" + markup.WIKITEXT_HEADING, "\\1"), ("(?m)" + markup.WIKITEXT_LIST_MARK, ""), ("(?m)" + markup.WIKITEXT_TABLE_LINE, "")]
    for pattern, by in steps:
        x = "regexp_replace({}, '{}', '{}', 'g')".format(x, pattern.replace("'", "''"), by)
    return f"array_to_string(list_filter(list_transform(string_split_regex({x}, '\\r\\n|[\\n\\r]'), lambda l: trim(regexp_replace(l, '[ \\t]+', ' ', 'g'))), lambda l: l <> ''), chr(10))"


MARKED = ("<!-- c -->[[", "|the ", "]] <ref name=a>r</ref><ref b/>[http://a.b label] [http://c.d] https://e.f\n== Head ==\n* item <nowiki>k</nowiki> [[File:q.jpg|thumb]]\n")
BALANCED = "{{Infobox|a={{b}}}}{|\n|t\n{| x |}|}"


@query("n8_wikitext_prose", f"SELECT doc_id, md5({_plain_prose_sql('chr(65) || {0} || lang || {1} || source || {2} || text'.format(*(repr(m).replace(chr(92) + 'n', chr(39) + ' || chr(10) || ' + chr(39)) for m in MARKED))).replace('chr(65) || ', '')}) AS text_md5 FROM documents")
def n8(spark, sf_dir):
    a, b, c = map(F.lit, MARKED)
    marked = F.concat(a, "lang", b, "source", F.lit(BALANCED), c, "text")
    return documents(spark, sf_dir).select("doc_id", F.md5(markup.prose_of_wikitext(marked)).alias("text_md5"))


@query("n6_n7_tables", "SELECT doc_id, md5('{| open ' || text || lang) AS text_md5 FROM documents")
def n7(spark, sf_dir):
    marked = F.concat(F.lit("{| open "), "text", F.lit("{| a {| "), "source", F.lit(" |} b |}"), "lang")
    return documents(spark, sf_dir).select("doc_id", F.md5(markup.without_tables(marked)).alias("text_md5"))


@query("n9_book_body", "SELECT doc_id, md5(regexp_replace(replace(text, '_', ''), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM documents")
def n9(spark, sf_dir):
    mark = lambda x: F.lit(f"\n*** {x} OF THIS PROJECT GUTENBERG EBOOK A BOOK ***\n")
    new = F.concat(F.lit("a head\n***\n"), mark("START"), "text", mark("END"), F.lit("the license"))
    old = F.concat(F.lit("a preamble\n***\nmore\n ****\n"), "text", F.lit("\nEnd of the Project Gutenberg Etext of a book"))
    return documents(spark, sf_dir).select("doc_id", F.md5(markup.body_of_book(F.when(F.col("lang") == "en", old).otherwise(new))).alias("text_md5"))


@query("s8_decode", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def s8(spark, sf_dir):
    """Texts of two languages as Latin-1 bytes, which Windows-1252 reads alike; the others as UTF-8."""
    data = F.when(F.col("lang").isin("fr", "de"), F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return documents(spark, sf_dir).select("doc_id", F.md5(markup.text_of_bytes(data)).alias("text_md5"))


@query("s4_wiki_dump", "SELECT 'Page ' || doc_id AS title, doc_id::VARCHAR AS doc_id, lang FROM documents WHERE doc_id % 7 <> 0 AND lang <> 'de' AND length(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '(?m)^=+\\s*(.*?)\\s*=+\\s*$', '\\1', 'g'), '(?m)^[*#;:]+', '', 'g'), chr(10)), lambda l: trim(regexp_replace(l, '[ \\t]+', ' ', 'g'))), lambda l: l <> ''), chr(10))) >= 50")
def s4(spark, sf_dir):
    """Documents as pages of a dump: every seventh is a template, those of one language stand in another namespace."""
    path = new_path(spark)
    title = F.concat(F.when(F.col("doc_id") % 7 == 0, "Template:").otherwise("Page "), F.col("doc_id").cast("string"))
    revision = F.struct(F.struct(F.col("text").alias("_VALUE"), F.lit("preserve").alias("_space")).alias("text"))
    pages = documents(spark, sf_dir).select(title.alias("title"), F.when(F.col("lang") == "de", "1").otherwise("0").alias("ns"), F.col("doc_id").cast("string").alias("id"), revision.alias("revision"), "lang")
    pages.write.partitionBy("lang").format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    rows = [readers.wiki_dump(spark, f"{path}/lang={r.lang}", "wiki", r.lang) for r in pages.select("lang").distinct().orderBy("lang").collect()]  # one a language
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.select("title", "doc_id", "lang")


@query("p12_training_rows", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn, n FROM documents JOIN (SELECT lang, count(DISTINCT source) AS n FROM documents GROUP BY lang) USING (lang)) WHERE rn <= 40 // n")
def p12(spark, sf_dir):
    return langid.training_rows(documents(spark, sf_dir), "doc_id", "lang", 40, "source").select("doc_id")


@query("k4_k7_a3_corpus_text", "SELECT count(*) AS docs, sum(length(text) + 2)::BIGINT AS chars, sha256(string_agg(text || chr(10) || chr(10), '' ORDER BY CASE lang WHEN 'en' THEN 0 ELSE 1 END, doc_id)) AS sha256, sum(octet_length(encode(text)) + 2)::BIGINT AS bytes FROM documents WHERE lang IN ('en', 'fr')")
def k4(spark, sf_dir):
    path = new_path(spark)
    n, chars = sinks.write_corpus_text(documents(spark, sf_dir), path, "doc_id", ["en", "fr"])
    size = sinks.disk_usage(spark, path).select("bytes")
    return size.select(F.lit(n).cast("long").alias("docs"), F.lit(chars).cast("long").alias("chars"), F.lit(sinks.corpus_text_hash(spark, path)).alias("sha256"), "bytes")


@query("k5_s11_s12_token_binary", f"SELECT row_number() OVER (ORDER BY conv_id, turn, k) - 1 AS pos, token::INT AS token FROM (SELECT conv_id, turn, unnest(i) AS token, generate_subscripts(i, 1) AS k FROM (SELECT conv_id, turn, {CHARS_SQL.format('text')} AS i FROM conversations WHERE text <> ''))")
def k5(spark, sf_dir):
    path = new_path(spark)
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("o"), encode(F.col("text")).alias("ids"))
    sinks.write_token_binary(rows, path, "o")
    file = f"{new_path(spark)}.bin"
    sinks.join_parts(spark, path, file.removeprefix("file:"))
    readers.checked_binary(spark, file, rows.agg(F.sum(F.size("ids"))).first()[0])
    return readers.token_binary(spark, file).select("pos", "token")


@query("s10_chat_files", "SELECT conv_id, turn, upper(role) AS speaker, md5(text) AS text_md5 FROM conversations")
def s10(spark, sf_dir):
    """Dialogs as JSON, read by their schema; utterances exploded again."""
    path = new_path(spark)
    u = F.sort_array(F.collect_list(F.struct(F.col("turn").alias("index"), F.upper("role").alias("speaker"), "text")))
    sinks.write_json_lines(table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("conversation_id")).agg(u.alias("utterances")), path)
    rows = chat_sources.scan(spark, path, chat_sources.DIALOGS).select("conversation_id", F.explode("utterances").alias("u"))
    return rows.select(F.col("conversation_id").cast("long").alias("conv_id"), F.col("u.index").alias("turn"), F.col("u.speaker").alias("speaker"), F.md5("u.text").alias("text_md5"))
