import bz2
import gzip
import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from tekstra.operators import tokens
from tekstra.sources import readers, sinks, training
from tekstra.streaming import clean


def test_json_lines_round_trip(spark, tmp_path):
    rows = [("s", "1", "t", "naïve 日本", "en"), ("s", "2", None, None, "tl")]
    path = str(tmp_path / "d")
    assert sinks.write_json_lines(spark.createDataFrame(rows, readers.DOCUMENT), path) == 2
    assert sorted(map(tuple, readers.json_lines(spark, path).collect())) == rows
    assert "naïve 日本" in "".join(p.read_text() for p in (tmp_path / "d").glob("*.json"))
    assert {r.text for r in readers.texts_of(readers.json_lines(spark, path)).collect()} == {"naïve 日本", ""}
    (tmp_path / "bad.jsonl").write_text('{"source": "s"}\n\n{"source": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl")).collect()


def test_wiki_dump(spark, tmp_path):
    page = lambda title, ns, text, more="": f"<page><title>{title}</title><ns>{ns}</ns><id>7</id>{more}<revision><text>old</text></revision><revision><text xml:space='preserve'>{text}</text></revision></page>"
    body = "The '''river''' runs to the [[sea|great sea]] &amp;amp; back again, every day of the year."
    xml = "<mediawiki xmlns='http://www.mediawiki.org/xml/export-0.10/'>" + page("River", 0, body) + page("Talk:River", 1, body) + page("Old", 0, body, "<redirect title='River'/>") + page("File:x", 0, body) + page("Stub", 0, "short") + "</mediawiki>"
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    rows = readers.wiki_dump(spark, str(tmp_path / "d.xml.bz2"), "enwiki", "en").collect()
    assert [(r.title, r.source) for r in rows] == [("River", "enwiki")] and "the great sea & back" in rows[0].text.replace("runs to ", "")


def test_books_and_catalog(spark, tmp_path):
    text = 'Text#,Type,Title,Language\n1,Text,"A\nB",en\n2,Sound,x,en\n3,Text,y,fr\n4,Text,z,"fr, en"\nx,Text,q,en\n'
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(text.encode()))
    assert [tuple(r) for r in readers.book_catalog(spark, str(tmp_path / "c.csv.gz")).collect()] == [(1, "A B"), (4, "z")]
    (tmp_path / "b").mkdir()
    for name, n in (("10", 12_000), ("11", 50), ("12", 12_000)):
        (tmp_path / "b" / f"{name}.txt").write_text("*** START OF THIS PROJECT GUTENBERG EBOOK ***\n" + "x " * (n // 2) + "y")
    assert [r.doc_id for r in readers.books(spark, str(tmp_path / "b"), 1).collect()] == ["10"]
    assert readers.capped(spark, str(tmp_path / "b")) and pytest.raises(ValueError, readers.capped, spark, str(tmp_path / "b"), 10)


def test_token_binaries(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("o"), F.array_repeat((F.col("id") + 60_000).cast("int"), 3).alias("ids"))
    want = [60_000 + i for i in range(40) for _ in range(3)]
    parts = sinks.write_token_binary(rows, str(tmp_path / "t"), "o", files=3)
    assert parts.agg(F.sum("tokens")).first()[0] == 120
    digest = sinks.join_parts(spark, str(tmp_path / "t"), str(tmp_path / "all.bin"))
    content = (tmp_path / "all.bin").read_bytes()
    assert content == struct.pack("<120H", *want) and digest == hashlib.sha256(content).hexdigest()
    assert readers.checked_binary(spark, str(tmp_path / "all.bin"), 120) == 120
    assert [r.token for r in readers.token_binary(spark, str(tmp_path / "all.bin"), 0.5, 1.0).orderBy("pos").collect()] == want[60:]
    (tmp_path / "odd.bin").write_bytes(b"abc")
    for path, n in (("odd.bin", None), ("all.bin", 7)):
        with pytest.raises(ValueError):
            readers.checked_binary(spark, str(tmp_path / path), n)


def test_hashes_corpus_text_and_records(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for n in "ab":
        (tmp_path / "f" / n).write_text(n * 10)
    assert {r.sha256 for r in sinks.file_hashes(spark, str(tmp_path / "f")).collect()} == {hashlib.sha256((n * 10).encode()).hexdigest() for n in "ab"}
    assert sinks.hash_of_all(spark, str(tmp_path / "f")) == hashlib.sha256(b"a" * 10 + b"b" * 10).hexdigest()
    docs = spark.createDataFrame([(2, "two", "tl"), (1, "one", "en"), (0, "zero", "tl"), (3, "x", "fr")], "i long, text string, lang string")
    assert sinks.write_corpus_text(docs, str(tmp_path / "c"), "i", ["en", "tl"]) == (3, 16)
    assert "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part*"))) == "one\n\nzero\n\ntwo\n\n"
    record = {f.split()[0]: "x" for f in readers.SOURCE_RECORD.split(", ")} | {"raw_size_bytes": 3, "title": "", "source_name": "n", "source_url": "u"}
    (tmp_path / "m.jsonl").write_text(json.dumps(record) + "\n" + json.dumps(record | {"source_url": "v"}) + "\n")
    found = readers.records(spark, str(tmp_path / "m.jsonl"))
    assert readers.records(spark, str(tmp_path / "none")).count() == 0 and found.count() == 2
    assert sinks.first_records(found, "source_url").first().source_url == "u"
    assert "| n | x | x | x | x | x |" in sinks.sources_page(found, "source_url") and "- n: v" in sinks.sources_page(found, "source_url")
    assert readers.unknown_records(found, found).count() == 0


def test_token_rows_are_bounded_and_the_corpus_text_has_a_hash(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PART_BYTES", 20)
    monkeypatch.setattr(sinks, "RANGE_BYTES", 100)
    rows = spark.range(40).select(F.col("id").alias("o"), F.transform(F.sequence(F.lit(0), (F.col("id") % 4).cast("int")), lambda k: (F.col("id") + k).cast("int")).alias("ids"))
    parts = sinks.write_token_binary(rows, str(tmp_path / "t"), "o").collect()
    assert max(r.tokens for r in parts) < 14 and len(parts) > 8
    sinks.join_parts(spark, str(tmp_path / "t"), str(tmp_path / "all.bin"))
    assert (tmp_path / "all.bin").read_bytes() == b"".join(struct.pack("<H", i + k) for i in range(40) for k in range(i % 4 + 1))
    docs = spark.createDataFrame([(2, "two", "tl"), (1, "óne", "en")], "i long, text string, lang string")
    sinks.write_corpus_text(docs, str(tmp_path / "c"), "i", ["en", "tl"])
    assert sinks.corpus_text_hash(spark, str(tmp_path / "c")) == hashlib.sha256("óne\n\ntwo\n\n".encode()).hexdigest()
    (tmp_path / "u" / "v").mkdir(parents=True)
    (tmp_path / "u" / "a").write_bytes(b"abc")
    (tmp_path / "u" / "v" / "b").write_bytes(b"de")
    assert [tuple(r)[1:] for r in sinks.disk_usage(spark, str(tmp_path / "u"), str(tmp_path / "c")).collect()] == [(2, 5), (len(list((tmp_path / "c").glob("part*"))), 11)]


def test_chat_sources(spark, tmp_path):
    from tekstra.sources import chat_sources as c

    write = lambda name, rows: (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows)) and str(tmp_path / name)
    path = write("aya.jsonl", [{"language_code": " ENG", "annotation_type": "original-annotations", "inputs": "a", "targets": "b"}, {"language_code": "fra", "annotation_type": "original-annotations"}, {"language_code": "fil", "annotation_type": "Re-annotations", "inputs": "x"}])
    rows = c.aya(c.scan(spark, path, c.AYA)).collect()
    assert [r.reason for r in rows] == ["", "other_language", "re-annotations"] and rows[0].id == "aya-eng-" + hashlib.sha256(b"eng|a|b").hexdigest()[:24]
    labels = [["spam"], {"toxicity": {"value": 1}}, {"quality": {"spam": 1}}, 0, None, ["humor"]]
    path = write("m.jsonl", [{"message_id": str(i), "role": "prompter", "lang": "en", "text": "t", "labels": x, "rank": i} for i, x in enumerate(labels)])
    assert [(r.reason, r.split) for r in c.messages(c.scan(spark, path, c.MESSAGES), "train").collect()] == [("labels", "train"), ("labels", "train")] + [("", "train")] * 4
    path = write("d.jsonl", [{"instruction": "\n do\u00a0", "context": None, "response": " r"}, {"instruction": " \n", "response": "r"}])
    assert [(r.reason, r.instruction, r.context, r.category) for r in c.dolly(c.scan(spark, path, c.DOLLY)).collect()] == [("", "do", "", ""), ("empty_instruction", "", "", "")]
    u = lambda *x: [{"index": i, "speaker": who, "text": t} for i, (who, t) in enumerate(x)]
    (tmp_path / "tm.json").write_text(json.dumps([{"conversation_id": "self-1", "utterances": u(("USER ", " hi "), ("robot", "x"), ("assistant", "yes"))}, {"conversation_id": "self-1", "utterances": u(("user", "second"))}, {"conversation_id": "w2", "domain": "d", "utterances": u(("user", "only"))}, {"conversation_id": "w3", "utterances": []}]))
    for name, ids in (("train", ["self-1", "w2"]), ("dev", ["w2"]), ("test", [])):
        (tmp_path / "lists").mkdir(exist_ok=True)
        (tmp_path / "lists" / f"{name}.csv").write_text("\n".join(["id,x", *(f"{i} ,1" for i in ids)]))
    rows = {r.id: r for r in c.dialogs(c.scan(spark, str(tmp_path / "tm.json"), c.DIALOGS, array=True), c.split_lists(spark, str(tmp_path / "lists"))).collect()}
    assert [(rows[k].reason, rows[k].split, rows[k].file, rows[k].domain) for k in ("self-1", "w2")] == [("", "train", "self", ""), ("no_assistant", "val", "woz", "d")] and rows["w3"].reason == "no_utterances"
    assert [tuple(x)[1:] for x in rows["self-1"].utterances] == [("user", "hi"), ("assistant", "yes")]


def test_shared_folder_is_never_one_machine_s_own_on_a_cluster():
    from types import SimpleNamespace

    from tekstra.sources import shared

    conf = SimpleNamespace(get=lambda *a: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared.shared(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master=master)))


def test_spread_moves_small_tables_alone(spark, tmp_path):
    from tekstra.sources.spread import spread

    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "small"))
    assert spread(spark.read.parquet(str(tmp_path / "small"))).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
        assert "Repartition" not in spread(spark.read.parquet(str(tmp_path / "small")))._jdf.queryExecution().logical().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_dialog_splits(spark):
    d = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    lists = spark.createDataFrame([("a", "train"), ("a", "dev"), ("b", "train")], "id string, list string")
    got = {r.id: r.split for r in readers.dialog_splits(d, lists).collect()}
    assert (got["a"], got["b"]) == ("val", "train") and got["c"] in ("train", "val")
    assert [r.v for r in readers.first_of_id(spark.createDataFrame([(1, 2), (1, 1)], "k int, v int"), "k", "v").collect()] == [1]


def test_pieces(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the river number {i} runs to the sea\nand back to hill {i * 7}") for i in range(80)], "i long, text string")
    model = training.train_pieces(docs, "i", vocabulary=120)
    (tmp_path / "m.model").write_bytes(model)
    rows = docs.select(tokens.piece_ids(str(tmp_path / "m.model"))("text").alias("ids")).collect()
    assert all(r.ids and max(r.ids) < 120 for r in rows)


def test_stream(spark, tmp_path):
    good = "".join(f"This is an ordinary sentence about the river, number {i}.\n" for i in range(20))
    rows = spark.createDataFrame([(1, good, "2024-01-01 00:00:00"), (2, "short", "2024-01-01 00:00:01"), (3, good, "2024-01-01 00:00:02")], "i long, text string, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = clean.unseen(clean.cleaned_stream(stream), "at").writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cleaned").count() == 1
