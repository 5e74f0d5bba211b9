"""Loaders, pages and event streams on literal files."""

import io
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from ragweave.sources import files, web
from ragweave.streaming import events

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
    return out.getvalue()


def test_office_files():
    docx = archive(
        word__document=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
        word__header1=f"<w:hdr {W}><w:p><w:r><w:t>Top</w:t></w:r></w:p></w:hdr>",
        word__footer1=f"<w:ftr {W}><w:p><w:r><w:t>End</w:t></w:r></w:p></w:ftr>",
    )
    assert files.load_docx(docx).split("\n") == ["Top", "# Title", "Body", "a | b", "End"]
    shape = lambda y, t: f'<p:sp><a:off x="1" y="{y}"/><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp>'
    pptx = archive(ppt__slides__slide1=f"<p:sld {A}>{shape(9, 'low')}{shape(2, 'high')}</p:sld>", ppt__slides__slide10=f"<p:sld {A}>{shape(1, 'ten')}</p:sld>", ppt__slides__slide2=f"<p:sld {A}>{shape(1, 'two')}</p:sld>")
    assert files.load_pptx(pptx).split("\n") == ["--- Slide 1 ---", "high", "low", "--- Slide 2 ---", "two", "--- Slide 3 ---", "ten"]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    xlsx = archive(xl__sharedStrings=f"<sst {s}><si><t>name</t></si></sst>", xl__worksheets__sheet1=f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>')
    assert files.load_xlsx(xlsx) == "name | 7"
    assert files.load_pdf(b"%PDF-1.4\nstream\nBT (Hello \\(all\\)) Tj ET\nendstream") == "Hello (all)"


def test_uploads_without_data_or_of_another_type_are_reported(spark):
    rows = spark.createDataFrame([("a.txt", "cGxhaW4="), ("b.txt", ""), ("c.txt", None), ("d.png", "cGxhaW4="), ("e.txt", "AAAA"), (" ", "cGxhaW4=")], "filename string, data64 string")
    got = {r.filename: (r.text, r.error is None) for r in files.extract(files.decode(rows, on_error="keep"), "filename", on_error="keep").collect()}
    assert got.pop("a.txt") == ("plain", True) and set(got.values()) == {(None, False)}
    with pytest.raises(Exception, match="needs a name and data"):
        files.decode(rows).collect()


def test_extract_many_kinds(spark, tmp_path):
    bodies = {"a.txt": b"plain", "b.csv": b"id,name\n1,Ann\n", "c.json": b'{"k": [1]}', "d.jsonl": b'{"a":1}\n\n{"b":2}', "e.xml": b"<r><x>one</x><y>two</y></r>", "f.html": b"<body><nav>n</nav><div id='main'>Main <b>text</b></div></body>", "g.yaml": b"a: 1\n\nb: 2\n", "h.exe": b"MZ"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = {r.filename: r.text for r in files.read_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": "plain", "b.csv": "id | name\n1 | Ann", "c.json": '{"k": [1]}', "d.jsonl": '{"a": 1}\n{"b": 2}', "e.xml": "one\ntwo", "f.html": "Main text", "g.yaml": "a: 1\nb: 2"}
    bad = spark.createDataFrame([("x.docx", bytearray(b"no zip")), ("y.txt", bytearray(b"ok"))], "filename string, content binary")
    kept = {r.filename: (r.text, r.error) for r in files.extract(bad, "filename", on_error="keep").collect()}
    assert kept["y.txt"] == ("ok", None) and "doesn't fit" in kept["x.docx"][1]
    with pytest.raises(Exception, match="doesn't fit"):
        files.extract(bad, "filename").collect()
    with pytest.raises(Exception, match="needs a name"):
        files.decode(spark.createDataFrame([("", "YQ==")], "filename string, data64 string")).collect()
    assert files.texts(spark.createDataFrame([(" ",), ("a",)], "text string")).count() == 1


def test_pages(spark):
    assert files.page_text("<head><title>t</title></head><p>a<script>x</script></p><p>b</p>") == "a b"
    assert files.page_text("<div class='x container'>in</div>out") == "in"
    html = '<a href="/b">b</a><a href="c.html#x">c</a><a href="#top"></a><a href="http://other/z">z</a><a href="/f.pdf">f</a><a href="mailto:x@y">m</a>'
    pages = spark.createDataFrame([("http://s/a", html), ("http://s/b", '<a href="/d">')], "url string, html string")
    links = web.links(pages)
    assert {(r.url, r.link) for r in links.collect()} == {("http://s/a", "http://s/b"), ("http://s/a", "http://s/c.html"), ("http://s/b", "http://s/d")}
    seen = web.crawl(pages.filter("url = 'http://s/a'").select("url"), links, 5)
    assert {(r.url[-6:], r.depth) for r in seen.collect()} == {("://s/a", 0), ("://s/b", 1), ("c.html", 1), ("://s/d", 2)}
    names = spark.createDataFrame([("http://h.org/x/y.pdf?q",), ("http://h.org",)], "u string").select(web.file_name("u").alias("n")).collect()
    assert [r.n for r in names] == ["y.pdf", "h.org"]
    clean = web.distinct_links(spark.createDataFrame([(" http%3A%2F%2Fa.b ",), ("http://a.b",), ("ftp://x",)], "link string"))
    assert [r.link for r in clean.collect()] == ["http://a.b"]


def test_events_fold_into_the_catalogue(spark, tmp_path):
    source, store = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    made = [("b", "k1", "s3:ObjectCreated:Put", "2024-01-01T00:00:00"), ("b", "k2", "s3:ObjectCreated:Put", "2024-01-01T00:00:00"), ("b", "k2", "s3:ObjectRemoved:Delete", "2024-01-02T00:00:00"), ("b", "k1", "s3:ObjectRemoved:Delete", "2023-01-01T00:00:00")]
    messages = [(events.notification(b, k, n, t),) for b, k, n, t in made]
    spark.createDataFrame(messages, "value string").repartition(3).write.text(source)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(source)
    events.maintain(events.storage_events(stream), store, f"{store}-{uuid.uuid4().hex}").awaitTermination()
    assert [(r.bucket_name, r.object_name) for r in events.catalogue(spark, store).collect()] == [("b", "k1")]
    records = spark.createDataFrame([(json.dumps({"Records": []}),), ("broken",)], "value string")
    assert events.storage_events(records).count() == 0
    paths = events.path_events(spark.createDataFrame([("/buck/a/b.txt",)], "path string")).first()
    assert (paths.bucket_name, paths.object_name) == ("buck", "a/b.txt")


def test_watermarked_windows(spark, tmp_path, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/e")
    name = "w" + uuid.uuid4().hex
    q = events.tumbling(stream, "1 hour", "10 minutes", "ts", ["event_type"], "value").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table(name).agg(F.sum("n")).first()[0] == rows.count()
    log = spark.createDataFrame([("x", 1, "uploaded"), ("x", 2, "error"), ("y", 1, "ingested")], "id string, ts int, status string")
    assert {(r.id, r.status) for r in events.status_machine(log).collect()} == {("x", "error"), ("y", "ingested")}


def test_dumps_and_audio(spark, tmp_path):
    import struct

    from ragweave.sources import dumps

    (tmp_path / "d.xml").write_text("<w><page><title>T</title><revision><text>[[Hi]] {x}</text></revision></page><page><title>E</title><revision><text> </text></revision></page></w>")
    assert [(r.title, r.text) for r in dumps.encyclopedia_texts(spark, f"file://{tmp_path}/d.xml").collect()] == [("T", "Hi x")]
    wave = lambda d: b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", len(d)) + d
    parts = spark.createDataFrame([("r", 1, bytearray(wave(b"cd"))), ("r", 0, bytearray(wave(b"ab")))], "request_id string, part int, audio binary")
    assert bytes(dumps.merged_audio(parts).first().audio).endswith(b"data\x04\0\0\0abcd")
    with pytest.raises(ValueError):
        dumps.merge_waves([wave(b"a"), wave(b"b").replace(struct.pack("<I", 8000), struct.pack("<I", 9000))])
