"""Folders of files from scan to sinks, damaged ones included, and the drop-folder stream."""

import csv
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from kartoteka.plans.details import counters, with_details
from kartoteka.schema import Settings
from kartoteka.sources import docx as docx_files
from kartoteka.sources import file_sink, files, sinks, store
from kartoteka.streaming import drop_folder

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def docx(paragraphs, rows=(), header=""):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        refs = '<w:sectPr><w:headerReference w:type="default" r:id="r2"/><w:footerReference w:type="default" r:id="r1"/></w:sectPr>' if header else ""
        z.writestr("word/document.xml", f"<w:document {W} {R}><w:body>{''.join(map(p, paragraphs))}{table if rows else ''}{refs}</w:body></w:document>")
        if header:
            z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="footer1.xml"/><Relationship Id="r2" Target="header1.xml"/></Relationships>')
            z.writestr("word/header1.xml", f"<w:hdr {W}>{p(header)}</w:hdr>")
            z.writestr("word/footer1.xml", f"<w:ftr {W}>{p('Подвал')}</w:ftr>")
            z.writestr("word/header9.xml", f"<w:hdr {W}>{p('nowhere referred to')}</w:hdr>")
    return out.getvalue()


def pages(texts, tables=None, images=None):
    """A backend of fixed pages; an exception among them is raised."""

    class Fake:
        def __len__(self):
            return len(texts or images)

        def given(self, those, k, none):
            if isinstance(x := those[k] if those else none, Exception):
                raise x
            return x

        def text(self, k):
            return self.given(texts, k, "")

        def tables(self, k):
            return self.given(tables, k, [])

        def image(self, k):
            return self.given(images, k, b"")

    return lambda content: Fake()


def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.docx").write_bytes(docx(["ИНН: 7744012347", ""], [["БИК: 044525225", ""], ["", ""]], "Реквизиты организации"))
    (d / "b.DOCX").write_bytes(docx([""]))
    (d / "c.docx").write_bytes(b"no zip")
    (d / "d.pdf").write_bytes(b"%PDF-1.4 page")
    (d / "e.txt").write_bytes(b"text")
    return str(d)


def test_folder(spark, tmp_path):
    found = files.with_text(files.scan(spark, folder(tmp_path)), pdf=pages(["ИНН: 7744012347 " + "x" * 60, " ", "two"]))
    r = {x.original_filename: x for x in found.collect()}
    assert set(r) == {"a.docx", "b.DOCX", "c.docx", "d.pdf"}
    assert r["a.docx"].text == "ИНН: 7744012347\nБИК: 044525225\nРеквизиты организации\nПодвал" and r["a.docx"].extractor == "python_docx"
    assert "empty" in r["b.DOCX"].extraction_warnings[0]
    assert r["c.docx"].error.startswith("Cannot open DOCX")
    assert r["d.pdf"].text.startswith("[Страница 1]\nИНН") and "[Страница 3]\ntwo" in r["d.pdf"].text and r["d.pdf"].pages == 3
    assert all(x.document_id == x.sha256[:8] for x in r.values())
    results = with_details(found)
    report = {x.file_name: x for x in sinks.batch_report(results).collect()}
    assert report["c.docx"].status == "error" and report["c.docx"].fill_rate is None and report["a.docx"].status == "needs_review"
    assert {x.status: x.n for x in counters(results).collect()} == {"needs_review": 3, "failed": 1}


def test_scans_need_a_backend(spark, tmp_path):
    d = tmp_path / "scans"
    d.mkdir()
    (d / "s.pdf").write_bytes(b"%PDF")
    (d / "i.png").write_bytes(b"\x89PNG....")
    scan = files.scan(spark, str(d), Settings(extensions=("pdf", "png")))
    assert all("backend" in x.error and x.failure == "error" for x in files.with_text(scan).collect())

    def ocr(image):
        if image == b"bad":
            raise ValueError("unreadable")
        if image == b"words":
            return [{"block_num": b, "line_num": n, "text": t} for b, n, t in ((1, 1, "ИНН:"), (2, 1, "КПП"), (1, 1, "77"), (1, 2, " "))]
        return [] if image == b"blank" else ["one", "two"]

    r = {x.original_filename: x for x in files.with_text(scan, pdf=pages(None, images=[b"x", b"blank", b"bad", b"words"]), ocr=ocr).collect()}
    assert r["i.png"].text == "one\ntwo" and r["i.png"].pages == 1 and r["i.png"].ocr_used
    assert r["s.pdf"].text == "[Страница 1]\none\ntwo\n\n[Страница 4]\nИНН: 77\nКПП" and r["s.pdf"].pages == 4
    assert r["s.pdf"].extraction_warnings == ["Page 2: OCR returned empty text", "Page 3: OCR failed — unreadable"]


def test_pdf_tables_and_small_text_layer(spark, tmp_path):
    d = tmp_path / "pdf"
    d.mkdir()
    (d / "t.pdf").write_bytes(b"%PDF")
    scan = files.scan(spark, str(d))
    pdf = pages(["Карточка", "", "стр"], [[[["ИНН", " 77 "], [None, ""], ["КПП", None]]], [], [3]])
    (r,) = files.with_text(scan, pdf=pdf).collect()
    assert r.text == "[Страница 1]\nКарточка\nИНН | 77\nКПП\n\n[Страница 3]\nстр" and r.pages == 3
    # what tells a scan is the pages' text alone, without tables
    assert r.extraction_warnings[0].startswith("Page 3: table extraction failed") and len(r.extraction_warnings) == 1 and r.doc_kind == "pdf_scan"
    (r,) = files.with_text(scan, pdf=pages(["x"])).collect()
    assert r.extraction_warnings[0].startswith("PDF text layer too small")
    (r,) = files.with_text(scan, pdf=pages([" " * 60 + "x" * 49, "", "", "y" * 60])).collect()
    assert r.doc_kind == "pdf_scan" and r.extractor == "pdfplumber"  # the fourth page isn't asked
    assert files.none_found(scan, str(d)) is None and "pdf" in files.none_found(scan.limit(0), str(d))


def test_pages_of_a_long_scan_use_all_tasks(spark, tmp_path):
    """3000 pages of one file are recognised in all partitions, bad ones cost a warning, and come back in order."""
    d = tmp_path / "long"
    d.mkdir()
    (d / "s.pdf").write_bytes(b"%PDF scan")
    (d / "t.pdf").write_bytes(b"%PDF text")
    (d / "x.pdf").write_bytes(b"%PDF broken")
    (d / "n.docx").write_bytes(docx(["рядом"]))

    def opened(content):
        class Doc:
            def __len__(self):
                if content.endswith(b"broken"):
                    raise ValueError("no pages")
                return 3000 if content.endswith(b"scan") else 70

            def text(self, k):
                if k == 40:
                    raise ValueError("torn")
                return "" if content.endswith(b"scan") else f"текст {k} " + "x" * 40

            def tables(self, k):
                return []

            def image(self, k):
                return f"{k}".encode()

        return Doc()

    def ocr(image):
        from pyspark import TaskContext

        if image == b"1234":
            raise ValueError("unreadable")
        return [f"{image.decode()} in {TaskContext.get().partitionId()}"] if image != b"7" else []

    ocr.extractor = "mine"
    r = {x.original_filename: x for x in files.with_text(files.scan(spark, str(d)), pdf=opened, ocr=ocr).collect()}
    assert set(r) == {"s.pdf", "t.pdf", "x.pdf", "n.docx"} and r["n.docx"].text == "рядом"
    s = r["s.pdf"]
    blocks = s.text.split("\n\n")
    assert [x.split("\n")[0] for x in blocks] == [f"[Страница {k + 1}]" for k in range(3000) if k not in (7, 1234)]
    assert [int(x.split("\n")[1].split(" ")[0]) for x in blocks] == [k for k in range(3000) if k not in (7, 1234)]
    assert {x.rsplit(" ", 1)[1] for x in blocks} == {str(p) for p in range(int(spark.conf.get("spark.sql.shuffle.partitions")))}
    assert (s.doc_kind, s.extractor, s.pages, s.ocr_used, s.error) == ("pdf_scan", "mine", 3000, True, None)
    assert s.extraction_warnings == ["Page 8: OCR returned empty text", "Page 1235: OCR failed — unreadable"]
    t = r["t.pdf"]
    assert (t.doc_kind, t.extractor, t.pages, t.ocr_used) == ("pdf_text", "pdfplumber", 70, False) and t.extraction_warnings == ["Page 41: text extraction failed — torn"]
    assert "[Страница 40]\nтекст 39" in t.text and "[Страница 41]" not in t.text
    assert r["x.pdf"].failure == "exception" and "no pages" in r["x.pdf"].error


def test_bounds_of_docx(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"

    def file(body, **parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f"<w:document {W} {R}><w:body>{body}</w:body></w:document>")
            for name, text in parts.items():
                z.writestr("word/_rels/document.xml.rels" if name == "rels" else f"word/{name}.xml", text)
        return out.getvalue()

    wide = f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="5000000"/></w:tcPr>{p("abcd")}</w:tc></w:tr></w:tbl>'
    bomb = file(p("a" * (150 << 20)))
    assert len(bomb) < 300_000
    d = tmp_path / "bounds"
    d.mkdir()
    (d / "wide.docx").write_bytes(file(wide))
    (d / "bomb.docx").write_bytes(bomb)
    r = {x.original_filename: x for x in files.with_text(files.scan(spark, str(d))).collect()}
    assert r["wide.docx"].error == "Cannot open DOCX: more than 500000 table cells" and r["wide.docx"].failure == "error"
    assert r["bomb.docx"].error == "Cannot open DOCX: more than 134217728 bytes of XML"
    with pytest.raises(docx_files.TooLarge, match="characters"):
        docx_files.text(file(wide.replace("5000000", "10")), most_chars=20)
    # rows and cells in content controls, a target from the root, a header shared by sections
    row = lambda t: f"<w:tr><w:sdt><w:sdtContent><w:tc>{p(t)}</w:tc></w:sdtContent></w:sdt><w:tc>{p('2')}</w:tc></w:tr>"
    table = f"<w:tbl>{row('a')}<w:sdt><w:sdtContent>{row('b')}</w:sdtContent></w:sdt></w:tbl>"
    nested = f"<w:tbl><w:tr><w:tc>{p('out')}<w:tbl>{row('in')}</w:tbl></w:tc></w:tr></w:tbl>"
    section = '<w:sectPr><w:headerReference w:type="default" r:id="r1"/></w:sectPr>'
    body = f"<w:p><w:r><w:t>one</w:t></w:r><w:pPr>{section}</w:pPr></w:p>{table}{nested}<w:sectPr/>"
    rels = '<Relationships><Relationship Id="r1" Target="/word/header1.xml"/></Relationships>'
    assert docx_files.text(file(body, rels=rels, header1=f"<w:hdr {W}>{p('Шапка')}</w:hdr>")) == "one\na | 2\nb | 2\nout\nШапка\nШапка"


def test_merged_cells_stand_in_each_place():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    wide = f'<w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p("A")}</w:tc>'
    tall = lambda v, t: f'<w:tc><w:tcPr><w:vMerge{v}/></w:tcPr>{p(t)}</w:tc>'
    first, second = f"<w:tr>{wide}{tall(' w:val=\"restart\"', 'T')}</w:tr>", f"<w:tr><w:tc>{p('b')}</w:tc><w:tc>{p('c')}</w:tc>{tall('', '')}</w:tr>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body><w:tbl>{first}{second}</w:tbl></w:body></w:document>")
    assert docx_files.text(out.getvalue()) == "A | A | T\nb | c | T"


def test_folder_to_folder(spark, tmp_path):
    """A whole batch: a good file, a broken and an oversize one, with all files written and a report in order."""
    d, out = folder(tmp_path), tmp_path / "out"
    (tmp_path / "in" / "0.pdf").write_bytes(b"%PDF" + bytes(2**20))
    settings = Settings(max_upload_mb=1)
    found = files.with_text(files.scan(spark, d, settings), settings, pdf=pages(["ИНН: 7744012347 " + "x" * 60]))
    # the record plan is long: its results are a table before more is derived from them
    with_details(found, settings).write.parquet(str(tmp_path / "results"))
    table = spark.read.parquet(str(tmp_path / "results"))
    results = sinks.write_files(table, str(out), template=docx(["ИНН 'INN'"]))
    before = {f.name: f.stat().st_mtime_ns for f in out.iterdir()}
    assert results.count() == 5 and results.where("json_path is not null").count() == 3
    assert {f.name: f.stat().st_mtime_ns for f in out.iterdir()} == before  # actions on the rows write nothing
    assert sorted(before) == sorted(p.rsplit("/", 1)[1] for r in results.collect() for p in (r.json_path, r.xlsx_path, r.docx_path, r.raw_text_path, r.normalized_text_path) if p)
    json_path, csv_path = sinks.write_report(results, str(out / "report"))
    rows = json.loads(open(json_path).read())
    assert open(json_path).read() == json.dumps(rows, ensure_ascii=False, indent=2)
    assert [r["file_name"] for r in rows] == ["0.pdf", "a.docx", "b.DOCX", "c.docx", "d.pdf"]
    assert [r["status"] for r in rows] == ["error", "needs_review", "needs_review", "error", "needs_review"]
    assert rows[0]["document_id"] is None and rows[0]["json_path"] is None and "larger than 1 MB" in rows[0]["warnings"][0]
    a = rows[1]
    text = open(a["json_path"]).read()
    saved = json.loads(text)
    assert text == json.dumps(saved, ensure_ascii=False, indent=2)
    assert saved["data"]["inn"] == "7744012347" and saved["processing_meta"]["sha256"][:8] == a["document_id"]
    assert list(saved["processing_meta"]) == ["extractor", "ocr_used", "llm_provider", "llm_model", "prompt_version", "sha256", "fallback_used", "fallback_count"]
    assert docx_files.text(open(a["docx_path"], "rb").read()) == "ИНН 7744012347"
    assert (out / f"{a['document_id']}_raw.txt").read_text().startswith("ИНН") and (out / f"{a['document_id']}_normalized.txt").exists()
    with open(csv_path, newline="") as f:
        read = list(csv.DictReader(f))
    said = {None: "", True: "True", False: "False"}
    assert [{k: "; ".join(v) if isinstance(v, list) else said[v] if v is None or v is True or v is False else str(v) for k, v in r.items()} for r in rows] == [{k: r[k] for k in rows[0]} for r in read]
    broken = sinks.write_files(table, str(out), template=b"no zip").where("original_filename = 'a.docx'").first()
    assert broken.docx_path is None and broken.xlsx_path and broken.warnings[-1].startswith("DOCX export failed")


def test_report_over_folders_and_partitions(spark, tmp_path):
    """The order is that of paths, whatever the partitions; texts with quotes, commas and line ends come back."""
    names = [f"{'ab'[k % 2]}/{k:03d}.pdf" for k in range(200)]
    rows = [(n.split("/")[1], n, f"id{n}", "done" if k % 3 else "error", True, 0.5, ['"x", y\nz', "w"] if k % 2 else [], "плохо") for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, "original_filename string, storage_path string, document_id string, status string, needs_review boolean, fill_rate double, warnings array<string>, error string").repartition(7)
    json_path, csv_path = sinks.write_report(df, str(tmp_path))
    got = json.loads(open(json_path).read())
    assert [r["file_name"] for r in got] == [n.split("/")[1] for n in sorted(names)]
    assert got[1]["warnings"] in ([], ["плохо"]) and any(r["warnings"] == ['"x", y\nz', "w"] for r in got)
    with open(csv_path, newline="") as f:
        assert [r["file_name"] for r in csv.DictReader(f)] == [r["file_name"] for r in got]
    json_path, csv_path = sinks.write_report(df.limit(0), str(tmp_path / "none"))
    assert open(json_path).read() == "[]" and open(csv_path).read().startswith("file_name,document_id,status")
    assert not [p for p in tmp_path.rglob("*") if "report-" in p.name]


def test_files_are_there_when_the_job_commits(spark, tmp_path):
    out = tmp_path / "files"
    df = spark.range(40).repartition(4).selectExpr("concat('d', id % 3, '/', id, '.txt') as name", "encode(concat('text ', id), 'utf-8') as content")
    file_sink.write(df, str(out))
    assert {str(f.relative_to(out)): f.read_text() for f in out.rglob("*") if f.is_file()} == {f"d{k % 3}/{k}.txt": f"text {k}" for k in range(40)}
    file_sink.write(df.where("name like 'd0/0%'").withColumn("content", F.encode(F.lit("new"), "utf-8")), out.as_uri())
    assert (out / "d0" / "0.txt").read_text() == "new" and (out / "d1" / "1.txt").read_text() == "text 1"

    bad = tmp_path / "bad"
    broken = df.withColumn("content", F.when(F.col("name").endswith("/39.txt"), F.expr("cast(raise_error('broken') as binary)")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        file_sink.write(broken, str(bad))
    assert not bad.exists() or not [f for f in bad.rglob("*")]
    for name in ("../x", "/x", "", "a/../../x"):
        with pytest.raises(Exception, match="file name"):
            file_sink.write(df.limit(1).withColumn("name", F.lit(name)), str(bad))
    assert not [f for f in bad.rglob("*")] and not (tmp_path / "x").exists()


def test_workbook_and_template(spark):
    results = with_details(spark.createDataFrame([("x", "ИНН: 7744012347")], "document_id string, text string"), compose=False)
    (book,) = sinks.workbooks(results).collect()
    with zipfile.ZipFile(io.BytesIO(book.content)) as z:
        assert "7744012347" in z.read("xl/worksheets/sheet1.xml").decode() and "field is null" in z.read("xl/worksheets/sheet2.xml").decode()
    template = docx(["ИНН 'INN' и &apos;KPP&apos;", "как есть"])
    (filled,) = sinks.filled_templates(results, template).collect()
    assert docx_files.text(bytes(filled.content)) == "ИНН 7744012347 и\nкак есть"
    row = results.select(sinks.json_document(results).alias("j")).first().j
    assert '"kpp":null' in row and '"extracted_by":{"inn":"regex"}' in row


def test_stream(spark, tmp_path):
    d = folder(tmp_path)
    q = drop_folder.started(drop_folder.watched(spark, d).select("original_filename", "details", "status"), str(tmp_path / "out"), str(tmp_path / "mark"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 4
    assert out.where(F.col("details.inn") == "7744012347").count() == 1


def test_stream_counts_each_content_once(spark, tmp_path):
    """The same file dropped twice counts once, in one batch and over a restart; a batch run again changes nothing."""
    d, mark = tmp_path / "drop", str(tmp_path / "mark")
    d.mkdir()
    one, two = docx(["ИНН: 7744012347"]), docx(["ИНН: 500100732259"])
    (d / "a.docx").write_bytes(one)
    (d / "a2.docx").write_bytes(one)
    (d / "bad.docx").write_bytes(b"no zip")
    counts = store.create(spark, str(tmp_path / "counts"), buckets=2, key="status")
    assert {r.status: r.n for r in drop_folder.totals(spark, counts).collect()} == {"done": 0, "needs_review": 0, "failed": 0}

    def run():
        q = drop_folder.counted(drop_folder.watched(spark, str(d), within="30 days"), counts, mark)
        q.awaitTermination(180)
        assert q.exception() is None
        return {r.status: r.n for r in drop_folder.totals(spark, counts).collect()}

    assert run() == {"done": 0, "needs_review": 1, "failed": 1}
    (d / "a3.docx").write_bytes(one)
    (d / "b.docx").write_bytes(two)
    assert run() == {"done": 0, "needs_review": 2, "failed": 1}  # a3 is known from before the restart
    # the last batch as after a failure between its rows and its commit
    commits = sorted((tmp_path / "mark" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / "mark" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert run() == {"done": 0, "needs_review": 2, "failed": 1}
    assert run() == {"done": 0, "needs_review": 2, "failed": 1}
