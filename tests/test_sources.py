import json
import sqlite3

import pytest

from quillstone import cli, config
from quillstone.config import FIELDS
from quillstone.errors import ConfigurationError, MissingFileError, QuillstoneError, UnsupportedFileTypeError
from quillstone.operators import store
from quillstone.plans import pipeline
from quillstone.sources import backends, files, ground_truth, sqlite, workbook


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.pdf").write_bytes(b"Invoice Number: INV-7\nTotal: $12.50\nDate: 01/15/2024")
    (d / "b.PNG").write_bytes(b"Invoice Number: INV-8 Bill To: X Total: 99")
    (d / "broken.pdf").write_bytes(b"!broken")
    (d / "empty.pdf").write_bytes(b"")
    (d / "note.txt").write_bytes(b"x")
    return str(d)


def test_listing_and_loading(spark, folder):
    rows = {r.filename: r for r in files.load(spark, folder).collect()}
    assert rows["a.pdf"].success and rows["a.pdf"].file_type == "pdf" and bytes(rows["a.pdf"].content).startswith(b"Invoice")
    assert rows["b.PNG"].success and rows["b.PNG"].file_type == "image"
    assert not rows["empty.pdf"].success and rows["empty.pdf"].error == "file is empty"
    assert "unsupported" in rows["note.txt"].error
    assert files.quarantine(files.load(spark, folder)).count() == 2
    assert [r.filename for r in files.enumerate_inputs(spark, folder).collect()] == ["a.pdf", "b.PNG", "broken.pdf", "empty.pdf"]
    with pytest.raises(UnsupportedFileTypeError):
        files.enumerate_inputs(spark, folder + "/note.txt")
    with pytest.raises(MissingFileError):
        files.listing(spark, folder + "/none")


def _render(settings):
    def run(content):
        if content.startswith(b"!"):
            raise ValueError("broken file")
        yield {"image": content, "width": 1000, "height": 1000, "text": content.decode(), "metadata": {}}

    return run


def _read(settings):
    def run(image):
        out = []
        for n, line in enumerate(image.decode().split("\n")):
            out += [{"text": w, "left": 10 * i, "top": 40 * n, "width": 8, "height": 30, "conf": 90.0, "line_num": n} for i, w in enumerate(line.split(" "))]
        return out

    return run


def _ask(settings):
    return lambda image, text, question: ("Acme Ltd.", 0.9) if "vendor" in question else (None, 0.0)


def test_pipeline_with_stand_in_backends(spark, folder):
    backends.PDF.add(backends.Backend("plain", _render))
    choice = pipeline.Choice(pdf="plain", image=lambda s: lambda c: next(_render(s)(c)), ocr=backends.Backend("split", _read), qa=backends.Backend("fixed", _ask))
    found = pipeline.extract(spark, folder, choice=choice)
    by = {r.source_file.rsplit("/", 1)[-1]: r for r in found.headers.collect()}
    assert by["a.pdf"].invoice_number == "INV-7" and by["a.pdf"].total_amount == "12.50" and by["a.pdf"].invoice_date == "2024-01-15"
    assert by["a.pdf"].vendor_name == "Acme Ltd" and by["a.pdf"].validation.is_valid
    assert by["b.PNG"].total_amount == "99.00"
    assert any("regex fallback" in w for w in by["a.pdf"].warnings)
    assert sorted((r.stage, r.path.rsplit("/", 1)[-1]) for r in found.errors.collect()) == [("load", "empty.pdf"), ("load", "note.txt"), ("render", "broken.pdf")]
    assert pipeline.admitted(found.headers).count() == 2


def _counting(make, log, name):
    """A backend that writes a line for every page it sees."""

    def made(settings):
        inner = make(settings)

        def run(image, *more):
            with open(log, "a") as f:
                f.write(f"{name}\n")
            return inner(image, *more)

        return run

    return backends.Backend(name, made)


def test_command_line_run(spark, folder, tmp_path, capsys):
    log = str(tmp_path / "calls")
    backends.PDF.add(backends.Backend("plain", _render))
    choice = pipeline.Choice(pdf="plain", image=lambda s: lambda c: next(_render(s)(c)), ocr=_counting(_read, log, "ocr"), qa=_counting(_ask, log, "qa"))
    truth = tmp_path / "truth.json"
    truth.write_text(json.dumps([{"source_file": "a.pdf", "invoice_number": "INV-7", "vendor_name": "Acme Ltd"}, {"source_file": "b.PNG", "total_amount": "99"}]))
    args = cli.parser().parse_args([folder, "-o", str(tmp_path / "out"), "--evaluate", str(truth), "--report", "json"])
    assert cli.run(args, choice) == 0
    calls = open(log).read().split()
    assert calls.count("ocr") == 2 and calls.count("qa") == 2 * len(FIELDS)
    out, err = capsys.readouterr()
    report = json.loads(out[out.index("{") :])
    assert report["field_metrics"]["vendor_name"]["avg_confidence"] == pytest.approx(0.9) and report["total_samples"] == 2
    made = sorted((tmp_path / "out").iterdir())
    assert [m.suffix for m in made] == [".db", ".xlsx"] and len(workbook.read_sheet(str(made[1]))) == 3
    assert sqlite.read(spark, str(made[0])).count() == 2
    assert "2 incomplete records" in err and "broken.pdf" in err
    assert cli.choice_of(cli.parser().parse_args([folder, "--qa", "none", "--default-date", "2024-02-01"])).default_date.day == 1


def test_page_counts(spark):
    pages = spark.createDataFrame([("a", 0, {"total_pages": "7"}), ("b", 0, {}), ("b", 1, {})], "path string, page_idx int, metadata map<string,string>")
    assert {r.path: r.page_count for r in files.page_counts(pages).collect()} == {"a": 7, "b": 2}


def test_backends_fall_back_or_fail():
    r = backends.Registry("ocr", "base")
    r.add(backends.Backend("base", _read))
    r.add(backends.Backend("other", _read, ("no_such_module",)))
    assert r.resolve("other").name == "base" and r.resolve("unknown").name == "base"
    assert r.info() == {"base": True, "other": False}
    with pytest.raises(QuillstoneError):
        r.resolve("other", strict=True)
    assert backends.quad_word([(0, 5), (10, 5), (10, 9), (0, 9)], "x", 0.5, 2) == {"text": "x", "left": 0, "top": 5, "width": 10, "height": 4, "conf": 50.0, "line_num": 2}
    assert backends.tesseract_flags(config.Settings()) == "--psm 3 --oem 3 --dpi 300"


def test_orientation_languages_and_info(spark):
    pages = spark.createDataFrame([("a", 0, bytearray(b"x")), ("b", 0, bytearray(b"!"))], "path string, page_idx int, image binary")

    def make(settings):
        return lambda image: {"orientation": 90, "script": "Latin"} if image == b"x" else 1 / 0

    got = {r.path: (r.orientation, r.rotate, r.script) for r in backends.orientation(pages, make).collect()}
    assert got == {"a": (90, 0, "Latin"), "b": (0, 0, None)}
    assert backends.languages(lambda: ["osd", "fra", "eng"]) == ["eng", "fra"] and backends.languages(lambda: 1 / 0) == ["eng"]
    info = backends.model_info(backend=backends.Backend("x", _ask))
    assert info["backend"] == "x" and set(info["questions"]) == set(FIELDS)


RECORD = dict.fromkeys(FIELDS, "v") | {"source_file": "a.pdf"}


@pytest.mark.parametrize("body", [[RECORD], {"records": [RECORD], "metadata": {}}, {"_description": "x", "invoices": [{"filename": "a.pdf", "fields": dict.fromkeys(FIELDS, "v")}]}, {"a.pdf": dict.fromkeys(FIELDS, "v")}])
def test_ground_truth_layouts(spark, tmp_path, body):
    p = tmp_path / "t.json"
    p.write_text(json.dumps(body, indent=1))
    got = ground_truth.read(spark, str(p)).collect()
    assert [(r.idx, r.source_file, r.total_amount) for r in got] == [(0, "a.pdf", "v")]


def test_ground_truth_csv_and_workbook(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('filename,invoice_number,vendor_name\na.pdf,007,"A ""B"", C\nD"\n')
    r = ground_truth.read(spark, str(p)).first()
    assert (r.source_file, r.invoice_number, r.vendor_name, r.total_amount) == ("a.pdf", "007", 'A "B", C\nD', None)
    x = str(tmp_path / "t.xlsx")
    workbook.write_sheets(x, [("s", ["source_file", "", "invoice_number"], [["a.pdf", "z", "1"], ["b.pdf", "", "2"]], [10, 10, 10])])
    assert [(r.source_file, r.invoice_number) for r in ground_truth.read(spark, x).orderBy("idx").collect()] == [("a.pdf", "1"), ("b.pdf", "2")]
    with pytest.raises(ConfigurationError):
        ground_truth.read(spark, "t.xml")


def _extraction(spark, n):
    kinds = ", ".join(f"{f} string" for f in FIELDS)
    rows = [(f"N{i}", "2024-01-01", f"V{i % 2}", None, "1.00", None, {"invoice_number": 0.5}, f"{i}.pdf", "t", "m", 1.25, i % 2 == 0) for i in range(n)]
    return spark.createDataFrame(rows, f"{kinds}, confidence_scores map<string,double>, source_file string, extraction_timestamp string, model_name string, processing_time double, success boolean")


def test_sqlite_round_trip(spark, tmp_path):
    path = str(tmp_path / "s.db")
    rows = store.to_stored(_extraction(spark, 20), "2024-01-01 00:00:00")
    assert sqlite.append(rows, path) == 20
    assert sqlite.append(rows, path) == 0
    got = sqlite.read(spark, path)
    assert got.count() == 20 and got.where("success = 1").count() == 10
    assert got.agg({"id": "max"}).first()[0] == 20
    assert sqlite.delete(path, "N3") and not sqlite.delete(path, "N3")
    with sqlite3.connect(path) as c:
        assert c.execute("SELECT count(*) FROM invoice_headers").fetchone()[0] == 19


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    df = _extraction(spark, 3)
    workbook.export(df, path)
    rows = workbook.read_sheet(path)
    assert rows[0] == [h for h, _ in workbook.COLUMNS] and len(rows) == 4
    meta = workbook.metadata_sheet(df).collect()
    assert [r["Success"] for r in meta] == ["TRUE", "", "TRUE"] and meta[0]["Processing Time (s)"] == "1.25"
    assert workbook.confidence_sheet(df).first()["Invoice Number Conf."] == "0.50"
    assert workbook.widths(workbook.data_sheet(df)).first()["Invoice Number"] == 16
    with pytest.raises(QuillstoneError):
        workbook.export(df.limit(0), path)


def test_settings(tmp_path):
    p = tmp_path / "s.yaml"
    p.write_text("input:\n  pdf:\n    dpi: 100\npaths:\n  output_dir: out\n")
    s = config.load(str(p))
    assert s.get("input.pdf.dpi") == 100 and s.get("input.pdf.max_pages") == 10
    assert s.get("no.such", 5) == 5 and s.get("paths.output_dir") == str(tmp_path / "out")
    p.write_text("input:\n  pdf:\n    dpi: 200\n")
    assert s.get("input.pdf.dpi") == 100 and s.reload().get("input.pdf.dpi") == 200 and config.Settings().reload() == config.Settings()
    with pytest.raises(ConfigurationError):
        config.load(str(tmp_path / "none.yaml"))
    assert str(QuillstoneError("m", a=1)) == "m | Details: {'a': 1}"
