"""Document grids of all three kinds, and vectors and tensors through files."""

import io
import json
import os
import zipfile

import numpy as np
import pytest

from strandworks.operators import measure
from strandworks.sources import arrays, documents

ARTICLE = b"""<article xmlns:x="u"><p>no <b>table</b></p><table-wrap id="T1"><label>1</label><table><thead><tr><th rowspan="2">Name</th><th colspan="2">MIC  <sup>a</sup></th></tr>
<tr><th>EC</th><th>SA</th></tr></thead><tbody><tr><td>p1</td><td>&gt; 8</td><td/></tr><tr><td rowspan="2">p2</td><td colspan="2"><table><tr><td>in</td></tr></table> 4</td></tr><tr><td>5</td><td>6</td></tr></tbody></table></table-wrap>
<table-wrap><table><tr><td>unnamed</td></tr></table></table-wrap><table-wrap id="T2"><table><tr><td>z</td></tr></table></table-wrap></article>"""


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


def sheet(cells):
    return f'<worksheet xmlns="{documents.SHEET[1:-1]}"><sheetData><row>{cells}</row></sheetData></worksheet>'


BOOK = zipped(
    xl__sharedStrings_xml=f'<sst xmlns="{documents.SHEET[1:-1]}"><si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r></si></sst>',
    xl__worksheets__sheet1_xml=sheet('<c r="A1" t="s"><v>1</v></c><c r="AB3"><v>2.5</v></c><c r="B9"/><c r="C2" t="inlineStr"><is><t>in line</t></is></c>'),
    xl__worksheets__sheet2_xml=sheet('<c r="A1" t="s"><v>0</v></c>'),
)
LETTER = zipped(word__document_xml=f'<d xmlns:w="{documents.WORD[1:-1]}"><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl></d>')


def test_grids_of_all_kinds(spark, tmp_path):
    for name, body in (("a.xml", ARTICLE), ("b.xlsx", BOOK), ("c.docx", LETTER)):
        (tmp_path / name).write_bytes(body)
    got = {}
    for r in documents.read_grids(spark, str(tmp_path)).collect():
        got.setdefault((os.path.basename(r.path), r.tbl), {})[r.row, r.col] = r.text
    first = got["a.xml", "T1"]
    assert [[first[i, j] for j in range(3)] for i in range(5)] == [["Name", "MIC a", "MIC a"], ["Name", "EC", "SA"], ["p1", "> 8", ""], ["p2", "in 4", "in 4"], ["p2", "5", "6"]]
    assert got["a.xml", "T2"] == {(0, 0): "z"} and len(got) == 5
    assert got["b.xlsx", "sheet1"] == {(0, 0): "two", (2, 27): "2.5", (1, 2): "in line"} and got["b.xlsx", "sheet2"] == {(0, 0): "one"}
    assert got["c.docx", "0"] == {(0, 0): "ab", (0, 1): ""}


def test_what_is_refused():
    read = lambda body: list(documents.xml_tables(b'<a><table-wrap id="t"><table>' + body + b"</table></table-wrap></a>"))
    with pytest.raises(ValueError, match="overlap"):
        read(b'<tr><td/><td rowspan="2"/></tr><tr><td colspan="2"/></tr>')
    with pytest.raises(ValueError, match="rowspan"):
        read(b'<tr><td rowspan="0"/></tr>')
    for cells, text in (('<c r="A1"><f>1+1</f><v>2</v></c>', "formula"), ('<c r="1A"><v>2</v></c>', "address")):
        with pytest.raises(ValueError, match=text):
            list(documents.sheets(zipped(xl__worksheets__sheet1_xml=sheet(cells))))
    with pytest.raises(ValueError, match="no reader"):
        list(documents.DocumentGrid().eval("x.pdf", b""))
    assert list(documents.DocumentGrid().eval("x.xml", None)) == []


def test_replay_reads_grids(spark):
    docs = spark.createDataFrame([("f.xml", bytearray(ARTICLE))], "file string, content binary")
    grid = documents.grids(docs, "file").selectExpr("file", "tbl", "row", "col", "text")
    cells = spark.createDataFrame([("f.xml", "T1", 2, 1, "> 8", 8.0), ("f.xml", "T1", 4, 2, "6", 7.0), ("f.xml", "T9", 0, 0, "6", 6.0)], "file string, tbl string, row int, col int, cell_text string, value double")
    got = {(r.tbl, r.row): r.replay for r in measure.grid_values(grid, cells).collect()}
    assert len(set(got.values())) > 1 and len(got) == 3


def test_vectors_come_back_over_ranges(spark, tmp_path):
    r = np.random.default_rng(3)
    x = r.normal(size=(5000, 12)).astype(np.float32)
    np.save(tmp_path / "x.npy", x)
    df = arrays.read_vectors(spark, f"{tmp_path}/x.npy", range_bytes=50_000)
    assert df.rdd.getNumPartitions() == 5
    got = df.orderBy("row").toArrow()
    assert got.column("row").to_pylist() == list(range(5000)) and np.array_equal(np.stack(got.column("vector").to_pylist()).astype(np.float32), x)
    arrays.write_vectors(df.repartition(3), f"{tmp_path}/out", "row", "vector", partitions=4)
    back = arrays.read_vectors(spark, f"{tmp_path}/out", range_bytes=100_000)
    assert back.join(df, ["row", "vector"]).count() == 5000 and back.count() == 5000
    assert arrays.read_vectors(spark, f"{tmp_path}/out", vectors=False).agg({"row": "sum"}).first()[0] == 5000 * 4999 // 2
    part = next(p for p in os.listdir(tmp_path / "out") if p.endswith(".f32"))
    assert arrays.verify_vectors(spark, f"{tmp_path}/out") == 5000
    body = (tmp_path / "out" / part).read_bytes()
    (tmp_path / "out" / part).write_bytes(body[:50] + b"\0" + body[51:])
    with pytest.raises(Exception, match="manifest"):
        arrays.verify_vectors(spark, f"{tmp_path}/out")
    with open(tmp_path / "out" / part, "r+b") as f:
        f.truncate(100)
    with pytest.raises(Exception, match="truncated"):
        arrays.read_vectors(spark, f"{tmp_path}/out").count()
    with open(tmp_path / "x.npy", "r+b") as f:
        f.truncate(1000)
    with pytest.raises(Exception, match="truncated"):
        arrays.read_vectors(spark, f"{tmp_path}/x.npy").count()
    np.save(tmp_path / "d.npy", x.astype(float))
    with pytest.raises(Exception, match="float32"):
        arrays.read_vectors(spark, f"{tmp_path}/d.npy").count()


def test_a_failed_write_leaves_no_table(spark, tmp_path):
    for k, bad in enumerate(([1.0], None, [1.0, None], [float("nan"), 1.0])):
        df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, bad)], "row long, vector array<float>")
        with pytest.raises(Exception, match="width|null|finite"):
            arrays.write_vectors(df, f"{tmp_path}/w{k}", "row", "vector", partitions=3)
        assert not os.path.exists(tmp_path / f"w{k}") or not os.path.exists(tmp_path / f"w{k}" / arrays.MANIFEST)
    arrays.write_vectors(df.limit(0), f"{tmp_path}/none", "row", "vector")
    assert json.loads((tmp_path / "none" / arrays.MANIFEST).read_text())["parts"] == [] and arrays.read_vectors(spark, f"{tmp_path}/none").count() == 0


def test_archives(spark, tmp_path):
    cube = np.arange(1.0, 25).reshape(2, 3, 4)
    good = {"sequences": np.array(["AC", "DE"]), "models": np.array(["a", "b", "c"]), "targets": np.array(list("wxyz")), "mic": cube}
    names = {"sequences": "sequence", "models": "model", "targets": "target"}
    data = arrays.archive_bytes(good)
    assert data == arrays.archive_bytes(dict(reversed(good.items())))
    (tmp_path / "a.npz").write_bytes(data)
    got = {(r.sequence, r.model, r.target): r.value for r in arrays.read_archive(spark, f"{tmp_path}/a.npz", names, "mic").collect()}
    assert len(got) == 24 and got["DE", "b", "z"] == cube[1, 1, 3]
    for change, text in (({"mic": cube - 1}, "positive"), ({"mic": cube[:, :2]}, "cube"), ({"models": np.array(["a", "a", "c"])}, "repeat"), ({"more": cube}, "holds")):
        (tmp_path / "bad.npz").write_bytes(arrays.archive_bytes(good | change))
        with pytest.raises(Exception, match=text):
            arrays.read_archive(spark, f"{tmp_path}/bad.npz", names, "mic").count()
