"""Word documents: read into paragraphs and runs, and written back. Standard library only."""

from __future__ import annotations

import copy
import io
import os
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import PARAGRAPHS

NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_W = f"{{{NS}}}"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
BODY = "word/document.xml"
ET.register_namespace("w", NS)


def _styles(z: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in z.namelist():
        return {}
    root = ET.fromstring(z.read("word/styles.xml"))
    names = {}
    for s in root.iter(f"{_W}style"):
        name = s.find(f"{_W}name")
        if name is not None:
            names[s.get(f"{_W}styleId")] = name.get(f"{_W}val")
    return names


def _run_text(r: ET.Element) -> str:
    out = []
    for e in r:
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag == f"{_W}tab":
            out.append("\t")
        elif e.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def _runs(p: ET.Element) -> list[ET.Element]:
    """Runs of a paragraph, those inside hyperlinks included."""
    return [r for e in p for r in ([e] if e.tag == f"{_W}r" else e.findall(f"{_W}r") if e.tag == f"{_W}hyperlink" else [])]


def _format(r: ET.Element) -> dict:
    props = r.find(f"{_W}rPr")

    def val(tag: str, attr: str = "val") -> str | None:
        e = None if props is None else props.find(f"{_W}{tag}")
        return None if e is None else e.get(f"{_W}{attr}", "")

    on = lambda tag: None if val(tag) is None else val(tag) not in ("0", "false", "none")
    return {"bold": on("b"), "italic": on("i"), "underline": on("u"), "font": val("rFonts", "ascii"), "size": val("sz"), "color": val("color"), "highlight": val("highlight"), "style": val("rStyle")}


def _elements(root: ET.Element) -> Iterator[tuple[str, ET.Element]]:
    """Paragraphs of the body, then those of its tables' cells; nested tables are not visited."""
    body = root.find(f"{_W}body")
    for p in body.findall(f"{_W}p"):
        yield "body", p
    for t in body.findall(f"{_W}tbl"):
        for cell in t.findall(f"{_W}tr/{_W}tc"):
            for p in cell.findall(f"{_W}p"):
                yield "table", p


def parse(content: bytes) -> list[dict]:
    """para_idx (blank ones count), section, style, text and runs of every paragraph."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root, names = ET.fromstring(z.read(BODY)), _styles(z)
    out = []
    for i, (section, p) in enumerate(_elements(root)):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        style = "Normal" if style is None else names.get(style.get(f"{_W}val"), style.get(f"{_W}val"))
        runs = [{"run_idx": k, "text": _run_text(r), **_format(r)} for k, r in enumerate(_runs(p))]
        out.append({"para_idx": i, "section": section, "style": style, "text": "".join(r["text"] for r in runs), "runs": runs})
    return out


def _set_text(r: ET.Element, text: str) -> None:
    for e in list(r):
        if e.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"):
            r.remove(e)
    t = ET.SubElement(r, f"{_W}t")
    t.text = text
    t.set(_SPACE, "preserve")


def _set_color(r: ET.Element, color: str) -> None:
    props = r.find(f"{_W}rPr")
    if props is None:
        props = ET.Element(f"{_W}rPr")
        r.insert(0, props)
    e = props.find(f"{_W}color")
    if e is None:
        e = ET.SubElement(props, f"{_W}color")
    e.set(f"{_W}val", color)


def rewrite(content: bytes, changed: dict[int, list[dict]]) -> bytes:
    """The document with the runs of some paragraphs (by para_idx) replaced by pieces: run_idx of the
    run whose format a piece copies, text, color. Everything else stays as it is."""
    src = zipfile.ZipFile(io.BytesIO(content))
    root = ET.fromstring(src.read(BODY))
    for i, (_, p) in enumerate(_elements(root)):
        if i not in changed:
            continue
        parent = {c: e for e in p.iter() for c in e}
        pieces: dict[int, list[dict]] = {}
        for piece in changed[i]:
            pieces.setdefault(piece["run_idx"], []).append(piece)
        for k, r in enumerate(_runs(p)):
            own = pieces.get(k, [])
            if len(own) < 2 and all(x["text"] == _run_text(r) for x in own):
                continue
            home, color = parent[r], _format(r)["color"]
            at = list(home).index(r)
            home.remove(r)
            for n, x in enumerate(own):
                new = copy.deepcopy(r)
                _set_text(new, x["text"])
                if x.get("color") and x["color"] != color:
                    _set_color(new, x["color"])
                home.insert(at + n, new)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in src.infolist():
            z.writestr(item, ET.tostring(root, encoding="utf-8", xml_declaration=True) if item.filename == BODY else src.read(item.filename))
    return out.getvalue()


def without_blank(content: bytes) -> tuple[bytes, int]:
    """The document without its blank body paragraphs, and how many there were."""
    src = zipfile.ZipFile(io.BytesIO(content))
    root = ET.fromstring(src.read(BODY))
    body = root.find(f"{_W}body")
    blank = [p for p in body.findall(f"{_W}p") if not "".join(map(_run_text, _runs(p))).strip()]
    for p in blank:
        body.remove(p)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in src.infolist():
            z.writestr(item, ET.tostring(root, encoding="utf-8", xml_declaration=True) if item.filename == BODY else src.read(item.filename))
    return out.getvalue(), len(blank)


def build(paragraphs: list[dict], table: list[list[str]] | None = None) -> bytes:
    """A small document: paragraphs of style and runs (text, bold), and a table of texts."""
    root = ET.Element(f"{_W}document")
    body = ET.SubElement(root, f"{_W}body")

    def add(home: ET.Element, style: str | None, runs: list[dict]) -> None:
        p = ET.SubElement(home, f"{_W}p")
        if style:
            ET.SubElement(ET.SubElement(p, f"{_W}pPr"), f"{_W}pStyle").set(f"{_W}val", style)
        for run in runs:
            r = ET.SubElement(p, f"{_W}r")
            if run.get("bold"):
                ET.SubElement(ET.SubElement(r, f"{_W}rPr"), f"{_W}b")
            _set_text(r, run["text"])

    for p in paragraphs:
        add(body, p.get("style"), p["runs"])
    if table:
        t = ET.SubElement(body, f"{_W}tbl")
        for row in table:
            tr = ET.SubElement(t, f"{_W}tr")
            for text in row:
                add(ET.SubElement(tr, f"{_W}tc"), None, [{"text": text}])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(BODY, ET.tostring(root, encoding="utf-8", xml_declaration=True))
    return out.getvalue()


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            rows = pd.DataFrame(parse(content), columns=["para_idx", "section", "style", "text", "runs"])
            rows.insert(0, "doc_id", _name(path))
            yield rows


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of a document, or of all documents of a folder (not its subfolders), from any file
    system Spark reads; one task a file."""
    return parsed(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content"))


def parsed(files: DataFrame) -> DataFrame:
    """Paragraphs of documents given as path and content."""
    return files.mapInPandas(_parsed, PARAGRAPHS)


def cleaned(files: DataFrame) -> DataFrame:
    """Documents (path, content) without their blank body paragraphs: doc_id, content, removed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [without_blank(c) for c in b["content"]]
            yield pd.DataFrame({"doc_id": [_name(p) for p in b["path"]], "content": [c for c, _ in rows], "removed": [n for _, n in rows]})

    return files.mapInPandas(run, "doc_id string, content binary, removed int")


def write_docx(spark: SparkSession, path: str, changed: DataFrame) -> DataFrame:
    """doc_id and content of the documents under ``path``, rebuilt from ``changed`` (doc_id, para_idx,
    runs_out). Documents meet their changed paragraphs by doc_id; both belong to one document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), "content")
    edits = changed.groupBy("doc_id").agg(F.collect_list(F.struct("para_idx", "runs_out")).alias("paras"))

    def rebuilt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = [c if p is None else rewrite(c, {x["para_idx"]: list(x["runs_out"]) for x in p}) for c, p in zip(b["content"], b["paras"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": new})

    return files.join(edits, "doc_id", "left").mapInPandas(rebuilt, "doc_id string, content binary")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        if os.path.isdir(self.path):
            return [_File(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".docx")]
        return [_File(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            rows = parse(f.read())
        order = ["run_idx", "text", "bold", "italic", "underline", "font", "size", "color", "highlight", "style"]
        for r in rows:
            yield (_name(partition.path), r["para_idx"], r["section"], r["style"], r["text"], [tuple(x[k] for k in order) for x in r["runs"]])


class DocxSource(DataSource):
    """``spark.dataSource.register(DocxSource)``, then ``spark.read.format("docx").load(path)``: for
    paths that workers can open; ``read_docx`` takes any file system."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return PARAGRAPHS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])
