import io
import zipfile
import zlib

import pytest

from findgrain.sources import documents as d
from findgrain.sources import files


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


DOCX = zipped(word__document_xml='<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Zebra</w:t><w:tab/><w:t xml:space="preserve">fish é</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t><w:br/><w:t>lines</w:t></w:r></w:p></w:body></w:document>')
ODT = zipped(content_xml='<o:d xmlns:o="o" xmlns:t="t"><o:body><t:h>Head</t:h><t:p>one <t:span>two</t:span> three<t:tab/>x<t:line-break/>y</t:p></o:body></o:d>')
RTF = rb"{\rtf1{\fonttbl{\f0 Arial;}}{\*\generator x}Hello \b world\b0\par caf\'e9 \u8364? end\{x\}}"


def pdf(body, head=b"", filtered=True):
    body = zlib.compress(body) if filtered else body
    name = b"/Filter /FlateDecode" if filtered else b""
    return b"%PDF-1.4\n" + head + b"1 0 obj\n<< /Length 9 " + name + b" >>\nstream\n" + body + b"\nendstream\nendobj"


PAGE = b"BT /F1 12 Tf 72 700 Td (Zebra \\(fish\\) \\351) Tj 0 -14 Td [(wal) -20 (rus) -300 (two)] TJ T* <414243> Tj ET"


def test_texts_of_each_format():
    assert d.rich_text("a.docx", DOCX) == "Zebra\tfish é\ntwo\nlines"
    assert d.rich_text("a.odt", ODT) == "Head\none two three\tx\ny"
    assert d.rich_text("a.rtf", RTF) == "Hello world\ncafé € end{x}"
    for filtered in (True, False):
        assert d.pdf_text("a.pdf", pdf(PAGE, filtered=filtered)) == "Zebra (fish) é\nwalrus two\nABC"


@pytest.mark.parametrize("data", [b"", b"PK", b"junk", b"%PDF-1.4", pdf(b"BT (x) Tj ET", b"/Encrypt 1"), pdf(b"no text"), b"%PDF-1.4\n<< /Filter /FlateDecode >>\nstream\nbroken\nendstream", b"{\\rtf1", b"}}}{"])
def test_what_has_no_text(data):
    assert d.pdf_text("x", data) == ""
    try:
        assert d.rich_text("x", data) == ""
    except zipfile.BadZipFile:
        pass


def test_extraction_goes_on_after_failures(spark, tmp_path):
    for name, data in (("a.docx", DOCX), ("b.rtf", RTF), ("c.pdf", pdf(PAGE)), ("bad.docx", b"PK broken"), ("slow.doc", b"x"), ("t.txt", b"text"), (".env", b"SECRET=1"), ("k.pem", b"SECRET"), ("n.txt", b"a\0b")):
        (tmp_path / name).write_bytes(data)

    def rich(path, data):
        if "slow" in path:
            import time

            time.sleep(30)
        return d.rich_text(path, data)

    scope = files.Scope(roots=[str(tmp_path)], index_hidden=True)
    rows = files.extract(files.scan(spark, scope), {"rich": rich}, timeout_s=1.0).where("not is_dir").collect()
    got = {r["path"].rpartition("/")[2]: r["content"] for r in rows}
    assert got.pop("c.pdf").startswith("Zebra (fish)") and got.pop("a.docx").startswith("Zebra\t") and got.pop("b.rtf").startswith("Hello")
    assert got == {"bad.docx": "", "slow.doc": "", "t.txt": "text", ".env": "", "k.pem": "", "n.txt": ""}
    # a limit reads no more than it, and says whether that may be all
    (tmp_path / "t.txt").write_bytes(b"x" * 10)
    for limit, full in ((9, False), (10, False), (11, True)):
        row = files.extract(files.scan(spark, scope).where("path like '%/t.txt'"), limit=limit).first()
        assert (len(row["content"]), row["full"]) == (min(limit, 10), full)


def test_scan_of_missing_roots(spark, tmp_path):
    scope = files.Scope(roots=[str(tmp_path / "none"), str(tmp_path / "some")])
    assert files.scan(spark, scope).count() == 0 and files.readable_roots(spark, scope) == []
    (tmp_path / "some").mkdir()
    (tmp_path / "some" / "a.txt").write_text("x")
    assert [r["path"].rpartition("/")[2] for r in files.scan(spark, scope).where("not is_dir").collect()] == ["a.txt"]
    assert len(files.readable_roots(spark, scope)) == 1
