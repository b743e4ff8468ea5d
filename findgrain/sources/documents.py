"""Text of word-processor, RTF and PDF files, by the formats' own rules."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

#: Bytes of XML that a file may unfold to.
LARGEST_XML = 200 << 20


def _paragraphs(xml: bytes, paragraph: tuple[str, ...], text: tuple[str, ...], blanks: dict[str, str]) -> str:
    """Text of an XML document: a line a paragraph, blanks for their own elements."""
    out: list[str] = []
    for event, node in ElementTree.iterparse(io.BytesIO(xml), ("start", "end")):
        name = node.tag.rpartition("}")[2]
        if event == "start":
            if name in blanks:
                out.append(blanks[name])
            continue
        if name in text and node.text:
            out.append(node.text)
        if name in paragraph:
            out.append("\n")
    return "".join(out)


def _member(archive: zipfile.ZipFile, name: str) -> bytes:
    if archive.getinfo(name).file_size > LARGEST_XML:
        raise ValueError("too large")
    return archive.read(name)


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        return _paragraphs(_member(archive, "word/document.xml"), ("p",), ("t",), {"tab": "\t", "br": "\n", "cr": "\n"}).strip()


def odt_text(data: bytes) -> str:
    """Text of an OpenDocument file; its text stands between elements, so all of a paragraph's counts."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(_member(archive, "content.xml"))
    out = []
    for node in root.iter():
        if node.tag.rpartition("}")[2] not in ("p", "h"):
            continue
        line = []

        def walk(n):
            line.append({"tab": "\t", "line-break": "\n", "s": " "}.get(n.tag.rpartition("}")[2], ""))
            line.append(n.text or "")
            for child in n:
                walk(child)
                line.append(child.tail or "")

        walk(node)
        out.append("".join(line))
    return "\n".join(out).strip()


_RTF = re.compile(rb"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
#: Groups of an RTF file that hold no text of the document.
_RTF_ASIDE = {b"fonttbl", b"colortbl", b"stylesheet", b"info", b"pict", b"header", b"footer", b"generator", b"themedata", b"listtable", b"rsidtbl", b"xmlnstbl"}
_RTF_MARKS = {b"par": "\n", b"line": "\n", b"tab": "\t", b"emdash": "—", b"endash": "–", b"lquote": "‘", b"rquote": "’", b"ldblquote": "“", b"rdblquote": "”", b"bullet": "•"}


def rtf_text(data: bytes) -> str:
    out: list[str] = []
    stack, aside = [], False
    for m in _RTF.finditer(data):
        byte, code, word, _, mark, brace, text = m.groups()
        if brace == b"{":
            stack.append(aside)
        elif brace == b"}":
            aside = stack.pop() if stack else False
        elif word in _RTF_ASIDE or mark == b"*":
            aside = True
        elif aside:
            continue
        elif byte:
            out.append(bytes.fromhex(byte.decode()).decode("cp1252", "replace"))
        elif code:
            out.append(chr(int(code) % 65536))
        elif word:
            out.append(_RTF_MARKS.get(word, ""))
        elif mark in (b"\\", b"{", b"}"):
            out.append(mark.decode())
        elif mark == b"~":
            out.append("\u00a0")
        elif text:
            out.append(text.decode("cp1252", "replace"))
    return "".join(out).strip()


def rich_text(path: str, data: bytes) -> str:
    """Text of a word-processor file by what it holds; an old binary ``.doc`` has none here."""
    if data[:5] == b"{\\rtf":
        return rtf_text(data)
    if data[:2] != b"PK":
        return ""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
    return docx_text(data) if "word/document.xml" in names else odt_text(data) if "content.xml" in names else ""


_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\(((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)|<([0-9A-Fa-f\s]+)>|(-?\d+(?:\.\d+)?)|\b(Tj|TJ|T\*|Td|TD|Tm|ET)|(['\"])")
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _pdf_string(raw: bytes) -> str:
    def plain(m: re.Match) -> bytes:
        c = m.group(1)
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else b"" if c in (b"\n", b"\r\n") else _PLAIN.get(c, c)

    data = _ESCAPED.sub(plain, raw)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def pdf_text(path: str, data: bytes) -> str:
    """The text layer of a PDF whose fonts use a plain encoding: strings shown by its content streams, a line a move to a new line.

    Streams are read as they are or inflated; fonts with an encoding of their own, encrypted files and scans give no text.
    """
    if data[:5] != b"%PDF-" or b"/Encrypt" in data:
        return ""
    out: list[str] = []
    for head, body in _STREAM.findall(data):
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body, LARGEST_XML)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        if b"BT" not in body:
            continue
        line: list[str] = []
        for m in _SHOWN.finditer(body):
            shown, coded, number, op, quote = m.groups()
            if shown is not None:
                line.append(_pdf_string(shown))
            elif coded is not None:
                raw = bytes.fromhex("".join(coded.decode().split()).ljust(2, "0")) if len("".join(coded.decode().split())) % 2 == 0 else b""
                line.append(raw.decode("cp1252", "replace"))
            elif number is not None and line and float(number) < -200:
                # a wide gap inside a shown array is a blank
                line.append(" ")
            elif op in (b"T*", b"Td", b"TD", b"Tm", b"ET") or quote:
                if any(x.strip() for x in line):
                    out.append("".join(line))
                line = []
    text = "\n".join(out)
    return text if sum(c.isprintable() or c.isspace() for c in text) >= 0.8 * len(text) else ""


#: What reads which kind of file.
EXTRACTORS = {"pdf": pdf_text, "rich": rich_text}
