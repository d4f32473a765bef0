"""Text of PDF files, read without a PDF library.

What it reads: objects in the file and in object streams, pages in the order of the page tree, content
streams that are plain or deflated, literal and hexadecimal strings, and the ToUnicode tables of fonts.
Encrypted files and other compressions give no text; a page that can't be read is left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"^(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s\[\]()<>/]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\(\d{1,3}|\r\n|[\s\S])")
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Document:
    """The objects of a file by number: dictionary part and stream."""

    def __init__(self, raw: bytes) -> None:
        self.objects: dict[int, tuple[bytes, bytes]] = {}
        for m in _OBJECT.finditer(raw):
            head, body = m[2], b""
            if found := _STREAM.match(m[2]):
                head, body = found[1], self._open(found[1], found[2])
            self.objects[int(m[1])] = (head, body)
        for head, body in list(self.objects.values()):
            if b"/ObjStm" in head:
                self._unpack(head, body)

    @staticmethod
    def _open(head: bytes, body: bytes) -> bytes:
        if b"/FlateDecode" not in head:
            return b"" if b"/Filter" in head else body
        try:
            return zlib.decompressobj().decompress(body)
        except zlib.error:
            return b""

    def _unpack(self, head: bytes, body: bytes) -> None:
        first = int(re.search(rb"/First\s+(\d+)", head)[1])
        numbers = [int(x) for x in body[:first].split()]
        places = list(zip(numbers[::2], numbers[1::2]))
        for (key, at), end in zip(places, [*(p for _, p in places[1:]), len(body) - first]):
            self.objects.setdefault(key, (body[first + at : first + end], b""))

    def head(self, key: int) -> bytes:
        return self.objects.get(key, (b"", b""))[0]

    def pages(self) -> Iterator[int]:
        """Page objects in the order of the tree; in that of their numbers where there is no tree."""
        roots = [k for k, (h, _) in self.objects.items() if re.search(rb"/Type\s*/Pages\b", h) and b"/Parent" not in h]
        seen: set[int] = set()
        todo = roots[::-1] or sorted((k for k, (h, _) in self.objects.items() if re.search(rb"/Type\s*/Page\b", h)), reverse=True)
        while todo:
            key = todo.pop()
            if key in seen:
                continue
            seen.add(key)
            if kids := re.search(rb"/Kids\s*\[(.*?)\]", self.head(key), re.S):
                todo += [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", kids[1])][::-1]
            elif re.search(rb"/Type\s*/Page\b", self.head(key)):
                yield key

    def _named(self, head: bytes, name: bytes) -> bytes:
        """A dictionary under a name, given in place or by reference."""
        if found := re.search(rb"/" + name + rb"\s+(\d+)\s+\d+\s+R", head):
            return self.head(int(found[1]))
        if not (found := re.search(rb"/" + name + rb"\s*<<", head)):
            return b""
        depth = 1
        for m in re.finditer(rb"<<|>>", head[found.end() :]):
            depth += 1 if m[0] == b"<<" else -1
            if not depth:
                return head[found.end() : found.end() + m.start()]
        return b""

    def tables(self, page: int) -> dict[bytes, dict[int, str]]:
        """Codes to text for each font of a page that has such a table."""
        head = self.head(page)
        resources = self._named(head, b"Resources") or head
        fonts = self._named(resources if b"/Font" in resources else head, b"Font")
        out = {}
        for name, key in re.findall(rb"/(\S+)\s+(\d+)\s+\d+\s+R", fonts):
            if to := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", self.head(int(key))):
                out[name] = _code_table(self.objects.get(int(to[1]), (b"", b""))[1])
        return out

    def text(self, page: int) -> str:
        found = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+)\s+\d+\s+R)", self.head(page), re.S)
        if not found:
            return ""
        keys = [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", found[1])] if found[1] is not None else [int(found[2])]
        return content_text(b"\n".join(self.objects.get(k, (b"", b""))[1] for k in keys), self.tables(page))


def _code_table(body: bytes) -> dict[int, str]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out |= {k: chr(int(c, 16) + k - int(a, 16)) for k in range(int(a, 16), min(int(b, 16), int(a, 16) + 65_535) + 1)}
    return out


def _string(token: bytes, table: dict[int, str] | None) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1].isspace() else _NAMED.get(m[1], m[1]), token[1:-1])
    if not table:
        return raw.decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    wide = 2 if max(table, default=0) > 255 or token[:1] == b"<" and len(raw) % 2 == 0 and not any(b in table for b in raw[:1]) else 1
    return "".join(table.get(int.from_bytes(raw[i : i + wide], "big"), "") for i in range(0, len(raw), wide))


def content_text(content: bytes, tables: dict[bytes, dict[int, str]]) -> str:
    """What a content stream shows: strings in order, a blank for a wide gap, a line end for a new line."""
    out: list[str] = []
    held: list[bytes] = []
    font = None
    for m in _TOKEN.finditer(content):
        token = m[0]
        if token[:1] in b"(<[]/" or token[:1] in b"+-.0123456789":
            held.append(token)
            continue
        shown = [x for x in held if x[:1] in b"(<" or token == b"TJ"]
        if token == b"Tf":
            font = next((x[1:] for x in held if x[:1] == b"/"), font)
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in b"'\"":
                out.append("\n")
            for x in shown:
                if x[:1] in b"(<":
                    out.append(_string(x, tables.get(font)))
                elif x[:1] in b"+-.0123456789" and float(x) < -200:
                    out.append(" ")
        elif token in (b"T*", b"ET") or token in (b"Td", b"TD") and held and float(held[-1] if held[-1][:1] not in b"([</]" else 0) or token == b"Tm":
            out.append("\n")
        held = []
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def pdf_text(raw: bytes | None, pages: int | None = None, page_chars: int | None = None) -> str:
    """The text of each page under a heading ``## Page n``; at most ``pages`` pages and ``page_chars`` characters of each, if given."""
    if not raw or b"%PDF-" not in raw[:1024] or b"/Encrypt" in raw:
        return ""
    document = Document(raw)
    parts = []
    for n, key in enumerate(document.pages(), 1):
        if pages is not None and n > pages:
            break
        try:
            text = document.text(key)
        except (ValueError, IndexError, TypeError):  # a page that can't be read
            text = ""
        if text:
            parts.append(f"## Page {n}\n\n{text[:page_chars]}")
    return "\n\n".join(parts)


def pdf_texts(files: DataFrame, pages: int | None = None, page_chars: int | None = None) -> DataFrame:
    """id and text of each of ``files`` (id, content); null content and what is no PDF give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pdf_text(x, pages, page_chars) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return files.select("id", "content").mapInArrow(run, f"id {files.schema['id'].dataType.simpleString()}, text string")
