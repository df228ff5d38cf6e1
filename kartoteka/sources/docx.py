"""Text of DOCX files, read part by part and element by element, within bounds of what a file may inflate to."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Bytes of XML that a file may inflate to, cells that its tables may have (a cell over several columns counts for each), and
#: characters of their texts.
MOST_BYTES = 128 << 20
MOST_CELLS = 500_000
MOST_CHARS = 32 << 20


class TooLarge(ValueError):
    """A file beyond the bounds."""


class _Budget:
    def __init__(self, bytes_: int, cells: int, chars: int):
        self.left = {"bytes of XML": bytes_, "table cells": cells, "characters in tables": chars}
        self.most = dict(self.left)

    def take(self, what: str, n: int) -> None:
        self.left[what] -= n
        if self.left[what] < 0:
            raise TooLarge(f"more than {self.most[what]} {what}")


class _Part(io.RawIOBase):
    """A part as a stream that counts what it gives."""

    def __init__(self, part, budget: _Budget):
        self.part, self.budget = part, budget

    def read(self, n: int = -1) -> bytes:
        data = self.part.read(n if n and n > 0 else 1 << 16)
        self.budget.take("bytes of XML", len(data))
        return data


def _elements(z: zipfile.ZipFile, name: str, budget: _Budget) -> Iterator[tuple[ET.Element, list[ET.Element]]]:
    """Each element when it is whole, with those that it stands in. What stood in it is there unless it was cleared."""
    stack: list[ET.Element] = []
    with z.open(name) as part:
        for event, e in ET.iterparse(_Part(part, budget), ("start", "end")):
            if event == "start":
                stack.append(e)
            else:
                stack.pop()
                yield e, stack


def _paragraph(p: ET.Element) -> str:
    out = []
    for x in p.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out).strip()


def _children(e: ET.Element, tag: str) -> Iterator[ET.Element]:
    """Children of a kind, those in content controls too."""
    for x in e:
        if x.tag == tag:
            yield x
        elif x.tag == f"{_W}sdt":
            for content in x.findall(f"{_W}sdtContent"):
                yield from _children(content, tag)


def _cells(row: ET.Element, above: dict[int, str], budget: _Budget) -> list[str]:
    """A table row's cell texts by grid column: one over several columns or rows stands in each."""
    out, at = [], 0
    for cell in _children(row, f"{_W}tc"):
        span, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
        text = "\n".join(_paragraph(p) for p in cell.findall(f"{_W}p")).strip()
        if merge is not None and merge.get(f"{_W}val", "continue") == "continue":
            text = above.get(at, "")
        wide = max(1, int(span.get(f"{_W}val", "1"))) if span is not None else 1
        budget.take("table cells", wide)
        budget.take("characters in tables", wide * len(text))
        above.update(dict.fromkeys(range(at, at + wide), text))
        out += [text] * wide
        at += wide
    return out


def _in(stack: list[ET.Element], *tags: str) -> bool:
    """Whether an element stands right in the last of the tags, that in the one before and so on; content controls don't count."""
    names = [x.tag for x in stack if x.tag not in (f"{_W}sdt", f"{_W}sdtContent")]
    return names == [f"{_W}{t}" for t in tags]


def _targets(z: zipfile.ZipFile, budget: _Budget) -> dict[str, str]:
    """Parts by relation; a target is relative to the document's folder, or from the package's root."""
    name = "word/_rels/document.xml.rels"
    if name not in z.namelist():
        return {}
    out = {}
    for e, _ in _elements(z, name, budget):
        if e.get("Id") and e.get("Target"):
            t = e.get("Target")
            out[e.get("Id")] = posixpath.normpath(t.lstrip("/") if t.startswith("/") else f"word/{t}")
    return out


def _body(z: zipfile.ZipFile, budget: _Budget) -> tuple[list[str], list[str], list[dict[str, str]]]:
    """Paragraphs, table rows, and for each section the relations of its own header and footer."""
    paragraphs, rows, sections, above = [], [], [], {}
    for e, stack in _elements(z, "word/document.xml", budget):
        if e.tag == f"{_W}sectPr":
            own = {}
            for kind in ("header", "footer"):
                for ref in e.findall(f"{_W}{kind}Reference"):
                    if ref.get(f"{_W}type", "default") == "default":
                        own[kind] = ref.get(f"{_R}id")
            sections.append(own)
        elif e.tag == f"{_W}p" and [x.tag for x in stack] == [f"{_W}document", f"{_W}body"]:
            paragraphs.append(_paragraph(e))
            stack[-1].remove(e)
        elif e.tag == f"{_W}tr" and _in(stack, "document", "body", "tbl"):
            rows.append(" | ".join(c for c in _cells(e, above, budget) if c))
            stack[-1].remove(e)
        elif e.tag == f"{_W}tbl" and _in(stack, "document", "body"):
            above = {}
            stack[-1].remove(e)
    return paragraphs, rows, sections


def text(content: bytes, most_bytes: int = MOST_BYTES, most_cells: int = MOST_CELLS, most_chars: int = MOST_CHARS) -> str:
    """Body paragraphs, then tables as rows of `a | b`, then headers and footers by section; blank ones left out.

    A section without a header or footer of its own has those of the one before.
    """
    budget = _Budget(most_bytes, most_cells, most_chars)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        paragraphs, rows, sections = _body(z, budget)
        targets, now, margins = _targets(z, budget) if sections else {}, {}, {}
        lines = paragraphs + rows
        for own in sections:
            now |= own
            for kind in ("header", "footer"):
                part = targets.get(now.get(kind))
                if part and part not in margins:  # sections share parts
                    root = {"header": "hdr", "footer": "ftr"}[kind]
                    margins[part] = [_paragraph(e) for e, stack in _elements(z, part, budget) if e.tag == f"{_W}p" and _in(stack, root)]
                for line in margins.get(part, []):
                    budget.take("characters in tables", len(line))
                    lines.append(line)
    return "\n".join(x for x in lines if x)
