"""Word files: text of paragraphs and tables, and rewriting with the runs kept."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(node) -> str:
    parts = {f"{W}t": lambda n: n.text or "", f"{W}tab": lambda n: "\t", f"{W}br": lambda n: "\n"}
    return "".join(parts[n.tag](n) for n in node.iter() if n.tag in parts)


def text_of(data: bytes) -> str:
    """Filled paragraphs, then the rows of tables with cells joined by bars, a line each."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    lines = [t for p in body.findall(f"{W}p") if (t := _text(p).strip())]
    for table in body.findall(f"{W}tbl"):
        for row in table.findall(f"{W}tr"):
            cells = ["\n".join(_text(p) for p in cell.findall(f"{W}p")).strip() for cell in row.findall(f"{W}tc")]
            lines.append(" | ".join(cells))
    return "\n".join(lines)


def parser():
    """For ``parse_with``: a Word file is one page."""
    return lambda data: [text_of(data)]


def placed(text: str, mapping: dict[str, str]) -> list[tuple[int, int, str]]:
    """Matches of all keys that don't overlap: leftmost, of equal starts the longest."""
    found = sorted((m.start(), -len(k), m.end(), v) for k, v in mapping.items() if k for m in re.finditer(re.escape(k), text))
    out: list[tuple[int, int, str]] = []
    for start, _, end, value in found:
        if not out or start >= out[-1][1]:
            out.append((start, end, value))
    return out


def rewrite_runs(runs: list[str], mapping: dict[str, str]) -> tuple[list[str], int]:
    """(the runs of a paragraph with matches replaced, how many); a replacement goes to the run that held most of the match."""
    text = "".join(runs)
    owner = [k for k, run in enumerate(runs) for _ in run]
    out: list[list[str]] = [[] for _ in runs]
    at, found = 0, placed(text, mapping)
    for start, end, value in [*found, (len(text), len(text), "")]:
        for k in range(at, start):
            out[owner[k]].append(text[k])
        if start < end:
            held = owner[start:end]
            out[max(sorted(set(held)), key=held.count)].append(value)
        at = end
    return ["".join(x) for x in out], len(found)


def rewrite(data: bytes, mapping: dict[str, str]) -> tuple[bytes, int]:
    """(the file with texts replaced in body, tables, headers and footers, how many)."""
    total, out = 0, io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for item in z.infolist():
            content = z.read(item)
            if re.fullmatch(r"word/(document|header\d*|footer\d*)\.xml", item.filename):
                root = ElementTree.fromstring(content)
                for paragraph in root.iter(f"{W}p"):
                    nodes = [t for r in paragraph.iter(f"{W}r") for t in r.findall(f"{W}t")]
                    new, n = rewrite_runs([t.text or "" for t in nodes], mapping)
                    total += n
                    for node, value in zip(nodes, new):
                        node.text = value
                        node.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                content = ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)
            w.writestr(item, content)
    return out.getvalue(), total
