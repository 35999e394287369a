"""Small office and mind-map files, as bytes, to try the readers on."""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape

_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def _core(author: str = "", title: str = "", created: str = "", modified: str = "") -> str:
    said = {"dc:creator": author, "dc:title": title, "dcterms:created": created, "dcterms:modified": modified}
    return '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/">' + "".join(f"<{k}>{escape(v)}</{k}>" for k, v in said.items() if v) + "</cp:coreProperties>"


def docx(paragraphs: list[tuple[str, str]], tables: list[list[list[str]]] = (), **core: str) -> bytes:
    """Paragraphs of (style, text), then tables of rows of cells."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda style, text: "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "") + f'<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'
    body = "".join(p(*x) for x in paragraphs)
    body += "".join("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p('', c)}</w:tc>" for c in row) + "</w:tr>" for row in t) + "</w:tbl>" for t in tables)
    return _zip({"[Content_Types].xml": _TYPES, "word/document.xml": f"<w:document {ns}><w:body>{body}</w:body></w:document>", "docProps/core.xml": _core(**core)})


def pptx(slides: list[tuple[str, list[str], str]], **core: str) -> bytes:
    """Slides of (title, bodies, notes)."""
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shape = lambda ph, text: f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in text.split(chr(10)))}</p:txBody></p:sp>'
    links = lambda x: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{kind}/{k}" Target="{t}"/>' for i, k, t in x) + "</Relationships>"
    parts = {"[Content_Types].xml": _TYPES, "docProps/core.xml": _core(**core)}
    parts["ppt/presentation.xml"] = f"<p:presentation {ns}><p:sldIdLst>" + "".join(f'<p:sldId id="{255 + i}" r:id="r{i}"/>' for i in range(1, len(slides) + 1)) + "</p:sldIdLst></p:presentation>"
    parts["ppt/_rels/presentation.xml.rels"] = links((f"r{i}", "slide", f"slides/slide{i}.xml") for i in range(1, len(slides) + 1))
    for i, (title, bodies, notes) in enumerate(slides, 1):
        tree = (shape('<p:ph type="title"/>', title) if title else "") + "".join(shape("", b) for b in bodies)
        parts[f"ppt/slides/slide{i}.xml"] = f"<p:sld {ns}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>"
        if notes:
            parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = links([("n", "notesSlide", f"../notesSlides/notes{i}.xml")])
            parts[f"ppt/notesSlides/notes{i}.xml"] = f"<p:notes {ns}><p:cSld><p:spTree>{shape('<p:ph type=' + chr(34) + 'body' + chr(34) + '/>', notes)}</p:spTree></p:cSld></p:notes>"
    return _zip(parts)


def xmind_json(sheets: list[dict], creator: str = "") -> bytes:
    return _zip({"content.json": json.dumps(sheets), "meta.json": json.dumps({"creator": {"name": creator}} if creator else {})})


def xmind_xml(sheets: str) -> bytes:
    return _zip({"content.xml": f'<xmap-content xmlns="urn:xmind:xmap:xmlns:content:2.0">{sheets}</xmap-content>'})
