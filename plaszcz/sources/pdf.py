"""PDF pages, by an optional library. Without it every call fails with a clear error."""

from __future__ import annotations

import io

from .ooxml import PackageError, Unit


def _library():
    try:
        import fitz
    except ImportError as e:
        raise PackageError("PDF files need PyMuPDF, which is not installed") from e
    return fitz


def page_units(data: bytes) -> list[Unit]:
    """One unit a page."""
    with _library().open(stream=data, filetype="pdf") as doc:
        return [Unit("page", f"page{i}", str(i), page.get_text()) for i, page in enumerate(doc)]


def full_text(data: bytes) -> str:
    """All pages' text, a line feed between."""
    return "\n".join(u.text for u in page_units(data))


def first_box(data: bytes, page_no: int, value: str) -> tuple[float, float, float, float] | None:
    """The first place of a value on a page."""
    with _library().open(stream=data, filetype="pdf") as doc:
        found = doc[page_no].search_for(value)
        return tuple(found[0]) if found else None


def signatures(data: bytes) -> list[dict]:
    """Signed signature fields with their place."""
    with _library().open(stream=data, filetype="pdf") as doc:
        return [{"page": i, "bbox": list(w.rect), "field_name": w.field_name} for i, page in enumerate(doc) for w in page.widgets() or [] if w.field_type_string == "Signature" and w.is_signed]


def remove_signatures(data: bytes) -> bytes:
    """Without digital signatures; PackageError unless none is left."""
    try:
        import pikepdf
    except ImportError as e:
        raise PackageError("signed PDF files need pikepdf, which is not installed") from e
    out = io.BytesIO()
    try:
        with pikepdf.open(io.BytesIO(data)) as pdf:
            if not pdf.acroform.exists:
                raise PackageError("a signed file has no form")
            pdf.acroform.disable_digital_signatures()
            pdf.save(out)
    except PackageError:
        raise
    except Exception as e:
        raise PackageError(f"signatures cannot be removed: {e}") from e
    if not out.getvalue() or signatures(out.getvalue()):
        raise PackageError("signatures are left")
    return out.getvalue()


def redact(data: bytes, replacements: dict[str, str]) -> bytes:
    """Every occurrence of the values, trimmed, is covered in white under its marker; images stay, signatures go."""
    fitz = _library()
    if signatures(data):
        data = remove_signatures(data)
    with fitz.open(stream=data, filetype="pdf") as doc:
        for page in doc:
            for raw, marker in replacements.items():
                for box in page.search_for(raw.strip()) if raw.strip() else []:
                    page.add_redact_annot(box, text=marker, fill=(1, 1, 1), fontsize=max(4, 0.75 * box.height))
            page.apply_redactions(images=0)
        return doc.tobytes(garbage=4, deflate=True)


def strip_metadata(data: bytes) -> bytes:
    """Without document information and XMP; a file that has neither stays as it is."""
    with _library().open(stream=data, filetype="pdf") as doc:
        if not any(v for k, v in (doc.metadata or {}).items() if k not in ("format", "encryption")) and not doc.get_xml_metadata():
            return data
        doc.set_metadata({})
        doc.del_xml_metadata()
        return doc.tobytes(garbage=4, deflate=True)
