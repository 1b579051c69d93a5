"""PDF text by whichever parser is installed, else by :mod:`pdf_text`."""

from __future__ import annotations

import importlib
import io
from collections.abc import Callable

from siltstone.sources import pdf_text


def _pages(module, data: bytes) -> str:
    return "".join(p.extract_text() or "" for p in module.PdfReader(io.BytesIO(data)).pages)


def _whole(module, data: bytes) -> str:
    return module.extract_text(io.BytesIO(data)) or ""


#: Module and how it gives a document's text, in order of preference.
KNOWN = [("pypdf", _pages), ("PyPDF2", _pages), ("pdfminer.high_level", _whole)]


def _installed() -> Callable[[bytes], str] | None:
    for name, text in KNOWN:
        try:
            module = importlib.import_module(name)
        except ImportError:
            continue
        return lambda data: text(module, data)
    return None


def parser(own: bool = False) -> Callable[[bytes], str]:
    """Text of a PDF's bytes, for :func:`siltstone.sources.papers.first_text`; it raises on what it cannot
    read, and the next attachment is tried. An installed library is found anew in each worker; without one, or
    if asked to, the package's own reader is taken."""
    if own:
        return pdf_text.text_of
    return lambda data: (_installed() or pdf_text.text_of)(data)
