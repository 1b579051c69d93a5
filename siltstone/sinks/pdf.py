"""Texts as small PDF files, for attachments that go to readers of PDF only."""

from __future__ import annotations

import zlib

import numpy as np


def _unicode_map(codes: set[int]) -> bytes:
    """A ToUnicode map that gives each code of 16 bits as it is, in runs."""
    runs: list[list[int]] = []
    for c in sorted(codes):
        if runs and runs[-1][1] == c - 1 and c % 256:  # a run may not pass the first byte's end
            runs[-1][1] = c
        else:
            runs.append([c, c])
    parts = [runs[i : i + 100] for i in range(0, len(runs), 100)]
    body = "".join(f"{len(p)} beginbfrange\n" + "".join(f"<{a:04X}> <{b:04X}> <{a:04X}>\n" for a, b in p) + "endbfrange\n" for p in parts)
    return f"begincmap\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n{body}endcmap\n".encode()


def as_pdf(text: str, lines: int = 50, compress: bool = True) -> bytes:
    """A PDF with the text's lines, ``lines`` of them a page, in a composite font with a map to Unicode."""
    rows = text.split("\n")
    pages = [rows[i : i + lines] for i in range(0, len(rows), lines)]
    raw = text.encode("utf-16-be")
    codes = set(np.frombuffer(raw, ">u2").tolist())
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(data: bytes) -> int:
        data = zlib.compress(data) if compress else data
        return add(b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" * compress, data))

    below = add(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Plain /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> >>")
    font = add(b"<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (below, stream(_unicode_map(codes))))
    kids = []
    for i, page in enumerate(pages):
        shown = [b"<%s> Tj" % row.encode("utf-16-be").hex().encode() for row in page] + [b"<> Tj"] * (i < len(pages) - 1)  # the break between pages
        content = stream(b"BT /F1 11 Tf 12 TL 50 780 Td\n" + b"\nT* ".join(shown) + b"\nET")
        kids.append(add(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 %d 0 R >> >> /Contents %d 0 R >>" % (font, content)))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = bytearray(b"%PDF-1.7\n"), []
    for i, body in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i + 1, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table))
