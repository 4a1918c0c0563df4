import zlib

import pytest

from spanloom.sources import pdf, readers


def made(contents, deflate=False, packed=False, more=b""):
    """A PDF file of pages with these content streams."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(contents)), 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>" + more}
    streams = {}
    for i, c in enumerate(contents):
        plain[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % (11 + 2 * i)
        data = zlib.compress(c) if deflate else c
        streams[11 + 2 * i] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if deflate else b"", data)
    if packed:
        body, places = b"", []
        for n, x in plain.items():
            places += [n, len(body)]
            body += x + b" "
        head = b" ".join(b"%d" % p for p in places) + b" "
        data = zlib.compress(head + body)
        streams[90] = b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(plain), len(head), len(data), data)
        plain = {}
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in [*plain.items(), *streams.items()]) + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGES = [
    b"BT /F1 12 Tf 72 700 Td (Patient Rao \\(male\\)) Tj 0 -14 Td [(SSN 123) -20 (-45-6789) -300 (seen)] TJ ET",
    b"BT <4D524E203132333435> Tj T* (caf\\351 endobj) Tj ET",
    b"0 0 10 10 re f",
]
TEXTS = ["Patient Rao (male)\nSSN 123-45-6789 seen", "MRN 12345\ncafé endobj", ""]


@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("packed", [False, True])
def test_texts_of_pages(deflate, packed):
    assert pdf.page_texts(made(PAGES, deflate, packed)) == TEXTS


@pytest.mark.parametrize(
    "data,why",
    [(b"x", "not a PDF"), (made(PAGES) + b"/Encrypt 5 0 R", "encrypted"), (made(PAGES, more=b"/Subtype /Type0"), "composite"), (b"%PDF-1.4\n", "no page tree"), (made([b"x"]).replace(b"/Length 1 ", b"/Length 1 /Filter /LZWDecode "), "LZWDecode")],
)
def test_what_is_not_read_raises(data, why):
    with pytest.raises(ValueError, match=why):
        pdf.page_texts(data)


def test_from_files_to_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made(PAGES, True))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "c.pdf").write_bytes(b"")
    files = readers.intake(readers.pdf_files(spark, str(tmp_path)))
    got = readers.extract_pages(files.where("rejected is null"), pdf.page_texts).collect()
    assert sorted((r["doc_name"].rsplit("/", 1)[1], r["page_number"], r["text"], r["page_status"]) for r in got) == [("a.pdf", i + 1, t, "NATIVE") for i, t in enumerate(TEXTS)] + [("b.pdf", 0, "", "FAILED: ValueError")]
