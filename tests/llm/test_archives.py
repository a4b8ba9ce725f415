"""Archives from elsewhere: records that aren't HTTP, heads without the usual headers, broken lines."""

import gzip
import io

import pytest

from barloom.llm import warc


def test_foreign_archives_are_converted(spark, tmp_path):
    html = b"<p>one</p>"
    blocks = [
        (b"dns:a.example 10.0.0.1 20010203040506 text/dns", b"20010203040506\na.example. 60 IN A 10.0.0.1\n"),
        (b"http://a.example/x y 10.0.0.1 20010203 text/html", b"HTTP/1.0 200 OK\r\nServer:none\r\n\r\n" + html),
        (b"http://a.example/z 10.0.0.1 20010203040507 text/html", b"HTTP/1.1 200 OK\r\n\r\n" + html),
    ]
    raw = warc.arc_version_block(1, "elsewhere") + b"\n" + b"".join(head + b" %d\n" % len(b) + b + b"\n" for head, b in blocks)
    (tmp_path / "IA-001.arc.gz").write_bytes(gzip.compress(raw))
    got = sorted(tuple(r)[:4] for r in warc.warc_rows(spark, warc.arc_to_warc(spark, str(tmp_path))).collect())
    assert [(r[1], r[3]) for r in sorted(got, key=lambda r: r[3])] == [(len(blocks[0][1]), "resource"), (len(html), "response"), (len(html), "revisit")]
    assert len({r[2] for r in got}) == 2


def test_header_lines_with_too_few_fields_are_refused():
    good = warc.arc_version_block(2, "f") + b"\n"
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(good + b"http://x/ 3\nabc\n")))
