import struct

from platen.__main__ import main
from platen.operators import ingest
from platen.sources import files
from platen.store import TableStore


def tiff(make: bytes, model: bytes, order: str = "<") -> bytes:
    entries = [(271, 2, len(make), None, make), (272, 2, len(model), None, model), (306, 2, 4, b"now\0", b"")]
    at, body = 8 + 2 + 12 * 3, b""
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, 3)
    for tag, kind, n, inline, data in entries:
        out += struct.pack(order + "HHI", tag, kind, n) + (inline or struct.pack(order + "I", at + len(body)))
        body += data
    return out + body


def test_headers():
    for order in "<>":
        got = files.header(tiff(b"SONY\0\0", b"ILCE-7M4\0", order))
        assert got == {"camera_make": "SONY", "camera_model": "ILCE-7M4", "taken": "now"}
    for bad in (b"", b"II*\0", b"II*\0\xff\xff\xff\xff", tiff(b"SONY\0\0", b"ILCE-7M4\0")[:30], b"JFIF" * 10):
        assert set(files.header(bad).values()) <= {None, "SONY"}


def test_scan_of_a_folder(spark, tmp_path, capsys):
    root = tmp_path / "cards"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.ARW").write_bytes(tiff(b"SONY\0\0", b"ILCE-7M4\0"))
    (root / "a" / "y.txt").write_bytes(b"no")
    found = files.listing(spark, str(root), contents=True).first()
    assert found.size > 20 and len(found.content_hash) == 64
    assert files.with_metadata(spark, str(root)).first().camera_model == "ILCE-7M4"
    store = TableStore(spark, str(tmp_path / "store"))
    known = files.known(store, f"file:{root}")
    assert [r.action for r in ingest.classified(files.listing(spark, str(root)), known).collect()] == ["added"]


def test_command_line(capsys):
    assert main(["stages"]) == 0 and main(["queries"]) == 0 and main(["schema"]) == 0
    out = capsys.readouterr().out
    assert "Demosaic" in out and "lib_sequence" in out
