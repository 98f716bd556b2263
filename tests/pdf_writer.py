"""Writes small PDF files for tests: classic or compressed objects, any dictionaries."""

import zlib


def dump(x) -> bytes:
    if isinstance(x, dict):
        return b"<<" + b" ".join(b"/" + k.encode() + b" " + dump(v) for k, v in x.items()) + b">>"
    if isinstance(x, list):
        return b"[" + b" ".join(map(dump, x)) + b"]"
    if isinstance(x, bytes):
        return x
    return str(x).encode()


def stream(data: bytes, flate: bool = True, **more) -> tuple[dict, bytes]:
    raw = zlib.compress(data) if flate else data
    return {**more, **({"Filter": b"/FlateDecode"} if flate else {}), "Length": len(raw)}, raw


def build(objects: dict, root: int = 1, info: int | None = None, packed: bool = False, trailer: dict | None = None) -> bytes:
    """objects: number -> dict or list, or (dict, bytes) for a stream. packed: plain objects go into an object stream."""
    out = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
    plain = {n: o for n, o in objects.items() if not isinstance(o, tuple)} if packed else {}
    for n, o in objects.items():
        if n in plain:
            continue
        body = dump(o[0]) + b"\nstream\n" + o[1] + b"\nendstream" if isinstance(o, tuple) else dump(o)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    ends = {"Root": b"%d 0 R" % root} | ({"Info": b"%d 0 R" % info} if info else {}) | (trailer or {})
    if packed:
        parts, heads, at = [], [], 0
        for n, o in plain.items():
            heads.append(f"{n} {at}")
            parts.append(dump(o) + b" ")
            at += len(parts[-1])
        head = " ".join(heads).encode() + b" "
        d, raw = stream(head + b"".join(parts), Type=b"/ObjStm", N=len(plain), First=len(head))
        out += b"900 0 obj\n" + dump(d) + b"\nstream\n" + raw + b"\nendstream\nendobj\n"
        d, raw = stream(b"", Type=b"/XRef", Size=1, W=[1, 2, 1], **ends)
        out += b"901 0 obj\n" + dump(d) + b"\nstream\n" + raw + b"\nendstream\nendobj\nstartxref\n0\n%%EOF"
    else:
        out += b"trailer\n" + dump({"Size": 99, **ends}) + b"\nstartxref\n0\n%%EOF"
    return bytes(out)


def simple(contents: list[bytes], fonts: dict | None = None, page: dict | None = None, more: dict | None = None, **kw) -> bytes:
    """A document with a page for each content; objects 10, 11, ... are pages, 50, 51, ... contents."""
    fonts = fonts or {"F1": {"Type": b"/Font", "Subtype": b"/Type1", "BaseFont": b"/Helvetica"}}
    objects = {1: {"Type": b"/Catalog", "Pages": b"2 0 R"}, 2: {"Type": b"/Pages", "Count": len(contents), "Kids": [b"%d 0 R" % (10 + i) for i in range(len(contents))], "Resources": {"Font": fonts}}}
    for i, c in enumerate(contents):
        objects[10 + i] = {"Type": b"/Page", "Parent": b"2 0 R", "MediaBox": [0, 0, 612, 792], "Contents": b"%d 0 R" % (50 + i), **(page or {})}
        objects[50 + i] = stream(c)
    return build(objects | (more or {}), **kw)
