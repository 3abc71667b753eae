"""Writes heap dumps: for round trips through the reader."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
from pathlib import Path

# fixed values: type codes of the format, and their layout letters for struct
CODES = {"object": 2, "boolean": 4, "char": 5, "float": 6, "double": 7, "byte": 8, "short": 9, "int": 10, "long": 11}
FORMS = {4: "b", 5: "H", 6: "f", 7: "d", 8: "b", 9: "h", 10: "i", 11: "q"}


class Dump:
    def __init__(self, id_size=8):
        self.id_size, self.strings, self.loads, self.heap = id_size, {}, [], [b""]
        self.shapes = {}

    def raw(self, n):
        return (n or 0).to_bytes(self.id_size)

    def name(self, text):
        return self.strings.setdefault(text, 0x7000 + len(self.strings))

    def add(self, data):
        self.heap[-1] += data

    def segment(self):
        self.heap.append(b"")

    def root(self, tag, raw, rest=b""):
        self.add(bytes([tag]) + self.raw(raw) + rest)

    def cls(self, raw, name, fields=(), sup=0, loader=0, statics=(), size=None):
        """fields: (name, type name); statics: (name, raw)."""
        self.loads.append((raw, self.name(name)))
        self.shapes[raw] = (list(fields), sup)
        widths = {2: self.id_size, 4: 1, 5: 2, 6: 4, 7: 8, 8: 1, 9: 2, 10: 4, 11: 8}
        size = size if size is not None else 16 + sum(widths[CODES[t]] for c in self.chain(raw) for _, t in self.shapes[c][0])
        out = b"\x20" + self.raw(raw) + b"\0\0\0\0" + self.raw(sup) + self.raw(loader) + self.raw(0) * 4 + struct.pack(">I", size) + b"\0\0"
        out += struct.pack(">H", len(statics)) + b"".join(self.raw(self.name(n)) + b"\x02" + self.raw(r) for n, r in statics)
        out += struct.pack(">H", len(fields)) + b"".join(self.raw(self.name(n)) + bytes([CODES[t]]) for n, t in fields)
        self.add(out)

    def chain(self, raw):
        out = []
        while raw:
            out.append(raw)
            raw = self.shapes[raw][1]
        return out

    def obj(self, raw, cls, *values):
        kinds = [CODES[t] for c in self.chain(cls) for _, t in self.shapes[c][0]]
        data = b"".join(self.raw(v) if k == 2 else struct.pack(">" + FORMS[k], v) for k, v in zip(kinds, values, strict=True))
        self.add(b"\x21" + self.raw(raw) + b"\0\0\0\0" + self.raw(cls) + struct.pack(">I", len(data)) + data)

    def array(self, raw, cls, *elements):
        self.add(b"\x22" + self.raw(raw) + b"\0\0\0\0" + struct.pack(">I", len(elements)) + self.raw(cls) + b"".join(map(self.raw, elements)))

    def prims(self, raw, kind, data):
        code = CODES[kind]
        self.add(b"\x23" + self.raw(raw) + b"\0\0\0\0" + struct.pack(">I", len(data)) + bytes([code]) + b"".join(struct.pack(">" + FORMS[code], v) for v in data))

    def bytes(self):
        record = lambda tag, data: bytes([tag]) + b"\0\0\0\0" + struct.pack(">I", len(data)) + data
        out = b"JAVA PROFILE 1.0.2\0" + struct.pack(">I", self.id_size) + struct.pack(">Q", 1)
        out += b"".join(record(1, self.raw(i) + t.encode()) for t, i in self.strings.items())
        out += b"".join(record(2, struct.pack(">I", k) + self.raw(raw) + b"\0\0\0\0" + self.raw(n)) for k, (raw, n) in enumerate(self.loads))
        out += b"".join(record(0x1C, h) for h in self.heap) + record(0x2C, b"") + record(0x0E, b"junk")
        return out

    def write(self, path, form="plain"):
        data = self.bytes()
        if form == "gzip":
            data = gzip.compress(data)
        elif form == "zip":
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as archive:
                archive.writestr("readme.txt", "x")
                archive.writestr("heap.hprof", data)
            data = buffer.getvalue()
        Path(path).write_bytes(data)
        return str(path)
