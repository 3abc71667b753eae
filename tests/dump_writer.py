"""A small heap dump with known contents."""

from graphlens.sources.hprof_writer import Dump


def known_objects(id_size=8):
    """Classes and objects whose answers the tests know."""
    high = 1 << (8 * id_size - 1)  # ids with the top bit set
    d = Dump(id_size)
    d.cls(1, "java/lang/Object", size=16)
    d.cls(2, "java/lang/Class", sup=1)
    d.cls(3, "java/lang/String", [("value", "object"), ("coder", "byte")], sup=1)
    d.cls(4, "demo/Base", [("ref", "object"), ("n", "int")], sup=1)
    d.cls(5, "demo/Sub", [("first", "object"), ("second", "object"), ("m", "int")], sup=4, loader=high + 1, statics=[("one", high + 1), ("two", high + 2)])
    d.cls(6, "demo/All", [("z", "boolean"), ("c", "char"), ("f", "float"), ("d", "double"), ("b", "byte"), ("s", "short"), ("l", "long")], sup=1)
    d.cls(7, "[Ljava/lang/Object;", sup=1)
    d.cls(8, "FooFoo", sup=1)
    d.cls(9, "FooFoo", sup=1)
    d.cls(10, "java/lang/Thread", [("name", "object")], sup=1)
    d.obj(high + 1, 4, high + 2, 42)
    d.obj(high + 2, 4, 0, 99)
    d.obj(high + 3, 5, 0, high + 1, 7, high + 2, 111)  # a null before the reference
    d.segment()
    d.prims(20, "byte", b"hello world")
    d.obj(21, 3, 20, 0)
    d.prims(22, "byte", [x - 256 if x > 127 else x for x in "grüße".encode("utf-16-le")])
    d.obj(23, 3, 22, 1)
    d.prims(24, "char", [ord(c) for c in "x" * 60])
    d.obj(25, 3, 24, 0)
    d.obj(26, 6, 1, 0xFFFF, 1.5, -2.25, -3, -300, -(1 << 40))
    d.array(27, 7, 21, 0, high + 1, high + 3)
    d.obj(28, 8)
    d.obj(29, 9)
    d.obj(30, 10, 21)
    d.prims(31, "int", [1, -2, 3])
    d.prims(32, "double", [])
    d.obj(33, 4, 999, 5)  # its reference is not in the dump
    rest = b"\0" * 8
    d.root(1, 27, d.raw(0))
    d.root(8, 30, rest)
    d.root(3, 30, rest)
    d.root(5, 26)
    d.root(0xFF, 25)
    d.root(5, 12345)  # no such object
    return d
