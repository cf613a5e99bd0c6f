from lodewell.operators import symbols


def test_python_that_does_not_parse():
    text = "import os, sys as s\nfrom a.b import (c,\n  d as e)\n\n@wrap\nclass A(B):\n    x = (\n    def f(self, y):\n        return g(y)\n\n    async def _h(self):\n        self.k()\n\ndef z():\n    q(1\n"
    p = symbols.parse("python", text)
    assert p.symbols == [("A", "class", True, 5, 12), ("A::f", "method", True, 8, 9), ("A::_h", "method", False, 11, 12), ("z", "function", True, 14, 15)]
    assert p.imports == ["os", "sys", "a.b", "a.b.c", "a.b.d"] and p.called == ["B", "g", "k", "q"][1:]
    assert sorted(p.calls) == [("A", "wrap"), ("A::_h", "k"), ("A::f", "g"), ("z", "q")]


def test_python_by_lines_equals_the_parser():
    text = "from . import u\n\ndef f(a,\n      b):\n    def g():\n        return h(a)\n    return g\n\nclass C:\n    def m(self):\n        '''def no(): x()'''\n        return self.n()\n"
    a, b = symbols._python(text), symbols._python_lines(text)
    assert sorted(a.symbols) == sorted(b.symbols) and set(a.calls) == set(b.calls) and set(a.imports) == set(b.imports)
