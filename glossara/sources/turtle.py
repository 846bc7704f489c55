"""A reader of the Turtle syntax for triples."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

_A = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_TOKEN = re.compile(
    r"""(?P<space>(?:\s|\#[^\n]*)+)|(?P<iri><[^<>"{}|^`\x00-\x20]*>)|(?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|\'\'\'(?:(?:'|\'\')?(?:[^'\\]|\\.))*\'\'\')|"""
    r"""(?P<text>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')|(?P<word>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))|"""
    r"""(?P<blank>_:[\w.·-]*[\w·-])|(?P<name>[^\W\d_][\w.·-]*:(?:(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])(?:[\w:.·-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])*)?|:(?:(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])(?:[\w:.·-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])*)?)|"""
    r"""(?P<key>[A-Za-z]+)|(?P<mark>[.;,\[\]()])""",
    re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text)


class _Reader:
    def __init__(self, text: str, tag: str):
        self.tag = tag
        self.text, self.at, self.made = text, 0, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.kind = self.value = None
        self.out: list[tuple] = []
        self.step()

    def step(self) -> None:
        while True:
            if self.at >= len(self.text):
                self.kind = self.value = None
                return
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise self.error("unknown characters")
            self.kind, self.value, self.at = m.lastgroup, m[0], m.end()
            if self.kind in ("name", "blank") and self.value.endswith("."):
                dots = len(self.value) - len(self.value.rstrip("."))  # a dot at the end closes the statement
                self.value, self.at = self.value[:-dots], self.at - dots
            if self.kind != "space":
                return

    def error(self, what: str) -> ValueError:
        return ValueError(f"line {self.text.count(chr(10), 0, self.at) + 1}: {what} near {self.text[max(0, self.at - 20) : self.at + 20]!r}")

    def take(self, value: str) -> None:
        if self.value != value:
            raise self.error(f"{value!r} is missing")
        self.step()

    def iri(self) -> str:
        kind, value = self.kind, self.value
        self.step()
        if kind == "iri":
            own = _unescape(value[1:-1])
            return urljoin(self.base, own) if self.base else own
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise self.error(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise self.error("an IRI is missing")

    def blank(self) -> str:
        self.made += 1
        return f"_:{self.tag}made{self.made}"

    def term(self) -> tuple[str, str | None]:
        """(value, language) of a subject or object; triples of nested ones are added."""
        kind, value = self.kind, self.value
        if kind in ("iri", "name"):
            return self.iri(), None
        self.step()
        if kind == "blank":
            return f"_:{self.tag}{value[2:]}", None
        if kind in ("text", "long"):
            cut = 3 if kind == "long" else 1
            own, language = _unescape(value[cut:-cut]), None
            if self.kind == "word":
                language = self.value[1:]
                self.step()
            elif self.kind == "type":
                self.step()
                self.iri()
            return own, language
        if kind == "number" or kind == "key" and value in ("true", "false"):
            return value, None
        if value == "[":
            node = self.blank()
            if self.value != "]":
                self.properties(node)
            self.take("]")
            return node, None
        if value == "(":
            items = []
            while self.value != ")":
                if self.kind is None:
                    raise self.error("')' is missing")
                items.append(self.term())
            self.step()
            nodes = [self.blank() for _ in items] + [_A + "nil"]
            for k, (item, language) in enumerate(items):
                self.out += [(nodes[k], _A + "first", item, language), (nodes[k], _A + "rest", nodes[k + 1], None)]
            return nodes[0], None
        raise self.error("a term is missing")

    def properties(self, subject: str) -> None:
        while True:
            if self.kind == "key" and self.value == "a":
                self.step()
                verb = _A + "type"
            else:
                verb = self.iri()
            while True:
                value, language = self.term()
                self.out.append((subject, verb, value, language))
                if self.value != ",":
                    break
                self.step()
            while self.value == ";":
                self.step()
            if self.value in (".", "]") or self.kind is None:
                return

    def directive(self) -> bool:
        word = (self.value or "").lower().lstrip("@")
        if self.kind not in ("word", "key") or word not in ("prefix", "base"):
            return False
        dotted = self.kind == "word"
        self.step()
        if word == "prefix":
            if self.kind != "name" or not self.value.endswith(":"):
                raise self.error("a prefix is missing")
            prefix = self.value[:-1]
            self.step()
            self.prefixes[prefix] = self.iri()
        else:
            self.base = self.iri()
        if dotted:
            self.take(".")
        return True


def triples(text: str, tag: str = "") -> Iterator[tuple[str, str, str, str | None]]:
    """(subject, predicate, object, language), statement by statement; a syntax error is a ValueError with its line.

    tag: put before the names of blank nodes, which hold inside one file only.
    """
    reader = _Reader(text, tag)
    while reader.kind is not None:
        if reader.directive():
            continue
        nested = reader.value == "["
        if reader.kind not in ("iri", "name", "blank") and reader.value not in ("[", "("):
            raise reader.error("a subject is missing")
        subject, _ = reader.term()
        if not (nested and reader.value == "."):
            reader.properties(subject)
        reader.take(".")
        yield from reader.out
        reader.out.clear()
