"""Messages with places in a source text. Places are bytes; lines end at LF, CRLF or CR."""

from __future__ import annotations

import re
import warnings as python_warnings
from dataclasses import dataclass, field

_line_end = re.compile(rb"\r\n|\r|\n")


@dataclass(frozen=True)
class Source:
    text: bytes
    filename: str = ""
    tab_width: int = 4

    def __post_init__(self) -> None:
        if isinstance(self.text, str):
            object.__setattr__(self, "text", self.text.encode())
        if self.tab_width < 1:
            raise ValueError(f"a tab of {self.tab_width} columns can't be drawn")


@dataclass(frozen=True)
class SourceSpan:
    """Bytes begin .. end-1; an empty span is a point."""

    source: Source
    begin: int
    end: int

    def __post_init__(self) -> None:
        if not 0 <= self.begin <= self.end <= len(self.source.text):
            raise ValueError(f"bytes {self.begin} to {self.end} don't lie in a text of {len(self.source.text)}")

    def _ends_before(self) -> list[tuple[int, int]]:
        """Line ends that begin before the span, a CRLF that it splits counted as begun."""
        return [m.span() for m in _line_end.finditer(self.source.text) if m.start() < self.begin]

    @property
    def line(self) -> int:
        return 1 + len(self._ends_before())

    @property
    def line_start(self) -> int:
        ends = self._ends_before()
        return min(ends[-1][1], self.begin) if ends else 0

    @property
    def column(self) -> int:
        return self.begin - self.line_start + 1


@dataclass(frozen=True)
class DiagnosticNote:
    message: str
    location: SourceSpan | None = None


@dataclass(frozen=True)
class Diagnostic:
    message: str
    location: SourceSpan | None = None
    notes: tuple[DiagnosticNote, ...] = ()

    def __str__(self) -> str:
        return format_diagnostic(self)


def _located(message: str, at: SourceSpan | None) -> str:
    if at is None:
        return f"{message}\n"
    text, tab = at.source.text, at.source.tab_width
    start = at.line_start
    end = m.start() if (m := _line_end.search(text, start)) else len(text)
    width = lambda a, b: sum(tab if x == 9 else 1 for x in text[a:b])
    where = f"In file {at.source.filename}, line {at.line}:" if at.source.filename else f"In line {at.line}:"
    shown = text[start:end].replace(b"\t", b" " * tab).decode("utf-8", "replace")
    if at.begin == at.end:
        mark = "_" * width(start, at.begin) + "^_"
    else:
        mark = " " * width(start, at.begin) + "~" * width(at.begin, min(at.end, end)) + " <<-- Here"
    return f"{where}\n{message}\n{shown}\n{mark}\n"


def format_diagnostic(d: Diagnostic) -> str:
    """The message, the first line of its place with a mark below, and the notes likewise."""
    return _located(d.message, d.location) + "".join(_located(f"note: {n.message}", n.location) for n in d.notes)


class DiagnosticError(Exception):
    """An error with a diagnostic."""

    def __init__(self, diagnostic: Diagnostic | str):
        self.diagnostic = Diagnostic(diagnostic) if isinstance(diagnostic, str) else diagnostic
        super().__init__(format_diagnostic(self.diagnostic))


class SemanticError(DiagnosticError):
    """The text can be read but means nothing."""


class ParseError(DiagnosticError):
    """The text can't be read."""


@dataclass
class Warnings:
    """Warnings of one operation."""

    items: list[Diagnostic] = field(default_factory=list)

    def add(self, diagnostic: Diagnostic) -> None:
        self.items.append(diagnostic)

    def issue(self, category: type[Warning] = UserWarning) -> None:
        """Hand them to Python's warnings."""
        for d in self.items:
            python_warnings.warn(format_diagnostic(d), category, stacklevel=2)
