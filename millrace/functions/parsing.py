"""A toolkit for parsers of symbols in parentheses: skipping, keywords, errors with places. No grammar of its own."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from .diagnostics import Diagnostic, DiagnosticNote, ParseError, Source, SourceSpan

#: Messages that callers match.
EXPECTING, EXPECTED_IN, STARTS_HERE, TRAILING = "Error! Expecting: {what} here:", "Expected {what} while parsing {name}", "{name} starts here", "Unexpected trailing input."

#: White space, and comments from a semicolon to the end of the line.
_skipped = re.compile(rb"(?:[ \t\n\x0b\x0c\r]|;[^\r\n]*)*")
#: A symbol ends at parentheses, semicolons and white space.
_symbol = re.compile(rb"[^() \t\n\x0b\x0c\r;]+")


class Parser:
    """A position in a source, and the first error since the last clear_error()."""

    def __init__(self, source: Source):
        self.source, self.at = source, 0
        self.error: Diagnostic | None = None

    def clear_error(self) -> None:
        self.error = None

    def record_error(self, at: int, message: str, notes: tuple[DiagnosticNote, ...] = ()) -> None:
        """The first error stays."""
        if self.error is None:
            self.error = Diagnostic(message, self.span(at, at), notes)

    def span(self, begin: int, end: int) -> SourceSpan:
        return SourceSpan(self.source, begin, end)

    def skip(self) -> int:
        self.at = _skipped.match(self.source.text, self.at).end()  # type: ignore[union-attr]
        return self.at

    def done(self) -> bool:
        return self.skip() == len(self.source.text)

    def literal(self, text: str) -> bool:
        if self.source.text.startswith(text.encode(), self.skip()):
            self.at += len(text.encode())
            return True
        return False

    def symbol(self) -> str | None:
        m = _symbol.match(self.source.text, self.skip())
        if m:
            self.at = m.end()
        return m[0].decode("utf-8", "replace") if m else None

    def keyword(self, text: str) -> bool:
        """The keyword in any case, as a whole symbol."""
        before = self.skip()
        if (s := self.symbol()) is not None and s.lower() == text.lower():
            return True
        self.at = before
        return False

    def expect(self, found: object, what: str, fail: Callable[[], None] | None = None) -> object:
        """found, or a ParseError that `what` is missing here."""
        if found is None or found is False:
            at = self.skip()
            if fail:
                fail()
            self.record_error(at, EXPECTING.format(what=what))
            raise ParseError(self.error)  # type: ignore[arg-type]
        return found

    @contextmanager
    def context(self, name: str) -> Iterator[None]:
        """Within the block, a missing part is reported as of `name`, with a note where that starts."""
        start, outer = self.skip(), getattr(self, "_contexts", [])
        self._contexts = [*outer, (name, start)]
        try:
            yield
        finally:
            self._contexts = outer

    def require(self, found: object, what: str) -> object:
        """Like expect(), with the message of the innermost context."""
        contexts = getattr(self, "_contexts", [])
        if not contexts:
            return self.expect(found, what)
        name, start = contexts[-1]

        def fail() -> None:
            self.record_error(self.at, EXPECTED_IN.format(what=what, name=name), (DiagnosticNote(STARTS_HERE.format(name=name), self.span(start, start)),))

        return self.expect(found, what, fail)

    def parse_full(self, rule: Callable[[Parser], object]) -> object:
        """The rule's result over the whole source; a recorded error or trailing input raises."""
        self.clear_error()
        self.at = 0
        out = rule(self)
        if self.error is None and not self.done():
            self.record_error(self.at, TRAILING)
        if self.error is not None:
            raise ParseError(self.error)
        return out


def format_error_at(source: Source, begin: int, message: str, end: int | None = None) -> str:
    """A message with the place of a node's bytes begin .. end-1, or of the point begin, after white space and comments that it starts with."""
    begin = _skipped.match(source.text, begin).end()  # type: ignore[union-attr]
    return str(Diagnostic(message, SourceSpan(source, begin, begin if end is None else max(begin, end))))
